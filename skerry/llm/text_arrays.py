"""Words of whole texts as numpy arrays of 64-bit hashes, a bounded piece of text at a time."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

PIECE = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_FILLED = np.ones(256, dtype=bool)
_FILLED[[0x20, *range(0x09, 0x0E)]] = False
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _powers or len(_powers["p"]) < n:
        size = max(n, 2 * PIECE)
        for key, base in (("p", _BASE), ("i", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, base, dtype=np.uint64)
            p[0] = 1
            _powers[key] = np.cumprod(p, dtype=np.uint64)
    return _powers["p"][:n], _powers["i"][:n]


def word_spans(data: np.ndarray, letters: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes that `letters` marks."""
    inside = np.empty(len(data) + 2, dtype=np.int8)
    inside[0] = inside[-1] = 0
    inside[1:-1] = letters[data]
    edges = np.diff(inside)
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes; equal bytes give equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    power, inverse = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def pieces(text: str, size: int = PIECE, breaks: str = " \n") -> Iterator[str]:
    """The text in pieces of about `size` characters that end after a blank, so no word is cut.

    A run without any blank is never cut, however long it is.
    """
    at = 0
    while len(text) - at > size:
        end = max(text.rfind(b, at + 1, at + size) for b in breaks)
        if end < 0:
            found = [x for b in breaks if (x := text.find(b, at + size)) >= 0]
            end = min(found) if found else len(text) - 1
        yield text[at : end + 1]
        at = end + 1
    if at < len(text) or not at:
        yield text[at:]


def hashed_words(texts: Iterable[str | None], lower: bool = True, letters: np.ndarray = _WORD) -> Iterator[tuple[list[int], list[int], np.ndarray]]:
    """Blocks of (text numbers, words of each, word hashes in order); a long text may span blocks.

    Texts are lower-cased as a whole; words are runs of digits, ASCII letters and all non-ASCII
    characters, or of the bytes that `letters` marks.
    """
    which: list[int] = []
    held: list[bytes] = []
    size = 0

    def flush():
        data = np.frombuffer(b"\n".join(held), dtype=np.uint8)
        starts, ends = word_spans(data, letters)
        hashes = hash_spans(data, starts, ends)
        edges = np.cumsum([len(x) + 1 for x in held])
        counts = np.diff(np.searchsorted(starts, edges, side="left"), prepend=0)
        return which[:], counts.tolist(), hashes

    for i, text in enumerate(texts):
        for piece in pieces((text.lower() if lower else text) if text else ""):
            raw = piece.encode("utf-8", "surrogatepass")
            if held and size + len(raw) > PIECE:
                yield flush()
                which, held, size = [], [], 0
            which.append(i)
            held.append(raw)
            size += len(raw)
    if held:
        yield flush()


def words_of_each(texts: Iterable[str | None], **how) -> Iterator[np.ndarray]:
    """The word hashes of each text in turn."""
    at, parts = 0, []
    for which, counts, hashes in hashed_words(texts, **how):
        ends = np.cumsum(counts)
        for i, count, end in zip(which, counts, ends, strict=True):
            if i != at:
                yield np.concatenate(parts) if len(parts) != 1 else parts[0]
                at, parts = i, []
            parts.append(hashes[end - count : end])
    if parts:
        yield np.concatenate(parts) if len(parts) != 1 else parts[0]
