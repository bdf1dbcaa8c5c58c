"""Operator 3: SentencePiece encoding and decoding by streaming Viterbi.

The vocabulary at hand is a merge (BPE) model, for which the path of highest summed score is not
what the library gives. The dynamic programme therefore keeps its form and changes its rule: at
each place the surviving path is the one whose last two pieces the merges leave apart (encoding
their joined text gives these two pieces again). Exactly one piece that ends at a place meets this,
so the table has one backpointer a place, and the ids are the library's own.

Only a window of the longest piece's length stays open. Ids are committed whenever all backpointer
paths of the window meet in one boundary. Between characters that stand side by side in no piece,
and before every blank that follows something else, all paths must meet: texts are cut there first
into parts. Arrow numbers the distinct parts of a block of texts; only those that no bounded memo
knows are encoded, in sorted order, so that each keeps the table of the prefix that it shares with
the one before. The ids of all texts are then gathered by number. Runs of three or more blanks,
whose pieces share one score, are merged directly.

Each part's ids are decoded once, when they are made; a text's round trip holds when those of all its
parts do. Memory is bounded by the memo, which lives as long as a task, and a block: texts are taken in blocks of about `BLOCK`
characters, and longer ones are cut before blanks (a run of that length without one stays whole).

Defined results: null and empty texts have no ids; identical rows each keep their row; characters
outside the vocabulary become their UTF-8 bytes' pieces; a text holding U+2581 decodes with blanks
in its place, as with the library, and counts as no round trip. Rows stay where they are read.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from skerry.llm.common import table

BLANK = "▁"
MEMO, PAIRS, LONG, BLOCK = 120_000, 150_000, 64, 1 << 20
BREAK = re.compile(f"(?<=[^ {BLANK}])[ {BLANK}]")  # a blank that follows something else
ROWS = 512  # texts encoded at once


class Memo:
    """part -> ids. Full, it becomes the old generation, whose parts come back when they are met again."""

    def __init__(self):
        self.new: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def get(self, part: str) -> tuple[int, ...] | None:
        if (ids := self.new.get(part)) is None and (ids := self.old.get(part)) is not None:
            self.put(part, ids)
        return ids

    def put(self, part: str, ids: tuple[int, ...]) -> None:
        if len(part) <= LONG:
            if len(self.new) >= MEMO:
                self.old, self.new = self.new, {}
            self.new[part] = ids


def blocks(texts: list[str | None]) -> Iterator[tuple[list[int], list[str], list[bool]]]:
    """Texts in blocks of about `BLOCK` characters: (number, stretch, whether the text begins with it) of each."""
    which, held, first, size = [], [], [], 0
    for i, text in enumerate(texts):
        at, text = 0, text or ""
        while at < len(text):
            end = at + BLOCK - size
            found = BREAK.search(text, end) if end < len(text) else None
            end = found.start() if found else len(text)
            which.append(i)
            held.append(text[at:end])
            first.append(not at)
            size += len(held[-1])
            at = end
            if size >= BLOCK:
                yield which, held, first
                which, held, first, size = [], [], [], 0
    if held:
        yield which, held, first


class PieceCodec:
    """Encoder and decoder of one model file; made once in each worker."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        self.pieces = {i: p for p, i in self.ids.items()}
        self.rank = {p: -model.get_score(i) for p, i in self.ids.items()}
        self.byte = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.bytes = {i: p.encode() for i, p in self.pieces.items()} | {i: bytes([b]) for b, i in self.byte.items()}
        self.halves: dict[str, tuple[str, str]] = {}
        made = {p for p in self.ids if len(p) > 1 and self.merged(p, self.halves) == [p]}
        self.order = {p: self.rank[p] for p in made}  # pieces that merging makes; single characters have none
        self.ids = {p: i for p, i in self.ids.items() if len(p) == 1 or p in made}
        self.longest = max(map(len, self.ids))
        self.reach: dict[str, int] = {}  # the longest piece that ends in these three characters
        for p in self.ids:
            self.reach[p[-3:]] = max(len(p), self.reach.get(p[-3:], 2))
        letters = sorted({c for p in self.rank for c in p})
        self.letter = np.zeros(0x110000, dtype=np.uint16)  # 0: in no piece
        self.letter[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        self.side_by_side = np.zeros((len(letters) + 1,) * 2, dtype=bool)
        pairs = np.array(sorted({(ord(p[k]), ord(p[k + 1])) for p in self.rank for k in range(len(p) - 1)})).reshape(-1, 2)
        self.side_by_side[self.letter[pairs[:, 0]], self.letter[pairs[:, 1]]] = True
        if not any(BLANK in p.lstrip(BLANK) for p in self.rank):  # no piece goes on over a blank
            other = np.arange(len(letters) + 1) != self.letter[ord(BLANK)]
            self.side_by_side[other, self.letter[ord(BLANK)]] = False
        self.apart: dict[int, bool] = {}  # by both ids in one number
        self.memo = Memo()
        self.faults: set[str] = set()  # parts whose ids do not decode to them

    def forget(self) -> None:
        """Empties the memos and gives their memory back, for what the worker does next."""
        self.memo = Memo()
        self.apart.clear()
        self.faults.clear()
        pa.default_memory_pool().release_unused()

    def merged(self, s: str, last: dict | None = None) -> list[str]:
        """The pieces that merging by rank, leftmost first among equals, leaves; `last` gets the two halves of each."""
        part = list(s)
        left, right = list(range(-1, len(s) - 1)), list(range(1, len(s) + 1))
        heap: list[tuple[float, int, str]] = []

        def offer(a: int) -> None:
            b = right[a]
            if b < len(part) and (joined := part[a] + part[b]) in self.rank:
                heapq.heappush(heap, (self.rank[joined], a, joined))

        for a in range(len(s) - 1):
            offer(a)
        while heap:
            _, a, joined = heapq.heappop(heap)
            if part[a] and (b := right[a]) < len(part) and part[b] and part[a] + part[b] == joined:
                if last is not None:
                    last[joined] = part[a], part[b]
                part[a], part[b] = joined, ""
                right[a] = right[b]
                if right[b] < len(part):
                    left[right[b]] = a
                offer(a)
                if left[a] >= 0:
                    offer(left[a])
        return [p for p in part if p]

    def _apart(self, a: int, b: int) -> bool:
        """Whether merging leaves the pieces a and b side by side; a below 0: b stands first.

        The merges that made both are undone from the latest on. The two stay apart unless, at some
        stage, the parts at the seam make a piece that ranks before whatever was undone last (the
        left one of equals goes first).
        """
        if a < 0:
            return True
        head, tail = self.pieces[a], self.pieces[b]
        rank, halves, order = self.rank, self.halves, self.order
        before, or_equal = float("inf"), False
        known = True
        while True:
            joined = rank.get(head + tail)
            if joined is not None and (joined < before or or_equal and joined == before):
                known = False
                break
            h, t = order.get(head, -1.0), order.get(tail, -1.0)
            if h < 0 and t < 0:
                break
            if h > t:
                before, or_equal, head = h, False, halves[head][1]
            else:
                before, or_equal, tail = t, True, halves[tail][0]
        if len(self.apart) >= PAIRS:
            self.apart.clear()
        self.apart[a << 24 | b] = known
        return known

    def viterbi(self, s: str, nodes: list, shared: int = 0, window: int = 0) -> list[int]:
        """The ids of `s`, of vocabulary characters only.

        `nodes` holds the places' (node before, id) and comes filled up to `shared` characters; with
        a `window` it is kept that short, and ids that all paths share are committed.
        """
        ids, apart, reach = self.ids.get, self.apart.get, self.reach.get
        out: list[int] = []
        del nodes[shared + 1 :]
        for i in range(shared + 1, len(s) + 1):
            n = reach(s[i - 3 : i], 2) if i > 2 else i
            if n > (held := len(nodes)):
                n = held
            while n:
                if (k := ids(s[i - n : i])) is not None and (before := nodes[-n]) is not None:
                    ok = apart(before[1] << 24 | k)
                    if ok if ok is not None else self._apart(before[1], k):
                        nodes.append((before, k))
                        break
                n -= 1
            else:
                nodes.append(None)
            if window and len(nodes) > 4 * window:
                del nodes[:-window]
                self._commit(nodes, out)
        path, node = [], nodes[-1]
        while node[0] is not None:
            path.append(node[1])
            node = node[0]
        out += reversed(path)
        return out

    @staticmethod
    def _commit(nodes: list, out: list[int]) -> None:
        """Where all paths of the window meet, their common ids go to `out` and the paths are cut."""
        paths = []
        for node in nodes:
            if node is not None:
                path = []
                while node is not None:
                    path.append(node)
                    node = node[0]
                paths.append(path[::-1])
        shared = 0
        while all(len(p) > shared + 1 for p in paths) and len({id(p[shared + 1]) for p in paths}) == 1:
            shared += 1
        if not shared:
            return
        out += [node[1] for node in paths[0][1 : shared + 1]]
        fresh: dict[int, tuple] = {id(paths[0][shared]): (None, paths[0][shared][1])}
        for p in paths:
            for node in p[shared + 1 :]:
                fresh.setdefault(id(node), (fresh[id(node[0])], node[1]))
        nodes[:] = [None if node is None else fresh[id(node)] for node in nodes]

    def encode_parts(self, parts: list[str]) -> Iterator[tuple[str, tuple[int, ...]]]:
        """Each part with its ids; inside a part any two neighbours share some piece. Sorted parts share prefixes."""
        nodes: list = [(None, -1)]
        before = ""
        for s in sorted(parts):
            if (k := self.ids.get(s)) is not None:
                yield s, (k,)
            elif len(s) == 1:
                yield s, tuple(self.byte[b] for b in s.encode("utf-8", "replace"))
            elif BLANK * 3 in s:
                yield s, tuple(self.ids[p] for p in self.merged(s))
            elif len(s) > LONG:
                yield s, tuple(self.viterbi(s, [(None, -1)], window=self.longest))
            else:
                shared, most = 0, min(len(s), len(before))
                while shared < most and s[shared] == before[shared]:
                    shared += 1
                yield s, tuple(self.viterbi(s, nodes, shared))
                before = s

    def cut(self, stretches: list[str], first: list[bool]) -> tuple[pa.StringArray, np.ndarray]:
        """All parts of the stretches in order, and where each stretch's parts begin (and the last ends)."""
        spaced = [(BLANK if f else "") + x.replace(" ", BLANK) for x, f in zip(stretches, first, strict=True)]
        codes = self.letter[np.frombuffer("".join(spaced).encode("utf-32-le", "replace"), dtype="<u4")]
        data = np.frombuffer("".join(spaced).encode("utf-8", "replace"), dtype=np.uint8)
        begins = np.concatenate(([0], np.cumsum([len(x) for x in spaced])))
        edge = np.ones(len(codes) + 1, dtype=bool)
        edge[1:-1] = ~self.side_by_side[codes[:-1], codes[1:]]
        edge[begins] = True
        at = np.flatnonzero(edge)
        places = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))[at].astype(np.int32)
        array = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(places), pa.py_buffer(data))
        return array, np.searchsorted(at, begins)

    def encode_block(self, stretches: list[str], first: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all stretches, where each one's begin, whether each one's decode to it)."""
        parts, begins = self.cut(stretches, first)
        numbered = parts.dictionary_encode()
        distinct, number = numbered.dictionary.to_pylist(), numbered.indices.to_numpy()
        known = [self.memo.get(p) for p in distinct]
        new = {p: k for k, (p, ids) in enumerate(zip(distinct, known, strict=True)) if ids is None}
        of = self.bytes
        for p, ids in self.encode_parts(list(new)):
            known[new[p]] = ids
            self.memo.put(p, ids)
            if b"".join([of[i] for i in ids]) != p.encode():
                self.faults.add(p)
        n = np.fromiter(map(len, known), dtype=np.int64, count=len(known))
        flat = np.fromiter(chain.from_iterable(known), dtype=np.int32, count=int(n.sum()))
        starts, counts = (np.cumsum(n) - n)[number], n[number]
        ends = np.concatenate(([0], np.cumsum(counts)))
        ids = flat[np.repeat(starts - ends[:-1], counts) + np.arange(ends[-1])]
        bad = np.array([p in self.faults for p in distinct])[number] if self.faults else np.zeros(len(number), dtype=bool)
        wrong = np.diff(np.concatenate(([0], np.cumsum(bad)))[begins])
        sound = np.array([not k and BLANK not in x for k, x in zip(wrong.tolist(), stretches, strict=True)])
        return ids, ends[begins], sound

    def encode_many(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[bool]]:
        """The ids of each whole text, and whether they decode to it."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        trips = [True] * len(texts)
        for which, stretches, first in blocks(texts):
            ids, begins, sound = self.encode_block(stretches, first)
            for k, i in enumerate(which):
                out[i].append(ids[begins[k] : begins[k + 1]])
                trips[i] &= bool(sound[k])
        none = np.zeros(0, dtype=np.int32)
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else none for x in out], trips

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of one whole text."""
        return self.encode_many([text])[0][0]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of the ids, without the blank that encoding puts in front."""
        of = self.bytes
        text = b"".join([of.get(i, b"") for i in ids]).decode("utf-8", "replace").replace(BLANK, " ")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(path)


def vocabulary(name: str) -> str:
    """The place of a public model file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode_pieces(docs: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, n_tokens, ids_crc32 (of the ids as 32-bit little-endian), round_trip (decoding gives the text)."""

    def run(batches):
        c = codec(vocabulary(model))
        for b in batches:
            for at in range(0, len(b), ROWS):
                part = b.slice(at, ROWS)
                ids, trips = c.encode_many(part.column(1).to_pylist())
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                columns = [
                    part.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(np.diff(ends).astype(np.int64)),
                    pa.array([crc32(np.ascontiguousarray(x, dtype="<i4")) for x in ids], pa.int64()), pa.array(trips, pa.bool_())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "n_tokens", "ids_crc32", "round_trip"])
        c.forget()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, ids array<int>, n_tokens long, ids_crc32 long, round_trip boolean")


def decode_pieces(encoded: DataFrame, model: str = "piece_bpe_32k.model", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text of each row's ids (null ids: an empty text)."""

    def run(batches):
        c = codec(vocabulary(model))
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x or ()) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    kind = encoded.schema[id_col].dataType.simpleString()
    return encoded.select(id_col, ids_col).mapInArrow(run, f"doc_id {kind}, text string")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents"))


QUERIES = {"op3_sentencepiece": op3_sentencepiece}
