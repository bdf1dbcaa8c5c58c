"""Operator 2: token counts with a whole-token shortcut.

Once in each worker, every vocabulary string that ends a word is decoded and encoded by the
library alone: those that come back as one token are proven whole tokens. A text is then cut into
pre-tokens; those in the proven set count one, and only the others go to the library, each distinct
one once (a bounded memo keeps their counts).

The cutting is done here for characters of a range where it was proven equal to the library's own
normalising and splitting (tests go through all of it). In a text with others, the words between
blanks that hold such characters are counted by the library, each distinct one once, and the rest is
cut here: no token, and no rule of normalising, reaches over a blank. Only a text that holds the
string of a special token is encoded whole by the library.

Defined results: null is an empty text, with 0 bytes and 0 tokens; identical rows each keep their
row; null ids are carried; an empty table gives an empty result; further columns are ignored,
whatever their names. Rows stay where they are read (no shuffle); memory is bounded by a batch, the
memo and the longest text, which is taken whole.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from skerry.llm.common import table

#: Fixed value: the vocabulary file's own splitting pattern, which must match it.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: ASCII, Latin-1 and Latin Extended-A without those that change length or case oddly, dashes and quotes.
SAFE = regex.compile(r"[\x00-\x1B\x20-\x7E\xA0-įĲ-ňŊ-ž‐-‧€]*")
BLANKS = regex.compile(r"[ \t\n]+")
MEMO = 200_000
LIMIT = 2048


class Counting:
    """Counts of one vocabulary file; made once in each worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.cut = regex.compile(PRETOKEN)
        self.whole = self.proven()
        self.memo: dict[str, int] = {}

    def proven(self) -> frozenset[str]:
        """Vocabulary strings that the library encodes alone as exactly one token, and cuts as one."""
        letters = {c: b for b, c in _byte_letters().items()}
        end = "</w>"
        words = []
        for v in self.library.get_vocab(with_added_tokens=False):
            if v.endswith(end) and all(c in letters for c in v[: -len(end)]):
                try:
                    words.append(bytes(letters[c] for c in v[: -len(end)]).decode("utf-8"))
                except UnicodeDecodeError:
                    continue
        words = [w for w in words if w and self.cut.findall(w) == [w]]
        return frozenset(w for w, e in zip(words, self.library.encode_batch(words, add_special_tokens=False), strict=True) if len(e.ids) == 1)

    def count(self, text: str) -> int:
        if any(s in text for s in self.special):
            return len(self.library.encode(text, add_special_tokens=False).ids)
        odd: Counter[str] = Counter()
        if not SAFE.fullmatch(text):
            words = BLANKS.split(text)
            odd.update(w for w in words if not SAFE.fullmatch(w))
            text = " ".join(w for w in words if w not in odd)
        found = Counter(self.cut.findall(text.lower()))
        found.update(odd)  # these hold characters that no pre-token from here does
        total, merge = 0, []
        whole, memo = self.whole, self.memo
        for word, n in found.items():
            if word in whole:
                total += n
            elif (k := memo.get(word)) is not None:
                total += k * n
            else:
                merge.append(word)
        if merge:
            if len(memo) + len(merge) > MEMO:
                memo.clear()
            for word, e in zip(merge, self.library.encode_batch_fast(merge, add_special_tokens=False), strict=True):
                total += (k := len(e.ids)) * found[word]
                if len(word) <= 64 and len(memo) < MEMO:
                    memo[word] = k
        return total


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def counting(path: str) -> Counting:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Counting(path)


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(docs: DataFrame, vocabulary_name: str = "word_bpe_49k.json", id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row."""

    def run(batches):
        counter = counting(vocabulary(vocabulary_name))
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            n = [counter.count(x) for x in texts]
            sizes = [len(x.encode("utf-8")) for x in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


QUERIES = {"op2_token_counts": op2_token_counts}
