"""Operator 7: language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled text. A text is
cross-parsed with each automaton: from where the last phrase ended, the longest stretch that occurs
in the language's text is the next phrase. The language that needs the fewest phrases a character
wins; ties go to the first name in order.

Texts are folded before: letters in lower case, everything else one blank. Each language's alphabet
is that of its sample, whatever its size: moves that would fill more than a table of `DENSE` places
are kept sparse (one move of each state beside it, the others in one sorted array).

Many stretches of `BLOCK` folded characters are parsed side by side with array operations. A stretch
is parsed from its own beginning first; then the state that the stretch before leaves is carried in,
until a phrase begins where one of the first parse did (from there on both are the same). So the
phrases are those of the whole text in one go, however long.

Bounds of learning, documented parameters: `max_docs` labelled documents a language, and whole texts
of these until `lang_chars` characters are reached. Texts of up to `short` characters come first, in
the order of a hash of the id; longer ones follow by length. A language whose first text alone is
longer than `lang_chars` learns from that much of it. Every language is learnt. Learning sees only
rows whose crc32(id) mod 4 is not 2.

Defined results: null texts, and texts without a letter, are `und` with score 0; null ids are never
learnt from nor held out; with nothing to learn from (an empty table too), every text is `und`; ties
go to the first language by name; identical rows each keep their row; further columns are ignored,
whatever their names. Scoring moves no rows; memory is that of a batch and the longest text.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skerry.llm.common import table

BLOCK, LANES = 1024, 16384  # characters a stretch; stretches times languages parsed at once
DENSE = 24 << 20  # moves of one table (96 MB); beyond that, moves are sparse
HELD = 2


def remainder(id_col: str, of: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(of))


class Automaton:
    """The suffix automaton of a sequence of small integers: the moves of each state."""

    def __init__(self, codes: np.ndarray):
        moves: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in codes.tolist():
            cur = len(moves)
            moves.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in moves[p]:
                moves[p][c] = cur
                p = link[p]
            if p >= 0:
                q = moves[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    copy = len(moves)
                    moves.append(dict(moves[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and moves[p].get(c) == q:
                        moves[p][c] = copy
                        p = link[p]
                    link[q] = link[cur] = copy
            last = cur
        self.moves = moves


class Parser:
    """Counts phrases of texts in each language; `samples`: (language, folded text) pairs."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        self.langs = [lang for lang, _ in samples]
        letters = [c for c in sorted(set("".join(t for _, t in samples))) if c != " "]
        self.letters = len(letters) + 2  # 0 is the blank, 1 any letter of no sample
        self.code = np.zeros(0x110000, dtype=np.int32)
        for start in range(0, 0x110000, 0x10000):
            self.code[start : start + 0x10000] = [chr(c).isalpha() for c in range(start, start + 0x10000)]
        for k, c in enumerate(letters):
            for same in {c, c.upper(), c.title()}:
                if len(same) == 1 and same.isalpha():
                    self.code[ord(same)] = k + 2
        self.root_moves = np.full((len(samples), self.letters), -1, dtype=np.int32)
        roots, one_code, one_to, keys, tos = [], [], [], [], []
        for k, (_, t) in enumerate(samples):
            base = len(one_code)
            roots.append(base)
            moves = Automaton(self.fold(t)).moves
            for state, out in enumerate(moves):
                first = next(iter(out), -1)
                one_code.append(first)
                one_to.append(base + out[first] if out else -1)
                if len(out) > 1:
                    keys += [(base + state) * self.letters + c for c in out if c != first]
                    tos += [base + x for c, x in out.items() if c != first]
            self.root_moves[k, list(moves[0])] = [base + x for x in moves[0].values()]
        self.roots = np.array(roots, dtype=np.int32)
        self.one_code, self.one_to = np.array(one_code, dtype=np.int32), np.array(one_to, dtype=np.int32)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys = np.append(np.array(keys, dtype=np.int64)[order], np.iinfo(np.int64).max)
        self.tos = np.append(np.array(tos, dtype=np.int32)[order], -1).astype(np.int32)
        self.several = np.zeros(len(one_code), dtype=bool)
        self.several[self.keys[:-1] // self.letters] = True
        self.all_moves = None  # small alphabets: every move in one table, which gives the same and is faster
        if len(one_code) * self.letters <= DENSE:
            self.all_moves = np.full(len(one_code) * self.letters, -1, dtype=np.int32)
            self.all_moves[self.keys[:-1]] = self.tos[:-1]
            some = self.one_code >= 0
            self.all_moves[np.flatnonzero(some) * self.letters + self.one_code[some]] = self.one_to[some]

    def fold(self, text: str, before: int = 0) -> np.ndarray:
        """Codes of the text, runs of other characters as one blank; `before`: the code of the character in front."""
        codes = self.code[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        return codes[(codes > 0) | (np.concatenate(([before], codes))[:-1] > 0)]

    def step(self, state: np.ndarray, lang: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, whether a phrase begins with the character) of flat arrays; an unknown letter is one by itself."""
        again = self.root_moves[lang, c]
        root = self.roots[lang]
        if self.all_moves is not None:
            to = self.all_moves[state * self.letters + c]
            begins = (to < 0) | (state == root)
            return np.where(begins, np.where(again < 0, root, again), to), begins
        to = np.where(self.one_code[state] == c, self.one_to[state], -1)
        more = np.flatnonzero((to < 0) & self.several[state] & (state != root))
        if len(more):
            key = state[more].astype(np.int64) * self.letters + c[more]
            at = np.searchsorted(self.keys, key)
            to[more] = np.where(self.keys[at] == key, self.tos[at], -1)
        begins = (to < 0) | (state == root)
        return np.where(begins, np.where(again < 0, root, again), to), begins

    def phrases(self, lanes: list[np.ndarray], follows: np.ndarray, carried: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(phrases that begin in each stretch, the state it leaves), languages first.

        `follows`: whether a stretch goes on where the one before it ends; the first may go on from
        the states `carried`.
        """
        n, langs = len(lanes), len(self.langs)
        length = np.array([len(x) for x in lanes])
        order = np.argsort(-length, kind="stable")
        place = np.argsort(order)
        rows = np.zeros((int(length.max()), n), dtype=np.int32)
        for k, i in enumerate(order):
            rows[: length[i], k] = lanes[i]
        live = np.searchsorted(-length[order], -np.arange(len(rows)), side="left")  # stretches longer than t
        begun = np.zeros((len(rows), langs, n), dtype=bool)
        last = np.repeat(self.roots[:, None], n, axis=1)
        which = np.repeat(np.arange(langs), n).reshape(langs, n)
        for t, m in enumerate(live.tolist()):
            to, begins = self.step(last[:, :m].ravel(), which[:, :m].ravel(), np.tile(rows[t, :m], langs))
            last[:, :m] = to.reshape(langs, m)
            begun[t, :, :m] = begins.reshape(langs, m)
        count = begun.sum(axis=0, dtype=np.int64)

        # in the order of the text: stretch i goes on from what stretch i - 1 truly leaves
        leaves, more = last[:, place].copy(), np.zeros((langs, n), dtype=np.int64)
        start = np.concatenate((carried[:, None] if carried is not None else self.roots[:, None], leaves[:, :-1]), axis=1)
        go_on = follows.copy()
        go_on[0] = carried is not None
        lang, i = np.nonzero(go_on[None, :] & (start != self.roots[:, None]))
        while len(lang):
            entered = np.where(i > 0, leaves[lang, i - 1], carried[lang] if carried is not None else -1)
            left, extra = self._joined(rows, begun, length, place, lang, i, entered, last)
            changed = left != leaves[lang, i]
            leaves[lang, i], more[lang, i] = left, extra
            lang, i = lang[changed], i[changed] + 1
            inside = i < n
            lang, i = lang[inside], i[inside]
            lang, i = lang[follows[i]], i[follows[i]]
        return count[:, place] + more, leaves

    def _joined(self, rows, begun, length, place, lang, i, state, last) -> tuple[np.ndarray, np.ndarray]:
        """(state left, phrases more than in the first parse) of stretches that are entered in the middle of a phrase."""
        lane, state = place[i], state.astype(np.int32)
        left, extra = last[lang, lane].copy(), np.zeros(len(lang), dtype=np.int64)
        open_ = np.arange(len(lang))
        for t in range(len(rows)):
            ended = length[i[open_]] <= t
            if ended.any():
                left[open_[ended]] = state[ended]
                open_, state = open_[~ended], state[~ended]
            if not len(open_):
                return left, extra
            state, begins = self.step(state, lang[open_], rows[t, lane[open_]])
            did = begun[t, lang[open_], lane[open_]]
            extra[open_] += begins.astype(np.int64) - did
            apart = ~(begins & did)
            open_, state = open_[apart], state[apart]
        left[open_] = state
        return left, extra

    def parse(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(folded characters, phrases by language) of each text."""
        chars, totals = np.zeros(len(texts), dtype=np.int64), np.zeros((len(texts), len(self.langs)), dtype=np.int64)
        most = max(64, LANES // max(len(self.langs), 1))
        lanes: list[np.ndarray] = []
        whose: list[int] = []
        carried: tuple[int, np.ndarray] | None = None

        def flush() -> None:
            nonlocal carried
            owner = np.array(whose)
            follows = np.concatenate(([False], owner[1:] == owner[:-1]))
            count, leaves = self.phrases(lanes, follows, carried[1] if carried and carried[0] == whose[0] else None)
            np.add.at(totals, owner, count.T)
            carried = whose[-1], leaves[:, -1]
            lanes.clear()
            whose.clear()

        for i, text in enumerate(texts):
            held, before = np.zeros(0, dtype=np.int32), 0
            for at in range(0, len(text or ""), BLOCK * 1024):
                codes = self.fold(text[at : at + BLOCK * 1024], before)
                before = codes[-1] if len(codes) else before
                held = np.concatenate((held, codes))
                whole = len(held) // BLOCK * BLOCK if at + BLOCK * 1024 < len(text) else len(held)
                chars[i] += whole
                for k in range(0, whole, BLOCK):
                    lanes.append(held[k : min(k + BLOCK, whole)])
                    whose.append(i)
                    if len(lanes) == most:
                        flush()
                held = held[whole:]
        if lanes:
            flush()
        return chars, totals

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """The language of each text, and how far its parse stands out (0 to 1)."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        chars, totals = self.parse(texts)
        rate = totals / np.maximum(chars, 1)[:, None]
        best = rate.argmin(axis=1)
        # phrases act as costs: how probable the best is against the others, a long text counting as 200 characters
        gap = np.minimum(chars, 200)[:, None] * (rate - rate.min(axis=1, keepdims=True))
        score = 1 / np.exp(-gap).sum(axis=1)
        some = chars > 0
        return [self.langs[k] if ok else "und" for k, ok in zip(best, some, strict=True)], np.where(some, score, 0.0)


@lru_cache(maxsize=2)
def parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    return Parser(samples)


def fold_text(text: str) -> str:
    """Letters in lower case, everything else one blank (the sample's form)."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = 48, lang_chars: int = 25_000, short: int = 4000) -> tuple[tuple[str, str], ...]:
    """A bounded sample of learnable text for each language, as (language, folded text) pairs."""
    learn = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & (remainder(id_col, 4) != HELD))
    learn = learn.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(id_col).alias("h"), F.greatest(F.length(text_col), F.lit(short)).alias("n"), F.col(text_col).alias("t"))
    first = learn.drop("t").withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("n", "h", "id"))).where(F.col("k") <= max_docs)
    # at most max_docs ids a language
    ids = docs.sparkSession.createDataFrame(first.select("id", "lang").distinct().collect(), first.select("id", "lang").schema)
    picked = learn.join(F.broadcast(ids), ["id", "lang"]).groupBy("lang", "n", "h", "id").agg(F.min(F.substring("t", 1, max(lang_chars, short))).alias("t")).orderBy("lang", "n", "h", "id").collect()
    taken: dict[str, list[str]] = {}
    for r in picked:
        held = sum(map(len, taken.setdefault(r.lang, [])))
        if held < lang_chars and (t := fold_text(r.t)):
            taken[r.lang].append(t)
    return tuple((lang, " ".join(texts)[: lang_chars + short]) for lang, texts in sorted(taken.items()) if texts)


def language_id(docs: DataFrame, samples: tuple[tuple[str, str], ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row."""

    shared = docs.sparkSession.sparkContext.broadcast(samples)  # at most lang_chars and one text a language

    def run(batches):
        p = parser(shared.value)
        for b in batches:
            for at in range(0, len(b), 2048):
                part = b.slice(at, 2048)
                names, score = p.predict(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    held = F.coalesce(remainder(id_col, 4) == HELD, F.lit(False)).alias("held_out")
    return docs.select(id_col, held, text_col).mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id(docs, fit(docs))


QUERIES = {"op7_language_id": op7_language_id}
