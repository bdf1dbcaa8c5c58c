"""Operator 10: quality classifier on random-indexing word vectors.

Words are the runs between blanks, as written, and each word's shape (letter case, digits, marks,
runs shortened). Both are hashed into fixed numbers of buckets. Random indexing: every bucket has a
sparse random index vector; a bucket's word vector is the sum, over the training texts, of the index
vectors of the words around it. A document pools the vectors of its words and shapes into means,
joined by a few rates (repeats, lengths, case, marks). A two-layer network in numpy gives a logit;
a temperature fitted on texts set apart turns it into a probability.

Learning sees labels only of rows whose crc32(id) mod 5 is not 0, and of these a bounded sample of
whole texts: `max_rows` documents (those whose id has the smallest hash), but for the texts of more
than `longest` characters among them. Scoring reads whole texts and nothing else, where they lie: no
rows move.

Defined results: null and empty texts pool to zeros and get the score of such a text; documents
labelled twice count with their smallest label, null labels not at all; with nothing (or one class)
to learn from, every score is the share of good labels, or 0.5; identical rows each keep their row and
score; an empty table gives an empty result; very long texts are scored whole, a piece at a time;
further columns are ignored, whatever their names (or kept, with `keep`).
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.common import table
from skerry.llm.text_arrays import _FILLED, hash_spans, mix, pieces, word_spans

WORDS, SHAPES, DIM, AROUND, RATES = 1 << 14, 1 << 12, 32, 2, 8
HELD, CUT = 0, 0.3
PART = 512  # rows judged at once
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x30:0x3A], _SHAPE[0x41:0x5B], _SHAPE[0x61:0x7B], _SHAPE[0x80:] = ord("9"), ord("A"), ord("a"), ord("a")
_UPPER, _MARK = _SHAPE == ord("A"), (_SHAPE != ord("A")) & (_SHAPE != ord("a")) & (_SHAPE != ord("9")) & _FILLED


def index_vectors(n: int, seed: int) -> np.ndarray:
    """Sparse ternary vectors: four places of each hold +1 or -1."""
    rng = np.random.default_rng(seed)
    out = np.zeros((n, DIM), dtype=np.float32)
    for _ in range(4):
        out[np.arange(n), rng.integers(0, DIM, n)] += rng.choice(np.array([-1, 1], dtype=np.float32), n)
    return out


def units(text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, shape buckets, and letters-in-capitals and marks of each word of the whole text."""
    found = []
    for piece in pieces(text or ""):
        data = np.frombuffer(piece.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        starts, ends = word_spans(data, _FILLED)
        if not len(starts):
            continue
        shape = _SHAPE[data]
        new = np.concatenate(([True], shape[1:] != shape[:-1]))
        new[starts] = True  # a word's first letter always counts
        at = np.concatenate(([0], np.cumsum(new)))
        upper, mark = (np.concatenate(([0], np.cumsum(t[data]))) for t in (_UPPER, _MARK))
        found.append((hash_spans(data, starts, ends), hash_spans(shape[new], at[starts], at[ends]) % np.uint64(SHAPES), upper[ends] - upper[starts], mark[ends] - mark[starts], ends - starts))
    if not found:
        zero = np.zeros(0, dtype=np.int64)
        return zero.astype(np.uint64), zero, zero, np.zeros((3, 0))
    h, s, u, m, n = (np.concatenate(x) for x in zip(*found, strict=True))
    return h, s.astype(np.int64), (h % np.uint64(WORDS)).astype(np.int64), np.stack((u, m, n)).astype(np.float64)


def rates(h: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """How long the text is, how much of it repeats, and what its words are made of."""
    n = len(h)
    if not n:
        return np.zeros(RATES, dtype=np.float32)
    total = max(letters[2].sum(), 1.0)
    triples = mix(h[:-2] * np.uint64(3) + mix(h[1:-1]) * np.uint64(5) + mix(h[2:] + np.uint64(9))) if n > 2 else h
    pairs = mix(h[:-1] * np.uint64(3) + mix(h[1:])) if n > 1 else h
    return np.array([
        np.log1p(n) / 8, len(np.unique(h)) / n, len(np.unique(triples)) / max(len(triples), 1), len(np.unique(pairs)) / max(len(pairs), 1),
        total / n / 8, letters[0].sum() / total, letters[1].sum() / total, (letters[1] > 0).mean()], dtype=np.float32)


@dataclass
class Model:
    """The fitted classifier; `constant` replaces it where nothing could be learnt."""

    words: np.ndarray | None = None
    shapes: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    layers: tuple[np.ndarray, ...] = ()
    temperature: float = 1.0
    constant: float | None = None

    def pooled(self, text: str | None) -> np.ndarray:
        """Means of the words' and shapes' vectors, and the rates."""
        h, s, w, letters = units(text)
        out = np.zeros(2 * DIM + RATES, dtype=np.float32)
        if len(h):
            for at, vectors, which in ((0, self.words, w), (DIM, self.shapes, s)):
                out[at : at + DIM] = sum(vectors[which[k : k + 65536]].sum(axis=0) for k in range(0, len(h), 65536)) / len(h)
        out[2 * DIM :] = rates(h, letters)
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        z = self.logits(np.stack([self.pooled(t) for t in texts])) if texts else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64) / self.temperature, -500, 500)))


def word_vectors(texts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Word and shape vectors of (word buckets, shape buckets) of the training texts."""
    wi, si = index_vectors(WORDS, 1), index_vectors(SHAPES, 2)
    words, shapes = np.zeros_like(wi), np.zeros_like(si)
    for at in range(0, len(texts), 256):
        w, s = (np.concatenate([t[k] for t in texts[at : at + 256]]) for k in (0, 1))
        whose = np.repeat(np.arange(len(texts[at : at + 256])), [len(t[0]) for t in texts[at : at + 256]])
        both = wi[w] + si[s]
        context = np.zeros_like(both)
        for d in range(1, AROUND + 1):
            same = (whose[d:] == whose[:-d])[:, None]
            context[d:] += both[:-d] * same
            context[:-d] += both[d:] * same
        for k in range(DIM):
            words[:, k] += np.bincount(w, weights=context[:, k], minlength=WORDS)
            shapes[:, k] += np.bincount(s, weights=context[:, k], minlength=SHAPES)
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-6)
    return unit(words) + 0.1 * wi, unit(shapes) + 0.5 * si


def train(texts: list[str], labels: np.ndarray, hidden: int = 24, steps: int = 400, rate: float = 0.01, decay: float = 1e-3, seed: int = 5) -> Model:
    """Fits vectors, network and temperature; every fifth text is set apart for the temperature."""
    if not len(texts) or len(set(labels.tolist())) < 2:
        return Model(constant=float(labels.mean()) if len(labels) else 0.5)
    model = Model(*word_vectors([units(t)[2:0:-1] for t in texts]))
    x = np.stack([model.pooled(t) for t in texts]).astype(np.float64)
    y = labels.astype(np.float64)
    apart = np.arange(len(y)) % 5 == 4
    if len(set(y[~apart].tolist())) < 2 or len(set(y[apart].tolist())) < 2:
        apart[:] = False
    model.mean, model.scale = x[~apart].mean(axis=0), x[~apart].std(axis=0) + 1e-3
    rng = np.random.default_rng(seed)
    layers = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    moment, square = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers]
    xs, ys = (x[~apart] - model.mean) / model.scale, y[~apart]
    for step in range(1, steps + 1):
        w1, b1, w2, b2 = layers
        a = np.tanh(xs @ w1 + b1)
        g = (1 / (1 + np.exp(-np.clip(a @ w2 + b2, -50, 50))) - ys) / len(ys)
        ga = np.outer(g, w2) * (1 - a * a)
        for p, m, v, grad in zip(layers, moment, square, (xs.T @ ga + decay * w1, ga.sum(axis=0), a.T @ g + decay * w2, g.sum(keepdims=True)), strict=True):
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    model.layers = tuple(layers)
    z, t = (model.logits(x[apart]), y[apart]) if apart.any() else (model.logits(x), y)
    loss = lambda c: np.logaddexp(0, np.where(t > 0, -z, z) / c).mean()
    model.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return model


def remainder(id_col: str, of: int) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(of))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 3000, longest: int = 50_000) -> Model:
    """A model of a bounded sample of the labelled rows."""
    known = labels.where(F.col(label_col).isNotNull() & (remainder(id_col, 5) != HELD)).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("y"))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(max_rows)
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where(F.col("t").isNull() | (F.length("t") <= longest))
    # at most max_rows ids are broadcast and come back
    rows = text.join(F.broadcast(sample), "id").groupBy("id", "y").agg(F.min("t").alias("t")).orderBy(F.xxhash64("id"), "id").collect()
    return train([r.t or "" for r in rows], np.array([r.y for r in rows], dtype=np.int64))


@lru_cache(maxsize=2)
def _loaded(blob: bytes) -> Model:
    return pickle.loads(blob)


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted of each row; `keep`: all columns of the predicted rows instead."""
    shared = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def judged(texts: list) -> np.ndarray:
        m = _loaded(shared.value)
        return np.round(m.scores(texts), 9)

    def parts(batches):
        return (b.slice(at, PART) for b in batches for at in range(0, len(b), PART))

    def run(batches):
        for b in parts(batches):
            score = judged(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score, pa.float64()), pa.array((score >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    def kept(batches):
        for b in parts(batches):
            ok = judged(b.column(b.schema.get_field_index(text_col)).to_pylist()) >= CUT
            yield b.filter(pa.array(ok))

    if keep:
        return docs.mapInArrow(kept, docs.schema)
    kind = docs.schema[id_col].dataType.simpleString()
    held = F.coalesce(remainder(id_col, 5) == HELD, F.lit(False)).alias("held_out")
    return docs.select(id_col, held, text_col).mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op10_quality_classifier": op10_quality_classifier}
