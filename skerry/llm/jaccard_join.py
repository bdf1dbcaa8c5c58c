"""Operator 8: n-gram Jaccard self-join by chosen paths.

Sets are the hashed five-word shingles of whole texts (lower case; words are runs of digits, ASCII
letters and non-ASCII characters; a text of fewer words is one shingle). Texts with equal sets form
one class member, dealt with once.

Chosen paths: in each run, each level has a random function of the tokens; a set follows those of
its tokens whose value is below `reach` / size. Sets that follow the same token share a bucket. A
bucket of one is dropped, a small one is compared by brute force, a larger one is split again by the
next level's tokens; what is still large after the last level is compared block against block. Two
sets of similarity s meet in a run with chance 1 - (1 - reach / size)^(s * size) or more at each
level; runs are repeated until the chance to meet at all, at the deepest level, is `recall`.

Brute force in a bucket compares min-hash sketches (128 places; a pair at the threshold is passed
over with a chance below 1e-9), and keeps a spanning forest of what is alike, not its pairs. Joined
over all buckets the forests give candidate groups. Inside each group all pairs are then compared
exactly, over the real sets, in blocks: this counts each text's links, also those that every run
missed, and gives the classes.

Result: one row a document with its class (the smallest id of its connected group) and its number of
links: other documents with similarity of `threshold` or more, copies counted one by one.

Defined results: texts without words are linked only to equal texts, null or blank ones to nothing;
identical rows count as copies; null ids are rows like any other (a class of null ids only is null); an
empty table gives an empty result; texts are taken whole, however long (a row's tokens stay in one
task); further columns are ignored, whatever their names (`keep_first` keeps them). Equal sets are told
by a 64-bit hash: among 10 billion different texts about three pairs share one.
Shuffles carry sketches, tokens and, for candidate groups alone, sets; large groups are blocks of
`block` members against each other, so that no group meets in one task. Nothing that grows with the
input is broadcast: the joins are asked to merge.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.common import cut, free_name, row_hash, spread_join, table, tasks
from skerry.llm.components import components
from skerry.llm.text_arrays import mix, words_of_each

WORDS, THRESHOLD = 5, 0.8
REACH, LEVELS, RECALL = 2.0, 2, 0.99999
SMALL, BLOCK, PLACES = 256, 1024, 128


def runs_needed(threshold: float = THRESHOLD, reach: float = REACH, levels: int = LEVELS, recall: float = RECALL) -> int:
    """Runs until a pair at the threshold has met with the chance `recall`."""
    meets = (1 - math.exp(-reach * threshold)) ** levels
    return math.ceil(math.log(1 - recall) / math.log(1 - meets))


def shingles(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes of a text's word hashes."""
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    k = min(n, len(words))
    h = np.zeros(len(words) - k + 1, dtype=np.uint64)
    for i in range(k):
        h = mix(h + words[i : len(words) - k + 1 + i] + np.uint64(k))
    return np.unique(h)


def _seeds(n: int, salt: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt))


def followed(tokens: np.ndarray, runs: int, levels: int, reach: float) -> list[np.ndarray]:
    """For each run and level (runs first), the tokens that the set follows."""
    bound = np.uint64(min(reach / max(len(tokens), 1), 1.0) * (2**64 - 2**11))
    seeds = _seeds(runs * levels, 77)[:, None]
    slots, picked = [], []
    for at in range(0, len(tokens), 4096):
        slot, k = np.nonzero(mix(tokens[None, at : at + 4096] ^ seeds) <= bound)
        slots.append(slot)
        picked.append(tokens[at + k])
    slot = np.concatenate(slots)
    order = np.argsort(slot, kind="stable")
    return np.split(np.concatenate(picked)[order], np.searchsorted(slot[order], np.arange(1, runs * levels)))


def sketch(tokens: np.ndarray) -> np.ndarray:
    """One byte of each of `PLACES` min-hashes, by one pass over the tokens."""
    a = _seeds(PLACES, 991)[:, None] | np.uint64(1)
    low = np.full(PLACES, np.iinfo(np.uint64).max, dtype=np.uint64)
    base = mix(tokens)
    for at in range(0, len(base), 2048):
        x = base[None, at : at + 2048] * a
        np.minimum(low, (x ^ (x >> np.uint64(29))).min(axis=1), out=low)
    return (mix(low) & np.uint64(255)).astype(np.uint8)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def prepared(docs: DataFrame, runs: int, levels: int, reach: float, n_words: int, id_col: str, text_col: str) -> DataFrame:
    """id, rk (row key), sid (hash of the set), size, tokens (of each run and level), sketch."""

    def run(batches):
        for b in batches:
            for at in range(0, len(b), 1024):
                part = b.slice(at, 1024)
                texts, own = part.column(2).to_pylist(), part.column(3).to_numpy(zero_copy_only=False)
                sids, sizes, followed_, ends, sketches = [], [], [], [0], []
                for i, words in enumerate(words_of_each(texts)):
                    s = shingles(words, n_words)
                    sizes.append(len(s))
                    if len(s):
                        sids.append(int(_signed(mix(np.array([np.bitwise_xor.reduce(mix(s + np.uint64(1))) + np.uint64(len(s))], dtype=np.uint64)))[0]))
                        parts = followed(s, runs, levels, reach)
                        sketches.append(sketch(s).tobytes())
                    else:
                        sids.append(int(_signed(mix(own[i : i + 1].view(np.uint64)))[0]) if (texts[i] or "").strip() else None)
                        parts = [s] * (runs * levels)
                        sketches.append(b"")
                    followed_ += parts
                    ends += (ends[-1] + np.cumsum([len(p) for p in parts])).tolist()
                flat = _signed(np.concatenate(followed_)) if followed_ else np.zeros(0, np.int64)
                inner = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
                outer = pa.ListArray.from_arrays(pa.array(range(0, len(followed_) + 1, runs * levels), pa.int32()), inner)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sids, pa.int64()), pa.array(sizes, pa.int32()), outer, pa.array(sketches, pa.binary())], names=["id", "rk", "sid", "size", "tokens", "sketch"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), row_hash(id_col, text_col).alias("rk"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("th"))
    return rows.mapInArrow(run, f"id {kind}, rk long, sid long, size int, tokens array<array<long>>, sketch binary")


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """The rows of one key after the other, of batches in which keys stand together."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not len(b):
            continue
        k = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        edges = np.flatnonzero(k[1:] != k[:-1]) + 1
        if held and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        at = 0
        for e in edges.tolist():
            held.append(b.slice(at, e - at))
            yield pa.Table.from_batches(held)
            held, at = [], e
        held.append(b.slice(at))
    if held:
        yield pa.Table.from_batches(held)


class _Forest:
    """Union-find over a few places."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def alike(sketches: np.ndarray, one: np.ndarray, other: np.ndarray, least: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs (one, other) whose sketches agree in `least` places or more."""
    forest, out = _Forest(len(sketches)), []
    same = one is other
    for k, i in enumerate(one.tolist()):
        rest = other[k + 1 :] if same else other
        agree = (sketches[rest] == sketches[i]).sum(axis=1) >= least
        for j in rest[agree].tolist():
            if forest.join(i, j):
                out.append((i, j))
    return out


def buckets(members: DataFrame, runs: int, levels: int, small: int) -> DataFrame:
    """bucket, n, sid: members of the buckets that hold more than one set and are done with splitting."""
    rows = members.select("sid", "tokens", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"))
    rows = rows.select("sid", "run", F.slice("tokens", F.col("run") * levels + 1, levels).alias("path"))
    done = None
    level = rows.select("sid", "path", F.explode(F.get("path", F.lit(0))).alias("token"), "run").select("sid", "path", F.xxhash64("run", "token").alias("bucket"))
    for k in range(levels):
        level = cut(level) if k else level
        sizes = level.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        met = spread_join(level.select("sid", "bucket", *(["path"] if k < levels - 1 else [])), sizes, "bucket", "sid")
        if k < levels - 1:
            met = cut(met)
            ready = met.where(F.col("n") <= small).select("bucket", "n", "sid")
            level = met.where(F.col("n") > small).select("sid", "path", "bucket", F.explode(F.get("path", F.lit(k + 1))).alias("token")).select("sid", "path", F.xxhash64("bucket", "token").alias("bucket"))
        else:
            ready = met.select("bucket", "n", "sid")
        done = ready if done is None else done.union(ready)
    return done


def _blocks(rows: DataFrame, group: str, n: str, member: str, block: int) -> DataFrame:
    """Rows dealt to the pairs of their group's blocks: key, side (0 or 1; all in block 0 of a lone block)."""
    parts = F.ceil(F.col(n) / block).cast("int")
    rows = rows.withColumn("_p", parts).withColumn("_b", F.pmod(F.xxhash64(member, F.lit(5)), F.col("_p")).cast("int"))
    rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_p") - 1)))
    return rows.withColumn("key", F.xxhash64(group, F.least("_b", "_o"), F.greatest("_b", "_o"))).withColumn("side", (F.col("_b") > F.col("_o")).cast("int")).withColumn("mixed", F.col("_b") != F.col("_o")).drop("_p", "_b", "_o")


def candidate_edges(members: DataFrame, runs: int, levels: int, small: int, block: int, threshold: float) -> DataFrame:
    """a, b: a spanning forest of the pairs that look alike in some bucket."""
    met = _blocks(buckets(members, runs, levels, small), "bucket", "n", "sid", max(small, block))
    met = met.join(members.select("sid", "sketch").hint("merge"), "sid").select("key", "sid", "side", "mixed", "sketch")
    least = max(1, math.floor(PLACES * threshold - 6.2 * math.sqrt(PLACES * threshold * (1 - threshold))))

    def run(batches):
        for g in _grouped(batches, "key"):
            g = g.combine_chunks()
            sid = g.column("sid").to_numpy()
            if len(sid) < 2:
                continue
            sk = np.frombuffer(b"".join(g.column("sketch").to_pylist()), dtype=np.uint8).reshape(len(sid), PLACES)
            if len(sid) == 2:
                pairs = [(0, 1)] if (sk[0] == sk[1]).sum() >= least else []
            elif g.column("mixed")[0].as_py():
                side = g.column("side").to_numpy()
                pairs = alike(sk, np.flatnonzero(side == 0), np.flatnonzero(side == 1), least)
            else:
                every = np.arange(len(sid))
                pairs = alike(sk, every, every, least)
            if pairs:
                a, b = np.array(pairs).T
                yield pa.RecordBatch.from_arrays([pa.array(sid[a]), pa.array(sid[b])], names=["a", "b"])

    dealt = met.repartition(tasks(members.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a long, b long")


def overlaps(sets: list[np.ndarray], one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Common tokens of each set of `one` with each of `other`, through postings of the shared tokens."""
    flat = np.concatenate([sets[i] for i in other]) if len(other) else np.zeros(0, np.int64)
    whose = np.repeat(np.arange(len(other)), [len(sets[i]) for i in other])
    order = np.argsort(flat, kind="stable")
    flat, whose = flat[order], whose[order]
    out = np.zeros((len(one), len(other)), dtype=np.int64)
    for k, i in enumerate(one.tolist()):
        lo, hi = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
        n = hi - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
        out[k] = np.bincount(whose[at], minlength=len(other))
    return out


def verified(groups: DataFrame, threshold: float) -> DataFrame:
    """kind, a, b: links counted (kind 0: set a has b linked documents more) and forest edges (kind 1)."""

    def run(batches):
        for g in _grouped(batches, "key"):
            g = g.combine_chunks()
            sid, copies = g.column("sid").to_numpy(), g.column("copies").to_numpy()
            if len(sid) < 2:
                continue
            sets = [np.asarray(x) for x in g.column("set").to_numpy(zero_copy_only=False)]
            size = np.array([len(x) for x in sets])
            mixed = g.column("mixed")[0].as_py()
            side = g.column("side").to_numpy()
            one = np.flatnonzero(side == 0) if mixed else np.arange(len(sid))
            other = np.flatnonzero(side == 1) if mixed else one
            links, forest, edges = np.zeros(len(sid), dtype=np.int64), _Forest(len(sid)), []
            for at in range(0, len(one), 64):
                some = one[at : at + 64]
                both = overlaps(sets, some, other)
                close = both >= threshold * (size[some][:, None] + size[other][None, :] - both) - 1e-9
                close &= some[:, None] != other[None, :]
                links[some] += close @ copies[other]
                if mixed:
                    links[other] += copies[some] @ close
                for i, j in zip(*np.nonzero(close), strict=True):
                    if forest.join(int(some[i]), int(other[j])):
                        edges.append((sid[some[i]], sid[other[j]]))
            got = np.flatnonzero(links)
            a = np.concatenate((sid[got], np.array([x for x, _ in edges], dtype=np.int64)))
            b = np.concatenate((links[got], np.array([x for _, x in edges], dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([0, 1], np.int32), [len(got), len(edges)])), pa.array(a), pa.array(b)], names=["kind", "a", "b"])

    return groups.repartition(tasks(groups.sparkSession), "key").sortWithinPartitions("key").mapInArrow(run, "kind int, a long, b long")


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, n_words: int = WORDS, recall: float = RECALL, reach: float = REACH, levels: int = LEVELS, small: int = SMALL, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, rk, class_id, n_links, n_shingles of each row, and head: the row key of the class's first row."""
    runs = runs_needed(threshold, reach, levels, recall)
    base = cut(prepared(docs, runs, levels, reach, n_words, id_col, text_col))
    first = F.min(F.struct(F.col("id").isNull().alias("null"), "id", "rk")).alias("first")
    members = base.where("sid is not null").groupBy("sid").agg(F.count(F.lit(1)).alias("copies"), first, F.min(F.struct("tokens", "sketch")).alias("x"))
    members = cut(members.select("sid", "copies", "first", "x.tokens", "x.sketch"))

    groups = components(candidate_edges(members, runs, levels, small, block, threshold))
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    inside = spread_join(groups, sizes, "root", "node").join(members.select(F.col("sid").alias("node"), "copies", "first").hint("merge"), "node")
    inside = inside.select("root", "n", F.col("node").alias("sid"), "copies", F.col("first.id").alias("first_id"), F.col("first.rk").alias("first_rk"))
    # the first row of each member, told by its id and its hash, brings its text again; the set is made anew
    keyed = docs.select(F.col(id_col).alias("id"), row_hash(id_col, text_col).alias("rk"), F.col(text_col).alias("t"))
    texts = keyed.join(inside.hint("merge"), (F.col("rk") == F.col("first_rk")) & F.col("id").eqNullSafe(F.col("first_id"))).dropDuplicates(["sid"]).select("root", "n", "sid", "copies", "t")

    def sets(batches):
        for b in batches:
            for at in range(0, len(b), 1024):
                part = b.slice(at, 1024)
                found = [_signed(shingles(w, n_words)) for w in words_of_each(part.column(4).to_pylist())]
                ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)))], names=["root", "n", "sid", "copies", "set"])

    with_sets = texts.mapInArrow(sets, "root long, n long, sid long, copies long, set array<long>")
    found = cut(verified(_blocks(with_sets, "root", "n", "sid", block).select("key", "sid", "side", "mixed", "copies", "set"), threshold))
    links = found.where("kind = 0").groupBy(F.col("a").alias("sid")).agg(F.sum("b").alias("links"))
    classes = components(found.where("kind = 1").select("a", "b")).withColumnRenamed("node", "sid")
    named = members.select("sid", "copies", "first").join(links.hint("merge"), "sid", "left").join(classes.hint("merge"), "sid", "left")
    named = cut(named.select("sid", "copies", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "sid").alias("root")))
    heads = named.groupBy("root").agg(F.min("first").alias("head"))
    final = spread_join(named, heads, "root", "sid").select("sid", F.col("head.id").alias("class_id"), (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("head.rk").alias("head"))
    rows = base.select("id", "rk", "sid", F.col("size").cast("long").alias("n_shingles"))
    out = rows.where("sid is not null").join(final.hint("merge"), "sid").select("id", "rk", "class_id", "n_links", "n_shingles", "head")
    lone = rows.where("sid is null").select("id", "rk", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "n_shingles", F.col("rk").alias("head"))
    return out.union(lone)


def keep_first(docs: DataFrame, **how) -> DataFrame:
    """The documents with one of each class left: the row of the smallest id (of identical rows, one)."""
    heads = jaccard_join(docs, **how).where((F.col("rk") == F.col("head")) & F.col("id").eqNullSafe(F.col("class_id")))
    id_col, text_col = how.get("id_col", "doc_id"), how.get("text_col", "text")
    mine, theirs, ids = (free_name(docs, x) for x in ("_rk", "_head", "_head_id"))
    keyed = docs.withColumn(mine, row_hash(id_col, text_col))
    heads = heads.select(F.col("rk").alias(theirs), F.col("id").alias(ids))
    kept = keyed.join(heads.hint("merge"), (F.col(mine) == F.col(theirs)) & F.col(id_col).eqNullSafe(F.col(ids)), "left_semi")
    return kept.dropDuplicates([mine, id_col]).select(*docs.columns)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id", "n_links", "n_shingles")


#: All pairs that share a shingle, and what is reached over their links.
SQL = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, text, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
u AS (SELECT DISTINCT r, g FROM (SELECT r, unnest(CASE WHEN len(w) < {WORDS} THEN list_filter([array_to_string(w, ' ')], lambda x: x <> '') ELSE list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) END) AS g FROM d)),
n AS (SELECT r, count(*) AS n FROM u GROUP BY r),
shared AS (SELECT x.r AS a, y.r AS b, count(*) AS k FROM u x JOIN u y ON x.g = y.g AND x.r <> y.r GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE k >= {THRESHOLD} * (x.n + y.n - k) - 1e-9
  UNION ALL SELECT x.r, y.r FROM d x JOIN d y ON x.text = y.text AND x.r <> y.r AND len(x.w) = 0 AND regexp_matches(x.text, '\S')),
reach(r, x) AS (SELECT r, r FROM d UNION SELECT reach.r, b FROM reach JOIN links ON x = a),
classes AS (SELECT reach.r, min(d.doc_id) AS class_id FROM reach JOIN d ON d.r = x GROUP BY reach.r)
SELECT doc_id, class_id, (SELECT count(*) FROM links WHERE a = d.r)::BIGINT AS n_links, coalesce(n.n, 0)::BIGINT AS n_shingles FROM d JOIN classes USING (r) LEFT JOIN n USING (r)"""

QUERIES = {"op8_jaccard_join": op8_jaccard_join}
ORACLE_SQL = {"op8_jaccard_join": SQL}
