"""Operator 5: exact top-k search by exhaustive term-at-a-time accumulation.

Vectors become sparse rows of integer weights, floor(scale * x). Queries and candidates are dealt
into blocks of bounded size; each pair of a query block and a candidate block is one group. In a
group the candidates are inverted into postings (term -> rows, weights). Each term's postings are
scattered, weighted by the query rows that hold the term, into a dense array of scores; partition
selection then takes each query's k best, and a last merge ranks the best of all blocks.

Exhaustive: every pair is scored, no bound or index leaves any out. A row's block comes from its
place in the input, so repeated ids or equal vectors never meet in one block for that reason.

Defined results: vectors that are null or hold null or non-finite components take no part; a missing
component (shorter vector) weighs 0; rows of the query's own id are never its candidates; repeated
rows stay separate candidates and separate queries; null ids take no part; an empty table gives an empty
result; further columns are ignored, whatever their names. Scores are 64-bit. Memory is bounded by one
pair of blocks: candidates are sent once for each `QUERY_BLOCK` queries, weights as 16-bit numbers
where all fit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skerry.llm.common import table

K, SCALE, EVERY = 20, 64, 20
QUERY_BLOCK, ROW_BLOCK = 2048, 8192


def _weights(column: pa.Array) -> np.ndarray:
    """Integer weights as a dense matrix, rows padded with 0."""
    lists = [np.asarray(x, dtype=np.int64) for x in column.to_numpy(zero_copy_only=False)]
    out = np.zeros((len(lists), max(map(len, lists), default=0)), dtype=np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of all rows with all queries, (rows, queries), accumulated term by term."""
    small = min(queries.shape[1], rows.shape[1])
    most = int(np.abs(queries).max(initial=0)) * int(np.abs(rows).max(initial=0)) * max(small, 1)
    kind = np.int32 if most < 2**31 else np.int64
    acc = np.zeros((len(rows), len(queries)), dtype=kind)
    for term in range(small):
        asking = np.flatnonzero(queries[:, term])
        posting = np.flatnonzero(rows[:, term])
        if not len(asking) or not len(posting):
            continue
        q, w = queries[:, term].astype(kind), rows[posting, term].astype(kind)
        for at in range(0, len(posting), 256):  # a strip of the array stays in cache
            ids = posting[at : at + 256]
            lo, hi = int(ids[0]), int(ids[-1]) + 1
            if hi - lo == len(ids):
                acc[lo:hi] += w[at : at + 256, None] * q
            else:
                acc[ids] += w[at : at + 256, None] * q
    return acc


def best_of_block(query_ids: np.ndarray, queries: np.ndarray, row_ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, row id, score) of each query's k best rows here; ties go to the smaller id."""
    order = np.argsort(row_ids, kind="stable")
    row_ids, rows = row_ids[order], rows[order]
    acc = np.ascontiguousarray(scores(queries, rows).T)
    n = len(row_ids)
    own = query_ids[:, None] == row_ids[None, :] if np.isin(query_ids, row_ids).any() else None
    out_q, out_r, out_s = [], [], []
    for i in range(len(query_ids)):
        s = acc[i].astype(np.int64)
        open_rows = np.arange(n) if own is None or not own[i].any() else np.flatnonzero(~own[i])
        s = s[open_rows]
        if len(s) > k:
            edge = np.partition(s, len(s) - k)[len(s) - k]
            above = np.flatnonzero(s > edge)
            pick = np.concatenate((above, np.flatnonzero(s == edge)[: k - len(above)]))
        else:
            pick = np.arange(len(s))
        out_q.append(np.full(len(pick), i))
        out_r.append(row_ids[open_rows[pick]])
        out_s.append(s[pick])
    join = lambda x: np.concatenate(x) if x else np.zeros(0, dtype=np.int64)
    return join(out_q), join(out_r), join(out_s)


def topk_search(rows: DataFrame, is_query: str, k: int = K, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row that meets the SQL condition `is_query`, its k best others."""
    v = F.col(vec_col)
    usable = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    base = rows.select(F.col(id_col).cast("long").alias("id"), F.expr(is_query).alias("asks"), F.when(usable, F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))).alias("w"), F.monotonically_increasing_id().alias("at")).where(F.col("w").isNotNull())
    largest = F.max(F.greatest(F.abs(F.array_max("w")), F.abs(F.array_min("w"))))
    n_rows, n_queries, most = base.agg(F.count(F.lit(1)), F.count(F.when(F.col("asks"), 1)), largest).first()
    # weights travel in the narrowest type that holds them all
    base = base.withColumn("w", F.col("w").cast(f"array<{'smallint' if (most or 0) < 1 << 15 else 'int' if most < 1 << 31 else 'long'}>"))
    q_blocks, r_blocks = max(1, -(-n_queries // QUERY_BLOCK)), max(1, -(-n_rows // ROW_BLOCK))
    deal = lambda n, salt: F.pmod(F.xxhash64("at", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    queries = base.where("asks").select(deal(q_blocks, 1).alias("qb"), every(r_blocks).alias("rb"), F.col("at").alias("q"), "id", "w")
    cands = base.select(every(q_blocks).alias("qb"), deal(r_blocks, 2).alias("rb"), F.lit(None).cast("long").alias("q"), "id", "w")

    def run(left, right):
        a, b = left, right
        empty = {"q": [], "query_id": [], "vec_id": [], "score": []}
        if not a.num_rows or not b.num_rows:
            return pa.table(empty, schema=schema)
        keys = a.column("q").combine_chunks().to_numpy(zero_copy_only=False)
        qid = a.column("id").combine_chunks().to_numpy(zero_copy_only=False)
        i, r, s = best_of_block(qid, _weights(a.column("w").combine_chunks()), b.column("id").combine_chunks().to_numpy(zero_copy_only=False), _weights(b.column("w").combine_chunks()), k)
        return pa.table({"q": keys[i], "query_id": qid[i], "vec_id": r, "score": s}, schema=schema)

    schema = pa.schema([("q", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
    found = queries.groupBy("qb", "rb").cogroup(cands.groupBy("qb", "rb")).applyInArrow(run, "q long, query_id long, vec_id long, score long")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search(table(spark, sf_dir, "embeddings"), f"vec_id % {EVERY} = 0")


SQL = f"""
WITH v AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.w::DOUBLE[], c.w::DOUBLE[])::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= {K}"""

QUERIES = {"op5_topk_search": op5_topk_search}
ORACLE_SQL = {"op5_topk_search": SQL}
