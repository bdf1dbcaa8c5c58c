"""Connected components of an edge table, by min-label hooking with pointer jumping."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.llm.common import cut, spread_join


def roots_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, their smallest joined node) of the edges u - v."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while True:
        least = root.copy()
        np.minimum.at(least, root[a], root[b])
        np.minimum.at(least, root[b], root[a])
        while not np.array_equal(jump := least[least], least):
            least = jump
        if np.array_equal(new := least[root], root):
            return nodes, nodes[root]
        root = new


def _one_task(edges: DataFrame) -> DataFrame:
    def run(batches):
        tables = [b for b in batches if len(b)]
        if tables:
            u, v = (np.concatenate([t.column(k).to_numpy() for t in tables]) for k in (0, 1))
            nodes, roots = roots_of(u, v)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "root"])

    return edges.select(F.col("u").cast("long"), F.col("v").cast("long")).repartition(1).mapInArrow(run, "node long, root long")


def components(edges: DataFrame, rounds: int = 64, one_task: int = 1_000_000) -> DataFrame:
    """node, root: the smallest node that each node of the edges (a, b) is joined to.

    Every round replaces each node's neighbours by the least node in reach: edges turn towards
    their smallest neighbour (large star), then towards each node's least one (small star), until
    all point at a root. Edges stay at most as many as given. A node with very many neighbours is a
    partial minimum first, and its rows are spread over tasks. Null ends and loops are ignored.
    Up to `one_task` edges, counted first (16 MB), one task does the same without rounds.
    """
    e = cut(edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b"))).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if e.count() <= one_task:
        return cut(_one_task(e))
    last = None
    for _ in range(rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: neighbours above a node move to the least of its neighbourhood
        big = spread_join(both, least, "u", "v").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its smaller neighbours move to the least of them
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(big, low, "u", "v").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        e = cut(small)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            break
        last = now
    else:
        raise RuntimeError(f"components were not joined after {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
