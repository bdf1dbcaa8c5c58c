"""Reciprocal rank fusion of several rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ranked(rows: DataFrame, key: str, order, limit: int) -> DataFrame:
    """key and rank (equal values share one) of the first `limit` rows; only those reach the window."""
    top = rows.orderBy(order, key).limit(limit)
    return top.select(F.col(key).alias("key"), F.rank().over(Window.orderBy(order)).alias("rank"))


def rrf(branches: list[tuple[DataFrame, float]], k: int = 60, limit: int | None = None) -> DataFrame:
    """key and score, the sum of weight / (k + rank) over the branches; each branch is (key, rank)."""
    parts = [b.select("key", (F.lit(float(w)) / (F.lit(k) + F.col("rank"))).alias("part")) for b, w in branches]
    out = reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.sum("part").alias("score"))
    return out.orderBy(F.desc("score"), "key").limit(limit) if limit else out
