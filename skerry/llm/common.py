"""Shared helpers of the training-data operators: tables, lineage cuts, row keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.sources.scratch import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table `name` below `sf_dir` (any path that Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder, without its lineage.

    The folder is the session's spark.checkpoint.dir (see skerry.sources.scratch).
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def free_name(df: DataFrame, name: str) -> str:
    """`name`, with underscores behind it until no column of `df` is called so (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_hash(*cols: str) -> Column:
    """A 64-bit hash of the row's columns that tells null from empty."""
    parts = [x for c in cols for x in (F.col(c).isNull(), F.col(c))]
    return F.xxhash64(*parts)


def tasks(spark: SparkSession) -> int:
    """Shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread_join(many: DataFrame, few: DataFrame, key: str, by: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """`many` joined with `few` (one row a key) on `key`; the rows of one key go to `salts` tasks by the hash of `by`."""
    left = many.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    right = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right.hint("merge"), [key, "_salt"], how).drop("_salt")
