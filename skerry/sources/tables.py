"""Reading and writing tables, with the layouts that later queries profit from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

FORMATS = {"parquet", "csv", "json", "orc"}


def load(spark: SparkSession, path: str, kind: str = "parquet", schema: StructType | str | None = None, **options) -> DataFrame:
    """A table of one of the file formats; CSV has a header unless told otherwise, and no inference without asking."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}")
    reader = spark.read.options(**({"header": "true"} if kind == "csv" else {}) | options)
    return (reader.schema(schema) if schema is not None else reader).format(kind).load(path)


def save(df: DataFrame, path: str, kind: str = "parquet", sort_by: list[str] | None = None, partition_by: list[str] | None = None, range_by: list[str] | None = None, mode: str = "overwrite") -> None:
    """Writes a table: `range_by` deals rows by ranges, `sort_by` orders each file (row-group statistics prune), `partition_by` makes folders."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}")
    if range_by:
        df = df.repartitionByRange(*range_by)
    if sort_by:
        df = df.sortWithinPartitions(*sort_by)
    writer = df.write.mode(mode).format(kind)
    if kind == "csv":
        writer = writer.option("header", "true")
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def compact(spark: SparkSession, path: str, target: str, file_bytes: int = 128 << 20, kind: str = "parquet") -> int:
    """Rewrites a table of many small files as files of about `file_bytes`; gives the number of files."""
    df = load(spark, path, kind)
    size = spark._jvm.org.apache.hadoop.fs.Path(path)
    total = size.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(size).getLength()
    n = max(1, -(-total // file_bytes))
    df.repartition(n).write.mode("overwrite").format(kind).save(target)
    return n


def late_columns(top: DataFrame, wide: DataFrame, key: str) -> DataFrame:
    """The wide columns of a few chosen rows: `top` (key, score, ...) joined back to `wide` by key."""
    return top.join(wide.drop(*[c for c in top.columns if c != key and c in wide.columns]), key)
