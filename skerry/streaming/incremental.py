"""Incremental indexing: arriving rows are analysed batch by batch and appended to a postings table.

Each micro-batch writes its own folder, named by its number, so a batch that is tried again replaces
what it had written and no row counts twice. Deleted keys are left out by an anti join when reading.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.plans.index import FieldSpec, SearchIndex


def append_stream(stream: DataFrame, key: str, field: FieldSpec, out: str, checkpoint: str, available_now: bool = True):
    """Starts a query that appends the postings of all that arrives under `out`."""

    def put(batch: DataFrame, number: int) -> None:
        index = SearchIndex(batch, key, {"text": field})
        index.postings("text").repartitionByRange("term", "key").sortWithinPartitions("term", "key").write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_postings(spark: SparkSession, out: str, deleted: DataFrame | None = None) -> DataFrame:
    """The live postings; `deleted` holds keys that are gone."""
    rows = spark.read.parquet(out)
    return rows if deleted is None else rows.join(deleted.select(F.col(deleted.columns[0]).alias("key")).distinct(), "key", "left_anti")


def merge_batches(spark: SparkSession, out: str, target: str, deleted: DataFrame | None = None) -> None:
    """All batches as one table sorted by term, without deleted keys."""
    read_postings(spark, out, deleted).drop("batch").repartitionByRange("term", "key").sortWithinPartitions("term", "key").write.mode("overwrite").parquet(target)


def numbers(postings: DataFrame) -> tuple[int, float]:
    """Documents and mean length of a postings table, for scoring."""
    lengths = postings.groupBy("key").agg(F.first("length").alias("n"))
    row = lengths.agg(F.count(F.lit(1)), F.avg("n")).first()
    return row[0], row[1] or 0.0


def verify(postings: DataFrame, source: DataFrame, key: str, field: FieldSpec) -> DataFrame:
    """Keys whose postings and source differ: in one only, or with another number of tokens."""
    have = postings.groupBy("key").agg(F.sum("tf").alias("have"))
    want = source.select(F.col(key).alias("key"), F.size(field.analyzer.tokens(F.expr(field.column))).cast("long").alias("want")).where("want > 0")
    return have.join(want, "key", "full").where("have is distinct from want")
