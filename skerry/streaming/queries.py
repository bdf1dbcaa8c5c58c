"""The streaming index as a query: documents arrive as a stream, and are searched afterwards."""

from __future__ import annotations

from pyspark.sql import functions as F

from skerry.plans.index import FieldSpec, search_postings
from skerry.plans.text_queries import ANY, has, oracle
from skerry.sources.scratch import fresh_folder
from skerry.streaming.incremental import append_stream, numbers, read_postings

QUERIES, ORACLE_SQL = {}, {}


def stream_index(spark, sf_dir):
    path = f"{sf_dir}/documents.parquet"
    schema, folder = spark.read.parquet(path).schema, fresh_folder(spark, "stream")
    reader = spark.readStream.schema(schema)
    # a stream watches a folder: the table's own, or the one that holds its single file
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    stream = reader.parquet(path) if whole else reader.option("pathGlobFilter", "documents.parquet").parquet(sf_dir)
    append_stream(stream, "doc_id", FieldSpec("text"), f"{folder}/postings", f"{folder}/state").awaitTermination()
    rows = read_postings(spark, f"{folder}/postings")
    n, mean = numbers(rows)
    return search_postings(rows, ["license", "public"], n, mean).select(F.col("key").alias("doc_id"), F.round("score", 4).alias("score"))


QUERIES["stream_index"] = stream_index
ORACLE_SQL["stream_index"] = oracle(f"{has('license')} OR {has('public')}", ANY)
