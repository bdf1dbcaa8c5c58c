"""The corpus pipeline: documents through five stages to encoded training texts.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as Parquet and read
again as the next stage's docs. All stages but the last give the columns of documents.

Defined results: null and empty texts are scored as such texts by the classifier, and fail the quality
rules for want of words; null ids, languages and sources are carried like any other value; identical
rows are one document after the third stage; very long texts go through whole; ties are settled by
smallest id and by hashes of ids, so every run gives the same rows; empty tables give an empty result;
further columns of `documents`, whatever their names, are left out from the first stage on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skerry.llm import jaccard_join, mixing, piece_codec, quality_classifier, quality_rules
from skerry.llm.common import table
from skerry.sources.scratch import fresh_folder, remove

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for good ones (score of 0.3 or more)."""
    docs = docs.select(*COLUMNS)
    return quality_classifier.classify(docs, quality_classifier.fit(docs, table(spark, sf_dir, "labels")), keep=True)


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, with cross-document line frequency."""
    return quality_rules.filter_documents(docs.select(*COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles join at a similarity of 0.8 or more."""
    return jaccard_join.keep_first(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sample that meets the target weights of sources, languages and topics."""
    return mixing.mix_sources(docs.select(*COLUMNS)).where("mix_kept").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's piece ids, their number and checksum, and whether they decode to its text."""
    return piece_codec.encode_pieces(docs.select(*COLUMNS))


STAGES = [("quality classifier", classify_quality), ("quality rules", apply_rules), ("n-gram Jaccard join", drop_near_copies), ("mixing sources", mix), ("piece encoding", encode)]

#: The classifier and the piece ids are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again.

    A stage's table is deleted once the next one is written; the last one's is the result.
    """
    docs = table(spark, sf_dir, "documents")
    folder = fresh_folder(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
