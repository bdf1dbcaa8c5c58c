"""The pipeline's stages on a small table, each against its own operator, and the entry file's guard."""

import os

import pytest

import corpus_pipeline
from skerry.llm import jaccard_join, quality_rules

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == before.columns
            assert kept[name] <= {r.doc_id for r in before.select("doc_id").collect()}
        if name == "quality rules":
            assert kept[name] == {r.id for r in quality_rules.quality_rules(before).where("kept").collect()}
        if name == "n-gram Jaccard join":
            assert kept[name] == {r.class_id for r in jaccard_join.jaccard_join(before).collect()}
    assert docs.where("not round_trip").count() == 0
    assert docs.count() == len(kept["mixing sources"])


def test_run_gives_the_same_rows_twice(spark):
    a, b = (sorted((r.doc_id, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect()) for _ in range(2))
    assert a == b and a


def test_rules_stage_writes_texts_without_frequent_lines(spark, tmp_path):
    own = lambda k: " ".join(f"own{k}x{i}" for i in range(80))
    rows = [(k, f"the same line everywhere\n{own(k)}", "en", "h", 0) for k in range(12)]
    corpus_pipeline.apply_rules(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), SF).write.parquet(f"{tmp_path}/2")
    got = {r.doc_id: (r.text, r.n_chars) for r in spark.read.parquet(f"{tmp_path}/2").collect()}
    assert got == {k: (own(k), len(own(k))) for k in range(12)}


def test_odd_empty_and_clashing_tables_go_through(spark, odd, make, tmp_path):
    """Nulls, repeated rows, long texts and columns of other names; every stage by itself, on an empty table too."""
    good = make([f"{k} " + " ".join(f"word{k}x{i}" for i in range(80)) for k in range(6)], ids=range(100, 106))
    for name, docs in (("odd", odd.union(good)), ("empty", odd.limit(0))):
        docs.coalesce(1).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(100, 1, 0), (101, 1, 0), (3, 0, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").limit(0 if name == "empty" else 9).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        rows = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert all(r.round_trip for r in rows) and bool(rows) == (name == "odd")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, f"{tmp_path}/{name}").columns == corpus_pipeline.COLUMNS
