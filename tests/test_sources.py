import numpy as np
import pytest
from pyspark.sql import functions as F

from skerry.operators.vector_search import ClusterIndex, knn
from skerry.plans.index import FieldSpec
from skerry.sources.demo import KINDS, demo_table
from skerry.sources.tables import compact, late_columns, load, save
from skerry.streaming.incremental import append_stream, merge_batches, read_postings, verify


def test_formats_and_compaction(spark, tmp_path):
    items = demo_table(spark, "orders", 30)
    for kind in ("parquet", "csv", "json", "orc"):
        save(items, f"{tmp_path}/{kind}", kind, sort_by=["order_id"])
        assert load(spark, f"{tmp_path}/{kind}", kind, schema=items.schema).count() == 30
    save(items.repartition(9), f"{tmp_path}/many")
    assert compact(spark, f"{tmp_path}/many", f"{tmp_path}/few") == 1
    top = items.select("order_id").orderBy("order_id").limit(3)
    assert late_columns(top, items, "order_id").count() == 3


def test_demo_tables(spark):
    for kind in KINDS:
        assert demo_table(spark, kind, 12).count() == 12


def test_stream_of_batches(spark, tmp_path):
    items = demo_table(spark, "items", 20).select("id", "description")
    for part in (0, 1):
        items.where(F.col("id") % 2 == part).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(items.schema).parquet(f"{tmp_path}/in")
        append_stream(stream, "id", FieldSpec("description"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    rows = read_postings(spark, f"{tmp_path}/out")
    assert rows.select("key").distinct().count() == 20
    assert verify(rows, items, "id", FieldSpec("description")).count() == 0
    gone = spark.createDataFrame([(3,), (4,)], "id int")
    merge_batches(spark, f"{tmp_path}/out", f"{tmp_path}/merged", gone)
    assert spark.read.parquet(f"{tmp_path}/merged").select("key").distinct().count() == 18


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
def test_clusters_find_the_neighbours_by_each_metric(spark, tmp_path, metric):
    """Vectors of unequal length in loose groups; a fifth of the clusters holds nine tenths of the neighbours."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(25, 12))
    vectors = (centres[np.arange(2000) % 25] + 0.25 * rng.normal(size=(2000, 12))) * rng.uniform(0.5, 2, size=(2000, 1))
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    index = ClusterIndex(rows, metric=metric, centroid_ratio=0.02)
    index.write(f"{tmp_path}/clusters")
    queries = [[float(x) for x in vectors[i] * 1.1] for i in (3, 500, 1001, 1777)]
    assert index.recall(queries, 10, 0.2) >= 0.9
    assert index.recall(queries[:1], 10, 1.0) == 1.0
    assert index.recall(queries, 10, index.probe_for(queries, 10)) >= 0.9
    assert index.info().first().clusters == 40 and index.clusters().count() <= 40


def test_few_rows_are_one_cluster(spark):
    rows = demo_table(spark, "items", 100).select(F.col("id").alias("vec_id"), "embedding")
    query = [float(x) for x in rows.where("vec_id = 5").first().embedding]
    index = ClusterIndex(rows)
    assert index.k == 1
    assert [r.vec_id for r in index.search(query, 5).collect()] == [r.vec_id for r in knn(rows, query, 5).collect()]
    with pytest.raises(ValueError):
        ClusterIndex(rows, metric="nope")
