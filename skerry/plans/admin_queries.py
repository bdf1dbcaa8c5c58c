"""Queries over SQL functions and index introspection."""

from __future__ import annotations

from pyspark.sql import functions as F

from skerry.plans import admin, sql
from skerry.plans import ast as q
from skerry.plans.text_queries import BASE, WORD, documents, has, near, one, read

QUERIES, ORACLE_SQL = {}, {}


def entry(name: str, text: str | None = None):
    def put(f):
        QUERIES[name] = f
        if text:
            ORACLE_SQL[name] = text
        return f

    return put


@entry("sql_match", f"{BASE} SELECT doc_id FROM d WHERE ({has('license')} OR {has('reserved')}) AND NOT ({has('gnu')} AND {has('public')})")
def sql_match(spark, sf_dir):
    sql.register(spark)
    return spark.sql("SELECT doc_id FROM {d} WHERE match_any(text, 'License reserved') AND NOT match_all(text, 'GNU public')", d=read(spark, sf_dir, "documents"))


@entry("sql_phrase", f"{BASE} SELECT doc_id FROM d WHERE contains(' ' || array_to_string(t, ' ') || ' ', ' all rights reserved ')")
def sql_phrase(spark, sf_dir):
    sql.register(spark)
    return spark.sql("SELECT doc_id FROM {d} WHERE match_phrase(text, 'All rights reserved.')", d=read(spark, sf_dir, "documents"))


@entry("sql_tokenize", f"SELECT p_partkey, unnest(x) AS term, (unnest(range(len(x))))::INT AS pos FROM (SELECT p_partkey, regexp_extract_all(lower(p_name), '{WORD}') AS x FROM part)")
def sql_tokenize(spark, sf_dir):
    sql.register(spark)
    return spark.sql("SELECT p_partkey, term, pos FROM {p}, LATERAL tokenize(p_name)", p=read(spark, sf_dir, "part"))


@entry("sql_vector", "SELECT vec_id, round(list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)), 6) AS d FROM embeddings")
def sql_vector(spark, sf_dir):
    sql.register(spark)
    return spark.sql("SELECT a.vec_id, round(vector_l2(a.embedding, b.embedding), 6) AS d FROM {e} a JOIN {e} b ON b.vec_id = 1", e=read(spark, sf_dir, "embeddings"))


@entry("admin_schema", "SELECT * FROM (VALUES ('text', 'text', 'string', 'unicode_words', 1.2::DOUBLE, 0.75::DOUBLE), ('source', 'source', 'string', 'unicode_words', 1.2, 0.75), ('doc_id', 'doc_id', 'bigint', NULL, NULL, NULL), ('lang', 'lang', 'string', NULL, NULL, NULL), ('n_chars', 'n_chars', 'bigint', NULL, NULL, NULL)) v(name, \"column\", type, tokenizer, k1, b)")
def admin_schema(spark, sf_dir):
    return admin.schema(documents(spark, sf_dir))


@entry("admin_info", "SELECT count(*) AS n FROM documents")
def admin_info(spark, sf_dir):
    return admin.info(documents(spark, sf_dir)).agg(F.sum("rows").alias("n"))


@entry("admin_statistics", f"{BASE} SELECT (SELECT n FROM s) AS n_docs, round((SELECT al FROM s), 6) AS mean_length, (SELECT count(DISTINCT x) FROM (SELECT unnest(t) AS x FROM d)) AS n_terms")
def admin_statistics(spark, sf_dir):
    return admin.statistics(documents(spark, sf_dir), "text").select("n_docs", F.round("mean_length", 6).alias("mean_length"), "n_terms")


@entry("admin_verify", f"{BASE} SELECT doc_id AS key, NULL::BIGINT AS have, len(t)::BIGINT AS want FROM d WHERE doc_id % 97 = 5 AND len(t) > 0")
def admin_verify(spark, sf_dir):
    """Written postings of which some rows were lost: their keys come out."""
    index = documents(spark, sf_dir)
    damaged = index.stored("postings", "text").where("key % 97 <> 5")
    return admin.verify(index, "text", damaged)


@entry("admin_dictionary", f"{BASE} SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(t) AS term FROM d) GROUP BY term")
def admin_dictionary(spark, sf_dir):
    return documents(spark, sf_dir).dictionary("text")


@entry("not_query", f"{BASE} SELECT doc_id, round(1.0 + {one('license')}, 4)::DOUBLE AS score FROM d, s WHERE {has('license')} AND NOT {has('gnu')}")
def not_query(spark, sf_dir):
    node = q.Boolean(must=(q.Term("text", "license"), q.negate(q.Term("text", "gnu"))))
    return documents(spark, sf_dir).search(node).select("doc_id", F.round("score", 4).alias("score"))


@entry("keyset_membership", f"{BASE} SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT doc_id FROM d WHERE {has('license')})")
def keyset_membership(spark, sf_dir):
    keys = documents(spark, sf_dir).search(q.Term("text", "license")).select("doc_id")
    return read(spark, sf_dir, "orders").join(keys, F.col("o_orderkey") == F.col("doc_id"), "left_semi").select("o_orderkey")


@entry("sql_terms", f"{BASE} SELECT doc_id FROM d WHERE ({has('license')} AND len(list_filter(t, lambda x: regexp_full_match(x, 'lic.*d'))) > 0) OR len(list_filter(t, lambda x: levenshtein(x, 'reservd') <= 1)) > 0")
def sql_terms(spark, sf_dir):
    sql.register(spark)
    return spark.sql("SELECT doc_id FROM {d} WHERE match_term(text, 'license') AND match_regex(text, 'lic.*d') OR match_fuzzy(text, 'reservd', 1)", d=read(spark, sf_dir, "documents"))


@entry("sql_near", f"{BASE} SELECT doc_id, {near('license', 'gnu', 'abs(b - a) <= 4')} > 0 AS either, {near('gnu', 'license', 'b >= a AND b - a <= 4')} > 0 AS ordered, contains(' ' || array_to_string(t, ' '), ' all rights res') AS prefix FROM d")
def sql_near(spark, sf_dir):
    sql.register(spark)
    return spark.sql("SELECT doc_id, match_near(text, 'license', 3, 'gnu') AS either, match_near_ordered(text, 'gnu', 3, 'license') AS ordered, match_phrase_prefix(text, 'All rights res') AS prefix FROM {d}", d=read(spark, sf_dir, "documents"))


@entry("sql_cosine", "SELECT vec_id, round(list_cosine_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)), 6) AS d FROM embeddings")
def sql_cosine(spark, sf_dir):
    sql.register(spark)
    return spark.sql("SELECT a.vec_id, round(vector_cosine(a.embedding, b.embedding), 6) AS d FROM {e} a JOIN {e} b ON b.vec_id = 1", e=read(spark, sf_dir, "embeddings"))


@entry("parameterised", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 150000 AND o_orderstatus IN ('F', 'P')")
def parameterised(spark, sf_dir):
    """One text, run with values bound by name."""
    read(spark, sf_dir, "orders").createOrReplaceTempView("_orders")
    return spark.sql("SELECT o_orderkey, o_totalprice FROM _orders WHERE o_totalprice > :least AND array_contains(:states, o_orderstatus)", args={"least": 150000, "states": F.array(F.lit("F"), F.lit("P"))})


@entry("row_level_view", f"{BASE} SELECT doc_id FROM d WHERE lang = 'de' AND {has('license')}")
def row_level_view(spark, sf_dir):
    """A view that shows a reader the rows of one language only; searched like any table."""
    read(spark, sf_dir, "documents").where("lang = 'de'").createOrReplaceTempView("_visible")
    sql.register(spark)
    return spark.sql("SELECT doc_id FROM _visible WHERE match_term(text, 'license')")


@entry("join_range_partitioned", "SELECT o_orderkey, count(*) AS n, round(sum(l_quantity), 2) AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def join_range_partitioned(spark, sf_dir):
    """Both sides dealt to the same buckets of key ranges, written so, and joined and summed within these."""
    orders, items = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    part = lambda c: F.floor(F.col(c) / 4096)  # noqa: E731  a bucket is a range of keys
    left = orders.select("o_orderkey", part("o_orderkey").alias("range"))
    right = items.select("l_orderkey", "l_quantity", part("l_orderkey").alias("range"))
    joined = left.repartition("range").join(right.repartition("range"), (F.col("o_orderkey") == F.col("l_orderkey")) & (left["range"] == right["range"]))
    return joined.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@entry("random_words", "SELECT 1000::BIGINT AS n, true AS fits")
def random_words(spark, sf_dir):
    return admin.random_words(spark, 1000, 7).agg(F.count("word").alias("n"), F.every(F.col("word").rlike("^[a-z]{3,10}$")).alias("fits"))
