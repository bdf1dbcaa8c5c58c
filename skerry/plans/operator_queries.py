"""Queries for JSON aggregations, facets, vectors, rank fusion, ranges and highlighting."""

from __future__ import annotations

from pyspark.sql import functions as F

from skerry.functions import ranges
from skerry.functions.vectors import inner_product
from skerry.operators.fusion import ranked, rrf
from skerry.operators.highlight import highlight, snippet, snippet_positions, snippets
from skerry.operators.json_aggs import aggregate, buckets, facet
from skerry.operators.vector_search import ClusterIndex, knn
from skerry.plans import ast as q
from skerry.plans.index import FieldSpec, SearchIndex
from skerry.plans.text_queries import BASE, WORD, documents, has, one, read

QUERIES, ORACLE_SQL = {}, {}


def entry(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


# -- JSON aggregations ---------------------------------------------------------------------------------


def agg_query(name: str, table: str, spec: dict, sql: str, *columns):
    """A bucket aggregation as a flat table; `columns` changes or picks what is compared."""

    @entry(name, sql)
    def run(spark, sf_dir):
        out = buckets(read(spark, sf_dir, table), spec, exact=True)
        return out.selectExpr(*columns) if columns else out


agg_query("json_terms", "documents", {"terms": {"field": "lang", "size": 3}, "aggs": {"chars": {"avg": {"field": "n_chars"}}}}, "SELECT lang AS key, count(*) AS doc_count, round(avg(n_chars), 4) AS chars FROM documents WHERE lang IS NOT NULL GROUP BY lang ORDER BY doc_count DESC, key LIMIT 3", "key", "doc_count", "round(chars, 4) AS chars")
agg_query("json_terms_order", "orders", {"terms": {"field": "o_orderpriority", "order": {"_key": "asc"}, "size": 100}, "aggs": {"top": {"max": {"field": "o_totalprice"}}}}, "SELECT o_orderpriority AS key, count(*) AS doc_count, max(o_totalprice) AS top FROM orders GROUP BY 1")
agg_query("json_terms_path", "events", {"terms": {"field": "props.k", "size": 5}}, "SELECT props->>'$.k' AS key, count(*) AS doc_count FROM events GROUP BY 1 ORDER BY doc_count DESC, key LIMIT 5")
agg_query("json_terms_missing", "labels", {"terms": {"field": "quality", "missing": -1, "size": 10}}, "SELECT coalesce(quality, -1)::INT AS key, count(*) AS doc_count FROM labels GROUP BY 1")
agg_query("json_histogram", "documents", {"histogram": {"field": "n_chars", "interval": 2000}}, "WITH b AS (SELECT floor(n_chars / 2000.0) * 2000 AS key, count(*) AS n FROM documents GROUP BY 1), g AS (SELECT unnest(range((SELECT min(key) / 2000 FROM b)::BIGINT, (SELECT max(key) / 2000 FROM b)::BIGINT + 1)) * 2000.0 AS key) SELECT g.key::DOUBLE AS key, coalesce(b.n, 0)::BIGINT AS doc_count FROM g LEFT JOIN b ON b.key = g.key")
agg_query("json_date_histogram", "orders", {"date_histogram": {"field": "o_orderdate", "fixed_interval": "30d"}, "aggs": {"total": {"sum": {"field": "o_totalprice"}}}}, "SELECT (epoch_ms(o_orderdate) // 2592000000) * 2592000000 AS key, count(*) AS doc_count, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1", "key", "doc_count", "round(total, 2) AS total")
agg_query("json_range", "part", {"range": {"field": "p_retailprice", "ranges": [{"to": 1000}, {"from": 1000, "to": 1500}, {"from": 5000}]}}, "SELECT r.key, count(p_partkey) AS doc_count FROM (VALUES ('*-1000', NULL, 1000), ('1000-1500', 1000, 1500), ('1500-5000', 1500, 5000), ('5000-*', 5000, NULL)) r(key, lo, hi) LEFT JOIN part ON (lo IS NULL OR p_retailprice >= lo) AND (hi IS NULL OR p_retailprice < hi) GROUP BY r.key")
agg_query("json_filter", "documents", {"filter": {"sql": "n_chars > 2000"}, "aggs": {"longest": {"max": {"field": "n_chars"}}}}, "SELECT count(*) AS doc_count, max(n_chars)::DOUBLE AS longest FROM documents WHERE n_chars > 2000")
agg_query("json_multi_terms", "lineitem", {"multi_terms": {"terms": [{"field": "l_returnflag"}, {"field": "l_linestatus"}], "size": 4}}, "SELECT l_returnflag AS key_0, l_linestatus AS key_1, count(*) AS doc_count FROM lineitem GROUP BY ALL ORDER BY doc_count DESC, 1, 2 LIMIT 4")
agg_query("json_composite", "documents", {"composite": {"size": 7, "sources": [{"l": {"terms": {"field": "lang"}}}, {"s": {"terms": {"field": "source"}}}], "after": {"l": "en", "s": "src15"}}}, "SELECT lang AS l, source AS s, count(*) AS doc_count FROM documents WHERE (lang, source) > ('en', 'src15') GROUP BY ALL ORDER BY 1, 2 LIMIT 7")
agg_query("json_stats", "events", {"terms": {"field": "event_type"}, "aggs": {"v": {"stats": {"field": "value"}}}}, "SELECT event_type AS key, count(*) AS doc_count, round(sum(value), 2) AS total, min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean FROM events GROUP BY 1", "key", "doc_count", "round(v.sum, 2) AS total", "v.min AS low", "v.max AS high", "round(v.avg, 6) AS mean")
agg_query("json_extended_stats", "events", {"terms": {"field": "event_type"}, "aggs": {"v": {"extended_stats": {"field": "value"}}}}, "SELECT event_type AS key, round(var_pop(value), 5) AS variance, round(stddev_samp(value), 6) AS sampling, round(sum(value * value), 2) AS squares FROM events GROUP BY 1", "key", "round(v.variance, 5) AS variance", "round(v.std_deviation_sampling, 6) AS sampling", "round(v.sum_of_squares, 2) AS squares")
agg_query("json_percentiles", "events", {"terms": {"field": "event_type"}, "aggs": {"v": {"percentiles": {"field": "value", "percents": [50, 95]}}}}, "SELECT event_type AS key, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1", "key", "round(v['50.0'], 6) AS p50", "round(v['95.0'], 6) AS p95")
agg_query("json_cardinality", "lineitem", {"terms": {"field": "l_returnflag"}, "aggs": {"parts": {"cardinality": {"field": "l_partkey"}}}}, "SELECT l_returnflag AS key, count(*) AS doc_count, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
agg_query("json_top_hits", "orders", {"terms": {"field": "o_orderstatus"}, "aggs": {"best": {"top_hits": {"size": 2, "sort": [{"o_totalprice": "desc"}, {"o_orderkey": "asc"}], "docvalue_fields": ["o_orderkey"]}}}}, "SELECT o_orderstatus AS key, max(CASE WHEN rn = 1 THEN o_orderkey END) AS first, max(CASE WHEN rn = 2 THEN o_orderkey END) AS second FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) GROUP BY 1", "key", "get(best, 0).o_orderkey AS first", "get(best, 1).o_orderkey AS second")


def _each(response, path: str, schema: str, out: str):
    """The buckets below `path` of a response, one row each."""
    return response.select(F.inline(F.from_json(F.get_json_object("response", path), schema))).selectExpr(*out.split("; "))


@entry("json_terms_nested", "SELECT lang AS key, source AS inner_key, n AS inner_count FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS rn FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL)) WHERE rn <= 2")
def json_terms_nested(spark, sf_dir):
    got = aggregate(read(spark, sf_dir, "documents"), {"l": {"terms": {"field": "lang", "size": 100}, "aggs": {"s": {"terms": {"field": "source", "size": 2}}}}})
    outer = _each(got, "$.l.buckets", "array<struct<key: string, s: struct<buckets: array<struct<key: string, doc_count: bigint>>>>>", "key; s.buckets AS b")
    return outer.select("key", F.inline("b").alias("inner_key", "inner_count"))


@entry("json_nested_three", "SELECT l_returnflag AS a, l_linestatus AS b, l_linenumber::VARCHAR AS c, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ALL")
def json_nested_three(spark, sf_dir):
    below = {"c": {"terms": {"field": "l_linenumber", "size": 100}, "aggs": {"q": {"sum": {"field": "l_quantity"}}}}}
    got = aggregate(read(spark, sf_dir, "lineitem"), {"a": {"terms": {"field": "l_returnflag"}, "aggs": {"b": {"terms": {"field": "l_linestatus"}, "aggs": below}}}})
    inner = "array<struct<key: string, doc_count: bigint, q: struct<value: double>>>"
    one = _each(got, "$.a.buckets", f"array<struct<key: string, b: struct<buckets: array<struct<key: string, c: struct<buckets: {inner}>>>>>>", "key AS a; b.buckets AS x")
    two = one.select("a", F.inline("x").alias("b", "y")).select("a", "b", F.inline("y.buckets").alias("c", "n", "v"))
    return two.select("a", "b", "c", "n", F.round("v.value", 2).alias("q"))


@entry("json_filter_terms", "SELECT source AS key, count(*) AS n, max(n_chars)::DOUBLE AS longest FROM documents WHERE n_chars > 2000 GROUP BY source")
def json_filter_terms(spark, sf_dir):
    got = aggregate(read(spark, sf_dir, "documents"), {"f": {"filter": {"sql": "n_chars > 2000"}, "aggs": {"s": {"terms": {"field": "source", "size": 1000}, "aggs": {"m": {"max": {"field": "n_chars"}}}}}}})
    return _each(got, "$.f.s.buckets", "array<struct<key: string, doc_count: bigint, m: struct<value: double>>>", "key; doc_count AS n; m.value AS longest")


@entry("json_range_nested", "SELECT p.p_brand AS brand, r.key, r.lo AS low, r.hi AS high, count(x.p_partkey) AS n FROM (SELECT DISTINCT p_brand FROM part) p CROSS JOIN (VALUES ('*-1000', NULL, 1000.0::DOUBLE), ('1000-1500', 1000.0, 1500.0), ('1500-5000', 1500.0, 5000.0), ('5000-*', 5000.0, NULL)) r(key, lo, hi) LEFT JOIN part x ON x.p_brand = p.p_brand AND (r.lo IS NULL OR x.p_retailprice >= r.lo) AND (r.hi IS NULL OR x.p_retailprice < r.hi) GROUP BY ALL")
def json_range_nested(spark, sf_dir):
    below = {"r": {"range": {"field": "p_retailprice", "ranges": [{"to": 1000}, {"from": 1000, "to": 1500}, {"from": 5000}]}}}
    got = aggregate(read(spark, sf_dir, "part"), {"b": {"terms": {"field": "p_brand", "size": 1000}, "aggs": below}})
    outer = _each(got, "$.b.buckets", "array<struct<key: string, r: struct<buckets: array<struct<key: string, `from`: double, `to`: double, doc_count: bigint>>>>>", "key AS brand; r.buckets AS x")
    return outer.select("brand", F.inline("x").alias("key", "low", "high", "n"))


@entry("json_filter_nested", "SELECT lang AS key, count(*) FILTER (WHERE n_chars > 15000) AS n FROM documents GROUP BY lang")
def json_filter_nested(spark, sf_dir):
    got = aggregate(read(spark, sf_dir, "documents"), {"l": {"terms": {"field": "lang", "size": 100}, "aggs": {"f": {"filter": {"sql": "n_chars > 15000"}}}}})
    return _each(got, "$.l.buckets", "array<struct<key: string, f: struct<doc_count: bigint>>>", "key; f.doc_count AS n")


@entry("json_response", "SELECT count(*) AS n, round(avg(value), 6) AS mean FROM events")
def json_response(spark, sf_dir):
    got = aggregate(read(spark, sf_dir, "events"), {"n": {"value_count": {"field": "event_id"}}, "mean": {"avg": {"field": "value"}}})
    return got.select(F.get_json_object("response", "$.n.value").cast("long").alias("n"), F.round(F.get_json_object("response", "$.mean.value").cast("double"), 6).alias("mean"))


@entry("facet_over", f"{BASE}, m AS (SELECT * FROM d WHERE {has('license')}) SELECT doc_id, (SELECT count(*) FROM m) AS total FROM m, s ORDER BY {one('license')} DESC, doc_id LIMIT 5")
def facet_over(spark, sf_dir):
    index, node = documents(spark, sf_dir), q.Term("text", "license")
    out = facet(index.search(node), index.top(node, 5), {"n": {"value_count": {"field": "doc_id"}}})
    return out.select("doc_id", F.get_json_object("facet", "$.n.value").cast("long").alias("total"))


# -- vectors and fusion -----------------------------------------------------------------------------------

QUERY_ID = 7


def _query(spark, sf_dir) -> list[float]:
    return [float(x) for x in read(spark, sf_dir, "embeddings").where(F.col("vec_id") == QUERY_ID).first().embedding]


def _vector_sql(distance: str, where: str = "true") -> str:
    return f"WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = {QUERY_ID}) SELECT vec_id, round({distance}, 6) AS distance FROM embeddings, q WHERE {where} ORDER BY {distance}, vec_id LIMIT 10"


for _name, _metric, _sql in (("knn_l2", "l2", "list_distance(embedding::DOUBLE[], v)"), ("knn_cosine", "cosine", "list_cosine_distance(embedding::DOUBLE[], v)"), ("knn_ip", "ip", "-list_inner_product(embedding::DOUBLE[], v)")):

    def _knn(spark, sf_dir, metric=_metric):
        return knn(read(spark, sf_dir, "embeddings"), _query(spark, sf_dir), 10, metric).select("vec_id", F.round("distance", 6).alias("distance"))

    entry(_name, _vector_sql(_sql))(_knn)


@entry("knn_filtered", _vector_sql("list_distance(embedding::DOUBLE[], v)", "label = 3"))
def knn_filtered(spark, sf_dir):
    return knn(read(spark, sf_dir, "embeddings"), _query(spark, sf_dir), 10, where="label = 3").select("vec_id", F.round("distance", 6).alias("distance"))


for _name, _metric, _sql in (("knn_clusters", "l2", "list_distance(embedding::DOUBLE[], v)"), ("knn_clusters_cosine", "cosine", "list_cosine_distance(embedding::DOUBLE[], v)"), ("knn_clusters_ip", "ip", "-list_inner_product(embedding::DOUBLE[], v)")):

    def _clusters(spark, sf_dir, metric=_metric):
        """With every cluster probed a search gives the exact answer."""
        index = ClusterIndex(read(spark, sf_dir, "embeddings"), metric=metric, centroid_ratio=0.02)
        return index.search(_query(spark, sf_dir), 10, probe=1.0).select("vec_id", F.round("distance", 6).alias("distance"))

    entry(_name, _vector_sql(_sql))(_clusters)


@entry("vector_info", "SELECT count(*) AS rows, greatest(1, round(count(*) * 0.02))::INT AS clusters, 'l2' AS metric, max(len(embedding))::INT AS dimensions FROM embeddings")
def vector_info(spark, sf_dir):
    return ClusterIndex(read(spark, sf_dir, "embeddings"), centroid_ratio=0.02, flat_below=0).info()


@entry("vector_clusters", "SELECT count(*) AS n FROM embeddings")
def vector_clusters(spark, sf_dir):
    return ClusterIndex(read(spark, sf_dir, "embeddings"), centroid_ratio=0.02).clusters().agg(F.sum("rows").alias("n"))


@entry("vector_self_product", "SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS p FROM embeddings")
def vector_self_product(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(inner_product(F.col("embedding"), F.col("embedding")), 6).alias("p"))


@entry("rrf_hybrid", f"""{BASE}, q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = {QUERY_ID}),
a AS (SELECT doc_id AS key, round({one('license')}, 6) AS x FROM d, s WHERE {has('license')} ORDER BY x DESC, key LIMIT 20),
b AS (SELECT vec_id AS key, round(list_distance(embedding::DOUBLE[], v), 6) AS x FROM embeddings, q ORDER BY x, key LIMIT 20),
r AS (SELECT key, rank() OVER (ORDER BY x DESC) AS k, 1.0 AS w FROM a UNION ALL SELECT key, rank() OVER (ORDER BY x), 0.5 FROM b)
SELECT key, round(sum(w / (60 + k)), 6)::DOUBLE AS score FROM r GROUP BY key""")
def rrf_hybrid(spark, sf_dir):
    text = documents(spark, sf_dir).search(q.Term("text", "license")).withColumn("x", F.round("score", 6))
    near = knn(read(spark, sf_dir, "embeddings"), _query(spark, sf_dir), 20).withColumn("x", F.round("distance", 6))
    return rrf([(ranked(text, "doc_id", F.desc("x"), 20), 1.0), (ranked(near, "vec_id", F.asc("x"), 20), 0.5)]).select("key", F.round("score", 6).alias("score"))


@entry("hybrid_join", f"{BASE} SELECT d.doc_id, e.label, round({one('license')}, 4)::DOUBLE AS score FROM d JOIN embeddings e ON e.vec_id = d.doc_id, s WHERE {has('license')}")
def hybrid_join(spark, sf_dir):
    found = documents(spark, sf_dir).search(q.Term("text", "license"))
    return found.join(read(spark, sf_dir, "embeddings"), F.col("vec_id") == F.col("doc_id")).select("doc_id", "label", F.round("score", 4).alias("score"))


@entry("score_in_join", f"{BASE} SELECT d.doc_id, l.quality, round({one('license')} + (CASE WHEN l.toxic = 1 THEN 1.0 ELSE 0.0 END), 4)::DOUBLE AS total FROM d JOIN labels l USING (doc_id), s WHERE {has('license')}")
def score_in_join(spark, sf_dir):
    left = documents(spark, sf_dir).search(q.Term("text", "license"), "a")
    right = SearchIndex(read(spark, sf_dir, "labels"), "doc_id", {}).scored(q.Where("toxic = 1"), score="b")
    return left.join(right, "doc_id").select("doc_id", "quality", F.round(F.col("a") + F.col("b"), 4).alias("total"))


@entry("agg_of_score", f"{BASE} SELECT lang, count(*) AS n, round(max({one('license')}), 4)::DOUBLE AS best FROM d, s WHERE {has('license')} GROUP BY lang")
def agg_of_score(spark, sf_dir):
    return documents(spark, sf_dir).search(q.Term("text", "license")).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("score"), 4).alias("best"))


# -- ranges ---------------------------------------------------------------------------------------------

ROWS = "(SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity END AS lo, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity + l_linenumber END AS hi FROM lineitem)"


def range_query(name: str, node: q.RangeTerm, test: str):
    @entry(name, f"SELECT l_orderkey, l_linenumber FROM {ROWS} WHERE {test}")
    def run(spark, sf_dir):
        rows = read(spark, sf_dir, "lineitem")
        low, high = F.expr("CASE WHEN l_linenumber <> 1 THEN l_quantity END"), F.expr("CASE WHEN l_linenumber <> 7 THEN l_quantity + l_linenumber END")
        index = SearchIndex(rows.withColumn("span", ranges.make(low, high)), "l_orderkey", {})
        return index.search(node).select("l_orderkey", "l_linenumber")


range_query("range_term", q.RangeTerm("span", "term", 20.0), "(lo IS NULL OR lo <= 20) AND (hi IS NULL OR hi > 20)")
range_query("range_intersects", q.RangeTerm("span", "intersects", low=10.0, high=12.0, high_inclusive=True), "(lo IS NULL OR lo <= 12) AND (hi IS NULL OR hi > 10)")
range_query("range_contains", q.RangeTerm("span", "contains", low=10.0, high=30.0), "lo >= 10 AND hi <= 30")
range_query("range_within", q.RangeTerm("span", "within", low=20.0, high=21.0), "(lo IS NULL OR lo <= 20) AND (hi IS NULL OR hi >= 21)")

# -- highlighting -----------------------------------------------------------------------------------------

LICENSED = f"SELECT doc_id, text FROM documents WHERE list_contains(regexp_extract_all(lower(text), '{WORD}'), 'license')"


def _licensed(spark, sf_dir):
    return documents(spark, sf_dir).search(q.Term("text", "license"))


@entry("highlight_whole", f"SELECT doc_id, md5(regexp_replace(text, '\\b(license)\\b', '<b>\\1</b>', 'gi')) AS h FROM ({LICENSED})")
def highlight_whole(spark, sf_dir):
    return _licensed(spark, sf_dir).select("doc_id", F.md5(highlight(F.col("text"), ["license"])).alias("h"))


SHORT = "SELECT p_partkey, '(' || p_name || ', a RED-red ' || p_type || ')' AS t FROM part"
TAGGED = "regexp_replace(t, '\\b(red)\\b', '<b>\\1</b>', 'gi')"


def _short(spark, sf_dir):
    return read(spark, sf_dir, "part").selectExpr("p_partkey", "'(' || p_name || ', a RED-red ' || p_type || ')' AS t")


@entry("snippet_short", f"SELECT p_partkey, {TAGGED}[2:-2] AS s FROM ({SHORT})")
def snippet_short(spark, sf_dir):
    return _short(spark, sf_dir).select("p_partkey", snippet(F.col("t"), ["red"]).alias("s"))


@entry("snippets_short", f"SELECT p_partkey, {TAGGED}[2:-2] AS s, 1 AS n FROM ({SHORT})")
def snippets_short(spark, sf_dir):
    found = snippets(F.col("t"), ["red"], sort_by="position")
    return _short(spark, sf_dir).select("p_partkey", found.alias("x")).select("p_partkey", F.get("x", F.lit(0)).alias("s"), F.size("x").alias("n"))


@entry("snippet_positions_short", f"SELECT p_partkey, CASE WHEN p_name LIKE 'red %' THEN 3 ELSE 2 END AS n, (strpos(t, 'RED') - 1)::INT AS upper_start, (strpos(t, 'RED') + 2)::INT AS upper_end FROM ({SHORT.replace('SELECT p_partkey', 'SELECT p_partkey, p_name')})")
def snippet_positions_short(spark, sf_dir):
    found = snippet_positions(F.col("t"), ["red"])
    last = F.get("x", F.size("x") - 2)
    return _short(spark, sf_dir).select("p_partkey", found.alias("x")).select("p_partkey", F.size("x").alias("n"), F.get(last, F.lit(0)).alias("upper_start"), F.get(last, F.lit(1)).alias("upper_end"))


@entry("snippet")
def snippet_query(spark, sf_dir):
    return _licensed(spark, sf_dir).select("doc_id", snippet(F.col("text"), ["license"]).alias("snippet"))


@entry("snippets")
def snippets_query(spark, sf_dir):
    return _licensed(spark, sf_dir).select("doc_id", snippets(F.col("text"), ["license", "rights"], limit=3, sort_by="position").alias("snippets"))


@entry("snippet_positions")
def snippet_positions_query(spark, sf_dir):
    return _licensed(spark, sf_dir).select("doc_id", snippet_positions(F.col("text"), ["license"]).alias("positions"))


@entry("json_path_search", "SELECT event_id, 1.0::DOUBLE AS score FROM events WHERE props->>'$.k' = '69'")
def json_path_search(spark, sf_dir):
    index = SearchIndex(read(spark, sf_dir, "events"), "event_id", {"props.k": FieldSpec("get_json_object(props, '$.k')")})
    return index.search(q.TermSet("props.k", ("69",))).select("event_id", "score")
