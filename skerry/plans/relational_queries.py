"""Joins, aggregates, windows, set operations and subqueries: one SQL text for Spark and the oracle.

The text names tables in braces; Spark gets DataFrames for them, the oracle its own views. Where the
dialects differ, the oracle's text stands beside.
"""

from __future__ import annotations

import re

from skerry.plans.text_queries import read

QUERIES, ORACLE_SQL = {}, {}
NAMES = re.compile(r"\{(\w+)\}")


def query(name: str, sql: str, oracle: str | None = None):
    """Registers a query by its SQL."""

    def run(spark, sf_dir):
        return spark.sql(sql, **{t: read(spark, sf_dir, t) for t in set(NAMES.findall(sql))})

    QUERIES[name] = run
    ORACLE_SQL[name] = NAMES.sub(r"\1", oracle or sql)


# -- predicates --------------------------------------------------------------------------------------
query("pred_compare", "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_quantity >= 30 AND l_discount <> 0.05 AND l_shipdate < TIMESTAMP '1998-06-01' AND l_returnflag = 'R'")
query("pred_between", "SELECT o_orderkey FROM {orders} WHERE o_totalprice BETWEEN 100000 AND 120000")
query("pred_in", "SELECT p_partkey FROM {part} WHERE p_size IN (3, 9, 14) AND p_brand NOT IN ('Brand#1', 'Brand#2')")
query("pred_isnull", "SELECT o.o_orderkey, l.l_linenumber IS NULL AS lone FROM {orders} o LEFT JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey AND l.l_quantity > 49 WHERE l.l_linenumber IS NULL OR l.l_tax IS NOT NULL")
query("pred_bool", "SELECT doc_id, (quality = 1) IS TRUE AS good, (toxic = 1) IS NOT FALSE AS bad FROM {labels} WHERE NOT (quality = 0 AND toxic = 1)")
query("pred_like", "SELECT c_custkey FROM {customer} WHERE c_name LIKE '%00000012_' OR c_mktsegment ILIKE 'build%'")
query("pred_json", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM {events} WHERE CAST(get_json_object(props, '$.k') AS INT) > 90", "SELECT event_id, json_extract(props, '$.k')::INT AS k FROM {events} WHERE json_extract(props, '$.k')::INT > 90")
query("pred_json_exists", "SELECT event_id FROM {events} WHERE get_json_object(props, '$.k') IS NOT NULL AND get_json_object(props, '$.z') IS NULL", "SELECT event_id FROM {events} WHERE json_exists(props, '$.k') AND NOT json_exists(props, '$.z')")
query("pred_path_descendant", "SELECT page_id FROM (SELECT page_id, replace(split_part(url, '/', 3), '.', '_') || '.' || coalesce(split_part(split_part(url, '/', 4), '?', 1), '') AS path FROM {pages}) WHERE path = 'x' OR startswith(split_part(path, '.', 2), 'en')", "SELECT page_id FROM (SELECT page_id, replace(split_part(url, '/', 3), '.', '_') || '.' || coalesce(split_part(split_part(url, '/', 4), '?', 1), '') AS path FROM {pages}) WHERE path = 'x' OR starts_with(split_part(path, '.', 2), 'en')")
query("pred_regex_and_like", "SELECT doc_id FROM {documents} WHERE regexp_like(text, 'licen[cs]e') AND text LIKE '%GNU%' AND n_chars > 500", "SELECT doc_id FROM {documents} WHERE regexp_matches(text, 'licen[cs]e') AND text LIKE '%GNU%' AND n_chars > 500")

# -- joins -------------------------------------------------------------------------------------------
query("join_inner", "SELECT o.o_orderkey, c.c_name, o.o_totalprice FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey WHERE c.c_mktsegment = 'BUILDING'")
query("join_three_way", "SELECT n.n_name, r.r_name, count(*) AS n FROM {customer} c JOIN {nation} n ON c.c_nationkey = n.n_nationkey JOIN {region} r ON n.n_regionkey = r.r_regionkey GROUP BY n.n_name, r.r_name")
query("join_left", "SELECT c.c_custkey, o.o_orderkey FROM {customer} c LEFT JOIN {orders} o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000")
query("join_right", "SELECT c.c_custkey, o.o_orderkey FROM {orders} o RIGHT JOIN {customer} c ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'P'")
query("join_full", "SELECT a.doc_id AS doc_id, b.item_id AS item_id FROM {documents} a FULL JOIN {benchmark} b ON a.doc_id = b.item_id * 40")
query("join_semi", "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
query("join_semi_in", "SELECT p_partkey FROM {part} WHERE p_partkey IN (SELECT l_partkey FROM {lineitem} WHERE l_quantity = 50)")
query("join_anti", "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey)")
query("join_not_in", "SELECT doc_id FROM {documents} WHERE doc_id NOT IN (SELECT doc_id FROM {labels} WHERE quality = 1)")
query("join_not_in_null", "SELECT doc_id FROM {documents} WHERE doc_id NOT IN (SELECT CASE WHEN quality = 1 THEN doc_id END FROM {labels})")
query("join_mark", "SELECT p_partkey FROM {part} WHERE p_size > 48 OR p_partkey IN (SELECT l_partkey FROM {lineitem} WHERE l_quantity > 49)")
query("join_self", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM {supplier} a JOIN {supplier} b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
query("join_theta", "SELECT o.o_orderkey, l.l_linenumber FROM {orders} o JOIN {lineitem} l ON o.o_orderkey = l.l_orderkey AND l.l_extendedprice > o.o_totalprice / 4")
query("join_cross_or", "SELECT d.doc_id FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id WHERE contains(d.text, 'license') OR l.toxic = 1")
query("join_cross", "SELECT r.r_name, n.n_name FROM {region} r CROSS JOIN {nation} n")
query("join_lateral", "SELECT c.c_custkey, t.o_orderkey, t.o_totalprice FROM {customer} c, LATERAL (SELECT o_orderkey, o_totalprice FROM {orders} o WHERE o.o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t")
query("join_distinct", "SELECT DISTINCT c.c_mktsegment, o.o_orderpriority FROM {customer} c JOIN {orders} o ON c.c_custkey = o.o_custkey")
query("join_topk", "SELECT o.o_orderkey, c.c_custkey, o.o_totalprice FROM {orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 0 ORDER BY o.o_totalprice DESC, o.o_orderkey LIMIT 25")
query("join_text_key", "SELECT d.doc_id, e.n FROM {documents} d JOIN (SELECT source, count(*) AS n FROM {documents} GROUP BY source) e ON d.source = e.source WHERE d.n_chars < 300")
query("join_using_nullsafe", "SELECT a.doc_id FROM {labels} a JOIN {documents} b ON a.doc_id <=> b.doc_id WHERE b.lang = 'fr'", "SELECT a.doc_id FROM {labels} a JOIN {documents} b ON a.doc_id IS NOT DISTINCT FROM b.doc_id WHERE b.lang = 'fr'")

# -- aggregates ----------------------------------------------------------------------------------------
query("agg_count", "SELECT count(*) AS n, count(DISTINCT l_partkey) AS parts, count(CASE WHEN l_tax > 0.05 THEN 1 END) AS taxed FROM {lineitem}")
query("agg_sum_avg", "SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_quantity), 6) AS avg_qty, CAST(sum(DISTINCT l_linenumber) AS BIGINT) AS lines FROM {lineitem} GROUP BY l_returnflag, l_linestatus")
query("agg_minmax", "SELECT o_orderstatus, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date, min(o_totalprice) AS low, max(o_orderpriority) AS top FROM {orders} GROUP BY o_orderstatus")
query("agg_stddev_var", "SELECT event_type, round(stddev_samp(value), 6) AS sd, round(stddev_pop(value), 6) AS sdp, round(var_samp(value), 5) AS v, round(var_pop(value), 5) AS vp FROM {events} GROUP BY event_type")
query("agg_bool", "SELECT c_mktsegment, bool_and(c_acctbal > -900) AS a, bool_or(c_acctbal > 9900) AS b, every(c_custkey >= 0) AS c FROM {customer} GROUP BY c_mktsegment", "SELECT c_mktsegment, bool_and(c_acctbal > -900) AS a, bool_or(c_acctbal > 9900) AS b, bool_and(c_custkey >= 0) AS c FROM {customer} GROUP BY c_mktsegment")
query("agg_array", "SELECT n_regionkey, array_join(sort_array(collect_list(n_name)), '|') AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, array_to_string(list_sort(array_agg(n_name)), '|') AS names FROM {nation} GROUP BY n_regionkey")
query("agg_string", "SELECT n_regionkey, listagg(n_name, ', ') WITHIN GROUP (ORDER BY n_name DESC) AS names FROM {nation} GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name DESC) AS names FROM {nation} GROUP BY n_regionkey")
query("agg_filter", "SELECT lang, count(*) FILTER (WHERE contains(text, 'license')) AS licensed, count(*) FILTER (WHERE n_chars > 3000) AS longs, count(*) AS n FROM {documents} GROUP BY lang")
query("agg_having", "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY o_custkey HAVING count(*) > 15")
query("agg_topk", "SELECT l_partkey, round(sum(l_quantity), 2) AS q FROM {lineitem} GROUP BY l_partkey ORDER BY q DESC, l_partkey LIMIT 10")
query("agg_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
query("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY CUBE (l_returnflag, l_linestatus)")
query("agg_grouping_sets", "SELECT lang, source, count(*) AS n FROM {documents} GROUP BY GROUPING SETS ((lang), (source), ())")
query("agg_expression_key", "SELECT date_trunc('month', o_orderdate) AS m, count(*) AS n FROM {orders} GROUP BY date_trunc('month', o_orderdate)", "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS m, count(*) AS n FROM {orders} GROUP BY ALL")
query("agg_json_key", "SELECT get_json_object(props, '$.k') AS k, count(*) AS n, round(sum(value), 2) AS v FROM {events} GROUP BY get_json_object(props, '$.k')", "SELECT props->>'$.k' AS k, count(*) AS n, round(sum(value), 2) AS v FROM {events} GROUP BY ALL")
query("agg_unnest", "SELECT w, count(*) AS n FROM (SELECT explode(split(p_name, ' ')) AS w FROM {part}) GROUP BY w", "SELECT w, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM {part}) GROUP BY w")
query("agg_missing", "SELECT coalesce(lang, 'none') AS lang, count(l.quality) AS known, avg(coalesce(l.quality, 0)) AS q FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id GROUP BY coalesce(lang, 'none')")
query("agg_over_join", "SELECT n.n_name, round(sum(l.l_extendedprice), 2) AS total FROM {lineitem} l JOIN {supplier} s ON l.l_suppkey = s.s_suppkey JOIN {nation} n ON s.s_nationkey = n.n_nationkey GROUP BY n.n_name")
query("agg_empty", "SELECT count(*) AS n, sum(l_quantity) AS q, min(l_tax) AS t FROM {lineitem} WHERE l_quantity < 0")
query("agg_decimal", "SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2))) AS DECIMAL(22, 2)) AS total FROM {lineitem} GROUP BY l_returnflag")
query("agg_distinct", "SELECT DISTINCT p_brand, p_type FROM {part}")
query("agg_percentile", "SELECT event_type, round(percentile(value, 0.5), 6) AS p50, round(percentile(value, 0.95), 6) AS p95 FROM {events} GROUP BY event_type", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM {events} GROUP BY event_type")
query("agg_distinct_on", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM {orders}) WHERE rn = 1", "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM {orders} ORDER BY o_custkey, o_orderdate DESC, o_orderkey")

# -- windows -------------------------------------------------------------------------------------------
query("win_rank", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC) AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS d, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM {part}", "SELECT p_partkey, (rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC))::INT AS r, (dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size))::INT AS d, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey))::INT AS n FROM {part}")
query("win_lag_lead", "SELECT o_orderkey, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before_, lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS after_ FROM {orders}")
query("win_frame", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 4) AS s FROM {events}")
query("win_range_frame", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN INTERVAL '30' DAY PRECEDING AND CURRENT ROW) AS n FROM {orders}")
query("win_running", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), 2) AS running FROM {orders}")
query("win_ntile_first", "SELECT s_suppkey, ntile(4) OVER (ORDER BY s_acctbal, s_suppkey) AS tile, first_value(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS best FROM {supplier}", "SELECT s_suppkey, (ntile(4) OVER (ORDER BY s_acctbal, s_suppkey))::INT AS tile, first_value(s_suppkey) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS best FROM {supplier}")
query("facet_partition", "SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS in_lang, max(n_chars) OVER (PARTITION BY source) AS longest FROM {documents} WHERE contains(text, 'license')")

# -- set operations, subqueries, CTEs ----------------------------------------------------------------------
query("set_union", "SELECT lang AS k FROM {documents} UNION SELECT source FROM {documents}")
query("set_union_all", "SELECT n_name AS name FROM {nation} UNION ALL SELECT r_name FROM {region}")
query("set_intersect", "SELECT o_custkey AS k FROM {orders} WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM {orders} WHERE o_orderstatus = 'P'")
query("set_except", "SELECT c_custkey AS k FROM {customer} EXCEPT SELECT o_custkey FROM {orders}")
query("set_except_all", "SELECT l_linenumber AS k FROM {lineitem} WHERE l_returnflag = 'R' EXCEPT ALL SELECT l_linenumber FROM {lineitem} WHERE l_returnflag = 'A' AND l_quantity < 25")
query("sub_scalar", "SELECT p_partkey FROM {part} WHERE p_retailprice > (SELECT avg(p_retailprice) FROM {part})")
query("sub_correlated", "SELECT p_partkey FROM {part} p WHERE p_retailprice > (SELECT avg(p_retailprice) FROM {part} q WHERE q.p_brand = p.p_brand)")
query("cte", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM {orders} GROUP BY o_custkey), top AS (SELECT * FROM big WHERE t > 2000000) SELECT c.c_name, round(t.t, 2) AS total FROM top t JOIN {customer} c ON c.c_custkey = t.o_custkey")
query("cte_recursive", "WITH RECURSIVE up(k, root, depth) AS (SELECT n_nationkey, n_nationkey, 0 FROM {nation} WHERE n_nationkey = 24 UNION ALL SELECT CAST(floor((k - 1) / 2) AS INT), root, depth + 1 FROM up WHERE k > 0) SELECT k, root, depth FROM up", "WITH RECURSIVE up(k, root, depth) AS (SELECT n_nationkey, n_nationkey, 0 FROM {nation} WHERE n_nationkey = 24 UNION ALL SELECT ((k - 1) // 2)::INT, root, depth + 1 FROM up WHERE k > 0) SELECT k, root, depth FROM up")
query("order_nulls", "SELECT o_orderkey, q FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice END AS q FROM {orders}) ORDER BY q DESC NULLS LAST, o_orderkey LIMIT 30")
query("view_filtered", "SELECT v.doc_id FROM (SELECT * FROM {documents} WHERE lang = 'de') v WHERE v.n_chars > 4000")
query("order_range", "SELECT l_orderkey, l_linenumber FROM (SELECT *, struct(l_quantity AS lo, l_quantity + l_linenumber AS hi) AS r FROM {lineitem}) ORDER BY r, l_orderkey, l_linenumber LIMIT 40", "SELECT l_orderkey, l_linenumber FROM {lineitem} ORDER BY l_quantity, l_quantity + l_linenumber, l_orderkey, l_linenumber LIMIT 40")

# -- scalar functions --------------------------------------------------------------------------------------
query("fn_string", "SELECT c_custkey, concat_ws('', c_name, NULL, '-', c_mktsegment) AS c, ascii(c_name) AS a, repeat('ab', 2) AS r, startswith(c_name, 'Cust') AS sw, endswith(c_name, '7') AS ew, replace(c_name, '#', '') AS rp, length(c_name) AS n, substring(c_name, 3, 4) AS s, reverse(c_mktsegment) AS rv, upper(c_name) AS u, lower(c_name) AS l, trim(concat(' ', c_name, ' ')) AS t FROM {customer}",
      "SELECT c_custkey, concat(c_name, NULL, '-', c_mktsegment) AS c, ascii(c_name) AS a, repeat('ab', 2) AS r, starts_with(c_name, 'Cust') AS sw, ends_with(c_name, '7') AS ew, replace(c_name, '#', '') AS rp, length(c_name)::INT AS n, substring(c_name, 3, 4) AS s, reverse(c_mktsegment) AS rv, upper(c_name) AS u, lower(c_name) AS l, trim(concat(' ', c_name, ' ')) AS t FROM {customer}")
query("fn_math", "SELECT c_custkey, abs(c_acctbal) AS a, CAST(ceil(c_acctbal) AS BIGINT) AS c, CAST(floor(c_acctbal) AS BIGINT) AS f, round(c_acctbal, 1) AS r, round(sqrt(abs(c_acctbal)), 6) AS q, round(power(c_custkey, 2), 2) AS p, CAST(sign(c_acctbal) AS INT) AS s, round(ln(abs(c_acctbal) + 1), 6) AS l, round(log10(abs(c_acctbal) + 1), 6) AS g FROM {customer}")
query("fn_conditional", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), 'done') AS s, greatest(o_custkey, 500, NULL) AS g, least(o_custkey, 500) AS l, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS c, (o_orderstatus = 'P') IS TRUE AS t FROM {orders}")
query("fn_date", "SELECT o_orderkey, year(o_orderdate) AS y, extract(month FROM o_orderdate) AS m, date_trunc('quarter', o_orderdate) AS q FROM {orders}", "SELECT o_orderkey, year(o_orderdate)::INT AS y, extract(month FROM o_orderdate)::INT AS m, date_trunc('quarter', o_orderdate)::TIMESTAMP AS q FROM {orders}")
query("fn_array", "SELECT p_partkey, array_contains(split(p_name, ' '), 'red') AS red, size(split(p_name, ' ')) AS n, array_contains(array(1, 2, 3), p_size) AS small FROM {part}", "SELECT p_partkey, list_contains(string_split(p_name, ' '), 'red') AS red, len(string_split(p_name, ' '))::INT AS n, p_size IN (1, 2, 3) AS small FROM {part}")
