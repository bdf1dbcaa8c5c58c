"""JSON aggregation requests, compiled to DataFrame aggregations.

A request names aggregations: {"by_lang": {"terms": {"field": "lang"}, "aggs": {...}}, "n": {...}}.
`aggregate` gives the response as one JSON row a request, with buckets nested to any depth; `buckets` gives the flat table of one
bucket aggregation, with its metrics as columns. Aggregation is partial before any shuffle; a
response's size is the number of its buckets, which `bucket_limit` guards.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

METRICS = {"value_count", "avg", "sum", "min", "max", "stats", "extended_stats", "percentiles", "cardinality", "top_hits"}
BUCKETS = {"terms", "histogram", "date_histogram", "range", "filter", "multi_terms", "composite"}
UNITS = {"ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}
BUCKET_LIMIT = 65_000


class RequestError(ValueError):
    """The request can't be understood."""


def _field(df: DataFrame, name: str, missing=None) -> Column:
    """A column, or a path into a JSON string column (root.leaf)."""
    if name in df.columns:
        c = F.col(name)
    elif "." in name and name.split(".")[0] in df.columns:
        root, path = name.split(".", 1)
        c = F.get_json_object(root, f"$.{path}")
    else:
        raise RequestError(f"unknown field {name!r}")
    return F.coalesce(c, F.lit(missing)) if missing is not None else c


def _kind(spec: dict) -> str:
    kinds = [k for k in spec if k not in ("aggs", "aggregations")]
    if len(kinds) != 1 or kinds[0] not in METRICS | BUCKETS:
        raise RequestError(f"one aggregation is expected, not {sorted(spec)}")
    return kinds[0]


def _subs(spec: dict) -> dict:
    return spec.get("aggs") or spec.get("aggregations") or {}


def metric(df: DataFrame, kind: str, body: dict, exact: bool = False) -> Column:
    """One metric as a column: a number or a struct (stats, percentiles). `top_hits` is ranked apart."""
    x = _field(df, body["field"], body.get("missing"))
    if kind == "value_count":
        return F.count(x)
    if kind == "cardinality":
        return F.count_distinct(x) if exact else F.approx_count_distinct(x, 0.02)
    v = x.cast("double")
    if kind == "percentiles":
        points = body.get("percents", [1, 5, 25, 50, 75, 95, 99])
        of = F.percentile(v, [p / 100 for p in points]) if exact else F.percentile_approx(v, [p / 100 for p in points])
        return F.map_from_arrays(F.array(*[F.lit(f"{float(p)}") for p in points]), of)
    plain = {"count": F.count(v), "sum": F.sum(v), "min": F.min(v), "max": F.max(v), "avg": F.avg(v)}
    if kind == "stats":
        return F.struct(*[c.alias(k) for k, c in plain.items()])
    if kind == "extended_stats":
        more = plain | {"sum_of_squares": F.sum(v * v), "variance": F.var_pop(v), "variance_population": F.var_pop(v), "variance_sampling": F.var_samp(v), "std_deviation": F.stddev_pop(v), "std_deviation_population": F.stddev_pop(v), "std_deviation_sampling": F.stddev_samp(v)}
        return F.struct(*[c.alias(k) for k, c in more.items()])
    return plain[kind]


def _top_hits(df: DataFrame, body: dict, keys: list[str], name: str) -> DataFrame:
    """keys and the array of each group's first rows: a ranking that keeps from + size rows a group in every task."""
    sort = [(k, d) for s in body.get("sort", []) for k, d in (s.items() if isinstance(s, dict) else [(s, "asc")])]
    falls = lambda d: (d.get("order") if isinstance(d, dict) else str(d)).lower() == "desc"
    fields = body.get("docvalue_fields", [c for c in df.columns if c not in keys])
    order = [_field(df, k).desc_nulls_last() if falls(d) else _field(df, k).asc_nulls_last() for k, d in sort]
    skip, size = body.get("from", 0), body.get("size", 3)
    hit = F.struct(*[_field(df, n).alias(n) for n in fields]).alias("_hit")
    ranked = df.select(*keys, hit, F.row_number().over(Window.partitionBy(*keys).orderBy(*order, F.to_json(hit))).alias("_rank")) if keys else None
    if ranked is None:  # one group: a bounded heap in every task, and a rank among the few rows left
        few = df.orderBy(*order, F.to_json(hit)).limit(skip + size)
        ranked = few.select(hit, F.row_number().over(Window.orderBy(*order, F.to_json(hit))).alias("_rank"))
    kept = ranked.where((F.col("_rank") <= skip + size) & (F.col("_rank") > skip))
    return kept.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_rank", "_hit"))), lambda h: h["_hit"]).alias(name))


def _beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """`left` with the columns of `right`, which has at most one row for each of its keys."""
    return left.join(right, keys, "left") if keys else left.crossJoin(F.broadcast(right))  # one row


def _measured(df: DataFrame, aggs: dict, keys: list[str], exact: bool) -> DataFrame:
    """keys, doc_count and a column for each metric among `aggs`."""
    found = {n: s for n, s in aggs.items() if _kind(s) in METRICS}
    for n in found:
        if n in keys or n in ("key", "doc_count"):
            raise RequestError(f"an aggregation can't be called {n!r} here")
    plain = [metric(df, _kind(s), s[_kind(s)], exact).alias(n) for n, s in found.items() if _kind(s) != "top_hits"]
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("doc_count"), *plain)
    for n, s in found.items():
        if _kind(s) == "top_hits":
            hits = _top_hits(df, s["top_hits"], keys, n)
            out = _beside(out, hits, keys).withColumn(n, F.coalesce(n, F.array().cast(hits.schema[n].dataType)))
    return out


def interval_ms(text: str) -> int:
    """Milliseconds of a fixed interval such as 30d."""
    m = re.fullmatch(r"(\d+)(ms|s|m|h|d)", text or "")
    if not m:
        raise RequestError(f"not a fixed interval: {text!r}")
    return int(m[1]) * UNITS[m[2]]


def key_columns(df: DataFrame, kind: str, body: dict) -> list[Column]:
    """The columns that tell a row's bucket."""
    if kind == "terms":
        return [_field(df, body["field"], body.get("missing")).alias("key")]
    if kind == "histogram":
        step, offset = float(body["interval"]), float(body.get("offset", 0))
        return [(F.floor((_field(df, body["field"]).cast("double") - offset) / step) * step + offset).alias("key")]
    if kind == "date_histogram":
        step = interval_ms(body.get("fixed_interval"))
        return [(F.floor(F.unix_millis(_field(df, body["field"]).cast("timestamp")) / step) * step).cast("long").alias("key")]
    if kind == "range":
        x = _field(df, body["field"]).cast("double")
        return [_range_case(x, body["ranges"]).alias("key")]
    if kind == "multi_terms":
        return [_field(df, t["field"], t.get("missing")).alias(f"key_{i}") for i, t in enumerate(body["terms"])]
    if kind == "composite":
        return [_field(df, next(iter(s.values()))["terms"]["field"]).alias(next(iter(s))) for s in body["sources"]]
    raise RequestError(f"{kind} has no keys")


def range_bounds(ranges: list[dict]) -> list[tuple[float | None, float | None]]:
    """Contiguous buckets: those asked for, and the gaps between and around them."""
    edges = sorted({x for r in ranges for x in (r.get("from"), r.get("to")) if x is not None})
    return list(zip([None, *edges], [*edges, None], strict=True))


def range_key(low: float | None, high: float | None) -> str:
    say = lambda x: "*" if x is None else f"{x:g}"
    return f"{say(low)}-{say(high)}"


def _range_case(x: Column, ranges: list[dict]) -> Column:
    out = None
    for low, high in range_bounds(ranges):
        test = (F.lit(True) if low is None else x >= low) & (F.lit(True) if high is None else x < high) & x.isNotNull()
        out = F.when(test, range_key(low, high)) if out is None else out.when(test, range_key(low, high))
    return out


def _keyed(df: DataFrame, kind: str, body: dict, names: list[str]) -> DataFrame:
    """The rows that fall into a bucket, with the bucket's keys as columns `names`."""
    if kind == "filter":
        return df.where(F.expr(body["sql"]) if "sql" in body else _field(df, body["field"]) == F.lit(body["value"]))
    return df.withColumns(dict(zip(names, key_columns(df, kind, body), strict=True))).dropna(subset=names)


def _every_bucket(out: DataFrame, groups: DataFrame, outer: list[str], names: list[str], kind: str, body: dict, limit: int) -> DataFrame:
    """`out` with the empty buckets that the request asks for, in each of the outer `groups`."""
    if kind == "range":
        grid = groups.select(*outer, F.explode(F.array(*[F.lit(range_key(a, b)) for a, b in range_bounds(body["ranges"])])).alias(names[0]))
    elif kind in ("histogram", "date_histogram") and body.get("min_doc_count", 0) == 0:
        step = float(body["interval"]) if kind == "histogram" else interval_ms(body["fixed_interval"])
        ends = out.groupBy(*outer).agg(F.min(names[0]).alias("_lo"), F.max(names[0]).alias("_hi")).where("_lo is not null")
        n = F.round((F.col("_hi") - F.col("_lo")) / step)
        n = F.when(n < limit, n.cast("int")).otherwise(F.raise_error(F.concat(F.lit("too many buckets: "), n.cast("string"))).cast("int"))
        grid = ends.select(*outer, F.explode(F.transform(F.sequence(F.lit(0), n), lambda i: (F.col("_lo") + i * F.lit(step)).cast("double" if kind == "histogram" else "long"))).alias(names[0]))
    else:
        return out
    return grid.join(out, [*outer, *names], "left").withColumn("doc_count", F.coalesce("doc_count", F.lit(0)))


def _order(kind: str, body: dict, names: list[str]) -> list[Column]:
    if kind not in ("terms", "multi_terms"):
        return [F.col(n) for n in names]
    by, way = next(iter(body.get("order", {"_count": "desc"}).items()))
    target = F.col({"_count": "doc_count", "_key": names[0]}.get(by, by))
    return [target.desc() if str(way).lower() == "desc" else target.asc(), *[F.col(n) for n in names]]


def _first(out: DataFrame, kind: str, body: dict, outer: list[str], names: list[str]) -> DataFrame:
    """The buckets that the request's size, and the place to go on after, leave in each outer group."""
    if kind == "composite" and body.get("after"):
        out = out.where(F.struct(*names) > F.struct(*[F.lit(body["after"][next(iter(s))]) for s in body["sources"]]))
    if kind not in ("terms", "multi_terms", "composite"):
        return out
    order, size = _order(kind, body, names), body.get("size", 10)
    if not outer:
        return out.orderBy(*order).limit(size)
    return out.withColumn("_n", F.row_number().over(Window.partitionBy(*outer).orderBy(*order))).where(F.col("_n") <= size).drop("_n")


def buckets(df: DataFrame, spec: dict, exact: bool = False, within: list[str] | None = None, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """The flat buckets of one bucket aggregation: keys, doc_count and the metrics below it.

    `within`: columns of outer buckets, kept as leading keys.
    """
    kind = _kind(spec)
    body, outer = spec[kind], within or []
    names = _names(kind, body)
    out = _measured(_keyed(df, kind, body, names), _subs(spec), [*outer, *names], exact)
    out = _every_bucket(out, df.select(*outer).distinct() if outer else df.sparkSession.range(1), outer, names, kind, body, bucket_limit)
    return _first(out, kind, body, outer, names)


def _names(kind: str, body: dict) -> list[str]:
    if kind == "filter":
        return []
    if kind == "multi_terms":
        return [f"key_{i}" for i in range(len(body["terms"]))]
    return [next(iter(s)) for s in body["sources"]] if kind == "composite" else ["key"]


def aggregate(df: DataFrame, request: dict | str, exact: bool = False, bucket_limit: int = BUCKET_LIMIT) -> DataFrame:
    """One row, one column `response`: the JSON answer, buckets nested to any depth.

    Percentiles and cardinality are sketches unless `exact`. Every bucket aggregation, at any depth, may
    make `bucket_limit` buckets before its size cuts them.
    """
    spec = json.loads(request) if isinstance(request, str) else request
    if "buckets" in spec or not spec:
        raise RequestError("a request names its aggregations")
    out = _answers(df, spec, [], exact, bucket_limit, 0)
    return out.select(F.to_json(F.struct(*_shapes(spec))).alias("response"))


def _shaped(kind: str, value: Column) -> Column:
    if kind in ("stats", "extended_stats"):
        return value
    if kind == "percentiles":
        return F.struct(value.alias("values"))
    return F.struct(value.alias("hits" if kind == "top_hits" else "value"))


def _answers(df: DataFrame, aggs: dict, outer: list[str], exact: bool, limit: int, depth: int) -> DataFrame:
    """outer keys, doc_count, and for each aggregation a column with its answer in the bucket of these keys."""
    out = _measured(df, aggs, outer, exact)
    for name, s in aggs.items():
        kind = _kind(s)
        if kind in METRICS:
            continue
        answer = _bucket_answer(df, out.select(*outer) if outer else df.sparkSession.range(1), name, s, outer, exact, limit, depth)
        out = _beside(out, answer, outer)
        # outer buckets without any of these: no buckets, or none of the filter's rows
        made = answer.schema[name].dataType
        empty = F.from_json(F.lit('{"doc_count": 0}' if kind == "filter" else '{"buckets": []}'), made.json())
        out = out.withColumn(name, F.coalesce(name, empty))
    return out


def _shapes(aggs: dict) -> list[Column]:
    return [(_shaped(_kind(s), F.col(n)) if _kind(s) in METRICS else F.col(n)).alias(n) for n, s in aggs.items()]


def _bucket_answer(df: DataFrame, groups: DataFrame, name: str, spec: dict, outer: list[str], exact: bool, limit: int, depth: int) -> DataFrame:
    """outer keys and the column `name`: the answer of a bucket aggregation in each of the outer groups that have one."""
    kind = _kind(spec)
    body, subs = spec[kind], _subs(spec)
    names = [f"_k{depth}_{i}" for i in range(len(_names(kind, body)))]
    inner = _answers(_keyed(df, kind, body, names), subs, [*outer, *names], exact, limit, depth + 1)
    if kind == "filter":
        return inner.select(*outer, F.struct("doc_count", *_shapes(subs)).alias(name))
    n, total = inner.agg(F.count(F.lit(1)), F.coalesce(F.sum("doc_count"), F.lit(0))).first()
    if n > limit:
        raise RequestError(f"{n} buckets; at most {limit} are allowed")
    if kind == "terms" and outer:
        inner = inner.withColumn("_all", F.sum("doc_count").over(Window.partitionBy(*outer)))
    inner = _first(_every_bucket(inner, groups, outer, names, kind, body, limit), kind, body, outer, names)
    inner = inner.withColumn("_place", F.row_number().over(Window.partitionBy(*outer).orderBy(*_order(kind, body, names))))  # at most `limit` rows
    bucket = F.struct(*_key_fields(kind, body, names), "doc_count", *_shapes(subs))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_place", bucket.alias("_b")))), lambda b: b["_b"]).alias("buckets")
    more = []
    if kind == "terms":
        every = F.first("_all") if outer else F.lit(total)
        more = [(F.coalesce(every, F.lit(0)) - F.coalesce(F.sum("doc_count"), F.lit(0))).alias("sum_other_doc_count"), F.lit(0).alias("doc_count_error_upper_bound")]
    if kind == "composite":
        last = F.max_by(F.struct(*[F.col(k).alias(n) for k, n in zip(names, _names(kind, body), strict=True)]), "_place")
        more = [last.alias("after_key")]
    return inner.groupBy(*outer).agg(F.struct(listed, *more).alias(name))


def _key_fields(kind: str, body: dict, names: list[str]) -> list[Column]:
    """A bucket's key as the response gives it."""
    if kind == "multi_terms":
        parts = [F.col(n).cast("string") for n in names]
        return [F.array(*parts).alias("key"), F.concat_ws("|", *parts).alias("key_as_string")]
    if kind == "composite":
        return [F.struct(*[F.col(k).alias(n) for k, n in zip(names, _names(kind, body), strict=True)]).alias("key")]
    key = F.col(names[0])
    if kind == "date_histogram":
        return [key.alias("key"), F.date_format(F.timestamp_millis(key), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("key_as_string")]
    if kind == "range":
        ends = {range_key(a, b): (a, b) for a, b in range_bounds(body["ranges"])}
        at = lambda i: F.create_map(*[F.lit(x) for k, v in ends.items() for x in (k, None if v[i] is None else float(v[i]))])[key].cast("double")
        return [key.alias("key"), at(0).alias("from"), at(1).alias("to")]
    return [key.alias("key")]


def facet(matches: DataFrame, top: DataFrame, spec: dict, name: str = "facet") -> DataFrame:
    """The rows of `top` with the aggregation over all matches beside each."""
    return top.crossJoin(F.broadcast(aggregate(matches, spec).withColumnRenamed("response", name)))  # one row
