"""Operator 6: quality rules, with cross-document line frequency.

Lines are trimmed, lower-cased and hashed. Within each host (`source`) the documents that hold a line
are counted, each once, copies like any other document. A line above the limits (`min_docs` documents
and `max_share` of the host's) is boilerplate and is removed from every document of the host. A
document left with less than `min_left` of its words is depleted and rejected, besides those that
fail the base rules. `filter_documents` gives the kept documents with their texts rebuilt from the
other lines, which stay as they are.

Defined results: null texts have no words and fail; a null source is a host of its own; null ids are
carried; identical rows are judged alike and each keeps its row; an empty table gives an empty result;
texts are taken whole, however long (a row's lines stay in one task); further columns are ignored, or
passed on by `filter_documents`, whatever their names.

Texts are read once: counts and line hashes go to a narrow table in the shared checkpoint folder, and
all that follows reads that. Counts are combined on the map side, so a line or a host with a third of
all rows is many small partial sums. The lines above the limits are counted; up to `FEW` are
broadcast. Of more, only those that stand in very many documents are, and the others, none of which
has many rows, are joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm.common import cut, free_name, table

SPACE = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
FEW = 200_000  # rows of a table that is still broadcast
HEAVY = 1_000_000  # documents of a line whose rows should not meet in one task


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE, -1), "")


def _repeat_words(w: Column) -> Column:
    """Words in 3-word windows that the array `w` holds twice or more.

    Windows become 64-bit hashes, sorted together with their places; equal neighbours repeat.
    Only arrays with a repeated hash are sorted at all.
    """
    n = F.size(w)
    windows = F.slice(F.arrays_zip(w.alias("a"), F.slice(w, 2, F.greatest(n, F.lit(1))).alias("b"), F.slice(w, 3, F.greatest(n, F.lit(1))).alias("c")), 1, F.greatest(n - 2, F.lit(0)))
    hashes = F.transform(windows, lambda x: F.xxhash64(x["a"], x["b"], x["c"]))
    one = lambda x: F.array(x)  # noqa: E731  transform(array(x), f)[0] evaluates x once

    def repeated(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.get(F.transform(one(order), covered), F.lit(0))

    def covered(s: Column) -> Column:
        m = F.size(s)
        twice = F.filter(
            F.arrays_zip(s.alias("x"), F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice(s, 1, m - 1)).alias("l"), F.slice(s, 2, m).alias("r")),
            lambda t: F.coalesce(t["x"]["h"] == t["l"]["h"], F.lit(False)) | F.coalesce(t["x"]["h"] == t["r"]["h"], F.lit(False)))
        at = F.transform(twice, lambda t: t["x"]["i"])
        return F.get(F.transform(one(at), lambda p: F.size(F.array_union(F.array_union(p, F.transform(p, lambda x: x + 1)), F.transform(p, lambda x: x + 2)))), F.lit(0))

    count = F.get(F.transform(one(hashes), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(repeated(h))), F.lit(0))
    return F.coalesce(count, F.lit(0)).cast("long")


def _lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, BLANKS, "") != "")


def _line_key(line: Column) -> Column:
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(line, SPACE, " "))))


def _keys(lines: Column) -> Column:
    """(hash, words) of each line."""
    return F.transform(lines, lambda x: F.struct(_line_key(x).alias("line"), F.size(_words(x)).alias("words")))


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The input with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and `_lines` (hash, words)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("_w", _words(text)).withColumn("_l", _lines(text))
    out = out.withColumns({
        "n_words": F.size("_w").cast("long"), "word_chars": F.length(F.translate(text, BLANKS, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"), "n_repeat_words": _repeat_words(F.col("_w")), "_lines": _keys(F.col("_l"))})
    return out.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).drop("_w", "_l")


BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def frequent_lines(rows: DataFrame, min_docs: int = 10, max_share: float = 0.005) -> DataFrame:
    """host, line, n: the lines above the limits and their documents; `rows` has host and lines (hash, words)."""
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("host_n")).withColumnRenamed("host", "_host")
    lines = rows.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    counts = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs)
    return counts.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).where(F.col("n") > max_share * F.col("host_n")).select("host", "line", "n")


def _hits(rows: DataFrame, limits: DataFrame, few: int) -> DataFrame:
    """at, words, line: every line of a row that is above the limits."""
    held = rows.select("at", "host", F.explode("lines").alias("l")).select("at", "host", "l.line", "l.words")
    limits = limits.select(F.col("host").alias("_host"), F.col("line").alias("_line"), "n")
    same = (F.col("line") == F.col("_line")) & F.col("host").eqNullSafe(F.col("_host"))
    n, most = limits.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    if n <= few:
        return held.join(F.broadcast(limits), same).select("at", "words", "line")
    bar = max(HEAVY, most / max(few, 1))  # so at most `few` lines are heavy
    heavy, light = limits.where(F.col("n") > bar), limits.where(F.col("n") <= bar)
    rest = held.join(F.broadcast(heavy), same, "left_anti")
    return held.join(F.broadcast(heavy), same).select("at", "words", "line").union(rest.join(light.hint("merge"), same).select("at", "words", "line"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", min_docs: int = 10, max_share: float = 0.005, min_left: float = 0.4, few: int = FEW) -> DataFrame:
    """One row a document: id, two hashes of host and text, the base counts, base_failed, removed_words, removed_lines (hashes), kept."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.col(source_col).alias("host"))
    made = features(narrow, "t")
    rows = cut(made.select(F.monotonically_increasing_id().alias("at"), "id", "host", *_identity("t", "host"), *BASE, F.col("_lines").alias("lines")))
    limits = cut(frequent_lines(rows, min_docs, max_share))
    gone = _hits(rows, limits, few).groupBy("at").agg(F.sum("words").alias("removed_words"), F.collect_set("line").alias("removed_lines"))
    out = rows.drop("host", "lines").join(gone, "at", "left")
    out = out.withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long")).withColumn("removed_lines", F.coalesce("removed_lines", F.array().cast("array<long>")))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("n_words") - F.col("removed_words") >= min_left * F.col("n_words")))
    return out.select("id", "k1", "k2", *BASE, "removed_words", "removed_lines", "kept")


def _identity(text_col: str, source_col: str, names: tuple[str, str] = ("k1", "k2")) -> list[Column]:
    """Two 64-bit hashes of what decides on a row: its host and its text."""
    parts = [x for c in (source_col, text_col) for x in (F.col(c).isNull(), F.col(c))]
    return [F.xxhash64(*parts, F.lit(k)).alias(n) if k else F.xxhash64(*parts).alias(n) for k, n in enumerate(names)]


def filter_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", few: int = 500_000, **limits) -> DataFrame:
    """The documents that the rules keep, with all their columns; the text without its removed lines, `n_chars` to match.

    The hashes of the rejected texts, and of the texts that lose lines with those lines, are written and
    counted. Up to `few` hashes (a few megabytes) they are broadcast, and the texts stay where they
    are; more are joined by a shuffle.
    """
    judged = quality_rules(docs, id_col, text_col, source_col, **limits).where(~F.col("kept") | (F.size("removed_lines") > 0))
    a, b, kept, gone = (free_name(docs, x) for x in ("_k1", "_k2", "_kept", "_gone"))
    changes = judged.select(F.col("k1").alias(a), F.col("k2").alias(b), F.col("kept").alias(kept), F.when(F.col("kept"), F.col("removed_lines")).alias(gone))
    changes = cut(changes.groupBy(a, b).agg(F.first(kept).alias(kept), F.first(gone).alias(gone)))
    hashes = changes.agg(F.coalesce(F.sum(1 + F.coalesce(F.size(gone), F.lit(0))), F.lit(0))).first()[0]
    keyed = docs.select("*", *_identity(text_col, source_col, (a, b)))
    left = keyed.join(F.broadcast(changes) if hashes <= few else changes.hint("merge"), [a, b], "left").where(F.coalesce(kept, F.lit(True)))
    rest = F.array_join(F.filter(F.split(text_col, "\n", -1), lambda x: ~F.array_contains(gone, _line_key(x))), "\n")
    left = left.withColumn(text_col, F.when(F.col(gone).isNotNull(), rest).otherwise(F.col(text_col)))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(F.col(gone).isNotNull(), F.length(text_col).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT r, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT r, i FROM win SEMI JOIN (SELECT r, g FROM win GROUP BY r, g HAVING count(*) > 1) k USING (r, g)),
rep AS (SELECT r, count(DISTINCT i + o) AS n FROM twice, (VALUES (0), (1), (2)) v(o) GROUP BY r),
lines AS (SELECT r, source, lower(trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g'))) AS line, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS words FROM (SELECT r, source, unnest(l) AS x FROM d)),
hosts AS (SELECT source, count(*) AS n FROM d GROUP BY source),
freq AS (SELECT source, line, count(DISTINCT r) AS n FROM lines GROUP BY source, line HAVING count(DISTINCT r) >= 10),
over_limit AS (SELECT f.source, f.line FROM freq f JOIN hosts h ON f.source IS NOT DISTINCT FROM h.source WHERE f.n > 0.005 * h.n),
gone AS (SELECT r, sum(words)::BIGINT AS n FROM lines l JOIN over_limit o ON l.line = o.line AND l.source IS NOT DISTINCT FROM o.source GROUP BY r),
out AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS removed_words FROM d LEFT JOIN rep USING (r) LEFT JOIN gone USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, removed_words,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - removed_words >= 0.4 * n_words AS kept FROM out"""

QUERIES = {"op6_quality_rules": op6_quality_rules}
ORACLE_SQL = {"op6_quality_rules": SQL}
