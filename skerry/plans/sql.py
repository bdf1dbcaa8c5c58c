"""SQL functions: the search predicates for use in SQL text. They are SQL bodies, inlined by Catalyst."""

from __future__ import annotations

from pyspark.sql import SparkSession

from skerry.functions.analysis import UNICODE_WORD

#: The default analyzer's words, as they stand in a SQL string.
PATTERN = UNICODE_WORD.replace("\\", "\\\\").replace("'", "\\'")


def _places(term: str) -> str:
    """SQL for the places of a term among the words of t."""
    words = f"regexp_extract_all(lower(t), '{PATTERN}', 0)"
    return f"filter(transform({words}, (x, i) -> if(x = {term}, i, -1)), i -> i >= 0)"


#: name(arguments) -> (result, body)
FUNCTIONS = {
    "search_terms(t STRING)": ("ARRAY<STRING>", f"regexp_extract_all(lower(t), '{PATTERN}', 0)"),
    "match_any(t STRING, q STRING)": ("BOOLEAN", f"arrays_overlap(regexp_extract_all(lower(t), '{PATTERN}', 0), regexp_extract_all(lower(q), '{PATTERN}', 0))"),
    "match_all(t STRING, q STRING)": ("BOOLEAN", f"t IS NULL AND NULL OR size(regexp_extract_all(lower(q), '{PATTERN}', 0)) > 0 AND size(array_except(regexp_extract_all(lower(q), '{PATTERN}', 0), regexp_extract_all(lower(t), '{PATTERN}', 0))) = 0"),
    "match_phrase(t STRING, q STRING)": ("BOOLEAN", f"contains(concat(' ', array_join(regexp_extract_all(lower(t), '{PATTERN}', 0), ' '), ' '), concat(' ', array_join(regexp_extract_all(lower(q), '{PATTERN}', 0), ' '), ' '))"),
    "match_term(t STRING, q STRING)": ("BOOLEAN", f"array_contains(regexp_extract_all(lower(t), '{PATTERN}', 0), q)"),
    "match_regex(t STRING, q STRING)": ("BOOLEAN", f"exists(regexp_extract_all(lower(t), '{PATTERN}', 0), x -> x RLIKE concat('^(?:', q, ')$'))"),
    "match_fuzzy(t STRING, q STRING, d INT)": ("BOOLEAN", f"exists(regexp_extract_all(lower(t), '{PATTERN}', 0), x -> levenshtein(x, q) <= d)"),
    "match_near(t STRING, a STRING, d INT, b STRING)": ("BOOLEAN", f"exists({_places('a')}, i -> exists({_places('b')}, j -> abs(j - i) <= d + 1))"),
    "match_near_ordered(t STRING, a STRING, d INT, b STRING)": ("BOOLEAN", f"exists({_places('a')}, i -> exists({_places('b')}, j -> j >= i AND j - i <= d + 1))"),
    "match_phrase_prefix(t STRING, q STRING)": ("BOOLEAN", f"contains(concat(' ', array_join(regexp_extract_all(lower(t), '{PATTERN}', 0), ' ')), concat(' ', array_join(regexp_extract_all(lower(q), '{PATTERN}', 0), ' ')))"),
    "vector_cosine(a ARRAY<FLOAT>, b ARRAY<FLOAT>)": ("DOUBLE", "1 - aggregate(zip_with(a, b, (x, y) -> double(x) * double(y)), 0D, (s, x) -> s + x) / sqrt(aggregate(a, 0D, (s, x) -> s + double(x) * double(x)) * aggregate(b, 0D, (s, x) -> s + double(x) * double(x)))"),
    "vector_l2(a ARRAY<FLOAT>, b ARRAY<FLOAT>)": ("DOUBLE", "sqrt(aggregate(zip_with(a, b, (x, y) -> (double(x) - double(y)) * (double(x) - double(y))), 0D, (s, x) -> s + x))"),
    "vector_ip(a ARRAY<FLOAT>, b ARRAY<FLOAT>)": ("DOUBLE", "aggregate(zip_with(a, b, (x, y) -> double(x) * double(y)), 0D, (s, x) -> s + x)"),
}

TABLES = {"tokenize(t STRING)": ("TABLE(term STRING, pos INT)", f"SELECT col, pos FROM posexplode(regexp_extract_all(lower(t), '{PATTERN}', 0))")}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session; gives their names."""
    for head, (result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {result} RETURN {body}")
    for head, (result, body) in TABLES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {result} RETURN {body}")
    return [head.split("(")[0] for head in [*FUNCTIONS, *TABLES]]
