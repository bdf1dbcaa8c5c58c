"""Full-text queries over `documents`, `part`, `pages` and `conversations`, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.functions.analysis import Analyzer
from skerry.plans import ast as q
from skerry.plans.index import FieldSpec, SearchIndex, search_postings
from skerry.sources.scratch import fresh_folder

#: DuckDB's patterns, written apart from the engine's: words by Unicode's default rules, and runs of letters and digits.
WORD = r"_*(?:(?:[\p{L}\p{M}]+(?:[''’.:·][\p{L}\p{M}]+)*|\p{N}+(?:[.,;''’]\p{N}+)*)_*)+"
RUN = r"[\p{L}\p{N}]+"
QUERIES, ORACLE_SQL = {}, {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_built: dict[tuple[str, str], SearchIndex] = {}


def documents(spark: SparkSession, sf_dir: str, stored: bool = True, **spec) -> SearchIndex:
    """The index of `documents`: written once a session into the shared folder, then opened; or scanned where not `stored`."""
    index = SearchIndex(read(spark, sf_dir, "documents"), "doc_id", {"text": FieldSpec("text", **spec), "source": FieldSpec("source")})
    if not stored or "analyzer" in spec:
        return index
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _built:
        plain = SearchIndex(index.df, "doc_id", {"text": FieldSpec("text"), "source": FieldSpec("source")})
        _built[key] = plain.build(fresh_folder(spark, "index"))
    # parameters of scoring are no part of what is written
    return index.opened(_built[key].folder) if spec else _built[key]


# -- oracle pieces ---------------------------------------------------------------------------------

BASE = f"""WITH d AS (SELECT *, regexp_extract_all(lower(text), '{WORD}') AS t FROM documents), s AS (SELECT count(t) AS n, avg(len(t)) AS al FROM d)"""


def has(term: str) -> str:
    return f"list_contains(t, '{term}')"


def tf(term: str) -> str:
    return f"len(list_filter(t, lambda x: x = '{term}'))"


def df(term: str) -> str:
    return f"(SELECT count(*) FROM d WHERE {has(term)})"


def idf(term: str) -> str:
    return f"ln(1 + (s.n - {df(term)} + 0.5) / ({df(term)} + 0.5))"


def bm(times: str, weight: str, k1: float = 1.2, b: float = 0.75) -> str:
    return f"(CASE WHEN {times} > 0 THEN {weight} * {k1 + 1} * {times} / ({times} + {k1} * ({1 - b} + {b} * len(t) / s.al)) ELSE 0.0 END)"


def one(term: str, **p) -> str:
    return bm(tf(term), idf(term), **p)


def phrase(*terms: str) -> str:
    """How often the terms stand one after the other."""
    tests = " AND ".join(f"t[i + {k}] = '{x}'" for k, x in enumerate(terms))
    return f"len(list_filter(range(1, len(t) + 1), lambda i: coalesce({tests}, false)))"


def positions(term: str) -> str:
    return f"list_filter(range(1, len(t) + 1), lambda i: t[i] = '{term}')"


def oracle(where: str, score: str = "1.0", tail: str = "", base: str = BASE) -> str:
    return f"{base} SELECT doc_id, round({score}, 4)::DOUBLE AS score FROM d, s WHERE {where} {tail}"


def query(name: str, node, sql: str, **spec):
    """A query over documents that gives doc_id and the rounded score of every match."""

    def run(spark, sf_dir):
        made = node(spark, sf_dir) if callable(node) else node
        return documents(spark, sf_dir, **spec).search(made).select("doc_id", F.round("score", 4).alias("score"))

    QUERIES[name] = run
    ORACLE_SQL[name] = sql


def entry(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


# -- tokens and terms --------------------------------------------------------------------------------

ANY = f"({one('license')} + {one('public')})"
query("text_match_all", q.Match("text", "general Public license general", every=True), oracle(f"{has('general')} AND {has('public')} AND {has('license')}", f"{one('general')} + {one('public')} + {one('license')}"))
query("text_match_repeated", q.Match("text", "license license"), oracle(has("license"), f"2 * {one('license')}"))
query("text_match_tokens", q.Match("text", ("license", "rights")), oracle(f"{has('license')} OR {has('rights')}", f"{one('license')} + {one('rights')}"))
query("text_term", q.Term("text", "reserved"), oracle(has("reserved"), one("reserved")))
query("text_term_not_analysed", q.Term("text", "Reserved"), oracle("false"))
query("text_term_set", q.TermSet("text", ("licensed", "reserved", "gnu")), oracle(f"{has('licensed')} OR {has('reserved')} OR {has('gnu')}"))
query("text_exists", q.Exists("text"), oracle("text IS NOT NULL"))
query("text_all", q.All(), oracle("true"))
query("text_empty", q.Empty(), oracle("false"))
query("bm25_params", q.Match("text", "license public"), oracle(f"{has('license')} OR {has('public')}", f"{one('license', k1=0.9, b=0.4)} + {one('public', k1=0.9, b=0.4)}"), k1=0.9, b=0.4)
query("bm25_no_norms", q.Term("text", "license"), oracle(has("license"), f"(CASE WHEN {tf('license')} > 0 THEN {idf('license')} * 2.2 * {tf('license')} / ({tf('license')} + 1.2) ELSE 0.0 END)"), fieldnorms=False)

# -- positions ---------------------------------------------------------------------------------------

PHRASE = phrase("all", "rights", "reserved")
query("text_phrase", q.Phrase("text", "All rights RESERVED"), oracle(f"{PHRASE} > 0", bm(PHRASE, f"({idf('all')} + {idf('rights')} + {idf('reserved')})")))
query("text_phrase_single", q.Phrase("text", "reserved"), oracle(has("reserved"), one("reserved")))
SLOP = f"len(list_filter({positions('licensed')}, lambda a: len(list_filter({positions('gnu')}, lambda b: abs(b - 1 - a) <= 2)) > 0))"
query("text_phrase_slop", q.Phrase("text", "licensed gnu", slop=2), oracle(f"{SLOP} > 0", bm(SLOP, f"({idf('licensed')} + {idf('gnu')})")))
query("text_phrase_prefix", q.PhrasePrefix("text", "all rights res"), oracle("len(list_filter(range(1, len(t) + 1), lambda i: coalesce(t[i] = 'all' AND t[i + 1] = 'rights' AND t[i + 2] LIKE 'res%', false))) > 0"))
query("text_regex", q.Regex("text", "licen[cs]ed?"), oracle("len(list_filter(t, lambda x: regexp_full_match(x, 'licen[cs]ed?'))) > 0"))
query("text_regex_phrase", q.RegexPhrase("text", ("all", "right.*")), oracle("len(list_filter(range(1, len(t) + 1), lambda i: coalesce(t[i] = 'all' AND regexp_full_match(t[i + 1], 'right.*'), false))) > 0"))


def near(left: str, right: str, test: str) -> str:
    return f"len(list_filter({positions(left)}, lambda a: len(list_filter({positions(right)}, lambda b: {test})) > 0))"


N1, N2 = near("license", "gnu", "abs(b - a) <= 4"), near("gnu", "license", "b >= a AND b - a <= 4")
query("prox_unordered", q.Near("text", "license", 3, "gnu"), oracle(f"{N1} > 0", bm(N1, f"({idf('license')} + {idf('gnu')})")))
query("prox_ordered", q.Near("text", "gnu", 3, "license", ordered=True), oracle(f"{N2} > 0", bm(N2, f"({idf('gnu')} + {idf('license')})")))
query("prox_ordered_reverse", q.Near("text", "license", 3, "gnu", ordered=True), oracle(f"{near('license', 'gnu', 'b >= a AND b - a <= 4')} > 0", bm(near("license", "gnu", "b >= a AND b - a <= 4"), f"({idf('license')} + {idf('gnu')})")))
N3 = "len(list_filter(list_filter(range(1, len(t) + 1), lambda i: t[i] IN ('gnu', 'public')), lambda a: len(list_filter(" + positions("license") + ", lambda b: abs(b - a) <= 2)) > 0))"
query("prox_array", q.Near("text", ("gnu", "public"), 1, "license"), oracle(f"{N3} > 0", bm(N3, f"({idf('gnu')} + {idf('public')} + {idf('license')})")))
N4 = "len(list_filter(list_filter(range(1, len(t) + 1), lambda i: regexp_full_match(t[i], 'lic.*')), lambda a: len(list_filter(" + positions("gnu") + ", lambda b: abs(b - a) <= 3)) > 0))"
query("prox_regex", q.Near("text", "/lic.*/", 2, "gnu"), oracle(f"{N4} > 0", bm(N4, idf("gnu"))))
INNER = f"list_concat(list_filter({positions('general')}, lambda a: len(list_filter({positions('public')}, lambda b: abs(b - a) <= 1)) > 0), list_filter({positions('public')}, lambda b: len(list_filter({positions('general')}, lambda a: abs(b - a) <= 1)) > 0))"
N5 = f"len(list_filter(list_distinct({INNER}), lambda c: len(list_filter({positions('version')}, lambda v: abs(v - c) <= 3)) > 0))"
query("prox_chain", q.Near("text", q.Near("text", "general", 0, "public"), 2, "version"), oracle(f"{N5} > 0", bm(N5, f"({idf('general')} + {idf('public')} + {idf('version')})")))

# -- edits -------------------------------------------------------------------------------------------

query("text_fuzzy_term", q.Fuzzy("text", "licence", 1, transpose=False), oracle("len(list_filter(t, lambda x: levenshtein(x, 'licence') <= 1)) > 0"))
query("text_fuzzy_two", q.Fuzzy("text", "reserve", 2, transpose=False), oracle("len(list_filter(t, lambda x: levenshtein(x, 'reserve') <= 2)) > 0"))
query("text_fuzzy_transpose", q.Fuzzy("text", "lciense", 1), oracle("len(list_filter(t, lambda x: damerau_levenshtein(x, 'lciense') <= 1)) > 0"))
query("text_fuzzy_prefix", q.Fuzzy("text", "licem", 1, prefix=True, transpose=False), oracle("len(list_filter(t, lambda x: levenshtein(x[1:4], 'licem') <= 1 OR levenshtein(x[1:5], 'licem') <= 1 OR levenshtein(x[1:6], 'licem') <= 1)) > 0"))
query("text_fuzzy_match", q.Match("text", "licence rigths", distance=1, transpose=True), oracle("len(list_filter(t, lambda x: damerau_levenshtein(x, 'licence') <= 1)) > 0 OR len(list_filter(t, lambda x: damerau_levenshtein(x, 'rigths') <= 1)) > 0",
      "(len(list_filter(t, lambda x: damerau_levenshtein(x, 'licence') <= 1)) > 0)::INT + (len(list_filter(t, lambda x: damerau_levenshtein(x, 'rigths') <= 1)) > 0)::INT"))

# -- compounds ---------------------------------------------------------------------------------------

LIC, RES, GNU = q.Term("text", "license"), q.Term("text", "reserved"), q.Term("text", "gnu")
query("bool_must", q.Boolean(must=(LIC, GNU)), oracle(f"{has('license')} AND {has('gnu')}", f"{one('license')} + {one('gnu')}"))
query("bool_should", q.Boolean(should=(LIC, RES)), oracle(f"{has('license')} OR {has('reserved')}", f"{one('license')} + {one('reserved')}"))
query("bool_must_should", q.Boolean(must=(LIC,), should=(GNU,)), oracle(has("license"), f"{one('license')} + {one('gnu')}"))
query("bool_must_not", q.Boolean(must=(LIC,), must_not=(GNU,)), oracle(f"{has('license')} AND NOT {has('gnu')}", one("license")))
query("bool_only_not", q.Boolean(must_not=(LIC,)), oracle("false"))
query("bool_not_all", q.Boolean(must=(q.All(),), must_not=(LIC,)), oracle(f"NOT {has('license')}"))
query("bool_min_should", q.Boolean(should=(LIC, GNU, RES, q.Term("text", "public")), minimum_should_match=2), oracle(f"{has('license')}::INT + {has('gnu')}::INT + {has('reserved')}::INT + {has('public')}::INT >= 2", f"{one('license')} + {one('gnu')} + {one('reserved')} + {one('public')}"))
query("bool_min_zero", q.Boolean(should=(LIC,), minimum_should_match=0), oracle("true", one("license")))
query("dismax", q.DisMax((LIC, q.Term("text", "public")), 0.3), oracle(f"{has('license')} OR {has('public')}", f"greatest({one('license')}, {one('public')}) + 0.3 * (({one('license')} + {one('public')}) - greatest({one('license')}, {one('public')}))"))
query("boost", q.Boost(LIC, 2.5), oracle(has("license"), f"2.5 * {one('license')}"))
query("const_score", q.Const(LIC, 3.0), oracle(has("license"), "3.0"))
query("score_filter", q.ScoreFilter(LIC, ((None, 1.0), (4.0, None))), oracle(f"{has('license')} AND ({one('license')} < 1.0 OR {one('license')} > 4.0)", one("license")))
query("bm25_with_filter", q.Boolean(must=(LIC, q.Where("n_chars > 2000"))), oracle(f"{has('license')} AND n_chars > 2000", f"{one('license')} + 1.0"))
query("range_filter", q.Boolean(must=(LIC, q.Range("n_chars", 1000, 3000))), oracle(f"{has('license')} AND n_chars >= 1000 AND n_chars < 3000", f"{one('license')} + 1.0"))
query("range_exclusive", q.Range("n_chars", 1000, 3000, low_inclusive=False, high_inclusive=True), oracle("n_chars > 1000 AND n_chars <= 3000"))
query("range_open", q.Range("n_chars", None, 500), oracle("n_chars < 500"))
query("bm25_multi_field", q.Boolean(should=(LIC, q.Term("source", "src3"))), oracle(f"{has('license')} OR source = 'src3'", f"{one('license')} + (CASE WHEN source = 'src3' THEN ln(1 + (s.n - (SELECT count(*) FROM d WHERE source = 'src3') + 0.5) / ((SELECT count(*) FROM d WHERE source = 'src3') + 0.5)) * 2.2 / 2.2 ELSE 0.0 END)"))
query("json_query", q.Query.from_json(q.Boolean(must=(LIC,), must_not=(GNU,)).to_json()), oracle(f"{has('license')} AND NOT {has('gnu')}", one("license")))

# -- query strings -----------------------------------------------------------------------------------

query("parse_basic", q.Parse("license reserved", "text"), oracle(f"{has('license')} OR {has('reserved')}", f"{one('license')} + {one('reserved')}"))
query("parse_conjunction", q.Parse("license gnu", "text", conjunction=True), oracle(f"{has('license')} AND {has('gnu')}", f"{one('license')} + {one('gnu')}"))
query("parse_fields", q.Parse("text:(license gnu) AND n_chars:>2000"), oracle(f"({has('license')} OR {has('gnu')}) AND n_chars > 2000", f"{one('license')} + {one('gnu')} + 1.0"))
query("parse_phrase", q.Parse('text:"all rights"~1 -text:license'), oracle(f"NOT {has('license')} AND len(list_filter({positions('all')}, lambda a: len(list_filter({positions('rights')}, lambda b: abs(b - 1 - a) <= 1)) > 0)) > 0",
      bm(f"len(list_filter({positions('all')}, lambda a: len(list_filter({positions('rights')}, lambda b: abs(b - 1 - a) <= 1)) > 0))", f"({idf('all')} + {idf('rights')})")))
query("parse_boost", q.Parse("license^2 gnu", "text"), oracle(f"{has('license')} OR {has('gnu')}", f"2 * {one('license')} + {one('gnu')}"))
query("parse_precedence", q.Parse("license AND gnu OR reserved", "text"), oracle(f"({has('license')} AND {has('gnu')}) OR {has('reserved')}", f"(CASE WHEN {has('license')} AND {has('gnu')} THEN {one('license')} + {one('gnu')} ELSE 0 END) + {one('reserved')}"))
query("parse_or_conjunction", q.Parse("license OR reserved", "text", conjunction=True), oracle(f"{has('license')} OR {has('reserved')}", f"{one('license')} + {one('reserved')}"))
query("parse_lenient", q.Parse("missing:x text:license", lenient=True), oracle(has("license"), one("license")))


# -- top-k, counts, paging, more like this -------------------------------------------------------------


@entry("text_match_any", oracle(f"{has('license')} OR {has('public')}", ANY, f"ORDER BY {ANY} DESC, doc_id LIMIT 20"))
def text_match_any(spark, sf_dir):
    return documents(spark, sf_dir).top(q.Match("text", "license public"), 20).select("doc_id", F.round("score", 4).alias("score"))


@entry("topk_offset", oracle(f"{has('license')} OR {has('public')}", ANY, f"ORDER BY {ANY} DESC, doc_id LIMIT 10 OFFSET 5"))
def topk_offset(spark, sf_dir):
    return documents(spark, sf_dir).top(q.Match("text", "license public"), 10, offset=5).select("doc_id", F.round("score", 4).alias("score"))


@entry("topk_by_fields", oracle(has("license"), one("license"), "ORDER BY lang DESC, n_chars, doc_id LIMIT 15"))
def topk_by_fields(spark, sf_dir):
    return documents(spark, sf_dir).top(q.Term("text", "license"), 15, "lang desc", "n_chars").select("doc_id", F.round("score", 4).alias("score"))


@entry("order_lower", oracle(has("license"), one("license"), "ORDER BY lower(source), doc_id LIMIT 12"))
def order_lower(spark, sf_dir):
    return documents(spark, sf_dir).top(q.Term("text", "license"), 12, "lower(source)").select("doc_id", F.round("score", 4).alias("score"))


@entry("paging_keyset", oracle(f"{has('the')} AND doc_id > 100", "1.0", "ORDER BY doc_id LIMIT 25"))
def paging_keyset(spark, sf_dir):
    found = documents(spark, sf_dir).search(q.TermSet("text", ("the",))).where("doc_id > 100")
    return found.orderBy("doc_id").limit(25).select("doc_id", "score")


@entry("count_matches", f"{BASE} SELECT count(*) AS n FROM d WHERE {has('license')}")
def count_matches(spark, sf_dir):
    return documents(spark, sf_dir).count(q.Term("text", "license"))


@entry("partial_index", f"WITH d AS (SELECT *, regexp_extract_all(lower(text), '{WORD}') AS t FROM documents WHERE lang = 'en'), s AS (SELECT count(t) AS n, avg(len(t)) AS al FROM d) SELECT doc_id, round({one('license')}, 4)::DOUBLE AS score FROM d, s WHERE {has('license')}")
def partial_index(spark, sf_dir):
    index = SearchIndex(read(spark, sf_dir, "documents"), "doc_id", {"text": FieldSpec("text")}, where="lang = 'en'")
    return index.search(q.Term("text", "license")).select("doc_id", F.round("score", 4).alias("score"))


@entry("postings_match", oracle(f"{has('license')} OR {has('public')}", ANY))
def postings_match(spark, sf_dir):
    index = documents(spark, sf_dir)
    found = search_postings(index.stored("postings", "text"), ["license", "public"], index.n_docs("text"), index.mean_length("text"))
    return found.select(F.col("key").alias("doc_id"), F.round("score", 4).alias("score"))


@entry("postings_table", f"WITH w AS (SELECT doc_id AS key, regexp_extract_all(lower(text), '{WORD}') AS t FROM documents) SELECT key, len(t)::INT AS length, term, count(*) AS tf FROM (SELECT key, t, unnest(t) AS term FROM w) GROUP BY key, t, term")
def postings_table(spark, sf_dir):
    return documents(spark, sf_dir).stored("postings", "text").select("key", "length", "term", "tf")


MLT = f"""{BASE}, src AS (SELECT term, count(*) AS tf FROM (SELECT unnest(t) AS term FROM d WHERE doc_id = 29) GROUP BY term),
dict AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(t) AS term FROM d) GROUP BY term),
top AS (SELECT term, df FROM src JOIN dict USING (term), s ORDER BY round(tf * ln(1 + (s.n - df + 0.5) / (df + 0.5)), 6) DESC, term LIMIT 10),
p AS (SELECT doc_id, term, count(*) AS tf, any_value(len(t)) AS dl FROM (SELECT doc_id, t, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM top) GROUP BY doc_id, term)
SELECT doc_id, round(sum(ln(1 + (s.n - df + 0.5) / (df + 0.5)) * 2.2 * tf / (tf + 1.2 * (0.25 + 0.75 * dl / s.al))), 4)::DOUBLE AS score FROM p JOIN top USING (term), s GROUP BY doc_id"""


@entry("mlt_key", MLT)
def mlt_key(spark, sf_dir):
    return documents(spark, sf_dir).search(q.MoreLikeThis("text", key=29, max_query_terms=10)).select("doc_id", F.round("score", 4).alias("score"))


@entry("mlt_text", oracle(f"{has('license')} OR {has('gnu')} OR {has('work')}", f"{one('license')} + {one('gnu')} + {one('work')}"))
def mlt_text(spark, sf_dir):
    return documents(spark, sf_dir).search(q.MoreLikeThis("text", text="This GNU license, a work", stopwords=("this", "a"))).select("doc_id", F.round("score", 4).alias("score"))


query("terms_of_fields", q.Terms((("text", "gnu"), ("source", "src3"))), oracle(f"{has('gnu')} OR source = 'src3'"))
query("match_other_tokenizer", q.Match("text", "license,reserved gnu", tokenizer="whitespace"), oracle(has("gnu"), one("gnu")))
query("prox_regex_limited", q.Near("text", "/lic.*/", 2, "gnu", max_expansions=50), oracle(f"{N4} > 0", bm(N4, idf("gnu"))))


@entry("mlt_fields", oracle(f"{has('license')} OR {has('gnu')} OR source = 'src3'", f"{one('license')} + {one('gnu')} + (CASE WHEN source = 'src3' THEN ln(1 + (s.n - (SELECT count(*) FROM d WHERE source = 'src3') + 0.5) / ((SELECT count(*) FROM d WHERE source = 'src3') + 0.5)) ELSE 0.0 END)"))
def mlt_fields(spark, sf_dir):
    """More like a document of two fields."""
    node = q.MoreLikeThis(("text", "source"), text=(("text", "GNU license"), ("source", "src3")))
    return documents(spark, sf_dir).search(node).select("doc_id", F.round("score", 4).alias("score"))


@entry("not_null_guard", f"SELECT doc_id, NOT CASE WHEN doc_id % 3 = 0 THEN NULL ELSE list_contains(regexp_extract_all(lower(text), '{WORD}'), 'license') END AS matches FROM documents")
def not_null_guard(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").withColumn("text", F.expr("CASE WHEN doc_id % 3 <> 0 THEN text END"))
    index = SearchIndex(docs, "doc_id", {"text": FieldSpec("text")})
    return index.scored(q.Term("text", "license")).select("doc_id", (~F.col("matches")).alias("matches"))


# -- analyzers: one row a token ------------------------------------------------------------------------


def tokens_of(name: str, table: str, key: str, column: str, analyzer: Analyzer, sql: str):
    """Query `name`: key, term, pos of every token of a column; `sql` gives the oracle's list of terms."""

    @entry(name, f"SELECT {key}, unnest(x) AS term, (unnest(range(len(x))))::INT AS pos FROM (SELECT {key}, {sql} AS x FROM {table})")
    def run(spark, sf_dir):
        return read(spark, sf_dir, table).select(key, F.explode(analyzer.tokens(F.expr(column.replace("''", "\\'")))).alias("t")).select(key, "t.term", "t.pos")


SIGNS = "'“' || {0} || '”—' || {0} || '…\u00a0l’été 3.14,5 snake_case __ ¿don''t? naïve–' || {1}"
MIXED = "'日本語 тест ' || {0} || ' café-' || {1} || '，試験abc漢字'"
tokens_of("tokenize_simple", "part", "p_partkey", SIGNS.format("p_name", "p_brand"), Analyzer("simple"), f"regexp_extract_all(lower({SIGNS.format('p_name', 'p_brand')}), '{RUN}')")
tokens_of("tokenize_unicode", "part", "p_partkey", SIGNS.format("p_name", "p_brand"), Analyzer("unicode_words"), f"regexp_extract_all(lower({SIGNS.format('p_name', 'p_brand')}), '{WORD}')")
tokens_of("tokenize_chinese", "part", "p_partkey", MIXED.format("p_name", "p_brand"), Analyzer("chinese_compatible"), f"regexp_extract_all(regexp_replace(lower({MIXED.format('p_name', 'p_brand')}), '([一-鿿])', ' \\1 ', 'g'), '{RUN}')")
tokens_of("tokenize_icu", "part", "p_partkey", "'(' || p_name || ') it''s, ' || p_type || ' 3.5.'", Analyzer("icu"), "regexp_extract_all(lower(p_name || ' it''s ' || p_type || ' 3.5'), '[a-z0-9''.]+')")
tokens_of("tokenize_raw", "part", "p_partkey", "p_brand", Analyzer("raw"), "[p_brand]")
tokens_of("tokenize_keyword_trim", "part", "p_partkey", "'  ' || p_brand || ' '", Analyzer("keyword", trim=True), "[p_brand]")
tokens_of("tokenize_case_kept", "part", "p_partkey", "p_type", Analyzer(lowercase=False), r"regexp_extract_all(p_type, '[0-9A-Za-z]+')")
tokens_of("tokenize_whitespace", "conversations", "conv_id", "text", Analyzer("whitespace"), r"regexp_extract_all(lower(text), '[^ \t\n\r\f\x0B]+')")
tokens_of("tokenize_literal", "part", "p_partkey", "p_name", Analyzer("literal"), "[p_name]")
tokens_of("tokenize_literal_normalized", "customer", "c_custkey", "c_name", Analyzer("literal_normalized"), "[lower(c_name)]")
tokens_of("tokenize_ngram", "nation", "n_nationkey", "n_name", Analyzer("ngram", {"low": 3, "high": 3}), "list_transform(range(1, len(n_name) - 1), lambda i: lower(n_name[i:i + 2]))")
tokens_of("tokenize_edge_ngram", "nation", "n_nationkey", "n_name", Analyzer("edge_ngram", {"low": 2, "high": 5}), "flatten(list_transform(list_filter(regexp_extract_all(lower(n_name), '[0-9a-z]+'), lambda w: len(w) >= 2), lambda w: list_transform(range(2, least(5, len(w)) + 1), lambda k: w[1:k])))")
tokens_of("tokenize_regex", "pages", "page_id", "url", Analyzer("regex_pattern", {"pattern": "[a-z]+"}), "regexp_extract_all(url, '[a-z]+')")
tokens_of("tokenize_source_code", "pages", "page_id", "url", Analyzer("source_code"), f"regexp_extract_all(lower(regexp_replace(regexp_replace(url, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g')), '{RUN}')")


def filtered(name: str, analyzer: Analyzer, test: str, change: str = "term", base: str = "lower(text)"):
    """Query `name`: how often each term is left by token filters, over documents."""

    @entry(name, f"SELECT term, count(*) AS n FROM (SELECT {change} AS term FROM (SELECT unnest(regexp_extract_all({base}, '{WORD}')) AS term FROM documents) WHERE {test}) GROUP BY term")
    def run(spark, sf_dir):
        return read(spark, sf_dir, "documents").select(F.explode(analyzer.terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))


filtered("filter_length", Analyzer(min_bytes=3, max_bytes=6), "strlen(term) BETWEEN 3 AND 6")
filtered("filter_stopwords", Analyzer(stopwords=("the", "and", "of")), "term NOT IN ('the', 'and', 'of')")
filtered("filter_stopwords_language", Analyzer(stopwords_languages=("english",)), "term NOT IN (" + ", ".join(f"'{w}'" for w in __import__("skerry.functions.analysis", fromlist=["x"]).STOPWORDS["english"]) + ")")
filtered("filter_stopwords_spark", Analyzer(stopwords_languages=("dutch",)), "term NOT IN (SELECT unnest(string_split('de en van ik te dat die in een hij het niet zijn is was op aan met als voor had er maar om hem dan zou of wat mijn men dit zo door over ze zich bij ook tot je mij uit der daar haar naar heb hoe heeft hebben deze u want nog zal me zij nu ge geen omdat iets worden toch al waren veel meer doen toen moet ben zonder kan hun dus alles onder ja eens hier wie werd altijd doch wordt wezen kunnen ons zelf tegen na reeds wil kon niets uw iemand geweest andere', ' ')))")
filtered("filter_alnum", Analyzer(alnum_only=True), "regexp_full_match(term, '[0-9A-Za-z]+')")
filtered("filter_asciifold", Analyzer(fold=True), "true", "replace(strip_accents(term), 'ß', 'ss')")
