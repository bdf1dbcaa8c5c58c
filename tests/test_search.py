"""Random query trees over small tables against a plain evaluator, and single rules of the search half."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skerry.functions import ranges
from skerry.functions.analysis import Analyzer
from skerry.functions.stemming import english, german
from skerry.operators.highlight import fragments, highlight, snippet, snippet_positions, snippets
from skerry.operators.json_aggs import RequestError, aggregate, buckets
from skerry.plans import ast as q
from skerry.plans import parser
from skerry.plans.compile import fuzzy_match
from skerry.plans.index import FieldSpec, SearchIndex

TEXTS = ["red fox runs", "the red red dog", "a fox and a dog", None, "", "blue dog runs to the red fox", "fox red"]
WORDS = ["red", "fox", "dog", "runs", "blue", "none"]


@pytest.fixture(scope="module")
def index(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    index = SearchIndex(rows, "id", {"text": FieldSpec("text")})
    index.doc_frequencies("text", WORDS)
    return index


def score_of(node, i):
    """(matches, score) by plain Python; matches is None for null texts."""
    toks = [(t or "").split() if t is not None else None for t in TEXTS]
    held = [t for t in toks if t is not None]
    mean = sum(map(len, held)) / len(held)
    if isinstance(node, q.Term):
        if toks[i] is None:
            return None, 0.0
        tf, df = toks[i].count(node.value), sum(node.value in t for t in held)
        idf = math.log(1 + (len(held) - df + 0.5) / (df + 0.5))
        return tf > 0, idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(toks[i]) / mean)) if tf else 0.0
    if isinstance(node, q.Boost):
        m, s = score_of(node.query, i)
        return m, s * node.factor
    if isinstance(node, q.Const):
        m, _ = score_of(node.query, i)
        return m, node.score if m else 0.0
    if isinstance(node, q.Boolean):
        must, should, no = ([score_of(x, i) for x in part] for part in (node.must, node.should, node.must_not))
        if not must and not should:
            return False, 0.0
        tests = [m for m, _ in must] + [None if m is None else not m for m, _ in no]
        if should and not must:
            ors = [m for m, _ in should]
            tests.append(True if True in ors else None if None in ors else False)
        ok = False if False in tests else None if None in tests else True
        return ok, sum(s for _, s in must + should) if ok else 0.0
    raise AssertionError(node)


terms = st.sampled_from(WORDS).map(lambda w: q.Term("text", w))
trees = st.recursive(terms, lambda t: st.one_of(
    st.builds(q.Boost, t, st.sampled_from([0.5, 2.0])), st.builds(q.Const, t, st.sampled_from([1.0, 3.0])),
    st.builds(q.Boolean, st.lists(t, max_size=2).map(tuple), st.lists(t, max_size=2).map(tuple), st.lists(t, max_size=1).map(tuple))), max_leaves=5)


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(tree=trees)
def test_random_trees(index, tree):
    got = {r.id: (r.matches, r.score) for r in index.scored(tree).collect()}
    for i in range(len(TEXTS)):
        m, s = score_of(tree, i)
        assert bool(got[i][0]) == bool(m)
        assert got[i][1] == pytest.approx(s if m else 0.0, abs=1e-9)
    assert q.Query.from_json(tree.to_json()) == tree


def ids(index, node):
    return sorted(r.id for r in index.search(node).collect())


def test_slop_one_gap_is_one_and_a_swap_is_two(index):
    assert ids(index, q.Phrase("text", "red fox")) == [0, 5]
    assert ids(index, q.Phrase("text", "red runs", slop=1)) == [0]
    assert ids(index, q.Phrase("text", "red fox", slop=1)) == [0, 5]
    assert ids(index, q.Phrase("text", "red fox", slop=2)) == [0, 5, 6]


def test_nothing_to_look_for(index):
    for node in (q.Match("text", ""), q.Phrase("text", "!!"), q.Boolean(), q.Boolean(must_not=(q.All(),)), q.Empty()):
        assert ids(index, node) == []


def test_raw_values_and_changed_terms_are_found(spark):
    rows = spark.createDataFrame([(1, "Brand#1"), (2, "Façades"), (3, None)], "id int, v string")
    for analyzer, term, want in ((Analyzer("literal"), "Brand#1", [1]), (Analyzer(fold=True, stemmer="english"), "facad", [2]), (Analyzer("ngram", {"low": 3, "high": 3}), "ran", [1]), (Analyzer(lowercase=False), "Brand", [1])):
        assert ids(SearchIndex(rows, "id", {"v": FieldSpec("v", analyzer)}), q.Term("v", term)) == want


def test_near(index):
    assert ids(index, q.Near("text", "red", 0, "fox")) == [0, 5, 6]
    assert ids(index, q.Near("text", "red", 0, "fox", ordered=True)) == [0, 5]


@pytest.mark.parametrize(("a", "b", "d", "kind", "want"), [
    ("shose", "shoes", 1, {}, True), ("shose", "shoes", 1, {"transpose": False}, False), ("shose", "shoes", 2, {"transpose": False}, True),
    ("runner", "run", 0, {"prefix": True}, False), ("runner", "run", 1, {"prefix": True}, True), ("abc", "xyz", 2, {}, False), ("badc", "abcd", 2, {}, True)])
def test_fuzzy(spark, a, b, d, kind, want):
    assert spark.range(1).select(fuzzy_match(F.lit(a), b, d, **kind).alias("x")).first().x is want


def test_parser():
    assert parser.parse("a b", ["f"]) == q.Boolean(should=(q.Match("f", "a"), q.Match("f", "b")))
    assert parser.parse("a AND b", ["f"]) == q.Boolean(must=(q.Match("f", "a"), q.Match("f", "b")))
    assert parser.parse("g:x^2", ["f"], text_fields={"f", "g"}) == q.Boost(q.Match("g", "x"), 2.0)
    assert parser.parse('"a b"~2', ["f"]) == q.Phrase("f", "a b", 2)
    assert parser.parse('"a b"*', ["f"]) == q.PhrasePrefix("f", "a b")
    assert parser.parse("g:>3", ["f"]) == q.Where("g > 3")
    assert parser.parse("g:[1 TO 5}", ["f"]) == q.Range("g", 1, 5, True, False)
    assert parser.parse("-x y", ["f"]) == q.Boolean(should=(q.Match("f", "y"),), must_not=(q.Match("f", "x"),))
    with pytest.raises(parser.ParseError):
        parser.parse("h:x", ["f"], text_fields={"f"})
    with pytest.raises(parser.ParseError):
        parser.parse("(a", ["f"])
    assert parser.parse("(a", ["f"], lenient=True) == q.Match("f", "a")


@pytest.mark.parametrize(("text", "conjunction", "want"), [
    ("a AND b OR c", False, "((a&b)|c)"), ("a OR b AND c", False, "(a|(b&c))"), ("a OR b", True, "(a|b)"), ("a b", True, "(a&b)"), ("a AND b c", False, "((a&b)|c)"),
    ("a AND b AND c", False, "(a&b&c)"), ("(a OR b) AND c", False, "((a|b)&c)"), ("a b OR c", True, "(a&(b|c))"), ("a OR b OR c", True, "(a|b|c)")])
def test_and_binds_closer_than_or(text, conjunction, want):
    def say(n):
        return n.text if isinstance(n, q.Match) else "(" + ("&" if n.must else "|").join(map(say, n.must or n.should)) + ")"

    assert say(parser.parse(text, ["f"], conjunction=conjunction)) == want


@pytest.mark.parametrize(("analyzer", "text", "want"), [
    (Analyzer(), "Hello, World-2 é", [("hello", 0), ("world", 1), ("2", 2), ("é", 3)]),
    (Analyzer(stopwords=("the",)), "the end", [("end", 1)]),
    (Analyzer("unicode_words"), "it's 3.14 “red” fox—runs\u00a0a…b __ _x_", [("it's", 0), ("3.14", 1), ("red", 2), ("fox", 3), ("runs", 4), ("a", 5), ("b", 6), ("_x_", 7)]),
    (Analyzer("unicode_words"), "a1.b2 c.d 1,5x l’été 日本 カタカナ ひら", [("a1", 0), ("b2", 1), ("c.d", 2), ("1,5x", 3), ("l’été", 4), ("日", 5), ("本", 6), ("カタカナ", 7), ("ひ", 8), ("ら", 9)]),
    (Analyzer("simple"), "“red” fox—runs\u00a0it's тест x_y", [("red", 0), ("fox", 1), ("runs", 2), ("it", 3), ("s", 4), ("тест", 5), ("x", 6), ("y", 7)]),
    (Analyzer("icu", {"language": "fr"}), "«l'été» vient, مرحبا", [("l'été", 0), ("vient", 1), ("مرحبا", 2)]),
    (Analyzer("source_code"), "parseHTTPRequest_now", [("parse", 0), ("http", 1), ("request", 2), ("now", 3)]),
    (Analyzer("chinese_compatible"), "日本ab café—тест カナ", [("日", 0), ("本", 1), ("ab", 2), ("café", 3), ("тест", 4), ("カナ", 5)]),
    (Analyzer(fold=True), "Œuvre Łódź ﬁne Ångström", [("oeuvre", 0), ("lodz", 1), ("fine", 2), ("angstrom", 3)]),
    (Analyzer(stopwords_languages=("dutch",)), "de kat van haar", [("kat", 1)]),
    (Analyzer("ngram", {"low": 2, "high": 3}), "abc", [("ab", 0), ("abc", 1), ("bc", 2)]),
    (Analyzer("ngram", {"low": 1, "high": 2, "prefix_only": True}), "abc", [("a", 0), ("ab", 1)]),
    (Analyzer("edge_ngram", {"low": 2, "high": 3}), "a bcd", [("bc", 0), ("bcd", 1)]),
    (Analyzer(fold=True), "Façade", [("facade", 0)]),
    (Analyzer(stemmer="english"), "Running dogs' happiness", [("run", 0), ("dog", 1), ("happi", 2)]),
    (Analyzer(stemmer="german"), "Die Häuser der Freundlichkeit", [("die", 0), ("haus", 1), ("der", 2), ("freundlich", 3)]),
    (Analyzer("literal"), "As Is", [("As Is", 0)]), (Analyzer("literal_normalized"), "As Is", [("as is", 0)])])
def test_analyzers(spark, analyzer, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(analyzer.tokens(F.col("t")).alias("x")).first().x
    assert [(t.term, t.pos) for t in got] == want
    assert spark.createDataFrame([(None,)], "t string").select(analyzer.tokens(F.col("t")).alias("x")).first().x is None


def test_stems_of_the_published_examples():
    want = {"consigned": "consign", "consistency": "consist", "consolation": "consol", "consolingly": "consol", "knightly": "knight", "knocking": "knock", "knots": "knot", "generously": "generous", "communism": "communism",
            "skies": "sky", "dying": "die", "gas": "gas", "gaps": "gap", "kiwis": "kiwi", "ties": "tie", "cries": "cri", "hopping": "hop", "hoping": "hope", "agreed": "agre", "luxuriated": "luxuri", "say": "say", "by": "by", "cry": "cri",
            "relational": "relat", "conditional": "condit", "rationalize": "ration", "hopefulness": "hope", "national": "nation", "adjustment": "adjust", "adoption": "adopt", "controlling": "control", "rate": "rate", "succeed": "succeed"}
    assert {k: english(k) for k in want} == want
    want = {"aufeinanderfolgenden": "aufeinanderfolg", "aufenthaltes": "aufenthalt", "auffällig": "auffall", "kategorischen": "kategor", "kaufmann": "kaufmann", "katzen": "katz", "käuflich": "kauflich", "kerkern": "kerk", "verständnisse": "verstandnis", "größe": "gross"}
    assert {k: german(k) for k in want} == want


def test_ranges(spark):
    make = lambda lo, hi, a=True, b=False: ranges.make(F.lit(lo).cast("int"), F.lit(hi).cast("int"), F.lit(a), F.lit(b))
    row = spark.range(1).select(
        ranges.holds(make(1, 3), F.lit(3)).alias("a"), ranges.holds(make(1, 3, b=True), F.lit(3)).alias("b"), ranges.intersects(make(1, 3), make(3, 5)).alias("c"),
        ranges.intersects(make(1, 3, b=True), make(3, 5)).alias("d"), ranges.inside(make(2, 3), make(1, 3)).alias("e"), ranges.inside(make(None, 3), make(1, 3)).alias("f"),
        ranges.intersects(make(3, 3), make(1, 5)).alias("g"), ranges.inside(make(1, 3), make(None, None)).alias("h")).first()
    assert tuple(row) == (False, True, False, True, True, False, False, True)


def test_aggregation_requests(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 7, "y"), ("b", 3, None), (None, 2, "x")], "k string, v int, s string")
    answer = aggregate(rows, {"k": {"terms": {"field": "k"}, "aggs": {"m": {"max": {"field": "v"}}, "s": {"terms": {"field": "s"}}}}, "n": {"value_count": {"field": "v"}}}).first().response
    import json

    got = json.loads(answer)
    assert [(b["key"], b["doc_count"], b["m"]["value"]) for b in got["k"]["buckets"]] == [("a", 2, 7.0), ("b", 1, 3.0)]
    assert [b["key"] for b in got["k"]["buckets"][0]["s"]["buckets"]] == ["x", "y"]
    assert got["n"] == {"value": 4}
    assert {r.key: r.doc_count for r in buckets(rows, {"histogram": {"field": "v", "interval": 2}}).collect()} == {0.0: 1, 2.0: 2, 4.0: 0, 6.0: 1}
    for bad in ({"x": {"nope": {}}}, {"buckets": {}}, {"x": {"terms": {"field": "missing"}}}, {"x": {"date_histogram": {"field": "v", "fixed_interval": "1 day"}}}):
        with pytest.raises(RequestError):
            aggregate(rows, bad)
    with pytest.raises(RequestError):
        aggregate(rows, {"k": {"terms": {"field": "k"}}}, bucket_limit=1)


def answer_of(rows, spec, **how):
    import json

    return json.loads(aggregate(rows, spec, **how).first().response)


def test_nested_aggregations(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 7, "y"), ("a", 8, "y"), ("b", 3, None), (None, 2, "x")], "k string, v int, s string")
    hits = {"h": {"top_hits": {"size": 1, "from": 1, "sort": [{"v": "desc"}], "docvalue_fields": ["v"]}}}
    deep = {"k": {"terms": {"field": "k"}, "aggs": {"s": {"terms": {"field": "s"}, "aggs": {"v": {"terms": {"field": "v", "order": {"_key": "asc"}}, "aggs": hits}}}}}}
    got = answer_of(rows, deep)["k"]["buckets"]
    assert [(x["key"], y["key"], z["key"], z["doc_count"]) for x in got for y in x["s"]["buckets"] for z in y["v"]["buckets"]] == [("a", "y", 7, 1), ("a", "y", 8, 1), ("a", "x", 1, 1)]
    assert got[1]["s"]["buckets"] == [], "a bucket without any below it has an empty list"
    filtered = answer_of(rows, {"f": {"filter": {"sql": "v > 2"}, "aggs": {"k": {"terms": {"field": "k"}, "aggs": hits}}}})["f"]
    assert filtered["doc_count"] == 3 and [(b["key"], b["doc_count"], b["h"]["hits"]) for b in filtered["k"]["buckets"]] == [("a", 2, [{"v": 7}]), ("b", 1, [])]
    below = answer_of(rows, {"k": {"terms": {"field": "k"}, "aggs": {"f": {"filter": {"sql": "v > 7"}}, "r": {"range": {"field": "v", "ranges": [{"from": 2, "to": 5}]}}}}})["k"]["buckets"]
    assert [b["f"]["doc_count"] for b in below] == [1, 0]
    assert [[(r["key"], r.get("from"), r.get("to"), r["doc_count"]) for r in b["r"]["buckets"]] for b in below] == [
        [("*-2", None, 2.0, 1), ("2-5", 2.0, 5.0, 0), ("5-*", 5.0, None, 2)], [("*-2", None, 2.0, 0), ("2-5", 2.0, 5.0, 1), ("5-*", 5.0, None, 0)]]
    grid = answer_of(rows, {"k": {"terms": {"field": "k"}, "aggs": {"h": {"histogram": {"field": "v", "interval": 3}}}}})["k"]["buckets"]
    assert [(b["key"], b["doc_count"]) for b in grid[0]["h"]["buckets"]] == [(0.0, 1), (3.0, 0), (6.0, 2)]
    two = answer_of(rows, {"m": {"multi_terms": {"terms": [{"field": "k"}, {"field": "s"}]}}, "c": {"composite": {"size": 1, "sources": [{"k": {"terms": {"field": "k"}}}]}}})
    assert two["m"]["buckets"][0] == {"key": ["a", "y"], "key_as_string": "a|y", "doc_count": 2} and two["c"] == {"buckets": [{"key": {"k": "a"}, "doc_count": 3}], "after_key": {"k": "a"}}
    other = answer_of(rows, {"k": {"terms": {"field": "k", "size": 1}, "aggs": {"s": {"terms": {"field": "s", "size": 1}}}}})["k"]
    assert other["sum_other_doc_count"] == 1 and other["buckets"][0]["s"]["sum_other_doc_count"] == 1


def test_bucket_limits_hold_before_sizes_and_below(spark):
    rows = spark.range(50).selectExpr("id % 2 AS k", "id AS v")
    with pytest.raises(RequestError):
        aggregate(rows, {"v": {"terms": {"field": "v", "size": 1}}}, bucket_limit=20)
    with pytest.raises(RequestError):
        aggregate(rows, {"k": {"terms": {"field": "k"}, "aggs": {"v": {"terms": {"field": "v"}}}}}, bucket_limit=20)
    with pytest.raises(Exception, match="too many buckets"):
        aggregate(rows, {"h": {"histogram": {"field": "v", "interval": 0.001}}}, bucket_limit=200).collect()
    sketch, exact = (answer_of(rows, {"p": {"percentiles": {"field": "v", "percents": [50]}}, "c": {"cardinality": {"field": "v"}}}, exact=e) for e in (False, True))
    assert exact["c"]["value"] == 50 and abs(sketch["c"]["value"] - 50) <= 3 and abs(sketch["p"]["values"]["50.0"] - exact["p"]["values"]["50.0"]) <= 1


def test_fragments():
    text = "one two three four five six seven two"
    found = fragments(text, {"two"}, 16)
    assert [text[a:b] for a, b, _ in found] == ["one two three", "seven two"]


def test_highlighting_follows_the_analyzer(spark):
    rows = spark.createDataFrame([(1, "Running dogs, a DOG’s façade"), (2, "nothing"), (3, None), (4, "")], "id int, t string")
    plain, stemmed, folded = Analyzer("simple"), Analyzer("simple", stemmer="english"), Analyzer("simple", fold=True)
    got = {r.id: r for r in rows.select("id", *[f(F.col("t"), terms, analyzer=a).alias(n) for n, f, terms, a in (
        ("a", snippet, ["dog"], plain), ("b", snippet, ["dog"], stemmed), ("c", highlight, ["facade"], folded), ("d", highlight, ["dog"], plain),
        ("e", snippet_positions, ["facade"], folded), ("f", snippets, ["dog"], stemmed))]).collect()}
    assert got[1].a == "Running dogs, a <b>DOG</b>’s façade" and got[1].b == "Running <b>dogs</b>, a <b>DOG</b>’s façade"
    assert got[1].c == "Running dogs, a DOG’s <b>façade</b>" and got[1].d == "Running dogs, a <b>DOG</b>’s façade"
    assert got[1].e == [[24, 31]] and got[1].f == [got[1].b]
    assert (got[2].b, got[2].c, got[2].f, got[3].b, got[3].c, got[3].f, got[4].b) == (None, "nothing", [], None, None, [], None)


def test_order_expressions(spark):
    rows = spark.createDataFrame([(1, "x", 3), (2, "x", 1), (3, "x", None)], "id int, t string, v int")
    index = SearchIndex(rows, "id", {"t": FieldSpec("t")})
    order = lambda *o: [r.id for r in index.top(q.Term("t", "x"), 3, *o).collect()]
    assert order("v + 1 desc nulls last") == [1, 2, 3] and order("v * 2 asc NULLS FIRST") == [3, 2, 1] and order("v desc") == [3, 1, 2] and order("v") == [2, 1, 3]


def test_stored_and_scanned_indexes_agree(spark, tmp_path):
    texts = [*TEXTS, "red red fox", "the quick blue-red dog runs", "foxes run", "fax fox"]
    rows = spark.createDataFrame([(i, t, i % 3) for i, t in enumerate(texts)], "id int, text string, n int")
    scanned = SearchIndex(rows, "id", {"text": FieldSpec("text")})
    stored = scanned.build(f"{tmp_path}/index")
    red, fox = q.Term("text", "red"), q.Term("text", "fox")
    for node in (red, q.Match("text", "red fox dog", every=True), q.Match("text", "red dog"), q.Phrase("text", "red fox"), q.Phrase("text", "fox red", slop=3), q.PhrasePrefix("text", "red fo"), q.Regex("text", "fo.*"), q.Fuzzy("text", "fix", 1),
                 q.Match("text", "fix rad", distance=1), q.Near("text", "red", 1, "fox"), q.Boolean(must=(red, q.Where("n = 1"))), q.Boolean(should=(red, fox), must_not=(q.Term("text", "dog"),)), q.Boolean(should=(red,), minimum_should_match=0),
                 q.DisMax((red, fox)), q.Boost(fox, 2.0), q.MoreLikeThis("text", key=0, min_doc_frequency=1), q.All(), q.Empty(), q.Match("text", ""), q.Term("text", "absent"), q.RegexPhrase("text", ("r.d", "f.x")), q.TermSet("text", ("blue", "runs")), q.Parse("red AND fox OR blue", "text")):
        a, b = (sorted((r.id, round(r.score, 9)) for r in x.search(node).collect()) for x in (scanned, stored))
        assert a == b, node


def test_bad_settings(index):
    with pytest.raises(ValueError):
        FieldSpec("x", b=2)
    with pytest.raises(ValueError):
        Analyzer("nope")
    with pytest.raises(ValueError):
        index.search(q.Term("nope", "x"))
    with pytest.raises(ValueError):
        index.search(q.Boost(q.All(), 5000))
