"""SearchIndex: a DataFrame with analysed fields and the numbers that scoring needs.

Two modes share the query nodes and give the same rows and scores. A scanned index analyses while it
scans: no state besides the source. A stored one (`build`) has written, once, each field's postings,
its dictionary with document frequencies, and its numbers: a query then reads the numbers of its own
terms, finds the keys that can match from the postings of its rarest terms, and analyses only the rows
of these. Corpus numbers come from all rows of the index, whatever a query filters.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skerry.functions.analysis import DEFAULT, Analyzer
from skerry.plans import ast
from skerry.plans.compile import Compiler

SPREAD = 16  # files of one term's postings


@dataclass(frozen=True)
class FieldSpec:
    """One searchable field: its column (or SQL expression), analyzers and BM25 parameters."""

    column: str
    analyzer: Analyzer = DEFAULT
    search_analyzer: Analyzer | None = None
    k1: float = 1.2
    b: float = 0.75
    fieldnorms: bool = True

    def __post_init__(self):
        if self.k1 < 0 or not 0 <= self.b <= 1:
            raise ValueError("k1 is not negative, and b lies between 0 and 1")


@dataclass
class SearchIndex:
    """df, its key column, and the fields by name; `where`: a partial index holds only such rows."""

    df: DataFrame
    key: str
    fields: dict[str, FieldSpec]
    where: str | None = None
    folder: str | None = None
    _numbers: dict = field(default_factory=dict, repr=False)

    def __post_init__(self):
        if self.where:
            self.df = self.df.where(self.where)
        self.analysed = self.with_tokens(self.df)

    # -- the stored form ------------------------------------------------------------------------

    def build(self, folder: str) -> SearchIndex:
        """The index with its postings, dictionaries and numbers written below `folder`, which is to be shared by all machines.

        Postings lie sorted by term and key in every file, and each term's in `SPREAD` files at most: few row
        groups of each file hold a term, and a term of very many rows is no single task's.
        """
        numbers = []
        for name in self.fields:
            dealt = self.postings(name).repartition("term", F.pmod(F.xxhash64("key"), F.lit(SPREAD)))
            dealt.sortWithinPartitions("term", "key").write.mode("overwrite").parquet(f"{folder}/postings/{name}")
            written = self.stored("postings", name, folder)
            written.groupBy("term").agg(F.count(F.lit(1)).alias("df")).sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/terms/{name}")
            n, mean = self._lengths(name)
            numbers.append((name, n, mean))
        self.df.sparkSession.createDataFrame(numbers, "field string, n long, mean double").coalesce(1).write.mode("overwrite").parquet(f"{folder}/numbers")
        return self.opened(folder)

    def opened(self, folder: str) -> SearchIndex:
        """The index over what `build` has written below `folder`."""
        index = SearchIndex(self.df, self.key, self.fields, None, folder)
        for r in self.df.sparkSession.read.parquet(f"{folder}/numbers").collect():  # one row a field
            index._numbers["lengths", r.field] = r.n, r.mean
        return index

    def stored(self, what: str, name: str, folder: str | None = None) -> DataFrame:
        """A field's written `postings` or `terms`."""
        return self.df.sparkSession.read.parquet(f"{folder or self.folder}/{what}/{name}")

    def candidates(self, seeds: list[tuple[str, tuple[str, ...]]]) -> DataFrame:
        """The keys of the rows that hold any of the seeds' terms."""
        parts = [self.stored("postings", f).where(F.col("term").isin(*terms)).select(F.col("key").alias(self.key)) for f, terms in seeds]
        return reduce(DataFrame.union, parts).distinct()

    def with_tokens(self, rows: DataFrame) -> DataFrame:
        """The rows with a token column for each field.

        A row number, compared with nothing it could fail, keeps the optimizer from copying the
        analysis into every place that reads it; filters that need no tokens go in before.
        """
        once = F.monotonically_increasing_id() >= 0
        return rows.select("*", *[F.when(once, self.raw_tokens(name)).alias(self.token_column(name)) for name in self.fields])

    def raw_tokens(self, name: str):
        spec = self.fields[name]
        return spec.analyzer.tokens(F.expr(spec.column))

    def may_hold(self, name: str, term: str):
        """A cheap condition that every row holding the term meets, or None where terms are changed by the analyzer."""
        spec = self.fields[name]
        if spec.analyzer.stemmer or spec.analyzer.fold:
            return None
        text = F.expr(spec.column)
        return F.contains(F.lower(text) if spec.analyzer.lowers else text, F.lit(term))

    def token_column(self, name: str) -> str:
        if name not in self.fields:
            raise ValueError(f"unknown field {name!r}")
        return "_tokens_" + name.replace(".", "_")

    # -- numbers of the whole index ------------------------------------------------------------

    def _once(self, key, make):
        if key not in self._numbers:
            self._numbers[key] = make()
        return self._numbers[key]

    def _lengths(self, name: str):
        self.token_column(name)
        spec = self.fields[name]
        n = spec.analyzer.count(F.expr(spec.column))
        return self._once(("lengths", name), lambda: self.df.select(n.alias("n")).agg(F.count("n"), F.avg("n")).first())

    def n_docs(self, name: str) -> int:
        return self._lengths(name)[0]

    def mean_length(self, name: str) -> float:
        return self._lengths(name)[1] or 0.0

    def doc_frequencies(self, name: str, terms: list[str]) -> None:
        """Takes the frequencies of all `terms` in one pass."""
        new = [t for t in dict.fromkeys(terms) if ("df", name, t) not in self._numbers]
        if new and self.folder:
            found = {r.term: r.df for r in self.stored("terms", name).where(F.col("term").isin(*new)).collect()}  # a query's terms
            self._numbers |= {("df", name, t): found.get(t, 0) for t in new}
        elif new:
            self.token_column(name)
            tests = [self.may_hold(name, t) for t in new]
            rows = self.df if any(t is None for t in tests) else self.df.where(reduce(lambda a, b: a | b, tests))
            row = self.with_tokens(rows).agg(*[F.count_if(_holds(F.col(self.token_column(name)), t)) for t in new]).first()
            self._numbers |= {("df", name, t): n for t, n in zip(new, row, strict=True)}

    def doc_frequency(self, name: str, term: str) -> int:
        self.doc_frequencies(name, [term])
        return self._numbers["df", name, term]

    def analyse(self, name: str, text: str, tokenizer: str | None = None) -> list[str]:
        """The terms of a query text under the field's search analyzer, or under another tokenizer with its filters."""
        self.token_column(name)
        spec = self.fields[name]
        analyzer = spec.search_analyzer or spec.analyzer
        terms = (analyzer.with_options(tokenizer=tokenizer, options={}) if tokenizer else analyzer).terms(F.lit(text))
        found = self._once(("terms", name, text, tokenizer), lambda: self.df.sparkSession.range(1).select(terms.alias("t")).first().t)
        self.doc_frequencies(name, found)
        return list(found)

    def dictionary(self, name: str) -> DataFrame:
        """term, df: every term of the field and how many rows hold it."""
        self.token_column(name)
        if self.folder:
            return self.stored("terms", name)
        tokens = F.col(self.token_column(name))
        return self.analysed.select(F.explode(F.array_distinct(F.transform(tokens, lambda t: t["term"]))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))

    def expand(self, name: str, test, limit: int) -> list[str]:
        """The first `limit` terms of the dictionary, in order, that meet the test."""
        return [r.term for r in self.dictionary(name).where(test(F.col("term"))).select("term").orderBy("term").limit(limit).collect()]

    def telling_terms(self, q: ast.MoreLikeThis) -> list[tuple[str, str, float]]:
        """(field, term, tf * idf) of the terms of the source with the largest tf * idf, over all its fields."""
        return self._once(("telling", q), lambda: self._telling_terms(q))

    def _telling_terms(self, q: ast.MoreLikeThis) -> list[tuple[str, str, float]]:
        names = [q.field] if isinstance(q.field, str) else list(q.field)
        texts = {q.field: q.text} if isinstance(q.text, str) else dict(q.text) if q.text is not None else None
        found = [x for name in names if texts is None or name in texts for x in self._telling_of(q, name, texts and texts[name])]
        return sorted(found, key=lambda x: (-x[2], x[1], x[0]))[: q.max_query_terms]

    def _telling_of(self, q: ast.MoreLikeThis, name: str, text: str | None) -> list[tuple[str, str, float]]:
        tokens = F.col(self.token_column(name))
        if text is not None:
            source = self.df.sparkSession.range(1).select(F.explode(self.fields[name].analyzer.terms(F.lit(text))).alias("term"))
        else:
            source = self.with_tokens(self.df.where(F.col(self.key) == F.lit(q.key))).select(F.explode(F.transform(tokens, lambda t: t["term"])).alias("term"))
        tf = source.groupBy("term").agg(F.count(F.lit(1)).alias("tf")).where(F.col("tf") >= q.min_term_frequency)
        if q.stopwords:
            tf = tf.where(~F.col("term").isin(*q.stopwords))
        tf = tf.where(F.length("term") >= q.min_word_length)
        if q.max_word_length is not None:
            tf = tf.where(F.length("term") <= q.max_word_length)
        n = self.n_docs(name)
        tf = F.broadcast(tf)  # one text's terms
        if self.folder:
            joined = self.dictionary(name).join(tf, "term")
        else:  # only the source's terms are counted
            held = self.analysed.select(F.explode(F.array_distinct(F.transform(tokens, lambda t: t["term"]))).alias("term")).join(tf, "term", "left_semi")
            joined = held.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(tf, "term")
        joined = joined.where(F.col("df") >= q.min_doc_frequency)
        if q.max_doc_frequency is not None:
            joined = joined.where(F.col("df") <= q.max_doc_frequency)
        weight = F.round(F.col("tf") * F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6)
        rows = joined.select("term", "df", weight.alias("w")).orderBy(F.desc("w"), "term").limit(q.max_query_terms).collect()
        self._numbers |= {("df", name, r.term): r.df for r in rows}
        return [(name, r.term, r.w) for r in rows]

    # -- queries --------------------------------------------------------------------------------

    def search(self, query: ast.Query, score: str = "score") -> DataFrame:
        """The rows that match, with their score, without the token columns."""
        compiler = Compiler(self)
        match, value = compiler.compile(query)
        needed = compiler.needs(query)
        seeds = compiler.seeds(query) if self.folder else None
        rows = self.df if needed is None else self.df.where(needed)
        if seeds is not None:
            rows = rows.join(self.candidates(seeds), self.key, "left_semi") if any(terms for _, terms in seeds) else rows.where(F.lit(False))
        rows = self.with_tokens(rows)
        found = rows.where(match).withColumn(score, value)
        return found.drop(*[self.token_column(f) for f in self.fields])

    def scored(self, query: ast.Query, match: str = "matches", score: str = "score") -> DataFrame:
        """All rows, with match (null where the field is null) and score."""
        m, value = Compiler(self).compile(query)
        return self.analysed.withColumn(match, m).withColumn(score, value).drop(*[self.token_column(f) for f in self.fields])

    def top(self, query: ast.Query, k: int, *order: str, offset: int = 0) -> DataFrame:
        """The k best rows by the SQL order expressions (by default the score), then by key; each task keeps k rows."""
        if len(order) > 5:
            raise ValueError("at most 5 sort keys")
        keys = [_order(o) for o in order] or [F.col("score").desc()]
        return self.search(query).orderBy(*keys, self.key).offset(offset).limit(k)

    def count(self, query: ast.Query) -> DataFrame:
        """How many rows match."""
        return self.search(query).agg(F.count(F.lit(1)).alias("n"))

    # -- postings --------------------------------------------------------------------------------

    def postings(self, name: str) -> DataFrame:
        """key, term, tf, positions, length: the inverted table of a field, to be written once."""
        tokens = F.col(self.token_column(name))
        rows = self.analysed.where(tokens.isNotNull()).select(F.col(self.key).alias("key"), F.size(tokens).alias("length"), F.explode(tokens).alias("t"))
        return rows.groupBy("key", "length", F.col("t.term").alias("term")).agg(F.count(F.lit(1)).alias("tf"), F.sort_array(F.collect_list("t.pos")).alias("positions"))


def _holds(tokens, term: str):
    return F.exists(tokens, lambda x: x["term"] == term)


ORDER = re.compile(r"(?is)^(?P<expr>.*?)(?:\s+(?P<way>asc|desc))?(?:\s+nulls\s+(?P<nulls>first|last))?$")


def _order(text: str):
    m = ORDER.match(text.strip())
    c, down = F.expr(m["expr"]), (m["way"] or "").lower() == "desc"
    first = m["nulls"].lower() == "first" if m["nulls"] else down  # the usual order of the host
    if first:
        return c.desc_nulls_first() if down else c.asc_nulls_first()
    return c.desc_nulls_last() if down else c.asc_nulls_last()


def search_postings(postings: DataFrame, terms: list[str], n_docs: int, mean_length: float, every: bool = False, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """key, score of any-match (or all-match) of `terms` over a postings table.

    Only the terms' postings are read (a pushed-down filter on a table sorted by term).
    """
    mine = postings.where(F.col("term").isin(*terms))
    df = mine.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # one row a query term
    rows = mine.join(F.broadcast(df), "term")
    idf = F.log(1 + (F.lit(n_docs) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(mean_length)))
    out = rows.groupBy("key").agg(F.sum(score).alias("score"), F.count(F.lit(1)).alias("held"))
    return (out.where(F.col("held") == len(set(terms))) if every else out).select("key", "score")
