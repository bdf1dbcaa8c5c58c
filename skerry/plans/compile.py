"""From query nodes to columns: match (boolean, null where a guarded field is null) and score (double).

Scores: BM25 for tokens and phrases; 1 for clauses that only tell whether a row matches; a boolean
adds up its matching must and should clauses. What a query needs of the whole index (rows, mean
length, document frequencies) is a few numbers, taken by one aggregation for each field.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from skerry.plans import ast, parser

EXPANDED = 1024  # terms that a pattern may stand for before all rows are read instead

def _any(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, columns) if columns else F.lit(False)


def _every(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, columns) if columns else F.lit(False)


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns) if columns else F.lit(0.0)


def _all_of(parts: list) -> Column | None:
    """The conjunction of what is known."""
    known = [p for p in parts if p is not None]
    return _every(known) if known else None


def _one_of(parts: list) -> Column | None:
    """The disjunction, if every part is known."""
    return _any(parts) if parts and all(p is not None for p in parts) else None


def fuzzy_match(term: Column, value: str, distance: int, prefix: bool = False, transpose: bool = True) -> Column:
    """Whether a term is within `distance` edits of `value` (or, with `prefix`, one of its prefixes is)."""
    if distance == 0:
        return term == value
    swapped = [value[:i] + value[i + 1] + value[i] + value[i + 2 :] for i in range(len(value) - 1)] if transpose else []
    twice = {w[:i] + w[i + 1] + w[i] + w[i + 2 :] for w in swapped for i in range(len(value) - 1)} if distance == 2 else set()

    def near(t: Column) -> Column:
        within = lambda v, d: F.levenshtein(t, F.lit(v), d) >= 0  # noqa: E731  it gives -1 beyond d
        return _any([within(value, distance), *(within(v, distance - 1) for v in sorted(set(swapped) - {value})), *(t == v for v in sorted(twice - {value}))])

    if not prefix:
        return near(term)
    lengths = range(max(0, len(value) - distance), len(value) + distance + 1)
    return _any([near(F.substring(term, 1, k)) for k in lengths])


class Compiler:
    """Compiles nodes against an index (index.SearchIndex)."""

    def __init__(self, index):
        self.index = index

    # -- pieces -------------------------------------------------------------------------------

    def tokens(self, field: str) -> Column:
        return F.col(self.index.token_column(field))

    def terms_of(self, field: str, text, tokenizer: str | None = None) -> list[str]:
        """Tokens of a query text; a sequence is taken as tokens already."""
        return list(text) if isinstance(text, (list, tuple)) else self.index.analyse(field, text, tokenizer)

    def pattern(self, field: str, pattern: str, limit: int | None, strict: bool):
        """A test of terms: those that meet the pattern; at most the first `limit` of the dictionary, or an error if `strict`."""
        if limit is None:
            return lambda t: t.rlike(f"^(?:{pattern})$")
        found = self.index.expand(field, lambda t: t.rlike(f"^(?:{pattern})$"), limit + 1)
        if strict and len(found) > limit:
            raise ValueError(f"the pattern {pattern!r} stands for more than {limit} terms")
        return lambda t: t.isin(*found[:limit]) if found else F.lit(False)

    def idf(self, field: str, term: str) -> float:
        n, df = self.index.n_docs(field), self.index.doc_frequency(field, term)
        return math.log(1 + (n - df + 0.5) / (df + 0.5))

    def bm25(self, field: str, tf: Column, idf: float) -> Column:
        spec = self.index.fields[field]
        length = F.size(self.tokens(field))
        norm = F.lit(1 - spec.b) + F.lit(spec.b / max(self.index.mean_length(field), 1e-9)) * length if spec.fieldnorms else F.lit(1.0)
        return F.when(tf > 0, F.lit(idf * (spec.k1 + 1)) * tf / (tf + F.lit(spec.k1) * norm)).otherwise(0.0)

    def term(self, field: str, term: str) -> tuple[Column, Column]:
        tf = F.size(F.filter(self.tokens(field), lambda t: t["term"] == term))
        return F.exists(self.tokens(field), lambda t: t["term"] == term), self.bm25(field, tf, self.idf(field, term))

    def places(self, field: str, test) -> Column:
        """Positions of the tokens whose term meets the test."""
        return F.transform(F.filter(self.tokens(field), lambda t: test(t["term"])), lambda t: t["pos"])

    def sequence(self, field: str, tests: list, slop: int) -> tuple[Column, Column]:
        """(matches, how often): tokens that meet the tests one after the other, displaced by `slop` in all at most."""
        places = [self.places(field, t) for t in tests]
        if slop == 0:
            starts = F.filter(places[0], lambda p: _every([F.array_contains(q, p + i) for i, q in enumerate(places[1:], 1)]))
            return F.size(starts) > 0, F.size(starts)

        def fits(i: int, low: Column, high: Column) -> Column:
            if i == len(places):
                return high - low <= slop
            return F.exists(places[i], lambda p: fits(i + 1, F.least(low, p - i), F.greatest(high, p - i)))

        starts = F.filter(places[0], lambda p: fits(1, p, p))
        return F.size(starts) > 0, F.size(starts)

    # -- what a matching row can't do without ---------------------------------------------------

    def needs(self, q: ast.Query) -> Column | None:
        """A condition on the source columns that every match meets, None where there is none.

        It holds no tokens, so it runs before the analysis, and plain parts of it reach the scan.
        """
        held = lambda f, terms: [self.index.may_hold(f, t) for t in terms]
        if isinstance(q, (ast.Boost, ast.Const, ast.ScoreFilter)):
            return self.needs(q.query)
        if isinstance(q, ast.Term):
            return self.index.may_hold(q.field, q.value)
        if isinstance(q, ast.TermSet):
            return _one_of(held(q.field, q.values))
        if isinstance(q, ast.Match) and not q.distance:
            parts = held(q.field, self.terms_of(q.field, q.text, q.tokenizer))
            return _all_of(parts) if q.every else _one_of(parts)
        if isinstance(q, (ast.Phrase, ast.PhrasePrefix)):
            return _all_of(held(q.field, self.terms_of(q.field, q.text, getattr(q, "tokenizer", None))))
        if isinstance(q, ast.Near):
            return _all_of([self._side_needs(q.field, q.left), self._side_needs(q.field, q.right)])
        if isinstance(q, ast.Boolean):
            if q.must:
                return _all_of([self.needs(x) for x in q.must])
            return None if q.minimum_should_match == 0 else _one_of([self.needs(x) for x in q.should])
        if isinstance(q, ast.DisMax):
            return _one_of([self.needs(x) for x in q.clauses])
        if isinstance(q, ast.Terms):
            return _one_of([self.index.may_hold(f, t) for f, t in q.pairs])
        if isinstance(q, ast.MoreLikeThis):
            return _one_of([self.index.may_hold(f, t) for f, t, _ in self.index.telling_terms(q)])
        if isinstance(q, ast.Parse):
            return self.needs(self.tree(q))
        if isinstance(q, (ast.Where, ast.Range, ast.Exists)):
            return self.compile(q)[0]
        return None

    def _side_needs(self, field: str, side) -> Column | None:
        if isinstance(side, ast.Near):
            return self.needs(side)
        if isinstance(side, (tuple, list)):
            return _one_of([self._side_needs(field, x) for x in side])
        return None if len(side) > 1 and side[0] == side[-1] == "/" else self.index.may_hold(field, side)

    # -- terms that every matching row holds one of -----------------------------------------------

    def seeds(self, q: ast.Query) -> list[tuple[str, tuple[str, ...]]] | None:
        """(field, terms) pairs: every matching row holds one of these terms. None: nothing is known.

        Where several sets would do (all words of a phrase, all must clauses), the one with the fewest
        postings is taken. Patterns stand for the terms of the dictionary that meet them, up to `EXPANDED`.
        """
        one = lambda f, terms: [(f, tuple(dict.fromkeys(terms)))]
        if isinstance(q, (ast.Boost, ast.Const, ast.ScoreFilter)):
            return self.seeds(q.query)
        if isinstance(q, ast.Term):
            return one(q.field, [q.value])
        if isinstance(q, ast.TermSet):
            return one(q.field, q.values)
        if isinstance(q, ast.Match):
            terms = self.terms_of(q.field, q.text, q.tokenizer)
            parts = [self._expanded(q.field, lambda t, v=v: fuzzy_match(t, v, q.distance, q.prefix, q.transpose)) if q.distance else one(q.field, [v]) for v in terms]
            return self._rarest(parts) if q.every and terms else self._union(parts)
        if isinstance(q, ast.Phrase):
            return self._rarest([one(q.field, [t]) for t in self.terms_of(q.field, q.text, q.tokenizer)])
        if isinstance(q, ast.PhrasePrefix):
            terms = self.terms_of(q.field, q.text)
            return self._rarest([one(q.field, [t]) for t in terms[:-1]]) if len(terms) > 1 else None
        if isinstance(q, ast.Regex):
            return self._expanded(q.field, lambda t: t.rlike(f"^(?:{q.pattern})$"))
        if isinstance(q, ast.RegexPhrase):
            return self._rarest([self._expanded(q.field, lambda t, p=p: t.rlike(f"^(?:{p})$")) for p in q.patterns])
        if isinstance(q, ast.Fuzzy):
            return self._expanded(q.field, lambda t: fuzzy_match(t, q.value, q.distance, q.prefix, q.transpose))
        if isinstance(q, ast.Near):
            return self._rarest([self._side_seeds(q.field, q.left), self._side_seeds(q.field, q.right)])
        if isinstance(q, ast.Boolean):
            if q.must:
                return self._rarest([self.seeds(x) for x in q.must])
            return None if q.minimum_should_match == 0 or not q.should else self._union([self.seeds(x) for x in q.should])
        if isinstance(q, ast.DisMax):
            return self._union([self.seeds(x) for x in q.clauses]) if q.clauses else None
        if isinstance(q, ast.MoreLikeThis):
            return [(f, (t,)) for f, t, _ in self.index.telling_terms(q)]
        if isinstance(q, ast.Terms):
            return [(f, (t,)) for f, t in q.pairs]
        if isinstance(q, ast.Parse):
            return self.seeds(self.tree(q))
        return None

    def _side_seeds(self, field: str, side):
        if isinstance(side, ast.Near):
            return self.seeds(side)
        if isinstance(side, (tuple, list)):
            return self._union([self._side_seeds(field, x) for x in side])
        if len(side) > 1 and side[0] == side[-1] == "/":
            return self._expanded(field, lambda t: t.rlike(f"^(?:{side[1:-1]})$"))
        return [(field, (side,))]

    def _expanded(self, field: str, test):
        terms = self.index.expand(field, test, EXPANDED + 1)
        return [(field, tuple(terms))] if len(terms) <= EXPANDED else None

    @staticmethod
    def _union(parts: list):
        return [x for p in parts for x in p] if all(p is not None for p in parts) else None

    def _rarest(self, parts: list):
        known = [p for p in parts if p is not None]
        for f, terms in [x for p in known for x in p]:
            self.index.doc_frequencies(f, list(terms))
        return min(known, key=lambda p: sum(self.index.doc_frequency(f, t) for f, terms in p for t in terms), default=None)

    # -- nodes --------------------------------------------------------------------------------

    def compile(self, q: ast.Query) -> tuple[Column, Column]:
        """(match, score) of a node; the score is 0 where the node doesn't match."""
        match, score = getattr(self, f"_{type(q).__name__.lower()}")(q)
        return match, F.when(F.coalesce(match, F.lit(False)), score).otherwise(0.0)

    def guard(self, field: str, match: Column) -> Column:
        """Null where the field is null, so that NOT leaves such rows out."""
        return F.when(self.tokens(field).isNotNull(), match)

    def _all(self, q):
        return F.lit(True), F.lit(1.0)

    def _empty(self, q):
        return F.lit(False), F.lit(0.0)

    def _term(self, q):
        match, score = self.term(q.field, q.value)
        return self.guard(q.field, match), score

    def _termset(self, q):
        return self.guard(q.field, F.exists(self.tokens(q.field), lambda t: t["term"].isin(*q.values)) if q.values else F.lit(False)), F.lit(1.0)

    def _terms(self, q):
        if not q.pairs:
            return F.lit(False), F.lit(1.0)
        return _any([F.coalesce(self._termset(ast.TermSet(f, (v,)))[0], F.lit(False)) for f, v in q.pairs]), F.lit(1.0)

    def _match(self, q):
        terms = self.terms_of(q.field, q.text, q.tokenizer)
        if q.every:
            terms = list(dict.fromkeys(terms))
        if not terms:
            return F.lit(False), F.lit(0.0)
        if q.distance:
            hits = [self.fuzzy(q.field, v, q) for v in terms]
            parts = [(h, F.when(h, 1.0).otherwise(0.0)) for h in hits]
        else:
            parts = [self.term(q.field, v) for v in terms]
        match = (_every if q.every else _any)([m for m, _ in parts])
        return self.guard(q.field, match), _sum([s for _, s in parts])

    def _phrase(self, q):
        terms = self.terms_of(q.field, q.text, q.tokenizer)
        if not terms:
            return F.lit(False), F.lit(0.0)
        if len(terms) == 1:
            return self._term(ast.Term(q.field, terms[0]))
        match, times = self.sequence(q.field, [lambda t, v=v: t == v for v in terms], q.slop)
        return self.guard(q.field, match), self.bm25(q.field, times, sum(self.idf(q.field, v) for v in terms))

    def _phraseprefix(self, q):
        terms = self.terms_of(q.field, q.text)
        if not terms:
            return F.lit(False), F.lit(0.0)
        last = self.index.expand(q.field, lambda t: t.startswith(terms[-1]), q.max_expansions)
        if not last:
            return F.lit(False), F.lit(0.0)
        match, times = self.sequence(q.field, [*(lambda t, v=v: t == v for v in terms[:-1]), lambda t: t.isin(*last)], 0)
        return self.guard(q.field, match), F.when(times > 0, 1.0).otherwise(0.0)

    def _regex(self, q):
        return self.guard(q.field, F.exists(self.tokens(q.field), lambda t: t["term"].rlike(f"^(?:{q.pattern})$"))), F.lit(1.0)

    def _regexphrase(self, q):
        match, _ = self.sequence(q.field, [self.pattern(q.field, p, q.max_expansions, True) for p in q.patterns], q.slop)
        return self.guard(q.field, match), F.lit(1.0)

    def fuzzy(self, field: str, value: str, q) -> Column:
        return F.exists(self.tokens(field), lambda t: fuzzy_match(t["term"], value, q.distance, q.prefix, q.transpose))

    def _fuzzy(self, q):
        if q.distance not in (0, 1, 2):
            raise ValueError("the distance is 0, 1 or 2")
        return self.guard(q.field, self.fuzzy(q.field, q.value, q)), F.lit(1.0)

    def near_places(self, field: str, side, nested: str | None = None, limit: int | None = None) -> Column:
        """Positions that an operand offers; an inner Near offers both ends, or the inner one when nested deeper."""
        if isinstance(side, ast.Near):
            left, right = self.near_places(field, side.left, "left", side.max_expansions), self.near_places(field, side.right, "right", side.max_expansions)
            lefts = F.filter(left, lambda a: F.exists(right, lambda b: self.close(a, b, side)))
            rights = F.filter(right, lambda b: F.exists(left, lambda a: self.close(a, b, side)))
            return {"left": rights, "right": lefts}.get(nested, F.array_sort(F.array_union(lefts, rights)))
        if isinstance(side, (tuple, list)):
            return F.array_sort(F.flatten(F.array(*[self.near_places(field, x, limit=limit) for x in side])))
        if len(side) > 1 and side[0] == side[-1] == "/":
            return self.places(field, self.pattern(field, side[1:-1], limit, False))
        return self.places(field, lambda t: t == side)

    @staticmethod
    def close(a: Column, b: Column, q: ast.Near) -> Column:
        return ((b >= a) & (b - a <= q.distance + 1)) if q.ordered else F.abs(b - a) <= q.distance + 1

    def near_terms(self, side) -> list[str]:
        if isinstance(side, ast.Near):
            return self.near_terms(side.left) + self.near_terms(side.right)
        if isinstance(side, (tuple, list)):
            return [t for x in side for t in self.near_terms(x)]
        return [] if side[:1] == "/" else [side]

    def _near(self, q):
        left, right = self.near_places(q.field, q.left, limit=q.max_expansions), self.near_places(q.field, q.right, limit=q.max_expansions)
        found = F.filter(left, lambda a: F.exists(right, lambda b: self.close(a, b, q)))
        idf = sum(self.idf(q.field, t) for t in self.near_terms(q)) or 1.0
        return self.guard(q.field, F.size(found) > 0), self.bm25(q.field, F.size(found), idf)

    def _exists(self, q):
        return F.col(q.column).isNotNull(), F.lit(1.0)

    def _where(self, q):
        return F.expr(q.sql), F.lit(1.0)

    def _range(self, q):
        c, parts = F.col(q.column), []
        if q.low is not None:
            parts.append(c >= F.lit(q.low) if q.low_inclusive else c > F.lit(q.low))
        if q.high is not None:
            parts.append(c <= F.lit(q.high) if q.high_inclusive else c < F.lit(q.high))
        return _every(parts) if parts else c.isNotNull(), F.lit(1.0)

    def _rangeterm(self, q):
        from skerry.functions import ranges

        row = F.col(q.column)
        if q.relation == "term":
            return ranges.holds(row, F.lit(q.value)), F.lit(1.0)
        query = ranges.make(F.lit(q.low), F.lit(q.high), F.lit(q.low_inclusive), F.lit(q.high_inclusive))
        if q.relation not in ("intersects", "contains", "within"):
            raise ValueError(f"unknown relation {q.relation!r}")
        return {"intersects": ranges.intersects(row, query), "contains": ranges.inside(row, query), "within": ranges.inside(query, row)}[q.relation], F.lit(1.0)

    def _boolean(self, q):
        must, should, no = ([self.compile(x) for x in part] for part in (q.must, q.should, q.must_not))
        if not must and not should:
            return F.lit(False), F.lit(0.0)
        least = q.minimum_should_match if q.minimum_should_match is not None else (0 if must else 1)
        held = [m for m, _ in must]
        if should and least > 0:
            held.append(_any([m for m, _ in should]) if least == 1 else _sum([F.when(F.coalesce(m, F.lit(False)), 1).otherwise(0) for m, _ in should]) >= least)
        elif least > len(should):
            return F.lit(False), F.lit(0.0)
        match = _every([*held, *(~m for m, _ in no)]) if held or no else F.lit(True)
        return match, _sum([s for _, s in [*must, *should]])

    def _dismax(self, q):
        parts = [self.compile(x) for x in q.clauses]
        if not parts:
            return F.lit(False), F.lit(0.0)
        scores = [s for _, s in parts]
        best = F.greatest(*scores) if len(scores) > 1 else scores[0]
        return _any([m for m, _ in parts]), best + F.lit(q.tie) * (_sum(scores) - best)

    def _boost(self, q):
        if not -2048 <= q.factor <= 2048:
            raise ValueError("a boost lies between -2048 and 2048")
        match, score = self.compile(q.query)
        return match, score * F.lit(float(q.factor))

    def _const(self, q):
        return self.compile(q.query)[0], F.lit(float(q.score))

    def _scorefilter(self, q):
        match, score = self.compile(q.query)
        inside = [_every([*([score > low] if low is not None else []), *([score < high] if high is not None else []), F.lit(True)]) for low, high in q.bounds]
        return match & _any(inside), score

    def _morelikethis(self, q):
        terms = self.index.telling_terms(q)
        if not terms:
            return F.lit(False), F.lit(0.0)
        parts = [(f, *self.term(f, t), 1.0 if q.boost_factor is None else q.boost_factor * w / terms[0][2]) for f, t, w in terms]
        held = [self.guard(f, m) for f, m, _, _ in parts]
        match = _any(held) if isinstance(q.field, str) else _any([F.coalesce(m, F.lit(False)) for m in held])
        return match, _sum([s if w == 1.0 else s * w for _, _, s, w in parts])

    def tree(self, q: ast.Parse) -> ast.Query:
        """The nodes of a query string."""
        names = list(self.index.fields)
        known = set(names) | set(self.index.df.columns)
        return parser.parse(q.text, [q.field] if q.field else names, q.lenient, q.conjunction, known)

    def _parse(self, q):
        return self.compile(self.tree(q))
