"""Query nodes. A tree of them is compiled to a match column and a score column (compile.py)."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, is_dataclass


@dataclass(frozen=True)
class Query:
    """Base of all nodes; `to_json` and `from_json` keep the tree."""

    def to_json(self) -> str:
        return json.dumps(_plain(self))

    @staticmethod
    def from_json(text: str) -> Query:
        return _node(json.loads(text))

    def boost(self, factor: float) -> Query:
        return Boost(self, factor)

    def const(self, score: float) -> Query:
        return Const(self, score)


def _plain(x):
    if isinstance(x, Query):
        return {"node": type(x).__name__} | {f.name: _plain(getattr(x, f.name)) for f in fields(x)}
    return [_plain(y) for y in x] if isinstance(x, (list, tuple)) else x


def _node(x):
    if isinstance(x, dict) and "node" in x:
        kind = NODES.get(x["node"])
        if kind is None:
            raise ValueError(f"unknown query node {x['node']!r}")
        return kind(**{k: _node(v) for k, v in x.items() if k != "node"})
    return tuple(_node(y) for y in x) if isinstance(x, list) else x


@dataclass(frozen=True)
class All(Query):
    """Every row, score 1."""


@dataclass(frozen=True)
class Empty(Query):
    """No row."""


@dataclass(frozen=True)
class Term(Query):
    """A token exactly as given."""

    field: str
    value: str


@dataclass(frozen=True)
class TermSet(Query):
    """Any of some tokens; constant score."""

    field: str
    values: tuple


@dataclass(frozen=True)
class Terms(Query):
    """Any of some tokens, each of its own field: (field, token) pairs; constant score."""

    pairs: tuple


@dataclass(frozen=True)
class Match(Query):
    """The analysed text's tokens, any (each occurrence scores) or all (distinct ones).

    `tokenizer`: analyses the query text instead of the field's own search analyzer.
    """

    field: str
    text: str | tuple
    every: bool = False
    distance: int = 0
    prefix: bool = False
    transpose: bool = True
    tokenizer: str | None = None


@dataclass(frozen=True)
class Phrase(Query):
    """The analysed tokens in order; `slop` is the total displacement allowed, `tokenizer` as in Match."""

    field: str
    text: str | tuple
    slop: int = 0
    tokenizer: str | None = None


@dataclass(frozen=True)
class PhrasePrefix(Query):
    """As Phrase, the last token being a prefix; its first `max_expansions` terms in order count."""

    field: str
    text: str | tuple
    max_expansions: int = 50


@dataclass(frozen=True)
class Regex(Query):
    """A whole token meets the pattern; constant score."""

    field: str
    pattern: str


@dataclass(frozen=True)
class RegexPhrase(Query):
    """Consecutive tokens meet the patterns; a pattern of more than `max_expansions` terms is an error."""

    field: str
    patterns: tuple
    slop: int = 0
    max_expansions: int | None = None


@dataclass(frozen=True)
class Fuzzy(Query):
    """A token within an edit distance of 0 to 2; `transpose` counts a swap of neighbours as one."""

    field: str
    value: str
    distance: int = 2
    prefix: bool = False
    transpose: bool = True


@dataclass(frozen=True)
class Near(Query):
    """Proximity: at most `distance` tokens between left and right; `ordered`: left comes first.

    Each side is a token, a pattern `/.../`, a tuple of alternatives, or another Near. A pattern stands for
    its first `max_expansions` terms in order (None: for all).
    """

    field: str
    left: object
    distance: int
    right: object
    ordered: bool = False
    max_expansions: int | None = None


@dataclass(frozen=True)
class Exists(Query):
    """The column has a value."""

    column: str


@dataclass(frozen=True)
class Where(Query):
    """A plain SQL predicate, which scores 1 like any clause that the index answers."""

    sql: str


@dataclass(frozen=True)
class Range(Query):
    """low..high, each end inclusive or not, None: open."""

    column: str
    low: object = None
    high: object = None
    low_inclusive: bool = True
    high_inclusive: bool = False


@dataclass(frozen=True)
class RangeTerm(Query):
    """Of a range column (struct lower, upper, lower_inc, upper_inc): holds a value, or relates to a range.

    relation: `term` (value), `intersects`, `contains` (the query holds the row), `within` (the row holds the query).
    """

    column: str
    relation: str
    value: object = None
    low: object = None
    high: object = None
    low_inclusive: bool = True
    high_inclusive: bool = False


@dataclass(frozen=True)
class Boolean(Query):
    """must, should and must_not clauses; scores of matching must and should clauses add up."""

    must: tuple = ()
    should: tuple = ()
    must_not: tuple = ()
    minimum_should_match: int | None = None


@dataclass(frozen=True)
class DisMax(Query):
    """The best clause's score, and `tie` times the others'."""

    clauses: tuple
    tie: float = 0.0


@dataclass(frozen=True)
class Boost(Query):
    query: Query
    factor: float


@dataclass(frozen=True)
class Const(Query):
    query: Query
    score: float


@dataclass(frozen=True)
class ScoreFilter(Query):
    """Rows whose score lies in any of the bounds (low, high), each None: open, ends excluded."""

    query: Query
    bounds: tuple


@dataclass(frozen=True)
class MoreLikeThis(Query):
    """Rows that share the most telling terms of a text or of the row with the given key.

    `field` may be several fields; `text` is then a tuple of (field, text) pairs (a document). The best
    `max_query_terms` of all fields count. `boost_factor`: each term's score is multiplied by it and by
    how telling the term is, against the most telling one.
    """

    field: str | tuple
    text: str | tuple | None = None
    key: object = None
    min_doc_frequency: int = 1
    max_doc_frequency: int | None = None
    min_term_frequency: int = 1
    max_query_terms: int = 25
    min_word_length: int = 0
    max_word_length: int | None = None
    stopwords: tuple = ()
    boost_factor: float | None = None


@dataclass(frozen=True)
class Parse(Query):
    """Query-string syntax; `field` is the default field (None: all fields)."""

    text: str
    field: str | None = None
    lenient: bool = False
    conjunction: bool = False


def negate(query: Query) -> Query:
    """NOT query: all rows but those that match (the row itself counts 1)."""
    return Boolean(must=(All(),), must_not=(query,))


NODES = {k.__name__: k for k in list(globals().values()) if is_dataclass(k) and isinstance(k, type)}
