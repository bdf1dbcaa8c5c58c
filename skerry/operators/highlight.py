"""Highlighting: the best fragments of a text with the matched terms tagged, and their byte offsets.

Terms are those of the field's analyzer: the analyzer runs over each word of the text, in the JVM, and
words whose terms are wanted are the ones tagged, so `dogs` is found by the stem `dog`. Fragments run
over the few rows that a top-k query has kept. They are cut at word boundaries, so that each holds at
most `max_chars` characters; the best has the most distinct matched words, then the most matches, then
stands first. Null texts give null (no fragments, no positions).
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from skerry.functions.analysis import DEFAULT, Analyzer

WORD = re.compile(r"[^\W_]+")
START, END, MAX_CHARS, LIMIT = "<b>", "</b>", 150, 5


def surfaces(text: Column, terms: list[str], analyzer: Analyzer = DEFAULT) -> Column:
    """The distinct words of the text, in lower case, that the analyzer turns into one of the terms."""
    words = F.array_distinct(Analyzer(analyzer.tokenizer, analyzer.options, lowercase=False).terms(text))
    tokens = F.transform(words, lambda w, i: F.struct(w.alias("term"), i.alias("pos")))
    held = F.filter(analyzer.filtered(tokens), lambda t: t["term"].isin(*terms))
    return F.array_distinct(F.transform(held, lambda t: F.lower(F.get(words, t["pos"]))))


def _matches(text: str, words) -> list[tuple[int, int, str]]:
    if words is None or not len(words):
        return []
    any_ = "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w)))
    return [(m.start(), m.end(), m[0].lower()) for m in re.finditer(rf"(?i)(?<![^\W_])(?:{any_})(?![^\W_])", text)]


def fragments(text: str, words, max_chars: int = MAX_CHARS) -> list[tuple[int, int, list[tuple[int, int, str]]]]:
    """(start, end, matches) of the fragments with a match, in order of place."""
    hits = _matches(text, words)
    if not hits:
        return []
    found = [(m.start(), m.end()) for m in WORD.finditer(text)]
    cuts, at = [], 0
    while at < len(found):
        end = at
        while end + 1 < len(found) and found[end + 1][1] - found[at][0] <= max_chars:
            end += 1
        cuts.append((found[at][0], found[end][1]))
        at = end + 1
    out, k = [], 0
    for a, b in cuts:
        inside = []
        while k < len(hits) and hits[k][0] < b:
            if a <= hits[k][0] and hits[k][1] <= b:
                inside.append(hits[k])
            k += 1
        if inside:
            out.append((a, b, inside))
    return out


def _ranked(found, by: str):
    return sorted(found, key=lambda f: (-len({h[2] for h in f[2]}), -len(f[2]), f[0])) if by == "score" else found


def _tagged(text: str, fragment, start: str, end: str) -> str:
    a, b, hits = fragment
    out, at = [], a
    for s, e, _ in hits:
        out += [text[at:s], start, text[s:e], end]
        at = e
    return "".join([*out, text[at:b]])


def snippet(text: Column, terms: list[str], start_tag: str = START, end_tag: str = END, max_num_chars: int = MAX_CHARS, analyzer: Analyzer = DEFAULT) -> Column:
    """The best fragment, tagged; null where nothing matches."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, words: pd.Series) -> pd.Series:
        best = [(t, _ranked(fragments(t, w, max_num_chars), "score") if t else []) for t, w in zip(texts, words, strict=True)]
        return pd.Series([_tagged(t, f[0], start_tag, end_tag) if f else None for t, f in best], dtype=object)

    return run(text, surfaces(text, terms, analyzer))


def snippets(text: Column, terms: list[str], start_tag: str = START, end_tag: str = END, max_num_chars: int = MAX_CHARS, limit: int = LIMIT, offset: int = 0, sort_by: str = "score", analyzer: Analyzer = DEFAULT) -> Column:
    """Several fragments, by score or position."""
    if sort_by not in ("score", "position"):
        raise ValueError("sort_by is score or position")

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([[_tagged(t, f, start_tag, end_tag) for f in _ranked(fragments(t, w, max_num_chars), sort_by)[offset : offset + limit]] if t else [] for t, w in zip(texts, words, strict=True)], dtype=object)

    return run(text, surfaces(text, terms, analyzer))


def snippet_positions(text: Column, terms: list[str], analyzer: Analyzer = DEFAULT) -> Column:
    """[start, end) byte offsets of every match."""

    @F.pandas_udf("array<array<int>>")
    def run(texts: pd.Series, words: pd.Series) -> pd.Series:
        return pd.Series([[[len(t[:a].encode()), len(t[:b].encode())] for a, b, _ in _matches(t, w)] if t else [] for t, w in zip(texts, words, strict=True)], dtype=object)

    return run(text, surfaces(text, terms, analyzer))


def highlight(text: Column, terms: list[str], start_tag: str = START, end_tag: str = END, analyzer: Analyzer = DEFAULT) -> Column:
    """The whole text with matched words tagged: in the JVM where the terms are the words in lower case, else fragment by fragment."""
    if analyzer.stemmer or analyzer.fold:

        @F.pandas_udf("string")
        def run(texts: pd.Series, words: pd.Series) -> pd.Series:
            return pd.Series([_tagged(t, (0, len(t), _matches(t, w)), start_tag, end_tag) if t else t for t, w in zip(texts, words, strict=True)], dtype=object)

        return run(text, surfaces(text, terms, analyzer))
    words = "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True))
    return F.regexp_replace(text, rf"(?iu)(?<![\p{{L}}\p{{N}}])({words})(?![\p{{L}}\p{{N}}])", f"{start_tag}$1{end_tag}")
