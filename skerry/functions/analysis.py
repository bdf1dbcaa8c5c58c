"""Analyzers: tokenizers and token filters as Spark columns.

An analysed text is array<struct<term: string, pos: int>>. Filters drop or change terms and never
renumber positions, so removed stop words leave gaps. Letters and digits are told by their Unicode
properties in every script. A null text stays null.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from skerry.functions.stemming import STEMMERS, stem_terms

WORD = r"[\p{L}\p{N}]+"
IDEOGRAPH = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}"
#: Letters (with their marks) but those of scripts written without blanks; joints that keep letters, and digits, together.
_LETTER = r"[\p{L}\p{M}&&[^\p{IsHan}\p{IsHiragana}\p{IsKatakana}]]"
_LETTERS, _DIGITS = rf"{_LETTER}++(?:['’.:·]{_LETTER}++)*+", r"\p{N}++(?:[.,;'’]\p{N}++)*+"
UNICODE_WORD = rf"[\p{{IsHan}}\p{{IsHiragana}}]|(?<!_)_*+(?:(?:{_LETTERS}|{_DIGITS}|\p{{IsKatakana}}++)_*+)++"


def _numbered(terms: Column) -> Column:
    return F.transform(terms, lambda t, i: F.struct(t.alias("term"), i.alias("pos")))


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def simple(text: Column) -> Column:
    """Runs of letters and digits."""
    return _numbered(_all(text, WORD))


def unicode_words(text: Column) -> Column:
    """Words by Unicode's default rules: a joint (apostrophe, point, ...) inside letters or digits and any underscore keep a word whole; ideographs and hiragana stand alone."""
    return _numbered(_all(text, UNICODE_WORD))


def icu(language: str = "en", country: str = "") -> Callable[[Column], Column]:
    """Words at the word breaks of a locale."""
    return lambda text: _numbered(F.flatten(F.sentences(text, F.lit(language), F.lit(country))))


def whitespace(text: Column) -> Column:
    """What stands between blanks."""
    return _numbered(F.filter(F.split(text, r"[ \t\n\r\f\x0B]+", -1), lambda t: t != ""))


def literal(text: Column) -> Column:
    """The whole value."""
    return F.when(text.isNotNull(), _numbered(F.array(text)))


def ngram(low: int, high: int, prefix_only: bool = False) -> Callable[[Column], Column]:
    """Character n-grams of the whole text, by start and then by length."""

    def make(text: Column) -> Column:
        n = F.length(text)
        starts = F.array(F.lit(0)) if prefix_only else F.when(n >= low, F.sequence(F.lit(0), n - low)).otherwise(F.array().cast("array<int>"))
        grams = F.flatten(F.transform(starts, lambda s: F.transform(F.sequence(F.lit(low), F.lit(high)), lambda k: F.when(s + k <= n, F.substring(text, s + 1, k)))))
        return F.when(text.isNotNull(), _numbered(F.filter(grams, lambda g: g.isNotNull())))

    return make


def edge_ngram(low: int, high: int) -> Callable[[Column], Column]:
    """Prefixes of each word; words shorter than `low` give none."""

    def make(text: Column) -> Column:
        words = F.filter(_all(text, WORD), lambda w: F.length(w) >= low)
        return _numbered(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(low), F.least(F.lit(high), F.length(w))), lambda k: F.substring(w, 1, k)))))

    return make


def regex_pattern(pattern: str) -> Callable[[Column], Column]:
    """The matches of a regular expression."""
    return lambda text: _numbered(_all(text, pattern))


def source_code(text: Column) -> Column:
    """Splits at punctuation, underscores and changes of case."""
    parted = F.regexp_replace(F.regexp_replace(text, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2"), r"(\p{Lu}+)(\p{Lu}\p{Ll})", "$1 $2")
    return _numbered(_all(parted, WORD))


def chinese_compatible(text: Column) -> Column:
    """Each ideograph is a token; other runs of letters and digits stay whole."""
    return _numbered(_all(text, rf"[{IDEOGRAPH}]|[\p{{L}}\p{{N}}&&[^{IDEOGRAPH}]]+"))


TOKENIZERS: dict[str, Callable[..., Callable[[Column], Column]]] = {
    "simple": lambda: simple, "unicode_words": lambda: unicode_words, "whitespace": lambda: whitespace, "literal": lambda: literal, "literal_normalized": lambda: literal,
    "ngram": ngram, "edge_ngram": edge_ngram, "regex_pattern": regex_pattern, "source_code": lambda: source_code, "chinese_compatible": lambda: chinese_compatible, "icu": icu,
    "raw": lambda: literal, "keyword": lambda: literal,
}

#: Languages whose stop words come with Spark.
SPARK_LANGUAGES = ("danish", "dutch", "finnish", "hungarian", "italian", "norwegian", "portuguese", "russian", "swedish", "turkish")

#: Stop words of the languages in the test tables.
STOPWORDS: dict[str, Sequence[str]] = {
    "english": "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split(),
    "french": "au aux avec ce ces dans de des du elle en et eux il je la le les leur lui ma mais me ne nos notre nous on ou par pas pour que qui sa se ses son sur ta te tes un une vos votre vous".split(),
    "german": "aber als am an auch auf aus bei bin bis das dass dem den der des die doch du ein eine einem einen einer er es für hat ich ihr im in ist mit nicht noch nur oder sich sie sind so um und von war was wie wir zu zum zur".split(),
    "spanish": "al como con de del el en es la las lo los más no o para pero por que se si sin son su sus un una y ya".split(),
}


def stop_words(language: str) -> Sequence[str]:
    """The stop words of a language: those above, or the lists that come with Spark (these need a session)."""
    if language in STOPWORDS:
        return STOPWORDS[language]
    from pyspark.ml.feature import StopWordsRemover

    if language not in SPARK_LANGUAGES:
        raise ValueError(f"no stop words for {language!r}")
    return StopWordsRemover.loadDefaultStopWords(language)


#: Letters that no decomposition takes apart.
APART = {"ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "TH", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ł": "l", "Ł": "L", "ħ": "h", "Ħ": "H", "ŧ": "t", "Ŧ": "T", "ı": "i"}


@lru_cache
def _foldings() -> tuple[str, str, dict[str, str]]:
    """(characters, their ASCII characters, longer replacements), from Unicode's compatibility decompositions."""
    one, longer = {}, {k: v for k, v in APART.items() if len(v) > 1}
    one |= {k: v for k, v in APART.items() if len(v) == 1}
    for o in [*range(0xA0, 0x250), *range(0x1E00, 0x2070), *range(0x2150, 0x2190), *range(0x2460, 0x24FF), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]:
        c = chr(o)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if c not in APART and plain.isascii() and plain.isalnum():
            (one if len(plain) == 1 else longer)[c] = plain
    return "".join(one), "".join(one.values()), longer


def ascii_fold(term: Column) -> Column:
    """Letters and digits without their marks, in ASCII where they have such a form."""
    marked, plain, longer = _foldings()
    folded = F.translate(term, marked, plain)
    many = folded
    for c, to in longer.items():
        many = F.replace(many, F.lit(c), F.lit(to))
    return F.when(folded.rlike("[" + "".join(longer) + "]"), many).otherwise(folded)


@dataclass(frozen=True)
class Analyzer:
    """A tokenizer with token filters, applied in one fixed order.

    The order: length, trim, lower case, stemming, own stop words, folding, letters and digits only,
    the languages' stop words.
    """

    tokenizer: str = "unicode_words"
    options: dict = field(default_factory=dict)
    lowercase: bool = True
    min_bytes: int | None = None
    max_bytes: int | None = None
    trim: bool = False
    stemmer: str | None = None
    stopwords: Sequence[str] = ()
    fold: bool = False
    alnum_only: bool = False
    stopwords_languages: Sequence[str] = ()

    def __post_init__(self):
        if self.tokenizer not in TOKENIZERS:
            raise ValueError(f"unknown tokenizer {self.tokenizer!r}")
        if self.stemmer is not None and self.stemmer not in STEMMERS:
            raise ValueError(f"no stemmer for {self.stemmer!r}")
        for language in self.stopwords_languages:
            if language not in STOPWORDS and language not in SPARK_LANGUAGES:
                raise ValueError(f"no stop words for {language!r}")

    @property
    def lowers(self) -> bool:
        """Whether terms come in lower case; whole raw values never do."""
        return self.lowercase and self.tokenizer not in ("literal", "raw", "keyword")

    def tokens(self, text: Column) -> Column:
        """array<struct<term, pos>> of a text column."""
        return self.filtered(TOKENIZERS[self.tokenizer](**self.options)(text))

    def filtered(self, out: Column) -> Column:
        """Tokens after the token filters."""
        on = lambda a, f: F.transform(a, lambda t: F.struct(f(t["term"]).alias("term"), t["pos"].alias("pos")))
        keep = lambda a, f: F.filter(a, lambda t: f(t["term"]))
        if self.min_bytes is not None:
            out = keep(out, lambda t: F.octet_length(t) >= self.min_bytes)
        if self.max_bytes is not None:
            out = keep(out, lambda t: F.octet_length(t) <= self.max_bytes)
        if self.trim:
            out = keep(on(out, F.trim), lambda t: t != "")
        if self.lowers:
            out = on(out, F.lower)
        if self.stemmer:
            stems = stem_terms(F.transform(out, lambda t: t["term"]), self.stemmer)
            out = F.zip_with(stems, F.transform(out, lambda t: t["pos"]), lambda t, i: F.struct(t.alias("term"), i.alias("pos")))
        if self.stopwords:
            out = keep(out, lambda t: ~t.isin(*self.stopwords))
        if self.fold:
            out = on(out, ascii_fold)
        if self.alnum_only:
            out = keep(out, lambda t: t.rlike("^[0-9A-Za-z]+$"))
        words = sorted({w for language in self.stopwords_languages for w in stop_words(language)})
        return keep(out, lambda t: ~t.isin(*words)) if words else out

    def count(self, text: Column) -> Column:
        """How many tokens a text has (null for null)."""
        drops = self.min_bytes is not None or self.max_bytes is not None or self.trim or self.stopwords or self.alnum_only or self.stopwords_languages
        if self.tokenizer in ("simple", "unicode_words") and not drops:
            return F.regexp_count(text, F.lit(WORD if self.tokenizer == "simple" else UNICODE_WORD))
        return F.when(text.isNotNull(), F.size(self.tokens(text)))

    def terms(self, text: Column) -> Column:
        """array<string> of the terms in order."""
        return F.transform(self.tokens(text), lambda t: t["term"])

    def with_options(self, **changes) -> Analyzer:
        return replace(self, **changes)


DEFAULT = Analyzer()
