"""Snowball stemmers (the published algorithms) for English and German, and their use on columns.

Words are stemmed in Arrow batches, each distinct word once: a bounded memo in every worker.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS = "aeiouy"
#: Fixed values of the published algorithm: words with their own stems, and endings with what takes their place.
WHOLE = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
DONE = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP_2 = {
    "ization": "ize", "ational": "ate", "fulness": "ful", "ousness": "ous", "iveness": "ive", "tional": "tion", "biliti": "ble", "lessli": "less", "entli": "ent", "ation": "ate", "alism": "al", "aliti": "al",
    "ousli": "ous", "iviti": "ive", "fulli": "ful", "enci": "ence", "anci": "ance", "abli": "able", "izer": "ize", "ator": "ate", "alli": "al", "bli": "ble", "ogi": "og", "li": "",
}
STEP_3 = {"ational": "ate", "tional": "tion", "alize": "al", "icate": "ic", "iciti": "ic", "ative": "", "ical": "ic", "ness": "", "ful": ""}
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _region(word: str, start: int, vowels: str) -> int:
    """Where the part after the first consonant that follows a vowel begins."""
    for i in range(start + 1, len(word)):
        if word[i] not in vowels and word[i - 1] in vowels:
            return i + 1
    return len(word)


def _ending(word: str, endings) -> str:
    """The longest of the endings that the word has, or nothing."""
    return max((e for e in endings if word.endswith(e)), key=len, default="")


def _short_end(w: str) -> bool:
    """Whether the word ends in a short syllable."""
    if len(w) == 2:
        return w[0] in VOWELS and w[1] not in VOWELS
    return len(w) > 2 and w[-3] not in VOWELS and w[-2] in VOWELS and w[-1] not in VOWELS + "wxY"


@lru_cache(200_000)
def english(word: str) -> str:
    """The stem of a word in lower case."""
    if len(word) < 3:
        return word
    if word in WHOLE:
        return WHOLE[word]
    w = word.replace("’", "'").removeprefix("'")
    w = re.sub("(^|[aeiouy])y", r"\1Y", w)
    first = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = first if first is not None else _region(w, 0, VOWELS)
    r2 = _region(w, r1, VOWELS)
    w = w[: len(w) - len(_ending(w, ("'s'", "'s", "'")))]

    end = _ending(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if end == "sses":
        w = w[:-2]
    elif end in ("ied", "ies"):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif end == "s" and any(c in VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in DONE:
        return w

    end = _ending(w, ("eedly", "ingly", "edly", "eed", "ing", "ed"))
    if end in ("eed", "eedly"):
        if len(w) - len(end) >= r1:
            w = w[: -len(end)] + "ee"
    elif end and any(c in VOWELS for c in w[: -len(end)]):
        w = w[: -len(end)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
            w = w[:-1]
        elif r1 >= len(w) and _short_end(w):
            w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in VOWELS:
        w = w[:-1] + "i"

    end = _ending(w, STEP_2)
    if end and len(w) - len(end) >= r1 and (end != "ogi" or w[-4:-3] == "l") and (end != "li" or w[-3:-2] in tuple("cdeghkmnrt")):
        w = w[: -len(end)] + STEP_2[end]
    end = _ending(w, STEP_3)
    if end and len(w) - len(end) >= (r2 if end == "ative" else r1):
        w = w[: -len(end)] + STEP_3[end]
    end = _ending(w, STEP_4)
    if end and len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(end)]
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


@lru_cache(200_000)
def german(word: str) -> str:
    """The stem of a word in lower case."""
    vowels = "aeiouyäöü"
    w = word.replace("ß", "ss")
    w = re.sub(f"(?<=[{vowels}])([uy])(?=[{vowels}])", lambda m: m[1].upper(), w)
    r1 = _region(w, 0, vowels)
    r2 = _region(w, r1, vowels)
    r1 = max(r1, 3)

    end = _ending(w, ("em", "ern", "er", "e", "en", "es", "s"))
    if end and len(w) - len(end) >= r1 and (end != "s" or w[-2:-1] in tuple("bdfghklmnrt")):
        w = w[: -len(end)]
        if end in ("e", "en", "es") and w.endswith("niss"):
            w = w[:-1]
    end = _ending(w, ("en", "er", "est", "st"))
    if end and len(w) - len(end) >= r1 and (end != "st" or len(w) > 5 and w[-3] in "bdfghklmnt"):
        w = w[: -len(end)]

    inside = lambda e: len(w) - len(e) >= r2
    end = _ending(w, ("end", "ung", "ig", "ik", "isch", "lich", "heit", "keit"))
    if end and inside(end):
        if end in ("end", "ung"):
            w = w[:-3]
            if w.endswith("ig") and inside("ig") and not w.endswith("eig"):
                w = w[:-2]
        elif end in ("ig", "ik", "isch"):
            if not w.endswith("e" + end):
                w = w[: -len(end)]
        elif end in ("lich", "heit"):
            w = w[:-4]
            if w.endswith(("er", "en")) and len(w) - 2 >= r1:
                w = w[:-2]
        else:
            w = w[:-4]
            more = _ending(w, ("lich", "ig"))
            if more and inside(more):
                w = w[: -len(more)]
    return w.translate(str.maketrans("äöüUY", "aouuy"))


STEMMERS = {"english": english, "german": german}


def stem_terms(terms: Column, language: str) -> Column:
    """array<string> of the stems of an array of terms (null for null)."""

    @F.pandas_udf("array<string>")
    def run(lists: pd.Series) -> pd.Series:
        stem = STEMMERS[language]
        return pd.Series([None if x is None else [stem(t) for t in x] for x in lists], dtype=object)

    return run(terms)
