"""Language identification and the quality classifier: rules, held-out accuracy, odd rows."""

import os
import random
import zlib

import numpy as np
import pytest

from skerry.llm import language_id, quality_classifier
from skerry.llm.text_arrays import pieces, words_of_each

SF = "/root/testdata/sf0.01"


def longest(sample, text):
    """Phrases of a greedy parse by plain search."""
    n, at = 0, 0
    while at < len(text):
        k = 1
        while at + k < len(text) and text[at : at + k + 1] in sample:
            k += 1
        at += k
        n += 1
    return n


def test_parse_is_the_greedy_longest_match():
    rng = random.Random(1)
    samples = tuple((name, "".join(rng.choice(letters) for _ in range(400))) for name, letters in (("aa", "abc "), ("bb", "bcd ")))
    p = language_id.Parser(samples)
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randint(1, 90))) for _ in range(50)]
    plain = [" ".join(x.split()) + " " * x.endswith(" ") for _, x in samples]
    chars, totals = p.parse(texts)
    for text, n, row in zip(texts, chars, totals, strict=True):
        if text.strip():
            folded = " ".join(text.split()) + " " * text.endswith(" ")
            assert n == len(folded)
            assert [longest(x, folded) for x in plain] == row.tolist()


@pytest.mark.parametrize("block, lanes, dense", [(1024, 16384, 24 << 20), (16, 16384, 0), (7, 1, 24 << 20), (64, 600, 0)])
def test_parse_of_long_texts_is_the_greedy_longest_match(monkeypatch, block, lanes, dense):
    monkeypatch.setattr(language_id, "DENSE", dense)
    monkeypatch.setattr(language_id, "BLOCK", block)
    monkeypatch.setattr(language_id, "LANES", lanes)
    rng = random.Random(2)
    samples = tuple((name, "".join(rng.choice(letters) for _ in range(900))) for name, letters in (("aa", "abc"), ("bb", "bcdé"), ("cc", "日本語abc")))
    p = language_id.Parser(samples)
    texts = ["".join(rng.choice("abcdé日x") for _ in range(rng.randint(1, 5000))) for _ in range(6)]
    texts += ["".join(x[k : k + rng.randint(1, 400)] for k in (rng.randrange(900) for _ in range(30)) for x in [rng.choice(samples)[1]]) for _ in range(6)]
    texts += [samples[0][1] * 3, "a" * 3000, "", "q" * 50]
    chars, totals = p.parse(texts)
    assert chars.tolist() == [len(x) for x in texts]
    assert totals.tolist() == [[longest(x, text) for _, x in samples] for text in texts]


def test_languages_with_many_letters_are_told_apart(spark):
    rng = random.Random(8)
    letters = {"zx": [chr(0x4E00 + i) for i in range(500)], "jx": [chr(0x4E00 + i) for i in range(250, 750)], "aa": "abcdefghij", "bb": "abcdefghij", "cc": "klmnopqrst", "rr": "абвгдежзий"}
    words = {k: ["".join(rng.choice(v) for _ in range(rng.randint(1, 4))) for _ in range(300)] for k, v in letters.items()}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(60)), k) for i, k in enumerate(list(letters) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [(r.lang_pred, rows[r.doc_id][2]) for r in language_id.language_id(docs, language_id.fit(docs)).where("held_out").collect()]
    for k in letters:
        assert np.mean([a == b for a, b in got if b == k]) > 0.95, k


def test_every_language_is_learnt_and_bounds_hold(make):
    langs = [f"l{k:03}" for k in range(90)]
    docs = make([f"{k}word and more {k}s of it" + " long" * (3000 if i % 7 == 0 else 0) for i, k in enumerate(langs * 2)], langs=langs * 2)
    samples = language_id.fit(docs, lang_chars=100, short=50)
    assert len(samples) > 80 and all(len(t) <= 150 for _, t in samples)


def test_languages_of_odd_rows(odd, make):
    samples = language_id.fit(odd)
    assert {x for x, _ in samples} <= {"en", "fr", "de"}
    rows = language_id.language_id(odd, samples).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if r.doc_id in (0, 1, 2, 3, None))
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert language_id.fit(odd.limit(0)) == ()
    assert {r.lang_pred for r in language_id.language_id(odd, ()).collect()} == {"und"}


def test_a_long_text_is_parsed_whole():
    p = language_id.Parser((("xx", "abab"), ("yy", "cdcd")))
    tail = "ab" * 10 + "cd" * 200_000
    assert p.predict([tail, "ab"])[0] == ["yy", "xx"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language_id.language_id(docs, language_id.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_classifier.classify(docs, quality_classifier.fit(docs, labels)).where("held_out").join(labels, "doc_id").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert np.mean([r.predicted for r in good]) > 0.97 and np.mean([r.predicted for r in bad]) < 0.2
    assert all(r.predicted == (r.score >= 0.3) for r in rows)


def test_quality_of_odd_rows(odd, spark):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (7, 1, None), (9, None, 1), (None, 1, 1), (8, 0, 0), (6, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality_classifier.classify(odd, quality_classifier.fit(odd, labels)).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    kept = quality_classifier.classify(odd, quality_classifier.Model(constant=1.0), keep=True)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    for empty in (labels.limit(0), labels.where("quality = 1")):
        model = quality_classifier.fit(odd, empty)
        assert model.constant in (0.5, 1.0)
    assert quality_classifier.classify(odd.limit(0), quality_classifier.fit(odd.limit(0), labels)).collect() == []


def test_pieces_of_long_texts_keep_the_words():
    text = " ".join(f"w{i}" for i in range(5000))
    assert "".join(pieces(text, 100)) == text
    whole = next(words_of_each([text]))
    assert len(whole) == 5000 and len(set(whole.tolist())) == 5000
    assert [len(x) for x in words_of_each([None, "", "a b", "!!"])] == [0, 0, 2, 0]
