"""License scans, quality rules and sharding against plain Python."""

import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skerry.llm import license_scan, quality_rules, sharding

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def base_scan(text):
    words = WORD.findall((text or "").translate(LOWER))
    at = [(i, label) for p, label in BASE.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))


LICENCES = ["All Rights Reserved. all rights reserved, CC-BY cc by cc by", "GNU General Public License version 3", "gnu general public LICENSE, version 2!", "all rights, reserved all rights", "cc", "cc by",
            "Permission is hereby granted, free of charge, to any one person obtaining a copy of this software and associated documentation files", "general public licence"]


def test_license_scan(make, odd):
    for docs in (make(LICENCES), odd, make(LICENCES).limit(0)):
        got = Counter(tuple(r)[:6] for r in license_scan.scan_digest(docs).collect())
        assert got == Counter((r.doc_id, *base_scan(r.text)) for r in docs.collect())
    rows = {r.doc_id: r for r in license_scan.scan_digest(make(LICENCES)).collect()}
    assert rows[1].labels == "gpl,gpl-3.0" and rows[2].labels == "gpl,gpl-2.0"
    assert rows[6].labels == "mit" and 0.8 <= rows[6].score < 1, "an inserted word leaves neighbouring diagonals"
    assert rows[7].labels == "" and rows[7].score == 0


def test_whole_licence_texts(make):
    texts = []
    for _, text in license_scan.WHOLE:
        words = license_scan.words_of(text)
        texts += ["Some words first. " + " ".join(words) + " and some after", " ".join(w for i, w in enumerate(words) if i % 20 != 7), " ".join(words[: len(words) // 2])]
    rows = {r.doc_id: r for r in license_scan.scan_digest(make(texts + [f"the quick {i} brown" for i in range(300)])).collect()}
    for k, (label, _) in enumerate(license_scan.WHOLE):
        assert label in rows[3 * k].labels.split(",") and rows[3 * k].score == 1, label
        assert label in rows[3 * k + 1].labels.split(","), "missing words leave neighbouring diagonals"
        assert label not in rows[3 * k + 2].labels.split(","), "half a text is not the whole"
    assert all(rows[i].labels == "" for i in range(3 * len(license_scan.WHOLE), len(rows)))


def rules(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    at = {i + o for i, g in enumerate(zip(words, words[1:], words[2:], strict=False)) if grams[g] > 1 for o in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(at)


def test_quality_features(make, odd):
    texts = ["a b c a b c a", "x\nx\n \n\nx", "## a|b <c> &&", "one two", "a a a a a", " ".join(["once upon a time"] * 40)]
    for docs in (make(texts), odd, odd.limit(0)):
        out = quality_rules.quality_rules(docs)
        got = {(r.id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words): r.base_failed for r in out.collect()}
        want = {(r.doc_id, *rules(r.text)) for r in docs.collect()}
        assert set(got) == want
        assert all(failed == (k[1] < 50 or 100 * k[5] > 50 * k[1]) for k, failed in got.items())


def brute_kept(rows, min_docs=10, max_share=0.005, min_left=0.4):
    """(removed words, text without frequent lines, kept) of each row, by counting."""
    norm = lambda x: re.sub(r"[\x20\x09-\x0D]+", " ", x).strip(" ").lower()
    lines = [[x for x in (r.text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)] for r in rows]
    hosts = Counter(r.source for r in rows)
    held = Counter((r.source, x) for r, ls in zip(rows, lines, strict=True) for x in {norm(x) for x in ls})
    over = {k for k, n in held.items() if n >= min_docs and n > max_share * hosts[k[0]]}
    out = []
    for r, ls in zip(rows, lines, strict=True):
        n_words, *_, repeats = rules(r.text)
        gone = sum(len(x.split()) for x in ls if (r.source, norm(x)) in over)
        left = "\n".join(x for x in (r.text or "").split("\n") if (r.source, norm(x)) not in over) if gone else r.text
        out.append((gone, left, not (n_words < 50 or 100 * repeats > 50 * n_words) and n_words - gone >= min_left * n_words))
    return out


@pytest.mark.parametrize("few", [quality_rules.FEW, 1])
def test_frequent_lines_and_depleted_documents(make, odd, monkeypatch, few):
    """All documents count, copies too, and none keeps a line; with `few` 0, light and heavy lines are joined apart."""
    monkeypatch.setattr(quality_rules, "HEAVY", 12)
    common = " ".join(f"Share{i}" for i in range(60))
    own = lambda k: "\n\n  " + " ".join(f"own{k}x{i}" for i in range(80)) + "\t\n"
    texts = [common + own(k) + f" {common.upper()}  \n" for k in range(12)] + [common + "\ntail"] * 3 + [own(k) for k in range(20, 24)] + [own(9)] * 40 + [own(30)] * 9 + [f"twelve{k} hold\nthe same short line" for k in range(12)]
    docs = make(texts, sources=["h"] * 19 + ["copies"] * 49 + [None] * 12).union(odd)
    rows = docs.collect()
    want = brute_kept(rows)
    got = quality_rules.quality_rules(docs, few=few).collect()
    assert Counter((r.id, r.removed_words, r.kept) for r in got) == Counter((r.doc_id, gone, kept) for r, (gone, _, kept) in zip(rows, want, strict=True))
    assert sum(gone > 0 for gone, _, _ in want) > 60 and not any(kept for _, _, kept in want[19:59]), "40 exact copies are boilerplate"
    for broadcast in (500_000, 0):
        left = quality_rules.filter_documents(docs, few=broadcast)
        assert left.columns == docs.columns
        assert Counter((r.doc_id, r.text) for r in left.collect()) == Counter((r.doc_id, text) for r, (_, text, kept) in zip(rows, want, strict=True) if kept)
    assert all(r.n_chars == len(r.text) for r in left.where("source = 'h'").collect())
    clash = docs.withColumns({"_k1": F.lit("a"), "_gone": F.lit("b"), "_kept": F.lit("c"), "host": F.lit("d"), "at": F.lit(1)})
    assert quality_rules.filter_documents(clash).columns == clash.columns
    assert quality_rules.filter_documents(docs.limit(0)).collect() == []


def check_shards(docs, rows, shards=8):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def loads(rows, shards=8):
    return [sum(r.size for r in rows if r.shard == s) for s in range(shards)]


def parted(rows):
    """Texts (by checksum) that stand in more than one shard."""
    return {k for k, n in Counter(k for k, _ in {(r.text_crc32, r.shard) for r in rows}).items() if n > 1}


@pytest.mark.parametrize("range_rows", [20_000, 100])
def test_sharding(make, odd, range_rows):
    check_shards(odd, sharding.shard_records(odd).collect())
    assert sharding.shard_records(odd.limit(0)).collect() == []
    texts = [f"text {i % 700} " + "y" * (i % 700 * 37 % 400) for i in range(2100)] + ["hot text " * 20] * 1500 + ["warm text " * 20] * 150
    rows = sharding.shard_records(make(texts), range_rows=range_rows).collect()
    check_shards(make(texts), rows)
    assert max(loads(rows)) - min(loads(rows)) <= sum(r.size for r in rows) / 8 / 16
    assert parted(rows) == {zlib.crc32(b"hot text " * 20)}, "only the group that fits in no shard is parted"


def test_groups_of_copies_stay_whole_beside_a_hot_text(make):
    """6,000 groups of two share the order with a text that has a third of all bytes."""
    texts = [f"pair {i // 2} of two" for i in range(12_000)] + ["pair hot of two"] * 6000
    rows = sharding.shard_records(make(texts), range_rows=500).collect()
    check_shards(make(texts), rows)
    assert parted(rows) == {zlib.crc32(b"pair hot of two")}
    assert max(loads(rows)) - min(loads(rows)) <= sum(loads(rows)) / 8 / 32


def test_a_group_that_fits_is_not_parted():
    pieces, room = sharding.plan([(1, 90), (2, 60), (3, 250), (4, 40)], 800, 8)
    assert Counter(k for k, *_ in pieces) == {1: 1, 2: 1, 3: 3, 4: 1}
    assert sum(room) == 800 - 440 and all(x >= 0 for x in room)
    assert sharding.plan([], 0, 8) == ([], [0] * 8)


@pytest.mark.parametrize("ids", [[7] * 600, [None] * 600, list(range(600))])
def test_identical_rows_are_placed_apart_and_written_once(make, tmp_path, spark, ids):
    docs = make(["the same text"] * 600, ids=ids).withColumn("shard", F.lit("own"))
    rows = sharding.shard_records(docs).collect()
    check_shards(docs, rows)
    assert max(loads(rows)) - min(loads(rows)) <= 2 * 14
    name = sharding.write_shards(docs, f"{tmp_path}/out", files=2)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert name == "shard_" and back.columns == [*docs.columns, "shard_"]
    assert back.count() == 600 and back.where("shard = 'own'").count() == 600
    assert sorted(r["count"] for r in back.groupBy("shard_").count().collect()) == [75] * 8


def test_written_shards(odd, tmp_path, spark):
    sharding.write_shards(odd, f"{tmp_path}/out", shards=4, files=2)
    back = spark.read.parquet(f"{tmp_path}/out")
    key = lambda r: repr((r.doc_id, r.text, r.lang, r.source))
    assert sorted(map(key, back.collect())) == sorted(map(key, odd.collect()))


@pytest.mark.parametrize("phrase", list(BASE))
def test_base_phrases_seed_every_pair(phrase):
    rows = [r for r in license_scan.template_positions() if r[2] and r[7] == phrase.split()[0] and r[8] == phrase.split()[1]]
    assert rows
