"""The Jaccard join, components, top-k search and mixing against brute force."""

import inspect
import itertools
import os
import random
import re
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from skerry.llm import jaccard_join, mixing, topk_search
from skerry.llm.components import components

SF = "/root/testdata/sf0.001"


def sets_of(texts):
    return [set(jaccard_join.shingles(w).tolist()) for w in jaccard_join.words_of_each(texts)]


def brute(rows, threshold=0.8):
    """(class, links) of each row by all pairs."""
    sets = sets_of([r.text for r in rows])
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [0] * len(rows)
    for a, b in itertools.combinations(range(len(rows)), 2):
        both = len(sets[a] & sets[b])
        same = (rows[a].text or "").strip() != "" and rows[a].text == rows[b].text
        if (sets[a] or sets[b]) and both >= threshold * len(sets[a] | sets[b]) or not sets[a] and not sets[b] and same:
            links[a], links[b] = links[a] + 1, links[b] + 1
            up[max(root(a), root(b))] = min(root(a), root(b))
    heads = {}
    for i, r in enumerate(rows):
        heads.setdefault(root(i), []).append(r.doc_id)
    return [(min((x for x in heads[root(i)] if x is not None), default=None), links[i]) for i in range(len(rows))]


def near_copies(seed=5):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, 8)):
            copy = base[:]
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("how", [{}, {"small": 3, "block": 4}])
def test_links_and_classes_are_those_of_all_pairs(make, how):
    docs = make(near_copies() + ["a b", "A, b!", "a b c", "one two three four five", "!!", "!!", "??"])
    rows = docs.collect()
    got = {r.id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_join(docs, **how).collect()}
    assert got == {r.doc_id: x for r, x in zip(rows, brute(rows), strict=True)}
    kept = jaccard_join.keep_first(docs, **how)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted({x for x, _ in got.values()})


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_test_tables_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    got = {r.id: (r.class_id, r.n_links) for r in jaccard_join.jaccard_join(docs).collect()}
    assert got == {r.doc_id: x for r, x in zip(rows, brute(rows), strict=True)}


def test_joins_of_odd_rows(odd):
    rows = jaccard_join.jaccard_join(odd).collect()
    assert len(rows) == odd.count()
    by = {}
    for r in rows:
        by.setdefault(r.id, []).append((r.class_id, r.n_links))
    assert by[4] == [(4, 1), (4, 1)] and by[7] == [(7, 1), (7, 1)], "identical rows are copies"
    assert by[0] == [(0, 0)] and by[1] == [(1, 0)] and by[None] == [(None, 0)], "null and blank texts have no links"
    assert jaccard_join.jaccard_join(odd.limit(0)).collect() == []
    assert jaccard_join.keep_first(odd).where("doc_id in (4, 7)").count() == 2


def test_runs_reach_the_recall():
    assert 1 - (1 - (1 - np.exp(-1.6)) ** 2) ** jaccard_join.runs_needed() >= 0.99999
    a = np.arange(1, 301, dtype=np.uint64)
    assert abs(np.mean([len(x) for x in jaccard_join.followed(jaccard_join.mix(a), 50, 2, 2.0)]) - 2) < 0.6


@pytest.mark.parametrize("one_task", [0, 1000])
def test_components(spark, one_task):
    rng = random.Random(7)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(200, i) for i in range(201, 230)] + [(5, 5), (None, 3)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            up[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), one_task=one_task).collect()}
    assert got == {x: root(x) for x in up}


def brute_topk(rows, k, every):
    out = []
    for q in rows:
        if q[0] is None or q[0] % every or q[1] is None:
            continue
        a = np.floor(64 * np.array(q[1], dtype=np.float64)).astype(int)
        found = []
        for r in rows:
            if r[0] is not None and r[0] != q[0] and r[1] is not None:
                b = np.floor(64 * np.array(r[1], dtype=np.float64)).astype(int)
                n = min(len(a), len(b))
                found.append((-int(a[:n] @ b[:n]), r[0]))
        out += [(q[0], i + 1, v, -s) for i, (s, v) in enumerate(sorted(found)[:k])]
    return sorted(out)


def test_topk_with_ties_nulls_and_repeats(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in np.float32(rng.integers(-3, 4, 6) / 64 * 1.5)]) for i in range(120)]
    rows += [(3, rows[3][1]), (5, rows[5][1]), (None, [1.0] * 6), (130, None), (140, []), (150, [1.0, 2.0])]
    good = rows[:]
    rows += [(160, [1.0, None, 2.0]), (170, [float("nan")] * 6), (180, [float("inf")] * 6)]
    df = spark.createDataFrame([(a, b, "x", "y", 1) for a, b in rows], "vec_id long, embedding array<float>, id string, w string, rank int")
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 4)
    monkeypatch.setattr(topk_search, "ROW_BLOCK", 30)
    got = sorted(tuple(r) for r in topk_search.topk_search(df, "vec_id % 5 = 0", k=7).collect())
    assert got == brute_topk(good, 7, 5)
    assert topk_search.topk_search(df.limit(0), "true").collect() == []
    few = topk_search.topk_search(df.where("vec_id < 3"), "vec_id = 0").collect()
    assert [r.rank for r in few] == [1, 2], "fewer rows than k"


def test_scores_of_large_weights():
    a = np.array([[1 << 20, -5], [0, 7]], dtype=np.int64)
    assert (topk_search.scores(a, a) == a @ a.T).all()


def test_raking_meets_all_margins():
    rng = np.random.default_rng(2)
    codes = np.array(list(itertools.product(range(4), range(3), range(2)))).T
    tokens = rng.integers(1, 1000, codes.shape[1]).astype(float)
    targets = [rng.dirichlet(np.ones(n)) for n in (4, 3, 2)]
    w = mixing.rake(tokens, codes, targets)
    for code, t in zip(codes, targets, strict=True):
        assert np.allclose(np.bincount(code, weights=w), t, atol=1e-6)
    c = mixing.factor_for(w, tokens, 0.5 * tokens.sum())
    assert np.minimum(tokens, c * w).sum() == pytest.approx(0.5 * tokens.sum())


def test_mixing_both_ways(make):
    rng = random.Random(9)
    texts = [" ".join(["word"] * rng.randint(1, 60)) for _ in range(300)]
    docs = make(texts, langs=[rng.choice(["en", "fr", None]) for _ in texts], sources=[rng.choice(["a", "a", "a", "b", None]) for _ in texts])
    want = {"source": {"a": 0.4, "b": 0.4}, "lang": {"fr": 0.5}}
    here, there = ({r.doc_id: r for r in mixing.mix_sources(docs, want, budget_share=0.5, local_cells=n, tolerance=1e-4).collect()} for n in (1000, 0))
    assert len(here) == 300
    for k, r in here.items():
        assert r.mix_probability == pytest.approx(there[k].mix_probability, abs=5e-3)
    cells = {(r.source, r.lang): r.mix_weight for r in here.values()}
    assert sum(v for (s, _), v in cells.items() if s == "a") == pytest.approx(0.4, abs=1e-3)
    assert sum(v for (_, x), v in cells.items() if x == "fr") == pytest.approx(0.5, abs=1e-3)
    assert sum(r.mix_tokens * r.mix_probability for r in here.values()) == pytest.approx(0.5 * sum(r.mix_tokens for r in here.values()), rel=1e-6)


def test_mixing_of_odd_rows(odd):
    out = mixing.mix_sources(odd)
    rows = out.collect()
    assert len(rows) == odd.count() and len(set(out.columns)) == len(out.columns)
    assert {r.mix_topic for r in rows if r.doc_id in (0, 1, 2)} == {"none"}
    fates = {}
    for r in rows:
        fates.setdefault((r.doc_id, r.text), set()).add(r.mix_kept)
    assert all(len(x) == 1 for x in fates.values())
    assert mixing.mix_sources(odd.limit(0)).collect() == []
    assert out.where(F.col("mix_probability").isNull()).count() == 0


def test_topics_are_shares_and_tokens_are_words(make):
    prose = "some plain words in a row " * 100
    want = {
        prose + "### x " * 5: "prose", prose + "| x " * 5: "prose", prose + "AB CD " * 8: "prose", "if (a) {\n        b = c;\n} <d> = {e};": "code",
        "a\tb\tc\nd\te\tf": "list", "ALL OF THIS IS CAPITALS": "shout", prose + "THE LICENSE": "legal", prose + "All RIGHTS Reserved": "legal", "\n \t\n": "none", prose * 4: "long"}
    docs = make(list(want))
    for keep in (True, False):
        rows = mixing.mix_sources(docs, keep_text=keep)
        assert ("text" in rows.columns) == keep
        got = {r.doc_id: r for r in rows.collect()}
        for k, (text, topic) in enumerate(want.items()):
            assert (got[k].mix_topic, got[k].mix_tokens) == (topic, len(text.split())), text[-40:]


def test_raking_has_one_limit_on_both_paths_and_reports_what_is_left(spark):
    for name in ("rounds", "tolerance"):
        assert inspect.signature(mixing._spread).parameters[name].default == inspect.signature(mixing.rake).parameters[name].default
    rows = [("a", "x", "p", 1000), ("a", "y", "p", 2), ("b", "y", "p", 1000)]
    want = {"source": {"a": 0.25, "b": 0.75}, "lang": {"x": 0.2, "y": 0.8}}
    with pytest.warns(RuntimeWarning, match="after 2 rounds"):
        mixing.rake(np.array([r[3] for r in rows], dtype=float), np.array([[0, 0, 1], [0, 1, 1]]), [np.array([0.25, 0.75]), np.array([0.2, 0.8])], rounds=2)
    with pytest.warns(RuntimeWarning, match="after 1 rounds"):
        mixing._spread(spark.createDataFrame(rows, "source string, lang string, topic string, tokens long"), want, 0.7, 0.5, rounds=1)


def brute_mix(rows, want, temper, budget_share, seed=11):
    """doc_id -> (tokens, topic, probability, kept), by plain loops."""
    cells = {}
    seen = []
    for r in rows:
        t = r.text or ""
        share = lambda chars: sum(c in chars for c in t)  # noqa: B023, E731
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        topic = ("none" if not words else "code" if share("{}#*$%&<>=;") * 10 > len(t) else "list" if share("|\t") * 20 > len(t) else "shout" if share("ABCDEFGHIJKLMNOPQRSTUVWXYZ") * 2 > len(t)
                 else "legal" if "license" in t.lower() or "rights reserved" in t.lower() else "long" if len(t) > 8000 else "prose")
        cell = (r.source, r.lang, topic)
        cells[cell] = cells.get(cell, 0) + len(words)
        seen.append((r.doc_id, len(words), cell))
    total = sum(cells.values())
    weight = {c: n / total for c, n in cells.items()}
    names = ("source", "lang", "topic")
    sums = lambda k, w: {v: sum(x for c, x in w.items() if c[k] == v) for v in {c[k] for c in w}}
    targets = []
    for k, name in enumerate(names):
        have = sums(k, weight)
        if name in want:
            named = {v: s for v, s in want[name].items() if have.get(v)}
            rest = sum(x for v, x in have.items() if v not in named)
            raised = {v: named.get(v, (1 - sum(named.values())) * x / rest if rest else 0) for v, x in have.items()}
        else:
            raised = {v: x**temper if x else 0 for v, x in have.items()}
        targets.append({v: x / sum(raised.values()) for v, x in raised.items()})
    for _ in range(300):
        for k in range(3):
            have = sums(k, weight)
            weight = {c: w * targets[k][c[k]] / have[c[k]] if have[c[k]] else 0 for c, w in weight.items()}
    low, high = 0.0, total * 1e6
    for _ in range(300):
        c = (low + high) / 2
        low, high = (c, high) if sum(min(n, c * weight[k]) for k, n in cells.items()) < budget_share * total else (low, c)
    p = {k: min(1.0, high * weight[k] / n) if n else 1.0 for k, n in cells.items()}
    place = lambda i: xxhash.xxh64(struct.pack("<i", seed), seed=xxhash.xxh64(struct.pack("<q", i), seed=42).intdigest()).intdigest() % 2**52 / 2**52
    return {i: (n, cell[2], p[cell], place(i) < p[cell]) for i, n, cell in seen}


@pytest.mark.parametrize("local_cells", [1000, 0])
def test_mixing_against_plain_loops(make, local_cells):
    rng = random.Random(12)
    kinds = ["plain words here ", "a { b } ; ", "one | two | ", "LOUD WORDS ", "license terms apply ", "l\tt\n x "]
    texts = [rng.choice(kinds) * rng.randint(0, 40) for _ in range(250)] + ["a  b\n\n\n c", "a b c", None, "", " \n", "word " * 2000]
    langs, sources = ([rng.choice(x) for _ in texts] for x in (["en", "fr", "de"], ["a", "a", "b", "c"]))
    docs = make(texts, langs=langs, sources=sources)
    want = {"source": {"a": 0.2, "b": 0.5}}
    got = {r.doc_id: (r.mix_tokens, r.mix_topic, r.mix_probability, r.mix_kept) for r in mixing.mix_sources(docs, want, budget_share=0.6, local_cells=local_cells, tolerance=1e-9 if local_cells else 1e-5).collect()}
    brute = brute_mix(docs.collect(), want, 0.7, 0.6)
    assert got.keys() == brute.keys() and got[250][0] == got[251][0] == 3
    for k, (n, topic, p, kept) in brute.items():
        assert got[k][:2] == (n, topic) and got[k][2] == pytest.approx(p, abs=1e-6 if local_cells else 2e-3) and (got[k][3] == kept or not local_cells), k


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_mixing_of_the_test_tables_against_plain_loops(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.topic, r.kept) for r in mixing.op4_mixing(spark, SF).collect()}
    brute = {k: (n, topic, kept) for k, (n, topic, _, kept) in brute_mix(docs.collect(), {}, 0.7, 0.8).items()}
    assert got == brute


def test_mixing_columns_give_way(make):
    docs = make(["a b", "c"]).withColumns({"mix_kept": F.lit(7), "weight": F.lit("w"), "probability": F.lit("p")})
    out = mixing.mix_sources(docs)
    assert len(set(out.columns)) == len(out.columns)
    assert {(r.mix_kept, r.weight, r.probability) for r in out.collect()} <= {(True, "w", "p"), (False, "w", "p")}
