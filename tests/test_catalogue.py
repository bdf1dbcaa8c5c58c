"""Every query against its oracle SQL, on the smallest tables."""

import math
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry_file
from skerry.plans import catalogue

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


LICENSE = r"(?i)(?<![^\W_])license(?![^\W_])"


def parts(text, words):
    """The fragments of at most 150 characters with one of the words, tagged, in order, by plain steps."""
    any_ = rf"(?i)(?<![^\W_])({'|'.join(words)})(?![^\W_])"
    out, at = [], None
    for m in [*re.finditer(r"[^\W_]+", text), None]:
        if at is not None and (m is None or m.end() - at > 150):
            if re.search(any_, text[at:end]):
                out.append(text[at:end])
            at = None
        if m is not None:
            at, end = m.start() if at is None else at, m.end()
    return [(len({x.lower() for x in re.findall(any_, p)}), len(re.findall(any_, p)), re.sub(any_, r"<b>\1</b>", p)) for p in out]


BRUTE = {
    "snippet": lambda t: min(((-a, -b, i, p) for i, (a, b, p) in enumerate(parts(t, ["license"]))), default=(0, 0, 0, None))[3],
    "snippets": lambda t: tuple(p for _, _, p in parts(t, ["license", "rights"])[:3]),
    "snippet_positions": lambda t: tuple((len(t[: m.start()].encode()), len(t[: m.end()].encode())) for m in re.finditer(LICENSE, t)),
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    import decimal

    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_gives_the_oracles_rows(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    if name not in catalogue.ORACLE_SQL:
        assert name in BRUTE, "a query without SQL is held against plain Python"
        texts = dict(duck.execute("SELECT doc_id, text FROM documents").fetchall())
        assert rows == sorted((tuple(plain(BRUTE[name](t) if c != "doc_id" else i) for c in columns) for i, t in texts.items() if t and re.search(LICENSE, t)), key=repr)
        return
    cursor = duck.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert rows == want


def test_entry_file(spark):
    assert entry_file.entry(spark).count() >= 0
    assert set(entry_file.oracle_sql()) <= set(entry_file.queries())
