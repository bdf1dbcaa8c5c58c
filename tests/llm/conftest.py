import pytest

#: Columns whose names also occur inside the operators.
EXTRA = "id string, rk string, sid string, size string, key string, score string, tokens string, w string, row string, topic string, n_tokens string, cell string"
BASE = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """make(texts, langs=..., ...): a documents table with extra columns of clashing names."""

    def build(texts, ids=None, langs=None, sources=None):
        n = len(texts)
        rows = [((ids or range(n))[i], t, (langs or ["en"] * n)[i], (sources or ["s"] * n)[i], len(t or ""), *["x"] * len(EXTRA.split(","))) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, f"{BASE}, {EXTRA}")

    return build


@pytest.fixture(scope="session")
def odd(make):
    """Nulls in every column, empty and very long texts, repeated rows, characters beyond ASCII."""
    long = " ".join(f"word{i % 977} stands" for i in range(60_000))
    texts = [None, "", "   ", "!!! ???", "the cat sat on the mat", "the cat sat on the mat", "Über ÉTÉ 日本 😀", long, "x" * 50_000, "a\x00b\nc", None]
    docs = make(texts, ids=[0, 1, 2, 3, 4, 4, 6, 7, 8, 9, None], langs=["en", None, "fr", "en", "en", "en", "de", "en", None, "fr", None], sources=["a", None, "a", "b", "a", "a", None, "b", "a", "a", None])
    return docs.union(docs.where("doc_id = 7"))
