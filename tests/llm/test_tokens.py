"""Token counts and piece ids against the libraries."""

import random

import pytest

from skerry.llm import piece_codec, token_counts

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def counter():
    return token_counts.counting(token_counts.vocabulary("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def pieces():
    path = piece_codec.vocabulary("piece_bpe_32k.model")
    return piece_codec.codec(path), sentencepiece.SentencePieceProcessor(model_file=path)


def library(counter, text):
    return len(counter.library.encode(text, add_special_tokens=False).ids)


def test_every_character_of_the_safe_range(counter):
    for o in range(0x2100):
        c = chr(o)
        if token_counts.SAFE.fullmatch(c):
            for t in (c, f"a{c}b", c + c, f"1{c} '{c}s"):
                assert counter.count(t) == library(counter, t), (hex(o), t)


def test_random_texts_count_as_in_the_library(counter):
    rng = random.Random(2)
    letters = "aAbB sStT'’ éÉßñ12#*\n\t.,!<|>½ſİıΣς日本😀́"
    for _ in range(3000):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
        assert counter.count(t) == library(counter, t), t
    for t in ("a <|endoftext|> b", "<|startoftext|><|endoftext|>", "<|endoftext", "x" * 3000, "don't we'll"):
        assert counter.count(t) == library(counter, t)


def test_counts_of_odd_rows(odd, counter):
    rows = sorted((tuple(r) for r in token_counts.token_counts(odd).collect()), key=repr)
    want = [(r.doc_id, len((r.text or "").encode()), n := library(counter, r.text or ""), n > 2048) for r in odd.collect()]
    assert rows == sorted(want, key=repr)
    assert token_counts.token_counts(odd.limit(0)).collect() == []


def test_random_texts_encode_as_in_the_library(pieces):
    ours, theirs = pieces
    rng = random.Random(3)
    parts = ["a", "b", "e", "th", " ", "  ", "\n", "\t", "é", "日", "😀", "#", "*", "the", "ing", " ing", "▁", "\x00", "1", "ſ", "İ", ".", "%", "   "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    vocabulary = sorted(ours.ids)
    texts += ["".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 6))).replace("▁", " ") for _ in range(3000)]
    for t in texts:
        assert ours.encode(t).tolist() == theirs.encode(t), repr(t)


def test_streaming_commits_and_runs_of_blanks(pieces):
    ours, theirs = pieces
    rng = random.Random(4)
    for t in ("".join(rng.choice("abcdefghilmnorst") for _ in range(5000)), "a" * 2000 + " " * 999 + "b" * 2000, " " * 70, "ab" * 3000):
        assert ours.encode(t).tolist() == theirs.encode(t)
        assert ours.decode(ours.encode(t).tolist()) == t


def test_small_memos_change_nothing(pieces, monkeypatch):
    ours, theirs = pieces
    monkeypatch.setattr(piece_codec, "MEMO", 3)
    monkeypatch.setattr(piece_codec, "PAIRS", 3)
    text = " ".join(f"word{i} other{i % 5}" for i in range(60))
    assert ours.encode(text).tolist() == theirs.encode(text)


@pytest.mark.parametrize("size", [1, 7, 40])
def test_blocks_change_nothing(pieces, monkeypatch, size):
    ours, theirs = pieces
    monkeypatch.setattr(piece_codec, "BLOCK", size)
    rng = random.Random(6)
    texts = ["".join(rng.choice(["word", " ", "  ", "▁", "\n", "é,", "日", "x" * 70]) for _ in range(rng.randint(0, 30))) for _ in range(400)] + [None, "", "   ", "▁"]
    ids, trips = ours.encode_many(texts)
    assert [x.tolist() for x in ids] == [theirs.encode(t or "") for t in texts]
    assert trips == ["▁" not in (t or "") and ours.decode(x.tolist()) == (t or "") for t, x in zip(texts, ids, strict=True)]


def test_a_part_that_does_not_decode_is_no_round_trip(pieces, monkeypatch):
    ours, _ = pieces
    fresh = piece_codec.PieceCodec(piece_codec.vocabulary("piece_bpe_32k.model"))
    monkeypatch.setitem(fresh.bytes, int(ours.encode("the")[0]), b"tha")
    assert [fresh.encode_many(["a the b", "a b", "the"])[1] for _ in range(2)] == [[False, True, False]] * 2


def test_round_trip_of_odd_rows(odd, pieces):
    encoded = piece_codec.encode_pieces(odd)
    rows = encoded.collect()
    assert all(r.round_trip for r in rows) and len(rows) == odd.count()
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in piece_codec.decode_pieces(encoded).collect()) == sorted((r.doc_id is None, r.doc_id, r.text or "") for r in odd.collect())
    assert piece_codec.encode_pieces(odd.limit(0)).collect() == []
