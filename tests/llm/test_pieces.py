"""Piece encoding and decoding beside the library, on random, odd and very long texts."""

from __future__ import annotations

import hashlib
import random
import struct

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from pairloom.llm import pieces
from pairloom.llm.queries import QUERIES

FILE = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
ALPHABET = "aabeinrst  \n\x00\té▁中ᄀ😀AB.,'#7"
SCHEMA = "doc_id long, text string, ids string, ids_sha256 string, n_tokens string"


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=FILE)


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(pieces.load_model(FILE))


@pytest.fixture(scope="module")
def decoder():
    return pieces.Decoder(pieces.load_model(FILE))


def same(library, encoder, decoder, text):
    ids = library.encode(text, add_bos=True, add_eos=True)
    assert np.frombuffer(encoder.text(text), "<u4").tolist() == ids
    assert decoder.text(np.array(ids, "<u4")) == library.decode(ids)


@settings(max_examples=300, deadline=None)
@given(text=st.one_of(st.text(ALPHABET, max_size=80), st.text(max_size=60)))
def test_any_text(library, encoder, decoder, text):
    same(library, encoder, decoder, text)


def test_pieces_in_a_row(library, encoder, decoder):
    rng, names = random.Random(3), list(encoder.model.scores)
    for _ in range(3000):
        same(library, encoder, decoder, "".join(rng.choice(names).replace("▁", " ") for _ in range(rng.randrange(9))))


@pytest.mark.parametrize("text", [
    "", " ", "ab" * 30_000, "x" * 20_000, " " * 9_000 + "a" + " " * 40, "中文字😀" * 4_000, "e n " * 400_000, "the " * 3 + "\n" * 5_000, "1234567890" * 2_000])
def test_long_texts(library, encoder, decoder, text):
    same(library, encoder, decoder, text)


def test_windows_and_forgetting(library, monkeypatch):
    """Small windows, small parts and no memory give the same ids."""
    rng = random.Random(5)
    for name, value in (("WINDOW", 3), ("SCAN", 20), ("REMEMBERED", 2)):
        monkeypatch.setattr(pieces, name, value)
    small = pieces.Encoder(pieces.load_model(FILE))
    for _ in range(300):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randrange(90)))
        assert np.frombuffer(small.text(text), "<u4").tolist() == library.encode(text, add_bos=True, add_eos=True)


def test_backtracking_gives_what_merging_gives():
    """Random merge tables over three letters, where the longest piece is often wrong; all ties in score."""
    rng = random.Random(8)
    for _ in range(150):
        formed = list("abc")
        for _ in range(rng.randrange(3, 14)):
            formed.append(rng.choice(formed) + rng.choice(formed))
        scores = {p: float(-rng.randrange(4)) for p in formed if len(p) < 9}
        model = pieces.PieceModel(scores, {p: k for k, p in enumerate(scores)}, list(range(1000, 1256)), 1, 2, [], frozenset())
        own = pieces.Encoder(model)
        for _ in range(40):
            text = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 25)))
            got = [own.names.get(k) or chr(k - pieces.ALONE) for k in own.pieces(text)]
            assert got == pieces.merged(scores, text)


def test_any_ids_decode_as_in_the_library(library, decoder):
    rng = random.Random(4)
    for _ in range(5000):
        ids = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(3, 259), rng.randrange(32_000), 29_871]) for _ in range(rng.randrange(12))]
        assert decoder.text(np.array(ids, "<u4")) == library.decode(ids)
    with pytest.raises(IndexError):
        decoder.text(np.array([1, 32_000], "<u4"))


def test_other_models_are_refused(tmp_path):
    with pytest.raises(Exception):
        pieces.load_model(str(tmp_path / "none.model"))


def digest(text):
    return hashlib.sha256(text).hexdigest()


def test_query_beside_the_library(spark, library):
    want = {}
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        want[r.doc_id] = (len(ids), digest(struct.pack(f"<{len(ids)}I", *ids)), digest(library.decode(ids).encode()))
    got = QUERIES["op11_piece_tokens"](spark, SF).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want and len(got) == len(want)


def test_odd_rows(spark, library):
    rows = [(1, None, "a", "b", "c"), (1, None, "a", "b", "c"), (None, "", "a", None, "c"), (2, " \n", None, "b", None), (3, "ab cd " * 50_000, "x", "y", "z")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = pieces.encode_texts(df, FILE).collect()
    assert [r.doc_id for r in got] == [1, 1, None, 2, 3]
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in got] == [library.encode(t or "", add_bos=True, add_eos=True) for _, t, *_ in rows]
    back = pieces.decode_ids(pieces.encode_texts(df, FILE), FILE)
    assert back.columns == ["doc_id", "n_tokens", "decoded"] and [r.decoded for r in back.collect()] == [r[1] or "" for r in rows]
    missing = spark.createDataFrame([(1, None, "own")], "id long, ids binary, decoded string")
    assert [tuple(r) for r in pieces.decode_ids(missing, FILE).collect()] == [(1, None)]
    empty = spark.createDataFrame([], SCHEMA)
    assert pieces.round_trip(empty, FILE).collect() == []
    assert pieces.round_trip(df, FILE).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
