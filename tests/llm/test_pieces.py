"""Operator 12 against the library, on texts of the tables, on random texts and on random ids."""

import hashlib
import random

import numpy as np
import pytest

from parsewright.llm import piece_codec, pretokens
from parsewright.llm.registry import QUERIES

PATH = pretokens.default_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def same(codec, library, text):
    ids = library.encode(text, add_bos=True, add_eos=True)
    packed = codec.encode(text)
    assert np.frombuffer(packed, "<u4").tolist() == ids, text[:200]
    assert codec.decode(packed) == library.decode(ids), text[:200]


def test_texts_of_all_kinds(library):
    codec = piece_codec.codec(PATH)
    for text in ["", " ", "\n", "  a", "a  b\n c▁", "▁▁x", "\0x\0", "<s>[INST] </s><0x0A>", "𠀀中文𠀁", "é ​﻿", " " * 40 + "the" + " " * 37, "\t\r\n a", "x" * 500]:
        same(codec, library, text)


def test_random_characters_and_pieces(library):
    codec, rnd = piece_codec.codec(PATH), random.Random(3)
    letters = [" ", " ", "a", "e", "t", "h", "▁", "\n", "中", "é", "𠀀", "1", ".", " the", "ing", "  ", "    ", "\t", "н", "日", "<", "0x", "\0"]
    pieces = list(codec.score)
    for _ in range(1500):
        same(codec, library, "".join(rnd.choices(letters, k=rnd.randint(1, 60))))
        same(codec, library, "".join(rnd.choices(pieces, k=rnd.randint(1, 25))).replace("▁", rnd.choice([" ", "▁", ""])))


def test_any_ids_decode_as_in_the_library(library):
    codec, rnd = piece_codec.codec(PATH), random.Random(4)
    for _ in range(1500):
        ids = [rnd.randrange(32000) if rnd.random() < 0.6 else rnd.randrange(259) for _ in range(rnd.randint(1, 12))]
        assert codec.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids), ids


def test_very_long_words_and_texts(library):
    codec = piece_codec.codec(PATH)
    same(codec, library, "的一是在不了有和人这中大为上个国我以要他" * 20_000)
    same(codec, library, "".join(random.Random(5).choices("abcdefgh", k=300_000)))
    same(codec, library, "word and word\n" * 60_000)


def test_words_at_hand_are_bounded(library, monkeypatch):
    monkeypatch.setattr(piece_codec, "WORDS", 50)
    monkeypatch.setattr(piece_codec, "PAIRS", 20)
    codec, rnd = piece_codec.Codec(PATH), random.Random(6)
    for _ in range(50):
        same(codec, library, " ".join("".join(rnd.choices("etaoin", k=5)) for _ in range(80)))
    assert len(codec.words) < 500 and len(codec.pairs) <= 20


def test_nulls_repeats_empty_tables_and_clashing_names(spark):
    rows = [(1, None, "x"), (1, None, "x"), (None, "a b", "y"), (2, "", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").withColumnRenamed("ids", "n_tokens")
    out = piece_codec.decode(piece_codec.encode(docs, PATH), PATH)
    assert sorted((r.doc_id or 0, r.n_tokens, r.decoded) for r in out.collect()) == [(0, 4, "a b"), (1, 2, ""), (1, 2, ""), (2, 2, "")]
    assert piece_codec.decode(piece_codec.encode(docs.limit(0), PATH), PATH).count() == 0


def test_query_against_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        want[r.doc_id] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op12_sentencepiece"](spark, sf).collect()}
    assert got == want
