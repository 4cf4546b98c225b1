import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import ODD
from tokenizers import Tokenizer

from tesserae.llm import tokens as T

PATH = public_tokenizers.path("byte_bpe_50k.json")
with open(PATH, "rb") as f:
    ENCODER = T.Encoder(f.read())


FRESH = Tokenizer.from_file(PATH)


def library(text):
    """By a tokenizer of its own, as the file has it."""
    return [*FRESH.encode(text or "", add_special_tokens=False).ids, 0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("ab'st .,\n\t\r\x1c\x85\xa0_1"), st.characters(codec="utf-8")), max_size=40), max_size=5))
def test_encoder_is_the_library(texts):
    ids, bounds = ENCODER.encode(texts, 0)
    assert [list(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [library(t) for t in texts]


def test_round_trip_of_odd_rows(spark, docs):
    ids = [5, 3, 3, None, 9, 1, 2, 4, 6, 7, 8]
    folder, shards = T.write_token_files(docs(ODD, ids, clash=True), PATH, 0, shards=3)
    rows = T.read_token_files(spark, folder, shards, with_ids=True).collect()
    assert len(rows) == len(ODD)
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(ids, key=lambda x: (x is not None, x or 0))
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
    by_id = {}
    for i, t in zip(ids, ODD, strict=True):
        by_id.setdefault(i, []).append(library(t))
    for r in rows:
        assert r.ids in by_id[r.doc_id] and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    found = [T.read_document(folder, u, 9) for u, *_ in shards]
    assert [x.tolist() for x in found if x is not None] == [library(ODD[4])]


def test_empty_table_and_wrong_dictionary(spark, docs):
    folder, shards = T.write_token_files(docs([]), PATH)
    assert shards == [] and T.read_token_files(spark, folder, shards).count() == 0
    folder, shards = T.write_token_files(docs(["some text"] * 3), PATH)
    with pytest.raises(ValueError):
        T._open(shards[0][0], b"another dictionary")


def test_many_rows_of_one_id_are_dealt_over_shards(spark, docs):
    texts = [f"text {i}" for i in range(400)] + ["same"] * 400
    folder, shards = T.write_token_files(docs(texts, [7] * 800), PATH, 0, shards=4)
    assert len(shards) == 4 and max(n for _, n, _, _ in shards) < 400
    rows = T.read_token_files(spark, folder, shards, with_ids=True).orderBy("start").collect()
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
    assert sorted(r.ids for r in rows) == sorted(library(t) for t in texts)


def test_the_dictionary_learns_from_whole_texts(spark, docs, monkeypatch):
    texts = ["a" * 5000, "b" * 20, None, "b" * 20, "c" * 40]
    whole = T.sample_texts(docs(texts, [1, 2, 3, 2, 4]).fillna("", ["text"]))
    assert sorted(whole) == ["", "a" * 5000, "b" * 20, "c" * 40]
    monkeypatch.setattr(T, "SAMPLE_CHARS", 60)
    assert sorted(T.sample_texts(docs(texts, [1, 2, 3, 2, 4]).fillna("", ["text"]))) == ["", "b" * 20, "c" * 40]


def test_vocabulary_is_read_by_the_library():
    assert Tokenizer.from_file(PATH).get_vocab_size() == 50257


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", " ", "\n", "a", " b", "<|", "|>", "endoftext", "é", "  ", "!"]), max_size=8).map("".join), max_size=5))
def test_added_tokens_are_the_librarys(texts):
    fresh = Tokenizer.from_file(PATH)
    ids, bounds = ENCODER.encode(texts, 0)
    assert [list(ids[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == [[*fresh.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    assert list(ENCODER.encode(["x", "a <|endoftext|> b"])[0][-4:]) == [64, 220, 50256, 275]
