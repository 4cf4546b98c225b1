import random
import re

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import ODD
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as pb

from tesserae.llm import pieces as P

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL, LIBRARY = P.load(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
ENCODER = P.Pieces(MODEL)


def ours(encoder, texts):
    ids, bounds = encoder.encode([P.prepared(encoder.m, t.encode()).decode() for t in texts])
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("abcdefgth  .\n1_é"), st.characters(codec="utf-8")), max_size=40), max_size=5))
def test_ids_are_the_librarys(texts):
    assert ours(ENCODER, texts) == LIBRARY.encode(texts)


def test_documents_are_the_librarys(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert ours(ENCODER, texts) == LIBRARY.encode(texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([" ", "a", "ab", "the", "é", "中文", "aab", "x1", "lesson", "\n"]), st.integers(1, 400)), max_size=6))
def test_long_units_and_runs_of_spaces_are_the_librarys(parts):
    text = "".join(x * n for x, n in parts)
    assert ours(ENCODER, [text]) == LIBRARY.encode([text])


def test_windows_that_share_no_piece(monkeypatch):
    rng = random.Random(4)
    texts = ["".join(rng.choice("thenoisr") for _ in range(n)) for n in (257, 700, 5000)]
    assert ours(P.Pieces(MODEL), texts) == LIBRARY.encode(texts)
    monkeypatch.setattr(P, "OVERLAP", 1)
    assert ours(P.Pieces(MODEL), texts) == LIBRARY.encode(texts)
    monkeypatch.setattr(P, "CELLS", 1 << 9)  # blocks of a few positions
    assert ours(P.Pieces(MODEL), texts) == LIBRARY.encode(texts)


def test_forgotten_units_are_found_again(spark, monkeypatch):
    monkeypatch.setattr(P.Pieces, "most_units", 50)
    monkeypatch.setattr(P.Pieces, "most_bytes", 300)
    encoder = P.Pieces(MODEL)
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect():
        assert ours(encoder, [r.text]) == [LIBRARY.encode(r.text)]
    encoder.thin()
    assert 0 < len(encoder) <= 25 and encoder.lengths.sum() <= 150


def test_unigram_is_the_librarys(spark):
    """The same pieces as a unigram model: the library then searches for the greatest sum of scores, too."""
    model = pb.ModelProto()
    with open(PATH, "rb") as f:
        model.ParseFromString(f.read())
    rng = random.Random(5)
    for p in model.pieces:
        p.score = -rng.uniform(3, 12) - len(p.piece) / 3 if p.type == 1 else 0.0
    model.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    encoder = P.Pieces(P.build([(p.piece, p.score, p.type) for p in model.pieces], P.UNIGRAM, True, 0))
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(30).collect()]
    # Unit by unit: over a whole text the library's single-precision sum rounds, and paths of equal score may change places.
    units = sorted({u[1:] for t in texts for u in re.findall(" *[^ ]+| +", " " + t) if u[0] == " "})
    assert ours(encoder, units) == library.encode(units)


def test_round_trip_of_odd_rows(spark, docs):
    rows = P.encode_texts(docs(ODD, clash=True), PATH)
    got = {r.doc_id: r for r in rows.collect()}
    assert len(got) == len(ODD) and rows.columns.count("ids") == 1
    for i, t in enumerate(ODD):
        assert got[i].ids == LIBRARY.encode(t or "") and got[i].n_tokens == len(got[i].ids)
        assert got[i].round_trip == (P.SPACE not in (t or ""))
    back = {r.doc_id: r.text for r in P.decode_ids(rows.select("doc_id", "ids"), PATH).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(ODD) if P.SPACE not in (t or ""))
    assert P.decode_ids(rows.select("doc_id", F.lit(None).cast("array<int>").alias("ids")).limit(1), PATH).first().text is None
    assert P.encode_texts(docs([]), PATH).count() == 0


def test_models_that_normalise_are_refused(tmp_path):
    model = pb.ModelProto()
    with open(PATH, "rb") as f:
        model.ParseFromString(f.read())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        P.load(str(tmp_path / "m"))
