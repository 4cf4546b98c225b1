import pytest

import __spark_entry__ as entry
import corpus_pipeline as C
from compare import both
from test_near import brute
from tesserae.llm import queries, secrets
from tesserae.session import cut

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of each stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in C.STAGES:
        after = cut(stage(spark, docs, SF), "stage")
        out.append((name, docs, after))
        docs = after
    return out


def test_stages(spark, stages):
    (_, docs, good), (_, _, apart), (_, _, clean), (_, _, mixed), (_, _, last) = stages
    assert all(set(after.columns) == set(docs.columns) for _, _, after in stages[:-1])
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id: r.text for r in good.collect()}
    assert not any(quality.get(i) == 0 for i in kept)
    # One document stays of each group, by comparing all pairs.
    groups = brute(sorted(kept.items()), 5, 80)
    assert sorted(r.doc_id for r in apart.collect()) == sorted({c for _, _, c in groups})
    before, after = {r.doc_id: r.text for r in apart.collect()}, {r.doc_id: r.text for r in clean.collect()}
    assert before.keys() == after.keys()
    for i, t in before.items():
        assert (after[i] == t) == (not secrets.base_findings(t)) or "<MODEL>" in after[i]
        assert not secrets.base_findings(after[i])
    assert {r.doc_id for r in mixed.collect()} <= set(after) and mixed.count() > 0
    rows = last.collect()
    assert len(rows) == mixed.count() and all(r.round_trip and len(r.ids) == r.n_tokens for r in rows)


def test_run_is_its_stages(spark, stages):
    rows = lambda df: sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in df.collect())
    assert rows(C.run(spark, SF)) == rows(stages[-1][2])


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, name):
    mine, theirs = both(spark, SF, queries.QUERIES[name], queries.ORACLE[name])
    assert mine == theirs


def test_every_operator_is_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TALE = " ".join(f"w{i * 7 % 61}" for i in range(80))


def test_near_duplicates_lose_nothing_but_copies(spark):
    other = " ".join(f"v{i * 5 % 67}" for i in range(80))
    rows = [(5, TALE, "en"), (3, TALE + " end", "en"), (3, other, "de"), (3, other, "en"), (None, TALE.upper(), "en"), (None, "only one here", None), (9, "", "en"), (9, "", "en"), (None, None, "en"), (4, " \n", None)]
    docs = spark.createDataFrame([(i, t, lang, "s", None) for i, t, lang in rows], SCHEMA)
    got = sorted(((r.doc_id, r.text, r.lang) for r in C.near_duplicates(spark, docs, SF).collect()), key=repr)
    assert got == sorted([(3, TALE + " end", "en"), (3, other, "de"), (None, "only one here", None), (9, "", "en"), (9, "", "en"), (None, None, "en"), (4, " \n", None)], key=repr)
    assert C.near_duplicates(spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("name, stage", C.STAGES)
def test_stages_take_odd_rows_and_none(spark, name, stage):
    from odd import ODD

    rows = [(i if i % 3 else None, t, "en" if i % 2 else None, None if i % 4 else "src1", None) for i, t in enumerate([*ODD, TALE, TALE])]
    docs = spark.createDataFrame(rows, SCHEMA)
    for c in ("kept", "score", "rid", "of", "h", "found", "epoch", "n_tokens", "ids", "budget"):
        docs = docs.selectExpr("*", f"'x' as {c}")
    got = stage(spark, docs, SF)
    assert len(got.columns) == len(set(got.columns))
    n = got.count()
    assert n == {"quality rules": n, "secret scans": len(rows), "SentencePiece": len(rows)}.get(name, n) and n <= 2 * len(rows)
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_run_leaves_its_stages_only(spark):
    import os

    from tesserae.session import shared_root

    folder = shared_root(spark).removeprefix("file://") + "/tesserae"
    before = set(os.listdir(folder))
    C.run(spark, SF).count()
    assert {x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before} == {"quality-rules", "n-gram-Jaccard-join", "secret-scans", "source-mix"}
