import math

import pandas as pd
import pytest

from tesserae.operators import evaluation as E
from tesserae.operators import fusion, keyword, stats, vector

CHUNKS = [("a", 0, "Deploy a smart contract with eth_call"), ("a", 1, "Run a node and a node again"), ("b", 0, "Café node keys"), ("b", 1, None)]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "url string, ord int, text string")


def ask(spark, chunks, text, k=5):
    rows = keyword.bm25(chunks, spark.createDataFrame([(1, text)], "query_id int, text string"), ["url", "ord"], ["text"], k)
    return [(r.url, r.ord, r.score) for r in rows.orderBy("rank").collect()]


def test_bm25_by_hand(spark, chunks):
    words = [["deploy", "a", "smart", "contract", "with", "eth", "call"], ["run", "a", "node", "and", "a", "node", "again"], ["cafe", "node", "keys"], []]
    avg = sum(map(len, words)) / 4
    idf = lambda df: max(math.log((4 - df + 0.5) / (df + 0.5)), 0) or 1e-6
    want = {i: sum(idf(sum(t in x for x in words)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / avg)) for t in ("node", "cafe")) for i, w in enumerate(words)}
    got = ask(spark, chunks, "CAFÉ node? node")
    assert got[0] == ("b", 0, round(want[2], 6)) and got[1] == ("a", 1, round(want[1], 6)) and len(got) == 2
    assert ask(spark, chunks, "?!") == ask(spark, chunks, "absent") == ask(spark, chunks, None) == []
    assert [x[:2] for x in ask(spark, chunks, "call")] == [("a", 0)] and len(ask(spark, chunks, "a node", 1)) == 1


def test_nearest_in_blocks(spark, monkeypatch):
    rows = spark.createDataFrame([(i, [float(i % 3), float(i % 5)]) for i in range(30)] + [(99, None)], "vec_id int, embedding array<float>")
    asked = rows.where("vec_id < 7").selectExpr("vec_id as query_id", "embedding")
    whole = sorted(map(tuple, vector.nearest(rows, asked, "vec_id", 3).collect()))
    monkeypatch.setattr(vector, "BLOCK", 2)
    assert sorted(map(tuple, vector.nearest(rows, asked, "vec_id", 3).collect())) == whole
    assert [r for r in whole if r[0] == 1][0] == (1, 1, 14, 6.0)
    assert vector.nearest(rows.limit(0), asked, "vec_id").count() == 0


def test_vector_cache(spark):
    seen = spark.sparkContext.accumulator(0)

    def encode(batches):
        for texts in batches:
            seen.add(len(texts))
            yield pd.Series([[float(len(t))] for t in texts])

    empty = spark.createDataFrame([], "model string, text_hash string, vector array<float>")
    texts = spark.createDataFrame([("a",), ("bb",), ("a",)], "text string")
    first = spark.createDataFrame(vector.refresh_vectors(empty, texts, "m", encode).collect(), empty.schema)
    assert first.count() == 2 and seen.value == 2
    more = spark.createDataFrame([("a",), ("ccc",)], "text string")
    assert vector.refresh_vectors(first, more, "m", encode).count() == 3
    assert vector.refresh_vectors(first, more, "other", encode).count() == 4


def test_fusion(spark):
    one = spark.createDataFrame([(1, 1, "x"), (1, 2, "both")], "query_id int, rank int, url string")
    two = spark.createDataFrame([(1, 1, "y"), (1, 2, "both")], "query_id int, rank int, url string")
    got = fusion.fuse([one, two], ["url"]).orderBy("rank").collect()
    assert [r.url for r in got] == ["both", "x", "y"] and abs(got[0].score - 2 / 62) < 1e-9
    assert fusion.candidates(3) == 50 and fusion.candidates(80) == 80


def test_ranks_and_recall(spark):
    questions = spark.createDataFrame([("q1", "p", "Needle", "", "seed"), ("q2", "z", "n", "tabs", "field")], "id string, expected_url string, evidence string, group string, origin string")
    results = spark.createDataFrame([("q1", 1, "o", "needle", 5), ("q1", 2, "p", "hay", 6), ("q1", 3, "p", "a NEEDLE", 8)], "query_id string, rank int, url string, text string, tokens int")
    got = {r.id: (r.page_rank, r.section_rank) for r in E.question_ranks(questions, results).collect()}
    assert got == {"q1": (2, 3), "q2": (None, None)}
    table = E.recall(E.question_ranks(questions, results)).orderBy("kind", "questions").collect()
    assert [(r.questions, r["count"], r.page_1, r.page_3, r.section_3) for r in table] == [("all", 2, 0, 1, 1), ("origin: field", 1, 0, 0, 0), ("origin: seed", 1, 0, 1, 1), ("general", 1, 0, 1, 1), ("group: tabs", 1, 0, 0, 0)]
    none = E.recall(E.question_ranks(questions.limit(0), results)).orderBy("kind").collect()
    assert [(r.questions, r["count"]) for r in none] == [("all", 0), ("general", 0)]
    assert tuple(E.tokens_returned(questions, results).first()) == (2, 10, 10)
    text = E.report([r.asDict() for r in table], "run", {"method": "keyword"}, missed=["q2"])
    assert "| all | 2 | 0 (0%) | 1 (50%)" in text and "q2" in text and E.percent(0, 0) == "-"


def test_changes_and_warnings(spark):
    make = lambda rows: spark.createDataFrame(rows, "id string, page_rank int, section_rank int")
    now = make([("a", 1, None), ("b", 2, 3), ("c", None, None), ("d", 1, 1)])
    old = make([("a", 2, 1), ("b", 1, 3), ("c", None, None)])
    got = {r.id: (r.page_change, r.section_change) for r in E.rank_changes(now, old).collect()}
    assert got == {"a": ("better", "lost"), "b": ("worse", ""), "c": ("", ""), "d": ("found", "found")}
    assert len(E.baseline_warnings({"page_version_hashes": {"a": "1"}, "question_ids": ["x"]}, {"page_version_hashes": {"a": "2"}, "question_ids": ["x"]})) == 1


def test_exclusive_quantiles(spark):
    rows = spark.createDataFrame([("p", t, 0) for t in (1, 2, 3, 4, 10)], "url string, tokens int, part int")
    got = stats.chunk_stats(rows).first()
    assert got.median == 3.0 and got.under_50 == 5
    import statistics

    cut = statistics.quantiles([1, 2, 3, 4, 10], n=20)
    assert abs(got.p5 - cut[0]) < 1e-9 and abs(got.p95 - cut[-1]) < 1e-9


def test_question_checks(spark):
    page = "# T\n\n## Use\n\nNeedle here\n\n```\n## Use\n```\n\n### More\n\nmore\n\n## Next\n\nneedle there, tool\n"
    pages = spark.createDataFrame([("u", page)], "url string, markdown string")
    cases = [("1", "u", "Use", "tool"), ("2", "u", "Use", "needle"), ("3", "u", "Use", "more"), ("4", "u", "None", "x"), ("5", "v", "Use", "x"), ("6", "u", "Next", "tool")]
    got = {r.id: r.problem for r in stats.question_checks(spark.createDataFrame(cases, "id string, url string, heading string, evidence string"), pages).collect()}
    assert got == {"1": "evidence not in section", "2": "evidence elsewhere", "3": "", "4": "heading missing", "5": "page missing", "6": ""}
