import json

import pandas as pd
import pytest

from tesserae import __main__ as cli
from tesserae.operators import runs

def encoder():
    words = ("node", "deploy", "contract", "keys")

    def encode(batches):
        for texts in batches:
            yield pd.Series([[t.lower().count(w) + 0.01 for w in words] for t in texts])

    return encode


@pytest.fixture
def site(tmp_path):
    for name, text in (("a", "# A\n\n## Run\n\nRun a node with keys.\n"), ("b", "# B\n\nDeploy a contract.\n")):
        (tmp_path / f"{name}.md").write_text(f"---\ntitle: {name}\nurl: https://x.example/{name}/\n---\n{text}")
    base = f"file://{tmp_path}"
    (tmp_path / "list.txt").write_text(f"# Site\n- [A]({base}/a.md)\n- [B]({base}/b.md)\n- [C]({base}/c.pdf)\n")
    (tmp_path / "site.json").write_text(json.dumps({"llms_txt": f"{base}/list.txt", "db": "store", "eval_set": "questions.jsonl", "chunking": {"max_tokens": 600}, "search": {"embedding_model": "words"}}))
    rows = [{"id": "n1", "question": "run a node", "expected_url": "https://x.example/a/", "evidence": "with KEYS", "origin": "seed", "group": ""}, {"id": "d1", "question": "deploy", "expected_url": "https://x.example/b/", "evidence": "absent", "origin": "seed", "group": "g"}]
    (tmp_path / "questions.jsonl").write_text("\n\n".join(map(json.dumps, rows)) + "\n")
    return tmp_path


def test_from_page_list_to_report(spark, site, capsys):
    config = str(site / "site.json")
    cli.main(["ingest", config])
    assert "c.pdf" in capsys.readouterr().out
    cli.main(["ingest", config, "--rechunk"])
    cli.main(["evaluate", config, "--label", "one"])
    (first,) = site.glob("results/*-one.json")
    record = json.loads(first.read_text())
    assert record["unreachable"] == ["d1"] and {r["id"]: (r["page_rank"], r["section_rank"]) for r in record["scores"]} == {"n1": (1, 1), "d1": (1, None)}
    assert record["page_version_hashes"].keys() == {"https://x.example/a/", "https://x.example/b/"}
    old = dict(record, scores=[dict(r, page_rank=2) for r in record["scores"]], page_version_hashes={})
    (site / "old.json").write_text(json.dumps(old))
    cli.main(["evaluate", config, "--label", "two", "--baseline", str(site / "old.json")])
    (second,) = site.glob("results/*-two.md")
    assert "| n1 | better |  |" in second.read_text() and "pages have changed" in second.read_text()
    loaded = runs.load_config(config)
    store = cli.Store(spark, loaded["db"])
    questions = runs.load_questions(spark, str(site / "questions.jsonl"))
    for method in ("embeddings", "hybrid"):
        got = runs.evaluate(store, loaded, questions, method, str(site / "more"), method, encode=encoder())
        assert {r["id"]: r["page_rank"] for r in got["scores"]} == {"n1": 1, "d1": 1}
    with pytest.raises(ValueError):
        runs.evaluate(store, loaded, questions, "x", str(site / "more"), "embeddings")
    with pytest.raises(RuntimeError):
        runs.evaluate(store, loaded | {"chunking": {"max_tokens": 5}}, questions, "stale", str(site / "stale"))
    assert not (site / "stale").exists()


def test_question_rows(spark, tmp_path):
    seed = spark.createDataFrame([("s1", "Q, \"quoted\"", "https://x.example/a/", "Use `x`", "howto", "e"), ("z1", "Q", "u", "H", "howto", "e")], "id string, question string, url string, heading string, style string, evidence string")
    groups = spark.createDataFrame([("s1", "tabs")], "id string, group string")
    problems = spark.createDataFrame([("s1", ""), ("z1", "page missing")], "id string, problem string")
    rows = runs.question_rows(seed, groups, {"s": "smart"}, problems)
    got = {r.id: (r.expected_anchor, r.area, r.group, r.verified) for r in rows.collect()}
    assert got == {"s1": ("https://x.example/a/#use-x", "smart", "tabs", True), "z1": ("u#h", None, "", False)}
    runs.write_questions(rows, str(tmp_path))
    assert sorted(map(str, runs.load_questions(spark, f"{tmp_path}/jsonl").collect())) == sorted(map(str, rows.collect()))
    assert spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/csv").where("id = 's1'").first().question == 'Q, "quoted"'
    with pytest.raises(ValueError):
        runs.question_rows(seed, groups.selectExpr("'nobody' as id", "group"), {}, problems)
    assert runs.site_base_url("https://x.example/docs/list.txt") == "https://x.example/"
