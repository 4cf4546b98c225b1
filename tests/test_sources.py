from pyspark.sql import functions as F

from tesserae.functions import text as T
from tesserae.sources import pages as P


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "x string").select(fn(F.col("x")).alias("y")).first().y


def test_link_list(spark):
    text = "# Site\n> see https://x.example\n## A\n- [One](https://x.example/a): note\n## B\n  -  [ Two ](https://x.example/b)\n* [No](u)\n"
    rows = P.link_list(spark.createDataFrame([(text,)], "text string")).orderBy("pos").collect()
    assert [(r.title, r.url) for r in rows] == [("One", "https://x.example/a"), ("Two", "https://x.example/b")]


def test_md_url(spark):
    cases = {
        "https://x.example/a/b/": "https://x.example/a/b.md",
        "https://x.example/a/b.md": "https://x.example/a/b.md",
        "https://x.example/a.html": None,
        "https://x.example/a.jsonl": None,
        "https://x.example/v1.2/": "https://x.example/v1.2.md",
        "https://x.example/a?p=2": "https://x.example/a?p=2.md",
    }
    assert {u: one(spark, u, T.md_url) for u in cases} == cases


def test_front_matter(spark):
    got = one(spark, "---\ntitle: 'A: b'\nurl: https://x.example/\ntitle: C\nno colon\n---\nbody\n", P.front_matter)
    assert got.front_matter == {"title": "C", "url": "https://x.example/"} and got.body == "body\n"
    for raw in ("---\n---\ntext", "---\nopen: yes\n", "plain", "---\r\na: b\r\n---\r\n"):
        got = one(spark, raw, P.front_matter)
        assert got.front_matter == {} and got.body == raw


def test_fetch_keeps_failures_apart(spark, tmp_path):
    (tmp_path / "a.md").write_text("---\nurl: https://x.example/a/\n---\nhello")
    rows = P.fetch(spark, [(0, "https://x.example/a", f"file://{tmp_path}/a.md"), (1, "https://x.example/b", f"file://{tmp_path}/b.md")], batch=1)
    pages, failures = P.parsed(rows)
    assert [(r.url, r.body) for r in pages.collect()] == [("https://x.example/a/", "hello")]
    assert [r.url for r in failures.collect()] == ["https://x.example/b"]


def test_python_integers(spark):
    cases = {" 12 ": 12, "+5": 5, "1_000": 1000, "1__0": None, "x": None, "": None}
    assert {k: one(spark, k, T.try_int) for k in cases} == cases
