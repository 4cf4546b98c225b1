"""Evaluation runs: configuration, question files, the choice of ranking, and run records with their reports."""

from __future__ import annotations

import datetime
import json
import os
from collections.abc import Callable
from urllib.parse import urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import chunking, evaluation, fusion, keyword, stats, vector
from tesserae.sources.store import Store

QUESTIONS = "id string, question string, expected_url string, expected_section string, expected_anchor string, style string, area string, evidence string, origin string, group string, verified boolean"
METHODS = ("keyword", "embeddings", "hybrid")


def load_config(path: str) -> dict:
    """A site's configuration; the store's place is taken from the file's folder, absent chunk settings are none."""
    with open(path) as f:
        config = json.load(f)
    folder = os.path.dirname(os.path.abspath(path))
    return {"chunking": {}, "search": {}} | config | {"db": os.path.normpath(os.path.join(folder, config["db"]))}


def settings_of(config: dict) -> chunking.Settings:
    return chunking.Settings(**config["chunking"])


def site_base_url(list_url: str) -> str:
    parts = urlsplit(list_url)
    return f"{parts.scheme}://{parts.netloc}/"


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions from JSON lines; blank lines are skipped."""
    return spark.read.schema(QUESTIONS).json(path)


def write_questions(questions: DataFrame, folder: str) -> None:
    """Questions as JSON lines and as CSV with a header, below `folder`."""
    questions.write.mode("overwrite").json(f"{folder}/jsonl")
    questions.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{folder}/csv")


def question_rows(seed: DataFrame, groups: DataFrame, areas: dict[str, str], problems: DataFrame) -> DataFrame:
    """Rows of QUESTIONS from seed(id, question, url, heading, style, evidence), groups(id, group) and problems(id, problem).

    The area goes by an id's first letter; a question is verified if it has no problem. Groups that name unknown ids are refused.
    """
    if unknown := [r.id for r in stats.unknown_ids(groups, seed).limit(20).collect()]:
        raise ValueError(f"groups name unknown questions: {', '.join(sorted(unknown))}")
    names = F.create_map(*(F.lit(x) for kv in areas.items() for x in kv))
    rows = seed.join(groups.dropDuplicates(["id"]), "id", "left").join(problems, "id", "left")
    return rows.select(
        "id", "question", F.col("url").alias("expected_url"), F.col("heading").alias("expected_section"),
        F.concat("url", F.lit("#"), chunking.slugs("heading")).alias("expected_anchor"), "style", F.try_element_at(names, F.substring("id", 1, 1)).alias("area"),
        "evidence", F.lit("seed").alias("origin"), F.coalesce("group", F.lit("")).alias("group"), (F.coalesce("problem", F.lit("")) == "").alias("verified"),
    )


def rank(chunks: DataFrame, queries: DataFrame, method: str, k: int, heading_path: bool = False, model: str = "", encode: Callable | None = None, cache: DataFrame | None = None, index: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, score) with the columns of the k best chunks for each of queries(query_id, text), by one of METHODS.

    encode: as for vector.refresh_vectors; it is needed for all methods but keyword. cache: vectors made before. index: keyword
    postings of the chunks, if they are stored.
    """
    if method not in METHODS:
        raise ValueError(f"unknown method {method}")
    key, wanted = ["url", "ord"], fusion.candidates(k) if method == "hybrid" else k
    lists = []
    if method != "embeddings":
        if index is None:
            indexed = chunks.select(*key, F.array_join("heading_path", " > ").alias("path"), "text")
            lists.append(keyword.bm25(indexed, queries, key, ["path", "text"] if heading_path else ["text"], wanted))
        else:
            lists.append(keyword.ranked(index, keyword.wanted(queries), key, wanted))
    if method != "keyword":
        if encode is None:
            raise ValueError(f"{method} needs an encoder")
        spark = chunks.sparkSession
        texts, asked = embedded(chunks, queries, heading_path)
        cache = spark.createDataFrame([], "model string, text_hash string, vector array<float>") if cache is None else cache
        known = vector.refresh_vectors(cache, texts.select("t").unionByName(asked.select("t")), model, encode, "t").where(F.col("model") == model).select("text_hash", F.col("vector").alias("embedding"))
        with_vector = lambda df: df.withColumn("text_hash", F.sha2("t", 256)).join(known, "text_hash")
        near = vector.nearest(with_vector(texts).select("k", "embedding"), with_vector(asked).select("query_id", "embedding"), "k", wanted)
        lists.append(near.select("query_id", "rank", "k.*", "score"))
    best = lists[0] if len(lists) == 1 else fusion.fuse(lists, key, k)
    return best.join(chunks, key)


def embedded(chunks: DataFrame, queries: DataFrame, heading_path: bool) -> tuple[DataFrame, DataFrame]:
    """(k, t) of chunks and (query_id, t) of queries(query_id, text): what of them is embedded."""
    texts = chunks.select(F.struct("url", "ord").alias("k"), vector.embedded_text(F.col("heading_path"), F.col("text"), heading_path).alias("t"))
    return texts, queries.where(F.trim("text") != "").select("query_id", F.col("text").alias("t"))


def evaluate(store: Store, config: dict, questions: DataFrame, label: str, folder: str, method: str = "keyword", baseline: dict | None = None, encode: Callable | None = None) -> dict:
    """Rank all questions, score them, and write `<date>-<label>.json` and `.md` below `folder`; the record.

    Stops before writing anything if the stored chunks were made with other settings. Records hold a row for each question.
    """
    store.check_settings(settings_of(config))
    chunks, pages = store.table("chunks"), store.table("pages")
    queries = questions.select(F.col("id").alias("query_id"), F.col("question").alias("text"))
    with_path, model, cache = bool(config["search"].get("index_heading_path")), config["search"].get("embedding_model", ""), None
    if method != "keyword" and encode is not None:  # new vectors are stored, so that no run encodes a text again
        texts, asked = embedded(chunks, queries, with_path)
        store.add_vectors(vector.missing_vectors(store.table("vectors"), texts.select("t").unionByName(asked.select("t")), model, encode, "t"))
        cache = store.table("vectors")
    results = rank(chunks, queries, method, evaluation.DEPTH, with_path, model, encode, cache, store.index(with_path)).cache()
    scores = evaluation.question_ranks(questions, results).cache()
    table = [r.asDict() for r in evaluation.recall(scores).orderBy("kind", "questions").collect()]
    tokens = evaluation.tokens_returned(questions, results).first().asDict()
    missed = sorted(r.id for r in evaluation.unreachable(questions, chunks).collect())
    rows = [r.asDict() for r in scores.orderBy("id").collect()]
    record = {
        "label": label, "date": datetime.date.today().isoformat(), "method": method, "chunking": config["chunking"], "search": config["search"],
        "pages": pages.count(), "chunks": chunks.count(), "question_ids": [r["id"] for r in rows], "recall": table, "tokens": tokens, "unreachable": missed, "scores": rows,
        "page_version_hashes": {r.url: r.version_hash for r in pages.select("url", "version_hash").collect()},
    }
    warnings = evaluation.baseline_warnings(record, baseline) if baseline else []
    notes = {"method": method, "pages": f"{record['pages']}, {record['chunks']} chunks", "mean tokens in the first 1, 3, 5": " / ".join(str(tokens[f"tokens_{k}"]) for k in evaluation.CUTOFFS)}
    text = evaluation.report(table, f"{record['date']} {label}", notes, warnings, missed)
    if baseline:
        old = {r["id"]: r for r in baseline["scores"]}
        changed = [(r["id"], *(described(old.get(r["id"], {}).get(f"{x}_rank"), r[f"{x}_rank"]) for x in ("page", "section"))) for r in rows]
        text += "\n| question | page | section |\n|---|---|---|\n" + "".join(f"| {i} | {p} | {s} |\n" for i, p, s in changed if p or s)
    os.makedirs(folder, exist_ok=True)
    for name, content in ((".json", json.dumps(record, indent=1)), (".md", text)):
        with open(f"{folder}/{record['date']}-{label}{name}", "w") as f:
            f.write(content)
    results.unpersist(), scores.unpersist()
    return record


def described(before: int | None, after: int | None) -> str:
    """evaluation.change for two numbers of a small record."""
    if before == after:
        return ""
    return "lost" if after is None else "found" if before is None else "better" if after < before else "worse"
