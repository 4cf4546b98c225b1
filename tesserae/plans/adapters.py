"""The driver's tables as inputs of this library: questions, chunks, pages and page lists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.session import cut, small_side, spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks: ten documents a page."""
    rows = table(spark, d, "documents")
    return rows.select(F.concat(F.lit("p"), F.floor(F.col("doc_id") / 10).cast("string")).alias("url"), "doc_id", "text", F.greatest(F.lit(1), F.floor(F.length("text") / 4).cast("int")).alias("tokens"))


def questions(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark passages as questions: expected is the page of the first document that holds the passage, else page p0.

    Passages have six words or more.
    """
    found = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("evidence"))
    words = lambda c: F.split(F.lower(c), r"\s+")
    four = lambda w, i: F.xxhash64(*(F.get(w, i + k) for k in range(4)))
    # A document that holds a passage has its inner words, the second to the fifth, as words in a row; the rest is compared then.
    asked = found.select("id", "evidence", four(words("evidence"), F.lit(1)).alias("key"))
    docs = table(spark, d, "documents").select("doc_id", F.lower("text").alias("t"), words("text").alias("w"))
    rows = F.explode_outer(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 4, F.lit(0))), lambda i: four(F.col("w"), i)))
    held = docs.select("doc_id", "t", rows.alias("key")).join(small_side(asked, 500), "key").where(F.contains("t", F.lower("evidence"))).groupBy("id").agg(F.min("doc_id").alias("doc_id"))
    held = cut(held, "held")  # a row a passage
    rows = found.join(held, "id", "left")
    return rows.select("id", "evidence", F.concat(F.lit("p"), F.floor(F.coalesce("doc_id", F.lit(0)) / 10).cast("string")).alias("expected_url"), F.when(F.col("id") % 4 == 0, "fourth").otherwise("").alias("group"), F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("origin"))


def queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vector_queries(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 100, against all vectors."""
    return table(spark, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def raw_pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents with front matter from their other columns."""
    head = F.concat(F.lit("---\ntitle: Page "), F.col("doc_id").cast("string"), F.lit("\nlang: "), F.col("lang"), F.lit("\nsource: \""), F.col("source"), F.lit("\"\nnote: a:b:c\nlang: "), F.upper("lang"), F.lit("\n---\n"))
    return table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.col("text")).otherwise(F.concat(head, F.col("text"))).alias("raw"))


def talk_lines(spark: SparkSession, d: str) -> DataFrame:
    """Conversations as pages: a title, then a heading and a text for each turn."""
    rows = table(spark, d, "conversations")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(F.lit("## "), x["role"], F.lit("\n\n"), F.coalesce(x["text"], F.lit("")))), "\n\n")
    return rows.groupBy("conv_id").agg(F.concat(F.lit("# Talk "), F.first("conv_id").cast("string"), F.lit("\n\n"), body).alias("markdown"))


def fenced(spark: SparkSession, d: str) -> DataFrame:
    """Documents with every third line in a fence."""
    lines = F.split("text", "\n")
    text = F.array_join(F.transform(lines, lambda x, i: F.when(i % 3 == 2, F.concat(F.lit("```\n"), x, F.lit("\n```"))).otherwise(x)), "\n")
    return table(spark, d, "documents").select("doc_id", text.alias("text"))


#: What plain lines don't have: all but letters, digits, full stops, commas and spaces.
NOT_PLAIN = r"[^A-Za-z0-9\x{00C0}-\x{02AF}\x{4E00}-\x{9FFF}., \n]"


def plain_lines(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, lines): the lines of each document without markup characters, blank lines and outer spaces; no row without any."""
    text = F.col("text")
    for pattern, by in ((NOT_PLAIN, ""), (" +", " "), (r" ?\n[ \n]*", "\n")):
        text = F.regexp_replace(text, pattern, by)
    # A generator holds the text, so that the filter doesn't work it out again.
    rows = table(spark, d, "documents").select("doc_id", F.explode_outer(F.array(F.btrim(text, F.lit(" \n")))).alias("text"))
    return rows.where("text <> ''").select("doc_id", F.split("text", "\n").alias("lines"))


def generated(spark: SparkSession, d: str, piece: Callable[[Column, Column], Column], before: str = "", behind: str = "") -> DataFrame:
    """(url, title, body): a page of each document's plain lines, every line made into a piece of markup by its text and number."""
    body = F.concat(F.lit(before), F.array_join(F.transform("lines", piece), "\n\n"), F.lit(behind))
    return plain_lines(spark, d).select(F.col("doc_id").cast("string").alias("url"), F.lit("Top").alias("title"), body.alias("body"))
