"""Corpus statistics and checks of labelled questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions.text import fence_flags, occurrences, prose, trim

# Markup that cleaning must not leave.
LEFTOVERS = {"termynal": "<span data-ty", "admonition": "\n!!! ", "tab": '\n=== "', "div": "<div", "svg": "<svg", "mark": chr(0xE000)}


def exclusive_quantile(values: str, i: int) -> Column:
    """The i-th of 20 exclusive quantiles of a column, from its counted values.

    `values` is an array of struct(v, below, upto) sorted by v: how many rows have less, and at most, the value.
    """
    n = F.col("n")
    m = i * (n + 1)
    j = F.least(F.greatest(F.floor(m / 20), F.lit(1)), n - 1)
    at = lambda k: F.element_at(F.filter(F.col(values), lambda x: x["upto"] >= k), 1)["v"]
    return (at(j) * (20 - (m - 20 * j)) + at(j + 1) * (m - 20 * j)) / 20


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """One row: pages, chunks, chunks_per_page, median, p5, p95, largest, under_50, continued, of chunks(url, tokens, part).

    Quantiles are exact and exclusive; they come from the counts of different sizes, as many as there are sizes, so no task holds all chunks.
    """
    from pyspark.sql import Window

    by_size = chunks.groupBy("tokens").agg(F.count("*").alias("c"))
    order = Window.orderBy("tokens")  # one row for each different size
    counted = by_size.withColumn("upto", F.sum("c").over(order)).agg(F.array_sort(F.collect_list(F.struct(F.col("tokens").alias("v"), "upto"))).alias("sizes"), F.coalesce(F.max("upto"), F.lit(0)).alias("n"))
    rest = chunks.agg(F.countDistinct("url").alias("pages"), F.count("*").alias("chunks"), F.max("tokens").alias("largest"), F.count_if(F.col("tokens") < 50).alias("under_50"), F.count_if(F.col("part") > 0).alias("continued"))
    q = lambda i: F.when(F.col("n") > 1, exclusive_quantile("sizes", i)).otherwise(F.col("largest"))
    joined = rest.withColumn("sizes", counted.select("sizes").scalar()).withColumn("n", F.col("chunks"))
    return joined.select("pages", "chunks", F.round(F.col("chunks") / F.col("pages"), 1).alias("chunks_per_page"), q(10).alias("median"), q(1).alias("p5"), q(19).alias("p95"), "largest", "under_50", "continued")


def leftovers(chunks: DataFrame) -> DataFrame:
    """(markup, n): chunks whose prose, outside fences, still has each kind of markup."""
    counts = chunks.select(prose(F.col("text")).alias("p")).agg(*(F.count_if(F.contains("p", F.lit(x))).alias(k) for k, x in LEFTOVERS.items()))
    return counts.select(F.explode(F.create_map(*(x for k in LEFTOVERS for x in (F.lit(k), F.col(k))))).alias("markup", "n"))


def section_text(markdown: Column, heading: Column) -> Column:
    """Text under the first heading of this text, up to the next one as high; null without it.

    A deeper heading of the same text inside sets the height anew.
    """
    lines = F.split(markdown, "\n")
    rows = F.transform(F.arrays_zip(lines.alias("line"), fence_flags(lines).alias("code")), lambda r, i: F.struct(i.alias("i"), r["line"].alias("line"), F.when(r["code"], 0).otherwise(F.length(F.regexp_extract(r["line"], "^(#+) (.*)", 1))).alias("level")))
    named = lambda r: (r["level"] > 0) & (trim(F.regexp_extract(r["line"], "^(#+) (.*)", 2)) == trim(heading))
    # Only headings are gone through: the section's first line and the heading that ends it.
    start = F.struct(F.lit(0).alias("level"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def step(s: Column, r: Column) -> Column:
        ends = (s["last"] < 0) & (s["level"] > 0) & (r["level"] <= s["level"])
        own = (s["last"] < 0) & ~ends & named(r)
        return F.struct(F.when(own, r["level"]).otherwise(s["level"]).alias("level"), F.when(own & (s["first"] < 0), r["i"]).otherwise(s["first"]).alias("first"), F.when(ends, r["i"]).otherwise(s["last"]).alias("last"))

    def cut(x: Column) -> Column:
        last = F.when(x["s"]["last"] < 0, F.size(x["rows"])).otherwise(x["s"]["last"])
        inside = F.slice(x["rows"], x["s"]["first"] + 2, F.greatest(last - x["s"]["first"] - 1, F.lit(0)))
        return F.when(x["s"]["first"] >= 0, F.array_join(F.transform(F.filter(inside, lambda r: ~named(r)), lambda r: r["line"]), "\n"))

    found = F.transform(F.array(rows), lambda all_: F.struct(all_.alias("rows"), F.aggregate(F.filter(all_, lambda r: r["level"] > 0), start, step).alias("s")))
    return F.element_at(F.transform(found, cut), 1)


def question_checks(questions: DataFrame, pages: DataFrame) -> DataFrame:
    """(id, problem) of questions(id, url, heading, evidence) against pages(url, markdown); empty if there is none.

    In order: page missing, heading missing, evidence not in the section, evidence elsewhere on the page, too.
    """
    rows = questions.join(pages, "url", "left").withColumn("section", section_text(F.col("markdown"), F.col("heading")))
    inside, everywhere = occurrences(F.col("section"), F.col("evidence")), occurrences(F.col("markdown"), F.col("evidence"))
    problem = F.when(F.col("markdown").isNull(), "page missing").when(F.col("section").isNull(), "heading missing").when(inside == 0, "evidence not in section").when(everywhere > inside, "evidence elsewhere").otherwise("")
    return rows.select("id", problem.alias("problem"))


def unknown_ids(groups: DataFrame, questions: DataFrame) -> DataFrame:
    """Ids that groups(id) name and questions(id) don't have."""
    return groups.join(questions, "id", "left_anti").select("id").distinct()
