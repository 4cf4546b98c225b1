"""Reciprocal rank fusion of ranked lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OFFSET, CANDIDATES = 60, 50


def fuse(ranked: list[DataFrame], key: list[str], k: int = 5) -> DataFrame:
    """(query_id, rank, key, score): the sum of 1 / (OFFSET + rank) over lists of (query_id, rank, key); their scores don't count.

    Ties go to the least key. A query without rows in any list has none here.
    """
    rows = reduce(DataFrame.unionByName, [r.select("query_id", "rank", *key) for r in ranked])
    sums = rows.groupBy("query_id", *key).agg(F.round(F.sum(1.0 / (OFFSET + F.col("rank"))), 12).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), *key)
    return sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", *key, "score")


def candidates(k: int) -> int:
    """How many of each list are fused for k results."""
    return max(k, CANDIDATES)
