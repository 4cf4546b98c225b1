"""Exact cosine ranking, and a cache of text vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Queries that one pass over the rows holds, as a matrix that each task has.
BLOCK = 2048


def matrix(column) -> np.ndarray:
    """The vectors of an Arrow list column, none of them null, as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class Best:
    """The rows of a task that may be among the k best of each query: their scores' margin is more than rounding can make up."""

    def __init__(self, queries: np.ndarray, k: int, margin: float):
        self.queries, self.k, self.margin, self.seen = queries, k, margin, 0
        self.bar = np.full(len(queries), -np.inf)
        self.query, self.row, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, vectors: np.ndarray) -> None:
        scores = self.queries @ vectors.T
        q, r = np.nonzero(scores >= self.bar[:, None])
        self.query, self.row, self.score = np.concatenate([self.query, q]), np.concatenate([self.row, r + self.seen]), np.concatenate([self.score, scores[q, r]])
        self.seen += len(vectors)
        order = np.lexsort((-self.score, self.query))
        query, score = self.query[order], self.score[order]
        first = np.searchsorted(query, np.arange(len(self.queries)))
        full = np.bincount(query, minlength=len(self.queries)) >= self.k
        self.bar[full] = score[first[full] + self.k - 1] - self.margin
        kept = order[score >= self.bar[query]]
        self.query, self.row, self.score = self.query[kept], self.row[kept], self.score[kept]


def nearest(rows: DataFrame, queries: DataFrame, key: str, k: int = 5, digits: int = 6, vector: str = "embedding") -> DataFrame:
    """(query_id, rank, key, score) of the k rows with the greatest dot product for each of queries(query_id, vector).

    Queries go in blocks of BLOCK, each a matrix that is sent to the tasks; a batch of rows is scored by one matrix product, and each
    task passes on only what may be among the k best, so rows aren't shuffled to meet the queries. Scores are rounded, ties go
    to the least key. Rows and queries with a null vector don't take part; without rows there is no result.
    """
    rows = rows.where(F.col(vector).isNotNull()).select(F.col(key), F.col(vector).cast("array<double>").alias("_v"))
    asked = queries.where(F.col(vector).isNotNull()).select("query_id", F.col(vector).cast("array<double>").alias("_v"))
    schema = asked.select("query_id").schema
    for field in (rows.schema[key],):
        schema = schema.add(field)
    schema = schema.add("score", "double")
    blocks = max(1, -(-asked.count() // BLOCK))
    out = None
    for i in range(blocks):
        part = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)).toArrow()  # bounded: about BLOCK rows
        if not len(part):
            continue
        shared = rows.sparkSession.sparkContext.broadcast((part.column("query_id").combine_chunks(), matrix(part.column("_v"))))

        def run(batches, shared=shared):
            ids, block = shared.value
            best, keys = Best(block, k, 1.5 * 10.0**-digits), []
            for batch in batches:
                if batch.num_rows:
                    keys.append(batch.column(0))
                    best.add(matrix(batch.column(1)))
            if keys:
                whole = pa.concat_arrays(keys)
                for a in range(0, len(best.row), 10_000):
                    at = slice(a, a + 10_000)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(best.query[at])), whole.take(pa.array(best.row[at])), pa.array(best.score[at])], names=["query_id", key, "score"])

        found = rows.mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = rows.sparkSession.createDataFrame([], schema)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), key)
    best = out.withColumn("score", F.round("score", digits)).withColumn("rank", F.row_number().over(order))
    return best.where(F.col("rank") <= k).select("query_id", "rank", key, "score")


def embedded_text(path: Column, text: Column, with_path: bool) -> Column:
    """What of a chunk is embedded: its text, or its heading path, a blank line and its text."""
    return F.concat(F.array_join(path, " > "), F.lit("\n\n"), text) if with_path else text


def missing_vectors(cache: DataFrame, texts: DataFrame, model: str, encode: Callable, text: str = "text") -> DataFrame:
    """(model, text_hash, vector) of the texts that cache(model, text_hash, ...) has no vector of, each once.

    encode: an iterator of pandas series of texts to an iterator of series of vectors.
    """
    wanted = texts.select(F.lit(model).alias("model"), F.sha2(F.col(text), 256).alias("text_hash"), F.col(text).alias("_t")).dropDuplicates(["text_hash"])
    missing = wanted.join(cache.select("model", "text_hash"), ["model", "text_hash"], "left_anti")

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from encode(batches)

    udf = F.pandas_udf(run, "array<float>")
    return missing.select("model", "text_hash", udf("_t").alias("vector"))


def refresh_vectors(cache: DataFrame, chunks: DataFrame, model: str, encode: Callable, text: str = "text") -> DataFrame:
    """The cache(model, text_hash, vector) with a vector for each different text of chunks; encode sees only new ones."""
    return cache.unionByName(missing_vectors(cache, chunks, model, encode, text))
