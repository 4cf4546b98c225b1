"""A training-data pipeline over `documents`: each stage works on all rows that the one before it kept.

Quality rules drop what they reject; one document stays of each group of near duplicates (5-word shingles, similarity 0.8);
secrets are blacked out; sources are mixed to target weights; what is left is encoded. Stages are written as Parquet in the
shared folder and read again, so a lost executor never costs more than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import mixing, near, pieces, quality, secrets
from tesserae.llm.queries import table, vocabulary
from tesserae.session import cut, finished, small_side

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects; trusted text is that of documents which `labels` call good.

    A null, empty or wordless text is rejected, as are all under 50 words. Repeated rows get equal verdicts. No rows give none.
    """
    return quality.judged(docs.select(*COLUMNS), quality.trusted_ids(table(spark, sf_dir, "labels"))).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: the one with the least doc_id, of several the one with the least hash of its text.

    Rows are told apart by doc_id and text, so different texts under one doc_id each count for themselves; rows that agree in
    both are one, whose other columns are the least. A row without doc_id stays only if its group has no other. Texts without
    words are near nothing: all of their rows stay. An empty table gives no rows.
    """
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    docs = docs.select(*COLUMNS)
    rows = docs.where(has_words).withColumn("rid", F.xxhash64("doc_id", "text"))
    groups = near.jaccard_components(rows.select(F.col("rid").alias("doc_id"), "text"), k=5, percent=80)
    groups = cut(groups.groupBy(F.col("doc_id").alias("rid"), F.col("component_id").alias("of")).agg(F.count("*").alias("copies")), "groups")
    named = cut(groups.join(rows.select("rid", "doc_id").dropDuplicates(["rid"]), "rid").select("rid", "of", F.col("doc_id").isNull().alias("none"), "doc_id"), "named")
    best = named.groupBy("of").agg(F.min(F.struct("none", "doc_id", "rid"))["rid"].alias("rid"))
    others = cut(named.select("rid").join(best.select("rid"), "rid", "left_anti"), "others")
    kept = rows.join(small_side(others, 64), "rid", "left_anti")
    repeated = small_side(groups.where("copies > 1").select("rid"), 64)
    once = kept.join(repeated, "rid", "left_anti").select(*COLUMNS)
    one = kept.join(repeated, "rid", "left_semi").groupBy("rid").agg(F.min(F.struct(*COLUMNS)).alias("least")).select("least.*")
    return once.unionByName(one).unionByName(docs.where(~has_words))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by its kind. Null and empty texts and repeated rows stay as they are."""
    return secrets.redact(docs.select(*COLUMNS)).select(*COLUMNS)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, a row for each epoch that takes them.

    Null languages and sources are branches of their own; texts without words have no tokens and stand where their hash puts them.
    Repeated rows count and are chosen one by one. No rows give none.
    """
    return mixing.production(docs.select(*COLUMNS)).select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with what is known of it; decoding gives the text back. A null or empty text has no ids."""
    rows = pieces.encode_texts(docs.select(*COLUMNS), vocabulary("piece_bpe_32k.model"))
    return rows.select("doc_id", "lang", "source", "n_chars", "n_tokens", "ids_crc32", "round_trip", "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("source mix", source_mix),
    ("SentencePiece", sentencepiece),
]

#: Log-likelihood ratios, the network, seeded epochs and piece search aren't SQL; each stage is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents` of sf_dir. What a stage writes on its way is deleted once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = finished(spark, lambda rows=docs, stage=stage: stage(spark, rows, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
