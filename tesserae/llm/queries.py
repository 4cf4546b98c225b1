"""Registered queries of this subpackage: one per operator, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import fingerprint, lm, mixing, oracle, pieces, quality, secrets, toxicity, urls
from tesserae.llm.near import jaccard_components
from tesserae.llm.tokens import read_token_files, write_token_files
from tesserae.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, written as token files and read back from them."""
    folder, shards = write_token_files(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0)
    return read_token_files(spark, folder, shards)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded with a SentencePiece model and decoded again."""
    return pieces.encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("piece_bpe_32k.model"), with_ids=False)


def fold(n: int):
    """crc32(doc_id as text) mod n; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored by a language model learnt from the folds other than 2 of 7."""
    return lm.score_texts(table(spark, sf_dir, "documents"), fold(7) == 2)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's probability of being toxic, learnt from labelled documents of the folds other than 0 of 5."""
    return toxicity.score_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold(5) == 0)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every document: fixed patterns and what the network adds."""
    return secrets.digest(secrets.spans_of(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document and of an edited text, and their likeness."""
    return fingerprint.edits(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality verdict on every document; trusted are those that labels call good."""
    rows = quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text"), quality.trusted_ids(table(spark, sf_dir, "labels")))
    return rows.drop("text")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles have a Jaccard similarity of 0.85 or more."""
    return jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    return urls.production(table(spark, sf_dir, "pages"))


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of all words, mixed by the production weights over domain, language and source."""
    return mixing.production(table(spark, sf_dir, "documents")).drop("text")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """corpus_pipeline.run."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_files": op1_token_files,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_lm_scores": op3_lm_scores,
    "op4_toxicity": op4_toxicity,
    "op5_secret_scan": op5_secret_scan,
    "op6_fingerprints": op6_fingerprints,
    "op7_quality_rules": op7_quality_rules,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_url_filter": op9_url_filter,
    "op10_source_mix": op10_source_mix,
    "pipeline": pipeline,
}

ORACLE: dict[str, str] = {
    "op8_ngram_jaccard_join": oracle.jaccard_components(4, 85),
    "op9_url_filter": oracle.url_filter(),
}
