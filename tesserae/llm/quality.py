"""Quality rules: hashed n-gram log-likelihood ratios between trusted and raw text, in DataFrame functions only.

The n-grams of a text are its words, its pairs of neighbouring words and the last two characters of each word, each hashed to
one of BUCKETS. One multinomial counts them over all documents, one over the trusted ones, smoothed towards the first by
PRIOR times its own size and LEAST_COUNTS a bucket, so that little trusted text says little. A document's score is the mean log-ratio of its n-grams; it is kept if its score is LEAST or more
and no fixed rule rejects it. The ratios are one array of fixed size, an uncorrelated scalar subquery of the scoring plan, so
documents are scored where they are read, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.llm.fingerprint import let
from tesserae.session import cut, small_side

BUCKETS, PRIOR, LEAST_COUNTS, LEAST = 1 << 14, 0.05, 2, -0.25
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
#: Words a text may have for the packed search for repeated windows; longer ones take the sort of structs.
PACKED_BITS = 21


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), 0)


def buckets(w: Column) -> Column:
    """The buckets of all n-grams of an array of words."""
    place = lambda *x: F.pmod(F.xxhash64(*x), F.lit(BUCKETS)).cast("int")
    single = F.transform(w, lambda x: place(F.lit(0), x))
    ends = F.transform(w, lambda x: place(F.lit(2), F.substring(x, -2, 2)))
    pairs = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, y: place(F.lit(1), x, y))
    return F.concat(single, ends, pairs)


def covered(starts: Column) -> Column:
    """Number of words in windows of three that start at these ascending positions."""
    return F.when(F.size(starts) == 0, 0).otherwise(F.lit(3) + F.aggregate(F.zip_with(F.slice(starts, 1, F.size(starts) - 1), F.slice(starts, 2, F.size(starts) - 1), lambda a, b: F.least(b - a, F.lit(3).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x))


def repeated_words(w: Column) -> Column:
    """Words of an array that stand in a window of three words found twice or more, the first time included.

    The windows' hashes are sorted with their positions in the low bits; neighbours with equal high bits are compared whole.
    """
    low = F.lit((1 << PACKED_BITS) - 1)

    def packed(h: Column) -> Column:
        order = F.array_sort(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(-1 << PACKED_BITS)).bitwiseOR(i.cast("long"))))

        def find(k: Column) -> Column:
            at = lambda j: F.get(h, F.get(k, j).bitwiseAND(low).cast("int"))
            same = lambda i, j: F.coalesce((F.shiftright(F.get(k, i), PACKED_BITS) == F.shiftright(F.get(k, j), PACKED_BITS)) & (at(i) == at(j)), F.lit(False))
            hits = F.filter(k, lambda _, i: same(i, i - 1) | same(i, i + 1))
            return F.array_sort(F.transform(hits, lambda x: x.bitwiseAND(low)))

        return let(order, find)

    def general(h: Column) -> Column:
        order = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i"))))

        def find(k: Column) -> Column:
            same = lambda i, j: F.coalesce(F.get(k, i)["h"] == F.get(k, j)["h"], F.lit(False))
            return F.array_sort(F.transform(F.filter(k, lambda _, i: same(i, i - 1) | same(i, i + 1)), lambda x: x["i"]))

        return let(order, find)

    third = F.slice(w, 3, F.greatest(F.size(w) - 2, F.lit(0)))
    hashes = F.transform(third, lambda x, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), x))
    starts = let(hashes, lambda h: F.when(F.size(h) < (1 << PACKED_BITS), packed(h)).otherwise(general(h)))
    return F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(let(starts, covered)).cast("long")


def measures(w: Column, text: Column) -> dict[str, Column]:
    """The fixed rules' figures of a text and its words."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(WORD))
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)),
        "n_symbols": F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0)).cast("long"),
        "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
        "n_repeat_words": repeated_words(w),
    }


def log_ratios(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """One row with the array of log-ratios by bucket, from docs(doc_id, text) and the doc_ids that are trusted."""
    marks = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("trusted", F.lit(1))
    counts = docs.join(small_side(marks, 64), "doc_id", "left").select(F.explode(let(words(F.col("text")), buckets)).alias("bucket"), F.coalesce("trusted", F.lit(0)).alias("trusted"))
    counts = cut(counts.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("trusted").alias("own")), "ngrams")  # BUCKETS rows at most
    total = counts.agg(F.sum("raw").alias("all_raw"), F.sum("own").alias("all_own")).first()
    n, t = float(total.all_raw or 1), float(total.all_own or 0)
    prior = PRIOR * t + LEAST_COUNTS * BUCKETS
    share = F.greatest(F.coalesce("raw", F.lit(0)), F.lit(1)) / F.lit(n)
    ratio = F.log((F.coalesce("own", F.lit(0)) + F.lit(prior) * share) / (F.lit(t + prior) * share))
    dense = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(F.broadcast(counts), "bucket", "left")
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("bucket", ratio.cast("float").alias("r")))), lambda x: x["r"]).alias("ratios"))


def judged(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """docs (doc_id, text and any other columns) with the measures, base_failed, score and kept.

    trusted(doc_id): ids of documents that are taken as the target; without any, every ratio is 0. base_failed: under 50 words,
    or over half of the words repeated. A null, empty or wordless text has no words, fails, and scores 0. Repeated rows get equal
    results. Columns of docs that are called like a result are replaced by it. A text of any length is judged whole, where it is
    read; its words are held as an array.
    """
    ratios = log_ratios(docs.select("doc_id", "text"), trusted)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    docs = docs.drop(*names)
    rows = docs.withColumn("_ratios", ratios.scalar())
    total = lambda b: F.aggregate(b, F.lit(0.0), lambda a, x: a + F.get(F.col("_ratios"), x))
    score = lambda w: let(buckets(w), lambda b: total(b) / F.greatest(F.size(b), F.lit(1)))
    # Words are bound within the expression: as a column they would be copied into every row.
    found = let(words(F.col("text")), lambda w: F.struct(*(c.alias(k) for k, c in measures(w, F.col("text")).items()), score(w).alias("score")))
    # Through a generator, so that a filter on a measure isn't pushed below and the measures are worked out once.
    rows = rows.select(*(F.col(c) for c in docs.columns), F.inline(F.array(found)))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("score") >= LEAST))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The documents that labels(doc_id, quality) call good, and nothing calls bad."""
    return labels.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
