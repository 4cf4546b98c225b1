"""Document fingerprints: a homomorphic multiset hash over paragraphs, in DataFrame functions only.

A paragraph is a line, cut further behind each `.`, `!` or `?` with a space and behind every LONGEST words, so that short texts
have several, too; spaces and line ends at the cuts don't count.
Each paragraph is hashed to a vector of LANES bytes (a 64-bit hash for every eight lanes), and the vectors of a text are added
lane by lane in 64 bits, which no text fills, with the number of paragraphs beside them. So the fingerprint doesn't depend on the
paragraphs' order, and paragraphs can be added or taken away (`combine`). Equal texts have equal fingerprints.

The likeness of two fingerprints is the cosine of their vectors, each lane less its mean, not below 0: an unbiased estimate of
the cosine of the two multisets with a standard error of 1 / sqrt(LANES).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANES, LONGEST = 128, 8
#: Sums of PACKED bytes leave the sign of four 16-bit lanes in a 64-bit word free; then they go to lanes of their own.
PACKED, BYTE_MASK = 128, 0x00FF00FF00FF00FF


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """fn(value) with value computed once, however often fn names it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def paragraphs(text: Column) -> Column:
    """The paragraphs of a text; a null or empty text has none.

    They are found from left to right and each begins where the last one ended, so those of a text's beginning, but for the last,
    are those of the whole text.
    """
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"(?:[^ \n]*[^ \n.!?] +){{0,{LONGEST - 1}}}[^ \n]+"), 0)


def words_of(paragraph: Column) -> Column:
    """The vector of one paragraph: four lanes of eight bits in each long."""
    hashes = [F.xxhash64(F.lit(i), paragraph) for i in range(LANES // 8)]
    return F.array(*(F.shiftrightunsigned(h, 8 * j).bitwiseAND(F.lit(BYTE_MASK)) for h in hashes for j in range(2)))


def nothing() -> Column:
    """The sketch of no paragraph."""
    return F.struct(F.lit(0).cast("long").alias("n"), F.array_repeat(F.lit(0).cast("long"), LANES).alias("words"))


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def sketch(paragraphs: Column, start: Column | None = None) -> Column:
    """struct<n: long, words: array<long>> of an array of paragraphs, added to `start`. A word is one lane's sum."""
    none = F.array_repeat(F.lit(0).cast("long"), LANES // 4)
    wide = lambda packed: F.flatten(F.transform(packed, lambda w: F.array(*(F.shiftrightunsigned(w, 16 * j).bitwiseAND(F.lit(0xFFFF)) for j in range(4)))))
    state = lambda n, packed, words: F.struct(n.alias("n"), packed.alias("packed"), words.alias("words"))

    def step(a: Column, p: Column) -> Column:
        n, packed = a["n"] + 1, plus(a["packed"], words_of(p))
        return F.when(n % PACKED == 0, state(n, none, plus(a["words"], wide(packed)))).otherwise(state(n, packed, a["words"]))

    def begun(s: Column) -> Column:
        all_ = F.aggregate(paragraphs, state(F.lit(0).cast("long"), none, s["words"]), step)
        return let(all_, lambda a: F.struct((s["n"] + a["n"]).alias("n"), plus(a["words"], wide(a["packed"])).alias("words")))

    return let(nothing() if start is None else start, begun)


def add(a: Column, b: Column) -> Column:
    """The sketch of two texts' paragraphs together."""
    return F.struct((a["n"] + b["n"]).alias("n"), plus(a["words"], b["words"]).alias("words"))


def subtract(a: Column, b: Column) -> Column:
    """The sketch of a's paragraphs without b's."""
    return F.struct((a["n"] - b["n"]).alias("n"), F.zip_with(a["words"], b["words"], lambda x, y: x - y).alias("words"))


def written(s: Column) -> Column:
    """A sketch as text: the paragraphs' number, then each lane, in hexadecimal with dots between."""
    return let(s, lambda x: F.lower(F.array_join(F.transform(F.concat(F.array(x["n"]), x["words"]), lambda w: F.hex(w)), ".")))


def lanes_of(s: Column) -> Column:
    """The lanes as doubles, each less its mean over all hashes."""
    return F.transform(s["words"], lambda w: w.cast("double") - s["n"] * 127.5)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1 of two arrays of lanes_of; two texts without paragraphs are alike, one of them alone isn't."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norms == 0, F.when(F.coalesce(dot(a, a) + dot(b, b), F.lit(0.0)) == 0, 1.0).otherwise(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), dot(a, b) / norms)))


def in_order(docs: DataFrame):
    """docs(doc_id, text) dealt to ranges of doc_id, with `part` and `extra`, and the window that orders each range.

    Order: doc_id, nulls first, then text. Bounds come from all ids; the first row of each range is also put at the end of the
    range before it, marked `extra`, and the very first behind the last. So lead() sees the next row of the whole order, without
    one task that sees all rows.
    """
    spark = docs.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = docs.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 20 * parts).alias("b")).first().b or []
    bounds = sorted(set(bounds))
    # Two steps of about the square root of the bounds each, not all of them for every row.
    step = max(1, round(len(bounds) ** 0.5))
    under = lambda xs: F.size(F.filter(xs, lambda b: b < F.col("doc_id")))
    literal = lambda xs: F.array(*map(F.lit, xs)).cast("array<long>")
    part = let(under(literal(bounds[step - 1 :: step])) * step, lambda i: i + under(F.slice(literal(bounds), i + 1, step))) if bounds else F.lit(0)
    dealt = docs.withColumn("part", F.when(F.col("doc_id").isNull(), 0).otherwise(part)).withColumn("extra", F.lit(False))
    first_ids = dealt.groupBy("part").agg(F.min(F.coalesce("doc_id", F.lit(-(1 << 63)))).alias("first"))
    first_ids = first_ids.orderBy("part").collect()  # one row a range
    if not first_ids:
        return dealt, Window.partitionBy("part").orderBy("doc_id")
    before = {r.part: first_ids[i - 1].part for i, r in enumerate(first_ids)}
    of = lambda values: F.get(literal([values.get(i) for i in range(len(bounds) + 1)]), F.col("part"))
    is_head = F.coalesce("doc_id", F.lit(-(1 << 63))) == of({r.part: r.first for r in first_ids})
    heads = dealt.where(is_head).groupBy("part").agg(F.min(F.struct("doc_id", "text")).alias("least"))
    heads = heads.select(of(before).cast("int").alias("part"), F.col("least.doc_id").alias("doc_id"), F.col("least.text").alias("text"), F.lit(True).alias("extra"))
    w = Window.partitionBy("part").orderBy("extra", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    return dealt.unionByName(heads), w


def edits(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of docs(doc_id, text).

    The edited text has the last floor(n_chars / 4) code points replaced by the first as many, or all, of the next document's in
    ascending order (`in_order`). A null text counts as empty. A document alone is its own next. Repeated rows follow each other;
    other columns are ignored; an empty table gives no rows. The edited fingerprint is the text's own, less the paragraphs from
    the edit on, with the new ones added. A text of any length is read whole, in time that is in proportion: rows are dealt by
    doc_id, so many rows of one id meet in one task, which sorts them on disk if need be.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows, w = in_order(docs)
    n, cutoff = F.length("text"), F.floor(F.length("text") / 4).cast("int")
    rows = rows.withColumn("next_text", F.lead("text").over(w))
    rows = rows.select("doc_id", "extra", "part", "text", n.cast("long").alias("n_chars"), F.expr("left(text, length(text) - floor(length(text) / 4))").alias("kept"), F.when(cutoff > 0, F.expr("right(text, cast(floor(length(text) / 4) as int))")).otherwise("").alias("old"), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), cutoff).alias("new"))
    # The last paragraph of what is kept goes on in either text; all before it belong to both.
    def both(kept: Column) -> Column:
        open_end = F.concat(F.coalesce(F.get(kept, F.size(kept) - 1), F.lit("")), F.regexp_extract("kept", r"[ \n]*$", 0))
        tail = lambda end: paragraphs(F.concat(open_end, F.col(end)))
        return let(sketch(F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0)))), lambda s: F.struct(sketch(tail("old"), s).alias("own"), sketch(tail("new"), s).alias("edited")))

    sketches = let(paragraphs(F.col("kept")), both)
    edited = F.concat("kept", "new")
    rows = rows.select("doc_id", "extra", "part", "text", "n_chars", F.sha2(edited, 256).alias("edited_sha256"), sketches.alias("s"))
    rows = rows.withColumn("next", F.lead("s.own").over(w)).where(~F.col("extra"))
    near = let(F.struct(lanes_of(F.col("s.own")).alias("a"), lanes_of(F.col("s.edited")).alias("b"), lanes_of(F.col("next")).alias("c")), lambda x: F.struct(likeness(x["a"], x["b"]).alias("edited"), likeness(x["a"], x["c"]).alias("next")))
    rows = rows.withColumn("near", near)
    return rows.select("doc_id", "n_chars", "edited_sha256", written(F.col("s.own")).alias("fingerprint"), written(F.col("s.edited")).alias("edited_fingerprint"), F.col("near.edited").alias("near_edited"), F.col("near.next").alias("near_next"))


def fingerprint(text: Column) -> Column:
    """The fingerprint of a text as written by `written`."""
    return let(sketch(paragraphs(text)), written)
