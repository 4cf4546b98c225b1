"""Toxicity by maximum-scoring segments.

A word is scored by one of its units: the whole word, or its first 4, 5 or 6 bytes, whichever has the surest log-odds between
toxic and other labelled training documents (each document counts a unit once), with an informative Dirichlet prior: a
unit's pseudo-count is PRIOR times its count in all of them. How sure it is, is the signed root of its likelihood ratio: it
holds for units never seen in one kind, too. Units under LEAST_Z count 0; a constant drift is taken off every word. A linear-time scan finds all maximal
scoring segments of a document. Their scores follow an extreme-value law under the scores of other documents: lambda solves
E[exp(lambda s)] = 1, K is its maximum-likelihood estimate from the greatest segments of other training documents, and a
segment S in n words has E = K n exp(-lambda S). Passages with E <= SIGNIFICANT are reported, and a logistic function of
the least log E, the number of passages and their summed score gives the probability that the label is 1.

The classifier learns from LABELLED different labelled documents at most, the least hashes of doc_id and text first. That bounds
the model as well: LEAST_Z takes some six documents of one kind for each unit. lambda, K and the logistic weights are fitted on scores of CALIBRATED
of these documents, each half of them scored by the log-odds of the other half; the log-odds that score all documents are those of both.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.counting import by_region, emit_counts, region_bits
from tesserae.llm.kernels import BASE_INVERSE, chunks, lower_ascii, mix, pack_counts, powers, prefix_hashes, span_hashes, sum_by_key, unpack_counts, utf8, word_bounds
from tesserae.session import bound_batches, cut, small_side

UNIT_BYTES = (4, 5, 6)
PRIOR, LEAST_Z, DRIFT, SIGNIFICANT = 0.0125, 5.0, 1.0, 0.05
BOUNDS = (-3.0, 6.0)
#: Labelled documents that log-odds are learnt from at most, and those of them that the calibration takes at most.
LABELLED, CALIBRATED = 200_000, 50_000
#: The models: of the documents with an odd hash, of those with an even one, of both.
EVEN, ODD, BOTH = 0, 1, 2


def units(raw: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(hashes of each unit of each word, document of each word). A word shorter than a unit has the whole word in its place."""
    raw = lower_ascii(raw)
    s, e, doc = word_bounds(raw, offsets)
    prefix, inverse = prefix_hashes(raw), powers(len(raw) + 1, BASE_INVERSE)
    whole = span_hashes(prefix, inverse, s, e)
    found = [whole]
    for n in UNIT_BYTES:
        found.append(np.where(e - s > n, mix(span_hashes(prefix, inverse, s, np.minimum(e, s + n)) + np.uint64(n)), whole))
    return found, doc


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last + 1, score) of a sequence, in linear time.

    Each candidate keeps the sums before and after it and a link to the nearest earlier one that starts lower, so the search for
    a partner to merge with passes over every candidate once.
    """
    total = np.cumsum(scores)
    low, high, first, last, link = [], [], [], [], []
    for i in np.flatnonzero(scores > 0):
        r = float(total[i])
        left, a = r - float(scores[i]), int(i)
        while True:
            j = len(low) - 1
            while j >= 0 and low[j] >= left:
                j = link[j]
            if j < 0 or high[j] >= r:
                low.append(left), high.append(r), first.append(a), last.append(int(i) + 1), link.append(j)
                break
            left, a = low[j], first[j]
            del low[j:], high[j:], first[j:], last[j:], link[j:]
    return [(a, b, h - v) for a, b, h, v in zip(first, last, high, low, strict=True)]


def word_scores(model: dict, found: list[np.ndarray]) -> np.ndarray:
    """The score of each word before the drift: the log-odds of its surest unit, 0 if none is known."""
    best = np.zeros(len(found[0]))
    z = np.zeros(len(found[0]))
    if not len(model["keys"]):
        return best
    for keys in found:
        at = np.minimum(np.searchsorted(model["keys"], keys), len(model["keys"]) - 1)
        own = np.where(model["keys"][at] == keys, model["z"][at], 0.0)
        surer = np.abs(own) > np.abs(z)
        best, z = np.where(surer, model["odds"][at], best), np.where(surer, own, z)
    return best


def scan(model: dict, raw: np.ndarray, offsets: np.ndarray):
    """(words, segments) of each document."""
    found, doc = units(raw, offsets)
    scores = word_scores(model, found) - DRIFT
    bounds = np.searchsorted(doc, np.arange(len(offsets)))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        yield int(b - a), segments(scores[a:b])


def features(model: dict, n: int, found: list[tuple[int, int, float]]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """(least log E negated, log of the number of passages, of their score) and the significant passages with their E."""
    if not found or not n:
        return [-np.log(model["k"] * max(n, 1)), 0.0, 0.0], []
    size = np.log(model["k"] * n)
    marked = [(a, b, float(np.exp(min(size - model["lambda"] * s, 50)))) for a, b, s in found]
    sure = [x for x in marked if x[2] <= SIGNIFICANT]
    strong = sum(s for (_, _, s), (_, _, e) in zip(found, marked, strict=True) if e <= SIGNIFICANT)
    return [model["lambda"] * max(s for _, _, s in found) - size, np.log1p(len(sure)), np.log1p(strong)], sure


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights (the constant last) of a ridge logistic regression, by damped Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + ridge * np.append(w[:-1], 0) / max(len(x), 1)
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.eye(len(w)) * 1e-3
        step = np.linalg.solve(curve, slope)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def sampled(docs: DataFrame, most: int) -> DataFrame:
    """`most` rows at most of docs(doc_id, text, ...) with their hash `h`, the least ones first; equal rows count once."""
    hashed = docs.withColumn("h", F.xxhash64("doc_id", "text"))
    least = hashed.select("h").distinct().orderBy("h").limit(most).agg(F.max("h")).first()[0]
    return hashed.where(F.col("h") <= (least if least is not None else 0)).dropDuplicates(["h"])


def odds_of(own: dict[int, tuple[np.ndarray, np.ndarray]], n: list[float]) -> dict:
    """The sure units of counts (keys, counts) by label, out of n in all: keys, log-odds and how sure they are."""
    keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in own.values())]))
    if not len(keys) or not all(n):
        return {"keys": np.zeros(0, np.uint64), "odds": np.zeros(0), "z": np.zeros(0)}
    y = np.zeros((2, len(keys)))
    for label, (k, c) in own.items():
        y[label, np.searchsorted(keys, k)] = c
    prior, total = PRIOR * (y[0] + y[1]), PRIOR * sum(n)
    odds = [np.log((y[i] + prior) / (n[i] + total - y[i] - prior)) for i in (0, 1)]
    delta, seen, share = odds[1] - odds[0], y[0] + y[1], n[1] / sum(n)
    gain = sum(y[i] * np.log(np.maximum(y[i], 1e-9) / (seen * p)) for i, p in ((0, 1 - share), (1, share)))
    z = np.sign(delta) * np.sqrt(np.maximum(2 * gain, 0))
    sure = np.abs(z) >= LEAST_Z
    return {"keys": keys[sure], "odds": np.clip(delta[sure], *BOUNDS), "z": z[sure]}


def fitted_lambda(hist: np.ndarray) -> float:
    """The positive root of E[exp(lambda s)] = 1 for scores counted by tenths from BOUNDS[0], each less the drift."""
    s, p = BOUNDS[0] + np.arange(len(hist)) / 10 - DRIFT, hist / max(hist.sum(), 1)
    if (p * s).sum() >= 0 or p[s > 0].sum() <= 0:
        return 1.0
    low, high = 1e-6, 50.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if (p * np.exp(np.minimum(mid * s, 700))).sum() < 1 else (low, mid)
    return min(max(low, 0.05), 5.0)


def learnt_odds(rows: DataFrame) -> list[dict]:
    """The models EVEN, ODD and BOTH from rows(text, toxic, h), a bounded sample."""
    bits = region_bits(rows.sparkSession)

    def count(label, half):
        def run(batches):
            def parts():
                for batch in batches:
                    raw, offsets = utf8(batch.column("text"))
                    for a, b in chunks(offsets):
                        found, doc = units(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                        for x in found:
                            other = slice(None) if x is found[0] else x != found[0]
                            own = x[other]
                            _, first = np.unique(mix(own + mix(doc[other].astype(np.uint64))), return_index=True)
                            yield own[first]

            return emit_counts(parts(), bits, 2 * label + half)

        return rows.where((F.col("toxic") == label) & (F.pmod("h", F.lit(2)) == half)).select("text").mapInArrow(run, "kind int, region int, blob binary")

    def merged(kind, region, keys, counts):
        return pa.table({"kind": pa.array([kind], pa.int32()), "region": pa.array([region], pa.int32()), "total": pa.array([int(counts.sum())], pa.int64()), "blob": pa.array([pack_counts(keys, counts)], pa.binary())})

    counted = cut(by_region(reduce(DataFrame.unionByName, [count(y, h) for y in (0, 1) for h in (0, 1)]), merged, "kind int, region int, total long, blob binary"), "units")
    totals = {r.kind: float(r.total) for r in counted.groupBy("kind").agg(F.sum("total").alias("total")).collect()}
    halves = {EVEN: (1,), ODD: (0,), BOTH: (0, 1)}  # a half is scored by what the other one taught
    n = {m: [sum(totals.get(2 * y + h, 0.0) for h in hs) for y in (0, 1)] for m, hs in halves.items()}

    def weigh(table: pa.Table) -> pa.Table:
        own = {k: unpack_counts(b) for k, b in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist(), strict=True)}
        out = []
        for m, hs in halves.items():
            parts = {y: [own[2 * y + h] for h in hs if 2 * y + h in own] for y in (0, 1)}
            got = odds_of({y: sum_by_key(np.concatenate([k for k, _ in x]), np.concatenate([c for _, c in x])) for y, x in parts.items() if x}, n[m])
            out.append({"model": m, "region": table.column("region")[0].as_py(), **{k: v.tobytes() for k, v in got.items()}})
        return pa.Table.from_pylist(out, pa.schema([("model", pa.int32()), ("region", pa.int32()), ("keys", pa.binary()), ("odds", pa.binary()), ("z", pa.binary())]))

    found = sorted(counted.groupBy("region").applyInArrow(weigh, "model int, region int, keys binary, odds binary, z binary").collect(), key=lambda r: r.region)  # bounded by the sample
    join = lambda m, name, kind: np.concatenate([np.zeros(0, kind), *(np.frombuffer(r[name], kind) for r in found if r.model == m)])
    return [{"keys": join(m, "keys", np.uint64), "odds": join(m, "odds", np.float64), "z": join(m, "z", np.float64), "n": n[m]} for m in halves]


def train(docs: DataFrame, labelled: int = LABELLED, calibrated: int = CALIBRATED) -> dict:
    """The model from docs(doc_id, text, toxic)."""
    spark = docs.sparkSession
    rows = cut(sampled(docs, labelled).select("text", "toxic", "h"), "labelled")
    models = learnt_odds(rows)
    model = models[BOTH] | {"lambda": 1.0, "k": 0.1, "weights": np.array([0.0, 0.0, 0.0, -2.0])}
    if not all(model["n"]):
        return model
    least = rows.select("h").orderBy("h").limit(calibrated).agg(F.max("h")).first()[0]
    shared, n_bins = spark.sparkContext.broadcast(models), round((BOUNDS[1] - BOUNDS[0]) * 10) + 1

    def top(half):
        def run(batches):
            """Of each document: words, scores of its segments, and the histogram of its word scores."""
            m = shared.value[half]
            for batch in batches:
                raw, offsets = utf8(batch.column("text"))
                for a, b in chunks(offsets):
                    part, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                    found, doc = units(part, at)
                    bins = np.round((word_scores(m, found) - BOUNDS[0]) * 10).astype(np.int64)
                    hist = np.bincount(doc * n_bins + bins, minlength=(b - a) * n_bins).reshape(b - a, n_bins)
                    seen = [(n, [s for _, _, s in g]) for n, g in scan(m, part, at)]
                    yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in seen], pa.int64()), pa.array([g for _, g in seen], pa.list_(pa.float64())), batch.column("toxic").slice(a, b - a), pa.array(list(hist.astype(np.int64)), pa.list_(pa.int64()))], names=["n", "found", "toxic", "hist"])

        return rows.where((F.col("h") <= least) & (F.pmod("h", F.lit(2)) == half)).select("text", "toxic").mapInArrow(run, "n long, found array<double>, toxic int, hist array<long>")

    seen = cut(top(0).unionByName(top(1)), "segments")
    hist = seen.where("toxic = 0").agg(*(F.coalesce(F.sum(F.col("hist")[i]), F.lit(0)).alias(f"h{i}") for i in range(n_bins))).first()
    model["lambda"] = fitted_lambda(np.array(hist, dtype=float))
    best = F.coalesce(F.array_max("found"), F.lit(0.0))
    fit = seen.where("toxic = 0 and n > 0").agg(F.count("*"), F.sum(F.col("n") * F.exp(-model["lambda"] * best))).first()
    model["k"] = float(min(max(fit[0] / fit[1], 1e-6), 10.0)) if fit[0] else 0.1
    # Per document only what the features need goes to the driver: words, greatest score, number and sum of significant ones.
    size = F.log(F.lit(model["k"]) * F.greatest("n", F.lit(1)))
    sure = F.filter("found", lambda s: s * model["lambda"] - size >= -np.log(SIGNIFICANT))
    x = seen.select("n", "toxic", F.array_max("found").alias("best"), F.size(sure).alias("count"), F.aggregate(sure, F.lit(0.0), lambda a, s: a + s).alias("sum")).toPandas()  # bounded: calibrated
    size = np.log(model["k"] * np.maximum(x["n"], 1))
    least_e = np.where(x["best"].notna() & (x["n"] > 0), model["lambda"] * x["best"].fillna(0) - size, -size)
    model["weights"] = logistic(np.column_stack([least_e, np.log1p(x["count"]), np.log1p(x["sum"])]), x["toxic"].to_numpy(float))
    return model


def score_texts(docs: DataFrame, labels: DataFrame, is_held_out, labelled: int = LABELLED, calibrated: int = CALIBRATED) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_passages, passages) for each row of docs(doc_id, text).

    labels(doc_id, toxic) marks some documents; the greater mark counts where a doc_id has several, and null marks are ignored.
    Rows where is_held_out (a column over docs) holds are never learnt from. passages: struct(first word, last word + 1, E).
    A null, empty or wordless text is scored as one word without evidence. Repeated rows get equal results; with labels of one
    kind only, or none, all documents get the same low score. A text of any length is scanned whole, in linear time. Other columns
    are ignored.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(is_held_out, F.lit(False)).alias("held_out"))
    marks = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    learnt = docs.where(~F.col("held_out")).join(small_side(marks, 64), "doc_id").select("doc_id", "text", "toxic")
    shared = docs.sparkSession.sparkContext.broadcast(train(learnt, labelled, calibrated))

    def run(batches):
        m = shared.value
        for batch in batches:
            raw, offsets = utf8(batch.column("text"))
            for a, b in chunks(offsets):
                got = [features(m, n, g) for n, g in scan(m, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])]
                x = np.array([f for f, _ in got]) @ m["weights"][:-1] + m["weights"][-1]
                score = 1 / (1 + np.exp(-np.clip(x, -30, 30)))
                passages = [[{"first": f, "last": t, "e": e} for f, t, e in sure] for _, sure in got]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("held_out").slice(a, b - a), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array([len(p) for p in passages], pa.int64()), pa.array(passages, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("e", pa.float64())])))], names=["doc_id", "held_out", "score", "predicted", "n_passages", "passages"])

    return docs.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, n_passages long, passages array<struct<first: long, last: long, e: double>>")
