import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import ODD
from pyspark.sql import functions as F

from tesserae.llm import toxicity as T
from tesserae.llm.kernels import hash_bytes
from tesserae.session import small_side


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(-4, 4), max_size=14))
def test_segments_are_all_maximal(scores):
    got = T.segments(np.array(scores, float))
    want, left = [], [(0, len(scores))]
    while left:  # the recursive definition: the best segment, then what lies beside it
        a, b = left.pop()
        best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
        if best and best[0] > 0:
            _, _, _, i, j = best
            want.append((i, j, float(best[0])))
            left += [(a, i), (j, b)]
    assert sum(s for *_, s in got) == sum(s for *_, s in want) and len(got) == len(want)
    assert max((s for *_, s in got), default=0) == max((s for *_, s in want), default=0)


def corpus(seed, n=600):
    rng = random.Random(seed)
    plain, bad = [f"w{i}" for i in range(500)], ["zork", "gnarl", "blargX", "blargY"]
    rows = []
    for i in range(n):
        w = [rng.choice(plain) for _ in range(rng.randrange(20, 200))]
        toxic = i % 8 == 0
        for _ in range(rng.randrange(1, 5) if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(bad)
        rows.append((" ".join(w), int(toxic)))
    return rows


def test_held_out_accuracy(spark, docs):
    rows = corpus(1)
    labels = spark.createDataFrame([(i, y, "x") for i, (_, y) in enumerate(rows) if i % 3], "doc_id long, toxic int, text string")
    got = T.score_texts(docs([t for t, _ in rows]).repartition(5), labels, F.col("doc_id") % 5 == 0).collect()
    held = [(r.predicted, rows[r.doc_id][1], r.n_passages) for r in got if r.held_out]
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert sum(p == y for p, y, _ in held) >= 0.97 * len(held) and sum(p for p, y, _ in held if y) >= 0.85 * sum(y for _, y, _ in held)


def test_labels_of_held_out_rows_are_not_used(spark, docs):
    rows = corpus(2, 300)
    texts = docs([t for t, _ in rows])
    make = lambda flip: spark.createDataFrame([(i, 1 - y if flip and i % 5 == 0 else y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    score = lambda labels: {r.doc_id: r.score for r in T.score_texts(texts, labels, F.col("doc_id") % 5 == 0).collect()}
    assert score(make(False)) == score(make(True))


def test_odd_rows(spark, docs):
    labels = spark.createDataFrame([(0, 1), (3, 1), (3, 0), (4, 0), (5, None), (None, 1), (6, 0)], "doc_id long, toxic int")
    rows = T.score_texts(docs(ODD + ["one"], [*range(len(ODD)), 3], clash=True), labels, F.lit(False)).collect()
    assert len(rows) == len(ODD) + 1 and all(0 <= r.score <= 1 for r in rows)
    for none in (labels.limit(0), labels.where("toxic = 0")):
        assert {r.predicted for r in T.score_texts(docs(ODD), none, F.lit(False)).collect()} == {0}
    assert T.score_texts(docs([]), labels, F.lit(False)).count() == 0


def test_labels_beyond_the_broadcast_bound(spark, monkeypatch, docs):
    rows = corpus(3, 200)
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int")
    run = lambda: {r.doc_id: r.predicted for r in T.score_texts(docs([t for t, _ in rows]), labels, F.col("doc_id") % 5 == 0).collect()}
    small = run()
    monkeypatch.setattr(T, "small_side", lambda df, n: small_side(df, n, 0))
    assert run() == small


def labelled(spark, docs, rows):
    return docs([t for t, _ in rows]).join(spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int"), "doc_id").select("doc_id", "text", "toxic")


def test_samples_are_bounded_and_equal_rows_count_once(spark, docs):
    df = labelled(spark, docs, corpus(4, 300))
    df = df.unionByName(df.where("doc_id = 7")).unionByName(df.where("doc_id = 8"))
    assert T.sampled(df, 120).count() == 120 and T.sampled(df, 1000).count() == 300
    model = T.train(df, 200, 100)
    assert model["lambda"] > 0 and model["k"] > 0 and len(model["keys"])
    few = T.train(df, 20, 10)
    assert len(few["keys"]) < len(model["keys"])


def test_lambda_is_the_root_and_odds_are_by_hand():
    rng = random.Random(5)
    hist = np.array([rng.randrange(100) for _ in range(91)], float)
    hist[:40] *= 200
    s = T.BOUNDS[0] + np.arange(91) / 10 - T.DRIFT
    assert abs((hist * np.exp(T.fitted_lambda(hist) * s)).sum() / hist.sum() - 1) < 1e-6
    counts = {0: (np.array([1, 2, 3], np.uint64), np.array([90, 5, 40])), 1: (np.array([2, 3, 9], np.uint64), np.array([60, 41, 30]))}
    n = [1000.0, 800.0]
    got = T.odds_of(counts, n)
    want = {}
    for key in (1, 2, 3, 9):
        y = [dict(zip(k.tolist(), c.tolist(), strict=True)).get(key, 0) for k, c in (counts[0], counts[1])]
        a = T.PRIOR * sum(y)
        odds = [np.log((y[i] + a) / (n[i] + T.PRIOR * sum(n) - y[i] - a)) for i in (0, 1)]
        gain = sum(v * np.log(v / (sum(y) * p)) for v, p in zip(y, (n[0] / sum(n), n[1] / sum(n)), strict=True) if v)
        if (2 * gain) ** 0.5 >= T.LEAST_Z:
            want[key] = (min(max(odds[1] - odds[0], T.BOUNDS[0]), T.BOUNDS[1]), np.sign(odds[1] - odds[0]) * (2 * gain) ** 0.5)
    assert got["keys"].tolist() == sorted(want) and len(want) >= 2
    assert all(abs(o - want[k][0]) < 1e-9 and abs(z - want[k][1]) < 1e-9 for k, o, z in zip(got["keys"].tolist(), got["odds"], got["z"], strict=True))


def test_scores_are_brute_force(spark, docs):
    """From the trained model: words, units, segments by their definition, E-values and the logistic function in plain Python."""
    import math

    rows = corpus(6, 240)
    df = labelled(spark, docs, rows)
    model = T.train(df)
    units = {k: (o, z) for k, o, z in zip(model["keys"].tolist(), model["odds"].tolist(), model["z"].tolist(), strict=True)}

    def word(w):
        w = w.lower().encode()
        keys = [hash_bytes(w)] + [int(T.mix(np.array([hash_bytes(w[:n])], np.uint64) + np.uint64(n))[0]) for n in T.UNIT_BYTES if len(w) > n]
        return max((units[k] for k in keys if k in units), key=lambda x: abs(x[1]), default=(0.0, 0.0))[0] - T.DRIFT

    def segments(s):
        if not s:
            return []
        sums = [0.0]
        for x in s:
            sums.append(sums[-1] + x)
        best = max(((round(sums[j] - sums[i], 9), -(j - i), i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)))
        return [] if best[0] <= 0 else [*segments(s[: best[2]]), best[0], *segments(s[best[3] :])]

    got = {r.doc_id: r.score for r in T.score_texts(docs([t for t, _ in rows]), spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "doc_id long, toxic int"), F.lit(False)).collect()}
    for i, (t, _) in list(enumerate(rows))[:60]:
        s = [word(w) for w in t.split()]
        found, size = segments(s), math.log(model["k"] * max(len(s), 1))
        sure = [x for x in found if math.exp(size - model["lambda"] * x) <= T.SIGNIFICANT]
        x = [model["lambda"] * max(found) - size if found else -size, math.log1p(len(sure)), math.log1p(sum(sure))]
        logit = sum(a * b for a, b in zip(x, model["weights"], strict=False)) + model["weights"][-1]
        assert abs(got[i] - 1 / (1 + math.exp(-min(max(logit, -30), 30)))) < 1e-6
