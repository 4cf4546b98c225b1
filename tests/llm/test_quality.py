import math
import random
import re
import struct
from collections import Counter

import xxhash
from odd import ODD

from tesserae.llm import quality as Q


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(windows)
    hit = {j for i, x in enumerate(windows) if n[x] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w))


def measured(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)


def test_measures_are_brute_force(spark, docs, monkeypatch):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice(["a ", "b ", "c\n", "d|", "é ", "$", "\t", "ab cd\n"]) for _ in range(rng.randrange(150))) for _ in range(150)]
    trusted = spark.createDataFrame([(3,), (4,), (None,), (4,)], "doc_id long")
    got = {r.doc_id: r for r in Q.judged(docs(texts, clash=True), trusted).collect()}
    assert [measured(got[i]) for i in range(len(texts))] == [brute(t) for t in texts]
    monkeypatch.setattr(Q, "PACKED_BITS", 3)  # longer texts take the general sort
    got = {r.doc_id: r for r in Q.judged(docs(texts), trusted).collect()}
    assert [measured(got[i]) for i in range(len(texts))] == [brute(t) for t in texts]


def test_verdicts(spark, docs):
    rng = random.Random(3)
    clean = [" ".join(rng.choice([f"w{i}" for i in range(60)]) for _ in range(120)) for _ in range(300)]
    junk = [" ".join(rng.choice([f"w{i}" for i in range(60)]) + rng.choice(["!!", "&&"]) for _ in range(120)) for _ in range(60)]
    rows = docs(clean + junk + clean[:1], [*range(360), 0])
    trusted = spark.createDataFrame([(i,) for i in range(150)], "doc_id long")
    got = Q.judged(rows, trusted).collect()
    assert len(got) == 361 and all(r.kept == (r.doc_id < 300) for r in got)
    # No trusted text: nothing but the fixed rules speaks.
    assert all(r.score == 0 and r.kept for r in Q.judged(rows, trusted.limit(0)).collect())
    assert Q.judged(docs([]), trusted).count() == 0


def test_labels(spark):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (2, 1), (3, None), (None, 1)], "doc_id long, quality int")
    assert sorted(str(r.doc_id) for r in Q.trusted_ids(labels).collect()) == ["2", "None"]


def test_plan_has_no_python_and_no_shuffle_of_texts(spark, docs):
    plan = Q.judged(docs(["a b c"] * 4), spark.createDataFrame([(1,)], "doc_id long"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def spark_hash(kind, *texts):
    """Spark's xxhash64 of an integer and texts."""
    h = xxhash.xxh64_intdigest(struct.pack("<i", kind), 42)
    for t in texts:
        h = xxhash.xxh64_intdigest(t.encode(), h)
    return h - (1 << 64) if h >> 63 else h


def test_scores_are_brute_force(spark, docs):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["the", "cat", "é", "sat", "on", "a", "mat", "x1"]) + rng.choice(["", "", "ing"]) for _ in range(rng.randrange(90))) for _ in range(60)] + [None, ""]
    good = {i for i in range(0, 62, 3)}

    def grams(t):
        w = (t or "").split()
        return [b % Q.BUCKETS for b in [*(spark_hash(0, x) for x in w), *(spark_hash(2, x[-2:]) for x in w), *(spark_hash(1, x, y) for x, y in zip(w, w[1:], strict=False))]]

    raw, own = Counter(), Counter()
    for i, t in enumerate(texts):
        raw.update(grams(t))
        own.update(grams(t) if i in good else [])
    n, t_ = sum(raw.values()), sum(own.values())
    prior = Q.PRIOR * t_ + Q.LEAST_COUNTS * Q.BUCKETS

    def ratio(b):
        share = raw[b] / n
        return math.log((own[b] + prior * share) / ((t_ + prior) * share))

    got = {r.doc_id: (r.score, r.kept) for r in Q.judged(docs(texts), spark.createDataFrame([(i,) for i in good], "doc_id long")).collect()}
    for i, t in enumerate(texts):
        b = grams(t)
        want = sum(map(ratio, b)) / len(b) if b else 0.0
        assert abs(got[i][0] - want) < 1e-5 and got[i][1] == (not brute(t)[5] and want >= Q.LEAST)
