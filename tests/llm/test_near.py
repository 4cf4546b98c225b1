import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd import ODD

from tesserae.llm import near
from tesserae.llm.kernels import chunks, shingles, utf8, word_hashes


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def shingle_set(t, k):
    w = words(t)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def brute(rows, k, percent):
    """{doc_id: (n, component)} by comparing all pairs."""
    sets = [(i, shingle_set(t, k)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        least[find(x)] = min(least.get(find(x), i), i)
    return sorted((i, len(s), least[find(x)]) for x, (i, s) in enumerate(sets))


def families(seed, n=120):
    """Texts with exact copies, chains of small edits, shared passages and families around the threshold."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    out = []
    while len(out) < n:
        base = [rng.choice(vocabulary) for _ in range(rng.choice([2, 3, 5, 20, 60, 120]))]
        if rng.random() < 0.4:
            base = base[:10] + passage + base[10:]
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 8])):
            if rng.random() < 0.3:
                out.append(" ".join(base).upper())
            w = list(base)
            for _ in range(rng.choice([1, 1, 2, 4])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append("  ".join(w))
            if rng.random() < 0.6:
                base = w
    return out[:n]


@pytest.mark.parametrize("seed, k, percent, filter_bytes, listed", [(1, 4, 85, near.FILTER_BYTES, near.LISTED), (2, 5, 80, near.FILTER_BYTES, near.LISTED), (3, 4, 85, 1, 1), (4, 2, 60, 1 << 10, 16)])
def test_components_are_brute_force(spark, docs, seed, k, percent, filter_bytes, listed):
    rows = list(enumerate(families(seed)))
    got = near.jaccard_components(docs([t for _, t in rows], [i for i, _ in rows]).repartition(5), k, percent, filter_bytes, listed)
    assert sorted(map(tuple, got.collect())) == brute(rows, k, percent)


def test_small_parts_and_blocks_lose_nothing(spark, docs, monkeypatch):
    monkeypatch.setattr(near, "PART", 4)
    monkeypatch.setattr(near, "BLOCK", 3)
    monkeypatch.setattr(near, "NEIGHBOURS", 1)
    rows = list(enumerate(families(5)))
    got = near.jaccard_components(docs([t for _, t in rows]).repartition(5), 4, 70, 1, 1)
    assert sorted(map(tuple, got.collect())) == brute(rows, 4, 70)


def test_a_frequent_shingle_is_paired_block_by_block(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(near, "BLOCK", 50)
    n = 400
    met = spark.range(n).select(F.lit(7).cast("long").alias("t"), (F.col("id") % 100).alias("comp"), F.array(F.col("id")).alias("earlier"), F.col("id").alias("node"), F.lit(10).cast("long").alias("n"), F.lit(10).cast("long").alias("meets"), *(F.lit(0).cast("long").alias(f"s{i}") for i in range(near.SIGNATURE // 64)))
    got = [tuple(sorted(r)) for r in near._pairs(met, 85).collect()]
    assert sorted(got) == [(a, b) for a in range(n) for b in range(a + 1, n) if a % 100 != b % 100]
    blocks = near._pairs(met, 85)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in blocks and "i#" in blocks


def test_a_family_larger_than_a_part(spark, docs):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(900):
        w = list(base)
        w[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    got = near.jaccard_components(docs(texts).repartition(4), 4, 85)
    assert sorted(map(tuple, got.collect())) == brute(rows, 4, 85)


def test_odd_rows(spark, docs):
    ids = [i for i in range(len(ODD))]
    got = near.jaccard_components(docs(ODD + ["one"], ids + [3], clash=True), 4, 85)
    assert sorted(map(tuple, got.collect())) == brute(list(zip(ids + [3], ODD + ["one"], strict=True)), 4, 85)
    assert near.jaccard_components(docs([]), 4, 85).count() == 0
    null = near.jaccard_components(docs(["a b c d e", "a b c d e", "z y x w v"], [None, 7, None]), 4, 85).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in null) == [(-1, -1), (-1, 7), (7, 7)]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abAB \n\t\x0bé中", max_size=30)), max_size=6), st.integers(1, 5))
def test_shingles_are_exact(texts, k):
    import pyarrow as pa

    raw, offsets = utf8(pa.array(texts, pa.string()))
    for a, b in chunks(offsets, 16):
        h, d = word_hashes(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        _, bounds = shingles(h, d, b - a, k)
        assert (bounds[1:] - bounds[:-1]).tolist() == [len(shingle_set(t, k)) for t in texts[a:b]]


def test_components_of_long_chains(spark):
    pairs = [(i * 7919 % 1009, (i + 1) * 7919 % 1009) for i in range(900)]
    nodes = spark.createDataFrame([(i,) for i in range(1009)], "node long")
    got = near.components(nodes, spark.createDataFrame(pairs, "a long, b long"))
    sizes = sorted(r["count"] for r in got.groupBy("comp").count().collect())
    assert sizes == [1] * 108 + [901]
