import hashlib
import random
import struct

import numpy as np
import xxhash
from odd import ODD
from pyspark.sql import functions as F

from tesserae.llm import fingerprint as P


def test_edits_by_hand(spark, docs):
    rng = random.Random(2)
    texts = ODD + [" ".join(rng.choice(["a.", "bb", "ccc!", "d\n"]) for _ in range(rng.randrange(200))) for _ in range(60)]
    ids = list(range(0, 3 * len(texts), 3))
    rows = {r.doc_id: r for r in P.edits(docs(texts, ids, clash=True).repartition(7)).collect()}
    assert len(rows) == len(texts)
    want = []
    for k, (i, t) in enumerate(zip(ids, texts, strict=True)):
        t, after = t or "", texts[(k + 1) % len(texts)] or ""
        m = len(t) // 4
        edited = t[: len(t) - m] + after[:m]
        want.append((i, edited))
        assert (rows[i].n_chars, rows[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= rows[i].near_edited <= 1 and 0 <= rows[i].near_next <= 1
        assert t != after or rows[i].near_next == 1
    own = spark.createDataFrame(want, "doc_id long, text string").select("doc_id", P.fingerprint(F.col("text")).alias("f")).collect()
    assert all(r.f == rows[r.doc_id].edited_fingerprint for r in own)
    own = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").select("doc_id", P.fingerprint(F.col("text")).alias("f")).collect()
    assert all(r.f == rows[r.doc_id].fingerprint for r in own)


def test_repeated_null_and_no_ids(spark, docs):
    rows = P.edits(docs(["aaaa", "bbbb", "cccc", "aaaa"], [2, None, 2, 1])).collect()
    # Order: null, 1, 2 (aaaa), 2 (cccc).
    got = sorted((r.doc_id or 0, r.edited_sha256) for r in rows)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == sorted([(0, sha("bbba")), (1, sha("aaaa")), (2, sha("aaac")), (2, sha("cccb"))])
    assert P.edits(docs([])).count() == 0
    alone = P.edits(docs(["abcdefgh"])).first()
    assert alone.edited_sha256 == sha("abcdefab") and alone.near_next == 1


def test_multiset_hash(spark):
    rows = spark.createDataFrame([("a. b. c", "c\nb.\na.", "a. b. c c", "x")], "a string, b string, c string, d string")
    s = lambda c: P.sketch(P.paragraphs(F.col(c)))
    got = rows.select(
        (P.written(s("a")) == P.written(s("b"))).alias("order"),
        (P.written(s("a")) != P.written(s("c"))).alias("change"),
        (P.written(P.subtract(P.add(s("a"), s("d")), s("d"))) == P.written(s("a"))).alias("back"),
        (P.written(P.add(s("a"), s("d"))) == P.fingerprint(F.concat("a", F.lit("\n"), "d"))).alias("insert"),
    ).first()
    assert all(got)


def test_likeness_follows_what_is_shared(spark):
    rng = random.Random(4)
    lines = [f"line {i} {rng.random()}" for i in range(200)]
    rows = spark.createDataFrame([(k, "\n".join(lines), "\n".join(lines[:k] + [x + "!" for x in lines[k:]])) for k in (0, 50, 100, 150, 200)], "k int, a string, b string")
    lanes = lambda c: P.lanes_of(P.sketch(P.paragraphs(F.col(c))))
    got = {r.k: r.n for r in rows.select("k", P.likeness(lanes("a"), lanes("b")).alias("n")).collect()}
    assert got[200] == 1 and all(abs(got[k] - k / 200) < 4 / P.LANES**0.5 for k in got)


def test_repeated_lines_dont_wrap(spark):
    rows = []
    for m in (100, 257, 258, 400, 1000, 2000):
        m4 = m // 4
        rows.append((m, "\n".join(["the same line"] * m), "\n".join(["the same line"] * (m - m4) + [f"other{i}" for i in range(m4)])))
    df = spark.createDataFrame(rows, "m int, a string, b string")
    lanes = lambda c: P.lanes_of(P.sketch(P.paragraphs(F.col(c))))
    for r in df.select("m", P.likeness(lanes("a"), lanes("b")).alias("n"), P.likeness(lanes("a"), lanes("a")).alias("own")).collect():
        x, k = r.m - r.m // 4, r.m // 4
        assert r.own == 1 and abs(r.n - x / (x * x + k) ** 0.5) < 0.01, r
    sums = df.select("m", P.sketch(P.paragraphs(F.col("a"))).alias("s"), P.sketch(F.array(F.lit("the same line"))).alias("one")).collect()
    assert all(r.s.n == r.m and r.s.words == [r.m * w for w in r.one.words] for r in sums)


def lanes(text):
    """(number, sums) of a text's paragraphs in plain Python: cut behind line ends, sentence marks and eight words."""
    found, at = [], []
    for line in (text or "").split("\n"):
        for w in [x for x in line.split(" ") if x]:
            at.append(w)
            if w[-1] in ".!?" or len(at) == P.LONGEST:
                found.append(at)
                at = []
        if at:
            found.append(at)
        at = []
    sums = np.zeros(P.LANES, np.int64)
    for words in found:
        p = " ".join(words).encode()
        for i in range(P.LANES // 8):
            h = xxhash.xxh64_intdigest(p, xxhash.xxh64_intdigest(struct.pack("<i", i), 42))
            own = [h >> 16 * k + 8 * j & 255 for j in range(2) for k in range(4)]
            sums[8 * i : 8 * i + 8] += own
    return len(found), sums


def cosine(a, b):
    x, y = (s - 127.5 * n for n, s in (a, b))
    if not a[0] or not b[0]:
        return float(a[0] == b[0])
    return min(1.0, max(0.0, float(x @ y) / float(np.sqrt((x @ x) * (y @ y)))))


def test_fingerprints_and_likeness_are_brute_force(spark, docs):
    rng = random.Random(12)
    texts = [None, "", "one", "one."] + ["".join(rng.choice(["a. ", "bb ", "é! ", "d\n", "e f g h i j k l m "]) for _ in range(rng.randrange(1, 300))).strip(" ") for _ in range(40)] + ["the same line\n" * 2000 + "x", "the same line\n" * 1500 + "y"]
    rows = {r.doc_id: r for r in P.edits(docs(texts).repartition(5)).collect()}
    for i, t in enumerate(texts):
        t, after = t or "", texts[(i + 1) % len(texts)] or ""
        m = len(t) // 4
        own, edited, other = lanes(t), lanes(t[: len(t) - m] + after[:m]), lanes(after)
        written = lambda x: ".".join(f"{v:x}" for v in (x[0], *x[1].tolist()))
        assert rows[i].fingerprint == written(own) and rows[i].edited_fingerprint == written(edited)
        assert abs(rows[i].near_edited - cosine(own, edited)) < 1e-6 and abs(rows[i].near_next - cosine(own, other)) < 1e-6
    assert rows[len(texts) - 2].near_next > 0.99
