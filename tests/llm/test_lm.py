import json
import math
import random
import re
from collections import Counter

import numpy as np
from odd import ODD
from pyspark.sql import functions as F

from tesserae.llm import lm
from tesserae.llm.files import read_whole


def words(t):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "\n"]


def base(train, t):
    c = Counter(w for x in train for w in words(x))
    n, v = sum(c.values()), len(c)
    return len(words(t)), sum(c[w] > 0 for w in words(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t))


class Model:
    """The model with counts as they are, which they are in the filters up to 127."""

    def __init__(self, train):
        self.c = [Counter(), Counter(), Counter()]
        for x in train:
            for grams in self.grams(x):
                for c, g in zip(self.c, grams, strict=True):
                    c[g] += 1
        self.total = sum(self.c[0].values()) + len(self.c[0]) + 1
        self.train = train

    def grams(self, text):
        w = ["\n", "\n", *words(text)]
        return [((w[i],), (w[i - 1], w[i]), (w[i - 2], w[i - 1], w[i])) for i in range(2, len(w))]

    def score(self, text, k2, k3, less=0):
        out = 0.0
        for i, (a, b, c) in enumerate(self.grams(text)):
            n = lambda counts, g: max(counts[g] - less, 0)
            p = (n(self.c[0], a) + 1) / self.total
            p = (n(self.c[1], b) + k2 * p) / (n(self.c[0], (b[0],)) + k2)
            if i:
                p = (n(self.c[2], c) + k3 * p) / (n(self.c[1], c[:2]) + k3)
            out += math.log10(p)
        return out

    def kappas(self):
        return max(lm.PAIRS, key=lambda k: sum(self.score(t, *k, less=1) for t in self.train))


def check(rows, texts, held):
    train = [t for t, h in zip(texts, held, strict=True) if not h]
    model = Model(train)
    best = model.kappas()
    assert len(rows) == len(texts)
    for r in rows:
        n, known, total, want = base(train, texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, total, held[r.doc_id])
        assert abs(r.base_score - want) <= 1e-9 * max(1, abs(want))
        yield r, model.score(texts[r.doc_id], *best)


def test_scores_are_brute_force(spark, docs, monkeypatch):
    rng = random.Random(1)
    texts = [t for t in ODD if t is None or len(t) < 10_000] + [" ".join(rng.choice([f"W{i * i % 97}" for i in range(60)]) for _ in range(rng.randrange(40))) for _ in range(60)]
    held = [i % 4 == 1 for i in range(len(texts))]
    for room in (lm.HELD, 30):  # all in one chunk a task, then many chunks
        monkeypatch.setattr(lm, "HELD", room)
        for r, want in check(lm.score_texts(docs(texts, clash=True).repartition(6), F.col("doc_id") % 4 == 1).collect(), texts, held):
            assert abs(r.score - want) < 1e-6 * max(1, abs(want))


def test_long_texts_and_great_counts(spark, docs):
    held = [i % 4 == 1 for i in range(len(ODD))]
    for r, want in check(lm.score_texts(docs(ODD), F.col("doc_id") % 4 == 1).collect(), ODD, held):
        assert abs(r.score - want) <= 1e-6 + r.n_tokens * 2 * math.log10(1 + 1 / 128)  # counts of 30,000 are kept to a part in 128


def test_probabilities_of_a_context_add_up_to_one(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    folder = f"file://{tmp_path}/model"
    lm.score_texts(rows, F.col("doc_id") % 5 == 0, folder)
    meta = json.loads(read_whole(f"{folder}/meta"))
    train = [r.text for r in rows.where("doc_id % 5 <> 0").select("text").collect()]
    vocabulary = sorted({w for t in train for w in words(t)})
    assert meta["words"] == len(vocabulary) > 50_000
    all_words = np.array([lm.hash_bytes(w.encode()) for w in vocabulary], np.uint64)
    rng = random.Random(8)
    contexts = set()
    while len(contexts) < 100:  # as they stand in the text, so frequent ones often
        w = words(rng.choice(train))
        if len(w) > 3:
            i = rng.randrange(len(w) - 2)
            contexts.add((w[i], w[i + 1]))
    c1 = lm.counts_in(folder, 1, all_words)
    assert (c1 >= 1).all()
    for u, v in contexts:
        first, second = (np.array([lm.hash_bytes(x.encode())], np.uint64) for x in (u, v))
        before, pair = lm.counts_in(folder, 1, second)[0], lm.counts_in(folder, 2, lm.pair_keys(first, second))[0]
        pairs = lm.pair_keys(second, all_words)
        c2 = np.minimum(lm.counts_in(folder, 2, pairs), np.minimum(c1, before))
        c3 = np.minimum(lm.counts_in(folder, 3, lm.triple_keys(first, pairs)), np.minimum(c2, pair))
        unknown = lm.smoothed(0.0, before, 0.0, pair, 0.0, meta["total"], *meta["kappas"])
        for starts in (False, True):
            sum_ = lm.smoothed(c1, before, c2, pair, c3, meta["total"], *meta["kappas"], starts).sum()
            assert 0.98 < sum_ + unknown < 1.02


def test_no_training_rows_nulls_and_repeats(spark, docs):
    rows = lm.score_texts(docs(["a b", "a"]), F.lit(True)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 and r.score == 0 for r in rows)
    assert lm.score_texts(docs([]), F.lit(False)).count() == 0
    rows = lm.score_texts(docs(["a b", "a b", None], [None, None, 1]), F.lit(None).cast("boolean")).collect()
    assert sorted((r.doc_id or 0, r.n_tokens, r.train_tokens) for r in rows) == [(0, 3, 7), (0, 3, 7), (1, 1, 7)]


def test_model_beats_its_base_on_held_out_text(spark, docs):
    rng = random.Random(2)
    after = {f"w{i}": [f"w{rng.randrange(200)}" for _ in range(3)] for i in range(200)}

    def text():
        out = [f"w{rng.randrange(200)}"]
        for _ in range(99):
            out.append(rng.choice(after[out[-1]]))
        return " ".join(out)

    rows = lm.score_texts(docs([text() for _ in range(200)]), F.col("doc_id") % 5 == 0).where("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows) + 30 * len(rows)  # log10 of 200 choices against 3


def test_documents_that_occur_twice_stand_apart(spark, docs):
    rows = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang = 'en'").select("text").distinct().limit(120).collect()]
    texts = rows + rows[:20]
    got = {r.doc_id: r.score / r.n_tokens for r in lm.score_texts(docs(texts), F.lit(False)).collect() if r.n_tokens > 50}
    once = sorted(got[i] for i in range(20, 120) if i in got)
    twice = [got[i] for i in range(20) if i in got]
    assert sum(x > once[int(0.9 * len(once))] for x in twice) >= 0.8 * len(twice)


def test_quantised_counts():
    c = np.array([*range(1, 5000), 10**6, 2**40, 2**52 - 1], np.uint64)
    codes = lm.codes_of(c)
    assert (np.diff(codes) >= 0).all() and (lm.value_of(codes)[:127] == c[:127]).all()
    assert (np.abs(lm.value_of(codes) / c - 1) < 1 / 128 + 1e-9).all() and lm.value_of(np.array([0]))[0] == 0


def test_a_filter_gives_back_what_it_holds():
    every = lm.mix(np.arange(60_000, dtype=np.uint64)) >> np.uint64(3)  # region 0 of 8
    keys = np.concatenate([np.sort(every[:40_000]), every[40_000:]])
    codes = lm.codes_of(np.array([1 + (i * i % 977 if i % 9 == 0 else i % 3) for i in range(40_000)], np.uint64))
    visits = lm.visits_for(60_000)
    held = lm.build_filter(keys[:40_000], codes, visits, 3)
    assert (lm.probe(held, keys[:40_000], visits, 3) == codes).mean() > 0.9999  # a false positive only adds
    assert (lm.probe(held, keys[40_000:], visits, 3) > 0).sum() <= 2
    assert [lm.visits_for(v) for v in (1, 10**9, 10**12)] == [3, 4, 5]
    assert not lm.probe(lm.build_filter(keys[:0], codes[:0], 3, 3), keys, 3, 3).any()
