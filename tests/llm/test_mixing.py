import random
from collections import defaultdict
from fractions import Fraction

from odd import ODD
from pyspark.sql import functions as F

from tesserae.llm import mixing as M


def poured(supply, weights, total):
    """Exact shares, by dealing a node's budget to its children again and again until it is used or all are full."""
    depth = max(map(len, supply), default=0)
    limit, children = defaultdict(Fraction), defaultdict(set)
    for leaf, n in supply.items():
        shut = any(weights.get(leaf[:k], 1) == 0 for k in range(1, depth + 1))
        for k in range(depth + 1):
            limit[leaf[:k]] += 0 if shut else n
            if k < depth:
                children[leaf[:k]].add(leaf[: k + 1])
    share, todo = {(): min(Fraction(total), limit[()])}, [()]
    while todo:
        node = todo.pop()
        given = {c: Fraction(0) for c in children[node]}
        while (left := share[node] - sum(given.values())) > 0:
            open_ = [c for c in given if given[c] < limit[c]]
            whole = sum(Fraction(weights.get(c, 1)) for c in open_)
            for c in open_:
                given[c] = min(limit[c], given[c] + left * Fraction(weights.get(c, 1)) / whole)
        share |= given
        todo += [c for c in given if len(c) < depth]
    return {leaf: share[leaf] for leaf in supply}


def budgets(spark, supply, weights, total):
    depth = len(next(iter(supply), ("",)))
    names = [f"_l{i}" for i in range(depth)]
    rows = spark.createDataFrame([(*k, v) for k, v in supply.items()], ", ".join(f"{n} string" for n in names) + ", n long")
    return {tuple(r[n] for n in names): r.budget for r in M.budgets(rows, names, weights, total).collect()}


def test_budgets_by_hand(spark):
    supply = {("a", "x"): 100, ("a", "y"): 10, ("b", "x"): 1000}
    half = {("a",): Fraction(1, 2), ("b",): Fraction(1, 2)}
    # y is short by 40: its sibling takes it, though b has plenty.
    assert budgets(spark, supply, half, 200) == {("a", "x"): 90, ("a", "y"): 10, ("b", "x"): 100}
    # a as a whole is short: only then b takes the rest.
    assert budgets(spark, supply, half, 400) == {("a", "x"): 100, ("a", "y"): 10, ("b", "x"): 290}
    assert budgets(spark, supply, half, 10**6) == supply
    assert budgets(spark, supply, {("a",): Fraction(0)}, 50) == {("a", "x"): 0, ("a", "y"): 0, ("b", "x"): 50}
    assert budgets(spark, {}, {}, 5) == {} and sum(budgets(spark, {(str(i),): 10 for i in range(3)}, {}, 10).values()) == 10


def test_budgets_are_the_exact_shares(spark):
    rng = random.Random(1)
    for _ in range(6):
        supply = {(rng.choice("ab"), rng.choice(["x", "y", None]), str(i)): rng.randrange(100) for i in range(rng.randrange(1, 14))}
        weights = {("a",): Fraction(rng.randrange(1, 5)), ("b", "x"): Fraction(3, 7), ("a", None): Fraction(1, 3)}
        total = rng.randrange(600)
        got, want = budgets(spark, supply, weights, total), poured(supply, weights, total)
        assert sum(got.values()) == min(total, sum(supply.values())) and all(0 <= got[k] <= supply[k] for k in supply)
        assert all(abs(got[k] - want[k]) < 4 for k in supply)  # one token less or more a level, passed on by the level below


def test_great_budgets_are_exact(spark):
    supply = {(str(i),): 10**16 + i for i in range(5)}
    got = budgets(spark, supply, {("0",): Fraction(1, 999_983)}, 3 * 10**16)
    want = poured(supply, {("0",): Fraction(1, 999_983)}, 3 * 10**16)
    assert sum(got.values()) == 3 * 10**16 and all(abs(got[k] - want[k]) < 1 for k in supply)


def test_more_leaves_than_a_driver_would_hold_in_a_plan(spark):
    rows = spark.range(150_000).selectExpr("concat('d', id % 3) as _l0", "concat('s', id) as _l1", "1 + id % 7 as n")
    got = M.budgets(rows, ["_l0", "_l1"], {("d0",): Fraction(2)}, 200_000)
    assert got.selectExpr("sum(budget)", "count(*)", "min(n - budget) >= 0").first() == (200_000, 150_000, True)


def brute(rows, budget, epochs):
    """Rows chosen of one leaf: rows are (order by epoch, tokens, row)."""
    total, out = sum(n for _, n, _ in rows), []
    for e in range(epochs):
        room, before = budget - e * total, 0
        for h, n, row in sorted(rows, key=lambda x: x[0][e]):
            if total and room > 0 and before < room:
                out.append((e, row))
            before += n
    return sorted(out)


def run(spark, df, share, epochs, weights):
    tokens = F.coalesce(F.regexp_count("text", F.lit(r"[^ ]+")), F.lit(0))
    got = M.mix(df, [F.col("lang"), F.col("source")], tokens, weights, share=share, epochs=epochs)
    keyed = df.select("doc_id", "text", "lang", "source", tokens.alias("n"), *(F.xxhash64(F.lit(17), F.lit(e), "doc_id", F.xxhash64("text")).alias(f"h{e}") for e in range(epochs))).collect()
    leaves = defaultdict(list)
    for r in keyed:
        leaves[r.lang, r.source].append(([(r[f"h{e}"] % 2**64 , r.doc_id) for e in range(epochs)], r.n, r.doc_id))
    asked = {k: sum(n for _, n, _ in v) * epochs for k, v in leaves.items()}, {k: Fraction(w) for k, w in weights.items()}, int(Fraction(share).limit_denominator(10**6) * sum(n for v in leaves.values() for _, n, _ in v))
    given, shares = budgets(spark, *asked), poured(*asked)
    assert all(abs(given[k] - shares[k]) < 3 for k in given)
    want = sorted(x for k, v in leaves.items() for x in brute(v, given[k], epochs))
    return sorted((r.epoch, r.doc_id) for r in got.collect()), want


def test_prefixes_are_brute_force(spark, docs):
    rng = random.Random(5)
    texts = [" ".join(["w"] * rng.randrange(40)) for _ in range(300)]
    for share, epochs, weights in ((0.5, 2, {}), (1.0, 2, {("en", "src0"): 8}), (2.5, 3, {("en", "src1"): 0}), (0.01, 1, {})):
        got, want = run(spark, docs(texts).repartition(5), share, epochs, weights)
        assert got == want, (share, epochs)


def test_odd_rows(spark, docs):
    rows = docs([*ODD, "one"], [*range(len(ODD)), 3], clash=True).withColumn("source", F.when(F.col("doc_id") % 2 == 0, F.col("source")))
    got = M.production(rows, epochs=1, share=1.0)
    assert set(rows.columns) <= set(got.columns)
    # Rows without words may stand behind the end of a prefix; all others are chosen, repeated ones as often as they occur.
    chosen = sorted(r.doc_id for r in got.collect() if r.n_tokens)
    assert chosen == sorted([i for i, t in enumerate(ODD) if (t or "").split()] + [3])
    assert M.production(docs([])).count() == 0
    assert M.production(docs([None, "", " "])).count() == 0  # no tokens, no budget
