"""Mixing sources to target weights: hierarchical budgets over a tree of domain, language and source, and token prefixes of
seeded epochs.

Supply: the tokens of each leaf, times the epochs. The budget goes down the tree by weights, level by level, as rows: a node's
children are put in the order in which they fill, by supply a weight. A child is full if what is poured while it fills is no more than the
node has; the others share the rest by their weights. That is what comes of passing shortages to siblings again and again until all is
used or all are full; only what a whole family can't use went to its parent's siblings before. Weights are whole numbers in
proportion to the given fractions and sums are decimals, so nothing is rounded but the shares of open children: their running sum is
rounded down, in that order, so they add up to the node's budget.

A leaf with a budget of several epochs takes whole epochs and a prefix of the last one. An epoch's order is that of the documents'
hashes with the seed and the epoch's number. The prefix is found in two steps: tokens by (leaf, epoch, first bits of the hash),
summed where they are; then, only within the one slot where a leaf's budget ends, document by document. So no task sees a
leaf's documents, and a leaf may hold any share of all rows. The tree may have any number of leaves.
"""

from __future__ import annotations

from fractions import Fraction
from functools import reduce
from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.session import cut, hot_keys, join_hot, small_side

SLOT_BITS = 16


def path_key(columns: list[Column]) -> Column:
    """One text for a path of names; null is a name of its own."""
    return F.concat_ws("\x01", *(F.coalesce(F.concat(F.lit("="), c), F.lit("-")) for c in columns))


def budgets(leaves: DataFrame, names: list[str], weights: dict[tuple, Fraction], total: int) -> DataFrame:
    """leaves(names, n), a row a leaf with its supply n, with `budget`: tokens for each leaf.

    weights: of paths of any depth, among their siblings; a path without one has 1, and 0 shuts a branch. The sum is `total` or what
    all open leaves can give. Every node is one row, whatever lies below it; a node's children meet in one task.
    """
    unit = lcm(*(w.denominator for w in weights.values())) if weights else 1
    own = {k: int(w * unit) for k, w in weights.items()}

    def weight(depth: int) -> Column:
        given = [(k, w) for k, w in own.items() if len(k) == depth]
        if not given:
            return F.lit(unit)
        key = lambda k: "\x01".join("-" if x is None else "=" + x for x in k)
        table = F.create_map(*(F.lit(x) for k, w in given for x in (key(k), w)))
        return F.coalesce(F.try_element_at(table, path_key([F.col(c) for c in names[:depth]])), F.lit(unit))

    big = lambda c: c.cast("decimal(38,0)")
    opens = reduce(lambda x, y: x & y, (weight(d) > 0 for d in range(1, len(names) + 1)))
    rows = leaves.withColumn("_limit", F.when(opens, F.col("n")).otherwise(0).cast("long"))
    room = rows.agg(F.coalesce(F.sum("_limit"), F.lit(0))).first()[0]
    given = None
    for depth in range(1, len(names) + 1):
        above, here = names[: depth - 1], names[:depth]
        nodes = rows.groupBy(*here).agg(F.sum("_limit").alias("l")).where("l > 0").withColumns({"w": weight(depth), "_up": path_key([F.col(c) for c in above])})
        nodes = nodes.withColumn("share", F.lit(min(total, room)).cast("long")) if given is None else nodes.join(given, "_up")
        family = Window.partitionBy("_up")
        order = family.orderBy(F.col("l") / F.col("w"), *(F.col(c).asc_nulls_first() for c in here)).rowsBetween(Window.unboundedPreceding, -1)
        nodes = nodes.withColumns({"_lb": F.coalesce(F.sum(big(F.col("l"))).over(order), big(F.lit(0))), "_wf": F.sum(big(F.col("w"))).over(family) - F.coalesce(F.sum(big(F.col("w"))).over(order), big(F.lit(0)))})
        nodes = nodes.withColumn("_full", big(F.col("_lb")) * F.col("w") + big(F.col("l")) * big(F.col("_wf")) <= big(F.col("share")) * F.col("w"))
        open_l, open_w = F.when(F.col("_full"), big(F.col("l"))).otherwise(0), F.when(F.col("_full"), big(F.lit(0))).otherwise(big(F.col("w")))
        nodes = nodes.withColumns({"_left": big(F.col("share")) - F.sum(open_l).over(family), "_ow": F.sum(open_w).over(family), "_ob": F.coalesce(F.sum(open_w).over(order), big(F.lit(0)))})
        nodes = nodes.withColumn("budget", F.when(F.col("_full"), F.col("l")).otherwise(F.expr("cast(cast(_left as decimal(38,0)) * cast(_ob + w as decimal(38,0)) div cast(_ow as decimal(38,0)) - cast(_left as decimal(38,0)) * cast(_ob as decimal(38,0)) div cast(_ow as decimal(38,0)) as long)")))
        given = nodes.select(path_key([F.col(c) for c in here]).alias("_up"), F.col("budget").alias("share"))
    found = given.select(F.col("_up").alias("_key"), F.col("share").alias("budget"))
    keyed = leaves.withColumn("_key", path_key([F.col(c) for c in names]))
    return keyed.join(found, "_key", "left").withColumn("budget", F.coalesce("budget", F.lit(0).cast("long"))).drop("_key")


def mix(docs: DataFrame, levels: list[Column], tokens: Column, weights: dict[tuple, float | Fraction], share: float = 0.5, total: int | None = None, epochs: int = 2, seed: int = 17) -> DataFrame:
    """The chosen rows of docs(doc_id and any other columns) with `epoch`, n_tokens and the leaf's budget.

    levels: columns from the root down, e.g. domain, language, source; nulls are a branch of their own. tokens: a document's tokens;
    null counts as 0. total: tokens to choose, by default `share` of all. A document is in the prefix if the tokens before it in its
    epoch's order are less than what the leaf's budget leaves for that epoch, so a leaf exceeds its budget by less than one
    document; documents without tokens are chosen with the prefix they stand in. Order: hash of seed, epoch, doc_id and text's hash; equal rows stand
    together. Repeated rows count and are chosen one by one. Columns called like a result are replaced. No rows give no rows. A
    text of any length is counted whole.
    """
    names = [f"_l{i}" for i in range(len(levels))]
    docs = docs.drop("epoch", "n_tokens", "budget")
    tokens = F.greatest(F.coalesce(tokens.cast("long"), F.lit(0)), F.lit(0))
    rows = docs.select(F.struct("*").alias("_doc"), *(c.cast("string").alias(n) for n, c in zip(names, levels, strict=True)), tokens.alias("n_tokens"))
    leaves = cut(rows.groupBy(*names).agg(F.sum("n_tokens").alias("once"), F.count("*").alias("docs")), "leaves")
    supply = leaves.agg(F.coalesce(F.sum("once"), F.lit(0))).first()[0]
    wanted = total if total is not None else int(Fraction(share).limit_denominator(10**6) * supply)
    exact = {k: Fraction(v).limit_denominator(10**6) for k, v in weights.items()}
    plan = budgets(leaves.withColumn("n", F.col("once") * epochs), names, exact, wanted)
    plan = plan.where("once > 0").select(path_key([F.col(c) for c in names]).alias("_leaf"), "docs", "budget", F.filter(F.transform(F.sequence(F.lit(0), F.lit(epochs - 1)), lambda e: F.struct(e.alias("epoch"), (F.col("budget") - e * F.col("once")).alias("room"))), lambda x: x["room"] > 0).alias("_epochs"))
    plan = cut(plan.where(F.size("_epochs") > 0), "plan")
    hot = hot_keys(plan, "_leaf", "docs")
    text = F.xxhash64("_doc.text") if "text" in docs.columns else F.lit(0).cast("long")
    rows = rows.select("_doc", "n_tokens", path_key([F.col(c) for c in names]).alias("_leaf"))
    rows = join_hot(rows, small_side(plan.drop("docs"), 200), "_leaf", hot).select("_doc", "n_tokens", "_leaf", "budget", F.inline("_epochs"))
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), "epoch", "_doc.doc_id", text)).withColumn("_slot", F.shiftrightunsigned("_h", 64 - SLOT_BITS).cast("int"))
    rows = rows.withColumn("_key", F.concat_ws("\x02", "_leaf", "epoch"))
    by_slot = cut(rows.groupBy("_key", "room", "_slot").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs")), "slots")
    # A slot's sum before it, in two levels as well: blocks of slots first, then slots within a block.
    by_slot = by_slot.withColumn("_block", F.shiftright("_slot", SLOT_BITS // 2))
    block = by_slot.groupBy("_key", "_block").agg(F.sum("n").alias("n"))
    block = block.select("_key", "_block", (F.sum("n").over(Window.partitionBy("_key").orderBy("_block")) - F.col("n")).alias("_before"))
    inner = F.sum("n").over(Window.partitionBy("_key", "_block").orderBy("_slot")) - F.col("n")
    slots = by_slot.withColumn("_inner", inner).join(block, ["_key", "_block"]).select("_key", "_slot", "n", "room", (F.col("_inner") + F.col("_before")).alias("_before"))
    # One slot a leaf and epoch holds the budget's end; what stands before is chosen whole.
    last = slots.where((F.col("_before") < F.col("room")) & (F.col("_before") + F.col("n") >= F.col("room"))).groupBy("_key").agg(F.min(F.struct("_slot", "_before")).alias("end"))
    last = cut(last, "ends")
    hot = hot_keys(by_slot.groupBy("_key").agg(F.sum("docs").alias("docs")), "_key", "docs")
    rows = join_hot(rows, small_side(last, 200), "_key", hot, "left")
    whole = rows.where(F.col("end").isNull() | (F.col("_slot") < F.col("end._slot")))
    edge = rows.where(F.col("_slot") == F.col("end._slot"))
    order = Window.partitionBy("_key").orderBy("_h", "_doc.doc_id").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("_sum", F.col("end._before") + F.coalesce(F.sum("n_tokens").over(order), F.lit(0))).where(F.col("_sum") < F.col("room"))
    return whole.select("_doc.*", "epoch", "n_tokens", "budget").unionByName(edge.select("_doc.*", "epoch", "n_tokens", "budget"))


# Production tree: fixed values. Sources are grouped into domains by number.
DOMAINS = 4
WEIGHTS: dict[tuple, Fraction] = {
    ("d0",): Fraction(4, 10), ("d1",): Fraction(3, 10), ("d2",): Fraction(2, 10), ("d3",): Fraction(1, 10),
    **{(f"d{i}", lang): w for i in range(DOMAINS) for lang, w in (("en", Fraction(4, 10)), ("de", Fraction(2, 10)), ("fr", Fraction(2, 10)), ("es", Fraction(2, 10)))},
}


def production(docs: DataFrame, epochs: int = 2, share: float = 0.5) -> DataFrame:
    """docs(doc_id, text, lang, source, ...) mixed by WEIGHTS, a document's tokens being its words [^\\x20\\x09-\\x0D]+."""
    number = F.expr(f"try_cast(regexp_extract(source, '([0-9]+)$', 1) as long) % {DOMAINS}")
    domain = F.coalesce(F.concat(F.lit("d"), number.cast("string")), F.lit("none"))
    tokens = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    return mix(docs, [domain, F.col("lang"), F.col("source")], tokens, WEIGHTS, share=share, epochs=epochs)
