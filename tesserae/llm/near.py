"""N-gram Jaccard join: an exact grouped prefix join over word shingles, and its connected components.

1. Count every shingle of every document (`counting`, 40 bits a shingle). Repeated shingles go to a Bloom filter, the most
   frequent ones to a list; both have a fixed greatest size and are broadcast. Beyond that size the filter passes more and the
   list orders less: results stay exact, the join gets slower.
2. A document of n shingles can only link with a different text if at least percent * n of them are repeated. Those that can
   write their set, and its prefix: the n - ceil(percent * n) + 1 first shingles, where unlisted ones come first, in order of
   hash, and then listed ones from rare to frequent. Two linked sets share a shingle of their prefixes.
3. Equal sets collapse to one node, nodes with equal prefix and size to one group. Groups that share a prefix shingle meet.
4. Of a pair is known: both sizes, how many shingles of either are repeated at all, and a signature with the parity of the
   shingles in each of SIGNATURE bins. Differing bins can't outnumber differing shingles, so the join drops only pairs that
   can't link.
5. First every group is verified against one pivot of each shingle, every member against its group's pivot, so that a family
   of near copies becomes one component at linear cost; then every member against NEIGHBOURS of those that it meets. What
   still shares a shingle across components is expanded to member pairs, each at the first shingle where it meets, and all of
   them are verified. Members of a frequent shingle are dealt into blocks, and each pair of blocks is a task's. No link is lost;
   links inside a component need not be listed.

Nodes are 64-bit sums over the set: at 10**9 different sets, two of them agree by chance with odds of 3 %.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.counting import bit_places, by_region, emit_counts, filter_of, filter_words, region_bits
from tesserae.llm.kernels import chunks, mix, shingles, utf8, word_hashes
from tesserae.session import bound_batches, cut, give_back, hot_keys, join_hot, small_side

FILTER_BYTES = 64 << 20
LISTED = 1 << 20
SIGNATURE = 1024
#: Shingles before one in its prefix that are looked at to see whether a pair has met before.
EARLIER = 64
#: Members that each is compared with at a shingle before all pairs across components are, and the members in one such part.
NEIGHBOURS, PART = 8, 256
#: Members of a shingle that meet all of one another in one task; those of a more frequent one meet block by block.
BLOCK = 512
KEY_MASK = 0xFFFFFFFFFF000000


def _sets(batch: pa.RecordBatch, k: int):
    """(first document, bounds, hashes) of runs of documents of a batch with a text column."""
    raw, offsets = utf8(batch.column("text"))
    for a, b in chunks(offsets):
        h, d = word_hashes(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        hashes, bounds = shingles(h, d, b - a, k)
        yield a, bounds, hashes


def repeated_shingles(docs: DataFrame, k: int, filter_bytes: int = FILTER_BYTES, listed: int = LISTED) -> dict:
    """The filter of shingles in two documents or more and the list of the most frequent, for broadcasting."""
    spark = docs.sparkSession
    bits = region_bits(spark)
    most_words, most_listed = max(8, (filter_bytes >> 3) >> bits), max(1, listed >> bits)

    def count(batches):
        return emit_counts((hashes & np.uint64(KEY_MASK) for batch in batches for _, _, hashes in _sets(batch, k)), bits)

    def digest(_, region, keys, counts):
        keys, counts = keys[counts > 1], counts[counts > 1]
        words = min(filter_words(len(keys), 10.0), most_words)
        least = 8
        while int((counts >= least).sum()) > most_listed:
            least *= 2
        heavy = counts >= least
        return pa.table({"region": pa.array([region], pa.int32()), "words": pa.array([words], pa.int64()), "filter": [filter_of(keys, words).tobytes()], "keys": [keys[heavy].tobytes()], "counts": [counts[heavy].tobytes()]})

    blobs = docs.select("text").mapInArrow(count, "kind int, region int, blob binary")
    rows = by_region(blobs, digest, "region int, words long, filter binary, keys binary, counts binary").collect()  # bounded: filter_bytes and listed * 16 bytes
    words = np.full(1 << bits, 0, np.int64)
    for r in rows:
        words[r.region] = r.words
    parts = {r.region: r for r in rows}
    del rows
    order = sorted(parts)
    return {
        "bits": bits,
        "words": words,
        "start": np.concatenate([[0], np.cumsum(words)])[:-1],
        "filter": np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(parts[r].filter, np.uint64) for r in order)]),
        "keys": np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(parts[r].keys, np.uint64) for r in order)]),
        "counts": np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(parts[r].counts, np.uint64) for r in order)]),
    }


def may_repeat(known: dict, hashes: np.ndarray) -> np.ndarray:
    """Whether each shingle may be in two documents or more. Never wrong for one that is."""
    keys = hashes & np.uint64(KEY_MASK)
    region = (keys >> np.uint64(64 - known["bits"])).astype(np.int64)
    out = known["words"][region] > 0
    keys, region = keys[out], region[out]
    if len(keys):
        at, mask = bit_places(keys, 1 << 31)
        at = at.astype(np.int64) % known["words"][region] + known["start"][region]
        out[out] = (known["filter"][at] & mask) == mask
    return out


def _prefix(known: dict, own: np.ndarray, length: int) -> np.ndarray:
    """The first `length` of a sorted set: unlisted by hash, then listed by frequency and hash."""
    if not len(known["keys"]):
        return own[:length]
    keys = own & np.uint64(KEY_MASK)
    at = np.minimum(np.searchsorted(known["keys"], keys), len(known["keys"]) - 1)
    counts = np.where(known["keys"][at] == keys, known["counts"][at], 0)
    light = own[counts == 0]
    if len(light) >= length:
        return light[:length]
    heavy, often = own[counts > 0], counts[counts > 0]
    return np.concatenate([light, heavy[np.lexsort((heavy, often))]])[:length]


def _nodes_of(docs: DataFrame, known, k: int, percent: int) -> DataFrame:
    """Each document with n_shingles and, where it may link, its node; the first of a node in a task has all else."""

    def run(batches):
        info, seen = known.value, set()
        for batch in batches:
            ids = batch.column("doc_id")
            for a, bounds, hashes in _sets(batch, k):
                n = np.diff(bounds)
                passed = may_repeat(info, hashes)
                total = np.concatenate([[0], np.cumsum(passed)])
                may = (n > 0) & (100 * (total[bounds[1:]] - total[bounds[:-1]]) >= percent * n)
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(0x8EBC6AF09C88C6E3)), dtype=np.uint64)])
                node = mix(sums[bounds[1:]] - sums[bounds[:-1]] + n.astype(np.uint64)).view(np.int64)
                prefix, sets, marks = [None] * len(n), [None] * len(n), [None] * len(n)
                for i in np.flatnonzero(may):
                    if int(node[i]) not in seen:
                        seen.add(int(node[i]))
                        own = hashes[bounds[i] : bounds[i + 1]]
                        single = int(n[i] - (total[bounds[i + 1]] - total[bounds[i]]))  # these come first and meet nothing
                        prefix[i] = _prefix(info, own[passed[bounds[i] : bounds[i + 1]]], max(0, len(own) + (-len(own) * percent // 100) + 1 - single)).view(np.int64)
                        sets[i] = own.tobytes()
                        marks[i] = np.packbits(np.bincount((own & np.uint64(SIGNATURE - 1)).astype(np.int64), minlength=SIGNATURE).astype(np.uint8) & 1).view(np.int64)
                meets = pa.array(total[bounds[1:]] - total[bounds[:-1]], pa.int64())
                yield pa.RecordBatch.from_arrays([ids.slice(a, len(n)), pa.array(n, pa.int64()), pa.array(node, pa.int64(), mask=~may), meets, pa.array(prefix, pa.list_(pa.int64())), pa.array(sets, pa.binary()), pa.array(marks, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "node", "meets", "prefix", "shingles", "marks"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, node long, meets long, prefix array<long>, shingles binary, marks array<long>")


def _side(name: str) -> list[Column]:
    """Columns of a member as one side of a pair."""
    return [F.col("node").alias(name), F.col("n").alias(f"n{name}"), F.col("meets").alias(f"m{name}"), *(F.col(f"s{i}").alias(f"s{name}{i}") for i in range(SIGNATURE // 64))]


def _may_link(percent: int) -> Column:
    """Whether sides a and b may link, by sizes, repeated shingles and signatures; true for all that do."""
    size, most = F.col("na") + F.col("nb"), F.least("ma", "mb")
    apart = reduce(lambda x, y: x + y, (F.bit_count(F.col(f"sa{i}").bitwiseXOR(F.col(f"sb{i}"))) for i in range(SIGNATURE // 64)))
    return (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & (100 * most >= percent * (size - most)) & ((100 + percent) * apart <= (100 - percent) * size)


def _verified(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets overlap enough."""
    pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = heads.select("node", "shingles").join(wanted, "node", "left_semi").dropDuplicates(["node"])
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                same = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(100 * same >= percent * (len(x) + len(y) - same))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, comp) for each row of nodes(node), where links(a, b) connect nodes.

    Every round joins each label to its least neighbour and contracts the links. Labels are hashes, so the number of rounds
    grows with the logarithm of the longest chain.
    """
    labels = nodes.select("node", F.col("node").alias("comp"))
    links = cut(links.select("a", "b").distinct(), "links")
    while not links.isEmpty():
        both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("to")).select(F.col("a").alias("comp"), F.least("a", "to").alias("to"))
        least = cut(least.where(F.col("to") < F.col("comp")), "hooks")
        labels = cut(labels.join(least, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "labels")
        moved = lambda side: links.join(least.select(F.col("comp").alias(side), F.col("to").alias(f"to_{side}")), side, "left")
        links = moved("a").join(least.select(F.col("comp").alias("b"), F.col("to").alias("to_b")), "b", "left")
        links = links.select(F.coalesce("to_a", "a").alias("a"), F.coalesce("to_b", "b").alias("b")).where(F.col("a") != F.col("b"))
        links = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    return labels


def _apart(meets: DataFrame, members: DataFrame, labels: DataFrame) -> DataFrame:
    """(t, m, node, comp) of all members that meet at a shingle (or in a group) which not only one component has."""
    met = meets.join(members.select("node", "g").join(labels, "node"), "g").select("t", "m", "node", "comp")
    apart = met.groupBy("t").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("t")
    return cut(met.join(apart, "t", "left_semi"), "apart").join(members.drop("g"), "node")


def _neighbours(met: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of each member and the NEIGHBOURS behind it, in an order of its own for each shingle.

    A family whose members link with a few others each, but not with one pivot, grows together by these at linear cost. A shingle
    that many have is cut into parts of about PART members.
    """
    salt = F.pmod(F.xxhash64("node"), (F.lit(1) + F.floor(F.col("m") / PART)).cast("long")).alias("salt")
    me = F.struct("node", "n", "meets", *(f"s{i}" for i in range(SIGNATURE // 64)))
    order = Window.partitionBy("t", "salt").orderBy(F.xxhash64("t", "node"), "node")
    rows = met.select("t", "comp", "node", "n", "meets", *(f"s{i}" for i in range(SIGNATURE // 64)), salt)
    rows = rows.select("comp", me.alias("a"), *(F.lead(F.struct("comp", me.alias("b")), k).over(order).alias(f"next{k}") for k in range(1, NEIGHBOURS + 1)))
    behind = F.array(*(f"next{k}" for k in range(1, NEIGHBOURS + 1)))
    rows = rows.select("comp", "a", F.explode(F.filter(behind, lambda x: x.isNotNull())).alias("x")).where(F.col("comp") != F.col("x.comp"))
    sides = [F.col(f"{f}.{c}").alias(name) for f, x in (("a", "a"), ("x.b", "b")) for c, name in (("node", x), ("n", f"n{x}"), ("meets", f"m{x}"), *((f"s{i}", f"s{x}{i}") for i in range(SIGNATURE // 64)))]
    return rows.select(*sides).where(_may_link(percent)).select("a", "b")


def _pairs(met: DataFrame, percent: int) -> DataFrame:
    """All pairs (a, b) of members of met(t, comp, earlier, node, ...) that meet at t first, in different components, and may link."""
    many = met.groupBy("t").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK).select("t", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    dealt = met.join(small_side(many, 64), "t", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))
    side = lambda x, i, j: dealt.select("t", F.col("comp").alias(f"c{x}"), F.col("earlier").alias(f"e{x}"), *_side(x), i.alias("i"), j.alias("j"))
    left = side("a", F.col("own"), F.explode(F.sequence("own", F.col("blocks") - 1)))
    right = side("b", F.explode(F.sequence(F.lit(0), "own")), F.col("own"))
    apart = F.when(F.col("i") == F.col("j"), F.col("ca") < F.col("cb")).otherwise(F.col("ca") != F.col("cb"))
    return left.join(right, ["t", "i", "j"]).where(apart & _may_link(percent) & ~F.arrays_overlap("ea", "eb")).select("a", "b")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels(node, comp) after more links(a, b) between nodes."""
    side = lambda x: labels.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}"))
    between = links.join(side("a"), "a").join(side("b"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).where("a <> b")
    to = components(labels.select(F.col("comp").alias("node")).distinct(), between).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    return cut(labels.join(to, "comp").select("node", F.col("to").alias("comp")), "labels")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80, filter_bytes: int = FILTER_BYTES, listed: int = LISTED) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs(doc_id, text).

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; a document's set holds its distinct k-word shingles, or its whole
    sequence if it has fewer words. Two documents link when 100 * intersection >= percent * union. component_id is the least
    doc_id reachable over links, the document itself included. Null, empty and wordless texts have 0 shingles and link with
    nothing. Repeated rows stay, each with the same result; a null doc_id counts only where nothing else is reachable. Other
    columns are ignored, and an empty table gives no rows. A text of any length is read whole; its set is held by a task, 8 bytes
    a shingle.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sc = docs.sparkSession.sparkContext
    known = sc.broadcast(repeated_shingles(docs, k, filter_bytes, listed))
    pa.default_memory_pool().release_unused()
    give_back()
    rows = cut(_nodes_of(docs, known, k, percent), "nodes")
    heads = rows.where("shingles is not null").withColumn("g", F.xxhash64("prefix", "n_shingles"))
    members = heads.select("node", "g", F.col("n_shingles").alias("n"), "meets", *(F.col("marks")[i].alias(f"s{i}") for i in range(SIGNATURE // 64)))
    members = cut(members.dropDuplicates(["node"]), "members")
    groups = cut(members.groupBy("g").agg(F.min("node").alias("node"), F.count("*").alias("size")), "groups")
    postings = heads.select("g", "prefix").dropDuplicates(["g"]).select(F.explode("prefix").alias("t"), "g")
    postings = cut(postings, "postings")
    stats = postings.groupBy("t").agg(F.min("g").alias("lo"), F.max("g").alias("hi"), F.count("*").alias("m")).where("lo < hi").select("t", "lo", "m")
    shared = cut(postings.join(stats, "t"), "shared")
    meets = shared.select("t", "g", "m").unionByName(groups.where("size > 1").select(F.col("g").alias("t"), "g", F.col("size").alias("m")))

    pivots = members.join(groups.select("g", "node"), ["g", "node"], "left_semi")
    point = lambda name: pivots.select(F.col("g").alias(f"{name}g"), *_side(name))
    across = shared.where("lo != g").select(F.col("lo").alias("ag"), F.col("g").alias("bg")).distinct().join(point("a"), "ag").join(point("b"), "bg").where(_may_link(percent)).select("a", "b")
    hot = hot_keys(groups.withColumnRenamed("g", "ag"), "ag", "size")
    inside = join_hot(members.select(F.col("g").alias("ag"), *_side("b")), point("a"), "ag", hot).where((F.col("a") != F.col("b")) & _may_link(percent)).select("a", "b")
    labels = components(members, _verified(across.unionByName(inside), heads, percent))
    labels = _merged(labels, _verified(_neighbours(_apart(meets, members, labels), percent), heads, percent))
    met = _apart(meets, members, labels)
    tokens = met.groupBy("node").agg(F.array_sort(F.collect_set("t")).alias("ts"))  # its prefix at most
    earlier = F.slice("ts", F.greatest(F.col("i") - EARLIER + 1, F.lit(1)), F.least(F.col("i"), F.lit(EARLIER))).alias("earlier")
    met = tokens.select("node", "ts", F.posexplode("ts").alias("i", "t")).select("node", "t", earlier).join(members.drop("g").join(labels, "node"), "node")
    met = cut(met, "met")
    last = _merged(labels, _verified(_pairs(met, percent), heads, percent))

    linked = rows.where("node is not null").select("doc_id", "n_shingles", "node")
    least = linked.groupBy("node").agg(F.min("doc_id").alias("least")).join(last, "node")
    named = least.join(least.groupBy("comp").agg(F.min("least").alias("component_id")), "comp").select("node", "component_id")
    done = linked.join(named, "node").select("doc_id", "n_shingles", "component_id")
    alone = rows.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return done.unionByName(alone)
