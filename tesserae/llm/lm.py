"""N-gram language-model scores from log-frequency Bloom filters.

Documents go in chunks of HELD tokens. A chunk counts its words, pairs and triples of neighbouring words, cuts the sorted keys by
their top bits into regions and sends each region its part, with the counts of training documents (none for held-out ones). A
region's task adds the counts, keeps them in Bloom filters and answers every chunk's keys by probing those. So a filter grows with
the input and no worker ever holds more than one region of it: it is dealt over the workers, as nothing bounds it for a broadcast.

A count c is kept as its quantised logarithm: the place L of its highest bit, and the MANTISSA bits behind that one. The filter
holds the events (n-gram, 0) .. (n-gram, L) and one for each of the bits behind that is 1; counts under 2 ** (MANTISSA + 1) come back
exactly, greater ones to a part in 2 ** (MANTISSA + 1). A probe asks level after level until one is missing, then for the bits. An
event sets eight bits in each of several 64-bit words of a block of BLOCK; their number grows with the logarithm of the vocabulary, so that over all words
false positives add less to a context than a hundredth of one occurrence (`visits_for`).

Probabilities are smoothed towards the next lower order, and those of a context add up to 1 over all words and the unknown one:

    P(w)     = (c(w) + 1) / (C + V + 1)                         C: sum of c(w) over the V words
    P(w|v)   = (c(vw) + k2 * P(w)) / (c(v) + k2)
    P(w|uv)  = (c(uvw) + k3 * P(w|v)) / (c(uv) + k3)            the first token of a document takes P(w|v), v being an end

An n-gram never counts more than those within it. k2 and k3 are those of KAPPAS2 and KAPPAS3 that give all training documents the
greatest likelihood, each token scored by counts that are less by its own occurrence.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.counting import region_bits
from tesserae.llm.files import read_whole, write_whole
from tesserae.llm.kernels import chunks, hash_bytes, mix, pack_counts, planes, sum_by_key, unpack_counts, unplanes, utf8, word_hashes
from tesserae.session import bound_batches, cut, new_path

MANTISSA, BLOCK = 6, 8
#: Words with the two bits that 12 bits name.
TWO_BITS = np.uint64(1) << (np.arange(4096, dtype=np.uint64) & np.uint64(63)) | np.uint64(1) << (np.arange(4096, dtype=np.uint64) >> np.uint64(6))
#: Keys that are worked on at once, so that what is made on the way stays in the processor's cache.
AT_ONCE = 1 << 15
#: Tokens of a chunk; a document is never divided.
HELD = 3 << 19
KAPPAS2, KAPPAS3 = (4.0, 32.0, 256.0, 2048.0), (2.0, 16.0, 128.0, 1024.0)
PAIRS = [(a, b) for a in KAPPAS2 for b in KAPPAS3]
END = hash_bytes(b"\n")
ODD, GOLDEN, WHOLE = 0xD1B54A32D192ED03, 0x9E3779B97F4A7C15, (1 << 64) - 1
#: Bits of a key by order: two pairs or triples agree by chance far less often than a filter errs.
MASKS = (0xFFFFFFFFFFFFFFFF, 0xFFFFFFFFFFFFFF00, 0xFFFFFFFFFFFF0000)


def codes_of(counts: np.ndarray) -> np.ndarray:
    """The quantised logarithm of counts of 1 and more, as one number: 1 + L * 2 ** MANTISSA + the bits behind the highest."""
    part, power = np.frexp(counts.astype(np.float64))
    return 1 + ((power - 1).astype(np.int64) << MANTISSA) + np.floor(part * (2 << MANTISSA)).astype(np.int64) - (1 << MANTISSA)


def value_of(codes: np.ndarray) -> np.ndarray:
    """The count taken for a code: the mean of the integers that have it; 0 for 0."""
    codes = codes.astype(np.int64)
    level, bits = np.maximum(codes - 1, 0) >> MANTISSA, np.maximum(codes - 1, 0) & ((1 << MANTISSA) - 1)
    unit = np.exp2(level - MANTISSA)
    low = np.ceil(((1 << MANTISSA) + bits) * unit)
    high = np.maximum(np.ceil(((1 << MANTISSA) + bits + 1) * unit) - 1, low)
    return np.where(codes > 0, (low + high) / 2, 0.0)


def visits_for(vocabulary: int) -> int:
    """64-bit words that an event has: each lets one in 1,500 others or less pass, where a third of the bits is set."""
    return min(BLOCK, max(3, int(np.ceil(np.log(100.0 * max(vocabulary, 1)) / np.log(1500.0)))))


def _events(keys: np.ndarray, which: int, blocks: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word of the block, hash) of the events `which` of keys, all of them in one region of 2 ** bits.

    An event's block follows its key's order, shifted for each kind of event: sorted keys go through the filter from end to end,
    and the events of one frequent n-gram don't fill a block.
    """
    place = ((keys << np.uint64(bits)) >> np.uint64(32)) + np.uint64(which * GOLDEN >> 16 & 0xFFFFFFFF) & np.uint64(0xFFFFFFFF)
    return (place * np.uint64(blocks) >> np.uint64(32)) * np.uint64(BLOCK), mix(keys + np.uint64((which + 1) * ODD & WHOLE))


def _places(at: np.ndarray, h: np.ndarray, visit: int) -> tuple[np.ndarray, np.ndarray]:
    """The word of each event at a visit, another of its block each time, and the bits there."""
    word = at + (h + np.uint64(visit) & np.uint64(BLOCK - 1))
    if visit:
        h = mix(h + np.uint64(visit * GOLDEN & WHOLE))
    mask = TWO_BITS[h >> np.uint64(52)]
    for low in (40, 28, 16):
        mask |= TWO_BITS[h >> np.uint64(low) & np.uint64(4095)]
    return word, mask


def build_filter(keys: np.ndarray, codes: np.ndarray, visits: int, bits: int) -> np.ndarray:
    """The filter of these sorted n-grams of one region: 20 bits for each event and visit."""
    level, rest = (codes - 1) >> MANTISSA, (codes - 1) & ((1 << MANTISSA) - 1)
    owners = [(i, keys[level >= i]) for i in range(int(level.max(initial=-1)) + 1)]
    owners += [(64 + j, keys[rest >> j & 1 == 1]) for j in range(MANTISSA)]
    blocks = max(1, int(np.ceil(sum(len(k) for _, k in owners) * visits * 20 / 64 / BLOCK)))
    out = np.zeros(blocks * BLOCK, np.uint64)
    for which, own in owners:
        for a in range(0, len(own), AT_ONCE):
            first, h = _events(own[a : a + AT_ONCE], which, blocks, bits)
            for v in range(visits):
                np.bitwise_or.at(out, *_places(first, h, v))
    return out


def probe(held: np.ndarray, keys: np.ndarray, visits: int, bits: int) -> np.ndarray:
    """The code of each key of the region that the filter holds, 0 where its first event is missing."""
    if len(keys) > AT_ONCE:
        return np.concatenate([probe(held, keys[a : a + AT_ONCE], visits, bits) for a in range(0, len(keys), AT_ONCE)])

    def has(rows: np.ndarray, which: int) -> np.ndarray:
        first, h = _events(keys[rows], which, len(held) // BLOCK, bits)
        for v in range(visits):
            at, mask = _places(first, h, v)
            there = (held[at] & mask) == mask
            if not there.all():
                rows, first, h = rows[there], first[there], h[there]
        return rows

    level = np.full(len(keys), -1, np.int64)
    alive, i = np.arange(len(keys)), 0
    while len(alive := has(alive, i)):
        level[alive] = i
        i += 1
    codes = np.where(level >= 0, 1 + (np.maximum(level, 0) << MANTISSA), 0)
    for j in range(MANTISSA):  # a count of L + 1 bits has no more than L behind its highest
        rows = has(np.flatnonzero(level >= MANTISSA - j), 64 + j)
        codes[rows] += 1 << j
    return codes


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each token: the words of a document, then its end."""
    h, doc = word_hashes(raw, offsets)
    n_docs = len(offsets) - 1
    sizes = np.bincount(doc, minlength=n_docs) + 1
    out = np.full(len(h) + n_docs, END, np.uint64)
    out[np.arange(len(h)) + doc] = h
    return out, np.repeat(np.arange(n_docs), sizes)


def pair_keys(before: np.ndarray, t: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(GOLDEN) + mix(t)) & np.uint64(MASKS[1])


def triple_keys(first: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    return mix(first * np.uint64(0xC2B2AE3D27D4EB4F) + pairs) & np.uint64(MASKS[2])


def keys_of(t: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
    """The keys of the word, the pair and the triple that end at each token; before a document's first token stand ends."""
    before = np.concatenate([np.array([END], np.uint64), t[:-1]])  # the last token of the document before is an end
    second = np.concatenate([np.array([END], np.uint64), before[:-1]])
    second[np.diff(doc, prepend=-1) > 0] = END
    pairs = pair_keys(before, t)
    return [t, pairs, triple_keys(second, pairs)]


def smoothed(c1, before, c2, pair, c3, total: float, k2: float, k3: float, first=False) -> np.ndarray:
    """P(w|uv), P(w|v) where `first`, from the counts of w, v, vw, uv and uvw; total is C + V + 1."""
    lower = (c2 + k2 * ((c1 + 1) / total)) / (before + k2)
    return np.where(first, lower, (c3 + k3 * lower) / (pair + k3))


def likelihoods(counts: list[np.ndarray], doc: np.ndarray, held_out: np.ndarray, total: float) -> tuple[np.ndarray, np.ndarray]:
    """(log10 P of each document, of all training tokens less their own occurrence), a column for each of PAIRS.

    counts: of the word, pair and triple that end at each token; held_out: of each document.
    """
    new = np.diff(doc, prepend=-1) > 0
    c1, before = counts[0], np.roll(counts[0], 1)
    c2 = np.minimum(counts[1], np.minimum(c1, before))
    pair = np.roll(c2, 1)
    c3 = np.minimum(counts[2], np.minimum(c2, pair))
    # Up to 12 neighbours are multiplied before the logarithm is taken: none is under 1e-25.
    place = np.arange(len(doc)) - np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))
    parts = np.flatnonzero(place % 12 == 0)
    of = np.searchsorted(parts, np.flatnonzero(new))
    logs = lambda p: np.add.reduceat(np.log10(np.multiply.reduceat(p, parts)), of)
    scores = np.stack([logs(smoothed(c1, before, c2, pair, c3, total, a, b, new)) for a, b in PAIRS], axis=1)
    less = [np.maximum(x - 1, 0) for x in (c1, before, c2, pair, c3)]
    apart = np.array([logs(smoothed(*less, total, a, b, new))[~held_out].sum() for a, b in PAIRS])
    return scores, apart


def _packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(planes(x))


def _unpacked(blob: bytes, dtype) -> np.ndarray:
    return unplanes(zstandard.ZstdDecompressor().decompress(blob), dtype)


def _chunk_parts(docs: DataFrame, bits: int, folder: str) -> DataFrame:
    """(region, chunk, n1, n2, n3): each chunk's keys with training counts by region; the chunk itself goes to a file of `folder`.

    Files are named by task and number: a task that runs again writes the same ones.
    """

    def run(batches):
        number, held, n = TaskContext.get().partitionId() << 24, [], 0

        def send():
            nonlocal number, held, n
            whole = pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
            sink = pa.BufferOutputStream()
            with pa.ipc.new_file(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(whole)
            write_whole(f"{folder}/{number}", sink.getvalue())
            t, doc = tokens(*utf8(whole.column("text")))
            learnt = ~whole.column("held_out").to_numpy()[doc]
            columns = {}
            for i, keys in enumerate(keys_of(t, doc), 1):
                order = np.argsort(keys)
                own = keys[order]
                first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                own, counts = own[first], np.add.reduceat(learnt[order].astype(np.uint64), first)
                cuts = np.concatenate([[0], np.searchsorted(own, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), [len(own)]])
                columns[f"n{i}"] = [pack_counts(own[a:b], counts[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            regions = 1 << bits
            for a in range(0, regions, 512):
                rows = {"region": pa.array(range(a, min(a + 512, regions)), pa.int32()), "chunk": pa.array([number] * (min(a + 512, regions) - a), pa.int64())}
                yield pa.RecordBatch.from_pydict(rows | {k: pa.array(v[a : a + 512], pa.binary()) for k, v in columns.items()})
            number += 1

        for batch in batches:
            _, offsets = utf8(batch.column("text"))
            for a, b in chunks(offsets, 4 << 20):
                held.append(batch.slice(a, b - a))
                n += int(offsets[b] - offsets[a]) // 6  # a token's bytes, about
                if n >= HELD:
                    yield from send()
        if held:
            yield from send()

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "region int, chunk long, n1 binary, n2 binary, n3 binary")


def _answers(parts: DataFrame, bits: int, model: str | None) -> DataFrame:
    """(chunk, region, exact, c1, c2, c3, n, v, mass): the codes of each chunk's keys, and the region's totals in one of its rows.

    model: a folder for the region's filters. Regions are many enough that one of them fits in a task, whatever the keys: equal
    keys are one.
    """

    def run(table: pa.Table) -> pa.Table:
        region, out, visits, n, v, mass = table.column("region")[0].as_py(), {}, 0, 0, 0, 0.0
        for i in (1, 2, 3):
            asked = [unpack_counts(b.as_py()) for b in table.column(f"n{i}")]
            keys, counts = sum_by_key(np.concatenate([k for k, _ in asked]), np.concatenate([c for _, c in asked]))
            keys, counts = keys[counts > 0], counts[counts > 0]
            codes = codes_of(counts)
            if i == 1:
                visits, n, v, mass = visits_for(len(keys) << bits), int(counts.sum()), len(keys), float(value_of(codes).sum())
                at = [np.minimum(np.searchsorted(keys, k), max(len(keys) - 1, 0)) for k, _ in asked]
                out["exact"] = [_packed(np.where(keys[x] == k, counts[x], 0).astype(np.uint64) if len(keys) else np.zeros(len(k), np.uint64)) for x, (k, _) in zip(at, asked, strict=True)]
            held = build_filter(keys, codes, visits, bits)
            if model is not None:
                write_whole(f"{model}/{i}-{region}", bytes([visits]) + held.tobytes())
            out[f"c{i}"] = [_packed(probe(held, k, visits, bits).astype(np.uint16)) for k, _ in asked]
        once = lambda x, kind: pa.array([x] + [0] * (len(table) - 1), kind)
        return pa.table({"chunk": table.column("chunk"), "region": table.column("region"), **{k: pa.array(x, pa.binary()) for k, x in out.items()}, "n": once(n, pa.int64()), "v": once(v, pa.int64()), "mass": once(mass, pa.float64())})

    return parts.groupBy("region").applyInArrow(run, "chunk long, region int, exact binary, c1 binary, c2 binary, c3 binary, n long, v long, mass double")


def score_texts(docs: DataFrame, is_held_out, model: str | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs(doc_id, text).

    is_held_out: a column over docs; the model learns from rows where it is false. A null text counts as empty: one end and
    nothing else. Repeated rows are trained on and scored as often as they occur. Without training rows every count is 0, and
    every probability 1. An empty table gives no rows. A text of any length is scored whole; a task holds about 100 bytes for
    each of its tokens. Other columns are ignored. model: a folder that gets the filters, for `counts_in`.
    """
    spark = bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(is_held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bits, folder = region_bits(spark), new_path(spark, "chunks")
    answers = cut(_answers(_chunk_parts(docs, bits, folder), bits, model), "answers")
    n, v, mass = answers.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "v", "mass"))).first()
    total = float(mass + v + 1)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("region")
        with pa.ipc.open_file(pa.BufferReader(read_whole(f"{folder}/{table.column('chunk')[0].as_py()}"))) as f:
            rows = f.read_all().combine_chunks()
        t, doc = tokens(*utf8(rows.column("text")))
        counts, exact = [], None
        for i, keys in enumerate(keys_of(t, doc), 1):
            _, back = np.unique(keys, return_inverse=True)
            whole = lambda name, kind: np.concatenate([_unpacked(b.as_py(), kind) for b in table.column(name)])[back]  # noqa: B023, E731
            exact = whole("exact", np.uint64) if i == 1 else exact
            counts.append(value_of(whole(f"c{i}", np.uint16)))
        first = np.flatnonzero(np.diff(doc, prepend=-1))
        scores, apart = likelihoods(counts, doc, rows.column("held_out").to_numpy(), total)
        sums = lambda x: np.add.reduceat(x, first)  # noqa: E731  every document has its end
        lists = pa.FixedSizeListArray.from_arrays(pa.array(scores.ravel()), len(PAIRS)).cast(pa.list_(pa.float64()))
        return pa.table({"doc_id": rows.column("doc_id"), "held_out": rows.column("held_out"), "n_tokens": pa.array(np.bincount(doc)), "n_known": pa.array(sums((exact > 0).astype(np.int64))), "logs": pa.array(sums(np.log10(exact + 1.0))), "scores": lists, "apart": pa.array([apart.tolist()] + [None] * (len(rows) - 1), pa.list_(pa.float64()))})

    scored = cut(answers.groupBy("chunk").applyInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, logs double, scores array<double>, apart array<double>"), "scored")
    fit = scored.where("apart is not null").agg(*(F.coalesce(F.sum(F.get("apart", F.lit(i))), F.lit(0.0)) for i in range(len(PAIRS)))).first()
    best = int(np.argmax(fit))
    if model is not None:
        write_whole(f"{model}/meta", json.dumps({"bits": bits, "total": total, "kappas": PAIRS[best], "words": int(v)}).encode())
    base = F.col("logs") - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(n)).cast("long").alias("train_tokens"), base.alias("base_score"), F.get("scores", F.lit(best)).alias("score"))


def counts_in(model: str, order: int, keys: np.ndarray) -> np.ndarray:
    """The counts that a stored model's filters hold of words (order 1), pairs or triples: one region of them at a time."""
    bits = json.loads(read_whole(f"{model}/meta"))["bits"]
    region = (keys >> np.uint64(64 - bits)).astype(np.int64)
    out = np.zeros(len(keys))
    for r in np.unique(region):
        blob = read_whole(f"{model}/{order}-{r}")
        out[region == r] = value_of(probe(np.frombuffer(blob, np.uint64, offset=1), keys[region == r], blob[0], bits))
    return out
