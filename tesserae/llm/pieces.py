"""SentencePiece encoding and decoding by batched numpy Viterbi.

Texts are cut into units: a run of spaces and what follows up to the next space. No piece has a space behind another character
(checked on loading), so no piece crosses a unit. Different units of one length in characters advance together, character by
character: the hashes of all substrings that end there probe the sorted keys of the pieces, each piece found extends the path
to its start, and a vectorised maximum keeps the best path to each position with a back-pointer to its last piece.

Unigram models give paths the sum of their pieces' scores. Models of kind BPE hold merge priorities as scores, and the greatest
sum of those isn't what merging gives. For them the lattice is restricted instead: a piece may follow another only if merging
leaves that pair as it is. A sequence is what merging gives if and only if each neighbouring pair of it is, so exactly one path
is left to every position, and the same search finds the library's ids. Whether a pair stays is found by undoing its latest
merges one after the other and asking whether the two pieces at the border would have been merged before. Pieces of equal score
share a rank, and of equal merges the leftmost comes first; so it is with runs of spaces.

Long units are cut into windows that overlap, and these advance together like other words. Two windows that have a piece in common
at the same place are joined there: all neighbouring pairs of the joint sequence stay, so it is the sequence of the whole. Where
two windows share none, and for unigram models, a long unit is searched from end to end, in blocks of positions.

Characters without a piece become their UTF-8 bytes' pieces, or the unknown piece in models without those.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.kernels import BASE_INVERSE, chunks, mix, powers, prefix_hashes, span_hashes, utf8
from tesserae.llm.units import Units, flat
from tesserae.session import bound_batches

SPACE = "\u2581"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, BYTE, USER = 1, 2, 6, 4
NEVER = np.int64(1 << 40)
#: Positions times words of one batch of the search.
CELLS = 1 << 18
#: Top bits of a hash by which most substrings that aren't pieces are passed over before the search.
SEEN_BITS = 20
#: Pairs of pieces that are remembered, a power of two.
REMEMBERED = 1 << 20
#: Characters of a window of a longer unit, and how many of them the next window has, too. Their difference is a multiple of the
#: sizes that runs of one character are mostly cut to.
WINDOW, OVERLAP = 256, 64
#: Bytes of text that are searched at once, and whose ids are made at once; one document at least.
SEARCHED_BYTES, BLOCK_BYTES = 4 << 20, 1 << 18


def merge(text: str, scores: dict[str, float]) -> list[tuple[str, tuple]]:
    """What merging makes of a text, each piece with its tree: the best pair first, of equal ones the leftmost. Plain and slow."""
    at = [(c, ()) for c in text]
    while True:
        best = max(((scores[a[0] + b[0]], -i) for i, (a, b) in enumerate(zip(at, at[1:], strict=False)) if a[0] + b[0] in scores), default=None)
        if best is None:
            return at
        i = -best[1]
        at[i : i + 2] = [(at[i][0] + at[i + 1][0], (at[i], at[i + 1]))]


def load(path: str) -> dict:
    """What the search needs of a model file, as arrays. Only files that leave texts as they are (identity) are taken."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model = pb.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    spec, kind = model.normalizer_spec, model.trainer_spec.model_type
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and BPE models that don't normalise are supported")
    return build([(p.piece, p.score, p.type) for p in model.pieces], kind, spec.add_dummy_prefix, model.trainer_spec.unk_id)


def build(pieces: list[tuple[str, float, int]], kind: int, prefix: bool, unknown: int) -> dict:
    """load() from (piece, score, type) of each id."""
    scores = {p: s for p, s, t in pieces if t in (NORMAL, USER)}
    if any(SPACE in p.lstrip(SPACE) for p in scores):
        raise ValueError("a piece has a space behind another character")
    ids = {p: i for i, (p, _, t) in enumerate(pieces) if t in (NORMAL, USER)}
    raw = [p.encode() for p in ids]
    joined = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(p) for p in raw])
    keys = span_hashes(prefix_hashes(joined), powers(len(joined) + 1, BASE_INVERSE), ends - [len(p) for p in raw], ends)
    order = np.argsort(keys)
    n = len(pieces)
    left, right = np.full(n + 1, -1, np.int32), np.full(n + 1, -1, np.int32)
    rank, born = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
    if kind == BPE:
        order_of = {x: i for i, x in enumerate(sorted(set(scores.values()), reverse=True))}
        for p, x in scores.items():
            rank[ids[p]] = order_of[x]
        for p in sorted(ids, key=len):
            if len(p) > 1:
                made = merge(p, scores)
                if len(made) == 1:
                    a, b = (ids.get(x[0], -1) for x in made[0][1])
                    if born[a] < NEVER and born[b] < NEVER and a >= 0 and b >= 0:
                        left[ids[p]], right[ids[p]], born[ids[p]] = a, b, max(rank[ids[p]], born[a], born[b])
                        continue
                born[ids[p]] = NEVER  # merging never makes it
    pairs = np.array([(ids[p[:k]] * n + ids[p[k:]], rank[i]) for p, i in ids.items() for k in range(1, len(p)) if p[:k] in ids and p[k:] in ids] or [(-1, 0)], np.int64)
    pairs = pairs[np.argsort(pairs[:, 0])]
    shown = [bytes([int(p[3:5], 16)]) if t == BYTE else b"" if t not in (NORMAL, USER, UNKNOWN) else b" \xe2\x81\x87 " if t == UNKNOWN else p.replace(SPACE, " ").encode() for p, _, t in pieces]
    as_bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == BYTE}
    return {
        "kind": kind, "prefix": prefix, "n": n, "unknown": unknown, "longest": max(map(len, ids)),
        "keys": keys[order], "seen": np.bincount((keys >> np.uint64(64 - SEEN_BITS)).astype(np.int64), minlength=1 << SEEN_BITS) > 0, "places": np.array(list(ids.values()), np.int32)[order],
        "score": np.array([s for _, s, _ in pieces] + [min(scores.values()) - 10.0], np.float32), "left": left, "right": right, "rank": rank, "born": born, "pairs": pairs[:, 0].copy(), "pair_rank": pairs[:, 1].copy(),
        "bytes": np.array([as_bytes.get(i, -1) for i in range(256)], np.int64) if len(as_bytes) == 256 else None,
        "shown": np.frombuffer(b"".join(shown), np.uint8), "shown_at": np.concatenate([[0], np.cumsum([len(x) for x in shown])]),
        "names": [p for p, _, _ in pieces] + [""], "sizes": [len(p) for p, _, _ in pieces] + [1],
    }


class Pieces(Units):
    """The encoder of one model."""

    def __init__(self, model: dict):
        super().__init__()
        self.m = model
        self.pairs, self.stays = np.full(REMEMBERED, -1, np.int64), np.zeros(REMEMBERED, bool)

    def solid(self, raw: np.ndarray) -> np.ndarray:
        return raw != 32

    def joined_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the piece that two pieces make in a row; NEVER if there is none."""
        pairs, key = self.m["pairs"], a.astype(np.int64) * self.m["n"] + b
        at = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
        return np.where(pairs[at] == key, self.m["pair_rank"][at], NEVER)

    def stay(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves each pair (a, b) of pieces as it is."""
        out = np.ones(len(a), bool)
        alive = np.flatnonzero((a < self.m["n"]) & (b < self.m["n"]))
        x, y = a.copy(), b.copy()
        limit = np.full(len(a), NEVER)
        left, right, born = self.m["left"], self.m["right"], self.m["born"]
        while len(alive):
            u, v = x[alive], y[alive]
            meet = self.joined_rank(u, v)
            when = np.maximum(meet, np.maximum(born[u], born[v]))
            merged = (meet < NEVER) & (when < limit[alive])
            out[alive[merged]] = False
            alive, u, v = alive[~merged], u[~merged], v[~merged]
            # Undo the later of the two; of equal times the right one, as merging goes from left to right.
            undo = (born[u] > born[v]) & (left[u] >= 0)
            undo_right = ~undo & (left[v] >= 0)
            undo |= ~undo_right & (left[u] >= 0)
            limit[alive[undo]] = born[u[undo]]
            x[alive[undo]] = right[u[undo]]
            limit[alive[undo_right]] = born[v[undo_right]] + 1
            y[alive[undo_right]] = left[v[undo_right]]
            alive = alive[undo | undo_right]
        return out

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """stay(), remembered in a table where a pair has one place and a later one takes it over."""
        key = a.astype(np.int64) * (self.m["n"] + 1) + b
        place = (mix(key.view(np.uint64)) & np.uint64(len(self.pairs) - 1)).astype(np.int64)
        out = self.stays[place]
        new = np.flatnonzero(self.pairs[place] != key)
        if len(new):
            own, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            found = self.stay(own // (self.m["n"] + 1), own % (self.m["n"] + 1))
            out[new] = found[back]
            at = place[new[first]]
            self.pairs[at], self.stays[at] = own, found
            again = self.pairs[at] != own  # two new pairs in one place: the last has it
            if again.any():
                self.pairs[at[again]] = -1
        return out

    def lookup(self, at: np.ndarray, first: int, stop: int, prefix: np.ndarray, inverse: np.ndarray) -> np.ndarray:
        """found[size, end - first, word]: the piece of `size` characters that ends there, -1 if there is none."""
        m, (words, n) = self.m, (len(at), at.shape[1] - 1)
        longest = min(n, m["longest"])
        found = np.full((longest + 1, stop - first, words), -1, np.int32)
        for size in range(1, min(longest, stop - 1) + 1):
            least = max(first, size)
            h = span_hashes(prefix, inverse, at[:, least - size : stop - size].T, at[:, least:stop].T)
            part = found[size, least - first :]
            if size == 1:
                part[:] = m["n"]  # a character without a piece stands alone
            some = np.nonzero(m["seen"][h >> np.uint64(64 - SEEN_BITS)])
            h = h[some]
            p = np.minimum(np.searchsorted(m["keys"], h), len(m["keys"]) - 1)
            hit = m["keys"][p] == h
            if m["kind"] == BPE:
                hit &= m["born"][m["places"][p]] < NEVER
            part[some[0][hit], some[1][hit]] = m["places"][p[hit]]
        return found

    def search(self, at: np.ndarray, prefix: np.ndarray, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, bounds by word) of words given by the byte bounds of their characters, at[word, character].

        Unknown characters have id n. Pieces are looked up for a block of positions at a time, and sums are kept as far back as
        a piece reaches; only the last piece at each position is kept for all.
        """
        m, (words, n) = self.m, (len(at), at.shape[1] - 1)
        longest, every = min(n, m["longest"]), np.arange(words)
        best = np.full((longest + 1, words), -np.inf, np.float32)  # of position i in row i modulo its size
        best[0] = 0
        last, back = np.full((n + 1, words), -1, np.int32), np.zeros((n + 1, words), np.int16)
        step = max(1, CELLS // (words * longest))
        for first in range(1, n + 1, step):
            found = self.lookup(at, first, min(first + step, n + 1), prefix, inverse)
            for i in range(first, first + found.shape[1]):
                size = min(i, longest)
                piece = found[1 : size + 1, i - first]
                before = best[(i - 1 - np.arange(size)) % len(best)]
                s, w = np.nonzero((piece >= 0) & (before > -np.inf))
                p, value = piece[s, w], before[s, w]
                if m["kind"] == BPE:
                    inner = np.flatnonzero(i - 1 - s > 0)
                    ok = np.ones(len(s), bool)
                    ok[inner] = self.may_follow(last[i - 1 - s[inner], w[inner]], p[inner])
                    value = np.where(ok, value, -np.inf)
                else:
                    value = value + m["score"][p]
                values = np.full(piece.shape, -np.inf, np.float32)
                values[s, w] = value
                top = size - 1 - values[::-1].argmax(axis=0)  # of equal sums the longest last piece, as the library has it
                best[i % len(best)], last[i], back[i] = values[top, every], piece[top, every], top + 1
        steps, where = [], np.full(words, n)
        while (where > 0).any():
            live = where > 0
            steps.append(np.where(live, last[where, every], -1))
            where = where - np.where(live, back[where, every], 0)
        table = np.array(steps[::-1]).T
        kept = table >= 0
        return table[kept], np.concatenate([[0], np.cumsum(kept.sum(axis=1))])

    def searched(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text, those of one length together."""
        out: list = [None] * len(texts)
        by_size: dict[int, list[int]] = {}
        for i, text in enumerate(texts):
            by_size.setdefault(len(text), []).append(i)
        for size, members in by_size.items():
            step = max(1, CELLS // (size * min(size, self.m["longest"])))
            for a in range(0, len(members), step):
                block = members[a : a + step]
                raw = np.frombuffer("".join([texts[i] for i in block]).encode(), np.uint8)
                starts = np.flatnonzero((raw & 0xC0) != 0x80)
                at = np.append(starts, len(raw))[np.arange(len(block))[:, None] * size + np.arange(size + 1)[None, :]]
                ids, bounds = self.search(at, prefix_hashes(raw), powers(len(raw) + 1, BASE_INVERSE))
                flat, cuts = ids.tolist(), bounds.tolist()
                for k, i in enumerate(block):
                    out[i] = flat[cuts[k] : cuts[k + 1]]
        return out

    def joined(self, text: str) -> list[int]:
        """The ids of a long text from windows of it."""
        sizes, starts = self.m["sizes"], range(0, len(text) - OVERLAP, WINDOW - OVERLAP)
        out, ends = [], []  # ids so far, and where each ends
        for a, found in zip(starts, self.searched([text[a : a + WINDOW] for a in starts]), strict=True):
            cuts = (a + np.cumsum([sizes[i] for i in found])).tolist()
            if a:
                place = {e: k for k, e in enumerate(cuts)}
                k = bisect_left(ends, a + 1)
                while k < len(ends) and not ((j := place.get(ends[k])) is not None and found[j] == out[k]):
                    k += 1
                if k == len(ends):
                    return self.searched([text])[0]
                del out[k:], ends[k:]
                found, cuts = found[j:], cuts[j:]
            out += found
            ends += cuts
        return out

    def learn(self, units: list[str]) -> list:
        texts = [u.replace(" ", SPACE) for u in units]
        long = {i for i, t in enumerate(texts) if len(t) > WINDOW and self.m["kind"] == BPE}
        short = iter(self.searched([t for i, t in enumerate(texts) if i not in long]))
        new = [self.joined(t) if i in long else next(short) for i, t in enumerate(texts)]
        return [self.spelt(t, ids) if self.m["n"] in ids else ids for t, ids in zip(texts, new, strict=True)]

    def spelt(self, text: str, ids: list[int]) -> list[int]:
        """Ids with each unknown character (id n) in its bytes."""
        out, at = [], 0
        for i in ids:
            p = self.m["names"][i] if i < self.m["n"] else text[at]
            out.append((i, p))
            at += len(p)
        return self.with_bytes(out)

    def with_bytes(self, found: list[tuple[int, str]]) -> list[int]:
        out: list[int] = []
        for i, p in found:
            if i < self.m["n"]:
                out.append(i)
            elif self.m["bytes"] is not None:
                out += [int(self.m["bytes"][b]) for b in p.encode()]
            elif not out or out[-1] != self.m["unknown"]:
                out.append(self.m["unknown"])
        return out


def prepared(model: dict, text: bytes) -> bytes:
    """The text that is cut into units: the model's space mark is a space, and a space stands before any text."""
    text = text.replace(SPACE.encode(), b" ")
    return b" " + text if text and model["prefix"] else text


def decode_flat(model: dict, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """The bytes of each text of a flat array of ids, without the space that stands before it."""
    at = model["shown_at"]
    sizes = (at[1:] - at[:-1])[ids]
    total = np.concatenate([[0], np.cumsum(sizes)])
    flat = model["shown"][np.repeat(at[ids] - total[:-1], sizes) + np.arange(int(total[-1]))]
    cuts = total[bounds]
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        a = int(a) + (1 if model["prefix"] and b > a and flat[a] == 32 else 0)
        out.append(flat[a:b].tobytes())
    return out


def encode_texts(docs: DataFrame, model_path: str, with_ids: bool = True) -> DataFrame:
    """docs (text and any other columns but `text`) with n_tokens, ids_crc32, decoded_sha256, round_trip[, ids].

    ids are those of the model file for the whole text; decoded is what they decode to, and round_trip tells whether it equals the
    text, as it does for each text without the model's space mark. ids_crc32: of the ids as little-endian uint32. A null or empty
    text has no ids. Repeated rows get equal results. Columns of docs that are called like a result are replaced by it. A text of
    any length is encoded whole: memory grows with it by some 50 bytes a character, time in proportion, words without spaces
    included (for unigram models these take a step for each character).
    """
    spark = bound_batches(docs.sparkSession)
    shared = spark.sparkContext.broadcast({"model": load(model_path)})
    results = ["n_tokens", "ids_crc32", "decoded_sha256", "round_trip", *(["ids"] if with_ids else [])]
    docs = docs.drop(*results)
    others = [c for c in docs.columns if c != "text"]
    schema = docs.select(*others, F.lit(0).cast("long").alias("n_tokens"), F.lit(0).cast("long").alias("ids_crc32"), F.lit("").alias("decoded_sha256"), F.lit(True).alias("round_trip"), *([F.expr("cast(array() as array<int>)").alias("ids")] if with_ids else [])).schema

    def run(batches):
        model = shared.value
        encoder = model.setdefault("encoder", Pieces(model["model"]))  # the worker keeps what it has learnt for its next tasks
        for batch in batches:
            raw, offsets = utf8(batch.column("text"))
            for first, stop in chunks(offsets, SEARCHED_BYTES):
                texts = [raw[x:y].tobytes() for x, y in zip(offsets[first:stop], offsets[first + 1 : stop + 1], strict=True)]
                numbers, cuts = encoder.numbers(*flat([prepared(encoder.m, t) for t in texts]))
                for a, b in chunks(offsets[first : stop + 1] - offsets[first], BLOCK_BYTES):
                    yield block(encoder, batch.slice(first + a, b - a), texts[a:b], numbers[cuts[a] : cuts[b]], cuts[a : b + 1] - cuts[a])

    def block(encoder, rows, texts, numbers, cuts):
        ids, bounds = encoder.ids(numbers, cuts)
        shown = decode_flat(encoder.m, ids, bounds)
        parts = [np.ascontiguousarray(ids[x:y], "<u4") for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
        out = [rows.column(c) for c in others]
        out += [pa.array(np.diff(bounds), pa.int64()), pa.array([zlib.crc32(x) for x in parts], pa.int64()), pa.array([sha256(x).hexdigest() for x in shown]), pa.array([t == x for t, x in zip(texts, shown, strict=True)])]
        if with_ids:
            out.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids.astype(np.int32))))
        return pa.RecordBatch.from_arrays(out, names=[*others, *results])

    return docs.withColumn("text", F.col("text").cast("string")).mapInArrow(run, schema)


def decode_ids(rows: DataFrame, model_path: str) -> DataFrame:
    """rows (ids and any other columns) with `text`; null ids give a null text, bytes that aren't UTF-8 U+FFFD."""
    spark = bound_batches(rows.sparkSession)
    shared = spark.sparkContext.broadcast(load(model_path))
    rows = rows.drop("text")
    schema = rows.select("*", F.lit(None).cast("string").alias("text")).schema

    def run(batches):
        for batch in batches:
            column = batch.column("ids")
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy())]).astype(np.int64)
            texts = [x.decode("utf-8", "replace") for x in decode_flat(shared.value, flat, bounds)]
            text = pa.array([None if null else t for t, null in zip(texts, column.is_null().to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], names=[*batch.schema.names, "text"])

    return rows.mapInArrow(run, schema)
