"""Vectorised kernels over batches of text: word bounds, word hashes, shingles, packed sorted keys."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard

#: White space between words: \x20 and \x09-\x0D.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Odd multiplier of the rolling hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int, base: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)[:n]


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Runs of whole documents of about `limit` bytes each (one document at least), as (first, last + 1)."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, document) of each word [^\\x20\\x09-\\x0D]+; words never cross documents."""
    table = np.ones(256, bool)
    table[list(SPACES)] = False
    inside = table[raw]
    if not len(raw):
        z = np.zeros(0, np.int64)
        return z, z, z
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(raw))]
    starts[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(offsets, s, "right") - 1


def lower_ascii(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[raw]


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    """Prefix sums of byte * BASE**position modulo 2**64, one longer than `raw`."""
    out = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(len(raw), BASE), dtype=np.uint64, out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, inverse: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of raw[start:end], equal for equal bytes wherever they stand."""
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each word, A-Z lower-cased."""
    raw = lower_ascii(raw)
    s, e, doc = word_bounds(raw, offsets)
    return span_hashes(prefix_hashes(raw), powers(len(raw) + 1, BASE_INVERSE), s, e), doc


def hash_bytes(word: bytes) -> int:
    """The hash that span_hashes gives for these bytes alone."""
    raw = np.frombuffer(word, np.uint8)
    return int(span_hashes(prefix_hashes(raw), powers(len(raw) + 1, BASE_INVERSE), np.array([0]), np.array([len(raw)]))[0])


def shingles(words: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, bounds): the distinct k-word shingles of each document, sorted within it.

    A document with fewer words has its whole sequence as one shingle; one without words has none.
    Document d owns hash[bounds[d]:bounds[d + 1]].
    """
    n = np.bincount(doc, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(n)])
    got, where = [], []
    if len(words) >= k:
        total = np.zeros(len(words) - k + 1, np.uint64)
        for j in range(k):
            total += words[j : len(words) - k + 1 + j] * np.uint64((2 * j + 1) * 0x9E3779B97F4A7C15 + 2 * j & (1 << 64) - 1 | 1)
        whole = doc[: len(total)] == doc[k - 1 :]
        got.append(mix(total[whole]))
        where.append(doc[: len(total)][whole])
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        total = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = n[short] > j
            total[has] += mix(words[first[short[has]] + j] + np.uint64(j + 1))
        got.append(mix(total + n[short].astype(np.uint64) * np.uint64(0xA0761D6478BD642F)))
        where.append(short)
    if not got:
        return np.zeros(0, np.uint64), np.zeros(n_docs + 1, np.int64)
    h, w = np.concatenate(got), np.concatenate(where)
    if len(got) > 1:
        order = np.argsort(w, kind="stable")
        h, w = h[order], w[order]
    bounds = np.concatenate([[0], np.cumsum(np.bincount(w, minlength=n_docs))])
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
    return h[keep], np.concatenate([[0], np.cumsum(np.bincount(w[keep], minlength=n_docs))])


def planes(x: np.ndarray) -> bytes:
    """Bytes of an integer array, plane by plane, so that equal high bytes stand together."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unplanes(data: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


def pack_counts(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted uint64 keys with uint64 counts as one compressed blob."""
    n = len(keys)
    steps = np.diff(keys, prepend=np.uint64(0))
    return n.to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(planes(steps) + planes(counts.astype(np.uint64)))


def unpack_counts(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    body = zstandard.ZstdDecompressor().decompress(blob[8:])
    return np.cumsum(unplanes(body[: 8 * n], np.uint64), dtype=np.uint64), unplanes(body[8 * n :], np.uint64)


def sum_by_key(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and the sum of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.add.reduceat(counts, at)


def count_keys(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and how often each occurs."""
    if not len(keys):
        return keys, np.zeros(0, np.uint64)
    keys = np.sort(keys)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.diff(np.append(at, len(keys))).astype(np.uint64)
