"""Corpus-wide counts of 64-bit keys, and Bloom filters over them, built in regions of the key space.

Each task sorts and counts its own keys, cuts them by the top bits into regions and sends one compressed blob per region.
A region's blobs meet in one task: as many as there are tasks, each bounded by FLUSH keys over the regions, however hot a key is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tesserae.llm.kernels import count_keys, mix, pack_counts, sum_by_key, unpack_counts

#: Keys that a task holds before it sends what it has.
FLUSH = 3 << 20


def region_bits(spark) -> int:
    """log2 of the number of regions: at least the session's shuffle partitions, which follow the input's size."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(4, min(16, int(np.ceil(np.log2(max(n, 1))))))


def emit_counts(parts: Iterator[np.ndarray], bits: int, kind: int = 0) -> Iterator[pa.RecordBatch]:
    """Blobs of counted keys by region, from arrays of keys."""
    held, n = [], 0

    def flush():
        keys, counts = count_keys(np.concatenate(held))
        cuts = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
        bounds = np.concatenate([[0], cuts, [len(keys)]])
        full = [r for r in range(1 << bits) if bounds[r + 1] > bounds[r]]
        blobs = [pack_counts(keys[bounds[r] : bounds[r + 1]], counts[bounds[r] : bounds[r + 1]]) for r in full]
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(full), pa.int32()), pa.array(full, pa.int32()), pa.array(blobs, pa.binary())], names=["kind", "region", "blob"])

    for keys in parts:
        held.append(keys)
        n += len(keys)
        if n >= FLUSH:
            yield flush()
            held, n = [], 0
    if n:
        yield flush()


def merge_blobs(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of one region from the blobs of all tasks."""
    got = [unpack_counts(b) for b in blobs]
    return sum_by_key(np.concatenate([k for k, _ in got]), np.concatenate([c for _, c in got]))


def by_region(blobs: DataFrame, fn: Callable[[int, int, np.ndarray, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """fn(kind, region, keys, counts) for each region, in parallel."""

    def run(table: pa.Table) -> pa.Table:
        keys, counts = merge_blobs(table.column("blob").to_pylist())
        return fn(table.column("kind")[0].as_py(), table.column("region")[0].as_py(), keys, counts)

    return blobs.groupBy("kind", "region").applyInArrow(run, schema)


def filter_words(n_keys: int, per_key: float) -> int:
    """Number of 64-bit words of a filter for n_keys keys, a power of two."""
    return 1 << max(3, int(np.ceil(np.log2(max(n_keys * per_key / 64, 1)))))


def bit_places(keys: np.ndarray, words: int, k: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Of each key: the word (blocked filter: one 64-bit word a key) and a mask with up to k bits in it."""
    h = mix(keys ^ np.uint64(0xC2B2AE3D27D4EB4F))
    mask = np.zeros(len(keys), np.uint64)
    for j in range(k):
        mask |= np.uint64(1) << (h >> np.uint64(6 * j) & np.uint64(63))
    return (h >> np.uint64(32)) % np.uint64(words), mask


def filter_of(keys: np.ndarray, words: int, k: int = 3) -> np.ndarray:
    """The filter that holds these keys."""
    at, mask = bit_places(keys, words, k)
    out = np.zeros(words, np.uint64)
    np.bitwise_or.at(out, at, mask)
    return out


def probe(table: np.ndarray, words: int, bits: int, keys: np.ndarray, k: int = 3) -> np.ndarray:
    """Whether each key may be in `table`, the filters of all 2**bits regions one after the other."""
    at, mask = bit_places(keys, words, k)
    at += (keys >> np.uint64(64 - bits)) * np.uint64(words)
    return (table[at] & mask) == mask
