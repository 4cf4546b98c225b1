"""Encoding by remembered units: texts are cut where no token can cross, and each different unit is encoded once.

Units are told apart by 64-bit hashes of their bytes. They are found, hashed and looked up as arrays; only new ones become strings.
"""

from __future__ import annotations

from itertools import chain

import numpy as np

from tesserae.llm.kernels import BASE_INVERSE, chunks, powers, prefix_hashes, span_hashes


class Units:
    """What is known of units. A subclass tells white space from other bytes, and encodes new units with `learn`.

    A unit is a run of white space and the run of other bytes behind it; white space at a text's end is one of its own.
    """

    #: Units and their bytes that are remembered; beyond, the half of them that was used most stays.
    most_units, most_bytes = 500_000, 8_000_000

    def __init__(self):
        self.keys, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # sorted hashes, and the number of each
        self.pool, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int32)  # ids by number
        self.uses, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def __len__(self) -> int:
        return len(self.keys)

    def solid(self, raw: np.ndarray) -> np.ndarray:
        """Whether each byte is none of white space."""
        raise NotImplementedError

    def learn(self, units: list[str]) -> list:
        """The ids of each unit."""
        raise NotImplementedError

    def thin(self) -> None:
        """Forget units that were used once, and of the others all but the most used half of what may be held."""
        order = np.argsort(-self.uses, kind="stable")[: self.most_units // 2]
        order = order[self.uses[order] > 1]
        kept = order[np.cumsum(self.lengths[order]) <= self.most_bytes // 2]
        renamed = np.full(len(self), -1, np.int32)
        renamed[kept] = np.arange(len(kept))
        stays = renamed[self.places] >= 0
        self.keys, self.places = self.keys[stays], renamed[self.places[stays]]
        starts, self.sizes = self.starts[kept], self.sizes[kept]
        self.starts = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        self.pool = self.pool[np.repeat(starts - self.starts, self.sizes) + np.arange(int(self.sizes.sum()))]
        self.uses, self.lengths = self.uses[kept] // 2, self.lengths[kept]

    def spans(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, bytes) of each unit of texts; they stand one behind the other."""
        ends = self.solid(raw)
        ends[:-1] &= ~ends[1:]
        ends[np.unique(offsets[1:][offsets[1:] > 0]) - 1] = True  # a run ends with its text
        ends = np.flatnonzero(ends) + 1
        starts = np.concatenate([[0], ends[:-1]])
        return span_hashes(prefix_hashes(raw), powers(len(raw) + 1, BASE_INVERSE), starts, ends), ends - starts

    def numbers(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the numbers of all units, bounds by text) of texts in UTF-8; new units are learnt. Valid until the next call."""
        if len(self) > self.most_units or int(self.lengths.sum()) > self.most_bytes:
            self.thin()
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        found = [self.spans(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in chunks(offsets) if offsets[b] > offsets[a]]
        h = np.concatenate([x for x, _ in found])
        lengths = np.concatenate([x for _, x in found])
        ends = np.cumsum(lengths)
        starts = ends - lengths
        own, first, back = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.keys, own)
        known = np.zeros(len(own), bool)
        known[at < len(self)] = self.keys[at[at < len(self)]] == own[at < len(self)]
        number = np.zeros(len(own), np.int32)
        number[known] = self.places[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            whole, spans = raw.tobytes(), zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)
            learnt = self.learn([whole[a:b].decode() for a, b in spans])
            number[new] = len(self) + np.arange(len(new))
            self.keys, self.places = np.insert(self.keys, at[new], own[new]), np.insert(self.places, at[new], number[new])
            sizes = np.fromiter(map(len, learnt), np.int32, len(learnt))
            self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes, dtype=np.int64) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.pool = np.concatenate([self.pool, np.fromiter(chain.from_iterable(learnt), np.uint32, int(sizes.sum()))])
            self.lengths = np.concatenate([self.lengths, lengths[first[new]].astype(np.int32)])
            self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
        self.uses[number] += np.bincount(back, minlength=len(own))
        return number[back], np.searchsorted(starts, offsets)

    def ids(self, numbers: np.ndarray, bounds: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds by text) from their units; each text's ids are followed by `end`, if given."""
        starts, sizes, pool = self.starts, self.sizes, self.pool
        if end is not None:  # one more unit, of the end id alone
            numbers, bounds = np.insert(numbers, bounds[1:], len(starts)), bounds + np.arange(len(bounds))
            starts, sizes, pool = np.append(starts, len(pool)), np.append(sizes, 1), np.append(pool, np.uint32(end))
        n = sizes[numbers]
        total = np.concatenate([[0], np.cumsum(n, dtype=np.int64)])
        return pool[np.repeat(starts[numbers] - total[:-1], n) + np.arange(int(total[-1]))], total[bounds]

    def encode(self, texts: list[str], end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """ids() of texts."""
        return self.ids(*self.numbers(*flat([t.encode() for t in texts])), end)


def flat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of texts."""
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))]).astype(np.int64)
