"""A minimal perfect hash over 64-bit keys that verifies its keys.

Built in rounds: the keys left over are hashed into twice as many bits; a key that has a bit for itself is settled
there, the others go on to the next round. A key's slot is the number of set bits before its own, so n keys have the
slots 0 to n - 1 in about 4 bits a key. Any key has some slot or none; as the slot's own key is stored beside it,
``slots`` tells members from others exactly.
"""

from __future__ import annotations

import numpy as np

ONE = np.uint64(1)


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    z = keys.view(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class PerfectHash:
    """keys: those of the slots, in their order; bits, before: the rounds' bits by 64 and the number of set ones before;
    sizes: the rounds' bits."""

    def __init__(self, keys: np.ndarray, bits: np.ndarray, before: np.ndarray, sizes: list[int]):
        self.keys, self.bits, self.before, self.sizes = keys, bits, before, sizes

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        """keys: distinct signed 64-bit numbers."""
        left, rounds, sizes = keys, [], []
        while len(left):
            size = -(-2 * len(left) // 64) * 64
            place = (mixed(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            rounds.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = left[~alone[place]]
        bits = np.concatenate(rounds) if rounds else np.empty(0, np.uint64)
        ones = np.bitwise_count(bits).astype(np.int64)
        made = cls(keys, bits, np.cumsum(ones) - ones, sizes)
        stored = np.empty_like(keys)
        stored[made._places(keys)] = keys
        made.keys = stored
        return made

    def _places(self, keys: np.ndarray) -> np.ndarray:
        """A slot for each key that finds a set bit, else -1."""
        found = np.full(len(keys), -1, np.int64)
        left, offset = np.arange(len(keys)), 0
        for seed, size in enumerate(self.sizes):
            if not len(left):
                break
            at = mixed(keys[left], seed) % np.uint64(size) + np.uint64(offset)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            held = self.bits[word]
            hit = (held >> bit) & ONE == ONE
            below = np.bitwise_count(held & ((ONE << bit) - ONE)).astype(np.int64)
            found[left[hit]] = (self.before[word] + below)[hit]
            left, offset = left[~hit], offset + size
        return found

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for those that are no members."""
        found = self._places(keys)
        some = np.flatnonzero(found >= 0)
        other = self.keys[found[some]] != keys[some]
        found[some[other]] = -1
        return found

    def dump(self) -> dict[str, bytes]:
        return {"keys": self.keys.tobytes(), "bits": self.bits.tobytes(), "sizes": np.array(self.sizes, np.int64).tobytes()}

    @classmethod
    def load(cls, told: dict[str, bytes]) -> PerfectHash:
        bits = np.frombuffer(told["bits"], np.uint64)
        ones = np.bitwise_count(bits).astype(np.int64)
        return cls(np.frombuffer(told["keys"], np.int64), bits, np.cumsum(ones) - ones, np.frombuffer(told["sizes"], np.int64).tolist())
