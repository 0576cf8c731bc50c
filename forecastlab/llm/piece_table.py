"""What pre-tokens give, remembered by a worker and looked up in bulk: hashes of all slices of a buffer at once, then an open-addressed table."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np

from .pretokenize import cuts

#: Slots of a table, and how many of them are used before it starts anew: a bound on a worker's memory (about 40 MB).
SLOT_BITS, REMEMBERED = 20, 600_000
#: Longer pre-tokens are encoded each time.
LONGEST = 64
#: Bytes that are hashed at a time.
CHUNK = 1 << 18

Encode = Callable[[list[bytes]], list[list[int]]]


@cache
def _powers() -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], ...]:
    """For each of two hash functions: a random value for each byte, the powers of an odd multiplier, and those of its inverse, modulo 2^64."""
    rng, out = np.random.default_rng(3), []
    for _ in range(2):
        by = int(rng.integers(0, 2**63)) | 1
        series = lambda m: np.concatenate([np.ones(1, dtype=np.uint64), np.cumprod(np.full(CHUNK, m, dtype=np.uint64))])
        out.append((rng.integers(1, 2**64, 256, dtype=np.uint64), series(by), series(pow(by, -1, 2**64))))
    return tuple(out)


def slice_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit polynomial hashes of each slice of at most CHUNK bytes, which do not depend on where the slice is."""
    out = []
    for values, up, down in _powers():
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(values[data] * up[: len(data)], out=sums[1:])
        out.append((sums[end] - sums[start]) * down[start])
    return out


class PieceTable:
    """Pre-tokens to ids. Pre-tokens of at most LONGEST bytes are known by 128 bits of hash; new ones are encoded once."""

    def __init__(self, encode: Encode):
        self.encode_new = encode
        self.first, self.second = np.zeros(1 << SLOT_BITS, dtype=np.uint64), np.zeros(1 << SLOT_BITS, dtype=np.uint64)
        self.clear()

    def clear(self) -> None:
        self.entry = np.full(1 << SLOT_BITS, -1, dtype=np.int32)
        self.at, self.n = np.zeros(REMEMBERED, dtype=np.int64), np.zeros(REMEMBERED, dtype=np.int64)
        self.flat, self.filled, self.used = np.zeros(1 << 16, dtype=np.uint32), 0, 0

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The entry of each pair of hashes, -1 without one."""
        slot = (first >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        entry = self.entry[slot]
        todo = np.flatnonzero((entry >= 0) & ((self.first[slot] != first) | (self.second[slot] != second)))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << SLOT_BITS) - 1)
            here = slot[todo]
            entry[todo] = self.entry[here]
            todo = todo[(self.entry[here] >= 0) & ((self.first[here] != first[todo]) | (self.second[here] != second[todo]))]
        return entry

    def add(self, first: np.ndarray, second: np.ndarray, pieces: list[bytes]) -> None:
        ids = self.encode_new(pieces)
        flat = np.array([i for x in ids for i in x], dtype=np.uint32)
        if self.filled + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.filled], np.zeros(max(len(self.flat), len(flat)), dtype=np.uint32)])
        self.flat[self.filled : self.filled + len(flat)] = flat
        lengths = np.array([len(x) for x in ids], dtype=np.int64)
        new = slice(self.used, self.used + len(ids))
        self.at[new], self.n[new] = self.filled + np.cumsum(lengths) - lengths, lengths
        for k, slot in enumerate((first >> np.uint64(64 - SLOT_BITS)).tolist()):
            while self.entry[slot] >= 0:
                slot = (slot + 1) & ((1 << SLOT_BITS) - 1)
            self.entry[slot], self.first[slot], self.second[slot] = self.used + k, first[k], second[k]
        self.filled, self.used = self.filled + len(flat), self.used + len(ids)

    def entries(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The entry of each slice, after new ones are learnt."""
        first, second = slice_hashes(data, start, end)
        entry = self.find(first, second)
        while len(missing := np.flatnonzero(entry < 0)):
            new = missing[np.unique(first[missing], return_index=True)[1]]
            if self.used + len(new) > REMEMBERED:
                self.clear()
                return self.entries(data, start, end)
            self.add(first[new], second[new], [data[a:b].tobytes() for a, b in zip(start[new], end[new])])
            entry[missing] = self.find(first[missing], second[missing])
        return entry

    def ids(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the slices of data that begin at `at` (the last is the end), and how many each slice has."""
        ids, counts, k = [], [], 0
        while k < len(at) - 1:
            to = max(k + 1, int(np.searchsorted(at, at[k] + CHUNK, side="right")) - 1)
            start, end, base = at[k:to], at[k + 1 : to + 1], at[k]
            long = end - start > LONGEST
            short = ~long
            part = data[base : end[-1]]
            entry = self.entries(part, start[short] - base, end[short] - base) if short.any() else np.zeros(0, dtype=np.int32)
            n, where, flat = np.zeros(len(start), dtype=np.int64), np.zeros(len(start), dtype=np.int64), self.flat
            n[short], where[short] = self.n[entry], self.at[entry]
            if long.any():
                found = self.encode_new([data[a:b].tobytes() for a, b in zip(start[long], end[long])])
                n[long] = [len(x) for x in found]
                where[long] = self.filled + np.cumsum(n[long]) - n[long]
                flat = np.concatenate([flat[: self.filled], np.array([i for x in found for i in x], dtype=np.uint32)])
            ids.append(flat[np.repeat(where - (np.cumsum(n) - n), n) + np.arange(n.sum())])
            counts.append(n)
            k = to
        return (np.concatenate(ids), np.concatenate(counts)) if ids else (np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        data, at, pieces = cuts(texts)
        ids, n = self.ids(data, at)
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(pieces)])]
        return [ids[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]
