"""Canonical Huffman codes of limited length, and blocks of coded ids that are decoded in lanes.

Code lengths follow from counts by package-merge; the codes themselves from the
lengths alone: shorter ones first, equal ones by id. A block keeps, besides its
bits, how many bits every LANE ids take, so each lane starts at a known bit and
all lanes of a block are decoded side by side, a table look-up for each id.
"""

from __future__ import annotations

import numpy as np

#: Ids between two checkpoints.
LANE = 64
#: Bits of the longest code, unless so many ids occur that they need more; the decoder takes up to 25.
LIMIT, LONGEST = 18, 25
#: Bits of a length within an entry of the decoder's table.
_LENGTH_BITS = 5


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """The lengths, up to `limit`, that need the fewest bits for these counts (above 0). A single id takes one bit."""
    n = len(counts)
    if n > 1 << limit:
        raise ValueError(f"{n} codes don't fit into {limit} bits")
    if n < 2:
        return np.ones(n, np.int64)
    order = np.argsort(counts, kind="stable")
    leaves = np.asarray(counts, np.int64)[order]
    packages, is_leaf = np.zeros(0, np.int64), []
    for _ in range(limit):
        items = np.concatenate([leaves, packages])
        by_weight = np.argsort(items, kind="stable")
        is_leaf.append(by_weight < n)
        items = items[by_weight][: len(items) // 2 * 2]
        packages = items[::2] + items[1::2]
    lengths, taken = np.zeros(n, np.int64), 2 * n - 2
    for leaf in reversed(is_leaf):
        k = int(leaf[:taken].sum())
        lengths[:k] += 1  # the k lightest
        taken = 2 * (taken - k)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """A canonical code for `symbols` (ascending ids) with these lengths."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray):
        self.symbols, self.lengths = np.asarray(symbols, np.uint32), np.asarray(lengths, np.uint8)
        self.limit = int(self.lengths.max(initial=1))
        if self.limit > LONGEST:
            raise ValueError(f"codes of {self.limit} bits")
        order = np.lexsort((self.symbols, self.lengths))
        wide = np.int64(1) << (self.limit - self.lengths[order].astype(np.int64))  # places that a code takes in a table of all `limit` bits
        first = np.cumsum(wide) - wide
        if len(wide) and first[-1] + wide[-1] > 1 << self.limit:
            raise ValueError("the lengths are no code")
        self._sorted, self._wide = order, wide
        size = int(self.symbols[-1]) + 1 if len(self.symbols) else 0
        self.code_of, self.length_of = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        self.code_of[self.symbols[order]] = first >> (self.limit - self.lengths[order].astype(np.int64))
        self.length_of[self.symbols] = self.lengths

    @staticmethod
    def of(symbols: np.ndarray, counts: np.ndarray) -> Code:
        """The best code for ids and their counts."""
        return Code(symbols, code_lengths(counts, max(LIMIT, (len(symbols) - 1).bit_length() + 1)))

    def table(self) -> np.ndarray:
        """For each value of the next `limit` bits: the id's place in the sorted symbols and its length; length 0 where no code fits."""
        out = np.zeros(1 << self.limit, np.uint32)
        entry = self._sorted.astype(np.uint32) << _LENGTH_BITS | self.lengths[self._sorted]
        out[: int(self._wide.sum())] = np.repeat(entry, self._wide)
        return out

    def encode(self, ids: np.ndarray) -> bytes:
        """A block: the bits of each lane as 16-bit numbers, then all codes one after the other."""
        lengths = self.length_of[ids]
        if not lengths.all():
            raise ValueError("an id without a code")
        ends = np.cumsum(lengths)
        at = ends - lengths
        lanes = np.diff(np.append(at[::LANE], ends[-1] if len(ends) else 0)) if len(ids) else np.zeros(0)
        # A code lies in two neighbouring words of 32 bits at most; codes don't overlap, so sums are unions.
        word = at >> 5
        wide = self.code_of[ids] << (64 - (at & 31) - lengths).astype(np.uint64)
        words = (int(ends[-1]) >> 5) + 2 if len(ids) else 0
        bits = np.bincount(word, wide >> np.uint64(32), words) + np.bincount(word + 1, wide & np.uint64(0xFFFFFFFF), words)
        return lanes.astype("<u2").tobytes() + bits.astype(">u4").tobytes()[: (int(ends[-1]) + 7) // 8 if len(ids) else 0]


def decode(block: bytes, n: int, code: Code, table: np.ndarray, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids `first` to `last` (exclusive; default all n) of a block, by the lanes that hold them. ValueError if it is damaged."""
    last = n if last is None else last
    if not 0 <= first <= last <= n:
        raise ValueError(f"the block has no ids {first} to {last}")
    if first == last:
        return np.zeros(0, np.uint32)
    lanes = -(-n // LANE)
    bits_at = np.concatenate([[0], np.cumsum(np.frombuffer(block, "<u2", lanes), dtype=np.int64)])
    raw = np.frombuffer(block[2 * lanes :] + bytes(4), np.uint8).astype(np.uint32)
    if bits_at[-1] > 8 * (len(raw) - 4):
        raise ValueError("the block is cut short")
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    low, high = first // LANE, -(-last // LANE)
    at, goal = bits_at[low:high].copy(), bits_at[low + 1 : high + 1]
    out = np.empty((LANE, high - low), np.uint32)
    rest = n - (high - 1) * LANE  # ids of the last lane, which may be short
    down = np.uint32(32 - code.limit)
    for k in range(LANE):
        if k == rest:
            at = at[:-1]
        entry = table[(window[np.minimum(at >> 3, len(window) - 1)] << (at & 7).astype(np.uint32)) >> down]
        out[k, : len(at)] = entry >> _LENGTH_BITS
        at += entry & ((1 << _LENGTH_BITS) - 1)
        if k == rest - 1 and at[-1] != goal[-1]:
            raise ValueError("the block is damaged")
    if (at != goal[: len(at)]).any():
        raise ValueError("the block is damaged")
    ids = code.symbols[np.minimum(out.T.ravel()[: last - low * LANE], len(code.symbols) - 1)]
    return ids[first - low * LANE :]
