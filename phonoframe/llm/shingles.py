"""Word shingles as sets of 64-bit hashes, computed over the bytes of many documents at once."""

from __future__ import annotations

import numpy as np

from phonoframe.llm.common import kept, mixed

#: Bytes of white space between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256)
LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64)[LOWER] * np.uint64(2) + np.uint64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return kept(f"powers {n}", lambda: (np.cumprod(np.full(n, _BASE)), np.cumprod(np.full(n, _INVERSE))))


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash per word (A-Z lower-cased) and the first word of each document (n + 1 numbers)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    gap = SPACE[raw]
    first = np.empty(n, bool)
    first[0], first[1:] = True, gap[:-1]
    first[at[:-1][at[:-1] < n]] = True
    last = np.empty(n, bool)
    last[-1], last[:-1] = True, gap[1:]
    last[at[1:][at[1:] > 0] - 1] = True
    start, end = np.flatnonzero(first & ~gap), np.flatnonzero(last & ~gap) + 1
    power, inverse = _powers(max(1 << 21, 1 << (n - 1).bit_length()))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * power[:n], out=total[1:])
    return mixed((total[end] - total[start]) * inverse[start] + (end - start).astype(np.uint64)), np.searchsorted(start, at)


def shingle_sets(raw: np.ndarray, at: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """The sorted different shingle hashes of each document. With fewer words than `size`, the whole sequence; without words, none."""
    words, first = word_hashes(raw, at)
    n = len(words)
    weight = [np.uint64(x) for x in np.random.default_rng(size).integers(0, 1 << 63, size) * 2 + 1]
    rolled = np.zeros(max(n - size + 1, 0), np.uint64)
    for j in range(size):
        rolled += words[j : n - size + 1 + j] * weight[j] if n >= size else np.uint64(0)
    rolled = mixed(rolled)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for i in range(a, b):
                whole = mixed(whole * weight[0] + words[i : i + 1])
            out.append(whole)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_digest(tokens: np.ndarray) -> tuple[int, int]:
    """Two independent signed 64-bit numbers for a set."""
    if not len(tokens):
        return 0, 0
    sums = [mixed(tokens ^ np.uint64(k)).sum(dtype=np.uint64) ^ np.uint64(len(tokens)) for k in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
    return tuple(mixed(np.array(sums)).view(np.int64).tolist())
