"""Word shingles as numbers.

A text is lower-cased (A-Z) and cut at ASCII white space. Each word is hashed to 64 bits with a
seed, and the numbers of five words in a row are mixed one after another, none of the steps being
linear. Equal shingles have equal numbers; two different ones have the same with a chance of about
2**-64, so over all pairs of 10,000 shingles about 3e-12.
"""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
#: Seed of the words' hash. Sets are the same for any seed; another one may be set where texts could be made to collide.
SEED = 20240


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over all bits, one to one."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """The distinct shingles of a text as sorted unsigned numbers; fewer than n words are one shingle, none give none."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashed, seed = xxhash.xxh3_64_intdigest, SEED
    numbers = np.array([hashed(w, seed) for w in words], np.uint64)
    width = min(n, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)  # a short text is no prefix of a longer shingle
    for k in range(width):
        out = mix(out ^ numbers[k : k + len(out)]) + np.uint64(0x9E3779B97F4A7C15)
    return np.unique(out)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, of sorted distinct arrays."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    common = shared(a, b)
    return 100 * common >= percent * (len(a) + len(b) - common)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def shared_matrix(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, columns: int = 4096) -> np.ndarray:
    """Intersection sizes of sets at places `left` with those at `right`, by products of 0/1 matrices of bounded width."""
    out = np.zeros((len(left), len(right)), np.int64)
    sizes = [len(s) for s in sets]
    if not out.size or not sum(sizes):
        return out
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    dense = np.cumsum(counts > 1) - 1  # only what two sets have
    rows = np.repeat(np.arange(len(sets)), sizes)
    of = counts[inverse] > 1
    rows, columns_of = rows[of], dense[inverse[of]]
    order = np.argsort(columns_of, kind="stable")
    rows, columns_of = rows[order], columns_of[order]
    total = int(dense[-1]) + 1
    for at in range(0, total, columns):
        a, b = np.searchsorted(columns_of, [at, at + columns])
        part = np.zeros((len(sets), min(columns, total - at)), np.float32)
        part[rows[a:b], columns_of[a:b] - at] = 1
        out += (part[left] @ part[right].T).astype(np.int64)
    return out
