"""Bitmaps of sets: a bound on how much two sets differ, before their elements are fetched."""

from __future__ import annotations

import numpy as np

#: Bits of a set's bitmap.
BITS = 1_024
#: Sets that bitmaps are looked at together, for each set that texts are compared together.
WIDE = 4


def bitmap(found: np.ndarray) -> bytes:
    """The parities of a set's hashes in each of BITS classes: two sets differ in at least as many elements as bits."""
    odd = np.bincount((found >> np.uint64(40)).astype(np.int64) % BITS, minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def candidate_groups(size: np.ndarray, bits: np.ndarray, component: np.ndarray, percent: int) -> list[np.ndarray]:
    """Members that may be similar to one of another component, by sizes and bitmaps, in groups that such pairs connect."""
    n, order = len(size), np.argsort(size, kind="stable")
    group, met = np.arange(n), np.zeros(n, bool)
    size, bits, component = size[order], bits[order], component[order]
    # In order of sizes, those near enough from below stand side by side.
    least = np.searchsorted(100 * size, percent * size)
    for i, low in enumerate(least.tolist()):
        near = low + np.flatnonzero(component[low:i] != component[i])
        if len(near):
            apart = np.bitwise_count(bits[near] ^ bits[i]).sum(1, dtype=np.int64)
            near = near[(100 + percent) * apart <= (100 - percent) * (size[near] + size[i])]
        if len(near):
            met[near] = met[i] = True
            for g in np.unique(group[near]).tolist():
                group[group == g] = group[i]
    return [np.sort(order[met & (group == g)]) for g in np.unique(group[met]).tolist()]


def in_blocks(group: np.ndarray, most: int) -> list[np.ndarray]:
    """``group`` as it is, or every pair of blocks of it where it has more than ``most`` members."""
    if len(group) <= most:
        return [group]
    blocks = np.array_split(group, -(-len(group) // max(1, most // 2)))
    return [np.concatenate([a, b]) for k, a in enumerate(blocks) for b in blocks[k + 1 :]]
