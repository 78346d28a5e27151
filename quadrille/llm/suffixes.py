"""Suffix arrays of many short sequences at once, by refining buckets.

All documents of a chunk are sorted together; a document's last suffixes end in a mark that
sorts first, and every symbol carries its document, so suffixes of two documents never agree.
"""

from __future__ import annotations

import numpy as np


def dense(keys: np.ndarray) -> np.ndarray:
    """Equal keys get the same bucket: the place of their first in sorted order."""
    order = np.argsort(keys)
    ranked = keys[order]
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    place = np.maximum.accumulate(np.where(fresh, np.arange(len(keys)), 0))
    rank = np.empty(len(keys), dtype=np.int64)
    rank[order] = place
    return rank


def refine(rank: np.ndarray, later: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Splits the buckets of the active places by the bucket that ``later`` points to.

    Returns the new buckets and the places that still share one. Places that stand alone keep
    their pointer, so a round costs only what is still tied."""
    n = len(rank)
    keys = rank[active] * np.int64(n + 1) + (later[active] + 1)
    order = np.argsort(keys)
    places, keys = active[order], keys[order]
    old = rank[places]
    index = np.arange(len(places))
    bucket_first = np.ones(len(places), dtype=bool)
    bucket_first[1:] = old[1:] != old[:-1]
    group_first = np.ones(len(places), dtype=bool)
    group_first[1:] = keys[1:] != keys[:-1]
    bucket_start = np.maximum.accumulate(np.where(bucket_first, index, 0))
    group_start = np.maximum.accumulate(np.where(group_first, index, 0))
    fresh = rank.copy()
    fresh[places] = old + group_start - bucket_start
    alone = group_first.copy()
    alone[:-1] &= group_first[1:]
    return fresh, np.sort(places[~alone])


def pointed(rank: np.ndarray, ends: np.ndarray, step: int) -> np.ndarray:
    """The bucket ``step`` places on, -1 past the end of a place's own sequence."""
    n = len(rank)
    out = np.full(n, -1, dtype=np.int64)
    if step < n:
        out[: n - step] = rank[step:]
        out[np.arange(n) + step >= ends] = -1
    return out


def suffix_levels(keys: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Buckets by the first 1, 2, 4, ... symbols, up to the level at which all suffixes differ."""
    levels = [dense(keys)]
    counts = np.bincount(levels[0], minlength=len(keys)) if len(keys) else np.zeros(0, np.int64)
    active = np.flatnonzero(counts[levels[0]] > 1) if len(keys) else np.zeros(0, np.int64)
    step = 1
    while len(active):
        rank, active = refine(levels[-1], pointed(levels[-1], ends, step), active)
        levels.append(rank)
        step *= 2
    return levels


def longest_shared(keys: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each suffix, the depth of the deepest longest-common-prefix interval that holds it:
    the larger of the common prefixes with its two neighbours in the suffix array."""
    n = len(keys)
    if n < 2:
        return np.zeros(n, dtype=np.int64)
    levels = suffix_levels(keys, ends)
    order = np.empty(n, dtype=np.int64)
    order[levels[-1]] = np.arange(n)
    left, right = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        rank = levels[k]
        both = np.flatnonzero((left < n) & (right < n))
        a, b = left[both], right[both]
        # a bucket of level k is shared by suffixes that agree on 2**k symbols, or that end
        same = both[(rank[a] == rank[b]) & (a + (1 << k) <= ends[a]) & (b + (1 << k) <= ends[b])]
        common[same] += 1 << k
        left[same] += 1 << k
        right[same] += 1 << k
    best = np.zeros(n, dtype=np.int64)
    best[order[:-1]] = common
    best[order[1:]] = np.maximum(best[order[1:]], common)
    return best
