"""Interval lists as a mergeable aggregate.

An interval list is a pair of int64 arrays ``(starts, ends)``, sorted and disjoint, with holes wider than ``slack``.
``collapse`` makes such lists for many entities at once, ``merge`` joins two lists by one linear pass, and
``complement`` gives the holes. Merging is associative and commutative and a repeated row changes nothing, so partial
lists may be combined in any tree.
"""

from __future__ import annotations

import numpy as np

_LOW = np.iinfo(np.int64).min


def running_end(codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The largest end so far within each run of equal codes; codes must not decrease."""
    if not len(ends):
        return ends
    low = int(ends.min())
    width = int(ends.max()) - low + 1
    steps = np.concatenate(([0], np.cumsum(codes[1:] != codes[:-1])))
    if int(steps[-1] + 1) * width < 2**62:
        return np.maximum.accumulate(ends - low + steps * width) - steps * width + low
    out = np.empty_like(ends)
    for a, b in zip(*_bounds(steps)):
        out[a:b] = np.maximum.accumulate(ends[a:b])
    return out


def _bounds(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cut = np.flatnonzero(codes[1:] != codes[:-1]) + 1
    return np.concatenate(([0], cut)), np.concatenate((cut, [len(codes)]))


def collapse(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, slack: int):
    """Union per code of intervals sorted by (code, start): ``(codes, starts, ends)`` of the disjoint lists."""
    if not len(starts):
        return codes, starts, ends
    reach = running_end(codes, ends)
    fresh = np.ones(len(starts), bool)
    fresh[1:] = (codes[1:] != codes[:-1]) | (starts[1:] > reach[:-1] + slack)
    first = np.flatnonzero(fresh)
    last = np.concatenate((first[1:], [len(starts)])) - 1
    return codes[first], starts[first], reach[last]


def merge(a, b, slack: int):
    """The list of two lists of one entity, by one linear pass over both."""
    starts, ends = [], []
    i = j = 0
    while i < len(a[0]) or j < len(b[0]):
        if j == len(b[0]) or (i < len(a[0]) and a[0][i] <= b[0][j]):
            s, e, i = int(a[0][i]), int(a[1][i]), i + 1
        else:
            s, e, j = int(b[0][j]), int(b[1][j]), j + 1
        if starts and s <= ends[-1] + slack:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(s)
            ends.append(e)
    return np.array(starts, np.int64), np.array(ends, np.int64)


def complement(lst, low: int | None, high: int | None, slack: int) -> list[tuple[int, int]]:
    """Holes wider than ``slack`` before, between and after the intervals of a list; none for an empty list."""
    starts, ends = lst
    if not len(starts):
        return []
    edges = ([] if low is None else [(low, int(starts[0]))]) + list(zip(map(int, ends[:-1]), map(int, starts[1:])))
    edges += [] if high is None else [(int(ends[-1]), high)]
    return [(a, b) for a, b in edges if b - a > slack]
