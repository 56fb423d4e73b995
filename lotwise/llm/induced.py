"""Induced suffix sorting of strings around sampled positions, with common prefixes.

A shard holds strings in groups; every string has a sampled position. Suffixes
from the sampled positions are sorted once, with the common prefix of neighbours.
Going back one byte in all strings at once, a suffix is the tuple (group, byte,
rank of the suffix after it): a stable sort by byte induces the new order from the
old one, and the common prefix of new neighbours is one more than the least
between their old places. Strings whose start is passed drop out.
"""

from __future__ import annotations

import numpy as np


def _range_minima(values: np.ndarray) -> list[np.ndarray]:
    """Minima of all runs of 1, 2, 4, … entries."""
    levels = [values]
    while 2 << (len(levels) - 1) <= len(values):
        step = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-step], levels[-1][step:]))
    return levels


def _least(levels: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least entry of each [first, last], not empty."""
    level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
    out = np.empty(len(first), np.int64)
    for k in np.unique(level):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(levels[k][first[at]], levels[k][last[at] - (1 << int(k)) + 1])
    return out


def _sorted_samples(data, starts, ends, group):
    """Order of the suffixes data[starts:ends] by group and bytes, and common prefixes.

    The prefix of an entry is that with the entry before it, -1 in another group.
    """
    size = ends - starts
    width = -(-int(size.max()) // 8) * 8
    column = np.arange(width)
    inside = column < size[:, None]
    grid = np.where(inside, data[np.minimum(starts[:, None] + column, len(data) - 1)], 0).astype(np.uint8)
    words = grid.view(">u8").astype(np.uint64)
    order = np.lexsort((size, *words.T[::-1], group))
    grid, size, group = grid[order], size[order], group[order]
    differ = grid[1:] != grid[:-1]
    prefix = np.where(differ.any(1), differ.argmax(1), width)
    prefix = np.minimum(prefix, np.minimum(size[1:], size[:-1]))
    prefix[group[1:] != group[:-1]] = -1
    return order, np.concatenate([[-1], prefix])


def repeated_runs(data, bounds, offset, windows, group, wanted, length):
    """Windows of strings that equal one of another string of the group.

    String i is data[bounds[i]:bounds[i + 1]] with its sampled position at
    ``offset``; its windows of ``length`` bytes start at 0 … windows - 1, all at or
    before the sampled position, and equal windows lie alike to it. Returns runs
    (string, first window, number) for ``wanted`` strings.
    """
    _, group = np.unique(group, return_inverse=True)
    starts = bounds[:-1]
    order, prefix = _sorted_samples(data, starts + offset, bounds[1:], group)
    found = np.zeros((len(starts), int(windows.max()) + 1), bool)
    back = 0
    while True:
        at = offset[order] - back  # window start of each suffix in order
        near = np.maximum(prefix, np.append(prefix[1:], -1)) >= length
        hit = near & (at < windows[order])
        found[order[hit], at[hit]] = True
        stay = np.flatnonzero(at > 0)
        if not len(stay):
            break
        back += 1
        byte = data[starts[order[stay]] + at[stay] - 1]
        own = group[order[stay]]
        # (group, byte) with ties in the old order
        stay = stay[np.argsort(own.astype(np.int64) << 8 | byte, kind="stable")]
        byte = data[starts[order[stay]] + at[stay] - 1]
        own = group[order[stay]]
        same = (own[1:] == own[:-1]) & (byte[1:] == byte[:-1])
        levels, pairs = _range_minima(prefix), np.flatnonzero(same)
        prefix = np.full(len(stay), -1, np.int64)
        prefix[1:][own[1:] == own[:-1]] = 0
        prefix[pairs + 1] = 1 + _least(levels, stay[pairs] + 1, stay[pairs + 1])
        order = order[stay]
    found &= wanted[:, None]
    edges = np.diff(found.astype(np.int8), axis=1, prepend=0)
    row, first = np.nonzero(edges == 1)
    _, last = np.nonzero(edges == -1)
    return row, first, last - first
