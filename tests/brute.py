"""Independent plain-Python model of ranked draws, for small fixtures."""

from __future__ import annotations

import hashlib


def _digest(parts) -> str:
    text = "|".join(str(p) for p in parts if p is not None)
    return hashlib.md5(text.encode()).hexdigest()


def row_order(row):
    nulls_first = tuple((v is not None, v) for v in row)
    text = "|".join("-" if v is None else f"{len(str(v))}:{v}" for v in row)
    return hashlib.md5(text.encode()).hexdigest(), nulls_first


def rank(seed, total, *ids):
    digest = _digest([seed, *ids])
    return ((int(digest[:15], 16) << 60) + int(digest[15:30], 16)) % total


def chain_results(tables, edges):
    """All join results in rank order; ``edges`` are column positions.

    Copies of a row follow each other, each with its partners.
    """
    results = []
    for copy, row in enumerate(tables[0]):
        key = row[edges[0][0]]
        if key is not None:
            order = (row_order((key,)), row_order(row), copy)
            results.append((order, (row,)))
    for (src, dst), table in zip(edges, tables[1:]):
        partners = {}
        for copy, row in enumerate(table):
            partners.setdefault(row[dst], []).append((copy, row))
        results = [
            ((*order, row_order(row), copy), (*rows, row))
            for order, rows in results
            if rows[-1][src] is not None
            for copy, row in partners.get(rows[-1][src], [])
        ]
    return [rows for _, rows in sorted(results, key=lambda r: r[0])]


def chain_sample(tables, edges, n, seed):
    results = chain_results(tables, edges)
    return [
        (i, *(v for row in results[rank(seed, len(results), i)] for v in row))
        for i in range(n)
    ]


def pick(rows, weights, position):
    """The row owning a position; ``rows`` with positive weights only."""
    for row, weight in sorted(zip(rows, weights), key=lambda p: row_order(p[0])):
        if position < weight:
            return row
        position -= weight
    raise AssertionError("position outside the rows")
