"""Cardinalities beyond 38 digits."""

import random

import pytest

from lotwise.operators.residues import from_residues, primes_above
from lotwise.plans import ChainJoin, TableSpec


def test_numbers_come_back_from_their_residues():
    rng = random.Random(3)
    for digits in (1, 9, 38, 39, 120):
        primes = primes_above(10**digits)
        assert len(set(primes)) == len(primes)
        for n in (0, 1, 10**digits, rng.randrange(10**digits)):
            assert from_residues([n % p for p in primes], primes) == n


def brute(keys):
    """Results of a chain of self-describing tables: rows are (incoming, outgoing)."""
    counts = None
    for rows in reversed(keys):
        held = {}
        for incoming, outgoing in rows:
            weight = 1 if counts is None else counts.get(outgoing, 0)
            held[incoming] = held.get(incoming, 0) + weight
        held.pop(None, None)
        counts = held
    return sum(counts.values())


def chain(spark, keys):
    tables = [
        TableSpec(f"t{i}", spark.createDataFrame(rows, "a int, b int")) for i, rows in enumerate(keys)
    ]
    return ChainJoin(tables, [("b", "a")] * (len(keys) - 1))


def test_chain_of_eight_tables_beyond_38_digits(spark):
    rng = random.Random(5)
    hot = 90_000  # one key holds most rows of every table
    keys = [[(0 if k % 10 else rng.randrange(5), 0 if k % 9 else rng.randrange(5)) for k in range(hot)] for _ in range(8)]
    keys[3][:2] = [(None, 0), (0, None)]
    expected = brute([[(0, b) for _, b in keys[0]], *keys[1:]])
    assert expected > 10**38
    assert chain(spark, keys).cardinality_exact() == expected


@pytest.mark.parametrize("tables", [2, 3])
def test_small_chains_and_empty_ones(spark, tables):
    rng = random.Random(tables)
    keys = [[(rng.choice([None, 1, 2, 3]), rng.choice([None, 1, 2, 3])) for _ in range(40)] for _ in range(tables)]
    expected = brute([[(0, b) for _, b in keys[0]], *keys[1:]])
    joined = chain(spark, keys)
    assert joined.cardinality_exact() == expected == joined.cardinality().first()[0]
    apart = [[(7, 7)] * 3, *[[(8, 8)] * 3] * (tables - 1)]
    assert chain(spark, apart).cardinality_exact() == 0
    none = chain(spark, keys)
    none.tables[0] = TableSpec("t0", none.tables[0].df.limit(0))
    assert none.cardinality_exact() == 0
