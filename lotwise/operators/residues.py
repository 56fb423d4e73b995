"""Whole numbers of any size as residues modulo several primes.

Sums and products of join counts need no more than sums and products of their
residues, which fit a BIGINT; the number itself is put together once, at the end,
by the Chinese remainder theorem. It is exact below the product of the primes.
"""

from __future__ import annotations

from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TOP = 1 << 31


def primes_above(bound: int) -> list[int]:
    """Primes below 2**31, from the largest, whose product exceeds ``bound``.

    Products of two residues stay below 2**62 and fit a BIGINT.
    """
    found: list[int] = []
    candidate = _TOP - 1
    while not found or prod(found) <= bound:
        if _is_prime(candidate):
            found.append(candidate)
        candidate -= 2
    return found


def _is_prime(n: int) -> bool:
    # 2, 3, 5 and 7 are witnesses enough below 3,215,031,751
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        power = pow(base, odd, n)
        if power not in (1, n - 1) and not any(pow(power, 2**k, n) == n - 1 for k in range(1, twos)):
            return False
    return True


def from_residues(residues: list[int], primes: list[int]) -> int:
    """The number below the product of ``primes`` with these residues."""
    whole = prod(primes)
    parts = (r * (whole // p) * pow(whole // p, -1, p) for r, p in zip(residues, primes))
    return sum(parts) % whole


def residue_columns(count: Column, primes: list[int]) -> list[Column]:
    """``count`` modulo each prime, as columns ``__r0``, ``__r1``, …"""
    return [(count % F.lit(p)).cast("bigint").alias(f"__r{i}") for i, p in enumerate(primes)]


def summed(rows: DataFrame, by: list[str], primes: list[int], times: str | None = None) -> DataFrame:
    """Residues of the sums of ``__r0``, … by key, each row counted ``times``.

    High and low 16 bits are summed apart, so no BIGINT overflows below 2**47 rows
    of a key, and sums are combined on the map side.
    """
    sums, whole = [], []
    for i, p in enumerate(primes):
        own = f"__r{i}" if times is None else f"(__r{i} * ({times} % {p}L)) % {p}L"
        sums += [F.expr(f"sum(({own}) div 65536L)").alias(f"__h{i}"), F.expr(f"sum(({own}) % 65536L)").alias(f"__l{i}")]
        whole.append(F.expr(f"(__h{i} % {p}L * 65536L + __l{i}) % {p}L").alias(f"__r{i}"))
    return rows.groupBy(*by).agg(*sums).select(*by, *whole)
