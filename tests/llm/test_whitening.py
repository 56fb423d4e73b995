"""Whitening against plain numpy and exact integers."""

import math
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lotwise.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, label int, whitened int, at string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "c") for i, v in rows], SCHEMA).repartition(4)


def expected(rows):
    """(x, eigenvalues, trace) of the usable rows."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    n, dim = len(x), len(x[0])
    sums = [sum(row[d] for row in x) for d in range(dim)]
    off = np.array([[n * row[d] - sums[d] for d in range(dim)] for row in x], object)
    v = np.array(off.T @ off, np.float64) / n**3
    return off, v


def check(found, rows, wanted=32):
    off, v = expected(rows)
    n = len(rows)
    values = np.linalg.eigvalsh(v)[::-1]
    k = min(wanted, int((values > values[0] * 1e-12).sum()))
    by_id = defaultdict(list)
    for r in found:
        by_id[r.vec_id].append(r)
    assert len(found) == n * k and {r.n for r in found} == {n} and len({r.identity_error for r in found}) == 1
    assert found[0].identity_error < 1e-8
    w, scaled = np.zeros((n, k)), (off / n).astype(np.float64)
    for i, (vec_id, _) in enumerate(rows):
        own = sorted(by_id[vec_id], key=lambda r: r.component)
        assert [r.component for r in own] == list(range(1, k + 1))
        assert {r.deviation for r in own} == {int((off[i] * off[i]).sum())}
        w[i] = [r.whitened for r in own]
        assert [r.explained for r in own] == pytest.approx((values[:k] / np.trace(v)).tolist(), rel=1e-9)
    axes = np.linalg.lstsq(scaled, w * np.sqrt(values[:k]), rcond=None)[0]
    assert np.allclose(scaled @ axes, w * np.sqrt(values[:k]), atol=1e-8 * np.sqrt(values[0]))
    assert np.allclose(w.T @ w / n, np.eye(k), atol=1e-8)
    for j in range(k):  # each axis is an eigenvector, wherever the data tell
        assert np.linalg.norm(v @ axes[:, j] - values[j] * axes[:, j]) < 1e-8 * values[0]


def test_whitening(spark):
    draw = np.random.default_rng(1)
    x = draw.standard_normal((400, 40)) @ draw.standard_normal((40, 40)) * np.logspace(0, -2, 40)
    rows = [(i, r.tolist()) for i, r in enumerate(x)]
    bad = [(None, None), (900, [float("nan")] * 40), (901, [1.0] * 39 + [None]), (902, [float("inf")] * 40), (903, []), (904, [1.0] * 39), (905, [1e300] * 40)]
    check(whitening.whiten(frame(spark, rows + bad)).collect(), rows)


def test_few_dimensions_and_large_entries(spark):
    draw = np.random.default_rng(2)
    x = draw.standard_normal((50, 3)) * [1e9, 1.0, 30.0] + [3e9, 0, 1]
    rows = [(i, r.tolist()) for i, r in enumerate(x / 1e3)]
    check(whitening.whiten(frame(spark, rows)).collect(), rows)


def test_without_variance(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [(1, [1.0, 2.0])] * 5)).count() == 0
    line = [(i, [float(i), float(2 * i), 3.0]) for i in range(20)]
    found = whitening.whiten(frame(spark, line)).collect()
    check(found, line)
    assert {r.component for r in found} == {1}


def test_repeated_rows_and_missing_ids(spark):
    draw = np.random.default_rng(3)
    rows = [(None if i % 9 == 0 else i % 5, r.tolist()) for i, r in enumerate(draw.standard_normal((60, 6)))]
    rows += rows[:20]
    found = whitening.whiten(frame(spark, rows)).collect()
    assert len(found) == 80 * 6 and found[0].n == 80 and found[0].identity_error < 1e-10


@pytest.mark.parametrize("dim, decay", [(1, 0), (2, 0), (33, 0), (64, 1), (64, 8), (90, 3)])
def test_components(dim, decay):
    draw = np.random.default_rng(dim)
    q, _ = np.linalg.qr(draw.standard_normal((dim, dim)))
    own = np.logspace(0, -decay, dim)
    v = (q * own) @ q.T
    v = (v + v.T) / 2
    values, axes = whitening.components(v, 32)
    k = min(32, dim)
    assert np.allclose(values, np.sort(np.linalg.eigvalsh(v))[::-1][:k], rtol=0, atol=1e-13 * dim)
    assert np.allclose(axes.T @ axes, np.eye(k), atol=1e-13 * dim)
    assert np.abs(v @ axes - axes * values).max() < 1e-13 * dim


def test_groups_of_equal_eigenvalues():
    draw = np.random.default_rng(7)
    q, _ = np.linalg.qr(draw.standard_normal((50, 50)))
    own = np.array([5.0] * 12 + [4.0, 4.0 - 1e-9] + [2.0] * 20 + [1.0] * 16)
    v = (q * own) @ q.T
    values, axes = whitening.components((v + v.T) / 2, 32)
    assert np.allclose(values, own[:32], atol=1e-12) and np.allclose(axes.T @ axes, np.eye(32), atol=1e-11)


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 12), st.integers(0, 1000))
def test_inertia(dim, seed):
    draw = np.random.default_rng(seed)
    a = draw.integers(-3, 4, (dim, dim)).astype(float)
    a = a + a.T
    values = np.linalg.eigvalsh(a)
    points = np.array([-7.3, -1.1, 0.123, 2.7, 9.9])
    assert (whitening.counts_above(whitening.tridiagonal(a), points) == (values[:, None] > points).sum(0)).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-(1 << 62), 1 << 62) | st.integers(-50, 50), min_size=2, max_size=2), min_size=1, max_size=20))
def test_exact_moments(rows):
    y = np.array(rows, np.int64).reshape(-1, 2)
    sums, products = whitening.exact_moments(y)
    assert sums.tolist() == [sum(int(r[d]) for r in rows) for d in range(2)]
    assert products.tolist() == [[sum(int(r[a]) * int(r[b]) for r in rows) for b in range(2)] for a in range(2)]
