"""Sampling of tree joins and by approximate weights, against brute force."""

import hashlib
import random
from collections import Counter

import pytest
from brute import rank

from lotwise import TableSpec, TreeJoin
from lotwise.operators import sample_by_sketch


def skewed(seed=4):
    rng = random.Random(seed)

    def key(hot):
        draw = rng.random()
        return hot if draw < 0.35 else None if draw < 0.42 else rng.randrange(8)

    root = [(i % 25, key(1), key(2)) for i in range(40)]
    left = [(key(1), key(3), i) for i in range(30)] + [(1, 3, 99)] * 12
    leaf = [(key(3), i) for i in range(20)]
    right = [(key(2), i % 6) for i in range(35)]
    return root, left, leaf, right


EDGES = [(0, "a", 1, "b_a"), (1, "c", 2, "l_c"), (0, "d", 3, "r_d")]
SCHEMAS = ["id int, a int, d int", "b_a long, c int, n int", "l_c int, v int", "r_d int, w int"]


def tree(spark, tables, **options):
    specs = [TableSpec(n, spark.createDataFrame(t, s)) for n, t, s in zip(("root", "left", "leaf", "right"), tables, SCHEMAS)]
    return TreeJoin(specs, EDGES, **options)


def by_hash(rows):
    def text(v):
        return "-" if v is None else f"{len(str(v))}:{v}"

    return sorted(rows, key=lambda r: hashlib.md5("|".join(map(text, r)).encode()).hexdigest())


def results(tables):
    """All rows of the join in the order that draws count: in pre-order, by row hash."""
    root, left, leaf, right = map(by_hash, tables)
    return [
        (*r, *x, *y, *z)
        for r in root
        for x in left if x[0] == r[1] and r[1] is not None
        for y in leaf if y[0] == x[1] and x[1] is not None
        for z in right if z[0] == r[2] and r[2] is not None
    ]


@pytest.mark.parametrize("options", [{}, {"wide": True}, {"split_rows": 5, "slice_digits": 1}])
def test_tree_sample(spark, options):
    tables, n, seed = skewed(), 300, 8
    every = results(tables)
    expected = Counter((i, *every[rank(seed, len(every), i)]) for i in range(n))
    joined = tree(spark, tables, **options)
    assert joined.cardinality().first()[0] == len(every) > 3000
    assert Counter(map(tuple, joined.sample(n, seed).collect())) == expected
    joined.release()


def test_tree_without_results(spark):
    tables = skewed()
    joined = tree(spark, [*tables[:3], [(77, 1)]])
    found = joined.sample(10, 1)
    assert found.count() == 0 and found.columns[:4] == ["draw_id", "id", "a", "d"]
    assert tree(spark, tables).sample(0, 1).count() == 0
    with pytest.raises(ValueError):
        tree(spark, tables).sample(-1, 1)


def two(spark, left, right):
    return (
        TableSpec("l", spark.createDataFrame(left, "i int, k int"), ["i"]), "k",
        TableSpec("r", spark.createDataFrame(right, "k long, j int")), "k",
    )


@pytest.mark.parametrize("width", [1, 3, 1 << 16])
def test_sketch_sample_is_uniform(spark, width):
    """Whatever the sketch overrates, all join rows are equally likely."""
    rng = random.Random(2)
    left = [(i, 1 if i % 3 == 0 else rng.randrange(9) if i % 7 else None) for i in range(24)]
    right = [(rng.choice([1, 1, 1, 2, 3, 5, 50, None]), j) for j in range(30)]
    every = Counter((i, k, m, j) for i, k in left for m, j in right if k is not None and k == m)
    n = 40 * len(every)
    found = sample_by_sketch(*two(spark, left, right), n, 3, depth=2, width=width).collect()
    assert sorted(r[0] for r in found) == list(range(n))
    counts = Counter(tuple(r)[1:] for r in found)
    assert set(counts) <= set(every)
    chi = sum((counts[r] - 40) ** 2 / 40 for r in every)
    free = len(every) - 1
    assert abs(chi - free) < 5 * (2 * free) ** 0.5


def test_sketch_sample_of_nothing(spark):
    """All left keys fall on cells of other keys, so every draw would be rejected."""
    found = sample_by_sketch(*two(spark, [(1, 1), (2, 2)], [(5, 1), (6, 2)]), 10, 1, depth=1, width=1)
    assert found.columns == ["draw_id", "i", "l_k", "r_k", "j"] and found.count() == 0
    assert sample_by_sketch(*two(spark, [], [(5, 1)]), 10, 1).count() == 0
    assert sample_by_sketch(*two(spark, [(5, 5)], [(5, 1)]), 0, 1).count() == 0
