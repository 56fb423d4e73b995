"""Golden numbers of the two-table fixture."""

from collections import Counter

import pytest
from fixtures import fixture_chain

from lotwise import ChainJoin, TableSpec
from lotwise.operators import at_site, merge_memos, tag_site
from pyspark.sql import functions as F

N = 3000


@pytest.fixture(scope="module")
def chain(spark):
    return fixture_chain(spark)


def as_dict(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_memos(chain):
    assert as_dict(chain.memo(1), "key", "count") == {"A": 30, "B": 13, "C": 12}
    by_site = {
        (r["site"], r["key"]): r["count"] for r in chain.memo(0, by_site=True).collect()
    }
    assert by_site == {
        ("s0", "A"): 120, ("s0", "B"): 52, ("s0", "C"): 48,
        ("s1", "A"): 13200, ("s1", "B"): 286, ("s1", "C"): 1116,
        ("s2", "A"): 210, ("s2", "B"): 78, ("s2", "C"): 60,
    }


def test_site_memos_are_the_tagged_memos_of_the_sites(spark, chain):
    def at(site):
        tables = [TableSpec(t.name, at_site(t.df, site)) for t in chain.tables]
        return tag_site(ChainJoin(tables, chain.edges).memo(1), site)

    tagged = at("s0").unionByName(at("s1")).unionByName(at("s2"))
    by_site = chain.memo(1, by_site=True)
    assert sorted(by_site.select(tagged.columns).collect()) == sorted(tagged.collect())
    merged = {r["key"]: r["count"] for r in merge_memos(tagged).collect()}
    assert merged == {"A": 30, "B": 13, "C": 12}


def test_cardinality(chain):
    assert chain.cardinality().first()[0] == 15170
    assert as_dict(chain.cardinality(by_site=True), "site", "cardinality") == {
        "s0": 220, "s1": 14602, "s2": 348,
    }
    assert as_dict(chain.cardinality(by_key=True), "key", "cardinality") == {
        "A": 13530, "B": 416, "C": 1224,
    }
    assert chain.full_join().count() == 15170


def test_dangling_rows(chain):
    rows = chain.tables[0].df.count()
    assert rows == 691 and rows - chain.weights(0).count() == 106


def test_rounded_allocation_starves_small_sites(chain):
    counts = as_dict(chain.allocate(20, "proportional"), "site", "count")
    assert counts == {"s0": 0, "s1": 19, "s2": 0}


def test_drawn_allocation_is_complete(chain):
    counts = as_dict(chain.allocate(N, "drawn", seed=5), "site", "count")
    assert sum(counts.values()) == N and set(counts) == {"s0", "s1", "s2"}


def test_allocation_per_site_and_key_adds_up(chain):
    per_key = as_dict(chain.key_counts(0, N, 5), "key", "count")
    spread = Counter()
    for r in chain.allocate_keys(1, N, 5).collect():
        spread[r["key"]] += r["count"]
    assert spread == per_key


def test_memo_allocation_follows_the_totals(chain):
    weights = as_dict(chain.cardinality(by_site=True), "site", "cardinality")
    counts = as_dict(chain.allocate(5000, "memo", seed=5), "site", "count")
    expected = {s: 5000 * w / sum(weights.values()) for s, w in weights.items()}
    assert sum(counts.values()) == 5000
    assert sum((counts.get(s, 0) - e) ** 2 / e for s, e in expected.items()) < 13.8  # 2 degrees of freedom, p = 0.001


def test_memo_allocation_per_site_and_key_adds_up(chain):
    per_key, spread = as_dict(chain.key_counts(0, N, 5), "key", "count"), Counter()
    shares = {(r["site"], r["key"]) for r in chain.memo(1, by_site=True).collect()}
    for r in chain.allocate_keys(1, N, 5, "memo").collect():
        assert (r["site"], r["key"]) in shares
        spread[r["key"]] += r["count"]
    assert spread == per_key
    assert sum(r["count"] for r in chain.allocate_keys(0, N, 5, "memo").collect()) == N


def test_one_site_only(spark, chain):
    tables = [TableSpec(t.name, t.df.where("site = 's0'")) for t in chain.tables]
    assert ChainJoin(tables, chain.edges).cardinality().first()[0] == 88


def test_draws_follow_the_join(chain):
    """Chi-square of drawn keys and of drawn join results."""
    sample = chain.sample(N, seed=11)
    keys = as_dict(sample.groupBy("tbl0_key").count(), "tbl0_key", "count")
    expected = {"A": 13530, "B": 416, "C": 1224}
    assert set(keys) == set(expected)  # D has no partner
    chi = sum(
        (keys[k] - N * w / 15170) ** 2 / (N * w / 15170) for k, w in expected.items()
    )
    assert chi < 13.8  # 2 degrees of freedom, p = 0.001
    population = chain.full_join().groupBy("tbl0_value", "tbl1_value", "tbl0_key").count()
    drawn = sample.groupBy("tbl0_value", "tbl1_value", "tbl0_key").agg(
        F.count(F.lit(1)).alias("drawn")
    )
    both = population.join(
        drawn, ["tbl0_value", "tbl1_value", "tbl0_key"], "left"
    ).fillna(0)
    mean = F.col("count") * N / 15170
    stat, cells = both.agg(
        F.sum((F.col("drawn") - mean) ** 2 / mean), F.count(F.lit(1))
    ).first()
    assert abs(stat - (cells - 1)) < 4 * (2 * (cells - 1)) ** 0.5
