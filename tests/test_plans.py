"""The physical plans are the intended ones."""

import contextlib
import re

import pytest

from lotwise import ChainJoin, TableSpec
from lotwise.staging import Staging
from pyspark.sql import functions as F

NO_BROADCAST = {
    "spark.sql.autoBroadcastJoinThreshold": -1,
    "spark.sql.adaptive.autoBroadcastJoinThreshold": -1,
}


@contextlib.contextmanager
def settings(spark, conf):
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name in conf:
            spark.conf.unset(name)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def chain(spark, tmp_path_factory):
    """Parquet tables with columns the join does not need."""
    root = tmp_path_factory.mktemp("tables")
    specs = []
    for name, x, y in (("a", 1, 10), ("b", 10, 7), ("c", 7, 1)):
        path = f"{root}/{name}"
        spark.range(2000).select(
            F.col("id").alias(f"{name}_id"),
            (F.col("id") % x).alias(f"{name}_x"),
            (F.col("id") % y).alias(f"{name}_y"),
            F.repeat(F.lit("-"), 20).alias(f"{name}_text"),
        ).write.parquet(path)
        specs.append(TableSpec(name, spark.read.parquet(path), [f"{name}_id"]))
    return ChainJoin(specs, [("a_y", "b_x"), ("b_y", "c_x")])


def test_cardinality_reads_join_columns_only(chain):
    plan = plan_of(chain.cardinality())
    read = sorted(re.findall(r"ReadSchema: struct<([^>]*)>", plan))
    assert read == ["a_y:bigint", "b_x:bigint,b_y:bigint", "c_x:bigint"]
    assert "IsNotNull" in plan


def test_key_counts_are_combined_before_the_shuffle(spark, chain):
    with settings(spark, NO_BROADCAST):
        plan = plan_of(chain.cardinality())
    assert plan.count("partial_count") == 2 and "partial_sum" in plan


@pytest.mark.parametrize("conf", [{}, NO_BROADCAST])
def test_no_cross_or_nested_loop_join(spark, chain, conf, monkeypatch):
    plans = []
    write = Staging.table

    def spy(self, df, name):
        plans.append(plan_of(df))
        return write(self, df, name)

    monkeypatch.setattr(Staging, "table", spy)
    with settings(spark, conf):
        moved = ChainJoin(chain.tables, chain.edges, split_rows=100)
        sample = moved.sample(300, 1)
        assert sample.count() == 300
        plans += [plan_of(sample), plan_of(moved.cardinality(by_key=True))]
    assert len(plans) > 8
    for plan in plans:
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_windows_hold_bounded_groups(spark, monkeypatch):
    """One key holds most rows: no window may see the key as a whole."""
    df = spark.range(5000).select("id", F.when(F.col("id") % 10 > 0, 1).otherwise(F.col("id")).alias("k"))
    specs = [TableSpec("l", df), TableSpec("r", df)]
    chain = ChainJoin(specs, [("k", "k")], split_rows=100)
    largest = []
    import lotwise.operators.lookup as lookup

    original = lookup.with_intervals

    def spy(rows, by, order, span):
        sizes = rows.groupBy(*by).count().agg(F.max("count"))
        largest.append(sizes.first()[0] or 0)
        return original(rows, by, order, span)

    monkeypatch.setattr(lookup, "with_intervals", spy)
    sample = chain.sample(200, 1)
    assert sample.count() == 200
    slices = 16**chain.slice_digits
    assert chain.cardinality().first()[0] > 4500**2
    assert max(largest) <= min(4501, slices) and min(largest) <= 100
    assert len(largest) >= 4


def test_hot_join_key_is_split_by_adaptive_execution(spark):
    """A middle table with a third of its rows under one outgoing key."""
    hot = F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id"))
    rows = spark.range(0, 300_000, 1, 8)
    first = rows.select((F.col("id") % 1000).alias("a"))
    middle = rows.select(F.col("id").alias("b"), hot.alias("c"))
    last = rows.select((F.col("id") % 50_000).alias("d"))
    chain = ChainJoin(
        [TableSpec("x", first), TableSpec("y", middle), TableSpec("z", last)],
        [("a", "b"), ("c", "d")],
    )
    conf = NO_BROADCAST | {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": 20_000,
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": 20_000,
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    }
    with settings(spark, conf):
        memo = chain.memo(1)
        total = sum(r["count"] for r in memo.collect())
        plan = plan_of(memo)
    assert "skew=true" in plan
    expected = 100_000 * 6 + sum(6 for i in range(50_000) if i % 3)
    assert total == expected


def test_hot_group_of_a_lookup_is_split(spark, monkeypatch):
    """A drawn group with a third of a table, larger than ``split_rows``."""
    hot = F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id"))
    left = spark.range(0, 3000).select((F.col("id") % 50_000).alias("a"))
    right = spark.range(0, 300_000, 1, 8).select(F.col("id").alias("b"), hot.alias("c"))
    chain = ChainJoin([TableSpec("x", left), TableSpec("y", right)], [("a", "c")], split_rows=1000)
    conf = NO_BROADCAST | {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": 20_000,
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": 20_000,
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
    }
    plans = {}
    write = Staging.table

    def spy(self, df, name):
        out = write(self, df, name)
        if name.startswith("slices"):
            df.write.format("noop").mode("overwrite").save()
            df.collect()
            plans[name] = plan_of(df)
        return out

    monkeypatch.setattr(Staging, "table", spy)
    with settings(spark, conf):
        chain.sample_table(1, 2000, 1)
    assert "skew=true" in plans["slices1"]
    assert "partial_count" in plans["slices1"] or "partial_sum" in plans["slices1"]


def wide_chain(spark, order, n=6000):
    """A wide payload, and order columns that many rows may share."""
    rows = spark.range(n).selectExpr(
        "id % 40 AS k", "id % 7 AS o", "id", "repeat(CAST(id AS STRING), 50) AS payload", "array(id, id % 3) AS other", "id % 5 AS out"
    )
    right = spark.range(60).selectExpr("id % 5 AS k2", "CAST(id AS STRING) AS text")
    specs = [TableSpec("l", rows, order), TableSpec("r", right)]
    return lambda **options: ChainJoin(specs, [("out", "k2")], **options)


@pytest.mark.parametrize("options", [{}, {"split_rows": 50, "slice_digits": 1}])
def test_payload_is_fetched_late(spark, monkeypatch, options):
    """Windows and grids do not see the columns that only the result needs."""
    import lotwise.operators.lookup as lookup

    build, seen = wide_chain(spark, ["id"]), []
    original = lookup.locate

    def spy(points, intervals, by):
        seen.append((set(points.columns), set(intervals.columns)))
        return original(points, intervals, by)

    monkeypatch.setattr(lookup, "locate", spy)
    build(**options).draws(300, 1, 1)
    assert len(seen) >= 2
    assert all(not {"payload", "other"} & (a | b) for a, b in seen)


@pytest.mark.parametrize("options", [{}, {"split_rows": 50, "slice_digits": 1}])
def test_late_fetch_changes_no_row(spark, monkeypatch, options):
    import lotwise.operators.lookup as lookup

    build = wide_chain(spark, ["k", "o"])
    late = sorted(map(str, build(**options).sample(300, 1).collect()))
    original = lookup.RowLookup._narrow
    monkeypatch.setattr(lookup.RowLookup, "_narrow", lambda self, late: original(self, False))
    assert sorted(map(str, build().sample(300, 1).collect())) == late and len(late) == 300
