"""Skew, copies, nulls, empty inputs and large numbers against brute force."""

import random

import pytest
from brute import chain_results, chain_sample, pick, rank

from lotwise import ChainJoin, TableSpec, TreeJoin, repeat_rows
from lotwise import sample_per_key, weighted_sample
from pyspark.sql import functions as F

N, SEED = 400, 9


def skewed_tables(seed=3):
    """Three tables; a third of the middle one is copies of one row, a third of
    each join column is one key; some keys are null or without a partner."""
    rng = random.Random(seed)

    def key(hot):
        draw = rng.random()
        return hot if draw < 0.35 else None if draw < 0.4 else rng.randrange(12)

    a = [(i, key(1)) for i in range(60)]
    b = [(key(1), key(2), i) for i in range(100)] + [(1, 2, 1000)] * 60
    c = [(key(2), i % 20) for i in range(90)]
    return [a, b, c]


EDGES = [(1, 0), (1, 0)]


def skewed_chain(spark, tables, **options):
    schemas = ["a_id long, a_x int", "b_x long, b_y int, b_id int", "c_y int, c_v int"]
    specs = [
        TableSpec(name, spark.createDataFrame(rows, schema))
        for name, rows, schema in zip("abc", tables, schemas)
    ]
    return ChainJoin(specs, [("a_x", "b_x"), ("b_y", "c_y")], **options)


@pytest.fixture(scope="module")
def expected():
    tables = skewed_tables()
    return tables, sorted(chain_sample(tables, EDGES, N, SEED))


def collected(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("split_rows, digits", [(1 << 17, 4), (50, 1), (4, 4), (1, 2)])
def test_sample_equals_brute_force(spark, expected, split_rows, digits):
    tables, rows = expected
    chain = skewed_chain(spark, tables, split_rows=split_rows, slice_digits=digits)
    assert collected(chain.sample(N, SEED)) == rows
    chain.release()


def test_wide_sample_equals_brute_force(spark, expected):
    tables, rows = expected
    chain = skewed_chain(spark, tables, wide=True, split_rows=16)
    assert collected(chain.sample(N, SEED)) == rows


def test_partitioning_does_not_matter(spark, expected):
    tables, rows = expected
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (1, 13):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            chain = skewed_chain(spark, tables)
            specs = [TableSpec(t.name, t.df.repartition(parts)) for t in chain.tables]
            moved = ChainJoin(specs, chain.edges)
            assert collected(moved.sample(N, SEED)) == rows
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_shuffled_joins_give_the_same(spark, expected):
    tables, rows = expected
    names = ["spark.sql.autoBroadcastJoinThreshold",
             "spark.sql.adaptive.autoBroadcastJoinThreshold"]
    try:
        for name in names:
            spark.conf.set(name, -1)
        chain = skewed_chain(spark, tables, split_rows=16)
        assert collected(chain.sample(N, SEED)) == rows
    finally:
        for name in names:
            spark.conf.unset(name)


def test_cardinality_and_weights(spark, expected):
    tables, _ = expected
    results = chain_results(tables, EDGES)
    for wide in (False, True):
        chain = skewed_chain(spark, tables, wide=wide)
        assert chain.cardinality().first()[0] == len(results)
        assert chain.full_join().count() == len(results)
    starts = {}
    for rows in results:
        starts[rows[0]] = starts.get(rows[0], 0) + 1
    assert {(r[0], r[1]): r[2] for r in chain.weights(0).collect()} == starts


def test_sample_tables(spark, expected):
    tables, rows = expected
    samples = skewed_chain(spark, tables).sample_tables(N, SEED)
    starts = [1, 3, 6, 8]
    for i, df in enumerate(samples):
        got = [tuple(r) for r in df.collect()]
        assert sorted(got) == sorted(r[starts[i] : starts[i + 1]] for r in rows)
    key = [r["b_x"] for r in samples[1].collect()]
    assert key == sorted(key)


def test_n_zero_and_one(spark, expected):
    tables, rows = expected
    chain = skewed_chain(spark, tables)
    assert chain.sample(0, SEED).count() == 0
    assert collected(chain.sample(1, SEED)) == rows[:1]
    with pytest.raises(ValueError):
        chain.sample(-1, SEED)


@pytest.mark.parametrize("empty", [0, 1, 2])
def test_empty_tables(spark, empty):
    tables = skewed_tables()
    chain = skewed_chain(spark, tables)
    specs = [
        TableSpec(t.name, t.df.where("false") if i == empty else t.df)
        for i, t in enumerate(chain.tables)
    ]
    chain = ChainJoin(specs, chain.edges)
    assert chain.cardinality().first()[0] == 0
    sample = chain.sample(5, 1)
    assert sample.count() == 0
    assert sample.columns == skewed_chain(spark, tables).sample(1, 1).columns


def test_no_matching_key(spark):
    left = TableSpec("l", spark.createDataFrame([(1,), (None,)], "k int"))
    right = TableSpec("r", spark.createDataFrame([(2,), (None,)], "k int"))
    chain = ChainJoin([left, right], [("k", "k")])
    assert chain.cardinality().first()[0] == 0 and chain.sample(3, 0).count() == 0


def test_empty_string_is_a_value(spark):
    left = TableSpec("l", spark.createDataFrame([("",), (" ",), (None,)], "k string"))
    right = TableSpec("r", spark.createDataFrame([("",), (None,)], "k string"))
    chain = ChainJoin([left, right], [("k", "k")])
    assert [tuple(r) for r in chain.sample(2, 0).collect()] == [(0, "", ""), (1, "", "")]


def test_user_columns_named_count_and_weight(spark):
    rows = [(k, k * 2, k * 3) for k in (1, 1, 2)]
    specs = [
        TableSpec(n, spark.createDataFrame(rows, "key int, count int, weight int"))
        for n in ("l", "r")
    ]
    chain = ChainJoin(specs, [("key", "key")])
    assert chain.cardinality().first()[0] == 5
    for r in chain.sample(20, 1).collect():
        assert (r.l_count, r.l_weight) == (r.l_key * 2, r.l_key * 3)
    assert chain.weights(0, "w").columns == ["key", "count", "weight", "w"]
    with pytest.raises(ValueError, match="weight"):
        chain.weights(0)


def test_draws_only_what_is_asked(spark, expected, monkeypatch):
    from lotwise.staging import Staging

    names, write = [], Staging.table
    monkeypatch.setattr(Staging, "table", lambda self, df, name: names.append(name) or write(self, df, name))
    tables, rows = expected
    chain = skewed_chain(spark, tables)
    assert chain.sample_table(0, N, SEED).count() == N
    assert not any(n in names for n in ("sample1", "sample2"))
    assert collected(chain.sample(N, SEED)) == rows
    assert names.count("sample0") == names.count("sample2") == 1


def test_decimal_keys_meet_integers(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1,), (1,)], "k int").select(F.col("k").cast("decimal(12,2)").alias("k"))
    chain = ChainJoin([TableSpec("l", left), TableSpec("r", right)], [("k", "k")])
    assert chain.cardinality().first()[0] == 2


def test_same_frame_at_both_ends(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(10)], "id int, k int")
    chain = ChainJoin([TableSpec("x", df), TableSpec("y", df)], [("k", "k")])
    assert chain.cardinality().first()[0] == 16 + 9 + 9
    for r in chain.sample(50, 1).collect():
        assert r.x_id % 3 == r.y_id % 3 == r.x_k == r.y_k


def test_more_results_than_a_bigint(spark):
    """Ten tables of 100 rows under one key: 10**20 results."""
    df = spark.range(100).select(F.lit(1).alias("k"), "id")
    specs = [TableSpec(f"t{i}", df) for i in range(10)]
    edges = [("k", "k")] * 9
    chain = ChainJoin(specs, edges, wide=True)
    assert chain.cardinality().first()[0] == 10**20
    sample = chain.sample(200, 3)
    assert sample.count() == 200
    per_table = sample.select([F.countDistinct(f"t{i}_id") for i in range(10)]).first()
    assert min(per_table) > 70  # about 87 of 100 expected
    with pytest.raises(Exception, match="overflow|OVERFLOW"):
        ChainJoin(specs, edges).cardinality().collect()


def test_validation(spark):
    a = TableSpec("a", spark.createDataFrame([(1, "x")], "k int, s string"))
    with pytest.raises(ValueError, match="weighted_sample"):
        ChainJoin([a], [])
    with pytest.raises(ValueError, match="edges"):
        ChainJoin([a, a], [])
    with pytest.raises(ValueError, match="no column"):
        ChainJoin([a, a], [("k", "zz")])
    with pytest.raises(ValueError, match="cannot join"):
        ChainJoin([a, a], [("k", "s")])
    with pytest.raises(ValueError, match="reserved"):
        ChainJoin([TableSpec("b", a.df.withColumnRenamed("s", "__s")), a], [("k", "k")])
    with pytest.raises(ValueError, match="site"):
        ChainJoin([a, a], [("k", "k")]).memo(0, by_site=True)


def test_description(spark):
    chain = skewed_chain(spark, skewed_tables())
    assert [chain.incoming(i) for i in range(3)] == [None, "b_x", "c_y"]
    assert [chain.outgoing(i) for i in range(3)] == ["a_x", "b_y", None]


@pytest.mark.parametrize("split_rows, digits", [(1 << 17, 4), (20, 1), (1, 4)])
def test_weighted_sample(spark, split_rows, digits):
    rows = [(i, i % 7 - 1) for i in range(120)] + [(500, 40)] * 60 + [(501, None)]
    df = spark.createDataFrame(rows, "id long, w int")
    live = [r for r in rows if r[1] and r[1] > 0]
    total = sum(w for _, w in live)
    sample = weighted_sample(
        df, "w", 200, 4, split_rows=split_rows, slice_digits=digits
    )
    expected = [
        (i, *pick(live, [w for _, w in live], rank(4, total, i))) for i in range(200)
    ]
    assert collected(sample) == expected


def test_order_columns_shared_by_many_rows(spark):
    df = spark.range(100).select("id", F.lit(1).alias("w"), (F.col("id") % 2).alias("half"))
    sample = collected(weighted_sample(df, "w", 50, 1, order_cols=["half"]))
    assert len(sample) == 50
    for split_rows in (10, 1):
        sliced = weighted_sample(df, "w", 50, 1, order_cols=["half"], split_rows=split_rows)
        assert collected(sliced) == sample


def test_rows_of_equal_text(spark):
    """Nulls, separators and split values: different rows, told apart."""
    rows = [("a|b", "c"), ("a", "b|c"), ("a", None), (None, "a"), ("", "a"), ("a", "")]
    df = spark.createDataFrame(rows, "x string, y string").withColumn("w", F.lit(1))
    sample = weighted_sample(df, "w", 300, 1, split_rows=1, slice_digits=1)
    assert collected(sample) == collected(weighted_sample(df, "w", 300, 1))
    assert len(set(r[1:3] for r in sample.collect())) == len(rows)


@pytest.mark.parametrize("total", [2 * 10**37, 10**36, 5 * 10**18, 10])
def test_wide_draws_are_uniform(spark, total):
    df = spark.range(4).withColumn("w", F.lit(str(total)).cast("decimal(38,0)"))
    counts = weighted_sample(df, "w", 2000, 7, wide=True).groupBy("id").count().collect()
    assert len(counts) == 4
    assert sum((r["count"] - 500) ** 2 / 500 for r in counts) < 25  # chi-square, 3 degrees


def test_weights_are_whole_numbers(spark):
    df = spark.createDataFrame([(i, 1.5) for i in range(10)], "id int, w double")
    for weight in ("w", "d"):
        fractions = df.withColumn("d", F.col("w").cast("decimal(10,2)"))
        with pytest.raises(ValueError, match="whole numbers"):
            weighted_sample(fractions, weight, 100, 1)
    counts = spark.createDataFrame([(1, 3)], "key int, count int")
    with pytest.raises(ValueError, match="whole numbers"):
        sample_per_key(df, "id", counts, 1, "w")
    whole = df.withColumn("d", F.lit(2).cast("decimal(10,0)"))
    assert weighted_sample(whole, "d", 100, 1).count() == 100
    with pytest.raises(ValueError, match="map columns"):
        weighted_sample(whole.withColumn("m", F.create_map("id", "w")), "d", 1, 1)


@pytest.mark.parametrize("split_rows", [1 << 17, 10])
@pytest.mark.parametrize("weight", [None, "w"])
def test_sample_per_key(spark, split_rows, weight):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.4 else rng.choice("abc"), i, i % 4) for i in range(100)]
    rows += [("hot", 7, 3)] * 40 + [(None, 1, 1)]
    counts = {"hot": 2500, "a": 3, "b": 0, "zzz": 5}
    df = spark.createDataFrame(rows, "k string, id int, w int")
    wanted = spark.createDataFrame(
        [*counts.items(), ("a", 2), (None, 4)], "key string, count long"
    )
    got = sample_per_key(df, "k", wanted, 8, weight, split_rows=split_rows)
    expected = []
    for key, n in (("hot", 2500), ("a", 5)):
        live = [r for r in rows if r[0] == key and (weight is None or r[2] > 0)]
        weights = [r[2] if weight else 1 for r in live]
        expected += [
            (i, *pick(live, weights, rank(8, sum(weights), key, i))) for i in range(n)
        ]
    assert collected(got) == sorted(expected)


def test_repeat_rows(spark):
    df = spark.createDataFrame([("a", 0), ("b", 3), ("c", 5000), ("d", None)], "k string, n int")
    got = repeat_rows(df, "n")
    assert collected(got.groupBy("k").agg(F.count("*"), F.min("copy"), F.max("copy"))) == [
        ("b", 3, 0, 2), ("c", 5000, 0, 4999),
    ]


def test_one_huge_count_is_dealt_to_all_tasks(spark):
    got = repeat_rows(spark.createDataFrame([("a", 30_000_000), ("b", 2)], "k string, n long"), "n")
    sizes = got.where("k = 'a'").groupBy(F.spark_partition_id()).count().collect()
    sizes = sorted(r["count"] for r in sizes)
    assert sum(sizes) == 30_000_000 and sizes[-1] <= 2 * sizes[len(sizes) // 2]
    assert len(sizes) >= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_tree(spark):
    root = [(i % 4, i % 3) for i in range(20)]
    left, right = [(i % 5,) for i in range(12)], [(i % 2, i) for i in range(9)]
    specs = [
        TableSpec("root", spark.createDataFrame(root, "x int, y int")),
        TableSpec("left", spark.createDataFrame(left, "x long")),
        TableSpec("right", spark.createDataFrame(right, "y int, v int")),
    ]
    tree = TreeJoin(specs, [(0, "x", 1, "x"), (0, "y", 2, "y")])
    weights = [
        (x, y, w)
        for x, y in root
        if (w := left.count((x,)) * sum(r[0] == y for r in right))
    ]
    assert collected(tree.weights()) == sorted(weights)
    assert tree.cardinality().first()[0] == sum(w for *_, w in weights)
    with pytest.raises(ValueError):
        TreeJoin(specs, [(0, "x", 1, "x")])
    with pytest.raises(ValueError):
        TreeJoin(specs, [(0, "x", 1, "x"), (0, "x", 1, "x")])
