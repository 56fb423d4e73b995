"""Readers, writers and the site catalog."""

import pytest

from lotwise.sources import (
    empty_table,
    multi_site_tables,
    read_csv,
    read_memo,
    read_site_table,
    read_table,
    site_catalog,
    write_csv,
    write_memo,
    write_parquet,
    write_samples,
)
from lotwise.staging import Staging, shared_folder
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("key", T.StringType()), T.StructField("value", T.LongType())]
)


@pytest.fixture
def df(spark):
    return spark.createDataFrame([("a", 1), ("", 2), ("x,y", 3), (" b ", 4), (None, None)], SCHEMA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_csv_round_trip_keeps_empty_strings(spark, df, tmp_path):
    path = str(tmp_path / "t")
    write_csv(df, path, single_file=True)
    assert rows(read_csv(spark, path, SCHEMA)) == rows(df)
    assert [f.dataType for f in read_csv(spark, path).schema] == [T.StringType()] * 2
    assert rows(read_table(spark, path, "csv", SCHEMA)) == rows(df)


def test_parquet_round_trip_overwrites(spark, df, tmp_path):
    path = str(tmp_path / "t")
    write_parquet(df.limit(1), path)
    write_parquet(df, path)
    assert rows(read_table(spark, path)) == rows(df)


def test_unknown_format(spark):
    with pytest.raises(ValueError, match="format"):
        read_table(spark, "/nowhere", "orc")


def test_memo_columns_are_named_by_position(spark, df, tmp_path):
    for fmt, schema in (("csv", SCHEMA), ("parquet", None)):
        path = str(tmp_path / fmt)
        write_memo(df.toDF("k", "n"), path, fmt)
        memo = read_memo(spark, path, fmt, schema)
        assert memo.columns == ["key", "count"] and rows(memo) == rows(df)


def test_empty_table_is_neutral(spark, df):
    assert rows(empty_table(spark, SCHEMA).union(df)) == rows(df)


@pytest.mark.parametrize("layout", ["table", "site"])
def test_sites(spark, df, tmp_path, layout):
    root = str(tmp_path)
    for site, tables in {"s0": ["t", "u"], "s1": ["t"]}.items():
        for name in tables:
            folder = f"{name}/site={site}" if layout == "table" else f"{site}/{name}"
            write_parquet(df, f"{root}/{folder}")
    catalog = site_catalog(spark, root, by=layout)
    assert rows(catalog) == [("s0", "t"), ("s0", "u"), ("s1", "t")]
    assert dict(rows(multi_site_tables(catalog))) == {"t": True, "u": False}
    whole = read_site_table(spark, root, "t", by=layout)
    assert whole.groupBy("site").count().count() == 2 and whole.count() == 10
    one = read_site_table(spark, root, "t", schema=SCHEMA, sites=["s1"], by=layout)
    assert {r["site"] for r in one.collect()} == {"s1"} and one.count() == 5


def test_site_filter_prunes_directories(spark, df, tmp_path):
    write_parquet(df.selectExpr("*", "'s0' AS site"), f"{tmp_path}/t", ["site"])
    one = read_site_table(spark, str(tmp_path), "t", sites=["s0"])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan


def test_write_samples(spark, df, tmp_path):
    write_samples({"a": df, "b": df.limit(2)}, str(tmp_path))
    assert read_table(spark, f"{tmp_path}/b").count() == 2


def test_staging_uses_the_shared_folder_and_cleans_up(spark, df, tmp_path):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_folder(spark) == named.rstrip("/")
    staging = Staging(spark, str(tmp_path))
    table = staging.table(df, "x")
    assert rows(table) == rows(df) and staging.path.startswith(str(tmp_path))
    staging.release()
    assert not list(tmp_path.iterdir())


def test_staged_folders_are_released(spark):
    import os

    from lotwise.operators import count_min_sketch
    from lotwise.staging import Staging, release_all

    memo = spark.createDataFrame([(1, 2), (2, 3)], "key int, count long")
    with Staging(spark) as staging:
        staging.table(memo, "memo")
        assert os.path.isdir(staging.path)
    assert not os.path.exists(staging.path)
    folder = os.path.dirname(staging.path)
    before = set(os.listdir(folder))
    count_min_sketch(memo, 2, 8)
    made = set(os.listdir(folder)) - before
    assert made
    release_all()
    assert not made & set(os.listdir(folder))
