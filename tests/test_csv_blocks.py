"""CSV files with line breaks in fields, read by many tasks."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.sources import read_csv, read_table, write_csv

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType())])
TEXTS = [
    "plain", None, "", '"', '""', 'a "quoted" word', "two\nlines", "\n", "\n\n\n", 'ends with "\n', '\n"starts',
    "back\\slash", ",", ',"\n",', " blanks ", "ünï\ncødé " * 9, "x\n" * 300, '"\n"' * 100, "long " * 200,
]


@pytest.fixture
def small_blocks(spark):
    """Blocks of 64 bytes to 1 kB, so records cross many of them."""

    def blocks(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)

    yield blocks
    for name in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{name}")


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("size", [64, 257, 1024, 1 << 20])
@pytest.mark.parametrize("files", [1, 3])
def test_split_reading_equals_whole_files(spark, tmp_path, small_blocks, size, files):
    path = str(tmp_path / "t")
    rows = [(i, TEXTS[i * 7 % len(TEXTS)]) for i in range(120)]
    write_csv(spark.createDataFrame(rows, SCHEMA).repartition(files), path)
    small_blocks(size)
    assert values(read_csv(spark, path, SCHEMA, split=True)) == values(spark.createDataFrame(rows, SCHEMA))
    assert values(read_csv(spark, path, split=True)) == values(read_csv(spark, path))


def test_one_file_is_read_by_many_tasks(spark, tmp_path, small_blocks):
    path = str(tmp_path / "t")
    rows = [(i, f"line {i}\nline {i}, and more") for i in range(2000)]
    write_csv(spark.createDataFrame(rows, SCHEMA), path, single_file=True)
    small_blocks(4096)
    found = read_csv(spark, path, SCHEMA, split=True)
    tasks = found.groupBy(F.spark_partition_id()).count().collect()
    assert read_csv(spark, path, SCHEMA).rdd.getNumPartitions() == 1
    assert len(tasks) > 8
    assert max(r["count"] for r in tasks) < 2000 / 4
    assert values(found) == sorted(rows, key=repr)


def test_malformed_values_and_options(spark, tmp_path, small_blocks):
    path = tmp_path / "t.csv"
    path.write_text('k,v\n1,"a\nb"\n\nx,"c\n\nd"\n')
    small_blocks(8)
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        read_table(spark, str(path), "csv", SCHEMA, split=True).collect()
    kept = read_table(spark, str(path), "csv", SCHEMA, split=True, mode="PERMISSIVE")
    assert values(kept) == [(1, "a\nb"), (None, "c\n\nd")]
    with pytest.raises(ValueError, match="csv"):
        read_table(spark, str(path), "parquet", split=True)


def test_files_without_records(spark, tmp_path):
    path = tmp_path / "t"
    path.mkdir()
    (path / "a.csv").write_text("k,v\n")
    (path / "b.csv").write_text("k,v")
    assert read_csv(spark, str(path), SCHEMA, split=True).count() == 0
