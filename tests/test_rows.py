"""Row operators that need more than their SQL."""

from collections import Counter

from pyspark.sql import functions as F

from lotwise.operators import with_record_id
from lotwise.operators.rows import numbered
from lotwise.staging import Staging


def test_ids_do_not_depend_on_partitions(spark):
    df = spark.range(3000).selectExpr("id % 700 AS a", "IF(id % 5 = 0, NULL, concat('t', id % 9)) AS b")
    once, again = (Counter(map(tuple, with_record_id(df.repartition(n)).collect())) for n in (3, 17))
    assert once == again and sorted(r[-1] for r in once) == list(range(3000))
    assert with_record_id(df.limit(0)).count() == 0


def test_numbers_inside_groups(spark):
    """Two thirds of the rows are one group and most of these one row."""
    df = spark.range(5000).selectExpr("IF(id % 3 < 2, 'hot', concat('g', id % 40)) AS g", "IF(id % 7 < 5, 1, id % 100) AS v")
    found = numbered(df.repartition(9), [F.col("v")], "n", Staging(spark), ["g"], "size").collect()
    by_group = {}
    for r in found:
        by_group.setdefault(r.g, []).append((r.n, r.v, r["size"]))
    for rows in by_group.values():
        rows.sort()
        assert [n for n, _, _ in rows] == list(range(len(rows)))
        assert [v for _, v, _ in rows] == sorted(v for _, v, _ in rows)
        assert {size for _, _, size in rows} == {len(rows)}


def test_equal_rows_are_spread(spark):
    """Rows of one value do not sit in one part."""
    df = spark.range(4000).selectExpr("1 AS v")
    staging, merged = Staging(spark), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(merged, False)
    numbered(df.repartition(8), [F.col("v")], "n", staging)
    spark.conf.unset(merged)
    ordered = spark.read.parquet(f"{staging.path}/*-ordered")
    sizes = [r["count"] for r in ordered.groupBy(F.shiftright("__at", 33)).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 1500
