"""Aggregates and filters on join keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions import common_type
from lotwise.operators.names import SITE
from lotwise.operators.skew import join_unique


def merge_memos(site_memos: DataFrame) -> DataFrame:
    """``(key, count)`` over all sites from ``(key, count, site)``."""
    return site_memos.groupBy("key").agg(F.sum("count").alias("count"))


def nonzero(memo: DataFrame) -> DataFrame:
    """Keys with a positive count."""
    return memo.where(F.col("count") > 0)


def restrict_memo(memo: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``memo`` (any table with a ``key``) whose key occurs in ``keys``."""
    as_type = common_type(memo.schema["key"].dataType, keys.schema["key"].dataType)
    wanted = keys.select(F.col("key").cast(as_type).alias("__wanted")).distinct()
    return join_unique(memo, F.col("key").cast(as_type), wanted, "__wanted", "left_semi")


def key_totals(site_memos: DataFrame, keys: DataFrame) -> DataFrame:
    """``(key, total)`` over all sites, for the keys in ``keys``."""
    return restrict_memo(site_memos, keys).groupBy("key").agg(
        F.sum("count").alias("total")
    )


def site_key_shares(site_memos: DataFrame, key_counts: DataFrame) -> DataFrame:
    """Expected draws of each (site, key).

    ``site_memos`` is ``(key, count, site)``, ``key_counts`` ``(key, count)``.
    Result: ``(site, key, count, total, requested, expected)``.
    """
    # A key has one row per site, so the window stays small.
    total = F.sum("count").over(Window.partitionBy("key"))
    requested = key_counts.select("key", F.col("count").alias("requested"))
    expected = F.col("requested") * F.col("count") / F.col("total")
    return (
        restrict_memo(site_memos, key_counts)
        .withColumn("total", total)
        .join(requested, "key")
        .select(SITE, "key", "count", "total", "requested", expected.alias("expected"))
    )


def expected_row_draws(
    weighted: DataFrame, key: str, key_counts: DataFrame, memo: DataFrame
) -> DataFrame:
    """Weighted rows with ``expected``: their share of the draws of their key."""
    requested = key_counts.select(
        F.col("key").alias("__key"), F.col("count").alias("__requested")
    )
    totals = memo.select(F.col("key").alias("__total_key"), F.col("count").alias("__total"))
    per_key = requested.join(totals, F.col("__key") == F.col("__total_key"))
    expected = F.col("__requested") * F.col("weight") / F.col("__total")
    as_type = requested.schema["__key"].dataType
    return join_unique(weighted, F.col(key).cast(as_type), per_key, "__key").select(
        *weighted.columns, expected.alias("expected")
    )


def key_frequency(df: DataFrame, key: str) -> DataFrame:
    """``(key, freq)``: share of the table's keyed rows at each key."""
    counts = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(
        F.count(F.lit(1)).alias("__count")
    )
    rows = df.agg(F.count(key).cast("double").alias("__rows"))
    return counts.select("key", (F.col("__count") / rows.scalar()).alias("freq"))


def key_metadata(weighted: DataFrame, key: str, site: str) -> DataFrame:
    """``(key, count, site, weight)``: rows and join results of each (key, site)."""
    return weighted.groupBy(F.col(key).alias("key"), F.col(site).alias(SITE)).agg(
        F.count(F.lit(1)).alias("count"), F.sum("weight").alias("weight")
    ).select("key", "count", SITE, "weight")


def key_filter(
    left: DataFrame, left_col: str, right: DataFrame, right_col: str
) -> tuple[DataFrame, DataFrame]:
    """Both tables without the rows that have no partner in the other one."""
    as_type = common_type(left.schema[left_col].dataType, right.schema[right_col].dataType)
    own = {}
    for name, df, column in (("l", left, left_col), ("r", right, right_col)):
        keys = df.select(F.col(column).cast(as_type).alias("__partner")).distinct()
        own[name] = df, F.col(column).cast(as_type), keys
    (left, left_on, left_keys), (right, right_on, right_keys) = own["l"], own["r"]
    return (
        join_unique(left, left_on, right_keys, "__partner", "left_semi"),
        join_unique(right, right_on, left_keys, "__partner", "left_semi"),
    )
