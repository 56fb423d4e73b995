"""Exact join weights: how many join results a row starts.

A memo says, for each value of a join column, how many results start there
(``TOTAL``) and how many rows start them (``ROWS``). Memos have one row per key,
so joining a table with a memo never multiplies rows, and the key counts are
combined before the shuffle on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.functions import quoted
from lotwise.operators.names import KEY, ROWS, TOTAL, WEIGHT
from lotwise.operators.skew import join_unique


def leaf_memo(
    table: DataFrame, key: str, key_type, weight_type, extra: Sequence[str] = ()
) -> DataFrame:
    """Memo of a table that joins nothing further: its rows per key."""
    keyed = table.select(F.col(key).cast(key_type).alias(KEY), *extra)
    counted = keyed.where(F.col(KEY).isNotNull()).groupBy(KEY, *extra)
    return counted.agg(F.count(F.lit(1)).alias(ROWS)).withColumn(
        TOTAL, F.col(ROWS).cast(weight_type)
    )


def _weight_of_key(memo: DataFrame) -> DataFrame:
    return memo.select(
        F.col(KEY).alias("__next_key"),
        F.col(TOTAL).alias(WEIGHT),
        F.col(ROWS).alias("__next_rows"),
    ).where(F.col(WEIGHT) > 0)


def attach_weight(table: DataFrame, column: str, key_type, memo: DataFrame) -> DataFrame:
    """Rows of ``table`` with a partner, WEIGHT taken from ``memo``.

    Adds ``__next_key`` and ``__next_rows``: the group the row leads to.
    """
    on = F.col(quoted(column)).cast(key_type)
    return join_unique(table, on, _weight_of_key(memo), "__next_key")


def inner_memo(
    table: DataFrame,
    key: str,
    key_type,
    next_col: str,
    next_type,
    next_memo: DataFrame,
    weight_type,
    extra: Sequence[str] = (),
) -> DataFrame:
    """Memo of a table in the middle: weights summed per incoming key."""
    keyed = table.select(
        F.col(key).cast(key_type).alias(KEY),
        F.col(next_col).alias("__next"),
        *extra,
    ).where(F.col(KEY).isNotNull())
    weighed = attach_weight(keyed, "__next", next_type, next_memo)
    return weighed.groupBy(KEY, *extra).agg(
        F.sum(WEIGHT).cast(weight_type).alias(TOTAL),
        F.count(F.lit(1)).alias(ROWS),
    )


def root_memo(
    table: DataFrame,
    next_col: str,
    next_type,
    next_memo: DataFrame,
    weight_type,
    extra: Sequence[str] = (),
) -> DataFrame:
    """Memo of the first table by its own join column.

    Rows with the same value have the same weight, so they are counted before
    the join: a value held by most of the table reaches it as one row.
    """
    counted = leaf_memo(table, next_col, next_type, weight_type, extra)
    found = _weight_of_key(next_memo)
    weighed = counted.drop(TOTAL).join(found, F.col(KEY) == F.col("__next_key"))
    total = (F.col(ROWS).cast(weight_type) * F.col(WEIGHT)).cast(weight_type)
    return weighed.select(KEY, *extra, ROWS, total.alias(TOTAL))
