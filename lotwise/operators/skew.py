"""Joins of a table with one row per key, safe for keys that fill the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def join_unique(
    rows: DataFrame, column: Column, keyed: DataFrame, key: str, how: str = "inner"
) -> DataFrame:
    """``rows`` joined with ``keyed`` on ``column = key``, types being equal.

    Adaptive execution splits a reducer that one key overfills, but only where
    both sides of the join come straight from a shuffle. An aggregation by
    ``key`` is already distributed by it, so none would follow. Joining on a
    function of the key as well asks for a new distribution: ``keyed``, one short
    row per key, is shuffled once more, and a hot key's rows can be split. That
    function is never null, or the join would compute it again to filter nulls out.
    """
    turn = "coalesce(pmod(xxhash64({}), 2), 0L)"
    left = rows.withColumn("__on", column)
    left = left.withColumn("__turn", F.expr(turn.format("__on")))
    right = keyed.withColumn("__key_turn", F.expr(turn.format(key)))
    same = (F.col("__on") == F.col(key)) & (F.col("__turn") == F.col("__key_turn"))
    return left.join(right, same, how).drop("__on", "__turn", "__key_turn")
