"""Point-in-interval join: which interval of its group does a position fall in.

The intervals of one group cover ``[0, total)`` without gaps. The range is cut
into a grid of ``parts`` cells and both sides join on (group, cell), so the
join is a plain equi-join: it can be broadcast, sorted or split by adaptive
execution, and one heavily drawn group spreads over its cells. The grid adds at
most ``parts`` entries to a group's intervals, and with ``parts`` not below the
number of intervals a uniform draw meets two of them on average, whatever the
weights are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.operators.names import CELL, LAST, LOW, PARTS, POS, TOTAL


def _cell(position: str) -> str:
    # Non-decreasing in the position and the same expression on both sides, so
    # a position inside [low, last] always lands between their cells.
    # Never null, or the join would compute it again to filter nulls out.
    share = f"CAST({position} AS DOUBLE) / CAST({TOTAL} AS DOUBLE)"
    return f"coalesce(CAST(floor({share} * {PARTS}) AS BIGINT), 0L)"


def with_intervals(
    rows: DataFrame, by: Sequence[str], order: Sequence[Column], span: str
) -> DataFrame:
    """Add ``[LOW, LAST]``: the running sum of column ``span`` inside each group.

    The window holds one group per task, so callers keep groups bounded.
    """
    window = (
        Window.partitionBy(*by)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return rows.withColumn("__end", F.sum(span).over(window)).selectExpr(
        "*", f"__end - {span} AS {LOW}", f"__end - 1 AS {LAST}"
    )


def locate(points: DataFrame, intervals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Join every point with the interval holding its position.

    Both sides carry ``by``, TOTAL and PARTS with equal values inside a group.
    The result has the point's columns and the interval's, without TOTAL and
    PARTS.
    """
    point_side = points.withColumn(CELL, F.expr(_cell(POS))).drop(TOTAL, PARTS)
    cells = F.expr(f"explode(sequence({_cell(LOW)}, {_cell(LAST)}))")
    interval_side = intervals.withColumn(CELL, cells).drop(TOTAL, PARTS)
    return point_side.join(interval_side, [*by, CELL]).where(
        f"{POS} BETWEEN {LOW} AND {LAST}"
    )
