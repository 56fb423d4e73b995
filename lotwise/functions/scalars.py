"""Small numeric helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def common_type(left: T.DataType, right: T.DataType) -> T.DataType:
    """The type two join columns are compared in."""
    if left == right:
        return left
    if isinstance(left, _INTEGRAL) and isinstance(right, _INTEGRAL):
        return T.LongType()
    numbers = (*_INTEGRAL, T.DecimalType)
    if isinstance(left, numbers) and isinstance(right, numbers):
        scale = max(t.scale for t in (left, right) if isinstance(t, T.DecimalType))
        return T.DecimalType(38, scale)
    raise ValueError(
        f"cannot join {left.simpleString()} with {right.simpleString()} columns"
    )


def half_up(value: Column) -> Column:
    """Round a non-negative number to the nearest BIGINT, halves upwards."""
    return F.floor(value + F.lit(0.5)).cast("bigint")


def to_share(part: Column, whole: Column) -> Column:
    """``part / whole`` as DOUBLE, with ``whole`` floored at one."""
    return part.cast("double") / F.greatest(whole.cast("double"), F.lit(1.0))
