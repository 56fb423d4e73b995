"""Weighted draws with replacement from single tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.functions import draw_position, quoted
from lotwise.operators.lookup import BIGINT, SLICE_DIGITS, SPLIT_ROWS, WIDE, RowLookup
from lotwise.operators.names import (
    KEY,
    POS,
    ROWS,
    TOTAL,
    WEIGHT,
    check_user_columns,
)
from lotwise.operators.skew import join_unique
from lotwise.staging import Staging

COPIES_PER_CHUNK = 1024


def repeat_rows(df: DataFrame, count: str, index: str = "copy") -> DataFrame:
    """Every row ``count`` times, numbered from 0 in ``index``; none for 0.

    Rows with large counts are cut into chunks, dealt to all tasks at each level,
    so no task cuts or expands a huge count alone or builds a huge array.
    """
    n, size = quoted(count), COPIES_PER_CHUNK
    columns = [quoted(c) for c in df.columns]
    small = df.where(f"{n} > 0 AND {n} <= {size}").selectExpr(
        "*", f"explode(sequence(0L, CAST({n} AS BIGINT) - 1)) AS {quoted(index)}"
    )
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # cut by size**3, then size**2, then size: no array has more than about
    # ``size`` entries below counts of size**4
    large = df.where(f"{n} > {size}").selectExpr("*", "0L AS __low", f"CAST({n} AS BIGINT) AS __end")
    for width in (size**3, size**2, size):
        start = f"explode(sequence(__low, __end - 1, {width}L)) AS __start"
        large = large.selectExpr(*columns, "__end", start).selectExpr(
            *columns, "__start AS __low", f"least(__end, __start + {width}L) AS __end"
        )
        if width < size**3:  # the largest chunks are few
            large = large.repartition(tasks)
    large = large.selectExpr(
        *columns, f"explode(sequence(__low, __end - 1)) AS {quoted(index)}"
    )
    return small.unionByName(large)


_WHOLE_NUMBERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _weighted_rows(df: DataFrame, weight: str | None, wide: bool) -> tuple[DataFrame, str]:
    weight_type = WIDE if wide else BIGINT
    name = weight or "__one"
    if weight is None:
        return df.withColumn(name, F.lit(1).cast(weight_type)), name
    kind = df.schema[weight].dataType
    whole = isinstance(kind, _WHOLE_NUMBERS) or isinstance(kind, T.DecimalType) and kind.scale == 0
    if not whole:
        raise ValueError(f"weights must be whole numbers, {weight!r} is {kind.simpleString()}")
    return df.where(F.col(weight) > 0), name


def check_sortable(df: DataFrame) -> None:
    maps = [f.name for f in df.schema if isinstance(f.dataType, T.MapType)]
    if maps:
        raise ValueError(f"map columns cannot be ordered, drop {maps} first")


def _weigher(name: str, wide: bool):
    weight_type = WIDE if wide else BIGINT
    return lambda df: df.withColumn(WEIGHT, F.col(name).cast(weight_type))


def weighted_sample(
    df: DataFrame,
    weight: str,
    n: int,
    seed: int,
    order_cols: Sequence[str] | None = None,
    wide: bool = False,
    split_rows: int = SPLIT_ROWS,
    slice_digits: int = SLICE_DIGITS,
    staging: Staging | None = None,
) -> DataFrame:
    """``n`` draws, each taking a row in proportion to its integer weight.

    Result: ``draw_id`` and the columns of ``df``. Rows with a weight that is
    null or not positive are never drawn.
    """
    check_user_columns(df.columns)
    check_sortable(df)
    if n < 0:
        raise ValueError("n must not be negative")
    found = draw_rows(df, weight, 0, n, seed, order_cols or df.columns, wide, split_rows, slice_digits, staging) if n else None
    if found is None:
        schema = T.StructType([T.StructField("draw_id", BIGINT), *df.schema])
        return df.sparkSession.createDataFrame([], schema)
    return found.select(F.col("__draw").alias("draw_id"), *df.columns)


def draw_rows(
    df: DataFrame,
    weight: str,
    first: int,
    n: int,
    seed: int,
    order_cols: Sequence[str],
    wide: bool = False,
    split_rows: int = SPLIT_ROWS,
    slice_digits: int = SLICE_DIGITS,
    staging: Staging | None = None,
) -> DataFrame | None:
    """Draws ``first`` to ``first + n - 1`` of the sequence that ``seed`` starts.

    ``__draw``, the row's columns and POS, the position inside its weight. None
    if no row has weight.
    """
    spark, weight_type = df.sparkSession, WIDE if wide else BIGINT
    rows, name = _weighted_rows(df, weight, wide)
    whole = rows.agg(F.sum(F.col(name).cast(WIDE)), F.count(F.lit(1))).first()
    total, count = int(whole[0] or 0), whole[1]
    if total == 0:
        return None
    total_lit = F.lit(str(total)).cast(WIDE)
    points = spark.range(first, first + n).select(
        F.col("id").alias("__draw"),
        F.lit(0).alias(KEY),
        draw_position(seed, ["id"], f"'{total}'", weight_type.simpleString()).alias(POS),
        total_lit.cast(weight_type).alias(TOTAL),
        F.lit(count).cast("bigint").alias(ROWS),
    )
    lookup = RowLookup(
        rows.withColumn(KEY, F.lit(0)),
        order_cols,
        _weigher(name, wide),
        [name],
        False,
        staging or Staging(spark),
        weight_type,
        split_rows,
        slice_digits,
        single_group=(total, count),
    )
    return lookup.resolve(points, count)


def sample_per_key(
    df: DataFrame,
    key: str,
    counts: DataFrame,
    seed: int,
    weight: str | None = None,
    order_cols: Sequence[str] | None = None,
    wide: bool = False,
    split_rows: int = SPLIT_ROWS,
    slice_digits: int = SLICE_DIGITS,
    staging: Staging | None = None,
) -> DataFrame:
    """For each ``(key, count)`` of ``counts``, that many draws among its rows.

    Rows are drawn in proportion to ``weight`` (equally without one). Result:
    ``draw_no`` (from 0 inside each key) and the columns of ``df``. Keys without
    rows give nothing.
    """
    check_user_columns(df.columns)
    check_sortable(df)
    spark, weight_type = df.sparkSession, WIDE if wide else BIGINT
    staging = staging or Staging(spark)
    rows, name = _weighted_rows(df, weight, wide)
    rows = rows.withColumn(KEY, F.col(key))
    weigh = _weigher(name, wide)
    wanted = (
        counts.where((F.col("count") > 0) & F.col("key").isNotNull())
        .groupBy(F.col("key").cast(df.schema[key].dataType).alias(KEY))
        .agg(F.sum("count").cast("bigint").alias("__wanted"))
    )
    keys = wanted.select(F.col(KEY).alias("__wanted_key"))
    totals = staging.table(
        join_unique(
            weigh(rows).select(KEY, WEIGHT), F.col(KEY), keys, "__wanted_key", "left_semi"
        )
        .groupBy(KEY)
        .agg(
            F.sum(WEIGHT).cast(weight_type).alias(TOTAL),
            F.count(F.lit(1)).alias(ROWS),
        )
        .join(wanted, KEY),
        "key_totals",
    )
    draws = repeat_rows(totals, "__wanted", "__draw")
    points = staging.table(
        draws.select(
            "__draw",
            KEY,
            draw_position(
                seed, [KEY, "__draw"], TOTAL, weight_type.simpleString()
            ).alias(POS),
            TOTAL,
            ROWS,
        ),
        "key_draws",
    )
    largest = totals.agg(F.max(ROWS)).first()[0] or 0
    lookup = RowLookup(
        rows,
        order_cols or df.columns,
        weigh,
        [name],
        False,
        staging,
        weight_type,
        split_rows,
        slice_digits,
    )
    found = lookup.resolve(points, largest)
    return found.select(F.col("__draw").alias("draw_no"), *df.columns)
