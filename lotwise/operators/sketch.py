"""Approximate weights: a count-min sketch kept as a small table.

The sketch has at most ``depth * width`` rows whatever the data, and is staged.
Different keys of a table are weighed first, cell by cell; the table then meets
its keys once. Estimates never fall below the exact weight, so draws by them can be
thinned to exact ones.
"""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.functions import common_type, quoted
from lotwise.operators.lookup import RowLookup
from lotwise.operators.names import KEY, POS, ROWS, TOTAL, WEIGHT, output_columns
from lotwise.operators.rows import numbered
from lotwise.operators.sampling import draw_rows
from lotwise.operators.skew import join_unique
from lotwise.staging import Staging

if TYPE_CHECKING:
    from lotwise.plans.chain import TableSpec


def _bucket(depth: Column, key: Column, width: int) -> Column:
    return F.pmod(_key_hash(depth, key), F.lit(width).cast("bigint"))


def _key_hash(depth: Column, key: Column) -> Column:
    text = F.concat_ws("|", depth.cast("string"), key.cast("string"))
    word = F.conv(F.substring(F.md5(text), 1, 15), 16, 10)
    return word.cast("bigint")


def check_size(depth: int, width: int) -> None:
    if depth < 1 or width < 1:
        raise ValueError("depth and width must be positive")


def count_min_sketch(
    memo: DataFrame, depth: int, width: int, staging: Staging | None = None
) -> DataFrame:
    """``(depth, bucket, total)`` of a ``(key, count)`` memo, staged.

    It is read once per depth, so it is written once instead of being recomputed.
    """
    check_size(depth, width)
    rows = memo.where(F.col("key").isNotNull()).select(
        F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("depth"), "key", "count"
    )
    bucket = _bucket(F.col("depth"), F.col("key"), width)
    cells = rows.groupBy("depth", bucket.alias("bucket")).agg(
        F.sum("count").alias("total")
    )
    return (staging or Staging(memo.sparkSession)).table(cells, "sketch")


def approximate_weights(
    table: DataFrame, column: str, sketch: DataFrame, depth: int, width: int
) -> DataFrame:
    """``table`` with ``weight``: the least sketch cell of each row's key.

    Rows that miss a cell have no partner for certain and are dropped.
    """
    check_size(depth, width)
    keys = table.select(F.col(quoted(column)).alias("__key")).where("__key IS NOT NULL").distinct()
    for level in range(depth):
        cells = sketch.where(F.col("depth") == level).select(
            F.col("bucket").alias(f"__bucket_{level}"),
            F.col("total").alias(f"__total_{level}"),
        )
        bucket = _bucket(F.lit(level), F.col("__key"), width)
        keys = join_unique(keys, bucket, cells, f"__bucket_{level}")
    totals = [F.col(f"__total_{level}") for level in range(depth)]
    least = totals[0] if depth == 1 else F.least(*totals)
    weight = keys.select(F.col("__key").alias("__weighed"), least.alias("weight"))
    return join_unique(table, F.col(quoted(column)), weight, "__weighed").select(*table.columns, "weight")


def sample_by_sketch(
    left: TableSpec,
    left_col: str,
    right: TableSpec,
    right_col: str,
    n: int,
    seed: int,
    depth: int = 4,
    width: int = 1 << 16,
    staging: Staging | None = None,
) -> DataFrame:
    """``n`` independent uniform draws from ``left JOIN right``: ``draw_id`` and their columns.

    The exact memo of the right table is never built. Rows of the left are drawn by
    approximate weight; as this is not below the exact one, a position inside it
    that is below the exact one, too, is accepted and names a row of the right, any
    other is rejected. Exact counts are taken for keys that were drawn only. Draws
    are a fixed sequence, of which the first ``n`` accepted are taken, in rounds.
    """
    check_size(depth, width)
    if n < 0:
        raise ValueError("n must not be negative")
    spark = left.df.sparkSession
    staging = staging or Staging(spark)
    joined_as = common_type(left.df.schema[left_col].dataType, right.df.schema[right_col].dataType)
    rows = right.df.withColumn(KEY, F.col(quoted(right_col)).cast(joined_as))
    names = output_columns([left, right])
    keyed = left.df.withColumn("__join", F.col(quoted(left_col)).cast(joined_as))
    counts = rows.where(F.col(KEY).isNotNull()).groupBy(F.col(KEY).alias("key")).agg(F.count(F.lit(1)).alias("count"))
    sketch = count_min_sketch(counts, depth, width, staging)
    guessed = approximate_weights(keyed, "__join", sketch, depth, width).withColumnRenamed("weight", "__guess")
    guessed = staging.table(guessed, "guessed")
    own = [F.col(quoted(c)).alias(f"__0_{c}") for c in left.df.columns]
    accepted, found, drawn, rate = [], 0, 0, 1.0
    while found < n:
        more = int((n - found) / rate * 1.1) + 64
        draws = draw_rows(guessed, "__guess", drawn, more, seed, left.order, staging=staging)
        if draws is None:
            break
        draws = staging.table(draws.select("__draw", POS, F.col("__join").alias(KEY), *own), "drawn")
        keys = draws.select(F.col(KEY).alias("__wanted")).distinct()
        totals = join_unique(rows.select(KEY), F.col(KEY), keys, "__wanted", "left_semi").groupBy(F.col(KEY).alias("__of"))
        totals = totals.agg(F.count(F.lit(1)).alias(TOTAL))
        kept = join_unique(draws, F.col(KEY), totals, "__of").where(f"{POS} < {TOTAL}").drop("__of")
        kept = staging.table(kept, "accepted")
        accepted.append(kept)
        own_found = kept.count()
        if not own_found and not found and not _any_result(guessed, rows):
            break
        found, drawn = found + own_found, drawn + more
        rate = max(found, 1) / drawn
    fields = [F.col(f"__{i}_{c}").alias(name) for i, named in enumerate(names) for c, name in named.items()]
    if not found:
        kinds = [(name, t.df.schema[c].dataType) for t, named in zip((left, right), names) for c, name in named.items()]
        return spark.createDataFrame([], T.StructType([T.StructField(c, k) for c, k in [("draw_id", T.LongType()), *kinds]]))
    all_kept = reduce(DataFrame.unionByName, accepted)
    placed = numbered(all_kept, [F.col("__draw")], "__place", staging).where(f"__place < {n}")
    points = placed.drop("__draw").withColumn(ROWS, F.col(TOTAL))
    points = staging.table(points, "points")
    largest = points.agg(F.max(ROWS)).first()[0]
    unit = lambda df: df.withColumn(WEIGHT, F.lit(1).cast("bigint"))
    lookup = RowLookup(rows, right.order, unit, [], False, staging)
    result = lookup.resolve(points, largest)
    result = result.withColumnsRenamed({c: f"__1_{c}" for c in right.df.columns})
    return result.select(F.col("__place").alias("draw_id"), *fields)


def _any_result(guessed: DataFrame, rows: DataFrame) -> bool:
    """Does the join have a row at all; asked after a round without an accepted draw."""
    keys = rows.select(F.col(KEY).alias("__wanted")).distinct()
    return not join_unique(guessed, F.col("__join"), keys, "__wanted", "left_semi").isEmpty()
