"""Row-level helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions import common_type, quoted, row_hash
from lotwise.operators.keys import nonzero
from lotwise.operators.names import SITE
from lotwise.operators.skew import join_unique
from lotwise.staging import Staging

_IN_PART = 33  # monotonically_increasing_id: the part in the upper bits, the row below


def numbered(
    df: DataFrame,
    order: Sequence[Column],
    name: str,
    staging: Staging,
    within: Sequence[str] = (),
    size: str | None = None,
) -> DataFrame:
    """Number rows from 0 in ``order``, inside each group of ``within`` (not null).

    Rows are range-partitioned, sorted and written; a row's number is that of the
    rows in the parts before plus its place in its own part. No task sees more
    than one part, whatever the groups are. Rows equal in ``order`` must be
    interchangeable: they are spread by a number of their own, not kept together.
    ``size`` names a column for the number of rows of the group.
    """
    groups = [quoted(c) for c in within]
    ranges = [*[F.col(c) for c in groups], *order, F.col("__tie")]
    tied = df.withColumn("__tie", F.monotonically_increasing_id())
    ranged = tied.repartitionByRange(*ranges).sortWithinPartitions(*ranges).drop("__tie")
    ranged = staging.table(ranged.withColumn("__at", F.monotonically_increasing_id()), "ordered")
    ranged = ranged.withColumn("__part", F.shiftright("__at", _IN_PART))
    parts = ranged.groupBy("__part", *groups).agg(F.count(F.lit(1)).alias("__count"), F.min("__at").alias("__first"))
    # one row per part and group it meets
    own = Window.partitionBy(*groups)
    before = own.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns(
        {"__earlier": F.coalesce(F.sum("__count").over(before), F.lit(0)), "__size": F.sum("__count").over(own)}
    )
    keys = [F.col(c).alias(f"__group_{i}") for i, c in enumerate(groups)]
    parts = parts.select(F.col("__part").alias("__of"), *keys, F.expr("__earlier - __first").alias("__shift"), "__size")
    parts = staging.table(parts, "parts")
    on = F.col("__part") == F.col("__of")
    for i, c in enumerate(groups):
        on &= F.col(c) == F.col(f"__group_{i}")
    sizes = [F.col("__size").alias(size)] if size else []
    columns = [F.col(quoted(c)) for c in df.columns]
    return ranged.join(parts, on).select(*columns, F.expr("__at + __shift").alias(name), *sizes)


def with_record_id(df: DataFrame, name: str = "record_id", staging: Staging | None = None) -> DataFrame:
    """Add dense ids from 0, in order of a hash of the row, then of its columns.

    They depend on the rows only, not on how they are partitioned; copies of a row
    take consecutive ids. Columns of map type cannot be hashed.
    """
    staging = staging or Staging(df.sparkSession)
    hashed = df.withColumn("__hash", row_hash(df.columns))
    order = [F.col("__hash"), *[F.col(quoted(c)) for c in df.columns]]
    return numbered(hashed, order, name, staging).drop("__hash")


def with_unit_weight(df: DataFrame) -> DataFrame:
    """Add ``weight`` 1, the weight of every row of a last table."""
    return df.withColumn("weight", F.lit(1).cast("bigint"))


def tag_site(df: DataFrame, site: str) -> DataFrame:
    """Add the literal site."""
    return df.withColumn(SITE, F.lit(site))


def at_site(df: DataFrame, site: str) -> DataFrame:
    """Rows of one site; prunes directories of site-partitioned tables."""
    return df.where(F.col(SITE) == site)


def with_partner(df: DataFrame, column: str, memo: DataFrame) -> DataFrame:
    """Rows whose key has a positive count in a ``(key, count)`` memo."""
    as_type = common_type(df.schema[column].dataType, memo.schema["key"].dataType)
    keys = nonzero(memo).select(F.col("key").cast(as_type).alias("__partner"))
    on = F.col(column).cast(as_type)
    return join_unique(df, on, keys, "__partner", "left_semi")
