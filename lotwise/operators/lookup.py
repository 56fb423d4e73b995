"""Draws into grouped, weighted rows, without holding a large group anywhere.

A draw names a group and a position in ``[0, total)`` of that group. The rows of
a group are ordered by a portable row hash, then by their columns, and each row
owns as many positions as its weight; the draw gets the row owning its position.

* Late fetch. Where groups are cut, or other columns are wide, draws are located among
  narrow rows: group, hashes of the order columns and what the weight depends on.
  Other columns are read once, at the end, for rows that were drawn, and pass through
  no window and no grid. Rows that share their order columns are told apart by the
  others, in a second lookup of these rows only. The table meets drawn rows by a
  cheap hash; the long one is checked where they met.
* Only groups that were drawn are read; they join on the group, nothing else.
* A group with more rows than ``split_rows`` is cut into slices by the leading
  digits of the row hash. Slice totals come from one aggregation with few slices
  per group, so most of it happens on the map side; the draw moves to its slice.
  Drawn slices that are still large are cut again by the next digits. Slices
  follow the row hash, so the cuts never change a result. The narrow rows are
  written before they are cut, so every row is hashed once for all levels.
* The table meets drawn groups, slices and rows, one row each, by ``join_unique``: a
  hot group is split by adaptive execution, and counts are combined before a shuffle.
* Rows of one hash share a slice that cannot be cut. There they are counted, on
  the map side first: a row repeated any number of times is one row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.functions import quoted, row_hash
from lotwise.functions.hashing import HASH_DIGITS
from lotwise.operators.locate import locate, with_intervals
from lotwise.operators.skew import join_unique
from lotwise.operators.names import (
    COPIES,
    KEY,
    LAST,
    LEAF,
    LOW,
    PARTS,
    POS,
    ROWS,
    TOTAL,
    WEIGHT,
)
from lotwise.staging import Staging

BIGINT = T.LongType()
WIDE = T.DecimalType(38, 0)

SPLIT_ROWS = 1 << 17
LATE_BYTES = 48  # about as much as late fetch adds to a narrow row
_BYTES = {"byte": 1, "short": 2, "boolean": 1, "integer": 4, "date": 4, "float": 4, "long": 8, "double": 8, "timestamp": 8, "decimal": 16, "string": 20}
SLICE_DIGITS = 4  # hash digits per cut: at most 65536 slices of a group or slice
HASH = "__hash"
QUICK = "__quick"  # 64-bit hash of the order columns, for joins
SPAN = "__span"
CUT = "__cut"  # can and must this slice be cut again
WHOLE = "''"  # LEAF of an uncut group
TIED = "__tied_total"  # weight of all rows of one hash
TIED_ROWS = "__tied_rows"


class RowLookup:
    """Finds the row of each draw.

    ``rows`` has KEY and the table's columns. ``weigh`` adds WEIGHT to a frame with
    the columns ``needs``; it may add more columns and drops rows without weight. It
    runs after the rows were reduced to the drawn groups. ``joins`` says that it
    looks the weight up in another table. ``single_group`` is (total, rows) when all
    rows form one group. ``late`` settles whether columns are fetched late; both ways
    give the same rows.
    """

    def __init__(
        self,
        rows: DataFrame,
        order_cols: Sequence[str],
        weigh: Callable[[DataFrame], DataFrame],
        needs: Sequence[str],
        joins: bool,
        staging: Staging,
        weight_type: T.DataType = BIGINT,
        split_rows: int = SPLIT_ROWS,
        slice_digits: int = SLICE_DIGITS,
        single_group: tuple[int, int] | None = None,
        late: bool | None = None,
    ):
        if split_rows < 1 or not 1 <= slice_digits <= SLICE_DIGITS:
            raise ValueError("split_rows or slice_digits out of range")
        self.columns = [c for c in rows.columns if c != KEY]
        self.order_cols = list(order_cols)
        self.rest = [c for c in self.columns if c not in self.order_cols]
        self.weigh, self.needs, self.joins = weigh, list(needs), joins
        self.staging = staging
        self.weight_type = weight_type
        self.split_rows = split_rows
        self.slice_digits = slice_digits
        self.single_group = single_group
        self.late = late
        self.rows = rows
        self.quick = F.xxhash64(*[F.col(quoted(c)) for c in self.order_cols])

    def _narrow(self, late: bool) -> None:
        """Settle which columns travel with the rows. Equal hashes are equal rows, or
        rows equal in the order columns if the others are fetched late."""
        self.late = late
        self.carried = self.needs if late else self.columns
        hashes = [row_hash(self.order_cols)]
        if self.rest and not late:
            hashes.append(row_hash(self.rest))
        self.digits = HASH_DIGITS * len(hashes)
        own = F.concat(*hashes) if len(hashes) > 1 else hashes[0]
        quick = [self.quick.alias(QUICK)] if late else []
        self.narrow = self.rows.select(KEY, own.alias(HASH), *quick, *[quoted(c) for c in self.carried])

    def _is_wide(self) -> bool:
        payload = [c for c in self.rest if c not in self.needs]
        return sum(_BYTES.get(self.rows.schema[c].dataType.typeName(), 64) for c in payload) > LATE_BYTES

    @property
    def _as_type(self) -> str:
        return self.weight_type.simpleString()

    def _cast(self, expression: str) -> Column:
        return F.expr(f"CAST({expression} AS {self._as_type})")

    def resolve(self, points: DataFrame, largest_group: int) -> DataFrame:
        """Points (KEY, POS, TOTAL, ROWS and ids) with their row.

        POS becomes the position inside the row's own weight. ``largest_group``
        is an upper bound of ROWS; slices are only planned when it exceeds
        ``split_rows``.
        """
        ids = [c for c in points.columns if c not in (KEY, POS, TOTAL, ROWS)]
        if self.late is None:
            self.late = largest_group > self.split_rows or self._is_wide()
        self._narrow(self.late)
        found = self._located(points.withColumn(LEAF, F.expr(WHOLE)), largest_group)
        own = self._cast(f"{POS} % {WEIGHT}")
        if not self.late:
            return found.withColumn(POS, own)
        seen = Observation()
        found = self.staging.table(found.drop(LEAF).observe(seen, F.max(TIED_ROWS).alias("most")), "located")
        single = self._fetched(found.where(f"{TIED_ROWS} = 1")).withColumn(POS, own)
        most = seen.get["most"] or 0
        if most <= 1:
            return single
        tied = found.where(f"{TIED_ROWS} > 1").selectExpr(
            *[quoted(c) for c in ids], KEY, HASH, QUICK, POS, f"{TIED} AS {TOTAL}", f"{TIED_ROWS} AS {ROWS}"
        )
        return single.unionByName(self._tied(tied, most).select(*single.columns))

    # ---- narrow rows -----------------------------------------------------

    def _located(self, points: DataFrame, largest_group: int) -> DataFrame:
        """Points with the HASH they fall on, POS among its rows, TIED and TIED_ROWS."""
        if largest_group <= self.split_rows:
            return self._finish(points, self._whole(points))
        self.narrow = self.staging.table(self.narrow, "narrow")
        located, picked, large, level = [], [], points, 0
        if self.single_group is None:
            small = points.where(f"{ROWS} <= {self.split_rows}")
            located, picked = [small], [self._whole(small)]
            large = points.where(f"{ROWS} > {self.split_rows}")
        while large is not None:
            level += 1
            cut = self.staging.table(self._to_slice(large, level), f"slices{level}")
            last = (level + 1) * self.slice_digits > self.digits
            ready = cut if last else cut.where(f"NOT {CUT}")
            located.append(ready.drop(CUT))
            picked.append(self._slice_rows(ready, level))
            large = None if last else cut.where(CUT).drop(CUT)
            if large is not None and large.isEmpty():
                large = None
        return self._finish(
            reduce(DataFrame.unionByName, located),
            reduce(DataFrame.unionByName, picked),
        )

    def _drawn_groups(self, points: DataFrame) -> DataFrame:
        """Rows of the drawn groups, with TOTAL and ROWS of the group."""
        if self.single_group is None:
            drawn = points.select(F.col(KEY).alias("__group"), TOTAL, ROWS).distinct()
            return join_unique(self.narrow, F.col(KEY), drawn, "__group").drop("__group")
        total, rows = self.single_group
        return self.narrow.selectExpr(
            "*",
            f"CAST('{total}' AS {self._as_type}) AS {TOTAL}",
            f"CAST({rows} AS BIGINT) AS {ROWS}",
        )

    def _spans(self, rows: DataFrame) -> DataFrame:
        """Rows weighed, SPAN being the weight of all COPIES."""
        weighed = self.weigh(rows).withColumn(SPAN, self._cast(f"{WEIGHT} * {COPIES}"))
        return weighed.drop(*[c for c in self.needs if c != KEY]) if self.late else weighed

    def _whole(self, points: DataFrame) -> DataFrame:
        """Rows of the drawn small groups, copies included: ROWS bounds them."""
        rows = self._drawn_groups(points)
        return self._spans(rows.selectExpr("*", f"{WHOLE} AS {LEAF}", f"1L AS {COPIES}"))

    def _slice(self, level: int) -> str:
        """Slice of a hash: its leading digits."""
        return f"substring({HASH}, 1, {level * self.slice_digits})"

    def _drawn_slices(self, points: DataFrame, level: int) -> DataFrame:
        """Rows of the drawn slices, with LEAF, TOTAL and ROWS."""
        if level == 0:
            return self._drawn_groups(points).withColumn(LEAF, F.expr(WHOLE))
        drawn = points.select(KEY, LEAF, TOTAL, ROWS).distinct()
        drawn = drawn.select(F.struct(KEY, LEAF).alias("__drawn"), TOTAL, ROWS)
        rows = self.narrow.withColumn(LEAF, F.expr(self._slice(level)))
        return join_unique(rows, F.struct(KEY, LEAF), drawn, "__drawn").drop("__drawn")

    def _to_slice(self, points: DataFrame, level: int) -> DataFrame:
        """Points of large groups or slices, moved into slices of ``level``."""
        by = [KEY, LEAF, TOTAL, PARTS, "__slice"]
        parts = f"least({ROWS}, {16**self.slice_digits}L) AS {PARTS}"
        # A BIGINT image of the hash keeps min and max in hash aggregation.
        rows = self._drawn_slices(points, level - 1).selectExpr(
            "*", f"{self._slice(level)} AS __slice", parts, f"xxhash64({HASH}) AS __image"
        )
        if not self.joins:
            rows = rows.selectExpr(
                "*", f"1L AS {COPIES}", "__image AS __min", "__image AS __max"
            )
        else:  # counted first, because weighing may shuffle on these columns
            rows = rows.groupBy(*by, *[quoted(c) for c in self.needs]).agg(
                F.count(F.lit(1)).alias(COPIES),
                F.min("__image").alias("__min"),
                F.max("__image").alias("__max"),
            )
        slices = (
            self.weigh(rows)
            .groupBy(*by)
            .agg(
                F.expr(f"CAST(sum({WEIGHT} * {COPIES}) AS {self._as_type}) AS __slice_total"),
                F.sum(COPIES).alias("__slice_rows"),
                (F.min("__min") < F.max("__max")).alias("__mixed"),
            )
        )
        intervals = with_intervals(
            slices, [KEY, LEAF], [F.asc("__slice")], "__slice_total"
        )
        found = locate(points.selectExpr("*", parts), intervals, [KEY, LEAF])
        ids = set(points.columns) - {KEY, LEAF, POS, TOTAL, ROWS}
        return found.selectExpr(
            *[quoted(c) for c in points.columns if c in ids],
            KEY,
            f"__slice AS {LEAF}",
            f"{POS} - {LOW} AS {POS}",
            f"__slice_total AS {TOTAL}",
            f"__slice_rows AS {ROWS}",
            f"__mixed AND __slice_rows > {self.split_rows} AS {CUT}",
        )

    def _slice_rows(self, points: DataFrame, level: int) -> DataFrame:
        """Rows of the drawn slices, each hash once with its count."""
        by = [KEY, LEAF, TOTAL, ROWS, HASH, *([QUICK] if self.late else [])]
        rows = self._drawn_slices(points, level).groupBy(*by, *[quoted(c) for c in self.carried])
        spans = self._spans(rows.agg(F.count(F.lit(1)).alias(COPIES)))
        if not self.late:  # equal hashes are equal rows
            return spans
        span = self._cast(f"sum({SPAN})").alias(SPAN)
        others = [F.first(c).alias(c) for c in spans.columns if c not in (*by, SPAN, COPIES)]  # used where a hash has one row
        return spans.groupBy(*by).agg(span, F.sum(COPIES).alias(COPIES), *others)

    def _finish(self, points: DataFrame, spans: DataFrame) -> DataFrame:
        # ROWS of a slice includes copies, so the grid is capped: one repeated
        # row must not spread over one cell per copy.
        parts = F.expr(f"least({ROWS}, CAST({self.split_rows} AS BIGINT))")
        by = [KEY, LEAF]
        intervals = with_intervals(spans.withColumn(PARTS, parts), by, [F.asc(HASH)], SPAN)
        if self.late:  # all rows of a hash are one interval; the window's order serves here too
            tied = Window.partitionBy(*by, HASH)
            whole = {LOW: F.min(LOW), LAST: F.max(LAST), TIED: F.sum(SPAN), TIED_ROWS: F.sum(COPIES)}
            intervals = intervals.withColumns(
                {c: e.over(tied) for c, e in whole.items()} | {"__nth": F.row_number().over(tied.orderBy(HASH))}
            )
            intervals = intervals.where("__nth = 1").drop("__nth")
        intervals = intervals.drop("__end", ROWS, COPIES, SPAN)
        found = locate(points.withColumn(PARTS, parts), intervals, by).withColumn(POS, self._cast(f"{POS} - {LOW}"))
        return found.withColumn(TIED, self._cast(TIED)) if self.late else found

    # ---- whole rows ------------------------------------------------------

    def _fetched(self, points: DataFrame) -> DataFrame:
        """Points on single rows with the columns of these."""
        rows = self.rows.withColumnsRenamed({KEY: "__of"}).withColumn("__own", self.quick)
        # BETWEEN keeps the long hash out of the join keys: it is computed for rows that met
        same = row_hash(self.order_cols).between(F.col(HASH), F.col(HASH))
        met = points.join(rows, (F.col(KEY) == F.col("__of")) & (F.col(QUICK) == F.col("__own")) & same)
        return met.drop("__of", "__own", HASH, QUICK, TIED, TIED_ROWS)

    def _tied(self, points: DataFrame, most: int) -> DataFrame:
        """Points on rows that share their order columns, in groups (KEY, HASH)."""
        drawn = points.select(F.struct(KEY, QUICK).alias("__drawn")).distinct()
        rows = self.rows.withColumn(QUICK, self.quick)
        rows = join_unique(rows, F.struct(KEY, QUICK), drawn, "__drawn").drop("__drawn", QUICK)
        rows = rows.withColumn(KEY, F.struct(KEY, row_hash(self.order_cols).alias(HASH)))
        lookup = RowLookup(
            rows,
            self.rest or self.columns,
            self.weigh,
            self.needs,
            self.joins,
            self.staging,
            self.weight_type,
            self.split_rows,
            self.slice_digits,
            late=False,
        )
        points = points.withColumn(KEY, F.struct(KEY, HASH)).drop(HASH, QUICK)
        return lookup.resolve(points, most).withColumn(KEY, F.col(f"{KEY}.{KEY}"))
