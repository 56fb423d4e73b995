"""Chain joins: counting and sampling their results without computing them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.functions import common_type, draw_position, half_up, to_share
from lotwise.operators.lookup import BIGINT, SLICE_DIGITS, SPLIT_ROWS, WIDE, RowLookup
from lotwise.operators.names import (
    KEY,
    POS,
    ROWS,
    SITE,
    TOTAL,
    WEIGHT,
    check_user_columns,
    output_columns,
)
from lotwise.operators.residues import from_residues, primes_above, residue_columns, summed
from lotwise.operators.sampling import sample_per_key, weighted_sample
from lotwise.operators.skew import join_unique
from lotwise.operators.weights import (
    attach_weight,
    inner_memo,
    leaf_memo,
    root_memo,
)
from lotwise.sources.tables import read_table
from lotwise.staging import Staging

DRAW = "__draw"


@dataclass(frozen=True)
class TableSpec:
    """One table of a query.

    ``order_cols`` name the columns that tell rows apart (all by default); a
    short unique key saves reading the rest when a large group is sliced.
    ``site_col`` names the column holding the site of a row.
    """

    name: str
    df: DataFrame
    order_cols: Sequence[str] | None = None
    site_col: str | None = None

    @classmethod
    def load(
        cls,
        spark: SparkSession,
        name: str,
        path: str,
        fmt: str = "parquet",
        schema: T.StructType | None = None,
        csv_options: dict | None = None,
        **options,
    ) -> TableSpec:
        return cls(name, read_table(spark, path, fmt, schema, **(csv_options or {})), **options)

    @property
    def order(self) -> list[str]:
        return list(self.order_cols or self.df.columns)

    def validate(self) -> None:
        check_user_columns(self.df.columns)
        named = [*self.order, *([self.site_col] if self.site_col else [])]
        missing = [c for c in named if c not in self.df.columns]
        if missing:
            raise ValueError(f"table {self.name!r} has no column {missing}")
        maps = [f.name for f in self.df.schema if isinstance(f.dataType, T.MapType)]
        if maps:
            raise ValueError(f"map columns cannot be ordered, drop {maps} first")


def key_type(left: TableSpec, left_col: str, right: TableSpec, right_col: str):
    """The type both sides of an edge are compared in."""
    for table, column in ((left, left_col), (right, right_col)):
        if column not in table.df.columns:
            raise ValueError(f"table {table.name!r} has no column {column!r}")
    return common_type(left.df.schema[left_col].dataType, right.df.schema[right_col].dataType)


@dataclass
class ChainJoin:
    """``tables[0] JOIN tables[1] ON src = dst JOIN tables[2] ...``

    ``edges[i]`` is ``(src_col of tables[i], dst_col of tables[i + 1])``. Tables
    are told apart by position, so a table may occur twice. Weights are BIGINT;
    a chain with more results needs ``wide=True`` (DECIMAL(38,0)), otherwise
    Spark raises an overflow error.

    Nothing runs until a frame is used, except that sampling stages the memos
    and the draws in the shared folder. ``release`` deletes them.
    """

    tables: Sequence[TableSpec]
    edges: Sequence[tuple[str, str]]
    wide: bool = False
    split_rows: int = SPLIT_ROWS
    slice_digits: int = SLICE_DIGITS
    _types: list = field(init=False, repr=False)
    _staged: dict = field(init=False, repr=False, default_factory=dict)
    _samples: dict = field(init=False, repr=False, default_factory=dict)
    _staging: Staging | None = field(init=False, repr=False, default=None)
    _facts: list | None = field(init=False, repr=False, default=None)

    def __post_init__(self):
        if len(self.tables) < 2:
            raise ValueError("a chain needs two tables; use weighted_sample for one")
        if len(self.edges) != len(self.tables) - 1:
            raise ValueError("a chain of k tables has k - 1 edges")
        for table in self.tables:
            table.validate()
        self._types = [
            key_type(self.tables[i], src, self.tables[i + 1], dst)
            for i, (src, dst) in enumerate(self.edges)
        ]

    # ---- description -----------------------------------------------------

    @property
    def last(self) -> int:
        return len(self.tables) - 1

    def incoming(self, i: int) -> str | None:
        """Column of table ``i`` that the table before is joined to."""
        return self.edges[i - 1][1] if i > 0 else None

    def outgoing(self, i: int) -> str | None:
        """Column of table ``i`` that the table after is joined to."""
        return self.edges[i][0] if i < self.last else None

    def _first_column(self, i: int) -> str:
        return self.incoming(i) or self.outgoing(i)

    @property
    def spark(self) -> SparkSession:
        return self.tables[0].df.sparkSession

    @property
    def staging(self) -> Staging:
        if self._staging is None:
            self._staging = Staging(self.spark)
        return self._staging

    @property
    def _weight_type(self):
        return WIDE if self.wide else BIGINT

    def release(self) -> None:
        """Delete staged tables. Frames returned by sampling end with them."""
        if self._staging is not None:
            self._staging.release()
        self._staging, self._facts = None, None
        self._staged.clear()
        self._samples.clear()

    # ---- backward pass ---------------------------------------------------

    def _site(self, i: int) -> Column:
        site_col = self.tables[i].site_col
        if site_col is None:
            raise ValueError(f"table {self.tables[i].name!r} has no site column")
        return F.col(site_col).alias(SITE)

    def _memo(self, i: int, by_site: bool = False) -> DataFrame:
        if not by_site and i in self._staged:
            return self._staged[i]
        extra = [self._site(i)] if by_site else []
        df = self.tables[i].df
        if by_site:
            columns = [c for c in (self.incoming(i), self.outgoing(i)) if c]
            df = df.select(*dict.fromkeys(columns), *extra)
            extra = [SITE]
        if i == self.last:
            return leaf_memo(
                df, self.edges[-1][1], self._types[-1], self._weight_type, extra
            )
        following = self._memo(i + 1)
        src, next_type = self.edges[i][0], self._types[i]
        if i == 0:
            return root_memo(df, src, next_type, following, self._weight_type, extra)
        return inner_memo(
            df,
            self.edges[i - 1][1],
            self._types[i - 1],
            src,
            next_type,
            following,
            self._weight_type,
            extra,
        )

    def memo(self, i: int, by_site: bool = False) -> DataFrame:
        """``(key, count)``: join results starting at each key of table ``i``.

        The key is the incoming join column, for the first table its outgoing
        one. ``by_site`` splits the counts by the site of the row.
        """
        sites = [SITE] if by_site else []
        return self._memo(i, by_site).select(
            F.col(KEY).alias("key"), F.col(TOTAL).alias("count"), *sites
        )

    def weights(self, i: int, name: str = "weight") -> DataFrame:
        """Table ``i`` with its weights; rows without a join result are gone."""
        table = self.tables[i].df
        if name in table.columns:
            raise ValueError(f"table {self.tables[i].name!r} has a column {name!r}")
        return self._weigh(i)(table).select(*table.columns, F.col(WEIGHT).alias(name))

    def _weigh(self, i: int):
        if i == self.last:
            return lambda df: df.withColumn(WEIGHT, F.lit(1).cast(self._weight_type))
        memo, src, next_type = self._memo(i + 1), self.edges[i][0], self._types[i]
        return lambda df: attach_weight(df, src, next_type, memo)

    def cardinality(self, by_site: bool = False, by_key: bool = False) -> DataFrame:
        """Exact number of join results, without joining.

        One row, or one per site or join key of the first table.
        """
        if by_site and by_key:
            raise ValueError("choose by_site or by_key")
        memo = self._memo(0, by_site)
        if by_key:
            return memo.select(F.col(KEY).alias("key"), F.col(TOTAL).alias("cardinality"))
        total = F.sum(TOTAL).cast(self._weight_type).alias("cardinality")
        if by_site:
            return memo.groupBy(SITE).agg(total)
        return memo.agg(total).select(
            F.coalesce("cardinality", F.lit(0).cast(self._weight_type)).alias(
                "cardinality"
            )
        )

    def cardinality_exact(self) -> int:
        """The number of join results, of any size, as a Python whole number.

        Counts travel as residues modulo primes whose product exceeds the product
        of all row counts. The driver gets a row of residues and a count per table.
        """
        sizes = [table.df.count() for table in self.tables]
        primes = primes_above(prod(sizes))
        following = None
        for i in range(self.last, -1, -1):
            table, key = self.tables[i].df, self._first_column(i)
            key_type = self._types[max(i - 1, 0)]
            if following is None:
                counted = leaf_memo(table, key, key_type, BIGINT)
                following = counted.select(KEY, *residue_columns(F.col(ROWS), primes))
                continue
            known = following.withColumnRenamed(KEY, "__next_key")
            if i == 0:  # rows of one value weigh alike, so they are counted first
                rows = leaf_memo(table, key, key_type, BIGINT).drop(TOTAL)
                rows = rows.join(known, F.col(KEY) == F.col("__next_key"))
                following = summed(rows, [], primes, times=ROWS)
                continue
            rows = table.select(F.col(key).cast(key_type).alias(KEY), F.col(self.outgoing(i)).cast(self._types[i]).alias("__next"))
            rows = rows.where(F.col(KEY).isNotNull()).groupBy(KEY, "__next").agg(F.count(F.lit(1)).alias(ROWS))
            rows = join_unique(rows, F.col("__next"), known, "__next_key")
            following = summed(rows, [KEY], primes, times=ROWS)
        found = following.first()
        return from_residues([found[f"__r{i}"] or 0 for i in range(len(primes))], primes)

    def full_join(self) -> DataFrame:
        """The join itself, for comparison; columns as in ``sample``."""
        sides = [
            table.df.select(
                *[F.col(c).alias(f"__{i}_{c}") for c in table.df.columns]
            )
            for i, table in enumerate(self.tables)
        ]
        joined = sides[0]
        for i, (src, dst) in enumerate(self.edges):
            left, right = f"__{i}_{src}", f"__{i + 1}_{dst}"
            on = F.col(left).cast(self._types[i]) == F.col(right).cast(self._types[i])
            joined = joined.join(sides[i + 1], on)
        return joined.select(
            *[
                F.col(f"__{i}_{c}").alias(name)
                for i, columns in enumerate(self._output_names())
                for c, name in columns.items()
            ]
        )

    def _output_names(self) -> list[dict[str, str]]:
        return output_columns(self.tables)

    # ---- forward pass ----------------------------------------------------

    def _stage_memos(self) -> list:
        """Stage memos last to first; (largest group, groups, total) of each."""
        if self._facts is None:
            for i in range(self.last, -1, -1):
                self._staged[i] = self.staging.table(self._memo(i), f"memo{i}")
            facts = reduce(
                DataFrame.unionAll,
                [
                    self._staged[i].agg(
                        F.lit(i).alias("i"),
                        F.max(ROWS).alias("largest"),
                        F.count(F.lit(1)).alias("groups"),
                        F.sum(TOTAL).cast(WIDE).alias("total"),
                    )
                    for i in range(len(self.tables))
                ],
            )
            self._facts = sorted(facts.collect())  # one row per table
        return self._facts

    def draws(self, n: int, seed: int, tables: int | None = None) -> list[DataFrame]:
        """Staged samples of the first ``tables`` tables (all by default).

        ``__draw`` tells draws apart. Later tables are drawn when first asked for.
        """
        if n < 0:
            raise ValueError("n must not be negative")
        tables = len(self.tables) if tables is None else tables
        steps = self._samples.setdefault((n, seed), [])
        while len(steps) < tables:
            i = len(steps)
            points = steps[-1][1] if steps else self._first_points(n, seed)
            steps.append(self._draw(i, points) if points is not None else (self._no_draws(i), None))
        return [sample for sample, _ in steps[:tables]]

    def _no_draws(self, i: int) -> DataFrame:
        fields = [T.StructField(DRAW, BIGINT), *self.tables[i].df.schema]
        return self.spark.createDataFrame([], T.StructType(fields))

    def _first_points(self, n: int, seed: int) -> DataFrame | None:
        first = self._stage_memos()[0]
        total = int(first["total"] or 0)
        return self._first_keys(n, seed, total, first["groups"]) if n and total else None

    def _draw(self, i: int, points: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """The sample of table ``i`` for its points, and the points of the next."""
        table, following = self.tables[i], []
        lookup = RowLookup(
            table.df.withColumn(KEY, F.col(self._first_column(i)).cast(self._types[max(i - 1, 0)])),
            table.order,
            self._weigh(i),
            [self.outgoing(i)] if i < self.last else [],
            i < self.last,
            self.staging,
            self._weight_type,
            self.split_rows,
            self.slice_digits,
        )
        found = lookup.resolve(points, self._stage_memos()[i]["largest"])
        if i < self.last:
            following = [
                F.col("__next_key").alias(KEY),
                POS,
                F.col(WEIGHT).alias(TOTAL),
                F.col("__next_rows").alias(ROWS),
            ]
        columns = [DRAW, *table.df.columns]
        found = found.select(*columns, *following).sortWithinPartitions(DRAW)
        staged = self.staging.table(found, f"sample{i}")
        return staged.select(*columns), staged.select(DRAW, KEY, POS, TOTAL, ROWS) if following else None

    def _first_keys(self, n: int, seed: int, total: int, groups: int) -> DataFrame:
        """Draw a rank in ``[0, total)`` and find the first table's key holding it."""
        whole = F.lit(str(total)).cast(WIDE)
        points = self.spark.range(n).select(
            F.col("id").alias(DRAW),
            F.lit(0).alias(KEY),
            draw_position(
                seed, ["id"], f"'{total}'", self._weight_type.simpleString()
            ).alias(POS),
            whole.cast(self._weight_type).alias(TOTAL),
            F.lit(groups).cast("bigint").alias(ROWS),
        )
        keys = self._staged[0].select(
            F.lit(0).alias(KEY),
            F.col(KEY).alias("__first_key"),
            F.col(TOTAL).alias("__key_total"),
            F.col(ROWS).alias("__key_rows"),
        )
        lookup = RowLookup(
            keys,
            ["__first_key"],
            lambda df: df.withColumn(WEIGHT, F.col("__key_total")),
            ["__key_total"],
            False,
            self.staging,
            self._weight_type,
            self.split_rows,
            self.slice_digits,
            single_group=(total, groups),
            late=False,
        )
        found = lookup.resolve(points, groups)
        return self.staging.table(
            found.select(
                DRAW,
                F.col("__first_key").alias(KEY),
                POS,
                F.col("__key_total").alias(TOTAL),
                F.col("__key_rows").alias(ROWS),
            ),
            "first_keys",
        )

    def sample(self, n: int, seed: int) -> DataFrame:
        """``n`` independent uniform draws from the join: ``draw_id`` and its columns."""
        names = self._output_names()
        renamed = [
            df.select(DRAW, *[F.col(c).alias(name) for c, name in columns.items()])
            for df, columns in zip(self.draws(n, seed), names)
        ]
        joined = reduce(lambda left, right: left.join(right, DRAW), renamed)
        return joined.withColumnRenamed(DRAW, "draw_id")

    def sample_table(self, i: int, n: int, seed: int) -> DataFrame:
        """The draws' rows of table ``i``, with repeats."""
        return self.draws(n, seed, i + 1)[i].drop(DRAW)

    def sample_tables(self, n: int, seed: int, ordered: bool = True) -> list[DataFrame]:
        """One sample per table, each sorted by its first join column."""
        frames = self.draws(n, seed)
        if ordered:  # by draw as well, or all draws of a hot key sort in one task
            frames = [df.orderBy(self._first_column(i), DRAW) for i, df in enumerate(frames)]
        return [df.drop(DRAW) for df in frames]

    def key_counts(self, i: int, n: int, seed: int) -> DataFrame:
        """``(key, count)`` the sample of table ``i`` hands to the next table."""
        column = self.outgoing(i) or self.incoming(i)
        sample = self.draws(n, seed, i + 1)[i]
        return sample.groupBy(F.col(column).alias("key")).agg(
            F.count(F.lit(1)).alias("count")
        )

    # ---- allocation ------------------------------------------------------

    def allocate(self, n: int, mode: str = "drawn", seed: int = 0) -> DataFrame:
        """``(site, count)``: how many of ``n`` draws start at each site.

        ``proportional`` rounds each site's share, so the counts may not add up
        to ``n`` and small sites may get none; ``drawn`` counts the real draws;
        ``memo`` draws sites by their totals, so no table row is looked up. Its
        counts have the distribution of ``drawn`` but are other draws.
        """
        if mode == "proportional":
            by_site = self.cardinality(by_site=True)
            total = by_site.agg(F.sum("cardinality").alias("total")).scalar()
            share = to_share(F.col("cardinality"), total)
            return by_site.select(SITE, half_up(share * F.lit(float(n))).alias("count"))
        if mode == "drawn":
            return self._count_by(0, n, seed, [self._site(0)])
        if mode == "memo":
            by_site = self.staging.table(self.cardinality(by_site=True), "site_totals")
            drawn = weighted_sample(by_site, "cardinality", n, seed, [SITE], self.wide, staging=self.staging)
            return drawn.groupBy(SITE).agg(F.count(F.lit(1)).alias("count"))
        raise ValueError(f"unknown mode {mode!r}")

    def allocate_keys(self, i: int, n: int, seed: int, mode: str = "drawn") -> DataFrame:
        """``(site, key, count)``: draws per site and incoming key of table ``i``.

        ``drawn`` counts the real draws; ``memo`` shares the draws that reach each key
        out over its sites by the table's memo, so no row of table ``i`` is looked up.
        """
        if mode == "memo":
            memo = self.staging.table(self.memo(i, by_site=True), f"site_memo{i}")
            if i == 0:
                drawn = weighted_sample(memo, "count", n, seed, [SITE, "key"], self.wide, staging=self.staging)
            else:
                wanted = self.key_counts(i - 1, n, seed)
                drawn = sample_per_key(memo, "key", wanted, seed, "count", [SITE], self.wide, staging=self.staging)
            return drawn.groupBy(SITE, "key").agg(F.count(F.lit(1)).alias("count"))
        if mode != "drawn":
            raise ValueError(f"unknown mode {mode!r}")
        key = F.col(self._first_column(i)).alias("key")
        return self._count_by(i, n, seed, [self._site(i), key])

    def _count_by(self, i: int, n: int, seed: int, by: list[Column]) -> DataFrame:
        return self.draws(n, seed, i + 1)[i].groupBy(*by).agg(
            F.count(F.lit(1)).alias("count")
        )

    def requested_and_collected(self, n: int, seed: int) -> DataFrame:
        """Per site of the first table: proportional request, rows drawn."""
        collected = self.allocate(n, "drawn", seed).withColumnRenamed(
            "count", "collected"
        )
        requested = self.allocate(n, "proportional").withColumnRenamed(
            "count", "requested"
        )
        return requested.join(collected, SITE, "left").fillna(0, ["collected"])
