"""Acyclic joins whose join graph is a tree."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.functions import draw_position, quoted
from lotwise.operators.lookup import SLICE_DIGITS, SPLIT_ROWS, RowLookup
from lotwise.operators.names import KEY, POS, ROWS, TOTAL, WEIGHT, output_columns
from lotwise.operators.skew import join_unique
from lotwise.operators.weights import leaf_memo
from lotwise.plans.chain import BIGINT, DRAW, WIDE, TableSpec, key_type
from lotwise.staging import Staging


@dataclass
class TreeJoin:
    """Tables joined along ``edges`` of ``(parent, parent_col, child, child_col)``.

    Table 0 is the root and every other table is the child of exactly one edge.
    A row's weight is the product of its children's memos. A draw descends along
    all branches: its position inside a row's weight is a number in mixed radix, one
    digit per child, the first child's the highest, and a digit is the position in
    the group of rows that this child's key leads to.
    """

    tables: Sequence[TableSpec]
    edges: Sequence[tuple[int, str, int, str]]
    wide: bool = False
    split_rows: int = SPLIT_ROWS
    slice_digits: int = SLICE_DIGITS
    _children: dict = field(init=False, repr=False, default_factory=dict)
    _parent: dict = field(init=False, repr=False, default_factory=dict)
    _staged: dict = field(init=False, repr=False, default_factory=dict)
    _staging: Staging | None = field(init=False, repr=False, default=None)

    def __post_init__(self):
        for table in self.tables:
            table.validate()
        for parent, parent_col, child, child_col in self.edges:
            if child in self._parent or child == 0:
                raise ValueError(f"table {child} has more than one parent")
            joined_as = key_type(
                self.tables[parent], parent_col, self.tables[child], child_col
            )
            self._parent[child] = (child_col, joined_as)
            self._children.setdefault(parent, []).append((parent_col, child, joined_as))
        reached = self._reachable(0)
        if reached != set(range(len(self.tables))):
            raise ValueError("every table must be reachable from table 0")

    def _reachable(self, i: int) -> set[int]:
        below = [self._reachable(c) for _, c, _ in self._children.get(i, [])]
        return {i}.union(*below)

    @property
    def _weight_type(self):
        return WIDE if self.wide else BIGINT

    def _memo(self, i: int) -> DataFrame:
        if i in self._staged:
            return self._staged[i]
        column, joined_as = self._parent[i]
        if i not in self._children:
            return leaf_memo(
                self.tables[i].df, column, joined_as, self._weight_type
            )
        rows = self._weighed(i, [column]).where(F.col(column).isNotNull())
        return rows.groupBy(F.col(column).cast(joined_as).alias(KEY)).agg(
            F.sum(WEIGHT).cast(self._weight_type).alias(TOTAL),
            F.count(F.lit(1)).alias(ROWS),
        )

    def _weighed(self, i: int, columns: Sequence[str]) -> DataFrame:
        children = self._children.get(i, [])
        own = list(dict.fromkeys([*columns, *[c for c, _, _ in children]]))
        rows = self.tables[i].df.select(*own)
        weight = F.lit(1).cast(self._weight_type)
        for number, (column, joined_as) in enumerate(self._join_columns(i)):
            key, part = f"__key_{number}", f"__part_{number}"
            memo = self._product(i, column, joined_as).toDF(key, part)
            rows = join_unique(rows, F.col(column).cast(joined_as), memo, key)
            weight = (weight * F.col(part)).cast(self._weight_type)
        return rows.select(*columns, weight.alias(WEIGHT))

    def _join_columns(self, i: int) -> list[tuple]:
        pairs = [(c, t) for c, _, t in self._children.get(i, [])]
        return [p for n, p in enumerate(pairs) if p not in pairs[:n]]

    def _product(self, i: int, column: str, joined_as) -> DataFrame:
        """``(key, total)``: product of the memos of all children joined on ``column``."""
        product = None
        for own_column, child, own_type in self._children[i]:
            if (own_column, own_type) != (column, joined_as):
                continue
            memo = self._memo(child).select(KEY, TOTAL)
            if product is not None:
                both = (F.col("__first") * F.col(TOTAL)).cast(self._weight_type)
                memo = product.toDF(KEY, "__first").join(memo, KEY)
                memo = memo.select(KEY, both.alias(TOTAL))
            product = memo
        return product

    def weights(self) -> DataFrame:
        """The root table with ``weight``; rows without a join result are gone."""
        columns = self.tables[0].df.columns
        return self._weighed(0, columns).withColumnRenamed(WEIGHT, "weight")

    def cardinality(self) -> DataFrame:
        """One row: the exact number of join results."""
        zero = F.lit(0).cast(self._weight_type)
        total = F.coalesce(F.sum(WEIGHT), zero).cast(self._weight_type)
        return self._weighed(0, []).agg(total.alias("cardinality"))

    # ---- sampling --------------------------------------------------------

    @property
    def staging(self) -> Staging:
        if self._staging is None:
            self._staging = Staging(self.tables[0].df.sparkSession)
        return self._staging

    def release(self) -> None:
        """Delete staged tables. Frames returned by sampling end with them."""
        if self._staging is not None:
            self._staging.release()
        self._staging = None
        self._staged.clear()

    def _below(self, i: int) -> list[int]:
        """Tables under table ``i``, children before their parents."""
        return [t for _, c, _ in self._children.get(i, []) for t in [*self._below(c), c]]

    def _weigh(self, i: int):
        """Adds WEIGHT, and key, total and rows of the group that each child is drawn from."""
        children = self._children.get(i, [])

        def weigh(df: DataFrame) -> DataFrame:
            weight = F.lit(1).cast(self._weight_type)
            for column, child, joined_as in children:
                key, total, rows = _group_of(child)
                memo = self._memo(child).select(F.col(KEY).alias(key), F.col(TOTAL).alias(total), F.col(ROWS).alias(rows))
                df = join_unique(df, F.col(quoted(column)).cast(joined_as), memo, key)
                weight = (weight * F.col(total)).cast(self._weight_type)
            return df.withColumn(WEIGHT, weight)

        return weigh

    def _digit(self, i: int, number: int) -> str:
        """SQL text: the digit of child ``number`` in POS."""
        children = [_group_of(c)[1] for _, c, _ in self._children[i]]
        radix, lower = children[number], " * ".join(children[number + 1 :])
        if not lower:
            return f"{POS} % {radix}"
        if not self.wide:
            return f"({POS} DIV ({lower})) % {radix}"
        return f"CAST(({POS} - {POS} % ({lower})) / ({lower}) AS DECIMAL(38,0)) % {radix}"

    def _draw(self, i: int, points: DataFrame, largest: int, single_group=None) -> DataFrame:
        """Staged rows of table ``i`` for its points, with DRAW, and those of all tables below."""
        table, children = self.tables[i], self._children.get(i, [])
        if i == 0:
            rows = table.df.withColumn(KEY, F.lit(0))
        else:
            column, joined_as = self._parent[i]
            rows = table.df.withColumn(KEY, F.col(quoted(column)).cast(joined_as))
        lookup = RowLookup(
            rows,
            table.order,
            self._weigh(i),
            list(dict.fromkeys(c for c, _, _ in children)),
            bool(children),
            self.staging,
            self._weight_type,
            self.split_rows,
            self.slice_digits,
            single_group,
        )
        found = lookup.resolve(points, largest)
        named = [F.col(quoted(c)).alias(f"__{i}_{c}") for c in table.df.columns]
        groups = [c for _, child, _ in children for c in _group_of(child)]
        staged = self.staging.table(found.select(DRAW, POS, *named, *groups), f"sample{i}")
        joined = staged.drop(POS, *groups)
        for number, (_, child, _) in enumerate(children):
            key, total, group_rows = _group_of(child)
            digit = f"CAST({self._digit(i, number)} AS {self._weight_type.simpleString()})"
            below = staged.selectExpr(DRAW, f"{key} AS {KEY}", f"{digit} AS {POS}", f"{total} AS {TOTAL}", f"{group_rows} AS {ROWS}")
            most = self._staged[child].agg(F.max(ROWS)).first()[0]
            joined = joined.join(self._draw(child, below, most), DRAW)
        return joined

    def sample(self, n: int, seed: int) -> DataFrame:
        """``n`` independent uniform draws from the join: ``draw_id`` and its columns.

        An empty join gives no rows. With ``wide`` the products of children's totals
        may have 32 digits.
        """
        if n < 0:
            raise ValueError("n must not be negative")
        names = output_columns(self.tables)
        spark = self.tables[0].df.sparkSession
        for i in self._below(0):
            if i not in self._staged:
                self._staged[i] = self.staging.table(self._memo(i), f"memo{i}")
        whole = self._weighed(0, []).agg(F.sum(F.col(WEIGHT).cast(WIDE)), F.count(F.lit(1))).first()
        total, rows = int(whole[0] or 0), whole[1]
        columns = [F.col(f"__{i}_{c}").alias(name) for i, own in enumerate(names) for c, name in own.items()]
        if not n or not total:
            fields = [(f"__{i}_{c}", t.df.schema[c].dataType) for i, t in enumerate(self.tables) for c in t.df.columns]
            schema = T.StructType([T.StructField(DRAW, BIGINT), *[T.StructField(c, kind) for c, kind in fields]])
            return spark.createDataFrame([], schema).select(F.col(DRAW).alias("draw_id"), *columns)
        as_type = self._weight_type.simpleString()
        points = spark.range(n).select(
            F.col("id").alias(DRAW),
            F.lit(0).alias(KEY),
            draw_position(seed, ["id"], f"'{total}'", as_type).alias(POS),
            F.lit(str(total)).cast(WIDE).cast(self._weight_type).alias(TOTAL),
            F.lit(rows).cast("bigint").alias(ROWS),
        )
        found = self._draw(0, points, rows, (total, rows))
        return found.select(F.col(DRAW).alias("draw_id"), *columns)


def _group_of(child: int) -> tuple[str, str, str]:
    """Work columns for the group a child is drawn from: key, total, rows."""
    return f"__key_{child}", f"__total_{child}", f"__rows_{child}"
