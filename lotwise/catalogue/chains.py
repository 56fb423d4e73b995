"""The chains the registered queries use, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.plans import ChainJoin, TableSpec, TreeJoin

DRAWS = 2000
SEED = 42
SITES = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def site_of(column: str):
    return F.concat(F.lit("s"), (F.col(column) % SITES).cast("string"))


def site_sql(column: str) -> str:
    return f"concat('s', {column} % {SITES})"


@dataclass(frozen=True)
class Member:
    """A table of a chain: its ordering columns, the first of which gives the site."""

    table: str
    columns: Sequence[str]
    alias: str | None = None
    payload: Sequence[str] = ()

    @property
    def name(self) -> str:
        return self.alias or self.table

    @property
    def site(self) -> str:
        return f"{self.name}_site"

    @property
    def carried(self) -> list[str]:
        return [*self.columns, *self.payload]

    def output(self, column: str) -> str:
        return f"{self.alias}_{column}" if self.alias else column

    def spec(self, spark: SparkSession, sf_dir: str) -> TableSpec:
        df = table(spark, sf_dir, self.table).select(
            *self.columns, *self.payload, site_of(self.columns[0]).alias(self.site)
        )
        return TableSpec(self.name, df, self.columns, self.site)

    def sql(self) -> str:
        return (
            f"SELECT {', '.join(self.carried)}, {site_sql(self.columns[0])} AS "
            f"{self.site}, row_number() OVER () AS rid FROM {self.table}"
        )


@dataclass(frozen=True)
class ChainCase:
    members: Sequence[Member]
    edges: Sequence[tuple[str, str]]

    def build(self, spark: SparkSession, sf_dir: str, **options) -> ChainJoin:
        specs = [m.spec(spark, sf_dir) for m in self.members]
        return ChainJoin(specs, self.edges, **options)

    # ---- SQL: everything below is derived from the real join ---------------

    def join_sql(self, start: int = 0) -> str:
        """FROM clause of the real join of the tables from ``start`` on."""
        sql = f"({self.members[start].sql()}) t{start}"
        for i in range(start, len(self.edges)):
            src, dst = self.edges[i]
            member = self.members[i + 1].sql()
            sql += f" JOIN ({member}) t{i + 1} ON t{i}.{src} = t{i + 1}.{dst}"
        return sql

    def columns_sql(self, i: int, site: bool = True) -> str:
        m = self.members[i]
        named = [f"t{i}.{c} AS {m.output(c)}" for c in m.carried]
        return ", ".join([*named, *([f"t{i}.{m.site} AS {m.site}"] if site else [])])

    def output(self, i: int) -> str:
        m = self.members[i]
        return ", ".join([*[m.output(c) for c in m.carried], m.site])

    def memo_sql(self, i: int, by_site: bool = False) -> str:
        key = self.edges[0][0] if i == 0 else self.edges[i - 1][1]
        site = f", t{i}.{self.members[i].site} AS site" if by_site else ""
        by = f"t{i}.{key}" + (f", t{i}.{self.members[i].site}" if by_site else "")
        return (
            f"SELECT t{i}.{key} AS key, count(*)::BIGINT AS count{site} "
            f"FROM {self.join_sql(i)} WHERE t{i}.{key} IS NOT NULL GROUP BY {by}"
        )

    def weights_sql(self, i: int) -> str:
        m = self.members[i]
        by = ", ".join(f"t{i}.{c}" for c in [*m.carried, m.site, "rid"])
        return (
            f"SELECT {self.columns_sql(i)}, count(*)::BIGINT AS weight "
            f"FROM {self.join_sql(i)} GROUP BY {by}"
        )

    def numbered_sql(self, n: int = DRAWS, seed: int = SEED) -> str:
        """CTEs ``j`` (join results with rank ``rk``) and ``s`` (the draws' results)."""
        src = self.edges[0][0]
        order = [row_hash_sql([f"t0.{src}"]), f"t0.{src}"]
        for i, m in enumerate(self.members):
            columns = [f"t{i}.{c}" for c in m.columns]
            rest = [f"t{i}.{c}" for c in [*m.payload, m.site]]
            order += [row_hash_sql(columns), row_hash_sql(rest), *columns]
            order += [f"t{i}.{c}" for c in [*m.payload, "rid"]]
        out = ", ".join(self.columns_sql(i) for i in range(len(self.members)))
        return (
            f"WITH j AS (SELECT {out}, row_number() OVER (ORDER BY "
            f"{', '.join(f'{o} ASC NULLS FIRST' for o in order)}) - 1 AS rk "
            f"FROM {self.join_sql()}), "
            f"d AS (SELECT range AS draw_id, {draw_hash_sql(seed, 'range')} "
            f"% (SELECT count(*) FROM j) AS rk FROM range({n})), "
            f"s AS (SELECT * FROM d JOIN j USING (rk)) "
        )


@dataclass(frozen=True)
class TreeCase:
    """Tables in pre-order; ``edges`` are (parent, its column, child, its column)."""

    members: Sequence[Member]
    edges: Sequence[tuple[int, str, int, str]]

    def build(self, spark: SparkSession, sf_dir: str, **options) -> TreeJoin:
        return TreeJoin([m.spec(spark, sf_dir) for m in self.members], self.edges, **options)

    def sample_sql(self, n: int = DRAWS, seed: int = SEED) -> str:
        """Draws looked up in the numbered join: in pre-order, each table by row hash."""
        joined = f"({self.members[0].sql()}) t0"
        for parent, column, child, own in self.edges:
            joined += f" JOIN ({self.members[child].sql()}) t{child} ON t{parent}.{column} = t{child}.{own}"
        order, out, names = [], [], []
        for i, m in enumerate(self.members):
            columns, rest = ([f"t{i}.{c}" for c in own] for own in (m.columns, [*m.payload, m.site]))
            order += [row_hash_sql(columns), row_hash_sql(rest), *columns, f"t{i}.rid"]
            out += [f"t{i}.{c} AS {c}" for c in [*m.carried, m.site]]
            names += [*m.carried, m.site]
        return (
            f"WITH j AS (SELECT {', '.join(out)}, row_number() OVER (ORDER BY {', '.join(order)}) - 1 AS rk FROM {joined}), "
            f"d AS (SELECT range AS draw_id, {draw_hash_sql(seed, 'range')} % (SELECT count(*) FROM j) AS rk FROM range({n})) "
            f"SELECT draw_id, {', '.join(names)} FROM d JOIN j USING (rk)"
        )


def row_hash_sql(columns: Sequence[str]) -> str:
    texts = [f"coalesce(length({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in columns]
    return f"md5(concat_ws('|', {', '.join(texts)}))"


def draw_hash_sql(seed: int, *ids: str) -> str:
    text = f"md5(concat_ws('|', {', '.join([str(seed), *ids])}))"
    high, low = (
        f"('0x' || substr({text}, {start}, 15))::BIGINT::HUGEINT" for start in (1, 16)
    )
    return f"({high} * {1 << 60} + {low})"


SUPPLIER = Member("supplier", ["s_suppkey", "s_nationkey"])
CUSTOMER = Member("customer", ["c_custkey", "c_nationkey"])
ORDERS = Member("orders", ["o_orderkey", "o_custkey", "o_orderpriority"])
LINEITEM = Member(
    "lineitem",
    ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"],
    payload=["l_quantity"],
)
EVENTS = Member("events", ["event_id", "user_id", "event_type"])
_PART_SIDE = LINEITEM.columns

GEO = ChainCase(
    [
        Member("region", ["r_regionkey", "r_name"]),
        Member("nation", ["n_nationkey", "n_name", "n_regionkey"]),
        SUPPLIER,
    ],
    [("r_regionkey", "n_regionkey"), ("n_nationkey", "s_nationkey")],
)
CHAIN2 = ChainCase([ORDERS, EVENTS], [("o_custkey", "user_id")])
CHAIN3 = ChainCase(
    [CUSTOMER, ORDERS, LINEITEM],
    [("c_custkey", "o_custkey"), ("o_orderkey", "l_orderkey")],
)
CHAIN4 = ChainCase(
    [SUPPLIER, CUSTOMER, ORDERS, LINEITEM],
    [
        ("s_nationkey", "c_nationkey"),
        ("c_custkey", "o_custkey"),
        ("o_orderkey", "l_orderkey"),
    ],
)
SELF_JOIN = ChainCase(
    [Member("lineitem", _PART_SIDE, "l1"), Member("lineitem", _PART_SIDE, "l2")],
    [("l_partkey", "l_partkey")],
)
HEAVY_SELF_JOIN = ChainCase(SELF_JOIN.members, [("l_suppkey", "l_suppkey")])
TREE = TreeCase(
    [
        Member("nation", ["n_nationkey", "n_name"]),
        Member("customer", ["c_custkey", "c_nationkey"]),
        Member("orders", ["o_orderkey", "o_custkey"], payload=["o_orderpriority"]),
        Member("events", ["event_id", "user_id"], payload=["event_type"]),
        Member("supplier", ["s_suppkey", "s_nationkey"]),
    ],
    [
        (0, "n_nationkey", 1, "c_nationkey"),
        (1, "c_custkey", 2, "o_custkey"),
        (1, "c_custkey", 3, "user_id"),
        (0, "n_nationkey", 4, "s_nationkey"),
    ],
)
