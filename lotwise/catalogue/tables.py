"""Scans, sinks, the site catalog and row-level operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.catalogue.chains import CHAIN2, CHAIN4, DRAWS, SEED, SITES, row_hash_sql, site_of, site_sql, table
from lotwise.operators import (
    at_site,
    repeat_rows,
    tag_site,
    with_partner,
    with_record_id,
    with_unit_weight,
)
from lotwise.plans import ChainJoin, TableSpec
from lotwise.sources import (
    empty_table,
    multi_site_tables,
    read_csv,
    read_memo,
    read_site_table,
    read_table,
    site_catalog,
    write_csv,
    write_memo,
    write_parquet,
    write_samples,
)
from lotwise.staging import Staging


def scan_csv_typed(spark, sf_dir):
    path, orders = Staging(spark).new_path("csv"), table(spark, sf_dir, "orders")
    write_csv(orders, path)
    return read_csv(spark, path, orders.schema)


def scan_csv_untyped(spark, sf_dir):
    path = Staging(spark).new_path("csv")
    write_csv(table(spark, sf_dir, "customer"), path)
    return read_csv(spark, path)


def scan_csv_text(spark, sf_dir):
    """Texts with line breaks, quotes and backslashes, through CSV and back."""
    path, docs = Staging(spark).new_path("csv"), table(spark, sf_dir, "documents")
    write_csv(docs, path)
    return read_csv(spark, path, docs.schema)


def scan_csv_blocks(spark, sf_dir):
    """The same, each file read by as many tasks as it has blocks."""
    path, docs = Staging(spark).new_path("csv"), table(spark, sf_dir, "documents")
    write_csv(docs, path)
    return read_table(spark, path, "csv", docs.schema, split=True)


def scan_parquet(spark, sf_dir):
    return read_table(spark, f"{sf_dir}/lineitem.parquet")


def scan_by_format(spark, sf_dir):
    part, staging = table(spark, sf_dir, "part"), Staging(spark)
    frames = []
    for fmt, write in (("csv", write_csv), ("parquet", write_parquet)):
        path = staging.new_path(fmt)
        write(part, path)
        spec = TableSpec.load(spark, "part", path, fmt, part.schema)
        frames.append(spec.df.withColumn("fmt", F.lit(fmt)))
    return reduce(DataFrame.unionByName, frames)


def empty_union_seed(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return empty_table(spark, orders.schema).unionByName(orders)


def _site_tables(spark, sf_dir) -> str:
    """customer and orders at three sites, events at one."""
    root = Staging(spark).new_path("sites")
    for name, site in (
        ("customer", site_of("c_custkey")),
        ("orders", site_of("o_orderkey")),
        ("events", F.lit("s0")),
    ):
        df = table(spark, sf_dir, name).withColumn("site", site)
        write_parquet(df, f"{root}/{name}", partition_by=["site"])
    return root


def catalog_of_sites(spark, sf_dir):
    return site_catalog(spark, _site_tables(spark, sf_dir))


def tables_at_many_sites(spark, sf_dir):
    return multi_site_tables(catalog_of_sites(spark, sf_dir))


def site_filter(spark, sf_dir):
    orders = read_site_table(spark, _site_tables(spark, sf_dir), "orders")
    return at_site(orders, "s1").select("o_orderkey", "o_custkey", "site")


def union_sites(spark, sf_dir):
    root = _site_tables(spark, sf_dir)
    per_site = [
        read_site_table(spark, root, "orders", sites=[f"s{i}"]) for i in range(SITES)
    ]
    return reduce(DataFrame.unionByName, per_site).select(
        "o_orderkey", "o_custkey", "site"
    )


def memo_roundtrip(spark, sf_dir):
    memo, staging = CHAIN2.build(spark, sf_dir).memo(1), Staging(spark)
    schema = T.StructType(
        [T.StructField("k", T.LongType()), T.StructField("c", T.LongType())]
    )
    frames = []
    for fmt in ("csv", "parquet"):
        path = staging.new_path(fmt)
        write_memo(memo, path, fmt)
        read = read_memo(spark, path, fmt, schema if fmt == "csv" else None)
        frames.append(read.withColumn("fmt", F.lit(fmt)))
    return reduce(DataFrame.unionByName, frames)


def sample_sink_roundtrip(spark, sf_dir):
    """All samples written in both formats; rows of each table read back."""
    chain, staging = CHAIN4.build(spark, sf_dir), Staging(spark)
    samples = dict(zip([t.name for t in chain.tables], chain.sample_tables(DRAWS, SEED)))
    frames = []
    for fmt in ("parquet", "csv"):
        path = staging.new_path("samples")
        write_samples(samples, path, fmt)
        for name, df in samples.items():
            read = read_table(spark, f"{path}/{name}", fmt, df.schema)
            text = F.concat_ws("|", *[F.col(c).cast("string") for c in df.columns if c != "l_quantity"])
            frames.append(read.select(F.lit(fmt).alias("fmt"), F.lit(name).alias("name"), text.alias("row")))
    return reduce(DataFrame.unionByName, frames)


def sample_from_sites(spark, sf_dir):
    """Tables written by site, read back with their real sites, sampled as a chain."""
    root = Staging(spark).new_path("by-site")
    specs = []
    for member in CHAIN2.members:
        df = table(spark, sf_dir, member.table).select(*member.columns)
        for i in range(SITES):
            own = df.where(F.col(member.columns[0]) % SITES == i)
            write_parquet(own, f"{root}/s{i}/{member.table}")
        df = read_site_table(spark, root, member.table, by="site")
        df = df.withColumnRenamed("site", member.site)
        specs.append(TableSpec(member.name, df, member.columns, member.site))
    return ChainJoin(specs, CHAIN2.edges).sample(DRAWS, SEED)


def site_tag(spark, sf_dir):
    """Parts of a table tagged with the site they are taken from."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    parts = [tag_site(orders.where(F.col("o_orderkey") % SITES == i), f"s{i}") for i in range(SITES)]
    return reduce(DataFrame.unionByName, parts)


def rows_repeated_often(spark, sf_dir):
    parts = table(spark, sf_dir, "supplier").selectExpr("s_suppkey", "s_suppkey * 137 % 4000 AS times")
    return repeat_rows(parts, "times")


def record_id_unique(spark, sf_dir):
    rows = with_record_id(table(spark, sf_dir, "lineitem").select("l_orderkey"))
    return rows.agg(
        F.count(F.lit(1)).alias("num_rows"),
        F.countDistinct("record_id").alias("num_ids"),
    )


def record_ids(spark, sf_dir):
    """Dense ids of rows, many of them equal, dealt over more parts than they come in."""
    rows = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber", "l_returnflag")
    return with_record_id(rows.repartition(13))


def leaf_weights(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return with_unit_weight(rows)


def dangling_removed(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    memo = CHAIN2.build(spark, sf_dir).memo(1)
    return with_partner(orders, "o_custkey", memo)


def rows_repeated(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_custkey") % 4).alias("times")
    )
    return repeat_rows(orders, "times")


QUERIES = {
    "scan_csv_typed": scan_csv_typed,
    "scan_csv_untyped": scan_csv_untyped,
    "scan_csv_text": scan_csv_text,
    "scan_csv_blocks": scan_csv_blocks,
    "scan_parquet": scan_parquet,
    "scan_by_format": scan_by_format,
    "empty_union_seed": empty_union_seed,
    "site_catalog": catalog_of_sites,
    "multi_site_tables": tables_at_many_sites,
    "site_filter": site_filter,
    "union_sites": union_sites,
    "memo_roundtrip": memo_roundtrip,
    "sample_sink_roundtrip": sample_sink_roundtrip,
    "record_id_unique": record_id_unique,
    "record_ids": record_ids,
    "leaf_weights": leaf_weights,
    "dangling_removed": dangling_removed,
    "repeat_rows": rows_repeated,
    "repeat_rows_large": rows_repeated_often,
    "sample_from_sites": sample_from_sites,
    "site_tag": site_tag,
}

_SITES_SQL = (
    f"SELECT DISTINCT {site_sql('c_custkey')} AS site, 'customer' AS \"table\" FROM customer "
    f"UNION ALL SELECT DISTINCT {site_sql('o_orderkey')}, 'orders' FROM orders "
    "UNION ALL SELECT DISTINCT 's0', 'events' FROM events"
)
_ID_COLUMNS = "l_suppkey, l_linenumber, l_returnflag"
_ORDER_SITES_SQL = (
    f"SELECT o_orderkey, o_custkey, {site_sql('o_orderkey')} AS site FROM orders"
)

ORACLES = {
    "scan_csv_typed": "SELECT * FROM orders",
    "scan_csv_untyped": (
        "SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_nationkey::VARCHAR AS c_nationkey, "
        "c_acctbal::VARCHAR AS c_acctbal, c_mktsegment FROM customer"
    ),
    "scan_csv_text": "SELECT * FROM documents",
    "scan_csv_blocks": "SELECT * FROM documents",
    "scan_parquet": "SELECT * FROM lineitem",
    "scan_by_format": (
        "SELECT *, 'csv' AS fmt FROM part UNION ALL SELECT *, 'parquet' FROM part"
    ),
    "empty_union_seed": "SELECT * FROM orders",
    "site_catalog": _SITES_SQL,
    "multi_site_tables": (
        f'SELECT "table", count(DISTINCT site) > 1 AS multi_site FROM ({_SITES_SQL}) '
        'GROUP BY "table"'
    ),
    "site_filter": f"SELECT * FROM ({_ORDER_SITES_SQL}) WHERE site = 's1'",
    "union_sites": _ORDER_SITES_SQL,
    "memo_roundtrip": (
        f"WITH m AS ({CHAIN2.memo_sql(1)}) SELECT *, 'csv' AS fmt FROM m "
        "UNION ALL SELECT *, 'parquet' FROM m"
    ),
    "sample_sink_roundtrip": CHAIN4.numbered_sql()
    + "SELECT fmt, name, row FROM ("
    + " UNION ALL ".join(
        f"SELECT '{m.name}' AS name, concat_ws('|', {', '.join([*m.columns, m.site])}) AS row FROM s"
        for m in CHAIN4.members
    )
    + "), (VALUES ('parquet'), ('csv')) f(fmt)",
    "sample_from_sites": (
        f"{CHAIN2.numbered_sql()} SELECT draw_id, {CHAIN2.output(0)}, {CHAIN2.output(1)} FROM s"
    ),
    "site_tag": _ORDER_SITES_SQL,
    "repeat_rows_large": (
        "SELECT s_suppkey, s_suppkey * 137 % 4000 AS times, unnest(range(s_suppkey * 137 % 4000)) AS copy "
        "FROM supplier"
    ),
    "record_id_unique": (
        "SELECT count(*) AS num_rows, count(*) AS num_ids FROM lineitem"
    ),
    "record_ids": (
        f"SELECT {_ID_COLUMNS}, row_number() OVER (ORDER BY {row_hash_sql(_ID_COLUMNS.split(', '))}, {_ID_COLUMNS}) - 1 "
        "AS record_id FROM lineitem"
    ),
    "leaf_weights": (
        "SELECT l_orderkey, l_linenumber, 1::BIGINT AS weight FROM lineitem"
    ),
    "dangling_removed": (
        "SELECT o_orderkey, o_custkey FROM orders "
        "WHERE o_custkey IN (SELECT user_id FROM events)"
    ),
    "repeat_rows": (
        "SELECT o_orderkey, o_custkey % 4 AS times, unnest(range(o_custkey % 4)) AS copy "
        "FROM orders"
    ),
}
