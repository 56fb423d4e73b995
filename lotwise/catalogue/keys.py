"""Key counts, key totals, allocations and key filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.catalogue.chains import CHAIN2, CHAIN4, DRAWS, SEED, draw_hash_sql, row_hash_sql, table
from lotwise.operators import (
    expected_row_draws,
    key_filter,
    key_frequency,
    key_metadata,
    key_totals,
    restrict_memo,
    site_key_shares,
)


def key_restricted_rows(spark, sf_dir):
    chain = CHAIN4.build(spark, sf_dir)
    counts = chain.key_counts(1, DRAWS, SEED)
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("key")
    )
    return restrict_memo(orders, counts)


def sampled_sites(spark, sf_dir):
    drawn = CHAIN4.build(spark, sf_dir).allocate(DRAWS, "drawn", SEED)
    return drawn.where(F.col("count") > 0).select("site")


def memo_semi_join(spark, sf_dir):
    chain = CHAIN4.build(spark, sf_dir)
    return restrict_memo(chain.memo(2, by_site=True), chain.key_counts(1, DRAWS, SEED))


def totals_of_sampled_keys(spark, sf_dir):
    chain = CHAIN4.build(spark, sf_dir)
    return key_totals(chain.memo(2, by_site=True), chain.key_counts(1, DRAWS, SEED))


def shares(spark, sf_dir):
    chain = CHAIN4.build(spark, sf_dir)
    counts = chain.key_counts(1, DRAWS, SEED)
    return site_key_shares(chain.memo(2, by_site=True), counts)


def row_draws(spark, sf_dir):
    chain = CHAIN4.build(spark, sf_dir)
    counts = chain.key_counts(1, DRAWS, SEED)
    weighted = chain.weights(2).select("o_orderkey", "o_custkey", "weight")
    return expected_row_draws(weighted, "o_custkey", counts, chain.memo(2))


def filtered_keys(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    events = table(spark, sf_dir, "events").select("event_id", "user_id")
    left, right = key_filter(orders, "o_custkey", events, "user_id")
    return left.select(F.lit("orders").alias("side"), F.col("o_orderkey").alias("id")).unionByName(
        right.select(F.lit("events").alias("side"), F.col("event_id").alias("id"))
    )


def metadata(spark, sf_dir):
    weighted = CHAIN2.build(spark, sf_dir).weights(0)
    return key_metadata(weighted, "o_custkey", "orders_site")


def allocation(mode):
    return lambda spark, sf: CHAIN4.build(spark, sf).allocate(DRAWS, mode, SEED)


QUERIES = {
    "key_restricted_rows": key_restricted_rows,
    "sampled_sites": sampled_sites,
    "memo_semi_join": memo_semi_join,
    "key_totals": totals_of_sampled_keys,
    "site_key_shares": shares,
    "expected_row_draws": row_draws,
    "key_filter": filtered_keys,
    "key_frequency": lambda spark, sf: key_frequency(
        table(spark, sf, "lineitem"), "l_partkey"
    ),
    "key_metadata": metadata,
    "sample_key_counts": lambda spark, sf: CHAIN4.build(spark, sf).key_counts(
        1, DRAWS, SEED
    ),
    "site_allocation_proportional": allocation("proportional"),
    "site_allocation_drawn": allocation("drawn"),
    "site_key_allocation": lambda spark, sf: CHAIN4.build(spark, sf).allocate_keys(
        2, DRAWS, SEED
    ),
    "site_allocation_memo": allocation("memo"),
    "site_key_allocation_memo": lambda spark, sf: CHAIN4.build(spark, sf).allocate_keys(
        2, DRAWS, SEED, "memo"
    ),
    "requested_vs_collected": lambda spark, sf: CHAIN4.build(
        spark, sf
    ).requested_and_collected(DRAWS, SEED),
}

_SAMPLED = CHAIN4.numbered_sql()
_COUNTS = f"{_SAMPLED}, c AS (SELECT c_custkey AS key, count(*) AS requested FROM s GROUP BY 1)"
_SITE_MEMO = f"m AS ({CHAIN4.memo_sql(2, by_site=True)})"
_PROPORTIONAL = (
    "SELECT supplier_site AS site, floor(count(*)::DOUBLE / "
    f"(SELECT count(*) FROM j) * {float(DRAWS)} + 0.5)::BIGINT AS count "
    "FROM j GROUP BY supplier_site"
)
_DRAWN = "SELECT supplier_site AS site, count(*) AS count FROM s GROUP BY supplier_site"



def _memo_allocation_sql() -> str:
    """Draws looked up among running totals of the sites."""
    order = f"{row_hash_sql(['site'])}, {row_hash_sql(['cardinality'])}, site"
    return (
        f"{_SAMPLED}, w AS (SELECT supplier_site AS site, count(*)::BIGINT AS cardinality FROM j GROUP BY 1), "
        f"r AS (SELECT *, sum(cardinality) OVER (ORDER BY {order} ROWS UNBOUNDED PRECEDING) - cardinality AS low FROM w), "
        f"p AS (SELECT {draw_hash_sql(SEED, 'range')} % (SELECT sum(cardinality) FROM w) AS pos FROM range({DRAWS})) "
        "SELECT site, count(*) AS count FROM p ASOF JOIN r ON p.pos >= r.low GROUP BY site"
    )


def _memo_key_allocation_sql() -> str:
    """Draws of each key looked up among running totals of its sites."""
    order = f"{row_hash_sql(['site'])}, {row_hash_sql(['count'])}, site"
    return (
        f"{_COUNTS}, {_SITE_MEMO}, "
        f"r AS (SELECT *, sum(count) OVER (PARTITION BY key ORDER BY {order} ROWS UNBOUNDED PRECEDING) - count AS low FROM m), "
        "t AS (SELECT key, sum(count) AS total FROM m GROUP BY 1), "
        "k AS (SELECT key, unnest(range(requested)) AS draw_no FROM c), "
        f"p AS (SELECT key, {draw_hash_sql(SEED, 'key', 'draw_no')} % total AS pos FROM k JOIN t USING (key)) "
        "SELECT site, p.key AS key, count(*) AS count FROM p ASOF JOIN r ON p.key = r.key AND p.pos >= r.low GROUP BY 1, 2"
    )


ORACLES = {
    "site_allocation_memo": _memo_allocation_sql(),
    "site_key_allocation_memo": _memo_key_allocation_sql(),
    "key_restricted_rows": (
        f"{_COUNTS} SELECT o.o_orderkey, o.o_custkey AS key FROM orders o "
        "WHERE o.o_custkey IN (SELECT key FROM c)"
    ),
    "sampled_sites": f"{_SAMPLED} SELECT DISTINCT supplier_site AS site FROM s",
    "memo_semi_join": (
        f"{_COUNTS}, {_SITE_MEMO} SELECT * FROM m WHERE key IN (SELECT key FROM c)"
    ),
    "key_totals": (
        f"{_COUNTS}, {_SITE_MEMO} SELECT key, sum(count)::BIGINT AS total FROM m "
        "WHERE key IN (SELECT key FROM c) GROUP BY key"
    ),
    "site_key_shares": (
        f"{_COUNTS}, {_SITE_MEMO}, "
        "t AS (SELECT key, sum(count)::BIGINT AS total FROM m GROUP BY key) "
        "SELECT site, key, m.count AS count, total, requested, "
        "(requested * m.count)::DOUBLE / total AS expected "
        "FROM m JOIN t USING (key) JOIN c USING (key)"
    ),
    "expected_row_draws": (
        f"{_COUNTS}, m AS ({CHAIN4.memo_sql(2)}), w AS ({CHAIN4.weights_sql(2)}) "
        "SELECT o_orderkey, o_custkey, weight, "
        "(requested * weight)::DOUBLE / m.count AS expected "
        "FROM w JOIN c ON o_custkey = c.key JOIN m ON o_custkey = m.key"
    ),
    "key_filter": (
        "SELECT 'orders' AS side, o_orderkey AS id FROM orders "
        "WHERE o_custkey IN (SELECT user_id FROM events) UNION ALL "
        "SELECT 'events', event_id FROM events "
        "WHERE user_id IN (SELECT o_custkey FROM orders)"
    ),
    "key_frequency": (
        "SELECT l_partkey AS key, count(*)::DOUBLE / (SELECT count(l_partkey) FROM lineitem) "
        "AS freq FROM lineitem WHERE l_partkey IS NOT NULL GROUP BY l_partkey"
    ),
    "key_metadata": (
        f"WITH w AS ({CHAIN2.weights_sql(0)}) SELECT o_custkey AS key, count(*) AS count, "
        "orders_site AS site, sum(weight)::BIGINT AS weight FROM w GROUP BY 1, 3"
    ),
    "sample_key_counts": f"{_COUNTS} SELECT key, requested AS count FROM c",
    "site_allocation_proportional": f"{_SAMPLED} {_PROPORTIONAL}",
    "site_allocation_drawn": f"{_SAMPLED} {_DRAWN}",
    "site_key_allocation": (
        f"{_SAMPLED} SELECT orders_site AS site, o_custkey AS key, count(*) AS count "
        "FROM s GROUP BY 1, 2"
    ),
    "requested_vs_collected": (
        f"{_SAMPLED}, p AS ({_PROPORTIONAL}), g AS ({_DRAWN}) "
        "SELECT site, p.count AS requested, coalesce(g.count, 0) AS collected "
        "FROM p LEFT JOIN g USING (site)"
    ),
}
