"""Backward pass: memos, exact weights, cardinalities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.catalogue.chains import (
    CHAIN2,
    CHAIN3,
    CHAIN4,
    GEO,
    HEAVY_SELF_JOIN,
    SELF_JOIN,
    table,
)
from lotwise.operators import (
    approximate_weights,
    count_min_sketch,
    merge_memos,
    nonzero,
)
from lotwise.plans import TableSpec, TreeJoin

_ID_COLUMNS = [
    ("s_suppkey", "s_nationkey"),
    ("c_custkey", "c_nationkey"),
    ("o_orderkey", "o_custkey"),
    ("l_orderkey", "l_partkey"),
]
SKETCH_DEPTH, SKETCH_WIDTH = 4, 4096


def exact_weights_chain4(spark, sf_dir):
    chain = CHAIN4.build(spark, sf_dir)
    frames = [
        chain.weights(i).select(
            F.lit(i).alias("position"),
            F.col(first).cast("bigint").alias("first_col"),
            F.col(second).cast("bigint").alias("second_col"),
            "weight",
        )
        for i, (first, second) in enumerate(_ID_COLUMNS)
    ]
    return reduce(DataFrame.unionAll, frames)


def approx_weights(spark, sf_dir):
    chain = CHAIN2.build(spark, sf_dir)
    sketch = count_min_sketch(chain.memo(1), SKETCH_DEPTH, SKETCH_WIDTH)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return approximate_weights(
        orders, "o_custkey", sketch, SKETCH_DEPTH, SKETCH_WIDTH
    )


def _tree(spark, sf_dir):
    names = ["customer", "nation", "orders", "lineitem", "events"]
    specs = [TableSpec(n, table(spark, sf_dir, n)) for n in names]
    edges = [
        (0, "c_nationkey", 1, "n_nationkey"),
        (0, "c_custkey", 2, "o_custkey"),
        (2, "o_orderkey", 3, "l_orderkey"),
        (0, "c_custkey", 4, "user_id"),
    ]
    return TreeJoin(specs, edges)


def tree_weights(spark, sf_dir):
    return _tree(spark, sf_dir).weights().select("c_custkey", "c_nationkey", "weight")


def join_cardinality_exact(spark, sf_dir):
    """Counted in residues, as text: the number may have more digits than any type."""
    found = CHAIN4.build(spark, sf_dir).cardinality_exact()
    return spark.range(1).select(F.lit(str(found)).alias("cardinality"))



QUERIES = {
    "leaf_memo": lambda spark, sf: CHAIN4.build(spark, sf).memo(3),
    "middle_memo": lambda spark, sf: CHAIN4.build(spark, sf).memo(1),
    "first_memo": lambda spark, sf: CHAIN4.build(spark, sf).memo(0),
    "site_tagged_memo": lambda spark, sf: CHAIN4.build(spark, sf).memo(2, by_site=True),
    "merged_memo": lambda spark, sf: merge_memos(
        CHAIN4.build(spark, sf).memo(2, by_site=True)
    ),
    "nonzero_keys": lambda spark, sf: nonzero(CHAIN3.build(spark, sf).memo(1)),
    "exact_weights_first": lambda spark, sf: CHAIN2.build(spark, sf).weights(0),
    "exact_weights_middle": lambda spark, sf: CHAIN4.build(spark, sf).weights(1),
    "exact_weights_chain4": exact_weights_chain4,
    "join_cardinality": lambda spark, sf: CHAIN2.build(spark, sf).cardinality(),
    "join_cardinality_chain3": lambda spark, sf: CHAIN3.build(spark, sf).cardinality(),
    "join_cardinality_chain4": lambda spark, sf: CHAIN4.build(spark, sf).cardinality(),
    "join_cardinality_geo": lambda spark, sf: GEO.build(spark, sf).cardinality(),
    "join_cardinality_self": lambda spark, sf: SELF_JOIN.build(spark, sf).cardinality(),
    "join_cardinality_heavy": lambda spark, sf: HEAVY_SELF_JOIN.build(
        spark, sf
    ).cardinality(),
    "join_cardinality_wide": lambda spark, sf: CHAIN4.build(
        spark, sf, wide=True
    ).cardinality(),
    "join_cardinality_exact": join_cardinality_exact,
    "join_cardinality_by_site": lambda spark, sf: CHAIN4.build(spark, sf).cardinality(
        by_site=True
    ),
    "join_cardinality_by_key": lambda spark, sf: CHAIN4.build(spark, sf).cardinality(
        by_key=True
    ),
    "full_chain_join": lambda spark, sf: CHAIN3.build(spark, sf).full_join(),
    "approx_weights": approx_weights,
    "tree_weights": tree_weights,
    "tree_cardinality": lambda spark, sf: _tree(spark, sf).cardinality(),
}


def _count_sql(case) -> str:
    return f"SELECT count(*)::BIGINT AS cardinality FROM {case.join_sql()}"


def _ids_sql(i: int) -> str:
    first, second = _ID_COLUMNS[i]
    return (
        f"SELECT {i} AS position, {first}::BIGINT AS first_col, "
        f"{second}::BIGINT AS second_col, weight FROM ({CHAIN4.weights_sql(i)})"
    )


def _sketch_sql() -> str:
    def bucket(depth: str, key: str) -> str:
        text = f"md5(concat_ws('|', {depth}, {key}))"
        return f"(('0x' || substr({text}, 1, 15))::BIGINT % {SKETCH_WIDTH})"

    levels = f"range({SKETCH_DEPTH}) d(depth)"
    return (
        f"WITH m AS ({CHAIN2.memo_sql(1)}), "
        f"k AS (SELECT depth, {bucket('depth', 'key')} AS bucket, sum(count) AS total "
        f"FROM m, {levels} GROUP BY ALL), "
        f"o AS (SELECT o_orderkey, o_custkey, depth, {bucket('depth', 'o_custkey')} AS bucket "
        f"FROM orders, {levels}) "
        "SELECT o_orderkey, o_custkey, min(total)::BIGINT AS weight FROM o JOIN k "
        "USING (depth, bucket) GROUP BY o_orderkey, o_custkey "
        f"HAVING count(*) = {SKETCH_DEPTH}"
    )


_TREE_JOIN_SQL = (
    "customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON c_custkey = o_custkey "
    "JOIN lineitem ON o_orderkey = l_orderkey JOIN events ON c_custkey = user_id"
)

ORACLES = {
    "leaf_memo": CHAIN4.memo_sql(3),
    "middle_memo": CHAIN4.memo_sql(1),
    "first_memo": CHAIN4.memo_sql(0),
    "site_tagged_memo": CHAIN4.memo_sql(2, by_site=True),
    "merged_memo": CHAIN4.memo_sql(2),
    "nonzero_keys": CHAIN3.memo_sql(1),
    "exact_weights_first": CHAIN2.weights_sql(0),
    "exact_weights_middle": CHAIN4.weights_sql(1),
    "exact_weights_chain4": " UNION ALL ".join(_ids_sql(i) for i in range(4)),
    "join_cardinality": _count_sql(CHAIN2),
    "join_cardinality_chain3": _count_sql(CHAIN3),
    "join_cardinality_chain4": _count_sql(CHAIN4),
    "join_cardinality_geo": _count_sql(GEO),
    "join_cardinality_self": _count_sql(SELF_JOIN),
    "join_cardinality_heavy": _count_sql(HEAVY_SELF_JOIN),
    "join_cardinality_wide": (
        f"SELECT count(*)::DECIMAL(38,0) AS cardinality FROM {CHAIN4.join_sql()}"
    ),
    "join_cardinality_exact": (
        f"SELECT count(*)::VARCHAR AS cardinality FROM {CHAIN4.join_sql()}"
    ),
    "join_cardinality_by_site": (
        "SELECT t0.supplier_site AS site, count(*)::BIGINT AS cardinality "
        f"FROM {CHAIN4.join_sql()} GROUP BY t0.supplier_site"
    ),
    "join_cardinality_by_key": (
        "SELECT t0.s_nationkey AS key, count(*)::BIGINT AS cardinality "
        f"FROM {CHAIN4.join_sql()} GROUP BY t0.s_nationkey"
    ),
    "full_chain_join": (
        f"SELECT {', '.join(CHAIN3.columns_sql(i) for i in range(3))} "
        f"FROM {CHAIN3.join_sql()}"
    ),
    "approx_weights": _sketch_sql(),
    "tree_weights": (
        "SELECT c_custkey, c_nationkey, count(*)::BIGINT AS weight "
        f"FROM {_TREE_JOIN_SQL} GROUP BY c_custkey, c_nationkey"
    ),
    "tree_cardinality": (
        f"SELECT count(*)::BIGINT AS cardinality FROM {_TREE_JOIN_SQL}"
    ),
}
