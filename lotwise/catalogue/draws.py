"""Sampling operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.catalogue.chains import (
    CHAIN2,
    CHAIN3,
    CHAIN4,
    DRAWS,
    GEO,
    SEED,
    SELF_JOIN,
    TREE,
    draw_hash_sql,
    row_hash_sql,
    table,
)
from lotwise.functions.hashing import wide_position
from lotwise.operators import sample_by_sketch, sample_per_key, weighted_sample

_LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def weighted(spark, sf_dir, **options):
    lines = table(spark, sf_dir, "lineitem").select(
        *_LINE, F.col("l_quantity").cast("bigint").alias("weight")
    )
    return weighted_sample(lines, "weight", DRAWS, SEED, order_cols=_LINE, **options)


def per_key(use_weight: bool, **options):
    """As many events of each user as the user has orders."""

    def query(spark, sf_dir):
        counts = (
            table(spark, sf_dir, "orders")
            .groupBy(F.col("o_custkey").alias("key"))
            .agg(F.count(F.lit(1)).alias("count"))
        )
        events = table(spark, sf_dir, "events").select(
            "event_id", "user_id", (F.col("event_id") % 5).alias("weight")
        )
        weight = "weight" if use_weight else None
        return sample_per_key(
            events, "user_id", counts, SEED, weight, order_cols=["event_id"], **options
        )

    return query


def joined(case):
    return lambda spark, sf: case.build(spark, sf).sample(DRAWS, SEED)


def one_table(case, i: int):
    return lambda spark, sf: case.build(spark, sf).sample_table(i, DRAWS, SEED)


def ordered_table(case, i: int):
    return lambda spark, sf: case.build(spark, sf).sample_tables(DRAWS, SEED)[i]


SLICED = {"split_rows": 64, "slice_digits": 1}


def sliced(case):
    """The same sample with groups cut as large ones are."""
    return lambda spark, sf: case.build(spark, sf, **SLICED).sample(DRAWS, SEED)


def wide(spark, sf_dir):
    """Weights whose total needs more than 120 bits."""
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "CAST(o_custkey % 4 AS DECIMAL(38,0)) * 1000000000000000000000000000000 AS weight"
    )
    return weighted_sample(orders, "weight", DRAWS, SEED, order_cols=["o_orderkey"], wide=True)


SKETCH = (2, 256)  # small, so that many draws are rejected
ENOUGH = 20 * DRAWS  # draws that the SQL makes, of which the first accepted count


def by_sketch(spark, sf_dir):
    left, right = (m.spec(spark, sf_dir) for m in CHAIN2.members)
    (src, dst), (depth, width) = CHAIN2.edges[0], SKETCH
    return sample_by_sketch(left, src, right, dst, DRAWS, SEED, depth, width)


QUERIES = {
    "sample_by_sketch": by_sketch,
    "weighted_sample_sliced": lambda spark, sf: weighted(spark, sf, **SLICED),
    "sample_per_key_sliced": per_key(use_weight=False, **SLICED),
    "sample_chain4_sliced": sliced(CHAIN4),
    "sample_self_join_sliced": sliced(SELF_JOIN),
    "sample_tree": lambda spark, sf: TREE.build(spark, sf).sample(DRAWS, SEED),
    "sample_tree_sliced": lambda spark, sf: TREE.build(spark, sf, **SLICED).sample(DRAWS, SEED),
    "weighted_sample_wide": wide,
    "weighted_sample": weighted,
    "sample_per_key": per_key(use_weight=False),
    "sample_per_key_weighted": per_key(use_weight=True),
    "sample_first_table": one_table(CHAIN2, 0),
    "sample_next_table": one_table(CHAIN2, 1),
    "sample_sorted": ordered_table(CHAIN3, 1),
    "sample_chain2": joined(CHAIN2),
    "sample_chain3": joined(CHAIN3),
    "sample_chain3_geo": joined(GEO),
    "sample_chain4": joined(CHAIN4),
    "sample_self_join": joined(SELF_JOIN),
    **{
        f"sample_per_table_{m.name}": one_table(CHAIN4, i)
        for i, m in enumerate(CHAIN4.members)
    },
}


def _joined_sql(case) -> str:
    columns = ", ".join(case.output(i) for i in range(len(case.members)))
    return f"{case.numbered_sql()} SELECT draw_id, {columns} FROM s"


def _table_sql(case, i: int) -> str:
    return f"{case.numbered_sql()} SELECT {case.output(i)} FROM s"


def _per_key_sql(weight: str) -> str:
    order = f"{row_hash_sql(['event_id'])}, event_id"
    return (
        "WITH c AS (SELECT o_custkey AS key, count(*) AS n FROM orders GROUP BY 1), "
        f"w AS (SELECT event_id, user_id, event_id % 5 AS weight, {weight} AS own "
        f"FROM events WHERE {weight} > 0), "
        "r AS (SELECT *, sum(own) OVER (PARTITION BY user_id ORDER BY "
        f"{order} ROWS UNBOUNDED PRECEDING) - own AS low FROM w), "
        "t AS (SELECT user_id, sum(own) AS total FROM w GROUP BY 1), "
        "k AS (SELECT key, unnest(range(n)) AS draw_no FROM c), "
        f"d AS (SELECT key AS user_id, draw_no, {draw_hash_sql(SEED, 'key', 'draw_no')} "
        "% total AS pos FROM k JOIN t ON key = t.user_id) "
        "SELECT draw_no, event_id, d.user_id AS user_id, weight FROM d ASOF JOIN r "
        "ON d.user_id = r.user_id AND d.pos >= r.low"
    )


_WEIGHTED_SQL = (
    f"WITH w AS (SELECT {', '.join(_LINE)}, l_quantity::BIGINT AS weight FROM lineitem "
    "WHERE l_quantity::BIGINT > 0), "
    "r AS (SELECT *, sum(weight) OVER (ORDER BY "
    f"{row_hash_sql(_LINE)}, {row_hash_sql(['weight'])}, {', '.join(_LINE)}, weight ROWS UNBOUNDED PRECEDING) - weight "
    "AS low FROM w), "
    f"d AS (SELECT range AS draw_id, {draw_hash_sql(SEED, 'range')} "
    f"% (SELECT sum(weight) FROM w) AS pos FROM range({DRAWS})) "
    f"SELECT draw_id, {', '.join(_LINE)}, weight FROM d ASOF JOIN r ON d.pos >= r.low"
)

def _wide_word(text: str, number: int) -> str:
    return f"('0x' || substr(md5({text}), {1 + 15 * number}, 15))::BIGINT::HUGEINT"


def _wide_text(attempt: int) -> str:
    parts = [str(SEED), "range", *([f"'try{attempt}'"] if attempt else [])]
    return f"concat_ws('|', {', '.join(parts)})"


_WIDE_SQL = (
    "WITH w AS (SELECT o_orderkey, (o_custkey % 4)::HUGEINT * 1000000000000000000000000000000::HUGEINT AS weight "
    "FROM orders WHERE o_custkey % 4 > 0), "
    f"r AS (SELECT *, sum(weight) OVER (ORDER BY {row_hash_sql(['o_orderkey'])} ROWS UNBOUNDED PRECEDING)::HUGEINT "
    "- weight AS low FROM w), t AS (SELECT sum(weight)::HUGEINT AS total FROM w), "
    f"d AS (SELECT range AS draw_id, {wide_position(_wide_text, _wide_word, 'total', 'HUGEINT', f'(total // {1 << 60})')} "
    f"AS pos FROM range({DRAWS}), t) "
    "SELECT draw_id, o_orderkey, weight::DECIMAL(38,0) AS weight FROM d ASOF JOIN r ON d.pos >= r.low"
)

def _sketch_bucket(depth: str, key: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', {depth}, {key})), 1, 15))::BIGINT % {SKETCH[1]})"


def _by_sketch_sql() -> str:
    left, right = CHAIN2.members
    src, dst = CHAIN2.edges[0]
    own, other = [*left.columns, left.site], [*right.columns, right.site]
    by = f"{row_hash_sql(left.columns)}, {row_hash_sql([left.site, src, 'guess'])}"
    return (
        f"WITH l AS ({left.sql()}), r AS ({right.sql()}), "
        f"m AS (SELECT {dst} AS key, count(*) AS count FROM r WHERE {dst} IS NOT NULL GROUP BY 1), "
        f"k AS (SELECT depth, {_sketch_bucket('depth', 'key')} AS bucket, sum(count) AS total FROM m, range({SKETCH[0]}) d(depth) GROUP BY ALL), "
        f"g AS (SELECT l.rid, min(total)::BIGINT AS guess FROM l, range({SKETCH[0]}) d(depth) JOIN k "
        f"ON k.depth = d.depth AND k.bucket = {_sketch_bucket('d.depth', f'l.{src}')} GROUP BY 1 HAVING count(*) = {SKETCH[0]}), "
        f"w AS (SELECT l.*, guess, sum(guess) OVER (ORDER BY {by} ROWS UNBOUNDED PRECEDING) - guess AS low FROM l JOIN g USING (rid)), "
        f"d AS (SELECT range AS draw, {draw_hash_sql(SEED, 'range')} % (SELECT sum(guess) FROM w) AS place FROM range({ENOUGH})), "
        f"a AS (SELECT draw, place - low AS pos, w.* FROM d ASOF JOIN w ON place >= low), "
        f"p AS (SELECT *, row_number() OVER (PARTITION BY {dst} ORDER BY {row_hash_sql(right.columns)}, {row_hash_sql([right.site])}, "
        f"{', '.join(right.columns)}) - 1 AS pos FROM r), "
        f"j AS (SELECT draw, {', '.join(f'a.{c} AS {c}' for c in own)}, {', '.join(f'p.{c} AS {c}' for c in other)} "
        f"FROM a JOIN p ON a.{src} = p.{dst} AND a.pos = p.pos) "
        f"SELECT row_number() OVER (ORDER BY draw) - 1 AS draw_id, {', '.join([*own, *other])} FROM j ORDER BY draw LIMIT {DRAWS}"
    )


ORACLES = {
    "sample_by_sketch": _by_sketch_sql(),
    "weighted_sample_sliced": _WEIGHTED_SQL,
    "sample_per_key_sliced": _per_key_sql("1"),
    "sample_chain4_sliced": _joined_sql(CHAIN4),
    "sample_self_join_sliced": _joined_sql(SELF_JOIN),
    "sample_tree": TREE.sample_sql(),
    "sample_tree_sliced": TREE.sample_sql(),
    "weighted_sample_wide": _WIDE_SQL,
    "weighted_sample": _WEIGHTED_SQL,
    "sample_per_key": _per_key_sql("1"),
    "sample_per_key_weighted": _per_key_sql("event_id % 5"),
    "sample_first_table": _table_sql(CHAIN2, 0),
    "sample_next_table": _table_sql(CHAIN2, 1),
    "sample_sorted": _table_sql(CHAIN3, 1),
    "sample_chain2": _joined_sql(CHAIN2),
    "sample_chain3": _joined_sql(CHAIN3),
    "sample_chain3_geo": _joined_sql(GEO),
    "sample_chain4": _joined_sql(CHAIN4),
    "sample_self_join": _joined_sql(SELF_JOIN),
    **{
        f"sample_per_table_{m.name}": _table_sql(CHAIN4, i)
        for i, m in enumerate(CHAIN4.members)
    },
}
