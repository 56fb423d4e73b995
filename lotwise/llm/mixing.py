"""Mixing sources to target weights by weighted fair queueing.

The documents of a source queue in shuffled order. The virtual finish time of a
document is the words its source has queued up to its end, divided by the
source's target. The mix takes words in order of virtual finish until the total
budget is reached, which is at virtual time one; a source whose documents run out
before starts over.

Cumulative sums need no task that sees a whole source: the shuffle order is cut
into about sqrt(documents) buckets, and a sum is that of the buckets before plus
that inside the bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm.tables import set_aside
from lotwise.staging import Staging

SEED = 17
WEIGHTS = (5, 2, 1)
SHARE = (3, 2)  # budget: 150 % of all words
MOST = 2  # times a document may be taken
WORD = r"[^\x20\x09-\x0D]+"
PAST = (Window.unboundedPreceding, -1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Weights repeat over the sources by code point, null last. Targets are in
    proportion to weights unless that exceeds ``most`` times a source's size; the
    excess goes to the others by weight. In order of size per weight the capped
    sources come first, so running sums over the sources find the level.
    """
    everything = Window.partitionBy()
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("turn") % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("turn", turn).withColumn("weight", weight.cast("bigint"))
    ranked = ranked.withColumn("cap", F.col("source_size") * most)
    before = Window.orderBy(F.col("cap") / F.col("weight"), "turn").rowsBetween(*PAST)
    ranked = ranked.withColumns(
        {
            "capped": F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "used": F.coalesce(F.sum("weight").over(before), F.lit(0)),
            "budget": F.sum("source_size").over(everything) * share[0],
            "all_weights": F.sum("weight").over(everything),
        }
    )
    # the level, if this source and all after it stay below their caps
    room = (F.col("budget") - F.col("capped") * share[1]).cast("double") / float(share[1])
    ranked = ranked.withColumn("level", room / (F.col("all_weights") - F.col("used")))
    fits = F.col("cap") >= F.col("level") * F.col("weight")
    final = F.min(F.when(fits, F.struct("used", "turn", "level"))).over(everything)["level"]
    ranked = ranked.withColumn("share", F.col("cap").cast("double")).withColumn("final", final)
    target = F.least("share", F.coalesce(F.col("final") * F.col("weight"), "share"))
    return ranked.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, seed: int = SEED, weights=WEIGHTS, share=SHARE, most: int = MOST, staging: Staging | None = None) -> DataFrame:
    """Rows of ``docs`` with __size, __source_size, __target, __before and __taken
    (in place of columns of these names).

    __taken is the number of words the mix takes of the row, repeats counted, at
    most ``most`` times its size; the last document taken of a source is cut.
    __before is the words of the source queued earlier. Null text has no words.
    The order is a hash of the seed and doc_id (ties: doc_id, text), so reruns
    agree; for repeated rows it does not matter which comes first.
    """
    staging = staging or Staging(docs.sparkSession)
    buckets = max(1, int(docs.count() ** 0.5))
    place = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    docs, restore = set_aside(docs, "doc_id", "source", "text")
    rows = docs.withColumns({"__size": word_count(F.col("text")), "__place": place})
    bucket = f"CAST(conv(substring(__place, 1, 8), 16, 10) AS BIGINT) * {buckets}L DIV 4294967296L"
    rows = rows.withColumn("__bucket", F.expr(bucket))
    sums = rows.groupBy(F.col("source").alias("__of"), F.col("__bucket").alias("__part")).agg(F.sum("__size").alias("__words"))
    sums = staging.table(sums, "buckets")
    sizes = sums.groupBy(F.col("__of").alias("source")).agg(F.sum("__words").alias("source_size"))
    targets = source_targets(sizes, weights, share, most)
    earlier = F.sum("__words").over(Window.partitionBy("__of").orderBy("__part").rowsBetween(*PAST))
    sums = sums.withColumn("__earlier", F.coalesce(earlier, F.lit(0)))
    sums = sums.join(targets, F.col("__of").eqNullSafe(F.col("source"))).selectExpr(
        "__of", "__part", "__earlier", "source_size AS __source_size", "target AS __target"
    )
    sums = staging.table(sums, "earlier")
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("__of")) & (F.col("__bucket") == F.col("__part")))
    order = Window.partitionBy("__of", "__part").orderBy("__place", "doc_id", F.xxhash64("text")).rowsBetween(*PAST)
    rows = rows.withColumn("__before", F.col("__earlier") + F.coalesce(F.sum("__size").over(order), F.lit(0)))
    taken = " + ".join(
        f"greatest(0L, least(__size, CAST(floor(__target) AS BIGINT) - {turn}L * __source_size - __before))"
        for turn in range(most)
    )
    rows = rows.withColumn("__taken", F.expr(taken))
    added = ["__size", "__source_size", "__target", "__before", "__taken"]
    return rows.select(*restore(*added), *added)


def by_finish(mixed: DataFrame) -> DataFrame:
    """``mixed`` in global order of the virtual finish of each row's first turn."""
    finish = F.when(F.col("__target") > 0, F.expr("(__before + __size) / __target"))
    return mixed.withColumn("__finish", finish).repartitionByRange("__finish", "doc_id").sortWithinPartitions("__finish", "doc_id")


def sequence(mixed: DataFrame, most: int = MOST) -> DataFrame:
    """The mix itself: rows of ``mixed``, repeated as often as taken, in global order.

    Adds __finish, the virtual finish time, and sorts by it. Documents stay whole:
    the last one of a source, which the budget cuts, is in if at least half of its
    words are.
    """
    turns = mixed.where("__size > 0").withColumn("__turn", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    before = "(__turn * __source_size + __before)"
    part = F.expr(f"CAST(floor(__target) AS BIGINT) - {before}")
    turns = turns.where(part * 2 >= F.col("__size")).withColumn("__finish", F.expr(f"({before} + __size) / __target"))
    return turns.drop("__turn").repartitionByRange("__finish", "doc_id").sortWithinPartitions("__finish", "doc_id")


_SIZE = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"
ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, text, {_SIZE}::BIGINT AS size,
    md5(concat_ws('|', '{SEED}', coalesce(doc_id::VARCHAR, '-'))) AS place FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM s),
w AS (SELECT *, [5, 2, 1][(turn % 3 + 1)::INT]::BIGINT AS weight, 2 * source_size AS cap FROM r),
c AS (SELECT *,
    coalesce(sum(cap) OVER past, 0)::BIGINT AS capped, coalesce(sum(weight) OVER past, 0)::BIGINT AS used,
    (3 * sum(source_size) OVER ())::BIGINT AS budget, (sum(weight) OVER ())::BIGINT AS all_weights
  FROM w WINDOW past AS (ORDER BY cap / weight, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (budget - 2 * capped)::DOUBLE / 2.0 / (all_weights - used) AS level FROM c),
f AS (SELECT level AS final FROM l WHERE cap >= level * weight ORDER BY used, turn LIMIT 1),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce((SELECT final FROM f) * weight, cap::DOUBLE)) AS target FROM l),
q AS (SELECT d.doc_id, d.size, t.source_size, t.target,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS earlier
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  (greatest(0, least(size, floor(target)::BIGINT - earlier))
   + greatest(0, least(size, floor(target)::BIGINT - source_size - earlier)))::BIGINT AS taken
FROM q
"""
