"""Near-duplicate vectors by sorted projection passes.

Each pass gives every vector a key, the signs of random projections written one
after the other, sorts all vectors by (label, key) and compares each with the
vectors a bounded distance before it in that order. Verified pairs of all passes
form the components. A pass misses pairs, the more the larger or narrower a label
is, and at the edges of its partitions; so further passes go over every label in
which the last ones joined components, until they join none. Cosines are taken
again between all members of a component, in blocks, so that the number of links
of a vector does not depend on the window.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.arrow import batch
from lotwise.llm.graph import connected_components
from lotwise.operators.skew import join_unique
from lotwise.staging import Staging

THRESHOLD = 0.98
PASSES = 6
WINDOW = 512
BLOCK = 1024
BITS = 63


def _sort_keys(number: int):
    """Task: adds the key of one pass."""

    def task(batches):
        for rows in batches:
            keys = np.zeros(rows.num_rows, np.int64)
            sizes = rows["dim"].to_numpy()
            listed = rows["embedding"]
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                x = listed.take(pa.array(at)).flatten().to_numpy().reshape(len(at), dim).astype(np.float64)
                planes = np.random.default_rng([number, int(dim)]).standard_normal((dim, BITS))
                keys[at] = (x @ planes > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
            columns = [rows[c] for c in rows.schema.names] + [pa.array(keys)]
            yield pa.RecordBatch.from_arrays(columns, names=[*rows.schema.names, "key"])

    return task


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x @ y.T) / np.outer(np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1)))


def _least_reachable(linked: np.ndarray) -> np.ndarray:
    """Least index reachable in a symmetric boolean matrix, for each index."""
    least = np.arange(len(linked))
    while True:
        lower = np.minimum(least, np.where(linked, least, len(linked)).min(axis=1, initial=len(linked)))
        lower = lower[lower]
        if (lower == least).all():
            return least
        least = lower


def _neighbours(threshold: float, window: int):
    """Task: links between rows of a sorted stream at most ``window`` apart or so."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("label", pa.int64())])

    def task(batches):
        held = None
        for rows in batches:
            for start in range(0, rows.num_rows, window):
                part = rows.slice(start, window)
                if held is not None:
                    part = pa.concat_batches([held, part])
                held = part.slice(max(0, part.num_rows - window))
                sizes, labels = part["dim"].to_numpy(), part["label"].to_numpy()
                ids, listed = part["vec_id"].to_numpy(), part["embedding"]
                for dim in np.unique(sizes):
                    at = np.flatnonzero(sizes == dim)
                    x = listed.take(pa.array(at)).flatten().to_numpy().reshape(len(at), dim).astype(np.float64)
                    linked = _cosines(x, x) >= threshold
                    linked &= labels[at][:, None] == labels[at][None, :]
                    least = _least_reachable(linked)
                    moved = np.flatnonzero(least != np.arange(len(at)))
                    yield batch(schema, ids[at][least[moved]], ids[at][moved], labels[at][moved])

    return task


def _count_links(threshold: float):
    def count(block: pd.DataFrame) -> pd.DataFrame:
        low, high = block["i"].iloc[0], block["j"].iloc[0]
        x = np.stack(block["embedding"].to_numpy()).astype(np.float64)
        own, copies = block["part"].to_numpy(), block["copies"].to_numpy()
        left, right = np.flatnonzero(own == low), np.flatnonzero(own == high)
        linked = _cosines(x[left], x[right]) >= threshold
        links = np.zeros(len(block), np.int64)
        if low == high:
            np.fill_diagonal(linked, False)
            links[left] = linked @ copies[right] + copies[left] - 1
        else:
            links[left] = linked @ copies[right]
            links[right] = copies[left] @ linked
        return pd.DataFrame({"__a": block["__a"], "__b": block["__b"], "links": links})

    return count


def near_duplicate_vectors(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    passes: int = PASSES,
    window: int = WINDOW,
    staging: Staging | None = None,
) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label).

    n_links counts the other vectors of the component with cosine >= threshold,
    component_id is the least vec_id reached, kept marks it. Vectors that are
    null, empty, zero or hold null or non-finite components, and rows without
    label or vec_id, link with nothing; so do vectors of different lengths.
    Repeated rows are linked with each other.
    """
    staging = staging or Staging(vectors.sparkSession)
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        "label",
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.xxhash64("vec_id", "label", "embedding").alias("__a"),
        F.xxhash64("embedding", F.lit(7), "label", "vec_id").alias("__b"),
    )
    usable = rows.where(
        "vec_id IS NOT NULL AND label IS NOT NULL AND exists(embedding, x -> x <> 0) AND "
        "forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    )
    usable = usable.groupBy("__a", "__b").agg(
        F.count(F.lit(1)).alias("copies"),
        *[F.first(c).alias(c) for c in ("vec_id", "label", "embedding")],
    )
    usable = usable.selectExpr("*", "size(embedding) AS dim", "xxhash64(label) AS __label")
    usable = staging.table(usable, "vectors")
    narrow = usable.selectExpr("vec_id", "__label AS label", "dim", "embedding")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema)
    nodes, going, number = None, narrow, 0
    while True:
        links = None
        for number in range(number, number + passes):
            by = ["label", "dim", "key", "vec_id"]
            ordered = going.mapInArrow(_sort_keys(number), f"{fields}, key BIGINT")
            ordered = ordered.repartitionByRange(*by).sortWithinPartitions(*by)
            found = ordered.mapInArrow(_neighbours(threshold, window), "a BIGINT, b BIGINT, label BIGINT")
            found = staging.table(found.distinct(), f"pass{number}")
            links = found if links is None else links.unionByName(found)
        number += 1
        if nodes is not None:  # what joins components found before
            for end in ("a", "b"):
                known = links.select(F.col(end).alias("id")).distinct().join(nodes, "id", "left")
                known = known.selectExpr("id", "coalesce(component, id) AS reached")
                links = join_unique(links, F.col(end), known, "id").drop("id", end).withColumnRenamed("reached", end)
            links = links.where("a <> b").select("a", "b", "label").distinct()
            links = staging.table(links, f"joining{number}")
        labels = staging.table(links.where("a <> b").select("label").distinct(), f"labels{number}")
        if labels.isEmpty():
            break
        links = links.select("a", "b")
        if nodes is not None:
            links = links.unionByName(nodes.selectExpr("id AS a", "component AS b"))
        nodes = staging.table(connected_components(links, staging), f"components{number}")
        going = join_unique(narrow, F.col("label"), labels.selectExpr("label AS open"), "open").select(narrow.columns)
    if nodes is None:
        nodes = links.where("a <> b").selectExpr("a AS id", "b AS component")
    sizes = nodes.groupBy("component").agg(F.count(F.lit(1)).alias("size")).withColumnRenamed("component", "of")
    nodes = join_unique(nodes, F.col("component"), sizes, "of").select("id", "component", "size")
    members = usable.select("__a", "__b", "vec_id", "copies", "embedding")
    repeated = members.where("copies > 1").selectExpr("vec_id AS id", "vec_id AS component", "1L AS size")
    nodes = nodes.unionByName(repeated.join(nodes, "id", "left_anti").distinct())
    members = members.join(nodes, F.expr("vec_id = id"))
    blocks = F.expr(f"CAST(ceil(size / {BLOCK}) AS INT)")
    members = members.withColumn("blocks", blocks).withColumn("part", F.expr("pmod(__a, blocks)"))
    pairs = F.expr(
        "transform(sequence(0, blocks - 1), x -> "
        "named_struct('i', least(part, CAST(x AS BIGINT)), 'j', greatest(part, CAST(x AS BIGINT))))"
    )
    placed = members.select("__a", "__b", "component", "part", "copies", "embedding", F.explode(pairs).alias("p"))
    placed = placed.select("*", "p.i", "p.j").drop("p")
    counted = placed.groupBy("component", "i", "j").applyInPandas(
        _count_links(threshold), "__a BIGINT, __b BIGINT, links BIGINT"
    )
    counted = counted.groupBy("__a", "__b").agg(F.sum("links").alias("links"))
    component = members.select("__a", "__b", "component")
    result = rows.join(component, ["__a", "__b"], "left").join(counted, ["__a", "__b"], "left")
    return result.selectExpr(
        "vec_id",
        "coalesce(links, 0L) AS n_links",
        "coalesce(component, vec_id) AS component_id",
        "coalesce(component, vec_id) <=> vec_id AS kept",
    )
