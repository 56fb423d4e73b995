"""N-gram Jaccard join with count-vector R-trees.

A document's set is its distinct 5-word shingles; two documents link when the
Jaccard similarity reaches a threshold. The join is exact and symmetric.

Classes. Documents with equal sets are one class, named by a hash of the set.
Everything below is about classes, so copies weigh nothing.

Blocking. Of two linked sets, each has one of its ``n - ceil(t * n) + 1`` first
shingles in common with the other's, in any fixed order. The order puts shingles
of crowded buckets last (document counts of ``2**BUCKET_BITS`` hash buckets, from
all documents), so a passage that many documents share does not bring them together.
The place of a shingle bounds the overlap of sets that have it as their first one in
common, and so the size of a partner, the reach. Classes with a common shingle make
blocks in order of size, cut where no reach goes on; in a block only classes that
reach each other are compared. The block of their first common shingle keeps a pair.

Bound. Shingles are hashed into groups, one or two for each shingle of the set
and ``GROUPS`` at least; a class is a point of group counts. The overlap of two
sets is at most the sum of the coordinate minima. Groups are powers of two, so a
point folds to fewer coordinates. The bound also holds for boxes of points with
their upper corners: an R-tree over the points of a block, folded to ``GROUPS``
coordinates, skips whole boxes, and pairs that it leaves are bounded again with
all coordinates. Surviving pairs are verified on the shingles of their texts, by a
second, independent hash of the words.

Order of work. In a block every class is first tested with the least one
(linear), then, where classes are still apart, with others drawn by hash: that
settles groups of near copies. Blocks that still hold classes of different
components go through R-trees, in parts of bounded size, so that no pair of a
block is left out that could connect components. Classes that the bounds leave a
partner are searched again with their shingles, by groups of what may be connected:
a group of m classes is verified in place and gives m - 1 links at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.arrow import as_bytes, batch, small_batches, text_slices
from lotwise.llm.graph import connected_components
from lotwise.llm.rolling import NOT_SPACE, Rolling, mix, word_hashes, word_spans
from lotwise.llm.tables import keyed, row_key, set_aside
from lotwise.llm.tokens import packed, unpacked
from lotwise.operators.skew import join_unique
from lotwise.staging import Staging

SHINGLE = 5
PERCENT = 75
GROUPS = 64
BUCKET_BITS = 16
REACH_BITS = 32  # of a size, below the number of shingles
LEAF, FAN = 32, 16
PART = 256  # classes of a block in one part
TURNS = 2  # further classes of each block that all others are tested with
KEY = ["__a", "__b"]
_ASCII_LOWER = np.arange(256, dtype=np.uint8)
_ASCII_LOWER[65:91] += 32


def _shingles(data: np.ndarray, bounds: np.ndarray, k: int = SHINGLE, table: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle) of every shingle in order of the text; see ``shingle_sets``."""
    data = _ASCII_LOWER[data]
    starts, ends, words = word_spans(data, bounds, NOT_SPACE)
    rolling = Rolling(word_hashes(data, starts, ends, table))
    counts = np.diff(words)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(counts)), n)
    first = np.repeat(words[:-1], n) + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return doc, rolling.spans(first, first + np.minimum(counts, k)[doc])


def _distinct(doc: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each document, sorted by both; ``doc`` is sorted, ``values`` sorted in place."""
    starts = np.flatnonzero(np.diff(doc, prepend=-1)).tolist()
    for low, high in zip(starts, [*starts[1:], len(doc)]):
        values[low:high].sort()
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (values[1:] != values[:-1])
    return doc[new], values[new]


def shingle_sets(data: np.ndarray, bounds: np.ndarray, k: int = SHINGLE, table: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle) of every distinct shingle, sorted by both.

    ``table`` chooses one of two independent hashes of the words.
    Documents with fewer words than ``k`` have their whole sequence as shingle.
    """
    return _distinct(*_shingles(data, bounds, k, table))


def _totals(doc: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of 64-bit values per document, modulo 2**64; ``doc`` is sorted."""
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values)])
    return sums[np.searchsorted(doc, np.arange(n), "right")] - sums[np.searchsorted(doc, np.arange(n))]


def _class_names(doc: np.ndarray, shingles: np.ndarray, n: int) -> np.ndarray:
    second = _totals(doc, mix(shingles ^ np.uint64(0xA5A5A5A55A5A5A5A)), n)
    return mix(_totals(doc, mix(shingles), n) ^ mix(second)).view(np.int64)


_SETS = pa.schema(
    [("kind", pa.int32()), *[(c, pa.int64()) for c in KEY], ("doc_id", pa.int64()), ("class", pa.int64()), ("n", pa.int64()), ("counts", pa.binary())]
)


def _groups(sizes: np.ndarray) -> np.ndarray:
    """Coordinates of sets: a power of two, the size or ``GROUPS`` at least."""
    return 1 << np.ceil(np.log2(np.maximum(sizes, GROUPS))).astype(np.int64)


def _describe(batches):
    """Task: kind 0, a row per document; kind 1, its part of the bucket counts."""
    buckets = np.zeros(1 << BUCKET_BITS, np.int64)
    for rows in batches:
        for first, last, data, bounds in text_slices(rows["text"]):
            n_docs = last - first
            doc, shingles = shingle_sets(data, bounds)
            buckets += np.bincount((shingles >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(buckets))
            sizes = np.bincount(doc, minlength=n_docs)
            groups = _groups(sizes)
            ends = np.cumsum(groups)
            at = (ends - groups)[doc] + (mix(shingles) & (groups[doc] - 1).astype(np.uint64)).astype(np.int64)
            counts = np.bincount(at, minlength=ends[-1])
            points = [packed(p) for p in np.split(counts, ends[:-1])]
            own = rows.slice(first, n_docs)
            yield batch(
                _SETS, np.zeros(n_docs, np.int32), own["__a"], own["__b"], own["doc_id"],
                _class_names(doc, shingles, n_docs), sizes, points,
            )
    used = np.flatnonzero(buckets)
    none = pa.nulls(len(used), pa.int64())
    yield batch(_SETS, np.ones(len(used), np.int32), none, none, none, used, buckets[used], pa.nulls(len(used), pa.binary()))


def _prefixes(crowd: np.ndarray, percent: int):
    """Task: (shingle, class, size) of the first shingles of each class.

    ``size`` holds the number of shingles, and below it the reach: as many as a set may
    have that links and has this shingle as its first one in common. From the place of the
    shingle on, the set has ``left`` shingles, and the overlap is no more.
    """
    schema = pa.schema([("shingle", pa.int64()), ("class", pa.int64()), ("size", pa.int64())])
    shift = np.uint64(64 - BUCKET_BITS)

    def swapped(values, table):
        upper = values >> shift
        return values ^ ((upper ^ table[upper.astype(np.int64)]) << shift)

    def task(batches):
        seen = np.empty(0, np.int64)
        # a bucket is the upper bits of its shingles; in their place, its number in order of crowds
        bucket = np.argsort(crowd, kind="stable").astype(np.uint64)
        number = np.empty_like(bucket)
        number[bucket.astype(np.int64)] = np.arange(len(bucket), dtype=np.uint64)
        for rows in batches:
            for first, last, data, bounds in text_slices(rows["text"]):
                doc, shingles = _shingles(data, bounds)
                doc, ordered = _distinct(doc, swapped(shingles, number))
                shingles = swapped(ordered, bucket)
                names = _class_names(doc, shingles, last - first)
                sizes = np.bincount(doc, minlength=last - first)
                fresh = np.zeros(len(names), bool)  # copies within the task speak once
                fresh[np.unique(names, return_index=True)[1]] = True
                fresh &= ~np.isin(names, seen)
                seen = np.union1d(seen, names[fresh])
                left = np.cumsum(sizes)[doc] - np.arange(len(doc))
                reach = (100 + percent) * left // percent - sizes[doc]
                chosen = fresh[doc] & (100 * left >= percent * sizes[doc])
                doc, reach = doc[chosen], reach[chosen]
                yield batch(schema, shingles[chosen].view(np.int64), names[doc], sizes[doc] << REACH_BITS | reach)

    return task


def _shared(batches):
    """Task: (block, first class, its n, its reach, class, n, reach) for shingles of several classes.

    The stream is sorted by shingle, size and class. A shingle makes a block of its
    classes, or several: one ends where no class so far reaches the size of the next.
    A class that does not reach the least size of its block links with none in it.
    Nothing of a block is held but its first class and the longest reach.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("block", "first", "first_n", "first_reach", "class", "n", "reach")])
    held = None
    for rows in batches:
        if not rows.num_rows:
            continue
        shingle, name, size = (rows[c].to_numpy() for c in ("shingle", "class", "size"))
        if held is not None:
            shingle, name, size = (np.concatenate([[h], x]) for h, x in zip(held, (shingle, name, size)))
        n, reach = size >> REACH_BITS, size & ((1 << REACH_BITS) - 1)
        new = np.ones(len(shingle), bool)
        new[1:] = shingle[1:] != shingle[:-1]
        # the longest reach of the rows of the shingle up to each
        of = np.cumsum(new) << REACH_BITS
        longest = reach if held is None else np.concatenate([held[3:], reach[1:]])
        far = np.maximum.accumulate(of | longest) - of
        start = new.copy()
        start[1:] |= far[:-1] < n[1:]
        lead = np.maximum.accumulate(np.where(start, np.arange(len(start)), 0))
        other = (name != name[lead]) & (reach >= n[lead])
        other[1:] &= (name[1:] != name[:-1]) | start[1:]
        held = (shingle[-1], name[lead[-1]], size[lead[-1]], far[-1])
        by, block = lead[other], mix(shingle.view(np.uint64) + mix(n[lead].astype(np.uint64))).view(np.int64)
        yield batch(schema, block[other], name[by], n[by], reach[by], name[other], n[other], reach[other])


def _points(column: pa.Array) -> list[np.ndarray]:
    return [unpacked(p) for p in column.to_pylist()]


def _folded(points: list[np.ndarray], groups: int, kind=np.int64) -> np.ndarray:
    return np.stack([p.reshape(-1, groups).sum(0, dtype=kind) for p in points])


def _overlaps(left: list[np.ndarray], right: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bounds of the overlaps of left[i] and right[j], with all coordinates both have."""
    common = np.minimum(np.array([len(p) for p in left])[i], np.array([len(p) for p in right])[j])
    bound = np.zeros(len(i), np.int64)
    for groups in np.unique(common):
        pairs = np.flatnonzero(common == groups)
        own, at = np.unique(i[pairs], return_inverse=True)
        its, to = np.unique(j[pairs], return_inverse=True)
        x, y = (_folded([p[k] for k in ks], groups, np.uint16) for p, ks in ((left, own), (right, its)))
        step = max(1, (1 << 22) // int(groups))
        for k in range(0, len(pairs), step):
            bound[pairs[k : k + step]] = np.minimum(x[at[k : k + step]], y[to[k : k + step]]).sum(1, dtype=np.int64)
    return bound


def _may_link(overlap, n, m, percent: int):
    """Can sets of n and m elements with at most this overlap link."""
    return (100 + percent) * overlap >= percent * (n + m)


def _bounded(percent: int):
    """Task: pairs whose count vectors allow a link."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def task(batches):
        for rows in batches:
            at = np.arange(rows.num_rows)
            overlap = _overlaps(_points(rows["a_counts"]), _points(rows["b_counts"]), at, at)
            keep = _may_link(overlap, rows["a_n"].to_numpy(), rows["b_n"].to_numpy(), percent)
            yield batch(schema, rows["a"].to_numpy()[keep], rows["b"].to_numpy()[keep])

    return task


def tree_pairs(n: np.ndarray, counts: np.ndarray, component: np.ndarray, percent: int = PERCENT):
    """Pairs (i, j), i < j, of points in different components that may link.

    A packed R-tree: points in order of set size, ``LEAF`` to a leaf and ``FAN``
    leaves to a box. A box is bounded by its upper corner and least size.
    """
    order = np.lexsort((counts[:, 0], n))
    n, counts, component = n[order], counts[order], component[order]
    leaves = np.arange(0, len(n), LEAF)
    boxes = np.arange(0, len(leaves), FAN)
    leaf_top, leaf_n = np.maximum.reduceat(counts, leaves), np.minimum.reduceat(n, leaves)
    box_top, box_n = np.maximum.reduceat(leaf_top, boxes), np.minimum.reduceat(leaf_n, boxes)
    left, right = [], []
    for q, start in enumerate(leaves):
        own = slice(start, min(start + LEAF, len(n)))

        def reach(tops, sizes):
            return _may_link(np.minimum(tops, leaf_top[q]).sum(1), sizes, leaf_n[q], percent)

        near = np.flatnonzero(reach(box_top, box_n))
        near = (near[:, None] * FAN + np.arange(FAN)).ravel()
        near = near[(near >= q) & (near < len(leaves))]
        near = near[reach(leaf_top[near], leaf_n[near])]
        points = (near[:, None] * LEAF + np.arange(LEAF)).ravel()
        points = points[points < len(n)]
        if not len(points):
            continue
        overlap = np.minimum(counts[own][:, None, :], counts[points][None, :, :]).sum(2)
        good = _may_link(overlap, n[own][:, None], n[points][None, :], percent)
        good &= component[own][:, None] != component[points][None, :]
        good &= np.arange(own.start, own.stop)[:, None] < points[None, :]
        i, j = np.nonzero(good)
        left.append(i + start)
        right.append(points[j])
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return order[np.concatenate(left)], order[np.concatenate(right)]


def joining_links(i: np.ndarray, j: np.ndarray, sets: list[np.ndarray], component: np.ndarray, percent: int = PERCENT):
    """Those of the candidate pairs (i, j) that link and join components not joined before."""
    sizes = np.array([len(s) for s in sets], np.int64)
    bounds = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
    values, codes = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_inverse=True)
    marked = np.zeros(len(values), bool)
    group = np.unique(component, return_inverse=True)[1]  # of each set, kept up to date
    left, right = [], []
    order = np.argsort(i, kind="stable")
    i, j = i[order], j[order]
    starts = np.flatnonzero(np.diff(i, prepend=-1))
    for low, high in zip(starts, [*starts[1:], len(i)]):
        own, others = i[low], j[low:high]
        others = others[group[others] != group[own]]
        if not len(others):
            continue
        marked[codes[bounds[own] : bounds[own + 1]]] = True
        ends = np.cumsum(sizes[others])
        at = np.repeat(bounds[others] - ends + sizes[others], sizes[others]) + np.arange(ends[-1])
        common = np.diff(np.cumsum(marked[codes[at]])[ends - 1], prepend=0)
        marked[codes[bounds[own] : bounds[own + 1]]] = False
        for other in others[100 * common >= percent * (sizes[own] + sizes[others] - common)]:
            if group[other] != group[own]:
                group[group == group[other]] = group[own]
                left.append(own)
                right.append(other)
    return np.array(left, np.int64), np.array(right, np.int64)


def _runs(batches, keys: list[str]):
    """Rows of equal ``keys`` of a sorted stream, one record batch for each run."""
    held, key = [], None
    for rows in batches:
        if not rows.num_rows:
            continue
        values = np.stack([rows[c].to_numpy() for c in keys])
        cuts = np.flatnonzero((values[:, 1:] != values[:, :-1]).any(axis=0)) + 1
        for low, high in zip([0, *cuts], [*cuts, rows.num_rows]):
            if held and (values[:, low] != key).any():
                yield pa.concat_batches(held)
                held = []
            held.append(rows.slice(low, high - low))
            key = values[:, low]
    if held:
        yield pa.concat_batches(held)


def _candidates(rows: pa.RecordBatch, percent: int, near: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (n, counts, component) that the bounds leave, of different components.

    ``near`` says which pairs to ask for; those of one leaf need no tree.
    """
    n, points = rows["n"].to_numpy(), _points(rows["counts"])
    if near is not None and len(n) <= LEAF:
        i, j = np.nonzero(np.triu(near, 1))
    else:
        i, j = tree_pairs(n, _folded(points, GROUPS), rows["component"].to_numpy(), percent)
        if near is not None:
            i, j = i[near[i, j]], j[near[i, j]]
    keep = _may_link(_overlaps(points, points, i, j), n[i], n[j], percent)
    return i[keep], j[keep]


def _in_reach(rows: pa.RecordBatch) -> np.ndarray:
    """Which pairs of rows (n, reach, component) reach each other and are of different components."""
    n, reach, component = (rows[c].to_numpy() for c in ("n", "reach", "component"))
    reached = n <= reach[:, None]
    return reached & reached.T & (component != component[:, None])


def _candidate_groups(percent: int):
    """Task: (group, class, component) of classes of a part that the bounds leave a partner.

    A group is what such pairs connect, named by its classes: one found in several
    blocks is one group. A part gives a row per class at most.
    """
    schema = pa.schema([(c, pa.int64()) for c in ("group", "class", "component")])

    def task(batches):
        for rows in _runs(batches, ["block", "i", "j"]):
            near = _in_reach(rows)
            some = np.flatnonzero(near.any(axis=0))
            if not len(some):
                continue
            rows, near = rows.take(pa.array(some)), near[np.ix_(some, some)]
            i, j = _candidates(rows, percent, near)
            label = np.arange(rows.num_rows)
            while (label[i] != label[j]).any():
                least = np.minimum(label[i], label[j])
                for side in (i, j):
                    np.minimum.at(label, label[side], least)
                label = label[label]
            used = np.union1d(i, j)
            used = used[np.argsort(label[used], kind="stable")]
            name, of = rows["class"].to_numpy()[used], label[used]
            starts = np.flatnonzero(np.diff(of, prepend=-1))
            if len(starts):
                groups = np.add.reduceat(mix(name.view(np.uint64)), starts)
                groups = np.repeat(groups, np.diff(starts, append=len(of))).view(np.int64)
                yield batch(schema, groups, name, rows["component"].to_numpy()[used])

    return task


def _searched(percent: int):
    """Task: verified links that join components of each group, fewer than its classes."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def task(batches):
        for rows in _runs(batches, ["group"]):
            name = rows["class"].to_numpy()
            sets = [np.frombuffer(s, np.uint64) for s in rows["shingles"].to_pylist()]
            i, j = joining_links(*_candidates(rows, percent), sets, rows["component"].to_numpy(), percent)
            yield batch(schema, np.minimum(name[i], name[j]), np.maximum(name[i], name[j]))

    return task


def _second_sets(batches):
    """Task: (class, shingles), by the second hash of words, from the text of each class."""
    schema = pa.schema([("class", pa.int64()), ("shingles", pa.binary())])
    for rows in batches:
        for first, last, data, bounds in text_slices(rows["text"]):
            doc, shingles = shingle_sets(data, bounds, table=1)
            cuts = np.searchsorted(doc, np.arange(1, last - first))
            yield batch(schema, rows["class"].slice(first, last - first), [s.tobytes() for s in np.split(shingles, cuts)])


def _verified(percent: int):
    """Task: pairs whose texts' sets link. Of a run of rows with one a, its text is cut once."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def task(batches):
        for rows in batches:
            keep = np.zeros(rows.num_rows, bool)
            for first, last, data, bounds in text_slices(rows["b_text"]):
                doc, right = shingle_sets(data, bounds, table=1)
                a = rows["a"].slice(first, last - first).to_numpy()
                runs = np.flatnonzero(np.diff(a, prepend=~a[:1]))
                of = np.repeat(np.arange(len(runs)), np.diff(runs, append=len(a)))
                data, bounds = as_bytes(rows["a_text"].take(pa.array(first + runs)))
                run, left = shingle_sets(data[bounds[0] : bounds[-1]], bounds - bounds[0], table=1)
                own, its = np.bincount(run, minlength=len(runs))[of], np.bincount(doc, minlength=last - first)
                # shingles of each run and of all its rows together, those of the run first
                side = np.repeat([0, 1], [len(left), len(right)])
                both_run, both = np.concatenate([run, of[doc]]), np.concatenate([left, right])
                order = np.lexsort((side, both, both_run))
                both_run, both, side = both_run[order], both[order], side[order]
                new = np.ones(len(both), bool)
                new[1:] = (both[1:] != both[:-1]) | (both_run[1:] != both_run[:-1])
                in_run = side[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))] == 0 if len(new) else new
                hit = order[in_run & (side == 1)] - len(left)
                common = np.bincount(doc[hit], minlength=last - first)
                keep[first:last] = 100 * common >= percent * (own + its - common)
            yield batch(schema, rows["a"].to_numpy()[keep], rows["b"].to_numpy()[keep])

    return task


class _Join:
    def __init__(self, docs: DataFrame, percent: int, staging: Staging):
        self.percent, self.staging = percent, staging
        self.rows = keyed(docs)
        described = self.rows.selectExpr(*KEY, "CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(
            _describe, "kind INT, __a BIGINT, __b BIGINT, doc_id BIGINT, class BIGINT, n BIGINT, counts BINARY"
        )
        described = staging.table(described, "sets")
        self.sets = described.where("kind = 0").drop("kind")
        buckets = described.where("kind = 1").groupBy("class").agg(F.sum("n").alias("c"))
        self.crowd = np.zeros(1 << BUCKET_BITS, np.int64)
        for r in buckets.collect():  # at most 2**BUCKET_BITS rows
            self.crowd[r["class"]] = r["c"]
        classes = self.sets.where("n > 0").groupBy("class").agg(
            F.min("doc_id").alias("least"), F.min(F.struct(*KEY)).alias("key"),
            F.first("n").alias("n"), F.first("counts").alias("counts"),
        )
        self.classes = staging.table(classes, "classes")

    def shared(self) -> DataFrame:
        prefixes = self.rows.select("text").mapInArrow(
            _prefixes(self.crowd, self.percent), "shingle BIGINT, class BIGINT, size BIGINT"
        )
        prefixes = prefixes.repartition("shingle").sortWithinPartitions("shingle", "size", "class")
        fields = "block BIGINT, first BIGINT, first_n BIGINT, first_reach BIGINT, class BIGINT, n BIGINT, reach BIGINT"
        return self.staging.table(prefixes.mapInArrow(_shared, fields), "shared")

    def bounded(self, pairs: DataFrame) -> DataFrame:
        known = self.classes.select("class", "n", "counts")
        for side in ("a", "b"):
            own = known.selectExpr("class AS __class", f"n AS {side}_n", f"counts AS {side}_counts")
            pairs = join_unique(pairs, F.col(side), own, "__class").drop("__class")
        return pairs.mapInArrow(_bounded(self.percent), "a BIGINT, b BIGINT")

    def texts(self, needed: DataFrame) -> DataFrame:
        """(class, text) of one row of each class in ``needed`` (class, distinct)."""
        keys = needed.join(self.classes, "class").select("class", "key.*")
        texts = self.rows.select(*KEY, "text").join(keys.hint("merge"), KEY).dropDuplicates(["class"])
        return texts.select("class", "text")

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """``pairs`` (a, b: classes, distinct) that link, by the texts of one row of each."""
        pairs = self.staging.table(pairs, f"{name}-pairs")
        needed = pairs.selectExpr("a AS class").union(pairs.selectExpr("b AS class")).distinct()
        texts = self.staging.table(self.texts(needed), f"{name}-texts")
        for side in ("b", "a"):  # a, the class of many pairs, last: its rows come together
            own = texts.selectExpr("class AS __class", f"text AS {side}_text")
            pairs = join_unique(pairs, F.col(side), own, "__class").drop("__class")
        return self.staging.table(pairs.mapInArrow(_verified(self.percent), "a BIGINT, b BIGINT"), f"{name}-links")

    def links(self) -> DataFrame:
        """Enough verified links (a, b) to connect all linked classes."""
        shared = self.shared()
        pairs = shared.where("n <= first_reach AND first_n <= reach").selectExpr("least(first, class) AS a", "greatest(first, class) AS b").distinct()
        links = self.verified(self.bounded(pairs), "least")
        members = shared.select("block", "class", "n", "reach").union(shared.select("block", "first", "first_n", "first_reach").distinct())
        for turn in range(TURNS):
            open_blocks = self.open_blocks(members, links, f"turn{turn}")
            lead = F.min_by(F.struct("class", "component", "n", "reach"), F.xxhash64("class", F.lit(turn))).alias("lead")
            leads = open_blocks.groupBy(F.col("block").alias("__block")).agg(lead)
            pairs = join_unique(open_blocks, F.col("block"), leads, "__block")
            pairs = pairs.where("component <> lead.component AND n <= lead.reach AND lead.n <= reach")
            pairs = pairs.selectExpr("least(class, lead.class) AS a", "greatest(class, lead.class) AS b").distinct()
            links = links.unionByName(self.verified(self.bounded(pairs), f"turn{turn}"))
        members = self.open_blocks(members, links, "tree")
        members = members.withColumn("parts", F.expr(f"CAST(ceil(size / {PART}) AS INT)"))
        members = members.withColumn("part", F.expr("pmod(xxhash64(class), parts)"))
        parts = "transform(sequence(0, parts - 1), x -> named_struct('i', least(part, CAST(x AS BIGINT)), 'j', greatest(part, CAST(x AS BIGINT))))"
        members = members.select("block", "class", "component", "reach", F.explode(F.expr(parts)).alias("p")).select("*", "p.i", "p.j").drop("p")
        known = self.classes.selectExpr("class AS __class", "n", "counts")
        by = ["block", "i", "j"]
        members = join_unique(members, F.col("class"), known, "__class").select(*by, "class", "component", "reach", "n", "counts")
        members = members.repartition(*by).sortWithinPartitions(*by)
        groups = members.mapInArrow(_candidate_groups(self.percent), "group BIGINT, class BIGINT, component BIGINT")
        groups = self.staging.table(groups.distinct(), "tree-groups")
        sets = self.texts(groups.select("class").distinct()).mapInArrow(_second_sets, "class BIGINT, shingles BINARY")
        sets = self.staging.table(sets, "tree-sets").withColumnRenamed("class", "__class")
        groups = join_unique(groups, F.col("class"), known, "__class").drop("__class")
        groups = join_unique(groups, F.col("class"), sets, "__class").drop("__class")
        groups = groups.repartition("group").sortWithinPartitions("group")
        found = groups.mapInArrow(_searched(self.percent), "a BIGINT, b BIGINT")
        return links.unionByName(self.staging.table(found, "tree-links"))

    def open_blocks(self, members: DataFrame, links: DataFrame, name: str) -> DataFrame:
        """Members of blocks of over two classes that are not all connected by ``links``.

        A block of two classes was settled with the first links.
        """
        components = self.staging.table(connected_components(links, self.staging), f"{name}-components")
        known = components.selectExpr("id AS __id", "component")
        members = join_unique(members, F.col("class"), known, "__id", "left").selectExpr(
            "block", "class", "n", "reach", "coalesce(component, class) AS component"
        )
        members = self.staging.table(members, f"{name}-members")
        blocks = members.groupBy("block").agg(
            F.count(F.lit(1)).alias("size"), F.min("component").alias("low"), F.max("component").alias("high")
        )
        blocks = blocks.where("size > 2 AND low < high").selectExpr("block AS __block", "size")
        blocks = self.staging.table(blocks, f"{name}-blocks")
        return join_unique(members, F.col("block"), blocks, "__block").drop("__block")


def one_of_each(docs: DataFrame, percent: int = PERCENT, staging: Staging | None = None) -> DataFrame:
    """``docs`` with one row of each group of linked documents, that of least doc_id.

    A null doc_id comes after all others, ties are settled by a hash of the row.
    Rows without words are in no group and stay.
    """
    grouped = jaccard_components(docs, percent, staging)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", *KEY)).alias("first")
    kept = grouped.where("__component IS NOT NULL").groupBy("__component").agg(first).select("first.*").select(*KEY)
    rows, restore = set_aside(docs, "doc_id", "text")
    rows = rows.withColumns(row_key())
    with_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    chosen = rows.where(with_words).join(kept.hint("merge"), KEY, "left_semi").dropDuplicates(KEY)
    return chosen.select(*restore()).unionByName(rows.where(~with_words).select(*restore()))


def jaccard_components(docs: DataFrame, percent: int = PERCENT, staging: Staging | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, and
    __component (the same groups, null for an empty set), __a, __b.

    component_id is the least doc_id that links reach. Null text and text without
    words have an empty set and link with nothing; a null doc_id is never the
    least, unless alone. __a and __b are the row key of ``tables.keyed``.
    """
    staging = staging or Staging(docs.sparkSession)
    with small_batches(docs.sparkSession):
        join = _Join(docs, percent, staging)
        links = join.links()
    components = connected_components(links, staging)
    components = join.classes.select("class", "least").join(components, F.expr("class = id"), "left")
    components = components.selectExpr("class", "least", "coalesce(component, class) AS component")
    components = staging.table(components, "components")
    least = components.groupBy("component").agg(F.min("least").alias("component_id"))
    named = join_unique(components.select("class", "component"), F.col("component"), least.withColumnRenamed("component", "__of"), "__of")
    named = named.selectExpr("class AS __class", "component_id", "component AS __component")
    rows = join_unique(join.sets, F.expr("IF(n > 0, class, NULL)"), named, "__class", "left")
    return rows.selectExpr("doc_id", "n AS n_shingles", "IF(n > 0, component_id, doc_id) AS component_id", "__component", *KEY)
