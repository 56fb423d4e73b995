"""Windows of a fixed length that occur in more than one place of a corpus.

Sampling. Every window of ``length`` units is represented by one of its
``core``-grams, the least by hash. The choice depends on the window only, so two
equal windows share the core and its offset. A sampled position (anchor) stands
for the run of neighbouring windows that chose it, and for the text those
windows span: its context.

Naming. Cores are counted with map-side combine. An anchor whose core occurs once
is done: none of its windows repeats. Otherwise its context gets a name: 64 bits of
hash, over other values of the units than those of the core's. A name that occurs twice makes every window of the run repeat.

Induction. What is left are cores seen in several contexts of which some occur
once: the ends of repeated passages. One representative of every context is
broken into its windows, and windows are matched: either shuffled one by one and
compared by name, or, for bytes, by induced suffix sorting of all contexts of a
core in one shard (``induced``), shards streaming from an external sort.

Memory. Rows of a key are never gathered: counting combines on the map side,
joins meet one row per key behind a fresh shuffle (so a hot key is split), and
windows are matched over a sorted stream. A window is matched with
representatives only, so copies of a text weigh nothing there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.arrow import as_bytes, batch, text_slices
from lotwise.llm.induced import repeated_runs
from lotwise.llm.rolling import BASES, BYTE_VALUES, NOT_SPACE, SECOND_VALUES, Rolling, anchors, mix, word_hashes, word_spans
from lotwise.staging import Staging

KEY = ["__a", "__b"]
SHARD_ROWS = 4096  # contexts matched at a time
CROWDED = 1 << 15  # contexts of a core from which its windows are matched one by one


def byte_units(data, bounds):
    return BYTE_VALUES[data], SECOND_VALUES[data], bounds


def word_units(data, bounds):
    starts, ends, words = word_spans(data, bounds, NOT_SPACE)
    return word_hashes(data, starts, ends), word_hashes(data, starts, ends, 1), words


# Bytes and bounds of documents to two independent values of every unit, and bounds in units.
Units = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _contexts(units: Units, length: int, core: int, places: bool):
    """Task: anchors of each document, with their keys and windows if ``places``."""
    schema = pa.schema([("core", pa.int64()), ("name", pa.int64())])
    if places:
        keys = [pa.field(c, pa.int64()) for c in KEY]
        schema = pa.schema([*keys, *schema, ("low", pa.int32()), ("n", pa.int32()), ("offset", pa.int32())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for first, _, data, bounds in text_slices(rows["text"]):
                values, second, bounds = units(data, bounds)
                doc, at, low, high, cores = anchors(values, bounds, length, core)
                if not len(doc):
                    continue
                names = Rolling(second, BASES[1]).spans(low, high + length)
                names ^= mix((at - low).astype(np.uint64))
                columns = [_signed(cores), _signed(names)]
                if places:
                    keys = [rows[c].to_numpy()[first + doc] for c in KEY]
                    shape = [(low - bounds[doc]).astype(np.int32), (high - low + 1).astype(np.int32), (at - low).astype(np.int32)]
                    columns = [*keys, *columns, *shape]
                yield batch(schema, *columns)

    return task


def _listed(rows: pa.RecordBatch):
    """Slices of texts with their listed contexts, flattened.

    Yields (document of each context, its fields, bytes, bounds, first row).
    """
    listed = rows["contexts"]
    fields = listed.flatten()
    per_row = np.diff(listed.offsets.to_numpy())
    ends = np.cumsum(per_row)
    columns = {f.name: fields.field(f.name).to_numpy(zero_copy_only=False) for f in fields.type}
    for first, last, data, bounds in text_slices(rows["text"]):
        part = slice(ends[first] - per_row[first], ends[last - 1])
        doc = np.repeat(np.arange(last - first), per_row[first:last])
        yield doc, {k: v[part] for k, v in columns.items()}, data, bounds, first


def _strings(length: int):
    """Task: the bytes that the listed contexts of each document span."""
    schema = pa.schema([("core", pa.int64()), *[(c, pa.int64()) for c in KEY], ("low", pa.int32()), ("offset", pa.int32()), ("open", pa.bool_()), ("context", pa.binary())])

    def task(batches):
        for rows in batches:
            for doc, own, data, bounds, first in _listed(rows):
                size = own["n"].astype(np.int64) + length - 1
                ends = np.cumsum(size)
                at = np.repeat(bounds[doc] + own["low"] - (ends - size), size) + np.arange(size.sum())
                offsets = np.concatenate([[0], ends]).astype(np.int64)
                context = pa.LargeBinaryArray.from_buffers(
                    pa.large_binary(), len(doc), [None, pa.py_buffer(offsets), pa.py_buffer(data[at])]
                )
                keys = [rows[c].to_numpy()[first + doc] for c in KEY]
                yield batch(schema, own["core"], *keys, own["low"], own["offset"], own["open"], context.cast(pa.binary()))

    return task


def _matched_strings(length: int):
    """Task: open windows found in two contexts of a core, from a stream sorted by core."""
    schema = pa.schema([*[(c, pa.int64()) for c in KEY], ("low", pa.int32()), ("n", pa.int32())])

    def match(rows: pa.RecordBatch):
        data, bounds = as_bytes(rows["context"])
        windows = np.diff(bounds) - length + 1
        row, low, n = repeated_runs(
            data[bounds[0] : bounds[-1]], bounds - bounds[0], rows["offset"].to_numpy(), windows,
            rows["core"].to_numpy(), rows["open"].to_numpy(zero_copy_only=False), length,
        )
        keys = [rows[c].to_numpy()[row] for c in KEY]
        return batch(schema, *keys, (rows["low"].to_numpy()[row] + low).astype(np.int32), n.astype(np.int32))

    def task(batches):
        held = None
        for rows in batches:
            for at in range(0, rows.num_rows, SHARD_ROWS):
                part = rows.slice(at, SHARD_ROWS)
                if held is not None:
                    part = pa.concat_batches([held, part])
                cores = part["core"].to_numpy()
                whole = int(np.flatnonzero(cores != cores[-1])[-1]) + 1 if cores[0] != cores[-1] else 0
                if whole:
                    yield match(part.slice(0, whole))
                held = part.slice(whole)
        if held is not None:
            yield match(held)

    return task


def _windows(units: Units, length: int):
    """Task: the windows of the listed contexts of each document, by name."""
    schema = pa.schema([("window", pa.int64()), ("core", pa.int64()), *[(c, pa.int64()) for c in KEY], ("at", pa.int32()), ("open", pa.bool_())])

    def task(batches):
        for rows in batches:
            for doc, own, data, bounds, first in _listed(rows):
                _, second, bounds = units(data, bounds)
                rolling, n = Rolling(second, BASES[1]), own["n"]
                inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(own["low"], n) + inside
                start = np.repeat(bounds[doc], n) + at
                keys = [np.repeat(rows[c].to_numpy()[first + doc], n) for c in KEY]
                yield batch(
                    schema,
                    _signed(rolling.spans(start, start + length)),
                    np.repeat(own["core"], n),
                    *keys,
                    at.astype(np.int32),
                    np.repeat(own["open"], n),
                )

    return task


def _matched(batches):
    """Task: open windows equal to a neighbour, from a stream sorted by name."""
    schema = pa.schema([*[(c, pa.int64()) for c in KEY], ("low", pa.int32()), ("n", pa.int32())])
    held = None  # the last row of the stream so far

    def emit(rows: pa.RecordBatch, repeated: np.ndarray):
        take = repeated & rows["open"].to_numpy(zero_copy_only=False)
        keys = [rows[c].to_numpy()[take] for c in KEY]
        return batch(schema, *keys, rows["at"].to_numpy()[take], np.ones(take.sum(), np.int32))

    for rows in batches:
        if not rows.num_rows:
            continue
        if held is not None:
            rows = pa.concat_batches([held, rows])
        names = np.stack([rows["window"].to_numpy(), rows["core"].to_numpy()])
        same = (names[:, 1:] == names[:, :-1]).all(axis=0)
        repeated = np.zeros(rows.num_rows, bool)
        repeated[1:] |= same
        repeated[:-1] |= same
        if held is not None and held_repeated:
            repeated[0] = True
        held, held_repeated = rows.slice(rows.num_rows - 1), bool(repeated[-1])
        yield emit(rows.slice(0, rows.num_rows - 1), repeated[:-1])
    if held is not None:
        yield emit(held, np.array([held_repeated]))


def _by_document(listed: DataFrame) -> DataFrame:
    """Contexts gathered per document: no more than the anchors of its own text."""
    return listed.groupBy(*KEY).agg(F.collect_list(F.struct("core", "low", "n", "offset", "open")).alias("contexts"))


def repeated_windows(
    docs: DataFrame, units: Units, length: int, core: int, staging: Staging, whole_strings: bool = False
) -> DataFrame:
    """Runs of repeated windows of ``docs`` (__a, __b, text): (__a, __b, runs).

    ``runs`` lists (low, n): the windows that start at units low … low + n - 1 of
    the document occur elsewhere too. One row per key that has any. With
    ``whole_strings`` (units are bytes) the contexts of a core are matched
    together, as strings; cores with very many of them still go window by window.
    """
    long, integer = "BIGINT", "INT"
    place = f"__a {long}, __b {long}"
    cores = (
        docs.select("text")
        .mapInArrow(_contexts(units, length, core, False), f"core {long}, name {long}")
        .groupBy("core")
        .agg(F.count(F.lit(1)).alias("c"), F.min("name").alias("least"), F.max("name").alias("most"))
        .where("c > 1")
        .selectExpr("core AS seen", "least < most AS mixed", "pmod(core, 2) AS seen_turn")
    )
    cores = staging.table(cores, "cores")
    anchored = docs.select(*KEY, "text").mapInArrow(
        _contexts(units, length, core, True), f"{place}, core {long}, name {long}, low {integer}, n {integer}, offset {integer}"
    )
    hits = anchored.withColumn("turn", F.expr("pmod(core, 2)")).join(
        cores, F.expr("core = seen AND turn = seen_turn")
    )
    hits = staging.table(hits.select(*KEY, "core", "name", "low", "n", "offset", "mixed"), "hits")
    mixed = hits.where("mixed")
    names = mixed.groupBy("core", "name").agg(
        F.count(F.lit(1)).alias("c"), F.min(F.struct(*KEY, "low", "n", "offset")).alias("first")
    )
    names = staging.table(names, "names")
    twice = names.where("c > 1").selectExpr("core AS core2", "name AS name2", "pmod(name, 2) AS turn2")
    named = mixed.withColumn("turn", F.expr("pmod(name, 2)")).join(
        twice, F.expr("core = core2 AND name = name2 AND turn = turn2"), "left_semi"
    )
    listed = names.selectExpr("first.*", "core", "c = 1 AS open")
    text = docs.select(*KEY, "text")
    matched = None
    if whole_strings:
        crowded = names.groupBy("core").count().where(f"count > {CROWDED}").select("core")
        crowded = staging.table(crowded, "crowded")
        contexts = text.join(_by_document(listed.join(crowded, "core", "left_anti")), KEY)
        strings = contexts.mapInArrow(_strings(length), f"core {long}, {place}, low {integer}, offset {integer}, open BOOLEAN, context BINARY")
        strings = strings.repartition("core").sortWithinPartitions("core")
        matched = strings.mapInArrow(_matched_strings(length), f"{place}, low {integer}, n {integer}")
        listed = None if crowded.isEmpty() else listed.join(crowded, "core", "left_semi")
    if listed is not None:
        windows = text.join(_by_document(listed), KEY).mapInArrow(
            _windows(units, length), f"window {long}, core {long}, {place}, at {integer}, open BOOLEAN"
        )
        windows = windows.repartition("window").sortWithinPartitions("window", "core")
        windows = windows.mapInArrow(_matched, f"{place}, low {integer}, n {integer}")
        matched = windows if matched is None else matched.unionByName(windows)
    found = hits.where("NOT mixed").select(*KEY, "low", "n").unionByName(named.select(*KEY, "low", "n")).unionByName(matched)
    return found.groupBy(*KEY).agg(F.collect_list(F.struct("low", "n")).alias("runs"))


def covered(runs: pa.ListArray, row: int, n_units: int, length: int) -> np.ndarray:
    """Mask of the units that the runs of one row cover."""
    steps = np.zeros(n_units + 1, np.int64)
    listed = runs[row].values
    if listed is not None and len(listed):
        low = listed.field("low").to_numpy()
        np.add.at(steps, low, 1)
        np.add.at(steps, low + listed.field("n").to_numpy() - 1 + length, -1)
    return np.cumsum(steps[:-1]) > 0
