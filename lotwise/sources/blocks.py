"""CSV records with line breaks, read by many tasks a file.

Spark cuts a text file into blocks at line ends. A line end lies inside a quoted
field exactly when an odd number of quotes stands before it in the file, so the
parities of whole blocks, summed up, say in which state each block starts, and
records are put together block by block. Only records that cross a block border
meet in a shuffle.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_WHOLE, _HEAD, _MIDDLE, _TAIL = range(4)
_FIELDS = "file BIGINT, start BIGINT, part INT, record STRING"
_SCHEMA = pa.schema(
    [("file", pa.int64()), ("start", pa.int64()), ("part", pa.int32()), ("record", pa.string())]
)


def csv_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``record``: the text of every record of CSV files, without each file's header.

    Quotes stand only around fields, or doubled inside quoted fields. Blank records
    are left out. The quotes are counted when this is called; the driver receives
    two numbers for each file block that starts inside a field, less than Spark's
    own list of the blocks. A record must fit in memory, a file need not.
    """
    lines = spark.read.text(path if isinstance(path, list) else [path], lineSep="\n").select(
        "value",
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
    )
    inside = _starting_inside(lines)
    parts = lines.select("file", "start", "value").mapInArrow(_records(inside), _FIELDS)
    records = parts.where(F.col("part") == _WHOLE).select("record")
    if any(len(starts) for starts in inside.values()):
        records = records.unionByName(_joined(parts.where(F.col("part") != _WHOLE)))
    return records


def _starting_inside(lines: DataFrame) -> dict[int, np.ndarray]:
    """For each file the sorted starts of the blocks that start inside a field."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    blocks = lines.groupBy("file", "start").agg(F.sum(quotes.cast("bigint")).alias("quotes"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    odd = blocks.withColumn("before", F.sum("quotes").over(earlier)).where("before % 2 = 1")
    starts = defaultdict(list)
    for row in odd.select("file", "start").collect():
        starts[row["file"]].append(row["start"])
    return {file: np.sort(np.array(found, np.int64)) for file, found in starts.items()}


def _joined(parts: DataFrame) -> DataFrame:
    """Records that cross blocks: a tail, blocks in the middle of the record, a head."""
    so_far = Window.partitionBy("file").orderBy("start", "part")
    begun = F.last(F.when(F.col("part") == _TAIL, F.col("start")), ignorenulls=True).over(so_far)
    pieces = F.array_sort(F.collect_list(F.struct("start", "part", "record")))
    whole = parts.withColumn("begun", begun).groupBy("file", "begun").agg(pieces.alias("pieces"))
    return whole.select(F.array_join("pieces.record", "\n").alias("record"))


def _blocks(batches):
    """(file, start, lines) of slices of one block, in file order."""
    for rows in batches:
        if not rows.num_rows:
            continue
        file, start = rows["file"].to_numpy(), rows["start"].to_numpy()
        cuts = np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1
        for low, high in zip([0, *cuts], [*cuts, rows.num_rows]):
            yield int(file[low]), int(start[low]), rows["value"].slice(low, high - low)


def _join_lines(lines: pa.Array, ends: np.ndarray) -> pa.Array:
    """Lines up to each end (exclusive) joined by line breaks."""
    offsets = pa.array(np.concatenate([[0], ends]), pa.int32())
    return pc.binary_join(pa.ListArray.from_arrays(offsets, lines), "\n")


def _records(inside: dict[int, np.ndarray]):
    """Task: records of each block, and its parts of records that cross its borders."""

    def batch(block, parts, records):
        n = len(records)
        return pa.RecordBatch.from_arrays(
            [pa.array([block[0]] * n, pa.int64()), pa.array([block[1]] * n, pa.int64()),
             pa.array(parts, pa.int32()), records.cast(pa.string())],
            schema=_SCHEMA,
        )

    def opened_before(block) -> bool:
        starts = inside.get(block[0], np.empty(0, np.int64))
        at = np.searchsorted(starts, block[1])
        return bool(at < len(starts) and starts[at] == block[1])

    def left_over(block, held, part):
        # the record that is open when the block ends
        if held:
            lines = pa.concat_arrays(held)
            yield batch(block, [_MIDDLE if part == _HEAD else _TAIL], _join_lines(lines, np.array([len(lines)])))

    def task(batches):
        block, held, odd, first, header = None, [], False, _WHOLE, False
        for file, start, lines in _blocks(batches):
            if (file, start) != block:
                yield from left_over(block, held, first)
                block, held = (file, start), []
                odd = opened_before(block)
                first, header = (_HEAD if odd else _WHOLE), start == 0
            quotes = pc.count_substring(lines, '"').to_numpy()
            open_after = (np.cumsum(quotes) + odd) % 2 == 1
            ends = np.flatnonzero(~open_after) + 1
            odd = bool(open_after[-1])
            if not len(ends):
                held.append(lines)
                continue
            before = sum(len(h) for h in held)
            closed = pa.concat_arrays([*held, lines.slice(0, ends[-1])])
            held = [lines.slice(ends[-1])] if ends[-1] < len(lines) else []
            records = _join_lines(closed, ends + before)
            parts = np.full(len(records), _WHOLE, np.int32)
            parts[0], first = first, _WHOLE
            keep = np.ones(len(records), bool)
            if header:
                keep[0], header = False, False
            keep &= (parts != _WHOLE) | (pc.utf8_length(pc.utf8_trim_whitespace(records)).to_numpy() > 0)
            yield batch(block, parts[keep], records.filter(pa.array(keep)))
        yield from left_over(block, held, first)

    return task
