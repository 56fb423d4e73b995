"""Removal of every byte inside a long byte string that occurs elsewhere too.

Not a full external suffix sort: there are no disk-backed priority queues and no
recursion. Suffixes are sampled (winnowed positions, at most ``length - CORE + 1``
apart) and get names; those whose name or core settles them need no sorting. The
rest, ends of repeated passages, are shuffled into shards by core and sorted there in
memory: sampled suffixes first, then by induction all suffixes before them, with
common prefixes carried along (``induced``). Shards stream from Spark's external
sort, which spills to disk, so a task holds the strings of one core at most.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lotwise.llm.arrow import as_bytes, batch
from lotwise.llm.repeats import KEY, byte_units, covered, repeated_windows
from lotwise.llm.tables import keyed
from lotwise.staging import Staging

LENGTH = 200
CORE = 40
_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary()), ("kept_sha256", pa.string())]
)


def _cut(length: int, keep_bytes: bool):
    schema = _SCHEMA if keep_bytes else _SCHEMA.remove(4)

    def task(batches):
        for rows in batches:
            data, bounds = as_bytes(rows["text"])
            out = []
            for i in range(rows.num_rows):
                own = data[bounds[i] : bounds[i + 1]]
                gone = covered(rows["runs"], i, len(own), length)
                spans = np.count_nonzero(gone[1:] > gone[:-1]) + int(gone[:1].sum())
                kept = own[~gone].tobytes()
                out.append((len(own), int(gone.sum()), int(spans), kept, hashlib.sha256(kept).hexdigest()))
            columns = [list(c) for c in zip(*out)] if out else [[]] * 5
            if not keep_bytes:
                columns.pop(3)
            yield batch(schema, rows["doc_id"], *columns)

    return task


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, core: int = CORE, keep_bytes: bool = False, staging: Staging | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): bytes counted and removed.

    A byte goes if a string of ``length`` bytes covering it starts at any other
    place, in the same document or not; matches never cross documents. Null text
    counts as empty. Rows that repeat are other places of the same strings.
    ``keep_bytes`` adds the remaining bytes (``kept``), which may split characters.
    """
    staging = staging or Staging(docs.sparkSession)
    rows = keyed(docs)
    runs = repeated_windows(rows, byte_units, length, core, staging, whole_strings=True)
    fields = "doc_id BIGINT, n_bytes BIGINT, n_removed BIGINT, n_spans BIGINT, "
    fields += "kept BINARY, kept_sha256 STRING" if keep_bytes else "kept_sha256 STRING"
    return rows.join(runs, KEY, "left").select("doc_id", "text", "runs").mapInArrow(_cut(length, keep_bytes), fields)
