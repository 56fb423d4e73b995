"""Removal of every word inside a long word sequence that occurs elsewhere too.

Not a De Bruijn graph: no k-mer edges are joined to their neighbours and no paths are
compacted by joins. Runs of windows of ``length`` words that share their least
``core``-gram are taken together in the task that reads the document, and meet by
hashes of that core and of their text (see ``repeats``): a run seen twice repeats as
a whole, a core with one run is unique, and only where a core has several runs are
these broken into windows and matched one by one. Coordinates in the source documents
carry each verdict back to the words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lotwise.llm.arrow import as_bytes, batch
from lotwise.llm.repeats import KEY, covered, repeated_windows, word_units
from lotwise.llm.rolling import NOT_SPACE, word_spans
from lotwise.llm.tables import keyed
from lotwise.staging import Staging

LENGTH = 35
CORE = 9
_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()), ("kept_sha256", pa.string())]
)


def _join_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The words with one space between them."""
    if not len(starts):
        return b""
    steps = np.zeros(len(data) + 1, np.int8)
    steps[starts] += 1
    stops = ends + 1
    stops[-1] -= 1  # no space after the last word
    out = data.copy()
    out[ends[:-1]] = 0x20
    np.add.at(steps, stops, -1)
    return out[np.cumsum(steps[:-1]) > 0].tobytes()


def _cut(length: int, keep_text: bool):
    schema = _SCHEMA if keep_text else _SCHEMA.remove(3)

    def task(batches):
        for rows in batches:
            data, bounds = as_bytes(rows["text"])
            out = []
            for i in range(rows.num_rows):
                own = data[bounds[i] : bounds[i + 1]]
                starts, ends, _ = word_spans(own, np.array([0, len(own)]), NOT_SPACE)
                gone = covered(rows["runs"], i, len(starts), length)
                kept = _join_words(own, starts[~gone], ends[~gone])
                out.append((len(starts), int(gone.sum()), kept.decode() if keep_text else "", hashlib.sha256(kept).hexdigest()))
            columns = [list(c) for c in zip(*out)] if out else [[]] * 4
            if not keep_text:
                columns.pop(2)
            yield batch(schema, rows["doc_id"], *columns)

    return task


def remove_repeated_words(docs: DataFrame, length: int = LENGTH, core: int = CORE, keep_text: bool = False, staging: Staging | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): words counted and removed.

    Words are runs of bytes other than ASCII white space. A word goes if a window
    of ``length`` words covering it starts at any other place. Null text has no
    words. ``keep_text`` adds the kept words, joined by one space (``kept``).
    """
    staging = staging or Staging(docs.sparkSession)
    rows = keyed(docs)
    runs = repeated_windows(rows, word_units, length, core, staging)
    fields = "doc_id BIGINT, n_words BIGINT, n_removed BIGINT, "
    fields += "kept STRING, kept_sha256 STRING" if keep_text else "kept_sha256 STRING"
    return rows.join(runs, KEY, "left").select("doc_id", "text", "runs").mapInArrow(_cut(length, keep_text), fields)
