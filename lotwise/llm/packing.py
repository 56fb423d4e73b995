"""Packing of token ids into sequences of bounded length, online in bounded space.

Every task that reads documents keeps ``WINDOWS`` open sequences. A document is
cut into whole sequences first; what is left of it goes to the open sequence that
it fills best. When it fits none, the fullest one is emitted, and if that one
would stay short by more than ``SLACK`` ids, the start of the piece fills it up.
At the end the open sequences of ``FAN_IN`` tasks meet in one and are packed the
same way, round by round, until one task closes the last. So ids are not shuffled,
but for those of at most ``WINDOWS`` sequences a task.

A sequence is padded to the capacity unless its length is a power of two; the very
last ids are cut into such lengths and need no padding.

Ids come from the tokenizers library, which works on words that white space
separates. A task has every different word encoded once and remembers ``CACHED``.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm.arrow import once_a_process, small_batches, text_slices
from lotwise.llm.byte_words import LETTERS, ByteWords, only_letters
from lotwise.staging import Staging

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048
END_ID = 1
WINDOWS = 32
SLACK = 16
FAN_IN = 16
CACHED = 500_000  # words that a worker process remembers
SLICE = 1 << 21
JOINED = 1000  # words given to the library at once
# No token reaches over white space, nor from a letter to one of these signs.
_SIGNS = rf"([{LETTERS}])([.,;:!?$%&*])"


class WordEncoder:
    """Token ids of texts under a tokenizer that white space cuts (word-end BPE)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)  # a character of an id's name is a byte
        for name, i in vocabulary.items():
            bytes_of[i] = len(name.removesuffix("</w>"))
        self.letters = ByteWords(self.library, bytes_of)
        self.width = 2 if len(bytes_of) <= 1 << 16 else 4
        self.forget()

    def forget(self):
        self.known: dict[str, int] = {}
        self.flat, self.bounds = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _of_letters(self, words: list[str]):
        found = []
        for start in range(0, len(words), JOINED):
            part = words[start : start + JOINED]
            found.append(self.letters([w.lower() for w in part], 0) or self._any(part))
        return _joined(found)

    def _any(self, words: list[str]):
        found = []
        for start in range(0, len(words), JOINED):
            part = words[start : start + JOINED]
            own = self.library.encode_batch([part], is_pretokenized=True, add_special_tokens=False)[0]
            found.append((np.array(own.ids, np.int64), np.bincount(np.array(own.word_ids, np.int64), minlength=len(part))))
        return _joined(found)

    def learn(self, words: list[str], letters: np.ndarray):
        own, others = ([words[k] for k in np.flatnonzero(kind).tolist()] for kind in (letters, ~letters))
        ids, sizes = _joined([self._of_letters(own), self._any(others)])
        first = len(self.known)
        self.known.update(zip(own + others, range(first, first + len(words))))
        self.flat = np.concatenate([self.flat, ids.astype(np.uint32)])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each); a null text has none."""
        texts = pc.replace_substring_regex(pc.fill_null(texts, ""), _SIGNS, r"\1 \2")
        listed = pc.ascii_split_whitespace(texts)
        edges = listed.offsets.to_numpy() - listed.offsets[0].as_py()
        coded = listed.flatten().dictionary_encode()
        words, where = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        if len(self.known) > CACHED:
            self.forget()
        found = np.fromiter(map(self.known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(found < 0)
        fresh = [words[k] for k in new.tolist()]
        self.learn(fresh, only_letters(coded.dictionary)[new])
        found[new] = np.fromiter(map(self.known.__getitem__, fresh), np.int64, len(fresh))
        entry = found[where]
        sizes = np.diff(self.bounds)[entry]
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        at = np.repeat(self.bounds[entry] - total[:-1], sizes) + np.arange(total[-1])
        return self.flat[at], np.diff(total[edges])


def _joined(parts):
    return tuple(np.concatenate([np.zeros(0, np.int64), *own]) for own in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 2


def encoder(path: str) -> WordEncoder:
    """One for each worker process, so that tasks share what it has learnt."""
    return once_a_process(("WordEncoder", path), lambda: WordEncoder(path))


# ---- windows ---------------------------------------------------------------


@dataclass
class Piece:
    doc_id: int | None
    start: int
    doc_tokens: int
    ids: np.ndarray

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.doc_id, self.start, self.doc_tokens, self.ids[:n]),
            Piece(self.doc_id, self.start + n, self.doc_tokens, self.ids[n:]),
        )


Item = list[Piece]


def length(item: Item) -> int:
    return sum(len(p.ids) for p in item)


def cut(item: Item, n: int) -> tuple[Item, Item]:
    """The first ``n`` ids of an item and the rest."""
    head, at = [], 0
    while at < len(item) and n >= len(item[at].ids):
        head.append(item[at])
        n -= len(item[at].ids)
        at += 1
    if n == 0:
        return head, item[at:]
    first, rest = item[at].cut(n)
    return [*head, first], [rest, *item[at + 1 :]]


class Packer:
    """At most ``windows`` open sequences; emitted ones collect in ``done``."""

    def __init__(self, capacity: int = CAPACITY, windows: int = WINDOWS, slack: int = SLACK):
        self.capacity, self.windows, self.slack = capacity, windows, slack
        self.rooms: list[tuple[int, int]] = []  # (free ids, window), the fullest first
        self.open: dict[int, Item] = {}
        self.done: list[Item] = []
        self._number = 0

    def place(self, item: Item):
        """Put an item of at most ``capacity`` ids into windows."""
        n = length(item)
        while n:
            at = bisect_left(self.rooms, (n, -1))
            if at < len(self.rooms):
                room, window = self.rooms.pop(at)
            elif len(self.rooms) < self.windows:
                room, window = self.capacity, self._number
                self._number += 1
                self.open[window] = []
            else:
                room, window = self.rooms.pop(0)
                if room <= self.slack:
                    self.done.append(self.open.pop(window))
                    continue
            head, item = (item, []) if n <= room else cut(item, room)
            self.open[window] += head
            n -= (filled := length(head))
            if room == filled:
                self.done.append(self.open.pop(window))
            else:
                insort(self.rooms, (room - filled, window))

    def add(self, piece: Piece):
        """Put a document of any length into windows, whole sequences first."""
        while len(piece.ids) >= self.capacity:
            head, piece = piece.cut(self.capacity)
            self.done.append([head])
        if len(piece.ids):
            self.place([piece])

    def emitted(self) -> list[Item]:
        found, self.done = self.done, []
        return found

    def left(self) -> list[Item]:
        found = [self.open[window] for _, window in self.rooms]
        self.rooms, self.open = [], {}
        return found

    def close(self):
        """Emit what is open, one after the other; the last ids in powers of two."""
        rest: Item = []
        for item in self.left():
            rest += item
            if length(rest) >= self.capacity:
                head, rest = cut(rest, self.capacity)
                self.done.append(head)
        while n := length(rest):
            head, rest = cut(rest, 1 << (n.bit_length() - 1))
            self.done.append(head)


# ---- tasks -----------------------------------------------------------------

_PIECE = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("offset", pa.int64())]
_SCHEMA = pa.schema(
    [("part", pa.int64()), ("number", pa.int64()), ("open", pa.bool_()), ("n_tokens", pa.int64()),
     ("pieces", pa.list_(pa.struct(_PIECE))), ("ids", pa.binary())]
)
_FIELDS = (
    "part BIGINT, number BIGINT, open BOOLEAN, n_tokens BIGINT, pieces ARRAY<STRUCT<doc_id: BIGINT, start: BIGINT, "
    "length: BIGINT, ids_crc32: BIGINT, doc_tokens: BIGINT, offset: BIGINT>>, ids BINARY"
)


def _rows(items: list[Item], part: int, first: int, is_open: bool, width: int) -> pa.RecordBatch:
    """Sequences as rows, numbered from ``first``; ids as little-endian numbers of ``width`` bytes."""
    columns, bounds, sizes, streams = [[] for _ in _PIECE], [0], [], []
    for item in items:
        offset = 0
        for p in item:
            n, crc = len(p.ids), zlib.crc32(p.ids.astype("<u4").tobytes())
            for column, value in zip(columns, (p.doc_id, p.start, n, crc, p.doc_tokens, offset)):
                column.append(value)
            offset += n
        bounds.append(len(columns[0]))
        sizes.append(offset)
        streams.append(np.concatenate([p.ids for p in item]).astype(f"<u{width}").tobytes())
    pieces = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _PIECE)], [name for name, _ in _PIECE])
    listed = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pieces)
    n = len(items)
    arrays = [
        pa.array([part] * n, pa.int64()), pa.array(range(first, first + n), pa.int64()), pa.array([is_open] * n, pa.bool_()),
        pa.array(sizes, pa.int64()), listed.cast(_SCHEMA.field("pieces").type), pa.array(streams, pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=_SCHEMA)


def _packed(path: str, end_id: int, capacity: int, windows: int, slack: int):
    """Task: documents (doc_id, text) into emitted and open sequences."""

    def task(batches):
        words, packer = encoder(path), Packer(capacity, windows, slack)
        part, number = TaskContext.get().partitionId(), 0
        for rows in batches:
            text = rows["text"].cast(pa.string())
            for first, last, _, _ in text_slices(text, SLICE):
                ids, sizes = words.encode(text.slice(first, last - first))
                low = 0
                for doc_id, n in zip(rows["doc_id"].slice(first, last - first).to_pylist(), sizes.tolist()):
                    own = np.append(ids[low : low + n], np.uint32(end_id))
                    packer.add(Piece(doc_id, 0, n + 1, own))
                    low += n
                done = packer.emitted()
                if done:
                    yield _rows(done, part, number, False, words.width)
                number += len(done)
        left = packer.left()
        if left:
            yield _rows(left, part, 0, True, words.width)

    return task


def _merged(width: int, capacity: int, windows: int, slack: int, last: bool):
    """Task: open sequences of several parts, the longest first, packed again."""

    def task(rows: pa.Table) -> pa.Table:
        packer = Packer(capacity, windows, slack)
        rows = rows.sort_by([("n_tokens", "descending"), ("part", "ascending"), ("number", "ascending")])
        for pieces, stream in zip(rows["pieces"].to_pylist(), rows["ids"].to_pylist()):
            ids, item = np.frombuffer(stream, f"<u{width}").astype(np.uint32), []
            for p in pieces:
                own = ids[p["offset"] : p["offset"] + p["length"]]
                item.append(Piece(p["doc_id"], p["start"], p["doc_tokens"], own))
            packer.place(item)
        if last:
            packer.close()
        part, done, left = rows["up"][0].as_py(), packer.emitted(), packer.left()
        return pa.Table.from_batches([_rows(done, part, 0, False, width), _rows(left, part, 0, True, width)])

    return task


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = END_ID,
    capacity: int = CAPACITY,
    windows: int = WINDOWS,
    slack: int = SLACK,
    fan_in: int = FAN_IN,
    staging: Staging | None = None,
) -> DataFrame:
    """Sequences of at most ``capacity`` ids of ``docs`` (doc_id, text).

    sequence_id (from 0, without gaps), n_tokens, pieces (doc_id, start in the
    document, length, ids_crc32, doc_tokens, offset in the sequence) and ids, as
    little-endian numbers of 2 bytes, of 4 if the vocabulary is larger. Null text
    is empty; every row gets the end id, so each has a piece, also rows repeated or
    without doc_id. No rows give no sequences.
    """
    staging = staging or Staging(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    limits = (capacity, windows, slack)
    with small_batches(docs.sparkSession):
        found = staging.table(rows.mapInArrow(_packed(tokenizer, end_id, *limits), _FIELDS), "round0")
    parts = (found.agg(F.max("part")).first()[0] or 0) + 1
    rounds, width = [found.where("NOT open")], encoder(tokenizer).width
    while parts:
        parts = -(-parts // fan_in) if parts > 1 else 1
        grouped = found.where("open").withColumn("up", F.expr(f"part DIV {fan_in}")).groupBy("up")
        last = parts == 1
        found = staging.table(grouped.applyInArrow(_merged(width, *limits, last), _FIELDS), f"round{len(rounds)}")
        rounds.append(found.where("NOT open"))
        if last:
            break
    numbered = None
    for number, own in enumerate(rounds):
        own = own.withColumn("round", F.lit(number))
        numbered = own if numbered is None else numbered.unionByName(own)
    counts = numbered.groupBy("round", "part").agg(F.count(F.lit(1)).alias("own"))  # one row per task
    before = Window.orderBy("round", "part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("round", "part", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("earlier"))
    counts = staging.table(counts, "counts")
    return numbered.join(counts, ["round", "part"]).selectExpr("earlier + number AS sequence_id", "n_tokens", "pieces", "ids")


def pieces(sequences: DataFrame) -> DataFrame:
    """One row per piece of ``pack``: its fields and sequence_id."""
    return sequences.select("sequence_id", F.explode("pieces").alias("p")).select("p.*", "sequence_id")
