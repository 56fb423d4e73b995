"""Token ids of every document, in compressed block files.

Ids come from the tokenizers library. A byte-level BPE works on pre-tokens that
it never crosses, and one starts at every blank that is the first or the last of a
run of white space. So texts are cut at blanks, the library encodes each different
piece once, and the ids are put together. Texts with a blank inside such a run, or a
NUL, are given to the library whole.

Files: a folder with ``codes`` (id, length: the canonical Huffman code) and
``blocks`` (Parquet; in order of part and block). A block holds whole documents
in ascending order, independent of other blocks: doc_ids, their numbers of ids,
the bit stream and its checkpoints.
"""

from __future__ import annotations

import os
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwise.llm.arrow import batch, once_a_process, small_batches, text_slices
from lotwise.llm.byte_words import JOINED, LETTERS, ByteWords, only_letters
from lotwise.llm.huffman import Decoder, canonical_codes, code_lengths, encode
from lotwise.staging import Staging

TOKENIZER = "byte_bpe_50k.json"
END_ID = 0
BLOCK_IDS = 1 << 16
CACHED = 600_000  # pieces a worker process remembers
SLICE = 1 << 20  # bytes of text encoded at once
ROWS = 200  # whose ids are counted at once
BLOCKS = 12  # read at once
# White space of Unicode, as code points.
_SPACE = r"\x09-\x0d\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
# A blank inside a run of white space, where pre-tokens do not start
INSIDE = rf"[{_SPACE}] (?:[{_SPACE}]|\z)|\x00"
# Pre-tokens start between a letter and one of these signs, too; _CLOSE marks such a place.
_SIGNS = rf"([{LETTERS}])([.,;:!?$%&*])"
_CLOSE = "\0"


class Encoder:
    """Ids of many texts at once, as one flat array and the counts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)  # of each id: a character of its name is a byte
        for name, i in vocabulary.items():
            self.bytes[i] = len(name)
        self.letters = ByteWords(self.tokenizer, self.bytes)
        self.forget()

    def forget(self):
        self.known: tuple[dict[str, int], ...] = ({}, {})  # words without and with a blank before
        self.entries = 0
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.first, self.count = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _joined(self, pieces: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of pieces that are cut again where they were, being joined, at their blanks."""
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.cumsum([len(p.encode()) for p in pieces])
        reached = np.cumsum(self.bytes[ids])
        last = np.searchsorted(reached, ends)
        if not len(reached) or reached[-1] != ends[-1] or (reached[last] != ends).any():
            return None
        return ids, np.diff(last + 1, prepend=0)

    def _apart(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.fromiter((i for own in ids for i in own), np.uint32), np.array([len(own) for own in ids])

    def learn(self, words: list[str], letters: np.ndarray, blank: int):
        """Have the library encode new pieces, many at a time: words of letters, of a blank and a word, or any."""
        ways = ([], [], [])
        for k, w in enumerate(words):
            if letters[k]:
                ways[0].append((w, w))
                continue
            p = w if not blank else w[1:] if w[:1] == _CLOSE else " " + w
            ways[2 if p[:1] != " " or len(p.split()) != 1 or p[-1].isspace() else 1].append((w, p))
        for way, own in zip((lambda p: self.letters(p, blank), self._joined, lambda p: None), ways):
            for start in range(0, len(own), JOINED):
                known, pieces = zip(*own[start : start + JOINED])
                found = way(pieces)
                if found is None:
                    found = self._apart([" " + w for w in known] if own is ways[0] and blank else list(pieces))
                self._remember(known, blank, *found)

    def _remember(self, words: list[str], blank: int, flat: np.ndarray, counts: np.ndarray):
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat) // 2 + len(flat), np.uint32)])
        at, n = self.entries, len(counts)
        if at + n > len(self.first):
            self.first, self.count = (np.concatenate([x, np.zeros(len(x) // 2 + n, np.int64)]) for x in (self.first, self.count))
        self.flat[self.used : self.used + len(flat)] = flat
        self.first[at : at + n] = self.used + np.cumsum(counts) - counts
        self.count[at : at + n] = counts
        self.known[blank].update(zip(words, range(at, at + n)))
        self.used += len(flat)
        self.entries += n

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each document) of UTF-8 bytes."""
        raw = pa.py_buffer(np.ascontiguousarray(data))
        texts = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), raw)
        listed = pc.split_pattern(pc.replace_substring_regex(texts, _SIGNS, rf"\1 {_CLOSE}\2"), " ")
        edges = listed.offsets.to_numpy()
        coded = listed.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False)
        letters, where = only_letters(coded.dictionary), coded.indices.to_numpy()
        # all parts of a text but the first follow a blank, unless marked
        after = np.ones(len(where), np.int64)
        after[edges[:-1][np.diff(edges) > 0]] = 0
        if self.entries > CACHED:
            self.forget()
        entry = np.zeros((len(words), 2), np.int64)
        for blank in (0, 1):
            used = np.flatnonzero(np.bincount(where[after == blank], minlength=len(words)))
            own = words[used].tolist()
            found = np.fromiter(map(self.known[blank].get, own, repeat(-1)), np.int64, len(own))
            new = np.flatnonzero(found < 0)
            fresh = [own[k] for k in new.tolist()]
            self.learn(fresh, letters[used[new]], blank)
            found[new] = np.fromiter(map(self.known[blank].__getitem__, fresh), np.int64, len(fresh))
            entry[used, blank] = found
        entry = entry[where, after]
        n = self.count[entry]
        total = np.concatenate([np.zeros(1, np.int64), np.cumsum(n)])
        ids = self.flat[np.repeat(self.first[entry] - total[:-1], n) + np.arange(total[-1])]
        per_doc = np.diff(total[edges])
        whole = np.flatnonzero(pc.match_substring_regex(texts, INSIDE).to_numpy(zero_copy_only=False))
        if len(whole):
            parts = np.split(ids, np.cumsum(per_doc)[:-1])
            for d in whole:
                parts[d] = np.array(self.tokenizer.encode(texts[d].as_py(), add_special_tokens=False).ids, np.uint32)
                per_doc[d] = len(parts[d])
            ids = np.concatenate(parts)
        return ids, per_doc


def encoder(path: str) -> Encoder:
    """One for each worker process, so that tasks share what it has learnt."""
    return once_a_process(("Encoder", path), lambda: Encoder(path))


def token_ids(docs: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, tie, n, ids) of every row, with the end id; ids as ``packed``."""
    schema = pa.schema([("doc_id", pa.int64()), ("tie", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])

    def task(batches):
        own_encoder = encoder(tokenizer)
        for rows in batches:
            for first, last, data, bounds in text_slices(rows["text"], SLICE):
                ids, counts = own_encoder.encode(data, bounds)
                ends = np.cumsum(counts)
                out, sizes = np.insert(ids, ends, end_id), counts + 1
                own = rows.slice(first, last - first)
                yield batch(schema, own["doc_id"], own["tie"], sizes, [packed(p) for p in np.split(out, np.cumsum(sizes)[:-1])])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("tie"), "text")
    return rows.mapInArrow(task, "doc_id BIGINT, tie BIGINT, n BIGINT, ids BINARY")


def packed(ids: np.ndarray) -> bytes:
    """Ids for a shuffle: byte planes of 16 or 32-bit numbers, compressed, and their number and width."""
    width = 2 if ids.max(initial=0) < 1 << 16 else 4
    planes = np.ascontiguousarray(ids.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return (len(ids) << 3 | width).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpacked(data: bytes) -> np.ndarray:
    head = int.from_bytes(data[:8], "little")
    n, width = head >> 3, head & 7
    planes = np.frombuffer(pa.decompress(memoryview(data)[8:], n * width, "zstd"), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{width}").ravel().astype(np.uint32)


def _ids_of(column: pa.Array) -> np.ndarray:
    return np.concatenate([np.empty(0, np.uint32), *[unpacked(d) for d in column.to_pylist()]])


def _counted(batches):
    """Task: (id, count) of its rows, unpacked a few at a time."""
    counts = np.zeros(0, np.int64)
    for rows in batches:
        for at in range(0, rows.num_rows, ROWS):
            own = np.bincount(_ids_of(rows["ids"].slice(at, ROWS)), minlength=len(counts))
            own[: len(counts)] += counts
            counts = own
    used = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["id", "count"])


def id_counts(ids: DataFrame) -> DataFrame:
    """(id, count) over all documents; a task sends one row per id at most."""
    return ids.select("ids").mapInArrow(_counted, "id BIGINT, count BIGINT").groupBy("id").agg(F.sum("count").alias("count"))


_BLOCK = pa.schema(
    [("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())),
     ("n_ids", pa.int64()), ("stream", pa.binary()), ("checkpoints", pa.binary())]
)


def _blocks(lengths: np.ndarray, block_ids: int):
    def task(batches):
        codes, part, number = canonical_codes(lengths), TaskContext.get().partitionId(), 0
        for rows in batches:
            sizes = rows["n"].to_numpy()
            ends, first = np.cumsum(sizes), 0
            while first < len(sizes):
                low = ends[first] - sizes[first]
                last = max(first + 1, int(np.searchsorted(ends, low + block_ids, "right")))
                own = _ids_of(rows["ids"].slice(first, last - first))
                stream, marks = encode(own, lengths, codes)
                members = pa.array([rows["doc_id"].slice(first, last - first).to_pylist()], pa.list_(pa.int64()))
                yield batch(_BLOCK, [part], [number], members, [sizes[first:last].tolist()], [len(own)], [stream], [marks.astype("<u4").tobytes()])
                first, number = last, number + 1

    return task


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS, staging: Staging | None = None) -> None:
    """Encode ``docs`` (doc_id, text) into ``folder``, in ascending doc_id order.

    Null doc_ids come first, rows of one doc_id in order of a hash of the text.
    Null text counts as empty; every document gets the end id. Of the vocabulary
    only counts of ids come to the driver.
    """
    spark = docs.sparkSession
    staging = staging or Staging(spark)
    with small_batches(spark):
        ids = staging.table(token_ids(docs, tokenizer, end_id), "ids")
    pairs = id_counts(ids).collect()  # at most one row per id of the vocabulary
    counts = np.zeros(max([end_id, *[r["id"] for r in pairs]]) + 1, np.int64)
    for r in pairs:
        counts[r["id"]] = r["count"]
    lengths = code_lengths(counts)
    code = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(code, "id BIGINT, length INT").write.parquet(f"{folder}/codes")
    by = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    ids.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(
        _blocks(lengths, block_ids),
        "part INT, block INT, doc_ids ARRAY<BIGINT>, sizes ARRAY<BIGINT>, n_ids BIGINT, stream BINARY, checkpoints BINARY",
    ).write.parquet(f"{folder}/blocks")


def read_token_files(spark: SparkSession, folder: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files.

    start counts the ids of all documents before; ``keep_ids`` adds the ids.
    """
    code = spark.read.parquet(f"{folder}/codes").collect()
    lengths = np.zeros(max([0, *[r["id"] for r in code]]) + 1, np.uint8)
    for r in code:
        lengths[r["id"]] = r["length"]
    blocks = spark.read.parquet(f"{folder}/blocks")
    past = (Window.unboundedPreceding, -1)
    parts = blocks.groupBy(F.col("part").alias("of")).agg(F.sum("n_ids").alias("own"))  # one row per written part
    parts = parts.select("of", F.coalesce(F.sum("own").over(Window.orderBy("of").rowsBetween(*past)), F.lit(0)).alias("earlier"))
    inside = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("block").rowsBetween(*past)), F.lit(0))
    starts = blocks.select("part", "block", "n_ids").withColumn("inside", inside)
    starts = starts.join(parts, F.expr("part = of")).selectExpr("part", "block", "earlier + inside AS first")
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int64()))] * keep_ids)

    def task(batches):
        decoder = Decoder(lengths)
        for rows in batches:
            for at in range(0, rows.num_rows, BLOCKS):
                own = rows.slice(at, BLOCKS)
                marks = [np.frombuffer(m, "<u4") for m in own["checkpoints"].to_pylist()]
                streams = own["stream"].to_pylist()
                found = decoder.decode(streams, marks, own["n_ids"].to_pylist())
                out = [[] for _ in schema]
                for ids, first, members, sizes in zip(found, own["first"].to_pylist(), own["doc_ids"].to_pylist(), own["sizes"].to_pylist()):
                    ids, low = ids.astype("<u4"), 0
                    for doc_id, n in zip(members, sizes):
                        part = ids[low : low + n]
                        values = (doc_id, first + low, n, zlib.crc32(part.tobytes()))
                        for column, value in zip(out, values + (part.tolist(),) * keep_ids):
                            column.append(value)
                        low += n
                yield batch(schema, *out)

    listed = "doc_id BIGINT, start BIGINT, n_tokens BIGINT, ids_crc32 BIGINT" + ", ids ARRAY<BIGINT>" * keep_ids
    return blocks.join(starts, ["part", "block"]).select("first", "doc_ids", "sizes", "n_ids", "stream", "checkpoints").mapInArrow(task, listed)
