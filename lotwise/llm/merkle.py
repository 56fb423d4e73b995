"""Merkle manifest of a dataset, its blocks in van Emde Boas layout.

A leaf is the hash of one document. Per source, leaves ascend by doc_id and every
three consecutive nodes are hashed into one until one is left, the subroot;
subroots in order of source likewise give the root. A lone node is its tree.

Storage. A tree is cut into aligned subtrees of ``HEIGHT`` levels (blocks); the
roots of its blocks are the bottom nodes of the next level of blocks. Inside a
block nodes lie in van Emde Boas order: the levels are split at half height, the
upper tree comes first, then the lower trees from left to right, each laid out
the same way. The place of a node follows from its depth and index alone, so any
path from root to leaf touches few neighbouring stretches at every cache size.

At scale. Leaves are hashed while the texts are read, by built-in functions; only
digests are shuffled. ``numbered`` gives every leaf its index without a task that
sees a source. A block has at most 3**HEIGHT bottom nodes, so a source of any size
spreads over its blocks. Paths go down block by block, once per block.
"""

from __future__ import annotations

from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm.tables import set_aside
from lotwise.operators.rows import numbered
from lotwise.staging import Staging

FAN = 3
HEIGHT = 6
DIGEST = 32
TREE = ["absent", "name"]  # a source; no source comes first
_TREE = "absent BOOLEAN, name STRING"


def digest(data: bytes) -> bytes:
    """Hash of concatenated texts, as lowercase hex."""
    return sha256(data).hexdigest().encode()


# ---- layout ----------------------------------------------------------------


def _nodes(levels: int) -> int:
    """Nodes of a complete tree."""
    return (FAN**levels - 1) // (FAN - 1)


@cache
def addresses(levels: int) -> tuple[np.ndarray, ...]:
    """Place of every node of a complete tree, by depth and index."""
    if levels == 1:
        return (np.zeros(1, np.int64),)
    upper = levels // 2
    lower = levels - upper
    below = []
    for depth, place in enumerate(addresses(lower)):
        index = np.arange(FAN ** (upper + depth))
        tree, inside = np.divmod(index, FAN**depth)
        below.append(_nodes(upper) + tree * _nodes(lower) + place[inside])
    return (*addresses(upper), *below)


def height(n: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def store(bottom: list[bytes], rise: int) -> bytes:
    """The subtree of ``rise`` levels above the bottom nodes (hex digests), laid out."""
    places = addresses(rise + 1)
    out = np.zeros((_nodes(rise + 1), DIGEST), np.uint8)
    for depth in range(rise, -1, -1):
        raw = bytes.fromhex(b"".join(bottom).decode())
        out[places[depth][: len(bottom)]] = np.frombuffer(raw, np.uint8).reshape(-1, DIGEST)
        bottom = [digest(b"".join(bottom[i : i + FAN])) for i in range(0, len(bottom), FAN)]
    return out.tobytes()


def siblings(stored: bytes, rise: int, n: int) -> list[list[tuple[bytes, bytes]]]:
    """Per depth, the deepest first: what stands left and right of each node in its run.

    ``n`` is the number of bottom nodes. The root of the block is not listed.
    """
    places = addresses(rise + 1)
    table = np.frombuffer(stored, np.uint8).reshape(-1, DIGEST)
    found = []
    for depth in range(rise, 0, -1):
        raw = table[places[depth][:n]].tobytes().hex().encode()
        size = 2 * DIGEST
        own = []
        for i in range(n):
            low = i - i % FAN
            own.append((raw[low * size : i * size], raw[(i + 1) * size : min(low + FAN, n) * size]))
        found.append(own)
        n = -(-n // FAN)
    return found


# ---- leaves ----------------------------------------------------------------


def _field(value: str) -> str:
    text = f"CAST({value} AS STRING)"
    return f"coalesce(concat(octet_length({text}), ':', {text}), '-')"


def leaf_hash(text: str = "text") -> Column:
    fields = ", ".join(map(_field, ("doc_id", "source", "lang", "n_chars", text)))
    return F.expr(f"sha2(concat({fields}), 256)")


def leaves(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """doc_id, source (TREE) and leaf of every row; ``other`` is the leaf that the
    row has with ``changed`` in place of its text, the same leaf without."""
    rows, _ = set_aside(docs, "doc_id", "source", "lang", "n_chars", "text")
    own = leaf_hash()
    if changed is None:
        other = own
    else:
        rows = rows.withColumn("__changed", changed)
        other = F.when(F.expr("__changed <=> text"), own).otherwise(leaf_hash("__changed"))
    return rows.select(
        "doc_id",
        F.col("source").isNull().alias("absent"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("name"),
        F.unhex(own).alias("leaf"),
        F.unhex(other).alias("other"),
    )


# ---- trees -----------------------------------------------------------------

_BLOCK = f"{_TREE}, block BIGINT, nodes_in_level BIGINT, nodes BINARY"
_PATH = "lefts ARRAY<BINARY>, rights ARRAY<BINARY>, subroot BINARY, root BINARY"


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def _in_block(n: int, block: int, width: int) -> tuple[int, int]:
    """(levels that a block rises, its bottom nodes) where the level has ``n`` nodes."""
    return height(min(n, width)), min(width, n - block * width)


def _stored(levels: int):
    width = FAN**levels
    schema = _arrow(_BLOCK)

    def task(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("pos")
        n, block = rows["n"][0].as_py(), rows["block"][0].as_py()
        rise, _ = _in_block(n, block, width)
        nodes = store([d.hex().encode() for d in rows["digest"].to_pylist()], rise)
        tree = [rows[c][0].as_py() for c in TREE]
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip([*tree, block, n, nodes], schema)], schema=schema)

    return task


def build(nodes: DataFrame, largest: int, staging: Staging, levels: int = HEIGHT) -> list[DataFrame]:
    """Levels of stored blocks above ``nodes`` (TREE, pos, n, digest), lowest first.

    ``n`` is the number of nodes of the tree, ``largest`` its maximum.
    """
    width, found = FAN**levels, []
    while True:
        dealt = nodes.selectExpr(*TREE, "pos", "n", "digest", f"pos DIV {width}L AS block")
        blocks = staging.table(dealt.groupBy(*TREE, "block").applyInArrow(_stored(levels), _BLOCK), f"blocks{len(found)}")
        found.append(blocks)
        if largest <= width:
            return found
        largest = -(-largest // width)
        up = f"CAST(ceil(nodes_in_level / {width}) AS BIGINT)"
        nodes = blocks.where(f"nodes_in_level > {width}").selectExpr(
            *TREE, "block AS pos", f"{up} AS n", f"substring(nodes, 1, {DIGEST}) AS digest"
        )


def tops(blocks: list[DataFrame], levels: int = HEIGHT) -> DataFrame:
    """(TREE, digest): the root of every tree."""
    found = None
    for level in blocks:
        own = level.where(f"nodes_in_level <= {FAN**levels}").selectExpr(*TREE, f"substring(nodes, 1, {DIGEST}) AS digest")
        found = own if found is None else found.unionByName(own)
    return found


def _descended(levels: int):
    """Task: the path of every bottom node of blocks, from the path of the block."""
    width = FAN**levels
    schema = _arrow(f"{_TREE}, pos BIGINT, {_PATH}")

    def task(batches):
        for rows in batches:
            for r in rows.to_pylist():
                rise, n = _in_block(r["nodes_in_level"], r["block"], width)
                beside = siblings(r["nodes"], rise, n)
                out = [[] for _ in schema]
                for i in range(n):
                    steps = [beside[d][i // FAN**d] for d in range(rise)]
                    lefts, rights = [s[0] for s in steps], [s[1] for s in steps]
                    values = (
                        r["absent"], r["name"], r["block"] * width + i,
                        lefts + r["lefts"], rights + r["rights"], r["subroot"], r["root"],
                    )
                    for column, value in zip(out, values):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return task


def paths(blocks: list[DataFrame], above: DataFrame, staging: Staging, levels: int = HEIGHT) -> DataFrame:
    """Lowest blocks with their paths to the root, from those of their trees (``above``)."""
    width, lower = FAN**levels, None
    for number in range(len(blocks) - 1, -1, -1):
        level = blocks[number]
        found = level.where(f"nodes_in_level <= {width}").join(above, TREE)
        if lower is not None:
            found = found.unionByName(level.join(lower.withColumnRenamed("pos", "block"), [*TREE, "block"]))
        if number:
            lower = staging.table(found.mapInArrow(_descended(levels), f"{_TREE}, pos BIGINT, {_PATH}"), f"paths{number}")
    return found


# ---- manifest --------------------------------------------------------------


class Manifest:
    """Tree over all rows of ``docs``, as stored tables.

    ``rows`` (TREE, pos, n, doc_id, leaf, other), ``blocks`` and ``source_blocks``
    (levels of blocks, lowest first), ``subroots`` (TREE, digest, pos, n).
    """

    def __init__(self, docs: DataFrame, changed: Column | None = None, staging: Staging | None = None, levels: int = HEIGHT):
        self.levels, self.staging = levels, staging or Staging(docs.sparkSession)
        hashed = self.staging.table(leaves(docs, changed), "leaves")
        order = [F.col("doc_id").asc_nulls_first(), F.col("leaf")]
        placed = numbered(hashed, order, "pos", self.staging, TREE, "n")
        self.rows = self.staging.table(placed, "placed")
        largest = self.rows.agg(F.max("n")).first()[0] or 0
        self.blocks = build(self.rows.withColumnRenamed("leaf", "digest"), largest, self.staging, levels)
        own = self.staging.table(tops(self.blocks, levels), "subroots")
        order = [F.col("absent").desc(), F.col("name")]
        self.subroots = self.staging.table(numbered(own, order, "pos", self.staging), "sources")
        sources = self.subroots.count()
        above = self.subroots.selectExpr("false AS absent", "'' AS name", "pos", f"{sources}L AS n", "digest")
        self.source_blocks = build(above, sources, self.staging, levels)

    def root(self) -> DataFrame:
        """(digest): one row, none without documents."""
        return tops(self.source_blocks, self.levels).select("digest")

    def _above(self) -> DataFrame:
        """(TREE, path of the subroot up to the root)."""
        none = "CAST(array() AS ARRAY<BINARY>)"
        top = tops(self.source_blocks, self.levels).selectExpr(
            *TREE, f"{none} AS lefts", f"{none} AS rights", "CAST(NULL AS BINARY) AS subroot", "digest AS root"
        )
        bottom = paths(self.source_blocks, top, self.staging, self.levels)
        steps = bottom.mapInArrow(_descended(self.levels), f"{_TREE}, pos BIGINT, {_PATH}").drop(*TREE, "subroot")
        found = self.subroots.select(*TREE, "pos", F.col("digest").alias("subroot")).join(steps, "pos").drop("pos")
        return self.staging.table(found, "above")

    def checked(self) -> DataFrame:
        """Every row of the documents with its proof, and the root that ``other`` gives.

        doc_id, leaf, subroot, root, proof_sha256 (hash of all siblings on the way
        up, left to right), folded_root and verified, digests as lowercase hex.
        """
        bottom = paths(self.blocks, self._above(), self.staging, self.levels)
        rows = self.rows.selectExpr(*TREE, "pos", "doc_id", "leaf", "other", f"pos DIV {FAN**self.levels}L AS block")
        by = [*TREE, "block"]
        return rows.groupBy(*by).cogroup(bottom.groupBy(*by)).applyInArrow(_folded(self.levels), _CHECKED)

    def check(self, docs: DataFrame) -> DataFrame:
        """Rows of ``docs`` that are not those of the manifest, by leaf: (doc_id, source, leaf)."""
        own = leaves(docs).selectExpr("doc_id", *TREE, "leaf")
        known = self.rows.select("leaf").distinct()
        odd = own.join(known, "leaf", "left_anti")
        return odd.selectExpr("doc_id", "IF(absent, NULL, name) AS source", "lower(hex(leaf)) AS leaf")


_CHECKED = "doc_id BIGINT, leaf STRING, subroot STRING, root STRING, proof_sha256 STRING, folded_root STRING, verified BOOLEAN"


def _folded(levels: int):
    """Task: rows of a block folded up through the block and its path."""
    width = FAN**levels
    schema = _arrow(_CHECKED)

    def task(rows: pa.Table, blocks: pa.Table) -> pa.Table:
        out = [[] for _ in schema]
        if rows.num_rows:
            (block,) = blocks.to_pylist()
            rise, n = _in_block(block["nodes_in_level"], block["block"], width)
            beside = siblings(block["nodes"], rise, n)
            higher = list(zip(block["lefts"], block["rights"]))
            rest = b"".join(left + right for left, right in higher)
            subroot, root = block["subroot"].hex(), block["root"].hex()
            listed = zip(*(rows[c].to_pylist() for c in ("doc_id", "pos", "leaf", "other")))
            for doc_id, pos, leaf, other in listed:
                at, proof, node = pos % width, b"", other.hex().encode()
                for depth in range(rise):
                    left, right = beside[depth][at // FAN**depth]
                    proof += left + right
                    node = digest(left + node + right)
                for left, right in higher:
                    node = digest(left + node + right)
                folded = node.decode()
                values = (doc_id, leaf.hex(), subroot, root, digest(proof + rest).decode(), folded, folded == root)
                for column, value in zip(out, values):
                    column.append(value)
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return task


def tampered() -> Column:
    """The text without line feeds, where the crc32 of the decimal doc_id is even."""
    return F.expr("IF(crc32(CAST(doc_id AS STRING)) % 2 = 0, replace(text, '\\n', ''), text)")


def manifest_check(docs: DataFrame, staging: Staging | None = None, levels: int = HEIGHT) -> DataFrame:
    """One row per row of ``docs`` (doc_id, source, lang, n_chars, text): its proof in
    the manifest of ``docs``, and whether it holds after ``tampered``.

    Null columns count as ``-``; a row without doc_id comes first in its source and
    is not tampered with. Rows of one doc_id are in order of their leaves; equal
    rows are leaves of their own. No rows give no rows. Other columns are ignored.
    """
    return Manifest(docs, tampered(), staging, levels).checked()


# ---- the same in SQL -------------------------------------------------------

_LEAF_SQL = " || ".join(
    f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars", "text")
)
# the low bit of crc32, bit by bit
_EVEN_CRC = """list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
  lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
    lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) & 1 = 1"""
_BESIDE = """SELECT *, coalesce(lag(h, 2) OVER run, '') || coalesce(lag(h) OVER run, '') AS l,
    coalesce(lead(h) OVER run, '') || coalesce(lead(h, 2) OVER run, '') AS r"""
ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('=' || source, '-') AS src, sha256({_LEAF_SQL}) AS leaf,
    sha256({_LEAF_SQL.replace("text", "changed")}) AS other
  FROM (SELECT *, CASE WHEN {_EVEN_CRC} THEN replace(text, chr(10), '') ELSE text END AS changed FROM documents)),
p AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    count(*) OVER (PARTITION BY src) AS n FROM d),
up AS (SELECT src, 0 AS lvl, pos AS idx, leaf AS h, n FROM p UNION ALL
  SELECT src, lvl + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3 FROM up WHERE n > 1
  GROUP BY src, lvl, idx // 3, n),
q AS (SELECT src, h AS subroot, row_number() OVER (ORDER BY src <> '-', src) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS lvl, pos AS idx, subroot AS h, n FROM q UNION ALL
  SELECT lvl + 1, idx // 3, sha256(string_agg(h, '' ORDER BY idx)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY lvl, idx // 3, n),
b AS ({_BESIDE} FROM up WINDOW run AS (PARTITION BY src, lvl, idx // 3 ORDER BY idx)),
t AS ({_BESIDE} FROM top WINDOW run AS (PARTITION BY lvl, idx // 3 ORDER BY idx)),
walk AS (SELECT src, pos, 0 AS lvl, pos AS idx, '' AS proof, other AS h FROM p UNION ALL
  SELECT w.src, w.pos, w.lvl + 1, w.idx // 3, proof || l || r, sha256(l || w.h || r)
  FROM walk w JOIN b ON w.src = b.src AND w.lvl = b.lvl AND w.idx = b.idx AND b.n > 1),
half AS (SELECT w.*, q.pos AS place, subroot FROM walk w JOIN b ON w.src = b.src AND w.lvl = b.lvl AND w.idx = b.idx AND b.n = 1
  JOIN q ON w.src = q.src),
rise AS (SELECT src, pos, subroot, 0 AS lvl, place AS idx, proof, h FROM half UNION ALL
  SELECT w.src, w.pos, w.subroot, w.lvl + 1, w.idx // 3, proof || l || r, sha256(l || w.h || r)
  FROM rise w JOIN t ON w.lvl = t.lvl AND w.idx = t.idx AND t.n > 1)
SELECT doc_id, leaf, subroot, t.h AS root, sha256(proof) AS proof_sha256, w.h AS folded_root, w.h = t.h AS verified
FROM rise w JOIN t ON w.lvl = t.lvl AND w.idx = t.idx AND t.n = 1 JOIN p ON w.src = p.src AND w.pos = p.pos
"""
