"""Canonical length-limited Huffman codes over integer ids, vectorised.

A code is given by its lengths alone: codes of one length are consecutive
numbers in order of id, shorter codes come first. Streams are written most
significant bit first, with a checkpoint (bit offset) every ``STRIDE`` ids, so a
reader decodes all stretches between checkpoints side by side.
"""

from __future__ import annotations

import numpy as np

LIMIT = 16
STRIDE = 128


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal lengths of at most ``limit`` bits by package-merge; 0 where count is 0."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids do not fit codes of {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.float64)  # exact below 2**53
    merged, is_leaf = leaves, [np.ones(len(leaves), bool)]
    for _ in range(limit - 1):
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, packages])
        order = np.argsort(both, kind="stable")
        merged = both[order]
        is_leaf.append(order < len(leaves))
    depth = np.zeros(len(leaves), np.int64)
    take = 2 * len(leaves) - 2
    for flags in reversed(is_leaf):
        own = int(flags[:take].sum())
        depth[:own] += 1
        take = 2 * (take - own)
    lengths[used] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes = np.zeros(len(lengths), np.uint32)
    if len(order):
        sizes = lengths[order].astype(np.int64)
        top = int(sizes[-1])
        steps = 1 << (top - sizes)
        codes[order] = (np.cumsum(steps) - steps) >> (top - sizes)
    return codes


def encode(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """(bit stream, bit offset of every STRIDE-th id)."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    total = int(ends[-1]) if len(ids) else 0
    # a code of at most 16 bits at a bit offset of at most 7 lies in three bytes
    placed = codes[ids].astype(np.int64) << (24 - size - (at & 7))
    out = np.zeros((total + 7) // 8 + 3, np.uint8)
    for byte in range(3):
        part = np.bincount((at >> 3) + byte, (placed >> (16 - 8 * byte)) & 255, len(out))
        out += part[: len(out)].astype(np.uint8)
    return out[: (total + 7) // 8].tobytes(), at[::STRIDE].astype(np.uint32)


class Decoder:
    """Table-driven decoder: the next ``top`` bits name an id and its length."""

    def __init__(self, lengths: np.ndarray):
        self.top = int(lengths.max(initial=1))
        codes = canonical_codes(lengths)
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        spans = 1 << (self.top - lengths[order].astype(np.int64))
        starts = codes[order].astype(np.int64) << (self.top - lengths[order].astype(np.int64))
        self.ids = np.zeros(1 << self.top, np.uint32)
        self.sizes = np.ones(1 << self.top, np.int64)
        fill = np.repeat(starts, spans) + np.arange(spans.sum()) - np.repeat(np.cumsum(spans) - spans, spans)
        self.ids[fill] = np.repeat(order, spans)
        self.sizes[fill] = np.repeat(lengths[order], spans)

    def decode(self, streams: list[bytes], checkpoints: list[np.ndarray], counts: list[int]) -> list[np.ndarray]:
        """The ids of each stream; all stretches of all streams go side by side."""
        data = np.frombuffer(b"".join(streams) + bytes(4 + STRIDE * 2), np.uint8).astype(np.uint32)
        word = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
        base = np.cumsum([0, *[len(s) for s in streams]])[:-1] * 8
        at = np.concatenate([b + c.astype(np.int64) for b, c in zip(base, checkpoints)]) if streams else np.empty(0, np.int64)
        out = np.empty((len(at), STRIDE), np.uint32)
        last = (len(word) - 1) * 8
        for i in range(STRIDE):
            bits = ((word[at >> 3].astype(np.uint64) << (at & 7).astype(np.uint64)) & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - self.top)
            out[:, i] = self.ids[bits]
            at = np.minimum(at + self.sizes[bits], last)
        flat, found, row = out.ravel(), [], 0
        for marks, n in zip(checkpoints, counts):
            found.append(flat[row * STRIDE : row * STRIDE + n])
            row += len(marks)
        return found
