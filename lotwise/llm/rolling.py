"""Rolling hashes and winnowing over integer sequences, vectorised.

A sequence is a flat array holding many documents. The hash of a span is a
polynomial of its units times an odd base, modulo 2**64, so any span's hash
follows from two prefix sums; results are mixed before use.
"""

from __future__ import annotations

import numpy as np

_SEEDS = np.random.default_rng(20_240_229)
BYTE_VALUES = _SEEDS.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
SECOND_VALUES = _SEEDS.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
POSITION_BITS = np.uint64(31)  # a document has fewer than 2**31 units
_POSITION_MASK = np.uint64((1 << 31) - 1)


def _power_table(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 19)
        tables = []
        for factor in (base, pow(base, -1, 1 << 64)):
            table = np.full(size, factor, np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        have = _powers[base] = tuple(tables)
        if size > 1 << 22:  # one very long document; do not keep its tables
            del _powers[base]
    return have


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any spans of ``values`` (uint64)."""

    def __init__(self, values: np.ndarray, base: int = BASES[0]):
        powers, self.inverse = _power_table(base, len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers[: len(values)], out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of each [start, end); spans of different lengths differ."""
        raw = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def grams(self, k: int) -> np.ndarray:
        """Hash of the ``k`` units from every position that has as many."""
        n = max(len(self.sums) - k, 0)
        return mix((self.sums[k:] - self.sums[:n]) * self.inverse[:n]) if n else np.empty(0, np.uint64)


def window_minima(hashes: np.ndarray, window: int) -> np.ndarray:
    """Position of the least hash in each run of ``window``, the leftmost of ties.

    Only the upper 33 bits are compared, so a choice depends on the run alone.
    """
    keys = (hashes >> POSITION_BITS << POSITION_BITS) | np.arange(len(hashes), dtype=np.uint64)
    width = 1
    while width * 2 <= window:
        keys = np.minimum(keys[:-width], keys[width:])
        width *= 2
    if width < window:
        shift = window - width
        keys = np.minimum(keys[:-shift], keys[shift:])
    return (keys & _POSITION_MASK).astype(np.int64)


def anchors(values: np.ndarray, bounds: np.ndarray, length: int, core: int):
    """Winnowed anchors of all windows of ``length`` units inside documents.

    Every window is represented by the least of its ``core``-grams. An anchor is
    one chosen core with the run of consecutive windows it represents:
    (document, core position, first window, last window, hash of the core).
    What a window chooses depends on the window's own units only, so equal
    windows have equal cores at equal offsets.
    """
    none = np.empty(0, np.int64)
    if len(values) < length:
        return none, none, none, none, np.empty(0, np.uint64)
    grams = Rolling(values).grams(core)
    chosen = window_minima(grams, length - core + 1)
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(chosen)]
    inside = np.arange(len(chosen)) + length <= bounds[doc + 1]
    change = np.empty(len(chosen) + 1, bool)
    change[0] = change[-1] = True
    change[1:-1] = (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1])
    edges = np.flatnonzero(change)
    first, last = edges[:-1], edges[1:] - 1
    keep = inside[first]
    first, last = first[keep], last[keep]
    return doc[first], chosen[first], first, last, grams[chosen[first]]


def word_spans(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray):
    """Words of each document: (starts, ends, word bounds of the documents).

    ``is_word`` says for each byte value whether it belongs to words.
    """
    word = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = np.zeros(len(data) + 1, bool)
    before[1:] = word
    here = np.zeros(len(data) + 1, bool)
    here[:-1] = word
    starts = np.flatnonzero(here & (~before | edge))
    ends = np.flatnonzero(before & (~here | edge))
    return starts, ends, np.searchsorted(starts, bounds)


NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False  # words [^\x20\x09-\x0D]+


# a random value for every byte at every place in a word, twice
_PLACES = 64
_TABLES = _SEEDS.integers(0, 2**64, (2, _PLACES * 256), dtype=np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: int = 0) -> np.ndarray:
    """Hash of each word [start, end); ``table`` chooses one of two independent ones.

    Not a polynomial: different words of few letters can agree in those for every
    base. Values of byte and place are looked up and added, beyond ``_PLACES`` mixed.
    """
    if not len(starts):
        return np.empty(0, np.uint64)
    place = np.arange(starts[0], ends[-1])
    place -= np.repeat(starts, np.diff(starts, append=ends[-1]))
    own = data[starts[0] : ends[-1]].astype(np.int64)
    values = _TABLES[table][np.minimum(place, _PLACES - 1) * 256 + own]
    far = np.flatnonzero(place >= _PLACES)
    if len(far):
        values[far] = mix(values[far] + place[far].astype(np.uint64) * np.uint64(BASES[table]))
    edges = np.empty(2 * len(starts), np.int64)
    edges[::2], edges[1::2] = starts, ends
    edges -= starts[0]
    sums = np.add.reduceat(np.append(values, np.uint64(0)), edges)[::2]
    return mix(sums + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
