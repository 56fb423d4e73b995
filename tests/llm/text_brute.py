"""Plain Python versions of the text operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def _covered(units, seen, length):
    gone = [False] * len(units)
    for i in range(len(units) - length + 1):
        if seen[units[i : i + length]] > 1:
            gone[i : i + length] = [True] * length
    return gone


def _windows(all_units, length):
    return Counter(u[i : i + length] for u in all_units for i in range(len(u) - length + 1))


def repeated_bytes(rows, length=200):
    raw = [(t or "").encode() for _, t in rows]
    seen, out = _windows(raw, length), []
    for (doc_id, _), own in zip(rows, raw):
        gone = _covered(own, seen, length)
        spans = len(re.findall("1+", "".join("01"[g] for g in gone)))
        out.append((doc_id, len(own), sum(gone), spans, sha(bytes(b for b, g in zip(own, gone) if not g))))
    return out


def repeated_words(rows, length=35):
    lists = [tuple(words(t)) for _, t in rows]
    seen, out = _windows(lists, length), []
    for (doc_id, _), own in zip(rows, lists):
        gone = _covered(own, seen, length)
        kept = " ".join(w for w, g in zip(own, gone) if not g)
        out.append((doc_id, len(own), sum(gone), sha(kept.encode())))
    return out


def contamination(rows, items, window=10):
    where = defaultdict(set)
    for item_id, text in items:
        own = BENCH_WORD.findall((text or "").translate(LOWER))
        span = min(len(own), window)
        for i in range(len(own) - span + 1 if own else 0):
            where[tuple(own[i : i + span])].add(item_id)
    spans, out = {len(w) for w in where}, []
    for doc_id, text in rows:
        own = BENCH_WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for span in spans:
            for i in range(len(own) - span + 1):
                if tuple(own[i : i + span]) in where:
                    hit |= set(range(i, i + span))
                    found |= where[tuple(own[i : i + span])]
        names = sorted(str(i) for i in found if i is not None)
        out.append((doc_id, len(own), len(hit), len(names), sha(",".join(names).encode()), bool(hit)))
    return out


def shingles(text, k=5):
    own = words((text or "").translate(LOWER))
    return {tuple(own[i : i + k]) for i in range(max(len(own) - k, 0) + 1)} if own else set()


def jaccard_groups(rows, percent=75):
    """(rows' shingle counts, rows' group numbers: least row index that links reach)."""
    sets, root, where = [shingles(t) for _, t in rows], list(range(len(rows))), defaultdict(list)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, own in enumerate(sets):
        common = Counter(j for s in own for j in where[s])
        for j, n in common.items():
            if 100 * n >= percent * (len(own) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
        for s in own:
            where[s].append(i)
    return [len(s) for s in sets], [find(i) for i in range(len(rows))]


def jaccard(rows):
    sizes, groups = jaccard_groups(rows)
    least = defaultdict(list)
    for (doc_id, _), g in zip(rows, groups):
        least[g].append(doc_id)
    smallest = {g: min((d for d in ids if d is not None), default=None) for g, ids in least.items()}
    return [(doc_id, n, smallest[g]) for (doc_id, _), n, g in zip(rows, sizes, groups)]


def encoded(rows, library, end_id=0):
    """(doc_id, start, n_tokens, crc) in order of doc_id; ties are the caller's."""
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, end_id]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def vector_groups(rows, threshold=0.98):
    """(vec_id, n_links, component_id, kept) of (vec_id, embedding, label) rows."""

    def good(r):
        v = r[1]
        return r[0] is not None and r[2] is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            if good(a) and good(b) and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    n[i] += 1
                    n[j] += 1
                    p, q = sorted((find(i), find(j)))
                    root[q] = p
    least = {}
    for i, r in enumerate(rows):
        if good(r):
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], n[i], least[find(i)] if good(r) else r[0], r[0] is None or r[0] == (least[find(i)] if good(r) else r[0])) for i, r in enumerate(rows)]
