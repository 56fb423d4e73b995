"""The manifest against plain Python."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lotwise.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, name string, pos int, __part long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([H(*below[i : i + 3]) for i in range(0, len(below), 3)])
    return levels


def steps_of(levels, i):
    """(left siblings, right siblings) from level to level."""
    for nodes in levels[:-1]:
        low = i - i % 3
        yield "".join(nodes[low:i]), "".join(nodes[i + 1 : low + 3])
        i //= 3


def checked(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""
    by_source = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        by_source[source].append((doc_id is not None, doc_id or 0, leaf(doc_id, source, lang, n_chars, text), doc_id, lang, n_chars, text))
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels_of([r[2] for r in sorted(by_source[s], key=lambda r: r[:3])]) for s in sources}
    top = levels_of([trees[s][-1][0] for s in sources])
    out = []
    for number, s in enumerate(sources):
        for i, (_, _, own, doc_id, lang, n_chars, text) in enumerate(sorted(by_source[s], key=lambda r: r[:3])):
            steps = [*steps_of(trees[s], i), *steps_of(top, number)]
            if text is not None and doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0:
                text = text.replace("\n", "")
            node = leaf(doc_id, s, lang, n_chars, text)
            for left, right in steps:
                node = H(left, node, right)
            out.append((doc_id, own, trees[s][-1][0], top[-1][0], H(*(a + b for a, b in steps)), node, node == top[-1][0]))
    return out


def corpus(n=700):
    draw = random.Random(5)
    texts = [None, "", "one\ntwo", "a\n\nb é", "\n", "plain", "z" * 200_000 + "\n"]
    names = [None, "", "é", "s1", "s2", "S", "😀", "ｚ", *[f"t{i}" for i in range(20)]]
    rows = []
    for i in range(n):
        source = "s1" if draw.random() < 0.6 else draw.choice(names)
        rows.append((i, draw.choice(texts[:6]), draw.choice(["aa", None]), source, draw.choice([None, 3])))
    rows += [(None, "x\n", "aa", "s1", 1), (None, "y", "aa", "s1", 1), (None, None, None, None, None), (-4, texts[6], "bb", "s2", 2)]
    rows += [rows[7]] * 5 + [(7, "other", "aa", rows[7][3], 1)] + [(1 << 40, "a\nb", "aa", "lone", 4)]
    return rows


@pytest.mark.parametrize("levels", [1, 3, 6])
def test_manifest(spark, levels):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "n", 1, 2) for r in rows], SCHEMA).repartition(5)
    expected = checked(rows)
    assert 50 < sum(not r[-1] for r in expected) < len(expected) - 50
    assert Counter(map(tuple, merkle.manifest_check(docs, levels=levels).collect())) == Counter(expected)


@pytest.mark.parametrize("n", [1, 4])
def test_few_documents(spark, n):
    rows = corpus()[:n]
    docs = spark.createDataFrame([(*r, "n", 1, 2) for r in rows], SCHEMA)
    assert Counter(map(tuple, merkle.manifest_check(docs).collect())) == Counter(checked(rows))


def test_no_documents(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert merkle.manifest_check(docs).count() == 0 and merkle.Manifest(docs).root().count() == 0


def test_one_hot_source(spark):
    rows = [(i, f"t{i}\n", "aa", "s", 1) for i in range(2500)]
    docs = spark.createDataFrame([(*r, "n", 1, 2) for r in rows], SCHEMA).repartition(7)
    assert Counter(map(tuple, merkle.manifest_check(docs, levels=4).collect())) == Counter(checked(rows))


def test_changed_documents_are_found(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "n", 1, 2) for r in rows], SCHEMA)
    other = [(d, (t or "") + "!" if d in (3, 9) else t, lang, s, c) for d, t, lang, s, c in rows]
    odd = merkle.Manifest(docs).check(spark.createDataFrame([(*r, "n", 1, 2) for r in other], SCHEMA))
    assert {r.doc_id for r in odd.collect()} == {3, 9}


@pytest.mark.parametrize("levels", [1, 2, 3, 5, 7])
def test_layout(levels):
    places = merkle.addresses(levels)
    assert [len(p) for p in places] == [3**d for d in range(levels)]
    assert sorted(np.concatenate(places)) == list(range(sum(3**d for d in range(levels))))
    upper = levels // 2
    for depth in range(upper, levels):  # a lower tree lies in one stretch
        size = sum(3**d for d in range(levels - upper))
        tree = np.arange(3**depth) // 3 ** (depth - upper)
        low = sum(3**d for d in range(upper)) + tree * size
        assert ((places[depth] >= low) & (places[depth] < low + size)).all()


def test_stored_nodes_and_their_siblings():
    for n in (1, 2, 3, 4, 9, 10, 26, 27):
        bottom = [H(str(i)).encode() for i in range(n)]
        rise = merkle.height(n)
        levels = levels_of([b.decode() for b in bottom])
        stored = merkle.store(bottom, rise)
        assert stored[:32].hex() == levels[-1][0]
        beside = merkle.siblings(stored, rise, n)
        for i in range(n):
            found = [beside[d][i // 3**d] for d in range(rise)]
            assert [(a.decode(), b.decode()) for a, b in found] == list(steps_of(levels, i))
