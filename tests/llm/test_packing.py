"""Packing: every id in one piece, little padding, ids of the library."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_operators import ROWS, SCHEMA, TEXTS

from lotwise.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path(packing.TOKENIZER)


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def padding(sizes, capacity):
    return sum(0 if n & (n - 1) == 0 else capacity - n for n in sizes)


def check(found, expected, capacity):
    """found: rows of ``pieces``; expected: (doc_id, ids with the end id) of every document."""
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
        documents[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
    assert sorted(sequences) == list(range(len(sequences)))
    sizes = []
    for own in sequences.values():
        end = 0
        for offset, n in sorted(own):
            assert offset == end and n > 0
            end += n
        assert end <= capacity
        sizes.append(end)
    assert sum(sizes) == sum(len(ids) for _, ids in expected)
    wanted = defaultdict(list)
    for doc_id, ids in expected:
        wanted[doc_id, len(ids)].append(np.array(ids, "<u4"))
    assert set(wanted) == set(documents)
    for key, all_ids in wanted.items():
        cover = Counter()
        for start, n, crc in documents[key]:
            assert crc in {zlib.crc32(ids[start : start + n].tobytes()) for ids in all_ids}
            cover.update(range(start, start + n))
        assert set(cover.values()) == {len(all_ids)} and len(cover) == key[1]
    return sizes


@pytest.mark.parametrize("parts, capacity, windows, fan_in", [(5, 2048, 32, 16), (23, 64, 4, 3), (1, 128, 1, 2), (40, 32, 2, 2)])
def test_pack(spark, parts, capacity, windows, fan_in):
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(parts)
    found = packing.pack(docs, PATH, capacity=capacity, windows=windows, fan_in=fan_in, slack=capacity // 128)
    own = library()
    expected = [(d, [*own.encode(t or "", add_special_tokens=False).ids, 1]) for d, t in TEXTS]
    sizes = check(packing.pieces(found).collect(), expected, capacity)
    assert padding(sizes, capacity) <= 0.01 * sum(sizes)
    for r in found.collect():
        ids = np.frombuffer(r.ids, "<u2").astype("<u4")
        assert len(ids) == r.n_tokens
        assert all(zlib.crc32(ids[p.offset : p.offset + p.length].tobytes()) == p.ids_crc32 for p in r.pieces)


def test_no_documents(spark):
    none = packing.pack(spark.createDataFrame([], SCHEMA), PATH)
    assert none.count() == 0 and packing.pieces(none).count() == 0
    empty = spark.createDataFrame([(1, None), (None, ""), (1, None)], "doc_id long, text string")
    found = packing.pieces(packing.pack(empty, PATH)).collect()
    assert Counter((r.doc_id, r.start, r.length, r.doc_tokens) for r in found) == Counter({(1, 0, 1, 1): 2, (None, 0, 1, 1): 1})


def test_words_match_the_library():
    import pyarrow as pa

    draw, own, words = random.Random(3), library(), packing.WordEncoder(PATH)
    signs = [*"ab Z19 \n\t ,.!'éÉ漢 　ñ½²_<|>́😀İΣσßǅ-:;?\x0b\x1c\x85", "  ", "\n\n", "'s", "'re", " 'll", "<|endoftext|>", "can't", "<|startoftext|>", "word", "Word,"]
    texts = [None, "", "x" * 5000, *["".join(draw.choice(signs) for _ in range(draw.randint(0, 60))) for _ in range(1500)]]
    ids, n = words.encode(pa.array(texts, pa.string()))
    found = [f.tolist() for f in np.split(ids, np.cumsum(n)[:-1])]
    assert found == [own.encode(t or "", add_special_tokens=False).ids for t in texts]
    again, m = words.encode(pa.array(texts[::-1], pa.string()))
    assert [f.tolist() for f in np.split(again, np.cumsum(m)[:-1])] == found[::-1]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 200), max_size=80), st.integers(1, 6), st.integers(0, 8), st.sampled_from([16, 50, 64]))
def test_packer_keeps_every_id_once(sizes, windows, slack, capacity):
    packer = packing.Packer(capacity, windows, slack)
    for i, n in enumerate(sizes):
        packer.add(packing.Piece(i, 0, n, np.arange(n, dtype=np.uint32)))
        assert len(packer.open) == len(packer.rooms) <= windows
    before = len(packer.done)
    assert all(packing.length(item) >= capacity - slack for item in packer.done)
    packer.close()
    seen = defaultdict(list)
    for number, item in enumerate(packer.done):
        n = packing.length(item)
        assert 0 < n <= capacity and (number < before or n == capacity or n & (n - 1) == 0)
        for p in item:
            assert len(p.ids) and (p.ids == np.arange(p.start, p.start + len(p.ids))).all()
            seen[p.doc_id] += p.ids.tolist()
    assert {i: sorted(own) for i, own in seen.items()} == {i: list(range(n)) for i, n in enumerate(sizes)}
