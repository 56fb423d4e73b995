"""What the operators pass through Python and the library, and how often."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from lotwise.llm import byte_words, jaccard, packing, tokens

ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
WORDS = ["le", "Straße", "ÉTÉ", "naïve", "áe", "İx.", "J̌a", "don't", "x1", "été,b", "a$$$", "«a»", "文字", "ﬁn", "ǅ", "ŉ", "ª", "<|endoftext|>.", "b<|endoftext|>", " c", "d\n.e", "f.\ng"]


def _texts():
    draw = random.Random(5)
    every = [chr(c) for c in range(0xC0, 0x250) if chr(c).isalpha()]
    texts = [" ".join(every), "".join(every), ".".join(every), *WORDS]
    texts += ["".join(draw.choice(WORDS + every) + draw.choice([" ", "", ".", " ", "\n", "$"]) for _ in range(60)) for _ in range(60)]
    return [*texts, "", "The theatre, the end.", "ab " * 30]


@pytest.mark.parametrize("module", [tokens, packing])
def test_ids_are_the_librarys(module):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path, texts = public_tokenizers.path(module.TOKENIZER), _texts()
    library = Tokenizer.from_file(path)
    expected = [library.encode(t, add_special_tokens=False).ids for t in texts]
    column = pa.array(texts)
    if module is packing:
        ids, counts = packing.WordEncoder(path).encode(column)
    else:
        raw = [t.encode() for t in texts]
        bounds = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        ids, counts = tokens.Encoder(path).encode(np.frombuffer(b"".join(raw), np.uint8), bounds)
    assert [p.tolist() for p in np.split(ids, np.cumsum(counts)[:-1])] == expected


def test_words_of_letters_pass_no_pattern_of_the_library():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    for made in (tokens.Encoder(public_tokenizers.path(tokens.TOKENIZER)), packing.WordEncoder(public_tokenizers.path(packing.TOKENIZER))):
        assert made.letters.library.normalizer is None
        assert "WhitespaceSplit" in repr(made.letters.library.pre_tokenizer)
    words = pa.array(["ab", "é", "İ", "a1", "", "a.", "a\n", "ÿĀ"])
    assert byte_words.only_letters(words).tolist() == [True, True, False, False, False, False, False, True]


def test_tasks_of_a_worker_share_an_encoder(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    path = public_tokenizers.path(packing.TOKENIZER)
    docs = spark.createDataFrame([("ab cd",)] * 40, "text string").repartition(40)

    def task(batches):
        for rows in batches:
            made = packing.encoder(path)
            yield pa.RecordBatch.from_pydict({"known": [len(made.known)]})
            made.encode(rows["text"])

    assert max(r.known for r in docs.mapInArrow(task, "known LONG").collect()) > 0


@pytest.mark.parametrize("ids", [[], [0], [65535] * 9, [65536, 1]])
def test_packed(ids):
    assert tokens.unpacked(tokens.packed(np.array(ids, np.uint32))).tolist() == ids


def test_batches_of_texts_are_small(spark, monkeypatch):
    before, seen = spark.conf.get(ROWS), []
    prefixes, written = jaccard._Join.links, tokens.token_ids
    monkeypatch.setattr(jaccard._Join, "links", lambda self: seen.append(int(spark.conf.get(ROWS))) or prefixes(self))
    monkeypatch.setattr(tokens, "token_ids", lambda *a: seen.append(int(spark.conf.get(ROWS))) or written(*a))
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    assert {r.component_id for r in jaccard.jaccard_components(docs).collect()} == {1}
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from lotwise.staging import Staging

    tokens.write_token_files(docs, public_tokenizers.path(tokens.TOKENIZER), Staging(spark).new_path("tokens"))
    assert len(seen) == 2 and max(seen) <= 2000 and spark.conf.get(ROWS) == before


def test_pipeline_passes_the_text_once(spark, monkeypatch):
    passed = []
    monkeypatch.setattr(corpus_pipeline.language, "train", lambda rows, staging: None)
    monkeypatch.setattr(corpus_pipeline.language, "predict", lambda rows, model: passed.append(rows) or rows.selectExpr("*", "'en' AS lang_pred", "1.0D AS score"))
    docs = spark.createDataFrame([(1, "a", "x", "y"), (None, None, "z", None)], "doc_id long, text string, score string, lang_pred string")
    assert sorted(map(str, corpus_pipeline.language_id(spark, docs, "").collect())) == sorted(map(str, docs.collect()))
    assert len(passed[0].columns) == 4


def test_ids_are_unpacked_a_few_rows_at_a_time(monkeypatch):
    passed, unpacked = [], tokens._ids_of
    monkeypatch.setattr(tokens, "_ids_of", lambda column: passed.append(len(column)) or unpacked(column))
    rows = pa.RecordBatch.from_pydict({"ids": [tokens.packed(np.array([k % 7, 5], np.uint32)) for k in range(1500)]})
    (found,) = tokens._counted(iter([rows, rows.slice(0, 0), rows]))
    expected = np.bincount([i for k in range(1500) for i in (k % 7, 5)]) * 2
    assert dict(zip(found["id"].to_pylist(), found["count"].to_pylist())) == dict(enumerate(expected))
    assert sum(passed) == 3000 and max(passed) <= 200
