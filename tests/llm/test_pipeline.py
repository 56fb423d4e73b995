"""The pipeline on a small corpus against plain Python, stage by stage and whole."""

import hashlib
from collections import Counter, defaultdict

import pytest
import text_brute as brute
from test_operators import ITEMS, ROWS, SCHEMA

import corpus_pipeline
from lotwise.llm import mixing, tokens
from lotwise.staging import Staging

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark):
    path = Staging(spark).new_path("tables")
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def mix_brute(rows):
    """Rows (doc_id, text, source) repeated as the mix takes them."""
    by_source = defaultdict(list)
    for doc_id, text, source in rows:
        key = hashlib.md5(f"{mixing.SEED}|{'-' if doc_id is None else doc_id}".encode()).hexdigest()
        by_source[source].append((key, doc_id, text, len(brute.words(text))))
    sizes = {s: sum(r[3] for r in own) for s, own in by_source.items()}
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        capped = {s for s in free if level * weight[s] > 2 * sizes[s]}
        target |= {s: 2 * sizes[s] for s in capped} | ({} if capped else {s: level * weight[s] for s in free})
        left -= sum(2 * sizes[s] for s in capped)
        free = free - capped if capped else set()
    out = []
    for s, own in by_source.items():
        for turn in (0, 1):
            before = turn * sizes[s]
            for _, doc_id, text, size in sorted(own, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
                if size and 2 * (int(target[s] + 1e-9) - before) >= size:
                    out.append((doc_id, text))
                before += size
    return out


def test_stages_and_whole(spark, folder):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "mixing", "token_output"]
    staging, docs, after = Staging(spark), spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = staging.table(stage(spark, docs, folder), name)
        assert docs.columns == ([f.split()[0] for f in SCHEMA.split(", ")] if name != "token_output" else docs.columns)
        after.append(docs.collect())
    known, kept, clean, mixed, written = after
    lettered = Counter((r[0], r[1]) for r in ROWS if any(c.isalpha() for c in r[1] or ""))
    assert Counter((r.doc_id, r.text) for r in known) <= lettered and len(known) > 0.9 * lettered.total()
    _, groups = brute.jaccard_groups([(r.doc_id, r.text) for r in known])
    assert len(kept) == len(set(groups))
    least = {g: min((known[i].doc_id is None, known[i].doc_id or 0) for i, h in enumerate(groups) if h == g) for g in set(groups)}
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in kept) == Counter(least.values())
    verdicts = brute.contamination([(r.doc_id, r.text) for r in kept], ITEMS)
    assert Counter((r.doc_id, r.text) for r in clean) == Counter((r.doc_id, r.text) for r, v in zip(kept, verdicts) if not v[-1])
    assert 0 < len(clean) < len(kept)
    assert Counter((r.doc_id, r.text) for r in mixed) == Counter(mix_brute([(r.doc_id, r.text, r.source) for r in clean]))
    library = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    expected = brute.encoded([(r.doc_id, r.text) for r in mixed], library)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in written) == Counter((d, n, c) for d, _, n, c in expected)
    assert Counter(map(tuple, corpus_pipeline.run(spark, folder).collect())) == Counter(map(tuple, written))


def test_no_documents(spark, folder):
    staging, docs = Staging(spark), spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = staging.table(stage(spark, docs, folder), name)
    assert docs.count() == 0
