"""Operators on awkward rows against plain Python.

Nulls in any column, empty and very long texts, ties, repeated rows, empty tables
and columns whose names clash with work columns.
"""

import random
from collections import Counter

import numpy as np
import pytest
import text_brute as brute

from lotwise.llm import debruijn, decontaminate, extraction, jaccard, language, mixing, repeats, suffix_dedup, tokens, url_filter, vectors
from lotwise.staging import Staging

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __a long, __size string, in_0 string, runs string, score double"


def corpus():
    draw = random.Random(11)
    vocabulary = ["".join(draw.choice("abcdeéñ") for _ in range(draw.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    passage, base = text(60), text(120)
    rows = [
        (None, None), (None, text(50)), (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "ONE"), (6, "a b c d"), (7, "a b c d e"),
        (8, base), (9, base), (9, base), (10, base.replace(" ", "\n", 3)), (11, base.upper()), (12, text(20_000)), (13, "word " * 300),
        (14, "word " * 299 + "end"), (15, "x" * 500), (16, "x" * 450 + " y"), (17, "!!! ... ???"), (18, "a b c d e"),
    ]
    for i in range(20, 50):
        own = base.split()
        for _ in range(draw.randint(0, 9)):
            own[draw.randrange(len(own))] = draw.choice(vocabulary)
        rows.append((i, " ".join(own)))
    for i in range(50, 75):
        rows.append((i, f"{text(draw.randint(0, 60))} {passage} {text(draw.randint(0, 60))}"))
    rows += [(80, text(90) + " " + base), (-5, passage), (1 << 40, text(300))]
    return [
        (d, t, draw.choice(["aa", "bb", None]), draw.choice(["s1", "s2", "é", None]), None, 7, "z", "q", None, 0.5) for d, t in rows
    ]


ROWS = corpus()
TEXTS = [(r[0], r[1]) for r in ROWS]
ITEMS = [
    (1, " ".join(TEXTS[-1][1].split()[5:30])), (2, " ".join(TEXTS[8][1].upper().split()[:14])), (2, "repeated id"), (3, None), (4, "?!"),
    (5, "One"), (6, "a-b c"), (None, " ".join(TEXTS[50][1].split()[:12])), (70, " ".join(TEXTS[-1][1].split()[20:45])),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def same(df, expected):
    assert Counter(map(tuple, df.collect())) == Counter(expected)


@pytest.mark.parametrize("crowded", [1 << 15, 2])
def test_repeated_bytes(docs, monkeypatch, crowded):
    monkeypatch.setattr(repeats, "CROWDED", crowded)
    same(suffix_dedup.remove_repeated_bytes(docs), brute.repeated_bytes(TEXTS))


def test_repeated_bytes_kept(docs):
    found = suffix_dedup.remove_repeated_bytes(docs, length=60, core=20, keep_bytes=True)
    assert all(brute.sha(bytes(r.kept)) == r.kept_sha256 and len(r.kept) == r.n_bytes - r.n_removed for r in found.collect())
    same(found.drop("kept"), brute.repeated_bytes(TEXTS, 60))


def test_repeated_words(docs):
    found = debruijn.remove_repeated_words(docs, keep_text=True)
    assert all(brute.sha(r.kept.encode()) == r.kept_sha256 for r in found.collect())
    same(found.drop("kept"), brute.repeated_words(TEXTS))


def test_contamination(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.contamination(docs, items).drop(*decontaminate.KEY)
    expected = brute.contamination(TEXTS, ITEMS)
    assert 5 < sum(r[-1] for r in expected) < len(expected)
    same(found, expected)
    same(decontaminate.contamination(docs, items.limit(0)).drop(*decontaminate.KEY), brute.contamination(TEXTS, []))


def test_contamination_of_periodic_text(spark):
    """All windows of a run share their least gram, however long it is."""
    rows, items = [(1, "0 " * 100), (2, "0 " * 60 + "t1 t2 t3 t4 t5 " + "0 " * 40)], [(1, "0 " * 100), (2, "0 0 0 0 0 t1 t2 t3 t4 t5")]
    for period in range(1, 8):
        words = [f"p{period}w{i % period}" for i in range(70)]
        items += [(10 * period, " ".join(words[:25])), (10 * period + 1, f"{' '.join(words[2:9])} end{period} of it")]
        rows += [(10 * period + n, f"{' '.join(words[n:])} end{period} of it {' '.join(words[:n])}") for n in (0, 1, 3, 28, 51)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = decontaminate.contamination(table, spark.createDataFrame(items, "item_id long, text string"))
    expected = brute.contamination(rows, items)
    assert expected[0][2] == 100
    same(found.drop(*decontaminate.KEY), expected)


@pytest.mark.parametrize("part", [jaccard.PART, 3])
def test_jaccard(docs, monkeypatch, part):
    monkeypatch.setattr(jaccard, "PART", part)
    found = jaccard.jaccard_components(docs).select("doc_id", "n_shingles", "component_id")
    same(found, brute.jaccard(TEXTS))


def test_jaccard_chain(spark):
    """Links that meet the least class of their block only through others."""
    words = [f"w{i}" for i in range(200)]
    rows = [(100 - k, " ".join(words[k * 14 : k * 14 + 110])) for k in range(7)]
    expected = brute.jaccard(rows)
    assert len({r[2] for r in expected}) == 1
    same(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id"), expected)


def test_one_of_each(docs):
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    sizes, groups = brute.jaccard_groups(TEXTS)
    assert sum(1 for r in kept.collect() if brute.words(r.text)) == len({g for n, g in zip(sizes, groups) if n})
    assert sum(1 for r in kept.collect() if not brute.words(r.text)) == sizes.count(0)
    assert {r.doc_id for r in kept.collect()} >= {8, 13, 15, None}


def test_language(spark, docs):
    model = language.train(language.training_rows(docs))
    found = language.predict(docs, model)
    assert model.languages == ["aa", "bb"] and found.columns == [*[c for c in docs.columns if c != "score"], "lang_pred", "score"]
    for r in found.collect():
        lettered = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und", r.score == 0) == (not lettered, not lettered) and 0 <= r.score <= 1
    assert language.train(docs.where("lang IS NULL")).languages == []
    assert {r.lang_pred for r in language.predict(docs, language.train(docs.limit(0))).collect()} == {"und"}


def test_language_accuracy(spark):
    draw = random.Random(4)
    letters = {"aa": "abcdefgh", "bb": "hijklmno", "cc": "opqrstuv"}
    rows = [
        (i, " ".join("".join(draw.choice(letters[k]) for _ in range(6)) for _ in range(draw.randint(3, 40))), k)
        for i, k in enumerate(draw.choice(list(letters)) for _ in range(600))
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language.predict(docs, language.train(language.training_rows(docs))).where(language.held_out()).collect()
    assert len(found) > 90 and sum(r.lang == r.lang_pred for r in found) > 0.98 * len(found)


def test_mixing(docs):
    mixed = mixing.mix(docs)
    rows = mixed.collect()
    assert mixed.columns == [*[c for c in docs.columns if c != "__size"], "__size", "__source_size", "__target", "__before", "__taken"]
    assert Counter((r.doc_id, r["__size"]) for r in rows) == Counter((d, len(brute.words(t))) for d, t in TEXTS)
    total = sum(len(brute.words(t)) for _, t in TEXTS)
    by_source = {}
    for r in rows:
        assert 0 <= r["__taken"] <= 2 * r["__size"]
        by_source.setdefault(r.source, []).append(r)
    weights = dict(zip(["s1", "s2", "é", None], [5, 2, 1, 5]))
    targets = {s: own[0]["__target"] for s, own in by_source.items()}
    caps = {s: 2 * own[0]["__source_size"] for s, own in by_source.items()}
    assert sum(targets.values()) == pytest.approx(1.5 * total)
    levels = [targets[s] / weights[s] for s in targets if targets[s] < caps[s]]
    assert max(levels) == pytest.approx(min(levels)) and all(targets[s] <= caps[s] for s in targets)
    assert all(caps[s] / weights[s] <= levels[0] * 1.000001 for s in targets if targets[s] == caps[s])
    assert {s: sum(r["__taken"] for r in own) for s, own in by_source.items()} == {s: int(t) for s, t in targets.items()}
    again = mixing.mix(docs.repartition(2)).select("doc_id", "__taken").collect()
    assert Counter(map(tuple, again)) == Counter((r.doc_id, r["__taken"]) for r in rows)


def test_mix_in_order(docs):
    mixed = mixing.mix(docs)
    size = {(r.doc_id, r.source, r.text): r["__target"] for r in mixed.collect()}
    taken = mixing.sequence(mixed).collect()
    finish = [r["__finish"] for r in taken]
    assert finish == sorted(finish) and finish[-1] < 2
    words = Counter()
    for r in taken:
        words[r.source] += len(brute.words(r.text))
    longest = max(len(brute.words(t)) for _, t in TEXTS)
    for (_, source, _), target in size.items():
        assert abs(words[source] - target) <= longest / 2 + 1


def test_url_filter(spark):
    captures = spark.createDataFrame(
        [
            (1, "http://User@A.Example.COM:80/x/y?z#t", "2024-03-01", "c"), (2, "https://example.com", "2024-01-31", "c"),
            (3, "https://example.com/x", "2024-02-01", "c"), (4, "mailto:me", "2024-02-01", "c"), (5, None, "2024-02-01", "c"),
            (6, "http://example.com/", None, "c"), (7, "http://notexample.com/x", "2024-03-01", "c"), (1, "http://User@A.Example.COM:80/x/y?z#t", "2024-03-01", "c"),
            (8, "http://b.example.com/x/yy", "2024-04-01", "c"), (9, "", "2024-04-01", None),
        ],
        "page_id long, url string, fetched string, host string",
    ).selectExpr("page_id", "url", "CAST(fetched AS DATE) AS fetched", "host", "1 AS pattern", "2 AS __url", "3 AS since")
    entries = spark.createDataFrame(
        [
            ("example.com", "ads", "2024-02-01", True), ("example.com", "ads", "2024-03-15", False), ("example.com", "ads", "2024-03-15", True),
            ("a.example.com/x", "adult", "2024-01-01", True), ("b.example.com/x/y", "adult", "2024-01-01", True),
            (None, "ads", "2024-01-01", True), ("b.example.com", "ads", None, True), ("b.example.com", "ads", "2024-01-01", None),
            ("b.example.com", None, "2024-04-02", True),
        ],
        "pattern string, category string, since string, active boolean",
    ).selectExpr("pattern", "category", "CAST(since AS DATE) AS since", "active")
    found = url_filter.filter_urls(captures, entries)
    assert found.columns == ["page_id", "url", "fetched", "pattern", "__url", "since", "host", "n_active", "blocked", "reason"]
    got = {(r.page_id, r.n_active, r.blocked, r.reason) for r in found.collect()}
    assert got == {
        (1, 2, True, "a.example.com/x adult"), (2, 0, False, None), (3, 1, True, "example.com ads"), (4, 0, False, None),
        (5, 0, False, None), (6, 0, False, None), (7, 0, False, None), (8, 0, False, None), (9, 0, False, None),
    }
    assert found.count() == 10 and url_filter.filter_urls(captures, entries.limit(0)).where("blocked").count() == 0
    assert url_filter.filter_urls(captures.limit(0), entries).count() == 0


def test_token_files(spark, docs):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path(tokens.TOKENIZER)
    library = Tokenizer.from_file(path)
    folder = Staging(spark).new_path("tokens")
    tokens.write_token_files(docs, path, folder, block_ids=1000)
    found = sorted(tokens.read_token_files(spark, folder, keep_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted((d for d, _ in TEXTS), key=lambda d: (d is not None, d or 0))
    for before, after in zip(found, found[1:]):
        assert after.start == before.start + before.n_tokens
    assert Counter((r.doc_id, tuple(r.ids)) for r in found) == Counter(
        (d, (*library.encode(t or "", add_special_tokens=False).ids, 0)) for d, t in TEXTS
    )
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == Counter((d, n, c) for d, _, n, c in brute.encoded(TEXTS, library))


def test_vectors(spark):
    draw = np.random.default_rng(8)
    base = draw.standard_normal((12, 16))
    rows = [(int(i), (base[i % 12] + draw.standard_normal(16) * draw.choice([0.02, 0.1, 0.25])).tolist(), int(i % 2)) for i in range(160)]
    rows += [
        (200, None, 1), (201, [0.0] * 16, 1), (202, [None] * 16, 1), (203, [float("nan")] * 16, 1), (204, [float("inf")] * 16, 1), (205, [], 1),
        (206, rows[3][1], None), (None, rows[3][1], 1), (207, rows[3][1], 1), (208, rows[3][1][:8], 1), (3, rows[3][1], 1), (209, [1.0] * 8, 1),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    same(vectors.near_duplicate_vectors(table.selectExpr("*", "1 AS component", "2 AS __a")), brute.vector_groups(rows))
    assert vectors.near_duplicate_vectors(table.limit(0)).count() == 0


def test_vectors_beyond_the_window(spark):
    draw = np.random.default_rng(9)
    base = draw.standard_normal(8)
    rows = [(int(i), (base + draw.standard_normal(8) * 0.02).tolist(), 1) for i in range(150)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    same(vectors.near_duplicate_vectors(table, window=16), brute.vector_groups(rows))


def test_vectors_in_a_narrow_cone(spark):
    """Pairs that a few passes over a small window miss."""
    draw = np.random.default_rng(10)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    first = unit(draw.standard_normal((250, 31)))
    second = unit(first + 0.55 * unit(draw.standard_normal((250, 31))))
    cone = np.hstack([np.full((500, 1), 3.0), np.vstack([first, second])])
    rows = [(i, x.tolist(), 1) for i, x in enumerate(cone)]
    expected = brute.vector_groups(rows)
    assert sum(n for _, n, *_ in expected) == 500
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    same(vectors.near_duplicate_vectors(table, window=8), expected)


def test_extraction(spark):
    page = (
        "<html><head><title>No</title></head><body><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies. All good?</div>"
        "<article><h1>Title &amp; more</h1><p>First  paragraph\n of text, a &lt;b&gt;.</p><form><p>Sign up now.</p></form><p>{}</p></article>"
        "<aside><p>Elsewhere on this site, a story.</p></aside><section class=comments><p>I read this and liked it.</p></section>"
        "<footer>&copy; us</footer></body></html>"
    )
    long = "Words and words. " * 40_000
    rows = [(1, "u", page.format("Last&nbsp;one."), 1), (2, None, None, 1), (None, "u", "", 1), (3, "v", page.format(long), 1), (1, "u", page.format("Last&nbsp;one."), 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    found = extraction.extract(pages, extraction.train(pages))
    start = "Title & more First paragraph of text, a <b>. "
    expected = [(1, "u", start + "Last one."), (2, None, ""), (None, "u", ""), (3, "v", start + long.strip()), (1, "u", start + "Last one.")]
    same(found, [(i, u, t, len(t)) for i, u, t in expected])
    assert extraction.extract(pages.limit(0), extraction.train(pages.limit(0))).count() == 0


def test_empty_tables(spark, none):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert suffix_dedup.remove_repeated_bytes(none).count() == 0
    assert debruijn.remove_repeated_words(none).count() == 0
    assert decontaminate.contamination(none, items).count() == 0
    assert jaccard.jaccard_components(none).count() == 0 and jaccard.one_of_each(none).count() == 0
    assert mixing.mix(none).count() == 0 and mixing.sequence(mixing.mix(none)).count() == 0
    public_tokenizers = pytest.importorskip("public_tokenizers")
    folder = Staging(spark).new_path("tokens")
    tokens.write_token_files(none, public_tokenizers.path(tokens.TOKENIZER), folder)
    assert tokens.read_token_files(spark, folder).count() == 0


def test_language_sample_is_bounded_under_copies(spark, monkeypatch):
    draw = random.Random(9)
    own = [" ".join("".join(draw.choice("abcdefgh") for _ in range(5)) for _ in range(6)) for _ in range(500)]
    rows = [(i, own[i] if i < 500 else "abc fed gab", "aa") for i in range(2000)]
    rows += [(2000 + i, " ".join("".join(draw.choice("stuvwxyz") for _ in range(5)) for _ in range(6)), "bb") for i in range(200)]
    seen = {}

    class Kept(language.Staging):
        def table(self, df, name):
            seen[name] = super().table(df, name)
            return seen[name]

    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 200, Kept(spark))
    folds = Counter(r.fold for r in seen["examples"].where("lang = 'aa'").collect())
    assert model.languages == ["aa", "bb"]
    assert 120 < sum(folds.values()) < 300 and len(folds) == language.SHARDS + 2 and max(folds.values()) < 70
