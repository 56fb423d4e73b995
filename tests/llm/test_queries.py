"""Registered text queries over the smallest tables: against SQL or plain Python."""

import os
import re
from collections import Counter

import pytest
import text_brute as brute
from oracle import connect, difference

import __spark_entry__ as contract
from lotwise import catalogue
from lotwise.llm import packing, tokens
from lotwise.llm.queries import ORACLES, QUERIES
from lotwise.llm.tables import read

SF_DIR = os.environ.get("LOTWISE_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables not present")


@pytest.fixture(scope="module")
def texts(spark):
    return [tuple(r) for r in read(spark, SF_DIR, "documents").select("doc_id", "text").collect()]


def rows_of(spark, name):
    return Counter(map(tuple, QUERIES[name](spark, SF_DIR).collect()))


def test_registration():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 14))
    assert set(contract.queries()) == {*catalogue.queries(), *QUERIES, "pipeline"}
    assert set(contract.oracle_sql()) == {*catalogue.oracle_sql(), *ORACLES}


@pytest.mark.parametrize("name", ORACLES)
def test_sql(spark, name):
    assert difference(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLES[name]) is None


def test_language(spark):
    truth = {r.doc_id: r.lang for r in read(spark, SF_DIR, "documents").collect()}
    found = QUERIES["op1_language_id"](spark, SF_DIR).collect()
    assert {r.doc_id for r in found} == set(truth)
    held = [r for r in found if r.held_out]
    assert 0.1 < len(held) / len(found) < 0.4
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.95 * len(held)


def test_suffix_dedup(spark, texts):
    assert rows_of(spark, "op3_suffix_dedup") == Counter(brute.repeated_bytes(texts))


def test_jaccard(spark, texts):
    assert rows_of(spark, "op4_ngram_jaccard") == Counter(brute.jaccard(texts))


def test_extraction(spark):
    """The generator's pages hold their text in one article."""
    import html

    def article(page):
        inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
        return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))).split())

    pages = read(spark, SF_DIR, "pages").collect()
    expected = Counter((r.page_id, r.url, article(r.html), len(article(r.html))) for r in pages)
    assert rows_of(spark, "op5_html_extraction") == expected


def test_tokens(spark, texts):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    assert rows_of(spark, "op8_token_output") == Counter(brute.encoded(texts, library))


def test_substring_dedup(spark, texts):
    assert rows_of(spark, "op9_substring_dedup") == Counter(brute.repeated_words(texts))


def test_vectors(spark):
    vectors = [(r.vec_id, r.embedding, r.label) for r in read(spark, SF_DIR, "embeddings").collect()]
    assert rows_of(spark, "op10_embedding_near_dedup") == Counter(brute.vector_groups(vectors))


def test_packing(spark, texts):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    import test_packing as own
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    expected = [(d, [*library.encode(t or "", add_special_tokens=False).ids, packing.END_ID]) for d, t in texts]
    sizes = own.check(QUERIES["op11_packing"](spark, SF_DIR).collect(), expected, packing.CAPACITY)
    assert own.padding(sizes, packing.CAPACITY) < 0.005 * sum(sizes)


def test_whitening(spark):
    import test_whitening as own

    rows = [(r.vec_id, r.embedding) for r in read(spark, SF_DIR, "embeddings").collect()]
    own.check(QUERIES["op12_embedding_whitening"](spark, SF_DIR).collect(), rows)


@pytest.mark.parametrize("name", ["op2_decontamination", "op7_url_filters"])
def test_native_queries_run_no_python(spark, name):
    plan = QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct|NestedLoop", plan)
