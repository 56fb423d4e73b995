"""Registered queries of the text operators, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.llm import decontaminate, extraction, language, merkle, mixing, packing, tokens, url_filter, whitening
from lotwise.llm.debruijn import remove_repeated_words
from lotwise.llm.jaccard import jaccard_components
from lotwise.llm.suffix_dedup import remove_repeated_bytes
from lotwise.llm.tables import read
from lotwise.llm.vectors import near_duplicate_vectors
from lotwise.staging import Staging


def language_id(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = language.train(language.training_rows(docs))
    predicted = language.predict(docs.select("doc_id", "text"), model)
    return predicted.selectExpr("doc_id", f"{language.held_out()} AS held_out", "lang_pred", "score")


def decontamination(spark, sf_dir):
    docs, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    return decontaminate.contamination(docs, items).drop(*decontaminate.KEY)


def suffix_dedup(spark, sf_dir):
    return remove_repeated_bytes(read(spark, sf_dir, "documents"))


def ngram_jaccard(spark, sf_dir):
    return jaccard_components(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def html_extraction(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    return extraction.extract(pages, extraction.train(pages))


def mixed_sources(spark, sf_dir):
    mixed = mixing.by_finish(mixing.mix(read(spark, sf_dir, "documents")))
    return mixed.selectExpr(
        "doc_id", "__size AS size", "__source_size AS source_size", "__target AS target", "__taken AS taken"
    )


def _digest(text: str) -> str:
    return f"CAST(conv(substring(md5({text}), 1, 8), 16, 10) AS BIGINT)"


def captures(spark, sf_dir):
    """``pages`` with a fetch date taken from a hash of the page."""
    day = f"date_add(DATE'2024-01-01', CAST({_digest('CAST(page_id AS STRING)')} % 366 AS INT))"
    return read(spark, sf_dir, "pages").select("page_id", "url", F.expr(day).alias("fetched"))


def list_entries(spark, sf_dir):
    """A block list with history over the hosts, domains and paths of ``pages``.

    Every fourth pattern by hash is on the list, with three dated entries.
    """
    pages = read(spark, sf_dir, "pages").select("url")
    split = pages.select(
        F.lower(F.regexp_extract("url", url_filter.HOST, 1)).alias("__host"),
        F.regexp_extract("url", url_filter.PATH, 1).alias("__path"),
    ).where("__host <> ''").distinct()
    listed = split.select(F.explode(F.expr(url_filter.patterns("url"))).alias("pattern")).distinct()
    listed = listed.where(f"instr(pattern, '.') > 0 AND {_digest('pattern')} % 4 = 0")
    turn = listed.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(2))))
    seed = "concat(pattern, '|', turn)"
    return turn.selectExpr(
        "pattern",
        f"element_at(array('ads', 'adult', 'malware'), CAST({_digest(chr(39) + 'c' + chr(39) + ' || pattern')} % 3 + 1 AS INT)) AS category",
        f"date_add(DATE'2024-01-01', CAST({_digest(seed)} % 366 AS INT)) AS since",
        f"{_digest(chr(39) + 'a' + chr(39) + ' || ' + seed)} % 3 <> 0 AS active",
    )


def url_filters(spark, sf_dir):
    return url_filter.filter_urls(captures(spark, sf_dir), list_entries(spark, sf_dir))


def token_files(spark, docs, staging=None):
    import public_tokenizers

    staging = staging or Staging(spark)
    folder = staging.new_path("tokens")
    tokens.write_token_files(docs, public_tokenizers.path(tokens.TOKENIZER), folder, staging=staging)
    return tokens.read_token_files(spark, folder)


def token_output(spark, sf_dir):
    return token_files(spark, read(spark, sf_dir, "documents"))


def substring_dedup(spark, sf_dir):
    return remove_repeated_words(read(spark, sf_dir, "documents"))


def embedding_near_dedup(spark, sf_dir):
    return near_duplicate_vectors(read(spark, sf_dir, "embeddings"))


def packed_sequences(spark, sf_dir):
    import public_tokenizers

    docs = read(spark, sf_dir, "documents")
    return packing.pieces(packing.pack(docs, public_tokenizers.path(packing.TOKENIZER)))


def embedding_whitening(spark, sf_dir):
    found = whitening.whiten(read(spark, sf_dir, "embeddings"))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS BIGINT)"))  # null beyond 64 bits


def merkle_manifest(spark, sf_dir):
    return merkle.manifest_check(read(spark, sf_dir, "documents"))


def _number(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::BIGINT"


_SUFFIXES = "list_transform(range(1, len(l) + 1), lambda i: array_to_string(l[i:], '.'))"
_PREFIXES = "list_transform(range(1, len(st) + 1), lambda i: host || '/' || array_to_string(st[1:i], '/'))"
_HOST = url_filter.HOST.replace("(?:", "(?:")
_URL_SQL = f"""
WITH c AS (SELECT page_id, url, DATE '2024-01-01' + ({_number('page_id::VARCHAR')} % 366)::INT AS fetched,
    nullif(lower(regexp_extract(url, '{_HOST}', 1)), '') AS host,
    list_filter(string_split(regexp_extract(url, '{url_filter.PATH}', 1), '/'), lambda s: s <> '') AS st FROM pages),
k AS (SELECT page_id, url, fetched, host, string_split(host, '.') AS l, st FROM c WHERE host IS NOT NULL),
a AS (SELECT DISTINCT url, fetched, unnest(list_concat({_SUFFIXES}, {_PREFIXES})) AS pattern FROM k),
p AS (SELECT DISTINCT pattern FROM a WHERE contains(pattern, '.') AND {_number('pattern')} % 4 = 0),
t AS (SELECT pattern, unnest([0, 1, 2]) AS turn FROM p),
e AS (SELECT pattern, ['ads', 'adult', 'malware'][({_number("'c' || pattern")} % 3 + 1)::INT] AS category,
    DATE '2024-01-01' + ({_number("pattern || '|' || turn")} % 366)::INT AS since,
    {_number("'a' || pattern || '|' || turn")} % 3 <> 0 AS active FROM t),
g AS (SELECT pattern, category, since, bool_and(active) AS active FROM e GROUP BY ALL),
v AS (SELECT *, lead(since) OVER (PARTITION BY pattern, category ORDER BY since) AS until FROM g),
m AS (SELECT url, fetched, count(*) AS n_active,
    first(a.pattern || ' ' || category ORDER BY -length(a.pattern), a.pattern, category) AS reason
  FROM a JOIN v ON a.pattern = v.pattern AND active AND fetched >= since AND (until IS NULL OR fetched < until) GROUP BY 1, 2)
SELECT page_id, c.url, c.fetched, host, coalesce(n_active, 0)::BIGINT AS n_active, n_active IS NOT NULL AS blocked, reason
FROM c LEFT JOIN m ON c.url = m.url AND c.fetched = m.fetched
"""

QUERIES = {
    "op1_language_id": language_id,
    "op2_decontamination": decontamination,
    "op3_suffix_dedup": suffix_dedup,
    "op4_ngram_jaccard": ngram_jaccard,
    "op5_html_extraction": html_extraction,
    "op6_mixing": mixed_sources,
    "op7_url_filters": url_filters,
    "op8_token_output": token_output,
    "op9_substring_dedup": substring_dedup,
    "op10_embedding_near_dedup": embedding_near_dedup,
    "op11_packing": packed_sequences,
    "op12_embedding_whitening": embedding_whitening,
    "op13_merkle_manifest": merkle_manifest,
}
ORACLES = {
    "op2_decontamination": decontaminate.ORACLE,
    "op6_mixing": mixing.ORACLE,
    "op7_url_filters": _URL_SQL,
    "op13_merkle_manifest": merkle.ORACLE,
}
