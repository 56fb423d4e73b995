"""Benchmark decontamination by winnowing, in DataFrame expressions only.

Benchmark items and documents are cut into words. Of every ``WINDOW`` consecutive
words the least hash among the ``GRAM``-grams is kept as fingerprint, so any span
of ``WINDOW`` shared words shares a fingerprint. Documents meet the benchmark on
fingerprints; a hit is extended to the windows that can share it, which are compared
as text. Items of fewer words are one window each and meet documents on the hash of
the whole window, for the few lengths below ``WINDOW`` that occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm.tables import keyed
from lotwise.staging import Staging

WINDOW = 10
GRAM = 5
REACH = WINDOW - GRAM  # a gram of a window starts at most so many words after it
KEY = ["__a", "__b"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # after A-Z became a-z
# The same words; single characters, which Java looks up in one table, and not ranges, which it tries in turn
LISTED_WORD = "[^" + "".join(rf"\x{c:02X}" for c in range(128) if not chr(c).isalnum() or chr(c).isupper()) + "]+"


def words(text: Column) -> Column:
    lower = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    found = F.regexp_extract_all(lower, F.lit(LISTED_WORD), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def _hash(first: int, n: int) -> str:
    return f"xxhash64({', '.join(f'get(w, at + {first + i})' for i in range(n))})"


def _positions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per word position ``at`` (from 0) with all hashes: w of the words, g of the grams.

    The arrays are only read from until the next projection, never written per position.
    """
    hashed = rows.select(*keys, F.transform("words", lambda w: F.xxhash64(w)).alias("w"))
    after = ", ".join(f"get(w, i + {i})" for i in range(1, GRAM))
    starts = f"slice(w, 1, greatest(size(w) - {GRAM - 1}, 0))"
    hashed = hashed.select(*keys, "w", F.expr(f"transform({starts}, (x, i) -> xxhash64(x, {after}))").alias("g"))
    # of a plain column Spark would also ask for its size, below, where the words would be cut once more
    return hashed.select(*keys, "w", "g", F.posexplode(F.expr("slice(w, 1, size(w))")).alias("at", "own"))


def _is_fingerprint() -> tuple[str, str]:
    """(condition, gram): winnowed fingerprints, where the least gram is another than one word before.

    Of equal grams the leftmost counts, so a window's gram is another one too if the
    window before began with it. In periodic text that is every window of a run of
    equal values; with at most ``REACH + 1`` windows to a gram, every window has the
    fingerprint of one that starts at most ``REACH`` words before it.
    """
    grams = [f"get(g, at + {i})" for i in range(-1, REACH + 1)]
    least, previous = f"least({', '.join(grams[1:])})", f"least({', '.join(grams[:-1])})"
    changed = f"(at = 0 OR {least} <> {previous} OR {least} = {grams[0]})"
    return f"(at + {WINDOW} <= size(w) AND {changed})", least


def contamination(docs: DataFrame, benchmark: DataFrame, staging: Staging | None = None) -> DataFrame:
    """One row per row of ``docs``: n_words, n_hit, n_items, items_sha256, contaminated.

    A document word is hit if a window of an item covers it. Null text has no
    words; an item without words has no window. Items are identified by item_id,
    and rows of a null item_id hit words without being counted as items.
    """
    staging = staging or Staging(docs.sparkSession)
    rows = keyed(docs)
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).where("size(words) > 0")
    items = staging.table(items, "items")
    span = F.least(F.size("words"), F.lit(WINDOW))
    starts = F.sequence(F.lit(1), F.size("words") - span + 1)
    windows = items.select("item_id", "words", span.alias("span"), F.explode(starts).alias("s"))
    windows = windows.selectExpr("item_id", "array_join(slice(words, s, span), ' ') AS window").distinct()
    windows = staging.table(windows, "windows")
    short = [r[0] for r in items.where(f"size(words) < {WINDOW}").select(F.size("words")).distinct().collect()]

    chosen, gram = _is_fingerprint()
    known = _positions(items, ["item_id"]).where(chosen).selectExpr(f"{gram} AS print", f"{WINDOW} AS span")
    for n in sorted(short):  # at most WINDOW - 1 lengths
        alike = items.where(f"size(words) = {n}").select(F.transform("words", lambda w: F.xxhash64(w)).alias("w"))
        known = known.unionByName(alike.selectExpr(f"xxhash64({', '.join(f'w[{i}]' for i in range(n))}) AS print", f"{n} AS span"))
    known = staging.table(known.distinct(), "fingerprints").selectExpr("print AS known", "span AS known_span")

    placed = _positions(rows.select(*KEY, words(F.col("text")).alias("words")), KEY)
    # the last position, which begins no window of so many words, tells the number of words
    last = "at + 1 = size(w)"
    prints = placed.where(f"{last} OR {chosen}").selectExpr(
        *KEY, "at", f"IF({last}, NULL, {gram}) AS print", f"{WINDOW} AS span", f"IF({last}, size(w), NULL) AS n_words"
    )
    if short:
        tests = ", ".join(
            f"IF(at + {n} <= size(w), named_struct('print', {_hash(0, n)}, 'span', {n}), NULL)" for n in sorted(short)
        )
        whole = placed.select(*KEY, "at", F.explode(F.expr(f"array({tests})")).alias("t")).where("t IS NOT NULL")
        prints = prints.unionByName(whole.selectExpr(*KEY, "at", "t.print", "t.span", "CAST(NULL AS INT) AS n_words"))
    hits = prints.join(known, F.expr("print = known AND span = known_span"), "left").where("known IS NOT NULL OR n_words IS NOT NULL")
    around = f"CASE WHEN n_words IS NOT NULL THEN array(-1) WHEN span < {WINDOW} THEN array(at) ELSE sequence(at, at + {REACH}) END"
    hits = hits.select(*KEY, "span", "n_words", F.explode(F.expr(around)).alias("at")).distinct()
    hits = hits.groupBy(*KEY).agg(  # of one document
        F.expr("collect_list(struct(at, span)) FILTER (WHERE at >= 0)").alias("tests"), F.max("n_words").cast("bigint").alias("n_words")
    )
    hits = staging.table(hits, "hits")  # a row for each document with words

    # hits grow with the documents: joined by shuffle at every size
    tested = rows.select(*KEY, "text").join(hits.where("size(tests) > 0").hint("merge"), KEY).dropDuplicates(KEY)
    tested = tested.select(*KEY, words(F.col("text")).alias("words"), "tests")
    tested = tested.select(*KEY, F.explode(F.expr(
        "transform(tests, t -> named_struct('at', t.at, 'span', t.span, "
        "'window', array_join(slice(words, t.at + 1, t.span), ' '), 'whole', t.at + t.span <= size(words)))"
    )).alias("t")).select(*KEY, "t.*").where("whole")
    texts = windows.select(F.col("window").alias("listed")).distinct()
    matched = staging.table(tested.join(texts, F.expr("window = listed"), "left_semi"), "matched")
    covered = matched.select(*KEY, F.explode(F.expr("sequence(at, at + span - 1)")).alias("word")).distinct()
    covered = covered.groupBy(*KEY).agg(F.count(F.lit(1)).alias("hit"))
    named = matched.select(*KEY, "window").distinct().join(
        windows.where("item_id IS NOT NULL").selectExpr("window AS listed", "CAST(item_id AS STRING) AS item"),
        F.expr("window = listed"),
    )
    named = named.select(*KEY, "item").distinct().groupBy(*KEY).agg(F.sort_array(F.collect_list("item")).alias("items"))
    found = hits.select(*KEY, "n_words").join(covered, KEY, "left").join(named, KEY, "left")
    found = staging.table(found, "found")
    return rows.select("doc_id", *KEY).join(
        found.hint("merge"), KEY, "left"
    ).selectExpr(
        "doc_id", "coalesce(n_words, 0L) AS n_words", "coalesce(hit, 0L) AS n_hit", "CAST(coalesce(size(items), 0) AS BIGINT) AS n_items",
        "sha2(coalesce(array_join(items, ','), ''), 256) AS items_sha256", "hit IS NOT NULL AS contaminated", *KEY,
    )


_ITEM_WORDS = rf"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}')"
ORACLE = f"""
WITH i AS (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT item_id, w, least(len(w), {WINDOW}) AS span FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, span, array_to_string(w[s : s + span - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(w) - span + 2)) AS s FROM iw)),
d AS (SELECT doc_id, coalesce({_ITEM_WORDS}, []) AS w FROM documents),
p AS (SELECT doc_id, w, span, unnest(range(1, len(w) - span + 2)) AS s FROM d, (SELECT DISTINCT span FROM win) WHERE len(w) >= span),
m AS (SELECT doc_id, s, p.span AS span, win.item_id AS item_id FROM p JOIN win
  ON p.span = win.span AND array_to_string(w[s : s + p.span - 1], ' ') = win.win),
h AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM
  (SELECT doc_id, unnest(range(s, s + span)) AS word FROM m) GROUP BY 1),
n AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
  sha256(string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256 FROM m GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256,
  n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN n USING (doc_id)
"""
