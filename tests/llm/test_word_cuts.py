"""How often and by which pattern texts are cut into words for the benchmark."""

from lotwise.llm import decontaminate
from lotwise.llm.tables import keyed


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_documents_are_cut_into_words_once(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    listed = keyed(docs).select(*decontaminate.KEY, decontaminate.words(docs["text"]).alias("words"))
    placed = decontaminate._positions(listed, decontaminate.KEY)
    assert _plan(placed.where("at > 0")).count("regexp_extract_all") == 1
    found = decontaminate.contamination(docs, spark.createDataFrame([(1, "a")], "item_id long, text string"))
    assert "regexp" not in _plan(found)


def test_words_as_in_the_sql(spark):
    texts = ["".join(map(chr, range(128))), "ABC Äbc İI ß-Z", "", " ", "é" * 3 + "\U0001f600X_y", None]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    fast = decontaminate.words(docs["text"])
    plain = f"coalesce(regexp_extract_all(translate(text, '{decontaminate.UPPER}', '{decontaminate.LOWER}'), r'{decontaminate.WORD}', 0), array())"
    assert all(r.a == r.b for r in docs.selectExpr(f"{plain} AS a", "text").withColumn("b", fast).collect())
