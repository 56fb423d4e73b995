"""A corpus pipeline of five stages over ``documents``.

Each stage takes all rows of the one before, as written to and read from Parquet,
and returns the columns of ``documents``; the last returns the encoded documents.
"""

from __future__ import annotations

from lotwise.llm import decontaminate, jaccard, language, mixing
from lotwise.llm.queries import token_files
from lotwise.llm.tables import read, row_key, set_aside
from lotwise.staging import Staging

LEAST_SCORE = 0.35
_staged: list[Staging] = []


def _staging(spark) -> Staging:
    """Where a stage keeps its work tables, until the next stage starts.

    A stage reads what the one before has written, so those tables are done with.
    """
    while _staged:
        _staged.pop().release()
    _staged.append(Staging(spark))
    return _staged[-1]


def language_id(spark, docs, sf_dir):
    """Drop documents without letters or without a clear language."""
    model = language.train(language.training_rows(docs), staging=_staging(spark))
    # every column goes to Python and back, the text once
    names = ["text" if c == "text" else f"in_{i}" for i, c in enumerate(docs.columns)]
    known = language.predict(docs.toDF(*names), model)
    known = known.where(f"lang_pred <> '{language.UNDETERMINED}' AND score >= {LEAST_SCORE}")
    return known.select(names).toDF(*docs.columns)


def near_duplicates(spark, docs, sf_dir):
    """Keep one document of each group that Jaccard links connect."""
    return jaccard.one_of_each(docs, staging=_staging(spark))


def decontamination(spark, docs, sf_dir):
    """Drop documents that hold a passage of the benchmark."""
    found = decontaminate.contamination(docs, read(spark, sf_dir, "benchmark"), _staging(spark))
    hit = found.where("contaminated").select(*decontaminate.KEY).hint("merge")
    rows, restore = set_aside(docs, "doc_id", "text")
    return rows.withColumns(row_key()).join(hit, decontaminate.KEY, "left_anti").select(*restore())


def mixed_sources(spark, docs, sf_dir):
    """Mix sources to their target weights; documents may come twice."""
    rows, restore = set_aside(docs, "doc_id", "source", "text")
    return mixing.sequence(mixing.mix(rows, staging=_staging(spark))).select(*restore())


def token_output(spark, docs, sf_dir):
    """Write token files and read the documents back from them."""
    return token_files(spark, docs, _staging(spark))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixed_sources),
    ("token_output", token_output),
]
ORACLE_SQL = None  # tokenizers and trained models are not SQL; tests hold it against brute force


def run(spark, sf_dir):
    """Apply the stages in order; each result is written and read again."""
    staging, docs = Staging(spark), read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staging.table(stage(spark, docs, sf_dir), name)
    return docs
