"""Input columns shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key() -> dict[str, Column]:
    """A 128-bit row key (__a, __b) of doc_id and text.

    Repeated rows share a key, so whatever is computed per key holds for each of
    them. A null doc_id or text has a key like any other value.
    """
    return {
        "__a": F.xxhash64("doc_id", "text"),
        "__b": F.xxhash64("text", F.lit(7), "doc_id"),
    }


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the row key; other columns go."""
    return docs.select("doc_id", "text", *[c.alias(k) for k, c in row_key().items()])


def set_aside(df: DataFrame, *wanted: str) -> tuple[DataFrame, Callable[..., list[Column]]]:
    """``df`` with columns under names of their own, and copies of the wanted ones.

    Work columns then clash with none. The function given back lists the columns
    of ``df`` under their old names, without those whose names it is told.
    """
    names = df.columns
    own = df.toDF(*[f"in_{i}" for i in range(len(names))])
    own = own.withColumns({w: F.col(f"in_{names.index(w)}") for w in wanted})

    def restore(*without: str) -> list[Column]:
        return [F.col(f"in_{i}").alias(c) for i, c in enumerate(names) if c not in without]

    return own, restore
