"""Readers and writers of single tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.functions import quoted
from lotwise.sources.blocks import csv_records

FORMATS = ("csv", "parquet")
# No field can hold this text, so a quoted empty field stays an empty string and
# only an unquoted one is null.
_NO_TEXT = "\u0000"


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | None = None,
    multi_line: bool = True,
    mode: str = "FAILFAST",
    split: bool = False,
) -> DataFrame:
    """Comma-separated files with a header; all strings without a schema.

    Types are never inferred, so the files are read once. A field may hold line
    breaks, quotes and backslashes. For that a task reads a whole file; without
    line breaks in fields, ``multi_line=False`` lets large files be cut. With them,
    ``split=True`` does, for two or three passes over the files instead of one. A
    value that its type cannot hold is an error; ``mode="PERMISSIVE"`` makes it null.
    """
    parsing = {
        "sep": ",", "nullValue": _NO_TEXT, "escape": '"', "mode": mode, "lineSep": "\n",
        "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
    }
    reader = spark.read.options(header=True, multiLine=multi_line or split, **parsing)
    if not split:
        return (reader.schema(schema) if schema else reader).csv(path)
    schema = schema or reader.csv(path).schema
    fields = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in schema)
    parsed = csv_records(spark, path).select(F.from_csv("record", fields, parsing).alias("row"))
    return parsed.select("row.*")


def read_table(
    spark: SparkSession,
    path: str | list[str],
    fmt: str = "parquet",
    schema: T.StructType | None = None,
    **csv_options,
) -> DataFrame:
    """All files of a table directory in its declared format.

    ``csv_options`` are those of ``read_csv``: multi_line, mode, split.
    """
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}, expected one of {FORMATS}")
    if fmt == "csv":
        return read_csv(spark, path, schema, **csv_options)
    if csv_options:
        raise ValueError(f"{list(csv_options)} are options of csv files")
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(*([path] if isinstance(path, str) else path))


def empty_table(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """A relation without rows, the neutral element of UNION ALL."""
    return spark.createDataFrame([], schema)


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """Overwrite ``path`` with CSV files; one file only for small results.

    Empty strings are written as ``""`` and so stay apart from nulls; blanks at
    the ends of a text are kept.
    """
    out = df.coalesce(1) if single_file else df
    keep_blanks = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    out.write.mode("overwrite").options(header=True, escape='"', lineSep="\n", **keep_blanks).csv(path)


def write_parquet(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), single_file: bool = False
) -> None:
    """Overwrite ``path`` with Parquet files, optionally in one directory per value."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_memo(memo: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write ``(key, count)``; Parquet keeps the key's type."""
    if fmt == "csv":
        write_csv(memo, path)
    else:
        write_parquet(memo, path)


def read_memo(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None
) -> DataFrame:
    """Read a memo; its two columns are renamed by position."""
    return read_table(spark, path, fmt, schema).toDF("key", "count")


def write_samples(samples: dict[str, DataFrame], path: str, fmt: str = "parquet") -> None:
    """One directory per table below ``path``, in Parquet or CSV."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}, expected one of {FORMATS}")
    for name, df in samples.items():
        (write_csv if fmt == "csv" else write_parquet)(df, f"{path}/{name}")
