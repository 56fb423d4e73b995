"""Tables spread over sites.

A site is a directory level and becomes a ``site`` column. Two layouts are read:
``<root>/<table>/site=<site>/`` (``by="table"``, what ``write_parquet`` with
``partition_by=["site"]`` produces; site filters prune directories) and
``<root>/<site>/<table>/`` (``by="site"``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.operators.names import SITE
from lotwise.sources.tables import read_table

_TABLE_THEN_SITE = r"/([^/]+)/site=([^/]+)/[^/]+$"
_SITE_THEN_TABLE = r"/([^/]+)/([^/]+)/[^/]+$"
LAYOUTS = ("table", "site")


def _check_layout(by: str) -> None:
    if by not in LAYOUTS:
        raise ValueError(f"unknown layout {by!r}, expected one of {LAYOUTS}")


def site_catalog(spark: SparkSession, root: str, by: str = "table") -> DataFrame:
    """``(site, table)`` for every table directory that holds files.

    Only file listings are read, never file contents.
    """
    _check_layout(by)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    pattern, site, table = (
        (_TABLE_THEN_SITE, 2, 1) if by == "table" else (_SITE_THEN_TABLE, 1, 2)
    )
    return (
        files.load(root)
        .select(
            F.regexp_extract("path", pattern, site).alias(SITE),
            F.regexp_extract("path", pattern, table).alias("table"),
        )
        .where(F.col(SITE) != "")
        .distinct()
    )


def multi_site_tables(catalog: DataFrame) -> DataFrame:
    """``(table, multi_site)``: is the table at more than one site?"""
    sites = F.countDistinct(SITE)
    return catalog.groupBy("table").agg((sites > 1).alias("multi_site"))


def read_site_table(
    spark: SparkSession,
    root: str,
    table: str,
    fmt: str = "parquet",
    schema: T.StructType | None = None,
    sites: Sequence[str] | None = None,
    by: str = "table",
) -> DataFrame:
    """The table at all sites, or at the given ones, with a ``site`` column."""
    _check_layout(by)
    if by == "table":
        if schema is not None:
            schema = T.StructType([*schema.fields, T.StructField(SITE, T.StringType())])
        df = read_table(spark, f"{root}/{table}", fmt, schema)
        df = df.withColumn(SITE, F.col(SITE).cast("string"))
        return df if sites is None else df.where(F.col(SITE).isin(list(sites)))
    paths = [f"{root}/{site}/{table}" for site in (["*"] if sites is None else sites)]
    df = read_table(spark, paths, fmt, schema)
    site = F.regexp_extract(F.col("_metadata.file_path"), _SITE_THEN_TABLE, 1)
    return df.select("*", site.alias(SITE))
