"""URL filters over dated block lists, as a temporal list join.

A list is a history of entries: at ``since`` a pattern is added to or removed
from a category. Consecutive entries of a pattern become validity intervals, and
every capture is tested against the entries active when it was fetched.

A capture is asked under every pattern it could match: its host, each parent
domain of that, and the host with each leading part of its path. These are
equality keys, so the test is an equi-join with a time condition; a popular host
is split like any overfull reducer. Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm.tables import set_aside
from lotwise.staging import Staging

HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^?#]*)"


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, category, since, until) of the times at which entries are active.

    ``entries`` has pattern, category, since (date) and active (boolean). Of
    entries of a pattern and category with the same date the removal counts last.
    Rows with a null pattern, date or verdict say nothing.
    """
    known = entries.where("pattern IS NOT NULL AND since IS NOT NULL AND active IS NOT NULL")
    day = known.groupBy("pattern", "category", "since").agg(F.min("active").alias("active"))
    following = Window.partitionBy("pattern", "category").orderBy("since")
    day = day.withColumn("until", F.lead("since").over(following))
    return day.where("active").select("pattern", "category", "since", "until")


def patterns(url: str, host: str = "__host", path: str = "__path") -> str:
    """SQL text: the distinct patterns a URL could match, longest path first."""
    labels = f"split({host}, '[.]')"
    domains = f"transform(sequence(1, size({labels})), i -> array_join(slice({labels}, i, size({labels})), '.'))"
    steps = f"filter(split({path}, '/'), s -> s <> '')"
    paths = (
        f"transform(sequence(0, size({steps})), i -> "
        f"concat({host}, '/', array_join(slice({steps}, 1, i), '/')))"
    )
    return f"array_distinct(concat({domains}, slice({paths}, 2, size({steps}))))"


def filter_urls(captures: DataFrame, entries: DataFrame, staging: Staging | None = None) -> DataFrame:
    """``captures`` (with url and fetched, a date) and the verdict of the lists.

    Adds host (lower case; null if the URL has none), n_active (active entries
    that match), blocked (any does) and reason (pattern and category of the
    longest of them, the least by text of ties). Rows with a null URL, host or
    date are not blocked. Other columns of ``captures`` are kept as they are, but
    those with the names of the added ones.
    """
    staging = staging or Staging(captures.sparkSession)
    spans = staging.table(intervals(entries), "intervals")
    spans = spans.selectExpr("pattern AS __listed", "category AS __category", "since AS __since", "until AS __until")
    host = F.lower(F.regexp_extract("url", HOST, 1))
    captures, restore = set_aside(captures, "url", "fetched")
    known = captures.withColumns(
        {"host": F.when(host != "", host), "__path": F.regexp_extract("url", PATH, 1)}
    )
    asked = (
        known.where("host IS NOT NULL AND fetched IS NOT NULL")
        .select("url", "fetched", "host", "__path")
        .distinct()
        .select("url", "fetched", F.explode(F.expr(patterns("url", "host"))).alias("__pattern"))
    )
    active = F.expr("__pattern = __listed AND fetched >= __since AND (__until IS NULL OR fetched < __until)")
    matched = asked.join(spans, active).groupBy("url", "fetched").agg(
        F.count(F.lit(1)).alias("n_active"),
        F.min(F.struct((-F.length("__pattern")).alias("l"), "__pattern", "__category")).alias("__best"),
    )
    matched = matched.selectExpr(
        "url AS __url", "fetched AS __fetched", "n_active",
        "concat_ws(' ', __best.__pattern, __best.__category) AS reason",
    )
    same = (F.col("url") == F.col("__url")) & (F.col("fetched") == F.col("__fetched"))
    joined = known.join(matched, same, "left")
    return joined.select(
        *restore("host", "n_active", "blocked", "reason"),
        "host",
        F.coalesce("n_active", F.lit(0)).cast("bigint").alias("n_active"),
        F.col("n_active").isNotNull().alias("blocked"),
        "reason",
    )
