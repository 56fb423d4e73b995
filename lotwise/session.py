"""Session defaults."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}

LOCAL = {
    "spark.driver.memory": "16g",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    app: str = "lotwise", master: str | None = None, **conf: str
) -> SparkSession:
    """A session with adaptive execution on.

    On a cluster leave ``master`` unset and give ``spark.checkpoint.dir`` and
    ``spark.sql.shuffle.partitions`` through spark-submit. ``conf`` keys use
    ``__`` for the dots.
    """
    builder = SparkSession.builder.appName(app)
    settings = dict(DEFAULTS)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            settings |= LOCAL
    settings |= {k.replace("__", "."): str(v) for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
