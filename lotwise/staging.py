"""Intermediate tables in the folder the cluster shares.

Results that several later jobs read (memos, located draws) are written once as
Parquet instead of being recomputed. Written files survive the loss of any
executor, carry true sizes for the planner's own broadcast decision, and keep
column pruning.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_dirs: list[tempfile.TemporaryDirectory] = []
_open: dict[str, Staging] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise RuntimeError(
            "set spark.checkpoint.dir to a folder that all executors can reach"
        )
    if not _local_dirs:
        _local_dirs.append(tempfile.TemporaryDirectory(prefix="lotwise-"))
    return _local_dirs[0].name


def release_all() -> None:
    """Delete everything staged by this process, also what has no owner left.

    Frames that operators returned read from there, so call it when all are used.
    """
    for staging in list(_open.values()):
        staging.release()


class Staging:
    """A private sub-folder of the shared folder for one query's tables.

    A context manager: at its end the folder is deleted. Operators that make
    their own keep it until ``release_all``.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.path = f"{(folder or shared_folder(spark)).rstrip('/')}/lotwise-{uuid.uuid4().hex}"
        self._count = 0
        _open[self.path] = self

    def __enter__(self) -> Staging:
        return self

    def __exit__(self, *error) -> None:
        self.release()

    def new_path(self, name: str) -> str:
        self._count += 1
        return f"{self.path}/{self._count:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` once and return a scan of the written files."""
        path = self.new_path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Delete the sub-folder; frames that read from it are invalid afterwards."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        conf = self.spark._jsc.hadoopConfiguration()
        path.getFileSystem(conf).delete(path, True)
        _open.pop(self.path, None)
