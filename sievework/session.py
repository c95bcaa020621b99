"""Session helpers: table loading and tables written to the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Temporary folders by application, for sessions that name no shared folder.
_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by ``spark.checkpoint.dir``.

    Only where that setting is absent and the master is local (tests, a laptop) a temporary folder is made, which goes at exit; on a cluster
    a folder of one machine would be another one for each executor, so the setting must be there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="sievework-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return f"file://{_OWN[app]}"


#: Folders in use, so that they can be removed before the application ends.
_PATHS: list[str] = []


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed by ``released`` or when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    p, fs = _folder(spark, path)
    fs.deleteOnExit(p)
    _PATHS.append(path)
    return path


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the intermediate tables written within; results must have been written or collected by then."""
    before = len(_PATHS)
    try:
        yield
    finally:
        while len(_PATHS) > before:
            p, fs = _folder(spark, _PATHS.pop())
            fs.delete(p, True)


#: Spark's setting to delete the shuffle files of a query when it ends, and not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back.

    It cuts the lineage and survives the loss of executors. Columns that a later step doesn't read
    aren't read from disk.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


def let_go(*tables: DataFrame) -> None:
    """Removes tables made by ``written`` that no later step reads; what was derived from them must have been written itself."""
    for t in tables:
        p, fs = _folder(t.sparkSession, t.written_to)
        fs.delete(p, True)
        if t.written_to in _PATHS:
            _PATHS.remove(t.written_to)


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a query go as soon as it ends."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)
