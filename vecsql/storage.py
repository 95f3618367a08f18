"""A folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
#: Folders of intermediate tables and of indexes that queries made for themselves, by session.
_made: list[tuple[SparkSession, str]] = []


def remember(spark: SparkSession, path: str) -> str:
    """A folder that goes when the session's program ends, or with ``clean``."""
    if not _made:
        atexit.register(clean)
    _made.append((spark, path))
    return path


def clean() -> None:
    """Delete all remembered folders; frames that still read them can't be used any more."""
    while _made:
        spark, path = _made.pop()
        if spark.sparkContext._jsc is None:  # stopped before
            continue
        try:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        except (Py4JError, OSError):  # the JVM has gone already, and with it the way to the folders
            _made.clear()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only where it is unset and the master is this one
    machine (tests), a temporary folder."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="vecsql-"))
        atexit.register(shutil.rmtree, _own[0], True)
    return f"file://{_own[0]}"


def fixed(df: DataFrame, name: str = "table") -> DataFrame:
    """The frame written once below the shared folder and read from there: numbers made from its order stay as they are."""
    spark = df.sparkSession
    path = remember(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
