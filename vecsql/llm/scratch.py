"""Intermediate tables in the folder that all executors share.

Long jobs cut their lineage by writing a table below ``spark.checkpoint.dir`` and reading it
again: a lost executor then costs only the running stage, and the plan is computed once.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from vecsql.storage import remember, shared_dir


#: Rows and bytes of an Arrow batch, at most, where rows hold texts or pictures.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
#: Whether shuffle files go when their query has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def small_batches(spark: SparkSession) -> None:
    """From now on this session's Arrow batches have at most ``BATCH_ROWS`` rows and about ``BATCH_BYTES`` bytes.

    An operator's result is a plan that runs later, under the session's settings of that time, so they stay;
    they only make batches smaller. At the usual 64 MB a batch stands a few times in the JVM and in Python.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        number, unit = re.fullmatch(r"(-?\d+)([kmg]?)b?", spark.conf.get(key).lower()).groups()
        if not 0 < int(number) << {"": 0, "k": 10, "m": 20, "g": 30}[unit] <= most:
            spark.conf.set(key, str(most))


def unused(name: str, *frames: DataFrame) -> str:
    """The name, with underscores before it until no column of the frames has it."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


class Scratch:
    """Named tables of one operator call; a unique folder keeps concurrent calls apart. They go when the program ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = remember(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")

    def save(self, df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
        """The frame as a table; Spark deletes the shuffle files behind it as soon as it is written."""
        conf, before = self.spark.conf, self.spark.conf.get(CLEANUP)
        conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").parquet(f"{self.root}/{name}", compression=compression)
        finally:
            conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        for name in names:
            at = path(f"{self.root}/{name}")
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
