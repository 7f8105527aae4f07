"""Intermediate results written to the folder the cluster shares for checkpoints."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only where it is unset and Spark runs in this very process (tests) is a local folder taken.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is not None:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share!")
    return _local_folder(spark.sparkContext.applicationId).name


@cache
def _local_folder(_application_id: str) -> tempfile.TemporaryDirectory:
    """Goes with the process."""
    return tempfile.TemporaryDirectory(prefix="voltledger-", ignore_cleanup_errors=True)


def hadoop_path(spark: SparkSession, path: str):
    """The file system of ``path`` and the path object, for any file system Spark can reach."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


class Staging:
    """A folder of its own for one run. Frames read from it do not depend on any executor.

    ``drop`` it when no frame that reads from it is needed any more.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/voltledger/{label}-{uuid.uuid4().hex}"
        self._count = 0

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame) -> DataFrame:
        """Write the frame once and return a frame that reads it back."""
        self._count += 1
        path = self.path(f"part{self._count}")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        file_system, path = hadoop_path(self.spark, self.root)
        file_system.delete(path, True)
