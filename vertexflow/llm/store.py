"""Tables written to the folder that the driver and all executors share.

Iterative operators cut their lineage here: a written table survives the loss of
any executor, is computed once and is read back column by column.
"""

from __future__ import annotations

import gc
import itertools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary folder only for a local session where none is set (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="vertexflow-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


class Store:
    """A scratch folder of one operator call, deleted when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self._numbers = itertools.count()
        self._hadoop(self.path)[0].deleteOnExit(self._hadoop(self.path)[1])

    def _hadoop(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def put(self, df: DataFrame, name: str = "t", partition_by: str | None = None) -> DataFrame:
        """Write ``df`` and return the written table."""
        path = f"{self.path}/{name}-{next(self._numbers)}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stored_at = path
        return out

    def read(self, df: DataFrame) -> DataFrame:
        """A written table anew, in the partitions of its files."""
        out = self.spark.read.schema(df.schema).parquet(df._stored_at)
        out._stored_at = df._stored_at
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no later plan reads."""
        fs, at = self._hadoop(df._stored_at)
        fs.delete(at, True)

    def release(self) -> None:
        """Let Spark delete the shuffle files of plans that nothing refers to any more."""
        gc.collect()
        self.spark._jvm.System.gc()
