"""Tables that are made once from raw files and then read as Parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class ConvertedTables:
    """Parquet tables under a folder that driver and executors share.

    A table is one Spark job whose output is committed as a whole, so it is either there or not: one
    without its mark of success is made again.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def files(self, path: str) -> list[str]:
        """Names in a folder of any store that Spark reads; none if it is not there."""
        jvm = self.spark._jvm
        there = jvm.org.apache.hadoop.fs.Path(path)
        fs = there.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(s.getPath().getName() for s in fs.listStatus(there)) if fs.exists(there) else []

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def has(self, name: str) -> bool:
        return "_SUCCESS" in self.files(self.path(name))

    def make(self, name: str, rows: Callable[[], DataFrame], overwrite: bool = False, compression: str = "zstd") -> str:
        """The path of a table, which is made only if it is not there or to be overwritten."""
        if overwrite or not self.has(name):
            rows().write.mode("overwrite").option("compression", compression).parquet(self.path(name))
        return self.path(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))
