"""Session set-up, tables and checkpoints."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session in UTC with adaptive execution; both settings are left to the cluster if not given."""
    builder = SparkSession.builder.appName("tallyloom").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()


def own_folder(spark: SparkSession) -> str:
    """A temporary folder for what is written on the way, in local mode only: executors of a cluster share none."""
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="tallyloom-")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one is made only where none is set, and kept in the settings."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = own_folder(spark)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the folder of spark.checkpoint.dir; one is made only where none is set."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def send_package(spark: SparkSession) -> None:
    """Let Python workers import this package: it is sent to them as a zip file, once a session."""
    context = spark.sparkContext
    if getattr(context, "_tallyloom_sent", False):
        return
    package = Path(__file__).resolve().parent.parent
    file = Path(tempfile.mkdtemp(prefix="tallyloom-")) / "tallyloom_package.zip"
    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(str(file))
    context._tallyloom_sent = True
