"""Streaming forms of collapse, resampling, key checks and conversion."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyloom.plans.session import shared_folder


def timed(df: DataFrame, time: str, late: str) -> DataFrame:
    """df with a watermark; times without a zone are taken as those of the session."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def stream_collapse(
    df: DataFrame, time: str, window: str, keys: Sequence[str], variables: Sequence[str], weight: str | None = None, late: str = "1 day", slide: str | None = None
) -> DataFrame:
    """Weighted means by window and keys, from sums that add up as rows come; rows later than the
    watermark are dropped."""
    w = F.col(weight) if weight else F.lit(1.0)
    at = F.window(time, window, slide) if slide else F.window(time, window)
    parts = [F.try_divide(F.sum(F.col(x) * w), F.sum(F.when(F.col(x).isNotNull(), w))).alias(x) for x in variables]
    grouped = timed(df, time, late).groupBy(at.alias("_window"), *keys)
    return grouped.agg(*parts, F.count(F.lit(1)).alias("n")).select(F.col("_window.start").alias("start"), *keys, *variables, "n")


def stream_resample(df: DataFrame, time: str, unit: str, values: Mapping[str, str], keys: Sequence[str] = (), late: str = "1 day") -> DataFrame:
    """(start, keys, values, n) of periods such as day, week, month or quarter, as rows come. values: column to
    mean, sum, min, max, first or last, the last two by time."""
    how = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "first": lambda c: F.min_by(c, time), "last": lambda c: F.max_by(c, time)}
    if wrong := sorted({v for v in values.values() if v not in how}):
        raise ValueError(f"unknown ways to resample: {wrong}")
    start = F.date_trunc(unit, F.col(time))
    made = (how[v](c).alias(c) for c, v in values.items())
    return timed(df, time, late).groupBy(start.alias("start"), *keys).agg(*made, F.count(F.lit(1)).alias("n"))


def stream_unique(df: DataFrame, time: str, keys: Sequence[str], late: str = "1 day") -> DataFrame:
    """The first row of each key within the watermark."""
    return timed(df, time, late).dropDuplicatesWithinWatermark(list(keys))


def stream_sessions(df: DataFrame, time: str, keys: Sequence[str], gap: str, late: str = "1 day") -> DataFrame:
    """(start, end, keys, n) of runs of rows without a longer gap."""
    grouped = timed(df, time, late).groupBy(F.session_window(time, gap).alias("_s"), *keys)
    return grouped.agg(F.count(F.lit(1)).alias("n")).select(F.col("_s.start").alias("start"), F.col("_s.end").alias("end"), *keys, "n")


def stream_regression(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """(key, n, slope) of the line through all rows of a key so far, from moments that add up as rows come."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    sums = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *(F.sum(e).alias(n) for n, e in (("_x", a), ("_y", b), ("_xx", a * a), ("_xy", a * b))))
    spread = F.col("n") * F.col("_xx") - F.col("_x") * F.col("_x")
    return sums.select(key, "n", F.when(spread != 0, (F.col("n") * F.col("_xy") - F.col("_x") * F.col("_y")) / spread).alias("slope"))


def run_available(df: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """All that a stream has now: each batch is written as Parquet in the shared folder, and of the
    complete results the last one is read, else all."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    done: list[str] = []

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{number}")
        done.append(f"{path}/{number}")

    query = df.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if not done:
        return spark.createDataFrame([], df.schema)
    return spark.read.schema(df.schema).parquet(*(done[-1:] if mode == "complete" else dict.fromkeys(done)))


def convert_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write a stream as Parquet, once for what there is; a later call goes on where it ended."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).option("compression", "zstd").trigger(availableNow=True).start()


def read_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table file as a stream."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
