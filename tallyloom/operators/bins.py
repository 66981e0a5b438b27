"""Quantile bins, histograms, clipping and binned scatters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.operators.quantiles import finite, weighted_quantiles


def inner_edges(df: DataFrame, variable: str, n_bins: int, weight: str | None = None) -> DataFrame:
    """One row with _edges: the distinct quantiles between the outer bins."""
    qs = [i / n_bins for i in range(1, n_bins)]
    cut = weighted_quantiles(df, [], variable, weight, qs, 0.5 if weight else 1.0)
    return cut.select(F.array_distinct(F.array(*cut.columns)).alias("_edges"))


def bin_data(
    df: DataFrame, variable: str, n_bins: int, name: str | None = None, weight: str | None = None
) -> DataFrame:
    """Adds the number, from 0, of the right-closed quantile bin of variable; missing stays missing."""
    edges = inner_edges(df, variable, n_bins, weight)
    above = sum((F.coalesce((F.col(variable) > F.get("_edges", i)).cast("int"), F.lit(0)) for i in range(n_bins - 1)), F.lit(0))
    return df.join(F.broadcast(edges)).withColumn(name or f"{variable}_bin", F.when(F.col(variable).isNotNull(), above)).drop("_edges")


def bin_dummies(df: DataFrame, variable: str, n_bins: int) -> DataFrame:
    """Adds variable_bin1 ... of 0 and 1: left-closed quantile bins, the last one open above."""
    qs = [i / n_bins for i in range(1, n_bins)]
    cut = weighted_quantiles(df, [], variable, None, qs, 1.0)
    out = df.join(F.broadcast(cut.select(F.array(*cut.columns).alias("_edges"))))
    for i in range(n_bins):
        inside = F.lit(True)
        if i:
            inside &= F.col(variable) >= F.col("_edges")[i - 1]
        if i < n_bins - 1:
            inside &= F.col(variable) < F.col("_edges")[i]
        out = out.withColumn(f"{variable}_bin{i + 1}", inside.cast("int"))
    return out.drop("_edges")


def winsorize(df: DataFrame, variables: Sequence[str], keep: float = 0.98, weight: str | None = None) -> DataFrame:
    """Variables clipped to their central share keep, by plain or weighted quantiles."""
    low, high = (1 - keep) / 2, 1 - (1 - keep) / 2
    out = df
    for x in variables:
        ends = weighted_quantiles(df, [], x, weight, [low, high], 0.5 if weight else 1.0)
        cut = ends.select(F.array(*ends.columns).alias("_cut"))
        clipped = F.least(F.greatest(F.col(x), F.col("_cut")[0]), F.col("_cut")[1])
        out = out.join(F.broadcast(cut)).withColumn(x, F.when(F.col(x).isNotNull(), clipped)).drop("_cut")
    return out


def fixed_bin(x: Column, low: float, high: float, n_bins: int) -> Column:
    """Number from 0 of an equal-width bin, left-closed, the last one closed; null outside."""
    number = F.when(x == high, F.lit(n_bins)).otherwise(F.width_bucket(x, F.lit(float(low)), F.lit(float(high)), F.lit(n_bins)))
    return F.when(number.between(1, n_bins), number - 1)


def histogram(df: DataFrame, variable: str, low: float, high: float, n_bins: int) -> DataFrame:
    """(bin, count) of equal-width bins, empty ones included."""
    counts = df.select(fixed_bin(F.col(variable), low, high, n_bins).cast("long").alias("bin")).where("bin is not null").groupBy("bin").count()
    spine = df.sparkSession.range(n_bins).withColumnRenamed("id", "bin")
    return spine.join(F.broadcast(counts), "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("n"))


def edge_bin(x: Column, edges: Sequence[float]) -> Column:
    """Number from 0 of the right-closed bin (a, b] of edges; null outside."""
    out = None
    for i in range(len(edges) - 1):
        inside = (x > edges[i]) & (x <= edges[i + 1])
        out = F.when(inside, F.lit(i)) if out is None else out.when(inside, F.lit(i))
    return out


def share_histogram(df: DataFrame, variable: str, edges: Sequence[float], weight: str | None = None) -> DataFrame:
    """(left, share) of right-closed bins, shares of the weight inside the edges, empty bins included."""
    w = F.col(weight) if weight else F.lit(1.0)
    rows = df.select(edge_bin(F.col(variable), edges).alias("_bin"), w.alias("_w")).where("_bin is not null")
    sums = rows.groupBy("_bin").agg(F.sum("_w").alias("_w"))
    total = sums.agg(F.sum("_w").alias("_total"))
    spine = df.sparkSession.createDataFrame([(i, float(e)) for i, e in enumerate(edges[:-1])], "_bin int, left double")
    share = F.coalesce(F.col("_w"), F.lit(0.0)) / F.col("_total")
    return spine.join(F.broadcast(sums), "_bin", "left").join(F.broadcast(total)).select("left", share.alias("share"))


def topcode(x: Column, low: float | None = None, high: float | None = None) -> Column:
    if low is not None:
        x = F.greatest(x, F.lit(float(low)))
    return F.least(x, F.lit(float(high))) if high is not None else x


def binscatter(df: DataFrame, y: str, x: str, n_bins: int = 10, weight: str | None = None, median: bool = False) -> DataFrame:
    """(bin, x, y) means, or medians, of x and y in quantile bins of x."""
    rows = bin_data(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, n_bins, "bin", weight)
    if median:
        return rows.groupBy("bin").agg(F.median(x).alias("x"), F.median(y).alias("y"))
    w = F.col(weight) if weight else F.lit(1.0)
    return rows.groupBy("bin").agg(*(F.try_divide(F.sum(F.col(c) * w), F.sum(w)).alias(n) for c, n in ((x, "x"), (y, "y"))))
