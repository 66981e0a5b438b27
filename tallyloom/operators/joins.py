"""Joins on dates, intervals, crosswalks and nearest scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_date_many(frames: Sequence[DataFrame], date: str = "date", how: str = "full_outer") -> DataFrame:
    """Frames side by side on their dates."""
    return reduce(lambda a, b: a.join(b, date, how), frames)


def load_outer(tables: Mapping[str, DataFrame], date: str = "date", prefix_all: bool = False) -> DataFrame:
    """Tables side by side on their dates; a table of several columns gets its name before them."""
    frames = []
    for name, df in tables.items():
        values = [c for c in df.columns if c != date]
        prefixed = prefix_all or len(values) > 1
        frames.append(df.select(date, *(F.col(c).alias(f"{name}_{c}" if prefixed else c) for c in values)))
    return merge_date_many(frames, date)


def interval_mask(df: DataFrame, spans: DataFrame, on: Sequence[str], date: str, start: str, end: str, values: Sequence[str]) -> DataFrame:
    """df joined with spans on keys; values of spans that don't hold on a row's date are missing, and
    the rows stay."""
    holds = F.col(date).between(F.col(start), F.col(end))
    joined = df.join(spans, list(on))
    return joined.withColumns({v: F.when(holds, F.col(v)) for v in values})


def nearest_match(
    treated: DataFrame, untreated: DataFrame, treated_id: str, untreated_id: str, score: str, caliper: float = 0.0
) -> DataFrame:
    """(treated, untreated, dist): for each treated row the untreated one of the nearest score.

    Ties go to the smaller id; with a caliper, matches farther than it are left out. Both sides are
    put in order of score once, and the nearest neighbours on either side are carried along; no
    pairs are made. Untreated rows of one score are first reduced to their smallest id.

    Order is global: rows are cut into ranges of score, each range's first and last untreated score
    is passed on to the ranges after and before, so no task holds all rows.
    """
    spark = treated.sparkSession
    low = untreated.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("_s")).agg(F.min(untreated_id).alias("_u"))
    high = treated.where(F.col(score).isNotNull()).select(F.col(score).cast("double").alias("_s"), F.col(treated_id).alias("_t"))
    both = low.select("_s", "_u", F.lit(None).cast(high.schema["_t"].dataType).alias("_t")).unionByName(
        high.select("_s", F.lit(None).cast(low.schema["_u"].dataType).alias("_u"), "_t")
    )
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    edges = both.agg(F.percentile_approx("_s", F.array(*(F.lit(i / parts) for i in range(1, parts))), 1000).alias("e")).first()["e"] if parts > 1 else []
    cuts = F.array(*(F.lit(float(e)) for e in sorted(set(edges or [])))) if edges else F.array().cast("array<double>")
    both = both.withColumn("_part", F.size(F.filter(cuts, lambda e: F.col("_s") > e)))
    point = F.when(F.col("_u").isNotNull(), F.struct("_s", "_u"))
    ends = both.groupBy("_part").agg(F.max(point).alias("_last"), F.min(point).alias("_first"))
    along = Window.orderBy("_part")
    ends = ends.select(
        "_part",
        F.last("_last", True).over(along.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
        F.first("_first", True).over(along.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
    )
    inside = Window.partitionBy("_part").orderBy("_s")
    placed = both.select(
        "*",
        F.last(point, True).over(inside.rangeBetween(Window.unboundedPreceding, 0)).alias("_below"),
        F.first(point, True).over(inside.rangeBetween(0, Window.unboundedFollowing)).alias("_above"),
    )
    placed = placed.where(F.col("_t").isNotNull()).join(F.broadcast(ends), "_part", "left")

    def near(side: Column) -> Column:
        return F.when(side.isNotNull(), F.struct(F.abs(F.col("_s") - side["_s"]).alias("dist"), side["_u"].alias("u")))

    best = F.least(near(F.coalesce("_below", "_before")), near(F.coalesce("_above", "_after")))
    out = placed.select(F.col("_t").alias("treated"), best["u"].alias("untreated"), best["dist"].alias("dist")).where("untreated is not null")
    return out.where(F.col("dist") <= caliper) if caliper > 0 else out


def crosswalk_factors(df: DataFrame, source: str, target: str, weight: str) -> DataFrame:
    """(source, target, factor): each target's share of its source's weight."""
    sums = df.groupBy(source, target).agg(F.sum(weight).alias("_w"))
    share = F.try_divide(F.col("_w"), F.sum("_w").over(Window.partitionBy(source)))
    return sums.select(source, target, share.alias("factor"))


def crosswalk_allocate(df: DataFrame, factors: DataFrame, source: str, target: str, values: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Values of sources dealt to targets by factors and summed. Values are summed to sources and keys before
    they meet their factors, so a source's rows and its targets make no pairs."""
    own = [k for k in keys if k in df.columns]
    sums = df.groupBy(source, *own).agg(*(F.sum(v).alias(v) for v in values))
    return sums.join(factors, source).groupBy(target, *keys).agg(*(F.sum(F.col(v) * F.col("factor")).alias(v) for v in values))


def keep_groups(df: DataFrame, keys: Sequence[str], holds: Column) -> DataFrame:
    """The rows of the groups in all of whose rows holds is true; null counts as true, and rows without a
    group go."""
    good = df.groupBy(*keys).agg(F.max(F.when(~holds, 1).otherwise(0)).alias("_bad")).where("_bad = 0").drop("_bad")
    return df.join(good, list(keys), "left_semi")


def ratio(a: Column, b: Column, sentinel: float | None = 666.0) -> Column:
    """a over b; where b is 0 the sentinel."""
    return F.when(b == 0, F.lit(sentinel)).otherwise(F.try_divide(a, b))


def percent_violations(distance: Column) -> Column:
    """Aggregate: share of negative distances among those that are there."""
    return F.avg(F.when(distance.isNotNull(), (distance < 0).cast("double")))
