"""Exact quantiles, weighted and not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.collapse import present


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))


def quantile_name(variable: str, q: float) -> str:
    return f"{variable}_p{100 * q:g}".replace(".", "_")


def running_sums(values: DataFrame, keys: Sequence[str], x: str, sums: Sequence[str]) -> DataFrame:
    """Adds before_<c> and total_<c> of each of sums: over the smaller x of the group, and over all of it.

    values has one row a group and x. Rows are cut into ranges of x, each summed on its own, and only
    the ranges' sums are added up in order; so no task gets a whole group, however large.
    """
    parts = max(1, int(values.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    shares = F.array(*(F.lit(i / parts) for i in range(1, parts))) if parts > 1 else F.array(F.lit(0.5))
    cuts = values.agg(F.percentile_approx(x, shares, 1000).alias("_cuts"))
    placed = values.join(F.broadcast(cuts)).withColumn("_range", F.size(F.filter("_cuts", lambda e: F.col(x) > e))).drop("_cuts")
    ranges = placed.groupBy(*keys, "_range").agg(*(F.sum(c).alias(f"_r_{c}") for c in sums))
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        *keys,
        "_range",
        *(F.coalesce(F.sum(f"_r_{c}").over(earlier), F.lit(0)).alias(f"_e_{c}") for c in sums),
        *(F.sum(f"_r_{c}").over(group).alias(f"total_{c}") for c in sums),
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumns({f"_i_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums})
    joined = placed.join(ranges, [*keys, "_range"])
    return joined.withColumns({f"before_{c}": F.col(f"_e_{c}") + F.col(f"_i_{c}") for c in sums}).drop(
        "_range", *(f"_e_{c}" for c in sums), *(f"_i_{c}" for c in sums)
    )


def weighted_quantiles(
    df: DataFrame, keys: Sequence[str], variable: str, weight: str | None, quantiles: Sequence[float], c: float = 0.5
) -> DataFrame:
    """Interpolated weighted quantiles by group, one column each.

    Values in order, equal ones by weight, stand at (S - c w) / (T + (1 - 2c) w), S their running and
    T the whole weight; quantiles are interpolated between neighbours and held at the ends. Only
    finite values of positive weight count. Without a weight and with c = 1 these are the usual
    linearly interpolated quantiles.

    Of equal values only the first and the last place matter, so values are summed up before the
    exchange, and the running weights of ranges of values are found apart from each other.
    """
    x = F.col(variable).cast("double")
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.where(present(keys)).select(*keys, x.alias("_x"), w.alias("_w")).where(finite(F.col("_x")) & finite(F.col("_w")) & (F.col("_w") > 0))
    values = rows.groupBy(*keys, "_x").agg(F.sum("_w").alias("_w"), F.min("_w").alias("_small"), F.max("_w").alias("_large"))
    placed = running_sums(values, keys, "_x", ["_w"])

    def at(s: Column, own: Column) -> Column:
        return F.coalesce(F.try_divide(s - own * c, F.col("total__w") + own * (1 - 2 * c)), F.lit(0.0))

    first, last = at(F.col("before__w") + F.col("_small"), F.col("_small")), at(F.col("before__w") + F.col("_w"), F.col("_large"))
    points = placed.select(*keys, F.explode(F.array(*(F.struct(g.alias("_g"), F.col("_x")) for g in (first, last)))).alias("_p"))
    found = []
    for i, q in enumerate(quantiles):
        found.append(F.max(F.when(F.col("_p._g") <= q, F.col("_p"))).alias(f"_lo{i}"))
        found.append(F.min(F.when(F.col("_p._g") > q, F.col("_p"))).alias(f"_hi{i}"))
    ends = points.groupBy(*keys).agg(*found)

    def between(i: int, q: float) -> Column:
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        slope = (hi["_x"] - lo["_x"]) / (hi["_g"] - lo["_g"])
        return F.when(lo.isNull(), hi["_x"]).when(hi.isNull(), lo["_x"]).otherwise(lo["_x"] + slope * (q - lo["_g"]))

    return ends.select(*keys, *(between(i, q).alias(quantile_name(variable, q)) for i, q in enumerate(quantiles)))


def group_quantiles(df: DataFrame, keys: Sequence[str], variable: str, quantiles: Sequence[float]) -> DataFrame:
    """Linearly interpolated quantiles by group, one column each."""
    return weighted_quantiles(df, keys, variable, None, quantiles, c=1.0)


def collapse_multiweight_quantiles(
    df: DataFrame, keys: Sequence[str], weights: dict[str, str], quantiles: Sequence[float]
) -> DataFrame:
    """Weighted quantiles of several variables, each with a weight of its own."""
    out = None
    for x, w in weights.items():
        part = weighted_quantiles(df, keys, x, w, quantiles)
        out = part if out is None else out.join(part, list(keys), "full_outer")
    return out


def lorenz(df: DataFrame, variable: str, weight: str | None = None) -> DataFrame:
    """Cumulative shares of weight (pop) and of weighted value (value) along the distinct values, and the
    shares before each (pop0, value0)."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    grouped = df.where(finite(F.col(variable)) & (w > 1e-12)).groupBy(F.col(variable).cast("double").alias("v")).agg(F.sum(w).alias("w"))
    grouped = grouped.withColumns({"vw": F.col("v") * F.col("w"), "one": F.lit(1).cast("long")})
    made = running_sums(grouped, [], "v", ["w", "vw", "one"])
    pairs = (("pop", "w"), ("value", "vw"))
    return made.select(
        "v",
        (F.col("before_one") + 1).alias("i"),
        F.col("total_one").alias("n"),
        *(((F.col(f"before_{c}") + F.col(c)) / F.col(f"total_{c}")).alias(n) for n, c in pairs),
        *((F.col(f"before_{c}") / F.col(f"total_{c}")).alias(f"{n}0") for n, c in pairs),
    )


def gini_trapezoid(df: DataFrame, variable: str, weight: str | None = None) -> DataFrame:
    """Gini coefficient from the Lorenz curve by trapezoids; the curve begins at its first point."""
    curve = lorenz(df, variable, weight).where("pop0 > 0")
    area = F.sum((F.col("value") + F.col("value0")) / 2 * (F.col("pop") - F.col("pop0")))
    return curve.agg((1 - 2 * area).alias("gini"))


def gini_simpson(df: DataFrame, variable: str, weight: str | None = None) -> DataFrame:
    """Gini coefficient by Simpson's rule for irregular points, the last interval of an even number of
    points corrected from the last three; two points are a trapezoid.

    Every three neighbouring points meet by the number of their pair of intervals, so no task gets the curve.
    """
    i, n = F.col("i"), F.col("n")
    at = F.when(i % 2 == 0, F.array(F.struct((i / 2).cast("long").alias("pair"), F.lit(1).alias("k")))).otherwise(
        F.array(
            F.struct(((i + 1) / 2).cast("long").alias("pair"), F.lit(2).alias("k")),
            F.struct(((i - 1) / 2).cast("long").alias("pair"), F.lit(0).alias("k")),
        )
    )
    tail = F.filter(F.array(F.struct(F.lit(-1).cast("long").alias("pair"), (n - i).cast("int").alias("k"))), lambda x: (n % 2 == 0) & (x["k"] <= 2))
    points = lorenz(df, variable, weight).select("n", "pop", "value", F.explode(F.concat(at, tail)).alias("_x")).select("n", "pop", "value", "_x.*")
    of = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}{k}")
    threes = points.groupBy("pair", "n").agg(*(of(c, k) for c in ("pop", "value") for k in (0, 1, 2)))
    h0, h1 = F.col("pop1") - F.col("pop2"), F.col("pop0") - F.col("pop1")
    three = (h0 + h1) / 6 * (
        (2 - h1 / h0) * F.col("value2") + (h0 + h1) * (h0 + h1) / (h0 * h1) * F.col("value1") + (2 - h0 / h1) * F.col("value0")
    )
    last = (
        (2 * h1 * h1 + 3 * h0 * h1) / (6 * (h0 + h1)) * F.col("value0")
        + (h1 * h1 + 3 * h0 * h1) / (6 * h0) * F.col("value1")
        - h1 * h1 * h1 / (6 * h0 * (h0 + h1)) * F.col("value2")
    )
    area = (
        F.when((F.col("pair") < 0) & (n == 2), (F.col("value0") + F.col("value1")) / 2 * h1)
        .when(F.col("pair") < 0, last)
        .when(F.col("pop0").isNotNull() & F.col("pop1").isNotNull() & F.col("pop2").isNotNull(), three)
        .otherwise(0.0)
    )
    return threes.agg((1 - 2 * F.sum(area)).alias("gini"))


def top_shares(df: DataFrame, variable: str, shares: Sequence[float], weight: str | None = None) -> DataFrame:
    """Share of the total held at or above the quantile that cuts the top p off: (top, share)."""
    rows = df.withColumn("_one", F.lit(1.0))
    w = weight or "_one"
    cut = weighted_quantiles(rows, [], variable, w, [1 - p for p in shares])
    names = cut.columns
    parts = [
        (F.sum(F.when(F.col(variable) >= F.col(n), F.col(variable) * F.col(w))) / F.sum(F.col(variable) * F.col(w))).alias(f"_s{i}")
        for i, n in enumerate(names)
    ]
    sums = rows.where(finite(F.col(variable)) & (F.col(w) > 0)).join(F.broadcast(cut)).agg(*parts)
    pairs = F.array(*(F.struct(F.lit(float(p)).alias("top"), F.col(f"_s{i}").alias("share")) for i, p in enumerate(shares)))
    return sums.select(F.explode(pairs).alias("_p")).select("_p.*")
