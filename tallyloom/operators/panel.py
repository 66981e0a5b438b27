"""Lags, panels, calendars, resampling, filters and trends."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

#: Months in a period of a calendar unit.
MONTHS = {"month": 1, "quarter": 3, "year": 12}


def ordered(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    """Rows of a group in order; a series without keys is one group, as its rows have one order."""
    return Window.partitionBy(*keys).orderBy(*order)


def shifted(x: Column, k: int, window: WindowSpec) -> Column:
    """x of k rows before; of -k rows after if k is negative."""
    return F.lag(x, k).over(window) if k >= 0 else F.lead(x, -k).over(window)


def lag_name(variable: str, k: int) -> str:
    if k == 0:
        raise ValueError("a lag of 0 is the variable itself")
    return f"L{k}_{variable}" if k > 0 else f"F{-k}_{variable}"


def add_lags(df: DataFrame, variable: str, lags: Sequence[int], order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Adds L1_x, L2_x ... (F1_x for leads, negative lags) by rows, within keys."""
    w = ordered(keys, order)
    return df.withColumns({lag_name(variable, k): shifted(F.col(variable), k, w) for k in lags})


def panel_shift(df: DataFrame, keys: Sequence[str], order: Sequence[str], variables: Sequence[str], periods: int = 1) -> DataFrame:
    """Variables of periods rows before in the same group, in place."""
    w = ordered(keys, order)
    return df.withColumns({x: shifted(F.col(x), periods, w) for x in variables})


def transform(
    df: DataFrame,
    variables: Sequence[str],
    order: Sequence[str],
    keys: Sequence[str] = (),
    function: str | None = None,
    diff: int = 0,
    lag: int = 0,
) -> DataFrame:
    """A function, then a difference, then a lag of variables; names such as L_D2_LOG_x tell them.

    A column that is already there is left alone.
    """
    w = ordered(keys, order)
    functions = {"log": F.ln, "exp": F.exp, "sqrt": F.sqrt, "abs": F.abs, "square": lambda c: c * c}
    out = df
    for x in variables:
        name, steps = x, []
        if function:
            name = f"{function.upper()}_{name}"
            steps.append(functions[function])
        if diff:
            name = f"D{diff if diff != 1 else ''}_{name}"
            steps.append(lambda c: c - F.lag(c, diff).over(w))
        if lag:
            name = f"{'L' if lag > 0 else 'F'}{abs(lag) if abs(lag) != 1 else ''}_{name}"
            steps.append(lambda c: shifted(c, lag, w))
        if name in out.columns:
            continue
        current = x
        for i, step in enumerate(steps):
            out = out.withColumn(f"_step{i}", step(F.col(current)))
            current = f"_step{i}"
        out = out.withColumn(name, F.col(current)).drop(*(f"_step{i}" for i in range(len(steps))))
    return out


def period_start(date: Column, unit: str) -> Column:
    return F.date_trunc(unit, date).cast("date")


def spine(df: DataFrame, keys: Sequence[str], date: str, unit: str) -> DataFrame:
    """Every period between the first and the last one of each group."""
    step = F.expr(f"interval {MONTHS[unit]} month") if unit in MONTHS else F.expr(f"interval 1 {unit}")
    ends = df.where(F.col(date).isNotNull()).groupBy(*keys).agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    return ends.select(*keys, F.explode(F.sequence(F.col("_a").cast("date"), F.col("_b").cast("date"), step)).alias(date))


def to_panel(df: DataFrame, keys: Sequence[str], date: str, unit: str) -> DataFrame:
    """df with a row for every period of each group; date must hold period starts, one row each."""
    return spine(df, keys, date, unit).join(df, [*keys, date], "left")


def resample(df: DataFrame, date: str, unit: str, methods: Mapping[str, Sequence[str]], keys: Sequence[str] = ()) -> DataFrame:
    """Periods' aggregates, method to variables: sum, mean, first, last, min, max, count, median.

    Empty periods between the first and the last are there: sums and counts are 0, others missing.
    first and last pass over missing values. Results are named variable_method.
    """
    at = F.col("_at")
    make = {
        "sum": lambda x: F.sum(x),
        "mean": lambda x: F.avg(x),
        "first": lambda x: F.min_by(x, F.when(F.col(x).isNotNull(), at)),
        "last": lambda x: F.max_by(x, F.when(F.col(x).isNotNull(), at)),
        "min": lambda x: F.min(x),
        "max": lambda x: F.max(x),
        "count": lambda x: F.count(x),
        "median": lambda x: F.median(x),
    }
    rows = df.withColumn("_at", F.col(date)).withColumn("_period", period_start(F.col(date), unit))
    names = {f"{x}_{m}": (m, x) for m, xs in methods.items() for x in xs}
    sums = rows.where("_period is not null").groupBy(*keys, "_period").agg(*(make[m](x).alias(n) for n, (m, x) in names.items()))
    full = spine(sums, keys, "_period", unit).join(sums, [*keys, "_period"], "left")
    zeros = {n: 0 for n, (m, _) in names.items() if m in ("sum", "count")}
    return full.fillna(zeros).withColumnRenamed("_period", date)


def calendar_lags(df: DataFrame, variable: str, date: str, lags: Sequence[int], unit: str, keys: Sequence[str] = ()) -> DataFrame:
    """Adds the value of k periods before by the calendar: a gap gives a missing value, not a nearer row.

    date must hold period starts, one row a group and period; lags are joins on moved dates.
    """
    step, out = MONTHS[unit], df
    for k in lags:
        moved = df.select(*keys, F.add_months(date, step * k).cast("date").alias(date), F.col(variable).alias(lag_name(variable, k)))
        out = out.join(moved, [*keys, date], "left")
    return out


def rolling_full(x: Column, k: int, window: WindowSpec) -> Column:
    """Sum of the last k values, missing until there are k."""
    last = window.rowsBetween(-(k - 1), 0)
    return F.when(F.count(x).over(last) == k, F.sum(x).over(last))


def cumulative_product(x: Column, window: WindowSpec) -> Column:
    """Running product of 1 + x, for x above -1."""
    return F.exp(F.sum(F.log1p(x)).over(window.rowsBetween(Window.unboundedPreceding, 0)))


def quarter_start(year: Column, quarter: Column) -> Column:
    return F.make_date(year.cast("int"), (3 * (quarter - 1) + 1).cast("int"), F.lit(1))


def year_start(year: Column) -> Column:
    return F.make_date(year.cast("int"), F.lit(1), F.lit(1))


def month_start(year: Column, month: Column) -> Column:
    """First day of a month; missing where there is no such month."""
    return F.when(month.cast("int").between(1, 12), F.make_date(year.cast("int"), month.cast("int"), F.lit(1)))


def period_starts(spark: SparkSession, start: str, periods: int, unit: str, name: str = "date") -> DataFrame:
    """So many consecutive period starts: from start's own period if it begins there, else from the next."""
    first = F.lit(start).cast("date")
    begin = F.trunc(first, unit)
    begin = F.when(begin < first, F.add_months(begin, MONTHS[unit])).otherwise(begin)
    return spark.range(periods).select(F.add_months(begin, (F.col("id") * MONTHS[unit]).cast("int")).alias(name))


def quarter_of_string(text: Column) -> Column:
    """First day of a quarter such as 2020Q3 or 2020:Q3."""
    return quarter_start(F.substring(text, 1, 4).cast("int"), F.right(text, F.lit(1)).cast("int"))


def positional_dates(df: DataFrame, start: str, unit: str, order: Sequence[str], name: str = "date") -> DataFrame:
    """Adds consecutive period starts in the order of rows, from start; ranges of rows are numbered on their own."""
    from tallyloom.operators.regression import numbered

    date = F.add_months(F.lit(start).cast("date"), F.col("_g").cast("int") * MONTHS[unit]).cast("date")
    return numbered(df, order).withColumn(name, date).drop("_g")


def deflate(df: DataFrame, prices: DataFrame, date: str, variables: Sequence[str], index: str, log: bool = False) -> DataFrame:
    """Adds DEF_x: x over the price index of the same date, or the logarithms' difference."""
    joined = df.join(prices.select(date, F.col(index).alias("_index")), date)
    made = {f"DEF_{x}": F.col(x) - F.ln("_index") if log else F.col(x) / F.col("_index") for x in variables}
    return joined.withColumns(made).drop("_index")


def lead_lag_correlations(df: DataFrame, a: str, b: str, lags: Sequence[int], order: Sequence[str]) -> DataFrame:
    """(lag, corr): correlation of a with b of so many rows before, over the rows that have both."""
    w = ordered((), order)
    rows = df.select(F.col(a).alias("_a"), *(shifted(F.col(b), k, w).alias(f"_b{i}") for i, k in enumerate(lags)))
    sums = rows.agg(*(F.corr("_a", f"_b{i}").alias(f"_c{i}") for i in range(len(lags))))
    pairs = F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"_c{i}").alias("corr")) for i, k in enumerate(lags)))
    return sums.select(F.explode(pairs).alias("_p")).select("_p.*")


def lowpass_weights(upper: float, n: int) -> list[float]:
    """Weights of lags 0 to n of a truncated ideal filter up to an angular frequency, summing to 1."""
    raw = [upper / math.pi] + [math.sin(upper * h) / (math.pi * h) for h in range(1, n + 1)]
    gap = (1.0 - (raw[0] + 2 * sum(raw[1:]))) / (2 * n + 1)
    return [r + gap for r in raw]


def symmetric_filter(x: Column, weights: Sequence[float], window: WindowSpec) -> Column:
    """Weighted sum over rows on both sides; missing where one of them is."""
    out = F.lit(weights[0]) * x
    for h, b in enumerate(weights[1:], 1):
        out = out + F.lit(b) * (F.lag(x, h).over(window) + F.lead(x, h).over(window))
    return out


def lowpass(x: Column, upper: float, n: int, window: WindowSpec) -> Column:
    return symmetric_filter(x, lowpass_weights(upper, n), window)


def bandpass(x: Column, short_period: float, long_period: float, n: int, window: WindowSpec) -> Column:
    """What of x has periods between the two bounds, in rows."""
    high, low = (lowpass_weights(2 * math.pi / p, n) for p in (short_period, long_period))
    return symmetric_filter(x, [a - b for a, b in zip(high, low, strict=True)], window)


def detrend_time(df: DataFrame, variables: Sequence[str], order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Adds x_trend and x_detrend: the line through the row numbers, and what is left of x."""
    group = Window.partitionBy(*keys)
    out = df.withColumn("_t", F.row_number().over(ordered(keys, order)).cast("double"))
    for x in variables:
        slope, level = F.regr_slope(x, "_t").over(group), F.regr_intercept(x, "_t").over(group)
        out = out.withColumn(f"{x}_trend", F.when(F.col(x).isNotNull(), level + slope * F.col("_t")))
        out = out.withColumn(f"{x}_detrend", F.col(x) - F.col(f"{x}_trend"))
    return out.drop("_t")


def rolling_forecast(df: DataFrame, y: str, x: str, order: Sequence[str], least: int) -> DataFrame:
    """Adds forecast: y of a row from the line through all earlier rows, once there are least of them. The rows are
    one series, whose running sums are one task's by nature; a panel's are spread by calling it on each group's aggregates."""
    past = ordered((), order).rowsBetween(Window.unboundedPreceding, -1)
    cx, cy = F.col(x).cast("double"), F.col(y).cast("double")
    n = F.count(F.lit(1)).over(past)
    sx, sy = F.sum(cx).over(past), F.sum(cy).over(past)
    slope = F.try_divide(n * F.sum(cx * cy).over(past) - sx * sy, n * F.sum(cx * cx).over(past) - sx * sx)
    return df.withColumn("_slope", slope).withColumn("_level", (sy - F.col("_slope") * sx) / n).withColumn(
        "forecast", F.when(n >= least, F.col("_level") + F.col("_slope") * cx)
    ).drop("_slope", "_level")


def fit_ar1(df: DataFrame, x: str, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(level, rho, n) of the regression of x on its row before, by group."""
    rows = df.withColumn("_before", F.lag(x).over(ordered(keys, order))).where(F.col(x).isNotNull() & F.col("_before").isNotNull())
    return rows.groupBy(*keys).agg(
        F.regr_intercept(x, "_before").alias("level"), F.regr_slope(x, "_before").alias("rho"), F.count(F.lit(1)).alias("n")
    )


def interpolate_linear(df: DataFrame, variable: str, date: str, keys: Sequence[str]) -> DataFrame:
    """Adds x_filled: missing values on the line between their neighbours; those after the last value
    repeat it, those before the first stay missing."""
    before = ordered(keys, [date]).rowsBetween(Window.unboundedPreceding, 0)
    after = ordered(keys, [date]).rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(variable).isNotNull(), F.struct(F.col(date).alias("d"), F.col(variable).alias("v")))
    out = df.withColumn("_lo", F.last(known, True).over(before)).withColumn("_hi", F.first(known, True).over(after))
    share = F.datediff(F.col(date), F.col("_lo.d")) / F.datediff(F.col("_hi.d"), F.col("_lo.d"))
    value = (
        F.when(F.col(variable).isNotNull(), F.col(variable))
        .when(F.col("_hi").isNull(), F.col("_lo.v"))
        .otherwise(F.col("_lo.v") + share * (F.col("_hi.v") - F.col("_lo.v")))
    )
    return out.withColumn(f"{variable}_filled", value).drop("_lo", "_hi")


def allocate_to_months(df: DataFrame, date: str, value: str) -> DataFrame:
    """(month, total): values given to their month by the share of it that is left on their date, the
    rest to the next one; every month between the first and the last is there."""
    day, length = F.dayofmonth(date), F.dayofmonth(F.last_day(date))
    here = F.col(value) * (length - day + 1) / length
    rows = df.select(period_start(F.col(date), "month").alias("month"), here.alias("_here"), (F.col(value) - here).alias("_next"))
    sums = rows.groupBy("month").agg(F.sum("_here").alias("_here"), F.sum("_next").alias("_next"))
    full = spine(sums, (), "month", "month").join(sums, "month", "left").fillna(0.0, ["_here", "_next"])
    return full.select("month", (F.col("_here") + F.coalesce(F.lag("_next").over(Window.orderBy("month")), F.lit(0.0))).alias("total"))
