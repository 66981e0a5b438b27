"""From loan contracts and firms' reports to distances from limits: binding limits, flows by quarter, violations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators.joins import keep_groups, ratio

#: What stands where a ratio's denominator is zero. Fixed value.
NO_RATIO = 666.0


def binding(kind: Column, limit: Column) -> Column:
    """Aggregate of limits of one kind: the smallest of those called Min..., the largest of Max..., else the mean."""
    name = F.first(kind)
    return F.when(name.startswith("Min"), F.min(limit)).when(name.startswith("Max"), F.max(limit)).otherwise(F.avg(limit))


def package_limits(contracts: DataFrame, package: str = "package", kind: str = "kind", value: str = "value") -> DataFrame:
    """(package, kind, limit, n): a package's binding limit of each kind and how many it has."""
    return contracts.groupBy(package, kind).agg(binding(F.col(kind), F.col(value).cast("double")).alias("limit"), F.count(F.lit(1)).alias("n"))


def package_spans(facilities: DataFrame, package: str = "package", start: str = "start", end: str = "end") -> DataFrame:
    """(package, start, end): from the first start to the last end of a package's facilities; those without either go."""
    return facilities.groupBy(package).agg(F.min(start).alias("start"), F.max(end).alias("end")).dropna(subset=["start", "end"])


def active_limits(reports: DataFrame, limits: DataFrame, company: str = "company", date: str = "date") -> DataFrame:
    """(company, date, kind, limit, n) on the dates of reports: the binding limit of the contracts active
    then, and their number (missing, and 0, where none is). limits: company, kind, limit, n, start, end.

    Dates and limits of a company meet once; what is active is a condition inside the sums, so every
    date on which the company has a limit of that kind at any time keeps its row.
    """
    dates = reports.select(company, date).distinct()
    met = dates.join(limits.select(company, "kind", "limit", "n", "start", "end"), company)
    holds = F.col(date).between(F.col("start"), F.col("end"))
    return met.groupBy(company, date, "kind").agg(
        binding(F.col("kind"), F.when(holds, F.col("limit"))).alias("limit"), F.sum(F.when(holds, F.col("n")).otherwise(0)).alias("n")
    )


def quarterly_flows(df: DataFrame, keys: Sequence[str], year: str, quarter: str, values: Sequence[str]) -> DataFrame:
    """Values that run from the year's start as flows of single quarters, in place; a quarter whose
    predecessor in the year is not there is missing."""
    w = Window.partitionBy(*keys, year).orderBy(quarter)
    before = F.lag(quarter).over(w) == F.col(quarter) - 1
    return df.withColumns({v: F.when(F.col(quarter) == 1, F.col(v)).when(before, F.col(v) - F.lag(v).over(w)) for v in values})


def annualised(df: DataFrame, values: Sequence[str]) -> DataFrame:
    """Adds <v>_ann, four times a quarter's flow."""
    return df.withColumns({f"{v}_ann": 4 * F.col(v) for v in values})


def filled_between(df: DataFrame, keys: Sequence[str], order: str, values: Sequence[str]) -> DataFrame:
    """Missing values on straight lines over the rows between known ones, in place; the last known one
    goes on, and nothing is filled before the first."""
    w = Window.partitionBy(*keys).orderBy(order)
    rows = df.withColumn("_at", F.row_number().over(w))
    made = {}
    for v in values:
        known = F.when(F.col(v).isNotNull(), F.struct(F.col("_at").alias("at"), F.col(v).cast("double").alias("v")))
        low = F.last(known, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
        high = F.first(known, True).over(w.rowsBetween(0, Window.unboundedFollowing))
        line = low["v"] + F.coalesce(F.try_divide((high["v"] - low["v"]) * (F.col("_at") - low["at"]), high["at"] - low["at"]), F.lit(0.0))
        made[v] = F.when(low.isNotNull(), line)
    return rows.withColumns(made).drop("_at")


def distance(kind: Column, value: Column, limit: Column) -> Column:
    """How far a value is inside a limit, negative where it violates it; missing for kinds with no side."""
    return F.when(kind.startswith("Min"), value - limit).when(kind.startswith("Max"), limit - value)


def headroom(kind: Column, value: Column, limit: Column) -> Column:
    """A value over its minimum, or its maximum over a value."""
    return F.when(kind.startswith("Min."), ratio(value, limit, NO_RATIO)).otherwise(ratio(limit, value, NO_RATIO))


def covenant_distances(
    reports: DataFrame,
    contracts: DataFrame,
    facilities: DataFrame,
    links: DataFrame,
    measures: Mapping[str, Column],
    company: str = "company",
    date: str = "date",
) -> DataFrame:
    """(company, date, kind, limit, n, value, distance, sound) for every report date and kind of limit of a company.

    reports: company, date and what the measures are made of; contracts: package, kind, value;
    facilities: package, start, end; links: package, company. measures: kind of limit to its value in
    a report. value, and so distance, is missing for kinds without a measure. sound: no headroom of
    the company's is ever negative. Dates without any active limit stay, without a limit.
    """
    spans = package_limits(contracts).join(package_spans(facilities), "package").join(links.select("package", company).distinct(), "package")
    measured = reports.select(company, date, F.map_from_arrays(F.array(*(F.lit(k) for k in measures)), F.array(*(m.cast("double") for m in measures.values()))).alias("_m"))
    rows = active_limits(reports, spans, company, date).join(measured, [company, date])
    value = F.try_element_at("_m", F.col("kind"))
    rows = rows.withColumn("value", value).drop("_m").withColumn("distance", distance(F.col("kind"), F.col("value"), F.col("limit")))
    bad = rows.groupBy(company).agg(F.coalesce(F.min(headroom(F.col("kind"), F.col("value"), F.col("limit"))) < 0, F.lit(False)).alias("_bad"))
    return rows.join(bad, company).withColumn("sound", ~F.col("_bad")).drop("_bad")


def sound_companies(distances: DataFrame, company: str = "company") -> DataFrame:
    """The rows of companies that are sound."""
    return keep_groups(distances, [company], F.col("sound"))
