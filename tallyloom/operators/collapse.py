"""Weighted collapse of microdata to groups, with partials that can be collapsed again."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def present(keys: Sequence[str]) -> Column:
    """Rows whose group keys are all there; groups of a missing key do not exist."""
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.lit(True))


@dataclass(frozen=True)
class Collapser:
    """Numerators and denominators of weighted means by group.

    frame has, beside the keys, x_num and x_denom of every variable: sums over rows, so partials of
    parts of the data add up, and coarser groups follow from finer ones without the data.
    """

    frame: DataFrame
    variables: tuple[str, ...]
    keys: tuple[str, ...]
    weight: str | None = None

    @classmethod
    def of(cls, df: DataFrame, variables: Sequence[str], keys: Sequence[str], weight: str | None = None) -> Collapser:
        """A variable's denominator is the weight of the rows where that variable is there."""
        w = F.col(weight) if weight else F.lit(1.0)
        parts = []
        for x in variables:
            parts.append(F.coalesce(F.sum(F.col(x) * w), F.lit(0.0)).alias(f"{x}_num"))
            parts.append(F.coalesce(F.sum(F.when(F.col(x).isNotNull(), w)), F.lit(0.0)).alias(f"{x}_denom"))
        return cls(df.where(present(keys)).groupBy(*keys).agg(*parts), tuple(variables), tuple(keys), weight)

    def _add_up(self, frame: DataFrame, keys: Sequence[str]) -> Collapser:
        names = [f"{x}_{part}" for x in self.variables for part in ("num", "denom")]
        summed = frame.where(present(keys)).groupBy(*keys).agg(*(F.sum(n).alias(n) for n in names))
        return Collapser(summed, self.variables, tuple(keys), self.weight)

    def collapse(self, keys: Sequence[str]) -> Collapser:
        """To coarser groups."""
        if unknown := set(keys) - set(self.keys):
            raise ValueError(f"not among the keys: {sorted(unknown)}")
        return self._add_up(self.frame, keys)

    def resample(self, date: str, unit: str) -> Collapser:
        """To calendar periods of a date key, named by their first day."""
        return self._add_up(self.frame.withColumn(date, F.date_trunc(unit, F.col(date)).cast("date")), self.keys)

    def rollup(self, keys: Sequence[str] | None = None, cube: bool = False) -> DataFrame:
        """Means of all prefixes (or, as a cube, all subsets) of the keys; the keys summed over are null."""
        keys = list(keys or self.keys)
        grouped = self.frame.cube(*keys) if cube else self.frame.rollup(*keys)
        return grouped.agg(*(F.try_divide(F.sum(f"{x}_num"), F.sum(f"{x}_denom")).alias(x) for x in self.variables))

    def means(self, with_denominators: bool = False) -> DataFrame:
        columns = [F.try_divide(F.col(f"{x}_num"), F.col(f"{x}_denom")).alias(x) for x in self.variables]
        if with_denominators:
            columns += [F.col(f"{x}_denom") for x in self.variables]
        return self.frame.select(*self.keys, *columns)

    def sums(self) -> DataFrame:
        return self.frame.select(*self.keys, *(F.col(f"{x}_num").alias(x) for x in self.variables))

    def save(self, path: str) -> None:
        self.frame.write.mode("overwrite").parquet(path)

    def loaded(self, path: str) -> Collapser:
        """The same kind of partials from a path."""
        return Collapser(self.frame.sparkSession.read.parquet(path), self.variables, self.keys, self.weight)


def concat(parts: Sequence[Collapser]) -> Collapser:
    """Partials of parts of the data as those of all of it; all must be of one kind."""
    first = parts[0]
    for p in parts[1:]:
        if (p.variables, p.keys, p.weight) != (first.variables, first.keys, first.weight):
            raise ValueError("collapsers differ in variables, keys or weight")
    return first._add_up(reduce(lambda a, b: a.unionByName(b), [p.frame for p in parts]), first.keys)


def collapse(df: DataFrame, keys: Sequence[str], variables: Sequence[str], weight: str | None = None, as_sum: bool = False) -> DataFrame:
    """Weighted means, or sums, by group; a missing value takes no part in its own variable alone."""
    made = Collapser.of(df, variables, keys, weight)
    return made.sums() if as_sum else made.means()


def collapse_all_weights(df: DataFrame, keys: Sequence[str], variables: Sequence[str], weight: str) -> DataFrame:
    """Weighted means whose denominator has the weight of all rows, those of a missing value included."""
    w = F.col(weight)
    means = [F.try_divide(F.coalesce(F.sum(F.col(x) * w), F.lit(0.0)), F.sum(w)).alias(x) for x in variables]
    return df.where(present(keys)).groupBy(*keys).agg(*means)


def collapse_multiweight(df: DataFrame, keys: Sequence[str], weights: dict[str, str]) -> DataFrame:
    """Weighted means, each variable with a weight of its own, in one aggregation."""
    means = [
        F.try_divide(F.sum(F.col(x) * F.col(w)), F.sum(F.when(F.col(x).isNotNull(), F.col(w)))).alias(x) for x, w in weights.items()
    ]
    return df.where(present(keys)).groupBy(*keys).agg(*means)


def weighted_moments(df: DataFrame, keys: Sequence[str], variable: str, weight: str) -> DataFrame:
    """Weighted mean, population variance and standard deviation by group.

    The variance is about the mean, which a first aggregation finds, so it doesn't lose digits.
    """
    x, w = F.col(variable), F.col(weight)
    means = df.where(present(keys) & x.isNotNull()).groupBy(*keys).agg(F.try_divide(F.sum(x * w), F.sum(w)).alias("mean"))
    spread = (
        df.where(x.isNotNull())
        .join(means, list(keys))
        .groupBy(*keys, "mean")
        .agg(F.try_divide(F.sum(w * (x - F.col("mean")) * (x - F.col("mean"))), F.sum(w)).alias("var"))
    )
    return spread.withColumn("std", F.sqrt("var"))


def safe_sum(column: str) -> Column:
    """A sum that is null as soon as one value is."""
    return F.when(F.count(F.col(column)) == F.count(F.lit(1)), F.sum(column))
