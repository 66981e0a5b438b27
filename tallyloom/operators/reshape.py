"""Wide and long forms, indicators and unions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_long(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "series", value: str = "value", keep_missing: bool = False) -> DataFrame:
    out = df.unpivot(list(keys), list(columns), name, value)
    return out if keep_missing else out.where(F.col(value).isNotNull())


def to_wide(df: DataFrame, keys: Sequence[str], name: str, value: str, series: Sequence[str]) -> DataFrame:
    """A column for each of series; the smallest value where a series has several."""
    return df.groupBy(*keys).pivot(name, list(series)).agg(F.min(value))


def one_hot(df: DataFrame, column: str, levels: Sequence[str]) -> DataFrame:
    """Adds column_level of 0 and 1 for every level."""
    return df.withColumns({f"{column}_{v}".replace("#", "").replace(" ", "_"): F.coalesce((F.col(column) == v).cast("int"), F.lit(0)) for v in levels})


def union_schemas(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all frames under all their columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def splice(old: DataFrame, new: DataFrame, date: str, cutoff: Column) -> DataFrame:
    """old before the cutoff, new from it on."""
    return old.where(F.col(date) < cutoff).unionByName(new.where(F.col(date) >= cutoff))


def bounded(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df to be sent to all tasks, if it has at most so many rows."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"a grid that is sent to all tasks has more than {most} rows")
    return F.broadcast(df)


def combine_grids(a: DataFrame, b: DataFrame) -> DataFrame:
    """Every point of one grid with every point of another, whose size is checked."""
    return a.join(bounded(b))


def combine_rows(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The products of all pairs of a row of a and a row of b, column by column, in the rows that share keys."""
    left, right = ([c for c in x.columns if c not in keys] for x in (a, b))
    joined = a.alias("a").join(b.alias("b"), list(keys))
    return joined.select(*keys, *((F.col(f"a.{x}") * F.col(f"b.{y}")).alias(f"{x}_{y}") for x in left for y in right))


def combine_markov_chains(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j, p) of two independent chains as one over pairs: (i, k, j, l, p)."""
    b = b.select(F.col("i").alias("k"), F.col("j").alias("l"), F.col("p").alias("_q"))
    return a.join(bounded(b)).select("i", "k", "j", "l", (F.col("p") * F.col("_q")).alias("p"))


def drop_low_probabilities(chain: DataFrame, least: float = 1e-6) -> DataFrame:
    """(i, j, p) without the steps of smaller probability, the others of a state adding up to one again."""
    kept = chain.where(F.col("p") >= least)
    whole = kept.groupBy("i").agg(F.sum("p").alias("_whole"))
    return kept.join(whole, "i").select("i", "j", (F.col("p") / F.col("_whole")).alias("p"))
