"""Least squares from aggregated moments, fixed effects, robust covariances, projections."""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.operators.panel import add_lags, ordered, shifted
from tallyloom.operators.quantiles import finite

#: Rows up to which one task may hold a window over all of them.
WINDOW_ROWS = 100_000
#: Rows of a group up to which they may all be dealt to one task.
GROUP_ROWS = 100_000
#: Levels of a dummy that are taken into a design at most; beyond, absorb the effect.
MAX_LEVELS = 500


@dataclass
class Formula:
    """y ~ a + b + a:b + log(a) + C(g) - 1: names, products, functions of names and dummies."""

    y: str
    terms: tuple[str, ...]
    effects: tuple[str, ...]
    intercept: bool

    @classmethod
    def parse(cls, text: str) -> Formula:
        y, _, right = text.partition("~")
        if not y.strip() or not right.strip():
            raise ValueError(f"not a formula: {text!r}")
        terms, effects, intercept = [], [], True
        for sign, term in re.findall(r"([+-]?)\s*([^+\-]+)", right):
            term = term.strip()
            if sign == "-":
                if term != "1":
                    raise ValueError("only the intercept can be taken out")
                intercept = False
            elif m := re.fullmatch(r"C\((\w+)\)", term):
                effects.append(m[1])
            elif term == "0":
                intercept = False
            elif term != "1":
                terms.append(term)
        return cls(y.strip(), tuple(terms), tuple(effects), intercept)


def formula_of(y: str, terms: Sequence[str], effects: Sequence[str] = (), intercept: bool = True, more: str = "") -> str:
    """The formula of a left side, terms, dummies of effects and what else is to be added."""
    right = [*terms, *(f"C({g})" for g in effects), *([more] if more else [])]
    if not right and not intercept:
        raise ValueError("a formula without a right side")
    return f"{y} ~ {' + '.join(right or ['1'])}" + ("" if intercept else " - 1")


def lag_terms(variable: str, lags: int) -> list[str]:
    """The names of lags 1 to lags of a variable."""
    return [f"L{i}_{variable}" for i in range(1, lags + 1)]


def projection_formula(horizon: int, y: str, shock: str, shock_lags: int = 2, y_lags: int = 1, controls: Mapping[str, int] | Sequence[str] = (), effects: Sequence[str] = ()) -> str:
    """A local projection's formula: y so many rows ahead on the shock, its lags, lags of y and of controls
    (one each, or as many as said)."""
    own = controls if isinstance(controls, Mapping) else dict.fromkeys(controls, 1)
    right = [shock, *lag_terms(shock, shock_lags), *lag_terms(y, y_lags), *(t for c, n in own.items() for t in lag_terms(c, n))]
    return formula_of(f"F{horizon}_{y}" if horizon else y, right, effects)


def term_column(term: str) -> Column:
    """A term's values: a name, a product a:b, or log, exp, sqrt, abs, square of one."""
    if ":" in term:
        out = F.lit(1.0)
        for part in term.split(":"):
            out = out * term_column(part.strip())
        return out
    if m := re.fullmatch(r"(log|exp|sqrt|abs|square)\((.+)\)", term):
        inner = term_column(m[2])
        return {"log": F.ln, "exp": F.exp, "sqrt": F.sqrt, "abs": F.abs, "square": lambda c: c * c}[m[1]](inner)
    return F.col(term).cast("double")


@dataclass
class Fit:
    """Coefficients and covariance of a regression, and the design they came from."""

    terms: list[str]
    coef: np.ndarray
    cov: np.ndarray
    n: int
    r2: float
    sigma2: float
    design: DataFrame = field(repr=False)

    @property
    def se(self) -> np.ndarray:
        return np.sqrt(np.clip(np.diag(self.cov), 0, None))

    def rows(self) -> list[tuple[str, float, float, float | None, float | None]]:
        """(term, coef, se, t, p), p from the normal distribution."""
        rows = []
        for name, b, s in zip(self.terms, self.coef.tolist(), self.se.tolist(), strict=True):
            t = b / s if s else None
            rows.append((name, b, s, t, math.erfc(abs(t) / math.sqrt(2)) if t is not None else None))
        return rows

    def table(self) -> DataFrame:
        """rows() as a table."""
        rows = self.rows()
        return self.design.sparkSession.createDataFrame(rows, "term string, coef double, se double, t double, p double")

    def combination(self, weights: Mapping[str, float]) -> tuple[float, float]:
        """A weighted sum of coefficients and its standard error."""
        a = np.array([weights.get(t, 0.0) for t in self.terms])
        return float(a @ self.coef), float(np.sqrt(a @ self.cov @ a))


def prediction(k: int, coef: Sequence[float]) -> Column:
    out = F.lit(0.0)
    for i in range(k):
        out = out + F.lit(float(coef[i])) * F.col(f"_x{i}")
    return out


def moments(design: DataFrame, k: int, weight: Column) -> tuple[np.ndarray, np.ndarray, float, float, float, int]:
    """X'WX, X'Wy, y'Wy, the weighted sum of y, the weight and the rows, in one aggregation."""
    sums = [F.sum(weight * F.col(f"_x{i}") * F.col(f"_x{j}")) for i in range(k) for j in range(i, k)]
    sums += [F.sum(weight * F.col(f"_x{i}") * F.col("_y")) for i in range(k)]
    sums += [F.sum(weight * F.col("_y") * F.col("_y")), F.sum(weight * F.col("_y")), F.sum(weight), F.count(F.lit(1))]
    row = list(design.agg(*(s.alias(f"_m{i}") for i, s in enumerate(sums))).first())
    if not row[-1]:
        raise ValueError("no complete rows")
    xx, at = np.zeros((k, k)), 0
    for i in range(k):
        for j in range(i, k):
            xx[i, j] = xx[j, i] = row[at]
            at += 1
    return xx, np.array(row[at : at + k]), row[-4], row[-3], row[-2], row[-1]


def symmetric_sum(df: DataFrame, k: int, value: Column) -> np.ndarray:
    """Sum over rows of x x' times value."""
    sums = [F.sum(value * F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"_m{i}_{j}") for i in range(k) for j in range(i, k)]
    row, out, at = df.agg(*sums).first(), np.zeros((k, k)), 0
    for i in range(k):
        for j in range(i, k):
            out[i, j] = out[j, i] = row[at]
            at += 1
    return out


def numbered(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Adds _g, the place of each row from 0 in order: ranges of rows are numbered on their own, and only
    the ranges' sizes are added up."""
    from tallyloom.plans.session import checkpointed

    made = checkpointed(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = made.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    sizes = sizes.select("_range", (F.sum("_size").over(before) - F.col("_size")).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return made.withColumn("_place", place).join(F.broadcast(sizes), "_range").withColumn("_g", F.col("_before") + F.col("_place")).drop("_range", "_place", "_before")


def lagged_scores(scored: DataFrame, order: Sequence[str], k: int, lags: int, n: int) -> DataFrame:
    """_u<i>, and _l<i>_<j>, the same j rows before in order.

    Up to WINDOW_ROWS rows are one task's. More are cut into runs of so many, and the last rows of a run
    also go before the next one.
    """
    one_before = lambda along: [F.lag(f"_u{i}", j).over(along).alias(f"_l{i}_{j}") for i in range(k) for j in range(1, lags + 1)]
    names = [f"_u{i}" for i in range(k)]
    if n <= WINDOW_ROWS:
        return scored.select(*names, *one_before(Window.orderBy(*order)))
    size = max(WINDOW_ROWS, lags)
    run = F.expr(f"_g div {size}")
    also = F.when(F.col("_g") % size >= size - lags, F.array(run, run + 1)).otherwise(F.array(run))
    rows = numbered(scored, order).withColumn("_own", run).withColumn("_run", F.explode(also))
    lagged = rows.select((F.col("_own") == F.col("_run")).alias("_is"), *names, *one_before(Window.partitionBy("_run").orderBy("_g")))
    return lagged.where("_is").drop("_is")


def design_columns(rows: DataFrame, made: Formula, absorbed: bool = False, trend: int = 0) -> dict[str, Column]:
    """The right-hand side's columns by name; dummies of an effect leave its first level out beside an intercept."""
    names = [*(["Intercept"] if made.intercept and not absorbed else []), *made.terms, *(["t", "t2"][:trend])]
    columns = {n: F.lit(1.0) if n == "Intercept" else F.col("t") * F.col("t") if n == "t2" and trend > 1 else term_column(n) for n in names}
    for g in made.effects:
        levels = [r[0] for r in rows.where(F.col(g).isNotNull()).select(g).distinct().orderBy(g).limit(MAX_LEVELS + 1).collect()]
        if len(levels) > MAX_LEVELS:
            raise ValueError(f"{g} has more than {MAX_LEVELS} levels; absorb it")
        for v in levels[1 if made.intercept or absorbed else 0 :]:
            columns[f"C({g})[{v}]"] = (F.col(g) == F.lit(v)).cast("double")
    return columns


def regression(
    df: DataFrame,
    formula: str,
    weight: str | None = None,
    cov_type: str = "HC3",
    cluster: str | None = None,
    hac_lags: int = 0,
    order: Sequence[str] = (),
    absorb: Sequence[str] = (),
    trend: int = 0,
) -> Fit:
    """Least squares of a formula over its complete rows.

    Moments are summed in one pass and solved on the driver, whatever the number of rows. Weights
    are normalised to sum to 1. Covariances: cluster, else Bartlett over hac_lags rows in order, else
    HC0, HC1, HC2, HC3 or 'nonrobust'. absorb takes effects out of every column first; trend adds
    powers of the row number in order.
    """
    if cluster and hac_lags:
        raise ValueError("a cluster and a lag covariance exclude each other")
    made = Formula.parse(formula)
    rows = df
    if trend:
        rows = numbered(rows, order).withColumn("t", (F.col("_g") + 1).cast("double")).drop("_g")
    columns = design_columns(rows, made, bool(absorb), trend)
    names, k = list(columns), len(columns)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    extra = [F.col(c).alias(f"_k{i}") for i, c in enumerate([*order, *([cluster] if cluster else []), *absorb])]
    design = rows.select(
        term_column(made.y).alias("_y"), *(c.alias(f"_x{i}") for i, c in enumerate(columns.values())), w.alias("_w"), *extra
    )
    for c in ["_y", "_w", *(f"_x{i}" for i in range(k))]:
        design = design.where(finite(F.col(c)))
    design = design.where(F.col("_w") > 0)
    if absorb:
        effects = [f"_k{len(order) + bool(cluster) + i}" for i in range(len(absorb))]
        design = absorb_effects(design, ["_y", *(f"_x{i}" for i in range(k))], effects, "_w")
    xx, xy, yy, sy, sw, n = moments(design, k, F.col("_w"))
    coef = np.linalg.solve(xx, xy)
    total_w = sw
    inverse = np.linalg.inv(xx / total_w)
    share = F.col("_w") / F.lit(total_w)
    rss = float(yy - 2 * coef @ xy + coef @ xx @ coef) / total_w
    tss = (yy - sy * sy / sw) / total_w if made.intercept else yy / total_w
    design = design.withColumn("_e", F.col("_y") - prediction(k, coef)).withColumn("_s", share)
    score = F.col("_s") * F.col("_e")
    sigma2 = rss / max(n - k, 1)
    if cluster:
        key = f"_k{len(order)}"
        parts = design.groupBy(key).agg(*(F.sum(score * F.col(f"_x{i}")).alias(f"_x{i}") for i in range(k)))
        groups = parts.count()
        meat = symmetric_sum(parts, k, F.lit(1.0)) * groups / (groups - 1) * (n - 1) / (n - k)
    elif hac_lags:
        meat = symmetric_sum(design, k, score * score)
        keys = [f"_k{i}" for i in range(len(order))]
        scored = design.select(*keys, *((score * F.col(f"_x{i}")).alias(f"_u{i}") for i in range(k)))
        lagged = lagged_scores(scored, keys, k, hac_lags, n)
        sums = lagged.agg(*(F.coalesce(F.sum(F.col(f"_u{a}") * F.col(f"_l{b}_{j}")), F.lit(0.0)).alias(f"_m{j}_{a}_{b}") for j in range(1, hac_lags + 1) for a in range(k) for b in range(k))).first()
        values = np.array(list(sums)).reshape(hac_lags, k, k)
        for j in range(1, hac_lags + 1):
            meat = meat + (1 - j / (hac_lags + 1)) * (values[j - 1] + values[j - 1].T)
    elif cov_type == "nonrobust":
        meat = (xx / total_w) * sigma2
    else:
        square = score * score
        if cov_type in ("HC2", "HC3"):
            h = F.lit(0.0)
            for i in range(k):
                for j in range(k):
                    h = h + F.lit(float(inverse[i, j])) * F.col(f"_x{i}") * F.col(f"_x{j}")
            keep = 1 - F.col("_s") * h
            square = square / (keep if cov_type == "HC2" else keep * keep)
        elif cov_type not in ("HC0", "HC1"):
            raise ValueError(f"unknown covariance {cov_type}")
        meat = symmetric_sum(design, k, square) * (n / (n - k) if cov_type == "HC1" else 1)
    return Fit(names, coef, inverse @ meat @ inverse, n, 1 - rss / tss if tss else float("nan"), sigma2, design)


def beside_groups(df: DataFrame, groups: DataFrame, keys: Sequence[str], size: str) -> DataFrame:
    """Rows beside their group's columns, null where there is no group. groups has one row a group, with its
    number of rows in size. Groups of more than GROUP_ROWS rows, of which there is at most one in so many
    rows, are broadcast; their rows and those without a key are dealt by where they are, not by key."""
    values = [c for c in groups.columns if c not in keys]
    large = F.col(size) > GROUP_ROWS
    # both joins keep all columns of groups, so that groups are summed once
    rows = df.join(F.broadcast(groups.where(large)), list(keys), "left")
    apart = F.col(size).isNotNull()
    for k in keys:
        apart |= F.col(k).isNull()
    rows = rows.withColumn("_deal", F.when(apart, F.spark_partition_id() + 1).otherwise(0))
    others = groups.select(*keys, *(F.col(c).alias(f"_o_{c}") for c in values), F.when(large, -1).otherwise(0).alias("_deal"))
    made = rows.join(others, [*keys, "_deal"], "left")
    return made.select(*df.columns, *(F.coalesce(c, f"_o_{c}").alias(c) for c in values))


def demean(df: DataFrame, variables: Sequence[str], keys: Sequence[str], weight: str | None = None, prefix: str = "") -> DataFrame:
    """Variables less their group's mean; rows without a group go. A weighted mean's weight is that of
    all rows of the group. Means are summed before the exchange and put beside the rows, so a group of very
    many rows is no single task's."""
    made = {"_size": F.count(F.lit(1))}
    for i, x in enumerate(variables):
        made[f"_m{i}"] = F.avg(x) if weight is None else F.try_divide(F.sum(F.col(x) * F.col(weight)), F.sum(weight))
    rows = df.dropna(subset=list(keys))
    means = rows.groupBy(*keys).agg(*(m.alias(n) for n, m in made.items()))
    out = beside_groups(rows, means, keys, "_size").withColumns({prefix + x: F.col(x) - F.col(f"_m{i}") for i, x in enumerate(variables)})
    return out.select(*dict.fromkeys([*df.columns, *(prefix + x for x in variables)]))


def demean_separate(df: DataFrame, variables: Sequence[str], groups: Sequence[str]) -> DataFrame:
    """One pass of demeaning by each group in turn."""
    for g in groups:
        df = demean(df, variables, [g])
    return df


def absorb_effects(
    df: DataFrame,
    variables: Sequence[str],
    groups: Sequence[str],
    weight: str | None = None,
    restore_mean: bool = False,
    tolerance: float = 1e-10,
    sweeps: int = 1000,
) -> DataFrame:
    """Variables with the means of one or several groupings taken out, in place.

    Rows are summed to the cells of all groupings once, and effects are found on cells: one grouping's
    are its means; several groupings' means are taken out in turn until the largest that a sweep
    takes out, over the variable's spread, is at most tolerance; one that is larger after all sweeps
    is an error. Rows meet their cell's effects once, in the end. Rows with a missing value, weight or
    group, or weight 0, are left out of the means and come back missing. Sweeps are checkpointed, so
    that neither the plan nor a lost executor's work grows.
    """
    from tallyloom.plans.session import checkpointed

    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    used = finite(w) & (w > 0)
    for c in variables:
        used &= finite(F.col(c).cast("double"))
    for g in groups:
        used &= F.col(g).isNotNull()
    value = {c: F.col(c).cast("double") for c in variables}
    sums = [F.sum(w).alias("_aw"), F.count(F.lit(1)).alias("_n")]
    for c, v in value.items():
        sums += [F.sum(w * v).alias(f"_r_{c}"), F.sum(v).alias(f"_s_{c}"), F.sum(v * v).alias(f"_q_{c}")]
    cells = checkpointed(df.where(used).groupBy(*groups).agg(*sums))
    total = [F.sum("_aw").alias("w"), F.sum("_n").alias("n")]
    total += [F.sum(f"_{k}_{c}").alias(f"{k}_{c}") for c in variables for k in "rsq"]
    whole = cells.agg(*total).first()
    spread = {c: math.sqrt(max(0.0, whole[f"q_{c}"] / whole["n"] - (whole[f"s_{c}"] / whole["n"]) ** 2)) or 1.0 for c in variables} if whole["n"] else {}
    cells = cells.select(*groups, "_aw", *(f"_r_{c}" for c in variables), *(F.lit(0.0).alias(f"_f_{c}") for c in variables))

    for _ in range(sweeps if spread else 0):
        cells = cells.withColumns({f"_d_{c}": F.lit(0.0) for c in variables})
        for g in groups:
            means = cells.groupBy(g).agg(*((F.sum(f"_r_{c}") / F.sum("_aw")).alias(f"_m_{c}") for c in variables))
            cells = cells.join(means, g).withColumns(
                {f"_r_{c}": F.col(f"_r_{c}") - F.col("_aw") * F.col(f"_m_{c}") for c in variables}
                | {f"_f_{c}": F.col(f"_f_{c}") + F.col(f"_m_{c}") for c in variables}
                | {f"_d_{c}": F.greatest(F.col(f"_d_{c}"), F.abs(f"_m_{c}")) for c in variables}
            ).drop(*(f"_m_{c}" for c in variables))
        if len(groups) == 1:
            break
        cells = checkpointed(cells)
        most = cells.agg(*(F.max(f"_d_{c}") for c in variables)).first()
        taken = max((m or 0.0) / spread[c] for m, c in zip(most, variables, strict=True))
        if taken <= tolerance:
            break
    else:
        if spread:
            raise ArithmeticError(f"group means of {taken:.3g} spreads are left after {sweeps} sweeps")
    effects = cells.select(*groups, *(f"_f_{c}" for c in variables))
    mean = {c: whole[f"r_{c}"] / whole["w"] if restore_mean and whole["n"] else 0.0 for c in variables}
    made = {c: F.when(used, value[c] - F.col(f"_f_{c}") + F.lit(mean[c])) for c in variables}
    # one select, as a variable may be a weight or a part of what is used
    return df.join(effects, list(groups), "left").select(*(made[c].alias(c) if c in made else F.col(c) for c in df.columns))


def drop_singletons(df: DataFrame, groups: Sequence[str], until_none: bool = False) -> DataFrame:
    """Without the rows that are alone in a group; one pass a grouping, or until none is left."""
    while True:
        for g in groups:
            df = df.join(df.groupBy(g).count().where("count > 1").drop("count"), g, "left_semi")
        if not until_none:
            return df
        alone = [df.groupBy(g).count().where("count = 1").limit(1).count() for g in groups]
        if not any(alone):
            return df


def hdfe(df: DataFrame, y: str, xs: Sequence[str], groups: Sequence[str], weight: str | None = None) -> Fit:
    """Regression with absorbed effects: singletons dropped, robust errors, and degrees of freedom less
    one for each group beyond the first of a grouping."""
    rows = drop_singletons(df.where(finite(F.col(y).cast("double"))), groups)
    fit = regression(rows, f"{y} ~ {' + '.join(xs)} - 1", weight, "HC0", absorb=groups)
    counts = rows.agg(*(F.countDistinct(g) for g in groups)).first()
    lost = len(xs) + sum(counts) - len(groups)
    fit.cov = fit.cov * fit.n / max(fit.n - lost, 1)
    return fit


def projection_table(spark: SparkSession, rows: Sequence[tuple[int, float, float]]) -> DataFrame:
    return spark.createDataFrame([(int(h), float(b), float(s)) for h, b, s in rows], "horizon int, coef double, se double")


def local_projection(
    df: DataFrame,
    y: str,
    shock: str,
    order: Sequence[str],
    keys: Sequence[str] = (),
    periods: int = 8,
    shock_lags: int = 2,
    y_lags: int = 1,
    controls: Sequence[str] = (),
    effects: Sequence[str] = (),
) -> DataFrame:
    """(horizon, coef, se) of y so many rows ahead on the shock, its lags, lags of y and controls.

    Lags and leads are made once, within keys. Horizon 0 has HC3 errors, horizon h those of h lags of
    the complete rows in order of keys and order, so at the end of a key's rows they reach into the
    next key's. A row stands once for each horizon that it has; all horizons' moments are one
    aggregation by horizon and all covariances another. Beyond WINDOW_ROWS rows horizons are fitted one
    by one, their lags in runs.
    """
    w = ordered(keys, order)
    rows = add_lags(df, shock, range(1, shock_lags + 1), order, keys)
    rows = add_lags(rows, y, range(1, y_lags + 1), order, keys)
    rows = rows.withColumns({f"_h{h}": shifted(F.col(y), -h, w) for h in range(periods + 1)})
    right = [shock, *(f"L{i}_{shock}" for i in range(1, shock_lags + 1)), *(f"L{i}_{y}" for i in range(1, y_lags + 1)), *controls]
    right += [f"C({g})" for g in effects]
    formula, places = " + ".join(right), [*keys, *order]
    columns = design_columns(rows, Formula.parse(f"_h0 ~ {formula}"))
    k, at, out = len(columns), list(columns).index(shock), []
    design = rows.select(*(F.col(c).alias(f"_k{i}") for i, c in enumerate(places)), *(c.alias(f"_x{i}") for i, c in enumerate(columns.values())), *(f"_h{h}" for h in range(periods + 1)))
    for i in range(k):
        design = design.where(finite(F.col(f"_x{i}")))
    stacked = F.explode(F.array(*(F.struct(F.lit(h).alias("h"), F.col(f"_h{h}").cast("double").alias("y")) for h in range(periods + 1))))
    long = design.withColumn("_s", stacked).select(*(c for c in design.columns if not c.startswith("_h")), F.col("_s.h").alias("_h"), F.col("_s.y").alias("_y"))
    long = long.where(finite(F.col("_y"))).persist()
    try:
        cells = [(i, j) for i in range(k) for j in range(i, k)]
        sums = [F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")) for i, j in cells] + [F.sum(F.col(f"_x{i}") * F.col("_y")) for i in range(k)]
        got = {r[0]: list(r[1:]) for r in long.groupBy("_h").agg(F.count(F.lit(1)), *sums).collect()}
        if any(h not in got for h in range(periods + 1)):
            raise ValueError("no complete rows")
        if max(v[0] for v in got.values()) > WINDOW_ROWS:
            for h in range(periods + 1):
                fit = regression(rows, f"_h{h} ~ {formula}", hac_lags=h, order=places)
                out.append((h, fit.coef[at], fit.se[at]))
            return projection_table(df.sparkSession, out)
        fits = {}
        for h, (n, *v) in got.items():
            xx = np.zeros((k, k))
            for (i, j), m in zip(cells, v, strict=False):
                xx[i, j] = xx[j, i] = m
            inverse = np.linalg.inv(xx / n)
            fits[h] = (n, np.linalg.solve(xx, np.array(v[len(cells) :])), inverse)
        known = [(h, [float(b) for b in f[1]], [float(x) for x in f[2].ravel()], float(f[0])) for h, f in fits.items()]
        known = df.sparkSession.createDataFrame(known, "_h int, _b array<double>, _inv array<double>, _n double")  # a row a horizon
        told = long.join(F.broadcast(known), "_h")
        error = F.col("_y")
        for i in range(k):
            error = error - F.get("_b", F.lit(i)) * F.col(f"_x{i}")
        leverage = F.lit(0.0)
        for i in range(k):
            for j in range(k):
                leverage = leverage + F.get("_inv", F.lit(i * k + j)) * F.col(f"_x{i}") * F.col(f"_x{j}")
        keep = F.when(F.col("_h") == 0, 1 - leverage / F.col("_n")).otherwise(1.0)
        score = error / F.col("_n") / keep
        told = told.select("_h", *(f"_k{i}" for i in range(len(places))), *((score * F.col(f"_x{i}")).alias(f"_u{i}") for i in range(k)))
        along = Window.partitionBy("_h").orderBy(*(f"_k{i}" for i in range(len(places))))
        falling = lambda i: sum((F.when(F.col("_h") >= j, (1 - F.lit(float(j)) / (F.col("_h") + 1)) * F.coalesce(F.lag(f"_u{i}", j).over(along), F.lit(0.0))).otherwise(0.0) for j in range(1, periods + 1)), F.lit(0.0))
        told = told.select("_h", *(f"_u{i}" for i in range(k)), *(falling(i).alias(f"_v{i}") for i in range(k)))
        meats = told.groupBy("_h").agg(*(F.sum(F.col(f"_u{i}") * (F.col(f"_u{j}") + F.col(f"_v{j}"))).alias(f"_m{i}_{j}") for i in range(k) for j in range(k)), *(F.sum(F.col(f"_u{i}") * F.col(f"_u{j}")).alias(f"_d{i}_{j}") for i in range(k) for j in range(k)))
        for r in meats.collect():
            both, own = (np.array(r[1 + p * k * k : 1 + (p + 1) * k * k], dtype=float).reshape(k, k) for p in (0, 1))
            _, coef, inverse = fits[r[0]]
            cov = inverse @ (both + both.T - own) @ inverse
            out.append((r[0], coef[at], math.sqrt(max(0.0, cov[at, at]))))
    finally:
        long.unpersist()
    return projection_table(df.sparkSession, sorted(out))


@dataclass
class VectorFit:
    """Coefficients (right-hand terms by equations) and residual covariance of a vector autoregression."""

    variables: list[str]
    terms: list[str]
    coef: np.ndarray
    sigma: np.ndarray
    n: int

    def companion(self) -> np.ndarray:
        m = len(self.variables)
        lags = (len(self.terms) - 1) // m
        out = np.zeros((m * lags, m * lags))
        out[:m] = self.coef[1:].T
        out[m:, :-m] = np.eye(m * (lags - 1))
        return out

    def responses(self, periods: int) -> np.ndarray:
        """Impulse responses to orthogonal shocks in the order of the variables: period, variable, shock."""
        m, impact, power = len(self.variables), np.linalg.cholesky(self.sigma), np.eye(len(self.companion()))
        out = []
        for _ in range(periods):
            out.append(power[:m, :m] @ impact)
            power = self.companion() @ power
        return np.array(out)


@dataclass(frozen=True)
class VarMoments:
    """Sums of products of (constant, lags of all variables lag by lag, variables) over n rows."""

    variables: list[str]
    lags: int
    gram: np.ndarray
    n: int

    @property
    def means(self) -> np.ndarray:
        return self.gram[0, -len(self.variables) :] / self.n

    def own_variances(self) -> np.ndarray:
        """Residual variances of each variable on a constant and its own lags."""
        m, out = len(self.variables), []
        for i in range(m):
            own, y = [0, *range(1 + i, 1 + m * self.lags, m)], 1 + m * self.lags + i
            xy = self.gram[own, y]
            out.append((self.gram[y, y] - xy @ np.linalg.solve(self.gram[np.ix_(own, own)], xy)) / self.n)
        return np.array(out)


def var_moments(df: DataFrame, variables: Sequence[str], lags: int, order: Sequence[str]) -> VarMoments:
    """The moments of a vector autoregression's complete rows, in one aggregation."""
    rows = df
    for x in variables:
        rows = add_lags(rows, x, range(1, lags + 1), order)
    columns = [F.lit(1.0), *(F.col(f"L{i}_{x}").cast("double") for i in range(1, lags + 1) for x in variables), *(F.col(x).cast("double") for x in variables)]
    names = [f"_x{i}" for i in range(len(columns))]
    rows = rows.select(*(c.alias(n) for c, n in zip(columns, names, strict=True)))
    for n in names:
        rows = rows.where(finite(F.col(n)))
    gram = symmetric_sum(rows, len(names), F.lit(1.0))
    return VarMoments(list(variables), lags, gram, int(round(gram[0, 0])))


def vector_autoregression(df: DataFrame, variables: Sequence[str], lags: int, order: Sequence[str]) -> VectorFit:
    """Least squares of every variable on a constant and the lags of all, from one aggregation."""
    made = var_moments(df, variables, lags, order)
    terms, gram = ["const", *(f"L{i}_{x}" for i in range(1, lags + 1) for x in variables)], made.gram
    k = len(terms)
    coef = np.linalg.solve(gram[:k, :k], gram[:k, k:])
    sigma = (gram[k:, k:] - coef.T @ gram[:k, k:]) / made.n
    return VectorFit(list(variables), terms, coef, sigma, made.n)


def hamilton_detrend(df: DataFrame, variable: str, order: Sequence[str], p: int = 4, h: int = 8) -> DataFrame:
    """Adds x_trend and x_detrend: x on its p values from h rows before on."""
    w = ordered((), order)
    rows = df.withColumns({f"_b{i}": F.lag(variable, h + i).over(w) for i in range(p)})
    fit = regression(rows, f"{variable} ~ {' + '.join(f'_b{i}' for i in range(p))}", cov_type="HC0")
    trend = F.lit(float(fit.coef[0]))
    for i in range(p):
        trend = trend + F.lit(float(fit.coef[i + 1])) * F.col(f"_b{i}")
    return rows.withColumn(f"{variable}_trend", trend).withColumn(f"{variable}_detrend", F.col(variable) - trend).drop(*(f"_b{i}" for i in range(p)))


def long_horizon(df: DataFrame, y: str, x: str, horizon: int, order: Sequence[str]) -> Fit:
    """The sum of y over the next horizon rows on x, with errors of so many lags."""
    w = ordered((), order)
    ahead = F.lit(0.0)
    for h in range(1, horizon + 1):
        ahead = ahead + F.lead(y, h).over(w)
    return regression(df.withColumn("_ahead", ahead), f"_ahead ~ {x}", hac_lags=horizon, order=order)


def distributed_lags(df: DataFrame, y: str, x: str, lags: int, order: Sequence[str]) -> Fit:
    """y on lags 1 to lags of x."""
    rows = add_lags(df, x, range(1, lags + 1), order)
    return regression(rows, f"{y} ~ {' + '.join(f'L{i}_{x}' for i in range(1, lags + 1))}", cov_type="HC0")


def arma_two_step(df: DataFrame, x: str, p: int, q: int, order: Sequence[str], first_lags: int = 4) -> Fit:
    """Autoregressive and moving-average terms by least squares on lagged residuals of a long autoregression."""
    w = ordered((), order)
    rows = add_lags(df, x, range(1, max(p, first_lags) + 1), order)
    first = regression(rows, f"{x} ~ {' + '.join(f'L{i}_{x}' for i in range(1, first_lags + 1))}", cov_type="HC0")
    fitted = F.lit(float(first.coef[0]))
    for i in range(1, first_lags + 1):
        fitted = fitted + F.lit(float(first.coef[i])) * F.col(f"L{i}_{x}")
    rows = rows.withColumn("_u", F.col(x) - fitted)
    rows = rows.withColumns({f"U{i}": F.lag("_u", i).over(w) for i in range(1, q + 1)})
    right = [f"L{i}_{x}" for i in range(1, p + 1)] + [f"U{i}" for i in range(1, q + 1)]
    return regression(rows, f"{x} ~ {' + '.join(right)}", cov_type="HC0")


def dynamic_least_squares(df: DataFrame, y: str, x: str, lags: int, order: Sequence[str]) -> Fit:
    """y on x with leads and lags of the difference of x."""
    w = ordered((), order)
    rows = df.withColumn("_dx", F.col(x) - F.lag(x).over(w))
    rows = rows.withColumns({f"D{i}".replace("-", "m"): shifted(F.col("_dx"), i, w) for i in range(-lags, lags + 1)})
    right = [x, *(f"D{i}".replace("-", "m") for i in range(-lags, lags + 1))]
    return regression(rows, f"{y} ~ {' + '.join(right)}", hac_lags=lags, order=order)


def error_correction(df: DataFrame, y: str, x: str, lags: int, order: Sequence[str], dls_lags: int = 2) -> tuple[Fit, Fit, float]:
    """(regression of the change of y, of x, long-run coefficient): changes on the lagged distance from the
    long-run relation, found by dynamic least squares, and on lagged changes of both."""
    long_run = dynamic_least_squares(df, y, x, dls_lags, order)
    beta = float(long_run.coef[long_run.terms.index(x)])
    level = float(long_run.coef[long_run.terms.index("Intercept")])
    w = ordered((), order)
    rows = df.withColumn("_gap", F.lag(F.col(y) - beta * F.col(x) - level).over(w))
    rows = rows.withColumns({f"_d{i}": F.col(c) - F.lag(c).over(w) for i, c in enumerate((y, x))})
    for i in range(2):
        rows = add_lags(rows, f"_d{i}", range(1, lags + 1), order)
    right = " + ".join(["_gap", *(f"L{k}__d{i}" for i in range(2) for k in range(1, lags + 1))])
    return (*(regression(rows, f"_d{i} ~ {right}", cov_type="HC0") for i in range(2)), beta)
