"""Reference SQL of least squares: centred moments, elimination written out, and errors of the coefficients."""

from __future__ import annotations

from collections.abc import Sequence


def least_squares(name: str, rows: str, y: str, xs: Sequence[str], order: str = "") -> str:
    """Table expressions ending in <name>_b, one row: n, b_c (constant), b_<i>, m_<i> (means) and
    v_<i>_<j> (inverse of the centred moments). <name>_r has the complete rows, as y, x_<i> and order."""
    k = len(xs)
    inside = ", ".join([f"CAST({y} AS DOUBLE) AS y", *(f"CAST({x} AS DOUBLE) AS x_{i}" for i, x in enumerate(xs)), *([order] if order else [])])
    given = " AND ".join(["y IS NOT NULL", *(f"x_{i} IS NOT NULL" for i in range(k))])
    means = ", ".join(["count(*) AS n", "avg(y) AS my", *(f"avg(x_{i}) AS m_{i}" for i in range(k))])
    of = [f"(x_{i} - m_{i})" for i in range(k)] + ["(y - my)"]
    kept = ", ".join(["n", "my", *(f"m_{i}" for i in range(k))])
    first = [f"sum({of[i]} * {of[j]}) AS a_{i}_{j}" for i in range(k) for j in range(k + 1)]
    first += [f"{float(i == j)} AS a_{i}_{k + 1 + j}" for i in range(k) for j in range(k)]
    once = ", ".join(f"any_value({c}) AS {c}" for c in kept.split(", "))
    out = [
        f"{name}_r AS (SELECT * FROM (SELECT {inside} FROM ({rows})) WHERE {given})",
        f"{name}_m AS (SELECT {means} FROM {name}_r)",
        f"{name}_0 AS (SELECT {once}, {', '.join(first)} FROM {name}_r, {name}_m)",
    ]
    for t in range(k):
        cells = [
            (f"a_{t}_{j} / a_{t}_{t}" if i == t else f"a_{i}_{j} - a_{i}_{t} * a_{t}_{j} / a_{t}_{t}") + f" AS a_{i}_{j}"
            for i in range(k)
            for j in range(2 * k + 1)
        ]
        out.append(f"{name}_{t + 1} AS (SELECT {kept}, {', '.join(cells)} FROM {name}_{t})")
    constant = " - ".join(["my", *(f"a_{i}_{k} * m_{i}" for i in range(k))])
    made = [f"a_{i}_{k} AS b_{i}" for i in range(k)] + [f"a_{i}_{k + 1 + j} AS v_{i}_{j}" for i in range(k) for j in range(k)]
    out.append(f"{name}_b AS (SELECT {kept}, {constant} AS b_c, {', '.join(made)} FROM {name}_{k})")
    return ",\n  ".join(out)


def errors(name: str, k: int, kind: str | int, order: str = "") -> str:
    """Table expressions ending in <name>_e, one row: se_c and se_<i>, by 'hc0', 'hc3' or so many Bartlett lags in order."""
    pull = [" + ".join(f"v_{i}_{j} * (x_{j} - m_{j})" for j in range(k)) for i in range(k)]
    residual = " - ".join(["y", "b_c", *(f"b_{i} * x_{i}" for i in range(k))])
    pulls = ", ".join(f"{p} AS g_{i}" for i, p in enumerate(pull))
    keep = f", {order}" if order else ""
    alone = " - ".join(["1.0 / n", *(f"m_{i} * g_{i}" for i in range(k))])
    leverage = " + ".join(["1.0 / n", *(f"(x_{i} - m_{i}) * g_{i}" for i in range(k))])
    weight = f" / (1 - ({leverage}))" if kind == "hc3" else ""
    names = ["c", *map(str, range(k))]
    scores = ", ".join(f"e * ({alone if c == 'c' else f'g_{c}'}){weight} AS u_{c}" for c in names)
    out = [
        f"{name}_g AS (SELECT *, {residual} AS e, {pulls} FROM {name}_r, {name}_b)",
        f"{name}_u AS (SELECT {scores}{keep} FROM {name}_g)",
    ]
    lags = kind if isinstance(kind, int) else 0
    lagged = ", ".join(["*", *(f"lag(u_{c}, {j}) OVER (ORDER BY {order}) AS u_{c}_{j}" for c in names for j in range(1, lags + 1))])
    total = lambda c: " + ".join([f"sum(u_{c} * u_{c})", *(f"{2 * (1 - j / (lags + 1))!r} * coalesce(sum(u_{c} * u_{c}_{j}), 0)" for j in range(1, lags + 1))])
    out.append(f"{name}_l AS (SELECT {lagged} FROM {name}_u)")
    out.append(f"{name}_e AS (SELECT {', '.join(f'sqrt(greatest(0, {total(c)})) AS se_{c}' for c in names)} FROM {name}_l)")
    return ",\n  ".join(out)


def fit_table(name: str, terms: Sequence[str], digits: int, with_errors: bool = True) -> str:
    """Rows (term, coef, se) of a fit, the constant as Intercept."""
    places = ["c", *map(str, range(len(terms)))]
    rows = [
        f"SELECT '{t}' AS term, round(b_{c}, {digits}) AS coef" + (f", round(se_{c}, {digits}) AS se" if with_errors else "") + f" FROM {name}_b" + (f", {name}_e" if with_errors else "")
        for t, c in zip(["Intercept", *terms], places, strict=True)
    ]
    return " UNION ALL ".join(rows)
