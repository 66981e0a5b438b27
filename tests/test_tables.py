import numpy as np
import pytest

from tallyloom.functions import numerics
from tallyloom.functions.tables import Cell, Table, regression_table
from tallyloom.operators import regression as reg


def fit(terms, coef, se, n=50, r2=0.5):
    return reg.Fit(list(terms), np.array(coef), np.diag(np.square(se)), n, r2, 4.0, None)


def test_tables_are_put_together():
    a = Table.of([["x", 1.0], ["y", 2]], header=["", "one"])
    b = Table.of([[3.5]], form="3.1f", header=["two"])
    both = a.beside(b)
    assert [[c.text for c in r] for r in both.rows] == [["", "one", "two"], ["x", "1.000", "3.5"], ["y", "2", ""]] and both.lines == {1}
    tall = both.below(Table.of([["z"]]), rule=True).titled("All")
    assert tall.rows[0] == [Cell("All", 3)] and tall.lines == {1, 2, 4} and [c.text for c in tall.rows[-1]] == ["z", "", ""]
    text = tall.tabular()
    assert text.startswith("\\begin{tabular}{lcc}\n\\hline\n\\multicolumn{3}{c}{All} \\\\\n\\hline\n & one & two \\\\") and text.count("\\hline") == 5
    assert "\\caption{c}" in a.floating("c", "t:a", "Notes.") and "\\par Notes." in a.floating("c", "t:a", "Notes.")
    with pytest.raises(ValueError, match="widths"):
        Table.of([["a"], ["a", "b"]])


def test_regressions_side_by_side():
    one = fit(["Intercept", "x"], [1.0, 3.0], [1.0, 1.0])
    two = fit(["Intercept", "x", "z"], [0.0, 1.7, -5.0], [1.0, 1.0, 0.5], n=40)
    made = regression_table([one, two], labels={"x": "Effect", "adjusted_r2": "Adj."})
    text = [[c.text for c in r] for r in made.rows]
    assert text[0] == ["", "(1)", "(2)"] and text[3] == ["Effect", "3.000***", "1.700*"] and text[4] == ["", "(1.000)", "(1.000)"]
    assert text[5] == ["z", "", "-5.000***"] and text[6] == ["", "", "(0.500)"] and text[7] == ["n", "50", "40"]
    assert text[8] == ["Adj.", f"{1 - 0.5 * 49 / 48:4.3f}", f"{1 - 0.5 * 39 / 37:4.3f}"] and made.lines == {1, 7}
    only = regression_table(two, ["only"], ["z"], t_values=True, stars=False, below=())
    assert [[c.text for c in r] for r in only.rows] == [["", "only"], ["z", "-5.000"], ["", "(-10.000)"]]


def test_formulas():
    assert reg.formula_of("y", ["a", "b"], ["g"], intercept=False, more="a:b") == "y ~ a + b + C(g) + a:b - 1"
    assert reg.formula_of("y", []) == "y ~ 1" and reg.lag_terms("x", 2) == ["L1_x", "L2_x"]
    assert reg.projection_formula(3, "y", "s", 1, 2, {"c": 2}, ["g"]) == "F3_y ~ s + L1_s + L1_y + L2_y + L1_c + L2_c + C(g)"
    parsed = reg.Formula.parse(reg.projection_formula(0, "y", "s", 0, 0, ["c"]))
    assert parsed.y == "y" and parsed.terms == ("s", "L1_c") and parsed.intercept
    with pytest.raises(ValueError):
        reg.formula_of("y", [], intercept=False)


def test_chains_settle():
    p = np.array([[0.999, 0.001, 0], [0.002, 0.997, 0.001], [0, 0.004, 0.996]])
    pi = numerics.stationary_by_doubling(p)
    assert np.allclose(pi @ p, pi) and np.allclose(pi, numerics.stationary(p))
    assert np.allclose(numerics.stationary_by_doubling(p, np.array([0, 0, 1.0])), pi)
    with pytest.raises(ArithmeticError):
        numerics.stationary_by_doubling(np.array([[0.0, 1], [1, 0]]), np.array([1.0, 0]), most=5)
    kept = numerics.without_rare_moves(np.array([[0.5, 0.4999999, 1e-7], [0, 1, 0]]))
    assert kept[0, 2] == 0 and np.allclose(kept.sum(axis=1), 1)
