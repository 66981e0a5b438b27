"""Tables for papers: cells put beside and below each other, regression results in columns, LaTeX."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from tallyloom.operators.regression import Fit

#: Levels of significance and their stars.
STARS = ((0.01, "***"), (0.05, "**"), (0.1, "*"))


@dataclass(frozen=True)
class Cell:
    """text over so many columns."""

    text: str
    span: int = 1
    align: str = "c"

    def latex(self) -> str:
        return self.text if self.span == 1 else f"\\multicolumn{{{self.span}}}{{{self.align}}}{{{self.text}}}"


def cell(value: object, form: str = "4.3f") -> Cell:
    if isinstance(value, Cell):
        return value
    return Cell("" if value is None else format(value, form) if isinstance(value, float) else str(value))


@dataclass
class Table:
    """Rows of cells, all of the same width; lines: numbers of rows that a rule stands above."""

    rows: list[list[Cell]]
    lines: set[int] = field(default_factory=set)

    @classmethod
    def of(cls, rows: Sequence[Sequence[object]], form: str = "4.3f", header: Sequence[object] = ()) -> Table:
        made = [[cell(v, form) for v in r] for r in ([header] if header else []) + list(rows)]
        return cls(made, {1} if header else set())

    def __post_init__(self) -> None:
        if len({sum(c.span for c in r) for r in self.rows}) > 1:
            raise ValueError("rows of different widths")

    @property
    def width(self) -> int:
        return sum(c.span for c in self.rows[0]) if self.rows else 0

    def beside(self, other: Table) -> Table:
        """Both side by side; the shorter one is filled with empty cells below."""
        n = max(len(self.rows), len(other.rows))
        fill = lambda t: t.rows + [[Cell("")] * t.width for _ in range(n - len(t.rows))]
        return Table([a + b for a, b in zip(fill(self), fill(other), strict=True)], self.lines | other.lines)

    def below(self, other: Table, rule: bool = False) -> Table:
        """Other under this one; the narrower one is filled with empty cells on its right."""
        width = max(self.width, other.width)
        fill = lambda t: [r + [Cell("")] * (width - t.width) for r in t.rows]
        n = len(self.rows)
        return Table(fill(self) + fill(other), self.lines | {n + i for i in other.lines} | ({n} if rule else set()))

    def titled(self, title: str) -> Table:
        """With a cell over all columns on top."""
        return Table([[Cell(title, self.width)], *self.rows], {0 + 1, *(i + 1 for i in self.lines)})

    def tabular(self, align: str | None = None) -> str:
        out = [f"\\begin{{tabular}}{{{align or 'l' + 'c' * (self.width - 1)}}}", "\\hline"]
        for i, row in enumerate(self.rows):
            out += (["\\hline"] if i in self.lines else []) + [" & ".join(c.latex() for c in row) + r" \\"]
        return "\n".join([*out, "\\hline", "\\end{tabular}"]) + "\n"

    def floating(self, caption: str = "", label: str = "", notes: str = "") -> str:
        parts = ["\\begin{table}", "\\centering", *([f"\\caption{{{caption}}}"] if caption else []), *([f"\\label{{{label}}}"] if label else [])]
        return "\n".join([*parts, self.tabular().rstrip("\n"), *([f"\\par {notes}"] if notes else []), "\\end{table}"]) + "\n"


def statistics(fit: Fit) -> dict[str, float]:
    k = len(fit.terms)
    return {"n": fit.n, "r2": fit.r2, "adjusted_r2": 1 - (1 - fit.r2) * (fit.n - 1) / (fit.n - k) if fit.n > k else float("nan"), "sigma": fit.sigma2**0.5}


def estimates(fit: Fit, form: str, t_values: bool, stars: bool) -> dict[str, tuple[str, str]]:
    """Of each term the coefficient with its stars and what stands below it in round brackets."""
    out = {}
    for term, b, s, t, p in fit.rows():
        mark = next((m for level, m in STARS if p is not None and p < level), "") if stars else ""
        below = t if t_values else s
        out[term] = (format(b, form) + mark, "" if below is None else f"({format(below, form)})")
    return out


def regression_table(
    fits: Fit | Sequence[Fit],
    names: Sequence[str] = (),
    terms: Sequence[str] = (),
    labels: Mapping[str, str] | None = None,
    form: str = "4.3f",
    t_values: bool = False,
    stars: bool = True,
    below: Sequence[str] = ("n", "adjusted_r2"),
) -> Table:
    """Regressions side by side, a column each: terms in the order in which they first come, or those asked
    for, each with its error (or t value) under it; statistics below a rule. A term that a regression
    lacks leaves its cells empty."""
    fits = [fits] if isinstance(fits, Fit) else list(fits)
    heads = list(names) or [f"({i})" for i in range(1, len(fits) + 1)]
    told = [estimates(f, form, t_values, stars) for f in fits]
    shown = list(terms) or list(dict.fromkeys(t for e in told for t in e))
    label = labels or {}
    rows: list[list[object]] = []
    for t in shown:
        pairs = [e.get(t, ("", "")) for e in told]
        rows += [[label.get(t, t), *(p[0] for p in pairs)], ["", *(p[1] for p in pairs)]]
    body = Table.of(rows, form, ["", *heads])
    if not below:
        return body
    sums = [statistics(f) for f in fits]
    return body.below(Table.of([[label.get(s, s), *(x[s] for x in sums)] for s in below], form), rule=True)
