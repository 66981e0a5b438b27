import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallyloom.functions import macros
from tallyloom.operators import flattening


def one(df):
    return {r["path"]: r for r in df.collect()}


def files(spark, tree):
    return spark.createDataFrame(list(tree.items()), "path string, text string")


def test_includes_are_closed_in_order(spark):
    tree = {
        "main.tex": "A\\input{one}B\\include{ two.tex }C\\input{one}D",
        "one.tex": "(1\\input{deep/three}1)",
        "two.tex": "[2]",
        "deep/three.tex": "<3\\input{lost}\\input{gone}\\input{lost}>",
        "empty.tex": None,
        "alone": "no includes $1 \\\\ {x}",
        "first.tex": "\\input{empty}",
    }
    df = files(spark, tree)
    got = one(flattening.closed_includes(df.repartition(3), df.where("path in ('main.tex', 'alone', 'first.tex', 'empty.tex')")))
    lost = "<3\\input{lost}\\input{gone}\\input{lost}>"
    assert got["main.tex"]["text"] == f"A(1{lost}1)B[2]C(1{lost}1)D"
    assert got["main.tex"]["n_includes"] == 5 and got["main.tex"]["missing"] == ["gone", "lost"]
    assert got["alone"]["text"] == tree["alone"] and got["alone"]["n_includes"] == 0 and got["alone"]["missing"] == []
    assert got["first.tex"]["text"] == "" and got["first.tex"]["n_includes"] == 1 and got["empty.tex"]["text"] == ""


def test_a_file_with_that_very_name_goes_first_and_folders_count(spark):
    df = files(spark, {"src/a": "exact", "src/a.tex": "with ending", "m": "\\input{a}"})
    assert one(flattening.closed_includes(df, df.where("path = 'm'"), folder="src/"))["m"]["text"] == "exact"


def test_circles_are_told(spark):
    df = files(spark, {"a": "\\input{b}", "b": "\\input{c}", "c": "x\\input{a}"})
    with pytest.raises(ValueError, match="a > b > c > a"):
        flattening.closed_includes(df, df.where("path = 'a'"))


def test_more_than_ten_pieces_keep_their_order(spark):
    tree = {f"p{i}": str(i) for i in range(30)} | {"m": "-".join(f"\\input{{p{i}}}" for i in range(30))}
    df = files(spark, tree)
    assert one(flattening.closed_includes(df, df.where("path = 'm'")))["m"]["text"] == "-".join(map(str, range(30)))


def test_references_become_numbers(spark):
    aux = files(spark, {"m": "\\newlabel{eq:a}{{3.2}{7}{}}\n\\newlabel{fig:b}{{4}{9}}\n\\newlabel{fig:b}{{5}{9}}", "n": ""})
    labels = flattening.label_numbers(aux)
    text = "see \\ref{fig:b}, \\eqref{ eq:a } and \\ref{no}; \\ref{eq:a}"
    df = files(spark, {"m": text, "n": text, "o": None}).join(labels, "path", "left")
    got = dict(rows(df.select("path", flattening.resolved(F.col("text"), F.coalesce("labels", F.create_map().cast("map<string,string>"))).alias("t"))))
    assert got["m"] == "see 5, (3.2) and \\ref{no}; 3.2" and got["n"] == text and got["o"] is None


def test_a_whole_tree(spark):
    tree = {
        "main": "\\newcommand{\\two}[2]{#2+#1}\\newcommand{\\unused}{z}\n\\input{part} % \\input{never}\nEnd \\ref{s}",
        "part": "\\two{\\two{a}{b}}{c} 50\\% off % gone\n\\def\\x{1}\\x\\def\\x{2}\\x",
    }
    df, aux = files(spark, tree), files(spark, {"main": "\\newlabel{s}{{9}{1}}"})
    got = one(flattening.flatten(df, df.where("path = 'main'"), aux, names=None, keep=False))["main"]
    assert got["text"] == "c+b+a 50\\% off 12 End 9" and got["missing"] == []
    kept = one(flattening.flatten(df, df.where("path = 'main'"), names=["x"], drop_unused=True))["main"]["text"]
    assert kept == "\\newcommand{\\two}[2]{#2+#1}\\two{\\two{a}{b}}{c} 50\\% off 12 End \\ref{s}"


def test_macros():
    text = r"\newcommand{\a}[1][d]{<#1>}\renewcommand*\b[2]{#2{#1}}\def\c#1#2{#1#2#1}\newcommand\e{\a[q]}"
    assert macros.definitions(text) == [macros.Macro("a", 1, "<#1>", "d"), macros.Macro("b", 2, "#2{#1}"), macros.Macro("c", 2, "#1#2#1"), macros.Macro("e", 0, r"\a[q]")]
    use = r"\a \a[x]\b{1} {2{3}}\c{\e}{y}\ab\e"
    assert macros.expanded(text + use, keep=False) == r"<d> <x>2{3}{1}<q>y<q>\ab<q>"
    assert macros.expanded(text + r"\b{1}{2}", keep=False) == "2{1}"
    assert macros.expanded(text + use, ["e"]) == text + r"\a \a[x]\b{1} {2{3}}\c{\a[q]}{y}\ab\a[q]"
    assert macros.expanded(r"\f{1}", known=[macros.Macro("f", 2, "#1#2")]) == r"\f{1}"  # an argument is missing
    assert macros.expanded(r"\newcommand{\g}{\h}\newcommand{\h}[1]{[#1]}\g{z}", keep=False) == "[z]"
    assert macros.expanded(r"\f{a\}b}{", known=[macros.Macro("f", 1, "(#1)")]) == r"(a\}b){"
    assert macros.expanded(r"\newcommand{\broken}[1]{oops \x") == r"\newcommand{\broken}[1]{oops \x"


def test_circular_macros_are_told(monkeypatch):
    monkeypatch.setattr(macros, "MOST", 100)
    with pytest.raises(ValueError, match="circles"):
        macros.expanded(r"\def\a{\b}\def\b{\a}\a")


def test_unused_definitions_go_until_none_is_left():
    assert macros.without_unused("\\newcommand{\\a}{1}\n\\newcommand{\\b}{\\a}\n\\def\\c{\\b}\nx \\d") == "x \\d"
    assert macros.without_unused("\\newcommand{\\a}{1}\\a") == "\\newcommand{\\a}{1}\\a"


def test_figures_are_renamed():
    text = "\\begin{figure}\n\\includegraphics[width=1cm]{img/p.pdf}\\caption{x}\\label{fig:p}\\end{figure}\\begin{figure*}\\includegraphics{q}\\label{fig:q}\\end{figure*}"
    assert macros.figure_files(text) == [("fig:p", "img/p.pdf"), ("fig:q", "q")]
    new, moves = macros.renamed_figures(text, {"fig:p": "3.1"}, "out/")
    assert moves == [("img/p.pdf", "out/fig3.1.pdf")] and "{out/fig3.1.pdf}" in new and "{q}" in new


def test_long_texts_take_time_in_proportion():
    import time

    def took(n):
        text = "\\newcommand{\\m}[1]{<#1>}" + "word \\m{x} " * n
        began = time.perf_counter()
        assert macros.expanded(text, keep=False).count("<x>") == n
        return time.perf_counter() - began

    took(1000)
    assert took(40_000) < 12 * max(took(10_000), 0.02)
