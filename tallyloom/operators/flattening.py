"""Source trees as one text each: includes closed by joins, references resolved, macros expanded."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import macros
from tallyloom.functions.text import remove_comments
from tallyloom.plans.session import checkpointed, send_package

#: An include with the name of a file. Fixed value.
INCLUDE = r"\\(?:input|include)\s*\{\s*([^{}]*?)\s*\}"
REFERENCE = r"\\(eqref|ref)\s*\{\s*([^{}]*?)\s*\}"
NEW_LABEL = r"\\newlabel\{([^{}]*)\}\{\{([^{}]*)\}"


def segments(files: DataFrame) -> DataFrame:
    """(path, at, text, name): each file as texts in order, each followed by the include of a name or nothing."""
    text = F.coalesce("text", F.lit(""))
    texts, names = F.split(text, INCLUDE), F.regexp_extract_all(text, F.lit(INCLUDE), 1)
    rows = files.where("path is not null").select("path", F.posexplode(F.arrays_zip(texts.alias("t"), names.alias("n"))).alias("at", "_s"))
    return rows.select("path", "at", F.coalesce(F.col("_s.t"), F.lit("")).alias("text"), F.col("_s.n").alias("name"))


def closed_includes(files: DataFrame, roots: DataFrame, folder: str = "") -> DataFrame:
    """(path, text, n_includes, missing) of every root: its text with the included files in the place of
    their includes, all the way down.

    files: path, text, one row a path; roots: path. A name is that of a path, or of a path without
    .tex, below folder. Includes of unknown files stay as they are and are told in missing, sorted and
    once each; a file that includes itself, directly or not, is an error. Files meet their includes in
    one join a level; a place is told by the places of the includes above it, by which the pieces of a
    root are put in order in the end.
    """
    parts = checkpointed(segments(files))
    known = files.select(F.col("path").alias("_p")).distinct()
    named = parts.where("name is not null").select("name").distinct().withColumn("_full", F.concat(F.lit(folder), "name"))
    exact = named.join(known, F.col("_full") == F.col("_p")).select("name", F.col("_p").alias("target"), F.lit(0).alias("_o"))
    short = named.join(known, F.concat("_full", F.lit(".tex")) == F.col("_p")).select("name", F.col("_p").alias("target"), F.lit(1).alias("_o"))
    targets = exact.unionByName(short).groupBy("name").agg(F.min(F.struct("_o", "target"))["target"].alias("target"))
    parts = checkpointed(parts.join(targets, "name", "left").select("path", "at", "text", "name", "target"))
    start = roots.select(F.col("path").alias("root")).distinct()
    level = start.select("root", F.array().cast("array<int>").alias("place"), F.array().cast("array<string>").alias("trail"), F.col("root").alias("target"))
    done = None
    while True:
        met = checkpointed(
            level.join(parts.withColumnRenamed("target", "next"), F.col("target") == F.col("path")).select(
                "root", F.concat("place", F.array("at")).alias("place"), F.concat("trail", F.array("target")).alias("trail"), "text", "name", "next"
            )
        )
        told = met.select("root", "place", F.concat("text", F.when(F.col("next").isNull() & F.col("name").isNotNull(), F.concat(F.lit("\\input{"), "name", F.lit("}"))).otherwise("")).alias("text"), "name", "next")
        done = told if done is None else done.unionByName(told)
        circle = met.where(F.array_contains("trail", F.col("next"))).select("trail", "next").first()
        if circle:
            raise ValueError(f"files include each other: {' > '.join([*circle['trail'], circle['next']])}")
        level = met.where("next is not null").select("root", "place", "trail", F.col("next").alias("target"))
        if level.isEmpty():
            break
    whole = done.groupBy("root").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda s: s["text"]), "").alias("text"),
        F.count("next").alias("n_includes"),
        F.array_sort(F.collect_set(F.when(F.col("next").isNull(), F.col("name")))).alias("missing"),
    )
    return whole.withColumnRenamed("root", "path")


def label_numbers(aux: DataFrame) -> DataFrame:
    """(path, labels): the numbers of a compiled document's labels, from the text of its auxiliary file; of
    a label twice, the last."""
    names, numbers = F.regexp_extract_all("text", F.lit(NEW_LABEL), 1), F.regexp_extract_all("text", F.lit(NEW_LABEL), 2)
    rows = aux.select("path", F.posexplode(F.arrays_zip(names.alias("l"), numbers.alias("n"))).alias("_at", "_s")).select("path", "_at", F.col("_s.l").alias("l"), F.col("_s.n").alias("n"))
    last = rows.groupBy("path", "l").agg(F.max_by("n", "_at").alias("n"))
    return last.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("l", "n"))).alias("labels"))


def resolved(text: Column, labels: Column) -> Column:
    """text with references to known labels as their numbers, those to equations in round brackets."""
    kinds, names, uses = (F.regexp_extract_all(text, F.lit(REFERENCE), i) for i in (1, 2, 0))
    numbers = F.transform(names, lambda n: F.try_element_at(labels, n))
    told = F.zip_with(F.zip_with(kinds, numbers, lambda k, n: F.when(k == "eqref", F.concat(F.lit("("), n, F.lit(")"))).otherwise(n)), uses, lambda a, b: F.coalesce(a, b))
    return F.array_join(F.zip_with(F.split(text, REFERENCE), told, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))), "")


def expanded_texts(df: DataFrame, names: Sequence[str] | None = None, keep: bool = True, drop_unused: bool = False) -> DataFrame:
    """df with the macros in its texts expanded (all, or those named); see functions.macros.expanded."""
    send_package(df.sparkSession)
    wanted = None if names is None else list(names)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = [None if t is None else macros.expanded(t, wanted, keep=keep) for t in f["text"]]
            yield f.assign(text=[macros.without_unused(t) if drop_unused and t is not None else t for t in texts])

    return df.mapInPandas(run, df.schema)


def flatten(
    files: DataFrame,
    roots: DataFrame,
    aux: DataFrame | None = None,
    names: Sequence[str] | None = (),
    comments: bool = False,
    keep: bool = True,
    drop_unused: bool = False,
    folder: str = "",
) -> DataFrame:
    """Every root as one text: (path, text, n_includes, missing).

    Comments go first unless kept, so that what they include is not read; then includes are closed,
    the macros named are expanded (None: all) and references become the numbers in aux (path of the
    root, text of its auxiliary file).
    """
    if not comments:
        files = files.select("path", remove_comments(F.col("text")).alias("text"))
    out = closed_includes(files, roots, folder)
    if names is None or len(names) or drop_unused:
        out = expanded_texts(out, names, keep, drop_unused)
    if aux is not None:
        out = out.join(label_numbers(aux), "path", "left")
        out = out.withColumn("text", F.when(F.col("labels").isNull(), F.col("text")).otherwise(resolved(F.col("text"), F.col("labels")))).drop("labels")
    return out
