"""Small helpers that the corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.plans.session import own_folder, send_package

#: The white space of the contracts: space and the controls 9 to 13.
BLANKS = "\t\n\x0b\x0c\r"
#: A word is a maximal run of other characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: A key with more than this part of all rows, and more than so many rows, is dealt over several tasks.
HOT_PARTS, FEW_ROWS = 500, 5000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where the setting is absent in local mode (tests) is a temporary folder made, and it is then
    kept in the session's settings so that later calls find the same one; a cluster must name one.
    What is written there stays until whoever runs the job clears the folder, as results read it.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = own_folder(spark)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other call has."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, so that a lost
    executor costs a re-read and not a re-run, and lets several branches share one pass."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once a row however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def salted_join(
    rows: DataFrame, unique: DataFrame, keys: list[str], weights: DataFrame, spread: Column, how: str = "inner", parts: int = HOT_PARTS, merge: bool = True
) -> DataFrame:
    """rows joined with unique, which has one row a key, so that no task gets all rows of a hot key.

    weights: the keys and _weight, their number of rows. Keys with more than 1 / parts of all rows,
    of which there are fewer than parts, are broadcast with a number of salts; their rows are dealt
    over the salts by spread, and unique has a row for each salt. With merge the plan is the same at
    every size; else the planner may broadcast a small unique.
    """
    total, top = weights.agg(F.sum("_weight"), F.max("_weight")).first()
    if (top or 0) <= max(FEW_ROWS, (total or 0) // parts):
        return rows.join(unique.hint("merge") if merge else unique, keys, how)
    hot = weights.where(F.col("_weight") * parts > total).select(*keys, F.ceil(F.col("_weight") * parts / F.lit(float(total))).cast("int").alias("_salts"))
    hot = F.broadcast(materialise(hot, "hot"))
    dealt = rows.join(hot, keys, "left").withColumn("_salt", F.coalesce(F.pmod(spread, F.col("_salts")).cast("int"), F.lit(0))).drop("_salts")
    spread_out = unique.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts") - 1, F.lit(0))))).drop("_salts")
    return dealt.join(spread_out.hint("merge") if merge else spread_out, [*keys, "_salt"], how).drop("_salt")


def without_places(lines: Column, places: Column) -> Column:
    """An array without the elements at these places (from 0), in time linear in both."""
    return let(
        lines,
        lambda x: F.transform(
            F.array_except(F.transform(x, lambda _, i: i), places.cast("array<int>")), lambda i: F.get(x, i)
        ),
    )


def single_blanks(text: Column) -> Column:
    """text with every run of blanks inside a line as one space. Texts without tabs and the like and
    without two spaces in a row, told by searches for bytes, are left as they are."""
    odd = [F.contains(text, F.lit(x)) for x in ("  ", *BLANKS.replace("\n", ""))]
    return F.when(reduce(or_, odd), F.regexp_replace(text, r"[ \t\x0B\f\r]+", " ")).otherwise(text)


def words_of(text: Column) -> Column:
    """The words of text as an array; null text has none."""
    spaced = F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" "))
    return F.array_remove(F.split(let(spaced, single_blanks), " "), "")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(text, upper, upper.lower())


def has_word(text: Column) -> Column:
    """Whether text has a character outside white space."""
    return text.rlike(r"[^\x20\x09-\x0D]")


def ready_workers(spark: SparkSession, rows: int = 1000) -> None:
    """What Python workers need: this package, sent to them as a zip file once a session, and small
    Arrow batches, as whole texts may be very long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) not in range(1, rows + 1):
        spark.conf.set(key, str(rows))
    send_package(spark)


def slices(texts: list[str], limit: int) -> Iterator[tuple[int, int]]:
    """Runs [a, b) of texts with at most limit characters each, or one longer text."""
    a, held = 0, 0
    for i, t in enumerate(texts):
        if i > a and held + len(t) > limit:
            yield a, i
            a, held = i, 0
        held += len(t)
    if a < len(texts):
        yield a, len(texts)
