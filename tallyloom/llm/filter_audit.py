"""How corpus filters overlap: failure masks of every document, counted for every order of the filters."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import materialise, ready_workers, salted_join

#: The filters by letter; the last one, of identical texts, is decided by sorting.
FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")

MIN_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
CAPITALS = bytes(range(65, 91))
SYMBOLS = re.compile(r"[#$%&*|]")


def text_mask(text: str) -> int:
    """Bits of the filters A to D that a text fails; the words of bytes.split are the contract's."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n = len(words)
    return (
        (n < MIN_WORDS)
        | (100 * len(set(words)) < LEAST_DISTINCT * n) << 1
        | (100 * (len(data) - len(data.translate(None, CAPITALS))) > MOST_CAPITALS * len(text)) << 2
        | (SYMBOLS.search(text) is not None) << 3
    )


def failure_masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of every row of docs: the filters that it fails as bits, A the lowest.

    docs: doc_id, text, source; other columns are ignored. Texts are sorted by a range partitioning of
    fingerprint and doc_id, so copies of one text may fill many tasks, and inside a task by fingerprint,
    text and doc_id, so that a row is compared with the row before. Rows of a task's first fingerprint
    wait: the run may have begun in another task. They and the last runs of all tasks say which doc_id
    a text has least, a minimum of few rows, and are then decided by it.

    Null text is empty, null source an empty part. A row without doc_id has no smaller one and is
    smaller than none; rows of one doc_id with one text do not fail for each other; an empty table
    gives no rows.
    """
    ready_workers(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("part"))
    rows = rows.withColumn("print", F.xxhash64("text"))
    ordered = rows.repartitionByRange("print", "doc_id").sortWithinPartitions("print", "text", "doc_id")

    def digest(text: str) -> bytes:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = before = None
        runs: list[list] = []  # [text, mask, least doc_id, digest if it waits] of the present fingerprint's texts
        kind = None
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            masks, waits = [], []
            for print_, text, doc_id in zip(*(batch.column(c).to_pylist() for c in ("print", "text", "doc_id")), strict=True):
                first = print_ if before is None else first
                if print_ != before:
                    runs, before = [], print_
                if not runs or runs[-1][0] != text:
                    runs.append([text, text_mask(text), None, digest(text) if print_ == first else None])
                _, mask, least, wait = own = runs[-1]
                if least is None:
                    own[2] = doc_id
                elif wait is None and doc_id > least:
                    mask |= DUPLICATE
                masks.append(mask)
                waits.append(wait)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("part"), pa.array(masks, pa.int32()), pa.array(waits, pa.binary())], ["doc_id", "part", "mask", "wait"]
            )
        if runs and before != first:
            none = [None] * len(runs)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[2] for r in runs], kind), pa.array(none, pa.string()), pa.array(none, pa.int32()), pa.array([digest(r[0]) for r in runs], pa.binary())],
                ["doc_id", "part", "mask", "wait"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    told = materialise(ordered.select("print", "text", "doc_id", "part").mapInArrow(run, f"doc_id {kind}, part string, mask int, wait binary"), "masks")
    edges = materialise(told.where("wait is not null").groupBy("wait").agg(F.min("doc_id").alias("_least"), F.count(F.lit(1)).alias("_weight")), "edges")
    waiting = told.where("wait is not null and mask is not null")
    settled = salted_join(waiting, edges.select("wait", "_least"), ["wait"], edges.select("wait", "_weight"), F.xxhash64("doc_id"))
    late = F.when(F.col("doc_id") > F.col("_least"), F.lit(DUPLICATE)).otherwise(F.lit(0))
    return told.where("wait is null").select("doc_id", "part", "mask").unionByName(settled.select("doc_id", "part", F.col("mask").bitwiseOR(late).alias("mask")))


def part_counters(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents, and those labelled quality=1 and toxic=1, of each mask.

    The counters add up over parts and over tables. A doc_id with several labels has any of them.
    Rows are summed by doc_id before they meet the labels, so repeated ids cost no more.
    """
    told = labels.where("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("long")).alias("_good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("long")).alias("_toxic")
    )
    few = masks.groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("_n"))
    return (
        few.join(told, "doc_id", "left")
        .groupBy("part", "mask")
        .agg(F.sum("_n").alias("n"), F.sum(F.col("_n") * F.coalesce("_good", F.lit(0))).alias("good"), F.sum(F.col("_n") * F.coalesce("_toxic", F.lit(0))).alias("toxic"))
    )


def every_order(counters: DataFrame) -> DataFrame:
    """What each step of each order of the filters keeps, removes and loses, from counters by mask.

    A part has at most 2 ** 5 counters; each order's step is a sum over those. shapley is the filter's
    removals summed over all orders: a document that fails k filters falls to each of them in 1/k of
    the orders.
    """
    steps = []
    for order in permutations(FILTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << FILTERS.index(letter)
            steps.append({"filter_order": "".join(order), "step": step, "bit": bit, "before": before})
            before |= bit
    cells = counters.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("_cells"))
    rows = cells.select("part", "_cells", F.explode(F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,bit:int,before:int>>")).alias("_s")).select("part", "_cells", "_s.*")

    def total(value: Callable[[Column], Column], holds: Callable[[Column], Column]) -> Column:
        return F.aggregate("_cells", F.lit(0).cast("long"), lambda s, c: s + F.when(holds(c["mask"]), value(c)).otherwise(F.lit(0)))

    def fails(mask: Column) -> Column:
        return mask.bitwiseAND(F.col("bit")) != 0

    def fresh(mask: Column) -> Column:
        return mask.bitwiseAND(F.col("before")) == 0

    def removed(mask: Column) -> Column:
        return fails(mask) & fresh(mask)

    orders = factorial(len(FILTERS))
    return rows.select(
        "part",
        "filter_order",
        "step",
        total(lambda c: c["n"], lambda m: fresh(m) & ~fails(m)).alias("kept"),
        total(lambda c: c["n"], removed).alias("removed"),
        total(lambda c: c["n"], lambda m: fails(m) & ~fresh(m)).alias("redundant"),
        total(lambda c: c["n"], lambda m: m == F.col("bit")).alias("unique_fails"),
        total(lambda c: c["good"], removed).alias("good_lost"),
        total(lambda c: c["toxic"], removed).alias("toxic_lost"),
        total(lambda c: c["n"] * (F.lit(orders) / F.bit_count(c["mask"])).cast("long"), fails).alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interaction of the five filters in every part (source): see failure_masks, part_counters and every_order.

    Returns part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and
    shapley, a row for each part and each of the five steps of the 120 orders, zeros included.
    """
    return every_order(part_counters(failure_masks(docs), labels))
