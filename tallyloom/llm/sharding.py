"""Sharding along a Hilbert curve, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import materialise

#: Places of one curve cell over which its rows are dealt before they are numbered: so many, or more with so many rows each.
PARTS, PART_ROWS = 256, 100_000
#: Largest table of curve positions that is kept as a literal.
MAX_CELLS = 1 << 15


def hilbert_positions(dims: int, bits: int) -> list[int]:
    """Position on the Hilbert curve of every cell of a dims-dimensional grid of side 2**bits.

    Cell (x0, x1, ...) has the number x0 << bits * (dims - 1) | x1 << ... . Follows the public
    transpose form: undo the excess work from the top bit down, then Gray-encode.
    """
    if dims < 1 or bits < 1 or dims * bits > MAX_CELLS.bit_length() - 1:
        raise ValueError("the grid must have between 2 and 2**15 cells")
    side, out = 1 << bits, []
    for cell in range(1 << dims * bits):
        x = [cell >> bits * (dims - 1 - d) & side - 1 for d in range(dims)]
        q = side >> 1
        while q > 1:
            for d in range(dims):
                if x[d] & q:
                    x[0] ^= q - 1
                else:
                    swap = (x[0] ^ x[d]) & q - 1
                    x[0] ^= swap
                    x[d] ^= swap
            q >>= 1
        for d in range(1, dims):
            x[d] ^= x[d - 1]
        flip, q = 0, side >> 1
        while q > 1:
            if x[-1] & q:
                flip ^= q - 1
            q >>= 1
        x = [v ^ flip for v in x]
        out.append(sum((x[d] >> b & 1) << b * dims + dims - 1 - d for b in range(bits) for d in range(dims)))
    return out


def log_bucket(size: Column, bits: int) -> Column:
    """An ordinal dimension on a log scale: its bit length less one, at most 2**bits - 1; null or below 1: 0."""
    return F.coalesce(
        F.when(size >= 1, F.least(F.length(F.bin(size)) - 1, F.lit((1 << bits) - 1))), F.lit(0)
    ).cast("int")


def rank_bounds(docs: DataFrame, names: list[str], bits: int) -> dict[str, list[tuple[int, str]]]:
    """For each nominal dimension (cell, least value of it), cells in order.

    A value's cell is the share of the rows with smaller values, in 2**bits steps: cells follow the
    order of the values and hold about as many rows each. Null counts as ''. Values are summed before
    the exchange and cut into ranges, each added up on its own; at most 2**bits values a dimension
    come to the driver.
    """
    pairs = F.array(*(F.struct(F.lit(n).alias("_dim"), F.coalesce(F.col(n).cast("string"), F.lit("")).alias("_value")) for n in names))
    values = docs.select(F.explode(pairs).alias("_x")).groupBy("_x").agg(F.count(F.lit(1)).alias("_n"))
    values = values.select("_x._dim", "_x._value", "_n").repartitionByRange("_dim", "_value").withColumn("_range", F.spark_partition_id())
    values = materialise(values, "values")
    sums = values.groupBy("_dim", "_range").agg(F.sum("_n").alias("_sum"))
    dim = Window.partitionBy("_dim")
    sums = sums.select(
        "_dim",
        "_range",
        (F.sum("_sum").over(dim.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum")).alias("_before"),
        F.sum("_sum").over(dim).alias("_total"),
    )
    inside = Window.partitionBy("_dim", "_range").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    placed = values.withColumn("_at", F.sum("_n").over(inside) - F.col("_n")).join(sums, ["_dim", "_range"])
    cells = placed.withColumn("_cell", F.expr(f"{1 << bits} * (_at + _before) div _total")).groupBy("_dim", "_cell").agg(F.min("_value").alias("_least"))
    out: dict[str, list[tuple[int, str]]] = {n: [] for n in names}
    for r in sorted(cells.collect()):
        out[r["_dim"]].append((int(r["_cell"]), r["_least"]))
    return out


def name_cell(name: Column, bounds: list[tuple[int, str]]) -> Column:
    """The cell of a value, by rank_bounds()."""
    value, cell = F.coalesce(name.cast("string"), F.lit("")), F.lit(0)
    for number, least in bounds:
        cell = F.when(value >= F.lit(least), F.lit(number)).otherwise(cell)
    return cell.cast("int")


def curve_index(dims: list[Column], bits: int) -> Column:
    """Hilbert position of quantised dims (each 0 to 2**bits - 1)."""
    cell = F.lit(0)
    for d in dims:
        cell = F.shiftleft(cell, bits).bitwiseOR(d)
    table = F.array(*map(F.lit, hilbert_positions(len(dims), bits)))
    return F.element_at(table, cell + 1)


def cut_runs(rows: DataFrame, curve: str, hashed: str, order: list[str], shards: int) -> DataFrame:
    """Number rows by (curve, salt, order) from 0 and cut the sequence into shards runs whose row
    counts differ by at most one; adds shard (int) and slot (long, gapless from 0 in each shard).

    Rows of one cell have no order among themselves, so they are dealt over salts by hashed, more of
    them for a larger cell: no task gets a whole cell, however many rows it has. The cells' sizes,
    which the grid bounds in number, are broadcast. Only counts a (cell, salt) are added up globally, first
    within cells and then over the cells, whose number is bounded by the grid.
    """
    salt = "_salt"
    parts = rows.groupBy(curve).agg(F.greatest(F.lit(PARTS), F.ceil(F.count(F.lit(1)) / PART_ROWS)).alias("_parts"))
    rows = rows.join(F.broadcast(parts), curve).withColumn(salt, F.pmod(F.col(hashed), F.col("_parts"))).drop("_parts", hashed)
    counts = rows.groupBy(curve, salt).agg(F.count(F.lit(1)).alias("_n"))
    cells = counts.groupBy(curve).agg(F.sum("_n").alias("_cell_n"))
    along = Window.orderBy(curve)
    cells = cells.select(
        curve,
        (F.sum("_cell_n").over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_cell_n")).alias("_cell_at"),
        F.sum("_cell_n").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"),
    )
    within = Window.partitionBy(curve).orderBy(salt).rowsBetween(Window.unboundedPreceding, 0)
    starts = (
        counts.withColumn("_at", F.sum("_n").over(within) - F.col("_n"))
        .join(cells, curve)
        .select(curve, salt, (F.col("_at") + F.col("_cell_at")).alias("_at"), "_total")
    )
    place = F.row_number().over(Window.partitionBy(curve, salt).orderBy(*order)) - 1
    total, n = F.col("_total"), F.lit(shards).cast("long")
    return (
        rows.withColumn("_place", place.cast("long"))
        .join(starts, [curve, salt])
        .withColumn("_g", F.col("_at") + F.col("_place"))
        .withColumn("shard", F.floor(F.expr(f"_g * {shards}L div _total")).cast("int"))
        .withColumn("slot", F.col("_g") - F.expr(f"(shard * _total + {shards - 1}L) div {shards}L"))
        .drop("_place", "_at", "_total", "_g", salt)
    )


def shard_documents(docs: DataFrame, shards: int = 8, bits: int = 4, carry: tuple[str, ...] = ()) -> DataFrame:
    """Shards of documents along a Hilbert curve over (source, lang, size).

    docs: doc_id, text, source and lang; further columns are ignored. Returns a row for each row
    of docs: doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null), curve (the
    Hilbert position), and the columns named in carry. Source and lang are quantised by rank, size by
    its logarithm, so that neighbouring cells hold neighbouring values, and a reader can prune
    shards by the bounds of each of the three (see shard_bounds).

    Null text has size 1 (no bytes, plus 1) and the CRC of no bytes; null source and lang count as
    ''; null doc_id sorts first; repeated rows keep a place each; an empty table gives no rows.
    Equal texts share size, but may lie in different cells if their source or lang differ.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("long") + 1
    bounds = rank_bounds(docs, ["source", "lang"], bits)
    dims = [name_cell(F.col("source"), bounds["source"]), name_cell(F.col("lang"), bounds["lang"]), log_bucket(size, bits)]
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    carried = F.struct(F.lit(0), *carry).alias("_carried")
    rows = docs.select(
        F.col("doc_id"),
        size.alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        curve_index(dims, bits).alias("curve"),
        F.conv(F.substring(digest, 1, 8), 16, 10).cast("long").alias("_hash"),
        carried,
    )
    rows = materialise(rows, "shards")
    cut = cut_runs(rows, "curve", "_hash", ["doc_id", "size", "text_crc32"], shards)
    return cut.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
        *(F.col("_carried")[c].alias(c) for c in carry),
    )


def shard_bounds(placed: DataFrame, columns: list[str]) -> DataFrame:
    """Of each shard its rows and the least and largest value of columns (min_*, max_*), by which a
    reader skips shards; nulls are left out, and counted as nulls_*."""
    return placed.groupBy("shard").agg(
        F.count(F.lit(1)).alias("rows"),
        *(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))),
        *(F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in columns),
    )
