"""Near-duplicate documents: MinHash bands, sequential Bayesian verification, exact links, components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import materialise, ready_workers, salted_join, slices

#: Words in a shingle, and the least similarity of linked documents in hundredths.
SHINGLE, LEAST = 5, 75
#: Bands, and values in a band: two sets of similarity 0.75 share none with probability 8e-5.
BANDS, BAND_ROWS = 48, 6
VALUES = BANDS * BAND_ROWS
#: Signature values compared before each look at the posterior.
BATCH = 32
#: A pair is given up when the posterior probability of enough similarity is below this.
MISS = 1e-6
#: Characters of the texts that are hashed together, and bytes at a time.
CHUNK, PIECE = 1 << 20, 1 << 20
#: Members of a bucket up to which pairs are made as rows, and of one block of a larger bucket, and about
#: how many shingles a block has at most.
SMALL, BLOCK, BLOCK_SHINGLES = 16, 128, 1 << 20
#: Elements whose indicators are multiplied at once.
COLUMNS = 1 << 13

MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-stirred 64-bit form of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """Each byte with A-Z in lower case plus one, and whether it is white space."""
    low = np.arange(256, dtype=np.uint64)
    low[65:91] += np.uint64(32)
    blank = np.zeros(256, dtype=bool)
    blank[[32, *range(9, 14)]] = True
    return low + np.uint64(1), blank


@lru_cache(maxsize=1)
def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, modulo 2**64, below size."""
    inverse = pow(BASE, -1, 1 << 64)
    out = []
    for base in (BASE, inverse):
        p = np.full(size, base, dtype=np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


@lru_cache(maxsize=1)
def draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fixed odd multipliers and masks of the permutations, and multipliers of positions."""
    random = np.random.default_rng(20240229)
    return (
        random.integers(0, 1 << 32, VALUES, dtype=np.uint32) | np.uint32(1),
        random.integers(0, 1 << 32, VALUES, dtype=np.uint32),
        random.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
    )


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of data, and where each starts. Hashed PIECE bytes at a time; a word
    that goes on into the next piece is put together from its parts."""
    low, blank = byte_tables()
    up, down = powers(PIECE)
    raw = np.frombuffer(data, dtype=np.uint8)
    hashes, places, carry, carried, begun = [], [], np.uint64(0), 0, 0
    for at in range(0, len(raw), PIECE):
        part = raw[at : at + PIECE]
        edges = np.diff(blank[part].astype(np.int8), prepend=np.int8(1), append=np.int8(1))
        starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(low[part] * up[: len(part)], out=sums[1:])
        values = (sums[ends] - sums[starts]) * down[starts]
        starts_at = starts + at
        if carried:
            if len(starts) and starts[0] == 0:
                values[0] = np.uint64((int(carry) + int(values[0]) * pow(BASE, carried, 1 << 64)) % (1 << 64))
                starts_at[0] = begun
            else:
                hashes.append(np.array([carry], dtype=np.uint64))
                places.append(np.array([begun]))
        carried = 0
        if len(ends) and ends[-1] == len(part):
            carry, begun = values[-1], int(starts_at[-1])
            carried = at + len(part) - begun
            values, starts_at = values[:-1], starts_at[:-1]
        hashes.append(values)
        places.append(starts_at)
    if carried:
        hashes.append(np.array([carry], dtype=np.uint64))
        places.append(np.array([begun]))
    return mixed(np.concatenate([np.zeros(0, dtype=np.uint64), *hashes])), np.concatenate([np.zeros(0, dtype=np.int64), *places])


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted 64-bit hashes of each text's distinct shingles; fewer than SHINGLE words make one."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    bounds = np.cumsum([0] + [len(r) + 1 for r in raw])
    data = b"\n".join(raw)
    del raw
    words, starts = word_hashes(data)
    first = np.searchsorted(starts, bounds)
    _, _, places = draws()
    windows = np.zeros(max(0, len(words) - SHINGLE + 1), dtype=np.uint64)
    for k in range(SHINGLE):
        windows += words[k : k + len(windows)] * places[k]
    windows = mixed(windows)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            got = np.sort(windows[a : b - SHINGLE + 1])
            out.append(got[np.r_[True, got[1:] != got[:-1]]])
        elif b > a:
            one = (words[a:b] * places[8 : 8 + b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
            out.append(mixed(np.array([one])))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(16-bit signature values, 64-bit band hashes) of each of the sets, none of which is empty."""
    multipliers, masks, places = draws()
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    every = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    least = np.empty((VALUES, len(sets)), dtype=np.uint32)
    buffer = np.empty_like(every)
    for k in range(VALUES):
        np.bitwise_xor(every, masks[k], out=buffer)
        np.multiply(buffer, multipliers[k], out=buffer)
        np.minimum.reduceat(buffer, starts, out=least[k])
    short = ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)
    bands = np.zeros((BANDS, len(sets)), dtype=np.uint64)
    rows = least.reshape(BANDS, BAND_ROWS, len(sets))
    for r in range(BAND_ROWS):
        bands = mixed(bands + rows[:, r].astype(np.uint64) * places[r])
    bands = mixed(bands + np.arange(BANDS, dtype=np.uint64)[:, None])
    return np.ascontiguousarray(short.T), np.ascontiguousarray(bands.T.view(np.int64))


def fingerprint(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return np.array([mixed(shingles + MIX2).sum(dtype=np.uint64), mixed(shingles ^ MIX1).sum(dtype=np.uint64)]).tobytes()


@lru_cache(maxsize=1)
def least_matches() -> tuple[tuple[int, int], ...]:
    """(values compared, matches below which a pair is given up), batch by batch.

    With a uniform prior, the posterior of the similarity after m matches of n is Beta(m + 1, n - m + 1);
    that it is at least LEAST has the probability of at most m successes in n + 1 trials of that chance.
    """
    out = []
    for n in range(BATCH, VALUES + 1, BATCH):
        chance, total, m = LEAST / 100, 0.0, -1
        while total < MISS and m < n:
            m += 1
            total += math.comb(n + 1, m) * chance**m * (1 - chance) ** (n + 1 - m)
        out.append((n, m))
    return tuple(out)


def surviving(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of two signature matrices may be similar enough, looked at batch by batch."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), dtype=np.int64)
    before = 0
    for n, least in least_matches():
        matches[alive] += (a[alive, before:n] == b[alive, before:n]).sum(axis=1)
        alive = alive[matches[alive] >= least]
        before = n
        if not len(alive):
            break
    return alive


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have 100 * intersection >= LEAST * union."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= LEAST * (len(a) + len(b) - both)


def document_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class (fingerprint of the set), signature and bands of every document."""
    ready_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in slices(texts, CHUNK):
                sets = shingle_sets(texts[a:b])
                some = [i for i, s in enumerate(sets) if len(s)]
                short, bands = signatures([sets[i] for i in some]) if some else ((), ())
                values: list = [None] * len(sets)
                hashes: list = [None] * len(sets)
                for k, i in enumerate(some):
                    values[i], hashes[i] = short[k].tobytes(), bands[k]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, b - a),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([fingerprint(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array(values, pa.binary()),
                        pa.array(hashes, pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "class", "signature", "bands"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_shingles long, class binary, signature binary, bands array<long>")


def bayes_survivors(pairs: DataFrame, signatures_of: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures don't rule enough similarity out."""
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            both = [np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, VALUES) for c in ("sa", "sb")]
            alive = pa.array(surviving(*both), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(alive), batch.column("b").take(alive)], ["a", "b"])

    signed = pairs
    for side, other in (("b", "a"), ("a", "b")):
        weights = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("_weight"))
        own = signatures_of.select(F.col("rep").alias(side), F.col("signature").alias(f"s{side}"))
        signed = salted_join(signed, own, [side], weights, F.xxhash64(other, F.lit(7)))
    return signed.select("a", "b", "sa", "sb").mapInArrow(run, f"a {kind}, b {kind}")


def exact_links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar enough on their full shingle sets."""
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("ta").to_pylist(), batch.column("tb").to_pylist()
            known: dict[str, np.ndarray] = {}
            new = list(dict.fromkeys([*left, *right]))
            for a, b in slices(new, CHUNK):
                known.update(zip(new[a:b], shingle_sets(new[a:b]), strict=True))
            linked = pa.array([i for i, (x, y) in enumerate(zip(left, right, strict=True)) if similar(known[x], known[y])], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a").take(linked), batch.column("b").take(linked)], ["a", "b"])

    for side, other in (("b", "a"), ("a", "b")):
        weights = pairs.groupBy(side).agg(F.count(F.lit(1)).alias("_weight"))
        owned = texts.select(F.col("rep").alias(side), F.col("text").alias(f"t{side}"))
        worded = salted_join(pairs if side == "b" else worded, owned, [side], weights, F.xxhash64(other, F.lit(3)))
    return worded.select("a", "b", "ta", "tb").mapInArrow(run, f"a {kind}, b {kind}")


def short_forms(texts: DataFrame) -> DataFrame:
    """(rep, form): a text's signature and its shingles' hashes, in order."""
    kind = texts.schema["rep"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text").to_pylist()
            for a, b in slices(text, CHUNK):
                sets = shingle_sets(text[a:b])
                some = [i for i, s in enumerate(sets) if len(s)]
                short = signatures([sets[i] for i in some])[0] if some else ()
                forms = [sig.tobytes() + sets[i].tobytes() for sig, i in zip(short, some, strict=True)]
                reps = batch.column("rep").slice(a, b - a).take(pa.array(some, pa.int64()))
                yield pa.RecordBatch.from_arrays([reps, pa.array(forms, pa.binary())], ["rep", "form"])

    return texts.select("rep", "text").mapInArrow(run, f"rep {kind}, form binary")


def shared_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many elements each of the sets a shares with each of the sets b, by products of indicators."""
    words, place = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    owner = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in [*a, *b]])
    out = np.zeros((len(a), len(b)), dtype=np.float64)
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    for low in range(0, len(words), COLUMNS):
        x, y = np.searchsorted(place, (low, low + COLUMNS))
        has = np.zeros((len(a) + len(b), min(COLUMNS, len(words) - low)), dtype=np.float32)
        has[owner[x:y], place[x:y] - low] = 1
        out += has[: len(a)] @ has[len(a) :].T
    return out


def block_survivors(blocks: DataFrame) -> DataFrame:
    """The pairs (a, b) of an outer and an inner block in different components that signatures don't
    rule out and that are similar enough on their full sets. No pair becomes a row before that."""
    kind = blocks.schema["outer"].dataType.elementType["rep"].dataType.simpleString()
    head = VALUES * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for outer, inner in zip(batch.column("outer").to_pylist(), batch.column("inner").to_pylist(), strict=True):
                both = [np.frombuffer(b"".join(x["form"][:head] for x in side), dtype=np.uint16).reshape(-1, VALUES) for side in (outer, inner)]
                sets = [[np.frombuffer(x["form"], dtype=np.uint64, offset=head) for x in side] for side in (outer, inner)]
                sizes = [np.array([len(x) for x in side]) for side in sets]
                parts = [np.array([x["component"] for x in side]) for side in (outer, inner)]
                fits = np.minimum.outer(*sizes) * 100 >= np.maximum.outer(*sizes) * LEAST
                i, j = np.nonzero(fits & (parts[0][:, None] != parts[1][None, :]))
                alive = surviving(both[0][i], both[1][j])
                if not len(alive):
                    continue
                i, j = i[alive], j[alive]
                both = shared_counts(*sets)[i, j]
                likely = 100 * both >= LEAST * (sizes[0][i] + sizes[1][j] - both)
                left += [outer[k]["rep"] for k in i[likely]]
                right += [inner[k]["rep"] for k in j[likely]]
            yield pa.RecordBatch.from_arrays([pa.array(left, batch.schema.field("outer").type.value_type.field("rep").type), pa.array(right, batch.schema.field("outer").type.value_type.field("rep").type)], ["x", "y"])

    found = blocks.select("outer", "inner").mapInArrow(run, f"x {kind}, y {kind}")
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of the links (a, b) reaches.

    Large-star and small-star steps in turn: every node hands its larger, then its smaller,
    neighbours to the smallest one, until all are stars. A node's smallest neighbour is a minimum
    summed before the exchange, and the links of a node with very many are dealt over salts to meet it.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        """edges: (u, v) with u > v, each pair once."""
        if large:
            both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        else:
            both = edges
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("_m"), F.count(F.lit(1)).alias("_weight")), "least")
        moved = salted_join(both, least.select("u", "_m"), ["u"], least.select("u", "_weight"), F.xxhash64("v"))
        if large:
            moved = moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("_m").alias("v"))
        else:
            moved = moved.select(F.col("v").alias("u"), F.col("_m").alias("v")).unionByName(least.select("u", F.col("_m").alias("v")))
        return moved.where(F.col("u") != F.col("v")).distinct()

    edges = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialise(edges, "edges")

    def settled(e: DataFrame) -> bool:
        """Whether every node has one edge, to a node without one. A star's edges are one row before they
        meet others."""
        most = e.groupBy("u").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
        return (most or 0) <= 1 and e.select("v").distinct().join(e.select(F.col("u").alias("v")), "v", "left_semi").isEmpty()

    while not settled(edges):
        edges = materialise(star(star(edges, True), False), "edges")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def ordered_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs (x, y) of sizes (nx, ny) that may be similar by their sizes, as distinct (a, b) with a < b."""
    fits = F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * LEAST
    return (
        pairs.where((F.col("x") != F.col("y")) & fits)
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .distinct()
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Link documents whose sets of five-word shingles have a Jaccard similarity of 0.75 or more.

    docs: doc_id, text; other columns are ignored. Words are lower-cased (A-Z) runs outside white
    space. Returns a row for each row: doc_id, n_shingles, component_id (smallest doc_id reachable),
    kept. Fewer than five words are one shingle; null or wordless text has none and is linked with
    nothing; rows of one doc_id count as one document; a row without doc_id gets the component of
    its set's class, null if no other row has it, and is kept only then; an empty table gives none.

    Documents of equal sets are one class from the start, by a minimum summed before the exchange.
    In each band's bucket every class is compared with one leader, drawn anew for each bucket; what
    is linked then needs no further pair. Only classes of a bucket that are still in different
    components are compared with each other: as pairs in small buckets, and block by block in large
    ones, where those outside the bucket's main component meet all the others in memory. Pairs are
    tested on signatures, batch by batch, then exactly. So a bucket of m copies of one text costs m
    pairs, and no link between components is lost but by the bands (8e-5 at similarity 0.75, less
    above) and by MISS.
    """
    sets = materialise(document_sets(docs), "sets")
    classes = (
        sets.where(F.col("class").isNotNull())
        .groupBy("class")
        .agg(
            F.min("doc_id").alias("rep"),
            F.first("n_shingles").alias("n"),
            F.first("signature").alias("signature"),
            F.first("bands").alias("bands"),
            F.count(F.lit(1)).alias("_weight"),
        )
    )
    classes = materialise(classes, "classes")
    reps = classes.where(F.col("rep").isNotNull())
    members = reps.select("rep", "n", F.explode("bands").alias("bucket"))
    place = F.xxhash64("rep", "bucket")
    leaders = (
        members.groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("_size"), F.min(F.struct(place.alias("_place"), F.col("rep").alias("y"), F.col("n").alias("ny"))).alias("_l"))
        .where(F.col("_size") > 1)
        .select("bucket", "_l.y", "_l.ny", F.col("_size").alias("_weight"))
    )
    leaders = materialise(leaders, "leaders")
    met = salted_join(members, leaders.drop("_weight"), ["bucket"], leaders.select("bucket", "_weight"), F.xxhash64("rep", F.lit(5)))
    met = materialise(met, "buckets")
    first = materialise(ordered_pairs(met.select(F.col("rep").alias("x"), F.col("n").alias("nx"), "y", "ny")), "pairs")
    involved = met.select(F.col("rep").alias("doc_id")).distinct()
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(involved, "doc_id", "left_semi")
    texts = materialise(texts.withColumnRenamed("doc_id", "rep"), "texts")
    links = materialise(exact_links(materialise(bayes_survivors(first, reps), "survivors"), texts), "links")
    found = components(links)

    placed = met.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "bucket", "rep", "n", F.coalesce("component", "rep").alias("component")
    )
    placed = materialise(placed, "placed")
    shares = placed.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("_n"), F.sum("n").alias("_shingles"))
    home = (
        shares.groupBy("bucket")
        .agg(F.sum("_n").alias("_size"), F.sum("_shingles").alias("_shingles"), F.count(F.lit(1)).alias("_parts"), F.max(F.struct("_n", "component")).alias("_home"))
        .where(F.col("_parts") > 1)
        .select("bucket", "_size", "_shingles", (F.col("_size") - F.col("_home")["_n"]).alias("_away"), F.col("_home")["component"].alias("_home"))
    )
    home = materialise(home, "homes")
    sizes = home.select("bucket", F.col("_size").alias("_weight"))
    mixed_buckets = materialise(salted_join(placed, home, ["bucket"], sizes, F.xxhash64("rep", F.lit(5))), "mixed")
    away = F.col("component") != F.col("_home")

    small = mixed_buckets.where(F.col("_size") <= SMALL)
    outer = small.where(away).select("bucket", F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("component").alias("_cx"))
    inner = small.select("bucket", F.col("rep").alias("y"), F.col("n").alias("ny"), F.col("component").alias("_cy"))
    second = ordered_pairs(outer.join(inner, "bucket").where(F.col("_cx") != F.col("_cy"))).join(first, ["a", "b"], "left_anti")

    large = mixed_buckets.where(F.col("_size") > SMALL)
    forms = materialise(short_forms(texts.join(large.select("rep").distinct(), "rep", "left_semi")), "forms")
    inner_blocks, outer_blocks = (F.ceil(F.greatest(F.col(c) / BLOCK, F.col("_shingles") / BLOCK_SHINGLES)).cast("int") for c in ("_size", "_away"))
    place = F.xxhash64("rep", F.lit(1))
    rows = large.join(forms, "rep").select(
        "bucket", away.alias("_out"), F.struct("rep", "component", "form").alias("_m"), inner_blocks.alias("_ni"), outer_blocks.alias("_no"),
        F.pmod(place, inner_blocks).cast("int").alias("_i"), F.pmod(place, outer_blocks).cast("int").alias("_o"),
    )
    as_inner = rows.select("bucket", "_i", F.explode(F.sequence(F.lit(0), F.col("_no") - 1)).alias("_o"), "_m", F.lit(False).alias("_out"))
    as_outer = rows.where("_out").select("bucket", F.explode(F.sequence(F.lit(0), F.col("_ni") - 1)).alias("_i"), "_o", "_m", "_out")
    blocks = (
        as_inner.unionByName(as_outer)
        .groupBy("bucket", "_i", "_o")
        .agg(F.collect_list(F.when(F.col("_out"), F.col("_m"))).alias("outer"), F.collect_list(F.when(~F.col("_out"), F.col("_m"))).alias("inner"))
        .where((F.size("outer") > 0) & (F.size("inner") > 0))
    )

    sure = block_survivors(blocks)
    more = materialise(exact_links(materialise(bayes_survivors(second, reps), "survivors"), texts).unionByName(sure).distinct(), "links")
    found = components(links.unionByName(more)) if not more.isEmpty() else found

    named = classes.select("class", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    named = named.select("class", F.coalesce("component", "rep").alias("component_id"))
    rows = sets.select("doc_id", "n_shingles", "class")
    worded = salted_join(rows.where("class is not null"), named, ["class"], classes.select("class", "_weight"), F.xxhash64("doc_id", F.lit(9)))
    wordless = rows.where("class is null").withColumn("component_id", F.col("doc_id"))
    return worded.unionByName(wordless).select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept")
    )
