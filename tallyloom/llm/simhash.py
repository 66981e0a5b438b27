"""SimHash near-duplicates: fingerprints of word shingles, joined by a binary trie with a Hamming budget."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import materialise, ready_workers, salted_join
from tallyloom.llm.near_duplicates import components

#: Words in a shingle, the hash's seed, and the differing bits up to which fingerprints are linked.
SHINGLE, SEED, BUDGET = 3, 42, 3
#: Of BUDGET + 1 blocks of a fingerprint two linked ones share one at least.
BLOCKS = BUDGET + 1
BLOCK_BITS = 64 // BLOCKS
#: Bytes of a text whose words are taken at once.
PIECE = 1 << 20
#: Fingerprints of a trie that one task holds at least and at most; parts of all between.
FEW, MANY, PARTS = 1 << 10, 1 << 16, 1000
#: Fingerprints joined at once, node pairs of a step, and pairs of fingerprints below which a pair of nodes is not split further.
TOGETHER, WIDTH, LEAF = 1 << 17, 1 << 16, 32

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
BLANK = re.compile(rb"[\x20\x09-\x0D]")


def shingle_hashes(text: str) -> Iterator[np.ndarray]:
    """XXH64 of a text's shingles with repeats, a run at a time; fewer words than SHINGLE make one."""
    data = text.encode("utf-8", "surrogatepass").translate(LOWER)
    digest, words, at, some = xxhash.xxh64_intdigest, [], 0, False
    while at < len(data):
        cut = BLANK.search(data, at + PIECE)
        end = cut.start() if cut else len(data)
        words = words[1 - SHINGLE :] + data[at:end].split()
        at = end
        if len(words) < SHINGLE:
            continue
        some = True
        flat = b" ".join(words)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: 1 - SHINGLE].tolist()
        found = [digest(flat[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)]
        yield np.array(found, dtype=np.uint64)
    if words and not some:
        yield np.array([digest(b" ".join(words), SEED)], dtype=np.uint64)


def fingerprint(text: str) -> int:
    """The bits that over half of the shingles' hashes have, as a signed 64-bit number; 0 without words."""
    counts, n = np.zeros(64, dtype=np.int64), 0
    for hashes in shingle_hashes(text):
        n += len(hashes)
        padded = np.zeros(-(-len(hashes) // 255) * 255, dtype="<u8")
        padded[: len(hashes)] = hashes
        bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 255, 8), axis=2, bitorder="little")
        counts += bits.sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0]) if n else 0


def document_prints(docs: DataFrame) -> DataFrame:
    """(doc_id, print) of every row."""
    ready_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints, pa.int64())], ["doc_id", "print"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, print long")


def trie_pairs(values: np.ndarray, roots: tuple[np.ndarray, ...], depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of values that differ by at most BUDGET bits, from pairs of nodes of binary tries.

    values: 64-bit numbers, sorted inside each node. A node of depth d is a range of values that share
    their first d bits. roots: (a0, a1, b0, b1), ranges of pairs of nodes of this depth that agree so far; equal
    ranges are joined with themselves, and i < j there. All pairs of nodes go down together, a bit a
    step: children of the same bit keep their error, others add one, and a pair over the budget is gone.
    Small pairs of nodes are compared in full. Wide steps are cut, so memory is bounded.
    """
    ones: dict[int, np.ndarray] = {}
    stack = [(depth, *roots, np.zeros(len(roots[0]), dtype=np.int8))]
    while stack:
        depth, a0, a1, b0, b1, error = stack.pop()
        if len(a0) > WIDTH:
            stack += [(depth, *(x[s : s + WIDTH] for x in (a0, a1, b0, b1, error))) for s in range(0, len(a0), WIDTH)]
            continue
        size = (a1 - a0) * (b1 - b0)
        small = (size <= LEAF) | (depth == 64)
        if small.any():
            count = size[small]
            owner = np.repeat(np.flatnonzero(small), count)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            wide = (b1 - b0)[owner]
            i, j = a0[owner] + place // wide, b0[owner] + place % wide
            near = (np.bitwise_count(values[i] ^ values[j]) <= BUDGET) & ((a0 != b0)[owner] | (i < j))
            if near.any():
                yield i[near], j[near]
        if small.all():
            continue
        a0, a1, b0, b1, error = (x[~small] for x in (a0, a1, b0, b1, error))
        if depth not in ones:
            ones[depth] = np.concatenate([[0], np.cumsum((values >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)])
        total = ones[depth]
        am, bm = a1 - (total[a1] - total[a0]), b1 - (total[b1] - total[b0])
        same = a0 == b0
        children = [
            (a0, am, b0, bm, error, np.ones(len(a0), dtype=bool)),
            (am, a1, bm, b1, error, np.ones(len(a0), dtype=bool)),
            (a0, am, bm, b1, error + 1, error < BUDGET),
            (am, a1, b0, bm, error + 1, (error < BUDGET) & ~same),
        ]
        kept = [[x[wanted & (c0 < c1) & (d0 < d1)] for x in (c0, c1, d0, d1, e)] for c0, c1, d0, d1, e, wanted in children]
        stack.append((depth + 1, *(np.concatenate(x) for x in zip(*kept, strict=True))))


def joined_roots(pairs: Iterator[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """The least place that each of n places reaches by the pairs, a batch of which is let go at once."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            x, y = root[i], root[j]
            open_ = x != y
            if not open_.any():
                break
            i, j, x, y = i[open_], j[open_], x[open_], y[open_]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := root[root], root):
                root = up
    return root


def trie_links(cells: DataFrame) -> DataFrame:
    """Links (a, b) that join the fingerprints of each cell as those within the budget do.

    cells: rotation, block, cell, side (0: joined with itself; 1 and 2: with each other) and value, a
    fingerprint turned so that its shared block leads. A cell of m fingerprints gives fewer than m links: the
    pairs inside a dense group are joined as they are found and never become rows.
    """
    order = ["rotation", "block", "cell", "side", "value"]
    dealt = cells.repartition("rotation", "block", "cell").sortWithinPartitions(*order)

    def links(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        rotation, block, cell, side, value = (np.concatenate(x) for x in zip(*parts, strict=True))
        values = value.astype(np.int64).view(np.uint64)
        new = np.flatnonzero(np.r_[True, (rotation[1:] != rotation[:-1]) | (block[1:] != block[:-1]) | (cell[1:] != cell[:-1]) | (side[1:] != side[:-1])])
        end = np.r_[new[1:], len(values)]
        alone = side[new] == 0
        pair = np.flatnonzero((side[new][:-1] == 1) & (side[new][1:] == 2) & (cell[new][:-1] == cell[new][1:]) & (block[new][:-1] == block[new][1:]) & (rotation[new][:-1] == rotation[new][1:]))
        roots = tuple(np.r_[x[alone], y] for x, y in ((new, new[pair]), (end, end[pair]), (new, new[pair + 1]), (end, end[pair + 1])))
        root = joined_roots(trie_pairs(values, roots, BLOCK_BITS), len(values))
        linked = np.flatnonzero(root != np.arange(len(root)))
        turn = (BLOCK_BITS * rotation).astype(np.uint64)
        back = np.where(turn == 0, values, (values >> turn) | (values << (np.uint64(64) - turn) % np.uint64(64)))
        both = [pa.array(back[x].view(np.int64), pa.int64()) for x in (linked, root[linked])]
        return pa.RecordBatch.from_arrays(both, ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in order]
            if not batch.num_rows:
                continue
            if n >= TOGETHER:  # up to the last change of cell, which may be in what is held
                change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in columns[:3]], axis=0))
                cut = 0 if any(x[0] != y[-1] for x, y in zip(columns[:3], held[-1][:3], strict=True)) else int(change[0]) + 1 if len(change) else None
                if cut is not None:
                    yield links([*held, [x[:cut] for x in columns]])
                    held, n, columns = [], 0, [x[cut:] for x in columns]
            held.append(columns)
            n += len(columns[0])
        if held:
            yield links(held)

    return dealt.select(*order).mapInArrow(run, "a long, b long")


def near_prints(docs: DataFrame) -> DataFrame:
    """SimHash fingerprints of documents, linked at BUDGET or fewer differing bits.

    docs: doc_id, text; other columns are ignored. Words are lower-cased (A-Z) runs outside white space;
    shingles of three words count with their repeats; fewer words are one shingle; null or wordless
    text has fingerprint zero and is linked like any other. Returns a row for each row: doc_id,
    fingerprint (16 hex digits) and component_id, the smallest doc_id reachable. A row without doc_id has
    its component's, null if no row there has one; repeated rows get a row each; an empty table gives
    none.

    Equal fingerprints are one from the start. Two linked ones share one of four blocks of 16 bits, so
    the self-join of the trie falls apart into the subtries of a shared block, one for each rotation that
    brings a block to the front. A subtrie with many fingerprints is dealt over chunks by hash, and
    every pair of chunks is a cell of its own, so no task has more than two chunks of it.
    """
    prints = materialise(document_prints(docs), "prints")
    classes = materialise(prints.groupBy("print").agg(F.min("doc_id").alias("_least"), F.count(F.lit(1)).alias("_weight")), "classes")
    chunk = min(max(classes.count() * BLOCKS // PARTS, FEW), MANY)
    turns = [F.lit(0).alias("rotation"), F.col("print").alias("value")], *(
        [F.lit(r).alias("rotation"), F.shiftleft("print", BLOCK_BITS * r).bitwiseOR(F.shiftrightunsigned("print", 64 - BLOCK_BITS * r)).alias("value")]
        for r in range(1, BLOCKS)
    )
    turned = classes.select(F.explode(F.array(*(F.struct(*t) for t in turns))).alias("_t")).select("_t.*")
    turned = turned.withColumn("block", F.shiftrightunsigned("value", 64 - BLOCK_BITS))
    sizes = turned.groupBy("rotation", "block").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    large = sizes.where(F.col("_n") > chunk).select("rotation", "block", F.ceil(F.col("_n") / chunk).cast("int").alias("_chunks"))
    large = F.broadcast(materialise(large, "large"))  # at most BLOCKS * 2 ** BLOCK_BITS rows
    placed = turned.join(large, ["rotation", "block"], "left").withColumn("_chunks", F.coalesce("_chunks", F.lit(1)))
    own = F.pmod(F.xxhash64("value", F.lit(1)), F.col("_chunks")).cast("int")
    met = placed.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    cells = met.select(
        "rotation",
        "block",
        (F.least("_own", "_other").cast("long") * F.col("_chunks") + F.greatest("_own", "_other")).alias("cell"),
        F.when(F.col("_own") == F.col("_other"), 0).when(F.col("_own") < F.col("_other"), 1).otherwise(2).alias("side"),
        "value",
    )
    found = components(materialise(trie_links(cells), "links"))
    named = classes.join(found.withColumnRenamed("node", "print"), "print", "left").select("print", "_least", "_weight", F.coalesce("component", "print").alias("component"))
    named = materialise(named, "named")
    firsts = materialise(named.groupBy("component").agg(F.min("_least").alias("component_id"), F.count(F.lit(1)).alias("_weight")), "firsts")
    named = salted_join(named.select("print", "component"), firsts.drop("_weight"), ["component"], firsts.select("component", "_weight"), F.xxhash64("print"))
    told = salted_join(prints, named.select("print", "component_id"), ["print"], classes.select("print", "_weight"), F.xxhash64("doc_id"))
    return told.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
