"""Exact top-k inner products from an impact-ordered index, a score at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import materialise, ready_workers

#: Vectors in one block of the index, queries that meet it at once, and queries of one pass.
INDEX_ROWS, QUERY_ROWS, PASS_QUERIES = 4096, 256, 4096
#: Step of quantised impacts, and the least impacts of the posting segments that are taken together.
STEP = 4
SEGMENTS = (8, 4, 0)
#: Share of a block's pairs at or below which possible members are rescored without a further segment.
FEW = 0.01
#: Bounds are widened by this share of the largest possible score, against rounding in doubles.
ROUNDING = 1e-9


class ImpactIndex:
    """Posting segments of a block of integer vectors.

    The impact of a component is its size over STEP, rounded. A segment holds the postings (vector,
    dimension, signed impact) between two bounds; as dense vectors have a posting in every
    dimension, it is kept as a matrix that is zero elsewhere. For every number of segments
    processed, rest has the norm of what each vector's accumulator still lacks.
    """

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.vectors, self.ids = vectors, ids
        exact = vectors.astype(np.float64)
        impact = np.rint(exact / STEP)
        self.segments, self.rest = [], []
        above, done = np.inf, np.zeros_like(exact)
        for least in SEGMENTS:
            size = np.abs(impact)
            segment = np.where((size >= least) & (size < above), impact * STEP, 0.0)
            done += segment
            above = least
            self.segments.append(np.ascontiguousarray(segment.T))
            self.rest.append(np.sqrt(((exact - done) ** 2).sum(axis=1)))
        self.largest = float(np.abs(exact).max(initial=0.0))

    def possible(self, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, vector) places that may belong to the top k.

        Segments are added up by descending impact. What is left of a score is at most the norms'
        product (Cauchy-Schwarz); a vector stays possible while its upper bound reaches the k-th
        largest lower bound of the block and floor, the k-th exact score known from other blocks.
        """
        q = queries.astype(np.float64)
        norms = np.sqrt((q * q).sum(axis=1))
        slack = ROUNDING * (1.0 + self.largest * np.abs(q).sum(axis=1))
        scores = np.zeros((len(q), len(self.ids)))
        for segment, rest in zip(self.segments, self.rest, strict=True):
            scores += q @ segment
            width = norms[:, None] * rest[None, :] + slack[:, None]
            low = np.where(own, -np.inf, scores - width)
            least = floor
            if low.shape[1] >= k:
                least = np.maximum(floor, np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
            may = ~own & (scores + width >= least[:, None])
            if may.sum() <= FEW * may.size:
                break
        return np.nonzero(may)


class TopK:
    """Running exact top k of a set of queries."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.query = self.vector = self.score = np.zeros(0, dtype=np.int64)
        self.floor = np.full(len(ids), -np.inf)

    def add(self, index: ImpactIndex) -> None:
        top = int(np.abs(self.queries).max(initial=0))
        if top * index.largest * max(1, self.queries.shape[1]) >= 2**62:
            raise ValueError("an inner product may not fit into 64 bits")
        found = [(self.query, self.vector, self.score)]
        for at in range(0, len(self.ids), QUERY_ROWS):
            part = slice(at, at + QUERY_ROWS)
            own = self.ids[part, None] == index.ids[None, :]
            rows, columns = index.possible(self.queries[part], own, self.floor[part], self.k)
            for some in np.array_split(np.arange(len(rows)), len(rows) // 100_000 + 1):
                r, c = rows[some] + at, columns[some]
                exact = np.einsum("ij,ij->i", self.queries[r], index.vectors[c])
                found.append((r, index.ids[c], exact))
        query, vector, score = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((vector, -score, query))
        query, vector, score = query[order], vector[order], score[order]
        starts = np.r_[0, np.flatnonzero(np.diff(query)) + 1] if len(query) else np.zeros(0, dtype=np.int64)
        rank = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
        keep = rank < self.k
        self.query, self.vector, self.score = query[keep], vector[keep], score[keep]
        last = rank[keep] == self.k - 1
        self.floor[self.query[last]] = self.score[last]


def integer_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id and the integer vector floor(scale * x), without the rows that take no part."""
    return vectors.where(
        F.col("vec_id").isNotNull()
        & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    ).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")).alias("v"),
    )


def blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) blocks of at most INDEX_ROWS vectors of one length."""
    waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def joined(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([i for i, _ in parts]), np.concatenate([v for _, v in parts])

    for batch in batches:
        ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
        lists = batch.column("v")
        values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        sizes = np.diff(offsets)
        for n in np.unique(sizes):
            rows = np.flatnonzero(sizes == n)
            places = offsets[rows][:, None] + np.arange(n)[None, :]
            waiting.setdefault(int(n), []).append((ids[rows], values[places.astype(np.int64)].reshape(len(rows), int(n))))
            if sum(len(i) for i, _ in waiting[int(n)]) >= INDEX_ROWS:
                yield joined(waiting.pop(int(n)))
    for parts in waiting.values():
        yield joined(parts)


def top_k_pass(candidates: DataFrame, rows: list, k: int) -> DataFrame:
    """Top k of each task's candidates for a bounded set of queries: query_id, vec_id, score."""
    by_size: dict[int, list] = {}
    for r in rows:
        by_size.setdefault(len(r["v"]), []).append(r)
    sets = {
        n: (np.array([r["vec_id"] for r in some], dtype=np.int64), np.array([r["v"] for r in some], dtype=np.int64).reshape(len(some), n))
        for n, some in by_size.items()
    }
    shared = candidates.sparkSession.sparkContext.broadcast(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops = {n: TopK(ids, queries, k) for n, (ids, queries) in shared.value.items()}
        for ids, vectors in blocks_of(batches):
            if vectors.shape[1] in tops:
                tops[vectors.shape[1]].add(ImpactIndex(vectors, ids))
        for top in tops.values():
            yield pa.RecordBatch.from_arrays(
                [pa.array(top.ids[top.query]), pa.array(top.vector), pa.array(top.score)], ["query_id", "vec_id", "score"]
            )

    return candidates.mapInArrow(run, "query_id long, vec_id long, score long")


def exact_top_k(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """The k largest integer inner products of each query vector with all other vectors.

    vectors: vec_id, embedding (array of float or double); other columns are ignored. Queries are
    the rows whose vec_id is divisible by every, candidates all rows of another vec_id. Returns
    query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id; all candidates if fewer
    than k. Vectors that are null, or hold null or non-finite components, and rows without vec_id
    take no part; vectors of different lengths have no score; of repeated rows each counts; an
    empty table, or one without queries, gives no rows. Scores beyond 64 bits raise an error.

    Queries meet all rows in passes of about PASS_QUERIES, so what is sent to the tasks is bounded
    whatever the number of queries; each task keeps k rows a query.
    """
    ready_workers(vectors.sparkSession)
    rows = integer_vectors(vectors, scale)
    queries = rows.where(F.col("vec_id") % every == 0)
    passes = -(-queries.count() // PASS_QUERIES)
    found = None
    for n in range(max(1, passes)):
        some = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == n).collect() if passes > 1 else queries.collect()
        part = top_k_pass(rows, some, k)
        part = materialise(part, "top-k") if passes > 1 else part
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
