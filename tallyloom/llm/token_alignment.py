"""Two tokenizers' tokens aligned on bytes, and how often their ids meet in the corpus."""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyloom.llm.common import materialise, ready_workers, slices

#: Characters of the texts that are aligned together.
CHUNK = 1 << 22
#: Pairs of ids a task sums up before it hands them on, and contributions to documents summed at once.
PAIRS, SUMS = 1 << 21, 1 << 22
#: Groups of B ids, which bound the rows a text has before its sums; cells that all groups are cut into at
#: least, and postings (pairs of a text) of a cell at most, about.
GROUPS, CELLS, POSTINGS = 32, 512, 1 << 22
#: Texts of these characters only are split into words alike by both libraries whatever their Unicode version.
PLAIN = re.compile("[\x00-ɏ‐-‧]*")
#: The splitting pattern of the byte-level tokenizer. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "▁"


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones stand for
    themselves, the others are numbered from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Side:
    """A tokenizer with the bytes of its ids: raw by id, and their lengths."""

    def __init__(self, raw: list[bytes]):
        self.raw = raw
        self.lengths = np.array([len(x) for x in raw], dtype=np.int64)
        digits = np.zeros((len(raw), 11), dtype=np.uint8)
        self.digits = np.array([len(str(i)) for i in range(len(raw))], dtype=np.int64)
        for i in range(len(raw)):
            digits[i, : self.digits[i]] = np.frombuffer(str(i).encode(), dtype=np.uint8)
        self.decimal = digits[:, : int(self.digits.max()) + 1].copy()

        self.flat = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, one after the other."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        return self.flat[np.repeat(self.starts[ids] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]

    def given_back(self, ids: list[np.ndarray], data: list[bytes]) -> np.ndarray:
        """Which texts' ids have exactly their bytes."""
        fits = np.array([int(self.lengths[x].sum()) == len(d) > 0 for x, d in zip(ids, data, strict=True)])
        some = np.flatnonzero(fits)
        if len(some):
            want = np.frombuffer(b"".join(data[k] for k in some), dtype=np.uint8)
            same = self.bytes_of(np.concatenate([ids[k] for k in some])) == want
            sizes = np.array([len(data[k]) for k in some])
            fits[some] = np.logical_and.reduceat(same, np.cumsum(sizes) - sizes)
        return fits


class ByteSide(Side):
    """A byte-level vocabulary file. Plain texts go through ranks made from the file, whose ids are
    the same and come as arrays; others through the file's own library, special tokens as text."""

    def __init__(self, path: str):
        letters = byte_letters()
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        vocabulary, special = content["model"]["vocab"], {x["content"] for x in content["added_tokens"]}
        ids = vocabulary | {x["content"]: x["id"] for x in content["added_tokens"]}
        raw = [b""] * (max(ids.values()) + 1)
        for token, i in ids.items():
            raw[i] = token.encode() if token in special else bytes(letters[c] for c in token)
        super().__init__(raw)
        ranks = {raw[i]: i for t, i in vocabulary.items() if t not in special}
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [
            self.fast.encode_to_numpy(t, disallowed_special=()).astype(np.int64)
            if PLAIN.fullmatch(t)
            else np.array(self.slow.encode(t, add_special_tokens=False).ids, dtype=np.int64)
            for t in texts
        ]


class PieceSide(Side):
    """A piece model file, which puts a space before the text itself."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        super().__init__([bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x, dtype=np.int64) for x in self.model.encode(texts, num_threads=1)]


@lru_cache(maxsize=2)
def sides(a_path: str, b_path: str) -> tuple[ByteSide, PieceSide]:
    return ByteSide(a_path), PieceSide(b_path)


class Aligned:
    """The tokens of several texts, laid end to end: text by text, both sides cover the same bytes.

    Both sides' ends are in order, so all that follows is found by counting along: a link is a stretch
    between neighbouring ends, inside one token of each side.
    """

    def __init__(self, a: Side, b: Side, ids_a: list[np.ndarray], ids_b: list[np.ndarray]):
        none = np.zeros(0, np.int64)
        self.a, self.b = (np.concatenate([none, *x]) for x in (ids_a, ids_b))
        self.first_a, self.first_b = (np.cumsum([0] + [len(x) for x in ids]) for ids in (ids_a, ids_b))
        end_a, end_b = np.cumsum(a.lengths[self.a]), np.cumsum(b.lengths[self.b])
        over = np.searchsorted(end_a, end_b)  # the A token that each B end lies in or ends
        shared = end_a[over] == end_b if len(end_a) else np.zeros(0, dtype=bool)
        alone = over[~shared]
        inside = np.bincount(alone, minlength=len(end_a))
        cut = np.zeros(len(end_a), dtype=bool)
        cut[over[shared]] = True
        #: The group of each token: how many common ends come before it.
        self.group_a, self.group_b = np.cumsum(cut) - cut, np.cumsum(shared) - shared
        self.n_groups = int(cut.sum())
        self.link_a = np.repeat(np.arange(len(end_a)), 1 + inside)
        ends = np.zeros(len(self.link_a), dtype=np.int64)  # whether a link ends with a B token
        ends[np.arange(len(alone)) + alone] = 1
        ends[(np.arange(len(end_a)) + np.cumsum(inside))[over[shared]]] = 1
        self.link_b = np.cumsum(ends) - ends
        #: The text of each link.
        self.owner = np.repeat(np.repeat(np.arange(len(ids_a)), np.diff(self.first_a)), 1 + inside)

    def groups_text(self, a: Side, b: Side) -> tuple[bytes, np.ndarray]:
        """`a1,a2|b1;a3|b2,b3;` of all texts in one, and where each text ends in it."""
        count_a, count_b = (np.bincount(g, minlength=self.n_groups) for g in (self.group_a, self.group_b))
        place_a = np.arange(len(self.a)) + (np.cumsum(count_b) - count_b)[self.group_a]
        place_b = np.arange(len(self.b)) + np.cumsum(count_a)[self.group_b]
        width = max(a.decimal.shape[1], b.decimal.shape[1])
        cells, used = np.zeros((len(self.a) + len(self.b), width), dtype=np.uint8), np.empty(len(self.a) + len(self.b), dtype=np.int64)
        for side, ids, group, place, mark in ((a, self.a, self.group_a, place_a, b"|"), (b, self.b, self.group_b, place_b, b";")):
            cells[place, : side.decimal.shape[1]] = side.decimal[ids]
            used[place] = side.digits[ids] + 1
            last = np.r_[group[1:] != group[:-1], True] if len(group) else np.zeros(0, dtype=bool)
            cells[place, side.digits[ids]] = np.where(last, mark[0], ord(","))
        text = cells[np.arange(width) < used[:, None]].tobytes()
        return text, np.r_[0, np.cumsum(used)][self.first_a + self.first_b]


def binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """values cut at bounds (rows of values), each part as one binary value."""
    data = np.ascontiguousarray(values)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * data.itemsize).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def run_bounds(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin, and the end."""
    return np.r_[np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64), len(x)]


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, and the sums of each of values by key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = run_bounds(keys)[:-1]
    return (keys[starts], *(np.add.reduceat(v[order], starts) if len(starts) else v[:0] for v in values))


def together(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Several tables of keys and values as one, summed by key."""
    return summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))


DOCUMENT = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def aligned_documents(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """What one pass over the texts finds, as rows of three kinds.

    document: a text's own figures. posting: for one B id, the A ids that it is linked with in a run of
    texts, with the text and the multiplicity of each. partial: for one B id, the sums of these by A id
    over what the task has read, so counts need not wait for postings. Rows of the last two hold arrays
    as binary values; `row` numbers the texts, and a posting's texts are counted from its `row`.
    """
    ready_workers(docs.sparkSession)
    doc_kind = docs.schema["doc_id"].dataType
    schema = f"kind string, row long, doc_id {doc_kind.simpleString()}, {DOCUMENT}, b int, ids binary, texts binary, times binary, weight long"

    def filled(columns: dict[str, pa.Array], types: dict[str, pa.DataType]) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([columns[k].cast(t) if k in columns else pa.nulls(n, t) for k, t in types.items()], list(types))

    def partial(codes: np.ndarray, times: np.ndarray, types: dict[str, pa.DataType]) -> pa.RecordBatch:
        bounds = run_bounds(codes >> 32)
        columns = {
            "kind": pa.array(["partial"] * (len(bounds) - 1)),
            "b": pa.array((codes >> 32)[bounds[:-1]].astype(np.int32)),
            "ids": binary((codes & 0xFFFFFFFF).astype("<u4"), bounds),
            "times": binary(times.astype("<i8"), bounds),
            "weight": pa.array(np.add.reduceat(times, bounds[:-1]) if len(times) else times, pa.int64()),
        }
        return filled(columns, types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = sides(a_path, b_path)
        types: dict[str, pa.DataType] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            types = {"kind": pa.string(), "row": pa.int64(), "doc_id": batch.schema.field("doc_id").type} | dict.fromkeys(("n_a", "n_b", "n_groups", "n_links"), pa.int64())
            types |= {"groups_sha256": pa.string(), "b": pa.int32(), "ids": pa.binary(), "texts": pa.binary(), "times": pa.binary(), "weight": pa.int64()}
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for low, high in slices(texts, CHUNK):
                part = texts[low:high]
                spaced = [f" {t}" for t in part]
                ids_a, ids_b = a.encode(spaced), b.encode(part)
                data = [t.encode("utf-8", "surrogatepass") for t in spaced]
                whole = a.given_back(ids_a, data) & b.given_back(ids_b, data)
                none = np.zeros(0, np.int64)
                ids_a, ids_b = ([x if part[k] and whole[k] else none for k, x in enumerate(ids)] for ids in (ids_a, ids_b))
                tokens = Aligned(a, b, ids_a, ids_b)
                owner, n = tokens.owner, len(part)
                text, ends = tokens.groups_text(a, b)
                n_links = np.bincount(owner, minlength=n)
                n_a, n_b = np.diff(tokens.first_a), np.diff(tokens.first_b)
                columns = {
                    "kind": pa.array(["document"] * n),
                    "row": batch.column("row").slice(low, n),
                    "doc_id": batch.column("doc_id").slice(low, n),
                    "n_a": pa.array(n_a),
                    "n_b": pa.array(n_b),
                    "n_groups": pa.array(n_a + n_b - n_links),
                    "n_links": pa.array(n_links),
                    "groups_sha256": pa.array([hashlib.sha256(text[x : y - 1]).hexdigest() if y > x else "" for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]),
                }
                yield filled(columns, types)
                # a link's B id, A id and text in one number, sorted once; texts of a batch are few
                codes = np.sort((tokens.b[tokens.link_b] * len(a.raw) + tokens.a[tokens.link_a]) * n + owner)
                bounds = run_bounds(codes)
                codes, times = codes[bounds[:-1]], np.diff(bounds)
                pair = codes // n
                firsts = run_bounds(pair)
                distinct, sums = pair[firsts[:-1]], np.add.reduceat(times, firsts[:-1]) if len(times) else times
                pair, distinct = (x // len(a.raw) << 32 | x % len(a.raw) for x in (pair, distinct))
                starts = run_bounds(pair >> 32)
                columns = {
                    "kind": pa.array(["posting"] * (len(starts) - 1)),
                    "row": pa.array(np.full(len(starts) - 1, batch.column("row")[low].as_py())),
                    "b": pa.array((pair >> 32)[starts[:-1]].astype(np.int32)),
                    "ids": binary((pair & 0xFFFFFFFF).astype("<u4"), starts),
                    "texts": binary((codes % n).astype("<u4"), starts),
                    "times": binary(times.astype("<u4"), starts),
                    "weight": pa.array(np.diff(starts)),
                }
                yield filled(columns, types)
                held.append((distinct, sums))
                if sum(len(x) for x, _ in held) > PAIRS:
                    held = [together(held)]
                    if len(held[0][0]) > PAIRS:
                        yield partial(*held.pop(), types)
        if held:
            yield partial(*together(held), types)

    return docs.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", "text").mapInArrow(run, schema)


def whole_counts(partials: DataFrame) -> DataFrame:
    """One partial row a B id: the sums of its rows, of at most as many numbers as there are A ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present, parts = None, None

        def told() -> pa.RecordBatch:
            ids, times = parts
            return pa.RecordBatch.from_arrays([pa.array([present], pa.int32()), pa.array([ids.astype("<u4").tobytes()]), pa.array([times.astype("<i8").tobytes()])], ["b", "ids", "times"])

        for batch in batches:
            for b, ids, times in zip(*(batch.column(c).to_pylist() for c in ("b", "ids", "times")), strict=True):
                more = np.frombuffer(ids, "<u4").astype(np.int64), np.frombuffer(times, "<i8")
                if b != present:
                    if parts:
                        yield told()
                    present, parts = b, more
                else:
                    parts = together([parts, more])
        if parts:
            yield told()

    return partials.select("b", "ids", "times").repartition("b").sortWithinPartitions("b").mapInArrow(run, "b int, ids binary, times binary")


def contributions(cells: DataFrame) -> DataFrame:
    """(row, n_best, count_sum): what the postings of a cell's B ids add to its texts, mostly a row a text.

    cells: group, slice, b, then for each b its counts (kind 0) and postings (kind 1). Sorted inside
    a task, so a B id's counts come first, with their maximum, and the postings stream by, of which
    no more than an Arrow batch is held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def flushed() -> pa.RecordBatch:
            rows, best, counts = together(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(rows), pa.array(best), pa.array(counts)], ["row", "n_best", "count_sum"])

        known, top, cell = None, 0, None
        for batch in batches:
            group, part, b, kind, row = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("group", "slice", "b", "kind", "row"))
            bounds = run_bounds(part * GROUPS + group)
            inner = run_bounds(b << 1 | kind)
            for x, y in itertools.pairwise(np.union1d(bounds, inner).tolist()):
                if held and (group[x], part[x]) != cell and sum(len(h[0]) for h in held) > SUMS // 4:
                    yield flushed()  # a cell's texts are mostly its own
                cell = (group[x], part[x])
                ids, times = (b"".join(batch.column(c).slice(x, y - x).to_pylist()) for c in ("ids", "times"))
                ids = np.frombuffer(ids, "<u4").astype(np.int64)
                if kind[x] == 0:
                    known = ids, np.frombuffer(times, "<i8")
                    top = known[1].max()
                    continue
                texts = batch.column("texts").slice(x, y - x).to_pylist()
                owner = np.repeat(row[x:y], [len(t) // 4 for t in texts]) + np.frombuffer(b"".join(texts), "<u4")
                times = np.frombuffer(times, "<u4").astype(np.int64)
                count = known[1][np.searchsorted(known[0], ids)]
                held.append((owner, times * (count == top), times * count))
            if sum(len(h[0]) for h in held) > SUMS:
                yield flushed()
        if held:
            yield flushed()

    return cells.select("group", "slice", "b", "kind", "row", "ids", "texts", "times").mapInArrow(run, "row long, n_best long, count_sum long")


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Align two tokenizers on the bytes of every text and count how often their ids are linked.

    docs: doc_id, text; other columns are ignored. A is a byte-level vocabulary file, B a piece model. Two tokens
    are linked if their bytes overlap. Returns a row for each row: doc_id, n_a, n_b, n_groups (cut where
    both sides' tokens end), n_links, n_best (links whose pair's count in the corpus is the highest of its B id,
    ties included), count_sum (of the pairs' counts over links) and groups_sha256. Null and empty
    texts, and those that either side does not give back byte by byte, have no tokens: zeros and an
    empty digest. Repeated rows and null doc_id get a row each; an empty table gives none. A text's tokens are
    in memory together, as both libraries give them.

    Multiplicities by text are shuffled by B id in groups, each cut into slices by text, as many as its
    postings ask for, so a B id with a third of all postings is no single task's and a text has at most
    GROUPS rows before its sums however many tasks there are. Counts are summed inside tasks first,
    then by B id, and go to every slice of their group.
    """
    found = materialise(aligned_documents(docs, a_path, b_path), "aligned")
    documents, postings, partials = (found.where(F.col("kind") == k).drop("kind") for k in ("document", "posting", "partial"))
    group = F.pmod(F.xxhash64("b"), F.lit(GROUPS)).cast("int").alias("group")
    weights = materialise(postings.groupBy(group).agg(F.sum("weight").alias("_weight")), "weights")
    total = F.sum("_weight").over(Window.partitionBy())  # GROUPS rows
    slices = F.ceil(F.greatest(F.col("_weight") / POSTINGS, F.col("_weight") * CELLS / total)).cast("int")
    slices = F.broadcast(materialise(weights.select("group", slices.alias("_slices")), "slices"))
    own = postings.withColumn("group", group).join(slices, "group").select(
        "group", F.pmod(F.xxhash64("row"), F.col("_slices")).cast("int").alias("slice"), "b", F.lit(1).alias("kind"), "row", "ids", "texts", "times"
    )
    heads = whole_counts(partials).withColumn("group", group).join(slices, "group").select(
        "group", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)).alias("slice"), "b", F.lit(0).alias("kind"),
        F.lit(0).cast("long").alias("row"), "ids", F.lit(None).cast("binary").alias("texts"), "times",
    )
    cells = own.unionByName(heads).repartition("group", "slice").sortWithinPartitions("group", "slice", "b", "kind")
    sums = contributions(cells).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    told = documents.join(sums, "row", "left")
    zero = F.lit(0).cast("long")
    return told.select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
