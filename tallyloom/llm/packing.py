"""Harmonic packing of tokenised documents into fixed-length sequences."""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import ready_workers, materialise

#: Word-to-ids entries in each of the two generations that a worker keeps.
CACHE_WORDS = 250_000
#: Places over which the pieces of one class are dealt before they are numbered: so many, or more with so many pieces each.
SALTS, SALT_PIECES = 256, 100_000
#: How tokenizer files look whose words may be looked up one by one: normaliser, splitting of text into
#: words, and spelling of words (fixed by the file format).
NORMALISERS = ["NFC", "Replace", "Lowercase"]
SPLIT = {
    "type": "Split",
    "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
    "behavior": "Removed",
    "invert": True,
}
SPELLING = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: Stands between words that are tokenised together.
MARK = "\x01"
#: Byte-level models write bytes without a printable Latin-1 character as the characters from 256 on, in order.
UNPRINTED = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
BYTE_CHARACTERS = {b: 256 + i for i, b in enumerate(UNPRINTED)}


def word_by_word(path: str) -> bool:
    """Whether a tokenizer file is of the kind whose words WordTokenizer may take apart."""
    with open(path, encoding="utf-8") as f:
        kind = json.load(f)
    normal, before, model = (kind.get(k) or {} for k in ("normalizer", "pre_tokenizer", "model"))
    steps = normal.get("normalizers") or []
    return (
        [x["type"] for x in steps] == NORMALISERS
        and (steps[1]["pattern"], steps[1]["content"]) == ({"Regex": r"\s+"}, " ")
        and before.get("pretokenizers") == [SPLIT, SPELLING]
        and model.get("type") == "BPE"
        and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
    )


class WordTokenizer:
    """Token ids of whole texts, with the ids of words kept.

    Splitting at spaces and line ends does not change the ids of a tokenizer whose pre-tokenizer
    drops white space and never matches across it. A file that doesn't say so by word_by_word() is
    used plainly, on whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.apart = word_by_word(path)
        self.model = self.tokenizer.model
        self.spelled = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        mark = self._encode(MARK)
        self.mark = mark[0] if len(mark) == 1 else None

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if MARK not in w] if self.mark is not None else []
        for at in range(0, len(plain), 20_000):
            some = plain[at : at + 20_000]
            ids = np.asarray(self._encode(f" {MARK} ".join(some)), dtype="<u4")
            cuts = np.flatnonzero(ids == self.mark)
            starts, ends = np.r_[0, cuts + 1], np.r_[cuts, len(ids)]
            raw = ids.tobytes()
            if len(starts) != len(some):
                for w in some:
                    self.known[w] = np.asarray(self._encode(w), dtype="<u4").tobytes()
                continue
            for w, a, b in zip(some, (starts * 4).tolist(), (ends * 4).tolist(), strict=True):
                self.known[w] = raw[a:b]
        for w in words:
            if w not in self.known:
                self.known[w] = np.asarray(self._encode(w), dtype="<u4").tobytes()

    def _letters(self, word: str) -> bytes:
        """Ids of a normalised word of letters only: it is one pre-token, so its bytes, each as the
        character that byte-level models write for it, go straight to the merges."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(BYTE_CHARACTERS)
        return b"".join([self.spelled[t.id] for t in self.model.tokenize(word)])

    def _derive(self, words: set[str]) -> None:
        """Learn words by way of their lower-case letters and one final stop or comma, which the
        pre-tokenizer takes apart anyway; other words go to the tokenizer as they are."""
        known, others = self.known, []
        for end in ".,":
            if end not in known:
                self._learn([end])
        for w in words:
            core, end = (w[:-1], w[-1]) if w[-1] in ".," else (w, "")
            core = core.lower() if core.isascii() else unicodedata.normalize("NFC", core).lower() if "Σ" not in core else ""
            if not core.isalpha():
                others.append(w)
                continue
            ids = known.get(core)
            if ids is None:
                ids = known[core] = self._letters(core)
            known[w] = ids + known[end] if end else ids
        if others:
            self._learn(sorted(others))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if not self.apart:
            return [np.asarray(self._encode(t), dtype="<u4").tobytes() for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known, self.older = {"": b""}, self.known
        split = [t.replace("\n", " ").split(" ") for t in texts]
        new = set().union(*split).difference(self.known)
        if self.older:
            again = new.intersection(self.older)
            self.known.update((w, self.older[w]) for w in again)
            new -= again
        if new:
            self._derive(new)
        get = self.known.__getitem__
        return [b"".join(map(get, words)) for words in split]


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def cut_lengths(tokens: int, capacity: int, slack: int) -> list[tuple[int, int]]:
    """(length, class) of a document's pieces in order. Class k holds lengths above capacity / (k + 1)
    and up to capacity / k, k pieces a bin.

    A rest that would leave more than capacity / slack of its class's bins empty gives up a piece of
    exactly the next class's largest length; what is left is far smaller and is treated alike.
    """
    out = [(capacity, 1)] * (tokens // capacity)
    rest = tokens % capacity
    while rest:
        k = capacity // rest
        if capacity - k * rest <= capacity // slack or k >= slack:
            out.append((rest, k))
            break
        piece = capacity // (k + 1)
        out.append((piece, capacity // piece))
        rest -= piece
    return out


PIECES = "doc_id {id}, start long, length long, ids_crc32 long, doc_tokens long, class int"


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int, slack: int) -> DataFrame:
    """Pieces of every document: its ids, then end_id, cut by cut_lengths."""
    ready_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = word_tokenizer(tokenizer_path)
        end = np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows, start, length, crc, total, cls = [], [], [], [], [], []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for row, ids in enumerate(tok.encode(texts)):
                ids += end
                n, at = len(ids) // 4, 0
                for size, k in cut_lengths(n, capacity, slack):
                    rows.append(row)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + size)]))
                    total.append(n)
                    cls.append(k)
                    at += size
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total)), pa.array(cls, pa.int32())],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, PIECES.format(id=kind))


def fit_leftovers(pieces: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Best fit, longest first, of a bounded number of pieces: adds bin (from 0) and offset."""
    pieces = pieces.sort_values(["length", "doc_id", "start"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = [], [], 0
    for n in pieces["length"].tolist():
        room = next((r for r in range(n, capacity + 1) if open_bins[r]), None)
        if room is None:
            bin_id, room, made = made, capacity, made + 1
        else:
            bin_id = open_bins[room].pop()
        bins.append(bin_id)
        offsets.append(capacity - room)
        if room - n:
            open_bins[room - n].append(bin_id)
    return pieces.assign(bin=bins, offset=offsets)


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 2048, slack: int = 32) -> DataFrame:
    """Pack documents into sequences of at most capacity tokens by harmonic classes.

    docs: doc_id, text; other columns are ignored. A document is its token ids and then end_id;
    null text is empty. Each id lies in exactly one piece. Returns a row for each piece: doc_id,
    start, length, ids_crc32, doc_tokens, sequence_id, offset, class. sequence_id runs from 0
    without gaps; offset from 0 without gaps in each sequence. Repeated rows are packed each; rows
    with a null doc_id too; an empty table gives no rows.

    A piece's class and bin follow from its length and its number in the class, so workers fill
    bins on their own: pieces are numbered in salted parts of a class, and only the parts'
    counts are added up. Fewer than k pieces of class k are left without a full bin; all these
    leftovers, whose number depends on capacity alone (under 10 000 at 2048), are packed together by
    best fit in one task, as a part-filled bin a class would be mostly padding.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    pieces = tokenised_pieces(docs, tokenizer_path, end_id, capacity, slack)
    pieces = materialise(pieces, "pieces")
    salts = max(SALTS, -(-pieces.count() // SALT_PIECES))
    pieces = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(salts)).cast("int"))
    parts = pieces.groupBy("class", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("class").orderBy("_salt").rowsBetween(Window.unboundedPreceding, 0)
    classes = parts.groupBy("class").agg(F.sum("_n").alias("_total"))
    full = F.expr("_total div class")
    along = Window.orderBy("class")
    classes = classes.select(
        "class",
        full.alias("_bins"),
        (F.sum(full).over(along.rowsBetween(Window.unboundedPreceding, 0)) - full).alias("_base"),
        F.sum(full).over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"),
    )
    parts = parts.withColumn("_at", F.sum("_n").over(before) - F.col("_n")).drop("_n").join(classes, "class")
    place = F.row_number().over(Window.partitionBy("class", "_salt").orderBy("doc_id", "start", "ids_crc32")) - 1
    placed = (
        pieces.withColumn("_place", place)
        .join(parts, ["class", "_salt"])
        .withColumn("_index", F.col("_at") + F.col("_place"))
        .withColumn("_bin", F.expr("_index div class"))
        .drop("_place", "_at", "_salt")
    )
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "class"]
    inside = Window.partitionBy("sequence_id").orderBy("_index").rowsBetween(Window.unboundedPreceding, 0)
    whole = (
        placed.where(F.col("_bin") < F.col("_bins"))
        .withColumn("sequence_id", F.col("_base") + F.col("_bin"))
        .withColumn("offset", F.sum("length").over(inside) - F.col("length"))
        .select(*columns)
    )

    def fit(_: tuple, group: pd.DataFrame) -> pd.DataFrame:
        got = fit_leftovers(group, capacity)
        return got.assign(sequence_id=got["_all"] + got["bin"])[columns]

    left = (
        placed.where(F.col("_bin") >= F.col("_bins"))
        .select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "_all", F.lit(0).alias("_one"))
        .groupBy("_one")
        .applyInPandas(fit, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, class int")
    )
    return whole.unionByName(left)
