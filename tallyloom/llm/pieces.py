"""SentencePiece encoding and decoding over an Aho-Corasick automaton."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyloom.llm.common import ready_workers

#: Stands for a space in pieces (fixed by the model format).
SPACE = "▁"
#: What an unknown character costs below the worst piece (fixed by the model format).
UNKNOWN_PENALTY = 10.0
#: Segment-to-ids entries that a worker keeps.
CACHE_SEGMENTS = 300_000


class PieceModel:
    """Best-scoring segmentation of texts into the pieces of a SentencePiece model, and back.

    The score of a segmentation is the sum of its pieces' scores; a character that no piece covers
    alone costs UNKNOWN_PENALTY below the worst piece and becomes its UTF-8 bytes (or the unknown
    piece if the model has no byte pieces). Of equal scores at a position, the longest last piece wins.
    """

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        with open(path, "rb") as f:
            sp = sentencepiece.SentencePieceProcessor(model_proto=f.read())
        n = sp.get_piece_size()
        self.unknown = sp.unk_id()
        self.byte_ids = [-1] * 256
        self.raw: list[bytes] = []
        self.scores = np.zeros(n)
        self.automaton = ahocorasick.Automaton()
        normal = {}
        for i in range(n):
            piece, self.scores[i] = sp.id_to_piece(i), sp.get_score(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.raw.append(b"\xef\xbf\xbd" if sp.is_unknown(i) else b"")
            else:
                normal[piece] = i
                self.raw.append(piece.replace(SPACE, " ").encode())
        for piece, i in normal.items():
            self.automaton.add_word(piece, (len(piece), float(self.scores[i]), i))
        self.automaton.make_automaton()
        self.worst = min(float(self.scores[i]) for i in normal.values()) - UNKNOWN_PENALTY
        self.is_byte = np.zeros(n, dtype=bool)
        self.is_byte[[i for i in self.byte_ids if i >= 0]] = True
        self.known: dict[str, bytes] = {}
        #: No piece goes on from another character into a space, or holds a line end: texts fall apart there.
        apart = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in normal)
        self.segments = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n" if apart else r"(?s:.+)").findall

    def best(self, text: str) -> list[int]:
        """Ids of the best segmentation of text, in which spaces are already SPACE.

        A single pass: the automaton reports the matches that end at each position, the longest
        first and the rest along its output links; each relaxes the best score of its end. A
        position that no single-character piece ends at is also reached by its unknown character.
        """
        n = len(text)
        score, back = [0.0] * (n + 1), [(0, -1)] * (n + 1)
        ends: list[list[tuple[int, float, int]]] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(text):
            ends[end].append(match)
        for at in range(n):
            top, how, alone = -np.inf, (at, -1), False
            for size, value, i in ends[at]:
                alone |= size == 1
                got = score[at + 1 - size] + value
                if got > top:
                    top, how = got, (at + 1 - size, i)
            if not alone and score[at] + self.worst > top:
                top, how = score[at] + self.worst, (at, -1)
            score[at + 1], back[at + 1] = top, how
        ids, at = [], n
        while at:
            start, i = back[at]
            ids.extend([i] if i >= 0 else reversed(self.spelled(text[start:at])))
            at = start
        return ids[::-1]

    def spelled(self, character: str) -> list[int]:
        ids = [self.byte_ids[b] for b in character.encode("utf-8", "surrogatepass")]
        return ids if min(ids) >= 0 else [self.unknown]

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text; an empty one has none."""
        if not text:
            return b""
        if len(self.known) > CACHE_SEGMENTS:
            self.known = {}
        parts = self.segments(SPACE + text.replace(" ", SPACE))
        for p in set(parts).difference(self.known):
            self.known[p] = np.asarray(self.best(p), dtype="<u4").tobytes()
        return b"".join(map(self.known.__getitem__, parts))

    def decode(self, ids: bytes) -> str:
        """The text of little-endian 32-bit ids, without the space put before it."""
        text = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, dtype="<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def encode_documents(docs: DataFrame, model_path: str, with_ids: bool = True) -> DataFrame:
    """Piece ids of every document, and whether they decode to its text again.

    docs: doc_id, text; other columns are ignored. Returns a row for each row: doc_id, n_pieces,
    n_byte_pieces, ids_crc32 (of little-endian 32-bit ids), score (sum over the pieces),
    round_trip, and ids (array) if with_ids. Null and empty text have no pieces and round_trip
    true; a text that holds the model's space mark itself comes back with a space and round_trip
    false; repeated rows and null doc_id get a row each; an empty table gives none.

    A text falls apart where no piece can go across, so best segmentations of its segments are
    together the text's; segments recur and are looked up.
    """
    ready_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(model_path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            ids = [model.encode(t) for t in texts]
            arrays = [np.frombuffer(x, dtype="<u4") for x in ids]
            columns = [
                batch.column("doc_id"),
                pa.array([len(a) for a in arrays], pa.int64()),
                pa.array([int(model.is_byte[a].sum()) for a in arrays], pa.int64()),
                pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                pa.array([float(model.scores[a].sum()) for a in arrays], pa.float64()),
                pa.array([model.decode(x) == t for x, t in zip(ids, texts, strict=True)], pa.bool_()),
            ]
            names = ["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "score", "round_trip"]
            if with_ids:
                columns.append(pa.array([a.astype(np.int32) for a in arrays], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_pieces long, n_byte_pieces long, ids_crc32 long, score double, round_trip boolean"
    return docs.select("doc_id", "text").mapInArrow(run, schema + ", ids array<int>" * with_ids)
