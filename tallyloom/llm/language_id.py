"""Language identification by cross-parsing against labelled text."""

from __future__ import annotations

import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import ready_workers, slices

#: Labelled rows that a language's sample is drawn from, and its characters, at most.
SAMPLE_DOCS = 64
SAMPLE_CHARS = 24_000
#: Symbols of a text that are parsed one after the other while all such blocks advance together, and
#: the places at which a block parsed again is held against the first time.
BLOCK = 512
LOOKS = (8, 16, 32, 64, 128, 256, 512)
UNKNOWN = "und"
#: Characters that are parsed at once.
CHUNK = 1 << 20
#: Symbols: padding, other letter, white space and all else that is no letter; then the letters of the samples.
PAD, OTHER, GAP = 0, 1, 2
#: Bytes of full transition tables in a worker: as many of the most frequent letters as fit have them.
TABLE_BYTES = 96 << 20


class SuffixAutomaton:
    """States and transitions of all substrings of a sequence of symbols."""

    def __init__(self, symbols: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in symbols:
            last = self._extend(last, c)

    def _add(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _extend(self, last: int, c: int) -> int:
        new, p = self._add(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            if self.length[p] + 1 < self.length[q]:
                twin = self._add(self.length[p] + 1, self.link[q], dict(self.next[q]))
                while p >= 0 and self.next[p].get(c) == q:
                    self.next[p][c] = twin
                    p = self.link[p]
                self.link[q] = q = twin
            self.link[new] = q
        return new

    def arrays(self, symbols: int) -> tuple[int, np.ndarray, np.ndarray]:
        """The number of states, and all transitions: sorted keys state * symbols + symbol, and next states."""
        found = sorted((s * symbols + c, to) for s, following in enumerate(self.next) for c, to in following.items())
        keys, to = np.array(found, dtype=np.int64).reshape(-1, 2).T
        return len(self.next), keys, to.astype(np.int32)


class Transitions:
    """Steps of a suffix automaton as entries: next state * 4, plus the phrases that the symbol begins.

    One state more than the automaton's stands before the first symbol and after one that the sample
    doesn't have: any symbol begins a phrase there. A symbol that the sample doesn't have counts as
    two phrases, as there is nothing to point at and it must be spelled. Symbols below width have a full table, the others
    are looked up among the sorted keys of the transitions there are.
    """

    def __init__(self, states: int, keys: np.ndarray, to: np.ndarray, symbols: int, width: int):
        self.symbols, self.width, self.apart = symbols, width, states
        self.begin = np.full(symbols, states * 4 + 2, dtype=np.int32)
        first = keys < symbols
        self.begin[keys[first]] = to[first] * 4 + 1
        table = np.empty((states + 1, width), dtype=np.int32)
        table[:] = self.begin[:width]
        full = keys % symbols < width
        table[keys[full] // symbols, keys[full] % symbols] = to[full] * 4
        table[:, PAD] = np.arange(states + 1) * 4
        self.table = table.ravel()
        self.keys = np.append(keys[~full], np.iinfo(np.int64).max)
        self.entries = np.append(to[~full] * 4, 0).astype(np.int32)

    def step(self, state: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states, and the phrases begun, of states that read a symbol each."""
        got = self.table[state * self.width + (c if self.width == self.symbols else np.where(c < self.width, c, PAD))]
        if self.width < self.symbols and len(at := np.flatnonzero(c >= self.width)):
            wanted = state[at].astype(np.int64) * self.symbols + c[at]
            place = np.searchsorted(self.keys, wanted)
            got[at] = np.where(self.keys[place] == wanted, self.entries[place], self.begin[c[at]])
        return got >> 2, got & 3


class CrossParser:
    """Phrases a text needs in each language: the greedy longest matches in its sample."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        letters = [c for c, _ in Counter(c for _, text in samples for c in text.lower() if c.isalpha()).most_common()]
        self.symbol = np.full(sys.maxunicode + 1, GAP, dtype=np.uint8 if len(letters) <= 250 else np.int32)
        self.symbol[letter_points()] = OTHER
        for i, c in enumerate(letters):
            self.symbol[ord(c)] = 3 + i
        self.count = 3 + len(letters)
        self.langs = [lang for lang, _ in samples]
        found, sizes = [], []
        for _, text in samples:
            symbols, _ = self.symbols([text])
            found.append(SuffixAutomaton(symbols.tolist()).arrays(self.count))
            sizes.append(max(2, len(symbols)))
        self.bits = np.log2(sizes)
        states = sum(n + 1 for n, _, _ in found)
        width = min(self.count, max(3, TABLE_BYTES // (4 * max(1, states))))
        self.steps = [Transitions(*x, self.count, width) for x in found]

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of all texts one after the other, runs of gaps as one, and each text's count."""
        low = [t.lower() for t in texts]
        points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        got = self.symbol[points]
        owner = np.repeat(np.arange(len(low)), [len(t) for t in low])
        keep = np.ones(len(got), dtype=bool)
        keep[1:] = (got[1:] != GAP) | (got[:-1] != GAP) | (owner[1:] != owner[:-1])
        return got[keep], np.bincount(owner[keep], minlength=len(low))

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(texts x languages) phrase counts, symbols of each text, and whether it has a letter."""
        symbols, counts = self.symbols(texts)
        blocks = -(-counts // BLOCK)
        owner = np.repeat(np.arange(len(texts)), blocks)
        grid = np.zeros((int(blocks.sum()), BLOCK), dtype=np.int32)
        row_start = np.repeat((np.cumsum(blocks) - blocks) * BLOCK, counts)
        within = np.arange(len(symbols)) - np.repeat(np.cumsum(counts) - counts, counts)
        grid.ravel()[row_start + within] = symbols
        steps = np.ascontiguousarray(grid.T)
        goes_on = np.flatnonzero(owner[1:] == owner[:-1]) + 1
        out = np.zeros((len(texts), len(self.steps)), dtype=np.int64)
        for k, step in enumerate(self.steps):
            begun = parsed_blocks(step, steps, goes_on)
            out[:, k] = np.bincount(owner, weights=begun, minlength=len(texts))
        text_of = np.repeat(np.arange(len(texts)), counts)
        lettered = np.bincount(text_of[symbols != GAP], minlength=len(texts)) > 0
        return out, counts, lettered

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language of fewest phrases, each weighed by the bits that point into its sample, and the
        share by which the second needs more; UNKNOWN and 0 without a letter or a sample."""
        if not self.steps:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        found, _, lettered = self.phrases(texts)
        cost = found * self.bits
        order = np.argsort(cost, axis=1, kind="stable")
        rows = np.arange(len(texts))
        best = cost[rows, order[:, 0]]
        second = cost[rows, order[:, 1]] if len(self.steps) > 1 else np.full(len(texts), np.inf)
        score = np.where(np.isinf(second), 1.0, 1.0 - best / np.maximum(second, 1e-9))
        langs = [self.langs[i] if ok else UNKNOWN for i, ok in zip(order[:, 0], lettered, strict=True)]
        return langs, np.where(lettered, np.clip(score, 0.0, 1.0), 0.0).tolist()


def parsed_blocks(step: Transitions, steps: np.ndarray, goes_on: np.ndarray) -> np.ndarray:
    """Phrases that begin in each block, steps[:, block] being its symbols, of one parse of every text
    from left to right; goes_on: the blocks that go on a text from the block before.

    All blocks are parsed at once, as if each began a text. Those that go on one are then parsed again
    from the state in which the block before ends, until they are in the state of the first time at the
    same place, after which nothing differs; that takes a few symbols. One that never gets there ends
    in another state, so the block after it is parsed again too.
    """
    width = steps.shape[1]
    state, begun = np.full(width, step.apart, dtype=np.int32), np.zeros(width, dtype=np.int32)
    seen: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for i, c in enumerate(steps):
        state, begins = step.step(state, c)
        begun += begins
        if i + 1 in LOOKS:
            seen[i + 1] = state, begun.copy()
    last, total, again = state.copy(), begun, goes_on
    while len(again):
        blocks, state, so_far = again, last[again - 1], np.zeros(len(again), dtype=np.int32)
        changed = []
        for i, c in enumerate(steps):
            state, begins = step.step(state, c[blocks])
            so_far += begins
            if i + 1 in LOOKS:
                then, had = seen[i + 1]
                same = then[blocks] == state
                if i + 1 == len(steps):
                    total[blocks] = so_far
                    differs = state != last[blocks]
                    last[blocks] = state
                    changed.extend(blocks[differs])
                    break
                total[blocks[same]] = so_far[same] + (seen[len(steps)][1] - had)[blocks[same]]
                back = blocks[same & (last[blocks] != seen[len(steps)][0][blocks])]
                last[back] = seen[len(steps)][0][back]
                changed.extend(back)
                blocks, state, so_far = blocks[~same], state[~same], so_far[~same]
                if not len(blocks):
                    break
        again = np.intersect1d(np.unique(np.asarray(changed, dtype=np.int64)) + 1, goes_on)
    return total


@lru_cache(maxsize=1)
def letter_points() -> np.ndarray:
    return np.array([i for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i))[0] == "L"], dtype=np.uint32)


@lru_cache(maxsize=2)
def cross_parser(samples: tuple[tuple[str, str], ...]) -> CrossParser:
    return CrossParser(samples)


def labelled_samples(docs: DataFrame, max_docs: int = SAMPLE_DOCS, max_chars: int = SAMPLE_CHARS) -> tuple[tuple[str, str], ...]:
    """Per language, text of at most max_chars characters from at most max_docs labelled documents.

    Rows whose crc32(doc_id) mod 3 is 1, or without lang, text or doc_id, are never learned from.
    The documents are those of least hash in max_docs parts of a language, found by one aggregation
    without text; repeated rows count once; each gives its share of the characters from the first
    letter on. What the driver gets is at most max_chars characters of each of them.
    """
    fit = docs.where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    ).select("doc_id", "lang", "text")
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(max_docs))
    chosen = (
        fit.where(F.col("text").rlike(r"\p{L}"))
        .groupBy("lang", part.alias("_part"))
        .agg(F.min(F.struct(F.xxhash64("doc_id").alias("h"), "doc_id")).alias("_first"))
        .select("lang", F.col("_first")["doc_id"].alias("doc_id"))
        .collect()
    )
    if not chosen:
        return ()
    wanted = {(r["lang"], r["doc_id"]) for r in chosen}
    share = {lang: max_chars // n for lang, n in Counter(lang for lang, _ in wanted).items()}
    letters = F.regexp_replace("text", r"^\P{L}+", "")
    rows = (
        fit.where(F.col("doc_id").isin(list({i for _, i in wanted})))
        .select("lang", "doc_id", F.substring(letters, 1, max(share.values())).alias("text"))
        .groupBy("lang", "doc_id")
        .agg(F.min("text").alias("text"))
        .orderBy("lang", F.xxhash64("doc_id"))
        .collect()
    )
    by_lang: dict[str, list[str]] = {}
    for r in rows:
        if (r["lang"], r["doc_id"]) in wanted:
            by_lang.setdefault(r["lang"], []).append(r["text"][: share[r["lang"]]])
    return tuple((lang, "\n".join(by_lang[lang])) for lang in sorted(by_lang))


def identify_languages(
    docs: DataFrame, max_docs: int = SAMPLE_DOCS, max_chars: int = SAMPLE_CHARS, carry: tuple[str, ...] = (),
    samples: tuple[tuple[str, str], ...] | None = None,
) -> DataFrame:
    """Language of every document, by the number of phrases it needs in each language.

    docs: doc_id, text, lang; other columns are ignored. A language's sample becomes a suffix
    automaton; a text is parsed from left to right into longest matches in it, a letter that the
    sample doesn't have being two phrases; the language with fewest phrases, weighed by the bits of a pointer into its sample, wins; ties go to the smaller
    name. A worker holds at most TABLE_BYTES of tables whatever the number of languages and letters,
    and about 2 MB of transitions a language.

    Returns a row for each row: doc_id, held_out, lang_pred, score, and the columns named in carry. Null text, and text without a
    letter, is 'und' with score 0, as is everything where nothing was labelled; a null doc_id is not
    held out and not learned from; repeated rows get a row each; an empty table gives none. samples:
    those of labelled_samples, if they are known.
    """
    samples = labelled_samples(docs, max_docs, max_chars) if samples is None else samples
    ready_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = cross_parser(samples)
        for batch in batches:
            texts, langs, scores = [t or "" for t in batch.column("text").to_pylist()], [], []
            for a, b in slices(texts, CHUNK):
                some, sure = parser.predict(texts[a:b])
                langs += some
                scores += sure
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), *map(batch.column, carry)],
                ["doc_id", "held_out", "lang_pred", "score", *carry],
            )

    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    kind = docs.schema["doc_id"].dataType.simpleString()
    more = "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select("doc_id", held_out.alias("held_out"), "text", *carry).mapInArrow(
        run, f"doc_id {kind}, held_out boolean, lang_pred string, score double{more}"
    )
