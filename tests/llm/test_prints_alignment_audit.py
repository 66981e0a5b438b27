import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyloom.llm import filter_audit, simhash, token_alignment
from tallyloom.llm.queries import tokenizer_file

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# SimHash


def brute_print(text):
    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, f"{p:016x}", least.get(find(i))) for i, ((d, _), p) in enumerate(zip(rows, prints, strict=True))), key=str)


def prints(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("print", F.lit("clash")).withColumn("block", F.lit(1))
    return sorted((tuple(r) for r in simhash.near_prints(df.repartition(3)).collect()), key=str)


def corpus(r, n):
    rows = []
    while len(rows) < n:
        words = ["".join(r.choices("abcdefgh", k=3)) for _ in range(r.randrange(1, 120))]
        for _ in range(r.choice([1, 1, 2, 5])):
            rows.append((len(rows) * 7 % 1009, " ".join(words)))
            words[r.randrange(len(words))] = "Edit"
    return rows + [(5000, None), (5001, ""), (5002, " \t\n"), (None, "a b"), (None, "a b"), (5003, "A B"), (5004, "a b"), (5004, "x"), (5005, "ä ö\x0bü ß"), (5006, "x y z")]


def test_prints_and_components_are_those_of_brute_force(spark):
    rows = corpus(random.Random(4), 150)
    assert prints(spark, rows) == brute_components(rows)
    assert prints(spark, []) == []


def test_tries_dealt_over_chunks_lose_no_link(spark, monkeypatch):
    for name, value in (("FEW", 3), ("MANY", 3), ("TOGETHER", 8), ("WIDTH", 4), ("LEAF", 2)):
        monkeypatch.setattr(simhash, name, value)
    r = random.Random(5)
    words = ["".join(r.choices("abcdefgh", k=3)) for _ in range(400)]
    rows = []
    for i in range(90):  # one dense family, hot in every rotation
        rows.append((i, " ".join(words)))
        words[r.randrange(len(words))] = f"w{i}"
    rows += corpus(r, 30)
    assert prints(spark, rows) == brute_components(rows)


def test_trie_pairs_are_all_pairs_within_the_budget():
    r = np.random.default_rng(6)
    centres = r.integers(0, 1 << 63, 12, dtype=np.uint64)
    values = np.unique(np.concatenate([c ^ (np.uint64(1) << r.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 40, dtype=np.uint64)) for c in centres]))
    one = (np.array([0]), np.array([len(values)]))
    got = [tuple(p) for i, j in simhash.trie_pairs(values, (*one, *one), 0) for p in zip(i.tolist(), j.tolist(), strict=True)]
    want = [(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if (int(values[i]) ^ int(values[j])).bit_count() <= 3]
    assert sorted(got) == want


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    monkeypatch.setattr(simhash, "PIECE", 64)
    r = random.Random(7)
    for n in (1, 2, 3, 4, 200):
        text = "".join("".join(r.choices("abAB", k=r.choice([1, 3, 150]))) + r.choice([" ", "\n\n", "\t"]) for _ in range(n))
        assert simhash.fingerprint(text) % (1 << 64) == brute_print(text)


# alignment


def brute_alignment(rows, a, b):
    found, counts = [], Counter()
    for d, text in rows:
        spaced = " " + (text or "")
        ids = [a.slow.encode(spaced, add_special_tokens=False).ids, b.model.encode(text or "")]
        raw = [[s.raw[i] for i in x] for s, x in zip((a, b), ids, strict=True)]
        if not text or any(b"".join(x) != spaced.encode() for x in raw):
            found.append((d, [], [], [], []))
            continue
        spans = []
        for x in raw:
            ends = np.cumsum([len(t) for t in x]).tolist()
            spans.append(list(zip([0, *ends[:-1]], ends, strict=True)))
        links = [(i, j) for i, (p, q) in zip(ids[0], spans[0], strict=True) for j, (u, v) in zip(ids[1], spans[1], strict=True) if max(p, u) < min(q, v)]
        counts.update(links)
        cuts = sorted({q for _, q in spans[0]} & {v for _, v in spans[1]})
        groups = []
        for low, high in zip([0, *cuts[:-1]], cuts, strict=True):
            groups.append("|".join(",".join(str(i) for i, (_, q) in zip(x, s, strict=True) if low < q <= high) for x, s in zip(ids, spans, strict=True)))
        found.append((d, *ids, groups, links))
    top = {}
    for (_, j), n in counts.items():
        top[j] = max(n, top.get(j, 0))
    return sorted(
        (
            (d, len(x), len(y), len(g), len(links), sum(counts[p] == top[p[1]] for p in links), sum(counts[p] for p in links), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
            for d, x, y, g, links in found
        ),
        key=str,
    )


TEXTS = [
    "The quick brown fox, isn't it? 12345 <|endoftext|> <s> </s>", "naïve café – déjà vu… “quoted”", "日本語のテキスト と emoji 👩‍👩‍👧 🎉", "", None, " ", "  two  spaces\n\n\nlines\t\ttabs ",
    "a ▁ mark of the model itself", "x" * 300, "\u0085   odd blanks   ﻿", "Ünïcödé ǅ ǆ 𝔘𝔫𝔦 ℌ ²³¼ Ⅷ", "\x00\x01 controls \x7f", "The quick brown fox", "The quick brown fox", "한국어 नमस्ते ꬰ \U0001fae8",
]


def alignment(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("b", F.lit("clash"))
    return sorted((tuple(r) for r in token_alignment.align_tokenizers(df.repartition(3), *files()).collect()), key=str)


def files():
    return tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model")


@pytest.mark.parametrize("small", [False, True])
def test_alignment_is_that_of_brute_force(spark, monkeypatch, small):
    if small:  # pieces of little, B ids dealt over salts
        for name, value in (("CHUNK", 50), ("PAIRS", 10), ("SUMS", 20), ("GROUPS", 3), ("CELLS", 7), ("POSTINGS", 40)):
            monkeypatch.setattr(token_alignment, name, value)
    r = random.Random(8)
    rows = list(enumerate(TEXTS)) + [(100 + i, " ".join(r.choices(["the", "of", "Tokenization", "überall", "1999", "a.b", "e e"], k=r.randrange(1, 40)))) for i in range(30)]
    rows += [(None, "no id"), (100, "again")]
    assert alignment(spark, rows) == brute_alignment(rows, *token_alignment.sides(*files()))


def test_alignment_of_nothing(spark):
    assert alignment(spark, []) == []
    assert alignment(spark, [(1, None), (2, "")]) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_fast_ids_are_those_of_the_file():
    a, _ = token_alignment.sides(*files())
    r = random.Random(9)
    plain = ["".join(chr(r.choice([32, 10, 9, 39, 0x85, 0xA0, *range(33, 127), *range(0xC0, 0x250), *range(0x2010, 0x2028)])) for _ in range(60)) for _ in range(400)]
    assert all(token_alignment.PLAIN.fullmatch(t) for t in plain)
    for t, ids in zip(plain, a.encode(plain), strict=True):
        assert ids.tolist() == a.slow.encode(t, add_special_tokens=False).ids


# audit


def brute_audit(rows, labels):
    masks = []
    for d, text, source in rows:
        t = text or ""
        words = WORD.findall(t)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": d is not None and any(e is not None and e < d and (u or "") == t for e, u, _ in rows),
        }
        told = [x for x in labels if d is not None and x[0] == d]
        masks.append((source or "", {k for k, v in fails.items() if v}, any(x[1] == 1 for x in told), any(x[2] == 1 for x in told)))
    out = []
    for part in sorted({m[0] for m in masks}):
        own = [m[1:] for m in masks if m[0] == part]
        total = Counter()
        for order in permutations("ABCDE"):
            for fails, _, _ in own:
                total[next((f for f in order if f in fails), None)] += 1
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                gone = [m for m in own if f in m[0] and not m[0] & before]
                out.append(
                    (part, "".join(order), step, sum(not m[0] & (before | {f}) for m in own), len(gone), sum(f in m[0] and bool(m[0] & before) for m in own),
                     sum(m[0] == {f} for m in own), sum(m[1] for m in gone), sum(m[2] for m in gone), total[f])
                )
    return sorted(out)


def audit(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("part", F.lit("clash")).withColumn("print", F.lit(0)).withColumn("mask", F.lit(0))
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return sorted(tuple(r) for r in filter_audit.audit_filters(docs.repartition(3), told).collect())


def test_audit_is_that_of_brute_force(spark):
    r = random.Random(10)
    texts = ["", None, "one", "ONE $", " ".join(f"w{i}" for i in range(60)), " ".join(["the same"] * 40), " ".join(f"W{i}" for i in range(55)), "x | y " * 30, "w\x0bu v " * 60]
    rows = [(r.randrange(60), r.choice(texts), r.choice(["a", "b", "", None])) for _ in range(90)]
    rows += [(100 + i, texts[4], "hot") for i in range(200)]  # copies that fill several tasks
    rows += [(None, texts[4], "a"), (None, texts[2], "a"), (None, texts[2], "a")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 150, 2)] + [(None, 1, 1), (4, 1, 0), (4, 0, 1)]
    assert audit(spark, rows, labels) == brute_audit(rows, labels)


def test_audit_of_nothing(spark):
    assert audit(spark, [], []) == []


def test_copies_across_tasks_are_decided_once(spark):
    rows = [(i, "copy", "s") for i in range(500)] + [(1000 + i, f"own {i}", "s") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = filter_audit.failure_masks(df).where("mask >= 16")
    assert got.count() == 499 and got.where("doc_id = 0").isEmpty()
