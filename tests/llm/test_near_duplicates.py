import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import near_duplicates as nd

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets}


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class", F.lit("clash")).repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(df).collect()}
    assert got == brute(rows)


def text_of(r, n, words="abcdefghijklmnopqrstuvwxyz"):
    return " ".join("".join(r.choices(words, k=3)) for _ in range(n))


def test_groups_chains_and_strangers(spark):
    r = random.Random(3)
    rows, at = [], 0
    for _ in range(12):
        words = text_of(r, 80).split()
        for _ in range(r.randrange(1, 9)):
            rows.append((at, " ".join(words)))
            at += 3
            words[r.randrange(80)] = "edited"  # each a little further from the first
    rows += [(at + i, text_of(r, r.randrange(1, 60))) for i in range(40)]
    r.shuffle(rows)
    check(spark, rows)


def test_a_large_group_with_outliers_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nd, "SMALL", 4)
    monkeypatch.setattr(nd, "BLOCK", 8)
    r = random.Random(5)
    words = text_of(r, 60).split()
    rows = []
    for i in range(90):
        w = list(words)
        for _ in range(r.randrange(0, 4)):
            w[r.randrange(60)] = text_of(r, 1)
        rows.append((i, " ".join(w)))
    check(spark, rows)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one"), (5, "ONE"), (6, "one two three four"), (7, "x " * 9000), (8, "É a b c d"), (9, "é a b c d"), (10, "a\tb\nc d e f"), (11, "A b  c\rd e f")]
    check(spark, rows)


def test_repeated_rows_missing_ids_and_empty_table(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, "q r s t u v"), (None, None), (2, "a b c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(str((x.doc_id, x.component_id, x.kept)) for x in nd.near_duplicates(df).collect())
    assert got == sorted(map(str, [(5, 2, False)] * 2 + [(None, 2, False), (None, None, True), (None, None, True), (2, 2, True)]))
    assert nd.near_duplicates(df.where("false")).count() == 0


def test_shingle_hashes_do_not_depend_on_the_batch():
    r = random.Random(1)
    texts = [text_of(r, r.randrange(0, 40)) for _ in range(50)] + ["", "a", "a b c d", "a a a a a a a"]
    whole = nd.shingle_sets(texts)
    for t, s in zip(texts, whole, strict=True):
        assert np.array_equal(nd.shingle_sets([t])[0], s) and len(s) == len(shingles(t))


@pytest.mark.parametrize("piece", [1, 2, 7, 64])
def test_shingle_hashes_do_not_depend_on_the_pieces(monkeypatch, piece):
    r = random.Random(9)
    texts = [text_of(r, 30), "", " ", "x" * 500 + " y", "  lead\ttail  ", "é 🙂 " * 9, "one"]
    whole = nd.shingle_sets(texts)
    monkeypatch.setattr(nd, "PIECE", piece)
    assert all(np.array_equal(a, b) for a, b in zip(whole, nd.shingle_sets(texts), strict=True))


def test_a_long_text_takes_few_times_its_size():
    import tracemalloc

    r = random.Random(2)
    text = " ".join(str(r.randrange(10**6)) for _ in range(900_000))
    nd.shingle_sets(["warm up the tables of powers"])
    tracemalloc.start()
    (found,) = nd.shingle_sets([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) > 800_000 and peak < 10 * len(text)


def test_hot_buckets_and_hubs(spark, monkeypatch):
    from tallyloom.llm import common

    monkeypatch.setattr(common, "FEW_ROWS", 3)
    r = random.Random(8)
    words = text_of(r, 60).split()
    rows = [(i, " ".join(words[:k] + [text_of(r, 1)] + words[k + 1 :])) for i, k in enumerate(r.choices(range(60), k=50))] + [(100 + i, text_of(r, 30)) for i in range(20)]
    check(spark, rows)


def test_posterior_bound_keeps_similar_pairs():
    r = np.random.default_rng(2)
    a = r.integers(0, 1 << 16, (3000, nd.VALUES)).astype(np.uint16)
    same = r.random((3000, nd.VALUES)) < 0.75
    b = np.where(same, a, a + 1).astype(np.uint16)
    assert len(nd.surviving(a, b)) == 3000
    far = np.where(r.random((3000, nd.VALUES)) < 0.3, a, a + 1).astype(np.uint16)
    assert len(nd.surviving(a, far)) == 0
    assert [n for n, _ in nd.least_matches()] == list(range(nd.BATCH, nd.VALUES + 1, nd.BATCH))


@pytest.mark.parametrize("n", [2, 7, 40])
def test_components_of_chains_and_stars(spark, n):
    chain = [(i, i + 1) for i in range(n)]
    star = [(1000, 1001 + i) for i in range(n)]
    got = {r.node: r.component for r in nd.components(spark.createDataFrame(chain + star, "a long, b long").repartition(3)).collect()}
    assert got == {**{i: 0 for i in range(1, n + 1)}, **{1001 + i: 1000 for i in range(n)}}


def test_shared_counts():
    r = np.random.default_rng(3)
    a, b = ([np.unique(r.integers(0, 60, r.integers(1, 50)).astype(np.uint32)) for _ in range(k)] for k in (4, 5))
    got = nd.shared_counts(a, b)
    assert all(got[i, j] == len(np.intersect1d(x, y)) for i, x in enumerate(a) for j, y in enumerate(b))
