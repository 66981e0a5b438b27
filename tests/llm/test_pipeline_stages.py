"""Every stage on its own: missing ids, repeated rows, empty and very long texts, other columns, no rows."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
STAGES = dict(cp.STAGES)


def prose(r, n, words=None):
    words = words or ["".join(r.choices("abcdefghijklmnop", k=r.randrange(3, 9))) for _ in range(400)]
    return " ".join(r.choices(words, k=n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    out = [(i, prose(r, 60), "en" if i % 2 else None, f"s{i % 3}", 1) for i in range(40)]
    out.append((40, out[0][1], "en", "s0", 1))  # a copy
    out.append((41, None, "en", "s0", None))
    out.append((42, "", None, None, 0))
    out.append((43, "\n \t\n", "en", "s1", 3))
    out.append((44, prose(r, 60_000), "en", "s2", 1))  # very long
    out += [(None, prose(r, 60), None, "s0", 1)] * 2
    out += [(45, prose(r, 60), "en", None, 1)] * 3
    return out


def frame(spark, rows):
    clash = {c: F.lit("clash") for c in ("class", "print", "_text", "kept", "component_id", "lang_pred", "part")}
    return spark.createDataFrame(rows, DOCS).withColumns(clash).repartition(3)


def told(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()), key=str)


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES[:-1]])
def test_a_stage_returns_documents_and_takes_no_rows(spark, rows, name):
    made = STAGES[name](spark, frame(spark, rows), "")
    assert made.columns == cp.COLUMNS
    assert STAGES[name](spark, frame(spark, rows).where("false"), "").count() == 0


def test_quality_rules_keep_rows_without_id_and_repeats(spark, rows):
    got = told(STAGES["quality rules"](spark, frame(spark, rows), ""))
    want = [(d, t) for d, t, *_ in rows if t and len(t.split()) >= 20 and d != 44]
    assert [x for x in got if x[0] != 44] == sorted(want, key=str)


def test_language_id_decides_row_by_row(spark, rows):
    got = told(STAGES["language id"](spark, frame(spark, rows), ""))
    assert got == sorted([(d, t) for d, t, *_ in rows if t and t.strip()], key=str)


def test_line_dedup_counts_copies_once_and_keeps_what_had_no_word_to_lose(spark, rows):
    got = told(STAGES["line dedup"](spark, frame(spark, rows), ""))
    ids = [d for d, _ in got]
    assert {0, 40, 41, 42, 43, 44} <= set(ids)
    assert ids.count(45) in (1, 3) and 44 in ids


def test_near_dedup_keeps_one_of_each(spark, rows):
    got = told(STAGES["near duplicates"](spark, frame(spark, rows), ""))
    ids = [d for d, _ in got]
    assert None not in ids and 40 not in ids and ids.count(45) == 1 and set(range(40)) <= set(ids) and {41, 42, 43, 44} <= set(ids)


def test_packing_takes_every_token_of_every_row(spark, rows):
    made = STAGES["packing"](spark, frame(spark, rows), "").collect()
    per_row = {}
    for r in made:
        per_row.setdefault((r["doc_id"], r["doc_tokens"]), []).append(r)
    assert sum(r["length"] for r in made if r["doc_id"] == 44) == next(r["doc_tokens"] for r in made if r["doc_id"] == 44)
    assert sum(r["length"] for r in made if r["doc_id"] == 45) == 3 * next(r["doc_tokens"] for r in made if r["doc_id"] == 45)
    assert sum(1 for r in made if r["doc_id"] is None and r["start"] == 0) == 2
    for sequence in {r["sequence_id"] for r in made}:
        own = sorted((r["offset"], r["length"]) for r in made if r["sequence_id"] == sequence)
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and own[0][0] == 0 and own[-1][0] + own[-1][1] <= 2048
    assert STAGES["packing"](spark, frame(spark, rows).where("false"), "").count() == 0
