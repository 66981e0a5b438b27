import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.llm.line_frequency import rule_documents
from tallyloom.llm.line_templates import drop_recurring_lines
from tallyloom.llm import sharding
from tallyloom.llm.sharding import hilbert_positions, rank_bounds, shard_bounds, shard_documents

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs(spark, texts, source="s", first=0):
    return spark.createDataFrame([(first + i, t, "en", source, None) for i, t in enumerate(texts)], SCHEMA)


ODD = [None, "", " ", "\n\n", "a", "\t\x0b\x0c\r", "日本 語", "🙂🙂 #", "x" * 5000, "w " * 3000]


@pytest.mark.parametrize(("dims", "bits"), [(2, 3), (3, 2), (1, 4), (4, 2)])
def test_curve_visits_every_cell_by_single_steps(dims, bits):
    at = hilbert_positions(dims, bits)
    assert sorted(at) == list(range(1 << dims * bits))
    cells = [c for _, c in sorted((p, c) for c, p in enumerate(at))]
    split = lambda c: [c >> bits * d & (1 << bits) - 1 for d in range(dims)]
    for a, b in zip(cells, cells[1:], strict=False):
        assert sum(abs(x - y) for x, y in zip(split(a), split(b), strict=True)) == 1


def check_shards(data, shards):
    by = defaultdict(list)
    for r in data:
        by[r.shard].append(r.slot)
    sizes = [len(by[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1 and set(by) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_shards_of_odd_and_repeated_rows(spark):
    df = docs(spark, ODD + ["same"] * 20).unionByName(docs(spark, ["same"] * 3, None)).withColumn("shard", F.lit("clash"))
    df = df.unionByName(df.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    data = shard_documents(df).collect()
    assert len(data) == len(ODD) + 24
    check_shards(data, 8)
    for r in data:
        if r.doc_id is not None and r.doc_id < len(ODD) and r.doc_id > 2:
            raw = (ODD[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) in {(len(raw) + 1, zlib.crc32(raw)), (5, zlib.crc32(b"same"))}
    assert shard_documents(df.where("false")).count() == 0


def test_shards_follow_the_curve(spark):
    data = shard_documents(docs(spark, ["y" * (1 << i % 9) for i in range(200)]), shards=5).collect()
    check_shards(data, 5)
    along = sorted(data, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in along] == sorted(r.curve for r in data)


def test_cells_follow_the_order_of_values(spark):
    names = [None, *(f"s{i:03d}" for i in range(60)), *["s030"] * 70, "é", "Z"]
    df = spark.createDataFrame([(n,) for n in names], "source string").repartition(5)
    bounds = rank_bounds(df, ["source"], 4)["source"]
    want = {v: 16 * sum((x or "") < v for x in names) // len(names) for v in {n or "" for n in names}}
    got = df.select("source", sharding.name_cell(F.col("source"), bounds).alias("cell")).distinct().collect()
    assert {r.source or "": r.cell for r in got} == want
    assert rank_bounds(df.where("false"), ["source"], 4) == {"source": []}


def test_bounds_let_a_reader_skip_shards(spark):
    rows = [(i, "x" * (1 << i % 9), f"l{i % 4}", f"site{i % 50:02d}", None) for i in range(2000)]
    placed = shard_documents(spark.createDataFrame(rows, SCHEMA).repartition(3), carry=("source", "lang"))
    check_shards(placed.collect(), 8)
    bounds = shard_bounds(placed, ["source", "lang", "size"]).collect()
    assert sum(r.rows for r in bounds) == 2000 and all(r.nulls_source == 0 for r in bounds)
    hit = lambda c, low, high: sum(r[f"min_{c}"] <= high and r[f"max_{c}"] >= low for r in bounds)
    assert hit("source", "site00", "site04") <= 4 and hit("lang", "l0", "l0") <= 4


def test_large_cells_get_more_parts(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PARTS", 2)
    monkeypatch.setattr(sharding, "PART_ROWS", 10)
    check_shards(shard_documents(docs(spark, ["same"] * 300)).collect(), 8)


def base(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    return {
        "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text or ""),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
        "base_failed": n < 20 or 100 * len(covered) > 30 * n,
    }


def line_verdicts(rows, max_share=0.1, min_docs=20, min_left=0.3):
    """Brute force over (text, source)."""
    def normal(line):
        return re.sub(" {2,}", " ", re.sub("[1-9]", "0", line.lower()).translate(str.maketrans("\t\x0b\x0c\r", "    "))).strip(" ")

    hosts, having = defaultdict(set), defaultdict(set)
    for t, s in rows:
        hosts[s].add(t or "")
        for x in (t or "").split("\n"):
            if normal(x):
                having[s, normal(x)].add(t or "")
    out = []
    for t, s in rows:
        n = len(WORD.findall(t or ""))
        gone = sum(len(normal(x).split(" ")) for x in (t or "").split("\n") if normal(x) and len(having[s, normal(x)]) >= min_docs and len(having[s, normal(x)]) > max_share * len(hosts[s]))
        out.append(not base(t)["base_failed"] and not (n - gone) < n * min_left)
    return out


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from("ab\n #é\t🙂"), max_size=120), min_size=1, max_size=6))
def test_base_counts_equal_brute_force(spark, texts):
    got = {r.doc_id: r for r in rule_documents(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        for k, v in base(t).items():
            assert getattr(got[i], k) == v, k


def test_rules_equal_brute_force_on_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in df.collect()]
    got = {r.doc_id: r for r in rule_documents(df).collect()}
    want = line_verdicts([(t, s) for _, t, s in rows])
    for (i, t, _), kept in zip(rows, want, strict=True):
        assert got[i].kept == kept
        assert all(getattr(got[i], k) == v for k, v in base(t).items())


def test_frequent_lines_deplete_but_copies_do_not(spark):
    own = lambda i: " ".join(f"w{chr(97 + i % 26)}{chr(97 + j)}{'x' * (i // 26)}" for j in range(24))
    boiler = " ".join(f"menu{chr(97 + j)}" for j in range(22))
    texts = [f"{own(i)}\n{boiler}" for i in range(40)] + [f"{boiler}\nonly{'y' * i}" for i in range(5)] + [own(60)] * 50
    rows = [(t, "h") for t in texts]
    got = [r.kept for r in rule_documents(docs(spark, texts, "h")).orderBy("doc_id").collect()]
    assert got == line_verdicts(rows)
    assert got[:40] == [True] * 40 and got[40:45] == [False] * 5 and got[45:] == [True] * 50


def test_rules_on_odd_rows(spark):
    df = docs(spark, ODD, None).unionByName(docs(spark, ODD)).withColumn("kept", F.lit(1))
    data = rule_documents(df).collect()
    assert len(data) == 2 * len(ODD) and not any(r.kept for r in data)
    assert rule_documents(df.where("false")).count() == 0


LONG = "the quick brown fox jumps over the lazy dog number {} today again"


def test_templates_recur_over_numbers_and_one_changed_word(spark):
    texts = ["own line one\n" + LONG.format(17), LONG.format(4) + "\nother words here", LONG.format("seven"), "clean text stands here alone and has no line that others share", None, "", "short\nshort"]
    got = {r.doc_id: r for r in drop_recurring_lines(docs(spark, texts)).collect()}
    assert got[0].text == texts[0] and got[0].n_dropped == 0
    assert got[1].text == "other words here" and got[1].n_dropped == 1 and not got[1].emptied
    assert got[2].text == "" and got[2].emptied
    assert [got[i].text for i in (3, 4, 5, 6)] == texts[3:]
    assert (got[4].n_lines, got[5].n_lines, got[6].n_lines) == (0, 1, 2)


def test_exact_copies_keep_their_lines(spark):
    text = "a line of more than eight words that stands in both copies\nsecond"
    got = drop_recurring_lines(docs(spark, [text] * 30)).collect()
    assert all(r.text == text for r in got)


def test_line_dedup_keeps_columns_and_rows(spark):
    df = docs(spark, ODD + [LONG.format(1), LONG.format(2)]).withColumn("extra", F.lit(5)).withColumn("n_lines", F.lit("clash")).withColumn("_copy", F.lit(0))
    df = df.unionByName(df.where("doc_id = 10"))
    got = drop_recurring_lines(df)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "extra", "_copy", "n_lines", "n_dropped", "emptied"]
    assert got.count() == len(ODD) + 3 and got.where("n_dropped > 0").count() == 1
    assert drop_recurring_lines(df.where("false")).count() == 0


def test_different_lines_of_one_leaf_stay(spark):
    head = "these four words begin "
    texts = [head + " ".join(f"{c}{i}".translate(str.maketrans("0123456789", "abcdefghij")) for i in range(8)) for c in "pqrstu"]
    assert all(r.n_dropped == 0 for r in drop_recurring_lines(docs(spark, texts)).collect())


def masked(line):
    line = re.sub("[1-9]", "0", line.lower()).translate(str.maketrans("\t\x0b\x0c\r", "    "))
    return re.sub("0{2,}", "0", re.sub(" {2,}", " ", line)).strip(" ")


def brute_drops(rows, depth=4, min_tokens=8, similarity=0.6, min_docs=2):
    """Texts without their recurring lines, by the method's words: each leaf's lines, the most widespread
    first, join the first template whose seed they are like, or found one."""
    leaves = defaultdict(lambda: defaultdict(set))
    for i, t in rows:
        for x in (t or "").split("\n"):
            tokens = tuple(masked(x).split(" "))
            if masked(x) and len(tokens) >= min_tokens:
                leaves[len(tokens), tokens[:depth] if len(tokens) >= 8 else tokens][tokens].add(t)
    owner = {}
    for lines in leaves.values():
        templates = []
        for x in sorted(lines, key=lambda x: (-len(lines[x]), x)):
            for members in templates:
                if sum(a == b for a, b in zip(x, members[0], strict=True)) >= similarity * len(x):
                    members.append(x)
                    break
            else:
                templates.append([x])
        for members in templates:
            having = set().union(*(lines[x] for x in members))
            if len(having) >= min_docs:
                first = min(having, key=lambda t: min(i for i, u in rows if u == t))
                owner |= {x: first for x in members}
    return {i: t if t is None else "\n".join(x for x in t.split("\n") if owner.get(tuple(masked(x).split(" ")), t) == t) for i, t in rows}


@pytest.mark.parametrize("seed", range(2))
def test_templates_equal_brute_force(spark, seed):
    import random

    r = random.Random(seed)
    stock = [[r.choice("abcdefg") * r.randrange(1, 3) for _ in range(r.randrange(6, 12))] for _ in range(12)]
    texts = []
    for _ in range(60):
        lines = []
        for _ in range(r.randrange(0, 5)):
            line = list(r.choice(stock))
            for _ in range(r.randrange(0, 4)):
                line[r.randrange(len(line))] = r.choice(["x", "y", str(r.randrange(99))])
            lines.append(r.choice([" ", "  "]).join(line))
        texts.append("\n".join(lines))
    rows = list(enumerate(texts + texts[:5]))
    for min_docs in (2, 3, 5):
        got = {x.doc_id: x.text for x in drop_recurring_lines(docs(spark, [t for _, t in rows]), min_docs=min_docs).collect()}
        assert got == brute_drops(rows, min_docs=min_docs)


def test_second_template_of_a_leaf_is_dropped_too(spark):
    head = "the daily report for "
    texts = [f"{head}{x} shows that all is well" for x in ("mars", "venus", "pluto")] + [f"{head}omega costs stayed {x} while none other fell much" for x in ("high", "low")]
    texts += [f"{head}saturn says that all is lost now", "the line beside them"]
    got = {r.doc_id: r.n_dropped for r in drop_recurring_lines(docs(spark, texts)).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 0, 4: 1, 5: 0, 6: 0} and {i: t for i, t in brute_drops(list(enumerate(texts))).items() if t} == {i: texts[i] for i in (0, 3, 5, 6)}


def test_two_variants_in_one_text_count_once(spark):
    texts = [LONG.format("one") + "\n" + LONG.format("two"), LONG.format("three"), "another line of some length that stands here alone"]
    assert [r.n_dropped for r in drop_recurring_lines(docs(spark, texts), min_docs=3).orderBy("doc_id").collect()] == [0, 0, 0]
    assert [r.n_dropped for r in drop_recurring_lines(docs(spark, texts), min_docs=2).orderBy("doc_id").collect()] == [0, 1, 0]


def test_hot_lines_and_copies_are_dealt_over_tasks(spark, monkeypatch):
    from tallyloom.llm import common

    monkeypatch.setattr(common, "FEW_ROWS", 3)

    texts = ["one line that all rows have here and there today\nown " + "z" * (i // 3) for i in range(90)]
    frame = docs(spark, texts).repartition(3)
    keys = frame.select("doc_id", F.xxhash64("source").alias("k"))
    joined = common.salted_join(keys, keys.select("k").distinct().withColumn("v", F.lit(1)), ["k"], keys.groupBy("k").agg(F.count(F.lit(1)).alias("_weight")), F.xxhash64("doc_id"), parts=40)
    assert joined.count() == 90 and joined.columns == ["k", "doc_id", "v"]
    assert "_salts" in joined._jdf.queryExecution().toString()
    assert {x.doc_id: x.text for x in drop_recurring_lines(frame).collect()} == brute_drops(list(enumerate(texts)))


def test_templates_equal_brute_force_on_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(x.doc_id, x.text) for x in df.collect()]
    assert {x.doc_id: x.text for x in drop_recurring_lines(df).collect()} == brute_drops(rows)


def test_query_and_stage_drop_short_lines(spark, tmp_path):
    import corpus_pipeline
    from tallyloom.llm.queries import queries

    texts = ["own first\nAll rights reserved.\nPage 3 of 9", "page 12 of  40\nall rights reserved.\nown second", "these are five words one", "these are five words two", "}"]
    df = docs(spark, texts)
    df.write.parquet(str(tmp_path / "documents.parquet"))
    want = {0: texts[0], 1: "own second", 2: texts[2], 3: texts[3], 4: "}"}
    assert {r.doc_id: r.text for r in queries()["op2_template_line_dedup"](spark, str(tmp_path)).collect()} == want
    assert {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, df, str(tmp_path)).collect()} == want


def test_stage_passes_on_text_without_frequent_lines(spark):
    import corpus_pipeline

    own = lambda i: " ".join(f"w{chr(97 + i)}{chr(97 + j)}" for j in range(24))
    texts = [f"Menu  {i % 10}\n\n{own(i)}\nend" for i in range(25)] + [own(25)] + [f"Menu  3\n\n{own(3)}\nend"]
    got = {r.doc_id: r for r in corpus_pipeline.quality_rules(spark, docs(spark, texts).withColumn("n_chars", F.length("text").cast("long")), "").collect()}
    assert len(got) == len(texts)
    for i, r in got.items():
        want = own(25) if i == 25 else "\n" + own(3 if i == 26 else i)
        assert (r.text, r.n_chars) == (want, len(want))
    other = corpus_pipeline.quality_rules(spark, docs(spark, texts[:25], "a").unionByName(docs(spark, texts[:3], "b", 50)), "")
    assert {r.text for r in other.where("source = 'b'").collect()} == set(texts[:3])


def test_a_leaf_holds_many_templates(spark):
    words = lambda k: " ".join(f"{'abcdefghijklmnopqrstuvwxyz'[k]}{c}" for c in "ghij")
    texts = [f"a b c d {x} {words(k)}" for k in range(22) for x in ("one", "two", "three")] + ["a b c d stands beside them in the leaf"] * 2
    texts[-1] += "\nown"
    got = [r.n_dropped for r in drop_recurring_lines(docs(spark, texts)).orderBy("doc_id").collect()]
    assert got == [0, 1, 1] * 22 + [0, 1]
