import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import language_id
from tallyloom.llm.language_id import CrossParser, SuffixAutomaton, identify_languages, labelled_samples
from tallyloom.llm.packing import WordTokenizer, cut_lengths, fit_leftovers, pack_documents
from tallyloom.llm.pieces import PieceModel, encode_documents
from tallyloom.llm.queries import tokenizer_file

ODD = [None, "", " ", "\n\n", "a", "日本 語 🙂", "x" * 9000, "word " * 4000, "<|endoftext|> s't", "▁x"]
SF = "/root/testdata/sf0.001/documents.parquet"
LETTERS = "aAbéÉßſİΣσς.,'’ \n\t\xa0́̊12½_-日本語ﬁ🙂\x01<|endoftext|>s'tǅ"


def odd(spark):
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(ODD)] + [(None, "null id here", None)], "doc_id long, text string, lang string")
    return df.unionByName(df.where("doc_id = 4")).withColumn("score", F.lit(1)).withColumn("class", F.lit("clash"))


def test_words_give_the_tokenizers_ids():
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    whole = Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    r = random.Random(3)
    texts = ["".join(r.choices(LETTERS, k=r.randrange(60))) for _ in range(3000)]
    got = WordTokenizer(path).encode(texts)
    for t, g, e in zip(texts, got, whole.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.asarray(e.ids, dtype="<u4").tobytes() == g, t


@pytest.mark.parametrize("tokens", [0, 1, 2, 65, 700, 1024, 1500, 2047, 2048, 2049, 9999])
def test_cuts_are_whole_and_fit_their_classes(tokens):
    cuts = cut_lengths(tokens, 2048, 32)
    assert sum(n for n, _ in cuts) == tokens
    assert all(n > 0 and n * k <= 2048 < n * (k + 1) for n, k in cuts)


def check_packing(data, texts, path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in data:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert sorted(by_seq) == list(range(len(by_seq)))
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    for i, t in texts.items():
        ids = np.asarray([*tok.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    totals = [sum(r.length for r in rows) for rows in by_seq.values()]
    return sum(2048 - n for n in totals if n & (n - 1)) / sum(totals)


def test_packing_of_documents_is_whole_and_tight(spark):
    path = tokenizer_file("word_bpe_49k.json")
    df = spark.read.parquet(SF)
    texts = {r.doc_id: r.text for r in df.collect()}
    assert check_packing(pack_documents(df, path).collect(), texts, path) < 0.03


def test_packing_of_odd_rows(spark):
    path = tokenizer_file("word_bpe_49k.json")
    df = odd(spark)
    data = pack_documents(df.where("doc_id is not null").dropDuplicates(["doc_id"]), path).collect()
    check_packing(data, dict(enumerate(ODD)), path)
    again = pack_documents(df, path)
    assert again.where("doc_id = 4 and start = 0").count() == 2 and again.where("doc_id is null").count() == 1
    assert pack_documents(df.where("false"), path).count() == 0


def test_full_bins_are_those_of_the_classes(spark):
    """Held against cutting and counting by hand: class k fills its count div k bins with k pieces each."""
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    df = spark.read.parquet(SF)
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    want = Counter()
    for r in df.collect():
        rest = len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1
        while rest:
            size = min(rest, 2048)
            k = 2048 // size
            if 2048 - k * size > 64 and k < 32:
                size = 2048 // (k + 1)
            want[2048 // size] += 1
            rest -= size
    data = pack_documents(df, path).collect()
    assert Counter(r["class"] for r in data) == want
    bins = defaultdict(list)
    for r in data:
        bins[r.sequence_id].append(r["class"])
    whole = sum(n // k for k, n in want.items())
    assert all(len(set(bins[i])) == 1 and len(bins[i]) == bins[i][0] for i in range(whole))
    assert Counter(bins[i][0] for i in range(whole)) == Counter({k: n // k for k, n in want.items() if n >= k})


def test_other_tokenizer_files_are_used_plainly():
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    whole, words = Tokenizer.from_file(path), WordTokenizer(path)
    whole.encode_special_tokens = True
    assert not words.apart and WordTokenizer(tokenizer_file("word_bpe_49k.json")).apart
    texts = ["A line, and  another\nDon't", "", "É🙂 x"]
    assert words.encode(texts) == [np.asarray(whole.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]


def test_leftovers_fit():
    import pandas as pd

    r = random.Random(2)
    pieces = pd.DataFrame({"doc_id": range(300), "start": 0, "length": [r.randrange(1, 101) for _ in range(300)]})
    got = fit_leftovers(pieces, 100)
    ends = got.assign(end=got.offset + got.length)
    assert ends.end.max() <= 100 and (got.groupby("bin").length.sum() == ends.groupby("bin").end.max()).all()
    assert got.bin.nunique() <= 11 / 9 * -(-pieces.length.sum() // 100) + 1


def phrases(text, sample):
    """Greedy longest matches by substring search; a symbol that is nowhere in the sample counts twice."""
    total = i = 0
    while i < len(text):
        n = 1
        while i + n < len(text) and text[i : i + n + 1] in sample:
            n += 1
        total += 1 if text[i] in sample else 2
        i += n
    return total


def test_cross_parsing_equals_substring_search():
    r = random.Random(7)
    samples = (("x", "".join(r.choices("abcd ", k=400))), ("y", "".join(r.choices("bcde ", k=300))))
    parser = CrossParser(samples)
    texts = ["".join(r.choices("abcdef. ", k=r.randrange(1, 1500))) for _ in range(20)] + ["", "...", "f", "abc"]
    plain = lambda t: re.sub(r"[^a-z]+", " ", t)
    got, counts, lettered = parser.phrases(texts)
    for t, row, n, has in zip(texts, got, counts, lettered, strict=True):
        assert n == len(plain(t)) and has == any(c.isalpha() for c in t)
        assert row.tolist() == [phrases(plain(t), plain(s)) for _, s in samples]


def test_automaton_has_all_substrings():
    text = [1, 2, 1, 2, 2, 3, 1, 2, 1]
    sam = SuffixAutomaton(text)
    for i in range(len(text)):
        s = 0
        for c in text[i:]:
            s = sam.next[s][c]
    assert len(sam.next) <= 2 * len(text)


def test_held_out_accuracy(spark):
    df = spark.read.parquet(SF.replace("0.001", "0.01"))
    got = identify_languages(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got) > 0
    assert all(0 <= r.score <= 1 for r in got)


def test_samples_leave_the_held_out_rows_alone(spark):
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 == 1]
    rows = [(i, "zz secret" if i in held else "aa bb", "held" if i in held else "l") for i in range(200)]
    df = spark.createDataFrame(rows + [(900, None, "l"), (None, "qq", "l"), (901, "rr", None)], "doc_id long, text string, lang string")
    samples = dict(labelled_samples(df))
    assert set(samples) == {"l"} and not any(x in samples["l"] for x in ("secret", "qq", "rr"))


def test_languages_of_odd_rows(spark):
    data = identify_languages(odd(spark), carry=("class",)).collect()
    assert len(data) == len(ODD) + 2
    unknown = {r.doc_id for r in data if r.lang_pred == "und"}
    assert unknown == {0, 1, 2, 3} and all(r["class"] == "clash" for r in data)
    assert [r.held_out for r in data if r.doc_id is None] == [False]
    nothing = identify_languages(odd(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    assert identify_languages(odd(spark).where("false")).count() == 0


@pytest.fixture(scope="module")
def model():
    return PieceModel(tokenizer_file("piece_bpe_32k.model"))


def best_score(model, pieces, text):
    """Plain dynamic programme over all substrings."""
    score = [0.0] + [-np.inf] * len(text)
    for e in range(1, len(text) + 1):
        for s in range(max(0, e - 48), e):
            if text[s:e] in pieces:
                score[e] = max(score[e], score[s] + pieces[text[s:e]])
        if text[e - 1] not in pieces:
            score[e] = max(score[e], score[e - 1] + model.worst)
    return score[-1]


def test_pieces_have_the_best_score_and_decode(model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    pieces = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    r = random.Random(4)
    texts = ["".join(r.choices("aeionrst thé日\n 🙂x", k=r.randrange(1, 40))) for _ in range(300)] + ["  a  b ", "\n", "the same thing, again."]
    for t in texts:
        raw = model.encode(t)
        ids = np.frombuffer(raw, dtype="<u4")
        text = "▁" + t.replace(" ", "▁")
        spelled = sum(len(c.encode()) for c in text if c not in pieces)
        unknown = sum(c not in pieces for c in text)
        assert model.is_byte[ids].sum() == spelled
        assert model.scores[ids][~model.is_byte[ids]].sum() + unknown * model.worst == pytest.approx(best_score(model, pieces, text))
        assert model.decode(raw) == t and sp.decode(ids.tolist()) == t.replace("▁", " ") or t.startswith(" ")


def test_pieces_of_documents_and_odd_rows(spark):
    path = tokenizer_file("piece_bpe_32k.model")
    assert encode_documents(spark.read.parquet(SF), path).where("not round_trip").count() == 0
    data = encode_documents(odd(spark), path).collect()
    assert len(data) == len(ODD) + 2
    assert {r.doc_id: r.round_trip for r in data}[9] is False
    assert all(r.round_trip for r in data if r.doc_id != 9)
    assert {r.doc_id: (r.n_pieces, r.ids) for r in data}[1] == (0, [])
    assert all(len(r.ids) == r.n_pieces for r in data)
    assert encode_documents(odd(spark).where("false"), path).count() == 0


def test_every_letter_keeps_its_symbol():
    r = random.Random(3)
    letters = [chr(0x4E00 + i) for i in range(2000)]
    samples = tuple((lang, "".join(r.choices(part, k=3000))) for lang, part in (("x", letters[:1200]), ("y", letters[800:])))
    parser = CrossParser(samples)
    texts = ["".join(r.choices(letters, k=r.randrange(1, 400))) for _ in range(10)] + [samples[0][1][40:300], samples[1][1][90:400]]
    got = parser.phrases(texts)[0]
    for t, row in zip(texts, got, strict=True):
        assert row.tolist() == [phrases(t, s) for _, s in samples]
    assert parser.predict(texts[-2:])[0] == ["x", "y"]


@pytest.mark.parametrize("tables", [1 << 30, 20_000, 0])
def test_phrases_go_on_across_blocks_at_any_table_size(monkeypatch, tables):
    monkeypatch.setattr(language_id, "TABLE_BYTES", tables)
    r = random.Random(5)
    long = "".join(r.choices("abc", k=4000))
    samples = (("x", long), ("y", "ab" * 900 + "".join(r.choices("abcd", k=50))), ("z", "".join(r.choices("abcdefgh", k=500))))
    parser = CrossParser(samples)
    texts = [long, long[100:3100], long[7:1500] + long[2000:3900], "ab" * 3000, "c" + "ab" * 800 + "d" + "ba" * 700, "".join(r.choices("abcdh", k=2600)), "a" * 512, "a" * 513, ""]
    for t, row in zip(texts, parser.phrases(texts)[0], strict=True):
        assert row.tolist() == [phrases(t, s) for _, s in samples]


def test_two_large_alphabets_beside_a_third_language():
    r = random.Random(11)
    alphabets = [[chr(0x4E00 + i) for i in range(1000)], [chr(0xAC00 + i) for i in range(1000)], list("abcdefghijklmnopqrstuvwxyz ")]
    draw = lambda letters, n: "".join(r.choices(letters, k=n))
    parser = CrossParser(tuple((f"l{i}", draw(letters, 6000)) for i, letters in enumerate(alphabets)))
    texts = [draw(alphabets[i % 3], 200) for i in range(60)]
    langs, scores = parser.predict(texts)
    assert langs == [f"l{i % 3}" for i in range(60)] and min(scores) > 0


def test_samples_are_cut_before_they_are_collected(spark):
    rows = [(i, "... " + "wordy " * 5000, "l") for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1]
    df = spark.createDataFrame(rows * 3, "doc_id long, text string, lang string")
    ((lang, text),) = labelled_samples(df, max_docs=8, max_chars=800)
    parts = text.split("\n")
    assert lang == "l" and len(text) <= 800 + len(parts) and len(parts) <= 8 and all(p.startswith("wordy ") for p in parts)
