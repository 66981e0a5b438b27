import base64
import gzip
import hashlib
import html
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm import archives, html_text, topk
from tallyloom.llm.html_text import Node, extract_pages, main_text, parse
from tallyloom.llm.queries import queries

PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize("version", [1, 2])
def test_arc_records_by_their_lengths(version):
    payloads = [b"", b"a\n\nhttp://x 0.0.0.0 20200101000000 text/html 3\nabc", "é\r\n\r\n".encode(), b"\n"]
    data = archives.arc_header("n.arc", "20240101000000", version) + b"".join(archives.arc_record(version, f"http://h/{i}?q=a b", "1.2.3.4", "20240102", "text/html", p) for i, p in enumerate(payloads))
    got = list(archives.read_arc(data))
    assert [r.fields["url"] for r in got] == [f"http://h/{i}?q=a b" for i in range(4)]
    assert got[1].payload == payloads[1] and got[2].payload == payloads[2]
    with pytest.raises(archives.ArchiveError):
        list(archives.read_arc(data[:-20] if len(data) > 20 else data))
    with pytest.raises(archives.ArchiveError):
        list(archives.read_arc(b"http://x 0.0.0.0 20200101000000 text/html 0\n"))


def test_dates_and_identifiers():
    assert archives.warc_date("20240203040506") == "2024-02-03T04:05:06Z"
    assert archives.warc_date("2024") == "2024-01-01T00:00:00Z"
    assert archives.record_id("a", "1") == archives.record_id("a", "1") != archives.record_id("a", "2")
    with pytest.raises(archives.ArchiveError):
        archives.warc_date("yesterday")


def test_archives_round_trip(spark):
    rows = [(1, "u", None), (2, None, "x" * 1200), (3, "u 1\n", "x" * 1200), (4, "é", "x" * 1200), (5, "z", "é" * 500), (6, "z", "é" * 500), (7, "y", "a\r\n\r\nb WARC/1.1"), (None, "q", "x" * 1200), (8, "s", "y" * 999), (9, "s", "y" * 999)]
    pages = spark.createDataFrame(rows, PAGES).withColumn("digest", F.lit("clash")).repartition(3)
    got = {r.page_id: r for r in archives.archive_pages(pages).collect()}
    assert len(got) == len(rows)
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert {i: got[i].refers_to for i in got if got[i].record_type == "revisit"} == {2: 4, 3: 4, None: 4, 5: 6}
    assert archives.archive_pages(pages.where("false")).count() == 0


@pytest.mark.parametrize("limit", [1, 2500, 1 << 20])
def test_written_archives_are_arc_and_warc(spark, tmp_path, monkeypatch, limit):
    rows = [(i, f"http://a/{i}?x=#y z", chr(97 + i % 3) * (1000 + i % 3)) for i in range(12)] + [(None, None, None)]
    pages = spark.createDataFrame(rows, PAGES).coalesce(1)
    paths = [str(tmp_path / x) for x in ("arc", "warc")]
    archives.write_arc(pages, paths[0], limit=limit)
    arcs = [p.read_bytes() for p in sorted((tmp_path / "arc").glob("part-*"))]
    assert len(arcs) == {1: 13, 2500: 12, 1 << 20: 1}[limit] or limit == 2500
    plain = [gzip.decompress(a) for a in arcs]
    assert all(a.startswith(b"filedesc://") for a in plain) and (len(arcs) == 1 or {a.split(b"\n")[1][:1] for a in plain} == {b"1", b"2"})
    got = [r for a in arcs for r in archives.read_arc(a)]
    assert sorted((archives.split_identity(r.fields["url"]), r.payload) for r in got) == sorted(
        ((archives.clean_url(u), "" if i is None else str(i)), (h or "").encode()) for i, u, h in rows
    )
    frame = archives.files(spark, paths[0])
    archives.write_warc(frame, archives.revisits(archives.arc_digests(frame, "bigint"), 1000), paths[1])
    data = b"".join(p.read_bytes() for p in (tmp_path / "warc").glob("part-*"))
    assert data.count(b"\x1f\x8b\x08") >= len(rows) and b"WARC-Type: warcinfo" in gzip.decompress(data)
    records = {f["X-Page-ID"]: (f, b) for f, b in archives.read_warc(data) if f["WARC-Type"] != "warcinfo"}
    for i in range(12):
        f, block = records[str(i)]
        holder = 9 + i % 3
        assert base64.b32decode(f["WARC-Payload-Digest"][5:]) == hashlib.sha1(rows[i][2].encode()).digest()
        if i == holder:
            assert (f["WARC-Type"], block) == ("response", rows[i][2].encode())
        else:
            assert f["WARC-Refers-To"] == records[str(holder)][0]["WARC-Record-ID"] and block == b""


def test_archives_of_other_encodings_and_broken_ones():
    raw = "café".encode("latin-1") + b"\xff\x00\n"
    data = archives.members([archives.arc_header("n", "2024", 2), archives.arc_record(2, "http://h/", "::1", "20240102030405", "text/html", raw)])
    (arc,) = archives.read_arc(data)
    assert arc.payload == raw and arc.fields["ip"] == "::1"
    (record,) = archives.read_warc(archives.members([archives.converted(arc, None)]) + archives.EMPTY_MEMBER)
    assert record[1] == raw and record[0]["WARC-Date"] == "2024-01-02T03:04:05Z"
    for broken in (data[:-5], b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc", b"no archive"):
        with pytest.raises(archives.ArchiveError):
            list((archives.read_arc if broken is not None and broken[:2] == b"\x1f\x8b" else archives.read_warc)(broken))
    long = archives.arc_record(1, "http://h/", "0.0.0.0", "2024", "t", b"x" * 30_000_000)
    begun = time.process_time()
    (arc,) = archives.read_arc(archives.arc_header("n", "2024", 1) + long)
    assert len(arc.payload) == 30_000_000 and time.process_time() - begun < 10


ARTICLE = "<h1>Title &amp; more</h1><p>First <b>bold</b>\n text of some length, it goes on and on.<p>Second &lt;tag&gt; paragraph, longer than any menu is.</p>"


@pytest.mark.parametrize(
    "frame",
    [
        "<nav><a href=a>menu</a></nav><article>{}</article><footer>&copy; x</footer>",
        "<div class='menu'><ul><li><a href=a>one</a><li><a href=b>two</a></ul></div><div id=content>{}</div><div class='sidebar'><p>Other things to read here and there</p></div><div id='comments'><p>Nice one, I have read it twice already and more</p></div>",
        "<div id='topMenu'><p>Go here or there</p></div><div class='post'>{}</div><ol class='commentlist'><li>A reader says this and that at some length</ol><div class='CookieBar'>We use cookies</div>",
        "<header><h2>Site</h2></header><main><div>{}<form><input value=x><p>Subscribe now to get all</p></form><script>var a='<p>no</p>'</script></div></main><aside>aside</aside>",
        "<div role=navigation><p>Skip</p></div><section>{}<div class='ad banner'>Buy this thing now, it is good</div><!-- <p>hidden</p> --><style>p{{}}</style></section>",
    ],
)
def test_main_text_of_frames(frame):
    want = "Title & more First bold text of some length, it goes on and on. Second <tag> paragraph, longer than any menu is."
    assert main_text(f"<!DOCTYPE html><html><head><title>No</title></head><body>{frame.format(ARTICLE)}</body></html>") == want


def test_main_text_of_odd_pages(spark):
    odd = [None, "", " \n", "plain words only", "<p>one", "<b><i>x</b></i>", "</p></div>a", "<div" , "<!-- open", "a<br>b", "<p>" * 3000 + "deep", "<table><tr><td>a<td>b<tr><td>c</table>"]
    want = ["", "", "", "plain words only", "one", "x", "a", "<div", "", "a b", "deep", "a b c"]
    assert [main_text(h) for h in odd] == want
    pages = spark.createDataFrame([(i, None, h) for i, h in enumerate(odd)] + [(None, "u", "<p>x"), (3, None, "<p>x")], PAGES).withColumn("text", F.lit("clash"))
    data = extract_pages(pages).collect()
    assert len(data) == len(odd) + 2 and all(r.n_chars == len(r.text) for r in data)
    assert extract_pages(pages.where("false")).count() == 0


ODD_FRAMES = ['<div class="layout has-sidebar">{}</div>', '<div class="content no-comments">{}</div>', '<div class="post-comments-off">{}</div>', '<article class="post related-topics">{}</article>', '<div class="sidebar">{}</div>']


@pytest.mark.parametrize("frame", ODD_FRAMES)
def test_class_names_do_not_empty_an_article(frame):
    want = "Title & more First bold text of some length, it goes on and on. Second <tag> paragraph, longer than any menu is."
    page = f"<body><nav><a href=a>menu</a></nav>{frame.format(ARTICLE)}<footer>foot</footer></body>"
    assert main_text(page) == want
    assert main_text(page.replace("<h1>", '<h1 class="article-header">')) == want


@pytest.mark.parametrize("unit", ["<a '", "<a ", "<", "<a href=\"", "<b></x>", "<b><ul>", "<p><td><i><ul>", "<!--", "<div>", "<script>", "<p>w "])
def test_long_odd_pages_take_linear_time(unit):
    begun = time.process_time()
    main_text(unit * (300_000 // len(unit)))
    assert time.process_time() - begun < 10


def brute_nodes(root):
    """The chosen nodes by the definitions, each looked up anew over whole subtrees."""

    def below(n):
        return [n] + [x for c in n.children if isinstance(c, Node) and not c.unseen for x in below(c)]

    def chars(n):
        return sum(len(c.replace(" ", "").replace("\n", "")) for x in below(n) for c in x.children if isinstance(c, str))

    def link_chars(n):
        return sum(chars(x) for x in below(n) if x.tag == "a" and not any(y.tag == "a" and x in below(y)[1:] for y in below(n)))

    def density(n):
        c, lc = chars(n), link_chars(n)
        t, links = len(below(n)) - 1, sum(x.tag == "a" for x in below(n))
        if not c:
            return 0.0
        base = math.log(c / max(c - lc, 1) * max(lc, 1) + link_chars(root) / chars(root) * c + math.e)
        return c / max(t, 1) * max(0.0, math.log(max(1.0, c / max(lc, 1) * max(t, 1) / max(links, 1)), base))

    def kept(n):
        while n is not None:
            if n.dropped:
                return False
            n = n.parent
        return True

    def inside(n):
        return [c for c in n.children if isinstance(c, Node) and not c.unseen and kept(c)]

    def total(n):
        solid = [c for c in inside(n) if c.tag not in html_text.VOID]
        return sum(density(c) for c in solid) if solid else density(n)

    def best(n):
        return max([x for x in below(n) if kept(x)], key=lambda x: round(total(x), 6))

    def up(n, stop):
        return [n] if n is stop else [n, *up(n.parent, stop)]

    core = best(root)
    threshold = min((density(n) for n in up(core, root) if n.tag not in ("#root", "html") and density(n) > 0), default=math.inf)
    out = []

    def take(n, chosen, path):
        if n in chosen:
            out.append(n)
            return
        for c in inside(n):
            if c in path:
                take(c, chosen, path)
            elif chars(c) and density(c) >= threshold - 1e-9:
                chosen, path = chosen | {best(c)}, path | set(up(best(c), c))
                take(c, chosen, path)

    take(root, {core}, set(up(core, root)))
    return out


def random_page(r, depth=0):
    tags = ["div", "p", "section", "ul", "li", "a", "b", "h2", "br", "span", "nav", "article"]
    out = []
    for _ in range(r.randint(1, 4)):
        tag = r.choice(tags)
        words = "word " * r.randint(0, 25) if r.random() < 0.6 else ""
        out.append("<br>" if tag == "br" else f"{words}<{tag}>{random_page(r, depth + 1) if depth < 3 else words}</{tag}>")
    return "".join(out)


@pytest.mark.parametrize("seed", range(40))
def test_chosen_nodes_equal_plain_definitions(seed):
    page = f"<html><body>{random_page(random.Random(seed))}</body></html>"
    a, b = parse(page), parse(page)
    got = html_text.main_nodes(a)
    html_text.settle(html_text.in_order(b))
    places = [{id(n): i for i, n in enumerate(html_text.in_order(t))} for t in (a, b)]
    assert [places[0][id(n)] for n in got] == [places[1][id(n)] for n in brute_nodes(b)]


WRAPPERS = "ad-free-text social-policy two-sidebar-layout page-header-fixed story-share comment-piece newsletter-issue recommended-reading promo-page comments sidebar".split()
PARAGRAPHS = [f"This is paragraph {i} of the article, of some length and sense, and it goes on for a while." for i in range(8)]
BODY = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)


@pytest.mark.parametrize("name", WRAPPERS)
def test_a_name_never_takes_the_article_away(name):
    page = f"<body><nav><a href=x>a</a><a href=y>b</a></nav><h1>Head of the whole article</h1><div class='{name}'>{BODY}</div><footer>f</footer></body>"
    assert main_text(page).endswith(" ".join(PARAGRAPHS)) and "foot" not in main_text(page)


def test_wrappers_references_and_headers_of_an_article_stay():
    want = " ".join(["Head", *PARAGRAPHS])
    assert main_text(f"<body><form id=aspnet><h1>Head</h1><div>{BODY}</div></form></body>") == " ".join(PARAGRAPHS)
    assert main_text(f"<body><form><div><h1>Head</h1>{BODY}</div></form></body>") == want
    references = [f"Author {i} (2001), a paper with a title of its own, in a journal" for i in range(6)]
    page = f"<body><nav><a href=x>a</a></nav><article><h1>Head</h1>{BODY}<ul>{''.join(f'<li><a href={i}>{t}</a>' for i, t in enumerate(references))}</ul></article></body>"
    assert main_text(page) == " ".join([want, *references])
    assert main_text(f"<body><header><h2>Site</h2></header><article><header><h1>Head</h1></header>{BODY}</article></body>") == want


def test_named_furniture_weighs_less():
    want = " ".join(["Head", *PARAGRAPHS])
    comments = "<p>I have read all of this and I do not agree at all, said a reader.</p>" * 12
    assert main_text(f"<body><article><h1>Head</h1>{BODY}</article><section class=comments>{comments}</section></body>") == want
    assert main_text(f"<body><article><h1>Head</h1><div class=share>Tell others</div>{BODY}<div class=related><p>Read another story too</p></div></article></body>") == want


def test_given_pages_give_their_articles(spark):
    for name, page in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html").collect():
        article = page[page.index("<article>") + 9 : page.index("</article>")]
        plain = html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(?:p|br|h1|ul|li)\b[^>]*>", " ", article)))
        assert main_text(page) == " ".join(plain.split()), name


def test_menus_inside_and_parts_beside_the_article():
    links = "".join(f"<li><a href={i}>some other story {i}</a></li>" for i in range(6))
    page = f"<body><div>{ARTICLE}<ul>{links}</ul></div><div><p>Last part of the same story, which stands in a block of its own here.</p></div></body>"
    assert main_text(page).endswith("longer than any menu is. Last part of the same story, which stands in a block of its own here.")


def brute_top(ids, vectors, every=50, k=5):
    out = []
    for i, v in zip(ids, vectors, strict=True):
        if i % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in zip(ids, vectors, strict=True) if j != i and len(v) == len(w))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_top_k_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(topk, "INDEX_ROWS", 64)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    monkeypatch.setattr(topk, "PASS_QUERIES", 4)
    r = np.random.default_rng(seed)
    raw = r.normal(size=(300, 8)).astype("float32") * (0.05 if seed == 2 else 0.4)
    raw[20:60] = raw[20]
    ids = r.permutation(600)[:300].tolist()
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, raw, strict=True)], "vec_id long, embedding array<float>").repartition(3)
    got = sorted(tuple(x) for x in topk.exact_top_k(df).collect())
    assert got == brute_top([int(i) for i in ids], np.floor(256 * raw.astype(float)).astype(int).tolist())


def test_top_k_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [3.0]), (6, [0.5, 0.5]), (None, [9.0, 9.0]), (50, [1.0]), (100, []), (7, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    got = sorted(tuple(x) for x in topk.exact_top_k(df).collect())
    assert got == [(0, 1, 6, 98304), (0, 2, 7, 98304), (50, 1, 5, 196608)]
    assert topk.exact_top_k(df.where("false")).count() == 0
    assert topk.exact_top_k(df.where("vec_id = 0")).count() == 0
    huge = spark.createDataFrame([(0, [1e30]), (1, [1e30])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception):  # noqa: B017
        topk.exact_top_k(huge).collect()


def words(r, n):
    return " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=4)) for _ in range(n))


def test_pipeline_on_planted_cases(spark, tmp_path):
    r = random.Random(9)
    clean = [words(r, 60) for _ in range(40)]
    passage = words(r, 60)
    texts = dict(enumerate(clean))
    texts[100] = texts[101] = texts[102] = clean[0]  # exact copies
    near = clean[1].split()
    near[30] = "changed"
    texts[110] = " ".join(near)
    texts |= {120: words(r, 40) + "\n" + passage, 121: words(r, 50) + "\n" + passage}
    texts |= {130: None, 131: "too short", 132: "same " * 50, 133: "123 " * 30}
    df = spark.createDataFrame([(i, t, "en", "h", len(t or "")) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    now, seen = df, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == corpus_pipeline.COLUMNS
        now.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen[name] = {x.doc_id: x.text for x in now.collect()}
    assert set(texts) - set(seen["quality rules"]) == {130, 131, 132, 133}
    assert set(seen["language id"]) == set(seen["quality rules"])
    assert seen["line dedup"][120].endswith(passage) and passage not in seen["line dedup"][121]
    assert all(seen["line dedup"][i] == t for i, t in enumerate(clean))
    final = seen["near duplicates"]
    assert set(final) == {*range(40), 120, 121} and all(final[i] == clean[i] for i in range(40))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == set(final)


def test_stages_of_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df, str(tmp_path)).count() == 0


@pytest.mark.parametrize("name", sorted(queries()))
def test_queries_give_rows(spark, name):
    assert queries()[name](spark, "/root/testdata/sf0.001").count() > 0


def test_documents_stay_where_nothing_is_labelled(spark):
    rows = [(0, "some words"), (1, "12 34"), (2, None), (3, "日本")]
    df = spark.createDataFrame([(i, t, None, "h", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.language_id(spark, df, "").collect()) == [0, 3]


@pytest.mark.parametrize(
    "attributes",
    ["style='overflow:hidden'", 'aria-hidden="false"', "data-id=related-5", "title='a class=menu here'", "class='has-sidebar'", "id=comments-open", "data-href='/p?id=comments'"],
)
def test_attributes_are_read_by_name(attributes):
    want = "Title & more First bold text of some length, it goes on and on. Second <tag> paragraph, longer than any menu is."
    assert main_text(f"<body><div {attributes}><article>{ARTICLE}</article></div><div class=menu><p>Go here</p></div></body>") == want
    assert main_text(f"<body><div {attributes}>{ARTICLE}</div><div hidden><p>Not to be seen at all, by anyone</p></div></body>") == want


def test_long_comments_beside_an_article_go():
    page = f"<body><article>{ARTICLE}</article><div id=comments>{'<p>I have read it and say so.' * 30}</div></body>"
    assert main_text(page).startswith("Title & more First") and "I have read" not in main_text(page)


def test_sibling_articles_join():
    line = "Some words of part {} that go on for quite a while, as they do."
    parts = [f"<article>{f'<p>{line.format(i)}' * 6}</article>" for i in "abc"]
    cards = "<article><a href=x>Read this other page</a></article>"
    got = main_text(f"<body><div><p>By us</p>{''.join(parts)}{cards}</div></body>")
    assert got == " ".join(line.format(i) for i in "abc" for _ in range(6))
