import hashlib
from collections import defaultdict

import numpy as np
import pytest

from pactspark.llm import embedding_dedup, html_text, warc
from pactspark.llm.components import components
from pactspark.llm.simhash import _Forest

# op4


def test_warc_round_trip(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    copies = pages.selectExpr("page_id + 1000000 AS page_id", "url", "html").where("page_id % 3 = 0")
    pages = pages.select("page_id", "url", "html").union(copies)
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    last = defaultdict(int)
    for i, b in rows:
        last[b] = max(last[b], i)
    found = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert len(found) == len(rows)
    for i, b in rows:
        r, first = found[i], len(b) < 1000 or last[b] == i
        assert (r.payload_bytes, r.payload_digest, r.verified) == (len(b), hashlib.sha1(b).hexdigest(), True)
        assert (r.record_type, r.refers_to) == (("response", None) if first else ("revisit", last[b]))


def test_warc_odd_pages(spark, tmp_path):
    tricky = "é" * 30000 + "\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n0\r\n\r\n"
    rows = [(1, "u", tricky), (1, "u", tricky), (2, None, None), (3, "x y\r\nz", ""), (None, "z", "a" * 1000), (9, "z", "a" * 1000), (7, "z", "a" * 999), (8, "z", "a" * 999)]
    path = str(tmp_path / "w")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS key"), path)
    found = warc.read_warc(spark, path).collect()
    assert {bytes(r.payload) for r in found if r.refers_to} == {b"a" * 1000}
    assert sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in found if r.page_id != 1) == [(0, 1000, "revisit", 9), (2, 0, "response", None), (3, 0, "response", None), (7, 999, "response", None), (8, 999, "response", None), (9, 1000, "response", None)]
    assert [bytes(r.payload).decode() for r in found if r.page_id == 1] == [tricky] * 2 and all(r.verified for r in found)
    empty = str(tmp_path / "e")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc.read_warc(spark, empty).collect() == []


def test_warc_segments():
    digest = hashlib.sha1(b"0123456789" * 30).hexdigest()
    raw = list(warc.records_of(5, "u", "0123456789" * 30, digest, None, 100, 7))
    parsed = [next(warc.parse_records(x)) for x in raw]
    assert [f.get("warc-segment-number") for f, _ in parsed] == [str(k + 1) for k in range(len(raw))] and len(raw) > 3
    assert all(f["warc-segment-origin-id"] == parsed[0][0]["warc-record-id"] for f, _ in parsed[1:])
    total = int(parsed[-1][0]["warc-segment-total-length"])
    assert total == sum(len(b) for _, b in parsed)

    def read(blocks, total=total):
        p = warc._Payload((None, None, 1, None, "response", 5, "u", digest, None, None, None), True)
        for k, b in blocks:
            p.add((None, None, k, total if k == len(raw) else None, None, None, None, None, None, None, b))
        return p.row()

    blocks = [(k + 1, b) for k, (_, b) in enumerate(parsed)]
    assert read(blocks)[-2:] == (True, b"0123456789" * 30)
    assert not read(blocks[:1] + blocks[2:])[-2] and not read(blocks, total + 1)[-2] and not read(blocks[:-1])[-2]
    assert [f["warc-type"] for f, _ in warc.parse_records(raw[0] + b"\r\n\r\njunk\r\n\r\n" + raw[1])] == ["response", "damage", "continuation"]
    for step in (1, 7, 1000):
        data = b"\r\n\r\n".join(raw)
        pieces = (data[k : k + step] for k in range(0, len(data), step))
        assert [b for _, b in warc.parse_records(pieces)] == [b for _, b in parsed]


def record(kind, number, body, head=b"", **fields):
    block = b"HTTP/1.1 200 OK\r\n" + head + b"\r\n" + body
    names = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:x:{number}>", "Page-ID": number, "WARC-Payload-Digest": "sha1:" + hashlib.sha1(body).hexdigest(), **{k.replace("_", "-"): v for k, v in fields.items()}}
    return warc._record(list(names.items()), block)


def test_reading_archives_of_others(spark, tmp_path):
    """Other record types, wrong lengths, broken bytes, archives that end too early, revisits without their target."""
    import gzip

    def member(x):
        return gzip.compress(x + b"\r\n\r\n")

    body = b"some text"
    good = [
        member(record("warcinfo", 1, b"")), member(record("response", 2, body)), member(record("response", 3, body, b"Content-Length: 9\r\n")), member(record("response", 4, body, b"Content-Length: 99\r\n")), member(record("request", 5, body)),
        member(record("revisit", 6, b"", b"Content-Length: 9\r\n", WARC_Refers_To="<urn:x:2>", WARC_Payload_Digest="sha1:" + hashlib.sha1(body).hexdigest())),
        member(record("revisit", 7, b"", b"Content-Length: 8\r\n", WARC_Refers_To="<urn:x:2>", WARC_Payload_Digest="sha1:" + hashlib.sha1(body).hexdigest())),
        member(record("revisit", 8, b"", b"Content-Length: 9\r\n", WARC_Refers_To="<urn:x:88>", WARC_Payload_Digest="sha1:" + hashlib.sha1(body).hexdigest())),
        member(record("request", 9, body, WARC_Segment_Number=1)), member(record("continuation", 10, body, WARC_Segment_Number=2, WARC_Segment_Origin_ID="<urn:x:9>", WARC_Segment_Total_Length=5)),
        member(record("continuation", 11, body, WARC_Segment_Number=2, WARC_Segment_Origin_ID="<urn:x:99>", WARC_Segment_Total_Length=5)),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(good))
    (tmp_path / "b.warc.gz").write_bytes(good[1].replace(b"x", b"x") + b"\x1f\x8b\x08 broken" + member(b"WARC/1.1\r\nno fields\r\n\r\n") + member(record("response", 12, body)))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(record("response", 13, body) + b"\r\n\r\n")[:-4])
    (tmp_path / "d.warc.gz").write_bytes(gzip.compress(record("response", 14, body)[:-3]))
    found = [(r.page_id, r.record_type, r.verified, r.payload and bytes(r.payload)) for r in warc.read_warc(spark, str(tmp_path)).collect()]
    assert sorted((x for x in found if x[0]), key=str) == sorted([(2, "response", True, body)] * 2 + [(3, "response", True, body), (4, "response", False, body), (6, "revisit", True, body), (7, "revisit", False, None), (8, "revisit", False, None), (12, "response", True, body), (13, "response", True, body), (14, "response", False, body[:-3])], key=str)
    assert all(x == (None, "damage", False, None) for x in found if not x[0]) and 3 <= sum(not x[0] for x in found) <= 5
    short = [(r.page_id, r.verified) for r in warc.read_warc(spark, str(tmp_path), payloads=False).collect() if r.page_id]
    assert sorted(short) == sorted((x[0], x[2]) for x in found if x[0])


def test_archives_are_split_among_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ROW_BYTES", 2000)
    rows = [(k, "u", f"page {k} " * 200) for k in range(400)]
    path = str(tmp_path / "w")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    found = warc.read_warc(spark, path).collect()
    assert sorted((r.page_id, bytes(r.payload).decode()) for r in found) == sorted((k, h) for k, _, h in rows) and all(r.verified for r in found)
    assert len(list((tmp_path / "w").glob("*.txt"))) <= 2
    import gzip

    assert gzip.decompress(next((tmp_path / "w").glob("*.txt")).read_bytes()).startswith(b"WARC/1.1\r\n")


@pytest.mark.parametrize("step", [1, 2, 3, 50])
def test_chunked_framing_in_pieces(step):
    data = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3;x=1\r\nabc\r\nA\r\n0123456789\r\n0\r\nTrailer: 1\r\n\r\n"
    body = warc.HttpBody()
    assert b"".join(p for k in range(0, len(data), step) for p in body.feed(data[k : k + step])) == b"abc0123456789" and body.whole


# op5


def test_pages_against_their_articles(spark, sf):
    import html
    import re

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    found = {r.page_id: r for r in html_text.extract_text(pages).collect()}
    for r in pages.collect():
        m = re.search(r"<article>(.*?)</article>", r.html, re.S) or re.search(r"<article>(.*?)<footer>", r.html, re.S)
        wanted = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", m[1]))).split())
        assert found[r.page_id].text == wanted and found[r.page_id].n_chars == len(wanted)


def neutral(page):
    """The page without names: every division is a div without class or id."""
    import re

    return re.sub(r" (class|id)=(\"[^\"]*\"|[^ >]+)", "", re.sub(r"<(/?)(article|nav|footer|header|aside|main|form)\b", r"<\1div", page))


def test_scores_find_the_article_where_no_name_tells(spark, sf, monkeypatch):
    import re

    pages = spark.read.parquet(f"{sf.replace('0.001', '0.1')}/pages.parquet").toPandas()["html"].tolist()
    wanted = [html_text.main_text(x) for x in pages]
    assert all(re.search("<article>", x) for x in pages)

    def equal():
        return np.mean([html_text.main_text(neutral(x)) == w for x, w in zip(pages, wanted)])

    assert equal() > 0.97
    monkeypatch.setattr(html_text, "LEAST_CHARS", 10**9)  # nothing passes points
    assert equal() < 0.1


N = 100_000


@pytest.mark.parametrize(
    "page,chars",
    [
        ("<a " * 4 * N, 0), ("<div>" * 2 * N, 0), ("<div><p>some text that is long enough, yes" * N, None), ('<a ">" ' * N, None), ("<a ' \" " * N + '">', 0), ("<!-- " * N, 0), ("<!x" * N, 0), ("<ul><div>" * N + "<li></li>" * N, 0),
        ("<div>" * N + "</section>" * N, 0), ("<title></titl " * N, 0), ("<p " + "a=\" b=' " * N + ">", 0), ("<" * N, N), ("<li><ul>" * N, 0), ("<table><tr><td>" + "<div>" * N + "</div><td>" * N, 0), ("<form><article>" * N + "text", 4), ("&#" * N, 2 * N),
    ],
)
def test_time_is_linear_in_the_page(page, chars):
    import time

    began = time.process_time()
    text = html_text.main_text(page)
    assert time.process_time() - began < 10 and (chars is None or len(text) == chars)


LONG = "This is a paragraph, with commas, and with more than enough words to count as text."


@pytest.mark.parametrize(
    "page,text",
    [
        (None, ""), ("", ""), ("plain", "plain"), ("<p></p>", ""), ("<" * 5, "<<<<<"),
        (f"<div id=content><p>{LONG}</p><p>{LONG}</p></div><div class='sidebar'><p>{LONG}</p></div>", f"{LONG} {LONG}"),
        (f"<header><h1>Site</h1></header><main><h1>Title</h1><p>{LONG}</p><form><p>{LONG}</p></form><section class='reader-comments'><p>{LONG}</p></section></main><aside>{LONG}</aside>", f"Title {LONG}"),
        (f"<article><p>{LONG}<p>a&nbsp;&lt;b&gt; &#x41;&amp;amp;<br>c<script>if (a<b) '</p>'</script><!-- <p>no</p> --><noscript>no</noscript></article>", f"{LONG} a <b> A&amp; c"),
        (f"<div class=cookie-notice>{LONG}</div><div><p>{LONG}</p><ul><li><a href=1>one link</a><li><a href=2>two link</a></ul></div><footer>{LONG}</footer>", LONG),
        (f"<div><section><p>{LONG}</p></section><section><p>{LONG}</p></section></div>", f"{LONG} {LONG}"),
        (f"<article>x<b>y</b>z <p>{LONG}</p><pre>a\n  b</pre><table><tr><td>c<td>d<tr><td>e</table></article>", f"xyz {LONG} a b c d e"),
        (f"<p title='a > b'>{LONG}</p><div hidden>no</div><span class='ad'>no</span>", LONG),
        (f"<article><p>{LONG}<script>never closed", LONG), (f"<p>{LONG}</p><div class='foo", LONG), (f"<!-->{LONG}<!-- no", LONG), (f"<p title=\"x>{LONG}</p>", LONG), (f"<p>{LONG}</ x></p><?php no ?>", LONG),
    ],
)
def test_html_text(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("wrapper", ["div class='content has-sidebar'", "div id=post-social", "div class=no-comments", "form method=post"])
@pytest.mark.parametrize("inner", ["div", "article"])
def test_marked_wrappers_keep_their_article(wrapper, inner):
    page = f"<body><nav>{LONG}</nav><{wrapper}><{inner}><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></{inner}><div class=sidebar><p>{LONG[:50]}</p></div></{wrapper.split()[0]}><footer>{LONG}</footer>"
    assert html_text.main_text(page) == f"{LONG} {LONG} {LONG}"
    assert html_text.main_text(f"<div class=widget><p>{LONG}</p></div><form>{LONG}</form>") == f"{LONG} {LONG}"
    assert html_text.main_text(f"<article>Short.</article><div class=ad><p>{LONG}</p></div>") == "Short."
    related = f"<div><p>{LONG}</p><p>{LONG}</p></div><div class=related><article><p>{LONG}</p></article></div>"
    assert html_text.main_text(related) == f"{LONG} {LONG}"


def test_deep_and_odd_pages(spark):
    assert html_text.main_text("<div>" * 5000 + "x" + "</p></b>" * 100) == "x"
    df = spark.createDataFrame([(1, None, None), (1, None, None), (None, "u", f"<p>{LONG}")], "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    assert sorted(((r.page_id, r.n_chars) for r in html_text.extract_text(df).collect()), key=str) == [(1, 0), (1, 0), (None, len(LONG))]
    assert html_text.extract_text(df.limit(0)).collect() == []


# op7


def test_embeddings_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "LEAST_JOB", 16)
    monkeypatch.setattr(embedding_dedup, "MOST_JOB", 40)
    monkeypatch.setattr(embedding_dedup, "BUCKET", 64)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 24))
    x = np.vstack([rng.normal(size=(300, 24)), centres[rng.integers(0, 12, 200)] + 0.12 * rng.normal(size=(200, 24)), np.repeat(centres[:2], 60, axis=0), centres[2] + 0.1 * rng.normal(size=(150, 24))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (u @ u.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    f = _Forest(len(x))
    f.add(*np.nonzero(link))
    found = embedding_dedup.near_vectors(spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<double>")).toPandas().sort_values("vec_id")
    assert (found["n_links"].to_numpy() <= link.sum(1)).all() and found["n_links"].sum() >= 0.97 * link.sum()
    assert (found["component_id"].to_numpy() == f.root).mean() > 0.99 and (found["kept"] == (found["vec_id"] == found["component_id"])).all()


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (None, [1.0, 0.05]), (7, [1.0]), (8, [-3.0]), (9, []), (10, [1e308, 1e300]), (11, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS root", "3 AS n")
    found = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(df).collect()), key=str)
    linked = [(1, 4, 1, True), (1, 4, 1, True), (10, 4, 1, False), (2, 4, 1, False), (None, 4, 1, False)]
    assert found == sorted(linked + [(k, 0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 11)], key=str)
    assert embedding_dedup.near_vectors(df.limit(0)).collect() == []


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(k, k + 1) for k in range(60)] + [(100, 100), (None, 3)] + [(200, int(k)) for k in range(201, 260)] + rng.integers(300, 400, (60, 2)).tolist()
    found = {r.id: r.root for r in components(spark.createDataFrame([tuple(e) for e in edges], "a long, b long")).collect()}
    f = _Forest(400)
    real = np.array([e for e in edges if None not in e])
    f.add(real[:, 0], real[:, 1])
    groups = defaultdict(set)
    for k, r in found.items():
        groups[f.root[k]].add(r)
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups) and 100 not in found
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []
