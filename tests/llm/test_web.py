"""The archive converter and HTML extraction."""

import base64
import gzip
import hashlib
import time
import tracemalloc

import pytest

from lorekeep.llm import html_extract, queries, warc
from lorekeep.llm.storage import shared_dir, write_file


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def expected(pages):
    best = {}
    for i, html in pages:
        best[html or ""] = max(best.get(html or "", i), i)
    return {i: (len((h or "").encode()), digest((h or "").encode()), "response" if best[h or ""] == i else "revisit", None if best[h or ""] == i else best[h or ""]) for i, h in pages}


def test_op6(spark, sf):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()]
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in queries.op6_warc_roundtrip(spark, sf).collect()}
    assert got == expected(pages)


def test_copies_and_odd_pages(spark):
    pages = [(1, "a"), (9, "a"), (5, "a"), (2, None), (3, ""), (-4, "neg"), (7, "é\r\n\r\n" * 50000), (8, "HTTP/1.1 200 OK\r\n\r\nx")]
    urls = ["http://a b/", None, "", "x\ny", "http://é/", "u", "u", "u"]
    frame = spark.createDataFrame([(i, u, h, "d", 0) for (i, h), u in zip(pages, urls)], "page_id long, url string, html string, digest string, first int")
    got = {r.record_place: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_digest(frame).collect()}
    assert got == expected(pages)
    least = {r.record_place: r.record_type for r in warc.archive_digest(frame, least_bytes=2).collect()}
    assert set(least.values()) == {"response"}
    nameless = spark.createDataFrame([(None, None, "a"), (4, None, "a")], "page_id long, url string, html string")
    assert {(r.record_place, r.record_type, r.refers_to) for r in warc.archive_digest(nameless).collect()} == {(None, "revisit", 4), (4, "response", None)}
    assert warc.archive_digest(frame.where("false")).count() == 0


def legacy(version):
    page = b"HTTP/1.0 200 OK\r\nContent-Type: text/html\r\n\r\nhello"
    records = [warc.ArcRecord("http://a/x y", "1.2.3.4", "19990102030405", "text/html; charset=x", page), warc.ArcRecord("dns:a", "1.2.3.4", "19990102030405", "text/dns", b"a 1 IN A\n\n1 2")]
    return warc.arc_header(version, "old.arc", "19990101000000") + b"".join(warc.arc_record(version, r) for r in records)


@pytest.mark.parametrize("version", [1, 2])
def test_both_versions_are_read_by_declared_length(version):
    first, second = warc.read_arc(legacy(version))
    assert (first.url, first.content_type, first.body[-5:]) == ("http://a/x y", "text/html; charset=x", b"hello") and second.body == b"a 1 IN A\n\n1 2"
    (h1, b1), (h2, b2) = [r for x in warc.convert_arc(legacy(version)) for r in warc.read_warc(x)]
    assert (h1["warc-type"], h1["warc-date"], h1["warc-target-uri"], h1["warc-ip-address"]) == ("response", "1999-01-02T03:04:05Z", "http://a/x y", "1.2.3.4")
    assert h1["warc-payload-digest"] == "sha1:" + digest(b"hello") and h1["warc-block-digest"] == "sha1:" + digest(b1)
    assert h2["warc-type"] == "resource" and h2["content-type"] == "text/dns" and b2 == second.body and h1["warc-record-id"] != h2["warc-record-id"]


@pytest.mark.parametrize("data", [b"http://a 1 2 t 3\nabc\n", legacy(1)[:-6], legacy(2)[:60]])
def test_broken_archives_are_errors(data):
    with pytest.raises(ValueError):
        list(warc.read_arc(data))


def test_files_of_legacy_archives(spark):
    source, out = shared_dir(spark, "arc"), shared_dir(spark, "warc")
    write_file(source, "one.arc", legacy(1))
    write_file(source, "two.arc.gz", gzip.compress(legacy(2)))
    manifest = warc.convert_arc_files(spark, source, out)
    assert manifest.groupBy().sum("records").first()[0] == 4
    assert sorted(r.record_type for r in warc.read_archives(spark, out, "old.arc").collect()) == ["resource", "resource", "response", "response"]


def reference(page):
    import html
    import re

    article = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", article).replace("<br>", " "))
    texts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in parts]
    return "\n".join(t for t in texts if t)


def test_op8(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").toPandas().set_index("page_id")
    got = queries.op8_main_text(spark, sf).toPandas().set_index("page_id")
    assert got.text.to_dict() == {i: reference(h) for i, h in pages.html.items()}
    assert (got.n_chars == got.text.str.len()).all() and got.url.to_dict() == pages.url.to_dict()


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""), ("", ""), ("plain text", "plain text"), ("<p>a &lt; b &amp; c&nbsp;d", "a < b & c d"), ("<script>x", ""), ("<!-- no", ""), ("<nav>only, a menu.</nav>", ""),
        ("<p>One. two, three.</p><ul><li><a>home</a><li><a>about</a></ul>", "One. two, three."),
        ("<div id='menu'><a>x</a></div><div class='content'><h2>T</h2><p>Hello, world. Text is here.<p>More   text<br>now.</div><div class=sidebar>no</div><section id=comments><p>Nice article, thanks a lot.</p></section>", "T\nHello, world. Text is here.\nMore text now."),
        ("<article><header><h1>T</h1></header><p>Body, of it.</p><aside>see, also.</aside><form>f <input></form></article><footer>f.</footer>", "T\nBody, of it."),
        ("<article><p>a<b>b</b>c<p>d<table><tr><td>e<td>f</table></article>", "abc\nd\ne\nf"),
        ("<main><p title='x>y'>q. 1 < 2, r</p></main>", "q. 1 < 2, r"),
    ],
)
def test_pages(page, want):
    assert html_extract.main_text(page) == want


PROSE = "<p>" + "The river rose again, and people moved to higher ground. " * 6 + "</p>"
SHORT = "<ul>" + "<li><a href='#'>item</a></li>" * 8 + "</ul>"


@pytest.mark.parametrize("name", ["legal", "search-results", "notice", "copyright", "side"])
def test_ratios_overrule_doubtful_names(name):
    page = f"<body><div class='x1'>{SHORT}</div><div class='{name}'><h1>Title</h1>{PROSE * 4}</div><div class='x2'>{SHORT}</div></body>"
    assert html_extract.main_text(page).count("The river rose") == 24
    beside = f"<body><div class='x1'><h1>Title</h1>{PROSE * 4}</div><div class='{name}'><p>Read our terms, please.</p></div></body>"
    assert "terms" not in html_extract.main_text(beside) and html_extract.main_text(beside).count("The river rose") == 24


@pytest.mark.parametrize(
    "name",
    ["class='content has-sidebar'", "class='post no-comments'", "class='layout--with-menu'", "class='site-content nav-open'", "class='col-md-8 no-widget'", "class='article-content social-share-enabled'", "class='entry ad-free'",
     "class='related-work'", "id='share-price-analysis'", "class='sidebar'", "id=footer", "class='promo'", "class='x' id='commentsHeader'"],
)
def test_a_name_never_takes_the_only_prose(name):
    page = f"<body><div class='top-bar'>{SHORT}</div><div {name}><h1>Title</h1>{PROSE * 3}</div><div class='site-footer'><p>Fine, print.</p></div></body>"
    got = html_extract.main_text(page)
    assert got.startswith("Title\nThe river") and got.count("The river rose") == 18 and "print" not in got and "item" not in got
    assert html_extract.main_text(f"<body><div {name}>{PROSE * 3}</div></body>").count("The river rose") == 18


def test_frames_and_titles():
    form = f"<body><form id='aspnetForm'><div class='menu'>{SHORT}</div><div class='page'><h1>Title</h1>{PROSE * 3}</div><div class='sidebar'>{PROSE.replace('river', 'lake')}</div></form></body>"
    got = html_extract.main_text(form)
    assert got.startswith("Title\nThe river") and "lake" not in got and "item" not in got
    entry = f"<body><article><div class='entry-header'><h1>The Title</h1></div><div class='entry-content'>{PROSE * 2}</div><div class='entry-share'><a>Share, it.</a></div></article></body>"
    assert html_extract.main_text(entry).startswith("The Title\nThe river") and "Share" not in html_extract.main_text(entry)
    header = f"<body><div class='page-header'><h1>The Title</h1></div><div class='col'>{PROSE * 2}</div></body>"
    assert html_extract.main_text(header).startswith("The Title\nThe river")


def test_teasers_named_as_articles_are_not_all():
    cards = "".join(f"<article class='card'><h3>More {i}</h3><p>A short, dull teaser of other news.</p></article>" for i in range(5))
    got = html_extract.main_text(f"<body><div class='text'><h1>Title</h1>{PROSE * 4}</div><div class='grid'>{cards}</div></body>")
    assert got.count("The river rose") == 24


def test_many_comments_below_a_short_article():
    page = f"<body><div class='text'><h1>Title</h1>{PROSE}</div><div class='comments-area'><h2>Comments</h2>{PROSE.replace('river', 'lake') * 30}</div></body>"
    got = html_extract.main_text(page)
    assert got.startswith("Title\nThe river") and "lake" not in got


def test_open_items_are_ended_at_any_depth():
    deep = "<ul><li>" + "<b><div>" * 200 + "one, a.<li>two, b.</ul>"
    page = f"<body>{deep}</body>"
    found = html_extract.blocks(page)
    assert [t for _, t, _ in found] == ["one, a.", "two, b."] and found[1][0].parent.tag == "ul"
    rows = html_extract.blocks("<table><tr><td>" + "<div>" * 100 + "a<td>b<tr><th>c<table><tr><td>d</table>e</table>")
    assert [(t, e.tag, e.parent.tag) for e, t, _ in rows] == [("a", "div", "div"), ("b", "td", "tr"), ("c", "th", "tr"), ("d", "td", "tr"), ("e", "th", "tr")]


def test_pages_without_telling_names():
    page = f"<body><div class='a'>{SHORT}</div><div class='b'><div class='c'><h1>Title</h1>{PROSE * 5}</div></div><div class='d'>{SHORT}<p>Fine.</p></div></body>"
    got = html_extract.main_text(page)
    assert got.startswith("Title\nThe river") and got.count("The river rose") == 30 and "item" not in got and "Fine." not in got


@pytest.mark.parametrize("name", ["comments", "cookie-consent", "sidebar", "related"])
def test_prose_below_firm_names_stays_out(name):
    page = f"<body><div><h1>Title</h1>{PROSE}</div><div class='{name}'>{PROSE.replace('river', 'lake') * 6}</div></body>"
    assert "lake" not in html_extract.main_text(page)


@pytest.mark.parametrize(
    "unit", ["<x", "<a '", "<a \"", "<a '>", "<a \">\"", "<!--", "<script>", "</script ", "<div>", "<li>", "</p>", "<div><li>", "<td><div>", "<p class='a b'>x, y.", "<a class=", "&amp", "<x <!--", "<ul><li><div>"]
)
def test_malformed_and_deep_pages_take_linear_time(unit):
    html_extract.main_text(unit * 10)
    tracemalloc.start()
    began = time.process_time()
    html_extract.main_text(unit * min(100_000, 600_000 // len(unit)))
    took, (_, peak) = time.process_time() - began, tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert took < 20 and peak < 400_000_000  # memory tracing slows it down several times


def test_unclosed_markup_is_text_or_hidden():
    assert html_extract.main_text("<p>a <b x") == "a <b x" and html_extract.main_text("<p>a <b <!-- no") == "a <b"
    assert html_extract.main_text("<p>a <i title='x>y</i> b, c</p>") == "a y b, c"


def test_long_and_clashing_pages(spark):
    rows = [(1, "u", "<p>" + "word, word. " * 50000, "old", 3), (1, "u", None, "old", 3), (None, None, "<p>x", None, None)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    got = html_extract.extract_main_text(frame).collect()
    assert sorted(r.n_chars for r in got) == [0, 1, 599999]
    assert html_extract.extract_main_text(frame.where("false")).count() == 0
