import base64
import hashlib
import zlib

import pytest
from llm_help import DATA
from pyspark.sql import functions as F

from granary.llm import html, warc
from granary.llm.registry import op4_html_extraction, op10_warc

MAIN = "<h1>Title &amp; more</h1><p>First <b>bold</b>, text with enough words to count.<p>Second&nbsp;para &lt;x&gt; and\n more words here.</p><ul><li>one<li>two</ul>"
TEXT = "Title & more First bold, text with enough words to count. Second para <x> and more words here. one two"
AROUND = [
    ("<nav><a href=/>Home</a></nav><article>{}</article><footer>Foot words words words words</footer>", "article"),
    ("<header><p>Head words</p></header><main><aside>side words</aside>{}<div class='comments'><p>I think that this is a very long comment by a reader of it.</p></div></main>", "main"),
    ("<div id=sidebar><p>Side words words words</p></div><div class='post-12 body'>{}<form><p>Sign up words</p></form><script>var x = '<p>no</p>';</script><!-- <p>no</p> --></div><div class=cookie-notice>We use cookies</div>", "div"),
    ("<table><tr><td class=menu>menu<td class=content>{}</table><div class='ad banner'>Buy words words now</div>", "td"),
    ("<div class='page has-sidebar'><section><style>p{{}}</style>{}</section></div>", "section"),
]


@pytest.mark.parametrize("shell", [s for s, _ in AROUND])
def test_layouts(shell):
    page = f"<!DOCTYPE html><html><head><title>No</title></head><body>{shell.format(MAIN)}</body></html>"
    assert html.main_text(page, None) == TEXT


FRAMES = [
    "<form id=aspnetForm action='x'><div class=menu>a b c d</div>{}<input name=q></form>",
    "<div class='widget Blog'>{}</div><div class='widget Profile'>about me me me</div>",
    "<div class='notice-of-award'>{}</div>",
    "<main>{}</main><div class=notice>" + "this is a very long notice of ours " * 20 + "</div>",
    "<div class=story>{}</div><div class=comments>" + "<p>a reader has a lot to say about this</p>" * 20 + "</div>",
    "<form><div class=story>{}</div><div id=comments>" + "<p>a reader has a lot to say about this</p>" * 20 + "</div></form>",
    "<div title=it's><p hidden>no</p>{}</div>",
    "<div data-x='>' title=a>{}</div>",
]


@pytest.mark.parametrize("shell", FRAMES)
def test_frames_are_no_parts(shell):
    assert html.main_text(f"<html><body>{shell.format(MAIN)}</body></html>", None) == TEXT


def test_named_parts():
    page = "<main><p>First of it all, some text.</p><div class='related-work'><p>Work by others is text too.</p></div><div class='related-posts'><p>More posts of ours</p></div><p>It's <b title=it's>the</b> end.</p></main>"
    assert html.main_text(page, None) == "First of it all, some text. Work by others is text too. It's the end."
    assert [html.told_by(n) for n in ("cookie-notice", "site-header", "notice-of-award", "has-sidebar", "share-buttons", "entry")] == [html.NEVER, html.FRAME, 0, 0, html.FRAME, 0]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<p>kept</p>" + "<a " * 350_000, "kept"),
        ("<p>kept</p>" + "<a x=\"" * 150_000, "kept"),
        ("<p>kept</p>" + "<!--" * 250_000, "kept"),
        ("<p>kept</p>" + "<script>" * 130_000, "kept"),
        ("<p>kept " + "< " * 500_000, "kept" + " <" * 500_000),
        ("<div>" * 200_000 + "deep" + "</div>" * 200_000, "deep"),
        ("<div class='a b'>" * 60_000 + "deep", "deep"),
        ("<div>" * 100_000 + "deep" + "</p></b></section>" * 50_000, "deep"),
        ("<b>" * 100_000 + "deep" + "</i></b>" * 100_000, "deep"),
        ("<form>" * 100_000 + "deep", "deep"),
        ("<p>a<x>" * 100_000, " ".join("a" * 100_000)),
        ("<ul><li>" * 100_000 + "deep", "deep"),
    ],
)
def test_pages_take_time_in_proportion(page, text):
    import time

    began = time.process_time()
    top = html.best(html.blocks(page))
    assert html.main_text(page, html.path_of(top) if top else None) == text
    assert time.process_time() - began < 10


def test_nested_tags_take_memory_in_proportion():
    import tracemalloc

    tracemalloc.start()
    assert html.main_text("<div class='a b'>" * 20_000 + "deep", None) == "deep"
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6


def test_text_against_an_independent_parser():
    """Random trees of known text: the expected text is made along with the page."""
    import random

    rng = random.Random(12)
    word = lambda: rng.choice(["alpha", "beta", "r&amp;d", "x&lt;y", "caf&eacute;", "&#65;&#x42;"])
    plain = {"r&amp;d": "r&d", "x&lt;y": "x<y", "caf&eacute;": "café", "&#65;&#x42;": "AB"}

    def part(depth):
        if depth == 0 or rng.random() < 0.5:
            words = [word() for _ in range(rng.randrange(8, 20))]
            tag = rng.choice(["p", "h2", "blockquote", "div"])
            body = [f"<b>{w}</b>" if rng.random() < 0.1 else w for w in words]
            return f"<{tag}>{rng.choice([' ', chr(10), '  '])}{' '.join(body)}</{tag}>\n", [" ".join(plain.get(w, w) for w in words)]
        if rng.random() < 0.25:
            return rng.choice(["<nav>{}</nav>", "<div class='ad-slot x'>{}</div>".replace(" x", ""), "<script>{}</script>", "<aside>{}</aside>", "<div class=share-buttons>{}</div>", "<!-- {} -->"]).format("no text here"), []
        inner = [part(depth - 1) for _ in range(rng.randrange(1, 5))]
        return "<div>" + "".join(h for h, _ in inner) + "</div>", [t for _, ts in inner for t in ts]

    for _ in range(200):
        inner = [part(3) for _ in range(4)]
        want = " ".join(t for _, ts in inner for t in ts)
        page = "<body><div id=top class=site-header>Name of it</div><article>" + "".join(h for h, _ in inner) + "</article><footer>foot</footer></body>"
        assert html.main_text(page, None) == want


def test_pages_of_the_table(spark):
    rows = {r.page_id: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = op4_html_extraction(spark, DATA).collect()
    assert len(got) == len(rows)
    import re
    from html import unescape

    for r in got:
        inner = re.search(r"<article[^>]*>(.*?)</article>", rows[r.page_id].html, re.S)[1]
        want = " ".join(unescape(re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1|br|li|ul)\b[^>]*>", " ", inner))).split())
        assert r.text == want and r.n_chars == len(want) and r.url == rows[r.page_id].url


def test_consensus_beats_a_page_of_links(spark):
    rows = [(k, "http://a.example/x", f"<body><div class=teaser><p>{'t ' * 5}</p></div><div class=story><p>{'word ' * 30}</p></div></body>") for k in range(5)]
    rows.append((9, "http://a.example/y", f"<body><div class=teaser><p>{'teaser ' * 40}</p></div><div class=story><p>short but ours</p></div></body>"))
    got = {r.page_id: r.text for r in html.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "short but ours"


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "x", ""), (None, "http://h/", "<p>a &#x41; &#10; b"), (3, "http://h/", "plain text"), (3, "http://h/", "plain text"), (4, "http://h/", "<div" + "<p>" * 3000 + "deep"), (5, "http://H:80/", "<p>" + "long " * 50_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "path": F.lit("p"), "text": F.lit("t")})
    got = sorted((str(r.page_id), r.text, r.n_chars) for r in html.extract(spark, df).collect())
    assert len(got) == 7 and ("1", "", 0) in got and ("None", "a A b", 5) in got and got.count(("3", "plain text", 10)) == 2
    assert ("5", ("long " * 50_000).strip(), 249_999) in got
    assert html.extract(spark, df.where("false")).count() == 0
    shuffled = sorted((str(r.page_id), r.text, r.n_chars) for r in html.extract(spark, df, small=0).collect())
    assert shuffled == got


def b32(b):
    return base64.b32encode(hashlib.sha1(b).digest()).decode()


def expected(rows):
    first = {}
    for i, h in rows:
        b = (h or "").encode()
        if i is not None:
            first[b] = min(first.get(b, i), i)
    out = []
    for i, h in rows:
        b = (h or "").encode()
        f = first.get(b)
        own = f is None or f == i
        out.append((i, len(b), b32(b), "response" if own else "revisit", None if own else f))
    return sorted(out, key=str)


def test_round_trip_of_the_table(spark):
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()]
    assert sorted(map(tuple, op10_warc(spark, DATA).collect()), key=str) == expected(rows)


ODD = [(5, "http://a/", "same"), (3, "http://b/", "same"), (9, None, "same"), (1, "http://c/\r\nX: y", ""), (2, "u", None), (-4, "u", "π\r\n\r\nWARC/1.1"), (7, "u", "z" * 3_000_000), (8, "u", "one"), (8, "u", "one"), (2**62, "u", "big")]


@pytest.mark.parametrize("small", [500_000, 0])
def test_odd_records(spark, small):
    df = spark.createDataFrame(ODD, "page_id long, url string, html string").withColumns({"sha": F.lit(1), "first": F.lit(2), "payload": F.lit("p")})
    path = warc.Scratch(spark).path("a")
    warc.write_warc(warc.mark_revisits(spark, df, small=small), path)
    back = warc.read_warc(spark, path)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, warc.page_of(r.refers_to)) for r in back.collect()), key=str)
    assert got == expected([(i, h) for i, _, h in ODD])
    assert all(bytes(r.payload) == dict((i, h) for i, _, h in ODD)[r.page_id].encode() for r in back.where("record_type = 'response' AND payload_bytes > 0").collect())
    assert warc.round_trip(spark, df.where("false")).count() == 0


@pytest.mark.parametrize("compression", ["gzip", "none"])
def test_filters_are_pushed_and_payloads_skipped(spark, compression):
    path = warc.Scratch(spark).path("b")
    rows = spark.createDataFrame([(k, f"http://h{k % 2}/{k}", bytearray(b"x" * 10_000), None if k else None) for k in range(20)] + [(99, "http://h0/99", bytearray(b"y"), 3)], "page_id long, url string, payload binary, refers_to long")
    warc.write_warc(rows, path, compression=compression, filebytes="30000")
    back = warc.read_warc(spark, path, payload="false")
    assert back.where("record_type = 'revisit'").collect()[0].page_id == 99
    some = back.where(F.startswith("target_uri", F.lit("http://h1")) & F.col("record_type").isin("response"))
    assert some.count() == 10 and some.first().payload is None
    assert back.where("record_type <> 'revisit' AND page_id > 17").count() == 2
    reader = warc.WarcReader({"path": path.replace("file://", "")})
    assert len(list(reader.pushFilters([warc.EqualTo(("record_type",), "revisit"), warc.EqualTo(("page_id",), 3)]))) == 1
    assert len(reader.partitions()) >= 1
    assert [r[7] for p in reader.partitions() for r in reader.read(p)] == [99]


def test_archives_of_others():
    record = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: text/plain\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n" + warc.build_record(1, "u", b"p", "2000-01-01T00:00:00Z", None)
    import io

    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    for data in (record, packed.compress(record) + packed.flush()):
        source = warc.Bytes(io.BytesIO(data), data is not record)
        kinds = []
        while (head := source.head()) is not None:
            fields = warc._fields(head)
            kinds.append(fields["warc-type"])
            source.skip(int(fields["content-length"]) + 4)
        assert kinds == ["warcinfo", "response"]


def test_ids_in_urns():
    assert all(warc.page_of(warc.record_urn(x)) == x for x in (0, 7, 2**40 + 3, 2**62, -1, -(2**63)))
    assert warc.page_of(None) is None and warc.page_of("<urn:uuid:123e4567-e89b-12d3-a456-426614174000>") is None


def records(path, **options):
    reader = warc.WarcReader({"path": str(path), **options})
    return [r for p in reader.partitions() for r in reader.read(p)]


@pytest.mark.parametrize("gzip", [True, False])
def test_malformed_archives_end_with_a_row(tmp_path, gzip):
    pack = warc.pack_member if gzip else bytes
    good = [pack(warc.build_record(k, "u", b"p" * 3000, "2000-01-01T00:00:00Z", None)) for k in range(3)]
    bad = pack(b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: many\r\n\r\nx\r\n\r\n")
    name = "a.warc" + ".gz" * gzip
    for data in (b"".join(good) + bad, b"".join(good) + good[0][:-20], b"".join(good) + b"\x1f\x8b\x08 no such thing"):
        (tmp_path / name).write_bytes(data)
        got = records(tmp_path)
        assert [r[7] for r in got[:3]] == [0, 1, 2] and [r[1] for r in got[3:]] == ["malformed"] and got[3][8]["error"]
    (tmp_path / name).write_bytes(b"")
    assert records(tmp_path) == []


def test_a_damaged_payload_shows(tmp_path):
    data = warc.build_record(1, "u", b"one payload", "2000-01-01T00:00:00Z", None)
    (tmp_path / "a.warc").write_bytes(data.replace(b"one payload", b"two payload"))
    for option, digest in (("check", b32(b"two payload")), ("false", b32(b"one payload"))):
        assert records(tmp_path, payload=option)[0][4] == digest


def test_unwanted_members_are_not_inflated(tmp_path):
    """Members with their lengths are passed over by a seek, others piece by piece."""
    import gzip
    import tracemalloc

    record = warc.build_record(1, "u", b"x" * 50_000_000, "2000-01-01T00:00:00Z", None)
    small = warc.build_record(2, "u", b"y", "2000-01-01T00:00:00Z", None)
    for pack in (warc.pack_member, gzip.compress):
        (tmp_path / "a.warc.gz").write_bytes(b"".join(map(pack, (record, small, record, small))))
        tracemalloc.start()
        assert [r[7] for r in records(tmp_path, payload="false")] == [1, 2, 1, 2]
        assert tracemalloc.get_traced_memory()[1] < 25e6
        tracemalloc.stop()
    assert gzip.decompress(warc.pack_member(small)) == small
