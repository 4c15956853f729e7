"""WARC round trips and HTML rendering."""

import base64
import gzip
import hashlib
import random

import pytest

from taxonspark.llm import htmltext, warc
from taxonspark.llm.common import new_folder

PAGES = "page_id long, url string, html string, kind string, capture_id string"


def by_hand(pages):
    last = {}
    for p, _, h in pages:
        if p is not None:
            last[h or ""] = max(p, last.get(h or "", p))
    out = []
    for p, _, h in pages:
        b = (h or "").encode()
        top = last.get(h or "")
        again = top is not None and (p is None or p < top)
        out.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


def pages():
    rows = [(i, f"http://h{i % 3}.example.org/{i}", f"<p>{i % 7}</p>\r\n\r\nWARC/1.1\r\n\r\nÉ") for i in range(40)]
    rows += [(50, None, None), (51, "http://x/\r\nInjected: 1", ""), (52, "u", None), (53, "http://big/", "x" * 3_000_000)]
    return rows + [(39, "http://twice/", rows[39][2]), (None, "http://noid/", rows[3][2]), (None, "http://noid/", "alone")]


def test_round_trip(spark):
    df = spark.createDataFrame([(*p, "k", "c") for p in pages()], PAGES).repartition(3)
    got = warc.round_trip(df)
    assert sorted((tuple(r) for r in got.collect()), key=str) == by_hand(pages())
    assert warc.round_trip(df.limit(0)).count() == 0


def test_nested_captures_keep_payloads(spark):
    df = spark.createDataFrame([(*p, "k", "c") for p in pages()], PAGES)
    for how in ("none", "gzip"):
        path = new_folder(spark, "test-warc")
        warc.write_archives(df, path, compression=how, pages_per_file=7, min_revisit_bytes=1)
        rows = warc.assemble(warc.read_records(spark, path)).collect()
        assert len(rows) == len(pages())
        for r in rows:
            assert len(r.requests) == 1 and len(r.metadata) == 1 and r.response.target_uri == r.requests[0].target_uri
            if r.response.kind == "response":
                assert len(r.response.payload) == r.response.payload_bytes and r.response.payload_digest == r.response.stated_digest
        payloads = sorted(bytes(r.response.payload) for r in rows if r.response.kind == "response")
        last = {}
        for p, _, h in pages():
            if h and p is not None:
                last[h] = max(p, last.get(h, p))
        want = sorted((h or "").encode() for p, _, h in pages() if not h or h not in last or p == last[h])
        assert payloads == want


def record(kind, rid, block=b"", **more):
    head = {"WARC-Type": kind, "WARC-Record-ID": rid, **{k.replace("_", "-"): v for k, v in more.items()}, "Content-Length": str(len(block))}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    good = (record("warcinfo", "<i>") + record("metadata", "<m>", b"via: x\r\n", WARC_Concurrent_To="<q>", Content_Type="application/warc-fields")
            + record("request", "<q>", b"GET / HTTP/1.0\r\n\r\n", WARC_Concurrent_To="<r>")
            + record("response", "<r>", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody") + record("metadata", "<o>", b"", WARC_Concurrent_To="<gone>"))
    (tmp_path / "a.warc").write_bytes(good)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(record("response", "<z>", b"HTTP/1.0 200 OK\r\n\r\nz")) + gzip.compress(record("response", "<y>", b"no head")))
    (tmp_path / "c.warc").write_bytes(record("response", "<w>", b"HTTP/1.0 200 OK\r\n\r\nw") + record("response", "<cut>", b"abc" * 50)[:90])
    records = warc.read_records(spark, str(tmp_path))
    assert [r.error is not None for r in records.where("error is not null").collect()] == [True]
    rows = {r.capture_id: r for r in warc.assemble(records).collect()}
    assert set(rows) == {"<r>", "<z>", "<y>", "<w>", "<gone>"}
    assert bytes(rows["<r>"].response.payload) == b"body" and rows["<r>"].metadata[0].fields == {"via": "x"}
    assert rows["<r>"].requests[0].record_id == "<q>" and rows["<gone>"].response is None


HTML = [
    (None, None), ("", ""), ("plain  text\n here", "plain text here"), ("<p>a<p>b", "a\n\nb"), ("a<br>b<br/>c", "a\nb\nc"),
    ("<div>a</div><div>b</div>", "a\nb"), ("x<b>y</b> <i> z</i>", "xy z"), ("<ul><li>a<li>b<ul><li>c</ul></ul>d", "- a\n- b\n  - c\n\nd"),
    ("<ol start=9><li>a</li><li>b</ol>", "9. a\n10. b"), ("<pre>a\n  b</pre>", "a\n  b"), ("&lt;b&gt; &amp;amp; &#233;", "<b> &amp; é"),
    ("<script>var a='<p>no';</script><style>p{}</style>yes<!-- no -->", "yes"), ("<p hidden>no</p><p style='DISPLAY : none'>no</p>yes", "yes"),
    ("<head><title>no</title></head><body>yes", "yes"), ("<table><tr><td>a<td>bb<tr><td>ccc<td>d</table>", "a    bb\nccc  d"),
    ("<table><tr><td colspan=2>wide cell</td></tr><tr><td>a</td><td>b</td></tr></table>", "wide cell\na  b"),
    ("<table><tr><td>x<br>y<td>z</table>", "x  z\ny"), ("<table><tr><td><table><tr><td>in</table><td>out</table>", "in  out"),
    ("<dl><dt>t<dd>d</dl>", "t\n  d"), ("<details><summary>s</summary>no</details>", "s"), ("<details open><summary>s</summary>yes</details>", "s\nyes"),
    ("<blockquote>q</blockquote>e", "  q\n\ne"), ("<p>a</div></p></td>b", "a\n\nb"), ("<h1>a<h2>b", "a\n\nb"), ("<input value=no><select><option>o<option>p</select>", "o\np"),
    ("<p>unclosed <b>bold<p>next", "unclosed bold\n\nnext"), ("a<noscript>no</noscript><template>no</template>b", "ab"),("<", "<"), ("&bogus; &", "&bogus; &"),
]


def test_rendering(spark):
    for html, want in HTML:
        assert htmltext.extract(html) == want, html
    df = spark.createDataFrame([(i, "u", h, "t", 0) for i, (h, _) in enumerate(HTML)] + [(None, "u", "n", "t", 0), (0, "u", "again", "t", 0)],
                               "page_id long, url string, html string, text string, n_lines int")
    got = sorted(((r.page_id, r.text, r.n_lines, r.n_chars) for r in htmltext.visible_text(df).collect()), key=str)
    want = [(i, w, 0 if not w else w.count("\n") + 1, len(w or "")) for i, (_, w) in enumerate(HTML)] + [(None, "n", 1, 1), (0, "again", 1, 5)]
    assert got == sorted(want, key=str)
    assert htmltext.visible_text(df.limit(0)).count() == 0


def test_rendering_of_large_and_deep_pages():
    deep = "<div>" * 30_000 + "x" + "</div>" * 30_000
    assert htmltext.extract(deep) == "x"
    assert htmltext.extract("<table>" * 3000 + "y") == "y"
    assert len(htmltext.extract("<p>word " * 50_000).split("\n\n")) == 50_000
    rows = htmltext.extract("<table>" + "<tr><td>a<td>b" * 5000 + "</table>").split("\n")
    assert rows == ["a  b"] * 5000


def test_deep_elements_are_elements():
    for deep in ("<div>" * 400, "<font>" * 30_000, "<div><b>" * 5000):
        page = deep + "<table><tr><td hidden><div>no</div><script>no</script>no<td>a<td>bb<tr><td>ccc<td>d</table><div style='display:none'>no<div>no</div>no</div><style>no</style>z"
        assert htmltext.extract(page) == "a    bb\nccc  d\n\nz", deep[:8]
    assert htmltext.extract("<div>" * 200 + "<ul><li>a<li>b</ul>") == "- a\n- b"
    assert htmltext.extract("<table><tr><td>x" * 500).split() == ["x"] * 500
    assert htmltext.extract("<ul><li>x" * 3000).split() == ["-", "x"] * 3000


def test_pages_keep_every_visible_word(spark, sf):
    import re
    for r in htmltext.visible_text(spark.read.parquet(f"{sf}/pages.parquet")).join(spark.read.parquet(f"{sf}/pages.parquet"), "page_id").collect():
        body = re.sub(r"<head>.*?</head>|<script>.*?</script>|<!--.*?-->", " ", r.html, flags=re.S)
        import html as h
        want = h.unescape(re.sub(r"<[^>]*>", " ", body)).split()
        assert [w for w in r.text.split() if w != "-"] == [w for w in want if w != "-"]


def test_wide_cells_and_spans_add_few_blanks():
    long = "<table><tr><td>" + "x" * 20_000 + "<td>b</tr>" + "<tr><td>a<td>b</tr>" * 1000 + "</table>"
    spans = "<table><tr>" + "<td>" + "<td>".join(["w" * 60] * 100) + "</tr>" + "<tr><td colspan=99>x<td>y</tr>" * 1000 + "</table>"
    nested = "<table><tr><td>a<td>" * 60 + "x" * 50 + "</table>" * 60
    for page in (long, spans, nested, (long + spans) * 3):
        text = htmltext.extract(page)
        assert len(text) <= 4 * len(page) and text.count("x") == page.count("x")
    assert htmltext.extract(long).split("\n")[1] == "a  b"


@pytest.mark.parametrize("html,text", [
    ("<svg><title>no</title><defs><text>no</text></defs><path d='x'/><text>yes</text></svg> end", "yes end"),
    ("<p>a <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> b", "a x=2 b"),
    ("<div style='visibility:hidden'>no<p style='visibility: visible'>yes</p>no</div>z", "yes\n\nz"),
    ("<textarea><b>kept</b> &amp; so</textarea>", "<b>kept</b> & so"),
    ("<div style='visibility:visible'><i style='visibility:hidden'>no</i>yes</div>", "yes")])
def test_what_browsers_show(html, text):
    assert htmltext.extract(html) == text


def test_damaged_archives_end_with_an_error_row():
    def record(kind, length, body):
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{kind}>\r\nContent-Length: {length}\r\n\r\n".encode() + body + b"\r\n\r\n"

    head = b"HTTP/1.1 200 OK\r\nContent-Length: 12, 12\r\n\r\n"
    one, two = record("revisit", len(head), head), record("response", 5, b"a\r\n\r\n"[:5])
    assert [(r[1], r[5], r[-1]) for r in warc.parse(one, True)] == [("revisit", None, None)]
    packed = gzip.compress(one) + gzip.compress(two)
    whole = [r[1] for r in warc.parse(packed, True)]
    assert whole == ["revisit", "response"]
    noise = gzip.compress(random.Random(1).randbytes(200_000))
    for data, first in ((packed[:-9], "revisit"), (packed[:40], None), (gzip.compress(one) + noise[:1000], "revisit"), (packed + b"junk", "revisit"),
                        (gzip.compress(one) + packed[:10] + b"\xff" * 50, "revisit")):
        got = list(warc.parse(data, True))
        assert got[-1][-1] and (got[0][1] == first)
    for bad in ("x", "", "9" * 30, "²"):
        assert list(warc.parse(record("response", bad, b""), True))[-1][-1].startswith("broken record")
