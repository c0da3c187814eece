import gzip
import hashlib
import random
import time
import tracemalloc
import zlib
from html.parser import HTMLParser

from ketframe.llm import warc as op


class Slow(HTMLParser):
    """Text of a page by a parser, without white space and entities' finer points."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.skip, self.out, self.found = 0, [], []

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style", "head")
        if tag == "a":
            self.found += [v for k, v in attrs if k == "href"]

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style", "head")

    def handle_data(self, data):
        if not self.skip:
            self.out.append(data)


def test_against_a_parser(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = op.op2(spark, sf).collect()
    assert len(rows) == 2 * len(pages)
    source = {r.page_id: r for r in op.responses(spark.read.parquet(f"{sf}/pages.parquet")).collect()}
    for r in rows:
        page, s = pages[r.page_id], source[r.page_id]
        assert r.refers_to == s.record_id and r.uri == page.url and r.record_id == op.derived_id(s.record_id, r.type)
        data = r.block.encode()
        assert r.content_length == len(data) and r.block_digest == "sha256:" + hashlib.sha256(data).hexdigest()
        slow = Slow()
        slow.feed(page.html)
        if r.type == "conversion":
            assert "".join(r.block.split()) == "".join("".join(slow.out).split())
        else:
            fields = [x.split(": ", 1) for x in r.block.split("\r\n") if x]
            assert ["source-warc-payload-digest", "sha256:" + hashlib.sha256(page.html.encode()).hexdigest()] in fields
            assert ["source-warc-block-digest", s.headers["WARC-Block-Digest"]] in fields and ["http-content-type", "text/html; charset=utf-8"] in fields
            got = [v.rsplit(" ", 1)[0] for k, v in fields if k == "outlink" and v.endswith(" a")]
            assert got == list(dict.fromkeys(op.urljoin(page.url, x.strip()).replace(" ", "%20") for x in slow.found if x.strip() and x.strip()[0] != "#"))


def test_edges(spark):
    rows = [(1, "http://a/b/c", None), (2, None, ""), (None, "http://a", "<p>x"), (3, "http://a/b/", "plain é & < b"), (4, "http://a", "<a href='../q?x=1&amp;y'>l</a><!-- <p>no"), (5, "x", "<p>w</p>" * 40_000), (1, "http://a/b/c", None)]
    df = spark.createDataFrame([(*r, 7, "k") for r in rows], "page_id int, url string, html string, n int, refers_to string")
    got = op.derive(op.responses(df)).collect()
    assert len(got) == 2 * len(rows) and all(r.n == 7 for r in got)
    text = {r.page_id: r.block for r in got if r.type == "conversion"}
    assert text == {1: "", 2: "", None: "x", 3: "plain é & < b", 4: "l", 5: "\n".join(["w"] * 40_000)}
    assert "outlink: http://a/q?x=1&y a" in next(r.block for r in got if r.page_id == 4 and r.type == "metadata")
    assert op.derive(op.responses(df.limit(0))).count() == 0
    other = spark.createDataFrame([("i", "request", None, None, {"a": "b"}, bytearray(b"x")), (None, "response", None, None, None, None), ("j", "response", None, None, None, bytearray(b"\xff<b>y</b>"))], "record_id string, type string, uri string, date string, headers map<string, string>, block binary")
    assert [r.block for r in op.derive(other).collect() if r.type == "conversion"] == ["�y"]


def test_charset():
    assert op.decode_payload("é".encode("latin-1"), [("Content-Type", "text/html; charset=ISO-8859-1")]) == ("é", "iso-8859-1")
    assert op.decode_payload(b"<meta charset=nonsense>x", [])[1] == "utf-8"


def test_files_round_trip(spark, sf, tmp_path):
    records = op.derive(op.responses(spark.read.parquet(f"{sf}/pages.parquet")))
    op.write_warc(records, f"{tmp_path}/out")
    back = {r.record_id: r for r in op.read_warc(spark, f"{tmp_path}/out/*.gz").collect()}
    assert len(back) == records.count()
    for r in records.collect():
        b = back[r.record_id]
        assert (b.type, b.refers_to, b.uri, b.date, bytes(b.block), b.headers) == (r.type, r.refers_to, r.uri, r.date, r.block.encode(), r.headers)


def test_left_out_and_missing_end_tags():
    text = op.plain_text
    assert text("<html><head><title>T</title><meta charset=utf-8><body><p>one<p>two") == "one\ntwo"
    assert text("<head><title>T</title><script>x='<p>no'</script><!-- <p>no --><style>p{}</style><p>one</p>") == "one"
    assert text("<head><title>T</title>text at once<p>one") == "text at once\none"
    assert text("<head><title>T</title></head><body><header>top</header>one") == "top\none"
    for tag in ("svg", "noscript", "template"):
        assert text(f"<p>a</p><{tag}><p>b</p>") == "a\nb"
        assert text(f"<p>a</p><{tag}>no</{tag}><p>b</p><{tag}>c") == "a\nb\nc"
    assert text("<p>a</p><svg width=1 /><p>b</p><svg>no</svg>") == "a\nb"
    for tag in ("<script>", "<style>", "<!--"):
        assert text(f"<p>a</p>{tag}<p>b</p>") == "a"
    assert text("<svg>x" * 40_000) == "\n".join("x" * 40_000)


def test_time_grows_with_length():
    began = time.time()
    n = 200_000
    for part in ("<a ", "<html ", "<title>", "<svg>", "<noscript>x", "<!-", "</", "<a href='", '<a "x" ', "<p title=\"a>b\" ", "&#", "<head>", "<script"):
        for end in ("", ">", "'", '">', "</svg></noscript></title>"):
            op.read_page(part * (n // len(part)) + end)
    op.read_page("&#" + "9" * n + ";" + "<a " + "x=" * n + ">" + "<a " + " " * n + "href>")
    assert time.time() - began < 60


def test_attributes():
    page = op.read_page("<html data-lang=xx LANG='de'><title>a<b</title><a title='href=no' href = \"q'>1\">x</a><img alt=src src=i.png><a data-href=no>y</a><!-- <a href=c> --><noscript><a href=n></noscript><script src=s>'<a href=t>'</script>")
    assert page.links == [("a", "q'>1"), ("img", "i.png"), ("a", "n"), ("script", "s")] and (page.title, page.language) == ("a<b", "de")


def response(body, *headers):
    return "\r\n".join(["HTTP/1.1 200 OK", *headers, "", ""]).encode() + body


def test_codings():
    def text(body, *headers):
        made = {r["type"]: r["block"] for r in op.derivatives("i", "http://a", None, {}, response(body, *headers))}
        return made["conversion"], "undecoded: br" in made["metadata"]

    page = ("<p>" + "text é " * 5_000).encode()
    plain = op.plain_text(page.decode())
    raw = zlib.compressobj(wbits=-15)
    raw = raw.compress(page) + raw.flush()
    chunked = b"".join(b"%x;ext=1\r\n%s\r\n" % (len(x), x) for x in (gzip.compress(page)[:100], gzip.compress(page)[100:])) + b"0\r\n\r\n"
    assert text(b"5\r\n<p>hi\r\n0\r\n\r\n", "Transfer-Encoding: chunked") == ("hi", False)
    for body, *headers in [(gzip.compress(page), "Content-Encoding: gzip"), (zlib.compress(page), "Content-Encoding: deflate"), (raw, "Content-Encoding: deflate"), (page, "Content-Encoding: gzip"), (page, "Transfer-Encoding: chunked"), (chunked, "Content-Encoding: x-gzip", "Transfer-Encoding: chunked"), (gzip.compress(page[:70]) + gzip.compress(page[70:]), "Content-Encoding: gzip"), (gzip.compress(gzip.compress(page)), "Content-Encoding: gzip, gzip"), (page, "Content-Encoding: identity")]:
        assert text(body, *headers) == (plain, False), headers
    part = text(gzip.compress(random.Random(1).randbytes(200_000).hex().encode())[:100_000], "Content-Encoding: gzip")[0]
    assert 100_000 < len(part) < 300_000  # cut off
    assert text(b"\x8b\x02", "Content-Encoding: br") == ("", True)


def test_members_and_bounded_reading(spark, tmp_path):
    blocks = [bytes([k % 256]) * (k % 50) + b"\xff\x00WARC/1.0\r\n\r\n" for k in range(300)]
    df = spark.createDataFrame([(f"<{k}>", "resource", f"http://a/{k}", "d", {"X-N": str(k)}, bytearray(b)) for k, b in enumerate(blocks)], "record_id string, type string, uri string, date string, headers map<string, string>, block binary").repartition(3)
    op.write_warc(df, f"{tmp_path}/a b")
    files = [p for p in (tmp_path / "a b").iterdir()]
    assert len(files) == 3 and sum(p.read_bytes().count(b"\x1f\x8b\x08") for p in files) >= 300
    for p in files:
        data, members = p.read_bytes(), 0
        while data:
            z = zlib.decompressobj(31)
            assert z.decompress(data).count(b"WARC-Record-ID") == 1
            data, members = z.unused_data, members + 1
        assert members > 50
    back = {r.record_id: bytes(r.block) for r in op.read_warc(spark, f"{tmp_path}/a b/*.warc.gz").collect()}
    assert back == {f"<{k}>": b for k, b in enumerate(blocks)}

    def endless(n):  # members of a megabyte each, as a file of n megabytes would give them
        one = gzip.compress(b"WARC/1.0\r\nContent-Length: 1000000\r\n\r\n" + bytes(1_000_000) + b"\r\n\r\n")
        for _ in range(n):
            yield from (one[:300], one[300:])

    tracemalloc.start()
    assert sum(len(b) for _, b in op.parse_warc(endless(1_000))) == 10**9
    assert tracemalloc.get_traced_memory()[1] < 2e7
    tracemalloc.stop()
    assert [b for _, b in op.parse_warc([b"WARC/1.0\r\nContent-Len", b"gth: 3\r\n\r", b"\nabc\r\n\r\nWA", b"RC/1.0\r\n\r\n\r\n\r\n"])] == [b"abc", b""]


def both_of(head, body):
    return op.derivatives("<r>", "http://a.org/x/y", None, {}, head.encode() + body)


def conversion(head, body):
    return next(d for d in both_of(head, body) if d["type"] == "conversion")["block"]


def metadata(head, body):
    return next(d for d in both_of(head, body) if d["type"] == "metadata")["block"]


def test_heads_with_bare_line_feeds():
    assert conversion("HTTP/1.0 200 OK\nContent-Type: text/html\n\n", b"<p>hello world") == "hello world"
    assert conversion("HTTP/1.0 200 OK\r\nContent-Type: text/html\n\r\n", b"<p>one\r\n\r\ntwo") == "one\ntwo"
    assert "http-content-type: text/html" in metadata("HTTP/1.0 200 OK\nContent-Type: text/html\n\n", b"x")


def test_transfer_codings_in_order():
    import gzip

    zipped = gzip.compress(b"<p>text")
    chunked = b"%x\r\n" % len(zipped) + zipped + b"\r\n0\r\n\r\n"
    assert conversion("HTTP/1.1 200 OK\r\nTransfer-Encoding: gzip, chunked\r\n\r\n", chunked) == "text"
    assert conversion("HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n", chunked) == "text"


def test_payloads_that_are_no_text():
    pdf = b"%PDF-1.4 \x00\x01 stream"
    for head in ("HTTP/1.1 200 OK\r\nContent-Type: application/pdf\r\n\r\n", "HTTP/1.1 200 OK\r\n\r\n"):
        assert conversion(head, pdf) == "" and "not-text: true" in metadata(head, pdf)
    assert conversion("HTTP/1.1 200 OK\r\nContent-Type: application/xhtml+xml\r\n\r\n", b"<p>x") == "x"


def test_links_are_relative_to_the_base():
    page = b"<head><base href='/other/'><base href='/no/'></head><a href=z>z</a><a href=/top>t</a>"
    block = metadata("HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n", page)
    assert "outlink: http://a.org/other/z a" in block and "outlink: http://a.org/top a" in block
    assert "outlink: http://a.org/x/z a" in metadata("HTTP/1.1 200 OK\r\n\r\n", b"<a href=z>z</a>")


def record(k, body=None, size=None):
    body = body or f"body {k}".encode()
    return f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <{k}>\r\nWARC-Concurrent-To: <a>\r\nwarc-concurrent-to: <b>\r\nwarc-refers-to: <q>\r\nContent-Length: {size or len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def test_damaged_members_lose_only_themselves(spark, tmp_path):
    import gzip
    import random

    noise = random.Random(1).randbytes(4000)
    members = [gzip.compress(record(k, noise if k == 1 else None)) for k in range(5)]
    bad = bytearray(members[1])
    bad[200:260] = bytes(60)
    data = members[0] + bytes(bad) + members[2] + bytes(500) + b"".join(members[3:])
    for size in (7, 100, 1 << 20):
        got = list(op.parse_warc(data[k : k + size] for k in range(0, len(data), size)))
        whole = [h["WARC-Record-ID"] for h, b in got if h["WARC-Type"] == "response" and "WARC-Truncated" not in h]
        assert whole == ["<0>", "<2>", "<3>", "<4>"] and sum(h["WARC-Type"] == "damaged" for h, _ in got) >= 1
        first = next(h for h, _ in got if h["WARC-Type"] == "damaged")
        assert len(members[0]) <= int(first["offset"]) <= len(members[0]) + len(bad) and first["reason"]
    (tmp_path / "x.warc.gz").write_bytes(data)
    rows = op.read_warc(spark, str(tmp_path)).collect()
    assert [r.record_id for r in rows if r.type == "response"][0] == "<0>" and {r.record_id for r in rows if r.type == "response"} >= {"<2>", "<3>", "<4>"}
    gone = next(r for r in rows if r.type == "damaged")
    assert "x.warc.gz" in gone.headers["file"] and gone.headers["offset"].isdigit()
    assert rows[0].refers_to == "<q>" and rows[0].headers["WARC-Concurrent-To"] == "<a>, <b>"


def test_cut_records_say_so():
    import gzip

    data = record(0) + record(1, b"ab", 5)[:-4]
    got = list(op.parse_warc([data]))
    assert got[0][1] == b"body 0" and "WARC-Truncated" not in got[0][0] and got[1][1] == b"ab" and got[1][0]["WARC-Truncated"] == "unspecified"
    member = gzip.compress(record(0)) + gzip.compress(record(1, b"x" * 50_000))[:-30]
    kinds = [(h["WARC-Type"], "WARC-Truncated" in h) for h, _ in op.parse_warc([member])]
    assert kinds[0] == ("response", False) and kinds[-1][0] == "damaged"
