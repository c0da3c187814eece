"""WARC derivatives: metadata and plain-text conversion records from responses.

Records are rows: record_id, type, uri, date, headers (the further WARC headers by name) and block.
`derive` makes two of each response and links them to it:

metadata    application/warc-fields: title, language, charset, links, and what must outlive the
            response: its HTTP status and headers, its WARC headers and its digests.
conversion  text/plain: the page's text, block by block, without scripts, styles and markup.

Both carry WARC-Refers-To with the response's id, its target URI and date, and digests of their own
(sha256, hexadecimal). Their ids follow from the response's id and their type, so a task that runs
again makes the same records. All work is row by row; nothing is shuffled.

A page is read once, tag by tag, in time that grows with its length (but for a logarithm) however broken
it is: after TRIES tags that do not end, ends are looked up in a table of quotes and brackets.

Transfer and content codings (chunked, gzip, deflate) are undone in their order; what is cut off or broken is
read as far as it goes, and a body that does not look like its coding is taken as it is. A body in another
coding (br, zstd) gives no text and no links, and its metadata says so (undecoded); so does one that is no text by its
content type (not-text). Links are relative to the page's <base> where it has one.

Files: one gzip member to a record. Tasks write to a hidden folder, and the driver moves the files when
all are done; readers unzip and parse a file piece by piece, so what they hold is one record.

Defined cases: rows of other types than response, and responses without an id, are left out; a null
or empty block gives an empty text and no links; a block without an HTTP head is taken as the
payload; undecodable bytes become U+FFFD; repeated rows each give two records; other columns pass.
"""

from __future__ import annotations

import hashlib
import html
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from typing import NamedTuple
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ketframe.llm._common import bounded_batches

DATE = "1970-01-01T00:00:00Z"
RECORD = "struct<record_id: string, type: string, refers_to: string, uri: string, date: string, headers: map<string, string>, block: string>"
TEMP = "__ketframe_"

#: Tags that do not end which are looked for before ends are put into a table.
TRIES = 50
#: Elements whose content is not shown.
RAW, HIDDEN = ("script", "style"), ("noscript", "template", "svg")
#: Elements that a head may hold.
HEAD_PARTS = {"base", "basefont", "bgsound", "link", "meta", "html", "head", "title", *RAW, "noscript", "template"}
BLOCKS = set("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol option p pre section select table tbody td tfoot th thead tr ul".split())
LINKED = {"a", "area", "link", "img", "script", "iframe", "frame", "source"}
_START = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][\w:-]*)|[!?])")
_REST = re.compile(r"(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTR = re.compile(r"([^\s\"'=>/]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++)))?|.", re.S)
_CLOSE = {t: re.compile(rf"</{t}(?![\w-])[^>]*+>?", re.I) for t in (*RAW, *HIDDEN, "title")} | {"!": re.compile("-->")}
_LONG_REFERENCE = re.compile(r"&#(?:[0-9]{20,}|[xX][0-9a-fA-F]{20,});?")
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?([\w.:-]+)", re.I)
_CHUNK = re.compile(rb"([0-9a-fA-F]{1,15})[^\r\n]{0,200}\r\n")
_MEMBER = b"\x1f\x8b\x08"
_HEAD_END = re.compile(rb"\r?\n\r?\n")
_ORIGIN = re.compile(r"https?://[^/?#]+", re.I)


def digest(block: bytes) -> str:
    return "sha256:" + hashlib.sha256(block).hexdigest()


def derived_id(response_id: str, kind: str) -> str:
    h = hashlib.md5(f"{kind} of {response_id}".encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP response; lines end with CR LF or a bare LF."""
    if not block.startswith(b"HTTP/"):
        return "", [], block
    end = _HEAD_END.search(block)
    head, payload = (block[: end.start()], block[end.end() :]) if end else (block, b"")
    first, *rest = re.split("\r?\n", head.decode("latin-1"))
    return first, [(k.strip(), v.strip()) for k, c, v in (line.partition(":") for line in rest) if c], payload


def _dechunked(body: bytes) -> bytes:
    """A body without chunk sizes; what is no chunk ends it, and a body that starts with none is taken as it is."""
    out, at = [], 0
    while m := _CHUNK.match(body, at):
        size = int(m[1], 16)
        out.append(body[m.end() : m.end() + size])
        at = m.end() + size + 2
        if not size or at > len(body):
            break
    return b"".join(out) if out else body


def _inflated(body: bytes, bits: int) -> bytes:
    """As much as can be unzipped of a body."""
    out: list[bytes] = []
    try:
        while body:
            z = zlib.decompressobj(bits)
            for at in range(0, len(body), 1 << 16):
                out.append(z.decompress(body[at : at + (1 << 16)]))
                if z.eof:
                    break
            body = z.unused_data + body[at + (1 << 16) :] if z.eof else b""
            if body and body[:2] != b"\x1f\x8b":
                break
    except zlib.error:
        pass
    return b"".join(out)


def decode_body(body: bytes, headers: list[tuple[str, str]]) -> tuple[bytes, str | None]:
    """(body without its codings, the coding that could not be undone): transfer codings first, each kind from the last one applied."""
    named = lambda name: [x.strip().lower() for k, v in headers if k.lower() == name for x in v.split(",")]
    for coding in (*reversed(named("transfer-encoding")), *reversed(named("content-encoding"))):
        if coding == "chunked":
            body = _dechunked(body)
        elif coding in ("gzip", "x-gzip"):
            body = _inflated(body, 31) if body[:2] == b"\x1f\x8b" else body
        elif coding == "deflate":
            body = _inflated(body, 15) or _inflated(body, -15) or body
        elif coding not in ("", "identity"):
            return b"", coding
    return body, None


def is_text(body: bytes, headers: list[tuple[str, str]]) -> bool:
    """Whether a payload is markup or text: by its content type, or where none is given by the lack of zero bytes and of a PDF's mark."""
    told = next((v.split(";")[0].strip().lower() for k, v in headers if k.lower() == "content-type"), "")
    if told:
        return told.startswith("text/") or told.endswith(("+xml", "/xml", "/json", "+json", "/javascript")) or "/" not in told
    return b"\0" not in body[:1024] and not body.startswith(b"%PDF")


def decode_payload(payload: bytes, headers: list[tuple[str, str]]) -> tuple[str, str]:
    """(text, charset) by the HTTP header, the page's own word, or UTF-8."""
    told = next((v for k, v in headers if k.lower() == "content-type"), "").encode()
    found = _CHARSET.search(told) or _CHARSET.search(payload[:2048])
    charset = found[1].decode("ascii", "replace").lower() if found else "utf-8"
    try:
        return payload.decode(charset, "replace"), charset
    except (LookupError, ValueError):
        return payload.decode("utf-8", "replace"), "utf-8"


class _Ends:
    """Where tags end: at the first > that is not in quotes."""

    def __init__(self, page: str):
        self.page, self.tried, self.marks = page, 0, None

    def after(self, at: int) -> int:
        """The place behind the tag whose name ends before `at`; -1 if it does not end."""
        if self.tried < TRIES:
            if m := _REST.match(self.page, at):
                return m.end()
            self.tried += 1
            return -1
        if self.marks is None:
            self.marks = [m.start() for m in re.finditer("['\">]", self.page)]
            self.same = {q: [p for p in self.marks if self.page[p] == q] for q in "'\""}
            self.ends = {len(self.marks): -1}
        path, k = [], bisect_left(self.marks, at)
        while k not in self.ends:  # a mark outside quotes: > ends the tag, a quote leads behind its partner
            p = self.marks[k]
            path.append(k)
            if self.page[p] == ">":
                self.ends[k] = p + 1
                break
            partners = self.same[self.page[p]]
            i = bisect_right(partners, p)
            k = bisect_right(self.marks, partners[i]) if i < len(partners) else len(self.marks)
        for x in path:
            self.ends[x] = self.ends[k]
        return self.ends[k]


class Page(NamedTuple):
    text: str
    links: list[tuple[str, str]]
    title: str | None
    language: str | None
    base: str | None


def attributes(tag: str) -> dict[str, str]:
    """The attributes of a tag's inside, the first of each name."""
    out: dict[str, str] = {}
    for name, *values in _ATTR.findall(tag):
        if name:
            out.setdefault(name.lower(), "".join(values))
    return out


def read_page(page: str) -> Page:
    """Text (a line for each block that has some), links as they stand, title, language and base of a page.

    A head ends at </head> or, where that is left out, at the first thing that a head cannot hold (a body,
    a flow element, text). Unclosed comments, scripts and styles run to the end of the page; of other
    unclosed elements only the tag goes. Links in elements that are not shown count, those in comments
    and scripts do not.
    """
    ends, missing = _Ends(page), set()
    out: list[str] = []
    links: list[tuple[str, str]] = []
    title = language = base = None
    at = shown = search = 0  # text from `at` on is new; before `shown` it is hidden
    head = False

    def close(tag: str, start: int) -> int | None:
        """Where the end tag begins and ends, or None."""
        if tag not in missing:
            if m := _CLOSE[tag].search(page, start):
                return m
            missing.add(tag)
        return None

    while m := _START.search(page, search):
        comment, slash, name = m.groups()
        name = (name or "").lower()
        end = m.end() if comment else ends.after(m.end())
        if end < 0:  # no tag
            search = m.start() + 1
            continue
        start = max(at, shown)
        if start < m.start():
            text = page[start : m.start()]
            if not head or text.strip():
                head = False
                out.append(text)
        search = at = end
        if head and (name == "head" if slash else name not in HEAD_PARTS and name):
            head = False
            if slash:
                continue
        elif head and slash and name in ("body", "html", "br"):
            head = False
        quiet = head or m.start() < shown
        if comment or name in RAW and not slash:
            if not quiet:
                out.append("\n")
            if name in LINKED and (url := attributes(page[m.end() : end - 1]).get("src")):
                links.append((name, url))
            found = close(name or "!", end)
            search = at = found.end() if found else len(page)
            continue
        if slash:
            pass
        elif name in LINKED:
            own = attributes(page[m.end() : end - 1])
            if url := own.get("href") or own.get("src"):
                links.append((name, url))
        elif name == "base" and base is None:
            base = attributes(page[m.end() : end - 1]).get("href") or None
        elif name == "html" and language is None:
            language = attributes(page[m.end() : end - 1]).get("lang") or None
        elif name == "title" and (title is None or head):
            if found := close(name, end):
                title = page[end : found.start()] if title is None else title
                if head:
                    search = at = found.end()
        elif name in HIDDEN and m.start() >= shown:
            if not quiet:
                out.append("\n")
            if not (name == "svg" and page[end - 2] == "/") and (found := close(name, end)):
                shown = found.end()
            continue
        if not slash and name == "head" and not quiet:
            head = True
            out.append("\n")
        elif not quiet and name in BLOCKS:
            out.append("\n")
    out.append(page[max(at, shown) :])
    whole = html.unescape(_LONG_REFERENCE.sub("\ufffd", "".join(out)))
    lines = (" ".join(line.split()) for line in whole.split("\n"))
    return Page("\n".join(line for line in lines if line), links, title, language, base)


def plain_text(page: str) -> str:
    """The text of a page, a line for each block that has some."""
    return read_page(page).text


def links(found: list[tuple[str, str]], base: str) -> list[tuple[str, str]]:
    """(element, absolute URL) of a page's links, each pair once, in the order of the page."""
    origin = _ORIGIN.match(base)
    out = {}
    for tag, url in found:
        url = html.unescape(_LONG_REFERENCE.sub("\ufffd", url.strip()))
        if not url or url[0] == "#" or url[:11].lower() == "javascript:":
            continue
        if origin and url[0] == "/" and url[1:2] != "/" and "/." not in url:
            url = origin[0] + url
        elif not _ORIGIN.match(url):
            try:
                url = urljoin(base, url)
            except ValueError:
                continue
        out[tag, re.sub(r"\s", "%20", url)] = None
    return list(out)


def base_of(uri: str, base: str | None) -> str:
    """What a page's links are relative to: its <base>, itself relative to the page, or the page."""
    try:
        return urljoin(uri, html.unescape(_LONG_REFERENCE.sub("\ufffd", base.strip()))) if base else uri
    except ValueError:
        return uri


def _field(name: str, value: str) -> str:
    return f"{name}: {' '.join(value.split())}\r\n"


def derivatives(record_id: str, uri: str | None, date: str | None, headers: dict[str, str], block: bytes) -> list[dict]:
    """The metadata and the conversion record of a response."""
    status, http, payload = http_parts(block)
    body, undecoded = decode_body(payload, http)
    page, charset = decode_payload(body, http)
    readable = is_text(body, http)
    found = read_page(page) if readable else Page("", [], None, None, None)
    fields = [(name, html.unescape(value)) for name, value in (("title", found.title), ("language", found.language)) if value is not None] + [("charset", charset)]
    fields += [("undecoded", undecoded)] * bool(undecoded) + [("not-text", "true")] * (not readable)
    fields += [("http-status", status)] * bool(status) + [(f"http-{k.lower()}", v) for k, v in http]
    fields += [(f"source-{k.lower()}", v) for k, v in sorted(headers.items())]
    fields += [(f"source-{k}", v) for k, v in (("warc-block-digest", digest(block)), ("warc-payload-digest", digest(payload))) if k not in {h.lower() for h in headers}]
    fields += [("outlink", f"{url} {tag}") for tag, url in links(found.links, base_of(uri or "", found.base))]
    blocks = {"metadata": ("application/warc-fields", "".join(_field(*f) for f in fields)), "conversion": ("text/plain; charset=utf-8", found.text)}
    out = []
    for kind, (content, text) in blocks.items():
        data = text.encode("utf-8", "replace")
        own = {"Content-Type": content, "Content-Length": str(len(data)), "WARC-Block-Digest": digest(data), "WARC-Refers-To": record_id}
        out.append({"record_id": derived_id(record_id, kind), "type": kind, "refers_to": record_id, "uri": uri, "date": date, "headers": list(own.items()), "block": data.decode()})
    return out


def responses(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = DATE) -> DataFrame:
    """Pages as response records; other columns pass."""
    body = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n")).cast("binary")
    h = F.md5(F.concat_ws("\x1f", F.col(id_col).cast("string"), F.col(url_col)).cast("binary"))
    uuid = F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))
    named = {"Content-Type": F.lit("application/http; msgtype=response"), "Content-Length": F.octet_length("block").cast("string"), "WARC-Block-Digest": _digest(F.col("block")), "WARC-Payload-Digest": _digest(body)}
    rows = pages.withColumns({"record_id": uuid, "type": F.lit("response"), "uri": F.col(url_col), "date": F.lit(date), "block": F.concat(head, body)})
    return rows.withColumn("headers", F.create_map(*(x for k, v in named.items() for x in (F.lit(k), v)))).drop(*({html_col, url_col} - {"uri", "block"}))


def _digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block, 256))


def derive(records: DataFrame) -> DataFrame:
    """The derivatives of all responses, as records with refers_to; columns that records have besides pass."""
    bounded_batches(records.sparkSession)

    @F.arrow_udf(f"array<{RECORD}>")
    def made(record_id: pa.Array, uri: pa.Array, date: pa.Array, headers: pa.Array, block: pa.Array) -> pa.Array:
        rows = zip(record_id.to_pylist(), uri.to_pylist(), date.to_pylist(), headers.to_pylist(), block)
        text = pa.string()
        names = ("record_id", "type", "refers_to", "uri", "date")
        kind = pa.struct([*((n, text) for n in names), ("headers", pa.map_(text, text)), ("block", text)])
        return pa.array([derivatives(i, u, d, dict(h or ()), b.as_buffer().to_pybytes() if b.is_valid else b"") for i, u, d, h, b in rows], pa.list_(kind))

    own = ("record_id", "type", "refers_to", "uri", "date", "headers", "block")
    rest = [c for c in records.columns if c not in own]
    rows = records.where((F.col("type") == "response") & F.col("record_id").isNotNull())
    return rows.select(*rest, F.explode(made("record_id", "uri", "date", "headers", "block")).alias(TEMP + "r")).select(*rest, *(F.col(TEMP + "r")[n].alias(n) for n in own))


def _opened(path: str):
    """(file system, path in it) for a path or URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))


class _Written(WriterCommitMessage):
    def __init__(self, name: str):
        self.name = name


class _WarcWriter(DataSourceArrowWriter):
    """Writes rows (record) as one gzip member each, a file to a task."""

    def __init__(self, path: str):
        self.path = path

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        import gzip
        import uuid

        files, path = _opened(self.path)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        files.create_dir(f"{path}/_writing", recursive=True)
        with files.open_output_stream(f"{path}/_writing/{name}", compression=None) as out:
            for batch in batches:
                for record in batch.column(0):
                    out.write(gzip.compress(record.as_buffer(), compresslevel=6, mtime=0))
        return _Written(name)

    def commit(self, messages: list) -> None:
        files, path = _opened(self.path)
        for m in messages:
            files.move(f"{path}/_writing/{m.name}", f"{path}/{m.name}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        files, path = _opened(self.path)
        if files.get_file_info(f"{path}/_writing").type == fs.FileType.Directory:
            files.delete_dir(f"{path}/_writing")


class WarcFiles(DataSource):
    """Sink of whole WARC records as bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc_files"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _WarcWriter(self.options["path"])


def write_warc(records: DataFrame, path: str) -> None:
    """Records as gzipped WARC files in the folder path, one to a partition, in a store that pyarrow opens."""
    told = F.transform(F.array_sort(F.map_entries(F.coalesce("headers", F.create_map().cast("map<string, string>")))), lambda e: F.concat(e["key"], F.lit(": "), e["value"], F.lit("\r\n")))
    told = F.filter(told, lambda x: x.isNotNull() & ~F.lower(x).startswith("content-length:"))
    block = F.coalesce(F.col("block").cast("binary"), F.lit(b""))
    line = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(name + ": "), c, F.lit("\r\n"))).otherwise("")
    head = F.concat(F.lit("WARC/1.0\r\n"), line("WARC-Type", F.col("type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Target-URI", F.col("uri")), line("WARC-Date", F.col("date")), F.array_join(told, ""), line("Content-Length", F.octet_length(block).cast("string")), F.lit("\r\n"))
    spark = records.sparkSession
    spark.dataSource.register(WarcFiles)
    records.select(F.concat(head.cast("binary"), block, F.lit(b"\r\n\r\n")).alias("record")).write.format("warc_files").mode("append").save(path)


#: Stands between the bytes of members, where a member's checksum was right.
MEMBER_END = b""


class Gap(NamedTuple):
    """A stretch of a file that gives no bytes."""

    offset: int
    reason: str


def _unzipped(pieces: Iterable[bytes], most: int = 1 << 20) -> Iterator[bytes | Gap]:
    """The bytes of a file in pieces, unzipped member by member if it is gzipped; behind a damaged member goes on at the next one's mark."""
    z, kind, offset, lost, held = None, None, 0, False, b""
    for data in pieces:
        if kind is None and data:
            kind = data[:1] == b"\x1f"
        if not kind:
            if data:
                yield data
            continue
        data, held = held + data, b""
        while data:
            if lost:
                at = data.find(_MEMBER)
                if at < 0:  # the mark may begin at the end of a piece
                    held = data[max(0, len(data) - len(_MEMBER) + 1) :]
                    offset += len(data) - len(held)
                    break
                data, offset, lost = data[at:], offset + at, False
            if z is None and data[:1] == b"\0":  # padding between members
                before, data = len(data), data.lstrip(b"\0")
                offset += before - len(data)
                continue
            z = z or zlib.decompressobj(31)
            before = len(data)
            try:
                out = z.decompress(data, most)
            except zlib.error as e:
                yield Gap(offset, str(e))
                z, lost, data = None, True, data[1:]
                offset += 1
                continue
            if out:
                yield out
            data = z.unconsumed_tail
            if z.eof:
                data, z = z.unused_data, None
                yield MEMBER_END
            offset += before - len(data)
    if z is not None and not z.eof:
        yield Gap(offset, "the file ends within a member")


def parse_warc(pieces: Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a WARC file given in pieces, gzipped or not; of the file, one record is held.

    Values of a header that is given several times are joined by commas. A record that is cut off has the bytes that are
    there and says WARC-Truncated, as does the last record of a damaged member. Where the file is damaged, a record of type
    `damaged` names the offset and the reason.
    """
    source, held, at, gap = _unzipped(pieces), bytearray(), 0, None
    last, sure = None, True  # a record waits until its member's checksum is known to be right, or the next one comes

    def more() -> bool:
        nonlocal at, gap, sure
        if gap is not None:
            return False
        del held[:at]
        at = 0
        piece = next(source, None)
        while isinstance(piece, bytes) and not piece:
            sure, piece = True, next(source, None)
        if isinstance(piece, Gap):
            gap = piece
        elif piece is not None:
            held.extend(piece)
        return piece is not None and gap is None

    while True:
        headers = None
        while (start := held.find(b"WARC/", at)) < 0:
            at = max(at, len(held) - 4)
            if not more():
                break
        if start >= 0:
            at = start
            while not (end := _HEAD_END.search(held, at)):
                if not more():
                    break
            if end:
                headers = {}
                for name, _, value in (x.partition(":") for x in re.split("\r?\n", held[at : end.start()].decode("utf-8", "replace"))[1:]):
                    same = next((k for k in headers if k.lower() == name.strip().lower()), name.strip())
                    headers[same] = f"{headers[same]}, {value.strip()}" if same in headers else value.strip()
                size = next((v for k, v in headers.items() if k.lower() == "content-length"), "0")
                size, at = int(size) if size.isascii() and size.isdigit() else 0, end.end()
                while len(held) - at < size and more():
                    pass
                if len(held) - at < size and not any(k.lower() == "warc-truncated" for k in headers):
                    headers["WARC-Truncated"] = "unspecified"
                if last:
                    yield last
                last, sure = (headers, bytes(held[at : at + size])), False
                at = min(at + size, len(held))
        if headers is None:  # nothing more up to the end or the next gap
            if last:
                if gap is not None and not sure:
                    last[0].setdefault("WARC-Truncated", "unspecified")
                yield last
                last = None
            if gap is None:
                return
            yield {"WARC-Type": "damaged", "offset": str(gap.offset), "reason": gap.reason}, b""
            held.clear()
            at, gap = 0, None


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files; a file is read by one task, as a stream where pyarrow can open its store, else as Spark loads it."""
    schema = pa.schema([*((n, pa.string()) for n in ("record_id", "type", "refers_to", "uri", "date")), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])
    names = {"warc-record-id": "record_id", "warc-type": "type", "warc-target-uri": "uri", "warc-date": "date"}

    def pieces(file: str | bytes) -> Iterator[bytes]:
        if isinstance(file, bytes):
            yield from (file[k : k + (1 << 20)] for k in range(0, len(file), 1 << 20))
            return
        files, at = _opened(file)
        with files.open_input_stream(at, compression=None) as stream:
            while data := stream.read(1 << 20):
                yield data

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0):
                part, held = [], 0
                for headers, block in parse_warc(pieces(file.as_py())):
                    row = {names[k.lower()]: v for k, v in headers.items() if k.lower() in names}
                    rest = [(k, v) for k, v in headers.items() if k.lower() not in names]
                    refers_to = next((v for k, v in headers.items() if k.lower() == "warc-refers-to"), None)
                    rest += [("file", file.as_py())] * (row.get("type") == "damaged" and isinstance(file.as_py(), str))
                    part.append(row | {"refers_to": refers_to, "headers": rest, "block": block})
                    held += len(block)
                    if len(part) == 256 or held > 1 << 24:
                        yield pa.RecordBatch.from_pylist(part, schema)
                        part, held = [], 0
                if part:
                    yield pa.RecordBatch.from_pylist(part, schema)

    from urllib.parse import unquote

    files = spark.read.format("binaryFile").load(path)
    some = files.select("path").first()
    try:
        _opened(some.path if some else path)
        found = files.select(F.udf(unquote)("path"))  # one row a file
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        found = files.select("content")
    return found.mapInArrow(rows, "record_id string, type string, refers_to string, uri string, date string, headers map<string, string>, block binary")


def op2(spark, sf_dir: str) -> DataFrame:
    """Query: both derivatives of every page."""
    out = derive(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    h = F.col("headers")
    return out.select("page_id", "type", "record_id", "refers_to", "uri", "date", h["Content-Type"].alias("content_type"), h["Content-Length"].cast("long").alias("content_length"), h["WARC-Block-Digest"].alias("block_digest"), "block")
