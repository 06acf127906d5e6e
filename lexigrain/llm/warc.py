"""WARC derivatives: metadata and plain-text conversion records of responses.

Every response gives a metadata record (application/warc-fields) and a conversion
record (text/plain).  Both name the response in WARC-Refers-To, with its target
address and date, and keep its headers and payload digest.  Where the table has a
column of record ids, these are what is referred to; else an id is made from the
response's own id and address.  Ids of the new records are made from it and the
record's type, so a repeated run gives the same records.  Header lines that aren't
given are left out and never made up, but for WARC-Date, which a record must have:
it is the response's date, or ``EPOCH`` where that is unknown.

``write`` makes a folder of WARC/1.1 files, one a partition and each record a gzip
member of its own, through Spark's text writer.

A page is read once from left to right, in time linear in its length.

Defined results: a null page is a response with an empty body and gives empty
text; a null address leaves that header out; line breaks in a header's value become
spaces; each input row gives two rows, repeated rows give equal records; a null id
gives ids made from the address; an empty table gives an empty result; other columns
are never read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc-record")
EPOCH = "1970-01-01T00:00:00Z"
#: What may follow the name of an element in its end tag.
END_OF_NAME = set(" \t\n\r\f/>") | {""}
#: Elements whose content isn't text, and elements that end a line.
RAW = {"script", "style", "noscript", "template"}
BLOCKS = set("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol p pre section table td th title tr ul".split())
#: A comment's start, or a tag; a `>` in a quoted value ends none, and a quote that isn't closed begins no value.
_TAG = re.compile(r"<!--|<(/?)([A-Za-z!?][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_ATTRIBUTE = re.compile(r"(?<![^\s=\"'>/])([^\s=\"'>/]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(response: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{kind} {response}')}>"


def pieces(page: str) -> Iterator[tuple[str, str, str, str]]:
    """(text, slash, name, attributes) of a page from left to right: a text, or a tag with an empty text.

    Comments and the content of RAW elements are left out; without an end they run to the
    end of the page.  A `<` that begins no tag is text.  Tags are sought up to the last
    `>` only, and a search that found nothing isn't made again, so each step goes on.
    """
    at, n, last = 0, len(page), page.rfind(">") + 1
    lower, ends = "", {}

    def find(what: str, start: int) -> int:
        nonlocal lower
        if not lower:
            lower = page.lower()
            if len(lower) != n:  # a character whose lower case is longer
                lower = "".join(x if len(x := c.lower()) == 1 else c for c in page)
        if what not in ends or -1 < ends[what] < start:
            ends[what] = lower.find(what, start)
        return ends[what]

    while at < n:
        m = _TAG.search(page, at, last) if at < last else None
        if not m:
            end = page.find("<!--", at)
            yield page[at : end if end >= 0 else n], "", "", ""
            return
        if m.start() > at:
            yield page[at : m.start()], "", "", ""
        at = m.end()
        if m[2] is None:
            end = find("-->", at)
            at = n if end < 0 else end + 3
            yield " ", "", "", ""
            continue
        name = m[2].lower()
        yield "", m[1], name, m[3]
        if name in RAW and not m[1] and not m[3].endswith("/"):
            close = find(f"</{name}", at)
            while close >= 0 and page[close + len(name) + 2 : close + len(name) + 3] not in END_OF_NAME:
                close = find(f"</{name}", close + 1)
            end = find(">", close) if close >= 0 else -1
            at = n if end < 0 else end + 1
            yield " ", "", "", ""


def attribute(tag: str, name: str) -> str | None:
    for m in _ATTRIBUTE.finditer(tag):
        if m[1].lower() == name:
            return entities.unescape(m[2] or m[3] or m[4] or "")
    return None


def read_page(page: str) -> tuple[str, str | None, str | None, list[str]]:
    """Plain text, a line for each block; declared language; title; addresses of links."""
    out: list[str] = []
    lang, title, links, into_title = None, None, [], False
    for x, slash, name, attributes in pieces(page):
        if x:
            out.append(x.replace("\n", " "))
            if into_title:
                title = (title or "") + x
            continue
        if name in BLOCKS:
            out.append("\n")
        if name == "title":
            into_title = title is None and not slash
            title = "" if into_title else title
        elif name == "html" and lang is None:
            lang = attribute(attributes, "lang")
        elif name == "a" and not slash and (link := attribute(attributes, "href")) is not None:
            links.append(_one_line(link.strip()))
    text = "\n".join(x for x in (" ".join(entities.unescape(line).split()) for line in "".join(out).split("\n")) if x)
    return text, lang, None if title is None else " ".join(entities.unescape(title).split()), links


def plain_text(page: str) -> str:
    return read_page(page)[0]


def declared_language(page: str) -> str | None:
    """The language of the first `html` element, lower-case."""
    for _, slash, name, attributes in pieces(page):
        if name == "html" and not slash:
            lang = attribute(attributes, "lang")
            return lang.strip().lower() if lang and lang.strip() else None
    return None


def _one_line(value: str) -> str:
    return " ".join(re.split(r"[\r\n]+", value))


def metadata(read: tuple, body: bytes, headers: str) -> str:
    fields = [("source-header", h) for h in re.split(r"[\r\n]+", headers) if h] + [("source-payload-digest", digest(body)), ("source-payload-length", str(len(body)))]
    if read[1]:
        fields.append(("declared-language", _one_line(read[1]).lower()))
    if read[2] is not None:
        fields.append(("title", read[2]))
    fields += [("outlink", link) for link in read[3]]
    return "".join(f"{k}: {v}\r\n" for k, v in fields)


def derive(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date_col: str | None = None, headers_col: str | None = None, record_col: str | None = None) -> DataFrame:
    """Two rows a page: page_id, warc_type, record_id, refers_to, target_uri, content_type,
    content_length, block_digest, payload_digest (of the response), header (the record's lines) and block.

    date_col: dates as they stand in WARC-Date; headers_col: the response's header lines;
    record_col: the response's WARC-Record-ID.
    """
    given = lambda c: F.col(c).cast("string") if c else F.lit(None).cast("string")
    source = pages.select(F.col(id_col).alias("page_id"), given(url_col).alias("url"), given(html_col).alias("html"), given(date_col).alias("date"), F.coalesce(given(headers_col), F.lit("")).alias("headers"), given(record_col).alias("record"))
    names = ["warc_type", "record_id", "refers_to", "target_uri", "content_type", "content_length", "block_digest", "payload_digest", "header", "block"]

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for page_id, url, page, date, headers, record in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page = page or ""
                body, read = page.encode("utf-8", "replace"), read_page(page)
                response = _one_line(record) if record else record_id(f"{'' if page_id is None else page_id} {url or ''}", "response")
                for kind, content, block in (("metadata", "application/warc-fields", metadata(read, body, headers)), ("conversion", "text/plain; charset=utf-8", read[0])):
                    raw = block.encode("utf-8", "replace")
                    rid, block_digest, payload = record_id(response, kind), digest(raw), digest(body)
                    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Date: {_one_line(date or EPOCH)}", f"WARC-Refers-To: {response}"]
                    head += [f"WARC-Target-URI: {_one_line(url)}", f"WARC-Refers-To-Target-URI: {_one_line(url)}"] if url else []
                    head += [f"WARC-Refers-To-Date: {_one_line(date)}"] if date else []
                    head += [f"WARC-Source-Payload-Digest: {payload}", f"WARC-Block-Digest: {block_digest}", f"Content-Type: {content}", f"Content-Length: {len(raw)}"]
                    ids.append(page_id)
                    out.append((kind, rid, response, url, content, len(raw), block_digest, payload, "\r\n".join(head), block))
            types = [pa.int64() if n == "content_length" else pa.string() for n in names]
            columns = zip(*out, strict=True) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["page_id", *names])

    kind = source.schema["page_id"].dataType.simpleString()
    return source.mapInArrow(records, f"page_id {kind}, " + ", ".join(f"{n} {'long' if n == 'content_length' else 'string'}" for n in names))


def write(records: DataFrame, path: str) -> None:
    """WARC files, each record a gzip member: header, empty line, block, then the two line ends that close a record.

    A member's last byte is the highest of its size, 0 below 16 MiB: it is taken off
    and comes back as the writer's line separator.  A larger record takes more members.
    """

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [x[i : i + (1 << 23)] for x in batch.column(0).to_pylist() for i in range(0, len(x), 1 << 23)]
            yield pa.RecordBatch.from_arrays([pa.array([gzip.compress(x, 6, mtime=0)[:-1] for x in raw], pa.binary())], ["member"])

    record = F.concat("header", F.lit("\r\n\r\n"), "block", F.lit("\r\n\r\n")).cast("binary")
    made = records.select(record.alias("record")).mapInArrow(members, "member binary")
    made.select(F.col("member").cast("string").alias("member")).write.option("lineSep", "\0").text(path)
