"""WARC derivatives: metadata and plain-text conversion records made from response records.

A record is a row: headers (map in the order of ``FIELDS``) and a block of bytes. ``derive`` makes of every
response a metadata record (application/warc-fields: title, status, source HTTP headers, outlinks) and a
conversion record (text/plain), both linked by WARC-Refers-To with the response's identifier and date, with its
target URI, and with the digests of the source beside their own. Identifiers are UUIDs of the response's
identifier and the kind, so a task that runs again makes the same records. ``parse`` and ``serialize`` read and
write the WARC 1.1 format, gzip members included.

A null or empty response block gives empty text and no outlinks; a missing header is left out, not invented; payloads
are decoded as their headers say (chunks, gzip, deflate, charset); repeated rows give repeated records; a key that is
no number becomes null; records that are no response are passed over; other columns are ignored;
an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import map_columns, small_batches
from sparkloom.llm.html_extract import BLOCKS

VERSION = b"WARC/1.1"
SCHEMA = "page_id long, kind string, record_id string, refers_to string, target_uri string, date string, source_block_digest string, source_payload_digest string, block_digest string, content_length long, headers map<string,string>, content string"
_SPACE = uuid.UUID("6f0f4c0e-2a3b-5a77-9d7c-0c6a8b1f2e55")
_HIDDEN = re.compile(r"(?i)<(?:(!--)|(script|style|noscript|template|head)\b)")
_CHARSET = re.compile(r"""(?i)charset\s*=\s*["']?\s*([\w.:-]+)""")
#: Bytes of a page in which its charset may be declared.
DECLARED = 2048
_BREAK = re.compile(rf"(?i)</?(?:br|{'|'.join(sorted(BLOCKS))})\b[^>]*>")
_TAG = re.compile(r"<[!?/a-zA-Z][^>]*>")
_TITLE = re.compile(r"(?is)<title\b[^>]*>(.*?)</title")
_LINK = re.compile(r"""(?i)<a\s[^>]*?\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, chr(0).join(parts))}>"


def _shown(html: str) -> str:
    """html without comments, scripts, styles and the head; one whose end is missing stays, and its end is looked for once."""
    low = html.lower()
    if len(low) != len(html):
        low = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), html)
    out, at, kept, missing = [], 0, 0, set()
    while m := _HIDDEN.search(html, at):
        mark = "-->" if m[1] else f"</{m[2].lower()}"
        end = -1 if mark in missing else low.find(mark, m.end())
        close = end + 3 if m[1] else html.find(">", end) + 1
        if end < 0 or not close:
            missing.add(mark)
            at = m.end()
            continue
        out += [html[kept : m.start()], " "]
        at = kept = close
    return "".join([*out, html[kept:]])


def plain_text(html: str) -> str:
    """Text of a page, a line for each block; line ends of the source are blanks."""
    text = _TAG.sub("", _BREAK.sub("\n", " ".join(_shown(html).split())))
    lines = (" ".join((unescape(x) if "&" in x else x).split()) for x in text.split("\n"))
    return "\n".join(x for x in lines if x)


def _unchunked(body: bytes) -> bytes:
    """The chunks of a chunked body; what does not follow that form ends it."""
    out, at = [], 0
    while (line := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:line].split(b";")[0].strip() or b"x", 16)
        except ValueError:
            break
        if not size:
            break
        out.append(body[line + 2 : line + 2 + size])
        at = line + 4 + size
    return b"".join(out)


def _inflated(body: bytes, kind: int) -> bytes:
    """As much as can be inflated of a damaged stream."""
    unpacker, out = zlib.decompressobj(kind), []
    for at in range(0, len(body), 1 << 16):
        try:
            out.append(unpacker.decompress(body[at : at + (1 << 16)]))
        except zlib.error:
            break
    return b"".join(out)


def decoded(fields: list[tuple[str, str]], payload: bytes) -> str:
    """Text of an HTTP payload: transfer and content encoding undone (gzip and deflate), letters by the charset of the
    header or the page, UTF-8 by default. Encodings that are not known stay; bytes that are no letters become U+FFFD."""
    named = {k.lower(): v.lower() for k, v in fields}
    if "chunked" in named.get("transfer-encoding", ""):
        payload = _unchunked(payload) or payload
    for kind in reversed(named.get("content-encoding", "").split(",")):
        if kind.strip() in ("gzip", "x-gzip"):
            payload = _inflated(payload, 31) or payload
        elif kind.strip() == "deflate":
            payload = _inflated(payload, 15) or _inflated(payload, -15) or payload
    found = _CHARSET.search(named.get("content-type", "")) or _CHARSET.search(payload[:DECLARED].decode("latin-1"))
    charset = found[1].lower() if found else "utf-8"
    charset = {"iso-8859-1": "cp1252", "latin1": "cp1252", "us-ascii": "cp1252", "ascii": "cp1252"}.get(charset, charset)
    try:
        return payload.decode(charset, "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def http_parts(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """(status, headers, payload) of an HTTP response; a block without a status line is all payload."""
    head, found, payload = block.partition(b"\r\n\r\n")
    if not found or not head.startswith(b"HTTP/"):
        return "", [], block
    first, *rest = head.decode("utf-8", "replace").split("\r\n")
    pairs = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in rest)]
    return first.split(" ")[1] if " " in first else "", pairs, payload


def response_of(url: str | None, html: str | None, key: object, date: str) -> tuple[dict[str, str], bytes]:
    """The response record of a crawled page."""
    payload = (html or "").encode("utf-8", "replace")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    headers = {"WARC-Type": "response", "WARC-Record-ID": record_id("response", str(key), url or "", digest(block)), "WARC-Date": date}
    if url:
        headers["WARC-Target-URI"] = url
    headers |= {"Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": digest(payload), "WARC-Block-Digest": digest(block), "Content-Length": str(len(block))}
    return headers, block


def derived(headers: dict[str, str], block: bytes | None) -> list[tuple[dict[str, str], bytes]]:
    """The metadata and the conversion record of one response."""
    block = block or b""
    source = headers.get("WARC-Record-ID", "")
    status, fields, payload = http_parts(block)
    html = decoded(fields, payload)
    title = _TITLE.search(html)
    lines = [f"via-record: {source}"]
    if title and title[1].strip():
        lines.append("title: " + " ".join(unescape(title[1]).split()))
    if status:
        lines.append(f"http-status: {status}")
    lines += [f"http-header: {k}: {v}" for k, v in fields]
    lines += ["outlink: " + "".join(unescape(a or b or c).split()) for a, b, c in _LINK.findall(html)]
    bodies = {"metadata": ("application/warc-fields", "".join(x + "\r\n" for x in lines)), "conversion": ("text/plain; charset=utf-8", plain_text(html))}
    out = []
    for kind, (media, text) in bodies.items():
        body = text.encode("utf-8", "replace")
        own = {"WARC-Type": kind, "WARC-Record-ID": record_id(kind, source), "WARC-Refers-To": source}
        for name in ("WARC-Date", "WARC-Target-URI", "WARC-IP-Address", "WARC-Warcinfo-ID", "WARC-Identified-Payload-Type"):
            if name in headers:
                own[name] = headers[name]
        if "WARC-Target-URI" in headers:
            own["WARC-Refers-To-Target-URI"] = headers["WARC-Target-URI"]
        if "WARC-Date" in headers:
            own["WARC-Refers-To-Date"] = headers["WARC-Date"]
        own["WARC-Source-Block-Digest"] = headers.get("WARC-Block-Digest") or digest(block)
        own["WARC-Source-Payload-Digest"] = headers.get("WARC-Payload-Digest") or digest(payload)
        own |= {"Content-Type": media, "WARC-Block-Digest": digest(body), "Content-Length": str(len(body))}
        out.append((own, body))
    return out


def serialize(headers: dict[str, str], block: bytes, compress: bool = False) -> bytes:
    data = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers.items()) + b"\r\n" + block + b"\r\n\r\n"
    if not compress:
        return data
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _plain(data: bytes) -> bytes:
    """Gzip members inflated one by one; a damaged member gives what can be read of it, and the next one is looked for."""
    out = []
    while data[:2] == b"\x1f\x8b":
        unpacker = zlib.decompressobj(31)
        try:
            out.append(unpacker.decompress(data) + unpacker.flush())
            data = unpacker.unused_data
        except zlib.error:
            out.append(_inflated(data, 31))
            after = data.find(b"\x1f\x8b\x08", 3)
            data = data[after:] if after > 0 else b""
    return b"".join(out) + data


def _headers(head: bytes) -> dict[str, str]:
    """Header fields of a record; the values of a repeated name are joined by a line feed."""
    out: dict[str, str] = {}
    for line in head.decode("utf-8", "replace").split("\r\n"):
        k, colon, v = line.partition(":")
        if colon:
            k, v = k.strip(), v.strip()
            out[k] = f"{out[k]}\n{v}" if k in out else v
    return out


def _record(data: bytes, at: int) -> tuple[dict[str, str], int, int] | None:
    """(headers, start, end of the block) of the record at a place; None if its head is cut off or gives no length."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return None
    headers = _headers(data[at:end])
    size = headers.get("Content-Length", "")
    return (headers, end + 4, end + 4 + int(size)) if size.isdigit() else None


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Every record of a WARC file, gzip members or plain. A record whose head is damaged is passed over; one whose block
    is cut off is given with the field WARC-Truncated, so that it is not taken for whole."""
    data, at = _plain(data), 0
    while (at := data.find(b"WARC/", at)) >= 0:
        found = _record(data, at)
        if found is None:
            at += 5
            continue
        headers, start, end = found
        if end > len(data):
            headers = {**headers, "WARC-Truncated": headers.get("WARC-Truncated", "unspecified")}
        yield headers, data[start:end]
        at = end


#: What begins a record; Spark's reader cuts files there.
_MARK = b"WARC/1."
_HEADS = "headers map<string,string>, block binary"


def _claimed(data: bytes) -> tuple[dict[str, str], int, int] | None:
    found = _record(data, 0)
    return found if found and "WARC-Type" in found[0] else None


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """headers and block of every record of the files at path, as a stream: Spark cuts the files (gzip members inflated
    by its reader) at the mark that begins a record, and a task holds one record at a time. A mark inside a block does
    not end it, as the block's length says, also where Spark splits a plain file inside that block: a first pass
    lists the marks and the lengths that stand behind them, and the marks of each file, read in order, tell how many
    pieces at the start of a split still belong to a record that began before it. Such pieces and the beginning of their
    record, one record a split at most, are put together by themselves. The table of such splits is broadcast: a row for
    each split that begins inside a record with marks in its block. A record that its file cuts off is given with
    WARC-Truncated; a mark inside a head makes no record of it."""
    pieces = spark.read.option("lineSep", _MARK.decode()).text(path)
    pieces = pieces.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    small_batches(spark)
    again = F.broadcast(_continued(pieces))
    cut = pieces.join(again, ["file", "start"], "left").select("value", "file", "start", F.coalesce("skip", F.lit(0)).alias("skip"))
    read = cut.mapInArrow(_read, f"{_HEADS}, file string, start long, place int, part binary")
    begun = F.max(F.when(F.col("place") < 0, F.col("start"))).over(Window.partitionBy("file").orderBy("start", F.expr("if(place < 0, 2147483647, place)")))
    parts = read.where("part is not null").withColumn("record", F.when(F.col("place") < 0, F.col("start")).otherwise(begun))
    joined = parts.groupBy("file", "record").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "place", "part"))), lambda p: p["part"]).alias("parts"))  # one record
    return read.where("part is null").select("headers", "block").unionByName(joined.select("parts").mapInArrow(_joined, _HEADS))


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


_FOUND = pa.schema([("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])


def _continued(pieces: DataFrame) -> DataFrame:
    """file, start, skip: how many pieces at the start of a split belong to the record before it."""
    listed = pa.schema([("file", pa.string()), ("start", pa.int64()), ("place", pa.int64()), ("size", pa.int64()), ("claim", pa.int64())])
    counted = pa.schema([("file", pa.string()), ("start", pa.int64()), ("skip", pa.int32())])

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, place = None, 0
        for batch in batches:
            rows = []
            for piece, file, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                place = place + 1 if (file, start) == at else 0
                at = file, start
                found = _claimed(_MARK + piece)
                rows.append((file, start, place, len(piece) + len(_MARK), found[2] if found else None))
            if rows:
                yield _arrow(rows, listed)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, left, begun, skip = None, 0, None, 0
        for batch in batches:
            rows = []
            for file, start, _, size, claim in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (file, start) != at:
                    if skip:
                        rows.append((*at, skip))
                    left, begun = (left, begun) if at and file == at[0] else (0, None)
                    at, skip = (file, start), 0
                if left > 0:
                    skip += begun != start
                    left -= size
                elif claim is not None:
                    left, begun = claim - size, start
            if rows:
                yield _arrow(rows, counted)
        if skip:
            yield _arrow([(*at, skip)], counted)

    plain = pieces.where(~F.col("file").rlike(r"(?i)\.(gz|bz2|zst|xz)$"))
    index = plain.mapInArrow(marks, "file string, start long, place long, size long, claim long")
    return index.repartition("file").sortWithinPartitions("file", "start", "place").mapInArrow(chain, "file string, start long, skip int")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole records, and the parts of those that go on in another split: place counts the pieces at the start of a split, the
    beginning of a record at its end has place -1."""
    schema = pa.schema([*_FOUND, ("file", pa.string()), ("start", pa.int64()), ("place", pa.int32()), ("part", pa.binary())])
    held, at, place = b"", None, 0
    for batch in batches:
        for piece, file, start, skip in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (file, start) != at:
                if held and _claimed(held):
                    yield _arrow([(None, None, *at, -1, held)], schema)
                held, at, place = b"", (file, start), 0
            if place < skip:
                yield _arrow([(None, None, *at, place, _MARK + piece)], schema)
                place += 1
                continue
            held += _MARK + piece
            found = _claimed(held)
            if found is None:
                held = b""  # no record begins here
            elif len(held) >= found[2]:
                yield _arrow([(list(found[0].items()), held[found[1] : found[2]], *at, 0, None)], schema)
                held = b""
    if held and _claimed(held):
        yield _arrow([(None, None, *at, -1, held)], schema)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for parts in batch.column(0).to_pylist():
            data = b"".join(parts)
            if found := _claimed(data):
                headers, start, end = found
                more = {} if len(data) >= end else {"WARC-Truncated": headers.get("WARC-Truncated", "unspecified")}
                yield _arrow([(list((headers | more).items()), data[start:end])], _FOUND)


def pages_to_responses(df: DataFrame, date: str = "2024-01-01T00:00:00Z", html: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """Response records of crawled pages: page_id, headers, block."""

    def make() -> Callable[..., Iterator[tuple]]:
        return lambda keys, urls, pages: ((k, *response_of(u, h, k, date)) for k, u, h in zip(keys, urls, pages, strict=True))

    return map_columns(df, [F.col(key).try_cast("long"), F.col(url), F.col(html)], "page_id long, headers map<string,string>, block binary", make)


def derive(records: DataFrame, key: str = "page_id") -> DataFrame:
    """A metadata and a conversion record for every response among the records."""

    def make() -> Callable[..., Iterator[tuple]]:
        def work(keys: list, heads: list, blocks: list) -> Iterator[tuple]:
            for k, pairs, block in zip(keys, heads, blocks, strict=True):
                headers = dict(pairs or [])
                if headers.get("WARC-Type") != "response":
                    continue
                for own, body in derived(headers, block):
                    yield k, own["WARC-Type"], own["WARC-Record-ID"], own["WARC-Refers-To"], own.get("WARC-Target-URI"), own.get("WARC-Date"), own["WARC-Source-Block-Digest"], own["WARC-Source-Payload-Digest"], own["WARC-Block-Digest"], len(body), list(own.items()), body.decode()

        return work

    return map_columns(records, [F.col(key).try_cast("long") if key in records.columns else F.lit(None).cast("long"), F.col("headers"), F.col("block")], SCHEMA, make)
