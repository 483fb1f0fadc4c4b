"""WARC derivatives: response records become linked metadata and plain-text conversion records.

A response record (WARC/1.1: named fields, an empty line, a block that is an HTTP message) gives two records:

* metadata (application/warc-fields): title, language, the HTTP status and source headers, outlinks;
* conversion (text/plain): the page's text without markup, scripts and styles.

Both refer to the response by WARC-Refers-To and keep its target URI, date and payload digest (as the field
WARC-Source-Payload-Digest); each has a block digest of its own. Record ids are made from the response's id, the type
and the block, so a task that runs again makes the same records. One pass over the rows, no shuffle; a page is read by one
scan, in time linear in its length, whatever its markup.

Defined results: a null record, one without a WARC version line or that isn't a response gives no derivatives; missing
fields are left out, a missing record id gives derivatives without WARC-Refers-To; an empty payload gives an empty
conversion; chunked, gzip and deflate payloads are decoded first (digests are of the payload as it is), others read as they
are; broken markup is read to the next tag or to the end; repeated rows give repeated records; extra columns are
not read. Files are read and written by `read` and `write`. In `responses` a null url gives no WARC-Target-URI, and a null page is an empty one.
"""

from __future__ import annotations

import hashlib
import html
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices

VERSION = "WARC/1.1"
_SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "warc:derivative")
#: Elements whose content is no text, and those that end a line of it.
_GONE = frozenset("script style noscript template svg".split())
_LINES = frozenset(
    "address article aside blockquote body br dd div dl dt figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section "
    "table tbody td tfoot th thead title tr ul".split()
)
_OPEN = re.compile(r"<(?:!--|[!?]|(/?[A-Za-z][A-Za-z0-9:-]*))")
_EDGE = re.compile("[<>]")
_ATTRIBUTE = re.compile(r"""([^\s=<>"'/]+)(?:\s*(=)\s*(?:"([^"]*)"|'([^']*)'|([^\s"'<>]+))?)?""")
#: Character references whose number no character has; Python's own reader takes no number of very many digits.
_ZEROS, _BEYOND = re.compile(r"&#([xX]?)0{5,}"), re.compile(r"&#(?:[xX]0*[1-9a-fA-F][0-9a-fA-F]{6,}|0*[1-9][0-9]{7,});?")
_CHUNK = re.compile(rb"([0-9A-Fa-f]{1,15})[^\r\n]*\r\n")
_CHARSET = re.compile(r"charset\s*=\s*[\"']?([\w-]+)", re.I)


def digest(block: bytes) -> str:
    return "sha256:" + hashlib.sha256(block).hexdigest()


def record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    """A record's bytes; fields whose value is None are left out, the block's length is added."""
    lines = [VERSION] + [f"{k}: {v}" for k, v in fields if v is not None] + [f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes] | None:
    """Named fields (lower-case names; a continuation line goes to the field before it) and the block."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not lines[0].startswith("WARC/"):
        return None
    fields, name = {}, ""
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            fields[name] = value.strip()
    length = fields.get("content-length", "")
    return fields, rest[: int(length)] if length.isdigit() else rest


def http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, headers and payload of an HTTP message; a block without a status line is all payload."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not block.startswith(b"HTTP/") or not gap:
        return "", [], block
    status, *lines = head.decode("utf-8", "replace").split("\r\n")
    return status, [(k.strip(), v.strip()) for k, _, v in (line.partition(":") for line in lines)], payload


def markup(page: str) -> Iterator[tuple[str, str]]:
    """A page's parts in order: ("", text) or (a tag's name, after / if it closes, and what stands in the tag). Comments,
    declarations and elements without text are left out. One scan: what isn't found up to the end isn't looked for again."""
    at, n, none = 0, len(page), set()

    def find(what: str, start: int) -> int:
        k = -1 if what in none else page.find(what, start)
        if k < 0:
            none.add(what)
        return k

    def after(name: str, start: int) -> int:
        """The place behind the end tag of an element without text, or the page's end."""
        found = None if name in none else re.compile(f"</{name}\\s*>", re.I).search(page, start)
        if not found:
            none.add(name)
        return found.end() if found else n

    while m := _OPEN.search(page, at):
        yield "", page[at : m.start()]
        name = (m[1] or "").lower()
        if not name:
            comment = m[0] == "<!--"
            k = find("-->" if comment else ">", m.end())
            if k < 0 and not comment:
                yield "", m[0]
            at = m.end() if k < 0 and not comment else n if k < 0 else k + len("-->" if comment else ">")
            continue
        if name in _GONE and (k := find(">", m.end())) >= 0:
            at = after(name, k + 1)
            continue
        edge = None if "edge" in none else _EDGE.search(page, m.end())
        if not edge:
            none.add("edge")
        if edge and edge[0] == ">":
            yield name, page[m.end() : edge.start()]
            at = edge.end()
        else:
            at = edge.start() if edge else n
            yield "", page[m.start() : at]
    yield "", page[at:]


def attribute(tag: str, name: str) -> str | None:
    """The value of a tag's first attribute of a name, also one in a namespace."""
    for m in _ATTRIBUTE.finditer(tag):
        if m[2] and m[1].lower().rpartition(":")[2] == name:
            return m[3] or m[4] or m[5] or ""
    return None


def unescaped(text: str) -> str:
    return html.unescape(_BEYOND.sub("\ufffd", _ZEROS.sub(r"&#\g<1>0", text)))


def lines_of(parts: list[tuple[str, str]]) -> str:
    """The text of a page's parts: a line for each block of it, white space in lines drawn together, no empty lines."""
    text = unescaped("".join(("\n" if name.lstrip("/") in _LINES else "") if name else x for name, x in parts))
    lines = (" ".join(line.split()) for line in text.split("\n"))
    return "\n".join(line for line in lines if line)


def text_of(page: str) -> str:
    return lines_of(list(markup(page)))


def title_of(parts: list[tuple[str, str]]) -> str | None:
    """What the first title says; one that nothing closes is none."""
    said, inside = [], False
    for name, x in parts:
        if inside and name == "/title":
            return " ".join(unescaped("".join(said)).split())
        if name == "title":
            inside = True
        elif inside and not name:
            said.append(x)
    return None


def _unchunked(payload: bytes) -> bytes:
    """The chunks of a payload together; what isn't chunked stays as it is."""
    out, at = [], 0
    while m := _CHUNK.match(payload, at):
        size = int(m[1], 16)
        if not size:
            return b"".join(out)
        out.append(payload[m.end() : m.end() + size])
        at = m.end() + size + 2
    return b"".join(out) if out else payload


def _inflated(payload: bytes) -> bytes:
    """A gzip or deflate payload as far as it can be read; anything else stays as it is."""
    for bits in (47, -15):
        reader, out, rest = zlib.decompressobj(bits), [], payload
        try:
            while rest:
                out.append(reader.decompress(rest))
                if not reader.eof:
                    break
                rest = reader.unused_data  # a further member
                reader = zlib.decompressobj(bits)
        except zlib.error:
            pass
        if any(out):
            return b"".join(out)
    return payload


def body(headers: list[tuple[str, str]], payload: bytes) -> bytes:
    """The payload without its transfer and content encodings (chunked, gzip, deflate; others are left)."""
    named = lambda name: [x.strip().lower() for k, v in headers if k.lower() == name for x in v.split(",")]
    if "chunked" in named("transfer-encoding"):
        payload = _unchunked(payload)
    for coding in reversed(named("content-encoding")):
        if coding in ("gzip", "x-gzip", "deflate"):
            payload = _inflated(payload)
    return payload


def _decoded(payload: bytes, kind: str) -> str:
    named = _CHARSET.search(kind)
    try:
        return payload.decode(named[1] if named else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def derivatives(data: bytes) -> list[tuple[str, str, str | None, str | None, str | None, bytes, bytes]]:
    """(type, record id, refers to, target URI, source payload digest, block, record) of each derivative."""
    parsed = parse(data)
    if not parsed or parsed[0].get("warc-type") != "response":
        return []
    fields, block = parsed
    status, headers, payload = http(block)
    kind = next((v for k, v in headers if k.lower() == "content-type"), "")
    parts = list(markup(_decoded(body(headers, payload), kind)))
    source = fields.get("warc-payload-digest") or digest(payload)
    refers, target = fields.get("warc-record-id"), fields.get("warc-target-uri")
    title, lang = title_of(parts), next((x for name, tag in parts if name == "html" and (x := attribute(tag, "lang"))), "")
    about = [("http-status", status)] if status else []
    about += [(f"source-{k.lower()}", v) for k, v in headers]
    if title is not None:
        about.append(("title", title))
    if lang := re.match("[A-Za-z0-9-]*", lang)[0]:
        about.append(("language", lang))
    links = (attribute(tag, "href") for name, tag in parts if name == "a")
    for link in dict.fromkeys(x for x in links if x is not None):
        about.append(("outlink", _absolute(target, unescaped(link).strip())))
    out = []
    for name, mime, content in (
        ("metadata", "application/warc-fields", "".join(f"{k}: {' '.join(v.split())}\r\n" for k, v in about).encode("utf-8", "replace")),
        ("conversion", "text/plain; charset=utf-8", lines_of(parts).encode("utf-8", "replace")),
    ):
        made = f"<urn:uuid:{uuid.uuid5(_SPACE, f'{refers} {name} {digest(content)}')}>"
        head = [
            ("WARC-Type", name), ("WARC-Record-ID", made), ("WARC-Date", fields.get("warc-date")), ("WARC-Target-URI", target),
            ("WARC-Refers-To", refers), ("WARC-Source-Payload-Digest", source), ("WARC-Block-Digest", digest(content)), ("Content-Type", mime),
        ]
        out.append((name, made, refers, target, source, content, record(head, content)))
    return out


def _absolute(base: str | None, link: str) -> str:
    try:
        return urljoin(base or "", link)
    except ValueError:
        return link


def responses(pages: DataFrame, id_col="page_id", url_col="url", html_col="html", date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(page_id, record): raw pages as response records, for tables that hold no WARC records."""

    def one(page_id, url: str | None, page: str | None) -> bytes:
        payload = (page or "").encode()
        head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        name = f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id} {url}')}>"
        block = head + payload
        fields = [("WARC-Type", "response"), ("WARC-Record-ID", name), ("WARC-Date", date), ("WARC-Target-URI", url and " ".join(url.split()))]
        fields += [("WARC-Payload-Digest", digest(payload)), ("WARC-Block-Digest", digest(block)), ("Content-Type", "application/http; msgtype=response")]
        return record(fields, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "html", 8 << 20):
                made = map(one, *(batch.column(c).to_pylist() for c in ("page_id", "url", "html")))
                yield pa.RecordBatch.from_arrays([batch.column("page_id"), pa.array(made, pa.binary())], names=["page_id", "record"])

    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id bigint, record binary")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record, whole) of the WARC files at a path, of any version, plain or compressed as a whole, by Spark's own
    reader. Files are cut where a record's end meets a version line, and put together again as far as Content-Length
    says, so a block may hold these bytes. `whole` is false if a record has not what its Content-Length says: it is cut
    short, or it has no such field, or such a block lies across two splits of a plain file. page_id numbers the records
    of one read."""
    value = F.col("value").cast("binary")
    pieces = spark.read.text(path, lineSep=_BETWEEN.decode()).select(F.monotonically_increasing_id().alias("page_id"), value.alias("record"))
    start = b"WARC/"

    def lacking(data: bytes) -> int:
        """Bytes that a record has less than its Content-Length says; -1 without that field."""
        head, gap, rest = data.partition(b"\r\n\r\n")
        length = _LENGTH.search(head) if gap else None
        return int(length[1]) - len(rest) if length else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_id, parts, left = None, [], 0  # a record that may go on in the next piece

        def give(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.bool_()), strict=True)], names=["page_id", "record", "whole"])

        def closed() -> tuple:
            data = b"".join(parts)
            short = lacking(data)
            # after a file's last record its closing line ends may stand
            return open_id, data, short == 0 or short < 0 and data.endswith(b"\r\n") and _exact(data)

        for batch in batches:
            rows = []
            for k, piece in zip(batch.column("page_id").to_pylist(), batch.column("record"), strict=True):
                piece = piece.as_py()
                if parts and left > 0:
                    parts += [_BETWEEN, piece]
                    left -= len(_BETWEEN) + len(piece)
                else:
                    if parts:
                        rows.append(closed())
                    open_id, parts = k, [piece if piece.startswith(start) else start + piece]
                    left = lacking(parts[0])
            if rows:
                yield give(rows)
        if parts:
            yield give([closed()])

    return pieces.mapInArrow(run, "page_id bigint, record binary, whole boolean")


_BETWEEN = b"\r\n\r\nWARC/"
_LENGTH = re.compile(rb"(?i)\r\ncontent-length[ \t]*:[ \t]*(\d{1,18})[ \t]*(?=\r\n|\Z)")


def _exact(data: bytes) -> bool:
    """Whether nothing but line ends follows a record's block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    length = _LENGTH.search(head)
    return bool(length) and len(rest) >= int(length[1]) and not rest[int(length[1]) :].strip(b"\r\n")


def write(derived: DataFrame, path: str, compression: str | None = None, record_col="record") -> None:
    """The records as WARC files, one for each partition, by Spark's own writer. They must be UTF-8, as derivatives are."""
    # a record ends in a line feed, which the writer puts after each row
    text = F.expr(f"cast(substr({record_col}, 1, octet_length({record_col}) - 1) as string)")
    derived.select(text.alias("value")).write.text(path, compression=compression, lineSep="\n")


def derive(records: DataFrame, id_col="page_id", record_col="record") -> DataFrame:
    """Two rows for each response: page_id, warc_type, record_id, refers_to, target_uri, source_digest, block, record."""
    names = ["page_id", "warc_type", "record_id", "refers_to", "target_uri", "source_digest", "block", "record"]
    kinds = [pa.int64()] + [pa.string()] * 5 + [pa.binary()] * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "record", 8 << 20):
                rows = [(i, *d) for i, r in zip(batch.column("id").to_pylist(), batch.column("record"), strict=True) for d in derivatives(r.as_py() or b"")]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    schema = "page_id bigint, warc_type string, record_id string, refers_to string, target_uri string, source_digest string, block binary, record binary"
    return records.select(F.col(id_col).cast("bigint").alias("id"), F.col(record_col).alias("record")).mapInArrow(run, schema)


def report(derived: DataFrame) -> DataFrame:
    """The derived records with their content's length and digests in place of the bytes."""
    return derived.select(
        "page_id", "warc_type", "record_id", "refers_to", "target_uri", "source_digest", F.octet_length("block").cast("bigint").alias("content_length"),
        F.concat(F.lit("sha256:"), F.sha2("block", 256)).alias("block_digest"), F.sha2("record", 256).alias("record_sha256"),
    )
