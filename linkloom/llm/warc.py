"""Derivatives of WARC responses: linked metadata and plain-text conversions.

Every response gives one metadata record (its source headers, title and
outgoing links as warc-fields) and one conversion record (its text). Both name
the response in WARC-Refers-To and carry digests of their own block; the
payload's digest and the source's WARC and HTTP headers are preserved.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html as entities
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "WARC/1.1"
#: Elements whose content is no text, and elements that break a line (fixed values of HTML).
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "title")
BREAKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Of the first, those that a slash at the end of their tag closes: foreign elements.
SELF_CLOSING = frozenset(["svg"])
_NAME = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)")
# a tag's end and its attributes; a capturing group within a possessive one is beyond the re module
_TAG = re.compile(r"""(?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*'|[^\s>]*+))*+>""")
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:("[^"]*")|('[^']*')|([^\s>]*)))?""")
_ENDS = {name: re.compile(rf"(?i)</{name}\s*>") for name in RAW}


def _tag_end(page: str, at: int) -> int:
    """Place behind the tag that starts at ``at``; a ``>`` within a quoted value does not end it.

    A quote opens a value only behind ``=``, as in HTML; one that is never closed is an ordinary character.
    """
    tag = _TAG.match(page, at)
    return tag.end() if tag else len(page)


def _href(page: str, at: int, end: int) -> str | None:
    """The first href of a tag whose attributes lie from ``at`` to ``end``."""
    for name, double, single, bare in _ATTRIBUTE.findall(page, at, end):
        if name.lower() == "href" and not (bare and bare[0] in "\"'"):
            return double[1:-1] or single[1:-1] or bare if double or single or bare else None
    return None


def extract(page: str) -> tuple[str, str, list[str]]:
    """(title, text, links) of an HTML page, in one pass over it."""
    parts: list[str] = []
    links: list[str] = []
    title, at = "", 0
    while (start := page.find("<", at)) >= 0:
        parts.append(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = len(page) if end < 0 else end + 3
            continue
        name = _NAME.match(page, start)
        if not name:
            if page.startswith(("<!", "<?", "</"), start):
                at = _tag_end(page, start)
            else:
                parts.append("<")
                at = start + 1
            continue
        at, kind = _tag_end(page, start), name[2].lower()
        if not name[1]:
            if kind in _ENDS and not (kind in SELF_CLOSING and page[at - 2 : at] == "/>"):
                end = _ENDS[kind].search(page, at)
                if kind == "title" and not title:
                    title = " ".join(entities.unescape(page[at : end.start() if end else len(page)]).split())
                at = end.end() if end else len(page)
            elif kind == "a" and (href := _href(page, name.end(), at - 1)) is not None:
                links.append(entities.unescape(href))
        if kind in BREAKS:
            parts.append("\n")
    parts.append(page[at:])
    lines = (" ".join(line.split()) for line in entities.unescape("".join(parts)).split("\n"))
    return title, "\n".join(line for line in lines if line), links


def digest(block: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()


def record_id(kind: str, uri: str, payload_digest: str) -> str:
    """A record id that is the same in every run."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {uri} {payload_digest}')}>"


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A serialized WARC record; line breaks within header values become spaces."""
    lines = [VERSION, *(f"{k}: {' '.join(v.split())}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


#: Compressed bytes that are unpacked at once, and bytes of blocks that make a batch of responses.
STEP, BATCH_BYTES = 1 << 16, 16 << 20


def _plain_parts(data: bytes) -> Iterator[bytes]:
    """The content of gzip members one after the other, or ``data`` itself.

    A view moves over the compressed bytes, so time goes with their number, however many members there are.
    A damaged member ends the file after what was unpacked before.
    """
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    view, at = memoryview(data), 0
    while bytes(view[at : at + 2]) == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        while not member.eof and at < len(view):
            step = view[at : at + STEP]
            try:
                yield member.decompress(step)
            except zlib.error:
                return
            at += len(step) - len(member.unused_data)


class Headers(list):
    """(name, value) of each header in order, names in lower case, repeated ones too; a name looks up its first value."""

    def __getitem__(self, name):
        if isinstance(name, str):
            return next(v for k, v in self if k == name)
        return super().__getitem__(name)

    def get(self, name: str, default: str = "") -> str:
        return next((v for k, v in self if k == name), default)

    @classmethod
    def of(cls, head: str) -> Headers:
        """Of a record's head; a line that begins with white space goes on with the one before."""
        found = cls()
        for line in head.split("\r\n")[1:]:
            if line[:1] in (" ", "\t") and found:
                found[-1] = (found[-1][0], f"{found[-1][1]} {line.strip()}".strip())
            elif line:
                name, _, value = line.partition(":")
                found.append((name.strip().lower(), value.strip()))
        return found


def read_records(data: bytes) -> Iterator[tuple[Headers, bytes]]:
    """(headers in order, block) of each record, gzip members or plain.

    A record without a numeric Content-Length is passed over, a damaged gzip
    member ends the file, and of a truncated one the records that are whole
    and the rest of the last block are read. Of the unpacked file only the
    record at hand is held.
    """
    parts, held, at, ended = _plain_parts(data), bytearray(), 0, False

    def more() -> bool:
        nonlocal ended, at
        if at:
            del held[:at]
            at = 0
        part = next(parts, None)
        ended = part is None
        held.extend(part or b"")
        return not ended

    while True:
        while (start := held.find(b"WARC/", at)) < 0:
            at = max(at, len(held) - 4)
            if not more():
                return
        at = start
        seen = start
        while (stop := held.find(b"\r\n\r\n", max(seen, at))) < 0:
            seen = len(held) - 3 - at
            if not more():
                return
        headers = Headers.of(bytes(held[at:stop]).decode("utf-8", "replace"))
        size = headers.get("content-length")
        if not size.isdecimal():
            at = stop + 4
            continue
        at, need = stop + 4, int(size)
        while len(held) - at < need and more():
            pass
        yield headers, bytes(held[at : at + need])
        at = min(at + need, len(held))


def split_http(block: bytes) -> tuple[str, bytes]:
    """(status line and headers, payload) of a response block."""
    head, found, payload = block.partition(b"\r\n\r\n")
    return (head.decode("latin-1"), payload) if found else ("", block)


def body(http: str, payload: bytes) -> bytes:
    """The payload without chunks and compression; what cannot be undone stays as it is."""
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (line.partition(":") for line in http.split("\r\n")[1:])}
    plain = payload
    if "chunked" in fields.get("transfer-encoding", ""):
        parts, rest = [], plain
        while rest:
            size, found, rest = rest.partition(b"\r\n")
            try:
                n = int(size.split(b";")[0], 16)
            except ValueError:
                break
            if not found or n == 0:
                break
            parts.append(rest[:n])
            rest = rest[n + 2 :]
        plain = b"".join(parts) or plain
    if fields.get("content-encoding") in ("gzip", "x-gzip", "deflate"):
        try:
            plain = zlib.decompress(plain, 47)
        except zlib.error:
            pass
    return plain


def derive(response_id: str, uri: str, date: str, http: str, payload: bytes, source_headers: str = "") -> dict[str, object]:
    """Both derivatives of one response: ids, digests, sizes and record bytes.

    ``source_headers`` are the response record's own headers, one a line; they
    are kept in the metadata, and a payload digest among them is referred to as
    it stands there.
    """
    kind = next((line.partition(":")[2].strip() for line in http.split("\r\n") if line.lower().startswith("content-type:")), "text/html")
    charset = re.search(r"(?i)charset\s*=\s*[\"']?([\w.:-]+)", kind)
    try:
        page = body(http, payload).decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        page = body(http, payload).decode("utf-8", "replace")
    title, text, links = extract(page) if "html" in kind.lower() else ("", page, [])
    kept = [line for line in source_headers.split("\n") if line]
    source = next((line.partition(":")[2].strip() for line in kept if line.lower().startswith("warc-payload-digest:")), "") or digest(payload)
    shared = [("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Refers-To", response_id), ("WARC-Refers-To-Payload-Digest", source)]
    fields = [f"source-header: {line}" for line in kept] + [f"http-header: {line}" for line in http.split("\r\n") if line] + [f"title: {title}"] * bool(title) + [f"outlink: {' '.join(x.split())}" for x in links]
    blocks = {"metadata": ("application/warc-fields", "".join(f"{x}\r\n" for x in fields).encode()), "conversion": ("text/plain; charset=utf-8", text.encode("utf-8", "replace"))}
    out: dict[str, object] = {"response_id": response_id, "target_uri": uri, "payload_digest": source, "title": title, "n_links": len(links)}
    for name, (content_type, block) in blocks.items():
        own = record_id(name, uri, source)
        headers = [("WARC-Type", name), ("WARC-Record-ID", own), *shared, ("WARC-Block-Digest", digest(block)), ("Content-Type", content_type)]
        out |= {f"{name}_id": own, f"{name}_digest": digest(block), f"{name}_bytes": len(block), f"{name}_record": record(headers, block)}
    return out


FIELDS = {
    "response_id": "string",
    "target_uri": "string",
    "payload_digest": "string",
    "title": "string",
    "n_links": "bigint",
    "metadata_id": "string",
    "metadata_digest": "string",
    "metadata_bytes": "bigint",
    "metadata_record": "binary",
    "conversion_id": "string",
    "conversion_digest": "string",
    "conversion_bytes": "bigint",
    "conversion_record": "binary",
}


def responses_from_pages(pages: DataFrame, *, date: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Responses (key, uri, date, http, payload) of pages that were stored without headers."""
    http = F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8")
    return pages.select(F.col(id_col).alias("key"), F.coalesce(F.col(url_col), F.lit("")).alias("uri"), F.lit(date).alias("date"), http.alias("http"), F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"))


def responses_from_warc(spark: SparkSession, path: str) -> DataFrame:
    """Responses of WARC files (plain or one gzip member a record) with the records' own headers, one task a file.

    Other kinds of records are passed over; a file without responses, or an
    empty one, gives no rows; absent headers are empty, repeated records repeat.
    """

    def packed(rows):
        kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["key", "uri", "date", "http", "payload", "source"])

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for headers, block in read_records(content.as_py()):
                    if headers.get("warc-type") != "response":
                        continue
                    rows.append((*(headers.get(n) for n in ("warc-record-id", "warc-target-uri", "warc-date")), *split_http(block), "\n".join(f"{k}: {v}" for k, v in headers)))
                    size += len(block)
                    if size >= BATCH_BYTES:
                        yield packed(rows)
                        rows, size = [], 0
                yield packed(rows)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, "key string, uri string, date string, http string, payload binary, source string")


def derivatives(responses: DataFrame, *, with_records: bool = True) -> DataFrame:
    """Per response: key and FIELDS (record bytes only ``with_records``).

    A string key is the response's record id; for other keys the id is made
    of uri and payload digest, so equal responses share it. Rows stay where
    they are; a response without payload gives an empty conversion. Null uris
    count as empty, null keys and repeated rows are kept, an empty table gives
    an empty table.
    """
    key = responses.schema["key"].dataType.simpleString()
    names = [name for name, kind in FIELDS.items() if with_records or kind != "binary"]
    kinds = {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows = []
                for key_, uri, date, http, payload, source in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                    uri, payload = uri or "", payload or b""
                    own = key_ if isinstance(key_, str) and key_ else record_id("response", uri, digest(payload))
                    rows.append(derive(own, uri, date or "", http or "", payload, source or ""))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[n] for r in rows], kinds[FIELDS[n]]) for n in names)], names=["key", *names])

    schema = ", ".join([f"key {key}", *(f"{n} {FIELDS[n]}" for n in names)])
    source = F.col("source") if "source" in responses.columns else F.lit(None)
    return responses.select("key", "uri", "date", "http", "payload", source.cast("string").alias("source")).mapInArrow(run, schema)


def members(derived: DataFrame, *columns: str) -> DataFrame:
    """Records as gzip members (key, kind, member); concatenated they are a .warc.gz file."""

    def zipped(kind: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.col(f"{kind}_record").alias("record"))

    rows = derived.select("key", F.explode(F.array(*map(zipped, columns or ("metadata", "conversion")))).alias("r")).select("key", "r.kind", "r.record")

    def run(batches):
        for batch in batches:
            packed = [gzip.compress(x.as_py(), mtime=0) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["key", "kind", "member"])

    return rows.mapInArrow(run, f"key {derived.schema['key'].dataType.simpleString()}, kind string, member binary")
