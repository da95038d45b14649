"""WARC derivatives: metadata and plain-text records linked to the responses they come from.

A record is a row: headers (map) and block (bytes). Responses become a metadata
record (JSON: the source's headers, HTTP status and headers, digests, title,
links) and a conversion record (the page's plain text). Both refer to the
response by WARC-Refers-To and keep its target and date.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import json
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from urllib.parse import urljoin

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import new_path, stored
from .token_file import BATCH_BYTES

RECORD = "headers map<string,string>, block binary"
_RECORD = pa.schema([("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])

_HIDDEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.I | re.S)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title\s*>|\Z)", re.I | re.S)
_BREAK = re.compile(r"</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|select|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^>]*>", re.I)
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*>")
#: Anything in angle brackets without such inside, and as much of its name as tells what it is: no block element's name has over ten characters.
_FLAT = re.compile(r"<([/!?]?\w{0,11})[^<>]*>")
_HREF = re.compile(r"<a\b[^>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
#: Scheme and host of a URL; references with a scheme and host, or from the root, that have no part which joining would change.
_ORIGIN = re.compile(r"(https?://[A-Za-z0-9.-]+(?::[0-9]+)?)(?:[/?#]|\Z)")
_PLAIN = re.compile(r"(?:https?://[A-Za-z0-9.-]+(?::[0-9]+)?)?/(?:[\w~%,-][\w.~%,-]*/)*(?:[\w~%,-][\w.~%,-]*)?(?:\?[\w.~%,=&-]+)?")
_JSON = json.JSONEncoder(ensure_ascii=False, sort_keys=True, check_circular=False)
_CHARSET = re.compile(rb"charset\s*=\s*[\"']?\s*([\w.:-]+)", re.I)


def digest(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def derived_id(source: str, kind: str) -> str:
    """The same id whenever the record is made from the same source."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{source}#{kind}')}>"


def split_http(block: bytes) -> tuple[str, list[tuple[str, str]], bytes]:
    """Status line, header fields in order, body of an HTTP response."""
    head, _, body = block.partition(b"\r\n\r\n")
    lines = re.sub(r"\r\n[ \t]+", " ", head.decode("iso-8859-1")).split("\r\n")
    return lines[0], [(n.strip(), v.strip()) for n, c, v in (x.partition(":") for x in lines[1:]) if c], body


def unchunked(body: bytes) -> bytes:
    """The body that a chunked one carries. A body that is not chunked, whatever its header says, stays; of one cut short, what is there."""
    out, at = [], 0
    while at < len(body):
        end = body.find(b"\r\n", at)
        size = body[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", size):
            return b"".join(out) if out else body
        n = int(size, 16)
        if not n:
            break
        out.append(body[end + 2 : end + 2 + n])
        at = end + 2 + n + 2
    return b"".join(out)


def unpacked(body: bytes, encodings: str) -> bytes | None:
    """The body without its content encodings (gzip, deflate, br, zstd), the last applied first; None if one is unknown or broken."""
    for name in reversed([x.strip().lower() for x in encodings.split(",")]):
        try:
            if name in ("gzip", "x-gzip"):
                body = gzip.decompress(body)
            elif name == "deflate":  # with or without zlib's frame
                body = zlib.decompress(body, 15 if body[:1] and body[0] & 15 == 8 else -15)
            elif name in ("br", "zstd"):
                body = pa.CompressedInputStream(pa.BufferReader(body), {"br": "brotli"}.get(name, name)).read()
            elif name not in ("", "identity"):
                return None
        except (OSError, EOFError, ValueError, zlib.error):
            return None
    return body


def agrees(named: str | None, data: bytes) -> bool | None:
    """Whether a digest field ("algorithm:value", the value in hexadecimal or base 32) is that of the data; None if there is none or its algorithm is unknown."""
    name, _, value = (named or "").partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ("md5", "sha1", "sha256", "sha384", "sha512"):
        return None
    raw = hashlib.new(name, data).digest()
    return value.strip().upper().rstrip("=") in (raw.hex().upper(), base64.b32encode(raw).decode().rstrip("="))


def decoded(body: bytes, content_type: str) -> str:
    """Text of a body: by the charset of the header, else of the page's start, else UTF-8; what can't be decoded becomes U+FFFD."""
    named = _CHARSET.search(content_type.encode()) or _CHARSET.search(body[:2048])
    try:
        return body.decode(named[1].decode("ascii") if named else "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def plain_text(page: str) -> str:
    """Visible text: hidden elements, comments and tags go, block elements break lines, character references are read, blanks and empty lines are closed up."""
    return _lines(_HIDDEN.sub(" ", page))


@lru_cache(1024)
def _instead(name: str) -> str | None:
    """What a tag of this name leaves in the text; None if it is no tag."""
    tag = f"<{name}>"
    return "\n" if _BREAK.fullmatch(tag) else "" if _TAG.fullmatch(tag) else None


def _untagged(seen: str) -> str:
    """``seen`` without tags, with line breaks for block elements. Where no bracket stands inside or outside of tags, which is nearly everywhere, one pass does it."""
    parts = _FLAT.split(seen)
    left = [*map(_instead, parts[1::2])]
    if len(left) != seen.count("<") or None in left:
        return _TAG.sub("", _BREAK.sub("\n", seen))
    parts[1::2] = left
    return "".join(parts)


def _closed_up(line: str) -> str:
    """A line without blanks at its ends, with one blank for each run inside. All white space but the plain blank counts as not printable."""
    return line.strip() if line.isprintable() and "  " not in line else " ".join(line.split())


def _lines(seen: str) -> str:
    """The text of a page without its hidden elements."""
    text = html.unescape(_untagged(seen))
    return "\n".join([line for x in text.split("\n") if x and (line := _closed_up(x))])


def derive(headers: dict[str, str], block: bytes) -> list[tuple[dict[str, str], bytes]]:
    """The metadata record of a response and, if it holds text, its conversion record.

    Field names count whatever their case. The payload is the body without its
    transfer encoding; text is read without its content encoding too. A body
    in an unknown or broken encoding has no conversion record.
    """
    own = {k.lower(): v for k, v in headers.items()}
    source = own.get("warc-record-id", "")
    status, fields, body = split_http(block)
    field = lambda name: next((v for n, v in fields if n.lower() == name), "")
    kind = field("content-type")
    if "chunked" in field("transfer-encoding").lower():
        body = unchunked(body)
    plain = unpacked(body, field("content-encoding"))
    about: dict = {
        "source_headers": dict(sorted(headers.items())),
        "status": status,
        "http_headers": [list(x) for x in fields],
        "block_digest": digest(block),
        "payload_digest": digest(body),
        "payload_length": len(body),
        "source_digests_agree": {"block": agrees(own.get("warc-block-digest"), block), "payload": agrees(own.get("warc-payload-digest"), body)},
        "decoded": plain is not None,
    }
    textual = plain is not None and (not kind or re.match(r"\s*(text/|application/(xhtml\+xml|xml|json))", kind, re.I))
    marked = textual and ("html" in kind.lower() or "xml" in kind.lower() or not kind)
    text = ""
    if textual:
        page = decoded(plain, kind)
        text = page
        if marked:
            seen = _HIDDEN.sub(" ", page)
            text = _lines(seen)
            title = _TITLE.search(seen)
            about["title"] = " ".join(html.unescape(_TAG.sub("", title[1])).split()) if title else None
            base = own.get("warc-target-uri", "")
            origin = _ORIGIN.match(base)
            about["links"] = [_absolute(base, html.unescape(m[m.lastindex] if m.lastindex else ""), origin and origin[1]) for m in _HREF.finditer(seen)]
    names = {"warc-target-uri": "WARC-Target-URI", "warc-date": "WARC-Date"}
    kept = {name: own[k] for k, name in names.items() if k in own}
    link = {"WARC-Refers-To": source, "WARC-Refers-To-Payload-Digest": about["payload_digest"]}
    link |= {f"WARC-Refers-To-{name[5:]}": own[k] for k, name in names.items() if k in own}
    found = [("metadata", "application/json", _JSON.encode(about).encode("utf-8", "replace"))]
    if textual:
        found.append(("conversion", "text/plain; charset=utf-8", text.encode("utf-8", "replace")))
    return [
        ({"WARC-Type": name, "WARC-Record-ID": derived_id(source, name), **kept, **link, "Content-Type": content, "WARC-Block-Digest": digest(data), "Content-Length": str(len(data))}, data)
        for name, content, data in found
    ]


def _absolute(base: str, ref: str, origin: str | None = None) -> str:
    """``ref`` as seen from ``base``. Plain references are what ``urljoin`` would leave or put behind the ``origin`` of the base, which spares most of its calls."""
    if _PLAIN.fullmatch(ref):
        if ref[0] != "/":
            return ref
        if origin:
            return origin + ref
    try:
        return urljoin(base, ref.strip())
    except ValueError:
        return ref


def serialize(headers: dict[str, str], block: bytes) -> bytes:
    """A record as it stands in a file."""
    lines = "".join(f"{n}: {v}\r\n" for n, v in headers.items() if n.lower() != "content-length")
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def parse_records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an uncompressed stream."""
    while line := source.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers: dict[str, str] = {}
        name = ""
        while (line := source.readline()).strip():
            text = line.decode("utf-8", "replace").rstrip("\r\n")
            if text[0] in " \t" and name:
                headers[name] += " " + text.strip()
            else:
                name, _, value = text.partition(":")
                headers[name] = value.strip()
        yield headers, source.read(int(next((v for k, v in headers.items() if k.lower() == "content-length"), 0)))


def _inflated(source) -> Iterator[bytes]:
    """What the members of a gzip file hold, in pieces; as ``gzip.GzipFile`` reads it, with less to do for each member."""
    member, rest = None, b""
    while rest or (rest := source.read(1 << 15)):
        member = member or zlib.decompressobj(31)
        piece = member.decompress(rest, 1 << 18)
        rest = member.unconsumed_tail
        if piece:
            yield piece
        if member.eof:
            rest, member = member.unused_data.lstrip(b"\0"), None
            while not rest and (rest := source.read(1 << 15)):  # zeros may fill up the file
                rest = rest.lstrip(b"\0")
    if member:
        raise EOFError("the file ends within a gzip member")


class _Stream(io.RawIOBase):
    """Pieces of bytes as a file."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, out) -> int:
        have = 0
        while have < len(out) and (self.held or (piece := next(self.pieces, None))):
            held = self.held or memoryview(piece)
            n = min(len(held), len(out) - have)
            out[have : have + n] = held[:n]
            have, self.held = have + n, held[n:]
        return have


def _batches(rows: Iterable[tuple[dict[str, str], bytes]]) -> Iterator[pa.RecordBatch]:
    """Records as Arrow batches of bounded bytes. Maps are made of all names and values at once, which costs far less than a dict each."""
    ends, names, values, blocks, total = [0], [], [], [], 0

    def batch() -> pa.RecordBatch:
        maps = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(names, pa.string()), pa.array(values, pa.string()))
        return pa.RecordBatch.from_arrays([maps, pa.array(blocks, pa.binary())], schema=_RECORD)

    for headers, block in rows:
        names += headers
        values += headers.values()
        ends.append(len(names))
        blocks.append(block)
        total += len(block) + 600
        if total >= BATCH_BYTES or len(blocks) >= 20_000:
            yield batch()
            ends, names, values, blocks, total = [0], [], [], [], 0
    if blocks:
        yield batch()


def _records(part: pa.RecordBatch) -> Iterator[tuple[dict[str, str] | None, bytes | None]]:
    """The records of a batch: headers of all at once, blocks one by one."""
    maps = part.column(0)
    ends = maps.offsets.to_pylist()
    names, values = (x.slice(ends[0], ends[-1] - ends[0]).to_numpy(zero_copy_only=False).tolist() if len(maps) else [] for x in (maps.keys, maps.items))
    for k, (there, block) in enumerate(zip(maps.is_valid().to_pylist(), part.column(1))):
        a, b = ends[k] - ends[0], ends[k + 1] - ends[0]
        yield dict(zip(names[a:b], values[a:b])) if there else None, block.as_py()


def _page_text() -> Column:
    return F.coalesce(F.col("html").cast("string"), F.lit(""))


def page_record_id() -> Column:
    """The id of a page's response, from page_id, url and html. The hash is named once, as Spark works it out each time it is named."""
    hashed = F.md5(F.concat_ws("|", F.col("page_id").cast("string"), F.col("url").cast("string"), F.sha2(_page_text(), 256)))
    return F.regexp_replace(hashed, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "<urn:uuid:$1-$2-$3-$4-$5>")


def page_responses(pages: DataFrame, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Pages (page_id, url, html) as response records: page_id, headers, block. Null html is an empty body, a null url leaves the target out; ids follow from page_id, url and html."""
    text, url = _page_text(), F.col("url").cast("string")
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(text).cast("string"), F.lit("\r\n\r\n"), text).cast("binary")
    headers = F.map_filter(
        F.create_map(*[x for k, v in (("WARC-Type", F.lit("response")), ("WARC-Record-ID", page_record_id()), ("WARC-Target-URI", url), ("WARC-Date", F.lit(date)), ("Content-Type", F.lit("application/http; msgtype=response"))) for x in (F.lit(k), v)]),
        lambda k, v: v.isNotNull(),
    )
    return pages.select("page_id", headers.alias("headers"), block.alias("block"))


def build_derivatives(records: DataFrame) -> DataFrame:
    """Metadata and conversion records of all responses among ``records`` (headers, block; other columns are not read).

    Records of other types and null blocks or headers give nothing; missing
    header fields are left out; a block that isn't HTTP is a response without
    body. Records that repeat give derivatives that repeat, with the same ids.
    An empty table gives no rows. A record is held whole in memory, as WARC
    readers do; an Arrow batch of derivatives is bounded.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for part in parts:
                for headers, block in _records(part):
                    if headers is not None and block is not None:
                        got = {k: v for k, v in headers.items() if v is not None}
                        if next((v for k, v in got.items() if k.lower() == "warc-type"), "").lower() == "response":
                            yield from derive(got, block)

        yield from _batches(rows())

    return records.select("headers", "block").mapInArrow(run, RECORD)


def write_warc(records: DataFrame, folder: str | None = None, level: int = 1) -> DataFrame:
    """Writes a gzipped file per partition, each record a member of its own; returns the stored manifest, path and number of records. A task that runs again writes the same file. An empty partition writes a file of no records."""
    folder = (folder or new_path(records.sparkSession, "warc")).rstrip("/")

    def write(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, n = TaskContext.get(), 0
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        attempt = f"{base}/.{task.partitionId()}-{task.taskAttemptId()}"
        with store.open_output_stream(attempt, compression=None) as out:
            for part in parts:
                for headers, block in _records(part):
                    out.write(gzip.compress(serialize(headers, block), level, mtime=0))
                    n += 1
        store.move(attempt, f"{base}/part-{task.partitionId():06d}.warc.gz")
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/part-{task.partitionId():06d}.warc.gz"]), pa.array([n], pa.int64())], names=["path", "records"])

    return stored(records.select("headers", "block").mapInArrow(write, "path string, records long"), "manifest")


def read_warc(files: DataFrame) -> DataFrame:
    """The records of the files named in ``path``, plain or gzipped; a task for each file. Null paths and empty tables give no records."""

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for part in parts:
                for path in part.column(0).to_pylist():
                    store, name = pafs.FileSystem.from_uri(path)
                    with store.open_input_stream(name, compression=None) as raw:
                        stream = io.BufferedReader(_Stream(_inflated(raw)), 1 << 18) if path.endswith(".gz") else raw
                        yield from parse_records(stream)

        yield from _batches(rows())

    named = files.select("path").where("path IS NOT NULL")
    return named.repartitionByRange(max(1, named.count()), "path").mapInArrow(read, RECORD)
