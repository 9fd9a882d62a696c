"""WARC derivatives: linked metadata and plain-text conversion records of responses.

Each response record gives a metadata record (its source headers, its HTTP headers, digests and page facts as
canonical JSON) and a conversion record (the page's text), both with WARC-Refers-To of the response.  A page
is taken out of chunked and gzip or deflate coding and read in the charset of its header, its byte order mark
or its meta tag, else as UTF-8.  The records are written as one gzip member each to WARC files in the shared
folder, after a warcinfo record; rows carry file, offset, length and digests.  Other record types give no
derivatives, and a damaged record, or a page in an unknown or broken coding, gives a metadata record with its
error and no conversion.  Source digests by SHA-1, SHA-256 or MD5 are compared; by others they hold as null.

Defined results: a null record, url or page counts as empty; null page ids stay; equal pages give equal
texts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import codecs
import gzip
import hashlib
import html
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import shared_dir, stored
from tallyloom.llm.shared_files import Ranges, new_file

FILE_BYTES = 64 << 20
DATE = "2026-01-01T00:00:00Z"
_END = b"\r\n\r\n"
_HIDDEN = re.compile(r"(?i)<!--|<(script|style|head|noscript|template)\b")
_CLOSED = {"": re.compile("-->")} | {n: re.compile(rf"(?i)</{n}\s*>") for n in ("script", "style", "head", "noscript", "template")}
_BREAK = re.compile(r"(?i)<(?:/?(?:p|div|h[1-6]|li|ul|ol|tr|table|article|section|header|footer|nav|blockquote|pre)\b|br|hr)[^<>]*>")
_TAG = re.compile(r"<(?=[A-Za-z/!?])[^<>]*>")
_TITLE = re.compile(r"(?i)<title\b[^<>]*>([^<]*)</title")
_LANG = re.compile(r"(?i)<html\b[^<>]*\blang=[\"']?([a-z-]+)")
_LINK = re.compile(r"(?i)<a\b[^<>]*\bhref=[\"']?([^\"'\s>]+)")
_BLANKS = re.compile(r"[ \t\r\f\v]+")
_CHARSET = re.compile(r"(?i)charset\s*=\s*[\"']?([\w.:-]+)")
_META = re.compile(r"(?i)<meta\b[^<>]*>")
_MARKS = ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16"))
_META_BYTES = 4096


def record_id(kind: str, name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind} {name}')}>"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.0\r\n" + head.encode("utf-8", "surrogatepass") + b"\r\n" + block + _END


def response(page_id: int | None, url: str, page: str) -> bytes:
    """A response record of a page, as a crawler would have kept it."""
    body = page.encode("utf-8", "surrogatepass")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: " + str(len(body)).encode() + _END
    return record([
        ("WARC-Type", "response"), ("WARC-Record-ID", record_id("response", f"{page_id} {url}")), ("WARC-Date", DATE), ("WARC-Target-URI", one_line(url)),
        ("WARC-Payload-Digest", digest(body)), ("WARC-Block-Digest", digest(http + body)), ("Content-Type", "application/http; msgtype=response"),
    ], http + body)


def warcinfo(file: str) -> bytes:
    """The first record of a file."""
    name = file.rsplit("/", 1)[-1]
    fields = b"format: WARC File Format 1.0\r\ndescription: metadata and plain text of responses\r\n"
    return record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id("warcinfo", file)), ("WARC-Date", DATE), ("WARC-Filename", name), ("WARC-Block-Digest", digest(fields)), ("Content-Type", "application/warc-fields")], fields)


def one_line(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


class Headers:
    """Header lines in their order, repeats included; by name in any case, the first one counts."""

    def __init__(self, lines: list[bytes]):
        self.pairs = [split_header(x) for x in lines]

    def get(self, name: str, default: str | None = None) -> str | None:
        return next((v for k, v in self.pairs if k.lower() == name.lower()), default)

    def __getitem__(self, name: str) -> str:
        if (value := self.get(name)) is None:
            raise KeyError(name)
        return value


def parse(raw: bytes) -> tuple[Headers, bytes]:
    """(headers, block) of one record; ValueError if it is damaged."""
    head, mark, rest = raw.partition(_END)
    lines = head.split(b"\r\n")
    if not mark or not lines[0].startswith(b"WARC/"):
        raise ValueError("no WARC header")
    headers = Headers(lines[1:])
    length = headers.get("Content-Length", "")
    if not length.isdigit() or len(rest) < int(length):
        raise ValueError("short block")
    return headers, rest[: int(length)]


def split_header(line: bytes) -> tuple[str, str]:
    name, _, value = line.decode("utf-8", "replace").partition(":")
    return name.strip(), value.strip()


def holds(kept: str | None, payload: bytes) -> bool | None:
    """Whether a labelled digest, in base 32 or hexadecimal, is that of the payload; null if there is none of a known kind."""
    kind, _, value = (kept or "").partition(":")
    if kind.lower() not in ("sha1", "sha256", "md5"):
        return None
    own = hashlib.new(kind.lower(), payload).digest()
    return value.upper().rstrip("=") == base64.b32encode(own).decode().rstrip("=") or value.lower() == own.hex()


def unchunked(data: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        size = int(data[at:end].split(b";")[0], 16) if end >= 0 else -1
        if size < 0 or end + 2 + size > len(data):
            raise ValueError("broken chunks")
        if not size:
            return b"".join(out)
        out.append(data[end + 2 : end + 2 + size])
        at = end + 4 + size


def body_of(http: Headers, payload: bytes) -> bytes:
    """The page out of its transfer and content codings; ValueError if one is unknown or broken."""
    if "chunked" in (http.get("Transfer-Encoding") or "").lower():
        payload = unchunked(payload)
    for coding in reversed([x.strip().lower() for x in (http.get("Content-Encoding") or "").split(",")]):
        if coding in ("", "identity"):
            continue
        if coding not in ("gzip", "x-gzip", "deflate"):
            raise ValueError(f"unknown coding {coding}")
        try:
            if coding == "deflate":
                payload = zlib.decompress(payload, zlib.MAX_WBITS if payload[:1] == b"\x78" else -zlib.MAX_WBITS)
            else:
                payload = gzip.decompress(payload)
        except (OSError, EOFError, zlib.error) as e:
            raise ValueError(f"broken {coding}") from e
    return payload


def decoded(http: Headers, body: bytes) -> tuple[str, str]:
    """The page, and the charset that reads it: the first of header, byte order mark and meta tag that names a text
    encoding which decodes the body, or UTF-8."""
    named = [m[1] for m in [_CHARSET.search(http.get("Content-Type") or "")] if m]
    named += [name for mark, name in _MARKS if body.startswith(mark)]
    named += [m[1] for tag in _META.findall(body[:_META_BYTES].decode("latin-1")) for m in [_CHARSET.search(tag)] if m]
    for name in named:
        try:
            return body.decode(name, "replace"), name
        except (LookupError, UnicodeError, ValueError):  # unknown, of no text, or one that doesn't replace what it can't read
            continue
    return body.decode("utf-8", "replace"), "utf-8"


def shown(page: str) -> str:
    """The page without comments and parts that are not seen; a part that is never closed stays."""
    out, at, seek, open_ended = [], 0, 0, set()
    while found := _HIDDEN.search(page, seek):
        name = (found[1] or "").lower()
        end = None if name in open_ended else _CLOSED[name].search(page, found.end())
        if end:
            out += [page[at : found.start()], " "]
            at = seek = end.end()
        else:
            open_ended.add(name)  # no later one is closed either
            seek = found.end()
    return "".join(out) + page[at:]


def plain_text(page: str) -> str:
    """Lines of visible text."""
    text = _TAG.sub("", _BREAK.sub("\n", shown(page)))
    lines = (_BLANKS.sub(" ", x).strip() for x in html.unescape(text).split("\n"))
    return "\n".join(x for x in lines if x)


def derivatives(raw: bytes) -> tuple[bytes, bytes | None, dict] | None:
    """(metadata record, conversion record, columns) of a record; None if it is not a response."""
    try:
        headers, block = parse(raw)
    except ValueError as e:
        headers, block, error = Headers([]), b"", str(e)
    else:
        error = None
        if headers.get("WARC-Type") != "response":
            return None
    source = headers.get("WARC-Record-ID", record_id("damaged", digest(raw)))
    url = headers.get("WARC-Target-URI", "")
    head, mark, body = block.partition(_END)
    lines = head.split(b"\r\n")
    http = Headers(lines[1:] if mark else [])
    payload = body if mark else b""
    try:
        body = body_of(http, payload)
    except ValueError as e:
        body, error = b"", error or str(e)
    page, charset = decoded(http, body)
    text = plain_text(page)
    title = _TITLE.search(page)
    lang = _LANG.search(page)
    links = _LINK.findall(page)
    kept = headers.get("WARC-Payload-Digest")
    facts = {
        "envelope": headers.pairs, "http": {"status": lines[0].decode("utf-8", "replace") if mark else "", "headers": http.pairs},
        "title": html.unescape(title[1]).strip() if title else "", "lang": lang[1].lower() if lang else "", "links": links,
        "payload-digest": digest(payload), "digest-holds": holds(kept, payload), "charset": charset, "error": error,
    }
    about = json.dumps(facts, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode("utf-8", "surrogatepass")
    words = text.encode("utf-8", "surrogatepass")
    common = [("WARC-Date", headers.get("WARC-Date", DATE)), ("WARC-Target-URI", url), ("WARC-Refers-To", source)]
    meta_id, text_id = record_id("metadata", source), record_id("conversion", source)
    meta = record([("WARC-Type", "metadata"), ("WARC-Record-ID", meta_id), *common, ("WARC-Block-Digest", digest(about)), ("Content-Type", "application/json")], about)
    linked = [("WARC-Source-Payload-Digest", kept or digest(payload)), ("WARC-Concurrent-To", meta_id)]
    conversion = record([("WARC-Type", "conversion"), ("WARC-Record-ID", text_id), *common, *linked, ("WARC-Block-Digest", digest(words)), ("Content-Type", "text/plain; charset=utf-8")], words)
    columns = {
        "refers_to": source, "url": url, "metadata_id": meta_id, "conversion_id": None if error else text_id, "payload_digest": digest(payload),
        "digest_holds": facts["digest-holds"], "n_links": len(links), "title": facts["title"], "lang": facts["lang"],
        "text_digest": None if error else digest(words), "text_chars": None if error else len(text), "error": error,
    }
    return meta, None if error else conversion, columns


KINDS = pa.schema([
    ("page_id", pa.int64()), ("refers_to", pa.string()), ("url", pa.string()), ("metadata_id", pa.string()), ("conversion_id", pa.string()),
    ("payload_digest", pa.string()), ("digest_holds", pa.bool_()), ("n_links", pa.int64()), ("title", pa.string()), ("lang", pa.string()),
    ("text_digest", pa.string()), ("text_chars", pa.int64()), ("error", pa.string()), ("file", pa.string()),
    ("metadata_offset", pa.int64()), ("metadata_length", pa.int64()), ("conversion_offset", pa.int64()), ("conversion_length", pa.int64()),
])
SCHEMA = """page_id long, refers_to string, url string, metadata_id string, conversion_id string, payload_digest string, digest_holds boolean,
    n_links long, title string, lang string, text_digest string, text_chars long, error string, file string,
    metadata_offset long, metadata_length long, conversion_offset long, conversion_length long"""


def responses(pages: DataFrame) -> DataFrame:
    """(page_id, record): a response record for each page."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("page_id", pa.int64()), ("record", pa.binary())])
        for batch in batches:
            raw = [response(i, u or "", h or "") for i, u, h in zip(*(c.to_pylist() for c in batch.columns))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], schema=kinds)

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(made, "page_id long, record binary")


def build(records: DataFrame) -> DataFrame:
    """Writes the derivatives of ``records(page_id, record)``; a row for each response."""
    folder = shared_dir(records.sparkSession, "warc")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((i, raw.as_py() or b"") for b in batches for i, raw in zip(b.column(0).to_pylist(), b.column(1)))
        part, seq, attempt = TaskContext.get().partitionId(), 0, TaskContext.get().taskAttemptId()
        row = next(rows, None)
        while row is not None:
            file = f"{folder}/part-{part:06d}-{seq:06d}-{attempt}.warc.gz"  # only files of the attempt that counts get into the index
            found = []
            with new_file(file) as sink:
                about = gzip.compress(warcinfo(file), 6, mtime=0)
                sink.write(about)
                at = len(about)
                while row is not None and at < FILE_BYTES:
                    made = derivatives(row[1])
                    if made is not None:
                        meta, conversion, columns = made
                        places = {"file": file}
                        for name, data in (("metadata", meta), ("conversion", conversion)):
                            packed = gzip.compress(data, 6, mtime=0) if data is not None else None
                            places |= {f"{name}_offset": None if packed is None else at, f"{name}_length": None if packed is None else len(packed)}
                            if packed is not None:
                                sink.write(packed)
                                at += len(packed)
                        found.append({"page_id": row[0]} | columns | places)
                    row = next(rows, None)
            seq += 1
            if found:
                yield pa.RecordBatch.from_pylist(found, schema=KINDS)

    own = records.select(F.col("page_id").cast("long").alias("page_id"), F.col("record").cast("binary").alias("record"))
    return stored(own.mapInArrow(written, SCHEMA), "warc-index")


def read_records(index: DataFrame) -> DataFrame:
    """Adds to the index what the conversion records, read back by range, hold: whether they are whole and refer to their response, and the text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            linked, texts = [], []
            for source, path, offset, length in zip(*(batch.column(k).to_pylist() for k in ("refers_to", "file", "conversion_offset", "conversion_length"))):
                if offset is None:
                    linked.append(None)
                    texts.append(None)
                    continue
                if path != name:
                    if file:
                        file.close()
                    name, file = path, Ranges(path)
                headers, block = parse(gzip.decompress(file.read(offset, length)))
                whole = headers["WARC-Block-Digest"] == digest(block) and headers["WARC-Type"] == "conversion"
                linked.append(whole and headers["WARC-Refers-To"] == source)
                texts.append(block.decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(linked, pa.bool_()), pa.array(texts, pa.string())], names=[*batch.schema.names, "linked", "text"])
        if file:
            file.close()

    return index.select(*KINDS.names).mapInArrow(read, SCHEMA + ", linked boolean, text string")
