"""Content-addressed payloads in tar shards.

A payload (a text's bytes, padded to whole rows of samples) is stored losslessly as an 8-bit grey PNG.  Its
address is the SHA-256 of the payload; each address is stored once, in a tar shard in the shared folder.
Rows carry digest, shard, offset and length.  Metadata columns are filled by range reads of each image's first
bytes alone; digests of what is stored and features by range reads of whole images.

Texts that a bitmap of repeated texts clears have no copies, and the task that reads them writes them.  The
others are turned to images first, each task leaving out those that it has just made, and meet by digest,
so that a payload with very many copies reaches its shard's writer once per task at most.

Defined results: a null text counts as empty and is stored as one row of padding; null doc_ids and repeated
rows stay, with equal values for equal texts; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import zlib
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import joined_by, maybe_in, shared_dir, stored, text_of
from tallyloom.llm.shared_files import Ranges, new_file

WIDTH = 576
PAD = b"\xff"
SHARD_BYTES = 64 << 20
SEEN = 200_000
OPEN_FILES = 16
# Fixed values of the PNG format: the signature, and the bytes up to the end of the header chunk.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33


def payload_of(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return raw + PAD * (max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw))


def payload_digest(text: Column) -> Column:
    """The address, in the JVM."""
    n = F.octet_length(text)
    pad = F.greatest(F.lit(1), F.ceil(n / WIDTH)).cast("int") * WIDTH - n
    return F.sha2(F.concat(text.cast("binary"), F.unhex(F.repeat(F.lit("FF"), pad))), 256)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_image(payload: bytes) -> bytes:
    """A grey 8-bit PNG with a row for each WIDTH bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each line starts with filter 0: samples as they are
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + _chunk(b"IEND", b"")


def image_header(first: bytes) -> tuple[int, int, int]:
    """(width, height, bits a sample) from the first HEADER_BYTES bytes."""
    if first[:8] != SIGNATURE or first[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", first[16:25])


def from_image(image: bytes) -> bytes:
    """The payload of an image that to_image made."""
    width, height, _ = image_header(image)
    at, data = 8, []
    while at < len(image):
        (size,) = struct.unpack(">I", image[at : at + 4])
        if image[at + 4 : at + 8] == b"IDAT":
            data.append(image[at + 8 : at + 8 + size])
        at += size + 12
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Rows, mean and spread of the samples, distinct samples, and the share of each eighth of the range."""
    samples = np.frombuffer(payload, np.uint8)
    share = np.bincount(samples >> 5, minlength=8) / len(samples)
    return f"rows={len(samples) // WIDTH};mean={samples.mean():.3f};std={samples.std():.3f};distinct={len(np.unique(samples))};" + ",".join(f"{x:.3f}" for x in share)


def store(docs: DataFrame) -> DataFrame:
    """Writes the shards; a row (digest, shard, offset, length) per distinct payload."""
    folder = shared_dir(docs.sparkSession, "media")
    images = pa.schema([("digest", pa.binary()), ("image", pa.binary())])
    places = pa.schema([("digest", pa.binary()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def imaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: OrderedDict[bytes, None] = OrderedDict()
        for batch in batches:
            made: list[tuple[bytes, bytes]] = []
            size = 0
            for text in batch.column(0):
                payload = payload_of(text.as_py())
                digest = hashlib.sha256(payload).digest()
                if digest in seen:
                    seen.move_to_end(digest)
                    continue
                seen[digest] = None
                if len(seen) > SEEN:
                    seen.popitem(last=False)
                made.append((digest, to_image(payload)))
                size += len(made[-1][1])
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*made), images)], schema=images)
                    made, size = [], 0
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*made), images)], schema=images)

    def written(batches: Iterator[pa.RecordBatch], kind: str = "shared") -> Iterator[pa.RecordBatch]:
        rows = ((d, i.as_py()) for b in batches for d, i in zip(b.column(0).to_pylist(), b.column(1)))
        task, seq, last = TaskContext.get(), 0, None
        part, attempt = task.partitionId(), task.taskAttemptId()  # each attempt has files of its own
        row = next(rows, None)
        while row is not None:
            shard = f"{folder}/{kind}-{part:06d}-{attempt:08d}-{seq:06d}.tar"
            found = []
            with new_file(shard) as sink, tarfile.open(fileobj=sink, mode="w|", format=tarfile.USTAR_FORMAT) as tar:
                while row is not None and tar.offset < SHARD_BYTES:
                    digest, image = row
                    if digest != last:
                        entry = tarfile.TarInfo(f"{digest.hex()}.png")
                        entry.size = len(image)
                        found.append((digest, shard, tar.offset + tarfile.BLOCKSIZE, len(image)))
                        tar.addfile(entry, io.BytesIO(image))
                        last = digest
                    row = next(rows, None)
            seq += 1
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*found), places)], schema=places)

    def written_at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from written(imaged(batches), "single")

    schema = "digest binary, shard string, offset long, length long"
    texts = docs.select(text_of().alias("text"))
    repeated = texts.groupBy(F.xxhash64("text").alias("key")).count().filter("count > 1").select("key")
    marked = maybe_in(texts, F.xxhash64("text"), stored(repeated, "media-repeated"))
    single = marked.filter("not _in").select("text").mapInArrow(written_at_once, schema)
    rest = marked.filter("_in").select("text").mapInArrow(imaged, "digest binary, image binary")
    rest = rest.repartition("digest").sortWithinPartitions("digest").mapInArrow(written, schema)
    return stored(single.unionByName(rest), "media-places")


class _Files:
    """Range reads of many files, of which a few are kept open."""

    def __init__(self) -> None:
        self._open: OrderedDict[str, Ranges] = OrderedDict()

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard not in self._open:
            if len(self._open) >= OPEN_FILES:
                self._open.popitem(last=False)[1].close()
            self._open[shard] = Ranges(shard)
        self._open.move_to_end(shard)
        return self._open[shard].read(offset, length)


def _read_more(places: DataFrame, more: str, read: Callable[[_Files, str, int, int], tuple]) -> DataFrame:
    """Adds columns that ``read`` gets from a place's shard, offset and length."""
    schema = ", ".join(f"{c} {t}" for c, t in places.dtypes) + f", {more}"
    names = [c.split()[0] for c in more.split(", ")]
    types = [pa.string() if c.endswith("string") else pa.int64() for c in more.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files()
        for batch in batches:
            rows = [read(files, *at) for at in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length")))]
            if rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names=[*batch.schema.names, *names])

    return places.mapInArrow(each, schema)


def metadata(places: DataFrame) -> DataFrame:
    """Adds width, height and bits a sample, from header-only range reads."""
    return _read_more(places, "width long, height long, bits long", lambda files, shard, offset, length: image_header(files.read(shard, offset, min(length, HEADER_BYTES))))


def contents(places: DataFrame) -> DataFrame:
    """Adds what the whole images show: the payload's size and digests, the stored form's, and the feature."""

    def read(files: _Files, shard: str, offset: int, length: int) -> tuple:
        image = files.read(shard, offset, length)
        payload = from_image(image)
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest(), feature(payload)

    return _read_more(places, "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", read)


def addressed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the payload's digest."""
    text = text_of()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(payload_digest(text)).alias("digest"))


def describe(docs: DataFrame) -> DataFrame:
    """Stores all payloads; each document's digest, shard, offset and length, the metadata columns and what was read back."""
    places = store(docs)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = stored(contents(metadata(places.repartition(n))), "media-contents")
    return joined_by(stored(addressed(docs), "media-documents"), found, "digest").withColumn("digest", F.lower(F.hex("digest")))
