"""Token ids in wavelet-matrix shards.

Documents are put in ascending doc_id order over range partitions.  Each task encodes its documents and
writes shards: one compressed file holds the ids' bit planes, from the highest bit down, each stably
parted by its bits (a wavelet matrix), with counts of ones before each block, and the documents' ids and
ends.  From that file alone a reader gets any id (access), the number of an id before a place (rank), the
place of its k-th occurrence (select), and whole ranges.

Defined results: a null text counts as empty and gives only the end id; null doc_ids come first, equal
doc_ids are ordered by the hash of their text; an empty table gives an empty result; other columns are
ignored.  Rows of one doc_id, or without one, may be dealt over several partitions.
"""

from __future__ import annotations

import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import shared_dir, stored, text_of
from tallyloom.llm.shared_files import Ranges, new_file

END_ID = 2
SHARD_TOKENS = 1 << 21
BLOCK_BYTES = 1 << 14
CACHED_WORDS = 1_200_000
GROUP_CHARS = 1 << 20
CACHED_LENGTH = 64
MAGIC = b"WVLTMTX1"
_HEAD = struct.Struct("<8sQQII")
_BLOCK = np.dtype([("offset", "<u8"), ("length", "<u4"), ("ones", "<u8")])
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
_LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha() and c not in "ªµº")
_WORD = re.compile(f"[{_LETTERS}]+")
_MARKS = ".,;:!?"
_ODD_BLANK = re.compile(r"[^\S \n]|[\x1c-\x1f]")


class Encoder:
    """Encodes texts with the tokenizers library, remembering the ids of words.

    A byte-level pre-tokenizer never joins a character with a blank after it, so a text may be cut before
    a single space, and around one or two line feeds, between two other characters; equal pieces then have
    equal ids.  Texts with other runs of blanks are cut only at such single spaces, and those that hold the text
    of an added token, which the library takes out before anything else, are not cut at all; nor are any where the
    tokenizer has a normaliser.  Words of letters alone
    are given to the library as the bytes' signs that its pre-tokenizer would make of them, with marks after
    them apart.  What is remembered is bounded: words that come when it is full are encoded again.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        self._bare = Tokenizer.from_file(path)  # takes signs of bytes, parted by blanks
        self._bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        signs = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self._signs = {ord(c): signs(c)[0][0] for c in _LETTERS}
        self._space = signs(" ")[0][0]
        size = self._tokenizer.get_vocab_size()
        self._spaced = np.array([(self._tokenizer.id_to_token(i) or "").startswith(self._space) for i in range(size)])
        self._added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values() if t.content]
        self._normal = self._tokenizer.normalizer is not None  # then added tokens may be looked for in other letters
        self._feed = self._ids(["\n"])[0]
        self._known: dict[str, bytes] = {}  # by word after a space; one that begins with a line feed stands after it instead

    def _ids(self, pieces: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self._tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _parted(self, words: list[str], joined: str, tokenizer) -> list[bytes]:
        """Ids of words that were joined to one text, parted at the ids that start with a space."""
        if not words:
            return []
        ids = np.array(tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
        starts = np.flatnonzero(self._spaced[ids])
        if len(starts) != len(words):
            return self._ids([" " + w for w in words])
        raw, cuts = ids.tobytes(), (4 * starts).tolist()
        return [raw[a:b] for a, b in zip(cuts, [*cuts[1:], len(raw)])]

    def _learn(self, words: set[str]) -> None:
        """Adds the ids of new words."""
        known, marked, bare, other, fed = self._known, {}, set(), [], []
        for w in words:
            if w.isalpha():
                (bare.add if w.isascii() or _WORD.fullmatch(w) else other.append)(w)
            elif w[0] == "\n":
                fed.append(w)
            elif w[-1] in _MARKS and _WORD.fullmatch(stem := w.rstrip(_MARKS)):
                marked[w] = stem
            else:
                other.append(w)
        bare.update(stem for stem in marked.values() if stem not in known)
        stems = list(bare)
        signs = [w if w.isascii() else w.translate(self._signs) for w in stems]
        found = dict(zip(stems, self._parted(stems, self._space + f" {self._space}".join(signs), self._bare)))
        tails = {w[len(stem) :] for w, stem in marked.items()}
        ends = dict(zip(tails, self._ids(list(tails))))
        for w, stem in marked.items():
            known[w] = (known.get(stem) or found[stem]) + ends[w[len(stem) :]]
        known.update((w, found[w]) for w in bare & words)
        known.update(zip(other, self._parted(other, " " + " ".join(other), self._tokenizer)))
        known.update((w, self._feed + ids) for w, ids in zip(fed, self._ids([w[1:] for w in fed])))

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        cut = [text.replace("\n", " \n").split(" ") for text in texts]
        for line in cut:
            line[0] = "\n" + line[0]  # so nothing stands before it; its feed's id is taken off again
        new = set().union(*cut).difference(self._known)
        blank = {""} & new
        if _ODD_BLANK.search("".join(new)):
            blank |= {w for w in new if w != "\n" and (w[-1:].isspace() or w[:1] != "\n" and w[:1].isspace() or w[1:2].isspace())}
        apart = {}
        for k, text in enumerate(texts):
            if self._normal or any(t in text for t in self._added):
                apart[k], cut[k] = [text], []
            elif "\n\n" in text and ("\n\n\n" in text or "\n\n " in text or text.endswith("\n\n")) or text[:1].isspace() or blank and not blank.isdisjoint(cut[k]):
                apart[k], cut[k] = _LONE_SPACE.split(text), []
        new -= blank
        self._learn(new)
        get, step = self._known.__getitem__, len(self._feed)
        out = [b"".join(map(get, line))[step:] for line in cut]
        for k, (head, *rest) in apart.items():
            out[k] = b"".join(self._ids([head, *(" " + w for w in rest)]))
        full = len(self._known) > CACHED_WORDS
        for w in new:
            if full or len(w) > CACHED_LENGTH:
                del self._known[w]
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker and vocabulary."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def to_file(ids: np.ndarray, docs: list[tuple[int | None, int]]) -> Iterator[bytes]:
    """The file's parts. ``docs``: each document's id and number of ids, in order."""
    bits = max(1, int(ids.max(initial=0)).bit_length())
    values = ids.astype("<u4" if bits > 16 else "<u2")
    squeeze = zstandard.ZstdCompressor(level=1)
    zeros, blocks, data, offset = np.zeros(bits, "<u8"), [], [], 0
    for level in range(bits):
        ones = (values & values.dtype.type(1 << (bits - 1 - level))).astype(bool)
        plane = np.packbits(ones)
        before = 0
        for at in range(0, len(plane), BLOCK_BYTES):
            raw = plane[at : at + BLOCK_BYTES]
            packed = squeeze.compress(raw.tobytes())
            blocks.append((offset, len(packed), before))
            before += int(np.bitwise_count(raw).sum())
            data.append(packed)
            offset += len(packed)
        zeros[level] = len(values) - before
        values = np.concatenate([values.take(np.flatnonzero(~ones)), values.take(np.flatnonzero(ones))])
    names = np.array([-1 if d is None else d for d, _ in docs], "<i8")
    known = np.array([d is not None for d, _ in docs], "u1")
    ends = np.cumsum([n for _, n in docs], dtype="<i8")
    table = squeeze.compress(names.tobytes() + known.tobytes() + ends.tobytes())
    yield _HEAD.pack(MAGIC, len(ids), len(docs), bits, len(table))
    yield zeros.tobytes()
    yield table
    yield np.array(blocks, _BLOCK).tobytes()
    yield from data


class WaveletMatrix:
    """Reads one shard by ranges; a plane's block is decompressed when it is first needed."""

    def __init__(self, read):
        """``read(offset, length)`` gives bytes of the file."""
        self._read = read
        magic, self.n, self.n_docs, self.bits, length = _HEAD.unpack(read(0, _HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a wavelet-matrix shard")
        at = _HEAD.size
        self.zeros = np.frombuffer(read(at, 8 * self.bits), "<u8").astype(np.int64)
        at += 8 * self.bits
        table = zstandard.ZstdDecompressor().decompress(read(at, length), max_output_size=17 * self.n_docs + 1)
        names, known = np.frombuffer(table, "<i8", self.n_docs), np.frombuffer(table, "u1", self.n_docs, 8 * self.n_docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(names, known)]
        self.ends = np.frombuffer(table, "<i8", self.n_docs, 9 * self.n_docs)
        at += length
        self._per_plane = -(-(-(-self.n // 8)) // BLOCK_BYTES)
        size = _BLOCK.itemsize * self._per_plane * self.bits
        self._blocks = np.frombuffer(read(at, size), _BLOCK).reshape(self.bits, self._per_plane)
        self._data = at + size
        self._open = lru_cache(maxsize=64)(self._load)

    def _load(self, level: int, block: int) -> np.ndarray:
        b = self._blocks[level, block]
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(self._read(self._data + int(b["offset"]), int(b["length"])), max_output_size=BLOCK_BYTES), "u1")

    def _bit(self, level: int, i: int) -> int:
        block, bit = divmod(i, 8 * BLOCK_BYTES)
        return int(self._open(level, block)[bit >> 3]) >> (7 - (bit & 7)) & 1

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits."""
        if i >= self.n:
            return self.n - int(self.zeros[level])
        block, bit = divmod(i, 8 * BLOCK_BYTES)
        plane = self._open(level, block)
        count = int(self._blocks[level, block]["ones"]) + int(np.bitwise_count(plane[: bit >> 3]).sum())
        return count + (int(plane[bit >> 3]) >> (8 - (bit & 7))).bit_count() if bit & 7 else count

    def access(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            bit = self._bit(level, i)
            value = value << 1 | bit
            i = int(self.zeros[level]) + self._ones(level, i) if bit else i - self._ones(level, i)
        return value

    def _range_of(self, token: int, i: int) -> tuple[int, int]:
        a, b = 0, max(0, min(i, self.n))
        for level in range(self.bits):
            if token >> (self.bits - 1 - level) & 1:
                z = int(self.zeros[level])
                a, b = z + self._ones(level, a), z + self._ones(level, b)
            else:
                a, b = a - self._ones(level, a), b - self._ones(level, b)
        return a, b

    def rank(self, token: int, i: int) -> int:
        """How often the id occurs among the first i."""
        if token < 0 or token >> self.bits:
            return 0
        a, b = self._range_of(token, i)
        return b - a

    def count(self, token: int, a: int = 0, b: int | None = None) -> int:
        return self.rank(token, self.n if b is None else b) - self.rank(token, a)

    def select(self, token: int, k: int) -> int | None:
        """The place of the id's occurrence number k, from 0; None if there are fewer."""
        if token < 0 or token >> self.bits or k < 0:
            return None
        a, b = self._range_of(token, self.n)
        if k >= b - a:
            return None
        i = a + k
        for level in range(self.bits - 1, -1, -1):
            z = int(self.zeros[level])
            one = token >> (self.bits - 1 - level) & 1
            i = self._select_bit(level, one, i - z if one else i)
        return i

    def _select_bit(self, level: int, one: int, k: int) -> int:
        """The place of the k-th one (or zero) of a plane: a search over blocks, then within one."""
        starts = np.arange(self._per_plane, dtype=np.int64) * 8 * BLOCK_BYTES
        before = self._blocks[level]["ones"].astype(np.int64)
        before = before if one else starts - before
        block = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self._open(level, block))[: self.n - int(starts[block])]
        return int(starts[block]) + int(np.flatnonzero(bits == one)[k - int(before[block])])

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def ids(self) -> np.ndarray:
        """All ids: the planes are merged again from the lowest bit up."""
        values = np.zeros(self.n, np.uint32)
        for level in range(self.bits - 1, -1, -1):
            planes = [self._load(level, b) for b in range(self._per_plane)]
            ones = np.unpackbits(np.concatenate(planes) if planes else np.zeros(0, np.uint8))[: self.n].astype(bool)
            merged, z = np.empty_like(values), int(self.zeros[level])
            merged[~ones] = values[:z]
            merged[ones] = values[z:] | np.uint32(1 << (self.bits - 1 - level))
            values = merged
        return values


def encoded(code: Encoder, texts: pa.Array) -> Iterator[bytes]:
    """Texts' ids in order, encoded in groups of a bounded size (or one text)."""
    group, size = [], 0
    for text in texts:
        group.append(text.as_py())
        size += len(group[-1])
        if size >= GROUP_CHARS:
            yield from code.encode_all(group)
            group, size = [], 0
    yield from code.encode_all(group)


MANIFEST = "part int, seq int, path string, n_docs long, n_tokens long"


def write_shards(docs: DataFrame, tokenizer: str, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Writes the shards to a new shared folder; a row for each, with the number of ids before it.

    A shard holds whole documents and is closed once it has ``shard_tokens`` ids.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark, "wavelet")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    order = ["doc_id", "_hash", "_from"]  # the last parts equal rows
    rows = rows.withColumn("_hash", F.xxhash64("text")).withColumn("_from", F.spark_partition_id())
    ordered = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, attempt = TaskContext.get().partitionId(), 0, TaskContext.get().taskAttemptId()
        code, end = encoder(tokenizer), np.array([END_ID], "<u4").tobytes()
        own: list[tuple[int | None, int]] = []
        held: list[bytes] = []
        total = 0

        def close() -> pa.RecordBatch:
            path = f"{folder}/part-{part:06d}-{seq:06d}-{attempt}.wm"  # only files of the attempt that counts get into the manifest
            with new_file(path) as sink:
                for piece in to_file(np.frombuffer(b"".join(held), "<u4"), own):
                    sink.write(piece)
            return pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "path": [path], "n_docs": [len(own)], "n_tokens": [total]}, schema=kinds)

        kinds = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoded(code, batch.column(1))):
                ids += end
                held.append(ids)
                own.append((doc_id, len(ids) // 4))
                total += len(ids) // 4
                if total >= shard_tokens:
                    yield close()
                    own, held, total, seq = [], [], 0, seq + 1
        if own:
            yield close()

    manifest = stored(ordered.mapInArrow(written, MANIFEST), "wavelet-manifest")
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # as many rows as range partitions
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_tokens")
    return manifest.withColumn("inside", inside).join(parts, "part").select("part", "seq", "path", "n_docs", "n_tokens", (F.col("before") + F.col("inside")).alias("start"))


def read_back(shards: DataFrame) -> DataFrame:
    """A row per document from the files: doc_id, start, n_tokens, and the crc32 of its ids."""
    kinds = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file = Ranges(path)
                shard = WaveletMatrix(file.read)
                ids = shard.ids().astype("<u4")
                file.close()
                ends = shard.ends.tolist()
                begins = [0, *ends[:-1]]
                view = memoryview(ids).cast("B")
                yield pa.RecordBatch.from_pydict({
                    "doc_id": shard.doc_ids, "start": [start + b for b in begins], "n_tokens": [e - b for b, e in zip(begins, ends)],
                    "ids_crc32": [zlib.crc32(view[4 * b : 4 * e]) for b, e in zip(begins, ends)],
                }, schema=kinds)

    n = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return shards.select("path", "start").repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
