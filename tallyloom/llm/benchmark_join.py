"""Benchmark passages in documents: a prefix-filtered join of item windows with texts, verified word by word.

A window is a run of so many item words (the whole item if it has fewer).  Each window is the set of its word
shingles; since all of them have to be in a document, a prefix of one shingle is enough to find it, and the
rarest is taken.  The work runs in two passes over the texts:

1. Shingles of windows are counted in all documents.  A window with a shingle that never comes can't occur.
2. Only places of the windows' rarest shingles leave the scan, each with the words around it.  They meet the
   prefixes by shingle; bounds of position and length leave those windows that fit into the text, and the words
   there have to equal a window's.  Candidates are joined by equality only, never paired within a group.

A bitmap of bounded size over shingle names is sent to the scans, which spares all others the shuffle; it only
says "maybe", and joins by name and by words decide.  Names are 64-bit hashes; equality of words is exact.

Defined results: null and empty texts have no words and no hit; an item without words gives no window; items
without an id are hit but not listed; items that share an id are one; each row of documents gives a row, also
where ids repeat or are null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm.common import stored

WINDOW, SHINGLE = 10, 5
BLOCK = 1 << 20  # bytes of text that are taken apart at once
LEAST_BITS, MOST_BITS = 20, 28  # the bitmap has 2^20 to 2^28 places (32 MB), 32 for each shingle if it may
BROADCAST_BYTES = 16 << 20
SALTS = 32

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_BASE = 0x9E3779B97F4A7C15
_STEP = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base modulo 2^64, and their inverses."""
    power = lambda b: np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)]))
    return power(_BASE), power(pow(_BASE, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def words(lowered: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and names of the words of bytes in lower case; long input goes in blocks that end between words."""
    out, at = [], 0
    while at < len(lowered):
        end = min(len(lowered), at + BLOCK)
        inside = _IS_WORD[lowered[at:end]]
        if end < len(lowered) and inside[-1]:
            gap = np.flatnonzero(~inside)
            if gap.size:
                end = at + int(gap[-1]) + 1
            else:  # a word longer than the block
                gap = np.flatnonzero(~_IS_WORD[lowered[end:]])
                end = end + int(gap[0]) if gap.size else len(lowered)
            inside = _IS_WORD[lowered[at:end]]
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        power, inverse = _powers(max(BLOCK, 1 << (end - at - 1).bit_length()))
        run = np.zeros(end - at + 1, np.uint64)
        np.cumsum((lowered[at:end].astype(np.uint64) + np.uint64(1)) * power[: end - at], out=run[1:])
        out.append((starts + at, ends + at, _mixed((run[ends] - run[starts]) * inverse[starts])))
        at = end
    none = np.zeros(0, np.int64)
    return tuple(map(np.concatenate, zip(*out))) if out else (none, none, none.astype(np.uint64))


def shingles(names: np.ndarray, size: int) -> np.ndarray:
    """A name for each run of ``size`` words."""
    n = max(0, len(names) - size + 1)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = out * _STEP + names[k : k + n]
    return _mixed(out)


def _slices(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Rows of together up to BLOCK bytes, or one longer row."""
    at = size = 0
    for k, t in enumerate(texts):
        n = len(t or b"") + 1
        if k > at and size + n > BLOCK:
            yield at, k
            at, size = k, 0
        size += n
    if at < len(texts):
        yield at, len(texts)


class _Rows:
    """The words of several texts, in order."""

    def __init__(self, texts: list[bytes | None]):
        self.data = _LOWER[np.frombuffer(b"\n".join(t or b"" for t in texts), np.uint8)]
        self.starts, self.ends, self.names = words(self.data)
        heads = np.concatenate([[0], np.cumsum([len(t or b"") + 1 for t in texts])])
        self.first = np.searchsorted(self.starts, heads)  # each text's first word, and the end
        self.row = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, name) of those that lie within one text."""
        names = shingles(self.names, size)
        at = np.flatnonzero(self.row[: len(names)] == self.row[size - 1 :][: len(names)])
        return at, names[at]

    def text(self, first: int, end: int) -> str:
        """Words first to end with single blanks."""
        raw = self.data.tobytes() if not hasattr(self, "_raw") else self._raw
        self._raw = raw
        return b" ".join(raw[s:e] for s, e in zip(self.starts[first:end], self.ends[first:end])).decode("utf-8", "replace")


def _texts(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    return batch.column(column).cast(pa.binary()).to_pylist()


def windows(items: DataFrame, width: int = WINDOW, size: int = SHINGLE) -> DataFrame:
    """(item_id string, words, n, size, names of its shingles in order) for each window of ``items(item_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("item_id").to_pylist(), _texts(batch, "text")
            for a, b in _slices(texts):
                rows, out = _Rows(texts[a:b]), []
                for k in range(b - a):
                    first, end = int(rows.first[k]), int(rows.first[k + 1])
                    n = min(width, end - first)
                    of = min(size, n)
                    names = shingles(rows.names[first:end], of).view(np.int64) if n else ()
                    for at in range(first, end - n + 1 if n else first):
                        out.append((ids[a + k], rows.text(at, at + n), n, of, names[at - first : at - first + n - of + 1].tolist()))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], names=["item_id", "words", "n", "size", "names"])

    types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
    rows = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "item_id string, words string, n int, size int, names array<long>")


class Bitmap:
    """Which names may be among given ones, sent to the tasks once."""

    def __init__(self, names: DataFrame, spark: SparkSession):
        self.bits = min(MOST_BITS, max(LEAST_BITS, (32 * names.count()).bit_length()))
        place = F.shiftrightunsigned("name", 64 - self.bits)
        parts = names.select(place.alias("p")).groupBy(F.expr("p div 32768").alias("k")).agg(F.expr("bitmap_construct_agg(p % 32768)").alias("b"))
        held = np.zeros((1 << self.bits) // 8, np.uint8)
        for k, part in parts.toLocalIterator():  # as many bytes as the bitmap has, at most
            held[k * 4096 : (k + 1) * 4096] = np.frombuffer(part, np.uint8)
        self.held = spark.sparkContext.broadcast(held)

    def among(self, names: np.ndarray) -> np.ndarray:
        place = names >> np.uint64(64 - self.bits)
        return (self.held.value[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def rarity(docs: DataFrame, names: DataFrame, sizes: list[int]) -> DataFrame:
    """(name, n): how often each shingle of ``names(name)`` comes in the texts, and some others' counts."""
    known = Bitmap(names, docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _texts(batch, "text")
            for a, b in _slices(texts):
                rows = _Rows(texts[a:b])
                found = [name[known.among(name)] for _, name in map(rows.shingles, sizes)]
                name, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(n.astype(np.int64))], names=["name", "n"])

    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "name long, n long").groupBy("name").agg(F.sum("n").alias("n"))


def places(docs: DataFrame, names: DataFrame, sizes: list[int], width: int) -> DataFrame:
    """For each document a row (key, doc_id, n_words), and one (key, n_words, pos, name, first, around) for each
    place of a shingle that may be among ``names(name)``: ``around`` are the words from ``first`` on that a
    window over the place could have.  ``key`` is a row's own."""
    known = Bitmap(names, docs.sparkSession)
    kind = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("pos", pa.int64()), ("name", pa.int64()), ("first", pa.int64()), ("around", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 36
        for batch in batches:
            ids, texts = batch.column("doc_id"), _texts(batch, "text")
            for a, b in _slices(texts):
                rows, n = _Rows(texts[a:b]), b - a
                lengths = np.diff(rows.first)
                empty = [pa.nulls(n, t) for t in kind.types[3:]]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(key, key + n)), ids.slice(a, n), pa.array(lengths), *empty], schema=kind)
                for size in sizes:
                    at, name = rows.shingles(size)
                    met = known.among(name)
                    at, name = at[met], name[met]
                    row = rows.row[at]
                    low, high = np.maximum(rows.first[row], at - (width - size)), np.minimum(rows.first[row + 1], at + width)
                    for c in range(0, len(at), 4096):
                        p = slice(c, c + 4096)
                        around = [rows.text(x, y) for x, y in zip(low[p], high[p])]
                        start = rows.first[row[p]]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(key + row[p]), pa.nulls(len(around), pa.int64()), pa.array(lengths[row[p]]), pa.array(at[p] - start), pa.array(name[p].view(np.int64)), pa.array(low[p] - start), pa.array(around, pa.string())],
                            schema=kind,
                        )
                key += n

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "key long, doc_id long, n_words long, pos long, name long, first long, around string")


def _bytes(rows: DataFrame) -> Column:
    size = F.lit(16)
    for c, kind in rows.dtypes:
        size = size + (F.octet_length(c) if kind == "string" else F.lit(16) * F.size(c) if kind.startswith("array") else F.lit(8))
    return F.coalesce(F.sum(size), F.lit(0))


def met(many: DataFrame, few: DataFrame, key: str, spread: Column) -> DataFrame:
    """An inner join by one key, of which ``few`` has one row each: broadcast if its measured size allows, or else
    salted by ``spread``, so that rows of a frequent key are dealt to SALTS tasks."""
    if few.agg(_bytes(few)).first()[0] <= BROADCAST_BYTES:
        return many.join(F.broadcast(few), key)
    salted = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return many.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(salted, [key, "_salt"]).drop("_salt")


def occurrences(docs: DataFrame, items: DataFrame, width: int = WINDOW, size: int = SHINGLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, occurrences, windows): (key, doc_id, n_words); (key, start, n, window); (window, item_id)."""
    own = stored(windows(items, width, size), "item-windows")
    sizes = sorted(r[0] for r in own.select("size").distinct().collect())  # 1 to ``size``
    kinds = stored(own.groupBy("words").agg(F.first("n").alias("n"), F.first("size").alias("size"), F.first("names").alias("names")).withColumn("window", F.monotonically_increasing_id()), "windows")
    listed = kinds.select("words", "window").join(own.select("words", "item_id").filter("item_id is not null"), "words").select("window", "item_id").distinct()
    parts = kinds.select("words", "window", "n", F.posexplode("names").alias("offset", "name"))
    counts = rarity(docs, parts.select("name").distinct(), sizes)
    # No shingle of a window may be missing; the rarest is its prefix.
    least = parts.join(counts.withColumnRenamed("n", "often"), "name", "left").groupBy("window", "n").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "name", "offset")).alias("p"))
    prefix = stored(least.filter("p.often > 0").select("window", "n", "p.name", "p.offset"), "prefixes")
    fits = stored(prefix.groupBy("name").agg(F.collect_set(F.struct("offset", "n")).alias("fits")), "fits")  # at most width^2 for each name
    seen = stored(places(docs, fits.select("name"), sizes, width), "places")
    near = met(seen.filter("pos is not null"), fits, "name", F.struct("key", "pos")).withColumn("fit", F.explode("fits"))
    near = near.withColumn("start", F.col("pos") - F.col("fit.offset")).filter("start >= first and start + fit.n <= n_words")
    at = near.select("key", "start", F.col("fit.n").alias("n"), F.array_join(F.slice(F.split("around", " "), (F.col("start") - F.col("first") + 1).cast("int"), F.col("fit.n")), " ").alias("words"))
    live = kinds.join(prefix.select("window"), "window").select("words", "window")
    found = met(at, live, "words", F.struct("key", "start")).select("key", "start", "n", "window")
    return seen.filter("pos is null").select("key", "doc_id", "n_words"), found, listed


def leaks(docs: DataFrame, items: DataFrame, width: int = WINDOW, size: int = SHINGLE) -> DataFrame:
    """(doc_id, n_words, n_hit, spans, item_ids) for each row of ``docs(doc_id, text)``.

    ``spans`` are the first word and the end of each occurrence of a window of ``items(item_id, text)``, in order;
    ``n_hit`` counts the words in any of them; ``item_ids`` are the sorted ids of items with an occurring window.
    """
    base, found, listed = occurrences(docs, items, width, size)
    spans = F.sort_array(F.collect_set(F.struct(F.col("start"), (F.col("start") + F.col("n")).alias("end"))))
    each = found.groupBy("key").agg(spans.alias("spans"), F.sort_array(F.collect_set("window")).alias("windows"))
    each = stored(each.withColumn("set", F.sha2(F.array_join("windows", ","), 256)), "hits")
    # Documents with the same windows have the same items: each set of windows is looked up once.
    sets = each.groupBy("set").agg(F.first("windows").alias("windows"))
    named = sets.select("set", F.explode("windows").alias("window")).join(listed, "window").groupBy("set").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    none = F.array().cast("array<string>")
    named = stored(sets.select("set").join(named, "set", "left").select("set", F.coalesce("item_ids", none).alias("item_ids")), "sets")
    hit = met(each.drop("windows"), named, "set", F.col("key")).drop("set")
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("upto"))
    covered = F.aggregate("spans", zero, lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["upto"]))).alias("n"), F.greatest(a["upto"], s["end"]).alias("upto")))["n"]
    out = base.join(hit, "key", "left")
    no_spans = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return out.select("doc_id", "n_words", F.coalesce(covered, F.lit(0)).cast("long").alias("n_hit"), F.coalesce("spans", no_spans).alias("spans"), F.coalesce("item_ids", none).alias("item_ids"))
