"""Exact Jaccard self-join of word n-gram sets, with adaptive multi-match prefixes.

Shingles are ordered from rare to frequent by a count sketch of fixed size.  Two sets with the wanted
overlap o share their first m common shingles within the first n - o + m of either, for any m up to o.  So
a set's prefix may be lengthened from one needed match to l, and then pairs must share correspondingly more
prefix shingles: each set takes the l that its shingles' estimated numbers of holders make cheapest.  A
pair comes up where its first shared shingle may lie, and has to share as many prefix shingles as the
smaller of its two sets' l before it is verified on the texts.

Only components are asked for, so sets that share a shingle are not all paired: equal sets are one node;
each shingle's holders are first verified against the most central of them (the one with the most common
shingles); then the remaining pairs, those that lie in different components, are formed, counted and
verified.  No possible link between components is left out.  Before texts are fetched, pairs meet as bitmaps:
a set's bit is whether an odd number of its shingles fall on a place, so two sets differ in at least as many
shingles as their bitmaps do in bits, and a pair whose bitmaps differ too much can't link.

Defined results: words are runs of other characters than space and \\t-\\r, with A-Z lowered.  A set has
the distinct runs of ``width`` words, or the whole sequence where there are fewer; a null text counts as
empty, has no shingles and links with nothing.  Rows with one doc_id are one document; rows without one get
their n_shingles, no component, and link nothing.  An empty table gives an empty result; other columns are
ignored.  Shingles are compared as 64-bit hashes, and a shingle's holders are told apart by 64-bit hashes of their sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import maybe_in, stored, text_of, with_small_batches
from tallyloom.llm.components import components

WIDTH = 4
PERCENT = 85
SLOTS = 1 << 20  # the count sketch, of 4 MB when broadcast
SLICE = 1 << 10
MOST_MATCHES = 6
VERIFY_COST = 0.25  # of one shingle, against looking at one holder
SEEN_SETS = 100_000
_TOKENS = 1 << 16  # of an output batch, or one set's

_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)  # odd multipliers


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    total = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        total = total * _ODD[k % 4] + hashes[k : k + len(total)]
        total ^= total >> np.uint64(29)
    total.sort()
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


def _texts(docs: DataFrame) -> DataFrame:
    return with_small_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")))


def _counted_sets(docs: DataFrame, width: int, slots: int) -> DataFrame:
    """In one pass: a row for each document (doc_id, n_shingles, the set's digest as node), and each task's
    counts of documents by slot (a hash's low bits), of a fixed size, as rows of (slice, counts)."""
    kinds = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.binary()), ("slice", pa.int32()), ("counts", pa.binary())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(slots, np.int64)
        for batch in batches:
            sizes, nodes = [], []
            for text in batch.column(1):
                own = shingle_set(text.as_py(), width)
                sizes.append(len(own))
                nodes.append(set_digest(own))
                places = (own & np.uint64(slots - 1)).astype(np.int64)
                if len(own) > slots // 8:
                    counts += np.bincount(places, minlength=slots)
                else:
                    np.add.at(counts, places, 1)
            n = len(sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], schema=kinds)
        if counts.any():
            raw = [_narrow(counts[k : k + SLICE]) for k in range(0, slots, SLICE)]
            none = [pa.nulls(len(raw), t) for t in kinds.types[:3]]
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(len(raw)), pa.int32()), pa.array(raw, pa.binary())], schema=kinds)

    return _texts(docs).mapInArrow(made, "doc_id long, n_shingles long, node binary, slice int, counts binary")


def _narrow(counts: np.ndarray) -> bytes:
    """The counts in as few bytes each as the largest one needs."""
    return counts.astype(np.min_scalar_type(counts.max())).tobytes()


def _widened(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"u{len(raw) // SLICE}").astype(np.int64)


def shingle_counts(counted: DataFrame, slots: int) -> np.ndarray:
    """How many documents hold the shingles of each slot; the size is fixed."""
    kinds = pa.schema([("slice", pa.int32()), ("counts", pa.binary())])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                found[k] = found.get(k, 0) + _widened(raw.as_py())
        yield pa.RecordBatch.from_pydict({"slice": list(found), "counts": [_narrow(x) for x in found.values()]}, schema=kinds)

    parts = counted.filter("slice is not null").select("slice", "counts").repartition("slice").mapInArrow(summed, "slice int, counts binary")
    out = np.zeros(slots, np.int64)
    for k, raw in parts.collect():  # slots / SLICE rows, whatever the input
        out[k * SLICE : (k + 1) * SLICE] = _widened(bytes(raw))
    return np.minimum(out, np.iinfo(np.uint32).max).astype(np.uint32)


def prefix(own: np.ndarray, counts: np.ndarray, usual: float, percent: int = PERCENT) -> tuple[np.ndarray, int, float]:
    """(the set's rarest shingles in order, the matches to ask for, how common its shingles are)."""
    n = len(own)
    held = counts[(own & np.uint64(len(counts) - 1)).astype(np.int64)]
    least = -(-percent * n // 100)
    most = max(1, min(MOST_MATCHES, least))
    order = np.argsort(held, kind="stable")[: n - least + most]
    others = np.cumsum(np.maximum(held[order] - usual, 0.0))[n - least :]
    matches = np.arange(1, most + 1)
    wanted = int(np.argmin(others * (1 + VERIFY_COST * n / matches))) + 1
    return own[order[: n - least + wanted]], wanted, float(np.log(held).mean())


def set_digest(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


PREFIX = "token long, node binary, pos int, matches int, common float"


def _prefixes(docs: DataFrame, counts: np.ndarray, width: int, percent: int) -> DataFrame:
    """A row for each prefix shingle of each set, under 64 bits of the set's digest; the first row has what holds for
    the whole set (matches, common).  A task leaves out sets that it has just given."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((counts, float(np.median(counts))))
    kinds = pa.schema([("token", pa.int64()), ("node", pa.binary()), ("pos", pa.int32()), ("matches", pa.int32()), ("common", pa.float32())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, usual = shared.value
        seen: set[bytes] = set()
        for batch in batches:
            tokens, rows, size = [], [], 0
            for text in batch.column(0):
                own = shingle_set(text.as_py(), width)
                node = set_digest(own)
                if not len(own) or node in seen:
                    continue
                if len(seen) >= SEEN_SETS:
                    seen.clear()
                seen.add(node)
                first, matches, common = prefix(own, counts, usual, percent)
                tokens.append(first.view(np.int64))
                rows.append((node, matches, common))
                size += len(first)
                if size >= _TOKENS:
                    yield batch_of(tokens, rows)
                    tokens, rows, size = [], [], 0
            if rows:
                yield batch_of(tokens, rows)

    def batch_of(tokens: list[np.ndarray], rows: list[tuple]) -> pa.RecordBatch:
        sizes = np.array([len(t) for t in tokens])
        which = np.repeat(np.arange(len(rows)), sizes)
        pos = np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])
        nodes, matches, common = (pa.array(c, kinds.field(k).type) for c, k in zip(zip(*rows), ("node", "matches", "common")))
        once = pa.array(which, mask=pos > 0)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), nodes.take(pa.array(which)), pa.array(pos), matches.take(once), common.take(once)], schema=kinds)

    texts = _texts(docs.filter("doc_id is not null")).select("text")
    return texts.mapInArrow(made, PREFIX).select("token", _short("node"), "pos", "matches", "common")


def _short(node: str) -> Column:
    return F.xxhash64(node).alias("short")


def _need(percent: int) -> str:
    """The overlap that sets a and b need."""
    return f"(({percent} * (a.n + b.n) + {99 + percent}) div {100 + percent})"


def _possible(percent: int) -> str:
    """Whether a shared shingle at these places may be the first that a and b share, if they link."""
    need = _need(percent)
    return f"{percent} * greatest(a.n, b.n) <= 100 * least(a.n, b.n) and a.pos <= a.n - {need} and b.pos <= b.n - {need}"


def _enough(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(x, y)`` whose prefixes share as many shingles as the smaller of their matches asks for."""
    need = _need(percent)
    m = f"least(a.matches, b.matches, {need})"
    part = lambda s: f"filter({s}.tokens, (t, i) -> {s}.places[i] < {s}.n - {need} + {m})"
    a, b = held.alias("a"), held.alias("b")
    both = pairs.alias("p").join(a, F.expr("p.x = a.id")).join(b, F.expr("p.y = b.id"))
    return both.filter(F.expr(f"size(array_intersect({part('a')}, {part('b')})) >= {m}")).select("x", "y")


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The texts of documents in ``ids(id)``, and of a few others."""
    return maybe_in(_texts(docs), F.col("doc_id"), ids.select(F.col("id").alias("key"))).filter("_in").select("doc_id", "text")


def parities(own: np.ndarray) -> np.ndarray:
    """A bitmap of two to four bits a shingle: whether the number of shingles with a place's low bits is odd."""
    size = 1 << max(6, (2 * len(own) - 1).bit_length())
    return np.packbits(np.bincount((own & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1)


def may_link(n: int, bits: np.ndarray, other_n: int, other_bits: np.ndarray, percent: int = PERCENT) -> bool:
    """False only for sets that don't link; the longer bitmap is folded to the length of the other."""
    while len(bits) != len(other_bits):
        if len(bits) < len(other_bits):
            bits, other_bits = other_bits, bits
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    least = -(-percent * (n + other_n) // (100 + percent))
    return int(np.bitwise_count(bits ^ other_bits).sum()) <= n + other_n - 2 * least


def _bitmaps(texts: DataFrame, width: int) -> DataFrame:
    kinds = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("bits", pa.binary())])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text.as_py(), width) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array([parities(s).tobytes() for s in sets], pa.binary())], schema=kinds)

    return texts.mapInArrow(made, "id long, n long, bits binary")


def _close(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``pairs(x, y)`` without those that can't link by their bitmaps."""
    kinds = pa.schema([("x", pa.int64()), ("y", pa.int64())])

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4).to_pylist(), batch.column(5))
            bits = lambda raw: np.frombuffer(raw.as_py(), np.uint8)
            keep = pa.array([may_link(n, bits(raw), m, bits(other), percent) for n, raw, m, other in sides], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], schema=kinds)

    ids = pairs.select(F.explode(F.array("x", "y")).alias("id"))
    bitmaps = stored(_bitmaps(_texts_of(docs, ids), width), "bitmaps")
    a, b = (bitmaps.select(F.col("id").alias(k), F.col("n").alias(f"n_{k}"), F.col("bits").alias(f"bits_{k}")) for k in "xy")
    both = pairs.join(b, "y").join(a, "x").select("x", "y", "n_x", "bits_x", "n_y", "bits_y")
    return with_small_batches(both).mapInArrow(checked, "x long, y long").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs(x, y)`` that link; x is the side that more pairs share."""
    kinds = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[str, np.ndarray] = ("", np.zeros(0, np.uint64))
        for batch in batches:
            u, v = [], []
            for x, y, left, right in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if (text := left.as_py()) != last[0]:
                    last = (text, shingle_set(text, width))
                a, b = last[1], shingle_set(right.as_py(), width)
                both = len(np.intersect1d(a, b, assume_unique=True))
                if both and 100 * both >= percent * (len(a) + len(b) - both):
                    u.append(x)
                    v.append(y)
            yield pa.RecordBatch.from_pydict({"u": u, "v": v}, schema=kinds)

    pairs = stored(_close(stored(pairs, "pairs"), docs, width, percent), "close")
    texts = _texts_of(docs, pairs.select(F.explode(F.array("x", "y")).alias("id")))
    right = pairs.join(texts.select(F.col("doc_id").alias("y"), F.col("text").alias("right")), "y")
    both = right.join(texts.select(F.col("doc_id").alias("x"), F.col("text").alias("left")), "x")
    return both.select("x", "y", "left", "right").mapInArrow(checked, "u long, v long").distinct()


def join(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """A row per document: doc_id, n_shingles, and component_id, the smallest doc_id that links reach."""
    counted = stored(_counted_sets(docs, width, SLOTS), "sets")
    sets = counted.filter("slice is null").select("doc_id", "n_shingles", "node")
    known = sets.filter("doc_id is not null and n_shingles > 0")
    nodes = stored(known.groupBy("node").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n")), "nodes")

    by_token = Window.partitionBy("token")
    several = F.min("short").over(by_token) != F.max("short").over(by_token)
    rows = _prefixes(docs, shingle_counts(counted, SLOTS), width, percent).repartition("token")
    rows = rows.withColumn("several", several).filter("several or pos = 0").repartition("short")
    whole = F.sort_array(F.collect_set(F.when(F.col("several"), F.struct("pos", "token")))).alias("held")
    held = rows.groupBy("short").agg(whole, F.min("matches").alias("matches"), F.max("common").alias("common")).filter("size(held) > 0")
    held = held.join(nodes.select(_short("node"), "id", "n"), "short")
    held = stored(held.select("id", "n", "matches", "common", F.col("held.token").alias("tokens"), F.col("held.pos").alias("places")), "held")

    # Where a set's first shared shingle may lie; the places beyond only count.
    first_places = f"filter(arrays_zip(tokens, places), h -> h.places <= n - ({percent} * n + 99) div 100)"
    shared = held.select("id", "n", "common", F.explode(F.expr(first_places)).alias("h"))
    shared = shared.select(F.col("h.tokens").alias("token"), "id", "n", F.col("h.places").alias("pos"), "common")
    central = F.first(F.struct("id", "n", "pos")).over(by_token.orderBy(F.desc("common"), "id"))
    near = shared.select(F.struct("id", "n", "pos").alias("a"), central.alias("b")).filter("a.id <> b.id").filter(_possible(percent))
    near = _enough(near.select(F.col("b.id").alias("x"), F.col("a.id").alias("y")).distinct(), held, percent)
    # Documents with one id in several sets are one.
    same = known.join(nodes, "node").groupBy("doc_id").agg(F.min("id").alias("u"), F.max("id").alias("v")).filter("u <> v").select("u", "v")
    first = stored(components(_verified(near, docs, width, percent).unionByName(same)), "components")

    placed = held.join(first, "id", "left").select("id", "n", F.coalesce("component", "id").alias("component"), F.explode(F.expr(first_places)).alias("h"))
    placed = placed.select(F.col("h.tokens").alias("token"), "id", "n", F.col("h.places").alias("pos"), "component")
    apart = F.min("component").over(by_token) != F.max("component").over(by_token)
    placed = stored(placed.withColumn("apart", apart).filter("apart").drop("apart"), "placed")
    a, b = placed.alias("a"), placed.alias("b")
    rest = a.join(b, F.expr(f"a.token = b.token and a.component < b.component and {_possible(percent)}"))
    rest = _enough(rest.select(F.col("a.id").alias("x"), F.col("b.id").alias("y")).distinct(), held, percent)
    late = _verified(rest, docs, width, percent)

    edges = first.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(late)
    linked = stored(components(edges), "components")
    groups = nodes.join(linked, "id", "left").select("node", F.coalesce("component", "id").alias("component_id"))
    ids = sets.join(stored(groups, "groups"), "node", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return ids.select("doc_id", "n_shingles", own.alias("component_id"))


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The documents, with all their columns, without those that link with a smaller doc_id, and without repeats of an id.

    Rows without a doc_id or without shingles stay.  Only rows that a bitmap can't clear are shuffled.
    """
    found = stored(join(docs, width, percent).filter("doc_id is not null and n_shingles > 0"), "joined")
    state = found.groupBy("doc_id").agg(F.min("component_id").alias("_group"), F.count("*").alias("_rows"))
    doubtful = stored(state.filter("_group <> doc_id or _rows > 1"), "doubtful")
    marked = maybe_in(docs, F.col("doc_id").cast("long"), doubtful.select(F.col("doc_id").alias("key")))
    clear, rest = marked.filter("not _in").select(*docs.columns), marked.filter("_in")
    gone = doubtful.select(F.col("doc_id").alias("_id"), "_group")
    rest = rest.withColumn("_id", F.col("doc_id").cast("long")).join(gone, "_id", "left")
    order = F.row_number().over(Window.partitionBy("_id").orderBy(F.col("text").desc_nulls_last()))
    rest = rest.withColumn("_r", order).filter("_group is null or (_group = _id and _r = 1)")
    return clear.unionByName(rest.select(*docs.columns))
