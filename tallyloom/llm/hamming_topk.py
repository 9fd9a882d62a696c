"""Exact top-k search over binary codes by incremental multi-index hashing.

A vector's code has a bit per dimension: 1 where it is above 0.  Codes are cut into m segments of about
log2(rows) bits, and one index over all rows leads from (segment, its value) to the codes with it.  A query
looks up all values at a radius from its own, in every segment; then the radius grows by one.  Once radius r
is done, every code within distance m * (r + 1) - 1 has been found and verified, so a query is finished when
its k-th smallest verified distance is no larger.  Each radius is one Spark job over the queries that are
still open, and none of their later candidates beyond the k-th distance so far is kept.

The index is dealt to cells by segment and the value's high bits, some CELL_ROWS rows each, and a cell is one
packed row, sorted by its low bits.  The cells are partitioned and sorted once and checkpointed so; a round
sends queries alone to them: to the cells whose high bits lie within the radius, where low bits are looked up.
A cell with more rows or queries (a common segment value) is split by hashes of both, so no task holds more
than one split of a cell and its queries.  Codes with many rows keep the k + 1 smallest ids, which is all that
a result can show.  Vectors of a length that so few ids have that k others may not be found (2k at most) are
compared with all codes of their length in the first round, which gives the same result as growing the radius.

Defined results: neighbours are other rows, by distance and then id; rows with a null or empty vector, a
null element, or a null id are neither queries nor neighbours; NaN gives bit 0; rows that repeat an id count
once per distinct code; vectors of different lengths are compared only with their like; fewer than k other
rows give fewer neighbours.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import checkpointed, stored, with_small_batches

K = 10
QUERY_EVERY = 20
LEAST_BITS, MOST_BITS = 6, 30  # of a segment
CELL_ROWS = 1 << 13
CELL_QUERIES = 1 << 16
CHUNK = 1 << 20  # look-ups or candidates at once

def codes(vectors: DataFrame) -> DataFrame:
    """(vec_id, n_bits, code): the bits, packed from the first dimension on, to whole 64-bit words."""

    def coded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            bits = [np.packbits(np.asarray(v, np.float32) > 0).tobytes() for v in frame["embedding"]]
            yield pd.DataFrame({"vec_id": frame["vec_id"], "n_bits": frame["embedding"].map(len), "code": [b + bytes(-len(b) % 8) for b in bits]})

    whole = "vec_id is not null and size(embedding) > 0 and not exists(embedding, x -> x is null)"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")).filter(whole)
    return rows.mapInPandas(coded, "vec_id long, n_bits int, code binary")


def bounds(n_bits: int, width: int) -> list[tuple[int, int]]:
    """The segments' first bits and ends."""
    m = math.ceil(n_bits / width)
    return [(k * n_bits // m, (k + 1) * n_bits // m) for k in range(m)]


def _values(packed: np.ndarray, n_bits: int, width: int) -> np.ndarray:
    """A column of values for each segment."""
    bits = np.unpackbits(packed, axis=1)[:, :n_bits].astype(np.int64)
    return np.stack([bits[:, a:b] @ (1 << np.arange(b - a - 1, -1, -1)) for a, b in bounds(n_bits, width)], axis=1)


@lru_cache(maxsize=1024)
def _masks(width: int, radius: int) -> np.ndarray:
    """All differences of a value's bits at a distance."""
    return np.array([sum(1 << i for i in c) for c in combinations(range(width), radius)], np.int64)


def _segments(rows: DataFrame, width: int, high: int, radius: int | None = None) -> DataFrame:
    """Adds a row for each segment: its number, its width, its value and the value's high bits.

    With a ``radius`` there is a row for all high bits up to so far away, and rest, what is left of the radius for low
    bits; rows marked ``few`` get all high bits, and no radius (-1).
    """
    names = rows.columns
    kinds = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", segment int, width int, value long, high long, rest int"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(names.index("n_bits")).to_numpy()
            few = batch.column(names.index("few")).to_numpy(zero_copy_only=False) if "few" in names else np.zeros(len(sizes), bool)
            for n_bits, scan in sorted(set(zip(sizes.tolist(), few.tolist()))):
                at = np.flatnonzero((sizes == n_bits) & (few == scan))
                own = batch.take(pa.array(at))
                packed = np.frombuffer(b"".join(own.column(names.index("code")).to_pylist()), np.uint8).reshape(len(at), -1)
                values = _values(packed, n_bits, width)
                for k, (a, b) in enumerate(bounds(n_bits, width)):
                    top = min(high, b - a)  # short segments have fewer high bits
                    more = [pa.array(np.full(len(at), k, np.int32)), pa.array(np.full(len(at), b - a, np.int32)), pa.array(values[:, k])]
                    for r in range(top + 1 if scan else min(radius or 0, top) + 1):
                        rest = pa.array(np.full(len(at), -1 if scan else (radius or 0) - r, np.int32))
                        for mask in _masks(top, r):
                            away = pa.array((values[:, k] >> (b - a - top)) ^ mask)
                            yield pa.RecordBatch.from_arrays([*own.columns, *more, away, rest], names=[*names, "segment", "width", "value", "high", "rest"])

    return rows.mapInArrow(cut, kinds)


class Cell:
    """One split of an index cell: codes by the low bits of their segment."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, words: np.ndarray, low: int):
        keys = values & (1 << low) - 1
        order = np.argsort(keys, kind="stable")
        self.ids, self.keys, self.words, self.low = ids[order], keys[order], words[order], low

    @classmethod
    def unpacked(cls, ids: bytes, keys: bytes, words: bytes, low: int) -> Cell:
        """A cell as :func:`_packed` has sorted it."""
        cell = cls.__new__(cls)
        cell.ids, cell.keys, cell.low = np.frombuffer(ids, np.int64), np.frombuffer(keys, np.int64), low
        cell.words = np.frombuffer(words, np.uint64).reshape(len(cell.ids), -1)
        return cell

    def _ranges(self, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(self.keys, probes, "left"), np.searchsorted(self.keys, probes, "right")

    def search(self, own: np.ndarray, values: np.ndarray, words: np.ndarray, limit: np.ndarray, radius: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, row id, distance): each query's k nearest other ids among the codes at a radius of its low bits,
        or of all where the radius is negative."""
        out = [(np.zeros(0, np.int64),) * 3]
        masks = _masks(self.low, radius) if radius >= 0 else np.zeros(1, np.int64)
        step = max(1, CHUNK // max(1, len(masks)))
        for at in range(0, len(own), step):
            probes = (values[at : at + step, None] & (1 << self.low) - 1) ^ masks[None, :]
            begin, end = self._ranges(probes) if radius >= 0 else (np.zeros_like(probes), np.full_like(probes, len(self.ids)))
            many = (end - begin).sum(axis=1)
            parts = np.flatnonzero(np.diff(np.cumsum(many) // CHUNK, prepend=-1, append=-1))  # not many more than CHUNK candidates at once
            for a, b in zip(parts, [*parts[1:], len(many)]):
                out.append(self._nearest(at + a, begin[a:b], end[a:b], own, words, limit, k))
        return tuple(np.concatenate(x) for x in zip(*out))

    def _nearest(self, first: int, begin: np.ndarray, end: np.ndarray, own: np.ndarray, words: np.ndarray, limit: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        some = begin < end
        counts = (end - begin)[some]
        query = np.repeat(np.nonzero(some)[0] + first, counts)
        row = np.arange(len(query)) + np.repeat(begin[some] - (np.cumsum(counts) - counts), counts)
        dist = sum(np.bitwise_count(self.words[row, w] ^ words[query, w]).astype(np.int64) for w in range(words.shape[1]))
        ids = self.ids[row]
        good = np.flatnonzero((dist <= limit[query]) & (ids != own[query]))
        query, ids, dist = query[good], ids[good], dist[good]
        order = np.lexsort((dist, ids, query))  # an id's nearest code counts
        query, ids, dist = query[order], ids[order], dist[order]
        fresh = np.ones(len(query), bool)
        fresh[1:] = (query[1:] != query[:-1]) | (ids[1:] != ids[:-1])
        query, ids, dist = query[fresh], ids[fresh], dist[fresh]
        order = np.lexsort((ids, dist, query))
        query, ids, dist = query[order], ids[order], dist[order]
        starts = np.flatnonzero(np.diff(query, prepend=-1))
        rank = np.arange(len(query)) - np.repeat(starts, np.diff(starts, append=len(query)))
        return query[rank < k], ids[rank < k], dist[rank < k]


CELL = ["n_bits", "segment", "high", "part", "turn"]


def _packed(rows: DataFrame, high: int) -> DataFrame:
    """A row for each cell of ``rows``, which are sorted by CELL: its ids, low bits and codes, in the order of low bits."""
    kinds = "n_bits int, segment int, high long, part int, turn int, low int, ids binary, keys binary, words binary"

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            marks = np.stack([batch.column(n).to_numpy().astype(np.int64) for n in CELL], axis=1)
            starts = np.flatnonzero(np.any(np.diff(marks, axis=0, prepend=-9), axis=1))
            for a, b in zip(starts, [*starts[1:], len(marks)]):
                if key is not None and key != tuple(marks[a].tolist()):
                    yield row_of(key, held)
                    held = []
                key = tuple(marks[a].tolist())
                words = np.frombuffer(b"".join(batch.column("code")[a:b].to_pylist()), np.uint64).reshape(b - a, -1)
                held.append((batch.column("vec_id").to_numpy()[a:b], batch.column("value").to_numpy()[a:b], words, int(batch.column("width")[int(a)].as_py())))
        if key is not None:
            yield row_of(key, held)

    def row_of(key: tuple, held: list[tuple]) -> pa.RecordBatch:
        low = max(0, held[0][3] - high)
        cell = Cell(*(np.concatenate(x) for x in list(zip(*held))[:3]), low)
        numbers = [pa.array([x], t) for x, t in zip((*key, low), (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))]
        raw = [pa.array([x.tobytes()], pa.binary()) for x in (cell.ids, cell.keys, cell.words)]
        return pa.RecordBatch.from_arrays([*numbers, *raw], names=[*CELL, "low", "ids", "keys", "words"])

    return rows.mapInArrow(packed, kinds)


def _look_up(cells: DataFrame, k: int) -> DataFrame:
    """``cells``: packed cells, each with its queries as a list ``asked``; candidates (query, vec_id, distance)."""
    kinds = pa.schema([("query", pa.int64()), ("vec_id", pa.int64()), ("distance", pa.int64())])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                cell = Cell.unpacked(*(batch.column(n)[i].as_py() for n in ("ids", "keys", "words", "low")))
                asked = batch.column("asked")[i].values
                names, own, values, limits, radius = (asked.field(n).to_numpy() for n in ("query", "query_id", "value", "limit", "rest"))
                words = np.frombuffer(b"".join(asked.field("code").to_pylist()), np.uint64).reshape(len(names), -1)
                for r in np.unique(radius).tolist():
                    if r <= cell.low:
                        at = np.flatnonzero(radius == r)
                        query, ids, dist = cell.search(own[at], values[at], words[at], limits[at], r, k)
                        yield pa.RecordBatch.from_arrays([pa.array(names[at][query]), pa.array(ids), pa.array(dist)], schema=kinds)

    return with_small_batches(cells.select("low", "ids", "keys", "words", "asked")).mapInArrow(searched, "query long, vec_id long, distance long")


def _spread(name: str, cells: str) -> Column:
    """Which of so many splits a row belongs to."""
    return F.pmod(F.xxhash64(name, F.lit(7)), F.col(cells)).cast("int")


def top_k(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY) -> DataFrame:
    """(query_id, rank, vec_id, distance) for every row whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = stored(codes(vectors).distinct(), "codes")
    by_code = Window.partitionBy("n_bits", "code").orderBy("vec_id")
    rare = rows.withColumn("r", F.row_number().over(by_code)).filter(F.col("r") <= k + 1).drop("r")
    sizes = rows.groupBy("n_bits").agg(F.count("*").alias("n"), F.approx_count_distinct("vec_id").alias("ids"))  # a row for each length of vectors
    n = rows.count()
    width = min(MOST_BITS, max(LEAST_BITS, round(math.log2(max(2, n)))))
    high = min(width, max(0, math.ceil(math.log2(max(1, n / CELL_ROWS)))))

    index = stored(_segments(rare, width, high).drop("rest"), "index")
    few = sizes.filter(F.col("ids") <= 2 * k).select("n_bits").withColumn("few", F.lit(True))  # too few to wait for k of them
    queries = rows.filter(F.col("vec_id") % every == 0).join(F.broadcast(few), "n_bits", "left")
    queries = queries.select(F.monotonically_increasing_id().alias("query"), F.col("vec_id").alias("query_id"), "n_bits", "code", F.coalesce("few", F.lit(False)).alias("few"))
    queries = stored(queries, "queries")
    parts = _segments(queries.select("query", "n_bits", "code"), width, high)
    where = ["n_bits", "segment", "high"]
    cells = index.groupBy(where).agg(F.count("*").alias("rows")).join(parts.groupBy(where).agg(F.count("*").alias("asked")), where, "left")
    cells = cells.select(*where, F.ceil(F.col("rows") / (2 * CELL_ROWS)).cast("int").alias("parts"), F.ceil(F.coalesce("asked", F.lit(1)) / CELL_QUERIES).cast("int").alias("turns"))
    cells = stored(cells, "cells")
    part = F.when(F.col("parts") > 1, _spread("vec_id", "parts")).otherwise(0)
    held = index.join(cells, where).withColumn("part", part).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)))
    parts_n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    held = held.select(*CELL, "vec_id", "width", "value", "code").repartition(parts_n, *CELL).sortWithinPartitions(*CELL)
    packed = checkpointed(_packed(held, high).repartition(parts_n, *CELL).sortWithinPartitions(*CELL))  # stays partitioned and sorted

    state = queries.withColumn("best", F.lit(None).cast("array<struct<distance:bigint,vec_id:bigint>>"))
    done: list[DataFrame] = []
    for radius in range(width + 1 if n else 0):
        now = state.select("query", "query_id", "n_bits", "code", "few", F.when(F.size("best") == k, F.col("best")[k - 1]["distance"]).otherwise(1 << 30).cast("long").alias("limit"))
        asked = _segments(now, width, high, radius).join(cells, where)
        asked = asked.withColumn("turn", F.when(F.col("turns") > 1, _spread("query", "turns")).otherwise(0)).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        asked = asked.groupBy(*CELL).agg(F.collect_list(F.struct("query", "query_id", "value", "code", "limit", "rest")).alias("asked"))
        found = _look_up(packed.join(asked, CELL), k).unionByName(state.select("query", F.explode("best").alias("b")).select("query", "b.vec_id", "b.distance"))
        found = found.groupBy("query", "vec_id").agg(F.min("distance").alias("distance"))
        rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "vec_id"))
        found = found.withColumn("r", rank).filter(F.col("r") <= k).groupBy("query").agg(F.array_sort(F.collect_list(F.struct("distance", "vec_id"))).alias("best"))
        m = F.ceil(F.col("n_bits") / width)
        over = F.col("few") | (F.lit(radius) >= F.ceil(F.col("n_bits") / m)) | ((F.size("best") == k) & (F.col("best")[k - 1]["distance"] <= m * (radius + 1) - 1))
        state = stored(state.drop("best").join(found, "query", "left").withColumn("over", F.coalesce(over, F.lit(False))), f"radius{radius}")
        done.append(state.filter("over").select("query_id", F.explode("best").alias("b")).select("query_id", "b.vec_id", "b.distance"))
        state = state.filter("not over").drop("over")
        if state.isEmpty():
            break
    if not done:
        return spark.createDataFrame([], "query_id long, rank long, vec_id long, distance long")
    found = done[0]
    for more in done[1:]:
        found = found.unionByName(more)
    found = found.groupBy("query_id", "vec_id").agg(F.min("distance").alias("distance"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return found.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")
