"""The trie of conversations' prefixes, from SQL ROLLUPs over columns of turn ids.

Turns are cut into blocks of BLOCK positions, and a block is a row: the key of the node where it begins and a
column for each position.  ``GROUP BY key, ROLLUP(t1, ..., t8)`` then counts all prefixes of all blocks at once,
and grouping_id tells a prefix's length.  A longer conversation goes on in further blocks, keyed by the node in
which the block before ends.  Such a key is the sum of the turns' digests up to there, each taken together with its
position (three sums of 40 bits), so blocks of one conversation don't wait for each other: keys are running sums.

Figures of subtrees need no walk down the trie either.  Each node is named by its smallest member, and a node's
own figure (saved tokens, or 1 for a childless node) is booked on that member.  A second ROLLUP adds up what is booked on
all members of a node; that is its subtree and, of its own name, also nodes above it, whose running sum is taken
off again.

A long conversation is split: turns are ranged over all tasks to number them, and running sums go in two levels.
The list of members that end in one node is hashed from sorted pieces, piece after piece, and never held whole.

Defined results: turns without conv_id are left out; turns go by (turn, role, text's digest), nulls first, and
null roles and texts are empty; repeated rows are turns of their own; an empty table gives an empty result; other columns are
not read.  Negative conv_ids count as any others; their base is nearer to zero (c - c % 5).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import stored

BLOCK = 8  # positions of a row
CHUNK = 4096  # rows that one task takes in order
KEEP, GROUP = 9, 5  # how many turns may come from another conversation, and how many conversations share one
PIECE = 1 << 14  # ids of a piece
_WORDS = ("x", "y", "z")
_MASK = (1 << 40) - 1


def _masked(c: Column) -> Column:
    return c.bitwiseAND(F.lit(_MASK))


def running(rows: DataFrame, key: str, order: str, values: Sequence[str], wrap: bool = False) -> DataFrame:
    """Adds ``before_<value>``: the sum over the key's rows of lower ``order`` (a long from 0, distinct in a key).

    A key's rows are taken in chunks of CHUNK orders, and the chunks' sums are summed up on their own.  ``wrap``:
    sums of words of 40 bits, of which 40 bits are kept.
    """
    cut = _masked if wrap else (lambda c: c)
    chunked = rows.withColumn("_chunk", F.expr(f"{order} div {CHUNK}"))
    sums = chunked.groupBy(key, "_chunk").agg(*(cut(F.sum(v)).alias(f"_{v}") for v in values))
    earlier = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(key, "_chunk", *(F.sum(f"_{v}").over(earlier).alias(f"_{v}") for v in values)).filter("_chunk > 0")
    inside = Window.partitionBy(key, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = chunked.select("*", *(F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"before_{v}") for v in values))
    out = own.join(base, [key, "_chunk"], "left")
    return out.select(*rows.columns, *(cut(F.col(f"before_{v}") + F.coalesce(f"_{v}", F.lit(0))).alias(f"before_{v}") for v in values))


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, id, bytes) of ``turns(conv_id, turn, role, text)``; id is a digest of role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    slim = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.octet_length(text).cast("long").alias("bytes"), F.sha2(text, 256).alias("digest"))
    slim = stored(slim.select("conv_id", "turn", "role", "bytes", "digest"), "turns")
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc(), F.col("digest").asc()]
    ranged = stored(slim.repartitionByRange(F.col("conv_id"), *order).withColumn("_part", F.spark_partition_id()), "ranged")
    # Only the first conversation of a range has turns in ranges before: as many rows as there are ranges, at most.
    counts = ranged.groupBy("conv_id", "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("conv_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("conv_id", "_part", before.alias("_before")).filter("_before > 0")
    place = F.row_number().over(Window.partitionBy("conv_id", "_part").orderBy(*order)).cast("long")
    rows = ranged.withColumn("_place", place).join(F.broadcast(offsets), ["conv_id", "_part"], "left")
    return rows.select("conv_id", (F.col("_place") + F.coalesce("_before", F.lit(0))).alias("pos"), F.sha2(F.concat_ws(":", F.length("role"), "role", "digest"), 256).alias("id"), "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): (conv_id, pos from 0, id, bytes, last) of the rebuilt conversations, and
    (conv_id, n) of all.

    Conversation c is the first h original turns of c - c % GROUP and then its own turns after its first h, where
    h is the CRC-32 of c in decimal, modulo KEEP.
    """
    own = stored(numbered(turns), "numbered")
    convs = own.groupBy("conv_id").agg(F.max("pos").alias("n_own"))
    kept = F.crc32(F.col("conv_id").cast("string")) % KEEP
    sizes = convs.withColumn("h", kept).withColumn("base", F.expr(f"conv_id - conv_id % {GROUP}"))
    bases = convs.filter(f"conv_id % {GROUP} = 0").select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    sizes = sizes.join(bases, "base", "left").withColumn("lead", F.least("h", F.coalesce("n_base", F.lit(0))))
    sizes = stored(sizes.withColumn("n", F.col("lead") + F.greatest(F.lit(0), F.col("n_own") - F.col("h"))), "conversations")
    heads = own.filter(f"conv_id % {GROUP} = 0 and pos < {KEEP}").select(F.col("conv_id").alias("base"), "pos", "id", "bytes")  # up to 8 turns each
    lead = sizes.filter("lead > 0").join(heads, "base").filter("pos <= lead").select("conv_id", (F.col("pos") - 1).alias("pos"), "id", "bytes", "n")
    rest = own.join(sizes.select("conv_id", "h", "lead", "n"), "conv_id").filter("pos > h").select("conv_id", (F.col("pos") - 1 - F.col("h") + F.col("lead")).alias("pos"), "id", "bytes", "n")
    rows = lead.unionByName(rest).withColumn("last", F.col("pos") == F.col("n") - 1)
    return rows.select("conv_id", "pos", "id", "bytes", "last"), sizes.select("conv_id", "n")


def blocks(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, block, kx, ky, kz, t1 ... t8, last): a row for each block, with the key of the node where it begins.

    A position's column is (x, y, z, bytes): digest words of the turn at its position.
    """
    digest = F.sha2(F.concat_ws(":", "pos", "id"), 256)
    word = lambda k: F.conv(F.substring(digest, 10 * k + 1, 10), 16, 10).cast("long")
    words = turns.select("conv_id", F.expr(f"pos div {BLOCK}").alias("block"), (F.col("pos") % BLOCK + 1).alias("slot"), *(word(k).alias(w) for k, w in enumerate(_WORDS)), "bytes", "last")
    slots = [F.max(F.when(F.col("slot") == k, F.struct(*_WORDS, "bytes"))).alias(f"t{k}") for k in range(1, BLOCK + 1)]
    sums = [_masked(F.sum(w)).alias(w) for w in _WORDS]
    filled = words.groupBy("conv_id", "block").agg(*slots, *sums, F.max("last").alias("last"))
    empty = convs.filter("n = 0").select("conv_id", F.lit(0).cast("long").alias("block"), F.lit(True).alias("last"), *(F.lit(0).cast("long").alias(w) for w in _WORDS))
    rows = running(filled.unionByName(empty, allowMissingColumns=True), "conv_id", "block", _WORDS, wrap=True)
    return rows.select("conv_id", "block", *(F.col(f"before_{w}").alias(f"k{w}") for w in _WORDS), *(f"t{k}" for k in range(1, BLOCK + 1)), "last")


def _name(slots: int) -> Column:
    """The name of the node of a block's first ``slots`` turns (absent ones add nothing)."""
    out = []
    for w in _WORDS:
        total = F.col(f"k{w}")
        for k in range(1, slots + 1):
            total = total + F.coalesce(F.col(f"t{k}")[w], F.lit(0))
        out.append(_masked(total).alias(w))
    return F.struct(*out)


_POSITIONS = ", ".join(f"t{k}" for k in range(1, BLOCK + 1))
_ROLLUP = f"""
select block, kx, ky, kz, {_POSITIONS}, {BLOCK} - bit_count(grouping_id()) as slots, {{figures}}
from {{{{rows}}}} group by block, kx, ky, kz, rollup({_POSITIONS})
"""


def _rolled(rows: DataFrame, figures: str) -> DataFrame:
    """Each node's name, parent's name, depth and last turn's bytes, with ``figures`` over its members.

    A prefix's columns end with a null where members of the node before end; those groups are no nodes.  The
    empty prefix is a node in the first block only; elsewhere it is the end of the block before.
    """
    found = rows.sparkSession.sql(_ROLLUP.format(figures=figures), rows=rows)
    at = lambda pick: F.coalesce(*(F.when(F.col("slots") == k, pick(k)) for k in range(1, BLOCK + 1)))
    found = found.withColumn("bytes", F.coalesce(at(lambda k: F.col(f"t{k}")["bytes"]), F.when((F.col("slots") == 0) & (F.col("block") == 0), F.lit(0).cast("long"))))
    found = found.filter("bytes is not null").withColumn("depth", F.col("block") * BLOCK + F.col("slots"))
    parent = at(lambda k: _name(k - 1))
    kept = [c for c in found.columns if c not in {"block", "kx", "ky", "kz", "slots", *_POSITIONS.split(", ")}]
    return found.select(*kept, _name(BLOCK).alias("name"), parent.alias("parent"))


def _ends(rows: DataFrame) -> DataFrame:
    """(name, ends_sha256) of ``rows(name, conv_id)``: the SHA-256 of a name's conv_ids in order, comma-joined.

    The rows are ranged and sorted, so a name's list comes in pieces from one or several tasks; the pieces are
    hashed one after the other.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("label", pa.string()), ("first", pa.int64()), ("piece", pa.string())])
        label, held, out = None, [], []

        def close() -> None:
            if held:
                out.append((label, held[0], ",".join(map(str, held))))
                held.clear()

        for batch in batches:
            for name, conv in zip(batch.column("label").to_pylist(), batch.column("conv_id").to_pylist()):
                if name != label or len(held) == PIECE:
                    close()
                    label = name
                held.append(conv)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label = hasher = None
        for batch in batches:
            done = []
            for name, piece in zip(batch.column("label").to_pylist(), batch.column("piece").to_pylist()):
                if name != label:
                    if hasher:
                        done.append((label, hasher.hexdigest()))
                    label, hasher = name, hashlib.sha256(piece.encode())
                else:
                    hasher.update(b"," + piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in done], pa.string()) for k in range(2)], names=["label", "ends_sha256"])
        if hasher:
            yield pa.RecordBatch.from_arrays([pa.array([label]), pa.array([hasher.hexdigest()])], names=["label", "ends_sha256"])

    labelled = rows.select(F.to_json("name").alias("label"), "conv_id")
    cut = labelled.repartitionByRange("label", "conv_id").sortWithinPartitions("label", "conv_id").mapInArrow(pieces, "label string, first long, piece string")
    hashed = cut.repartition("label").sortWithinPartitions("label", "first").mapInArrow(digests, "label string, ends_sha256 string")
    return hashed.select(F.from_json("label", "x long, y long, z long").alias("name"), "ends_sha256")


def trie(turns: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows = stored(blocks(*rebuilt(turns)), "blocks")
    nodes = stored(_rolled(rows, "count(*) as n_convs, min(conv_id) as conv_id"), "nodes")
    kids = nodes.filter("depth > 0").groupBy("parent").agg(F.count("*").alias("n_children")).withColumnRenamed("parent", "name")
    nodes = nodes.join(kids, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = stored(nodes.withColumn("own", (F.col("n_convs") - 1) * F.col("bytes")), "family")
    booked = nodes.groupBy("conv_id").agg(F.sum("own").alias("saved"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf")).filter("saved > 0 or leaf > 0")
    sums = stored(_rolled(rows.join(booked, "conv_id"), "sum(saved) as saved, sum(leaf) as leaves"), "subtrees").select("name", "saved", "leaves")
    above = running(nodes.select("conv_id", "depth", "own", "name"), "conv_id", "depth", ["own"]).select("name", F.col("before_own").alias("above"))
    ends = _ends(rows.filter("last").select(_name(BLOCK).alias("name"), "conv_id"))
    parents = nodes.filter("n_children > 0").select(F.col("name").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, "name").join(above, "name").join(ends, "name", "left").join(parents, "parent", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), (F.col("saved") - F.col("above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
