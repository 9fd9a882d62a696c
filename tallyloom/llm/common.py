"""What the operators share: tables, the shared folder, digests of texts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder (URI) under spark.checkpoint.dir, which all executors see.

    Where the setting is absent, as in local tests, it is set to a new folder of this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage with a Parquet table in the shared folder, so that lost executors cost no recomputation."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    """The same with a checkpoint in the shared folder, which keeps how rows are partitioned and sorted."""
    context = df.sparkSession.sparkContext
    folder = shared_dir(df.sparkSession, "checkpoint")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return df.checkpoint()


BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def with_small_batches(df: DataFrame) -> DataFrame:
    """Rows go to Python workers in Arrow batches of BATCH_BYTES, or of the session's own bound if that is smaller.

    A batch is held several times over, in the JVM, in transit and in Python; Spark's own bound is 64 MB.
    """
    spark = df.sparkSession
    if not 0 < _bytes(spark.conf.get(_BATCH, "64m")) <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return df


def _bytes(setting: str) -> int:
    text = setting.lower().rstrip("b")
    scale = {"k": 10, "m": 20, "g": 30}.get(text[-1:], 0)
    return int(text[:-1] if scale else text) << scale


def text_of(column: str = "text") -> Column:
    """Nulls count as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


MEMBER_BITS = 1 << 23  # of the filter in maybe_in, which is 1 MB when broadcast


def maybe_in(rows: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """Adds _in: whether a row's key may be among ``keys(key)``.

    False is certain: the keys are a bitmap of fixed size, in which some others' places are taken too.  So
    it spares the rows it clears a shuffle, and the rest need an exact test.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(MEMBER_BITS))
    maps = keys.select(place(F.col("key")).alias("_p")).groupBy(F.expr("_p div 32768").alias("_bucket")).agg(F.expr("bitmap_construct_agg(_p % 32768)").alias("_bits"))
    at = F.expr("cast(_p % 32768 as int)")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = rows.withColumn("_key", key).withColumn("_p", place(F.col("_key"))).withColumn("_bucket", F.expr("_p div 32768")).join(F.broadcast(maps), "_bucket", "left")
    found = F.coalesce(F.getbit(byte, F.expr("cast(_p % 8 as int)")) == 1, F.lit(False)) & F.col("_key").isNotNull()
    return held.withColumn("_in", found).select(*rows.columns, "_in")


HOT_SHARE = 1000


def joined_by(many: DataFrame, few: DataFrame, key: str) -> DataFrame:
    """``many`` (stored, as it is read twice) joined with ``few``, which has one row a key.

    A key with over a thousandth of ``many``'s rows is hot; there are fewer than HOT_SHARE such keys, so their rows
    of ``few`` are broadcast and ``many``'s stay where they are.  The rest are joined by a shuffle.
    """
    most = many.count() // HOT_SHARE
    hot = stored(many.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > most + 1).select(key), "hot")
    rest = many.join(F.broadcast(hot), key, "left_anti").join(few, key)
    return many.join(F.broadcast(few.join(F.broadcast(hot), key)), key).unionByName(rest)
