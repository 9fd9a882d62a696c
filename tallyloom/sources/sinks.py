"""Writers and guarded readers: the manifest, the search index, the vector cache, binary documents."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BYTES = 120 << 20


def work_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, which all executors see; where that is unset, as in local tests, a new one of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="spark-work-", dir="/tmp")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage with a table in the shared folder, so that lost executors cost no recomputation."""
    path = f"{work_dir(df.sparkSession)}-{label}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_manifest(decisions: DataFrame, path: str, stamp: Column) -> None:
    """Accepted and rejected documents with their reasons, a folder per status."""
    decisions.withColumn("generated_at", stamp).write.mode("overwrite").partitionBy("status").parquet(path)


def read_manifest(spark: SparkSession, path: str, files: DataFrame) -> DataFrame:
    """The manifest without accepted documents whose file is gone. ``files``: digest."""
    rows = spark.read.parquet(path)
    return rows.filter("status <> 'accepted'").unionByName(rows.filter("status = 'accepted'").join(files.select("digest").distinct(), "digest", "left_semi"))


def save_index(path: str, model: str, **tables: DataFrame) -> None:
    """The index's tables (chunks, postings, vectors), each marked with the embedding model."""
    for name, df in tables.items():
        df.withColumn("model", F.lit(model)).write.mode("overwrite").parquet(f"{path}/{name}")


def load_index(spark: SparkSession, path: str, model: str, name: str) -> DataFrame:
    """A table of the index; no rows if it was made with another model."""
    return spark.read.parquet(f"{path}/{name}").filter(F.col("model") == model).drop("model")


def vector_key(model: Column, text: Column) -> Column:
    return F.sha2(F.concat(model, F.decode(F.unhex(F.lit("00")), "UTF-8"), text), 256)


def new_vectors(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """What the cache lacks. Both have key."""
    return wanted.join(cache.select("key"), "key", "left_anti")


def upsert(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The cache with fresh rows in place of old ones of the same key."""
    return cache.join(fresh.select("key"), "key", "left_anti").unionByName(fresh)


def binary_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files with digest, size and whether they are admitted: not empty, not too large, a PDF's first bytes where its name says so."""
    rows = spark.read.format("binaryFile").load(path)
    pdf = ~F.lower("path").endswith(".pdf") | (F.substring("content", 1, 5) == F.lit(b"%PDF-"))
    return rows.select("path", "length", F.sha2("content", 256).alias("digest"), ((F.col("length") > 0) & (F.col("length") <= MAX_BYTES) & pdf).alias("admitted"))
