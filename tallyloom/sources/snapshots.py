"""An index that is built in steps: each build chunks and posts only what is new, and readers see one whole snapshot.

Parts are tables that are written once and never changed.  A snapshot lists the live documents by the digest of
their content, each with the part that holds its rows.  A build compares the documents' digests with the last
snapshot: new ones become a part of their own, gone ones leave the list, and where nothing is new or gone nothing
is written.  Last of all one row with the snapshot's number and place is appended to the log of heads; Spark
commits that file by a rename, so a reader finds the old snapshot or the new one, and a build that fails leaves
the old one (its part is in no list).  There is to be one builder at a time.

Defined results: documents of equal content are one, with the least doc_id; null content is the empty text; an
empty table of documents withdraws all; reading an index that was never built gives None.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Make = Callable[[DataFrame], DataFrame]  # documents (digest, doc_id, text and others) to rows with digest


@dataclass(frozen=True)
class Snapshot:
    root: str
    number: int
    place: str
    n_live: int
    n_new: int
    n_gone: int

    def live(self, spark: SparkSession) -> DataFrame:
        """(digest, doc_id, part)."""
        return spark.read.parquet(self.place)

    def table(self, spark: SparkSession, name: str) -> DataFrame:
        """The rows of live documents, with digest."""
        live = self.live(spark)
        parts = [r.part for r in live.select("part").distinct().collect()]  # as many as builds at most
        if not parts:
            raise LookupError("the index holds no documents")
        return spark.read.parquet(*(f"{p}/{name}" for p in parts)).join(live.select("digest"), "digest", "left_semi")


def digested(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row for each content: digest, and the columns of its row with the least doc_id."""
    rows = docs.withColumn(text, F.coalesce(F.col(text), F.lit(""))).withColumn("digest", F.sha2(F.col(text), 256))
    first = rows.groupBy("digest").agg(F.min_by(F.struct(*docs.columns), F.struct(F.col("doc_id").isNull(), "doc_id")).alias("row"))
    return first.select("digest", "row.*")


def heads(spark: SparkSession, root: str) -> DataFrame | None:
    """The log of snapshots; None where there is none yet."""
    try:
        return spark.read.schema("number long, place string, n_live long, n_new long, n_gone long").json(f"{root}/heads")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def current(spark: SparkSession, root: str, number: int | None = None) -> Snapshot | None:
    """The newest snapshot, or the one of a number."""
    log = heads(spark, root)
    row = None if log is None else (log if number is None else log.filter(F.col("number") == number)).orderBy(F.desc("number")).first()
    return Snapshot(root, **row.asDict()) if row else None


def build(spark: SparkSession, root: str, docs: DataFrame, makers: Mapping[str, Make]) -> Snapshot:
    """Brings the index up to date with ``docs`` (doc_id, text and others) and gives its snapshot."""
    last = current(spark, root)
    now = digested(docs)
    known = last.live(spark) if last else spark.createDataFrame([], "digest string, doc_id long, part string")
    part, place = f"{root}/parts/{uuid.uuid4().hex}", f"{root}/snapshots/{uuid.uuid4().hex}"
    # New documents are written first, so that all that follows is of one state of the source.
    ids = now.select("digest", F.col("doc_id").cast("long").alias("doc_id"))
    state = f"{part}/state"
    ids.join(known.select("digest", F.col("part").alias("old")), "digest", "left").write.parquet(state)
    seen = spark.read.parquet(state)
    n_live, n_new = seen.agg(F.count("*"), F.count(F.when(F.col("old").isNull(), 1))).first()
    n_gone = known.count() - (n_live - n_new)
    if last and not n_new and not n_gone:
        return last
    fresh = now.join(seen.filter("old is null").select("digest"), "digest", "left_semi")
    if n_new:
        for name, make in makers.items():
            make(fresh).write.parquet(f"{part}/{name}")
    seen.select("digest", "doc_id", F.coalesce("old", F.lit(part)).alias("part")).write.parquet(place)
    head = (last.number + 1 if last else 1, place, n_live, n_new, n_gone)
    spark.createDataFrame([head], "number long, place string, n_live long, n_new long, n_gone long").coalesce(1).write.mode("append").json(f"{root}/heads")
    return Snapshot(root, *head)
