"""Rate limits: a sliding limit per user and action in which refused events don't count, and a daily limit per action.

The batch functions run over a table; ``session_stream`` is the same rule over a stream, with the accepted
times of each key as its state.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tallyloom.sources.sinks import stored

HOUR, DAY = 3600.0, 86400.0
SLOTS = 1440  # of a window, in which the next start is looked up


def accept(times: list[float], kept: deque[float], limit: int, window: float) -> list[bool]:
    """Decides events in order; ``kept`` holds the accepted times that still count, and is changed."""
    out = []
    for t in times:
        while kept and t - kept[0] >= window:
            kept.popleft()
        out.append(len(kept) < limit)
        if out[-1]:
            kept.append(t)
    return out


def session_limit(events: DataFrame, limit: int, window: float = HOUR) -> DataFrame:
    """Adds accepted. ``events``: event_id, user_id, action, at (seconds).

    After a pause of ``window`` nothing that was accepted counts any more, so a key's events are cut there, and
    the stretches are dealt to tasks.  A stretch of no more than ``limit`` events is accepted as it is; the
    others stream through their task in order, which holds the accepted times of one stretch that still count,
    ``limit`` at most.  A key that never pauses is one stream.
    """
    kinds = pa.schema([("event_id", pa.int64()), ("user_id", pa.int64()), ("action", pa.string()), ("at", pa.float64()), ("accepted", pa.bool_())])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept = None, deque()
        for batch in batches:
            out = []
            for *key, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(4).to_pylist(), batch.column(3).to_pylist()):
                if key != now:
                    now, kept = key, deque()
                out += accept([at], kept, limit, window)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.bool_())], schema=kinds)

    key = ["user_id", "action"]
    order = Window.partitionBy(*key).orderBy("at", "event_id")
    pause = F.coalesce(F.col("at") - F.lag("at").over(order) >= window, F.lit(True)).cast("int")
    rows = events.select(F.col("event_id").cast("long").alias("event_id"), F.col("user_id").cast("long").alias("user_id"), "action", F.col("at").cast("double").alias("at")).withColumn("pause", pause)
    rows = rows.withColumn("stretch", F.sum("pause").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("pause")
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy(*key, "stretch")))
    few = rows.filter(F.col("n") <= limit).select("event_id", *key, "at", F.lit(True).alias("accepted"))
    many = rows.filter(F.col("n") > limit).drop("n").repartition(*key, "stretch").sortWithinPartitions(*key, "stretch", "at", "event_id")
    return few.unionByName(many.mapInArrow(decide, "event_id long, user_id long, action string, at double, accepted boolean"))


def daily_limit(events: DataFrame, limit: int, start: float) -> DataFrame:
    """Adds accepted: the first ``limit`` events of each action in a day, days counted from ``start``.

    Days are cut evenly from the start, by which many days of one action are decided at once.
    """
    day = F.floor((F.col("at") - start) / DAY)
    place = F.row_number().over(Window.partitionBy("action", "day").orderBy("at", "event_id"))
    return events.withColumn("day", day).withColumn("accepted", place <= limit)


def window_starts(times: DataFrame, length: float = DAY) -> DataFrame:
    """(start) of greedy windows over ``times(at)``: one starts at the first time, and the next at the first time that
    lies more than ``length`` after its start.

    Each time's next start is an as-of look-up: in the same slot of the time line, or else the first time of the
    next slot that has any.  The chain from the first time is then followed by pointer doubling: with the jumps
    doubled each round, the starts that are known double too, so rounds grow with the logarithm of their number.
    """
    slot = length / SLOTS
    place = lambda t: F.floor(t / slot).cast("long")
    known = stored(times.select(F.col("at").cast("double").alias("at")).filter("at is not null").distinct(), "times")
    asked = known.select(place(F.col("at") + length).alias("slot"), (F.col("at") + length).alias("t"), F.lit(1).alias("asks"), F.col("at").alias("of"))
    there = known.select(place(F.col("at")).alias("slot"), F.col("at").alias("t"), F.lit(0).alias("asks"), F.lit(None).cast("double").alias("of"))
    later = Window.partitionBy("slot").orderBy(F.desc("t"), F.desc("asks")).rowsBetween(Window.unboundedPreceding, -1)  # a time equal to the end is not after it
    near = asked.unionByName(there).withColumn("near", F.min(F.when(F.col("asks") == 0, F.col("t"))).over(later)).filter("asks = 1")
    firsts = there.groupBy("slot").agg(F.min("t").alias("first"))
    slots = near.select("slot").distinct().join(firsts, "slot", "full")  # at most one row for each slot of the time line
    slots = slots.select("slot", F.min("first").over(Window.orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, -1)).alias("onward"))
    jumps = stored(near.join(slots, "slot").select(F.col("of").alias("start"), F.coalesce("near", "onward").alias("next")).filter("next is not null"), "jumps")
    starts = stored(known.agg(F.min("at").alias("start")).filter("start is not null"), "starts")
    while True:
        more = stored(starts.join(jumps, "start").select(F.col("next").alias("start")).join(starts, "start", "left_anti").distinct(), "more")
        if more.isEmpty():
            return starts
        starts = stored(starts.unionByName(more), "starts")
        jumps = stored(jumps.join(jumps.select(F.col("start").alias("next"), F.col("next").alias("then")), "next").select("start", F.col("then").alias("next")), "jumps")


def global_limit(events: DataFrame, limit: int, window: float = DAY) -> DataFrame:
    """Adds start and accepted: the first ``limit`` events of each action in a window, whose start all actions share.

    A window begins with the first event that comes more than ``window`` after the start of the one before, not at
    midnight.  ``events``: event_id, action, at; those that the session's limit refused are not to be among them.
    The limit is kept by comparing with the last accepted event, so a window of very many events is no one task's.
    """
    rows = stored(events.filter("at is not null"), "events")  # read four times
    day = lambda t: F.floor(t / window).cast("long")
    marks = window_starts(rows, window).select(day(F.col("start")).alias("day"), "start")  # a window is longer than a day: one a day at most
    days = rows.select(day(F.col("at")).alias("day")).distinct().join(marks, "day", "full")
    earlier = F.last("start", ignorenulls=True).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1))  # a row a day
    days = days.select("day", F.col("start").alias("_own"), earlier.alias("_earlier"))
    placed = rows.withColumn("day", day(F.col("at"))).join(days, "day").withColumn("start", F.when(F.col("at") >= F.col("_own"), F.col("_own")).otherwise(F.col("_earlier"))).drop("day", "_own", "_earlier")
    rank = F.row_number().over(Window.partitionBy("action", "start").orderBy("at", "event_id"))
    last = placed.select("action", "start", "at", "event_id").withColumn("rank", rank).filter(F.col("rank") <= limit)
    last = last.groupBy("action", "start").agg(F.max(F.struct("at", "event_id")).alias("_last"))
    return placed.join(last, ["action", "start"], "left").withColumn("accepted", F.coalesce(F.struct("at", "event_id") <= F.col("_last"), F.lit(False))).drop("_last")


def session_stream(events: DataFrame, limit: int, window: float = HOUR, late: float = HOUR) -> DataFrame:
    """The sliding limit over a stream of events (event_id, user_id, action, at).

    Events may come ``late`` seconds behind the latest, and are decided in the order they come in; those behind
    the watermark are left out, as those before 1970 are.  A key is forgotten once the watermark has passed all
    its accepted times by ``window``.
    """

    def decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = deque(state.get[0]) if state.exists else deque()
        f = pd.concat(list(frames)).sort_values(["at", "event_id"])
        out = f.assign(accepted=accept(f["at"].tolist(), kept, limit, window))
        state.update((list(kept),))
        state.setTimeoutTimestamp(max(int((max(kept, default=0.0) + window) * 1000), state.getCurrentWatermarkMs() + 1))
        yield out[["event_id", "user_id", "action", "at", "accepted"]]

    rows = events.withColumn("ts", F.timestamp_seconds("at")).withWatermark("ts", f"{late} seconds")
    return rows.groupBy("user_id", "action").applyInPandasWithState(decide, "event_id long, user_id long, action string, at double, accepted boolean", "kept array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def spaced(arrivals: DataFrame, gap: float) -> DataFrame:
    """When calls start that must lie ``gap`` seconds apart, by one running maximum: t_i = max(a_i, t_{i-1} + gap). ``arrivals``: key, event_id, at."""
    order = Window.partitionBy("key").orderBy("at", "event_id")
    place = F.row_number().over(order) - 1
    rows = arrivals.withColumn("k", place).withColumn("slack", F.col("at") - F.col("k") * gap)
    return rows.withColumn("starts", F.max("slack").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("k") * gap).drop("k", "slack")
