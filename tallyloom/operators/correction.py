"""Correction of report sections in rounds, for all reports at once.

A round takes the sections with a blocking finding that rewriting may mend, puts their next revision in place
and checks what changed, and only that; findings in all other sections carry over.  It ends when no such
section has a revision left, or after MAX_ROUNDS.  Each round's tables are stored, and the next one begins with
an anti-join on them.  A report that still has a blocking finding then stays blocked.

Defined results: findings without a section are of the model's numbers and can't be mended by rewriting; a
revision that is null leaves the section as it is but counts as an attempt; of several revisions of one
attempt the least text counts; revisions of unknown sections are not used.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.sources.sinks import stored

c = F.col
MAX_ROUNDS = 3
BLOCKING = ("CRITICAL", "HIGH")
# The part of a report that a check's findings are mended in; None: no text mends them.
COMPONENTS = {
    "annualisation": "sections",
    "canonical metric": "sections",
    "driver numbers": "sections",
    "consensus": "sections",
    "segment shares": "sections",
    "citations": "sections",
    "metric semantics": "forward",
    "staleness": "forward",
    "market implied": "thesis",
    "risk direction": "risks",
    "consistency": None,
    "valuation": None,
    "segments": None,
}
KEY = ["ticker", "section"]


@dataclass(frozen=True)
class Corrected:
    """prose (with attempt: the round that its text is of, 0 for the first), findings, and log: (ticker, section,
    attempt, component, messages), which tells a writer what was wrong with the text before."""

    prose: DataFrame
    findings: DataFrame
    log: DataFrame


def component(check: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for k, v in COMPONENTS.items() if v for x in (k, v)]), check)


def mendable(findings: DataFrame) -> DataFrame:
    """(ticker, section, component, messages) of the sections that a blocking finding asks to rewrite."""
    rows = findings.filter(c("severity").isin(*BLOCKING) & c("section").isNotNull()).withColumn("component", component(c("check"))).filter("component is not null")
    return rows.groupBy(*KEY).agg(F.min("component").alias("component"), F.sort_array(F.collect_set("message")).alias("messages"))  # some sentences a section


def correct(prose: DataFrame, revisions: DataFrame, check: Callable[[DataFrame], DataFrame], fixed: DataFrame | None = None, rounds: int = MAX_ROUNDS) -> Corrected:
    """``prose``: ticker, section, text and what ``check`` reads besides; ``revisions``: ticker, section, attempt (from 1), text.

    ``check`` gives findings (ticker, section, severity, check, message) of sections; ``fixed`` are findings without one.
    """
    now = stored(prose.withColumn("attempt", F.lit(0)), "prose")
    columns = ["ticker", "section", "severity", "check", "message"]
    found = check(now).select(*columns)
    if fixed is not None:
        found = found.unionByName(fixed.withColumn("section", F.lit(None).cast("string")).select(*columns))
    found = stored(found, "findings")
    drafts = stored(revisions.groupBy(*KEY, "attempt").agg(F.min("text").alias("draft")), "drafts")
    log = None
    for attempt in range(1, rounds + 1):
        asked = mendable(found).join(drafts.filter(c("attempt") == attempt).drop("attempt"), KEY).join(now.select(*KEY), KEY, "left_semi")
        asked = stored(asked.withColumn("attempt", F.lit(attempt)), "asked")
        if asked.isEmpty():
            break
        entry = asked.select(*KEY, "attempt", "component", "messages")
        log = entry if log is None else log.unionByName(entry)
        new = asked.filter("draft is not null").select(*KEY, "draft", c("attempt").alias("round"))
        changed = stored(now.join(new, KEY).withColumn("text", c("draft")).withColumn("attempt", c("round")).select(now.columns), "changed")
        now = stored(now.join(changed.select(*KEY).distinct(), KEY, "left_anti").select(now.columns).unionByName(changed), "prose")
        kept = found.join(changed.select(*KEY).distinct(), KEY, "left_anti").select(*columns)  # null sections stay
        found = stored(kept.unionByName(check(changed).select(*columns)), "findings")
    if log is None:
        log = mendable(found).select(*KEY, F.lit(0).alias("attempt"), "component", "messages").limit(0)
    return Corrected(now, found, log)


def verdicts(done: Corrected) -> DataFrame:
    """(ticker, attempts, blocking, status): how many rounds rewrote something, and whether the report may be published."""
    reports = done.prose.select("ticker").distinct()
    tries = done.log.groupBy("ticker").agg(F.countDistinct("attempt").alias("attempts"))
    bad = done.findings.filter(c("severity").isin(*BLOCKING)).groupBy("ticker").agg(F.count("*").alias("blocking"))
    rows = reports.join(tries, "ticker", "left").join(bad, "ticker", "left").fillna(0, ["attempts", "blocking"])
    return rows.withColumn("status", F.when(c("blocking") > 0, "FAILED").otherwise("PASSED"))


def instruction(messages: Column) -> Column:
    """What a writer is told: each fault on a line of its own; empty where there is none."""
    head = F.lit("These faults were found in the text before. Mend what it says, not only how it says it:\n- ")
    return F.when(F.size(messages) > 0, F.concat(head, F.array_join(messages, "\n- "))).otherwise("")


def history_of(done: Corrected) -> DataFrame:
    """The log with the next round a section was taken up in, null for its last."""
    after = F.lead("attempt").over(Window.partitionBy(*KEY).orderBy("attempt"))
    return done.log.withColumn("next_attempt", after).withColumn("instruction", instruction(c("messages")))
