"""Chat and citations: history windows, marker resolution, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import text as T

c = F.col


def last_turns(turns: DataFrame, n: int, chars: int) -> DataFrame:
    """Each turn with the n before it, cut to ``chars`` characters; blank ones go after the count."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-n, -1)
    line = F.struct("turn", F.concat_ws(": ", "role", F.substring(F.trim("text"), 1, chars)).alias("line"), (F.trim(F.coalesce("text", F.lit(""))) == "").alias("blank"))
    kept = F.transform(F.filter(F.collect_list(line).over(before), lambda x: ~x["blank"]), lambda x: x["line"])
    return turns.select("conv_id", "turn", F.concat_ws("\n", kept).alias("history"), F.size(kept).alias("n_lines"))


def normal_markers(text: Column) -> Column:
    """[SOURCE 1, 4] and [1; 4] become [1][4]."""
    inner = F.regexp_replace(text, r"(?i)\[\s*sources?\s+", "[")
    return F.regexp_replace(F.regexp_replace(inner, r"(?<=\d)\s*[,;]\s*(?=\d+(?:\s*[,;]\s*\d+)*\s*\])", "]["), r"\[\s*(\d+)\s*\]", "[$1]")


def citations(answers: DataFrame, passages: DataFrame) -> DataFrame:
    """(answer_id, number, passage): the passages that an answer cites. ``passages``: answer_id, number from 1, passage."""
    cited = answers.select("answer_id", F.explode(F.array_distinct(T.markers(c("text")))).alias("number"))
    return cited.join(passages, ["answer_id", "number"])


def stripped(answers: DataFrame, limits: DataFrame) -> DataFrame:
    """Removes marks of passages that aren't there. ``limits``: answer_id, n."""
    rows = answers.join(limits, "answer_id", "left").withColumn("bad", F.filter(F.array_distinct(T.markers(c("text"))), lambda m: (m < 1) | (m > F.coalesce(c("n"), F.lit(0)))))
    clean = F.aggregate("bad", c("text"), lambda t, m: F.replace(t, F.concat(F.lit("["), m.cast("string"), F.lit("]")), F.lit("")))
    return rows.select("answer_id", clean.alias("text"), F.size("bad").alias("n_bad"))


def coverage(paragraphs: DataFrame, *keys: str) -> DataFrame:
    """Percent of paragraphs with a mark, 100 where there are none of them. ``paragraphs``: keys, paragraph."""
    cited = F.avg(F.when(c("paragraph").rlike(r"\[\d+\]"), 100.0).otherwise(0.0))
    return paragraphs.groupBy(*keys).agg(F.coalesce(F.bround(cited), F.lit(100.0)).alias("coverage"))
