"""Mixing sources to target weights with hierarchical budgets, in DataFrame functions only.

Documents hang on a tree of levels (domain, language, source).  A token budget goes down the tree: brothers
share their parent's budget by weight, none gets more than its capacity (its tokens times ``epochs``), and
what one cannot take goes to its brothers by weight before anything is left for the parent's brothers, as
a parent's own share is bounded by its children's capacity (that of weight 0 doesn't count).  Budgets are whole
numbers and none of a budget is lost in dividing it.  A leaf's budget buys whole epochs of its
documents, and of the next epoch, in an order seeded by the epoch, the longest prefix that fits.

The order is by a digest of (seed, epoch, doc_id).  Tokens are summed by the digest's first digits, so only
the documents of the one digit group in which a leaf's prefix ends are put in order; all others are decided
by comparing digests.

Defined results: null or empty texts have 0 tokens and come along with any prefix that reaches them; null
level values count as ''; values without a weight get weight 1, weights of 0 or less buy nothing; rows that
repeat a doc_id are in or out together; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import stored

DIGITS = 3
OWN = "__mix_"  # before the names of added columns
BROADCAST_LEAVES = 100_000


def words(text: Column) -> Column:
    """Tokens as spaces and line feeds, and one more, in a text that is not empty."""
    n = F.length(text)
    return F.when(n > 0, n - F.length(F.translate(text, " \n", "")) + 1).otherwise(0).cast("long")


def _order_key(seed: int, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))


def _weight(level: str, weights: Mapping[str, int]) -> Column:
    out = F.lit(1)
    for value, w in weights.items():
        out = F.when(F.col(level) == value, F.lit(int(w))).otherwise(out)
    return out.cast("long")


def _shares(kids: DataFrame, above: Sequence[str], level: str, weights: Mapping[str, int]) -> DataFrame:
    """Adds ``target``: brothers share what their parent has ``given`` by weight ``w``, none above its ``cap``.

    All in whole numbers.  In order of cap / w a brother is full if its share of what those before leave reaches
    its cap; the others share the rest, and what division leaves over goes, one token each, to the largest
    remainders (ties: by name).  So all that is given is spent, up to the caps.
    """
    scale = lcm(1, *(int(w) for w in weights.values() if w > 0))  # cap / w in order, as whole numbers
    wide = kids.withColumns({c: F.col(c).cast("decimal(38,0)") for c in ("cap", "given", "w")})
    order = Window.partitionBy(*above).orderBy(F.expr(f"cap * ({scale} div w)"), level)
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    left = F.col("given") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    wide = wide.withColumn("full", F.col("cap") * F.sum("w").over(after).cast("decimal(38,0)") <= left.cast("decimal(38,0)") * F.col("w"))
    brothers = Window.partitionBy(*above)
    open_ = lambda c: F.sum(F.when(~F.col("full"), F.col(c))).over(brothers).cast("decimal(38,0)")
    wide = wide.withColumn("rest", (F.col("given") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(brothers), F.lit(0))).cast("decimal(38,0)")).withColumn("ws", open_("w"))
    wide = wide.withColumn("base", F.when(F.col("full"), F.col("cap").cast("long")).otherwise(F.expr("rest * w div ws"))).withColumn("part", F.when(~F.col("full"), F.expr("rest * w % ws")))
    spare = F.col("rest") - open_("base")
    place = F.row_number().over(Window.partitionBy(*above, "full").orderBy(F.desc("part"), level))
    return wide.withColumn("spare", spare).withColumn("place", place).withColumn("target", F.col("base") + F.when(~F.col("full") & (F.col("place") <= F.col("spare")), 1).otherwise(0))


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], share: tuple[int, int], epochs: int) -> DataFrame:
    """Each leaf's ``target`` tokens. ``leaves``: levels and tokens; ``share``: the budget as a fraction of all tokens."""
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).scalar()
    plan = leaves.withColumn("_all", total.cast("long")).withColumn("target", F.expr(f"_all * {int(share[0])} div {int(share[1])}")).drop("_all")
    for level in levels:  # what can't be bought is no capacity of any parent
        plan = plan.filter(_weight(level, weights.get(level, {})) > 0)
    for depth, level in enumerate(levels):
        path, above = list(levels[: depth + 1]), list(levels[:depth])
        kids = plan.groupBy(*path).agg((F.sum("tokens") * epochs).alias("cap"), F.first("target").alias("given")).withColumn("w", _weight(level, weights.get(level, {})))
        plan = plan.drop("target").join(_shares(kids, above, level, weights.get(level, {})).select(*path, "target"), path)
    return plan


def plan(docs: DataFrame, levels: Sequence[str], weights: Mapping[str, Mapping[str, int]], share: tuple[int, int], epochs: int, seed: int) -> DataFrame:
    """A row per leaf: its tokens, target, whole epochs, and the digest up to which documents come once more.

    ``docs``: doc_id, the levels without nulls, and tokens.
    """
    leaves = stored(docs.groupBy(*levels).agg(F.sum("tokens").alias("tokens")), "leaves")
    aims = leaf_budgets(leaves, levels, weights, share, epochs).withColumn("whole", F.expr("case when tokens > 0 then target div tokens else 0 end"))
    aims = stored(aims.withColumn("rest", F.col("target") - F.col("whole") * F.col("tokens")), "aims")
    keyed = joined(docs, aims.select(*levels, "whole", "rest"), levels).withColumn("key", _order_key(seed, F.col("whole"))).withColumn("digits", F.substring("key", 1, DIGITS))
    groups = keyed.groupBy(*levels, "digits").agg(F.sum("tokens").alias("here"), F.first("rest").alias("rest"))
    upto = F.sum("here").over(Window.partitionBy(*levels).orderBy("digits"))
    ends = groups.withColumn("upto", upto).filter("upto > rest").groupBy(*levels).agg(F.min("digits").alias("end"), F.min("upto").alias("past"))
    ends = stored(ends.join(groups.withColumnRenamed("digits", "end").select(*levels, "end", "here"), [*levels, "end"]), "ends")
    last = joined(keyed, ends, levels).filter("digits = end")
    last = last.groupBy(*levels, "key").agg(F.sum("tokens").alias("tokens"), *(F.first(c).alias(c) for c in ("past", "here", "rest")))  # rows of one doc_id are one
    run = F.col("past") - F.col("here") + F.sum("tokens").over(Window.partitionBy(*levels).orderBy("key"))
    cuts = last.withColumn("run", run).filter("run <= rest").groupBy(*levels).agg(F.max("key").alias("cut"))
    out = aims.join(ends.select(*levels, "end"), list(levels), "left").join(cuts, list(levels), "left")
    return out.select(*levels, "tokens", "target", "whole", F.coalesce("cut", "end", F.lit("g")).alias("cut"))


def joined(docs: DataFrame, small: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Joins on the levels; broadcasts only a table that is counted and small."""
    few = small.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES
    return docs.join(F.broadcast(small) if few else small, list(levels))


def mix(
    docs: DataFrame, levels: Mapping[str, Column], weights: Mapping[str, Mapping[str, int]], *,
    tokens: Column | None = None, share: tuple[int, int] = (1, 2), epochs: int = 2, seed: int = 1,
) -> DataFrame:
    """The chosen documents with all their columns, and, with OWN before, tokens, copies (how often each comes) and the levels."""
    named = {f"{OWN}{k}": F.coalesce(c.cast("string"), F.lit("")) for k, c in levels.items()}
    count = words(F.coalesce(F.col("text"), F.lit(""))) if tokens is None else tokens
    own = docs.withColumns(named | {f"{OWN}tokens": F.coalesce(count, F.lit(0)).cast("long")})
    slim = stored(own.select(F.col("doc_id"), *named, F.col(OWN + "tokens").alias("tokens")), "slim")
    leaves = stored(plan(slim, list(named), {f"{OWN}{k}": v for k, v in weights.items()}, share, epochs, seed), "plan")
    aims = leaves.select(*named, F.col("whole").alias(OWN + "whole"), F.col("cut").alias(OWN + "cut"))
    once_more = (_order_key(seed, F.col(OWN + "whole")) <= F.col(OWN + "cut")).cast("long")
    return joined(own, aims, list(named)).withColumn(OWN + "copies", F.col(OWN + "whole") + once_more).filter(F.col(OWN + "copies") > 0).drop(OWN + "whole", OWN + "cut")


def repeated(mixed: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row for each copy."""
    return mixed.withColumn(OWN + "copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col(OWN + "copies")))).select(*columns)
