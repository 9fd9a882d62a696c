"""Report tables: canonical metrics, ledger, bridges, calendars, timing, chart series, model numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.functions import exprs as X
from tallyloom.sources.sinks import stored

c = F.col

# Canonical metrics: key, label, unit.
METRICS = (
    ("revenue", "Revenue", "money"), ("operating_income", "Operating income", "money"), ("net_income", "Net income", "money"), ("free_cash_flow", "Free cash flow", "money"),
    ("gross_margin", "Gross margin", "%"), ("operating_margin", "Operating margin", "%"), ("net_margin", "Net margin", "%"), ("net_debt", "Net debt", "money"),
)


def canonical_metrics(latest: DataFrame) -> DataFrame:
    """(ticker, key, label, value, unit, period) of the latest year's values that there are."""
    each = F.array(*(F.struct(F.lit(k).alias("key"), F.lit(n).alias("label"), c(k).cast("double").alias("value"), F.lit(u).alias("unit")) for k, n, u in METRICS))
    rows = latest.select("ticker", F.concat(F.lit("FY"), c("fiscal_year").cast("string")).alias("period"), F.explode(each).alias("m"))
    return rows.select("ticker", "m.*", "period").filter("value is not null")


def model_numbers(tables: list[tuple[DataFrame, list[str], list[str]]]) -> DataFrame:
    """(ticker, kind, value): all numbers of tables that prose may quote. Each table comes with its percent and money columns."""
    parts = []
    for df, percents, amounts in tables:
        items = [F.struct(F.lit("pct").alias("kind"), F.bround(c(n) * 100, 1).alias("value")) for n in percents] + [F.struct(F.lit("money").alias("kind"), c(n).cast("double").alias("value")) for n in amounts]
        parts.append(df.select("ticker", F.explode(F.array(*items)).alias("x")).select("ticker", "x.*").filter("value is not null"))
    return reduce(DataFrame.unionByName, parts).distinct()


# Fields that hold a ratio, and those that hold an amount.
PERCENT_FIELDS = [
    "revenue_growth", "operating_margin", "gross_margin", "net_margin", "implied_cagr", "year_one_growth", "bottom_up_cagr", "top_down_cagr", "cagr", "probability",
    "fair_value_change", "revenue_change",
]
AMOUNT_FIELDS = [
    "revenue", "operating_income", "net_income", "free_cash_flow", "present_value", "terminal_revenue", "latest_revenue", "fair_value", "fair_value_per_share", "value_per_share",
    "market_cap", "implied_value_per_share", "latest_segment_sum", "latest_total_revenue", "bottom_up_terminal_revenue", "base_fair_value", "base_terminal_revenue",
]


def number_walk(rows: DataFrame) -> DataFrame:
    """(ticker, kind, key, value): the numbers at any depth of ``rows(ticker, json)`` whose own field is a known one.

    A round opens one level of all objects and lists at once, and what is nested goes to the next; there are as many rounds
    as levels.  Ratios are percentages with a decimal.  Numbers that stand in a list have no field and true and
    false are no numbers; text that is no JSON, null and repeated rows give what they hold: nothing, or twice as much.
    """
    kind = F.when(c("key").isin(PERCENT_FIELDS), "pct").when(c("key").isin(AMOUNT_FIELDS), "money")
    number = F.try_variant_get("value", "$", "double")  # null for what is nested, and for some texts, in which there is nothing to open
    shape = F.when(c("number").isNotNull() & c("kind").isNotNull(), F.schema_of_variant("value"))  # of single values only, as it reads all that is nested
    open_ = stored(rows.select("ticker", F.try_parse_json("json").alias("v")).filter("v is not null"), "walk")
    found = []
    while True:
        level = rows.sparkSession.sql("select ticker, e.key, e.value from {open_} t, lateral variant_explode(t.v) e", open_=open_).withColumn("number", number).withColumn("kind", kind)
        level = level.withColumn("is_number", F.coalesce(shape.rlike("^(BIGINT|DECIMAL|DOUBLE)"), F.lit(False)))
        nested = F.when(c("number").isNull() & ~F.is_variant_null("value"), c("value"))
        level = stored(level.select("ticker", "kind", "key", F.when(c("is_number"), c("number")).alias("number"), nested.alias("v")).filter("number is not null or v is not null"), "walk")
        found.append(level.filter("number is not null").select("ticker", "kind", "key", F.when(c("kind") == "pct", F.bround(c("number") * 100, 1)).otherwise(c("number")).alias("value")))
        open_ = level.filter("v is not null").select("ticker", "v")
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, found)


def ledger(rows: DataFrame, entries: list[tuple[str, str, str, Column, Column | None, tuple[float, float] | None]]) -> DataFrame:
    """An ordered row per assumption: (ticker, seq, key, label, unit, value, raw_value, lo, hi, clamped).

    ``entries``: key, label, unit, value, the value before bounds, bounds.
    """
    items = [
        F.struct(
            F.lit(i).alias("seq"), F.lit(k).alias("key"), F.lit(n).alias("label"), F.lit(u).alias("unit"), v.cast("double").alias("value"),
            (F.lit(None) if raw is None else F.when(raw != v, raw)).cast("double").alias("raw_value"), F.lit(b[0] if b else None).cast("double").alias("lo"), F.lit(b[1] if b else None).cast("double").alias("hi"),
        )
        for i, (k, n, u, v, raw, b) in enumerate(entries)
    ]
    return rows.select("ticker", F.explode(F.array(*items)).alias("x")).select("ticker", "x.*").withColumn("clamped", c("raw_value").isNotNull())


def carried_over(final: DataFrame, probe: DataFrame, *columns: str) -> DataFrame:
    """Fills what the final ledger lacks from the probe's row of the same key."""
    old = probe.select("ticker", "key", *(c(n).alias(f"_{n}") for n in columns))
    rows = final.join(old, ["ticker", "key"], "left")
    return rows.withColumns({n: F.coalesce(c(n), c(f"_{n}")) for n in columns}).drop(*(f"_{n}" for n in columns))


def bridge(parts: Column, target: Column, within: float = 0.005) -> Column:
    """The parts (array of struct<component, value>), with a residual if they miss the target by more than half a point."""
    gap = target - F.aggregate(parts, F.lit(0.0), lambda a, x: a + x["value"])
    return F.when(F.abs(gap) > within, F.concat(parts, F.array(F.struct(F.lit("residual").alias("component"), gap.alias("value"))))).otherwise(parts)


def clean_segments(raw: Column) -> Column:
    """map<string, double> of year labels to millions -> sorted array of struct<year, revenue> above 0."""
    pairs = F.transform(F.map_entries(raw), lambda e: F.struct(F.substring(e["key"], 1, 4).try_cast("int").alias("year"), (e["value"] * 1e6).alias("revenue")))
    return F.array_sort(F.filter(pairs, lambda p: p["year"].isNotNull() & (p["revenue"] > 0)))


def anchored(catalysts: DataFrame, dates: DataFrame) -> DataFrame:
    """The k-th earnings catalyst of a ticker gets its k-th scheduled date; others keep theirs."""
    is_earnings = F.lower("title").contains("earnings")
    own = catalysts.withColumn("k", F.when(is_earnings, F.sum(is_earnings.cast("int")).over(Window.partitionBy("ticker").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))))
    sched = dates.select("ticker", c("date").alias("scheduled"), F.row_number().over(Window.partitionBy("ticker").orderBy("date")).alias("k"))
    return own.join(sched, ["ticker", "k"], "left").withColumn("date", F.coalesce(c("scheduled"), c("date"))).drop("k", "scheduled")


def report_month(fiscal_year: Column, quarter: Column, year_end_month: Column) -> Column:
    """Months since year 0 in which a fiscal quarter is reported: the month after its end."""
    return fiscal_year * 12 + (year_end_month - 1) - 3 * (4 - quarter) + 1


def retimed(month: Column, expected: Column) -> Column:
    """The expected month where a stated one is over two months off."""
    return F.when(F.abs(month - expected) > 2, expected).otherwise(month)


def split_catalysts(rows: DataFrame, as_of: Column) -> DataFrame:
    """Adds state: passed for months before the one of ``as_of``; unreadable months stay upcoming."""
    return rows.withColumn("state", F.when(c("month") < as_of, "passed").otherwise("upcoming"))


def chart_series(history: DataFrame, years: DataFrame, value: str = "revenue") -> DataFrame:
    """Reported and forecast values as one series, in the largest unit that fits its maximum."""
    both = history.select("ticker", c("fiscal_year").alias("year"), c(value).alias("value"), F.lit("reported").alias("kind")).unionByName(years.select("ticker", c("year").cast("int").alias("year"), c(value).alias("value"), F.lit("forecast").alias("kind")))
    most = F.max(F.abs(c("value"))).over(Window.partitionBy("ticker"))
    scale = F.when(most >= 1e9, 1e9).when(most >= 1e6, 1e6).otherwise(1.0)
    return both.filter("value is not null").withColumn("scale", scale).withColumn("scaled", c("value") / c("scale"))


def disclosures(rows: DataFrame) -> DataFrame:
    """A line of methodology per ticker. ``rows``: ticker, rating, headline, wacc, terminal_growth."""
    line = F.format_string("%s: target %.2f over 12 months, rated %s; 10-year DCF at %.1f%% with %.1f%% terminal growth", "ticker", "headline", "rating", c("wacc") * 100, c("terminal_growth") * 100)
    return rows.select("ticker", line.alias("disclosure"))


def thesis(rows: DataFrame) -> DataFrame:
    """The deterministic thesis where no model writes one. ``rows``: ticker, rating, upside, growth, margin."""
    stance = F.when(c("rating") == "BUY", "undervalued").when(c("rating") == "SELL", "overvalued").otherwise("fairly valued")
    drive = F.when(c("growth") >= 0.15, "fast growth").when(c("growth") >= 0.05, "steady growth").otherwise("slow growth")
    return rows.select("ticker", F.concat_ws(" ", F.lit("The shares look"), F.concat(stance, F.lit(":")), drive, F.lit("at a"), F.format_string("%.0f%%", c("margin") * 100), F.lit("margin.")).alias("thesis"))


def eval_line(rows: DataFrame) -> DataFrame:
    """Measures as markdown rows. ``rows``: configuration, hit_rate, mrr."""
    return rows.select(F.format_string("| %s | %.0f%% | %.3f |", "configuration", F.bround(c("hit_rate") * 100), "mrr").alias("line"))
