"""A report put together: tiles, tables of years and sections of a company as one nested row, gated by its findings.

Defined results: a company without a latest year has no tiles and empty tables; missing figures leave their tile
out; a section with a blocking finding is left out, and a report that has any is withheld: it keeps its tables,
has no rating, and its sections are gone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.operators import history as H

c = F.col
# The fields of the tables of reported and of forecast years, with their units.
REPORTED = (("revenue", "money"), ("revenue_growth", "%"), ("operating_income", "money"), ("operating_margin", "%"), ("net_income", "money"), ("free_cash_flow", "money"))
FORECAST = (("revenue", "money"), ("revenue_growth", "%"), ("operating_margin", "%"), ("free_cash_flow", "money"), ("present_value", "money"))
# What amounts are shown in.
SCALES = ((1e12, "tn"), (1e9, "bn"), (1e6, "m"))
ORDER = ("thesis", "financials", "outlook", "assumptions", "valuation", "risks", "business")


def shown(value: Column, currency: str = "USD") -> Column:
    """'USD 1.2bn', or whole units with separators."""
    size = F.abs(value)
    out = F.format_string(f"{currency} %,.0f", value.cast("double"))
    for least, unit in reversed(SCALES):
        out = F.when(size >= least, F.format_string(f"{currency} %,.1f{unit}", value / least)).otherwise(out)
    return F.when(value.isNotNull(), out)


def financial_table(history: DataFrame) -> DataFrame:
    """(ticker, year, the REPORTED fields) of all years."""
    rows = H.with_ratios(history).join(H.growth(history).withColumnRenamed("growth", "revenue_growth"), ["ticker", "fiscal_year"], "left")
    return rows.select("ticker", c("fiscal_year").alias("year"), *(k for k, _ in REPORTED))


def forecast_table(years: DataFrame) -> DataFrame:
    """(ticker, year, the FORECAST fields) of the valuation's years."""
    return years.select("ticker", c("year").cast("int").alias("year"), "revenue", c("growth").alias("revenue_growth"), c("margin").alias("operating_margin"), "free_cash_flow", "present_value")


def as_columns(table: DataFrame, fields: tuple[tuple[str, str], ...], most: int) -> DataFrame:
    """(ticker, seq, field, unit, y1 ... ymost): a row for each field, its years in columns from the newest."""
    place = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("year")))
    each = F.array(*(F.struct(F.lit(n).alias("seq"), F.lit(k).alias("field"), F.lit(u).alias("unit"), c(k).cast("double").alias("value")) for n, (k, u) in enumerate(fields)))
    rows = table.withColumn("place", place).filter(c("place") <= most).select("ticker", "place", F.inline(each))
    return rows.groupBy("ticker", "seq", "field", "unit").agg(*(F.max(F.when(c("place") == k, c("value"))).alias(f"y{k}") for k in range(1, most + 1)))


def kpis(rows: DataFrame, currency: str = "USD") -> DataFrame:
    """(ticker, seq, label, value, caption, tone). ``rows``: ticker, fiscal_year, revenue, growth, operating_margin,
    free_cash_flow, wacc, fair_value, upside, consensus; what is null has no tile."""
    year = F.concat(F.lit("FY"), c("fiscal_year").cast("string"))
    change = lambda x, what: F.concat(F.format_string("%+.0f%%", x * 100), F.lit(what))
    percent = lambda x: F.when(x.isNotNull(), F.format_string("%.1f%%", x * 100))
    share = lambda x: F.when(x.isNotNull(), F.format_string(f"{currency} %,.2f", x))
    tone = lambda x, other: F.when(F.coalesce(x, F.lit(0.0)) > 0, "positive").otherwise(other)
    plain = F.lit("neutral")
    tiles = [
        ("Revenue", F.when(c("revenue") != 0, shown(c("revenue"), currency)), F.concat_ws(", ", year, change(c("growth"), " YoY")), tone(c("growth"), "neutral")),
        ("Operating margin", percent(c("operating_margin")), year, plain),
        ("Free cash flow", shown(c("free_cash_flow"), currency), year, plain),
        ("WACC", percent(c("wacc")), F.lit("Discount rate (CAPM)"), plain),
        ("Our fair value (DCF)", share(c("fair_value")), F.coalesce(change(c("upside"), " vs market"), F.lit("")), tone(c("upside"), "negative")),
        ("Consensus target", share(c("consensus")), F.lit("what the market believes"), plain),
    ]
    each = F.array(*(F.struct(F.lit(n).alias("seq"), F.lit(k).alias("label"), v.alias("value"), t.alias("caption"), m.alias("tone")) for n, (k, v, t, m) in enumerate(tiles)))
    return rows.select("ticker", F.inline(each)).filter("value is not null")


def _nested(rows: DataFrame, order: str, name: str, *columns: str) -> DataFrame:
    """(ticker, name): an ordered array of structs; a ticker has some dozens at most."""
    listed = F.array_sort(F.collect_list(F.struct(c(order).alias("_order"), *columns)))
    return rows.groupBy("ticker").agg(F.transform(listed, lambda x: F.struct(*(x[k].alias(k) for k in columns))).alias(name))


def assemble(tickers: DataFrame, verdicts: DataFrame, tiles: DataFrame, reported: DataFrame, forecast: DataFrame, prose: DataFrame, findings: DataFrame) -> DataFrame:
    """One row a ticker: (ticker, status, rating, kpis, financial_table, forecast_table, sections, issues).

    ``prose``: ticker, section, text; ``findings``: ticker, section, severity, check, message.
    """
    bad = findings.filter(c("severity").isin("CRITICAL", "HIGH"))
    clean = prose.join(bad.select("ticker", "section").distinct(), ["ticker", "section"], "left_anti")
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, ORDER)), c("section")), F.lit(0)), F.lit(len(ORDER) + 1))
    parts = [
        _nested(tiles, "seq", "kpis", "label", "value", "caption", "tone"), _nested(reported, "year", "financial_table", "year", *(k for k, _ in REPORTED)), _nested(forecast, "year", "forecast_table", "year", *(k for k, _ in FORECAST)),
        _nested(clean.withColumn("place", F.struct(place.alias("place"), c("section").alias("name"))), "place", "sections", "section", "text"),
        _nested(bad.withColumn("rank", F.struct("severity", "check", "section", "message")), "rank", "issues", "severity", "check", "section", "message"),
    ]
    rows = reduce(lambda a, b: a.join(b, "ticker", "left"), parts, tickers.select("ticker").distinct().join(verdicts.select("ticker", "rating"), "ticker", "left"))
    blocked = F.coalesce(F.size("issues"), F.lit(0)) > 0
    empty = lambda name: F.array().cast(rows.schema[name].dataType)
    return rows.select(
        "ticker", F.when(blocked, "FAILED").otherwise("PASSED").alias("status"), F.when(~blocked, c("rating")).alias("rating"), *(F.coalesce(n, empty(n)).alias(n) for n in ("kpis", "financial_table", "forecast_table")),
        F.when(blocked | c("sections").isNull(), empty("sections")).otherwise(c("sections")).alias("sections"), F.coalesce("issues", empty("issues")).alias("issues"),
    )
