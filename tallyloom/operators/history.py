"""Operators on fiscal histories: ratios, growth, means, sufficiency, the latest year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tallyloom.functions import exprs as X


def _years() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy("fiscal_year")


def _newest() -> WindowSpec:
    return Window.partitionBy("ticker").orderBy(F.desc("fiscal_year"))


def with_ratios(history: DataFrame) -> DataFrame:
    c = F.col
    return history.withColumns({
        "gross_margin": X.gross_margin(c("gross_profit"), c("revenue"), c("cost_of_revenue")),
        "operating_margin": X.ratio(c("operating_income"), c("revenue")),
        "net_margin": X.ratio(c("net_income"), c("revenue")),
        "effective_tax_rate": X.effective_tax(c("tax_expense"), c("pretax_income")),
        "free_cash_flow": X.free_cash_flow(c("operating_cash_flow"), c("capex")),
        "net_debt": X.net_debt(c("total_debt"), c("cash"), c("short_term_investments")),
        "working_capital": c("current_assets") - c("current_liabilities"),
    })


def series(history: DataFrame, value: str) -> DataFrame:
    """(ticker, fiscal_year, value) where there is a value."""
    return history.select("ticker", "fiscal_year", F.col(value).alias("value")).filter("value is not null")


def growth(history: DataFrame, value: str = "revenue") -> DataFrame:
    """Growth on the value before, missing years skipped; pairs with a value of 0 before give none."""
    before = F.lag("value").over(_years())
    rows = series(history, value).withColumn("before", before).filter("before <> 0")
    return rows.select("ticker", "fiscal_year", (F.col("value") / F.col("before") - 1).alias("growth"))


def cagr(history: DataFrame, value: str = "revenue") -> DataFrame:
    """Compound growth over the points that there are; null for under two or an end that isn't above 0."""
    ends = series(history, value).groupBy("ticker").agg(F.min_by("value", "fiscal_year").alias("a"), F.max_by("value", "fiscal_year").alias("b"), F.count("*").alias("n"))
    rate = F.when((F.col("n") >= 2) & (F.col("a") > 0) & (F.col("b") > 0), F.pow(F.col("b") / F.col("a"), 1.0 / (F.col("n") - 1)) - 1)
    return ends.select("ticker", rate.alias("cagr"), "n")


def mean_last(history: DataFrame, value: str, n: int) -> DataFrame:
    """Mean of the last n values that there are."""
    rows = series(history, value).withColumn("r", F.row_number().over(_newest())).filter(F.col("r") <= n)
    return rows.groupBy("ticker").agg(F.avg("value").alias("mean"))


def ratio_to_revenue(history: DataFrame, value: str, n: int = 3) -> DataFrame:
    """Mean of |value| / revenue in the last n years, years without either left out of the mean."""
    rows = history.withColumn("r", F.row_number().over(_newest())).filter(F.col("r") <= n)
    return rows.groupBy("ticker").agg(F.avg(X.ratio(F.abs(F.col(value)), F.col("revenue"))).alias("ratio"))


def steady(growths: DataFrame) -> DataFrame:
    """Whether the last four growths (three at least) are all above 0 and vary little."""
    rows = growths.withColumn("r", F.row_number().over(_newest())).filter("r <= 4")
    ok = (F.count("*") >= 3) & F.every(F.col("growth") > 0) & (F.stddev_pop("growth") / F.avg("growth") < 0.5)
    return rows.groupBy("ticker").agg(F.coalesce(ok, F.lit(False)).alias("steady"))


def working_capital_share(history: DataFrame, default: float = 0.05, most: float = 0.25) -> DataFrame:
    """Upper median of change in working capital over change in revenue, where revenue moved by 5 % or more."""
    rows = with_ratios(history).withColumns({"wc0": F.lag("working_capital").over(_years()), "rev0": F.lag("revenue").over(_years())})
    change = F.col("revenue") - F.col("rev0")
    share = (F.col("working_capital") - F.col("wc0")) / X.nonzero(change)
    seen = F.when((F.abs(change) >= 0.05 * F.col("rev0")) & share.between(0.0, 0.60), share)
    lists = rows.groupBy("ticker").agg(F.sort_array(F.collect_list(seen)).alias("seen"))  # a value a year at most
    middle = F.element_at("seen", (F.size("seen") / 2).cast("int") + 1)
    return lists.select("ticker", F.when(F.size("seen") > 0, F.least(middle, F.lit(most))).otherwise(default).alias("wc_share"), F.size("seen").alias("observations"))


def sufficient(history: DataFrame) -> DataFrame:
    """Companies with two revenues and a free cash flow at least."""
    agg = with_ratios(history).groupBy("ticker").agg(F.count("revenue").alias("revenues"), F.count("free_cash_flow").alias("flows"))
    return agg.withColumn("sufficient", (F.col("revenues") >= 2) & (F.col("flows") >= 1))


def latest(history: DataFrame) -> DataFrame:
    """The newest year's row of each company, by one aggregate and no window."""
    rest = [c for c in history.columns if c not in ("ticker", "fiscal_year")]
    return history.groupBy("ticker").agg(F.max(F.struct("fiscal_year", *rest)).alias("y")).select("ticker", "y.*")


def fingerprint(history: DataFrame) -> DataFrame:
    """A short digest of the years' revenue, margin and cash flow, in whole units and ten-thousandths."""
    rows = with_ratios(history)
    whole = lambda x: F.coalesce(F.round(x).cast("long").cast("string"), F.lit(""))
    line = F.concat_ws(":", F.col("fiscal_year").cast("string"), whole(F.col("revenue")), whole(F.col("operating_margin") * 10000), whole(F.col("free_cash_flow")))
    lines = rows.groupBy("ticker").agg(F.concat_ws("|", F.sort_array(F.collect_list(line))).alias("line"))
    return lines.select("ticker", F.substring(F.sha2("line", 256), 1, 16).alias("fingerprint"))


def last_years(history: DataFrame, n: int) -> DataFrame:
    return history.withColumn("r", F.row_number().over(_newest())).filter(F.col("r") <= n).drop("r")


def rate_of(column: Column) -> Column:
    return F.round(column, 6)
