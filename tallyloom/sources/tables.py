"""Tables of the warehouse, and the fiscal facts that stand behind the valuations.

A company is a market segment in a nation.  Amounts are summed as whole ten-thousandths, so that sums do
not depend on the order of rows.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with their order's date and company."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    ticker = F.concat_ws("-", "c_mktsegment", F.lpad(F.col("c_nationkey").cast("string"), 2, "0"))
    joined = lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.withColumns({"ticker": ticker, "fiscal_year": F.year("o_orderdate")})


def last_full_year(spark: SparkSession, sf_dir: str) -> Column:
    """The last year that the orders reach the end of; an annual statement is of a full year."""
    return table(spark, sf_dir, "orders").agg(F.year(F.date_add(F.max("o_orderdate").cast("date"), 1)) - 1).scalar()


def full_year_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_lines(spark, sf_dir).filter(F.col("fiscal_year") <= last_full_year(spark, sf_dir))


def exact(x, scale: int):
    return F.sum(F.round(x * scale).cast("long")) / scale


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per company and full fiscal year with the statement lines; some are missing, as in filings.

    The few rows are dealt by company and kept (in memory, else on disk), as valuations read them several times:
    what groups, orders or joins them by company then needs no shuffle.  Lost ones are computed again.
    """
    price, net = F.col("l_extendedprice"), F.col("l_extendedprice") * (1 - F.col("l_discount"))
    sums = full_year_lines(spark, sf_dir).groupBy("ticker", "fiscal_year").agg(
        F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("qty"), exact(net, 10000).alias("revenue"),
        exact(price, 100).alias("gross"), exact(net * F.col("l_tax"), 1000000).alias("duty"),
    )
    rev, gross, qty, n = F.col("revenue"), F.col("gross"), F.col("qty"), F.col("n")
    op = rev - gross * 0.70
    return sums.select(
        "ticker", "fiscal_year", "revenue", (gross * 0.55).alias("cost_of_revenue"), F.when(n % 7 != 0, rev - gross * 0.55).alias("gross_profit"),
        op.alias("operating_income"), (op * 0.78).alias("net_income"), (op - gross * 0.01).alias("pretax_income"), (F.col("duty") * 1.2).alias("tax_expense"),
        (rev * 0.28).alias("operating_cash_flow"), (-(gross * 0.05)).alias("capex"), (gross * 0.03).alias("depreciation"),
        (qty * 100.0).alias("cash"), F.when(n % 2 != 0, qty * 10.0).alias("short_term_investments"), F.when(n % 3 != 0, gross * 0.1).alias("total_debt"),
        (gross * 0.4).alias("current_assets"), F.when(n % 5 != 0, rev * 0.3).alias("current_liabilities"),
        (qty / 10.0).alias("diluted_shares"), n.alias("n_lines"),
    ).repartition("ticker").persist(StorageLevel.MEMORY_AND_DISK)


# The same rows in SQL, as common table expressions.
HISTORY_SQL = """
lines as (select c_mktsegment || '-' || lpad(cast(c_nationkey as varchar), 2, '0') as ticker, cast(year(o_orderdate) as int) as fiscal_year, l.*, o_orderdate, o_orderkey
  from lineitem l join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey where year(o_orderdate) < (select year(cast(max(o_orderdate) as date) + 1) from orders)),
sums as (select ticker, fiscal_year, count(*) as n, cast(sum(cast(l_quantity as bigint)) as bigint) as qty,
    sum(cast(round(l_extendedprice * (1 - l_discount) * 10000) as bigint)) / 10000 as revenue,
    sum(cast(round(l_extendedprice * 100) as bigint)) / 100 as gross,
    sum(cast(round(l_extendedprice * (1 - l_discount) * l_tax * 1000000) as bigint)) / 1000000 as duty from lines group by ticker, fiscal_year),
hist as (select ticker, fiscal_year, revenue, gross * 0.55::double as cost_of_revenue, case when n % 7 <> 0 then revenue - gross * 0.55::double end as gross_profit,
    revenue - gross * 0.70::double as operating_income, (revenue - gross * 0.70::double) * 0.78::double as net_income, revenue - gross * 0.70::double - gross * 0.01::double as pretax_income, duty * 1.2::double as tax_expense,
    revenue * 0.28::double as operating_cash_flow, -(gross * 0.05::double) as capex, gross * 0.03::double as depreciation, qty * 100.0::double as cash,
    case when n % 2 <> 0 then qty * 10.0::double end as short_term_investments, case when n % 3 <> 0 then gross * 0.1::double end as total_debt,
    gross * 0.4::double as current_assets, case when n % 5 <> 0 then revenue * 0.3::double end as current_liabilities, qty / 10.0::double as diluted_shares, n as n_lines from sums)
"""
