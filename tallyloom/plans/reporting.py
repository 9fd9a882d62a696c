"""Registered report tables and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.operators import assembly as A
from tallyloom.operators import history as H
from tallyloom.operators import reporting as R
from tallyloom.operators import valuation as V
from tallyloom.plans import prose
from tallyloom.plans.registry import query
from tallyloom.plans.valuation import INPUTS_SQL, RATIOS_SQL, fair_sql, flows_sql, inputs, path_sql, rounded
from tallyloom.sources import sinks
from tallyloom.sources.tables import history, table

c = F.col

_LAST = RATIOS_SQL + ", newest as (select * from ratios qualify row_number() over (partition by ticker order by fiscal_year desc) = 1)"
_METRIC = " union all ".join(f"select ticker, '{k}' as key, '{n}' as label, round({k}, 6) as value, '{u}' as unit, 'FY' || fiscal_year as period from newest where {k} is not null" for k, n, u in R.METRICS)


@query("q_canonical_metrics", f"with {_LAST} {_METRIC}")
def q_canonical_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(R.canonical_metrics(H.with_ratios(H.latest(history(spark, sf_dir)))), "value")


@query("q_model_numbers", f"with {_LAST} select distinct ticker, kind, value from (select ticker, 'pct' as kind, round_even(operating_margin * 100, 1) as value from newest union all select ticker, 'pct', round_even(gross_margin * 100, 1) from newest union all select ticker, 'money', revenue from newest) where value is not null")
def q_model_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.model_numbers([(H.with_ratios(H.latest(history(spark, sf_dir))), ["operating_margin", "gross_margin"], ["revenue"])])


@query("q_ledger", "with " + INPUTS_SQL + """ select ticker, 0 as seq, 'year_one_growth' as key, round(year_one_growth, 8) as value, round(case when normal_growth <> year_one_growth then normal_growth end, 8) as raw_value, normal_growth <> year_one_growth as clamped from inputs
 union all select ticker, 1, 'terminal_growth', round(terminal_growth, 8), null, false from inputs union all select ticker, 2, 'wacc', round(wacc, 8), null, false from inputs""")
def q_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.ledger(inputs(spark, sf_dir)[0], [("year_one_growth", "Year 1 growth", "%", c("year_one_growth"), c("normal_growth"), (-0.3, 0.75)), ("terminal_growth", "Terminal growth", "%", c("terminal_growth"), None, (0.01, 0.04)), ("wacc", "WACC", "%", c("wacc"), None, None)])
    return rounded(rows.select("ticker", "seq", "key", "value", "raw_value", "clamped"), "value", "raw_value", digits=8)


@query("q_bridge", f"with {_LAST} select ticker, 2 + case when abs(net_margin - (gross_margin - (gross_margin - operating_margin))) > 0.005 then 1 else 0 end as n_parts, round(net_margin, 6) as total from newest")
def q_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From gross to net margin, the rest named."""
    rows = H.with_ratios(H.latest(history(spark, sf_dir)))
    part = lambda name, v: F.struct(F.lit(name).alias("component"), v.alias("value"))
    made = R.bridge(F.array(part("gross", c("gross_margin")), part("costs", c("operating_margin") - c("gross_margin"))), c("net_margin"))
    rows = rows.withColumn("b", made)
    return rows.select("ticker", F.size("b").alias("n_parts"), F.round(F.aggregate("b", F.lit(0.0), lambda a, x: a + x["value"]), 6).alias("total"))


@query("q_segment_history", "select o_custkey, y as year, v * 1e6 as revenue from (select o_custkey, cast(year(o_orderdate) as int) as y, sum(cast(round(o_totalprice) as bigint))::double as v from orders where year(o_orderdate) <> 1999 group by all) where v > 0")
def q_segment_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly totals kept as a map of labels, read back as a sorted series; 1999's label is unreadable."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey", F.year("o_orderdate").alias("y")).agg(F.sum(F.round("o_totalprice").cast("long")).cast("double").alias("v"))
    label = F.when(c("y") == 1999, F.lit("n/a")).otherwise(F.concat(c("y").cast("string"), F.lit("A")))
    maps = o.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct(label, "v"))).alias("m"))  # a value a year
    return maps.select("o_custkey", F.inline(R.clean_segments(c("m"))))


@query("q_anchored", """with k as (select o_custkey as ticker, o_orderkey as seq, o_orderpriority = '1-URGENT' as e, cast(o_orderdate as date) as d from orders), n as (select *, sum(e::int) over (partition by ticker order by seq) as k from k),
 s as (select o_custkey as ticker, cast(o_orderdate as date) as d, row_number() over (partition by o_custkey order by cast(o_orderdate as date)) as k from (select distinct o_custkey, cast(o_orderdate as date) as o_orderdate from orders where o_orderstatus = 'F'))
 select n.ticker, n.seq, strftime(case when n.e then coalesce(s.d, n.d) else n.d end, '%Y-%m-%d') as date from n left join s on n.ticker = s.ticker and n.k = s.k and n.e""")
def q_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders as earnings dates, put on the days of the finished ones in order."""
    o = table(spark, sf_dir, "orders")
    title = F.when(c("o_orderpriority") == "1-URGENT", "Earnings call").otherwise("Event")
    catalysts = o.select(c("o_custkey").alias("ticker"), c("o_orderkey").alias("seq"), title.alias("title"), c("o_orderdate").cast("date").alias("date"))
    dates = o.filter("o_orderstatus = 'F'").select(c("o_custkey").alias("ticker"), c("o_orderdate").cast("date").alias("date")).distinct()
    return R.anchored(catalysts, dates).select("ticker", "seq", F.date_format("date", "yyyy-MM-dd").alias("date"))


@query("q_fiscal_timing", """with t as (select o_orderkey, year(o_orderdate) * 12 + month(o_orderdate) - 1 as m, year(o_orderdate) as fy, o_orderkey % 4 + 1 as q, o_orderkey % 12 + 1 as e from orders), x as (select *, fy * 12 + (e - 1) - 3 * (4 - q) + 1 as expected from t)
 select o_orderkey, cast(case when abs(m - expected) > 2 then expected else m end as bigint) as month, case when (case when abs(m - expected) > 2 then expected else m end) < 2000 * 12 then 'passed' else 'upcoming' end as state from x""")
def q_fiscal_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, key = table(spark, sf_dir, "orders"), c("o_orderkey")
    year = F.year("o_orderdate")
    month = R.retimed(year * 12 + F.month("o_orderdate") - 1, R.report_month(year, key % 4 + 1, key % 12 + 1))
    return R.split_catalysts(o.select("o_orderkey", month.cast("long").alias("month")), F.lit(2000 * 12))


_YEARS_SQL = "years as (select ticker, cast(base_year + i + 1 as int) as year, cast(i + 1 as bigint) as t, g as growth, current_margin + (terminal_margin - current_margin) / 9 * i as margin, " + f"{flows_sql()[0]} as revenue, {flows_sql()[1]} as free_cash_flow, {flows_sql()[1]} / pow(1 + wacc, i + 1) as present_value from (select *, cast(unnest(range(0, 10)) as bigint) as i, unnest({path_sql()}) as g from inputs))"


@query("q_chart_series", "with " + INPUTS_SQL + f""", {_YEARS_SQL}, both_ as (select ticker, fiscal_year as year, revenue as value, 'reported' as kind from hist union all select ticker, year, revenue, 'forecast' from years),
 s as (select *, case when max(abs(value)) over (partition by ticker) >= 1e9 then 1e9 when max(abs(value)) over (partition by ticker) >= 1e6 then 1e6 else 1.0 end as scale from both_ where value is not null)
 select ticker, year, round(value, 4) as value, kind, scale::double as scale, round(value / scale, 4) as scaled from s""")
def q_chart_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, hist, _ = inputs(spark, sf_dir)
    return rounded(R.chart_series(hist, V.forecast_years(rows)), "value", "scaled", digits=4)


@query("q_texts", "with " + INPUTS_SQL + f""", v as (select i.ticker, {fair_sql()} as fair, price, year_one_growth as g, terminal_margin as m from inputs i join (select ticker, price from market) k using (ticker)),
 r as (select *, case when not (fair > 0 and price <> 0) then 'NOT RATED' when fair / price - 1 >= 0.15 then 'BUY' when fair / price - 1 >= -0.10 then 'HOLD' else 'SELL' end as rating from v)
 select ticker, 'The shares look ' || case rating when 'BUY' then 'undervalued' when 'SELL' then 'overvalued' else 'fairly valued' end || ': ' || case when g >= 0.15 then 'fast growth' when g >= 0.05 then 'steady growth' else 'slow growth' end || ' at a ' || printf('%.0f', m * 100) || '% margin.' as thesis from r""")
def q_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, mkt = inputs(spark, sf_dir)
    verdict = V.verdicts(V.valued(rows).select("ticker", c("fair_value").alias("dcf_value"), F.lit(0.0).alias("blended")), mkt.select("ticker", "price"))
    both = verdict.join(rows.select("ticker", c("year_one_growth").alias("growth"), c("terminal_margin").alias("margin")), "ticker")
    return R.thesis(both)


@query("q_vector_cache", "select sha256('m' || chr(0) || text) as key, cast(min(doc_id) as bigint) as doc_id from documents where text is not null and lang <> 'en' and text not in (select text from documents where lang = 'en' and text is not null) group by text")
def q_vector_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in other languages that a cache of the English ones lacks."""
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", "lang", sinks.vector_key(F.lit("m"), c("text")).alias("key"))
    fresh = docs.filter("lang <> 'en'").groupBy("key").agg(F.min("doc_id").alias("doc_id"))
    return sinks.new_vectors(fresh, docs.filter("lang = 'en'").select("key").distinct())


@query("q_ranked_segments", "select p_brand, p_type, n, rank from (select p_brand, p_type, count(*) as n, row_number() over (partition by p_brand order by count(*) desc, p_type) as rank from lineitem join part on l_partkey = p_partkey group by p_brand, p_type) where rank <= 3")
def q_ranked_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each brand's three most sold types."""
    sold = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("k")).join(table(spark, sf_dir, "part"), c("l_partkey") == c("p_partkey"))
    sums = sold.groupBy("p_brand", "p_type").agg(F.sum("k").alias("n"))
    rank = F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("n"), "p_type"))
    return sums.withColumn("rank", rank.cast("long")).filter("rank <= 3")


# Numbers with separators, rounded to so many decimals.
def _commas(x: str, digits: int) -> str:
    whole = f"cast(round(abs({x}) * {10**digits}) as bigint)"
    tail = f" || '.' || lpad(cast({whole} % {10**digits} as varchar), {digits}, '0')" if digits else ""
    return f"(case when {x} < 0 then '-' else '' end || format('{{:,}}', {whole} // {10**digits}){tail})"


def _shown(x: str) -> str:
    return f"'USD ' || case when abs({x}) >= 1e12 then {_commas(f'({x} / 1e12)', 1)} || 'tn' when abs({x}) >= 1e9 then {_commas(f'({x} / 1e9)', 1)} || 'bn' when abs({x}) >= 1e6 then {_commas(f'({x} / 1e6)', 1)} || 'm' else {_commas(x, 0)} end"


_TILES_SQL = f"""fairs as (select ticker, wacc, case when terminal_growth < wacc then {fair_sql()} end as fair from inputs),
 k as (select n.ticker, n.fiscal_year, n.revenue, g.growth, n.operating_margin, n.free_cash_flow, i.wacc, i.fair, m.price,
   coalesce(case when m.n % 4 <> 0 then m.price * 1.15::double end, m.price * 1.1::double) as consensus from last n join fairs i using (ticker) join (select ticker, price, n from market) m using (ticker) left join granked g on g.ticker = n.ticker and g.r = 1),
 u as (select *, case when fair > 0 and price <> 0 then fair / price - 1 end as upside from k),
 tiles as (select ticker, 0 as seq, 'Revenue' as label, {_shown('revenue')} as value, 'FY' || fiscal_year || coalesce(', ' || printf('%+.0f', growth * 100) || '% YoY', '') as caption, case when coalesce(growth, 0) > 0 then 'positive' else 'neutral' end as tone from u where revenue <> 0
  union all select ticker, 1, 'Operating margin', printf('%.1f', operating_margin * 100) || '%', 'FY' || fiscal_year, 'neutral' from u where operating_margin is not null
  union all select ticker, 2, 'Free cash flow', {_shown('free_cash_flow')}, 'FY' || fiscal_year, 'neutral' from u where free_cash_flow is not null
  union all select ticker, 3, 'WACC', printf('%.1f', wacc * 100) || '%', 'Discount rate (CAPM)', 'neutral' from u where wacc is not null
  union all select ticker, 4, 'Our fair value (DCF)', 'USD ' || {_commas('fair', 2)}, coalesce(printf('%+.0f', upside * 100) || '% vs market', ''), case when coalesce(upside, 0) > 0 then 'positive' else 'negative' end from u where fair is not null
  union all select ticker, 5, 'Consensus target', 'USD ' || {_commas('consensus', 2)}, 'what the market believes', 'neutral' from u)"""


def _tiles(rows: DataFrame, hist: DataFrame, mkt: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tiles, verdicts)."""
    values = V.valued(rows).select("ticker", "fair_value", "wacc")
    verdicts = V.verdicts(values.select("ticker", c("fair_value").alias("dcf_value"), F.lit(0.0).alias("blended")), mkt.select("ticker", "price"))
    last = H.with_ratios(H.latest(hist)).select("ticker", "fiscal_year", "revenue", "operating_margin", "free_cash_flow")
    growth = H.growth(hist).groupBy("ticker").agg(F.max_by("growth", "fiscal_year").alias("growth"))
    targets = mkt.select("ticker", F.coalesce("target_median", "target_mean").alias("consensus"))
    facts = last.join(values, "ticker").join(targets, "ticker").join(growth, "ticker", "left").join(verdicts.select("ticker", "upside"), "ticker", "left")
    return A.kpis(facts), verdicts


@query("q_kpis", "with " + INPUTS_SQL + ", " + _TILES_SQL + " select ticker, seq, label, value, caption, tone from tiles")
def q_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiles(*inputs(spark, sf_dir))[0]


@query("q_year_columns", f"with {RATIOS_SQL}, gr as (select ticker, fiscal_year, revenue / nullif(lag(revenue) over (partition by ticker order by fiscal_year), 0) - 1 as growth from hist), t as (select r.ticker, row_number() over (partition by r.ticker order by r.fiscal_year desc) as k, r.*, growth from ratios r left join gr using (ticker, fiscal_year)), "
  + "l as (" + " union all ".join(f"select ticker, {n} as seq, '{k}' as field, '{u}' as unit, k, {'growth' if k == 'revenue_growth' else k} as v from t" for n, (k, u) in enumerate(A.REPORTED)) + ") select ticker, seq, field, unit, " + ", ".join(f"round(max(v) filter (k = {i}), 6) as y{i}" for i in range(1, 7)) + " from l where k <= 6 group by ticker, seq, field, unit")
def q_year_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest six years of each company side by side, a row for each field."""
    return rounded(A.as_columns(A.financial_table(history(spark, sf_dir)), A.REPORTED, 6), *(f"y{k}" for k in range(1, 7)))


@query("q_report", "with " + INPUTS_SQL + ", " + _TILES_SQL + ", " + _YEARS_SQL + prose.FINDINGS_SQL.removeprefix(RATIOS_SQL).replace("from newest)", "from last)", 1).replace(", newest as (select * from ratios qualify row_number() over (partition by ticker order by fiscal_year desc) = 1)", "", 1) + """,
 bad as (select * from found where severity in ('CRITICAL', 'HIGH')), b as (select ticker, count(*) as n_issues from bad group by ticker), clean as (select s.* from sections s where not exists (select 1 from bad where bad.ticker = s.ticker and bad.section = s.section))
 select f.ticker, case when n_issues > 0 then 'FAILED' else 'PASSED' end as status, case when n_issues > 0 then null else case when upside is null then 'NOT RATED' when upside >= 0.15 then 'BUY' when upside >= -0.10 then 'HOLD' else 'SELL' end end as rating,
  (select count(*) from tiles t where t.ticker = f.ticker) as n_kpis, (select count(*) from hist h where h.ticker = f.ticker) as n_years, (select count(*) from years y where y.ticker = f.ticker) as n_forecast, coalesce(n_issues, 0) as n_issues,
  case when n_issues > 0 then '' else coalesce((select string_agg(section, ',' order by list_position(['thesis', 'financials', 'outlook', 'assumptions', 'valuation', 'risks', 'business'], section)) from clean s where s.ticker = f.ticker), '') end as sections
 from facts f join u using (ticker) left join b using (ticker)""")
def q_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every company's report as one row, withheld where a finding blocks it; here with the sizes of its parts."""
    rows, hist, mkt = inputs(spark, sf_dir)
    known = prose.facts(spark, sf_dir)
    tiles, verdicts = _tiles(rows, hist, mkt)
    sections = prose.sections(known)
    whole = A.assemble(known, verdicts, tiles, A.financial_table(hist), A.forecast_table(V.forecast_years(rows)), sections, prose.findings(sections, known))
    count = lambda n, name: F.size(n).cast("long").alias(name)
    return whole.select("ticker", "status", "rating", count("kpis", "n_kpis"), count("financial_table", "n_years"), count("forecast_table", "n_forecast"), count("issues", "n_issues"), F.array_join(F.transform("sections", lambda x: x["section"]), ",").alias("sections"))
