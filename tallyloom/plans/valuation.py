"""Registered valuation queries over the order lines, and their SQL."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import exprs as X
from tallyloom.operators import history as H
from tallyloom.operators import valuation as V
from tallyloom.plans.registry import query
from tallyloom.settings import DEFAULTS
from tallyloom.sources.tables import HISTORY_SQL, full_year_lines, history, table

c = F.col


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(c(n), digits) for n in names})


def market(hist: DataFrame) -> DataFrame:
    """A snapshot per company: price, beta, market value, analysts' targets; from the latest year's figures."""
    last = H.latest(hist)
    n, shares = c("n_lines"), c("diluted_shares")
    price = c("revenue") / shares * 0.12 * (n % 10 + 5)
    country = F.when(F.substring_index("ticker", "-", -1).cast("int") % 6 == 0, "INDIA").otherwise("US")
    rows = last.select("ticker", country.alias("country"), F.when(n % 11 != 0, (n % 20) / 10.0 + 0.5).alias("beta"), price.alias("price"), (price * shares * 20).alias("market_cap"), n.alias("n"))
    return rows.withColumns({"usd_rate": F.when(c("country") == "US", F.lit(1.0)).otherwise(0.012), "target_mean": c("price") * 1.1, "target_median": F.when(c("n") % 4 != 0, c("price") * 1.15), "analysts": c("n") % 40})


def overrides(hist: DataFrame) -> DataFrame:
    return H.latest(hist).filter("n_lines % 9 = 0").select("ticker", F.lit(0.2).alias("year_one_growth"), F.lit(None).cast("double").alias("terminal_growth"), F.lit(0.3).alias("terminal_margin"))


def proposals(hist: DataFrame) -> DataFrame:
    return H.latest(hist).filter("n_lines % 4 = 0").select("ticker", F.lit(0.4).alias("year_one_growth"), F.lit(0.06).alias("terminal_growth"), F.lit(0.01).alias("terminal_margin"))


def inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    hist = history(spark, sf_dir)
    mkt = market(hist)
    rows = V.forecast_inputs(hist, V.discount_rates(hist, mkt), proposals(hist), overrides(hist))
    return rows.persist(StorageLevel.MEMORY_AND_DISK), hist, mkt  # a row per company, read by each solve


RATIOS_SQL = HISTORY_SQL + """,
ratios as (select *, coalesce(gross_profit / nullif(revenue, 0), (revenue - cost_of_revenue) / nullif(revenue, 0)) as gross_margin, operating_income / nullif(revenue, 0) as operating_margin,
    net_income / nullif(revenue, 0) as net_margin, case when pretax_income > 0 and tax_expense / pretax_income between 0 and 0.60 then tax_expense / pretax_income end as effective_tax_rate,
    operating_cash_flow - abs(capex) as free_cash_flow, total_debt - coalesce(cash, 0) - coalesce(short_term_investments, 0) as net_debt, current_assets - current_liabilities as working_capital from hist)
"""
GROWTH_SQL = RATIOS_SQL + """,
growths as (select ticker, fiscal_year, growth from (select ticker, fiscal_year, revenue / nullif(lag(revenue) over (partition by ticker order by fiscal_year), 0) - 1 as growth from hist) where growth is not null),
ranked as (select *, row_number() over (partition by ticker order by fiscal_year desc) as r from ratios),
granked as (select *, row_number() over (partition by ticker order by fiscal_year desc) as r from growths),
last as (select * from ranked where r = 1)
"""
MARKET_SQL = GROWTH_SQL + """,
market as (select ticker, case when cast(split_part(ticker, '-', -1) as int) % 6 = 0 then 'INDIA' else 'US' end as country, case when n_lines % 11 <> 0 then (n_lines % 20) / 10.0::double + 0.5::double end as beta,
    revenue / diluted_shares * 0.12::double * (n_lines % 10 + 5) as price, revenue / diluted_shares * 0.12::double * (n_lines % 10 + 5) * diluted_shares * 20 as market_cap, n_lines as n, diluted_shares as shares, net_income from last),
wc as (select ticker, list(s order by s) as seen from (select ticker, (working_capital - lag(working_capital) over w) / nullif(revenue - lag(revenue) over w, 0) as s,
    abs(revenue - lag(revenue) over w) >= 0.05 * lag(revenue) over w as moved from ratios window w as (partition by ticker order by fiscal_year)) where moved and s between 0 and 0.60 group by ticker),
rates0 as (select m.*, 0.75::double * greatest(least(0.67::double * coalesce(beta, 1) + 0.33::double, 3.0), 0.3) + 0.25::double as beta_dcf, case country when 'INDIA' then 0.078::double else 0.055::double end as erp,
    case when market_cap * case country when 'US' then 1.0::double else 0.012::double end >= 1e10 then 0.0::double when market_cap * case country when 'US' then 1.0::double else 0.012::double end >= 2e9 then 0.01::double
      when market_cap is not null then 0.025::double else 0 end as size_premium,
    coalesce((select avg(effective_tax_rate) from ranked r where r.ticker = m.ticker and r.r <= 3), case country when 'INDIA' then 0.2517::double else 0.21::double end) as tax_rate,
    coalesce((select total_debt from last l where l.ticker = m.ticker), 0) as debt from market m),
rates1 as (select *, 0.043::double + beta_dcf * erp + size_premium as cost_of_equity from rates0),
rates as (select *, case when coalesce(market_cap, 0) <= 0 or debt <= 0 then cost_of_equity else
    greatest(least(market_cap / (market_cap + debt) * cost_of_equity + debt / (market_cap + debt) * 0.058::double * (1 - tax_rate), 0.20), 0.05) end as wacc from rates1)
"""
INPUTS_SQL = MARKET_SQL + """,
i0 as (select l.ticker, l.fiscal_year as base_year, l.revenue as base_revenue, l.operating_margin, l.net_debt as known_debt, l.diluted_shares as shares, l.net_income, l.n_lines,
    coalesce((select growth from granked g where g.ticker = l.ticker and r = 1), 0.05) as recent, coalesce((select avg(growth) from granked g where g.ticker = l.ticker and r <= 3), 0.05) as mean_growth,
    coalesce((select count(*) >= 3 and bool_and(growth > 0) and stddev_pop(growth) / avg(growth) < 0.5 from granked g where g.ticker = l.ticker and r <= 4), false) as steady,
    coalesce((select avg(operating_margin) from ranked g where g.ticker = l.ticker and r <= 3), 0.15) as margin3,
    coalesce((select least(seen[len(seen) // 2 + 1], 0.25) from wc where wc.ticker = l.ticker), 0.05) as wc_share,
    coalesce(nullif((select avg(abs(depreciation) / nullif(revenue, 0)) from ranked g where g.ticker = l.ticker and r <= 3), 0), 0.03) as depreciation_share,
    coalesce(nullif((select avg(abs(capex) / nullif(revenue, 0)) from ranked g where g.ticker = l.ticker and r <= 3), 0), 0.04) as capex_share,
    x.tax_rate, x.wacc from last l join rates x using (ticker) where l.revenue <> 0),
i1 as (select *, case when recent > 0 and recent < 0.15 and mean_growth > recent then (recent + mean_growth) / 2 else recent end as normal_growth, case when n_lines % 4 = 0 then 0.04::double else 0.025::double end as tg0 from i0),
i2 as (select *, least(greatest(normal_growth, 0.05), 0.75) as ceiling from i1),
i3 as (select *, case when normal_growth > 0 then least(greatest(tg0, normal_growth * 0.5), ceiling) else -0.30::double end as floor_ from i2),
i4 as (select *, case when n_lines % 9 = 0 then 0.2::double when n_lines % 4 = 0 then greatest(least(0.4::double, ceiling), floor_) else least(normal_growth, ceiling) end as year_one_growth, tg0 as terminal_growth,
    case when n_lines % 9 = 0 then 0.3::double when n_lines % 4 = 0 then 0.05::double else margin3 end as terminal_margin, coalesce(nullif(operating_margin, 0), margin3) as current_margin, coalesce(known_debt, 0) as net_debt from i3),
i5 as (select *, case when year_one_growth >= 0.45 then 0.68::double when year_one_growth >= 0.30 then 0.74::double when year_one_growth >= 0.18 then 0.80::double else 0.86::double end as d0 from i4),
inputs as (select *, case when steady then least(d0 + 0.05::double, 0.90) else d0 end as decay from i5)
"""


def path_sql(g: str = "year_one_growth", tg: str = "terminal_growth", decay: str = "decay") -> str:
    return f"list_transform(range(0, 10), lambda k: ({tg}) + (({g}) - ({tg})) * pow({decay}, k))"


def flows_sql(path: str | None = None, *, g: str = "year_one_growth", tg: str = "terminal_growth", tm: str = "terminal_margin", capex: str = "capex_share") -> tuple[str, str]:
    """(revenue, cash flow) of year i from 0, as scalar expressions."""
    path = path or path_sql(g, tg)
    rev = f"base_revenue * list_product(list_transform(({path})[1:cast(i + 1 as bigint)], lambda x: 1 + x))"
    prev = f"base_revenue * coalesce(list_product(list_transform(({path})[1:cast(i as bigint)], lambda x: 1 + x)), 1)"
    margin = f"(current_margin + (({tm}) - current_margin) / 9 * i)"
    return rev, f"({rev} * {margin} * (1 - tax_rate) + {rev} * depreciation_share - {rev} * ({capex}) - ({rev} - {prev}) * wc_share)"


def ev_sql(path: str | None = None, *, w: str = "wacc", end: str | None = None, **k: str) -> tuple[str, str]:
    """(enterprise value, present terminal value); ``end``: terminal growth of the perpetuity only."""
    tg = end or k.get("tg", "terminal_growth")
    flow = flows_sql(path, **k)[1]
    pv = f"list_sum(list_transform(range(0, 10), lambda i: {flow} / pow(1 + ({w}), i + 1)))"
    last = f"list_sum(list_transform([9], lambda i: {flow}))"
    tv = f"({last} * (1 + ({tg})) / (({w}) - ({tg})) / pow(1 + ({w}), 10))"
    return f"({pv} + {tv})", tv


def fair_sql(path: str | None = None, **k: str) -> str:
    return f"case when shares > 0 then ({ev_sql(path, **k)[0]} - net_debt) / shares else 0 end"


@query("q_history", "with " + RATIOS_SQL + """ select ticker, fiscal_year, round(revenue, 6) as revenue, round(gross_margin, 6) as gross_margin, round(operating_margin, 6) as operating_margin, round(net_margin, 6) as net_margin,
  round(effective_tax_rate, 6) as effective_tax_rate, round(free_cash_flow, 6) as free_cash_flow, round(net_debt, 6) as net_debt, round(working_capital, 6) as working_capital from ratios""")
def q_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = H.with_ratios(history(spark, sf_dir)).select("ticker", "fiscal_year", "revenue", "gross_margin", "operating_margin", "net_margin", "effective_tax_rate", "free_cash_flow", "net_debt", "working_capital")
    return rounded(rows, "revenue", "free_cash_flow", "net_debt", "working_capital", "gross_margin", "operating_margin", "net_margin", "effective_tax_rate")


@query("q_growth", "with " + GROWTH_SQL + " select ticker, fiscal_year, round(growth, 6) as growth from growths")
def q_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.growth(history(spark, sf_dir)), "growth")


@query("q_cagr", "with " + HISTORY_SQL + """ select ticker, n, round(case when n >= 2 and a > 0 and b > 0 then pow(b / a, 1.0 / (n - 1)) - 1 end, 6) as cagr
  from (select ticker, count(total_debt) as n, arg_min(total_debt, fiscal_year) filter (total_debt is not null) as a, arg_max(total_debt, fiscal_year) filter (total_debt is not null) as b from hist where total_debt is not null group by ticker)""")
def q_cagr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a series with gaps."""
    return rounded(H.cagr(history(spark, sf_dir), "total_debt"), "cagr")


@query("q_means", "with " + GROWTH_SQL + """, mean as (select ticker, avg(working_capital) as m from (select ticker, working_capital, row_number() over (partition by ticker order by fiscal_year desc) as k from ratios where working_capital is not null) where k <= 3 group by ticker)
  select ticker, round(m, 2) as mean, round(x.ratio, 6) as ratio from (select ticker, avg(abs(capex) / nullif(revenue, 0)) as ratio from ranked where r <= 3 group by ticker) x left join mean using (ticker)""")
def q_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = history(spark, sf_dir)
    rows = H.ratio_to_revenue(hist, "capex").join(H.mean_last(H.with_ratios(hist), "working_capital", 3), "ticker", "left")
    return rounded(rounded(rows, "ratio"), "mean", digits=2)


@query("q_steady", "with " + GROWTH_SQL + " select ticker, count(*) >= 3 and bool_and(growth > 0) and stddev_pop(growth) / avg(growth) < 0.5 as steady from granked where r <= 4 group by ticker")
def q_steady(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.steady(H.growth(history(spark, sf_dir)))


@query("q_working_capital", "with " + MARKET_SQL + " select t.ticker, round(case when seen is null then 0.05 else least(seen[len(seen) // 2 + 1], 0.25) end, 6) as wc_share, cast(coalesce(len(seen), 0) as int) as observations from (select distinct ticker from hist) t left join wc using (ticker)")
def q_working_capital(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(H.working_capital_share(history(spark, sf_dir)), "wc_share")


@query("q_sufficient", "with " + RATIOS_SQL + " select ticker, count(revenue) as revenues, count(free_cash_flow) as flows, count(revenue) >= 2 and count(free_cash_flow) >= 1 as sufficient from ratios group by ticker")
def q_sufficient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.sufficient(history(spark, sf_dir))


@query("q_fingerprint", "with " + RATIOS_SQL + """ select ticker, substring(sha256(string_agg(line, '|' order by line)), 1, 16) as fingerprint from (select ticker, fiscal_year || ':' || coalesce(cast(cast(round(revenue) as bigint) as varchar), '') || ':'
  || coalesce(cast(cast(round(operating_margin * 10000) as bigint) as varchar), '') || ':' || coalesce(cast(cast(round(free_cash_flow) as bigint) as varchar), '') as line from ratios) group by ticker""")
def q_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.fingerprint(history(spark, sf_dir))


@query("q_wacc", "with " + MARKET_SQL + " select ticker, round(beta_dcf, 8) as beta_dcf, erp, size_premium, round(tax_rate, 8) as tax_rate, round(cost_of_equity, 8) as cost_of_equity, round(wacc, 8) as wacc from rates")
def q_wacc(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = history(spark, sf_dir)
    return rounded(V.discount_rates(hist, market(hist)), "beta_dcf", "tax_rate", "cost_of_equity", "wacc", digits=8)


_INPUT_NAMES = ["normal_growth", "year_one_growth", "terminal_growth", "current_margin", "terminal_margin", "decay", "depreciation_share", "capex_share", "wc_share", "tax_rate", "wacc"]


@query("q_forecast_inputs", "with " + INPUTS_SQL + " select ticker, base_year, steady, " + ", ".join(f"round({n}, 8) as {n}" for n in _INPUT_NAMES) + " from inputs")
def q_forecast_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(inputs(spark, sf_dir)[0].select("ticker", "base_year", "steady", *_INPUT_NAMES), *_INPUT_NAMES, digits=8)


@query("q_paths", "with " + INPUTS_SQL + f", p as (select ticker, current_margin, terminal_margin, unnest(range(0, 10)) as t, unnest({path_sql()}) as growth from inputs) select ticker, t, round(growth, 6) as growth, round(current_margin + (terminal_margin - current_margin) / 9 * t, 6) as margin from p")
def q_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs(spark, sf_dir)[0]
    paths = F.arrays_zip(X.decay_path(c("year_one_growth"), c("terminal_growth"), 10, c("decay")).alias("growth"), X.fade_path(c("current_margin"), c("terminal_margin"), 10).alias("margin"))
    out = rows.select("ticker", F.posexplode(paths).alias("t", "p")).select("ticker", c("t").cast("long").alias("t"), c("p.growth").alias("growth"), c("p.margin").alias("margin"))
    return rounded(out, "growth", "margin")


@query("q_dcf", "with " + INPUTS_SQL + f", v as (select ticker, {ev_sql()[0]} as ev, {ev_sql()[1]} as pv_terminal, {fair_sql()} as fair_value from inputs where terminal_growth < wacc) select ticker, round(ev, 2) as ev, round(pv_terminal, 2) as pv_terminal, round(fair_value, 4) as fair_value, round(case when ev > 0 then pv_terminal / ev else 0 end, 6) as tv_share from v")
def q_dcf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: revenue history to a value per share, in one plan."""
    rows = V.valued(inputs(spark, sf_dir)[0]).filter("ev is not null").select("ticker", "ev", "pv_terminal", "fair_value", "tv_share")
    return rounded(rounded(rounded(rows, "ev", "pv_terminal", digits=2), "fair_value", digits=4), "tv_share")


@query("q_dcf_years", "with " + INPUTS_SQL + f", y as (select *, cast(unnest(range(0, 10)) as bigint) as i, unnest({path_sql()}) as growth from inputs) select ticker, cast(base_year + i + 1 as int) as year, round({flows_sql()[0]}, 2) as revenue, round(growth, 6) as growth, round({flows_sql()[1]}, 2) as free_cash_flow, round(1 / pow(1 + wacc, i + 1), 6) as discount_factor, round({flows_sql()[1]} / pow(1 + wacc, i + 1), 2) as present_value from y")
def q_dcf_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.forecast_years(inputs(spark, sf_dir)[0]).drop("margin")
    return rounded(rounded(rows, "growth", "discount_factor"), "revenue", "free_cash_flow", "present_value", digits=2)


@query("q_sensitivity", "with " + INPUTS_SQL + f", g as (select *, unnest([-0.02::double, -0.01, 0, 0.01, 0.02]) as dw from inputs), h as (select *, unnest([-0.01::double, -0.005, 0, 0.005, 0.01]) as dg from g) select ticker, dw, dg, round(case when terminal_growth + dg >= wacc + dw then 'nan'::double else {fair_sql(path_sql(), w='wacc + dw', end='terminal_growth + dg')} end, 4) as fair_value from h")
def q_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.sensitivity(inputs(spark, sf_dir)[0]), "fair_value", digits=4)


_CUT = f"list_transform({path_sql()}, lambda x: greatest(x - haircut, terminal_growth))"


@query("q_competition", "with " + INPUTS_SQL + f""", b as (select *, {fair_sql()} as fair0, unnest([0.02::double, 0.05, 0.10]) as haircut from inputs where terminal_growth < wacc),
  k as (select ticker, haircut, pow(list_product(list_transform({_CUT}, lambda x: 1 + x)), 0.1::double) - 1 as revenue_cagr, list_product(list_transform({_CUT}, lambda x: 1 + x)) / list_product(list_transform({path_sql()}, lambda x: 1 + x)) - 1 as revenue_change,
    ({fair_sql(_CUT)}) / fair0 - 1 as value_change from b where fair0 > 0) select ticker, haircut, round(revenue_cagr, 6) as revenue_cagr, round(revenue_change, 6) as revenue_change, round(value_change, 6) as value_change from k""")
def q_competition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(V.competition(inputs(spark, sf_dir)[0]), "revenue_cagr", "revenue_change", "value_change")


SCENARIO_SQL = INPUTS_SQL + f""",
spread as (select h.ticker, case when g.s is null then 0.125 else greatest(least(g.s, 0.20), 0.05) end as gs, case when h.s is null then 0.07 else greatest(least(h.s, 0.12), 0.02) end as ms, lo, hi
  from (select ticker, case when count(operating_margin) >= 2 then stddev_pop(operating_margin) end as s, min(operating_margin) as lo, max(operating_margin) as hi from ratios group by ticker) h
  left join (select ticker, case when count(*) >= 2 then stddev_pop(growth) end as s from growths group by ticker) g using (ticker)),
cases0 as (
  select i.*, 'bear' as scenario, 0.25::double as probability, greatest(year_one_growth - gs, greatest(terminal_growth - 0.005, 0.01)) as sg, greatest(greatest(terminal_margin - ms, lo), 0) as sm, greatest(terminal_growth - 0.005, 0.01) as st, least(wacc + 0.015, 0.20) as sw from inputs i join spread using (ticker)
  union all select i.*, 'base', 0.5, year_one_growth, terminal_margin, terminal_growth, wacc from inputs i join spread using (ticker)
  union all select i.*, 'bull', 0.25, least(year_one_growth + gs, 0.75), least(terminal_margin + ms, hi), least(terminal_growth + 0.005, 0.04), greatest(wacc - 0.015, 0.05) from inputs i join spread using (ticker)),
cases1 as (select * replace (least(st, sw - 0.005) as st) from cases0),
cases as (select ticker, scenario, probability, sg, sm, st, sw, {fair_sql(g='sg', tg='st', tm='sm', w='sw')} as fair_value from cases1 where st < sw)
"""


@query("q_scenarios", "with " + SCENARIO_SQL + " select ticker, scenario, probability, round(sg, 8) as year_one_growth, round(sm, 8) as terminal_margin, round(st, 8) as terminal_growth, round(sw, 8) as wacc, round(fair_value, 4) as fair_value from cases")
def q_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, hist, _ = inputs(spark, sf_dir)
    return rounded(rounded(V.scenarios(rows, hist).drop("tv_share"), "year_one_growth", "terminal_margin", "terminal_growth", "wacc", digits=8), "fair_value", digits=4)


@query("q_expected_value", "with " + SCENARIO_SQL + """ select ticker, n_cases, round(expected_value, 4) as expected_value, round(low, 4) as low, round(high, 4) as high, round(base_value, 4) as base_value, round((high - low) / nullif(base_value, 0), 6) as dispersion
  from (select ticker, count(*) as n_cases, sum(probability * fair_value) / sum(probability) as expected_value, min(nullif(fair_value, 0)) as low, max(nullif(fair_value, 0)) as high, max(fair_value) filter (scenario = 'base') as base_value from cases group by ticker)""")
def q_expected_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, hist, _ = inputs(spark, sf_dir)
    return rounded(rounded(V.expected(V.scenarios(rows, hist)), "expected_value", "low", "high", "base_value", digits=4), "dispersion")


def _bisect_sql(name: str, value, lo: str, hi: str, steps: int) -> str:
    """CTEs that halve [lo, hi] ``steps`` times; ``value(x)`` is the value at x as SQL."""
    return f""",
{name}_0 as (select *, {lo} as lo, {hi} as hi, 0 as step, ({value(hi)}) >= ({value(lo)}) as rising from priced where price between least({value(lo)}, {value(hi)}) and greatest({value(lo)}, {value(hi)})),
{name} as (select * from {name}_0 union all select * replace (case when (({value('((lo + hi) / 2)')}) < price) = rising then (lo + hi) / 2 else lo end as lo, case when (({value('((lo + hi) / 2)')}) < price) = rising then hi else (lo + hi) / 2 end as hi, step + 1 as step) from {name} where step < {steps})"""


IMPLIED_SQL = INPUTS_SQL.replace("lines as", "lines as", 1) + f""",
priced as (select i.*, {fair_sql()} * 1.08 as price from inputs i where terminal_growth < wacc and {fair_sql()} > 0)""" + _bisect_sql(
    "grow", lambda x: fair_sql(g=x), "-0.5::double", "3.0::double", 13)


@query("q_implied_growth", "with recursive " + IMPLIED_SQL + " select ticker, round((lo + hi) / 2, 3) as implied_growth from grow where step = 13")
def q_implied_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first-year growth that explains a price 8 % above the value."""
    rows = inputs(spark, sf_dir)[0]
    prices = V.valued(rows).filter("fair_value > 0").select("ticker", (c("fair_value") * 1.08).alias("price"))
    found = V.priced_in(rows, prices).filter("lever = 'revenue_cagr' and reachable")
    return rounded(found.select("ticker", "implied_growth"), "implied_growth", digits=3)


def _final(k: str, **more: str) -> str:
    """A figure of the last year: 0 its revenue, 1 its cash flow."""
    return f"list_sum(list_transform([9], lambda i: {flows_sql(**more)[int(k)]}))"


def _cagr_sql(g: str) -> str:
    return f"pow(list_product(list_transform({path_sql(g)}, lambda x: 1 + x)), 0.1::double) - 1"


PRICED_SQL = INPUTS_SQL + """,
priced as (select i.*, m.price from inputs i join (select ticker, price from market) m using (ticker) where terminal_growth < wacc and price > 0 and shares > 0 and base_revenue > 0)""" + _bisect_sql(
    "s_growth", lambda x: fair_sql(g=x), "-0.5::double", "3.0::double", 13) + _bisect_sql(
    "s_margin", lambda x: fair_sql(tm=x), "0.0::double", "1.0::double", 11) + _bisect_sql(
    "s_capex", lambda x: fair_sql(capex=x), "0.0::double", "(capex_share + 1.0::double)", 12) + _bisect_sql(
    "s_end", lambda x: fair_sql(tg=x), "0.0::double", "(wacc - 0.0025::double)", 11) + f""",
solved as (select p.*, (g.lo + g.hi) / 2 as i_growth, (m.lo + m.hi) / 2 as i_margin, (k.lo + k.hi) / 2 as i_capex, (e.lo + e.hi) / 2 as i_end from priced p left join (select ticker, lo, hi from s_growth where step = 13) g using (ticker)
  left join (select ticker, lo, hi from s_margin where step = 11) m using (ticker) left join (select ticker, lo, hi from s_capex where step = 12) k using (ticker) left join (select ticker, lo, hi from s_end where step = 11) e using (ticker)),
levers as (select ticker, 'revenue_cagr' as lever, 0 as seq, i_growth, {_cagr_sql('year_one_growth')} as base_value, case when i_growth is not null then {_cagr_sql('i_growth')} end as implied_value from solved
  union all select ticker, 'operating_margin', 1, i_growth, terminal_margin, i_margin from solved
  union all select ticker, 'fcf_margin', 2, i_growth, {_final('1')} / nullif({_final('0')}, 0), case when i_capex is not null then {_final('1', capex='i_capex')} / nullif({_final('0')}, 0) end from solved
  union all select ticker, 'terminal_growth', 3, i_growth, terminal_growth, i_end from solved)"""


@query("q_priced_in", "with recursive " + PRICED_SQL + """, w as (select ticker, lever as widest from levers where implied_value is not null qualify row_number() over (partition by ticker order by implied_value - base_value desc, seq) = 1)
 select ticker, lever, seq, round(i_growth, 4) as implied_growth, round(base_value, 4) as base_value, round(implied_value, 4) as implied_value, implied_value is not null as reachable, widest from levers left join w using (ticker)""")
def q_priced_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, mkt = inputs(spark, sf_dir)
    found = V.priced_in(rows, mkt.select("ticker", "price"))
    best = V.widest_lever(found).withColumnRenamed("lever", "widest")
    return rounded(found.join(best, "ticker", "left"), "implied_growth", "base_value", "implied_value", digits=4)


PEERS_SQL = MARKET_SQL + """,
peers as (select split_part(ticker, '-', 1) as peer_group, price * shares / nullif(net_income, 0) as pe, n % 2 = 0 as direct, case when n % 13 <> 0 then market_cap end as cap from market),
medians as (select peer_group, coalesce(median(pe) filter (direct and pe > 0), median(pe) filter (pe > 0)) as median_pe, count(*) as n_peers from peers where cap is not null group by peer_group),
comps as (select m.ticker, n_peers, median_pe, case when net_income > 0 then median_pe * (net_income / case when shares > 0 then shares end) end as implied_value, case when n_peers is null then 'not covered' end as note
  from (select *, case when n % 17 = 0 then 'none' else split_part(ticker, '-', 1) end as peer_group from market) m left join medians using (peer_group))
"""


def comps_of(hist: DataFrame, mkt: DataFrame) -> DataFrame:
    last = H.latest(hist).select("ticker", "net_income", c("diluted_shares").alias("shares"))
    rows = mkt.join(last, "ticker")
    group = F.substring_index("ticker", "-", 1)
    peers = rows.select(group.alias("peer_group"), (c("price") * c("shares") / X.nonzero(c("net_income"))).alias("pe"), (c("n") % 2 == 0).alias("direct"), F.when(c("n") % 13 != 0, c("market_cap")).alias("market_cap"))
    subjects = rows.select("ticker", F.when(c("n") % 17 == 0, "none").otherwise(group).alias("peer_group"), "net_income", "shares")
    return V.comps(subjects, peers)


@query("q_comps", "with " + PEERS_SQL + " select ticker, n_peers, round(median_pe, 6) as median_pe, round(implied_value, 4) as implied_value, note from comps")
def q_comps(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = history(spark, sf_dir)
    return rounded(rounded(comps_of(hist, market(hist)), "median_pe"), "implied_value", digits=4)


BLEND_SQL = MARKET_SQL + """,
est as (select split_part(ticker, '-', 1) as ticker, price as value, greatest(least((n % 40) / 12.0::double, 3.0), 1.0) as weight from market),
mid as (select ticker, median(value) as mid, count(*) as n from est where value > 0 group by ticker),
near as (select e.*, m.n, value between 0.40 * mid and 2.50 * mid as near, count(*) filter (value between 0.40 * mid and 2.50 * mid) over (partition by ticker) as n_near from est e join mid m using (ticker) where value > 0)
select ticker, round(sum(value * weight) / sum(weight), 4) as blended, round(min(value), 4) as low, round(max(value), 4) as high, count(*) as n_included from near where n < 3 or n_near < 2 or near group by ticker
"""


@query("q_blend", "with " + BLEND_SQL)
def q_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A market segment's blended price from its companies' prices, weighted by analysts."""
    mkt = market(history(spark, sf_dir))
    est = mkt.select(F.substring_index("ticker", "-", 1).alias("ticker"), c("price").alias("value"), V.analyst_weight(c("analysts")).alias("weight"))
    return rounded(V.blend(est), "blended", "low", "high", digits=4)


SEGMENTS_SQL = INPUTS_SQL + """,
seg as (select ticker, l_returnflag as segment, fiscal_year, sum(cast(round(l_extendedprice * (1 - l_discount) * 10000) as bigint)) / 10000 as revenue from lines group by all),
sr as (select *, row_number() over (partition by ticker, segment order by fiscal_year desc) as k from seg where revenue > 0),
s2 as (select ticker, segment, max(revenue) filter (k = 1) as last, max(revenue) filter (k = 2) as prev from sr group by all),
s3 as (select s.*, base_revenue, year_one_growth, terminal_growth, decay, coalesce(greatest(least(last / prev - 1, 0.75), -0.30), year_one_growth) as own from s2 s join inputs using (ticker)),
s4 as (select *, last * list_product(list_transform(range(0, 10), lambda k: 1 + (0.025::double + (own - 0.025::double) * pow(0.70::double, k)))) as final, base_revenue * list_product(list_transform(range(0, 10), lambda k: 1 + (terminal_growth + (year_one_growth - terminal_growth) * pow(decay, k)))) as top from s3),
s5 as (select ticker, sum(final) as bottom_up, max(top) as top_down, count(*) as n_segments from s4 group by ticker)
select ticker, round(bottom_up, 2) as bottom_up, round(top_down, 2) as top_down, n_segments, round(bottom_up / nullif(top_down, 0) - 1, 6) as gap, abs(bottom_up / nullif(top_down, 0) - 1) <= 0.15 as reconciles from s5 where abs(bottom_up / nullif(top_down, 0) - 1) <= 0.35
"""


@query("q_segments", "with " + SEGMENTS_SQL)
def q_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = c("l_extendedprice") * (1 - c("l_discount"))
    seg = full_year_lines(spark, sf_dir).groupBy("ticker", c("l_returnflag").alias("segment"), "fiscal_year").agg((F.sum(F.round(net * 10000).cast("long")) / 10000).alias("revenue"))
    return rounded(rounded(V.segment_forecast(seg, inputs(spark, sf_dir)[0]), "bottom_up", "top_down", digits=2), "gap")


VERDICT_SQL = INPUTS_SQL + f""",
v as (select ticker, price, {fair_sql()} as headline from inputs join (select ticker, price from market) m using (ticker))
select ticker, round(headline, 4) as headline, round(case when headline > 0 and price <> 0 then headline / price - 1 end, 6) as upside,
  case when not (headline > 0 and price <> 0) then 'NOT RATED' when headline / price - 1 >= 0.15 then 'BUY' when headline / price - 1 >= -0.10 then 'HOLD' else 'SELL' end as rating from v
"""


@query("q_ratings", "with " + VERDICT_SQL)
def q_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _, mkt = inputs(spark, sf_dir)
    values = V.valued(rows).select("ticker", c("fair_value").alias("dcf_value"), F.lit(0.0).alias("blended"))
    return rounded(rounded(V.verdicts(values, mkt.select("ticker", "price")), "headline", digits=4), "upside")


# What DCF, cases, peers and the market say of a company.
WHOLE_SQL = SCENARIO_SQL + PEERS_SQL[len(MARKET_SQL):].replace("comps as", "peer_values as") + f""",
base as (select ticker, wacc, case when terminal_growth < wacc then {fair_sql()} end as fair, case when terminal_growth < wacc and {ev_sql()[0]} > 0 then {ev_sql()[1]} / {ev_sql()[0]} else 0 end as tv from inputs),
e as (select ticker, sum(probability * fair_value) / sum(probability) as expected_value, min(nullif(fair_value, 0)) as low, max(nullif(fair_value, 0)) as high, max(fair_value) filter (scenario = 'base') as mid from cases group by ticker),
whole as (select b.*, e.expected_value, low, high, (high - low) / nullif(mid, 0) as dispersion, p.implied_value as comps_value, m.price, coalesce(case when m.n % 4 <> 0 then m.price * 1.15::double end, m.price * 1.1::double) as consensus
  from base b join market m using (ticker) left join e using (ticker) left join peer_values p using (ticker)),
judged as (select *, abs(comps_value / nullif(fair, 0) - 1) as away, abs(fair / nullif(consensus, 0) - 1) > 0.35 as far_c, abs(fair / nullif(price, 0) - 1) > 0.35 as far_p, case when fair > 0 and price <> 0 then fair / price - 1 end as upside from whole),
scored as (select *, (case when dispersion > 1.5 then 2 when dispersion > 0.8 then 1 else 0 end) + (case when tv > 0.80 then 2 when tv > 0.65 then 1 else 0 end) + (case when away > 0.5 then 2 when away > 0.25 then 1 else 0 end) as points,
  list_filter([case when fair is null or fair <= 0 then 'degenerate DCF' end, case when far_c then 'far from consensus' end, case when price < low or price > high then 'price outside scenarios' end, case when dispersion > 1.5 then 'wide scenarios' end,
    case when tv > 0.80 then 'mostly terminal value' end, case when far_p and far_c then 'outlier on both sides' end], lambda x: x is not null) as warned from judged)
"""


@query("q_valuation", "with " + WHOLE_SQL + """ select ticker, round(fair, 4) as fair_value, round(wacc, 4) as wacc, round(expected_value, 4) as expected_value, round(comps_value, 4) as comps_value, round(dispersion, 4) as dispersion, round(fair, 4) as headline, round(upside, 4) as upside,
 case when upside is null then 'NOT RATED' when upside >= 0.15 then 'BUY' when upside >= -0.10 then 'HOLD' else 'SELL' end as rating, points, case when points >= 4 then 'Low' when points >= 2 then 'Medium' else 'High' end as confidence,
 array_to_string(list_filter([case when dispersion > 0.8 then 'scenarios apart' end, case when tv > 0.65 then 'terminal value' end, case when away > 0.25 then 'peers disagree' end], lambda x: x is not null), ',') as drivers, array_to_string(warned, ';') as warnings, cast(len(warned) as int) as n_warnings from scored""")
def q_valuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole valuation: DCF, scenarios, comps, blend, verdict, confidence and warnings of every company."""
    rows, hist, mkt = inputs(spark, sf_dir)
    base = V.valued(rows).select("ticker", "fair_value", "tv_share", "wacc")
    cases = V.expected(V.scenarios(rows, hist))
    peer = comps_of(hist, mkt).select("ticker", c("implied_value").alias("comps_value"))
    whole = base.join(cases, "ticker", "left").join(peer, "ticker", "left").join(mkt.select("ticker", "price", F.coalesce("target_median", "target_mean").alias("consensus")), "ticker")
    doubts = V.confidence(whole.withColumn("dcf_value", c("fair_value")))
    notes = V.warnings(whole)
    verdict = V.verdicts(whole.select("ticker", c("fair_value").alias("dcf_value"), F.lit(None).cast("double").alias("blended")), mkt.select("ticker", "price"))
    out = whole.select("ticker", "fair_value", "wacc", "expected_value", "comps_value", "dispersion").join(verdict, "ticker").join(doubts, "ticker").join(notes, "ticker")
    return rounded(out, "fair_value", "wacc", "expected_value", "comps_value", "dispersion", "headline", "upside", digits=4)
