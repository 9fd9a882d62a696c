"""Valuation of many companies in one plan: discount rates, forecast inputs, DCF, grids, scenarios, solves, blends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions import exprs as X
from tallyloom.operators import history as H
from tallyloom.settings import DEFAULTS, Settings

c = F.col


def discount_rates(history: DataFrame, market: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """beta, cost of equity, tax and wacc per ticker.

    ``market``: ticker, country, beta, market_cap, usd_rate.  Without debt or market value the rate is the
    cost of equity, unbounded; with both it is weighted and bounded.
    """
    recent = H.last_years(H.with_ratios(history), 3)
    taxes = recent.groupBy("ticker").agg(F.avg("effective_tax_rate").alias("mean_tax"))
    debt = H.latest(history).select("ticker", F.coalesce("total_debt", F.lit(0.0)).alias("debt"))
    rows = market.join(taxes, "ticker", "left").join(debt, "ticker", "left")
    raw = F.coalesce(c("beta"), F.lit(1.0))
    rows = rows.withColumn("beta_adjusted", X.clamp(s.blume[0] * raw + s.blume[1], *s.beta_bounds))
    rows = rows.withColumn("beta_dcf", s.beta_horizon_weight * c("beta_adjusted") + (1 - s.beta_horizon_weight))
    rows = rows.withColumn("erp", X.by_map(c("country"), s.erp_by_country, s.erp)).withColumn("size_premium", X.tier(c("market_cap") * c("usd_rate"), s.size_tiers))
    rows = rows.withColumn("tax_rate", F.coalesce(c("mean_tax"), X.by_map(c("country"), s.tax_by_country, s.tax)))
    rows = rows.withColumn("cost_of_equity", F.lit(s.risk_free) + c("beta_dcf") * c("erp") + c("size_premium"))
    equity = F.coalesce(c("market_cap"), F.lit(0.0))
    total = equity + c("debt")
    levered = equity / total * c("cost_of_equity") + c("debt") / total * (s.risk_free + s.credit_spread) * (1 - c("tax_rate"))
    wacc = F.when((equity <= 0) | (c("debt") <= 0), c("cost_of_equity")).otherwise(X.clamp(levered, *s.wacc_bounds))
    return rows.select("ticker", "beta_dcf", "erp", "size_premium", "tax_rate", "cost_of_equity", wacc.alias("wacc"))


def forecast_inputs(history: DataFrame, rates: DataFrame, proposals: DataFrame | None = None, overrides: DataFrame | None = None, s: Settings = DEFAULTS) -> DataFrame:
    """One row of forecast inputs per ticker that has a revenue.

    ``proposals`` and ``overrides``: ticker, year_one_growth, terminal_growth, terminal_margin, each of which
    may be null.  A proposal is bounded by what the history supports; an override only by sanity.
    """
    newest = H.with_ratios(H.latest(history)).filter("revenue <> 0")
    growths = H.growth(history)
    recent = growths.groupBy("ticker").agg(F.max_by("growth", "fiscal_year").alias("recent"))
    mean3 = H.last_years(growths, 3).groupBy("ticker").agg(F.avg("growth").alias("mean_growth"))
    margins = H.with_ratios(history)
    margin3 = H.mean_last(margins, "operating_margin", 3).withColumnRenamed("mean", "mean_margin")
    parts = [
        recent, mean3, H.steady(growths), margin3, H.working_capital_share(history).drop("observations"),
        H.ratio_to_revenue(history, "depreciation").withColumnRenamed("ratio", "depreciation_share"),
        H.ratio_to_revenue(history, "capex").withColumnRenamed("ratio", "capex_share"), rates.select("ticker", "tax_rate", "wacc"),
    ]
    keep = ["ticker", c("fiscal_year").alias("base_year"), c("revenue").alias("base_revenue"), "operating_margin", c("net_debt").alias("known_debt"), c("diluted_shares").alias("shares"), "net_income"]
    rows = reduce(lambda a, b: a.join(b, "ticker", "left"), parts, newest.select(*keep))
    for extra, mark in ((proposals, "p"), (overrides, "o")):
        names = ["year_one_growth", "terminal_growth", "terminal_margin"]
        if extra is None:
            rows = rows.withColumns({f"{mark}_{n}": F.lit(None).cast("double") for n in names})
        else:
            rows = rows.join(extra.select("ticker", *(c(n).cast("double").alias(f"{mark}_{n}") for n in names)), "ticker", "left")
    recent_g, mean_g = F.coalesce("recent", F.lit(0.05)), F.coalesce("mean_growth", F.lit(0.05))
    normal = F.when((recent_g > 0) & (recent_g < 0.15) & (mean_g > recent_g), (recent_g + mean_g) / 2).otherwise(recent_g)
    rows = rows.withColumn("normal_growth", normal).withColumn("margin3", F.coalesce("mean_margin", F.lit(0.15)))
    tg = F.coalesce(X.clamp(c("p_terminal_growth"), *s.terminal_growth_bounds), F.lit(s.terminal_growth))
    rows = rows.withColumn("tg0", tg).withColumn("ceiling", F.least(F.greatest(c("normal_growth"), F.lit(0.05)), F.lit(s.max_year_one_growth)))
    floor = F.when(c("normal_growth") > 0, F.least(F.greatest(c("tg0"), c("normal_growth") * 0.5), c("ceiling"))).otherwise(s.min_year_one_growth)
    g1 = F.coalesce(X.clamp(c("p_year_one_growth"), floor, c("ceiling")), F.least(c("normal_growth"), c("ceiling")))
    tm = F.coalesce(X.clamp(c("p_terminal_margin"), *s.margin_bounds), c("margin3"))
    rows = rows.withColumns({
        "year_one_growth": F.coalesce(X.clamp(c("o_year_one_growth"), -0.9, 5.0), g1),
        "terminal_growth": F.coalesce(X.clamp(c("o_terminal_growth"), 0.0, 0.06), c("tg0")),
        "terminal_margin": F.coalesce(X.clamp(c("o_terminal_margin"), 0.0, 0.95), tm),
        "current_margin": F.coalesce(X.nonzero(c("operating_margin")), c("margin3")),
        "depreciation_share": F.coalesce(X.nonzero(c("depreciation_share")), F.lit(0.03)),
        "capex_share": F.coalesce(X.nonzero(c("capex_share")), F.lit(0.04)),
        "net_debt": F.coalesce("known_debt", F.lit(0.0)), "steady": F.coalesce("steady", F.lit(False)),
    }).withColumn("decay", X.decay_rate(c("year_one_growth"), c("steady")))
    names = ["ticker", "base_year", "base_revenue", "normal_growth", "year_one_growth", "terminal_growth", "current_margin", "terminal_margin", "steady", "decay", "depreciation_share", "capex_share", "wc_share", "tax_rate", "wacc", "net_debt", "shares", "net_income"]
    return rows.select(*names)


def dcf_at(
    s: Settings = DEFAULTS, *, growth: Column | None = None, margin: Column | None = None, year_one: Column | None = None, terminal_growth: Column | None = None,
    terminal_margin: Column | None = None, wacc: Column | None = None, capex: Column | None = None,
) -> Column:
    """The DCF of a row of forecast inputs, with any of its drivers replaced."""
    pick = lambda given, name: c(name) if given is None else given
    tg, n = pick(terminal_growth, "terminal_growth"), s.horizon
    path = X.decay_path(pick(year_one, "year_one_growth"), tg, n, c("decay")) if growth is None else growth
    fade = X.fade_path(c("current_margin"), pick(terminal_margin, "terminal_margin"), n) if margin is None else margin
    return X.dcf(
        revenue=c("base_revenue"), growth=path, margin=fade, tax=c("tax_rate"), depreciation=c("depreciation_share"), capex=pick(capex, "capex_share"),
        working_capital=c("wc_share"), wacc=pick(wacc, "wacc"), terminal_growth=tg, net_debt=c("net_debt"), shares=c("shares"),
    )


def valued(inputs: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    rows = inputs.withColumn("d", dcf_at(s)).select("*", "d.*").drop("d")
    return rows.withColumn("tv_share", X.terminal_share(c("pv_terminal"), c("ev")))


def forecast_years(inputs: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """A row per forecast year; revenue is carried along the path by one fold."""
    growth = X.decay_path(c("year_one_growth"), c("terminal_growth"), s.horizon, c("decay"))
    margin = X.fade_path(c("current_margin"), c("terminal_margin"), s.horizon)
    steps = F.zip_with(growth, margin, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    start = F.array(F.struct(c("base_revenue").cast("double").alias("revenue"), F.lit(0.0).alias("g"), F.lit(0.0).alias("m"), F.lit(0.0).alias("before")))

    def grow(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)["revenue"]
        return F.concat(acc, F.array(F.struct((last * (1 + x["g"])).alias("revenue"), x["g"].alias("g"), x["m"].alias("m"), last.alias("before"))))

    years = inputs.select("*", F.posexplode(F.aggregate(steps, start, grow)).alias("t", "y")).filter("t > 0").select("*", "y.*").drop("y")
    flow = c("revenue") * c("m") * (1 - c("tax_rate")) + c("revenue") * c("depreciation_share") - c("revenue") * c("capex_share") - (c("revenue") - c("before")) * c("wc_share")
    years = years.withColumn("free_cash_flow", flow).withColumn("discount_factor", F.lit(1.0) / F.pow(1 + c("wacc"), c("t")))
    return years.select("ticker", (c("base_year") + c("t")).alias("year"), "revenue", c("g").alias("growth"), c("m").alias("margin"), "free_cash_flow", "discount_factor", (c("free_cash_flow") * c("discount_factor")).alias("present_value"))


def sensitivity(inputs: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Values over shifted rates and terminal growth, on the same paths; NaN where growth isn't below the rate."""
    grid = F.explode(F.array(*(F.struct(F.lit(a).alias("dw"), F.lit(b).alias("dg")) for a in s.grid_steps for b in s.grid_growth_steps)))
    growth = X.decay_path(c("year_one_growth"), c("terminal_growth"), s.horizon, c("decay"))
    rows = inputs.withColumn("path", growth).withColumn("x", grid).withColumns({"w": c("wacc") + c("x.dw"), "g": c("terminal_growth") + c("x.dg")})
    value = dcf_at(s, growth=c("path"), terminal_growth=c("g"), wacc=c("w"))["fair_value"]
    return rows.select("ticker", c("x.dw").alias("dw"), c("x.dg").alias("dg"), F.when(c("g") >= c("w"), F.lit(float("nan"))).otherwise(value).alias("fair_value"))


def competition(inputs: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """What lower growth in every year does to revenue and value; none where the base value isn't above 0."""
    base = valued(inputs, s).filter("fair_value > 0").withColumn("haircut", F.explode(F.array(*map(F.lit, s.competition_haircuts))))
    path = X.decay_path(c("year_one_growth"), c("terminal_growth"), s.horizon, c("decay"))
    base = base.withColumn("path", F.transform(path, lambda g: F.greatest(g - c("haircut"), c("terminal_growth"))))
    base = base.withColumn("cut", dcf_at(s, growth=c("path")))
    return base.select("ticker", "haircut", X.path_cagr(c("path"), s.horizon).alias("revenue_cagr"), (c("cut.final_revenue") / c("final_revenue") - 1).alias("revenue_change"), (c("cut.fair_value") / c("fair_value") - 1).alias("value_change"))


def spreads(history: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """How far the bear and bull cases move growth and margin."""
    sigma = lambda x: F.when(F.count(x) >= 2, F.stddev_pop(x))
    mid = lambda b: (b[0] + b[1]) / 2
    growth = H.growth(history).groupBy("ticker").agg(sigma("growth").alias("sg"))
    margin = H.with_ratios(history).groupBy("ticker").agg(sigma("operating_margin").alias("sm"), F.min("operating_margin").alias("lowest"), F.max("operating_margin").alias("highest"))
    rows = margin.join(growth, "ticker", "left")
    return rows.select(
        "ticker", F.coalesce(X.clamp(c("sg"), *s.growth_spread_bounds), F.lit(mid(s.growth_spread_bounds))).alias("growth_spread"),
        F.coalesce(X.clamp(c("sm"), *s.margin_spread_bounds), F.lit(mid(s.margin_spread_bounds))).alias("margin_spread"), "lowest", "highest",
    )


def scenarios(inputs: DataFrame, history: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Bear, base and bull cases; a case without a finite value is left out."""
    rows = inputs.join(spreads(history, s), "ticker")
    tm, g, tg, w = c("terminal_margin"), c("year_one_growth"), c("terminal_growth"), c("wacc")
    bear_tg = F.greatest(tg - s.scenario_growth_shift, F.lit(s.terminal_growth_bounds[0]))
    bull_tg = F.least(tg + s.scenario_growth_shift, F.lit(s.terminal_growth_bounds[1]))

    def case(key: str, p: float, growth: Column, margin: Column, end: Column, rate: Column) -> Column:
        return F.struct(F.lit(key).alias("scenario"), F.lit(p).alias("probability"), growth.alias("sg"), margin.alias("sm"), end.alias("st"), rate.alias("sw"))

    cases = F.array(
        case("bear", s.scenario_probability[0], F.greatest(g - c("growth_spread"), bear_tg), F.greatest(F.greatest(tm - c("margin_spread"), c("lowest")), F.lit(0.0)), bear_tg, F.least(w + s.scenario_wacc_shift, F.lit(s.wacc_bounds[1]))),
        case("base", s.scenario_probability[1], g, tm, tg, w),
        case("bull", s.scenario_probability[2], F.least(g + c("growth_spread"), F.lit(s.max_year_one_growth)), F.least(tm + c("margin_spread"), c("highest")), bull_tg, F.greatest(w - s.scenario_wacc_shift, F.lit(s.wacc_bounds[0]))),
    )
    rows = rows.select("*", F.explode(cases).alias("k")).select("*", "k.*").withColumn("st", F.least(c("st"), c("sw") - s.wacc_growth_gap))
    rows = rows.withColumn("d", dcf_at(s, year_one=c("sg"), terminal_margin=c("sm"), terminal_growth=c("st"), wacc=c("sw"))).filter("d is not null")
    return rows.select("ticker", "scenario", "probability", c("sg").alias("year_one_growth"), c("sm").alias("terminal_margin"), c("st").alias("terminal_growth"), c("sw").alias("wacc"), c("d.fair_value").alias("fair_value"), X.terminal_share(c("d.pv_terminal"), c("d.ev")).alias("tv_share"))


def expected(cases: DataFrame) -> DataFrame:
    """Probability-weighted value, range and dispersion of the cases."""
    some = F.when(c("fair_value") != 0, c("fair_value"))
    base = F.max(F.when(c("scenario") == "base", c("fair_value")))
    out = cases.groupBy("ticker").agg((F.sum(c("probability") * c("fair_value")) / F.sum("probability")).alias("expected_value"), F.min(some).alias("low"), F.max(some).alias("high"), base.alias("base_value"), F.count("*").alias("n_cases"))
    return out.withColumn("dispersion", (c("high") - c("low")) / X.nonzero(c("base_value")))


GROWTH_RANGE, GROWTH_STEPS = (-0.5, 3.0), 13
LEVER_STEPS = 11


def priced_in(inputs: DataFrame, prices: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """What each driver alone would have to be for the price: (ticker, lever, base_value, implied_value, reachable)."""
    rows = inputs.join(prices, "ticker").filter("price > 0 and shares > 0 and base_revenue > 0")
    fair = lambda **k: dcf_at(s, **k)["fair_value"]
    path = lambda g: X.decay_path(g, c("terminal_growth"), s.horizon, c("decay"))
    rows = rows.withColumn("d", dcf_at(s)).filter("d is not null")
    rows = rows.withColumns({
        "i_growth": X.bisect(lambda g: fair(year_one=g), c("price"), F.lit(GROWTH_RANGE[0]), F.lit(GROWTH_RANGE[1]), GROWTH_STEPS),
        "i_margin": X.bisect(lambda m: fair(terminal_margin=m), c("price"), F.lit(0.0), F.lit(1.0), LEVER_STEPS),
        "i_capex": X.bisect(lambda k: fair(capex=k), c("price"), F.lit(0.0), c("capex_share") + 1.0, LEVER_STEPS + 1),
        "i_terminal": X.bisect(lambda t: fair(terminal_growth=t), c("price"), F.lit(0.0), c("wacc") - 0.0025, LEVER_STEPS),
    }).withColumn("solved", dcf_at(s, capex=c("i_capex")))
    levers = [
        ("revenue_cagr", X.path_cagr(path(c("year_one_growth")), s.horizon), F.when(c("i_growth").isNotNull(), X.path_cagr(path(c("i_growth")), s.horizon))),
        ("operating_margin", c("terminal_margin"), c("i_margin")),
        ("fcf_margin", c("d.final_fcf") / X.nonzero(c("d.final_revenue")), F.when(c("i_capex").isNotNull(), c("solved.final_fcf") / X.nonzero(c("solved.final_revenue")))),
        ("terminal_growth", c("terminal_growth"), c("i_terminal")),
    ]
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("lever"), F.lit(n).alias("seq"), c("i_growth").alias("implied_growth"), a.alias("base_value"), b.alias("implied_value")) for n, (k, a, b) in enumerate(levers))))
    return rows.select("ticker", each.alias("x")).select("ticker", "x.*").withColumn("reachable", c("implied_value").isNotNull())


def widest_lever(levers: DataFrame) -> DataFrame:
    """The reachable lever that has to move up most; the first of equals."""
    return levers.filter("reachable").groupBy("ticker").agg(F.max_by("lever", F.struct(c("implied_value") - c("base_value"), -c("seq"))).alias("lever"))


def comps(subjects: DataFrame, peers: DataFrame) -> DataFrame:
    """Median P/E of direct peers (all peers if there are none) on the subject's earnings per share.

    ``subjects``: ticker, peer_group, net_income, shares; ``peers``: peer_group, pe, direct, market_cap.
    """
    positive = F.when(c("pe") > 0, c("pe"))
    medians = peers.filter("market_cap is not null").groupBy("peer_group").agg(F.median(F.when(c("direct"), positive)).alias("pe_direct"), F.median(positive).alias("pe_all"), F.count("*").alias("n_peers"))
    rows = subjects.join(medians, "peer_group", "left").withColumn("median_pe", F.coalesce("pe_direct", "pe_all"))
    eps = c("net_income") / F.when(c("shares") > 0, c("shares"))
    note = F.when(c("n_peers").isNull(), "not covered")
    return rows.select("ticker", "n_peers", "median_pe", F.when((c("net_income") > 0), c("median_pe") * eps).alias("implied_value"), note.alias("note"))


def analyst_weight(count: Column) -> Column:
    return X.clamp(count / 12.0, 1.0, 3.0)


def blend(estimates: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Weighted mean per ticker of estimates above 0 with a weight above 0; from three on, those far from the median are left out, unless under two stay."""
    live = estimates.filter("value > 0 and weight > 0")
    mid = live.groupBy("ticker").agg(F.median("value").alias("mid"), F.count("*").alias("n"))
    rows = live.join(mid, "ticker").withColumn("near", c("value").between(s.outlier_band[0] * c("mid"), s.outlier_band[1] * c("mid")))
    near = F.sum(F.when(c("near"), 1).otherwise(0))
    kept = rows.groupBy("ticker").agg(near.alias("n_near"))
    rows = rows.join(kept, "ticker").filter((c("n") < 3) | (c("n_near") < 2) | c("near"))
    return rows.groupBy("ticker").agg((F.sum(c("value") * c("weight")) / F.sum("weight")).alias("blended"), F.min("value").alias("low"), F.max("value").alias("high"), F.count("*").alias("n_included"))


def segment_forecast(segments: DataFrame, top_down: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Bottom-up revenue after the horizon against the top-down path.

    ``segments``: ticker, segment, fiscal_year, revenue; ``top_down``: forecast inputs.
    """
    seen = segments.filter("revenue > 0").groupBy("ticker", "segment").agg(
        F.max(F.struct("fiscal_year", "revenue")).alias("last"), F.sort_array(F.collect_list(F.struct("fiscal_year", "revenue")), asc=False).alias("years"))  # a value a year
    own = F.when(F.size("years") >= 2, X.clamp(c("years")[0]["revenue"] / c("years")[1]["revenue"] - 1, *s.segment_growth_bounds))
    rows = seen.join(top_down.select("ticker", "base_revenue", "year_one_growth", "terminal_growth", "decay"), "ticker")
    path = X.decay_path(F.coalesce(own, c("year_one_growth")), F.lit(s.terminal_growth), s.horizon, F.lit(s.segment_decay))
    rows = rows.withColumn("final", c("last.revenue") * X.compound(path))
    top = c("base_revenue") * X.compound(X.decay_path(c("year_one_growth"), c("terminal_growth"), s.horizon, c("decay")))
    sums = rows.groupBy("ticker").agg(F.sum("final").alias("bottom_up"), F.first(top).alias("top_down"), F.count("*").alias("n_segments"))
    gap = c("bottom_up") / X.nonzero(c("top_down")) - 1
    return sums.withColumn("gap", gap).filter(F.abs(c("gap")) <= s.segment_max_gap).withColumn("reconciles", F.abs(c("gap")) <= s.segment_close_gap)


def verdicts(values: DataFrame, prices: DataFrame, s: Settings = DEFAULTS) -> DataFrame:
    """Headline value (blended, else DCF), upside and rating. ``values``: ticker, dcf_value, blended."""
    rows = values.join(prices, "ticker").withColumn("headline", F.coalesce(X.nonzero(c("blended")), c("dcf_value")))
    rows = rows.withColumn("upside", X.upside(c("headline"), c("price")))
    return rows.select("ticker", "headline", "upside", X.rating(c("upside"), s).alias("rating"))


def confidence(rows: DataFrame) -> DataFrame:
    """Points for what makes a value doubtful. ``rows``: ticker, dispersion, tv_share, comps_value, dcf_value."""
    two = lambda x, hi, lo: F.when(x > hi, 2).when(x > lo, 1).otherwise(0)
    away = F.abs(c("comps_value") / X.nonzero(c("dcf_value")) - 1)
    points = two(c("dispersion"), 1.5, 0.8) + two(c("tv_share"), 0.80, 0.65) + two(away, 0.5, 0.25)
    drivers = F.array_compact(F.array(F.when(c("dispersion") > 0.8, "scenarios apart"), F.when(c("tv_share") > 0.65, "terminal value"), F.when(away > 0.25, "peers disagree")))
    return rows.select("ticker", points.alias("points"), F.when(points >= 4, "Low").when(points >= 2, "Medium").otherwise("High").alias("confidence"), F.concat_ws(",", drivers).alias("drivers"))


def warnings(rows: DataFrame) -> DataFrame:
    """Diagnostics. ``rows``: ticker, fair_value, price, low, high, dispersion, tv_share, consensus."""
    far = lambda a, b: F.abs(a / X.nonzero(b) - 1) > 0.35
    found = F.array_compact(F.array(
        F.when(c("fair_value").isNull() | (c("fair_value") <= 0), "degenerate DCF"), F.when(far(c("fair_value"), c("consensus")), "far from consensus"),
        F.when((c("price") < c("low")) | (c("price") > c("high")), "price outside scenarios"), F.when(c("dispersion") > 1.5, "wide scenarios"),
        F.when(c("tv_share") > 0.80, "mostly terminal value"), F.when(far(c("fair_value"), c("price")) & far(c("fair_value"), c("consensus")), "outlier on both sides"),
    ))
    return rows.select("ticker", F.concat_ws(";", found).alias("warnings"), F.size(found).alias("n_warnings"))
