"""Column builders: ratios with guards, clamps, forecast paths, and the DCF as one fold."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.settings import DEFAULTS, Settings


def nonzero(x: Column) -> Column:
    """Zero counts as missing."""
    return F.nullif(x, F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    return a / nonzero(b)


def clamp(x: Column, lo: float | Column, hi: float | Column) -> Column:
    """Null stays null."""
    lo, hi = (v if isinstance(v, Column) else F.lit(v) for v in (lo, hi))
    return F.when(x.isNotNull(), F.greatest(F.least(x, hi), lo))


def gross_margin(profit: Column, revenue: Column, cost: Column) -> Column:
    return F.coalesce(ratio(profit, revenue), ratio(revenue - cost, revenue))


def effective_tax(tax: Column, pretax: Column) -> Column:
    rate = tax / nonzero(pretax)
    return F.when((pretax > 0) & rate.between(0.0, 0.60), rate)


def free_cash_flow(ocf: Column, capex: Column) -> Column:
    return ocf - F.abs(capex)


def net_debt(debt: Column, cash: Column, investments: Column) -> Column:
    return debt - F.coalesce(cash, F.lit(0.0)) - F.coalesce(investments, F.lit(0.0))


def number(text: Column) -> Column:
    """A number, or null for what is none, NaN included."""
    x = text.try_cast("double")
    return F.when(~F.isnan(x), x)


def percent(x: Column) -> Column:
    """Percentages written as whole numbers become fractions, in steps of half a point (half to even)."""
    return F.bround(F.when(F.abs(x) > 1.5, x / 100).otherwise(x) / 0.005) * 0.005


def decay_path(start: Column, end: Column, n: int, decay: Column) -> Column:
    if n <= 0:
        return F.array().cast("array<double>")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: end + (start - end) * F.pow(decay, i))


def fade_path(start: Column, end: Column, n: int) -> Column:
    if n <= 0:
        return F.array().cast("array<double>")
    if n == 1:
        return F.array(end)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: start + (end - start) / (n - 1) * i)


def compound(path: Column) -> Column:
    return F.aggregate(path, F.lit(1.0), lambda acc, g: acc * (1 + g))


def path_cagr(path: Column, n: int) -> Column:
    return F.pow(compound(path), F.lit(1.0 / n)) - 1


def dcf(
    *, revenue: Column, growth: Column, margin: Column, tax: Column, depreciation: Column, capex: Column,
    working_capital: Column, wacc: Column, terminal_growth: Column, net_debt: Column, shares: Column,
) -> Column:
    """struct(pv_forecast, terminal_value, pv_terminal, ev, equity, fair_value, final_revenue, final_fcf).

    Null where there is no finite value: paths of different or no length, revenue not above 0, or growth
    that is not below the discount rate.  A share count of 0 or less gives a value of 0 per share.
    """
    zero = F.lit(0.0)
    start = F.struct(revenue.cast("double").alias("rev"), F.lit(0).alias("t"), zero.alias("pv"), zero.alias("fcf"), F.lit(1.0).alias("df"))

    def year(s: Column, x: Column) -> Column:
        rev = s["rev"] * (1 + x["g"])
        flow = rev * x["m"] * (1 - tax) + rev * depreciation - rev * capex - (rev - s["rev"]) * working_capital
        factor = F.lit(1.0) / F.pow(1 + wacc, s["t"] + 1)
        return F.struct(rev.alias("rev"), (s["t"] + 1).alias("t"), (s["pv"] + flow * factor).alias("pv"), flow.alias("fcf"), factor.alias("df"))

    def finish(s: Column) -> Column:
        tv = s["fcf"] * (1 + terminal_growth) / (wacc - terminal_growth)
        ev = s["pv"] + tv * s["df"]
        fair = F.when(shares > 0, (ev - net_debt) / shares).otherwise(zero)
        names = {"pv_forecast": s["pv"], "terminal_value": tv, "pv_terminal": tv * s["df"], "ev": ev, "equity": ev - net_debt, "fair_value": fair, "final_revenue": s["rev"], "final_fcf": s["fcf"]}
        return F.struct(*(v.alias(k) for k, v in names.items()))

    steps = F.zip_with(growth, margin, lambda g, m: F.struct(g.alias("g"), m.alias("m")))
    usable = (F.size(growth) == F.size(margin)) & (F.size(growth) > 0) & (revenue > 0) & (terminal_growth < wacc)
    return F.when(usable, F.aggregate(steps, start, year, finish))


def terminal_share(pv_terminal: Column, ev: Column) -> Column:
    return F.when(ev > 0, pv_terminal / ev).otherwise(0.0)


def bisect(value: Callable[[Column], Column], target: Column, lo: Column, hi: Column, steps: int) -> Column:
    """The input in [lo, hi] at which ``value`` meets ``target``, after ``steps`` halvings; null out of reach."""
    at_lo, at_hi = value(lo), value(hi)
    rising = at_hi >= at_lo
    reach = target.between(F.least(at_lo, at_hi), F.greatest(at_lo, at_hi))

    def halve(s: Column, _: Column) -> Column:
        mids = F.array((s["lo"] + s["hi"]) / 2)
        return F.transform(mids, lambda m: F.when((value(m) < target) == rising, F.struct(m.alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), m.alias("hi"))))[0]

    start = F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))
    return F.when(reach, F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: (s["lo"] + s["hi"]) / 2))


def decay_rate(growth: Column, steady: Column) -> Column:
    base = F.when(growth >= 0.45, 0.68).when(growth >= 0.30, 0.74).when(growth >= 0.18, 0.80).otherwise(0.86)
    return F.when(steady, F.least(base + 0.05, F.lit(0.90))).otherwise(base)


def rating(upside: Column, s: Settings = DEFAULTS) -> Column:
    return F.when(upside.isNull(), "NOT RATED").when(upside >= s.buy_at, "BUY").when(upside >= s.hold_at, "HOLD").otherwise("SELL")


def upside(value: Column, price: Column) -> Column:
    return F.when((value > 0) & (nonzero(price).isNotNull()), value / price - 1)


def tier(x: Column, tiers: tuple[tuple[float, float], ...]) -> Column:
    """The first threshold that x reaches gives the value; null gives 0."""
    out = F.lit(0.0)
    for least, value in reversed(tiers):
        out = F.when(x >= least, F.lit(value)).otherwise(out)
    return F.when(x.isNotNull(), out).otherwise(0.0)


def by_map(key: Column, values: dict[str, float], default: float) -> Column:
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def money(x: Column, currency: Column) -> Column:
    """Compact money: tn, bn, m, or whole units."""
    size = F.abs(x)
    scaled = lambda d, unit: F.concat(F.format_string("%.2f", x / d), F.lit(unit))
    body = F.when(size >= 1e12, scaled(1e12, "tn")).when(size >= 1e9, scaled(1e9, "bn")).when(size >= 1e6, scaled(1e6, "m")).otherwise(F.format_string("%.0f", x.cast("double")))
    return F.concat_ws(" ", currency, body)
