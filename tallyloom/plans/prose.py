"""Registered checks of report prose, and SQL that reads the same sections."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.operators import correction
from tallyloom.operators import history as H
from tallyloom.operators import qa as Q
from tallyloom.plans.registry import query
from tallyloom.plans.valuation import RATIOS_SQL
from tallyloom.sources.tables import history

c = F.col

# What a model says about a company, by columns of its latest year; the same in Spark and in the SQL.
FACTS = {
    "ticker": "ticker", "fy": "fiscal_year", "n": "n_lines", "rev": "revenue", "om": "operating_margin", "fcf": "free_cash_flow", "tm": "operating_margin * 0.9e0",
    "itm": "operating_margin * 0.9e0 + 0.05e0", "tg": "(n_lines % 9 + 15) / 1000e0", "yg": "(n_lines % 13 + 1) / 100e0", "bear": "revenue / diluted_shares * 0.8e0", "bull": "revenue / diluted_shares * 1.3e0",
}
# The sections of its report: sentences with figures of the model, some of which are off.
SECTIONS = {
    "financials": """concat('Free cash flow ', case n % 5 when 0 then 'was' when 1 then 'reached a record' when 2 then 'totalled about' when 3 then 'came in at' else 'of' end, ' ',
        case n % 3 when 0 then '$' when 1 then 'US$' else '€' end, printf('%.4f', fcf * case when n % 7 = 0 then 0.35e0 else 1e0 end / 1e6), ' million [1], a strong result [2]. ',
        case when n % 11 = 0 then concat('Q1 free cash flow was $', printf('%.4f', fcf * 0.2e0 / 1e6), ' million, up sequentially. ') else '' end,
        'After all costs and taxes of the period the company reports to its owners that $', printf('%.4f', rev * case when n % 10 = 0 then 2e0 else 1e0 end / 1e6), ' million of total revenue was earned [1].')""",
    "outlook": """concat('Margins were stable. The $', printf('%.6f', rev * (0.2e0 + 0.02e0 * (n % 7)) / 1e9), ' billion of the period, once annualized, means 20.0% growth over FY', cast(fy as string), ' [1].',
        case when n % 8 = 0 then ' Management expects growth in FY2000 [7].' else '' end, case when n % 5 = 0 then ' The quarterly figure is annualised here [1].' else '' end,
        case when n % 9 = 0 then ' Consensus implies our bull case with 12% growth [1].' else '' end, case when n % 12 = 0 then ' Quarterly revenue for the year was flat [2].' else '' end)""",
    "assumptions": """concat('Operating margin of 60% today normalizes to a terminal operating margin of ', printf('%.2f', 100 * tm + case n % 6 when 0 then 9e0 when 1 then 5.5e0 else 0.2e0 end), '% at maturity [1]. ',
        'We use a terminal growth rate of ', printf('%.2f', 100 * tg + case when n % 7 = 3 then 2e0 else 0.3e0 end), '% and year-one revenue growth of about ', printf('%.2f', 100 * yg + case when n % 5 = 2 then 3e0 else 0e0 end), '%.',
        case when n % 4 = 1 then concat(' A ', printf('%.2f', 100 * itm + case when n % 8 = 1 then 12e0 else 0e0 end), '% terminal margin is what the price needs [1].') else '' end)""",
    "valuation": """concat('Our bull case of $', printf('%.2f', bull * case when n % 5 = 3 then 1.2e0 else 1.01e0 end), ' assumes that growth persists, and the bear-case fair value of ', printf('%.2f', bear * case when n % 9 = 4 then 0.9e0 else 1e0 end),
        ' that it ends [2]. The market implies a ', printf('%.2f', 100 * om + case when n % 4 = 0 then 8e0 else 1e0 end), '% margin [1].')""",
    "risks": """concat('A supply event could reduce growth from 20% to ', case when n % 4 = 0 then '25' else '15' end, '% [1].', case when n % 10 = 3 then ' That would lift our fair value.' else '' end)""",
    "business": """concat('The Data Center line was 60% of revenue [1]. Data Center made ', case when n % 3 = 0 then '90' else '70' end, '% of total revenue [2].')""",
    "thesis": """concat('The shares look cheap. They trade below their value', case when n % 13 = 5 then '.' else ' [1].' end)""",
}
N_EVIDENCE, N_PARAGRAPHS = 3, 2


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.with_ratios(H.latest(history(spark, sf_dir))).select(*(F.expr(e).alias(k) for k, e in FACTS.items()))


def sections(known: DataFrame) -> DataFrame:
    """(ticker, section, text, n_evidence, n_paragraphs) of the reports on ``known``, as of :func:`facts`."""
    each = F.array(*(F.struct(F.lit(k).alias("section"), F.expr(e).alias("text")) for k, e in SECTIONS.items()))
    return known.select("ticker", F.inline(each)).withColumns({"n_evidence": F.lit(N_EVIDENCE), "n_paragraphs": F.lit(N_PARAGRAPHS)})


def findings(prose: DataFrame, known: DataFrame) -> DataFrame:
    """All checks of prose against what the model ``known`` says."""
    canonical = known.select("ticker", c("fy").alias("fiscal_year"), F.inline(F.array(*(F.struct(F.lit(k).alias("key"), c(v).alias("value")) for k, v in (("revenue", "rev"), ("free_cash_flow", "fcf"))))))
    drivers = known.select("ticker", F.inline(F.array(*(F.struct(F.lit(k).alias("key"), F.array(*map(c, v)).alias("values")) for k, v in (("terminal_margin", ["tm", "itm"]), ("terminal_growth", ["tg"]), ("year_one_growth", ["yg"]))))))
    cases = known.select("ticker", F.inline(F.array(*(F.struct(F.lit(k).alias("scenario"), c(k).alias("fair_value")) for k in ("bear", "bull")))))
    levers = known.select("ticker", c("om").alias("implied_value"), F.lit(True).alias("reachable"))
    claims = Q.annualised_claims(prose).join(known.select("ticker", c("rev").alias("revenue")), "ticker")
    parts = [
        Q.risk_direction(prose), Q.quarterly_annualised(prose), Q.stale_forward(prose, known.select("ticker", c("fy").alias("fiscal_year"))), Q.dangling_citations(prose), Q.consensus_scenario(prose), Q.metric_semantics(prose),
        Q.canonical_metric(Q.bound_figures(prose, Q.SCANNED), canonical), Q.driver_numbers(prose, drivers), Q.case_values(prose, cases), Q.market_implied(prose, levers), Q.segment_shares(prose), Q.annualisation_arithmetic(claims),
    ]
    return reduce(DataFrame.unionByName, parts)


def _facts_sql() -> str:
    return RATIOS_SQL + ", newest as (select * from ratios qualify row_number() over (partition by ticker order by fiscal_year desc) = 1), facts as (select " + ", ".join(f"{e} as {k}" for k, e in FACTS.items()) + " from newest)"


def _sections_sql() -> str:
    return ", sections as (" + " union all ".join(f"select ticker, '{k}' as section, {e} as text from facts" for k, e in SECTIONS.items()) + ")"


_MONEY = r"(?:us\$|\$|€)"
# The SQL reads the texts with its own patterns, a check at a time.
SECTIONS_SQL = _facts_sql() + _sections_sql()
FINDINGS_SQL = SECTIONS_SQL + rf""",
sent as (select ticker, section, trim(unnest(regexp_extract_all(text || ' ', '.*?[.!?]\s+'))) as s from sections),
lowered as (select ticker, section, lower(text) as t from sections),
marks as (select ticker, section, list_transform(regexp_extract_all(text, '\[(\d+)\]', 1), lambda x: cast(x as int)) as m from sections),
said as (select l.*, unnest(regexp_extract_all(t, '(?:free cash flow (?:was|of|reached|totalled|came in at)(?: (?:a|about|record))* {_MONEY}[0-9.]+ million|{_MONEY}[0-9.]+ million of total revenue)')) as m from lowered l),
bound as (select s.ticker, section, case when m like 'free%' then 'free_cash_flow' else 'revenue' end as key, regexp_extract(m, '([0-9.]+) million', 1)::double * 1e6 as value,
    substring(t, greatest(strpos(t, m) - 81, 0) + 1, strpos(t, m) + 9 + length(m) - greatest(strpos(t, m) - 81, 0)) as context, f.rev, f.fcf, f.fy from said s join facts f using (ticker)),
drivers as (select l.ticker, section, unnest([{{'k': 'tm', 'v': regexp_extract_all(t, 'terminal operating margin of ([0-9.]+)%', 1)}}, {{'k': 'tm', 'v': regexp_extract_all(t, '([0-9.]+)% terminal margin', 1)}},
    {{'k': 'tg', 'v': regexp_extract_all(t, 'terminal growth rate of ([0-9.]+)%', 1)}}, {{'k': 'yg', 'v': regexp_extract_all(t, 'year-one revenue growth of about ([0-9.]+)%', 1)}}]) as d, tm, itm, tg, yg from lowered l join facts using (ticker)),
stated as (select ticker, section, d.k as k, unnest(d.v)::double as v, tm, itm, tg, yg from drivers),
cased as (select l.ticker, section, unnest(regexp_extract_all(t, '(?:bear|bull)[- ]case (?:fair value )?of \$?[0-9.]+\d')) as m, bear, bull from lowered l join facts using (ticker)),
shares as (select ticker, section, lower(regexp_extract(s, '(Data Center).* (\d+)% of (?:total )?revenue', 1)) as name, try_cast(regexp_extract(s, '(Data Center).* (\d+)% of (?:total )?revenue', 2) as double) as v from sent),
grown as (select ticker, section, regexp_extract(s, '\$([0-9.]+) billion.*annualized', 1)::double * 1e9 as q, regexp_extract(s, 'annualized.* ([0-9.]+)% growth over FY', 1)::double / 100 as g, rev from sent join facts using (ticker) where regexp_matches(s, 'annualized.*growth over FY20')),
found as (
  select ticker, section, 'HIGH' as severity, 'risk direction' as "check" from sent where (regexp_matches(lower(s), 'reduc') and try_cast(regexp_extract(s, 'from (\d+)% to (\d+)%', 2) as double) > try_cast(regexp_extract(s, 'from (\d+)% to (\d+)%', 1) as double) + 0.05) or regexp_matches(lower(s), '(rais|increas|lift|boost)\w* (our|the) (fair|intrinsic) value')
  union all select ticker, section, 'HIGH', 'annualisation' from sent where regexp_matches(lower(s), 'annuali[sz]') and contains(lower(s), 'quarter')
  union all select ticker, section, 'MEDIUM', 'staleness' from sent join facts using (ticker) where regexp_matches(lower(s), '\b(expects?|will|plans?|targets?|guides?|forecasts?)\b') and try_cast(regexp_extract(s, 'FY ?(20\d\d)', 1) as int) <= fy
  union all select ticker, section, 'HIGH', 'citations' from marks where len(list_filter(m, lambda x: x < 1 or x > {N_EVIDENCE})) > 0 or len(m) = 0
  union all select ticker, section, 'HIGH', 'consensus' from sent where regexp_matches(lower(s), 'consensus.*implies.*(bull|bear|base) case.*\d%')
  union all select ticker, section, 'HIGH', 'metric semantics' from sent where regexp_matches(lower(s), '\bquarterly\b') and contains(lower(s), 'for the year')
  union all select ticker, section, 'CRITICAL', 'canonical metric' from (select distinct ticker, section, key from bound where abs(value / case key when 'revenue' then rev else fcf end - 1) > 0.4 and not regexp_matches(context, 'q[1-4]|quarter|sequential|expect|forecast|target|assum|impl|could|would|potential|forward'))
  union all select ticker, section, 'CRITICAL', 'driver numbers' from stated where case k when 'tm' then abs(v - 100 * tm) > 1.5 and abs(v - 100 * itm) > 1.5 when 'tg' then abs(v - 100 * tg) > 0.8 else abs(v - 100 * yg) > 2.5 end
  union all select ticker, section, 'CRITICAL', 'driver numbers' from cased where abs(regexp_extract(m, '([0-9.]+)$', 1)::double / case when m like 'bear%' then bear else bull end - 1) > 0.03
  union all select ticker, section, 'HIGH', 'market implied' from sent join facts using (ticker) where abs(try_cast(regexp_extract(s, 'market implies a ([0-9.]+)%', 1) as double) - 100 * om) > 3
  union all select ticker, section, 'HIGH', 'segment shares' from shares where v is not null and name <> '' group by ticker, section, name having max(v) - min(v) > 15
  union all select ticker, section, 'CRITICAL', 'annualisation' from grown where 4 * q between 0.5 * rev and 3 * rev and abs(4 * q / rev - 1 - g) > 0.1)
"""


@query("q_sections_text", "with " + SECTIONS_SQL + " select ticker, section, sha256(text) as text from sections")
def q_sections_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections(facts(spark, sf_dir)).select("ticker", "section", F.sha2("text", 256).alias("text"))


@query("q_qa_prose", "with " + FINDINGS_SQL + ' select ticker, section, severity, "check", count(*) as n from found group by all')
def q_qa_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All findings in the sections of all companies' reports."""
    known = facts(spark, sf_dir)
    return findings(sections(known), known).groupBy("ticker", "section", "severity", "check").agg(F.count("*").alias("n"))


_GATED = """, counted as (select ticker, count(*) filter (severity = 'CRITICAL') as critical, count(*) filter (severity = 'HIGH') as high, count(*) filter (severity = 'MEDIUM') as medium, cast(0 as bigint) as low from facts left join found using (ticker) group by ticker)"""


@query("q_gate", "with " + FINDINGS_SQL + _GATED + " select *, case when critical + high > 0 then 'FAILED' else 'PASSED' end as status from counted")
def q_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = facts(spark, sf_dir)
    return Q.gate(findings(sections(known), known), known)


def _percents(spark: SparkSession, known: DataFrame) -> DataFrame:
    rows = sections(known).select("ticker", "section", F.explode(T.located(c("text"))).alias("x")).filter("x.kind = 'percent'")
    model = known.select("ticker", F.explode(F.array(*(c(k) * 100 for k in ("om", "tm", "itm", "tg", "yg")))).alias("value"))
    return Q.traced_percents(rows.select("ticker", "section", "x.start", "x.value"), model)


_PERCENTS_SQL = r""", pcts as (select ticker, section, unnest(list_transform(regexp_extract_all(text, '([0-9.]+)%', 1), lambda x: x::double)) as value from sections),
 ptraced as (select p.ticker, section, value, least(abs(value - 100 * om), abs(value - 100 * tm), abs(value - 100 * itm), abs(value - 100 * tg), abs(value - 100 * yg)) <= 0.6 as traced from pcts p join facts using (ticker))"""


@query("q_traced_percents", "with " + SECTIONS_SQL + _PERCENTS_SQL + " select ticker, section, value, traced from ptraced")
def q_traced_percents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each percentage in the prose against the model's."""
    return _percents(spark, facts(spark, sf_dir)).select("ticker", "section", "value", "traced")


def _amounts(known: DataFrame) -> DataFrame:
    rows = sections(known).select("ticker", "section", F.explode(T.located(c("text"))).alias("x")).filter("x.kind = 'money'")
    model = known.select("ticker", F.explode(F.array("rev", "fcf", "bear", "bull")).alias("value"))
    return Q.traced_amounts(rows.select("ticker", "section", "x.start", "x.value"), model)


_AMOUNTS_SQL = r""", moneys as (select ticker, section, unnest(regexp_extract_all(text, '(?:US\$|\$|€)[0-9]+\.[0-9]+(?: [mb]illion)?')) as m from sections),
 valued as (select ticker, section, regexp_extract(m, '([0-9.]+)', 1)::double * case when m like '%million' then 1e6 when m like '%billion' then 1e9 else 1 end as value from moneys),
 atraced as (select ticker, section, value, least(abs(value / rev - 1), abs(value / fcf - 1), abs(value / bear - 1), abs(value / bull - 1)) <= 0.02 as traced from valued join facts using (ticker))"""


@query("q_traced_amounts", "with " + SECTIONS_SQL + _AMOUNTS_SQL + " select ticker, section, round(value, 2) as value, traced from atraced")
def q_traced_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each amount of money in the prose against the model's."""
    return _amounts(facts(spark, sf_dir)).select("ticker", "section", F.round("value", 2).alias("value"), "traced")


@query("q_reliability", "with " + FINDINGS_SQL + _GATED + _PERCENTS_SQL + _AMOUNTS_SQL + r""",
 figures as (select ticker, count(*) as n, count(*) filter (not traced) as bad from (select ticker, traced from ptraced union all select ticker, traced from atraced) group by ticker),
 cover as (select ticker, 100.0::double * count(*) filter (regexp_matches(text, '\[\d+\]')) / count(*) as coverage from sections group by ticker),
 g as (select k.*, coalesce(round_even(bad / figures.n::double * 100, 1), 0) as unverified_pct, coverage, facts.n % 3 as k from counted k join figures using (ticker) join cover using (ticker) join facts using (ticker)),
 h as (select *, cast(greatest(least(round_even(100 - unverified_pct * 0.5::double - (100 - coverage) * 0.3::double - critical * 25 - high * 15 - medium * 4 - case k when 0 then 8 when 1 then 3 else 0 end, 0), 100), 0) as int) as score from g)
 select ticker, unverified_pct, score, case when score >= 85 then 'A' when score >= 70 then 'B' when score >= 55 then 'C' else 'D' end as grade from h""")
def q_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the share of sections that cite something as their coverage."""
    known = facts(spark, sf_dir)
    prose = sections(known)
    traced = _percents(spark, known).select("ticker", "traced").unionByName(_amounts(known).select("ticker", "traced"))
    traced = traced.groupBy("ticker").agg(F.count("*").alias("figures"), F.sum((~c("traced")).cast("int")).alias("untraced"))
    cover = prose.groupBy("ticker").agg((100 * F.avg((F.size(T.markers(c("text"))) > 0).cast("double"))).alias("coverage"))
    doubt = F.element_at(F.array(F.lit("Low"), F.lit("Medium"), F.lit("High")), (c("n") % 3 + 1).cast("int"))
    rows = Q.gate(findings(prose, known), known).join(traced, "ticker").join(cover, "ticker").join(known.select("ticker", doubt.alias("confidence")), "ticker")
    return Q.reliability(rows).select("ticker", "unverified_pct", "score", "grade")


def _only(check: str, *severities: str) -> str:
    return "with " + FINDINGS_SQL + f" select ticker, section, count(*) as n from found where \"check\" = '{check}' and severity in ({', '.join(repr(s) for s in severities)}) group by all"


def _by_section(rows: DataFrame) -> DataFrame:
    return rows.groupBy("ticker", "section").agg(F.count("*").alias("n"))


@query("q_qa_shares", _only("segment shares", "HIGH"))
def q_qa_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of one named line that are apart."""
    return _by_section(Q.segment_shares(sections(facts(spark, sf_dir))))


@query("q_qa_implied", _only("market implied", "HIGH"))
def q_qa_implied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of what the market implies against the solved margin."""
    known = facts(spark, sf_dir)
    return _by_section(Q.market_implied(sections(known), known.select("ticker", c("om").alias("implied_value"), F.lit(True).alias("reachable"))))


@query("q_qa_drivers", _only("driver numbers", "CRITICAL"))
def q_qa_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stated drivers and case values against the model's and the implied ones."""
    known = facts(spark, sf_dir)
    return _by_section(findings(sections(known), known).filter("check = 'driver numbers'"))


@query("q_qa_quarters", _only("annualisation", "CRITICAL"))
def q_qa_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth that the prose claims for a part of the year times four."""
    known = facts(spark, sf_dir)
    claims = Q.annualised_claims(sections(known)).join(known.select("ticker", c("rev").alias("revenue")), "ticker")
    return _by_section(Q.annualisation_arithmetic(claims))


@query("q_qa_canonical", _only("canonical metric", "CRITICAL"))
def q_qa_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free cash flows and revenues in the prose that aren't the canonical ones."""
    known = facts(spark, sf_dir)
    return _by_section(findings(sections(known), known).filter("check = 'canonical metric'"))


def _corrected(spark: SparkSession, sf_dir: str) -> correction.Corrected:
    """Reports whose sections come in up to three further versions, some with other faults and some missing;
    every seventh company's valuation is wrong besides."""
    known = facts(spark, sf_dir)
    later = known.withColumn("attempt", F.explode(F.array(*map(F.lit, (1, 2, 3))))).withColumn("n", c("n") + c("attempt"))
    each = F.array(*(F.struct(F.lit(k).alias("section"), F.expr(e).alias("text")) for k, e in SECTIONS.items()))
    drafts = later.filter("n % 4 <> 3").select("ticker", "attempt", F.inline(each))
    wrong = known.filter("n % 7 = 0").select("ticker", F.lit("CRITICAL").alias("severity"), F.lit("valuation").alias("check"), F.lit("target is not the DCF value").alias("message"))
    return correction.correct(sections(known), drafts, lambda prose: findings(prose, known), wrong)


def _corrected_sql() -> str:
    versions = SECTIONS_SQL.replace(", facts as (select ticker as ticker", ", facts0 as (select ticker as ticker")
    versions = versions.replace(", sections as (", ", facts as (select * replace (ticker || '#' || k as ticker, n + k as n) from (select *, unnest([0, 1, 2, 3]) as k from facts0)), sections as (", 1)
    sql = "with " + FINDINGS_SQL.replace(SECTIONS_SQL, versions)
    mend = "', '".join(k for k, v in correction.COMPONENTS.items() if v)
    sql += f""", bad as (select split_part(ticker, '#', 1) as ticker, cast(split_part(ticker, '#', 2) as int) as k, section, count(*) filter (severity in ('CRITICAL', 'HIGH')) as blocking,
      count(*) filter (severity in ('CRITICAL', 'HIGH') and "check" in ('{mend}')) as mend from found group by all),
    drafts as (select ticker, section, k from (select ticker, unnest([1, 2, 3]) as k, n from facts0) cross join (select unnest({list(SECTIONS)}) as section) where (n + k) % 4 <> 3),
    r0 as (select ticker, section, 0 as k, false as taken from facts0 cross join (select unnest({list(SECTIONS)}) as section))"""
    for r in (1, 2, 3):
        sql += f""", r{r} as (select p.ticker, p.section, case when coalesce(b.mend, 0) > 0 and d.k is not null then {r} else p.k end as k, coalesce(b.mend, 0) > 0 and d.k is not null as taken
      from r{r - 1} p left join bad b on b.ticker = p.ticker and b.section = p.section and b.k = p.k left join drafts d on d.ticker = p.ticker and d.section = p.section and d.k = {r})"""
    return sql


@query("q_corrected", _corrected_sql() + " select p.ticker, p.section, p.k as attempt, coalesce(b.blocking, 0) as blocking from r3 p left join bad b on b.ticker = p.ticker and b.section = p.section and b.k = p.k")
def q_corrected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version of each section that the rounds end with, and what still blocks it."""
    done = _corrected(spark, sf_dir)
    bad = done.findings.filter(c("severity").isin(*correction.BLOCKING)).groupBy("ticker", "section").agg(F.count("*").alias("blocking"))
    return done.prose.select("ticker", "section", "attempt").join(bad, ["ticker", "section"], "left").fillna(0, ["blocking"])


@query("q_correction_verdicts", _corrected_sql() + """, left_ as (select ticker, sum(blocking) as blocking from (select p.ticker, coalesce(b.blocking, 0) as blocking from r3 p left join bad b on b.ticker = p.ticker and b.section = p.section and b.k = p.k
      union all select ticker, 1 from facts0 where n % 7 = 0) group by ticker),
    tries as (select ticker, count(distinct r) filter (taken) as attempts from (select *, 1 as r from r1 union all select *, 2 from r2 union all select *, 3 from r3) group by ticker)
    select ticker, attempts, cast(blocking as bigint) as blocking, case when blocking > 0 then 'FAILED' else 'PASSED' end as status from left_ join tries using (ticker)""")
def q_correction_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return correction.verdicts(_corrected(spark, sf_dir))
