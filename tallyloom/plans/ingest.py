"""Registered queries on facts, filings, URLs and documents, and their SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.operators import facts as K
from tallyloom.operators import ingest as I
from tallyloom.plans.registry import query
from tallyloom.sources.tables import order_lines, table

c = F.col

# Orders as filings: a customer's total of a year, filed on the order's date; later orders restate it.
_FILED_SQL = """filed as (select o_custkey as cik, 'total' as concept, cast(year(o_orderdate) as int) as fiscal_year, o_totalprice as val, cast(o_orderdate as date) as filed, o_orderkey as seq,
  ['10-K', '10-K/A', '8-K', '20-F'][o_orderkey % 4 + 1] as form, 300 + o_orderkey % 120 as days from orders)"""


def filed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    end = F.make_date(F.year("o_orderdate"), F.lit(12), F.lit(31))
    form = F.element_at(F.array(*map(F.lit, ["10-K", "10-K/A", "8-K", "20-F"])), (c("o_orderkey") % 4 + 1).cast("int"))
    return o.select(c("o_custkey").alias("cik"), F.lit("total").alias("concept"), end.alias("end"), F.date_sub(end, (c("o_orderkey") % 120 + 300).cast("int")).alias("start"), c("o_totalprice").alias("val"), c("o_orderdate").cast("date").alias("filed"), c("o_orderkey").alias("seq"), form.alias("form"))


@query("q_latest_filed", "with " + _FILED_SQL + """ select cik, fiscal_year, val from (select *, row_number() over (partition by cik, fiscal_year order by filed desc, seq) as r from filed
  where form in ('10-K', '10-K/A', '20-F') and days between 330 and 400) where r = 1""")
def q_latest_filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.yearly(filed_orders(spark, sf_dir), "cik").select("cik", "fiscal_year", "val")


_CONCEPT_SQL = """conc as (select c_custkey as cik, l_returnflag as concept, cast(year(o_orderdate) as int) as fiscal_year, cast(sum(cast(l_quantity as bigint)) as bigint) as val
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey group by all)"""


def concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's quantities by return flag as concepts of one field."""
    rows = order_lines(spark, sf_dir)
    return rows.groupBy(c("o_custkey").alias("cik"), c("l_returnflag").alias("concept"), "fiscal_year").agg(F.sum(c("l_quantity").cast("long")).alias("val"))


@query("q_best_covering", "with " + _CONCEPT_SQL + """, yrs as (select cik, fiscal_year, row_number() over (partition by cik order by fiscal_year desc) <= 6 as recent from (select distinct cik, fiscal_year from conc)),
 cov as (select cik, concept, list_position(['R','A','N'], concept) as p, count(*) filter (recent) as nr, count(*) as n from conc join yrs using (cik, fiscal_year) group by all),
 prim as (select cik, concept as prim from cov qualify row_number() over (partition by cik order by nr desc, n desc, p) = 1)
 select cik, fiscal_year, concept, cast(val as bigint) as val from conc join prim using (cik) qualify row_number() over (partition by cik, fiscal_year order by concept <> prim, list_position(['R','A','N'], concept)) = 1""")
def q_best_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.best_covering(concepts(spark, sf_dir), ["R", "A", "N"], "cik").select("cik", "fiscal_year", "concept", "val")


@query("q_first_available", "with " + _CONCEPT_SQL + """, cur as (select cik, fiscal_year, arg_min(val, list_position(['A','N'], concept)) as a from conc where concept in ('A','N') group by all),
 lng as (select cik, fiscal_year, val as b from conc where concept = 'R') select cik, fiscal_year, cast(nullif(coalesce(a, 0) + coalesce(b, 0), 0) as double) as total_debt from cur full outer join lng using (cik, fiscal_year)""")
def q_first_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = concepts(spark, sf_dir)
    return K.total_debt(K.first_available(rows, ["A", "N"], "cik"), K.first_available(rows, ["R"], "cik"), "cik")


@query("q_pivot", "with " + _CONCEPT_SQL + " select * from (select cik, fiscal_year, max(val) filter (concept = 'N') as N, max(val) filter (concept = 'A') as A, max(val) filter (concept = 'R') as R from conc group by all) where N is not null")
def q_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.to_wide(concepts(spark, sf_dir).withColumnRenamed("concept", "field"), ["N", "A", "R"], "cik")


@query("q_statement_rows", "with " + _CONCEPT_SQL + """, w as (select cik, fiscal_year, f.field, val, f.p from conc, (values ('income','N',0),('income','A',1),('returns','R',0),('returns','A',1)) f(field, label, p) where f.label = concept and val is not null)
 select cik, fiscal_year, field, cast(arg_min(val, p) as bigint) as val from w group by all""")
def q_statement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return K.statement_rows(concepts(spark, sf_dir).withColumnRenamed("concept", "label"), {"income": ["N", "A"], "returns": ["R", "A"]}, "cik")


@query("q_either_source", """select cust as cik, src, n from (select o_custkey as cust, 'orders' as src, count(*) as n from orders where o_orderstatus = 'F' group by o_custkey
 union all select c_custkey, 'customers', 0 from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F'))""")
def q_either_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").groupBy(c("o_custkey").alias("cik")).agg(F.count("*").alias("n")).select("cik", F.lit("orders").alias("src"), "n")
    second = table(spark, sf_dir, "customer").select(c("c_custkey").alias("cik"), F.lit("customers").alias("src"), F.lit(0).cast("long").alias("n"))
    return K.either_source(first, second, "cik")


@query("q_fiscal_period", """with f as (select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as d, ['10-K','10-Q','8-K','6-K','20-F','X'][o_orderkey % 6 + 1] as form, ['0131','1231','0630','99'][o_orderkey % 4 + 1] as ye from orders),
 g as (select *, year(d::date) * 12 + month(d::date) - 1 - case when form in ('8-K','6-K') then 1 else 0 end as mm, case ye when '0131' then 1 when '0630' then 6 else 12 end as e from f)
 select o_orderkey, cast(mm // 12 + case when mm % 12 + 1 > e then 1 else 0 end as int) as fiscal_year, case when form in ('10-K','20-F') then 'FY' else 'Q' || (((mm % 12 + 1 - e - 1 + 12) % 12) // 3 + 1) end as fiscal_period,
  case form when '10-K' then 'annual_report' when '20-F' then 'annual_report' when '10-Q' then 'quarterly_report' when '8-K' then 'earnings_release' when '6-K' then 'earnings_release' end as doc_type from g""")
def q_fiscal_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (c("o_orderkey") % len(xs) + 1).cast("int"))
    rows = o.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), pick(["10-K", "10-Q", "8-K", "6-K", "20-F", "X"]).alias("form"), pick(["0131", "1231", "0630", "99"]).alias("ye"))
    year, period = I.fiscal_period(c("form"), c("d"), c("ye"))
    return rows.select("o_orderkey", year.cast("int").alias("fiscal_year"), period.alias("fiscal_period"), I.document_type(c("form")).alias("doc_type"))


@query("q_first_of_type", """select o_orderkey, o_custkey as cik, o_orderpriority as doc_type from (select *, row_number() over (partition by o_custkey, o_orderpriority order by o_orderdate desc, o_orderkey) as r from orders where year(o_orderdate) >= 2001 - 4)
 where r <= case o_orderpriority when '1-URGENT' then 2 when '2-HIGH' then 1 else 0 end""")
def q_first_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").filter(I.recent_enough(F.year("o_orderdate"), 2001))
    rows = o.select("o_orderkey", c("o_custkey").alias("cik"), c("o_orderpriority").alias("doc_type"), F.struct(-F.unix_timestamp("o_orderdate"), "o_orderkey").alias("seq"))
    return I.first_of_type(rows, {"1-URGENT": 2, "2-HIGH": 1}).drop("seq")


_URL_SQL = """u as (select page_id, url || ['', '/annual-report-2024.pdf', '/q3-2023-results', '/earnings/3Q25', '/investor_day_slides', '/fy22/quarter-2'][page_id % 6 + 1] as url from pages),
 t as (select *, regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1) || case when regexp_extract(url, '\\?([^#]*)', 1) <> '' then '?' || regexp_extract(url, '\\?([^#]*)', 1) else '' end as tail from u)"""


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    tails = ["", "/annual-report-2024.pdf", "/q3-2023-results", "/earnings/3Q25", "/investor_day_slides", "/fy22/quarter-2"]
    return table(spark, sf_dir, "pages").select("page_id", F.concat("url", F.element_at(F.array(*map(F.lit, tails)), (c("page_id") % 6 + 1).cast("int"))).alias("url"))


def _any_word(terms: Sequence[str], words: str = "words") -> str:
    """SQL for whether some term stands in the words, together or as one."""
    return "(" + " or ".join(f"contains({words}, '{t}') or contains({words}, '{t[0]}{t[1:-1].replace(' ', '')}{t[-1]}')" for t in terms) + ")"


@query("q_url_rules", "with " + _URL_SQL + """, w as (select *, ' ' || trim(regexp_replace(lower(tail), '[^a-z0-9]+', ' ', 'g')) || ' ' as words from t),
 e as (select *, list_filter(string_split(trim(words), ' '), lambda x: not contains(x, 'cdn')) as each from w)
 select page_id, case when """ + _any_word(I.URL_WORDS["annual_report"]) + """ or regexp_matches(words, ' ar[0-9]{2,4} ') then 'annual_report' when """ + _any_word(I.URL_WORDS["presentation"]) + """ then 'presentation'
   when """ + _any_word(I.URL_WORDS["quarterly_report"]) + """ or regexp_matches(words, ' q[1-4] ?(fy)?[0-9]{2,4} ') then 'quarterly_report' when """ + _any_word(I.URL_WORDS["earnings_release"]) + """ then 'earnings_release' end as kind,
  list_max(list_filter(list_transform(regexp_extract_all(' ' || regexp_replace(tail, '(\\d+)', '  \\1  ', 'g') || ' ', ' (\\d{4}) ', 1), lambda y: cast(y as int)), lambda y: y between 1990 and 2027)) as year,
  'Q' || coalesce(list_filter(each, lambda x: regexp_matches(x, '^q[1-4]') and not regexp_matches(x, '^q[1-4][0-9]{3}'))[1][2], list_filter(each, lambda x: regexp_matches(x, '^[1-4]q'))[1][1],
    nullif(regexp_extract(words, '^.*quarter *([1-4])', 1), '')) as quarter from e""")
def q_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = c("url")
    return urls(spark, sf_dir).select("page_id", I.url_kind(u).alias("kind"), I.url_year(u, 2026).alias("year"), I.url_quarter(u).alias("quarter"))


@query("q_url_score", "with " + _URL_SQL + """, w as (select *, ' ' || trim(regexp_replace(lower(url), '[^a-z0-9]+', ' ', 'g')) || ' ' as words from t) select page_id, cast(case when """ + _any_word(I.URL_HINTS) + """ then 20 else 0 end
  + case when contains(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), 'thther') then 60 else 0 end - case when contains(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), 'example.net') then 120 else 0 end as double) as score from w""")
def q_url_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls(spark, sf_dir).select("page_id", I.url_score(c("url"), F.lit("Thther Industries"), F.lit(None).cast("int"), 2026, ["example.net"]).alias("score"))


TERMS = ["tion", "ment", "and", "der", "que", "ning"]


@query("q_quality_gate", """select doc_id, case when length(coalesce(text, '')) = 0 then 'empty' when doc_id % 3 <> 0 and n_chars // 400 < 1 then 'only ' || (n_chars // 400) || ' page(s)' when length(trim(text)) < 300 then 'too little text'
 when contains(lower(text), 'tion')::int + contains(lower(text), 'ment')::int + contains(lower(text), 'and')::int + contains(lower(text), 'der')::int + contains(lower(text), 'que')::int + contains(lower(text), 'ning')::int < 2 then 'not on the subject' end as reason,
 contains(lower(text), 'tion')::int + contains(lower(text), 'ment')::int + contains(lower(text), 'and')::int + contains(lower(text), 'der')::int + contains(lower(text), 'que')::int + contains(lower(text), 'ning')::int as hits from documents""")
def q_quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    reason = I.quality_gate(c("text"), F.floor(c("n_chars") / 400), html=c("doc_id") % 3 == 0, min_pages=1, min_chars=300, min_terms=2, terms=TERMS)
    return docs.select("doc_id", reason.alias("reason"), T.hits(c("text"), TERMS).alias("hits"))


@query("q_admit", """with d as (select doc_id, sha256(coalesce(text, '')) as digest, case when n_chars < 300 then 'short' end as reason from documents), f as (select digest, min(doc_id) filter (reason is null) as f from d group by digest)
 select doc_id, digest, case when reason is null and doc_id = f then 'accepted' else 'rejected' end as status, coalesce(reason, case when doc_id <> f then 'duplicate' end) as why from d join f using (digest)""")
def q_admit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return I.admit(docs.select("doc_id", "text", F.when(c("n_chars") < 300, "short").alias("reason"), c("doc_id").alias("seq")))


@query("q_merge_sources", """with d as (select doc_id, lang as doc_type, source, case when doc_id % 4 <> 0 and lang <> 'de' then 2000 + doc_id % 25 end as fiscal_year, 'Q' || (doc_id % 4 + 1) as fiscal_period, case source when 'src0' then 3 when 'src1' then 2 else 1 end as trust from documents),
 k as (select * from d qualify row_number() over (partition by doc_type, fiscal_year, fiscal_period order by trust desc, doc_id) = 1)
 select doc_id, doc_type, fiscal_year, fiscal_period, trust from (select *, max(fiscal_year is not null) over (partition by doc_type) as dated from k) where fiscal_year is not null or not dated""")
def q_merge_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", c("lang").alias("doc_type"), "source", F.when((c("doc_id") % 4 != 0) & (c("lang") != "de"), c("doc_id") % 25 + 2000).alias("fiscal_year"), F.concat(F.lit("Q"), (c("doc_id") % 4 + 1).cast("string")).alias("fiscal_period"), c("doc_id").alias("seq"))
    trust = F.when(c("source") == "src0", 3).when(c("source") == "src1", 2).otherwise(1)
    return I.merge_sources(rows, trust).select("doc_id", "doc_type", "fiscal_year", "fiscal_period", "trust")


@query("q_exchange", "select c_custkey, case when n_regionkey in (0, 1) then n_name else 'XX' end as country, case when n_regionkey in (0, 1) then 'C' || n_regionkey else 'USD' end as currency, case when n_regionkey in (0, 1) then 100 - n_regionkey else 10 end as priority from customer join nation on c_nationkey = n_nationkey")
def q_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = table(spark, sf_dir, "nation").filter("n_regionkey in (0, 1)").select(c("n_nationkey").alias("exchange"), c("n_name").alias("country"), F.concat(F.lit("C"), c("n_regionkey").cast("string")).alias("currency"), (F.lit(100) - c("n_regionkey")).alias("priority"))
    return I.with_exchange(table(spark, sf_dir, "customer").select("c_custkey", c("c_nationkey").alias("exchange")), meta).select("c_custkey", "country", "currency", "priority")


@query("q_freshness", """select o_orderkey, case when date_diff('day', cast(o_orderdate as date), date '2001-06-30') / 30.44::double <= 6 then 'Current' when date_diff('day', cast(o_orderdate as date), date '2001-06-30') / 30.44::double <= 18 then 'Recent' else 'Historical context' end as freshness,
 case when (epoch(timestamp '2001-06-30') - epoch(cast(o_orderdate as timestamp))) / 3600 < 24 * (o_orderkey % 400) then 'fresh' else 'stale' end as state from orders""")
def q_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.lit("2001-06-30").cast("date")
    rows = table(spark, sf_dir, "orders").withColumn("fetched_at", c("o_orderdate"))
    cached = I.fresh_or_stale(rows, as_of, 24 * (c("o_orderkey") % 400))
    return cached.select("o_orderkey", I.freshness(c("o_orderdate").cast("date"), as_of).alias("freshness"), "state")


@query("q_collapse_dates", """with recursive d as (select o_custkey, cast(o_orderdate as date) as d, row_number() over (partition by o_custkey order by cast(o_orderdate as date)) as k from (select distinct o_custkey, cast(o_orderdate as date) as o_orderdate from orders)),
 w as (select o_custkey, d, k, d as kept, true as keep from d where k = 1 union all select d.o_custkey, d.d, d.k, case when d.d - w.kept > 7 then d.d else w.kept end, d.d - w.kept > 7 from w join d on d.o_custkey = w.o_custkey and d.k = w.k + 1)
 select o_custkey, count(*) filter (keep) as n_kept, strftime(max(kept), '%Y-%m-%d') as last_kept from w group by o_custkey""")
def q_collapse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's order dates, those within a week of the last kept one left out."""
    dates = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set(c("o_orderdate").cast("date")).alias("d"))  # days at most
    kept = I.collapse_dates(c("d"))
    return dates.select("o_custkey", F.size(kept).cast("long").alias("n_kept"), F.date_format(F.array_max(kept), "yyyy-MM-dd").alias("last_kept"))


@query("q_company_tokens", """select s_suppkey, array_to_string(list_sort(list_distinct(list_concat(list_filter(regexp_extract_all(lower(s_name), '([a-z]{3,})', 1), lambda w: w not in ('inc','corp','corporation','ltd','limited','plc','company','the','group','holdings','and')), ['s' || s_suppkey]))), ',') as tokens from supplier""")
def q_company_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", I.company_tokens(c("s_name"), F.concat(F.lit("S"), c("s_suppkey").cast("string"), F.lit(".N"))).alias("t")).select("s_suppkey", F.concat_ws(",", "t").alias("tokens"))


@query("q_match_company")
def q_match_company(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's best namesake among the suppliers of its nation."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    named = s.select("s_nationkey", F.concat(F.lit("S"), c("s_suppkey").cast("string"), F.lit(".N")).alias("ticker"), c("s_name").alias("name"), F.lit("EQUITY").alias("quote_type"), (c("s_suppkey") % 5).alias("priority"))
    return I.match_listed(s.select("s_nationkey", c("s_name").alias("query")), named, "s_nationkey").withColumn("score", F.round("score", 6))


@query("q_json_facts", """select c_custkey as cik, cast(o_orderkey as bigint) as seq, o_totalprice as val, 'USD' as unit, 'Revenues' as concept, strftime(o_orderdate, '%Y-%m-%d') as filed from orders join customer on o_custkey = c_custkey""")
def q_json_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as company-facts JSON, one document each, and read again."""
    o = table(spark, sf_dir, "orders")
    entry = F.array(F.struct(F.date_format("o_orderdate", "yyyy-MM-dd").alias("filed"), c("o_totalprice").alias("val"), F.lit("10-K").alias("form"), c("o_orderkey").cast("string").alias("end")))
    body = F.create_map(F.lit("facts"), F.create_map(F.lit("us-gaap"), F.create_map(F.lit("Revenues"), F.struct(F.create_map(F.lit("USD"), entry).alias("units")))))
    rows = K.company_facts(o.select(c("o_custkey").alias("cik"), F.to_json(body).alias("json")))
    return rows.select("cik", c("end").cast("long").alias("seq"), "val", "unit", "concept", "filed")
