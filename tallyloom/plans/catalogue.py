"""Registered queries on filings' lists, catalogues, ledgers and answers, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import exprs as X
from tallyloom.functions import text as T
from tallyloom.operators import catalogue as C
from tallyloom.operators import facts as K
from tallyloom.operators import ingest as I
from tallyloom.operators import qa as Q
from tallyloom.operators import reporting as R
from tallyloom.operators import search as S
from tallyloom.plans.registry import query
from tallyloom.sources import sinks
from tallyloom.sources.tables import table

c = F.col


@query("q_ticker_map", "select 'S' || s_suppkey || '.N' as ticker, lpad(cast(s_suppkey as varchar), 10, '0') as cik from supplier")
def q_ticker_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers written as ticker maps, with an entry without a ticker, and read again."""
    entry = lambda t, k: F.struct(t.alias("ticker"), k.alias("cik_str"))
    key = c("s_suppkey").cast("string")
    raw = F.to_json(F.create_map(F.lit("0"), entry(F.concat(F.lit("s"), key, F.lit(".n")), key), F.lit("1"), entry(F.lit(""), key)))
    return I.ticker_map(table(spark, sf_dir, "supplier").select(raw.alias("json")))


@query("q_submissions", """with f as (select o_custkey as cik, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey desc) - 1 as seq, ['10-K', '8-K', '10-Q'][o_orderkey % 3 + 1] as form, case o_orderkey % 5 when 0 then null when 1 then '2.02,9.01' else '5.02' end as items from orders)
 select cik, cast(seq as int) as seq, o_orderkey as accession, form from f where form <> '8-K' or coalesce(contains(items, '2.02'), false)""")
def q_submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as filings in parallel arrays, newest first, without current reports on other items."""
    o = table(spark, sf_dir, "orders")
    form = F.element_at(F.array(F.lit("10-K"), F.lit("8-K"), F.lit("10-Q")), (c("o_orderkey") % 3 + 1).cast("int"))
    items = F.when(c("o_orderkey") % 5 == 1, "2.02,9.01").when(c("o_orderkey") % 5 != 0, "5.02")
    lists = o.groupBy(c("o_custkey").alias("cik")).agg(F.sort_array(F.collect_list(F.struct(c("o_orderkey").alias("accession"), form.alias("form"), items.alias("items"))), asc=False).alias("x"))
    rows = I.submissions(lists.select("cik", *(c("x")[n].alias(n) for n in ("accession", "form", "items"))))
    return rows.filter(I.is_wanted(c("form"), c("items"))).select("cik", "seq", "accession", "form")


@query("q_sample_pages", """select doc_id, array_to_string(case when n_chars // 100 <= 16 then range(0, n_chars // 100) else list_transform(range(0, 16), lambda i: i * (n_chars // 100) // 16) end, ',') as pages from documents""")
def q_sample_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat_ws(",", I.sample_pages(F.floor(c("n_chars") / 100)).cast("array<string>")).alias("pages"))


@query("q_snapshot_price", "select p_partkey, case when p_size % 3 <> 0 then p_retailprice when p_size % 5 <> 0 then p_retailprice * 2 else cast(p_partkey as double) end as price from part")
def q_snapshot_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = K.snapshot_price(F.when(c("p_size") % 3 != 0, c("p_retailprice")), F.when(c("p_size") % 5 != 0, c("p_retailprice") * 2).otherwise(0.0), c("p_partkey").cast("double"))
    return table(spark, sf_dir, "part").select("p_partkey", price.alias("price"))


@query("q_qa_segments", "with s as (select l_orderkey as ticker, sum(case when l_returnflag = 'R' then cast(l_quantity as bigint) else 0 end) / sum(cast(l_quantity as bigint)) - 0.25::double as gap from lineitem group by l_orderkey) select ticker, 'CRITICAL' as severity from s where abs(gap) > 0.15::double")
def q_qa_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose returned share is far from a quarter, as segments that do not reconcile."""
    qty = c("l_quantity").cast("long")
    rows = table(spark, sf_dir, "lineitem").groupBy(c("l_orderkey").alias("ticker")).agg((F.sum(F.when(c("l_returnflag") == "R", qty).otherwise(0)) / F.sum(qty) - 0.25).alias("gap"))
    return Q.segment_gap(rows).select("ticker", "severity")


@query("q_carried_over", "select p_partkey as ticker, case when p_size % 3 = 0 then 2.0 * p_size else p_size end::double as value from part")
def q_carried_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger whose gaps are filled from the probe's."""
    rows = table(spark, sf_dir, "part").select(c("p_partkey").alias("ticker"), F.lit("size").alias("key"), c("p_size").cast("double").alias("value"))
    final = rows.withColumn("value", F.when(c("value") % 3 != 0, c("value")))
    return R.carried_over(final, rows.withColumn("value", c("value") * 2), "value").select("ticker", "value")


@query("q_disclosures", """select c_custkey as ticker, c_custkey || ': target ' || printf('%.2f', c_custkey / 4.0::double) || ' over 12 months, rated ' || c_mktsegment || '; 10-year DCF at ' || (c_custkey % 9 + 5) || '.0% with 2.5% terminal growth' as disclosure from customer""")
def q_disclosures(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(c("c_custkey").alias("ticker"), c("c_mktsegment").alias("rating"), (c("c_custkey") / 4).alias("headline"), ((c("c_custkey") % 9 + 5) / 100).alias("wacc"), F.lit(0.025).alias("terminal_growth"))
    return R.disclosures(rows)


@query("q_ordered_variants", """with v as (select conv_id as query_id, turn as seq, case turn % 3 when 0 then upper(role) when 1 then '  ' || role else '' end as text from conversations),
 f as (select *, lower(trim(text)) as key from v where trim(text) <> ''), g as (select * from f qualify row_number() over (partition by query_id, key order by seq) = 1)
 select query_id, cast(row_number() over (partition by query_id order by seq) as int) as seq, trim(text) as text from g""")
def q_ordered_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(c("turn") % 3 == 0, F.upper("role")).when(c("turn") % 3 == 1, F.concat(F.lit("  "), "role")).otherwise("")
    return S.ordered_variants(table(spark, sf_dir, "conversations").select(c("conv_id").alias("query_id"), c("turn").alias("seq"), text.alias("text")))


@query("q_manifest", """with d as (select doc_id, sha256(coalesce(text, '')) as digest, case when n_chars < 300 then 'short' end as reason from documents), f as (select digest, min(doc_id) filter (reason is null) as f from d group by digest),
 a as (select doc_id, digest, case when reason is null and doc_id = f then 'accepted' else 'rejected' end as status from d join f using (digest)) select doc_id, status from a where status = 'rejected' or digest >= '4'""")
def q_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions written as a manifest and read again, where a quarter of the accepted files is gone."""
    docs = table(spark, sf_dir, "documents")
    path = f"{sinks.work_dir(spark)}/manifest"
    sinks.write_manifest(I.admit(docs.select("doc_id", "text", F.when(c("n_chars") < 300, "short").alias("reason"), c("doc_id").alias("seq"))), path, F.lit("2026-01-01"))
    files = docs.select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")).filter("digest >= '4'")
    return sinks.read_manifest(spark, path, files).select("doc_id", "status")


@query("q_index_tables", "select l_orderkey, l_linenumber from lineitem")
def q_index_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table saved with the mark of its model, and read with the right one and a wrong one."""
    path = f"{sinks.work_dir(spark)}/index"
    sinks.save_index(path, "m1", lines=table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"))
    return sinks.load_index(spark, path, "m1", "lines").unionByName(sinks.load_index(spark, path, "m2", "lines"))


@query("q_upsert", "select o_orderkey as key, case when o_orderkey % 3 = 0 then 'new' else 'old' end as state from orders")
def q_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(c("o_orderkey").alias("key"))
    old, fresh = rows.withColumn("state", F.lit("old")), rows.filter("key % 3 = 0").withColumn("state", F.lit("new"))
    return sinks.upsert(old, fresh)


@query("q_guarded_ciks", "select c_custkey, case when n_regionkey = 1 then s_suppkey end as cik from customer join nation on c_nationkey = n_nationkey left join supplier on s_suppkey = c_custkey")
def q_guarded_ciks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of one region as US companies, suppliers as the known tickers."""
    country = F.when(c("n_regionkey") == 1, "US").otherwise("XX")
    companies = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), c("c_nationkey") == c("n_nationkey")).select("c_custkey", F.concat(F.lit("t"), c("c_custkey").cast("string")).alias("ticker"), country.alias("country"))
    known = table(spark, sf_dir, "supplier").select(F.concat(F.lit("T"), c("s_suppkey").cast("string")).alias("ticker"), c("s_suppkey").alias("cik"))
    return C.guarded_ciks(companies, known).select("c_custkey", "cik")


@query("q_identities", """select s_suppkey, trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '_', 'g'), '_') as slug, 'S' || s_suppkey as base, case s_suppkey % 3 when 0 then 'FY2024 Annual report' when 1 then 'Q2 FY2024 Annual report' else 'Annual report' end as label from supplier""")
def q_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    year, period = F.when(c("s_suppkey") % 3 != 2, 2024), F.when(c("s_suppkey") % 3 == 1, "Q2").when(c("s_suppkey") % 3 == 0, "FY")
    return table(spark, sf_dir, "supplier").select("s_suppkey", C.slug(c("s_name")).alias("slug"), C.base_ticker(F.concat(F.lit("S"), c("s_suppkey").cast("string"), F.lit(".N"))).alias("base"), C.document_label(year, period, F.lit("annual_report")).alias("label"))


def order_documents(spark: SparkSession, sf_dir: str, status: str) -> DataFrame:
    """A customer's orders of a status as documents of one source."""
    o = table(spark, sf_dir, "orders").filter(c("o_orderstatus") == status)
    period = F.when(c("o_orderkey") % 4 == 0, "FY").otherwise(F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string")))
    return o.select(c("o_custkey").alias("cik"), c("o_orderkey").alias("seq"), F.year("o_orderdate").alias("fiscal_year"), period.alias("fiscal_period"), (c("o_orderkey") % 3).alias("trust"), c("o_orderpriority").alias("origin"))


_FOUND_SQL = """found as (select o_custkey as cik, o_orderkey, case o_orderstatus when 'F' then 0 else 1 end as src, cast(year(o_orderdate) as int) as fiscal_year, case when o_orderkey % 4 = 0 then 'FY' else 'Q' || quarter(o_orderdate) end as fiscal_period, o_orderkey % 3 as trust, o_orderpriority as origin from orders where o_orderstatus in ('F', 'O'))"""


def found_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.discovered(order_documents(spark, sf_dir, "F"), order_documents(spark, sf_dir, "O"))


@query("q_accepted_order", "with " + _FOUND_SQL + """ select cik, o_orderkey, cast(row_number() over (partition by cik order by fiscal_year desc, case fiscal_period when 'FY' then 5 else cast(fiscal_period[2] as int) end desc, trust desc, src, o_orderkey) as int) as place from found""")
def q_accepted_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.accepted_order(found_documents(spark, sf_dir), "cik").select("cik", c("seq.seq").alias("o_orderkey"), "place")


@query("q_listed", "with " + _FOUND_SQL + " select cik, array_to_string(list_sort(list_distinct(list(fiscal_year))), ',') as years, array_to_string(list_sort(list_distinct(list(origin))), ',') as origins from found group by cik")
def q_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.listed(found_documents(spark, sf_dir), "cik")
    return rows.select("cik", F.concat_ws(",", c("years").cast("array<string>")).alias("years"), F.concat_ws(",", "origins").alias("origins"))


@query("q_section_list", """select doc_id, section, cast(row_number() over (partition by doc_id order by first) as int) as place from (select doc_id, section, min(ordinal) as first from
 (select doc_id, i - 1 as ordinal, nullif(substring(t[i], 1, 12), '') as section from (select doc_id, string_split(text, chr(10)) as t, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents)) where section is not null group by doc_id, section)""")
def q_section_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines' first characters as section names, each where it first stands."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "line"))
    return C.section_list(lines.withColumn("section", F.nullif(F.substring("line", 1, 12), F.lit("")))).select("doc_id", "section", "place")


@query("q_top_unverified", """with f as (select l_suppkey as ticker, l_orderkey * 8 + l_linenumber as seq, cast(l_quantity as bigint) as figure, l_shipmode_ as context from (select *, l_linestatus || l_returnflag as l_shipmode_ from lineitem) where l_linenumber % 2 = 1),
 n as (select ticker, count(*) as n_unverified from f group by ticker), g as (select ticker, figure, context, min(seq) as seq from f group by all)
 select ticker, figure, context, seq, cast(row_number() over (partition by ticker order by seq, figure, context) as int) as place, n_unverified from g join n using (ticker) qualify row_number() over (partition by ticker order by seq, figure, context) <= 25""")
def q_top_unverified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(c("l_suppkey").alias("ticker"), (c("l_orderkey") * 8 + c("l_linenumber")).alias("seq"), c("l_quantity").cast("long").alias("figure"), F.concat("l_linestatus", "l_returnflag").alias("context"), (c("l_linenumber") % 2 == 0).alias("traced"))
    return C.top_unverified(rows).select("ticker", "figure", "context", "seq", "place", "n_unverified")


@query("q_answer_json", """select event_id, case event_id % 4 when 3 then null else props end as json from events""")
def q_answer_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' JSON bare, in a fence, among words, and cut short."""
    p = c("props")
    answer = F.when(c("event_id") % 4 == 0, p).when(c("event_id") % 4 == 1, F.concat(F.lit("Here:\n```json\n"), p, F.lit("\n```"))).when(c("event_id") % 4 == 2, F.concat(F.lit("It is "), p, F.lit(" as asked."))).otherwise(F.concat(F.lit("{ cut "), F.substring(p, 1, 3)))
    return table(spark, sf_dir, "events").select("event_id", C.json_of(answer).alias("json"))


@query("q_statements_joined", """with y as (select o_custkey as ticker, cast(year(o_orderdate) as int) as fiscal_year, o_orderstatus as s, cast(sum(o_orderkey) as bigint) as v from orders group by all),
 k as (select ticker, fiscal_year from (select distinct ticker, fiscal_year from y) qualify row_number() over (partition by ticker order by fiscal_year desc) <= 6)
 select ticker, fiscal_year, max(v) filter (s = 'F') as income, max(v) filter (s = 'O') as balance, max(v) filter (s = 'P') as cash from k left join y using (ticker, fiscal_year) group by all""")
def q_statements_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three statements by order status; a year comes where any has it."""
    rows = table(spark, sf_dir, "orders").groupBy(c("o_custkey").alias("ticker"), F.year("o_orderdate").alias("fiscal_year"), "o_orderstatus").agg(F.sum("o_orderkey").alias("v"))
    parts = [rows.filter(c("o_orderstatus") == s).select("ticker", "fiscal_year", c("v").alias(n)) for s, n in (("F", "income"), ("O", "balance"), ("P", "cash"))]
    return C.statements_joined(*parts)


@query("q_exhibit", """select l_orderkey as filing, min(l_linenumber) as n from lineitem where l_linenumber % 2 = 1 and l_returnflag <> 'R' group by l_orderkey""")
def q_exhibit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as the rows of filings' indexes: exhibits by line number, some of them no pages."""
    n = c("l_linenumber").cast("string")
    kind = F.when(c("l_linenumber") % 2 == 1, F.concat(F.lit(" ex-99."), n)).otherwise(F.concat(F.lit("EX-99."), n, F.lit("x")))
    url = F.concat(F.lit("/a"), n, F.when(c("l_returnflag") == "R", ".pdf").when(c("l_returnflag") == "A", ".HTM").otherwise(".html"))
    found = C.exhibit(table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("filing"), kind.alias("kind"), url.alias("url")))
    return found.select("filing", F.regexp_extract("url", "([0-9]+)", 1).cast("int").alias("n"))


@query("q_exhibit_pages", """select l_orderkey as filing, 'https://filings.example/a/' || min(l_linenumber) || '.htm' as url from lineitem where l_linenumber % 2 = 1 and l_returnflag <> 'R' group by l_orderkey""")
def q_exhibit_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the HTML indexes of filings, a table row for each line; some rows are no exhibits and some no pages."""
    n = c("l_linenumber").cast("string")
    kind = F.when(c("l_linenumber") % 2 == 1, F.concat(F.lit("EX-99."), n)).otherwise("EX-10")
    link = F.concat(F.lit("/a/"), n, F.when(c("l_returnflag") == "R", ".pdf").otherwise(".htm"))
    row = F.concat(F.lit("<tr class=x>\n<td scope='row'>"), n, F.lit("</td><td> Report </td><td><a class=y href=\""), link, F.lit("\">file</a></td><TD>&nbsp;"), kind, F.lit("</TD></tr>"))
    pages = table(spark, sf_dir, "lineitem").groupBy(c("l_orderkey").alias("filing")).agg(F.concat(F.lit("<html><table><tr><th>Seq</th></tr>"), F.array_join(F.collect_list(row), "\n"), F.lit("</table></html>")).alias("html"))  # seven rows at most
    return C.exhibit(C.index_rows(pages, "https://filings.example"))


@query("q_year_months", "select o_orderkey, cast(year(o_orderdate) * 12 + month(o_orderdate) - 1 as int) as month from orders where o_orderkey % 3 < 2 union all select o_orderkey, null from orders where o_orderkey % 3 = 2")
def q_year_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months read from dates as figures and as words, and from text without one."""
    k, day = c("o_orderkey") % 3, c("o_orderdate").cast("date")
    text = F.when(k == 0, F.concat(F.lit("due "), F.date_format(day, "yyyy-MM"))).when(k == 1, F.concat(F.lit("in "), F.date_format(day, "MMMM yyyy"), F.lit(" or so"))).otherwise("some day")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.year_month(text).alias("month"))


@query("q_amount_texts", """with o as (select o_orderkey, cast(o_totalprice as decimal(18, 2)) as p, case when o_orderkey % 200 / 2.0 > 1.5 then o_orderkey % 200 / 200.0::double else o_orderkey % 200 / 2.0::double end as share from orders)
 select o_orderkey, case when p >= 1e6 then printf('%.2f', round(p * 0.000001, 2)) || 'm' else printf('%.0f', round(p, 0)) end as plain,
  'USD ' || case when p >= 1e6 then printf('%.2f', round(p * 0.000001, 2)) || 'bn' when p >= 1000 then printf('%.2f', round(p * 0.001, 2)) || 'm' else printf('%.0f', round(p * 1000, 0)) end as thousandfold, round_even(share / 0.005, 0) * 0.005 as share, o_orderkey % 2 = 0 as numeric from o""")
def q_amount_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as compact text, whole percentages as fractions, and text that is a number or none."""
    price, key = c("o_totalprice").cast("double"), c("o_orderkey")
    text = F.when(key % 2 == 0, price.cast("string")).otherwise(F.when(key % 3 == 0, "NaN").otherwise("n/a"))
    return table(spark, sf_dir, "orders").select("o_orderkey", X.money(price, F.lit(None).cast("string")).alias("plain"), X.money(price * 1000, F.lit("USD")).alias("thousandfold"), X.percent(key % 200 / 2.0).alias("share"), X.number(text).isNotNull().alias("numeric"))
