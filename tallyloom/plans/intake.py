"""Registered queries on layout, answers as of a time, calendars, numbers in JSON and the shared limit, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators import ingest as I
from tallyloom.operators import layout as Y
from tallyloom.operators import reporting as R
from tallyloom.plans.registry import query
from tallyloom.sources.tables import table
from tallyloom.streaming import limits as L

c = F.col
LINES, DOWN = 40, 7  # lines of a page; they stand in the file seven apart


def _laid_out(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The documents' lines, forty a page and in another order in the file than on it; some larger or bold; a page in
    three has a table over some lines, of figures or of words."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "text"))
    row = (c("k") % LINES * DOWN) % LINES
    lines = docs.select(
        "doc_id", F.floor(c("k") / LINES).cast("int").alias("page"), (c("k") % LINES).alias("ordinal"), "text", F.when((c("doc_id") + c("k")) % 5 == 0, 12.0).otherwise(10.0).alias("size"), ((c("doc_id") + c("k")) % 11 == 0).alias("bold"),
        F.when(c("doc_id") % 4 == 1, "10-K").alias("form"), F.lit(50.0).alias("x0"), (row * 14.0).alias("y0"), (50.0 + F.least(F.length("text"), F.lit(90)) * 5).alias("x1"), (row * 14.0 + 12).alias("y1"), (row * 14.0).alias("top"),
    )
    pages = lines.select("doc_id", "page").distinct().filter((c("doc_id") + c("page")) % 3 == 0)
    box = [F.lit(45.0).alias("x0"), (c("page") % 5 * 28.0 + 5).alias("y0"), F.lit(300.0).alias("x1"), (c("page") % 5 * 28.0 + 105).alias("y1")]
    figures = F.when(c("doc_id") % 2 == 0, "| a | 1 |\n| --- | --- |\n| b | 2 |").otherwise("| a | b |\n| --- | --- |\n| c | d |")
    return lines, pages.select("doc_id", "page", F.lit(0).alias("item"), *box, figures.alias("markdown"), (c("page") % 2 == 0).alias("ruled"))


@query("q_layout", r"""with l as (select doc_id, cast((i - 1) // 40 as int) as page, (i - 1) % 40 as ordinal, i - 1 as k, t[i] as text from (select doc_id, string_split(text, chr(10)) as t, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents)),
 p as (select *, case when (doc_id + k) % 5 = 0 then 12.0 else 10.0 end as size, (doc_id + k) % 11 = 0 as bold, doc_id % 4 = 1 as filed, 50.0::double as x0, ((k % 40 * 7) % 40) * 14.0::double as y0, 50.0::double + least(length(text), 90) * 5 as x1, ((k % 40 * 7) % 40) * 14.0::double + 12 as y1 from l),
 tab as (select distinct doc_id, page, 45.0::double as x0, page % 5 * 28.0::double + 5 as y0, 300.0::double as x1, page % 5 * 28.0::double + 105 as y1 from p where (doc_id + page) % 3 = 0 and (page % 2 = 0 or doc_id % 2 = 0)),
 body as (select doc_id, arg_max(size, n * 10 - case when size = first_size then 0 else 1 end) as body from (select doc_id, size, sum(length(text)) as n, any_value(first_size) as first_size from (select *, first_value(size) over (partition by doc_id order by k) as first_size from p where page < 25 and trim(text) <> '') group by doc_id, size) group by doc_id),
 shown as (select p.*, coalesce(body, 10.0) as body from p left join body using (doc_id) where trim(text) <> '' and not exists (select 1 from tab t where t.doc_id = p.doc_id and t.page = p.page
   and greatest(least(p.x1, t.x1) - greatest(p.x0, t.x0), 0) * greatest(least(p.y1, t.y1) - greatest(p.y0, t.y0), 0) > 0.5 * (p.x1 - p.x0) * (p.y1 - p.y0))),
 heads as (select doc_id, page, y0 as y, 1 as layer, ordinal, (size >= body * 1.15 or bold) and length(trim(text)) between 3 and 90 and not regexp_matches(trim(text), '[.,;]$') and length(regexp_replace(trim(text), '[^\p{L}]', '', 'g')) >= greatest(3, length(trim(text)) * 0.5) as head, trim(text) as text from shown
   union all select doc_id, page, y0, 0, null, false, null from tab),
 placed as (select *, row_number() over (partition by doc_id, page order by y, layer, ordinal) as place from heads)
 select doc_id, page, cast(place as bigint) as place, cast(ordinal as bigint) as ordinal, case when layer = 0 then 'table' when head then 'heading' else 'text' end as kind,
   last_value(case when head then text end ignore nulls) over (partition by doc_id order by page, place rows between unbounded preceding and current row) as section from placed""")
def q_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and tables in reading order under their headings."""
    rows = Y.blocks(*_laid_out(spark, sf_dir))
    return rows.select("doc_id", "page", c("place").cast("long").alias("place"), c("ordinal").cast("long").alias("ordinal"), "kind", "section")


@query("q_answers_as_of", """with e as (select event_id, user_id as key, floor(epoch(ts::timestamp))::double as at_, event_type, value from events), good as (select key, at_, min(value) as body from e where event_type in ('view', 'click') and value >= 10 group by all)
 select e.event_id, g.body, g.at_ as fetched_at, case when g.at_ is null then 'missing' when e.at_ - g.at_ < 43200 then 'fresh' else 'stale' end as state from (select * from e where event_type = 'purchase') e asof left join good g on e.key = g.key and e.at_ >= g.at_""")
def q_answers_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases ask for a user's last good answer; views and clicks fetch it, and fail below a value of 10."""
    e = table(spark, sf_dir, "events").select("event_id", c("user_id").alias("key"), F.unix_timestamp(c("ts").cast("timestamp")).cast("double").alias("at"), "event_type", "value")
    fetches = e.filter(c("event_type").isin("view", "click")).select("key", "at", (c("value") >= 10).alias("ok"), c("value").alias("body"))
    return I.answers_as_of(e.filter("event_type = 'purchase'").select("event_id", "key", "at"), fetches, 43200.0).select("event_id", "body", "fetched_at", "state")


@query("q_calendar", """with recursive d as (select o_custkey as ticker, cast(o_orderdate as date) as d, min(case when o_orderstatus = 'F' then 1 else 2 end) as feed from orders where o_orderstatus in ('F', 'O') and cast(o_orderdate as date) > date '1995-06-30' group by all),
 n as (select *, row_number() over (partition by ticker order by d) as k from d),
 w as (select ticker, d, feed, k, d as kept, true as take from n where k = 1 union all select n.ticker, n.d, n.feed, n.k, case when n.d - w.kept > 7 then n.d else w.kept end, n.d - w.kept > 7 from w join n on n.ticker = w.ticker and n.k = w.k + 1)
 select ticker, strftime(d, '%Y-%m-%d') as date, feed from w where take""")
def q_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finished and open orders' dates as two feeds."""
    o = table(spark, sf_dir, "orders").select(c("o_custkey").alias("ticker"), c("o_orderdate").cast("date").alias("date"), "o_orderstatus")
    rows = I.calendar(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'O'"), F.lit("1995-06-30").cast("date"))
    return rows.select("ticker", F.date_format("date", "yyyy-MM-dd").alias("date"), "feed")


@query("q_number_walk", """with l as (select l_orderkey, l_linenumber as i, cast(l_extendedprice as double) as price, cast(l_discount as double) as off, cast(l_tax as double) as tax from lineitem),
 f as (select o_orderkey as ticker, 'money' as kind, 'revenue' as key, cast(o_totalprice as double) as value from orders union all select o_orderkey, 'pct', 'operating_margin', round_even(o_orderkey % 97 / 1000.0::double * 100, 1) from orders
  union all select l_orderkey, 'money', 'fair_value', price from l union all select l_orderkey, 'pct', 'probability', round_even(off * 100, 1) from l union all select l_orderkey, 'pct', 'cagr', round_even(tax * 100, 1) from l where i % 2 = 0)
 select ticker, kind, key, value, count(*) as n from f group by all""")
def q_number_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines as nested JSON, in which some fields are known, some aren't, and some hold no numbers."""
    l = table(spark, sf_dir, "lineitem")
    deep = F.when(c("l_linenumber") % 2 == 0, F.struct(F.struct(c("l_tax").cast("double").alias("cagr"), F.array(F.lit(1), F.lit(2)).alias("revenue")).alias("inner")))
    line = F.struct(c("l_extendedprice").cast("double").alias("fair_value"), c("l_discount").cast("double").alias("probability"), c("l_quantity").cast("double").alias("quantity"), deep.alias("note"))
    lines = l.groupBy("l_orderkey").agg(F.collect_list(line).alias("cases"))  # seven at most
    o = table(spark, sf_dir, "orders").join(lines, c("l_orderkey") == c("o_orderkey"), "left")
    head = F.struct(c("o_totalprice").cast("double").alias("revenue"), F.lit(True).alias("net_income"), F.lit("12").alias("market_cap"), (c("o_orderkey") % 97 / 1000.0).alias("operating_margin"))
    rows = R.number_walk(o.select(c("o_orderkey").alias("ticker"), F.to_json(F.struct(head.alias("statement"), "cases")).alias("json")))
    return rows.groupBy("ticker", "kind", "key", "value").agg(F.count("*").alias("n"))


@query("q_global_limit", """with recursive e as (select event_id, user_id, event_type as action, floor(epoch(ts::timestamp))::double as at_, row_number() over (partition by user_id, event_type order by floor(epoch(ts::timestamp)), event_id) as k from events),
 w as (select event_id, user_id, action, at_, k, [at_] as kept, true as accepted from e where k = 1
  union all select e.event_id, e.user_id, e.action, e.at_, e.k, case when len(list_filter(w.kept, lambda t: e.at_ - t < 86400)) < 2 then list_append(list_filter(w.kept, lambda t: e.at_ - t < 86400), e.at_) else list_filter(w.kept, lambda t: e.at_ - t < 86400) end, len(list_filter(w.kept, lambda t: e.at_ - t < 86400)) < 2
  from w join e on e.user_id = w.user_id and e.action = w.action and e.k = w.k + 1),
 acc as (select event_id, action, at_ from w where accepted), times as (select list(distinct at_ order by at_) as ts from acc),
 s as (select ts[1] as start from times union all select list_filter(ts, lambda t: t > s.start + 86400)[1] from s, times where len(list_filter(ts, lambda t: t > s.start + 86400)) > 0),
 p as (select acc.*, s.start from acc asof join s on acc.at_ >= s.start)
 select event_id, start, row_number() over (partition by action, start order by at_, event_id) <= 40 as accepted from p""")
def q_global_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty events of a kind in a window that restarts, of those that the users' own limits let through."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", c("event_type").alias("action"), F.unix_timestamp(c("ts").cast("timestamp")).cast("double").alias("at"))
    return L.global_limit(L.session_limit(e, 2, L.DAY).filter("accepted").drop("accepted"), 40).select("event_id", "start", "accepted")
