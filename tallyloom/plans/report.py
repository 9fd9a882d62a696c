"""Registered queries on chat, integrity checks, pages and rate limits, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.operators import chat as C
from tallyloom.operators import documents as D
from tallyloom.operators import history as H
from tallyloom.operators import qa as Q
from tallyloom.operators import sections as S
from tallyloom.operators import valuation as V
from tallyloom.plans.registry import query
from tallyloom.plans.valuation import INPUTS_SQL, SCENARIO_SQL, fair_sql, inputs
from tallyloom.sources.tables import HISTORY_SQL, history, table
from tallyloom.streaming import limits as L

c = F.col


@query("q_chat_history", """select conv_id, turn, coalesce(array_to_string(list_transform(list_filter(l, lambda x: not x.blank), lambda x: x.line), chr(10)), '') as history, cast(coalesce(len(list_filter(l, lambda x: not x.blank)), 0) as int) as n_lines
 from (select conv_id, turn, list({'line': concat_ws(': ', role, substring(trim(text), 1, 400)), 'blank': trim(coalesce(text, '')) = ''}) over (partition by conv_id order by turn rows between 6 preceding and 1 preceding) as l from conversations)""")
def q_chat_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.last_turns(table(spark, sf_dir, "conversations"), 6, 400)


# Answers: assistants' turns with marks after them; passages: the turns of the conversation before them.
_ANSWER_SQL = "ans as (select conv_id * 1000 + turn as answer_id, conv_id, turn, text || ' [SOURCE 1, ' || (turn + 2) || '] [' || turn || ']' as text, turn as n from conversations where role = 'assistant')"


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").filter("role = 'assistant'")
    text = F.concat("text", F.lit(" [SOURCE 1, "), (c("turn") + 2).cast("string"), F.lit("] ["), c("turn").cast("string"), F.lit("]"))
    return rows.select((c("conv_id") * 1000 + c("turn")).alias("answer_id"), "conv_id", "turn", C.normal_markers(text).alias("text"), c("turn").alias("n"))


@query("q_citations", "with " + _ANSWER_SQL + """, cited as (select distinct answer_id, conv_id, turn, unnest([1, turn]) as number from ans)
 select answer_id, cast(number as int) as number, sha256(p.text) as passage from cited k join conversations p on p.conv_id = k.conv_id and p.turn = k.number - 1 where p.turn < k.turn""")
def q_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = answers(spark, sf_dir)
    before = table(spark, sf_dir, "conversations").select("conv_id", (c("turn") + 1).cast("int").alias("number"), c("text").alias("passage"), c("turn").alias("at"))
    passages = own.select("answer_id", "conv_id", "turn").join(before, "conv_id").filter("at < turn").select("answer_id", "number", "passage")
    return C.citations(own.select("answer_id", "text"), passages).select("answer_id", "number", F.sha2("passage", 256).alias("passage"))


@query("q_stripped", "with " + _ANSWER_SQL + " select answer_id, sha256(replace(text, ' [SOURCE 1, ' || (turn + 2) || ']', ' [1]')) as text, 1 as n_bad from ans")
def q_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = answers(spark, sf_dir)
    out = C.stripped(own.select("answer_id", "text"), own.select("answer_id", "n"))
    return out.select("answer_id", F.sha2("text", 256).alias("text"), "n_bad")


@query("q_coverage", "select conv_id, round_even(avg(case when role = 'assistant' then 100.0::double else 0 end), 0) as coverage from conversations group by conv_id")
def q_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.when(c("role") == "assistant", F.concat("text", F.lit(" [2]"))).otherwise(c("text"))
    return C.coverage(table(spark, sf_dir, "conversations").select("conv_id", marked.alias("paragraph")), "conv_id")


@query("q_qa_valuation", "with " + INPUTS_SQL + f", v as (select ticker, n_lines, {fair_sql()} as fair from inputs where terminal_growth < wacc) select ticker, 'CRITICAL' as severity, 'valuation' as \"check\", cast((n_lines % 3 = 0)::int + (n_lines % 7 = 0)::int as bigint) as n from v where fair <> 0 and (n_lines % 3 = 0 or n_lines % 7 = 0)")
def q_qa_valuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets and base cases, some of them moved, against the DCF value."""
    rows, hist, _ = inputs(spark, sf_dir)
    v = V.valued(rows).filter("fair_value is not null").join(H.latest(hist).select("ticker", "n_lines"), "ticker")
    v = v.select("ticker", c("fair_value").alias("dcf_value"), (c("fair_value") * F.when(c("n_lines") % 3 == 0, 1.01).otherwise(1.001)).alias("target"), (c("fair_value") * F.when(c("n_lines") % 7 == 0, 0.9).otherwise(1.01)).alias("base_case"))
    return Q.valuation_integrity(v).groupBy("ticker", "severity", "check").agg(F.count("*").alias("n"))


@query("q_qa_consistency", "with " + SCENARIO_SQL + f""", sets as (select ticker, max(fair_value) filter (scenario = 'bear') as a, max(fair_value) filter (scenario = 'base') as b, max(fair_value) filter (scenario = 'bull') as z, sum(probability) as p from cases group by ticker),
 v as (select ticker, price, case when terminal_growth < wacc then {fair_sql()} end as fair from inputs join (select ticker, price from market) m using (ticker)),
 f as (select ticker, 'cases are not in order' as message from sets where not (a <= b and b <= z) union all select ticker, 'probabilities do not sum to 1' from sets where abs(p - 1) > 0.01
  union all select ticker, 'rating against upside' from v where fair > 0 and price <> 0 and ((fair / price - 1 >= 0.15 and fair / price - 1 <= 0) or (fair / price - 1 < -0.10 and fair / price - 1 >= 0)))
 select ticker, 'CRITICAL' as severity, 'consistency' as "check", message, cast(row_number() over (partition by ticker order by message) as int) as place from f""")
def q_qa_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, hist, mkt = inputs(spark, sf_dir)
    verdicts = V.verdicts(V.valued(rows).select("ticker", c("fair_value").alias("dcf_value"), F.lit(0.0).alias("blended")), mkt.select("ticker", "price"))
    est = mkt.select("ticker", c("price").alias("value"), F.lit(1.0).alias("weight"))
    return Q.sorted_findings(Q.consistency(V.scenarios(rows, hist), verdicts, V.blend(est)))


@query("q_moat", """with d as (select s_nationkey as ticker, ['Strong brand','Moderate scale','Weak','None','Limited reach','Medium cost'][s_suppkey % 6 + 1] as strength from supplier), a as (select ticker, avg(case lower(split_part(strength, ' ', 1)) when 'strong' then 3.0::double when 'moderate' then 2 when 'medium' then 2 when 'weak' then 1 when 'limited' then 1 when 'none' then 0 end) as average from d group by ticker)
 select ticker, round(average, 6) as average, case when average >= 2.3 then 'Wide' when average >= 1.3 then 'Narrow' else 'None' end as moat from a""")
def q_moat(spark: SparkSession, sf_dir: str) -> DataFrame:
    strength = F.element_at(F.array(*map(F.lit, ["Strong brand", "Moderate scale", "Weak", "None", "Limited reach", "Medium cost"])), (c("s_suppkey") % 6 + 1).cast("int"))
    return Q.moat(table(spark, sf_dir, "supplier").select(c("s_nationkey").alias("ticker"), strength.alias("strength"))).withColumn("average", F.round("average", 6))


# A page's blocks by replacing tags: hidden parts go, what parts blocks becomes a mark, other tags vanish.
_PARTS = "p|div|li|ul|ol|tr|section|article|header|footer|blockquote|pre|br|nav|body|table|hr"
_SHOWN = "html"
for _hidden in ("<!--[\\s\\S]*?-->", "<script[\\s\\S]*?</script>", "<style[\\s\\S]*?</style>", "<head>[\\s\\S]*?</head>"):
    _SHOWN = f"regexp_replace({_SHOWN}, '{_hidden}', '', 'g')"
for _tag, _mark in (("<h1>", "chr(1) || chr(2)"), ("</h1>", "chr(1)"), (f"</?({_PARTS})\\b[^>]*>", "chr(1)"), ("<[^>]*>", "''")):
    _SHOWN = f"regexp_replace({_SHOWN}, '{_tag}', {_mark}, 'g')"
for _name, _sign in (("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&amp;", "&")):
    _SHOWN = f"replace({_SHOWN}, '{_name}', '{_sign}')"
HTML_BLOCKS_SQL = f"""split_ as (select page_id as doc_id, string_split({_SHOWN}, chr(1)) as parts from pages), each_ as (select doc_id, i, parts[i] as part from (select doc_id, parts, unnest(range(1, len(parts) + 1)) as i from split_)),
 words as (select doc_id, i, starts_with(part, chr(2)) as head, trim(regexp_replace(replace(part, chr(2), ''), '\\s+', ' ', 'g')) as text from each_),
 html_blocks as (select doc_id, cast(row_number() over (partition by doc_id order by i) - 1 as int) as ordinal, case when head then 'heading' else 'text' end as kind, text, 1 as page,
   last_value(case when head then text end ignore nulls) over (partition by doc_id order by i rows between unbounded preceding and current row) as section from words where text <> '')"""


@query("q_dispatch", "with " + HTML_BLOCKS_SQL + """, src as (select page_id, case page_id % 10 when 3 then 'broken gzip' when 5 then 'a PDF' when 7 then 'no content' when 8 then 'no parser for application/pdf' when 9 then 'empty' else 'ok' end as status, html from pages),
 n as (select doc_id, count(*) as n from html_blocks group by doc_id)
 select status, count(*) as n_sources, case status when 'no content' then 0 when 'empty' then 1 else count(distinct html) end as n_documents, cast(case status when 'ok' then sum(n) else 0 end as bigint) as n_blocks from src left join n on doc_id = page_id group by status""")
def q_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with damaged, missing and foreign sources among them: what was parsed, and how many failed of what."""
    k, raw = c("page_id") % 10, c("html").cast("binary")
    content = F.when(k == 3, F.concat(F.unhex(F.lit("1F8B")), raw)).when(k == 5, F.concat(F.lit("%PDF-").cast("binary"), raw)).when(k == 9, F.lit(" \n ").cast("binary")).when(k != 7, raw)
    kind = F.when(k == 8, "application/pdf").otherwise("html")
    return D.dispatch_counts(D.dispatch(table(spark, sf_dir, "pages").select(c("page_id").alias("source_id"), content.alias("content"), kind.alias("content_type"))))


@query("q_bpe_counts")
def q_bpe_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of each document by a public vocabulary of 50,000."""
    import public_tokenizers

    return D.bpe_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json")).select("doc_id", "bpe_tokens")


@query("q_html_blocks", "with " + HTML_BLOCKS_SQL + " select * from html_blocks")
def q_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.html_blocks(table(spark, sf_dir, "pages").select(c("page_id").alias("doc_id"), "html"))


@query("q_chunks")
def q_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    made = D.chunks(pages.select(c("page_id").alias("doc_id"), "html"))
    return made.withColumn("header", D.context_header(F.lit("crawl"), c("doc_id").cast("string"), c("section"), c("page")))


@query("q_sections", """with l as (select doc_id, i - 1 as ordinal, t[i] as line from (select doc_id, string_split(text, chr(10)) as t, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents)),
 h as (select *, length(trim(line)) between 3 and 90 and not regexp_matches(trim(line), '[.,;]$') and length(regexp_replace(trim(line), '[^\\p{L}]', '', 'g')) >= greatest(3, length(trim(line)) * 0.5) as head from l),
 s as (select doc_id, ordinal, head, last_value(case when head then trim(line) end ignore nulls) over (partition by doc_id order by ordinal rows between unbounded preceding and current row) as section from h)
 select doc_id, count(*) as n_lines, count(*) filter (head) as n_headings, count(distinct section) as n_sections, count(*) filter (section is null) as n_before from s group by doc_id""")
def q_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines under the headings that they follow."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "line")).withColumn("head", T.looks_like_heading(c("line")))
    order = Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("section", F.last(F.when(c("head"), F.trim("line")), ignorenulls=True).over(order))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count(F.when(c("head"), 1)).alias("n_headings"), F.countDistinct("section").alias("n_sections"), F.count(F.when(c("section").isNull(), 1)).alias("n_before"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", c("event_type").alias("action"), F.unix_timestamp(c("ts").cast("timestamp")).cast("double").alias("at"))


@query("q_session_limit", """with recursive e as (select event_id, user_id, event_type as action, floor(epoch(ts::timestamp)) as at_, row_number() over (partition by user_id, event_type order by floor(epoch(ts::timestamp)), event_id) as k from events),
 w as (select event_id, user_id, action, at_, k, [at_] as kept, true as accepted from e where k = 1
  union all select e.event_id, e.user_id, e.action, e.at_, e.k, case when len(list_filter(w.kept, lambda t: e.at_ - t < 86400)) < 2 then list_append(list_filter(w.kept, lambda t: e.at_ - t < 86400), e.at_) else list_filter(w.kept, lambda t: e.at_ - t < 86400) end, len(list_filter(w.kept, lambda t: e.at_ - t < 86400)) < 2
  from w join e on e.user_id = w.user_id and e.action = w.action and e.k = w.k + 1) select event_id, accepted from w""")
def q_session_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most two accepted actions of a kind per user in any 24 hours."""
    return L.session_limit(_events(spark, sf_dir), 2, L.DAY).select("event_id", "accepted")


@query("q_daily_limit", "select event_id, row_number() over (partition by event_type, floor((floor(epoch(ts::timestamp)) - 1000) / 86400) order by floor(epoch(ts::timestamp)), event_id) <= 50 as accepted from events")
def q_daily_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.daily_limit(_events(spark, sf_dir), 50, 1000.0).select("event_id", "accepted")


@query("q_spaced", """with recursive e as (select event_id, user_id, floor(epoch(ts::timestamp)) as a, row_number() over (partition by user_id order by floor(epoch(ts::timestamp)), event_id) as k from events),
 w as (select event_id, user_id, k, a as s from e where k = 1 union all select e.event_id, e.user_id, e.k, greatest(e.a, w.s + 7200.0) from w join e on e.user_id = w.user_id and e.k = w.k + 1) select event_id, cast(s as double) as starts from w""")
def q_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When a user's events start if two hours have to lie between them."""
    return L.spaced(_events(spark, sf_dir).select(c("user_id").alias("key"), "event_id", "at"), 7200.0).select("event_id", "starts")


HEADS = ["Risk factors", "Management's discussion", "Consolidated balance sheets", "Notes to the consolidated financial statements", "Our business", "Chairman's letter"]


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _narrative_sql(words: str) -> str:
    """SQL for the first label whose words stand in a line."""
    holds = lambda p: " and ".join([f"contains({words}, ' {p.split(' … ')[0]} ')", *(f"contains(' ' || string_split({words}, ' {p.split(' … ')[0]} ')[-1], ' {x} ')" for x in p.split(" … ")[1:])])
    return "case " + " ".join(f"when {' or '.join('(' + holds(p) + ')' for p in ps)} then {_quoted(n)}" for n, ps in S.NARRATIVE.items()) + " end"


def _items_sql(form: str, number: str) -> str:
    return f"case {number} " + " ".join(f"when '{k}' then {_quoted(v)}" for f, k, v in S.ITEMS if f == form) + f" else 'Item ' || {number} || ' -Own words' end"


@query("q_item_sections", f"""with l as (select doc_id, i - 1 as ordinal, t[i] as own from (select doc_id, string_split(text, chr(10)) as t, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents)),
 h as (select doc_id, ordinal, case doc_id % 4 when 1 then '10-K' when 3 then '10-Q/A' end as form, case when ordinal % 7 <> 3 then own when doc_id % 2 = 1 then 'Item ' || (ordinal // 7 % 17 + 1) || '. Own words' else [{', '.join(map(_quoted, HEADS))}][ordinal // 7 % 6 + 1] end as line from l),
 n as (select *, nullif(upper(regexp_extract(line, '(?i)^\\s*item\\s+([0-9]{{1,2}}[A-C]?)([.:)–—\\s-]|$)', 1)), '') as number, ' ' || trim(regexp_replace(lower(line), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ' as words from h),
 s as (select *, last_value(case when number is not null then case when form like '10-Q%' then {_items_sql('10-Q', 'number')} else {_items_sql('10-K', 'number')} end
   when form is null and length(trim(line)) between 3 and 90 then {_narrative_sql('words')} end ignore nulls) over (partition by doc_id order by ordinal rows between unbounded preceding and current row) as section from n)
 select doc_id, count(*) as n_lines, count(section) as n_labelled, count(distinct section) as n_sections, arg_max(section, ordinal) filter (section is not null) as last_section from s group by doc_id""")
def q_item_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' lines with a heading put in for every seventh: items in odd documents, words in even ones."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "own"))
    at = F.floor(c("ordinal") / 7)
    head = F.when(c("doc_id") % 2 == 1, F.concat(F.lit("Item "), (at % 17 + 1).cast("string"), F.lit(". Own words"))).otherwise(F.element_at(F.array(*map(F.lit, HEADS)), (at % len(HEADS) + 1).cast("int")))
    form = F.when(c("doc_id") % 4 == 1, "10-K").when(c("doc_id") % 4 == 3, "10-Q/A")
    rows = S.labelled(lines.select("doc_id", "ordinal", F.when(c("ordinal") % 7 == 3, head).otherwise(c("own")).alias("line"), form.alias("form")))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count("section").alias("n_labelled"), F.countDistinct("section").alias("n_sections"), F.max_by("section", "ordinal").alias("last_section"))


@query("q_table_figures", """with x as (select l_orderkey, count(*) as n, count(*) filter (l_linenumber % 2 = 1) as odd, count(*) filter (l_linenumber >= 10) as wide from lineitem group by l_orderkey)
 select l_orderkey, round((2 * n + odd) / (3.0::double + 3 * n), 6) as ratio, n + wide >= 4 as looks from x""")
def q_table_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pipe tables of their lines: the share of figures among the cells, and whether they make a table of figures."""
    l = table(spark, sf_dir, "lineitem")
    note = F.when(c("l_linenumber") % 2 == 1, F.lit("(3)%")).otherwise("n/a")
    row = F.concat(F.lit("| "), c("l_linenumber").cast("string"), F.lit(" | $"), F.format_number(c("l_extendedprice"), 2), F.lit(" | "), note, F.lit(" |"))
    lines = l.groupBy("l_orderkey").agg(F.concat_ws("\n", F.array_sort(F.collect_list(row))).alias("rows"))  # an order has seven lines at most
    text = F.concat(F.lit("| Line | Total | Note |\n| --- | --- | --- |\n"), c("rows"))
    return lines.select("l_orderkey", F.round(S.numeric_ratio(text), 6).alias("ratio"), S.looks_numeric(text).alias("looks"))


@query("q_figures", """with x as (select l_orderkey, l_linenumber, cast(l_extendedprice as double) as price, cast(l_quantity as bigint) as qty, cast(round(l_discount * 100) as bigint) as off,
  'Line ' || l_linenumber || ' cost US$' || printf('%.2f', l_extendedprice) || ' against ' || cast(l_quantity as bigint) || ' million last year, a discount of ' || cast(round(l_discount * 100) as bigint) || '% and £' || cast(l_quantity as bigint) || 'bn of sales in all the markets that the company named in its last report.' as text from lineitem),
 f as (select *, unnest([{'kind': 'money', 'value': price, 'own': 'US$' || printf('%.2f', price)}, {'kind': 'money', 'value': qty * 1e6, 'own': qty || ' million'}, {'kind': 'percent', 'value': off::double, 'own': off || '%'}, {'kind': 'money', 'value': qty * 1e9, 'own': '£' || qty || 'bn'}]) as y from x),
 p as (select l_orderkey, l_linenumber, y.kind as kind, y.value as value, y.own as own, text, strpos(text, case when y.kind = 'money' and y.value = qty * 1e6 then 'against ' || y.own when y.kind = 'percent' then 'of ' || y.own else y.own end) - 1 + case when y.kind = 'money' and y.value = qty * 1e6 then 8 when y.kind = 'percent' then 3 else 0 end as at_ from f)
 select l_orderkey, l_linenumber, kind, own as figure, value, case when at_ > 70 then '…' else '' end || trim(substring(text, greatest(at_ - 70, 0) + 1, at_ + length(own) + 70 - greatest(at_ - 70, 0))) || case when at_ + length(own) + 70 < length(text) then '…' else '' end as context from p""")
def q_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figures in a sentence on each order line, with what stands around them."""
    qty = c("l_quantity").cast("long").cast("string")
    text = F.concat(F.lit("Line "), c("l_linenumber").cast("string"), F.lit(" cost US$"), F.format_string("%.2f", c("l_extendedprice").cast("double")), F.lit(" against "), qty, F.lit(" million last year, a discount of "),
        F.round(c("l_discount") * 100).cast("long").cast("string"), F.lit("% and £"), qty, F.lit("bn of sales in all the markets that the company named in its last report."))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.explode(T.located(text)).alias("x"))
    return rows.select("l_orderkey", "l_linenumber", "x.kind", "x.figure", "x.value", "x.context")
