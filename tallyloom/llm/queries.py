"""The operators' registered queries, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyloom.llm import benchmark_join, hamming_topk, license_scan, media_store, mixing, ngram_join, piece_transducer, prefix_trie, quality_cnn, tool_calls, warc_derivatives, wavelet_tokens, whitening
from tallyloom.llm.common import table


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming_topk.top_k(table(spark, sf_dir, "embeddings"))


OP1_SQL = """
with codes as (select distinct vec_id, list_transform(embedding, lambda x: case when x > 0 then 1 else 0 end) as bits from embeddings
    where vec_id is not null and len(embedding) > 0),
pairs as (select q.vec_id as query_id, v.vec_id,
    min(list_sum(list_transform(list_zip(q.bits, v.bits), lambda z: case when z[1] <> z[2] then 1 else 0 end))) as distance
  from codes q join codes v on q.vec_id % 20 = 0 and q.vec_id <> v.vec_id and len(q.bits) = len(v.bits) group by all),
ranked as (select query_id, row_number() over (partition by query_id order by distance, vec_id) as rank, vec_id, distance from pairs)
select query_id, cast(rank as bigint) as rank, vec_id, cast(distance as bigint) as distance from ranked where rank <= 10
"""


def op2_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cnn.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the spans as text: label, first character, end, edits."""
    rows = license_scan.scan(table(spark, sf_dir, "documents"))
    return rows.withColumn("spans", F.array_join(F.transform("spans", lambda s: F.format_string("%s:%d-%d:%d", s["label"], s["start"], s["end"], s["edits"])), ";"))


def op4_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return wavelet_tokens.read_back(wavelet_tokens.write_shards(docs, vocabulary("byte_bpe_50k.json")))


def op5_media_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the shards' names in the run's folder."""
    return media_store.describe(table(spark, sf_dir, "documents")).withColumn("shard", F.substring_index("shard", "/", -1))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc_derivatives.build(warc_derivatives.responses(table(spark, sf_dir, "pages")))
    back = warc_derivatives.read_records(index)
    return back.drop("file", "metadata_offset", "metadata_length", "conversion_offset", "conversion_length").withColumn("text", F.sha2("text", 256)).withColumnRenamed("text", "text_sha256")


# The tree of the mix: a source's domain by its number, then language and source; weights by value.
MIX_WEIGHTS = {"domain": {"crawl": 2, "forum": 3, "library": 5}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = (1, 2), 2, 20


def mix_levels() -> dict[str, Column]:
    domain = F.when(F.col("source") == "src0", "crawl").when(F.col("source").isin([f"src{k}" for k in range(1, 13)]), "forum").otherwise("library")
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs, mix_levels(), MIX_WEIGHTS, share=MIX_SHARE, epochs=MIX_EPOCHS, seed=MIX_SEED)
    return mixed.select("doc_id", F.col("__mix_domain").alias("domain"), F.col("__mix_lang").alias("lang"), F.col("__mix_source").alias("source"), F.col("__mix_tokens").alias("n_tokens"), F.col("__mix_copies").alias("copies"))


def _shares_sql(name: str, rows: str, parents: str, level: str) -> str:
    """Brothers' whole-number shares: one is full if a filling of all to its own level (cap / w) is within what is given."""
    same = " and ".join(f"a.{p} = b.{p}" for p in parents.split(", ") if p) or "true"
    over = f"partition by {parents}" if parents else ""
    both = f"partition by {parents}, full_" if parents else "partition by full_"
    path = f"{parents}, {level}" if parents else level
    return f"""
{name}_a as (select a.*, (select sum(least(b.cap * a.w, a.cap * b.w)) from {rows} b where {same}) <= a.given * a.w as full_ from {rows} a),
{name}_b as (select *, given - coalesce(sum(cap) filter (full_) over p, 0) as rest, sum(w) filter (not full_) over p as ws from {name}_a window p as ({over})),
{name}_c as (select *, case when full_ then cap else rest * w // ws end as base, case when full_ then 0 else rest * w % ws end as part from {name}_b),
{name}_d as (select *, rest - sum(base) filter (not full_) over ({over}) as spare, row_number() over ({both} order by part desc, {level}) as place from {name}_c),
{name} as (select {path}, cast(base + case when not full_ and place <= spare then 1 else 0 end as hugeint) as given from {name}_d),"""


OP8_SQL = f"""
with docs as (
  select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source,
    case when source = 'src0' then 'crawl'
      when source in ('src1','src2','src3','src4','src5','src6','src7','src8','src9','src10','src11','src12') then 'forum' else 'library' end as domain,
    case when length(coalesce(text, '')) > 0 then length(text) - length(translate(text, ' ' || chr(10), '')) + 1 else 0 end as tokens
  from documents),
leaves as (select domain, lang, source, cast(sum(tokens) as hugeint) as tokens from docs group by all),
d0 as (select domain, cast(2 * sum(tokens) as hugeint) as cap, (select cast(sum(tokens) as hugeint) // 2 from leaves) as given,
    cast(case domain when 'crawl' then 2 when 'forum' then 3 when 'library' then 5 else 1 end as hugeint) as w from leaves group by domain),
{_shares_sql("d2", "d0", "", "domain")}
l0 as (select domain, lang, cast(2 * sum(tokens) as hugeint) as cap, any_value(given) as given,
    cast(case lang when 'en' then 4 when 'de' then 2 when 'fr' then 2 when 'es' then 2 else 1 end as hugeint) as w from leaves join d2 using (domain) group by domain, lang),
{_shares_sql("l2", "l0", "domain", "lang")}
s0 as (select domain, lang, source, 2 * tokens as cap, given, cast(1 as hugeint) as w from leaves join l2 using (domain, lang)),
{_shares_sql("s2", "s0", "domain, lang", "source")}
aims as (select domain, lang, source, tokens as total, given as target from s2 join leaves using (domain, lang, source)),
split as (select *, case when total > 0 then target // total else 0 end as whole from aims),
runs as (select doc_id, domain, lang, source, tokens, whole, target - whole * total as rest,
    sum(tokens) over (partition by domain, lang, source order by md5('20:' || whole || ':' || coalesce(cast(doc_id as varchar), 'null'))) as run
  from docs join split using (domain, lang, source))
select doc_id, domain, lang, source, cast(tokens as bigint) as n_tokens, cast(whole + case when run <= rest then 1 else 0 end as bigint) as copies
from runs where whole + case when run <= rest then 1 else 0 end > 0
"""


def op9_piece_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_transducer.round_trip(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


# Schemas of the two tools that the turns are taken as.
_TEXT, _TURN = {"type": "string", "minLength": 1}, {"type": "integer", "minimum": 0}
TOOLS = {
    "context": {"type": "object", "properties": {"text": _TEXT, "turn": _TURN}, "required": ["text", "turn"], "additionalProperties": False},
    "reply": {"type": "object", "properties": {"text": _TEXT, "turn": _TURN, "after": {"type": "string", "pattern": "^c[0-9]+$"}}, "required": ["text", "turn"], "additionalProperties": False},
}


def op10_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each system or user turn is a call, which needs the conversation's first call and the one before it;
    an assistant's turn is the result of the last call before it."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    before = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    is_call = F.col("role").isin("system", "user")
    name = F.concat(F.lit("c"), F.col("turn").cast("string"))
    own = F.when(is_call, name)
    turns = turns.withColumn("call_id", own).withColumn("last", F.last(own, True).over(before)).withColumn("start", F.first(own, True).over(before))
    arguments = F.to_json(F.struct("text", "turn", F.col("last").alias("after")))  # without nulls
    tool = F.when(F.col("role") == "system", "context").otherwise("reply")
    calls = turns.filter(is_call).select("conv_id", "call_id", "turn", tool.alias("tool"), arguments.alias("arguments"), F.array_distinct(F.array_compact(F.array("start", "last"))).alias("needs"))
    results = turns.filter("role = 'assistant'").select("conv_id", F.col("last").alias("call_id"), "turn", "text")
    return tool_calls.link(calls, results, TOOLS)


OP10_SQL = """
with turns as (select conv_id, turn, role, text, case when role in ('system', 'user') then 'c' || turn end as own from conversations),
placed as (select *, last_value(own ignore nulls) over w as last, first_value(own ignore nulls) over w as start
  from turns window w as (partition by conv_id order by turn, role nulls first, text nulls first rows between unbounded preceding and 1 preceding)),
calls as (select *, row_number() over (partition by conv_id order by turn) - 1 as level from placed where own is not null),
results as (select conv_id, last as own, arg_min(text, turn) as result from placed where role = 'assistant' and last is not null group by all),
checked as (select c.*, r.result, r.own is not null as linked,
    list_sort(list_filter([case when text is null then 'text: missing' when length(text) = 0 then 'text: too short' end,
      case when role = 'system' and last is not null then 'after: not known' end], lambda x: x is not null)) as errors
  from calls c left join results r using (conv_id, own))
select conv_id, own as call_id, turn, case role when 'system' then 'context' else 'reply' end as tool, cast(level as bigint) as level,
  cast(level + 1 as bigint) as place, case when linked then 'linked' else 'pending' end as status, cast(len(errors) as bigint) as n_errors,
  '{"arguments":{' || case when last is null then '' else '"after":"' || last || '",' end || case when text is null then '' else '"text":' || to_json(text) || ',' end
    || '"turn":' || turn || '},"call_id":"' || own || '","errors":' || to_json(errors) || ',"level":' || level || ',"needs":'
    || to_json(list_sort(list_distinct(list_filter([start, last], lambda x: x is not null)))) || ',"result":' || coalesce(to_json(result), 'null')
    || ',"tool":"' || case role when 'system' then 'context' else 'reply' end || '"}' as json
from checked
"""


def op11_benchmark_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = benchmark_join.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP11_SQL = r"""
with worded as (select 'd' as kind, row_number() over () as k, doc_id as id, text from documents union all select 'i', row_number() over (), item_id, text from benchmark),
split as (select kind, k, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w from worded),
items as (select id, w, least(10, len(w)) as n, unnest(range(0, len(w) - least(10, len(w)) + 1)) as p from split where kind = 'i' and len(w) > 0),
windows as (select distinct id, n, array_to_string(list_slice(w, p + 1, p + n), ' ') as words from items),
lengths as (select distinct n from windows),
docs as (select k, id, w from split where kind = 'd'),
placed as (select k, n, w, unnest(range(0, len(w) - n + 1)) as p from docs cross join lengths where len(w) >= n),
slices as (select k, n, p, array_to_string(list_slice(w, p + 1, p + n), ' ') as words from placed),
found as (select s.k, s.p, s.n, x.id from slices s join windows x using (n, words)),
hits as (select k, count(distinct p) as n_hit from (select k, unnest(range(p, p + n)) as p from (select distinct k, p, n from found)) group by k),
named as (select k, count(*) as n_items, string_agg(id, ',' order by id) as ids from (select distinct k, cast(id as varchar) as id from found where id is not null) group by k)
select d.id as doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from docs d left join hits using (k) left join named using (k)
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation beyond a long is null here; the operator has it as a decimal."""
    return whitening.whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


OP13_SQL = """
with recursive turns as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), sha256(coalesce(text, ''))) as pos from conversations where conv_id is not null),
own as (select conv_id, max(pos) as n_own, cast(conv_id as varchar) as name from turns group by conv_id),
bits as (select conv_id, name, 0 as i, cast(4294967295 as bigint) as c from own
  union all
  select conv_id, name, i + 1, xor(x >> 1, 3988292384 * (x & 1)) from (select conv_id, name, i, case when i % 8 = 0 then xor(c, ascii(substr(name, i // 8 + 1, 1))) else c end as x from bits where i < 8 * length(name))),
convs as (select conv_id, n_own, conv_id - conv_id % 5 as base, xor(c, 4294967295) % 9 as h from bits join own using (conv_id) where i = 8 * length(bits.name)),
sized as (select c.*, least(c.h, coalesce(b.n_own, 0)) as lead from convs c left join own b on b.conv_id = c.base),
rebuilt as (select c.conv_id, t.pos, role, text from sized c join turns t on t.conv_id = c.base and t.pos <= lead
  union all select c.conv_id, t.pos - h + lead, role, text from sized c join turns t on t.conv_id = c.conv_id and t.pos > h),
members as (select conv_id, 0 as depth, '' as key, 0 as bytes from own
  union all select conv_id, pos, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') over (partition by conv_id order by pos rows between unbounded preceding and current row), strlen(text) from rebuilt),
nodes as (select depth, key, min(conv_id) as conv_id, count(*) as n_convs, max(bytes) as bytes from members group by depth, key),
born as (select n.*, m.key as parent from nodes n left join members m on m.conv_id = n.conv_id and m.depth = n.depth - 1),
kids as (select depth - 1 as depth, parent as key, count(*) as n_children from born where depth > 0 group by all),
family as (select b.*, coalesce(n_children, 0) as n_children, (b.n_convs - 1) * b.bytes as own, p.conv_id as parent_conv_id
  from born b left join kids k on k.depth = b.depth and k.key = b.key left join nodes p on p.depth = b.depth - 1 and p.key = b.parent),
below as (select m.depth, m.key, sum(own) as saved, count(*) filter (n_children = 0) as leaves from family u join members m on m.conv_id = u.conv_id and m.depth <= u.depth group by all),
ends as (select depth, key, string_agg(cast(conv_id as varchar), ',' order by conv_id) as ids from (select conv_id, max(depth) as depth from members group by conv_id) join members using (conv_id, depth) group by all)
select conv_id, cast(f.depth as bigint) as depth, parent_conv_id, cast(n_convs as bigint) as n_convs, cast(n_children as bigint) as n_children, cast(leaves as bigint) as n_leaves,
  cast(saved as bigint) as saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
from family f join below b on b.depth = f.depth and b.key = f.key left join ends e on e.depth = f.depth and e.key = f.key
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hamming_topk": op1_hamming_topk,
    "op2_quality_cnn": op2_quality_cnn,
    "op3_license_scan": op3_license_scan,
    "op4_wavelet_tokens": op4_wavelet_tokens,
    "op5_media_store": op5_media_store,
    "op6_ngram_join": op6_ngram_join,
    "op7_warc_derivatives": op7_warc_derivatives,
    "op8_mixing": op8_mixing,
    "op9_piece_transducer": op9_piece_transducer,
    "op10_tool_calls": op10_tool_calls,
    "op11_benchmark_join": op11_benchmark_join,
    "op12_whitening": op12_whitening,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLES: dict[str, str] = {
    "op1_hamming_topk": OP1_SQL,
    "op8_mixing": OP8_SQL,
    "op10_tool_calls": OP10_SQL,
    "op11_benchmark_join": OP11_SQL,
    "op13_prefix_trie": OP13_SQL,
}
