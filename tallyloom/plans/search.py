"""Registered retrieval queries over documents, benchmark passages and embeddings, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.functions import text as T
from tallyloom.operators import reporting as R
from tallyloom.operators import search as S
from tallyloom.plans.registry import query
from tallyloom.sources.sinks import stored
from tallyloom.sources.tables import table

c = F.col

_TOKENS = "list_filter(list_transform(regexp_extract_all(lower({x}), '([a-z0-9][a-z0-9.,%$/-]*)', 1), lambda t: regexp_replace(t, '[.,/-]+$', '')), lambda t: t <> '')"


def chunks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks, with made-up facts: tables by source, years by number."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(c("doc_id").alias("chunk_id"), c("text").alias("body"), "lang", F.when(c("source") == "src1", "table").otherwise("text").alias("kind"), (F.lit(2020) + c("doc_id") % 5).cast("int").alias("fiscal_year"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(c("item_id").alias("query_id"), "text")


BM25_SQL = f"""
docs as (select doc_id as chunk_id, lang, case when source = 'src1' then 'table' else 'text' end as kind, 2020 + doc_id % 5 as fiscal_year, text as body, {_TOKENS.format(x="coalesce(text, '')")} as t from documents),
asked as (select item_id as query_id, unnest(list_distinct({_TOKENS.format(x='text')})) as token from benchmark),
stats as (select count(*) as n, avg(len(t)) as mean from docs),
post as (select chunk_id, token, count(*) as tf, any_value(length) as length from (select chunk_id, len(t) as length, unnest(t) as token from docs) group by chunk_id, token),
kept as (select * from post where token in (select token from asked)),
idf as (select token, greatest(ln((n - df + 0.5) / (df + 0.5)), 0.0) as idf, mean from (select token, count(*) as df from kept group by token), stats),
parts as (select chunk_id, token, idf * tf * 2.5::double / (tf + 1.5::double * (1 - 0.75::double + 0.75::double * length / mean)) as part from kept join idf using (token)),
bm as (select query_id, chunk_id, round(sum(part), 9) as score from asked join parts using (token) where part > 0 group by query_id, chunk_id),
bm_top as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from bm qualify rank <= 25)
"""


@query("q_token_stats", f"with docs as (select lang, {_TOKENS.format(x="coalesce(text, '')")} as t from documents), e as (select lang, unnest(t) as token from docs) select d.lang, d.n_docs, d.n_tokens, e.n_distinct from (select lang, count(*) as n_docs, cast(sum(len(t)) as bigint) as n_tokens from docs group by lang) d left join (select lang, count(distinct token) as n_distinct from e group by lang) e using (lang)")
def q_token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("lang", T.tokens(F.coalesce("text", F.lit(""))).alias("t"))
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(F.size("t")).alias("n_tokens"))
    words = rows.select("lang", F.explode("t").alias("token")).distinct().groupBy("lang").agg(F.count("*").alias("n_distinct"))
    return sizes.join(words, "lang", "left")


@query("q_doc_freq", f"with docs as (select doc_id, {_TOKENS.format(x="coalesce(text, '')")} as t from documents) select token, count(distinct doc_id) as df, count(*) as cf from (select doc_id, unnest(t) as token from docs) group by token")
def q_doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.postings(chunks_of(spark, sf_dir))
    return rows.groupBy("token").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def bm25_list(spark: SparkSession, sf_dir: str, postings: DataFrame | None = None) -> DataFrame:
    scores = S.bm25(questions(spark, sf_dir), chunks_of(spark, sf_dir), postings=postings).withColumn("score", F.round("score", 9))
    return S.top(scores, 25)


@query("q_bm25", "with " + BM25_SQL + " select query_id, chunk_id, round(score, 6) as score, rank from bm_top")
def q_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_list(spark, sf_dir).select("query_id", "chunk_id", F.round("score", 6).alias("score"), c("rank").cast("long").alias("rank"))


@query("q_dense", """with q as (select vec_id as query_id, embedding as e from embeddings where vec_id % 20 = 0),
 p as (select query_id, vec_id as chunk_id, list_cosine_similarity(e::double[], embedding::double[]) as s from q, embeddings),
 r as (select *, row_number() over (partition by query_id order by round(s, 12) desc, chunk_id) as rank from p) select query_id, chunk_id, round(s, 5) as score, rank from r where rank <= 10""")
def q_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(c("vec_id").alias("chunk_id"), "embedding")
    asked = vectors.filter(c("chunk_id") % 20 == 0).withColumnRenamed("chunk_id", "query_id")
    return S.dense(asked, vectors, 10).select("query_id", "chunk_id", F.round("score", 5).alias("score"), c("rank").cast("long").alias("rank"))


_FUSED_SQL = BM25_SQL + """,
long_ as (select query_id, chunk_id, round(sum(part), 9) as score from asked join parts using (token) where part > 0 and length(token) >= 6 group by query_id, chunk_id),
long_top as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from long_ qualify rank <= 25),
fused as (select query_id, chunk_id, sum(w / (60 + rank)) as s from (select query_id, chunk_id, 1.0::double as w, rank from bm_top union all select query_id, chunk_id, 0.5::double, rank from long_top) group by all),
boosted as (select query_id, chunk_id, lang, round(s * case when kind = 'table' then 1.25::double else 1 end * case fiscal_year when 2024 then 1.35::double when 2023 then 1.10::double else 1 end, 12) as score from fused join docs using (chunk_id)),
soft as (select * from (select *, count(*) filter (lang = 'en') over (partition by query_id) as n from boosted) where n < 5 or lang = 'en'),
final as (select *, row_number() over (partition by query_id order by score desc, chunk_id) as rank from soft qualify rank <= 8)
"""


def retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lexical lists fused, boosted, softly filtered to English, and cut to the best eight."""
    asked, chunks = questions(spark, sf_dir), chunks_of(spark, sf_dir)
    long_words = asked.select("query_id", F.concat_ws(" ", F.filter(T.tokens(c("text")), lambda t: F.length(t) >= 6)).alias("text"))
    postings = S.asked_postings(asked, chunks)  # the long words are among them
    other = S.top(S.bm25(long_words, chunks, postings=postings).withColumn("score", F.round("score", 9)), 25)
    lists = bm25_list(spark, sf_dir, postings).withColumn("weight", F.lit(1.0)).unionByName(other.withColumn("weight", F.lit(0.5)))
    fused = S.fuse(lists).join(chunks.drop("body"), "chunk_id")
    boosted = S.boost(fused, F.lit(True), F.array().cast("array<int>"), F.lit(2024)).withColumn("score", F.round("score", 12))
    return S.top(S.soft_filter(boosted, S.metadata_filter() & (c("lang") == "en")), 8)


@query("q_retrieve", "with " + _FUSED_SQL + " select query_id, chunk_id, round(score, 8) as score, rank from final")
def q_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieved(spark, sf_dir).select("query_id", "chunk_id", F.round("score", 8).alias("score"), c("rank").cast("long").alias("rank"))


@query("q_eval", "with " + _FUSED_SQL + """, m as (select b.item_id, f.rank, d.body is not null and contains(replace(lower(d.body), ',', ''), replace(lower(b.text), ',', '')) as hit from benchmark b left join final f on f.query_id = b.item_id left join docs d using (chunk_id)),
 g as (select item_id, min(rank) filter (hit) as first from m group by item_id) select count(*) as questions, round(avg(case when first is not null then 1 else 0 end), 6) as hit_rate, round(sum(coalesce(1.0 / first, 0)) / count(*), 6) as mrr from g""")
def q_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rate and MRR of the passages found for each benchmark text; a hit holds the text itself."""
    asked = questions(spark, sf_dir).withColumnRenamed("text", "wanted")
    plain = lambda x: F.replace(F.lower(x), F.lit(","), F.lit(""))
    rows = asked.join(retrieved(spark, sf_dir), "query_id", "left").join(chunks_of(spark, sf_dir).select("chunk_id", "body"), "chunk_id", "left")
    return S.hit_and_mrr(rows.withColumn("hit", F.coalesce(plain(c("body")).contains(plain(c("wanted"))), F.lit(False)))).select("questions", F.round("hit_rate", 6).alias("hit_rate"), F.round("mrr", 6).alias("mrr"))


# Configurations of retrieval, each with one more stage: lists, then filter and boosts, then outside scores.
LISTS = {1: ["dense"], 2: ["dense", "sparse"], 3: ["dense", "sparse", "variant"], 4: ["dense", "sparse", "variant"], 5: ["dense", "sparse", "variant"]}
NAMES = {1: "dense only", 2: "+ sparse", 3: "+ query expansion", 4: "+ metadata filters", 5: "+ reranking"}
FILTERED, RERANKED, SHORTLIST = 4, 5, 20

_STAGES_SQL = _FUSED_SQL + """,
dense_ as (select b.item_id as query_id, v.vec_id as chunk_id, round(list_cosine_similarity(e.embedding::double[], v.embedding::double[]), 12) as s from benchmark b join embeddings e on e.vec_id = b.item_id join embeddings v on v.vec_id in (select doc_id from documents)),
dense_top as (select *, row_number() over (partition by query_id order by s desc, chunk_id) as rank from dense_ qualify rank <= 25),
lists as (select 'dense' as l, 1.0::double as w, query_id, chunk_id, rank from dense_top union all select 'sparse', 1.0::double, query_id, chunk_id, rank from bm_top union all select 'variant', 0.5::double, query_id, chunk_id, rank from long_top),
conf as (select unnest([1, 2, 2, 3, 3, 3, 4, 4, 4, 5, 5, 5]) as k, unnest(['dense', 'dense', 'sparse', 'dense', 'sparse', 'variant', 'dense', 'sparse', 'variant', 'dense', 'sparse', 'variant']) as l),
all_fused as (select k, query_id, chunk_id, sum(w / (60 + rank)) as s from conf join lists using (l) group by all),
all_boosted as (select k, query_id, chunk_id, lang, round(case when k < 4 then s else s * case when kind = 'table' then 1.25::double else 1 end * case fiscal_year when 2024 then 1.35::double when 2023 then 1.10::double else 1 end end, 12) as score from all_fused join docs using (chunk_id)),
all_soft as (select * from (select *, count(*) filter (k < 4 or lang = 'en') over (partition by k, query_id) as n from all_boosted) where n < 5 or k < 4 or lang = 'en'),
short as (select *, row_number() over (partition by k, query_id order by score desc, chunk_id) as rank from all_soft qualify rank <= 20),
outside as (select *, case when k = 5 and chunk_id % 3 <> 0 then 1.0 + chunk_id % 9 end as o from short),
scored as (select *, case when max(o is not null) over (partition by k, query_id) then coalesce(o, 2.0) else 0 end as rr from outside),
placed as (select *, row_number() over (partition by k, query_id order by rr desc, rank) as place from scored qualify place <= 8)
"""


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of every question under every configuration: query_id (a struct of configuration and question), chunk_id, score, place.

    Each list is made once.  Vectors of one number stand for a question and a chunk; an outside model's scores are made up of numbers.
    """
    asked, chunks = questions(spark, sf_dir), chunks_of(spark, sf_dir)
    vectors = lambda key, ids: table(spark, sf_dir, "embeddings").select(c("vec_id").alias(key), c("embedding").alias("embedding")).join(ids.select(key), key, "left_semi")
    near = S.dense(vectors("query_id", asked), vectors("chunk_id", chunks), 25)
    long_words = asked.select("query_id", F.concat_ws(" ", F.filter(T.tokens(c("text")), lambda t: F.length(t) >= 6)).alias("text"))
    both = S.lexical(_numbered(asked, 0).unionByName(_numbered(long_words, 1)), chunks, 25)
    sparse, other = (both.filter(F.pmod("query_id", F.lit(2)) == seq).withColumn("query_id", F.shiftright("query_id", 1)) for seq in (0, 1))
    parts = [x.select(F.lit(n).alias("list"), F.lit(w).alias("weight"), "query_id", "chunk_id", "rank") for n, w, x in (("dense", 1.0, near), ("sparse", 1.0, sparse), ("variant", 0.5, other))]
    used = F.create_map(*[x for n in ("dense", "sparse", "variant") for x in (F.lit(n), F.array(*(F.lit(k) for k, names in LISTS.items() if n in names)))])
    lists = stored(parts[0].unionByName(parts[1]).unionByName(parts[2]), "lists").withColumn("k", F.explode(used[c("list")]))
    fused = S.fuse(lists.withColumn("query_id", F.struct("k", "query_id"))).join(chunks.drop("body"), "chunk_id")
    late = c("query_id.k") >= FILTERED
    boosted = S.boost(fused, F.lit(True), F.array().cast("array<int>"), F.lit(2024)).withColumnRenamed("score", "boosted")
    rows = fused.select("query_id", "chunk_id", "score").join(boosted, ["query_id", "chunk_id"]).withColumn("score", F.round(F.when(late, c("boosted")).otherwise(c("score")), 12)).drop("boosted")
    short = S.top(S.soft_filter(rows, ~late | (c("lang") == "en")), SHORTLIST)
    outside = short.filter((c("query_id.k") == RERANKED) & (c("chunk_id") % 3 != 0)).select("query_id", "chunk_id", (c("chunk_id") % 9 + 1.0).alias("score"))
    return S.rerank(short, outside)


def _numbered(queries: DataFrame, seq: int) -> DataFrame:
    return queries.select((c("query_id") * 2 + seq).alias("query_id"), "text")


@query("q_retrieve_full", "with " + _STAGES_SQL + " select query_id, chunk_id, cast(place as int) as place, round(score, 8) as score from placed where k = 5")
def q_retrieve_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = staged(spark, sf_dir).filter(c("query_id.k") == RERANKED)
    return rows.select(c("query_id.query_id").alias("query_id"), "chunk_id", "place", F.round("score", 8).alias("score"))


@query("q_ablations", "with " + _STAGES_SQL + """, conf_ as (select unnest([1, 2, 3, 4, 5]) as k, unnest(['dense only', '+ sparse', '+ query expansion', '+ metadata filters', '+ reranking']) as configuration),
 m as (select configuration, b.item_id, p.place, d.body is not null and contains(replace(lower(d.body), ',', ''), replace(lower(b.text), ',', '')) as hit from conf_ join benchmark b on true left join placed p on p.query_id = b.item_id and p.k = conf_.k left join docs d using (chunk_id)),
 g as (select configuration, item_id, min(place) filter (hit) as first from m group by all) select configuration, count(*) as questions, round(avg(case when first is not null then 1 else 0 end), 6) as hit_rate, round(sum(coalesce(1.0 / first, 0)) / count(*), 6) as mrr from g group by configuration""")
def q_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hit rate and MRR of each configuration, which shows what each stage adds."""
    names = F.create_map(*[x for k, n in NAMES.items() for x in (F.lit(k), F.lit(n))])
    asked = questions(spark, sf_dir).withColumnRenamed("text", "wanted").withColumn("k", F.explode(F.array(*map(F.lit, NAMES))))
    found = stored(staged(spark, sf_dir).select(c("query_id.k").alias("k"), c("query_id.query_id").alias("query_id"), "chunk_id", c("place").alias("rank")), "found")
    plain = lambda x: F.replace(F.lower(x), F.lit(","), F.lit(""))
    # The few passages are stored, so that their ids go to the texts and no text that wasn't found is shuffled.
    bodies = chunks_of(spark, sf_dir).select("chunk_id", "body").join(F.broadcast(found.select("chunk_id").distinct()), "chunk_id", "left_semi")
    rows = asked.join(found, ["k", "query_id"], "left").join(bodies, "chunk_id", "left")
    rows = rows.withColumn("configuration", names[c("k")]).withColumn("hit", F.coalesce(plain(c("body")).contains(plain(c("wanted"))), F.lit(False)))
    return S.hit_and_mrr(rows, "configuration").select("configuration", "questions", F.round("hit_rate", 6).alias("hit_rate"), F.round("mrr", 6).alias("mrr"))


@query("q_eval_lines", "with " + _STAGES_SQL + """, conf_ as (select unnest([1, 2, 3, 4, 5]) as k, unnest(['dense only', '+ sparse', '+ query expansion', '+ metadata filters', '+ reranking']) as configuration),
 m as (select configuration, b.item_id, p.place, d.body is not null and contains(replace(lower(d.body), ',', ''), replace(lower(b.text), ',', '')) as hit from conf_ join benchmark b on true left join placed p on p.query_id = b.item_id and p.k = conf_.k left join docs d using (chunk_id)),
 g as (select configuration, item_id, min(place) filter (hit) as first from m group by all)
 select '| ' || configuration || ' | ' || printf('%.0f', round_even(avg(case when first is not null then 1 else 0 end), 6) * 100) || '% | ' || printf('%.3f', round(sum(coalesce(1.0 / first, 0)) / count(*), 6)) || ' |' as line from g group by configuration""")
def q_eval_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The configurations' measures as rows of a table."""
    return R.eval_line(q_ablations(spark, sf_dir))


_LINES_SQL = "lines as (select doc_id, i - 1 as chunk_index, l[i] as body from (select doc_id, string_split(text, chr(10)) as l, unnest(range(1, len(string_split(text, chr(10))) + 1)) as i from documents))"


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "body"))


@query("q_neighbours", "with " + _LINES_SQL + " select doc_id, chunk_index, sha256(concat_ws(chr(10), lag(body) over w, body, lead(body) over w)) as context from lines window w as (partition by doc_id order by chunk_index)")
def q_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.neighbours(document_lines(spark, sf_dir)).select("doc_id", c("chunk_index").cast("long").alias("chunk_index"), F.sha2("context", 256).alias("context"))


@query("q_query_plan", """with q as (select conv_id * 100 + turn as query_id, text || ' in ' || (2018 + turn) || case when turn % 2 = 0 then ' and last year' else ' latest quarter revenue' end as text from conversations where role = 'user')
 select query_id, array_to_string(list_sort(list_distinct(list_concat(list_filter([cast(regexp_extract(text, ' in (\\d{4})', 1) as int)], lambda y: y in (2018, 2019, 2020, 2021)), case when text like '%latest%' then [2021] when text like '%last year%' then [2020, 2021] else [] end))), ',') as years,
 case when text like '%quarter%' then 'quarterly_report' else '' end as doc_types, text like '% revenue%' as prefer_tables from q""")
def q_query_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions made of chat turns with a year and a hint at their end."""
    turns = table(spark, sf_dir, "conversations").filter("role = 'user'")
    tail = F.when(c("turn") % 2 == 0, " and last year").otherwise(" latest quarter revenue")
    asked = turns.select((c("conv_id") * 100 + c("turn")).alias("query_id"), F.concat("text", F.lit(" in "), (c("turn") + 2018).cast("string"), tail).alias("text"))
    plans = S.plan_queries(asked, [2018, 2019, 2020, 2021])
    return plans.withColumns({"years": F.concat_ws(",", c("years").cast("array<string>")), "doc_types": F.concat_ws(",", "doc_types")})
