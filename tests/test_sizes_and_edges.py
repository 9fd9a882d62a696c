import math
import random
import re
from collections import Counter
from difflib import SequenceMatcher

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from pyspark.sql import functions as F

from tallyloom.functions.text import BARE, MAGNITUDES, find_tokens, located, tokens
from tallyloom.operators import ingest, retrieval, search
from tallyloom.plans import catalogue, registry, report  # noqa: F401
from tallyloom.plans import retrieval as plans  # noqa: F401
from tallyloom.plans import search as ablations  # noqa: F401

PARTS = [(0, 15, 900.0), (0, 1, 900.0), (7, 30, 900.7), (8, 24, 900.8), (-3, 45, 1.0), (None, 15, 2.0), (5, None, 3.0)]


def written(folder, name, columns, rows):
    pq.write_table(pa.table({n: pa.array(list(x), t) for (n, t), x in zip(columns, zip(*rows))}), folder / f"{name}.parquet")


def same_as_sql(spark, folder, name, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    cur = con.execute(registry.ORACLES[name])
    names = [d[0] for d in cur.description]
    got = [tuple(r[n] for n in names) for r in registry.QUERIES[name](spark, str(folder)).collect()]
    assert sorted(got, key=repr) == sorted(cur.fetchall(), key=repr)
    return got


def test_the_last_price_stands_even_at_zero(spark, tmp_path):
    written(tmp_path, "part", [("p_partkey", pa.int64()), ("p_size", pa.int32()), ("p_retailprice", pa.float64())], PARTS)
    assert (0, 0.0) in same_as_sql(spark, tmp_path, "q_snapshot_price", "part")


def test_references_without_a_semicolon_stand_as_they_are(spark, tmp_path):
    pages = ["<p>a&amp</p><p>b &amp b&amp;</p>", "<h1>R&am</h1>one &copy2 &copy; two", "<p>&ampfoo; &nothing; &", "<p>&&amp;&amp", "<p>&amp;copy; &middot &middot;", "<head><title>x&amp</title></head><p>&quot &quot;"]
    written(tmp_path, "pages", [("page_id", pa.int64()), ("html", pa.string())], list(enumerate(pages)))
    assert len(same_as_sql(spark, tmp_path, "q_html_blocks", "pages")) == 8


def scored(query, name, ticker, priority):
    a, b = (query or "").lower().strip(), (name or "").lower().strip()
    r = SequenceMatcher(None, a, b).ratio()
    r = max(r, 0.85) if a.split() and set(a.split()) <= set(b.split()) else r
    return priority + (200.0 if query is not None and query.upper() == ticker.split(".")[0].upper() else 0.0) + 150.0 * r


@pytest.mark.parametrize("block", [7, 4096])
def test_listed_namesakes_equal_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(ingest, "NAMES_BLOCK", block)
    rng = random.Random(5)
    words = ["Apple", "apple", "Inc", "plc", "Gröup", "ab", "ba", "#0012", "#0021", "T3.N", "x" * 210 + "yz", "", " "]
    name = lambda: rng.choice([None, " ".join(rng.choice(words) for _ in range(rng.randint(0, 4)))])
    listed = [(g, rng.choice([f"T{k}.N", "ab.L", "APPLE"]) + ("" if rng.random() < 0.8 else str(k)), name(), rng.choice(["EQUITY"] * 5 + ["ETF"]), rng.choice([0, 1, 90])) for g in (1, 2, None) for k in range(45)] + [(1, None, "Apple", "EQUITY", 900)]
    asked = [(g, q) for g in (1, 2, 3, None) for q in [None, "", "ab", "T3", "t7", "apple", "Apple Inc", "nothing like it", *(name() for _ in range(12))]]
    want = {}
    for g, q in asked:
        for h, ticker, n, kind, p in listed:
            if g == h and g is not None and kind == "EQUITY" and ticker is not None:
                want[q] = max(want.get(q, (-1.0, "")), (scored(q, n, ticker, p), ticker))
    got = ingest.match_listed(spark.createDataFrame(asked, "g int, query string"), spark.createDataFrame(listed, "g int, ticker string, name string, quote_type string, priority int"), "g").collect()
    assert {r["query"]: (r.score, r.ticker) for r in got} == want and len(got) == len(want)


def brute_bm25(asked, texts, k):
    """{(query, chunk): rank} by plain loops."""
    docs = {d: find_tokens((t or "").lower()) for d, t in texts}
    mean = sum(map(len, docs.values())) / len(docs)
    df = Counter(t for words in docs.values() for t in set(words))
    out = {}
    for q, text in asked:
        scores = {}
        for d, words in docs.items():
            tf = Counter(words)
            for t in set(find_tokens((text or "").lower())) & set(words):
                idf = max(math.log((len(docs) - df[t] + 0.5) / (df[t] + 0.5)), 0.0)
                scores[d] = scores.get(d, 0.0) + idf * tf[t] * 2.5 / (tf[t] + 1.5 * (1 - 0.75 + 0.75 * len(words) / mean))
        ranked = sorted((-round(x, 9), d) for d, x in scores.items() if x > 0)[:k]
        out |= {(q, d): r for r, (_, d) in enumerate(ranked, 1)}
    return out


@pytest.mark.parametrize("block", [3, 8192])
def test_lexical_lists_equal_brute_force_and_leave_the_tasks_cut(spark, monkeypatch, block):
    monkeypatch.setattr(search, "BLOCK", block)
    rng = random.Random(block)
    words = ["cash", "Margin.", "10-K", "5%", "a", "the", "Übung", "rev/", "q1", "debt,", "--", "x.y-"]
    text = lambda most: " ".join(rng.choice(words) for _ in range(rng.randint(0, most)))
    texts = [(k * 7 - 50, rng.choice([None, "", "same cash text", "debt q1", *(text(40) for _ in range(4))])) for k in range(700)]
    asked = [(k - 4, rng.choice([None, "", "unknown", text(8), text(3)])) for k in range(10)]
    chunks = spark.createDataFrame(texts, "chunk_id long, body string").repartition(3)
    queries = spark.createDataFrame(asked, "query_id long, text string")
    got = {(r.query_id, r.chunk_id): r["rank"] for r in search.lexical(queries, chunks, 6).collect()}
    assert got == brute_bm25(asked, texts, 6) and got
    everything = {(r.query_id, r.chunk_id) for r in search.bm25(queries, chunks).collect()}
    assert {x for x, _ in got} == {x for x, _ in everything}
    rows = search._lexical_block([(q, sorted(set(find_tokens((t or "").lower())))) for q, t in asked], chunks, 6, search.DEFAULTS)
    assert rows.count() <= rows.rdd.getNumPartitions() * 10 * 6 < len(everything)


def test_the_best_are_kept_over_many_parts():
    rng = random.Random(2)
    best, rows = search._Best(3, 4, 9), []
    best.most = 5
    for part in range(60):
        scores = [[rng.choice([0.0, 0.5, 1.0, 1.0 + 1e-12, rng.random()]) for _ in range(3)] for _ in range(4)]
        ids = [1000 - part * 4 - k for k in range(4)]
        best.add(search.np.array(scores), search.np.array(ids))
        rows += [(q, -round(x, 9), d) for line, d in zip(scores, ids) for q, x in enumerate(line) if x > 0]
    want = [x for q in range(3) for x in sorted(r for r in rows if r[0] == q)[:4]]
    assert [(int(q), -float(x), int(d)) for q, d, x in zip(*best.cut())] == want


@pytest.mark.parametrize("k", [3, 50])
def test_dense_lists_equal_brute_force_with_ties(spark, monkeypatch, k):
    monkeypatch.setattr(search, "BLOCK", 16)
    rng = random.Random(k)
    vectors = [(n, rng.choice([None, [0.0, 0.0], [1.0, 0.0], [float(rng.randint(-3, 3)), float(rng.randint(-3, 3))]])) for n in range(40)]
    asked = [(n, v) for n, v in vectors if n % 2]
    got = {}
    for r in search.dense(spark.createDataFrame(asked, "query_id long, embedding array<float>"), spark.createDataFrame(vectors, "chunk_id long, embedding array<float>"), k).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.chunk_id))
    unit = lambda v: [x / (math.hypot(*v) or 1) for x in v]
    for q, a in asked:
        want = sorted((-round(sum(x * y for x, y in zip(unit(a), unit(b))), 12), n) for n, b in vectors if b is not None)[:k] if a is not None else []
        assert [n for _, n in sorted(got.get(q, []))] == [n for _, n in want]


def test_tokens_in_tasks_are_those_of_the_expression(spark):
    rng = random.Random(4)
    texts = [(k, "a" + chr(k) + "1" + chr(k) + chr(k) + "Z") for k in range(1, 0x10000) if not 0xD800 <= k < 0xE000]
    texts += [(-k, "".join(rng.choice("aZ09.,%$/- \n\u00e9\u212a\u0130") for _ in range(30))) for k in range(1, 3000)]
    rows = spark.createDataFrame(texts, "k long, x string").select("k", tokens(F.col("x")).alias("t")).collect()
    by = dict(texts)
    assert not [r.k for r in rows if r.t != find_tokens(by[r.k].lower())]


def test_token_vectors_count_every_token_and_shared_ones_only_of_the_shortlist(spark):
    from hashlib import md5

    rng = random.Random(6)
    texts = [(k, rng.choice([None, "", "--", " ".join(rng.choice(["Cash", "10-K", "x.", "é", "m"]) + str(rng.randint(0, 30)) for _ in range(rng.randint(1, 60)))])) for k in range(1200)]
    chunks = spark.createDataFrame(texts, "chunk_id long, body string")
    want = {}
    for k, t in texts:
        for token in find_tokens((t or "").lower()):
            want.setdefault(k, [0.0] * 64)[int(md5(token.encode()).hexdigest()[:4], 16) % 64] += 1
    assert {r.chunk_id: r.embedding for r in retrieval.token_vectors(chunks, "chunk_id", "body").collect()} == want
    asked = spark.createDataFrame([(1, "cash3 cash3 m1 m2 10-k5"), (2, None), (3, "x7.")], "query_id long, text string")
    short = spark.createDataFrame([(q, k) for q in (1, 2, 3) for k in range(0, 1200, 50)], "query_id long, chunk_id long")
    words = {1: {"cash3", "m1", "m2", "10-k5"}, 2: set(), 3: {"x7"}}
    shared = {(q, k): n for q in words for k, t in texts if k % 50 == 0 and (n := len(words[q] & set(find_tokens((t or "").lower()))))}
    assert {(r.query_id, r.chunk_id): r.n for r in retrieval.shared_tokens(asked, chunks, short).collect()} == shared and shared


def test_only_texts_near_a_passage_are_read_for_contexts(spark):
    chunks = spark.createDataFrame([(k, k // 4, k % 4, f"words of {k}" if k % 3 else None) for k in range(40)], "chunk_id long, doc_id long, chunk_index long, body string")
    found = spark.createDataFrame([(1, 5, 1), (1, 6, 2), (2, 39, 1)], "query_id long, chunk_id long, place int")
    rows = retrieval.answer_contexts(found, chunks, 99)
    assert "LeftSemi" in rows._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.query_id, r.doc_id, r.first, r.last, r.context) for r in rows.collect()} == {(1, 1, 0, 3, "words of 4\nwords of 5\n\nwords of 7"), (2, 9, 2, 3, "words of 38\n")}


def test_planned_queries_make_no_postings_and_equal_their_sql(spark, tmp_path, monkeypatch):
    def never(*_):
        raise AssertionError("postings of all texts")

    monkeypatch.setattr(search, "postings", never)
    rng = random.Random(9)
    words = ["revenue", "cash", "margin", "debtors", "a-1", "growth", "x1", "assets"]
    text = lambda n: " ".join(rng.choice(words) + rng.choice(["", ".", str(rng.randint(0, 9))]) for _ in range(n))
    docs = [(k, rng.choice([None, "", "cash debtors7 x1", text(rng.randint(1, 30))]), rng.choice(["en", "de", "fr", "es"]), rng.choice(["src0", "src1"])) for k in range(300)]
    written(tmp_path, "documents", [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string())], docs)
    written(tmp_path, "benchmark", [("item_id", pa.int64()), ("text", pa.string())], [(k, text(6)) for k in range(10)])
    for name in ("q_filter_effect", "q_answer_context"):
        assert same_as_sql(spark, tmp_path, name, "documents", "benchmark")


_OLD = r"(?i)(us[$]|usd|[$]|₹|€|£)?\s?(\d[\d,]*(?:\.\d+)?)(?:\s?(?:(trillion|tn|t|billion|bn|b|million|mn|m|thousand|k)\b|(%)))?"


def test_figures_and_their_places_equal_a_plain_search(spark):
    rng = random.Random(8)
    parts = ["US$", "usd", "$", "€", "£", " ", "  ", "\n", "5", "12,5", "7.25", "7.", ",", "%", " %", "bn", "b", " million", "millions", "k", "T", "x", "–", "words of no figure ", "us", "u"]
    texts = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))) for k in range(3000)]
    got = {r.k: [(x.kind, x.figure, x.value, x.start, x.context) for x in r.x] for r in spark.createDataFrame(texts, "k int, t string").select("k", located(F.col("t"), 6).alias("x")).collect()}
    for k, t in texts:
        want = []
        for m in re.finditer(_OLD, t, re.ASCII):
            mark, digits, unit, sign = m.groups()
            kind = "percent" if sign else "money" if mark or (unit or "").lower() in BARE else None
            first, last = max(m.start() - 6, 0), min(m.end() + 6, len(t))
            context = ("…" if first else "") + t[first:last].strip(" ") + ("…" if last < len(t) else "")
            if kind:
                own = m[0].lstrip(" ")
                want.append((kind, m[0].strip(" "), float(digits.replace(",", "")) * MAGNITUDES.get((unit or "").lower(), 1.0), m.end() - len(own), context))
        assert got[k] == want, t


def test_a_sentence_is_made_once_for_all_its_figures(spark, sf_dir):
    plan = registry.QUERIES["q_figures"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("format_string") == 1


def test_the_lines_of_the_evaluation_need_no_postings(spark, tmp_path, monkeypatch):
    def never(*_):
        raise AssertionError("postings of all texts")

    monkeypatch.setattr(search, "asked_postings", never)
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(["revenue", "cash", "margin", "debtors", "a-1", "growth"]) + rng.choice(["", ".", str(rng.randint(0, 9))]) for _ in range(n))
    asked = [(k, text(5)) for k in range(8)]
    docs = [(k, rng.choice([None, "", asked[k % 8][1] + " cash", text(rng.randint(1, 30))]), rng.choice(["en", "de"]), rng.choice(["src0", "src1"])) for k in range(200)]
    written(tmp_path, "documents", [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string())], docs)
    written(tmp_path, "benchmark", [("item_id", pa.int64()), ("text", pa.string())], asked)
    written(tmp_path, "embeddings", [("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32()))], [(k, [rng.uniform(-1, 1) for _ in range(8)]) for k in range(220)])
    assert len(same_as_sql(spark, tmp_path, "q_eval_lines", "documents", "benchmark", "embeddings")) == 5
