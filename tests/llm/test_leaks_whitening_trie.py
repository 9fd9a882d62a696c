import hashlib
import math
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm import benchmark_join as B
from tallyloom.llm import prefix_trie, queries, whitening

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})


def words(text):
    return _WORD.findall((text or "").translate(_LOWER))


def brute_leaks(docs, items, width=10):
    found = {}
    for item, text in items:
        w = words(text)
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            found.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, spans, ids = words(text), set(), set()
        for n in {len(x) for x in found}:
            for k in range(len(w) - n + 1):
                if own := found.get(tuple(w[k : k + n])):
                    spans.add((k, k + n))
                    ids |= {str(i) for i in own if i is not None}
        out.append((doc, len(w), len({k for a, b in spans for k in range(a, b)}), sorted(spans), sorted(ids)))
    return sorted(out, key=repr)


def leaks(spark, docs, items, **more):
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = B.leaks(d, i, **more).collect()
    return sorted(((r.doc_id, r.n_words, r.n_hit, [tuple(s) for s in r.spans], r.item_ids) for r in rows), key=repr)


def random_texts(seed):
    rng = random.Random(seed)
    some = lambda n: [rng.choice(["a", "b", "c", "Ünd", "D9", "é"]) for _ in range(n)]
    items = [(k % 7, " ".join(some(rng.choice([1, 3, 4, 7, 9, 10, 12, 15])))) for k in range(12)]
    docs = [(k, ", ".join(some(rng.randint(0, 60)))) for k in range(40)]
    docs += [(50 + k, " x - ".join([" ".join(some(4)), items[k % 12][1].upper(), " ".join(some(4))])) for k in range(20)]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_leaks_match_brute_force(spark, seed):
    docs, items = random_texts(seed)
    assert leaks(spark, docs, items) == brute_leaks(docs, items)


def test_leaks_of_common_passages_many_items_and_short_windows(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    items = [(k, f"{text} item {k} ends here with words of its own") for k in range(30)] + [(None, "no id at all has this benchmark item of ten words"), (99, "solo"), (3, "a second text of item three that has a few more words"), (98, None), (97, ""), (97, " - ")]
    docs = [(k, f"start {text} end {k}") for k in range(40)] + [(50, "Solo solo"), (51, "no id at all has this benchmark item of ten words"), (52, "a second text of item three that has a few more"), (52, None), (None, text * 3), (53, "")]
    got = leaks(spark, docs, items)
    assert got == brute_leaks(docs, items)
    assert next(r for r in got if r[0] == 51)[2:] == (11, [(0, 10), (1, 11)], [])


def test_leaks_by_shuffled_and_salted_joins_are_the_same(spark, monkeypatch):
    docs, items = random_texts(3)
    monkeypatch.setattr(B, "BROADCAST_BYTES", -1)
    assert leaks(spark, docs, items) == brute_leaks(docs, items)


def test_leaks_of_odd_documents(spark, edge_docs, empty_docs):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa", "x"), (2, "wörd one two", "y")], "item_id long, text string, doc_id string")
    rows = B.leaks(edge_docs, items).collect()
    want = brute_leaks([(r.doc_id, r.text) for r in edge_docs.collect()], [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, "wörd one two")])
    assert sorted(((r.doc_id, r.n_words, r.n_hit, [tuple(s) for s in r.spans], r.item_ids) for r in rows), key=repr) == want
    assert B.leaks(empty_docs, items).count() == 0
    none = B.leaks(edge_docs, items.limit(0)).collect()
    assert len(none) == edge_docs.count() and all(r.n_hit == 0 and r.item_ids == [] for r in none)


def test_words_of_blocks_equal_words_of_the_whole(monkeypatch):
    text = ("Wörter 12 und, " * 50 + "x" * 300 + " é-é " * 20).encode()
    low = B._LOWER[np.frombuffer(text, np.uint8)]
    whole = B.words(low)
    B._powers.cache_clear()
    monkeypatch.setattr(B, "BLOCK", 64)
    cut = B.words(low)
    B._powers.cache_clear()
    assert all((a == b).all() for a, b in zip(whole, cut))
    assert [low[a:b].tobytes().decode() for a, b in zip(*whole[:2])] == words(text.decode())


def brute_whitened(vectors):
    x = [[math.floor(1024 * c) + 100000 for c in v] for v in vectors]
    n, totals = len(x), [sum(c) for c in zip(*x)]
    z = np.array([[n * a - s for a, s in zip(r, totals)] for r in x], dtype=object)
    cov = np.array([[float(Fraction(int(v), n**3)) for v in r] for r in z.T.dot(z)])
    e, u = np.linalg.eigh(cov)
    return n, [int((r * r).sum()) for r in z], e[::-1], np.array(z / n, float) @ u[:, ::-1], np.trace(cov)


def check_whitened(rows, kept, components=8):
    n, deviations, e, projected, trace = brute_whitened([v for _, v in kept])
    k = min(components, len(e))
    by = {(r.vec_id, r.component): r for r in rows}
    assert len(by) == len(rows) == n * k
    signs = None
    for row, (vec, _) in enumerate(kept):
        got = [by[vec, c + 1] for c in range(k)]
        want = projected[row, :k] / np.sqrt(e[:k])
        signs = np.sign([g.whitened * w for g, w in zip(got, want)]) if signs is None else signs
        assert np.allclose([g.whitened for g in got], signs * want, rtol=1e-9, atol=1e-9)
        assert {int(g.deviation) for g in got} == {deviations[row]} and {g.n for g in got} == {n}
        assert np.allclose([g.explained for g in got], e[:k] / trace, rtol=1e-9)
        assert all(g.identity_error < 1e-6 for g in got)


def test_whitened_query_matches_brute_force(spark, sf_dir):
    kept = [(r.vec_id, [float(c) for c in r.embedding]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check_whitened(queries.op12_whitening(spark, sf_dir).collect(), kept)


SCHEMA = "vec_id long, embedding array<float>, component string"


def test_whitening_drops_what_is_no_vector(spark):
    rng = random.Random(4)
    kept = [(k, [rng.randint(-900, 900) / 256 for _ in range(3)]) for k in range(30)]
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [float("inf"), 0.0, 1.0]), (104, []), (105, [1.0, 2.0]), (106, [1e30, 0.0, 1.0])]
    rows = whitening.whiten(spark.createDataFrame([(i, v, "c") for i, v in kept + odd], SCHEMA)).collect()
    check_whitened(rows, kept)


def test_whitening_of_very_large_and_spread_entries_is_exact(spark):
    rng = random.Random(5)
    kept = [(k, [float(rng.randint(-(2**40), 2**40)), rng.randint(-999, 999) / 512]) for k in range(25)]
    rows = whitening.whiten(spark.createDataFrame(kept, "vec_id long, embedding array<double>")).collect()
    _, deviations, *_ = brute_whitened([v for _, v in kept])
    assert {r.vec_id: int(r.deviation) for r in rows} == dict(zip(range(25), deviations))


def test_whitening_without_variance_ids_or_rows(spark):
    frame = lambda rows: whitening.whiten(spark.createDataFrame(rows, SCHEMA))
    assert frame([]).count() == 0
    assert frame([(1, [1.0, 2.0], "")]).count() == 0
    assert frame([(1, [1.0, 2.0], ""), (2, [1.0, 2.0], "")]).count() == 0
    rows = frame([(None, [1.0, 2.0], ""), (None, [1.0, 2.0], ""), (3, [2.0, 2.0], "")]).collect()
    assert [r.component for r in rows] == [1, 1, 1] and all(r.explained == 1.0 and r.identity_error < 1e-9 for r in rows)


def brute_trie(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(t[2], t[4]) for t in sorted(ts, key=lambda t: t[:4])] for c, ts in own.items()}
    members = {}
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))
        full[c] = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(full[c]) + 1):
            members.setdefault(full[c][:d], []).append(c)
    kids = {}
    for path in members:
        if path:
            kids.setdefault(path[:-1], []).append(path)
    below = {}
    for path in sorted(members, key=len, reverse=True):
        saved = (len(members[path]) - 1) * len(path[-1][1].encode()) if path else 0
        below[path] = (saved + sum(below[k][0] for k in kids.get(path, ())), sum(below[k][1] for k in kids.get(path, ())) or 1)
    out = set()
    for path, convs in members.items():
        ends = ",".join(map(str, sorted(c for c in convs if full[c] == path)))
        parent = min(members[path[:-1]]) if path else None
        out.add((min(convs), len(path), parent, len(convs), len(kids.get(path, ())), below[path][1], below[path][0], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def trie(spark, rows, schema="conv_id long, turn long, role string, text string"):
    found = prefix_trie.trie(spark.createDataFrame(rows, schema)).collect()
    out = {(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in found}
    assert len(out) == len(found)
    return out


def conversations(seed, most):
    rng = random.Random(seed)
    rows = []
    for conv in rng.sample(range(-20, 120), 60):
        for turn in range(rng.randint(1, most)):
            rows.append((conv, turn, rng.choice(["user", "assistant"]) if turn > 1 else "user", rng.choice(["yes", "nö", ""]) if rng.random() < 0.3 else "same"))
    return rows


@pytest.mark.parametrize("most", [5, 30])
def test_trie_matches_brute_force(spark, most):
    rows = conversations(most, most)
    assert trie(spark, rows) == brute_trie(rows)


def test_trie_of_nulls_ties_and_repeats(spark):
    rows = [(None, 0, "user", "x"), (1, None, None, "b"), (1, 0, "user", None), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, "", "b"), (2, 1, "user", ""), (7, 0, None, None), (5, 0, "user", "x" * 70000), (6, 3, "user", "x" * 70000)]
    rows += [(c, k, "user", "all the same") for c in range(40, 60) for k in range(16)]
    assert trie(spark, rows) == brute_trie(rows)
    named = [(*r, 1, "t") for r in rows]
    assert trie(spark, named, "conv_id long, turn long, role string, text string, depth int, name string") == brute_trie(rows)
    assert trie(spark, []) == set()


def test_trie_in_small_chunks_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 2)
    monkeypatch.setattr(prefix_trie, "PIECE", 2)
    rows = conversations(9, 40) + [(c, k, "user", "copy") for c in range(200, 230) for k in range(20)]
    assert trie(spark, rows) == brute_trie(rows)


def test_a_long_conversation_is_numbered_over_several_ranges(spark):
    rows = [(5, k, "user", f"t{k}") for k in range(4000)] + [(6, 0, "user", "t0")]
    found = prefix_trie.numbered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3))
    got = found.filter("conv_id = 5").orderBy("pos").select("pos", "id").collect()
    assert [r.pos for r in got] == list(range(1, 4001)) and len({r.id for r in got}) == 4000
    order = found.filter("conv_id = 5").join(spark.range(4000).select(F.sha2(F.concat_ws(":", F.lit(4), F.lit("user"), F.sha2(F.concat(F.lit("t"), "id"), 256)), 256).alias("id"), F.col("id").alias("k")), "id").filter("pos <> k + 1")
    assert order.count() == 0
