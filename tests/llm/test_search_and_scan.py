import random
import time

import numpy as np
import regex

from tallyloom.llm import hamming_topk as H
from tallyloom.llm import license_scan as L
from tallyloom.llm import queries


def test_top_k_matches_sql(spark, sf_dir, duck):
    got = sorted(tuple(r) for r in queries.op1_hamming_topk(spark, sf_dir).select("query_id", "rank", "vec_id", "distance").collect())
    cur = duck.execute(queries.OP1_SQL)
    names = [d[0] for d in cur.description]
    want = sorted(tuple(r[names.index(n)] for n in ("query_id", "rank", "vec_id", "distance")) for r in cur.fetchall())
    assert got == want


def test_cell_matches_brute_force():
    rng = np.random.default_rng(1)
    for bits, low in ((8, 8), (20, 5), (64, 11)):
        ids = rng.integers(0, 200, 300)
        words = rng.integers(0, 1 << bits, (300, 1), dtype=np.uint64)
        values = rng.integers(0, 1 << low, 300)
        cell = H.Cell(ids, values, words, low)
        own, asked, at = rng.integers(0, 200, 40), words[:40], values[:40]
        limit = np.full(40, 1 << 30)
        for radius in (-1, 0, 1, 3, low):
            want = []
            for q in range(40):
                best = {}
                for i, v, w in zip(ids.tolist(), values.tolist(), words[:, 0].tolist()):
                    if i != own[q] and (radius < 0 or (v ^ int(at[q])).bit_count() == radius):
                        best[i] = min(best.get(i, 99), (w ^ int(asked[q, 0])).bit_count())
                want += [(q, i, d) for d, i in sorted((d, i) for i, d in best.items())[:7]]
            assert list(zip(*(x.tolist() for x in cell.search(own, at, asked, limit, radius, 7)))) == want


def test_top_k_matches_brute_force_where_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(H, "CELL_ROWS", 16)
    monkeypatch.setattr(H, "CELL_QUERIES", 3)
    rng = np.random.default_rng(4)
    base = rng.choice([-1.0, 1.0], 40)
    rows = []
    for i in range(300):  # a third lies around one vector, and some lengths are rare
        v = base * np.where(rng.random(40) < 0.04, -1, 1) if i % 3 == 0 else rng.choice([-1.0, 1.0], 40 if i % 7 else 13)
        rows.append((i, v.tolist()))
    rows += [(1000 + i, [1.0, -1.0]) for i in range(0, 60, 20)]
    want = set()
    for q, x in rows:
        if q % 20 == 0:
            near = sorted((sum(a != b for a, b in zip(x, y)), v) for v, y in rows if v != q and len(x) == len(y))[:5]
            want |= {(q, r, v, d) for r, (d, v) in enumerate(near, 1)}
    got = H.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=5).collect()
    assert {(r.query_id, r.rank, r.vec_id, r.distance) for r in got} == want


def test_top_k_edges(spark):
    v = [1.0, -1.0, 1.0, 1.0]
    rows = [(0, v, 1), (20, v, 2), (1, v, 3), (1, v, 3), (2, None, 4), (3, [], 5), (None, v, 6), (4, [1.0, None, 1.0, 1.0], 7), (5, [1.0], 8), (6, [float("nan"), 1.0, -1.0, 1.0], 9)]
    got = H.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>, distance int"), k=2).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.distance) for r in got) == [(0, 1, 1, 0), (0, 2, 20, 0), (20, 1, 0, 0), (20, 2, 1, 0)]
    assert H.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_common_code_keeps_smallest_ids(spark):
    rows = [(i, [1.0] * 16) for i in range(100)]
    got = H.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=3)
    assert [r.vec_id for r in got.filter("query_id = 0").orderBy("rank").collect()] == [1, 2, 3]


def test_ids_with_several_codes_leave_room_for_others(spark):
    rng = np.random.default_rng(3)
    base = rng.choice([-1.0, 1.0], 24)
    rows = []
    for vec_id, copies, flips in ((0, 12, 1), (1, 30, 2), (2, 1, 8), (3, 5, 3), (4, 1, 10), (5, 1, 12), (20, 3, 4)):
        for _ in range(copies):
            v = base.copy()
            v[rng.choice(24, flips, replace=False)] *= -1
            rows.append((vec_id, v.tolist()))
    best = {}
    for q, x in rows:
        for v, y in rows:
            if q % 20 == 0 and q != v:
                best.setdefault(q, {}).setdefault(v, []).append(sum(a != b for a, b in zip(x, y)))
    want = {(q, r, v, d) for q, found in best.items() for r, (d, v) in enumerate(sorted((min(d), v) for v, d in found.items())[:4], 1)}
    got = H.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=4)
    assert {(r.query_id, r.rank, r.vec_id, r.distance) for r in got.collect()} == want


def brute_base(text):
    words = regex.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    at, labels = [], set()
    for phrase, label in L.BASE_PHRASES:
        p = phrase.split()
        for i in range(len(words)):
            if words[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_license_base_matches_brute_force(spark, sf_dir, small_texts):
    got = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in queries.op3_license_scan(spark, sf_dir).collect()}
    assert got == {d: brute_base(t) for d, t in small_texts}


def test_license_spans_match_whole_text_search():
    random.seed(4)
    for _ in range(40):
        label, notice, edits = random.choice(L.NOTICES)
        chars = list(notice)
        for _ in range(random.randint(0, edits)):
            at = random.randrange(len(chars))
            random.choice([lambda: chars.insert(at, "x"), lambda: chars.pop(at), lambda: chars.__setitem__(at, "q")])()
        text = f" lorem ipsum {''.join(chars)} dolor sit amet "
        whole = regex.search(rf"(?be)(?:{regex.escape(notice)}){{e<={edits}}}", text)
        assert whole
        found = [s for s in L.fuzzy_spans(text) if s[0] == label]
        assert found and min(s[3] for s in found) <= sum(whole.fuzzy_counts)
    assert L.fuzzy_spans(" nothing of that kind ") == []


def test_repeated_notices_give_a_span_each():
    gpl = " gnu genral public license gnu general public license gnu public licence "
    assert [(s[1], s[3]) for s in L.fuzzy_spans(gpl) if s[0] == "gpl"][:2] == [(1, 1), (27, 0)]
    mpl = " mozilla publc license mozilla public license mozila public license "
    assert [(s[0], s[3]) for s in L.fuzzy_spans(mpl)] == [("mpl", 1), ("mpl", 0), ("mpl", 1)]


def test_spans_leave_no_match_beside_them():
    random.seed(9)
    own = [n for n in L.NOTICES if n[0] in ("gpl", "mpl", "lgpl")]
    for _ in range(25):
        words = []
        for _ in range(random.randint(1, 7)):
            chars = list(random.choice(own)[1])
            for _ in range(random.randint(0, 3)):
                chars[random.randrange(len(chars))] = random.choice("qx ")
            words.append("".join(chars))
        text = f" {' '.join(words)} "
        spans = L.fuzzy_spans(text)
        for label, notice, edits in own:
            at = 0
            for start, end in [*sorted((s[1], s[2]) for s in spans if s[0] == label), (len(text), len(text))]:
                assert start >= at and least_edits(notice, text[at:start]) > edits
                at = end


def test_very_long_texts_take_linear_time():
    began = time.process_time()
    for text, n in (("mit license " * 40_000, 40_000), ("all rights reservd " * 4_000, 0), ("gnu general public " * 4_000, 0)):
        assert L.scan_text(text)[1] == n
    assert time.process_time() - began < 60


def least_edits(notice, text):
    """Of any part of the text."""
    row = list(range(len(notice) + 1))
    best = row[-1]
    for ch in text:
        last, row[0] = row[0], 0
        for i, x in enumerate(notice, 1):
            last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (x != ch))
        best = min(best, row[-1])
    return best


def test_license_weaker_notices_beside_an_exact_one():
    text = " gnu generel public license gnu general public license gnu genral public licence "
    assert [(s[3], s[4].strip()) for s in L.fuzzy_spans(text) if s[0] == "gpl"] == [(1, "gnu generel public license"), (0, "gnu general public license"), (2, "gnu genral public licence")]
    random.seed(9)
    for _ in range(60):
        label, notice, edits = one = random.choice(L.NOTICES)
        copies = []
        for _ in range(random.randint(2, 4)):
            chars = list(notice)
            for _ in range(random.choice([0, 1, edits])):
                chars[random.randrange(len(chars))] = "q"
            copies.append("".join(chars))
        text = f" a {' '.join(copies)} z "
        found = L.fuzzy_spans(text, (one,))
        edges = [0, *(x for s in found for x in s[1:3]), len(text)]
        assert found and all(x <= y for x, y in zip(edges, edges[1:]))
        assert all(least_edits(notice, text[x:y]) > edits for x, y in zip(edges[::2], edges[1::2]))


def test_license_edges(spark, edge_docs, empty_docs):
    rows = L.scan(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    null = [r for r in rows if r.doc_id == 3][0]
    assert (null.n_words, null.n_base, null.first_word, null.base_labels, null.labels, null.score, null.spans) == (0, 0, None, "", "", 0.0, [])
    assert L.scan(empty_docs).count() == 0
    x = L.scan_text("cc by CC-BY; under the Apache Licence. Apache license " + "w " * 50000 + "MIT license")
    assert x[1] == 4 and x[4] == "apache,cc-by,mit" and x[3] == 50000 + 10
