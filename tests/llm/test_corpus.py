import hashlib
import json
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyloom.llm import components as CC
from tallyloom.llm import mixing, ngram_join, queries, tool_calls
from tallyloom.llm import piece_transducer as P
from tallyloom.llm import quality_cnn as Q


def brute_components(rows, percent=85):
    sets = []
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((d, frozenset(tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))) if w else frozenset()))
    parent = {d: d for d, _ in sets}

    def top(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            both = len(x & y)
            if both and 100 * both >= percent * (len(x) + len(y) - both):
                u, v = sorted((top(a), top(b)))
                parent[v] = u
    return {(d, len(x), top(d)) for d, x in sets}


def test_join_matches_brute_force(spark, sf_dir, small_texts):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in queries.op6_ngram_join(spark, sf_dir).collect()}
    assert got == brute_components(small_texts)


def near_copies(seed, n=120):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    base = [rng.choice(words) for _ in range(60)]
    rows = []
    for d in range(n):
        own = list(base)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((d, " ".join(own if d % 3 else own + rng.choices(words, k=rng.randint(0, 20)))))
    return rows


def test_join_of_a_large_group_matches_brute_force(spark):
    rows = near_copies(5)
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()} == brute_components(rows)


def test_bitmaps_clear_no_link():
    rng = np.random.default_rng(11)
    cleared = 0
    for _ in range(400):
        n = int(rng.choice([1, 2, 3, 7, 20, 64, 65, 300, 2000]))
        a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        kept = a[rng.random(len(a)) >= rng.choice([0, 0.05, 0.08, 0.12, 0.15, 0.3])]
        b = np.unique(np.concatenate([kept, rng.integers(0, 1 << 63, int(rng.integers(0, 1 + n // 8)), np.uint64)]))
        both = len(np.intersect1d(a, b))
        link = 100 * both >= 85 * (len(a) + len(b) - both)
        args = (len(a), ngram_join.parities(a), len(b), ngram_join.parities(b))
        assert ngram_join.may_link(*args) == ngram_join.may_link(*args[2:], *args[:2])
        assert not link or ngram_join.may_link(*args)
        cleared += not ngram_join.may_link(*args)
    assert cleared > 100


def test_only_texts_of_close_pairs_are_fetched(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(300)]
    changed = lambda at: [f"x{rng.random()}" if k in at else w for k, w in enumerate(base)]
    rows = [(1, " ".join(base)), (2, " ".join(changed({7}))), *((d, " ".join(changed(set(range(d, 300, 50))))) for d in range(10, 14)), (20, "of other words")]
    asked = []
    texts_of = ngram_join._texts_of

    def noted(docs, ids):
        asked.append({r.id for r in ids.collect()})
        return texts_of(docs, ids)

    monkeypatch.setattr(ngram_join, "_texts_of", noted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = spark.createDataFrame([(1, d) for d, _ in rows[1:]], "x long, y long")
    got = ngram_join._verified(pairs, docs, 4, 85).collect()
    linked = [d for d, _ in rows[1:] if (d, 1) in {(d, g) for d, _, g in brute_components([rows[0], next(r for r in rows if r[0] == d)])}]
    assert sorted((r.u, r.v) for r in got) == [(1, d) for d in linked] and linked[0] == 2
    assert asked[-1] < {d for d, _ in rows}  # the bitmaps of all, the texts of few
    assert {1, *linked} <= asked[-1] and 20 not in asked[-1]


def test_counts_take_few_bytes():
    counts = np.zeros(ngram_join.SLICE, np.int64)
    counts[5] = 200
    assert len(ngram_join._narrow(counts)) == ngram_join.SLICE and (ngram_join._widened(ngram_join._narrow(counts)) == counts).all()
    counts[5] = 70_000
    assert len(ngram_join._narrow(counts)) == 4 * ngram_join.SLICE and (ngram_join._widened(ngram_join._narrow(counts)) == counts).all()


def test_join_of_one_id_with_several_texts(spark):
    """Texts under one id are one document, also where their sets share shingles, and copies stay one set."""
    rows = near_copies(9, 60)
    rows += [(rows[3][0], "some other words that are in no other text of this table"), (70, "some other words that are in no other text of this table"), (71, rows[0][1]), (72, rows[0][1])]
    got = ngram_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    apart = [(d if k < 60 or d >= 70 else 1000, t) for k, (d, t) in enumerate(rows)]
    want = {d: g for d, _, g in brute_components(apart)}
    top = min(want[rows[3][0]], want[70])
    same = lambda g: top if g in (want[rows[3][0]], want[70], want[1000]) else g
    assert {(r.doc_id, r.component_id) for r in got} == {(d, same(g)) for d, g in want.items() if d != 1000}


def test_join_edges(spark, edge_docs, empty_docs):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(edge_docs).collect()), key=str)
    by = {d: (n, g) for d, n, g in got}
    assert len(got) == 12 and by[3] == (0, 3) and by[4] == (0, 4) and by[None][1] is None
    assert by[1][1] == by[2][1] == 1 and by[7] == (1, 7) and by[8] == (1, 7)
    assert ngram_join.join(empty_docs).count() == 0
    kept = ngram_join.keep_one(edge_docs)
    assert kept.columns == edge_docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[1] == 1 and ids[2] == 0 and ids[8] == 0 and ids[None] == 1 and ids[3] == ids[4] == 1


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 150)]
    got = {r.id: r.component for r in CC.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(31)} | {100: 100, 101: 100, 200: 150, 150: 150}
    assert CC.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_quality_held_out_accuracy(spark):
    rows = queries.op2_quality_cnn(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out").collect()
    right = sum(r.predicted == r.quality for r in rows) / len(rows)
    assert len(rows) > 50 and right >= 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def test_quality_edges(spark, edge_docs, empty_docs, labels):
    rows = Q.classify(edge_docs, labels).collect()
    assert len(rows) == 12 and all(r.score is not None for r in rows)
    assert len({r.score for r in rows if r.doc_id in (3, 4)}) == 1
    none = Q.classify(edge_docs, labels.limit(0)).collect()
    assert {r.predicted for r in none} == {1}
    assert Q.classify(empty_docs, labels).count() == 0 and Q.keep(edge_docs, labels.limit(0)).count() == 12


def test_sample_has_one_text_of_each_label_row(spark, monkeypatch):
    monkeypatch.setattr(Q, "SAMPLE", 3)
    ids = [i for i in range(1, 60) if zlib.crc32(str(i).encode()) % Q.FOLD != Q.HELD_OUT][:3]
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)], "doc_id long, quality int")
    rows = [(ids[0], f"text {k:02d}") for k in range(40)] + [(ids[1], "second"), (ids[2], "third"), (ids[2], None)]
    got = Q.sample_of(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert got == [("text 00", 0), ("second", 1), ("", 0)]


def test_sampled_texts_train_whole(spark):
    rows = [(i, "".join(chr(97 + (k + i) % 26) for k in range(n))) for i, n in enumerate((0, 63, 70_000, 200_000))]
    sample = Q.sample_of(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, quality int"))
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sorted(sample) == sorted((t, i % 2) for i, t in rows if i not in held) and len(sample) >= 2


def test_sample_passes_over_labels_without_a_document(spark, monkeypatch):
    monkeypatch.setattr(Q, "SAMPLE", 40)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(3000)], "doc_id long, quality int")
    own = [i for i in range(60) if zlib.crc32(str(i).encode()) % Q.FOLD != Q.HELD_OUT]
    assert len(Q.sample_of(docs, labels)) == min(40, len(own))


def test_chunks_cover_the_text():
    for n in (0, 1, 255, 256, 257, 447, 448, 449, 5000):
        text = "".join(chr(97 + k % 26) for k in range(n))
        rows = Q.chunks(text)
        whole = np.zeros((len(rows) - 1) * Q.STEP + Q.CHUNK, np.uint8)
        for k, r in enumerate(rows):
            whole[k * Q.STEP : k * Q.STEP + Q.CHUNK] = r[: Q.CHUNK]
        assert bytes(whole[:n]).decode() == text and len(whole) >= n


def test_mixing_matches_sql(spark, sf_dir, duck):
    names = ["doc_id", "domain", "lang", "source", "n_tokens", "copies"]
    cur = duck.execute(queries.OP8_SQL)
    order = [[d[0] for d in cur.description].index(n) for n in names]
    assert sorted(tuple(r) for r in queries.op8_mixing(spark, sf_dir).select(*names).collect()) == sorted(tuple(r[i] for i in order) for r in cur.fetchall())


def test_budgets_go_to_brothers_first(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 1000), ("b", "z", 1000), ("b", "w", 0)], "d string, s string, tokens long")
    got = {r.s: r.target for r in mixing.leaf_budgets(leaves, ["d", "s"], {}, (1, 2), 1).collect()}
    assert got == {"x": 10, "y": 503 - 10, "z": 502, "w": 0}  # of 1,005 the odd token goes to the first name


def brute_budgets(tree, weights, budget, epochs=1):
    """Leaves' targets by sharing each budget among open brothers until it is spent or none has room. ``tree``: nested, tokens at the leaves."""

    def room(node, w):
        if w <= 0:
            return 0
        return epochs * node if isinstance(node, int) else sum(room(x, weights.get(k, 1)) for k, x in node.items())

    out = {}

    def share(node, given):
        got = {k: Fraction(0) for k in node}
        left = Fraction(given)
        while left:
            still = {k: weights.get(k, 1) for k, x in node.items() if weights.get(k, 1) > 0 and room(x, weights.get(k, 1)) > got[k]}
            if not still:
                break
            part, spent = left / sum(still.values()), Fraction(0)
            for k, w in still.items():
                more = min(part * w, room(node[k], w) - got[k])
                got[k] += more
                spent += more
            left -= spent
        whole = {k: int(v) for k, v in got.items()}
        for k in sorted(got, key=lambda k: (whole[k] - got[k], k))[: int(sum(got.values())) - sum(whole.values())]:
            whole[k] += 1
        for k, x in node.items():
            if isinstance(x, int):
                out[k] = whole[k]
            else:
                share(x, whole[k])

    share(tree, budget)
    return out


def plain_score(model, text):
    rows = Q.chunks(text)
    pooled = [[max(0.0, max(model.bias[f] + sum(model.filters[k][row[at + k]][f] for k in range(Q.WIDTH)) for at in range(Q.CHUNK))) for f in range(Q.FILTERS)] for row in rows]
    means = [sum(p[f] for p in pooled) / len(pooled) for f in range(Q.FILTERS)]
    tops = [max(p[f] for p in pooled) for f in range(Q.FILTERS)]
    z = sum(w * x for w, x in zip(model.weights, means + tops)) + model.offset
    return 1 / (1 + np.exp(-z))


def random_model(seed):
    rng = np.random.default_rng(seed)
    return Q.Model(0.3 * rng.standard_normal((Q.WIDTH, 256, Q.FILTERS)), 0.1 * rng.standard_normal(Q.FILTERS), 0.1 * rng.standard_normal(2 * Q.FILTERS), 0.2)


def test_scores_equal_plain_loops():
    model = random_model(1)
    for text in ("", "short", "wörds and more of them, " * 14):
        assert abs(Q.score_text(model, text) - plain_score(model, text)) < 1e-9


def test_gradients_equal_differences():
    model, rows, label = random_model(2), Q.chunks("some words of text, and others too. " * 12), 1.0
    grads = [np.zeros_like(model.filters), np.zeros_like(model.bias), np.zeros_like(model.weights), np.float64(0)]
    Q._add_gradient(model, rows, label, grads, 1)
    loss = lambda: -np.log(Q._sigmoid(Q._summary(Q._pooled(model, rows)) @ model.weights + model.offset))
    rng, step = np.random.default_rng(3), 1e-6
    for array, grad in zip((model.filters, model.bias, model.weights), grads):
        places = np.argwhere(np.abs(grad) > 1e-6)
        for at in map(tuple, places[rng.permutation(len(places))[:8]]):
            kept = array[at]
            array[at] = kept + step
            up = loss()
            array[at] = kept - step
            down = loss()
            array[at] = kept
            assert abs((up - down) / (2 * step) - grad[at]) < 1e-5


def test_weight_zero_is_no_capacity(spark):
    cases = [
        ({"a": {"x": 100, "y": 100}, "b": {"z": 1000}}, {"x": 0}, (1, 3)),
        ({"a": {"x": 50, "y": 70}, "b": {"z": 10, "u": 400}, "c": {"v": 300}}, {"c": 0, "u": 3, "a": 2}, (1, 2)),
        ({"a": {"x": 0, "y": 7}, "b": {"z": 0}}, {}, (1, 1)),
        ({"a": {"x": 122}}, {"a": 7, "x": 7}, (1, 2)),
        ({"a": {"x": 100, "y": 100, "z": 100}, "b": {"u": 55, "v": 200, "w": 31}}, {"a": 7, "b": 3, "u": 2, "v": 3}, (1, 3)),
        ({"a": {f"x{k}": 10 + k for k in range(9)}, "b": {f"y{k}": 3**k for k in range(9)}}, {"a": 11, "b": 13, "y3": 5, "x4": 6}, (2, 7)),
    ]
    for tree, weights, (num, den) in cases:
        rows = [(d, s, n) for d, kids in tree.items() for s, n in kids.items()]
        leaves = spark.createDataFrame(rows, "d string, s string, tokens long")
        got = {r.s: r.target for r in mixing.leaf_budgets(leaves, ["d", "s"], {"d": weights, "s": weights}, (num, den), 1).collect()}
        want = brute_budgets(tree, weights, sum(n for *_, n in rows) * num // den)
        assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
        assert sum(got.values()) == sum(want.values())


def test_many_rows_of_one_document_are_in_or_out_together(spark):
    rows = spark.createDataFrame([(k if k < 20 else None if k < 40 else 77, "a b c", "en", "src0") for k in range(60)], "doc_id long, text string, lang string, source string")
    out = mixing.mix(rows, {"source": F.col("source")}, {}, share=(2, 3), epochs=1, seed=4).groupBy("doc_id").count().collect()
    assert {r["count"] for r in out if r.doc_id is None or r.doc_id == 77} <= {20} and sum(r["count"] for r in out) <= 40


def test_arguments_end_with_their_value(spark):
    good = ['{"q":"x"}', ' {"q" : "x"}\n', "[1, 2]", "null", '"a, b"', "1"]
    bad = ['{"q":"x"} junk', '{"q":"x"}{"q":"y"}', '{"q":"x"}}', '{"q":"x"},{"q":"y"}', '{"q":"x"}] [', '{"q":"x"}} {', '{"q":"x"}, "w": 1', "1 2", "", " ", "1]", "1,", ", 1", "x"]
    rows = spark.createDataFrame([(k, a) for k, a in enumerate(good + bad)], "i int, arguments string").withColumn("fine", tool_calls.parsed(F.col("arguments")).isNotNull())
    assert [r.fine for r in rows.orderBy("i").collect()] == [True] * len(good) + [False] * len(bad)


def test_mixing_edges(spark, edge_docs, empty_docs):
    out = mixing.mix(edge_docs, queries.mix_levels(), {}, share=(2, 1), epochs=2, seed=1)
    copies = {(r["__mix_tokens"] > 0, r["__mix_copies"]) for r in out.collect()}
    assert set(edge_docs.columns) <= set(out.columns) and copies == {(True, 2), (False, 1)} and out.count() == 12  # two empty texts
    assert mixing.repeated(out, edge_docs.columns).count() == 22
    assert mixing.mix(empty_docs, queries.mix_levels(), {}).count() == 0
    half = mixing.mix(edge_docs, queries.mix_levels(), {"lang": {"en": 0}}, share=(1, 2), seed=3).collect()
    assert all(r.lang != "en" for r in half)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))


def test_pieces_match_the_library(spark, sf_dir, small_texts, library, edge_docs, empty_docs):
    path = queries.vocabulary("piece_bpe_32k.model")
    docs = spark.createDataFrame(small_texts, "doc_id long, text string").unionByName(edge_docs.select("doc_id", "text"))
    coded = P.encode(docs, path)
    texts = Counter((d, tuple(library.encode(t or ""))) for d, t in [*small_texts, *((r.doc_id, r.text) for r in edge_docs.collect())])
    assert Counter((r.doc_id, tuple(r.ids)) for r in coded.collect()) == texts
    back = Counter((r.doc_id, r.text) for r in P.decode(coded, path).collect())
    assert back == Counter((d, library.decode(list(ids))) for d, ids in texts.elements())
    assert P.encode(empty_docs, path).count() == 0 and P.round_trip(empty_docs, path).count() == 0


def test_random_texts_match_the_library(library):
    own = P.transducer(queries.vocabulary("piece_bpe_32k.model"))
    rng = random.Random(8)
    parts = ["a", "b", "the", "  ", " ", "▁", "\n", "é", "你好", "😀", "<s>", "<0x41>", "ing", "tion", "ERR", "...", "1", "ñ"]
    for _ in range(1500):
        text = "".join(rng.choices(parts, k=rng.randint(0, 12))) + " " * rng.choice([0, 0, 1, 2, 17, 33])
        assert own.encode(text).tolist() == library.encode(text)


def test_unigram_shortest_path_matches_brute_force():
    pieces = [("<unk>", 0.0, 2), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -3.1, 1), ("ba", -1.9, 1), ("aba", -5.0, 1), ("▁", -1.0, 1), ("▁a", -2.2, 1)]
    own = P.Transducer(pieces, bpe=False)
    cost = {t: -s for t, s, k in pieces if k == 1}

    def best(s):
        if not s:
            return 0.0
        return min([cost[s[:k]] + best(s[k:]) for k in range(1, 4) if s[:k] in cost])

    for text in ("ab", "abab", "baab ab", "a b a"):
        ids = own.encode(text)
        assert abs(sum(-pieces[i][1] for i in ids) - best("▁" + text.replace(" ", "▁"))) < 1e-9 and own.decode(ids) == text


def model_file(tmp_path, name, pieces=None, kind=2, rule=None, **normal):
    """A model on disk: the public pieces or given ones, with a normalisation of the library's own."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(queries.vocabulary("piece_bpe_32k.model"), "rb") as f:
        model.ParseFromString(f.read())
    if pieces:
        del model.pieces[:]
        for text, score, k in pieces:
            model.pieces.add(piece=text, score=score, type=k)
        model.trainer_spec.vocab_size, model.trainer_spec.model_type = len(pieces), kind
        model.trainer_spec.byte_fallback = any(k == P.BYTE for *_, k in pieces)
    if rule:
        made = sentencepiece_model_pb2.ModelProto()
        made.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
        model.normalizer_spec.precompiled_charsmap = made.normalizer_spec.precompiled_charsmap
    for k, v in normal.items():
        setattr(model.normalizer_spec, k, v)
    path = tmp_path / name
    path.write_bytes(model.SerializeToString())
    return str(path)


PARTS = ["a", "b", "ab", "the", "  ", " ", "▁", "\n", "\t", "é", "e\u0301", "你好", "😀", "ﬁ", "①", "Å", "ｱ", "ＡＢ", "\u00a0", "\u3000", "½", "...", "ing"]


def same_as_library(path, texts):
    import sentencepiece

    library, own = sentencepiece.SentencePieceProcessor(model_file=path), P.transducer(path)
    together = own.encode_all(texts)
    for text, ids in zip(texts, together):
        assert ids.tolist() == library.encode(text), text
        assert own.decode(ids) == library.decode(ids.tolist())


def random_texts(seed, n):
    rng = random.Random(seed)
    return ["".join(rng.choices(PARTS, k=rng.randint(0, 14))) for _ in range(n)]


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_character_maps_match_the_library(tmp_path, rule):
    same_as_library(model_file(tmp_path, "map.model", rule=rule), random_texts(4, 800))
    same_as_library(model_file(tmp_path, "fold.model", rule=rule, remove_extra_whitespaces=True, add_dummy_prefix=False), random_texts(5, 800))


def test_unigram_models_match_the_library(tmp_path):
    rng = random.Random(3)
    words = {"▁", "a", "b", "t", "h", "e", "i", "n", "g", "▁a", "▁ab", "ab", "ba", "the", "▁the", "ing", "▁th", "in", "你", "你好", "é", "..."}
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((w, -rng.uniform(1, 9), P.NORMAL) for w in sorted(words))]
    same_as_library(model_file(tmp_path, "unigram.model", pieces, P.UNIGRAM), random_texts(6, 800))
    spelled = pieces[:3] + [(f"<0x{b:02X}>", 0.0, P.BYTE) for b in range(256)] + pieces[3:]
    same_as_library(model_file(tmp_path, "spelled.model", spelled, P.UNIGRAM), random_texts(7, 800))


def test_borders_match_merging():
    own = P.transducer(queries.vocabulary("piece_bpe_32k.model"))
    rng = random.Random(2)
    ids = sorted(own.ids.values())
    pairs = [(rng.choice(ids), rng.choice(ids)) for _ in range(4000)] + [(own.ids["▁" * a], own.ids["▁" * b]) for a in range(1, 9) for b in range(1, 9)]
    want = [own.merged(own._names[a] + own._names[b]) == [own._names[a], own._names[b]] for a, b in pairs]
    assert own.apart(*np.array(pairs).T).tolist() == want and 100 < sum(want) < 4000


def test_long_and_short_cuts_agree():
    own = P.transducer(queries.vocabulary("piece_bpe_32k.model"))
    texts = ["▁" + "".join(random.Random(k).choices("abctheingé你", k=k)) for k in range(1, 120)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.shortest_paths(texts)] == [own.shortest_path(t) for t in texts]


def test_tool_calls_match_sql(spark, sf_dir, duck):
    names = ["conv_id", "call_id", "turn", "tool", "level", "place", "status", "n_errors", "json"]
    cur = duck.execute(queries.OP10_SQL)
    order = [[d[0] for d in cur.description].index(n) for n in names]
    assert sorted(tuple(r) for r in queries.op10_tool_calls(spark, sf_dir).select(*names).collect()) == sorted(tuple(r[i] for i in order) for r in cur.fetchall())


def test_tool_call_edges(spark):
    schema = {"type": "object", "properties": {"q": {"type": "string", "minLength": 1}, "n": {"type": "integer", "minimum": 0}}, "required": ["q"], "additionalProperties": False}
    calls = [
        (1, "a", 0, "t", '{"q": "x"}', []), (1, "b", 1, "t", '{"q": ""}', ["a"]), (1, "c", 2, "t", "{}", ["b", "a", None]), (1, "d", 3, "u", '{"q":"1"}', ["e"]), (1, "e", 4, "t", '{"q": "1", "z": 2, "n": -1}', ["d"]),
        (1, "f", 5, None, None, ["gone"]), (1, "a", 9, "t", '{"q": "second"}', []), (1, "a", 0, "t", '{"q": "y"}', []), (None, "a", 0, "t", "{}", []), (2, None, 0, "t", "{}", []), (3, "g", None, "t", '{"n": 1.0, "q": "x"}', None),
        (4, "h", 0, "t", '{"q": "x"', []), (4, "i", 1, "t", "", []), (4, "j", 2, "t", '{"q":"x","q":"y"}', []), (4, "k", 3, "t", None, []), (4, "l", 4, "t", "[1]", []), (4, "m", 5, "t", '{"q":"' + "long " * 60000 + '"}', []),
    ]
    c = spark.createDataFrame(calls, "conv_id long, call_id string, turn long, tool string, arguments string, needs array<string>").withColumn("errors", F.lit(1))
    r = spark.createDataFrame([(1, "a", 5, "late"), (1, "a", 2, "first"), (1, "zz", 1, "orphan"), (1, None, 1, "x")], "conv_id long, call_id string, turn long, text string")
    got = {x.call_id: x for x in tool_calls.link(c, r, {"t": schema}).collect()}
    assert set(got) == set("abcdefghijklm")
    assert [got[k].level for k in "abcdefg"] == [0, 1, 2, None, None, 0, 0] and got["a"].status == "linked" and '"result":"first"' in got["a"].json
    assert got["a"].json == '{"arguments":{"q":"x"},"call_id":"a","errors":[],"level":0,"needs":[],"result":"first","tool":"t"}'
    assert [got[k].n_errors for k in "bcdefghijklm"] == [1, 1, 1, 2, 2, 0, 1, 1, 1, 1, 1, 0]
    assert [json.loads(got[k].json)["errors"] for k in "ehkl"] == [["n: too small", "z: not known"], ["arguments: not JSON"], ["q: missing"], ["arguments: not a object"]]
    assert [json.loads(got[k].json)["arguments"] for k in "gjk"] == [{"n": 1, "q": "x"}, '{"q":"x","q":"y"}', {}] and '"n":1,' in got["g"].json
    assert [k for _, k in sorted((x.place, k) for k, x in got.items() if x.conv_id == 1)] == ["a", "f", "b", "c", "d", "e"]
    assert tool_calls.link(c.limit(0), r, {"t": {}}).count() == 0


def _plain_errors(value, schema, path=""):
    """The keywords' rules once more, over parsed JSON."""
    name, out = path or "arguments", []
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    fits = {"string": isinstance(value, str), "number": number, "integer": number and value == int(value), "boolean": isinstance(value, bool), "null": value is None, "array": isinstance(value, list), "object": isinstance(value, dict)}
    kinds = schema.get("type", list(fits))
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if not any(fits[k] for k in kinds):
        out.append(f"{name}: not a {' or '.join(kinds)}")
    if "enum" in schema and not any(type(v) is type(value) and v == value for v in schema["enum"]):
        out.append(f"{name}: not one of the values")
    if number:
        out += [f"{name}: too small"] * (value < schema.get("minimum", value)) + [f"{name}: too large"] * (value > schema.get("maximum", value))
    if isinstance(value, str):
        out += [f"{name}: too short"] * (len(value) < schema.get("minLength", 0)) + [f"{name}: too long"] * (len(value) > schema.get("maxLength", len(value)))
        out += [f"{name}: not of the pattern"] * ("pattern" in schema and not re.search(schema["pattern"], value))
    if isinstance(value, dict):
        at = lambda k: f"{path}.{k}" if path else k
        out += [f"{at(k)}: missing" for k in schema.get("required", ()) if k not in value]
        if schema.get("additionalProperties") is False:
            out += [f"{at(k)}: not known" for k in value if k not in schema.get("properties", {})]
        out += [e for k, inner in schema.get("properties", {}).items() if k in value for e in _plain_errors(value[k], inner, at(k))]
    if isinstance(value, list) and "items" in schema:
        out += [e for v in value for e in _plain_errors(v, schema["items"], f"{path}[]")]
    return sorted(set(out))


def test_schemas_match_plain_rules(spark):
    item = {"type": "object", "properties": {"id": {"type": "integer", "minimum": -5, "maximum": 9}, "tag": {"enum": ["a", "b", 1, None]}, "a.b": {"type": ["number", "null"]}}, "required": ["id"], "additionalProperties": False}
    schema = {"type": "object", "properties": {"items": {"type": "array", "items": item}, "on": {"type": "boolean"}, "name": {"type": "string", "minLength": 2, "maxLength": 4, "pattern": "^[a-z]"}, "in": {"type": "object", "properties": {"x": item}}}, "required": ["items", "on"]}
    rng = random.Random(11)
    leaf = lambda: rng.choice([None, True, False, -7, -5, 0, 3, 9, 10, 2.5, 4.0, "", "a", "b", "ab", "Abc", "abcde", "é\"n", [], {}, [1, "x"]])
    some = lambda keys, make: {k: make() for k in keys if rng.random() < 0.7}
    thing = lambda: some(["id", "tag", "a.b", "more"], leaf) if rng.random() < 0.8 else leaf()
    values = [{**some(["on", "name", "free"], leaf), **some(["items"], lambda: [thing() for _ in range(rng.randrange(4))] if rng.random() < 0.9 else leaf()), **some(["in"], lambda: some(["x", "y"], thing))} for _ in range(400)] + [leaf() for _ in range(30)]
    rows = spark.createDataFrame([(i, "t", json.dumps(v)) for i, v in enumerate(values)], "i int, tool string, arguments string")
    got = {x.i: x for x in rows.select("i", tool_calls.argument_errors({"t": schema}).alias("errors"), F.to_json(tool_calls.canonical_arguments(F.col("arguments"))).alias("json")).collect()}
    assert {i: x.errors for i, x in got.items()} == {i: _plain_errors(v, schema) for i, v in enumerate(values)}
    whole = lambda v: json.loads(json.dumps(v), parse_float=lambda x: int(float(x)) if float(x).is_integer() else float(x))
    assert all(got[i].json == json.dumps(whole(v), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for i, v in enumerate(values))
    with pytest.raises(ValueError):
        tool_calls.argument_errors({"t": {"oneOf": []}})


def test_levels_match_brute_force(spark):
    rng = random.Random(6)
    calls, edges = [], []
    for conv in range(12):
        n = 25
        calls += [(conv, f"c{k}") for k in range(n)]
        for k in range(1, n):
            edges += [(conv, f"c{k}", f"c{rng.randrange(k)}") for _ in range(rng.choice([0, 1, 1, 1, 2, 3]))]
        if conv % 3 == 0:
            edges.append((conv, "c3", "c20"))
    needs = {}
    for conv, a, b in edges:
        needs.setdefault((conv, a), set()).add((conv, b))

    want, changed = {x: 0 for x in calls if x not in needs}, True
    while changed:
        fresh = {x: 1 + max(want[y] for y in ys) for x, ys in needs.items() if x not in want and all(y in want for y in ys)}
        want.update(fresh)
        changed = bool(fresh)
    got = tool_calls.levels(spark.createDataFrame(edges, "conv_id long, call_id string, needs string"), spark.createDataFrame(calls, "conv_id long, call_id string"))
    assert {(r.conv_id, r.call_id): r.level for r in got.collect()} == want


def test_pipeline_matches_its_stages(spark, sf_dir, library):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.quality(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    scores = {r.doc_id: r.predicted for r in queries.op2_quality_cnn(spark, sf_dir).collect()}
    good = kept.collect()
    assert {r.doc_id for r in good} == {d for d, p in scores.items() if p}
    one = corpus_pipeline.near_duplicates(spark, kept, sf_dir)
    assert {r.doc_id for r in one.collect()} == {d for d, _, g in brute_components([(r.doc_id, r.text) for r in good]) if d == g}
    assert one.columns == docs.columns
    mixed = corpus_pipeline.mixture(spark, one, sf_dir)
    assert mixed.columns == docs.columns
    want = brute_mix([(r.doc_id, r.text, r.lang, r.source) for r in one.collect()])
    assert Counter(r.doc_id for r in mixed.collect()) == want and sum(want.values()) > 0
    last = corpus_pipeline.run(spark, sf_dir)
    assert set(last.columns) == {"doc_id", "ids"}
    texts = {r.doc_id: r.text for r in one.collect()}
    assert Counter((r.doc_id, tuple(r.ids)) for r in last.collect()) == Counter({(d, tuple(library.encode(texts[d] or ""))): n for d, n in want.items()})


def test_pipeline_drops_near_copies_of_five_words_and_080(spark):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(5000)]
    rows = []
    for at in range(0, 60, 3):
        base = rng.sample(words, rng.randint(49, 60))
        edited = list(base)
        edited[rng.randrange(10, 40)] = "edited"
        rows += [(at, " ".join(base)), (at + 1, " ".join(base + rng.sample(words, rng.randint(6, 20)))), (at + 2, " ".join(edited))]
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, t in rows for w in [t.split()]}
    top = {d: d for d in sets}
    for _ in sets:  # until the smallest id has come through any chain
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    top[a] = top[b] = min(top[a], top[b])
    want = {d for d in top if top[d] == d}
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert {r.doc_id for r in got.collect()} == want and 20 < len(want) < 60


def brute_mix(rows):
    """How often each doc_id comes in the pipeline's mixture of (doc_id, text, lang, source)."""
    forum = {f"src{k}" for k in range(1, 13)}
    leaves, tree = {}, {}
    for doc, text, lang, source in rows:
        lang, source = lang or "", source or ""
        domain = "crawl" if source == "src0" else "forum" if source in forum else "library"
        tokens = len(text) - len(text.replace(" ", "").replace("\n", "")) + 1 if text else 0
        leaf = f"{domain}/{lang}/{source}"
        leaves.setdefault(leaf, []).append((doc, tokens))
        at = tree.setdefault(domain, {}).setdefault(lang, {})
        at[leaf] = at.get(leaf, 0) + tokens
    weights = {**queries.MIX_WEIGHTS["domain"], **queries.MIX_WEIGHTS["lang"]}
    num, den = corpus_pipeline.SHARE
    targets = brute_budgets(tree, weights, sum(n for own in leaves.values() for _, n in own) * num // den, queries.MIX_EPOCHS)
    out = Counter()
    for leaf, own in leaves.items():
        total = sum(n for _, n in own)
        whole = targets[leaf] // total if total else 0
        rest, run = targets[leaf] - whole * total, 0
        key = lambda doc, whole=whole: hashlib.md5(f"{queries.MIX_SEED}:{whole}:{'null' if doc is None else doc}".encode()).hexdigest()
        for doc in sorted({d for d, _ in own}, key=key):
            run += sum(n for d, n in own if d == doc)
            copies = whole + (run <= rest)
            out[doc] += copies * sum(d == doc for d, _ in own)
    return +out


def test_pipeline_edges(spark, sf_dir, edge_docs, empty_docs, library):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = edge_docs.collect()
    kept = corpus_pipeline.quality(spark, edge_docs, sf_dir)
    assert kept.columns == edge_docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in Q.classify(edge_docs, labels).collect() if r.predicted)
    one = corpus_pipeline.near_duplicates(spark, edge_docs, sf_dir)
    assert one.columns == edge_docs.columns
    assert sorted(r.doc_id for r in one.collect() if r.doc_id is not None) == [1, 3, 4, 5, 6, 7, 10]
    mixed = corpus_pipeline.mixture(spark, edge_docs, sf_dir)
    assert mixed.columns == edge_docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == brute_mix([(r.doc_id, r.text, r.lang, r.source) for r in rows])
    coded = corpus_pipeline.encoding(spark, edge_docs, sf_dir)
    assert Counter((r.doc_id, tuple(r.ids)) for r in coded.collect()) == Counter((r.doc_id, tuple(library.encode(r.text or ""))) for r in rows)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty_docs, sf_dir).count() == 0, name
