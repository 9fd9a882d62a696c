import gzip
import hashlib
import random

from tallyloom.operators import catalogue as C
from tallyloom.operators import documents as D
from tallyloom.settings import DEFAULTS
from pyspark.sql import functions as F


def kinds(page):
    return [(b[0], b[1]) for b in D.blocks_of(page)]


def test_an_open_head_hides_no_text():
    assert kinds("<head><title>x<body><p>text</p>") == [("text", "text")]
    assert kinds("<html><head><title>x</title><p>text") == [("text", "text")]
    assert kinds("<head><style>p{}</style><script>var a='<p>no</p>'</script></head><p>a</p></head><p>b") == [("text", "a"), ("text", "b")]


def test_nested_tables_stand_for_themselves():
    inner = "<table><tr><td>Name</td><td>2024</td></tr><tr><td>Sales</td><td>7</td></tr></table>"
    page = f"<p>a</p><table><tr><td>left</td><td>{inner}</td></tr><tr><td>x</td><td>y</td></tr></table><p>b</p>"
    assert kinds(page) == [("text", "a"), ("table", "| Name | 2024 |\n| --- | --- |\n| Sales | 7 |"), ("text", "left"), ("text", "x y"), ("text", "b")]
    assert kinds(f"<table><tr><td>{inner}")[0][0] == "table" and kinds("<table><tr><td>a</td><td>b</td></tr><tr><td>1</td><td>2</td>")[0][0] == "table"
    assert kinds("<table><tr><td><table></table></td></tr></table></table><p>after") == [("text", "after")]


def test_pages_are_counted_by_rules_and_breaks():
    page = "<p>a</p><hr><p>b</p><p style='Page-Break-Before : ALWAYS'>c</p><p style='page-break-inside: avoid'>d</p>"
    assert [(b[1], b[2]) for b in D.blocks_of(page)] == [("a", 1), ("b", 2), ("c", 3), ("d", 3)]


def test_bad_sources_are_dead_letters_and_stop_nothing(spark):
    page = b"<h1>Head</h1><p>text</p>"
    rows = [
        (1, page, "html"), (2, gzip.compress(page), "html"), (3, gzip.compress(page)[:-9], "html"), (4, None, "html"), (5, b"", "html"), (6, b"%PDF-1.7", "html"), (7, page, "application/pdf"), (8, page, None), (9, b"one\n\ntwo\f three", "text"),
        (10, b"<p>\xff\xfe</p>", "html"), (11, b"<!-- nothing -->", "html"), (12, b"\x1f\x8b", "html"), (None, page, "html"), (1, page, "html"), (13, b"<![bad" + b"<p>" * 5, "html"),
    ]
    out = D.dispatch(spark.createDataFrame(rows, "source_id long, content binary, content_type string"))
    bad = {r.source_id: r.error for r in D.dead_letters(out).collect()}
    assert bad == {3: "broken gzip", 4: "no content", 5: "empty", 6: "a PDF", 7: "no parser for application/pdf", 8: "no parser for no type", 11: "no blocks", 12: "broken gzip", 13: bad.get(13)}
    good = sorted((r.source_id or 0, r.ordinal, r.kind, r.text, r.page) for r in out.filter("error is null").collect())
    assert [g for g in good if g[0] in (1, 2)] == [(1, 0, "heading", "Head", 1)] * 2 + [(1, 1, "text", "text", 1)] * 2 + [(2, 0, "heading", "Head", 1), (2, 1, "text", "text", 1)]
    assert [g[2:] for g in good if g[0] == 9] == [("text", "one", 1), ("text", "two", 1), ("text", "three", 2)] and [g[3] for g in good if g[0] == 10] == ["��"]
    ids = {r.source_id: r.doc_id for r in out.collect()}
    assert ids[1] == ids[7] == hashlib.sha256(page).hexdigest()[:12] and ids[4] is None
    counts = {r.status: (r.n_sources, r.n_documents, r.n_blocks) for r in D.dispatch_counts(out).collect()}
    assert counts["broken gzip"] == (2, 2, 0) and counts["no content"] == (1, 0, 0) and counts["ok"][2] == len(good)


def test_tokens_are_counted_as_the_library_does(spark, sf_dir):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    made = Tokenizer.from_file(path)
    rows = [(k, t) for k, t in enumerate(["", None, "two words", "wörd " * 3000, "<|endoftext|>"] + [f"text {k}" for k in range(150)])]
    got = {r.doc_id: r.bpe_tokens for r in D.bpe_counts(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()}
    assert got == {k: len(made.encode(t or "", add_special_tokens=False).ids) for k, t in rows}


def brute_chunks(blocks, most, overlap, least):
    """Windows over pieces by their sizes: closed before a piece that doesn't fit, a table or a new section."""
    out, held = [], []

    def close(keep):
        nonlocal held
        if held and sum(n for *_, n in held) >= least:
            out.append(("text", "\n".join(t for t, *_ in held), held[0][1], held[0][2], sum(n for *_, n in held)))
        tail = []
        if keep:
            for x in reversed(held):
                if sum(n for *_, n in tail) + x[3] > overlap:
                    break
                tail = [x, *tail]
        held = tail

    for kind, text, page, section in blocks:
        n = len(text.split())
        if kind == "table":
            close(False)
            out.append(("table", text, page, section, n))
            continue
        if held and held[-1][2] != section:
            close(False)
        if held and sum(m for *_, m in held) + n > most:
            close(True)
        held.append((text, page, section, n))
    close(True)
    return out


def test_chunks_match_a_plain_window():
    rng = random.Random(6)
    for _ in range(30):
        blocks, section = [], None
        for k in range(rng.randint(0, 40)):
            if rng.random() < 0.1:
                section = f"s{k}"
            kind = "table" if rng.random() < 0.1 else "text"
            blocks.append((kind, "| a | b |" if kind == "table" else " ".join(["w"] * rng.randint(1, 300)), 1 + k // 9, section))
        assert D.chunk_blocks(blocks) == brute_chunks(blocks, DEFAULTS.chunk_tokens, DEFAULTS.overlap_tokens, DEFAULTS.min_chunk_tokens)


def test_json_of_answers_ends_with_its_value(spark):
    cases = {
        '{"q":"x"}': '{"q":"x"}', ' [1, 2] ': "[1, 2]", '{"q":"x"} junk': '{"q":"x"}', 'Sure: [1,2] and {"a":1} or {"b":2}': None, '{"q":"x"}{"q":"y"}': None, "```json\n{\"a\": 1}\n```": '{"a": 1}', "```\n{\"a\": 1} x\n```": '{"a": 1}',
        '{"q":"x"}}': None, "[1]]": None, "no": None, "": None, None: None, "3": None, "{": None, '{"a":1}] [': '{"a":1}',
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "i int, a string").withColumn("j", C.json_of(F.col("a"))).collect()
    assert {r.a: r.j for r in rows} == cases


def test_an_exhibit_is_found_in_the_index_page(spark):
    row = lambda kind, link: f"<tr><td>1</td><td>{kind}</td><td><a href='{link}'>x</a>"
    pages = [
        (1, f"<table>{row('EX-99.2', '/a/two.htm')}</tr>{row(' ex-99.1 ', '/a/one.HTML')}{row('EX-99.1.5', '/a/no.htm')}</table>"), (2, f"{row('EX-99', 'b.htm')}{row('EX-99.1', 'a.htm')}"), (3, row("EX-99.1", "/a/one.pdf")),
        (4, "<tr><td>EX-99.1</td></tr>"), (5, row("<b>EX-99.3</b>", "http://other/x.htm")), (6, None), (7, "no html"), (8, row("EX-99.1", "//host/y.htm")),
    ]
    found = C.exhibit(C.index_rows(spark.createDataFrame(pages, "filing int, html string"), "https://base"))
    assert {r.filing: r.url for r in found.collect()} == {1: "https://base/a/one.HTML", 2: "https://base/a.htm", 5: "http://other/x.htm", 8: "https://host/y.htm"}


def test_binary_documents_are_admitted_by_size_and_first_bytes(spark, tmp_path):
    from tallyloom.sources.sinks import binary_documents

    for name, raw in (("a.pdf", b"%PDF-1.4 x"), ("b.pdf", b"<html>"), ("c.html", b"<p>"), ("d.html", b"")):
        (tmp_path / name).write_bytes(raw)
    rows = {r.path.rsplit("/", 1)[-1]: (r.admitted, r.digest) for r in binary_documents(spark, f"file://{tmp_path}").collect()}
    assert {k: v[0] for k, v in rows.items()} == {"a.pdf": True, "b.pdf": False, "c.html": True}  # Spark gives no row for an empty file
    assert rows["c.html"][1] == hashlib.sha256(b"<p>").hexdigest()


def test_namesakes_match_the_plain_ratio(spark, sf_dir):
    from difflib import SequenceMatcher

    from tallyloom.plans.ingest import q_match_company

    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").collect()
    want = {}
    for a in rows:
        scored = []
        for b in rows:
            if a.s_nationkey == b.s_nationkey:
                x, y = a.s_name.lower(), b.s_name.lower()
                r = SequenceMatcher(None, x, y).ratio()
                r = max(r, 0.85) if set(x.split()) <= set(y.split()) else r
                scored.append((b.s_suppkey % 5 + 150 * r, f"S{b.s_suppkey}.N"))
        want[a.s_name] = max(scored)
    assert {r["query"]: (r.score, r.ticker) for r in q_match_company(spark, sf_dir).collect()} == {k: (round(s, 6), t) for k, (s, t) in want.items()}
