import gzip
import hashlib
import json
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest

from tallyloom.llm import media_store as M
from tallyloom.llm import queries
from tallyloom.llm import warc_derivatives as W
from tallyloom.llm import wavelet_tokens as T
from tallyloom.llm.shared_files import read_all


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))


def token_rows(rows, tokenizer):
    out, start = [], 0
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_token_shards_match_library(spark, sf_dir, small_texts, tokenizer):
    got = sorted(tuple(r) for r in queries.op4_wavelet_tokens(spark, sf_dir).collect())
    assert got == token_rows(small_texts, tokenizer)


def test_token_edges(spark, edge_docs, empty_docs, tokenizer):
    shards = T.write_shards(edge_docs, queries.vocabulary("byte_bpe_50k.json"), shard_tokens=50)
    assert shards.count() > 3
    got = [tuple(r) for r in T.read_back(shards).orderBy("start").collect()]
    rows = sorted(((r.doc_id, r.text) for r in edge_docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert got == token_rows(rows, tokenizer)
    assert T.read_back(T.write_shards(empty_docs, queries.vocabulary("byte_bpe_50k.json"))).count() == 0


def test_texts_of_added_tokens_match_the_library(tokenizer):
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    ends = [c * n for c in ("\n", " ", "\t") for n in range(4)]
    texts = [f"word{a}{t}{b}{c}" for t in added for a in ends for b in ends for c in ("", "b")] + ["a\n\n<|endoftext|>b"]
    own = T.encoder(queries.vocabulary("byte_bpe_50k.json")).encode_all(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in own] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_wavelet_access_rank_select():
    ids = np.random.default_rng(2).integers(0, 50, 3 * 8 * T.BLOCK_BYTES // 2).astype("<u4")
    raw = b"".join(T.to_file(ids, [(7, len(ids))]))
    w = T.WaveletMatrix(lambda at, n: raw[at : at + n])
    assert (w.ids() == ids).all() and w.doc_ids == [7]
    for token in (0, 31, 49, 63, 70):
        places = np.flatnonzero(ids == token)
        assert w.count(token) == len(places) and w.count(token, 100, 5000) == (ids[100:5000] == token).sum()
        assert w.select(token, len(places)) is None
        if len(places):
            assert [w.select(token, k) for k in (0, len(places) // 2, len(places) - 1)] == places[[0, len(places) // 2, -1]].tolist()
    assert [w.access(i) for i in (0, 77, len(ids) - 1)] == ids[[0, 77, -1]].tolist()
    with pytest.raises(IndexError):
        w.access(len(ids))
    few = b"".join(T.to_file(np.array([5, 1, 5, 5], "<u4"), [(1, 4)]))
    assert T.WaveletMatrix(lambda at, n: few[at : at + n]).occurrences(5) == [0, 2, 3]


def media_row(text):
    raw = (text or "").encode()
    p = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
    return len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])


def test_media_round_trip(spark, sf_dir, small_texts):
    got = {r.doc_id: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in queries.op5_media_store(spark, sf_dir).collect()}
    assert got == {d: media_row(t) for d, t in small_texts}


def test_media_edges(spark, edge_docs, empty_docs):
    rows = M.describe(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    texts = {r.doc_id: r.text for r in edge_docs.collect()}
    for r in rows:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == media_row(texts[r.doc_id])
    same = [r for r in rows if r.doc_id in (1, 2)]
    assert len({(r.media_sha256, r.feature, r.media_bytes) for r in same}) == 1
    places = M.store(edge_docs)
    assert places.count() == len({t or "" for t in texts.values()}) == places.select("digest").distinct().count()
    for r in rows:  # an independent reader of tar and PNG finds the payload where the row says
        raw = read_all(r.shard)[r.offset : r.offset + r.length]
        assert hashlib.sha256(raw).hexdigest() == r.media_sha256 and len(raw) == r.media_bytes
        at, lines = 8, b""
        while at < len(raw):
            size = int.from_bytes(raw[at : at + 4])
            lines += raw[at + 8 : at + 8 + size] if raw[at + 4 : at + 8] == b"IDAT" else b""
            at += size + 12
        lines = zlib.decompress(lines)
        payload = b"".join(lines[k + 1 : k + 577] for k in range(0, len(lines), 577))
        assert hashlib.sha256(payload).hexdigest() == r.digest == r.payload_sha256 and (r.width, r.height, r.bits) == (576, len(payload) // 576, 8)
        mean = sum(payload) / len(payload)
        spread = (sum((x - mean) ** 2 for x in payload) / len(payload)) ** 0.5
        eighths = [sum(x >> 5 == k for x in payload) / len(payload) for k in range(8)]
        assert r.feature == f"rows={len(payload) // 576};mean={mean:.3f};std={spread:.3f};distinct={len(set(payload))};" + ",".join(f"{x:.3f}" for x in eighths)
    heads = {bytes(r.digest): (r.width, r.height, r.bits) for r in M.metadata(places).collect()}
    assert heads[hashlib.sha256(b"\xff" * 576).digest()] == (576, 1, 8)
    assert M.describe(empty_docs).count() == 0


def test_media_of_hot_and_rare_payloads(spark):
    docs = spark.createDataFrame([(k, None if k % 3 else f"own {k}") for k in range(3000)], "doc_id long, text string")
    rows = M.describe(docs).collect()
    assert len(rows) == 3000 and {(r.doc_id, r.n_bytes, r.payload_sha256) for r in rows} == {(k, *(media_row(None if k % 3 else f"own {k}")[i] for i in (0, 2))) for k in range(3000)}
    assert len({(r.shard, r.offset) for r in rows if r.n_bytes == 0}) == 1


def test_warc_links_and_digests(spark, sf_dir):
    rows = queries.op7_warc_derivatives(spark, sf_dir).collect()
    assert len(rows) == 50 and all(r.linked and r.digest_holds and r.error is None for r in rows)
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in rows:
        p = pages[r.page_id]
        text = W.plain_text(p.html)
        assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest() and r.text_digest == W.digest(text.encode())
        assert r.payload_digest == W.digest(p.html.encode()) and r.url == p.url and "<" not in text.replace("<", "", text.count("&lt;"))


def test_warc_records(spark):
    raw = W.response(1, "http://a/b", "<html lang=DE><title>T &amp; t</title><script>x</script><p>One<br>two &lt;3 <a href='/x'>l</a></html>")
    meta, conversion, columns = W.derivatives(raw)
    headers, block = W.parse(conversion)
    assert block.decode() == "T & t\nOne\ntwo <3 l" and headers["WARC-Refers-To"] == W.parse(raw)[0]["WARC-Record-ID"] == columns["refers_to"]
    assert W.parse(meta)[0]["WARC-Type"] == "metadata" and columns["n_links"] == 1 and columns["lang"] == "de" and columns["title"] == "T & t"
    assert W.derivatives(raw.replace(b"WARC-Type: response", b"WARC-Type: request")) is None
    rows = [(1, bytearray(raw)), (2, bytearray(b"junk")), (3, None), (None, bytearray(raw[:-40]))]
    got = W.read_records(W.build(spark.createDataFrame(rows, "page_id long, record binary"))).collect()
    assert len(got) == 4 and sorted(r.error or "" for r in got) == ["", "no WARC header", "no WARC header", "short block"]
    assert [r.text for r in got if r.page_id == 2] == [None]
    pages = spark.createDataFrame([(1, None, None, "a"), (1, "u", "", "b")], "page_id long, url string, html string, text string")
    assert W.build(W.responses(pages)).count() == 2 and W.build(W.responses(pages.limit(0))).count() == 0


class Visible(HTMLParser):
    """Visible text by the standard library's parser."""

    HIDDEN, BREAKS = {"script", "style", "head", "noscript", "template"}, set("p div h1 h2 h3 h4 h5 h6 li ul ol tr table article section header footer nav blockquote pre br hr".split())

    def __init__(self, page):
        super().__init__()
        self.depth, self.text = 0, ""
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        self.depth += tag in self.HIDDEN
        self.text += "\n" if tag in self.BREAKS else ""

    def handle_endtag(self, tag):
        self.depth -= tag in self.HIDDEN
        self.text += "\n" if tag in self.BREAKS else ""

    def handle_data(self, data):
        self.text += "" if self.depth else data


def test_warc_text_matches_the_standard_parser(spark, sf_dir):
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    for page in [*pages, "<body><nav><a href=/>Home</a></nav><p>1 < 2 and 3 > 2</p></body>"]:
        assert W.plain_text(page).split() == Visible(page).text.split()
    assert W.plain_text("<nav>Home</nav><p>1 < 2 and 3 > 2</p>") == "Home\n1 < 2 and 3 > 2"


def coded(page, headers, body=None):
    body = page if body is None else body
    http = b"HTTP/1.1 200 OK\r\n" + b"".join(h + b"\r\n" for h in headers) + b"\r\n" + body
    return W.derivatives(W.record([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>"), ("WARC-Payload-Digest", "sha256:" + hashlib.sha256(body).hexdigest())], http))


def test_warc_codings_and_charsets():
    text = "<p>Привет мир</p>"
    plain = text.encode()
    chunks = b"5;x=y\r\n" + plain[:5] + b"\r\n" + b"%x\r\n" % len(plain[5:]) + plain[5:] + b"\r\n0\r\n\r\n"
    cases = [
        ([], plain), ([b"Content-Encoding: gzip"], gzip.compress(plain)), ([b"content-encoding: deflate"], zlib.compress(plain)), ([b"Content-Encoding: deflate"], zlib.compress(plain)[2:-4]),
        ([b"Transfer-Encoding: chunked"], chunks), ([b"Content-Type: text/html; charset=windows-1251"], text.encode("windows-1251")), ([], b"<meta charset='windows-1251'>" + text.encode("windows-1251")),
        ([b"Content-Type: text/html; charset=none-such"], plain), ([], "\ufeff".encode("utf-16-le") + text.encode("utf-16-le")),
    ]
    for headers, body in cases:
        meta, conversion, columns = coded(None, headers, body)
        assert W.parse(conversion)[1].decode() == "Привет мир" and columns["digest_holds"] is True and columns["error"] is None, headers
    for headers, body, error in (([b"Content-Encoding: br"], plain, "unknown coding br"), ([b"Content-Encoding: gzip"], plain, "broken gzip"), ([b"Transfer-Encoding: chunked"], plain, None)):
        meta, conversion, columns = coded(None, headers, body)
        assert conversion is None and columns["error"] and (error is None or columns["error"] == error)
        assert json.loads(W.parse(meta)[1])["error"] == columns["error"]


def test_any_charset_name_gives_a_page():
    import encodings.aliases

    names = {*encodings.aliases.aliases, *encodings.aliases.aliases.values(), "undefined", "idna", "punycode", "unicode_escape", "none-such", "a" * 300}
    for name in names:
        for http, body in ((W.Headers([f"Content-Type: text/html; charset={name}".encode()]), b"plain"), (W.Headers([]), f"<meta charset='{name}'>plain".encode())):
            page, charset = W.decoded(http, body)
            assert isinstance(page, str) and charset
    assert W.decoded(W.Headers([b"Content-Type: text/html; charset=undefined"]), b"<meta charset='latin-1'>\xe9") == ("<meta charset='latin-1'>\xe9", "latin-1")


def test_warc_unclosed_tags_take_linear_time():
    began = time.process_time()
    assert W.plain_text("<script " * 200_000 + "<p>x<!--" + "<style>" * 100_000) is not None
    assert time.process_time() - began < 10
    assert W.plain_text("a<script>b</script>c<style>d") == "a cd"


def test_warc_headers_repeat_in_any_case():
    http = b"HTTP/1.1 200 OK\r\nSet-Cookie: a=1\r\nSet-Cookie: b=2\r\n\r\n<p>x</p>"
    raw = W.record([("warc-type", "response"), ("warc-record-id", "<urn:x>"), ("Via", "1"), ("Via", "2")], http).replace(b"Content-Length", b"content-length")
    meta, conversion, columns = W.derivatives(raw)
    facts = json.loads(W.parse(meta)[1])
    assert facts["http"]["headers"] == [["Set-Cookie", "a=1"], ["Set-Cookie", "b=2"]] and columns["refers_to"] == "<urn:x>"
    assert [v for k, v in facts["envelope"] if k == "Via"] == ["1", "2"] and W.parse(conversion)[1] == b"x"
