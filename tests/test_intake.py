import json
import random
from collections import Counter

import pytest

from tallyloom.operators import ingest as I
from tallyloom.operators import layout as Y
from tallyloom.operators import reporting as R
from tallyloom.streaming import limits as L

LINES = "doc_id long, page int, ordinal long, text string, size double, bold boolean, form string, x0 double, y0 double, x1 double, y1 double, top double"
TABLES = "doc_id long, page int, item int, x0 double, y0 double, x1 double, y1 double, markdown string, ruled boolean"


def line(ordinal, text, y, *, page=0, size=10.0, bold=False, form=None, x=(50.0, 250.0), doc=1):
    return (doc, page, ordinal, text, size, bold, form, x[0], y, x[1], y + 10.0, y)


def blocks(spark, lines, tables=()):
    rows = Y.blocks(spark.createDataFrame(lines, LINES), spark.createDataFrame(list(tables), TABLES)).orderBy("doc_id", "page", "place").collect()
    return [(r.kind, r.text, r.section) for r in rows]


def test_lines_and_tables_come_in_reading_order_under_their_headings(spark):
    lines = [line(0, "below the heading.", 40.0), line(1, "Revenue by Region", 20.0, size=12.0), line(2, "   ", 25.0), line(3, "first of all.", 5.0), line(0, "on the next page.", 5.0, page=1), line(1, "Bold Words Here", 30.0, page=1, bold=True), line(2, "small print,", 31.0, page=1, bold=True)]
    lines += [line(9, "in the table", 62.0), line(10, "half in it.", 95.0)]
    tables = [(1, 0, 0, 40.0, 60.0, 300.0, 100.0, "| a | b |\n| --- | --- |\n| c | d |", True)]
    assert blocks(spark, lines, tables) == [
        ("text", "first of all.", None), ("heading", "Revenue by Region", "Revenue by Region"), ("text", "below the heading.", "Revenue by Region"), ("table", tables[0][7], "Revenue by Region"), ("text", "half in it.", "Revenue by Region"),
        ("text", "on the next page.", "Revenue by Region"), ("heading", "Bold Words Here", "Bold Words Here"), ("text", "small print,", "Bold Words Here"),
    ]


def test_only_items_open_sections_in_filings_and_tables_of_words_need_rules(spark):
    lines = [line(0, "Item 1A. Risk Factors", 5.0, form="10-K"), line(1, "Our business", 20.0, form="10-K"), line(2, "words inside.", 62.0, form="10-K")]
    tables = [(1, 0, 0, 40.0, 60.0, 300.0, 100.0, "| a | b |\n| --- | --- |\n| c | d |", False), (1, 5, 0, 0.0, 0.0, 9.0, 9.0, "| a | 1 |\n| --- | --- |\n| b | 2 |", False)]
    assert [(k, s) for k, _, s in blocks(spark, lines, tables)] == [("heading", "Item 1A -Risk Factors"), ("text", "Item 1A -Risk Factors"), ("text", "Item 1A -Risk Factors"), ("table", "Item 1A -Risk Factors")]
    assert blocks(spark, [line(0, "Our business", 20.0)])[0][0] == "heading"


def test_body_sizes_count_characters_of_the_first_pages(spark):
    lines = [line(0, "ab", 1.0, size=12.04), line(1, "abc", 2.0, size=9.0), line(2, "c", 3.0, size=11.99), line(3, "x" * 99, 1.0, page=25, size=7.0), line(0, " ", 1.0, doc=2, size=8.0), line(0, "x", 1.0, doc=3, size=None)]
    got = {r.doc_id: r.body for r in Y.body_size(spark.createDataFrame(lines, LINES)).collect()}
    assert got == {1: 12.0, 2: 10.0, 3: 10.0}


def test_overlaps_match_all_pairs(spark):
    rng = random.Random(3)
    box = lambda w, h: (x := rng.uniform(-50, 600), y := rng.uniform(-50, 800), x + rng.uniform(-5, w), y + rng.uniform(-5, h))
    lines = [(k % 3, k % 2, k, "t", 10.0, False, None, *box(300, 40), 0.0) for k in range(400)] + [(0, 0, 900, "t", 10.0, False, None, None, 1.0, 2.0, 3.0, 0.0), (0, 0, 901, "t", 10.0, False, None, float("-inf"), 1.0, float("inf"), 3.0, 0.0)]
    tables = [(k % 3, k % 2, k, *box(500, 400), "| 1 |", True) for k in range(30)]
    want = set()
    for d, p, o, *_, x0, y0, x1, y1, _ in lines[:400]:
        if x1 > x0 and y1 > y0:
            for td, tp, _, a0, b0, a1, b1, *_ in tables:
                w, h = min(x1, a1) - max(x0, a0), min(y1, b1) - max(y0, b0)
                if (td, tp) == (d, p) and a1 > a0 and b1 > b0 and w > 0 and h > 0 and w * h > 0.5 * (x1 - x0) * (y1 - y0):
                    want.add((d, p, o))
    got = Y.inside_tables(spark.createDataFrame(lines, LINES), spark.createDataFrame(tables, TABLES))
    assert {tuple(r) for r in got.collect()} == want and len(want) > 20


def walked(spark, *texts):
    rows = R.number_walk(spark.createDataFrame([("T", t) for t in texts], "ticker string, json string")).collect()
    return Counter((r.kind, r.key, r.value) for r in rows)


def test_numbers_are_found_at_any_depth_by_their_own_field(spark):
    value = {"revenue": 5, "rows": [{"cagr": 0.12345, "deep": {"fair_value": 2.5e9, "operating_margin": True, "net_income": None}}, 7, [{"probability": -0.25, "revenue": "9"}]], "market_cap": [1, 2], "unknown": 3}
    assert walked(spark, json.dumps(value)) == {("money", "revenue", 5.0): 1, ("pct", "cagr", 12.3): 1, ("money", "fair_value", 2.5e9): 1, ("pct", "probability", -25.0): 1}
    nested = {"revenue": 1}
    for _ in range(12):
        nested = {"x": [nested]}
    assert walked(spark, json.dumps(nested), json.dumps(nested), "no json", None, "", "[]", "3", '{"revenue": 1e400}')[("money", "revenue", 1.0)] == 2


def brute_windows(times, length):
    out = []
    for t in sorted(times):
        if not out or t > out[-1] + length:
            out.append(t)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_windows_start_greedily(spark, seed):
    rng = random.Random(seed)
    times = [float(rng.randint(0, 5000)) for _ in range(rng.choice([1, 30, 400]))] + [0.0, 100.0, 200.0, 9000.0]
    got = sorted(r.start for r in L.window_starts(spark.createDataFrame([(t,) for t in times], "at double"), 100.0).collect())
    assert got == brute_windows(times, 100.0)


def test_the_shared_limit_restarts_and_ties_go_by_event(spark):
    rng = random.Random(7)
    rows = [(k, rng.choice("ab"), float(rng.randint(0, 900))) for k in range(300)] + [(900, "a", None), (901, "c", 5.0)]
    got = {r.event_id: (r.start, r.accepted) for r in L.global_limit(spark.createDataFrame(rows, "event_id long, action string, at double"), 7, 100.0).collect()}
    starts, used, want = brute_windows([t for *_, t in rows if t is not None], 100.0), Counter(), {}
    for event, action, at in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0])):
        start = max(s for s in starts if s <= at)
        used[action, start] += 1
        want[event] = (start, used[action, start] <= 7)
    assert got == want
    assert L.global_limit(spark.createDataFrame([], "event_id long, action string, at double"), 7).count() == 0


def test_the_last_good_answer_is_served(spark):
    rng = random.Random(8)
    fetches = [(rng.choice("abc"), float(rng.randint(0, 300)), rng.random() < 0.5, f"v{k}") for k in range(80)] + [(None, 1.0, True, "x"), ("a", None, True, "x"), ("a", 5.0, None, "x")]
    requests = [(k, rng.choice("abcd"), float(rng.randint(0, 300))) for k in range(120)] + [(500, None, 7.0), (501, "a", None), (502, "a", 300.0), (502, "a", 300.0)]
    frame = I.answers_as_of(spark.createDataFrame(requests, "n int, key string, at double"), spark.createDataFrame(fetches, "key string, at double, ok boolean, body string"), 40.0, chunk=30.0)

    def brute(key, at):
        good = [(t, b) for k, t, ok, b in fetches if ok and k is not None and k == key and t is not None and at is not None and t <= at]
        if not good:
            return None, None, "missing"
        last = max(t for t, _ in good)
        return min(b for t, b in good if t == last), last, "fresh" if at - last < 40 else "stale"

    assert sorted(((r.n, r.body, r.fetched_at, r.state) for r in frame.collect()), key=repr) == sorted(((n, *brute(k, at)) for n, k, at in requests), key=repr)


def test_two_calendars_are_one(spark):
    feed = lambda *rows: spark.createDataFrame(list(rows), "ticker string, date string").selectExpr("ticker", "cast(date as date) as date")
    rows = I.calendar(feed(("T", "2024-01-01"), ("T", "2024-02-10"), ("U", None)), feed(("T", "2024-02-10"), ("T", "2024-02-14"), ("T", "2024-02-18"), ("V", "2024-02-01")), feed(("x", "2024-01-15")).select("date").scalar())
    assert sorted((r.ticker, str(r.date), r.feed) for r in rows.collect()) == [("T", "2024-02-10", 1), ("T", "2024-02-18", 2), ("V", "2024-02-01", 2)]
