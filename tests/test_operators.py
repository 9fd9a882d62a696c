import datetime as dt
from collections import deque

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyloom.functions import exprs as X
from tallyloom.functions import text as T
from tallyloom.operators import chat, documents, ingest, qa, search
from tallyloom.operators import valuation as V
from tallyloom.streaming import limits


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def worked_dcf(**k):
    given_ = dict(revenue=1000.0, growth=[0.1, 0.1], margin=[0.2, 0.2], tax=0.25, depreciation=0.05, capex=0.05, working_capital=0.0, wacc=0.10, terminal_growth=0.02, net_debt=0.0, shares=100.0) | k
    return X.dcf(**{n: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v) for n, v in given_.items()})


def test_dcf_by_hand(spark):
    x = value(spark, worked_dcf())
    assert x.pv_forecast == pytest.approx(300) and x.terminal_value == pytest.approx(2314.125) and x.fair_value == pytest.approx(22.125)
    assert value(spark, worked_dcf(terminal_growth=0.1)) is None and value(spark, worked_dcf(revenue=0.0)) is None and value(spark, worked_dcf(margin=[0.2])) is None
    assert value(spark, worked_dcf(shares=0.0)).fair_value == 0.0
    assert value(spark, worked_dcf(net_debt=100.0)).fair_value == pytest.approx(21.125)


def test_paths(spark):
    assert value(spark, X.decay_path(F.lit(0.4), F.lit(0.02), 3, F.lit(0.5))) == pytest.approx([0.4, 0.21, 0.115])
    assert value(spark, X.fade_path(F.lit(0.1), F.lit(0.3), 3)) == pytest.approx([0.1, 0.2, 0.3])
    assert value(spark, X.fade_path(F.lit(0.1), F.lit(0.3), 1)) == [0.3] and value(spark, X.fade_path(F.lit(0.1), F.lit(0.3), 0)) == []
    assert value(spark, X.compound(F.array(F.lit(-1.5), F.lit(1.0)))) == -1.0


def test_guards(spark):
    assert value(spark, X.clamp(F.lit(None).cast("double"), 0, 1)) is None and value(spark, X.clamp(F.lit(7.0), 0, 1)) == 1
    assert value(spark, X.effective_tax(F.lit(70.0), F.lit(100.0))) is None and value(spark, X.effective_tax(F.lit(20.0), F.lit(100.0))) == 0.2
    assert value(spark, X.gross_margin(F.lit(None).cast("double"), F.lit(10.0), F.lit(4.0))) == 0.6 and value(spark, X.ratio(F.lit(1.0), F.lit(0.0))) is None
    assert value(spark, X.percent(F.lit(12.3))) == pytest.approx(0.125) and value(spark, X.number(F.lit("nan"))) is None and value(spark, X.number(F.lit("x"))) is None
    assert [value(spark, X.rating(F.lit(u))) for u in (0.15, -0.10, -0.2)] == ["BUY", "HOLD", "SELL"]
    assert value(spark, X.money(F.lit(2.5e9), F.lit("USD"))) == "USD 2.50bn"


@settings(max_examples=8, deadline=None)
@given(st.floats(0.01, 2.0))
def test_bisect_inverts(spark, x):
    found = value(spark, X.bisect(lambda m: m * m * m, F.lit(x**3), F.lit(0.0), F.lit(3.0), 30))
    assert found == pytest.approx(x, abs=1e-6)
    assert value(spark, X.bisect(lambda m: -m, F.lit(-x), F.lit(0.0), F.lit(3.0), 30)) == pytest.approx(x, abs=1e-6)
    assert value(spark, X.bisect(lambda m: m, F.lit(9.0), F.lit(0.0), F.lit(3.0), 5)) is None


def test_blend_drops_outliers(spark):
    rows = spark.createDataFrame([("a", v, 1.0) for v in (100.0, 110.0, 900.0)] + [("b", 10.0, 1.0), ("b", 900.0, 3.0), ("c", -1.0, 1.0)], "ticker string, value double, weight double")
    got = {r.ticker: r for r in V.blend(rows).collect()}
    assert got["a"].blended == 105 and got["a"].n_included == 2 and got["b"].blended == pytest.approx(677.5) and "c" not in got


def test_text(spark):
    assert value(spark, T.tokens(F.lit("Revenue: $1,200.5 up 12%, (10-K). a/"))) == ["revenue", "1,200.5", "up", "12%", "10-k", "a"]
    assert value(spark, T.amounts(F.lit("$1.5 billion and $2,000"))) == [1.5e9, 2000.0]
    assert value(spark, T.year_month(F.lit("Mar 2024"))) == 2024 * 12 + 2 == value(spark, T.year_month(F.lit("2024-03")))
    assert value(spark, chat.normal_markers(F.lit("x [SOURCE 1, 4] y [2; 3]"))) == "x [1][4] y [2][3]"


def test_figures_in_text(spark):
    text = "Sales of US$216 billion, ₹1,200.5 mn and €3 were up 12.5%; 5 Billion units, 40 people, £7k in 2024 (5 m tall)."
    assert value(spark, T.amounts(F.lit(text))) == [216e9, 1200.5e6, 3.0, 5e9, 7000.0]
    got = value(spark, T.located(F.lit(text), 10))
    assert [(x.kind, x.figure) for x in got][:4] == [("money", "US$216 billion"), ("money", "₹1,200.5 mn"), ("money", "€3"), ("percent", "12.5%")]
    assert [x.context for x in got][:2] == ["Sales of US$216 billion, ₹1,200.5…", "…billion, ₹1,200.5 mn and €3 we…"]
    assert value(spark, T.located(F.lit(""))) == [] == value(spark, T.amounts(F.lit("no figures"))) and value(spark, T.located(F.lit(None).cast("string"))) is None
    assert len(value(spark, T.located(F.lit("$1 of 2% " * 2000)))) == 4000


def test_risk_direction_by_stems(spark):
    wrong = ["It could reduce growth from our 13.3% base toward market-implied 25.3%.", "Costs lift the margin from 20% to 15%.", "Delays may raise our fair value.", "Prices slow sales from 4% to 4.2%."]
    right = ["It could reduce growth from 13% to 9%.", "Costs lift the margin from 15% to 20%.", "Delays raise richer valuation multiples.", "Moves from 5% to 9%.", "It falls from 5% to 5.04%.", ""]
    p = spark.createDataFrame([(x, x) for x in wrong + right] + [("none", None)], "ticker string, text string")
    assert {r.ticker for r in qa.risk_direction(p).collect()} == set(wrong)


def test_annualised_claims(spark):
    rows = [("a", "Flat year. The $81.6 billion quarter annualizes to a 151% increase over FY2026."), ("b", "$10 bn annualised is 5% growth."), ("c", "Annualized, 5% growth over 2024."), ("d", "We took $2bn and $3bn, annualised 12% above last-year sales."), ("e", None)]
    got = {r.ticker: (r.quarter, r.claimed_growth) for r in qa.annualised_claims(spark.createDataFrame(rows, "ticker string, text string")).collect()}
    assert got == {"a": (pytest.approx(81.6e9), pytest.approx(1.51)), "d": (3e9, pytest.approx(0.12))}


def test_collapse_is_anchored(spark):
    days = [dt.date(2024, 1, d) for d in (1, 6, 9, 16)]
    assert value(spark, ingest.collapse_dates(F.array(*map(F.lit, days)))) == [days[0], days[2]]


def test_fiscal_period(spark):
    def period(form, date, end):
        y, p = ingest.fiscal_period(F.lit(form), F.lit(date), F.lit(end))
        return value(spark, F.struct(y.alias("y"), p.alias("p")))

    assert tuple(period("10-Q", "2026-04-26", "0125")) == (2027, "Q1") and tuple(period("10-K", "2025-12-31", "1231")) == (2025, "FY")
    assert tuple(period("8-K", "2025-01-15", None)) == (2024, "Q4") and tuple(period("10-Q", "2025", "1231")) == (None, None)


def test_fusion_ignores_list_order(spark):
    rows = [(1, "a", 1.0, d, r) for r, d in enumerate((5, 6, 7), 1)] + [(1, "b", 1.0, d, r) for r, d in enumerate((7, 5), 1)]
    make = lambda x: {r.chunk_id: r.score for r in search.fuse(spark.createDataFrame(x, "query_id long, list string, weight double, chunk_id long, rank int")).collect()}
    got = make(rows)
    assert got == pytest.approx(make(rows[::-1])) and got[5] == pytest.approx(1 / 61 + 1 / 62) and max(got, key=got.get) == 5


def test_checks_are_silent_or_speak(spark):
    rows = [("good", "Margin falls from 30% to 25%. FY2030 will be strong [1]."), ("bad", "Margin falls from 20% to 25%. The quarter is annualised. We expect FY2020 growth [9].")]
    p = spark.createDataFrame([(t, x, 2, 2) for t, x in rows], "ticker string, text string, n_evidence int, n_paragraphs int")
    last = spark.createDataFrame([("good", 2024), ("bad", 2024)], "ticker string, fiscal_year int")
    for found in (qa.risk_direction(p), qa.quarterly_annualised(p), qa.stale_forward(p, last), qa.dangling_citations(p)):
        assert {r.ticker for r in found.collect()} == {"bad"}


def test_tolerance_joins(spark):
    f = spark.createDataFrame([("a", 10.59), ("a", 10.61), ("a", -3.0)], "ticker string, value double")
    k = spark.createDataFrame([("a", 10.0), ("a", 10.0), ("a", -2.5)], "ticker string, value double")
    assert {r.value: r.traced for r in qa.traced_percents(f, k).collect()} == {10.59: True, 10.61: False, -3.0: True}
    m = spark.createDataFrame([("a", 101.9), ("a", 97.9), ("a", 103.0), ("a", 0.0)], "ticker string, value double")
    assert {r.value: r.traced for r in qa.traced_amounts(m, spark.createDataFrame([("a", 100.0)], "ticker string, value double")).collect()} == {101.9: True, 97.9: False, 103.0: False, 0.0: False}


def test_html_and_chunks():
    page = "<html><head><title>x</title></head><h1>Item 1</h1><p>One<p>two <b>bold<table><tr><th><th>2024<tr><td>Rev<td>$<td>5</table><hr><h2>Next</h2><p>three"
    got = documents.blocks_of(page)
    assert [b[0] for b in got] == ["heading", "text", "text", "table", "heading", "text"] and got[-1][2:] == (2, "Next")
    assert documents.markdown([["a", "b"]]) is None and "| Rev | $5 |" in documents.markdown([["", "2024"], ["Rev", "$", "5"]])
    blocks = [("text", " ".join(["w"] * 80), 1, "s")] * 20
    made = documents.chunk_blocks(blocks)
    assert all(c[4] <= 600 for c in made) and len(made) > 2 and documents.chunk_blocks([("text", "few words", 1, None)]) == []


def test_long_tables_are_split_by_rows():
    head, rows = ["| a | b |", "| --- | --- |"], [f"| row {k} | {k * 7} |" for k in range(400)]
    made = documents.chunk_blocks([("table", "\n".join(head + rows), 3, "s"), ("table", "\n".join(head + rows[:2]), 4, None)])
    parts = [body.split("\n") for _, body, *_ in made]
    assert all(p[:2] == head for p in parts) and [r for p in parts for r in p[2:]] == rows + rows[:2] and all(n <= 600 for *_, n in made)
    assert [m[2:4] for m in made][-2:] == [(3, "s"), (4, None)] and len(made) > 3
    assert documents.split_table("\n".join(head + ["| " + "x " * 900 + "|"]), 600, documents.word_count) == ["\n".join(head + ["| " + "x " * 900 + "|"])]


def test_chunks_by_a_tokenizer(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    made = Tokenizer(models.BPE(vocab={x: k for k, x in enumerate("abcdefghij")}, merges=[]))
    made.pre_tokenizer = pre_tokenizers.Whitespace()
    import tempfile

    path = tempfile.mkdtemp() + "/t.json"
    made.save(path)
    docs = spark.createDataFrame([(1, "<p>" + "abc def. " * 400 + "</p>"), (2, None), (3, "")], "doc_id long, html string")
    got = documents.chunks(docs, tokenizer=path).collect()
    assert {r.doc_id for r in got} == {1} and all(80 <= r.tokens <= 600 for r in got) and sum(r.tokens for r in got) >= 2400
    assert len(documents.chunks(docs).collect()) < len(got)


def test_refused_events_do_not_count():
    assert limits.accept([0, 1, 2, 3600, 3601], deque(), 2, 3600.0) == [True, True, False, True, True]


def test_session_stream_equals_batch(spark, tmp_path):
    rows = [(k, k % 3, "a", float(1000 + k * 200)) for k in range(60)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, action string, at double")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = limits.session_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), 2)
    q = stream.writeStream.format("memory").queryName("accepted_events").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.event_id: r.accepted for r in spark.sql("select * from accepted_events").collect()}
    assert got == {r.event_id: r.accepted for r in limits.session_limit(events, 2).collect()} and not all(got.values())
