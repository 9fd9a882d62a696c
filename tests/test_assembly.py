from pyspark.sql import functions as F

from tallyloom.operators import assembly as A

KPI = "ticker string, fiscal_year int, revenue double, growth double, operating_margin double, free_cash_flow double, wacc double, fair_value double, upside double, consensus double"


def test_tiles_show_signs_units_and_leave_out_what_is_missing(spark):
    rows = spark.createDataFrame([("A", 2024, 215.9e9, 0.652, 0.6, -1.5e6, 0.0951, 1234.5, -0.25, None), ("B", 2023, 0.0, None, None, 999999.0, None, 5.0, 0.1, 12.0), ("C", None, None, None, None, None, None, None, None, None)], KPI)
    got = {}
    for r in A.kpis(rows).orderBy("ticker", "seq").collect():
        got.setdefault(r.ticker, []).append((r.label, r.value, r.caption, r.tone))
    assert got == {
        "A": [("Revenue", "USD 215.9bn", "FY2024, +65% YoY", "positive"), ("Operating margin", "60.0%", "FY2024", "neutral"), ("Free cash flow", "USD -1.5m", "FY2024", "neutral"), ("WACC", "9.5%", "Discount rate (CAPM)", "neutral"), ("Our fair value (DCF)", "USD 1,234.50", "-25% vs market", "negative")],
        "B": [("Free cash flow", "USD 999,999", "FY2023", "neutral"), ("Our fair value (DCF)", "USD 5.00", "+10% vs market", "positive"), ("Consensus target", "USD 12.00", "what the market believes", "neutral")],
    }


def test_years_stand_side_by_side_from_the_newest(spark):
    rows = spark.createDataFrame([("A", y, float(y), None if y == 2021 else 0.1) for y in (2020, 2021, 2022)], "ticker string, year int, revenue double, revenue_growth double")
    got = {r.field: (r.unit, r.y1, r.y2) for r in A.as_columns(rows, (("revenue", "money"), ("revenue_growth", "%")), 2).collect()}
    assert got == {"revenue": ("money", 2022.0, 2021.0), "revenue_growth": ("%", 0.1, None)}


def test_a_blocked_report_is_withheld(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    tickers = frame([("A",), ("B",), ("C",), ("A",)], "ticker string")
    tiles = frame([("A", 1, "x", "1", "", "neutral"), ("A", 0, "y", "2", "", "positive")], "ticker string, seq int, label string, value string, caption string, tone string")
    money = ", ".join(f"{k} double" for k, _ in A.REPORTED)
    reported = frame([("A", 2021, *[1.0] * 6), ("A", 2020, *[2.0] * 6)], f"ticker string, year int, {money}")
    forecast = frame([], "ticker string, year int, " + ", ".join(f"{k} double" for k, _ in A.FORECAST))
    prose = frame([("A", "zzz", "last"), ("A", "risks", "r"), ("A", "thesis", "t"), ("B", "thesis", "bad"), ("B", "risks", "fine")], "ticker string, section string, text string")
    findings = frame([("B", "thesis", "HIGH", "market implied", "m"), ("A", "risks", "MEDIUM", "staleness", "s"), ("B", None, "CRITICAL", "valuation", "v")], "ticker string, section string, severity string, check string, message string")
    got = {r.ticker: r for r in A.assemble(tickers, frame([("A", "BUY"), ("B", "SELL")], "ticker string, rating string"), tiles, reported, forecast, prose, findings).collect()}
    assert [s.section for s in got["A"].sections] == ["thesis", "risks", "zzz"] and (got["A"].status, got["A"].rating, got["A"].issues) == ("PASSED", "BUY", [])
    assert [k.label for k in got["A"].kpis] == ["y", "x"] and [y.year for y in got["A"].financial_table] == [2020, 2021] and got["A"].forecast_table == []
    assert (got["B"].status, got["B"].rating, got["B"].sections) == ("FAILED", None, []) and [i.severity for i in got["B"].issues] == ["CRITICAL", "HIGH"]
    assert (got["C"].status, got["C"].rating, got["C"].kpis, got["C"].sections) == ("PASSED", None, [], [])
    assert len(got) == 3


def test_amounts_have_their_unit(spark):
    rows = spark.createDataFrame([(1.25e12,), (-2.5e9,), (1e6,), (12345.0,), (0.0,), (None,)], "v double").select(A.shown(F.col("v"), "EUR").alias("s")).collect()
    assert [r.s for r in rows] == ["EUR 1.3tn", "EUR -2.5bn", "EUR 1.0m", "EUR 12,345", "EUR 0", None]
