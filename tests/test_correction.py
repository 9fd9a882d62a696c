import pytest
from pyspark.sql import functions as F

from tallyloom.operators import correction as K

FOUND = "ticker string, section string, severity string, check string, message string"


@pytest.fixture
def prose(spark):
    return spark.createDataFrame([("T", "thesis", "bad"), ("T", "risks", "fine"), ("U", "thesis", "fine")], "ticker string, section string, text string")


def drafts(spark, *rows):
    return spark.createDataFrame(list(rows), "ticker string, section string, attempt int, text string")


def checked(spark, severity="HIGH", check="market implied", calls=None):
    """A check that finds fault with every text that holds 'bad'."""

    def run(prose):
        if calls is not None:
            calls.append(sorted((r.ticker, r.section) for r in prose.collect()))
        return prose.filter("text like '%bad%'").select("ticker", "section", F.lit(severity).alias("severity"), F.lit(check).alias("check"), F.concat(F.lit("not "), "text").alias("message"))

    return run


def verdict(done, ticker="T"):
    return next((r.attempts, r.blocking, r.status) for r in K.verdicts(done).collect() if r.ticker == ticker)


def test_a_mendable_fault_is_corrected_and_only_what_changed_is_checked_again(spark, prose):
    calls = []
    done = K.correct(prose, drafts(spark, ("T", "thesis", 1, "good"), ("T", "risks", 1, "never asked for")), checked(spark, calls=calls))
    assert verdict(done) == (1, 0, "PASSED") and verdict(done, "U") == (0, 0, "PASSED")
    assert calls == [[("T", "risks"), ("T", "thesis"), ("U", "thesis")], [("T", "thesis")]]
    assert {(r.ticker, r.section): (r.text, r.attempt) for r in done.prose.collect()} == {("T", "thesis"): ("good", 1), ("T", "risks"): ("fine", 0), ("U", "thesis"): ("fine", 0)}


def test_a_fault_of_the_numbers_stays_blocked(spark, prose):
    fixed = spark.createDataFrame([("U", "CRITICAL", "consistency", "probabilities do not sum")], "ticker string, severity string, check string, message string")
    done = K.correct(prose, drafts(spark, ("T", "thesis", 1, "good"), ("U", "thesis", 1, "good")), checked(spark), fixed)
    assert verdict(done, "U") == (0, 1, "FAILED") and verdict(done) == (1, 0, "PASSED")
    only = K.correct(prose, drafts(spark, ("T", "thesis", 1, "good")), checked(spark, "CRITICAL", "consistency"))
    assert verdict(only) == (0, 1, "FAILED") and only.log.count() == 0


def test_rounds_run_out(spark, prose):
    many = drafts(spark, *(("T", "thesis", k, f"still bad {k}") for k in range(1, 6)))
    done = K.correct(prose, many, checked(spark), rounds=2)
    assert verdict(done) == (2, 1, "FAILED")
    assert [r.text for r in done.prose.collect() if r.attempt == 2] == ["still bad 2"]
    assert verdict(K.correct(prose, many, checked(spark))) == (3, 1, "FAILED")


def test_medium_faults_ask_for_nothing(spark, prose):
    calls = []
    done = K.correct(prose, drafts(spark, ("T", "thesis", 1, "good")), checked(spark, "MEDIUM", "staleness", calls))
    assert verdict(done) == (0, 0, "PASSED") and len(calls) == 1 and done.findings.count() == 1


def test_the_writer_is_told_what_was_wrong(spark, prose):
    done = K.correct(prose, drafts(spark, ("T", "thesis", 1, "bad again"), ("T", "thesis", 2, "good")), checked(spark))
    log = {r.attempt: (r.component, r.messages, r.next_attempt, r.instruction.split("\n- ")[1:]) for r in K.history_of(done).collect()}
    assert log == {1: ("thesis", ["not bad"], 2, ["not bad"]), 2: ("thesis", ["not bad again"], None, ["not bad again"])}


def test_missing_null_and_repeated_drafts(spark, prose):
    assert verdict(K.correct(prose, drafts(spark), checked(spark))) == (0, 1, "FAILED")
    done = K.correct(prose, drafts(spark, ("T", "thesis", 1, None), ("T", "thesis", 2, "good"), ("T", "thesis", 2, "good too"), ("X", "thesis", 1, "?"), (None, None, 1, "?")), checked(spark))
    assert verdict(done) == (2, 0, "PASSED") and {r.text for r in done.prose.collect() if r.attempt} == {"good"}
    assert K.verdicts(K.correct(prose.limit(0), drafts(spark), checked(spark))).count() == 0
