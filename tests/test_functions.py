from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from auditloom import functions as fn


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


def test_clean_text_treats_spellings_of_nothing_as_null(spark):
    for nothing in ("", "  ", "Unavailable", "N/A", " none ", None):
        assert one(spark, fn.clean_text("x"), nothing) is None
    assert one(spark, fn.clean_text("x"), "  Cell  ") == "Cell"


def test_split_multi_keeps_order_and_drops_blanks(spark):
    assert one(spark, fn.split_multi("x"), "Compromised Peer Review; ;Rogue Editor;") == [
        "Compromised Peer Review", "Rogue Editor",
    ]
    assert one(spark, fn.split_multi("x"), None) == []


def test_dates_in_three_spellings(spark):
    cases = {
        "4/20/2026 0:00": dt.date(2026, 4, 20), "6/24/1756 12:00:00 AM": dt.date(1756, 6, 24),
        "4/20/2026": dt.date(2026, 4, 20), " 4/20/2026 ": dt.date(2026, 4, 20), "n/a": None,
        "13/40/2020": None, "2/30/2021 0:00": None, "": None, None: None,
    }
    for text, day in cases.items():
        assert one(spark, fn.parse_date("x"), text) == day, text


def test_identifiers(spark):
    for spelled in ("10.1/AB", "https://doi.org/10.1/ab", "HTTP://DX.DOI.ORG/10.1/Ab"):
        assert one(spark, fn.normalize_doi("x"), spelled) == "10.1/ab"
    assert one(spark, fn.normalize_pubmed("x"), "0") is None
    assert one(spark, fn.normalize_pubmed("x"), " 17 ") == "17"
    assert one(spark, fn.short_id("x"), "https://example.org/W12") == "W12"
    assert one(spark, fn.short_id("x"), "https://example.org/") == ""


def test_coded_subjects(spark):
    assert one(spark, fn.subject_code("x"), "(B/T) Computer Science") == "B/T"
    assert one(spark, fn.subject_name("x"), "(B/T) Computer Science") == "Computer Science"
    assert one(spark, fn.subject_code("x"), "Biology") == ""
    assert one(spark, fn.subject_name("x"), "(PHY) ") is None


def test_numbers(spark):
    assert one(spark, fn.round_to("x", 2), 1.005, "double") == 1.0
    assert one(spark, fn.ratio(F.col("x"), F.lit(0)), 3, "bigint") is None
    days = fn.days_between(F.lit(dt.date(2020, 3, 1)), F.lit(dt.date(2020, 2, 1)))
    assert one(spark, days, 0, "int") == -29


def test_keywords_ignore_case_and_are_literal(spark):
    assert one(spark, fn.matches_any_keyword("x", ("Peer Review",)), "fake peer review ring")
    assert not one(spark, fn.matches_any_keyword("x", ("a.c",)), "abc")
