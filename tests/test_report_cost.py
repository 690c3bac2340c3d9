"""Work that the full check report does once, or spread over all cores, with the same rows as before."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from auditloom import functions as fn
from auditloom.functions import text
from auditloom.functions.dates import DATE_SHAPE
from auditloom.operators import pairs, persisting
from auditloom.plans import marts
from auditloom.retail import frames as f

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(5)
    signs = [" ", " ", " ", " ", "　", "(", ")", "(", ")", "a", "B", "é", "\U0001f600", "\n", "\t", "\x0b", ";", ";", "\x00", "​"]
    rows = [None, "", " ", "()", "(a)", "(a) ", "(a)b", "(\n)x", "((a)b)", "(a", "(é)  x", "(é)\t\n x", " (a)"]
    rows += ["".join(rng.choice(signs) for _ in range(rng.randrange(9))) for _ in range(5000)]
    days = [f"{m}/{d}/{y}" for y in ("0000", "0001", "1582", "1900", "2020", "2021", "9999") for m in ("0", "1", "02", "2", "12", "13")
            for d in ("0", "1", "09", "28", "29", "30", "31", "32")]
    days += [d + s for d in days[::5] for s in (" 0:00", " 12:00:00 AM", " 25:00", "x", " 13:00:00 PM", "  ")]
    return spark.createDataFrame([(x,) for x in rows + days + ["2020-01-01", "1/1/20", "+1/1/2020"]], "x string")


def test_cheaper_expressions_give_the_same_values(odd):
    """Against the expressions that handle every row the long way."""
    x = F.col("x")
    trimmed = F.btrim(x, F.lit(text.SPACES))
    parts = F.transform(F.split(F.coalesce(x, F.lit("")), "\\Q;\\E"), lambda part: F.btrim(part, F.lit(text.SPACES)))
    long_way = {
        text.trim_spaces: trimmed, text.split_multi: F.filter(parts, lambda part: part != ""),
        text.subject_code: F.regexp_extract(x, r"^\(([^)]+)\)", 1),
        text.subject_name: F.nullif(F.regexp_replace(x, r"^\([^)]+\)\s*", ""), F.lit("")),
        fn.parse_date: F.to_date(F.when(
            trimmed.rlike(DATE_SHAPE), F.try_to_timestamp(F.substring_index(trimmed, " ", 1), F.lit("M/d/yyyy")))),
    }
    for short, want in long_way.items():
        differ = odd.filter(~short("x").eqNullSafe(want)).select("x", short("x").cast("string"), want.cast("string"))
        assert odd.filter(want.isNotNull()).count() > 50 and differ.limit(5).collect() == [], short.__name__


def test_text_is_not_matched_where_plain_functions_do(odd):
    plan = plan_of(odd.select(text.split_multi("x"), text.subject_code("x"), text.subject_name("x"), fn.parse_date("x")))
    assert "\\Q" not in plan and "regexp_" not in plan and "gettimestamp" not in plan
    for separator in (";", "|", ".", "\\", "-", "a", "ab", "^"):
        got = odd.limit(1).select(text.split_multi(F.lit(separator.join(["one", "two", "x1"])), separator)).first()[0]
        assert got == ["one", "two", "x1"]


def test_works_of_a_small_file_are_built_on_all_cores(spark):
    wide = f.landed_works(spark, SF)
    assert wide.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert wide.count() == f.table(spark, SF, "part").count()


def test_edges_read_enriched_records_that_are_written_already(spark, monkeypatch):
    monkeypatch.setattr(f, "_WRITTEN", {})
    with f.one_version(spark, SF):
        built = f.works_of_orders(spark, SF)
        f.enriched(spark, SF)
        read = f.works_of_orders(spark, SF)
    assert "lineitem" in plan_of(built) and "lineitem" not in plan_of(read)
    assert read.dtypes == built.dtypes and read.exceptAll(built).isEmpty() and built.exceptAll(read).isEmpty()


def test_meetings_deal_the_members_out_once(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (3, "z"), (None, "a"), (4, None)], "g long, i string")
    counted = pairs._count_meetings(rows, "g", "i")
    assert counted.first()[0] == 1 + 3
    assert plan_of(counted).count("Exchange hashpartitioning") == 1


def test_leaderboard_counts_a_record_once_and_reads_countries_once(spark):
    countries = spark.createDataFrame(
        [(1, "x"), (1, "x"), (1, "y"), (2, "x"), (3, "x"), (4, "y"), (9, "x"), (5, None)], "record_id long, country string")
    facts = spark.createDataFrame(
        [(1, "j", 2000, 10, False, True, False, False, 2), (2, "j", 2001, 30, True, False, False, False, 1),
         (3, None, None, None, True, False, False, False, 0), (4, "k", 2001, 7, True, False, True, False, 3),
         (5, "k", 2001, 7, True, False, False, True, 4)],
        "record_id long, journal string, retraction_year long, retraction_latency_days long, is_international boolean, "
        "is_paper_mill boolean, is_peer_review_fraud boolean, is_ai_generated boolean, n_authors long")
    board = marts.country_leaderboard(countries, facts)
    rows = {r["country"]: r for r in board.collect()}
    x, y, unknown = rows["x"], rows["y"], rows[None]
    assert (x["n_retractions"], x["n_paper_mill"], x["n_journals"], x["active_years"]) == (3, 2, 1, 2)
    assert (x["first_retraction_year"], x["last_retraction_year"], x["median_latency_days"], x["n_as_sole_country"]) == (2000, 2001, 10.0, 1)
    assert (y["n_retractions"], y["n_journals"], y["active_years"], y["n_peer_review_fraud"]) == (2, 2, 2, 1)
    assert (unknown["n_retractions"], unknown["n_ai_generated"], unknown["active_years"]) == (1, 1, 1)
    assert "Expand" not in plan_of(board)


def test_tables_are_written_with_code_that_the_jvm_compiles(spark, monkeypatch):
    before, seen = spark.conf.get(persisting.METHOD_SETTING), []
    kind = type(spark.range(1).write)
    write = kind.parquet
    monkeypatch.setattr(kind, "parquet", lambda self, path: (seen.append(spark.conf.get(persisting.METHOD_SETTING)), write(self, path)))
    assert persisting.materialize(spark.range(3), "rows").count() == 3
    assert seen == ["8000"] and spark.conf.get(persisting.METHOD_SETTING) == before
    spark.conf.set(persisting.METHOD_SETTING, "4000")
    try:
        persisting.materialize(spark.range(3), "rows")
        assert seen[1:] == ["4000"] and spark.conf.get(persisting.METHOD_SETTING) == "4000"
    finally:
        spark.conf.set(persisting.METHOD_SETTING, before)
