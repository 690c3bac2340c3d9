from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from auditloom.plans import quality as q

AS_OF = dt.date(2026, 1, 1)


def run(spark, tables, checks):
    return {r["check_name"]: r for r in q.run_checks(tables, checks).collect()}


@pytest.fixture(scope="module")
def t(spark):
    return spark.createDataFrame([(1,), (2,), (2,), (3,)], "id int")


def test_pass_fail_error_and_severity(spark, t):
    checks = [
        q.row_check("not null", "t", q.null_keys("id")),
        q.row_check("unique", "t", q.repeated_keys("id")),
        q.row_check("small", "t", q.violating(lambda: F.col("id") > 1), "warning"),
        q.row_check("broken", "t", q.null_keys("nope"), "warning"),
        q.frame_check("absent", ("t", "gone"), q.orphans("id")),
        q.row_check("empty aggregate", "t", lambda: F.max(F.when(F.col("id") > 9, F.col("id")))),
    ]
    report = q.run_checks({"t": t}, checks)
    rows = {r["check_name"]: r for r in report.collect()}
    assert [rows[c.name]["status"] for c in checks] == [
        "passed", "failed_error", "failed_warning", "errored", "errored", "passed",
    ]
    assert [rows[c.name]["violations"] for c in checks] == [0, 1, 3, 0, 0, 0]
    assert [rows[c.name]["blocks_release"] for c in checks] == [False, True, False, True, True, False]
    assert "gone" in rows["absent"]["execution_error"]
    assert q.summarize(report).first().asDict() == {
        "total": 6, "passed": 2, "errored": 2, "failed_error": 1, "failed_warning": 1,
    }
    assert q.has_blocking_failure(report)


def test_only_errored_checks_still_give_a_report(spark, t):
    rows = run(spark, {"t": t}, [q.row_check("broken", "t", q.null_keys("nope"))])
    assert rows["broken"]["status"] == "errored"


def test_standard_set_is_well_formed():
    checks = q.standard_checks(AS_OF)
    assert len(checks) == 38 and len({c.name for c in checks}) == 38
    assert all(c.rationale for c in checks)
    assert q.missing_tables({"records": None}, checks[:9]) == ["record_reasons"]
    with pytest.raises(ValueError):
        q.Check("x", ("t",), q.null_keys("id"), "fatal")


def test_each_shape_finds_a_planted_violation(spark):
    records = spark.createDataFrame([
        (1, dt.date(2020, 1, 1), dt.date(2021, 1, 1), "Odd", "10.1/a"),
        (None, dt.date(2030, 1, 1), None, "Retraction", None),
        (3, dt.date(1756, 6, 24), None, "Correction", None),
        (3, None, None, None, None),
    ], "record_id bigint, retraction_date date, original_paper_date date, retraction_nature string, original_paper_doi string")
    tables = {
        "records": records,
        "record_reasons": spark.createDataFrame([(1, " "), (8, "x")], "record_id bigint, reason string"),
        "record_countries": spark.createDataFrame([(9, "x"), (9, "y")], "record_id bigint, country string"),
        "record_authors": spark.createDataFrame([(1, 1, "a"), (77, 3, "b")], "record_id bigint, author_position bigint, author_name string"),
        "journal_profile": spark.createDataFrame(
            [("j", 9, 12, 1.3, 2.0, 0.0, 0.0, 0.0)],
            "journal string, n_retractions bigint, peak_year_retractions bigint, burst_ratio double, paper_mill_share double, "
            "peer_review_fraud_share double, ai_generated_share double, china_share double"),
        "journal_risk": spark.createDataFrame([(101.0,), (1.0,)], "risk_score double"),
        "country_leaderboard": spark.createDataFrame([(120.0, 3, 2)], "share_of_global_pct double, n_as_sole_country bigint, n_retractions bigint"),
        "retraction_trends": spark.createDataFrame([(2020, 5, 5), (2021, 1, 7)], "year bigint, n_retractions bigint, cumulative_retractions bigint"),
        "records_enriched": spark.createDataFrame([(2020,)], "retraction_year bigint"),
        "feature_discriminative_power": spark.createDataFrame([(1.0008,)], "auc double"),
        "risk_score_validation": spark.createDataFrame([("structural_score（结构分，无标签特征 → 可信）", 0.4)], "score_name string, auc double"),
        "risk_tier_performance": spark.createDataFrame([(80.0, 0.1), (40.0, 0.3)], "min_score double, precision_rate double"),
        "works": spark.createDataFrame([("W1", "10.1/z", 2), ("W1", None, 0)], "work_id string, doi string, n_authors bigint"),
        "work_authorships": spark.createDataFrame([("W1",)], "work_id string"),
        "work_citations": spark.createDataFrame([(-1,), (1,)], "years_since_publication int"),
        "works_enriched": spark.createDataFrame([(False,), (False,), (True,)], "matched_in_records boolean"),
        "event_study": spark.createDataFrame([(1,), (2,)], "n_works bigint"),
        "penalty_summary": spark.createDataFrame([(-0.9,)], "mean_gap_before_retraction double"),
        "author_clusters": spark.createDataFrame([("c", 3, 1.0)], "cluster_id string, n_authors bigint, density double"),
        "author_cluster_members": spark.createDataFrame([("d",)], "cluster_id string"),
        "author_cluster_validation": spark.createDataFrame([(0.3,)], "auc double"),
    }
    found = run(spark, tables, q.standard_checks(AS_OF))
    silent = {name for name, row in found.items() if row["violations"] == 0}
    assert all(row["execution_error"] is None for row in found.values())
    assert silent == {"records fresh"}


def test_an_error_at_run_time_marks_one_check(spark, t):
    broken = q.row_check("broken", "t", lambda: F.max(F.raise_error(F.lit("no such value")).cast("bigint")))
    fine = q.row_check("fine", "t", lambda: F.count(F.lit(1)))
    found = run(spark, {"t": t}, [broken, fine])
    assert found["broken"]["status"] == "errored" and found["broken"]["execution_error"]
    assert found["fine"]["violations"] == t.count() and found["fine"]["execution_error"] is None
