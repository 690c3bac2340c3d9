from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from auditloom.operators import aggregates
from auditloom.plans import build, enriched, events, marts, network, profiling, quality, serving
from tests.test_sources import author, record_lines, works, write_csv, write_pages

PANEL_WORK = (
    "work_id string, publication_year int, retraction_year bigint, is_paper_mill boolean, is_peer_review_fraud boolean, "
    "is_ai_generated boolean, field string, domain string, cited_by_count bigint, n_authors bigint"
)


def test_panel_is_balanced_and_zero_filled(spark):
    linked = spark.createDataFrame([
        ("old", 2010, 2015, True, False, False, "f", "d", 9, 1),
        ("young", 2013, 2015, True, False, False, "f", "d", 9, 1),
        ("late", 2010, 2025, False, False, False, "f", "d", 9, 1),
    ], PANEL_WORK)
    citations = spark.createDataFrame(
        [("old", 2014, 3), ("old", 2014, 2), ("old", 2016, 0)], "work_id string, citation_year int, cited_by_count bigint"
    )
    rows = enriched.event_panel(linked, citations, last_full_year=2025).orderBy("event_time").collect()
    assert [(r["work_id"], r["event_time"], r["cited_by_count"], r["has_observed_data"]) for r in rows] == [
        ("old", -3, 0, False), ("old", -2, 0, False), ("old", -1, 5, True), ("old", 0, 0, False),
        ("old", 1, 0, True), ("old", 2, 0, False),
    ]


def panel(spark, means):
    rows = [(f"w{i}", t, value, True, i == 0) for t, values in means.items() for i, value in enumerate(values)]
    return spark.createDataFrame(rows, "work_id string, event_time bigint, cited_by_count bigint, has_observed_data boolean, is_paper_mill boolean")


def test_event_study_gap_against_the_line(spark):
    study = events.event_study(panel(spark, {-3: (1, 3), -2: (2, 4), -1: (3, 5), 0: (1, 1), 1: (0, 1), 2: (0, 0)}))
    rows = {r["event_time"]: r for r in study.collect()}
    assert (rows[0]["pre_trend_slope"], rows[0]["pre_trend_intercept"]) == (1.0, 5.0)
    assert (rows[0]["citation_gap"], rows[0]["citation_gap_pct"]) == (-4.0, -80.0)
    assert rows[2]["counterfactual_citations"] == 7.0
    summary = events.penalty_summary(study).first()
    assert summary["n_post_periods"] == 3 and summary["mean_gap_before_retraction"] == 0.0
    assert events.event_extremes(study).first()["worst_event_time"] == 2
    groups = events.event_study_by_group(panel(spark, {-3: (1, 3), -2: (2, 4), -1: (3, 5), 0: (1, 1)}))
    assert groups.count() == 8


def test_group_without_a_past_drops_out(spark):
    assert events.event_study_by_group(panel(spark, {0: (1, 1), 1: (2, 2)})).count() == 0


def test_lift_and_zero_base_rate(spark):
    schema = "structural_score double, n_paper_mill bigint"
    rows = [(90.0, 1), (85.0, 0), (10.0, 0), (5.0, 0)]
    tiers = {r["structural_tier"]: r for r in marts.risk_tier_performance(spark.createDataFrame(rows, schema)).collect()}
    assert (tiers["1_极高"]["precision_rate"], tiers["1_极高"]["lift"]) == (0.5, 2.0)
    none = marts.risk_tier_performance(spark.createDataFrame([(90.0, 0)], schema)).first()
    assert none["lift"] is None


def test_severity_tier_uses_the_unrounded_score():
    assert [c for c, _ in marts.v.SEVERITY_TIERS] == [85, 70, 50]
    assert abs(sum(marts.v.SEVERITY_WEIGHTS.values()) - 1) < 1e-12


def test_percent_rank_keeps_null_last(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 3.0)], "k string, x double")
    got = {r["k"]: r["pr_x"] for r in marts.percent_ranks(df, "k", {"x": "x"}).collect()}
    assert got == {"a": 0.0, "c": 0.5, "b": 1.0}


def test_trend_gap_years_and_zero_division(spark):
    df = spark.createDataFrame([(2000, 4), (2001, 6), (2003, 3)], "year bigint, n bigint")
    rows = marts.with_period_changes(df, "year", "n", {
        "previous": "p", "change": "c", "change_pct": "cp", "cumulative": "cum", "moving_mean": "m"}).orderBy("year").collect()
    assert [tuple(r)[2:] for r in rows] == [(None, None, None, 4, 4.0), (4, 2, 50.0, 10, 5.0), (6, -3, -50.0, 13, 4.3)]


def test_histogram_last_bin_holds_the_maximum(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 5, 10)], "x double")
    rows = {r["bin"]: r["n"] for r in aggregates.histogram(df, F.col("x"), 10).collect()}
    assert rows == {0: 1, 1: 1, 5: 1, 9: 1}
    constant = aggregates.histogram(df.filter("x = 5"), F.col("x"), 10).first()
    assert (constant["bin"], constant["n"]) == (0, 1)


def edges(spark, rows):
    return spark.createDataFrame(
        rows, "author_a string, author_b string, n_shared_works bigint, n_shared_paper_mill bigint, n_journals bigint, "
              "n_fields bigint, first_year bigint, last_year bigint")


def test_cluster_profile_and_scores(spark):
    rows = [(a, b, 2, 1, 2, 1, 2010, 2012) for a, b in (("a", "b"), ("a", "c"), ("b", "c"))]
    rows += [("k", "l", 4, 0, 0, 0, None, None), ("l", "m", 2, 0, 0, 0, None, None), ("x", "y", 9, 0, 1, 1, 2000, 2001)]
    df = edges(spark, rows)
    membership = network.component_membership(df)
    profile = network.cluster_profile(df, membership)
    got = {r["cluster_id"]: r for r in network.cluster_scores(profile).collect()}
    assert set(got) == {"a", "k"}
    assert (got["a"]["density"], got["a"]["year_span"], got["a"]["works_per_author_year"]) == (1.0, 3, 0.667)
    assert got["k"]["works_per_author_year"] is None and got["k"]["pr_works_per_author_year"] == 0.5
    assert got["k"]["field_journal_ratio"] is None and got["k"]["pr_field_journal_ratio"] == 0.5
    scores = network.cluster_scores(profile)
    assert {r["auc"] for r in network.cluster_auc(scores).collect()} == {1.0}
    only_one_class = network.cluster_auc(scores.filter("cluster_id = 'k'"))
    assert only_one_class.count() == 0
    with pytest.raises(ValueError):
        serving.author_clusters(scores, order_by="density; DROP")
    assert serving.author_clusters(scores).first()["cluster_id"] == "a"


def test_catalogue(spark):
    tables = {"t": spark.createDataFrame([(1, "x")], "id int, name string"), "u": spark.range(3)}
    profile = profiling.table_profile(tables)
    assert {(r["table_name"], r["column_name"], r["n_rows"]) for r in profile.collect()} == {
        ("t", "id", 1), ("t", "name", 1), ("u", "id", 3),
    }
    described = spark.createDataFrame([("id", "key")], "column_name string, description string")
    covered = profiling.documentation_coverage(profile, described)
    assert {r["table_name"]: r["coverage_pct"] for r in covered.collect()} == {"t": 50.0, "u": 100.0}


def test_whole_build_from_files(spark, tmp_path):
    pages = tmp_path / "pages"
    pages.mkdir()
    more = [
        {"id": f"https://example.org/X{n}", "doi": f"10.1/x{n}", "publication_year": 2015,
         "counts_by_year": [{"year": 2019, "cited_by_count": n}],
         "authorships": [author(50, "x"), author(51), author(52 + n % 2)]} for n in range(4)
    ]
    glob = write_pages(pages, works(), more)
    root = str(tmp_path / "warehouse")
    when = dt.datetime(2026, 1, 1)
    tables = build.build_warehouse(spark, write_csv(tmp_path, record_lines()), glob, root, when)
    facts = {r["record_id"]: r for r in tables["records_enriched"].collect()}
    first, second = facts[1], facts[2]
    assert first["is_paper_mill"] and first["is_rogue_editor"] and not second["is_paper_mill"]
    assert (first["n_countries"], second["n_countries"], first["last_author"]) == (2, 0, "Wu Y")
    assert first["involves_china"] and first["subject_code"] == "B/T" and first["n_institutions"] == 2
    linked = {r["work_id"]: r for r in tables["works_enriched"].collect()}
    assert linked["W1"]["n_records"] == 2 and linked["W1"]["is_paper_mill"] and "W2" not in linked
    assert tables["event_panel"].count() == 6
    pairs = {(r["author_a"], r["author_b"]): r["n_shared_works"] for r in tables["coauthor_edges"].collect()}
    assert pairs == {("A50", "A51"): 4, ("A50", "A52"): 2, ("A50", "A53"): 2, ("A51", "A52"): 2, ("A51", "A53"): 2}
    assert {r["author_id"] for r in tables["author_cluster_members"].collect()} == {"A50", "A51", "A52", "A53"}
    report = build.check_warehouse(tables, dt.date(2026, 1, 1), f"{root}/report")
    rows = {r["check_name"]: r for r in report.collect()}
    assert len(rows) == 38 and all(r["execution_error"] is None for r in rows.values())
    assert rows["record key not null"]["violations"] == 1 and rows["enough works"]["status"] == "failed_error"
    assert quality.has_blocking_failure(report)
