"""Registered queries against their SQL. AUDITLOOM_ALL=1 runs every key, otherwise the quick ones."""

from __future__ import annotations

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import connect, differences

SF = os.environ.get("AUDITLOOM_SF", "/root/testdata/sf0.001")
QUICK = (
    "parse_date_multi", "split_multi", "stg_records", "stg_works", "explode_values", "explode_positions",
    "explode_structs_pos", "explode_nested2", "explode_primary_flag", "records_enriched", "group_profile",
    "author_activity", "country_leaderboard", "reason_landscape", "trend_yoy", "risk_scores", "feature_auc",
    "average_rank", "event_study_by_group", "pair_edges", "cluster_scores", "qc_dates", "qc_ranges", "load_audit",
    "null_rates", "latency_histogram", "scan_csv_records", "scan_json_pages", "incremental_load",
)
CHOSEN = sorted(oracle_sql()) if os.environ.get("AUDITLOOM_ALL") else QUICK


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", CHOSEN)
def test_matches_sql(spark, con, name):
    assert differences(queries()[name](spark, SF), con, oracle_sql()[name]) == []


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry_has_rows(spark):
    assert entry(spark).count() > 0
