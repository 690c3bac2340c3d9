"""Read queries over the built tables: parameters in, a lazy frame out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions import count_where, matches_any_keyword
from auditloom.plans import vocabulary as v
from auditloom.plans.events import match_rate_by_year as cross_source_gap
from auditloom.plans.network import density_by_size

__all__ = [
    "author_clusters", "cluster_members", "country_leaderboard", "cross_source_gap", "density_by_size",
    "event_study", "event_study_by_group", "feature_power", "journal_risk", "latency_by_year",
    "overview_metrics", "penalty_summary", "reason_landscape", "risk_map", "risk_tier_performance",
    "risk_validation", "top_reasons", "trends", "worst_journals_by_share",
]


def overview_metrics(
    records: DataFrame, works: DataFrame, works_enriched: DataFrame, enriched: DataFrame,
    risk: DataFrame, clusters: DataFrame, countries: DataFrame,
) -> DataFrame:
    """Headline counts in one row."""
    parts = [
        works.agg(F.count(F.lit(1)).alias("works")),
        works_enriched.agg(
            F.count(F.lit(1)).alias("linked_works"), count_where(F.col("matched_in_records")).alias("matched")
        ),
        enriched.agg(count_where(F.col("is_paper_mill")).alias("paper_mill")),
        risk.agg(F.count(F.lit(1)).alias("scored_journals")),
        clusters.agg(F.count(F.lit(1)).alias("clusters")),
        countries.agg(F.count_distinct("country").alias("countries")),
    ]
    row = records.agg(F.count(F.lit(1)).alias("records"), F.count_distinct("journal").alias("journals"))
    for part in parts:
        row = row.crossJoin(F.broadcast(part))
    return row


def trends(table: DataFrame, first_year: int = 1990, last_year: int = 2030) -> DataFrame:
    return table.filter(F.col("year").between(first_year, last_year)).select(
        "year", "n_retractions", "n_paper_mill", "n_peer_review_fraud", "n_ai_generated",
        "paper_mill_share", "median_latency_days", "ma3_retractions", "yoy_change_pct",
        "cumulative_retractions",
    ).orderBy("year")


def country_leaderboard(table: DataFrame, limit: int = 30) -> DataFrame:
    return table.orderBy(F.desc("n_retractions"), F.asc("country")).limit(limit).select(
        "country", "n_retractions", "n_as_sole_country", "n_cooperative", "share_of_global_pct",
        "n_paper_mill", "paper_mill_share", "peer_review_fraud_share", "ai_generated_share",
        "median_latency_days", "n_recent_5y", "active_years", "n_journals", "rank_by_volume",
    )


def reason_landscape(table: DataFrame, limit: int = 25) -> DataFrame:
    return table.orderBy(F.desc("n_records"), F.asc("reason")).limit(limit).select(
        "reason", "n_occurrences", "n_records", "pct_of_all_retractions", "median_latency_days",
        "n_recent_5y", "recent_5y_share", "china_share",
    )


def top_reasons(table: DataFrame, limit: int = 15) -> DataFrame:
    """Most frequent reasons, marked as systemic fraud or ordinary problem."""
    return reason_landscape(table, limit).select(
        "reason", "n_records", "median_latency_days", "china_share",
        matches_any_keyword("reason", v.SYSTEMIC_KEYWORDS).alias("is_systemic"),
    )


def journal_risk(
    table: DataFrame, min_retractions: int = 5, tier: str | None = None, limit: int = 500
) -> DataFrame:
    chosen = table.filter(F.col("n_retractions") >= min_retractions)
    if tier:
        chosen = chosen.filter(F.col("risk_tier") == tier)
    return chosen.orderBy(F.desc("risk_score"), F.asc("journal")).limit(limit).select(
        "journal", "publisher", "n_retractions", "active_years", "first_year", "last_year", "peak_year",
        "peak_year_retractions", "burst_ratio", "n_paper_mill", "paper_mill_share",
        "peer_review_fraud_share", "ai_generated_share", "median_latency_days", "china_share",
        "risk_score", "risk_tier", "structural_score",
    )


def risk_map(table: DataFrame) -> DataFrame:
    return table.select("journal", "n_retractions", "paper_mill_share", "burst_ratio", "risk_score", "risk_tier")


def worst_journals_by_share(table: DataFrame, limit: int = 6) -> DataFrame:
    return table.orderBy(F.desc("paper_mill_share"), F.asc("journal")).limit(limit).select(
        "journal", "n_retractions", "paper_mill_share"
    )


def risk_validation(table: DataFrame) -> DataFrame:
    return table.select("score_name", "n_journals_total", "auc", "auc_grade").orderBy(F.desc("auc"))


def feature_power(table: DataFrame) -> DataFrame:
    return table.orderBy(F.desc("auc_abs"))


def risk_tier_performance(table: DataFrame) -> DataFrame:
    return table.orderBy(F.desc("min_score"))


def event_study(table: DataFrame) -> DataFrame:
    return table.select(
        "event_time", "n_works", "mean_citations", "counterfactual_citations", "citation_gap",
        "citation_gap_pct", "data_coverage", "is_post_retraction",
    ).orderBy("event_time")


def event_study_by_group(table: DataFrame) -> DataFrame:
    return table.select(
        "group_name", "event_time", "n_works", "mean_citations", "counterfactual_citations",
        "citation_gap", "citation_gap_pct",
    ).orderBy("group_name", "event_time")


def penalty_summary(table: DataFrame) -> DataFrame:
    return table


CLUSTER_ORDERS = ("cluster_risk_score", "cluster_structural_score", "n_authors", "total_shared_works")


def author_clusters(
    table: DataFrame, min_authors: int = 3, limit: int = 300, order_by: str = "cluster_risk_score"
) -> DataFrame:
    if order_by not in CLUSTER_ORDERS:
        raise ValueError(f"order_by must be one of {CLUSTER_ORDERS}, not {order_by!r}")
    return (
        table.filter(F.col("n_authors") >= min_authors)
        .orderBy(F.desc(order_by), F.asc("cluster_id")).limit(limit)
        .select(
            "cluster_id", "n_authors", "n_edges", "density", "total_shared_works", "n_paper_mill_works",
            "paper_mill_edge_share", "max_journals_in_edge", "max_fields_in_edge", "first_year",
            "last_year", "year_span", "works_per_author_year", "cluster_risk_score",
            "cluster_structural_score",
        )
    )


def cluster_members(table: DataFrame, cluster_id: object, limit: int = 50) -> DataFrame:
    return (
        table.filter(F.col("cluster_id") == F.lit(cluster_id))
        .orderBy(F.asc("author_name"), F.asc("author_id")).limit(limit)
        .select("author_name", "orcid", "author_id")
    )


def cluster_validation(table: DataFrame) -> DataFrame:
    """The scores of clusters, the best first."""
    return table.orderBy(F.desc_nulls_last("auc"), F.asc("score_name"))


def latency_by_year(table: DataFrame, first_year: int = 2005, last_year: int = 2025) -> DataFrame:
    years: Column = F.col("median_latency_days") / F.lit(365.25)
    return table.filter(
        F.col("year").between(first_year, last_year) & F.col("median_latency_days").isNotNull()
    ).select("year", years.alias("median_years"), "n_retractions").orderBy("year")
