"""Intermediate layer: business definitions on top of the staged tables.

Child tables are always reduced to one row per record before they are joined, so no join can
multiply records; each of those joins reuses the partitioning by record of its aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions import (
    count_where,
    days_between,
    ratio,
    round_to,
    share_where,
    subject_code,
    subject_name,
    year_of,
    years_from_days,
)
from auditloom.operators.aggregates import join_median, peak_per_group
from auditloom.operators.generators import cross_offsets
from auditloom.operators.pairs import TILE, meetings
from auditloom.plans import vocabulary as v


def reason_flags(reasons: DataFrame) -> DataFrame:
    """Number of reasons and one flag per reason family, per record."""
    return reasons.groupBy("record_id").agg(
        F.count(F.lit(1)).alias("n_reasons"),
        *[F.bool_or(F.col("reason").isin(*names)).alias(flag) for flag, names in v.REASON_FLAGS.items()],
    )


def country_features(countries: DataFrame, focus: str = v.FOCUS_COUNTRY) -> DataFrame:
    """``first_country`` is the alphabetically first one."""
    return countries.groupBy("record_id").agg(
        F.count(F.lit(1)).alias("n_countries"),
        F.min("country").alias("first_country"),
        F.bool_or(F.col("country") == focus).alias("involves_china"),
    )


def author_features(authors: DataFrame) -> DataFrame:
    """First and last author by position; no second pass to find the last position."""
    return authors.groupBy("record_id").agg(
        F.count(F.lit(1)).alias("n_authors"),
        F.max(F.when(F.col("author_position") == 1, F.col("author_name"))).alias("first_author"),
        F.max_by("author_name", "author_position").alias("last_author"),
    )


def institution_features(institutions: DataFrame) -> DataFrame:
    return institutions.groupBy("record_id").agg(F.count(F.lit(1)).alias("n_institutions"))


def subject_features(subjects: DataFrame) -> DataFrame:
    """Three independent minima: code and name may come from different subjects."""
    return subjects.groupBy("record_id").agg(
        F.count(F.lit(1)).alias("n_subjects"),
        F.min("subject").alias("primary_subject"),
        F.min(subject_code("subject")).alias("subject_code"),
        F.min(subject_name("subject")).alias("subject_name"),
    )


def enrich_records(
    records: DataFrame,
    reasons: DataFrame,
    countries: DataFrame,
    authors: DataFrame,
    institutions: DataFrame,
    subjects: DataFrame,
    focus: str = v.FOCUS_COUNTRY,
) -> DataFrame:
    """One row per record with counts (0 when a record has no children) and flags (false)."""
    joined = records
    for features in (
        reason_flags(reasons), country_features(countries, focus), author_features(authors),
        institution_features(institutions), subject_features(subjects),
    ):
        joined = joined.join(features, "record_id", "left")
    latency = days_between("original_paper_date", "retraction_date")

    def number(name: str):
        return F.coalesce(name, F.lit(0).cast("bigint")).alias(name)

    def flag(name: str):
        return F.coalesce(name, F.lit(False)).alias(name)

    return joined.select(
        "record_id", "title", "journal", "publisher", "retraction_nature", "paywalled",
        "original_paper_date", "retraction_date", "original_paper_year", "retraction_year",
        latency.alias("retraction_latency_days"),
        round_to(years_from_days(latency), 2).alias("retraction_latency_years"),
        "retraction_doi", "original_paper_doi", "original_paper_pubmed_id",
        number("n_reasons"),
        *[flag(name) for name in v.REASON_FLAGS],
        number("n_countries"),
        (F.coalesce("n_countries", F.lit(0)) > 1).alias("is_international"),
        flag("involves_china"),
        number("n_authors"), number("n_institutions"), number("n_subjects"),
        "first_country", "first_author", "last_author",
        "primary_subject", "subject_code", "subject_name",
        "source_file", "loaded_at",
    )


def journal_year_activity(enriched: DataFrame) -> DataFrame:
    known = enriched.filter(F.col("journal").isNotNull() & F.col("retraction_year").isNotNull())
    return known.groupBy("journal", F.col("retraction_year").alias("year")).agg(
        F.count(F.lit(1)).alias("n_retractions"),
        count_where(F.col("is_paper_mill")).alias("n_paper_mill"),
        count_where(F.col("is_peer_review_fraud")).alias("n_peer_review_fraud"),
        count_where(F.col("is_ai_generated")).alias("n_ai_generated"),
        count_where(F.col("is_rogue_editor")).alias("n_rogue_editor"),
        round_to(share_where(F.col("is_paper_mill")), 4).alias("paper_mill_share"),
        round_to(share_where(F.col("is_peer_review_fraud")), 4).alias("peer_review_fraud_share"),
        round_to(share_where(F.col("is_ai_generated")), 4).alias("ai_generated_share"),
        round_to(F.median("retraction_latency_days"), 1).alias("median_latency_days"),
        round_to(F.avg("retraction_latency_days"), 1).alias("mean_latency_days"),
        round_to(F.avg("n_authors"), 2).alias("mean_authors"),
        round_to(share_where(F.col("involves_china")), 4).alias("china_share"),
    )


def journal_profile(enriched: DataFrame) -> DataFrame:
    """Journal totals from record grain, with the busiest year and how much of all it holds."""
    known = enriched.filter(F.col("journal").isNotNull())
    totals = known.groupBy("journal").agg(
        F.min("publisher").alias("publisher"),
        F.count(F.lit(1)).alias("n_retractions"),
        F.count_distinct("retraction_year").alias("active_years"),
        F.min("retraction_year").alias("first_year"),
        F.max("retraction_year").alias("last_year"),
        count_where(F.col("is_paper_mill")).alias("n_paper_mill"),
        count_where(F.col("is_peer_review_fraud")).alias("n_peer_review_fraud"),
        count_where(F.col("is_ai_generated")).alias("n_ai_generated"),
        count_where(F.col("retraction_nature") == "Expression of concern").alias("n_expression_of_concern"),
        count_where(F.col("is_international")).alias("n_international"),
        round_to(share_where(F.col("is_paper_mill")), 4).alias("paper_mill_share"),
        round_to(share_where(F.col("is_peer_review_fraud")), 4).alias("peer_review_fraud_share"),
        round_to(share_where(F.col("is_ai_generated")), 4).alias("ai_generated_share"),
        round_to(F.avg("n_authors"), 2).alias("mean_authors"),
        round_to(share_where(F.col("involves_china")), 4).alias("china_share"),
    )
    totals = join_median(totals, known, ["journal"], "retraction_latency_days", "median_latency_days")
    peak = peak_per_group(known, "journal", "retraction_year").select(
        "journal", F.col("peak_period").alias("peak_year"), F.col("peak_rows").alias("peak_year_retractions")
    )
    years = F.greatest("active_years", F.lit(1))
    return totals.join(peak, "journal", "left").select(
        "*",
        round_to(ratio("peak_year_retractions", "n_retractions"), 4).alias("burst_ratio"),
        round_to(ratio("n_retractions", years), 2).alias("retractions_per_active_year"),
    )


def author_activity(authors: DataFrame, enriched: DataFrame) -> DataFrame:
    """Activity per author name over the records it signs.

    An author's lines in one record are folded where the join has put them, so distinct records become plain counts.
    The other distinct counts are sizes of sets of journals, subjects, years and countries: these are bounded by the
    vocabularies, not by the rows, and combined before the shuffle. One join, one aggregation, no multiplied rows.
    """
    facts = enriched.select(
        "record_id", "journal", "subject_code", "retraction_year", "original_paper_year",
        "first_country", "n_authors", "is_paper_mill", "is_peer_review_fraud", "is_ai_generated",
        "retraction_latency_days",
    )
    carried = [c for c in facts.columns if c != "record_id"]
    folded = authors.join(facts, "record_id").groupBy("record_id", "author_name").agg(
        F.count(F.lit(1)).alias("times"),
        count_where(F.col("author_position") == 1).alias("n_first"),
        count_where(F.col("author_position") == F.col("n_authors")).alias("n_last"),
        *[F.first(c).alias(c) for c in carried],
    )

    def times_where(flag: str) -> Column:
        return F.sum(F.when(F.col(flag), F.col("times")).otherwise(F.lit(0)))

    def different(column: str) -> Column:
        return F.size(F.collect_set(column)).cast("bigint")

    return folded.groupBy("author_name").agg(
        F.count("record_id").alias("n_retractions"),
        different("journal").alias("n_journals"),
        different("subject_code").alias("n_subject_areas"),
        different("retraction_year").alias("n_active_years"),
        different("first_country").alias("n_countries"),
        F.min("original_paper_year").alias("first_paper_year"),
        F.max("original_paper_year").alias("last_paper_year"),
        F.min("retraction_year").alias("first_retraction_year"),
        F.max("retraction_year").alias("last_retraction_year"),
        times_where("is_paper_mill").alias("n_paper_mill"),
        times_where("is_peer_review_fraud").alias("n_peer_review_fraud"),
        times_where("is_ai_generated").alias("n_ai_generated"),
        F.sum("n_first").alias("n_first_author"),
        F.sum("n_last").alias("n_last_author"),
        round_to(F.percentile("retraction_latency_days", F.lit(0.5), F.col("times")), 1).alias("median_latency_days"),
    )


_WORK_FLAGS = ("is_paper_mill", "is_peer_review_fraud", "is_ai_generated", "is_image_duplication", "is_rogue_editor")


def records_by_doi(enriched: DataFrame) -> DataFrame:
    """Records folded to one row per DOI, so works cannot multiply."""
    return enriched.filter(F.col("original_paper_doi").isNotNull()).groupBy(
        F.col("original_paper_doi").alias("record_doi")
    ).agg(
        F.count(F.lit(1)).alias("n_records"),
        F.min("retraction_date").alias("retraction_date"),
        *[F.bool_or(flag).alias(flag) for flag in _WORK_FLAGS],
        F.min("retraction_nature").alias("retraction_nature"),
        F.min("journal").alias("record_journal"),
        F.min("first_country").alias("record_first_country"),
        F.min("retraction_latency_days").alias("record_latency_days"),
    )


def enrich_works(works: DataFrame, enriched: DataFrame, as_of_year: int) -> DataFrame:
    """Works with a DOI, joined to what the records say about the same DOI."""
    with_doi = works.filter(F.col("doi").isNotNull())
    joined = with_doi.join(records_by_doi(enriched), F.col("doi") == F.col("record_doi"), "left")
    age = F.lit(as_of_year) - F.col("publication_year")
    return joined.select(
        "work_id", "doi", "title", "publication_year", "publication_date", "work_type", "language",
        "cited_by_count", "referenced_works_count", "fwci", "is_oa", "oa_status", "primary_topic",
        "domain", "field", "subfield", "n_authors", "countries_distinct_count",
        "institutions_distinct_count",
        F.col("record_doi").isNotNull().alias("matched_in_records"),
        F.coalesce("n_records", F.lit(0).cast("bigint")).alias("n_records"),
        "retraction_date",
        year_of("retraction_date").alias("retraction_year"),
        "retraction_nature", "record_journal", "record_first_country",
        F.coalesce("record_latency_days", days_between("publication_date", "retraction_date"))
        .alias("retraction_latency_days"),
        *[F.coalesce(flag, F.lit(False)).alias(flag) for flag in _WORK_FLAGS],
        F.when(age > 0, round_to(ratio("cited_by_count", age), 3)).alias("citations_per_year"),
        "source_file", "loaded_at",
    )


def event_panel(
    works: DataFrame,
    citations: DataFrame,
    window: tuple[int, int] = v.EVENT_WINDOW,
    last_full_year: int = v.LAST_FULL_YEAR,
) -> DataFrame:
    """Balanced panel: every eligible work has one row per event time, zero where nothing is known."""
    first, last = window
    eligible = works.filter(
        (F.col("publication_year") <= F.col("retraction_year") + first)
        & (F.col("retraction_year") + last <= last_full_year)
    ).select(
        "work_id", "publication_year", "retraction_year", "is_paper_mill", "is_peer_review_fraud",
        "is_ai_generated", "field", "domain", F.col("cited_by_count").alias("total_cited_by_count"),
        "n_authors",
    )
    grid = cross_offsets(eligible, first, last, "event_time").withColumn(
        "citation_year", F.col("retraction_year") + F.col("event_time")
    )
    yearly = citations.groupBy("work_id", F.col("citation_year").cast("bigint").alias("citation_year")).agg(
        F.sum("cited_by_count").alias("observed")
    )
    return grid.join(yearly, ["work_id", "citation_year"], "left").select(
        "work_id", "event_time", "citation_year", "publication_year", "retraction_year",
        (F.col("citation_year") - F.col("publication_year")).alias("years_since_publication"),
        F.coalesce("observed", F.lit(0).cast("bigint")).alias("cited_by_count"),
        F.col("observed").isNotNull().alias("has_observed_data"),
        "is_paper_mill", "is_peer_review_fraud", "is_ai_generated", "field", "domain",
        "total_cited_by_count", "n_authors",
    )


def coauthor_edges(
    authorships: DataFrame,
    works: DataFrame,
    min_shared: int = v.MIN_SHARED_WORKS,
    tile: int = TILE,
) -> DataFrame:
    """Author pairs with at least ``min_shared`` common works and what those works have in common.

    An author listed twice on a work counts once there.
    """
    facts = works.select(
        "work_id", "is_paper_mill", "record_journal", "field", "record_first_country", "publication_year"
    )
    met = meetings(authorships, "work_id", "author_id", min_shared, tile, facts)
    span = F.col("last_year") - F.col("first_year")
    # A pair shares few works, so its sets are small; distinct counts would multiply every meeting.
    edges = met.groupBy(F.col("a").alias("author_a"), F.col("b").alias("author_b")).agg(
        F.count(F.lit(1)).alias("n_shared_works"),
        count_where(F.col("is_paper_mill")).alias("n_shared_paper_mill"),
        round_to(share_where(F.col("is_paper_mill")), 4).alias("shared_paper_mill_share"),
        F.size(F.collect_set("record_journal")).cast("bigint").alias("n_journals"),
        F.size(F.collect_set("field")).cast("bigint").alias("n_fields"),
        F.size(F.collect_set("record_first_country")).cast("bigint").alias("n_countries"),
        F.min("publication_year").alias("first_year"),
        F.max("publication_year").alias("last_year"),
    ).filter(F.col("n_shared_works") >= min_shared)
    return edges.select(
        "*",
        span.alias("year_span"),
        round_to(ratio("n_shared_works", F.greatest(span + 1, F.lit(1))), 2).alias("works_per_year"),
    )
