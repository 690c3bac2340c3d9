"""Staging: typed, cleaned tables; no business rules yet."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions import (
    clean_text,
    normalize_doi,
    normalize_pubmed,
    parse_date,
    short_id,
    trim_spaces,
    year_of,
)
from auditloom.operators.aggregates import keep_and_count
from auditloom.operators.generators import explode_positions, explode_values
from auditloom.plans import vocabulary as v
from auditloom.sources.works_json import WRONG_VALUES


def has_record_id(raw: DataFrame) -> Column:
    return trim_spaces(F.coalesce(raw["Record ID"], F.lit(""))) != ""


def stage_records(raw: DataFrame, loaded_at: dt.datetime) -> DataFrame:
    """Record table. A Record ID that is no number becomes NULL and is left to the checks."""
    kept = raw.filter(has_record_id(raw)).withColumns(
        {"_retracted": parse_date("RetractionDate"), "_published": parse_date("OriginalPaperDate")}
    )
    return kept.select(
        trim_spaces("Record ID").try_cast("bigint").alias("record_id"),
        clean_text("Title").alias("title"),
        clean_text("Journal").alias("journal"),
        clean_text("Publisher").alias("publisher"),
        clean_text("Institution").alias("institution_raw"),
        clean_text("Author").alias("author_raw"),
        clean_text("Country").alias("country_raw"),
        clean_text("Subject").alias("subject_raw"),
        clean_text("ArticleType").alias("article_type_raw"),
        clean_text("Reason").alias("reason_raw"),
        clean_text("Notes").alias("notes"),
        clean_text("URLS").alias("urls"),
        F.col("_retracted").alias("retraction_date"),
        F.col("_published").alias("original_paper_date"),
        year_of("_retracted").alias("retraction_year"),
        year_of("_published").alias("original_paper_year"),
        normalize_doi("RetractionDOI").alias("retraction_doi"),
        normalize_doi("OriginalPaperDOI").alias("original_paper_doi"),
        normalize_pubmed("RetractionPubMedID").alias("retraction_pubmed_id"),
        normalize_pubmed("OriginalPaperPubMedID").alias("original_paper_pubmed_id"),
        clean_text("RetractionNature").alias("retraction_nature"),
        clean_text("Paywalled").alias("paywalled"),
        "source_file",
        F.lit(loaded_at).cast("timestamp").alias("loaded_at"),
    )


def record_reasons(records: DataFrame) -> DataFrame:
    return explode_values(records, "record_id", "reason_raw", "reason")


def record_countries(records: DataFrame) -> DataFrame:
    return explode_values(records, "record_id", "country_raw", "country")


def record_subjects(records: DataFrame) -> DataFrame:
    return explode_values(records, "record_id", "subject_raw", "subject")


def record_institutions(records: DataFrame) -> DataFrame:
    return explode_values(records, "record_id", "institution_raw", "institution")


def record_authors(records: DataFrame) -> DataFrame:
    return explode_positions(records, "record_id", "author_raw", "author_position", "author_name")


def stage_works(landed: DataFrame, loaded_at: dt.datetime) -> DataFrame:
    """Flat work table from the nested works (column ``w``); works without an id drop out."""
    w = landed["w"]
    return landed.filter(w["id"].isNotNull()).select(
        short_id(w["id"]).alias("work_id"),
        normalize_doi(w["doi"]).alias("doi"),
        w["title"].alias("title"),
        w["publication_year"].try_cast("int").alias("publication_year"),
        w["publication_date"].try_cast("date").alias("publication_date"),
        w["type"].alias("work_type"),
        w["language"].alias("language"),
        w["is_retracted"].alias("is_retracted"),
        w["cited_by_count"].alias("cited_by_count"),
        w["referenced_works_count"].alias("referenced_works_count"),
        w["fwci"].alias("fwci"),
        w["open_access"]["is_oa"].alias("is_oa"),
        w["open_access"]["oa_status"].alias("oa_status"),
        w["open_access"]["oa_url"].alias("oa_url"),
        short_id(w["primary_topic"]["id"]).alias("primary_topic_id"),
        w["primary_topic"]["display_name"].alias("primary_topic"),
        w["primary_topic"]["score"].alias("primary_topic_score"),
        w["primary_topic"]["domain"]["display_name"].alias("domain"),
        w["primary_topic"]["field"]["display_name"].alias("field"),
        w["primary_topic"]["subfield"]["display_name"].alias("subfield"),
        F.size(w["authorships"]).cast("bigint").alias("n_authors"),
        w["countries_distinct_count"].try_cast("int").alias("countries_distinct_count"),
        w["institutions_distinct_count"].try_cast("int").alias("institutions_distinct_count"),
        w["biblio"]["volume"].alias("biblio_volume"),
        w["biblio"]["issue"].alias("biblio_issue"),
        w["biblio"]["first_page"].alias("biblio_first_page"),
        w["biblio"]["last_page"].alias("biblio_last_page"),
        "source_file",
        F.lit(loaded_at).cast("timestamp").alias("loaded_at"),
    )


def _each_author(landed: DataFrame) -> DataFrame:
    w = landed["w"]
    return landed.select(
        short_id(w["id"]).alias("work_id"), F.posexplode(w["authorships"]).alias("_at", "a")
    )


def work_authorships(landed: DataFrame) -> DataFrame:
    """One row per author of a work, in the order of the source."""
    return _each_author(landed).select(
        "work_id",
        (F.col("_at") + 1).cast("bigint").alias("author_seq"),
        F.col("a.author_position").alias("author_position"),
        short_id("a.author.id").alias("author_id"),
        F.col("a.author.display_name").alias("author_name"),
        F.col("a.raw_author_name").alias("raw_author_name"),
        short_id("a.author.orcid").alias("orcid"),
        F.col("a.is_corresponding").alias("is_corresponding"),
        F.size("a.institutions").cast("bigint").alias("n_institutions"),
        F.col("a.countries").alias("countries"),
    )


def work_author_institutions(landed: DataFrame) -> DataFrame:
    """One row per institution of each author; authors without one drop out."""
    return (
        _each_author(landed)
        .select("work_id", "_at", F.col("a.author").alias("author"), F.explode("a.institutions").alias("i"))
        .select(
            "work_id",
            (F.col("_at") + 1).cast("bigint").alias("author_seq"),
            short_id("author.id").alias("author_id"),
            F.col("author.display_name").alias("author_name"),
            short_id("i.id").alias("institution_id"),
            F.col("i.display_name").alias("institution_name"),
            F.col("i.country_code").alias("country_code"),
            F.col("i.type").alias("institution_type"),
            short_id("i.ror").alias("ror"),
        )
    )


def work_citations(landed: DataFrame) -> DataFrame:
    """Citations per work and year; years before publication keep their negative age."""
    w = landed["w"]
    return (
        landed.filter(w["id"].isNotNull())
        .select(
            short_id(w["id"]).alias("work_id"),
            w["publication_year"].try_cast("int").alias("publication_year"),
            F.explode(w["counts_by_year"]).alias("c"),
        )
        .filter(F.col("c.year").isNotNull())
        .select(
            "work_id",
            "publication_year",
            F.col("c.year").try_cast("int").alias("citation_year"),
            F.col("c.cited_by_count").alias("cited_by_count"),
            (F.col("c.year").try_cast("int") - F.col("publication_year")).alias("years_since_publication"),
        )
    )


def work_topics(landed: DataFrame) -> DataFrame:
    """Topics per work; ``is_primary`` is NULL when either id is missing."""
    w = landed["w"]
    return (
        landed.filter(w["id"].isNotNull())
        .select(
            short_id(w["id"]).alias("work_id"),
            w["primary_topic"]["id"].alias("_primary"),
            F.explode(w["topics"]).alias("t"),
        )
        .select(
            "work_id",
            short_id("t.id").alias("topic_id"),
            F.col("t.display_name").alias("topic"),
            F.col("t.score").alias("topic_score"),
            F.col("t.domain.display_name").alias("domain"),
            F.col("t.field.display_name").alias("field"),
            F.col("t.subfield.display_name").alias("subfield"),
            (F.col("t.id") == F.col("_primary")).alias("is_primary"),
        )
    )


def quarantine_audit(records_landed: DataFrame, works_landed: DataFrame, pages: DataFrame, loaded_at: dt.datetime) -> DataFrame:
    """Lines and pages read, kept and in quarantine; rows like those of ``load_audit``.

    ``pages`` is the quarantine of the work pages. A page of which some values were nulled is kept.
    """
    lost = pages.filter(F.col("problem") != WRONG_VALUES).select("source_file").distinct().withColumn("_lost", F.lit(True))
    files = works_landed.select("source_file").union(pages.select("source_file")).distinct()
    seen = files.join(lost, "source_file", "left")
    first = F.min("source_file").alias("source_file")
    parts = [
        keep_and_count(records_landed, F.col("problem").isNull(), first).select(
            F.lit("record_lines").alias("dataset"), "*", F.lit(v.BROKEN_LINE_REASON).alias("drop_reason")
        ),
        keep_and_count(seen, F.col("_lost").isNull(), first).select(
            F.lit("work_pages").alias("dataset"), "*", F.lit(v.BROKEN_PAGE_REASON).alias("drop_reason")
        ),
    ]
    return parts[0].unionByName(parts[1]).withColumn("loaded_at", F.lit(loaded_at).cast("timestamp"))


def load_audit(raw: DataFrame, landed: DataFrame, loaded_at: dt.datetime) -> DataFrame:
    """Rows read, kept and dropped per source and where they came from (the first file), one pass over each."""
    parts = [
        keep_and_count(raw, has_record_id(raw), F.min("source_file").alias("source_file")).select(
            F.lit("records").alias("dataset"), "*", F.lit(v.BLANK_ROW_REASON).alias("drop_reason")
        ),
        keep_and_count(
            landed, landed["w"]["id"].isNotNull(), F.min("source_file").alias("source_file")
        ).select(
            F.lit("works").alias("dataset"), "*", F.lit(v.NULL_KEY_REASON).alias("drop_reason")
        ),
    ]
    return parts[0].unionByName(parts[1]).withColumn("loaded_at", F.lit(loaded_at).cast("timestamp"))
