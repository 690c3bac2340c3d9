"""Full rebuild of the warehouse in dependency order; every table is written, then read back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from auditloom.operators.pairs import count_pairs_by_edges
from auditloom.plans import enriched, events, marts, network, quality, staging
from auditloom.plans import vocabulary as v
from auditloom.sources.records_csv import broken_records, land_records, records_of, unmapped_report
from auditloom.sources.snapshots import newest_files
from auditloom.sources.tables import export_json, publish
from auditloom.sources.works_json import quarantine, read_work_pages, works_of


class Warehouse(dict):
    """Tables by name, and what was measured while they were written: ``observed[table][check]``."""

    def __init__(self, as_of: dt.date | None = None) -> None:
        super().__init__()
        self.as_of = as_of
        self.observed: dict[str, dict[str, int]] = {}


def build_warehouse(
    spark: SparkSession,
    records_csv: str | list[str],
    work_pages: str | list[str],
    root: str,
    loaded_at: dt.datetime,
    last_full_year: int = v.LAST_FULL_YEAR,
    one_page_per_file: bool = True,
    strict: bool = False,
) -> Warehouse:
    """Build all layers below ``root`` and return the tables by name.

    Every table is replaced at once after it has been written, so a build that fails leaves each table whole, as it
    was or as it is now. The checks that look at one row at a time are counted while their table is written, with
    the day of ``loaded_at`` as today. A folder of dated record files is read from its newest snapshot on. Lines and
    pages that can't be read go to quarantine tables and are counted in the audit; ``strict`` raises instead. Records
    and their children are laid out by record, so that folding the children and joining them exchanges nothing.
    """
    tables = Warehouse(loaded_at.date())
    checks = quality.standard_checks(tables.as_of)

    def keep(layer: str, name: str, df: DataFrame, by: str | None = None) -> DataFrame:
        measures = quality.written_measures(checks, name)
        tables.observed[name] = {}
        tables[name] = publish(
            df, root, layer, name, comments=v.COLUMN_COMMENTS, measures=measures, measured=tables.observed[name], bucket_key=by
        )
        return tables[name]

    lines = keep("landing", "records_landed", land_records(spark, newest_files(spark, records_csv), strict))
    landed_rows = keep("landing", "works_landed", read_work_pages(spark, work_pages, one_page_per_file, strict))
    keep("landing", "quarantined_lines", broken_records(lines))
    bad_pages = keep("landing", "quarantined_pages", quarantine(landed_rows, work_pages))
    keep("landing", "unmapped_columns", unmapped_report(lines))
    raw, landed = records_of(lines), works_of(landed_rows)

    records = keep("staging", "records", staging.stage_records(raw, loaded_at), "record_id")
    reasons = keep("staging", "record_reasons", staging.record_reasons(records), "record_id")
    countries = keep("staging", "record_countries", staging.record_countries(records), "record_id")
    subjects = keep("staging", "record_subjects", staging.record_subjects(records), "record_id")
    authors = keep("staging", "record_authors", staging.record_authors(records), "record_id")
    institutions = keep("staging", "record_institutions", staging.record_institutions(records), "record_id")
    works = keep("staging", "works", staging.stage_works(landed, loaded_at))
    authorships = keep("staging", "work_authorships", staging.work_authorships(landed))
    keep("staging", "work_author_institutions", staging.work_author_institutions(landed))
    citations = keep("staging", "work_citations", staging.work_citations(landed))
    keep("staging", "work_topics", staging.work_topics(landed))
    audit = staging.load_audit(raw, landed, loaded_at)
    keep("staging", "load_audit", audit.unionByName(staging.quarantine_audit(lines, landed_rows, bad_pages, loaded_at)))

    facts = keep("intermediate", "records_enriched", enriched.enrich_records(
        records, reasons, countries, authors, institutions, subjects))
    keep("intermediate", "journal_year_activity", enriched.journal_year_activity(facts))
    profile = keep("intermediate", "journal_profile", enriched.journal_profile(facts))
    keep("intermediate", "author_activity", enriched.author_activity(authors, facts))
    linked = keep("intermediate", "works_enriched", enriched.enrich_works(works, facts, loaded_at.year))
    panel = keep("intermediate", "event_panel", enriched.event_panel(linked, citations, last_full_year=last_full_year))
    edges = keep("intermediate", "coauthor_edges", enriched.coauthor_edges(authorships, linked))

    keep("marts", "retraction_trends", marts.retraction_trends(facts))
    risk = keep("marts", "journal_risk", marts.journal_risk(profile))
    keep("marts", "risk_score_validation", marts.risk_score_validation(risk))
    keep("marts", "feature_discriminative_power", marts.feature_discriminative_power(risk))
    keep("marts", "risk_tier_performance", marts.risk_tier_performance(risk))
    keep("marts", "country_leaderboard", marts.country_leaderboard(countries, facts))
    keep("marts", "reason_landscape", marts.reason_landscape(reasons, facts))
    study = keep("marts", "event_study", events.event_study(panel))
    keep("marts", "event_study_by_group", events.event_study_by_group(panel))
    keep("marts", "penalty_summary", events.penalty_summary(study))

    membership = keep("marts", "author_cluster_membership", network.community_membership(edges))
    scores = keep("marts", "author_clusters", network.cluster_scores(network.cluster_profile(edges, membership)))
    keep("marts", "author_cluster_members", network.cluster_members(membership, scores, authorships))
    known = authorships.join(linked.select("work_id"), "work_id", "left_semi")
    pairs = count_pairs_by_edges(known, "work_id", "author_id", edges, "n_shared_works")
    keep("marts", "author_cluster_validation", network.cluster_validation(scores, pairs))
    return tables


def check_warehouse(tables: dict[str, DataFrame], as_of: dt.date, report_path: str | None = None) -> DataFrame:
    """Run the standard checks; optionally write the report as JSON.

    Counts that the build took while it wrote the tables, for the same day, are not taken again.
    """
    known = tables.observed if isinstance(tables, Warehouse) and tables.as_of == as_of else {}
    report = quality.run_checks(tables, quality.standard_checks(as_of), known)
    if report_path:
        export_json(report, report_path)
    return report
