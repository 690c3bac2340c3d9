"""Registered queries: name, Spark query over the retail tables, expected result in SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom import functions as fn
from auditloom.operators import aggregates, generators, graph, pairs, ranking, regression
from auditloom.operators.persisting import materialize, scratch_path
from auditloom.plans import enriched as models
from auditloom.plans import events, marts, network, profiling, quality, serving, staging
from auditloom.plans import vocabulary as v
from auditloom.retail import frames as f
from auditloom.retail import oracles as o
from auditloom.sources import tables
from auditloom.sources.records_csv import read_records_csv, write_records_csv
from auditloom.sources.snapshots import latest_snapshot, newest_files
from auditloom.sources.works_json import quarantine, read_work_pages, works_of, write_work_pages
from auditloom.streaming.incremental import (
    land_new_files, merge_batch, merge_new_files, read_merged, stream_files, stream_work_pages,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        @functools.wraps(query)
        def run(spark: SparkSession, sf: str) -> DataFrame:
            with f.one_version(spark, sf):
                return query(spark, sf)

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = o.statement(oracle)
        return query
    return keep


# --- scalar functions -------------------------------------------------------------------------

@register("parse_date_multi", f"SELECT id, {o.parsed('retracted')} AS day FROM raw_records")
def parse_date_multi(spark, sf):
    return f.raw_records(spark, sf).select(F.col("Record ID").alias("id"), fn.parse_date("RetractionDate").alias("day"))


@register("split_multi", """
    SELECT id, count(*) FILTER (WHERE trim(part) <> '') AS n_parts,
           string_agg(trim(part), '|' ORDER BY place) FILTER (WHERE trim(part) <> '') AS parts
    FROM (SELECT id, unnest(string_split(institution, ';')) AS part,
                 generate_subscripts(string_split(institution, ';'), 1) AS place FROM raw_records WHERE id <> '')
    GROUP BY id""")
def split_multi(spark, sf):
    parts = fn.split_multi("Institution")
    return f.raw_records(spark, sf).filter(F.col("Record ID") != "").select(
        F.col("Record ID").alias("id"), F.size(parts).cast("bigint").alias("n_parts"),
        F.array_join(parts, "|").alias("parts"),
    )


@register("clean_text", f"SELECT id, {o.clean('title')} AS title, {o.clean('journal')} AS journal FROM raw_records")
def clean_text(spark, sf):
    return f.raw_records(spark, sf).select(
        F.col("Record ID").alias("id"), fn.clean_text("Title").alias("title"), fn.clean_text("Journal").alias("journal")
    )


@register("normalize_key", f"SELECT id, {o.doi('paper_doi')} AS doi FROM raw_records")
def normalize_key(spark, sf):
    return f.raw_records(spark, sf).select(F.col("Record ID").alias("id"), fn.normalize_doi("OriginalPaperDOI").alias("doi"))


@register("normalize_pmid", f"SELECT id, {o.pubmed('retraction_pubmed')} AS pubmed FROM raw_records")
def normalize_pmid(spark, sf):
    return f.raw_records(spark, sf).select(
        F.col("Record ID").alias("id"), fn.normalize_pubmed("RetractionPubMedID").alias("pubmed")
    )


@register("short_id", f"SELECT page_id, {o.last_segment('url')} AS short_id FROM pages")
def short_id(spark, sf):
    return f.table(spark, sf, "pages").select("page_id", fn.short_id("url").alias("short_id"))


@register("subject_code_name", r"""
    SELECT regexp_extract(subject, '^\(([^)]+)\)', 1) AS subject_code,
           nullif(regexp_replace(subject, '^\([^)]+\)\s*', ''), '') AS subject_name, count(*) AS n
    FROM subjects GROUP BY ALL""")
def subject_code_name(spark, sf):
    named = f.subjects(spark, sf).select(
        fn.subject_code("subject").alias("subject_code"), fn.subject_name("subject").alias("subject_name")
    )
    return named.groupBy("subject_code", "subject_name").agg(F.count(F.lit(1)).alias("n"))


@register("safe_cast", """
    SELECT id, TRY_CAST(id AS BIGINT) AS as_bigint, TRY_CAST(published AS DATE) AS as_date,
           TRY_CAST(paper_pubmed AS DOUBLE) AS as_double FROM raw_records""")
def safe_cast(spark, sf):
    return f.raw_records(spark, sf).select(
        F.col("Record ID").alias("id"), F.col("Record ID").try_cast("bigint").alias("as_bigint"),
        F.col("OriginalPaperDate").try_cast("date").alias("as_date"),
        F.trim("OriginalPaperPubMedID").try_cast("double").alias("as_double"),
    )


@register("latency_days", """
    SELECT record_id, datediff('day', original_paper_date, retraction_date) AS days,
           round(datediff('day', original_paper_date, retraction_date) / 365.25::DOUBLE, 2) AS years FROM records""")
def latency_days(spark, sf):
    days = fn.days_between("original_paper_date", "retraction_date")
    return f.records(spark, sf).select(
        "record_id", days.alias("days"), fn.round_to(fn.years_from_days(days), 2).alias("years")
    )


@register("nested_counts", """
    SELECT CASE WHEN p_partkey % 53 <> 0 THEN 'W' || p_partkey END AS work_id, p_partkey % 4 AS n_authors,
           CASE WHEN p_partkey % 4 > 0 THEN 'Author ' || (p_partkey % 300 + 1) END AS first_author FROM part""")
def nested_counts(spark, sf):
    return f.landed_works(spark, sf).select(
        fn.short_id("w.id").alias("work_id"), F.size("w.authorships").cast("bigint").alias("n_authors"),
        F.get("w.authorships", F.lit(0))["author"]["display_name"].alias("first_author"),
    )


@register("flatten_struct", """
    SELECT CASE WHEN p_partkey % 53 <> 0 THEN 'W' || p_partkey END AS work_id, p_size % 3 = 0 AS is_oa,
           CASE WHEN p_partkey % 37 <> 0 THEN p_type END AS domain,
           CASE WHEN p_partkey % 37 <> 0 THEN p_brand END AS field,
           CASE WHEN p_partkey % 37 <> 0 THEN 'Sub ' || (p_size % 5) END AS subfield FROM part""")
def flatten_struct(spark, sf):
    return f.landed_works(spark, sf).select(
        fn.short_id("w.id").alias("work_id"), F.col("w.open_access.is_oa").alias("is_oa"),
        F.col("w.primary_topic.domain.display_name").alias("domain"),
        F.col("w.primary_topic.field.display_name").alias("field"),
        F.col("w.primary_topic.subfield.display_name").alias("subfield"),
    )


@register("reason_systemic_flag", """
    SELECT reason, count(*) AS n,
           regexp_matches(reason, '(?i)Paper Mill|Peer Review|Rogue Editor|Computer-Generated|Image') AS is_systemic
    FROM reasons GROUP BY reason""")
def reason_systemic_flag(spark, sf):
    return f.reasons(spark, sf).groupBy("reason").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "is_systemic", fn.matches_any_keyword("reason", v.SYSTEMIC_KEYWORDS)
    )


@register("drop_blank_rows", "SELECT id, title FROM raw_records WHERE trim(id) <> ''")
def drop_blank_rows(spark, sf):
    raw = f.raw_records(spark, sf)
    return raw.filter(staging.has_record_id(raw)).select(F.col("Record ID").alias("id"), F.col("Title").alias("title"))


# --- staging and row generators ---------------------------------------------------------------

@register("stg_records", "SELECT * FROM staged")
def stg_records(spark, sf):
    return staging.stage_records(f.raw_records(spark, sf), f.LOADED_AT)


@register("stg_works", "SELECT * FROM works")
def stg_works(spark, sf):
    return f.works(spark, sf)


def _exploded(column: str, value: str) -> str:
    return (
        f"SELECT record_id, trim(part) AS {value} FROM staged, {o.split(column, 't')} "
        f"WHERE record_id IS NOT NULL AND trim(part) <> ''"
    )


@register("explode_values", " UNION ALL ".join(
    f"SELECT record_id, '{kind}' AS kind, value FROM ({_exploded(column, 'value')})"
    for kind, column in (("reason", "reason_raw"), ("country", "country_raw"), ("subject", "subject_raw"),
                         ("institution", "institution_raw"))))
def explode_values(spark, sf):
    records = f.staged(spark, sf)
    children = {
        "reason": staging.record_reasons(records), "country": staging.record_countries(records),
        "subject": staging.record_subjects(records), "institution": staging.record_institutions(records),
    }
    parts = [
        child.select("record_id", F.lit(kind).alias("kind"), F.col(kind).alias("value"))
        for kind, child in children.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@register("explode_positions", """
    SELECT record_id, place AS author_position, trim(part) AS author_name
    FROM (SELECT record_id, unnest(string_split(author_raw, ';')) AS part,
                 generate_subscripts(string_split(author_raw, ';'), 1) AS place
          FROM staged WHERE record_id IS NOT NULL AND author_raw IS NOT NULL)""")
def explode_positions(spark, sf):
    return staging.record_authors(f.staged(spark, sf))


_WORK_ID = "CASE WHEN p_partkey % 53 <> 0 THEN 'W' || p_partkey END"
_AUTHOR_ID = "CASE WHEN NOT (p_partkey % 5 = 0 AND i = 3) THEN 'A' || (p_partkey % 300 + i) END"


@register("explode_structs_pos", f"""
    SELECT {_WORK_ID} AS work_id, i AS author_seq, CASE WHEN i = 1 THEN 'first' ELSE 'middle' END AS author_position,
           {_AUTHOR_ID} AS author_id, 'Author ' || (p_partkey % 300 + i) AS author_name,
           'A. ' || (p_partkey % 300 + i) AS raw_author_name,
           CASE WHEN i = 2 THEN '0000-' || (p_partkey % 300 + i) END AS orcid, i = 1 AS is_corresponding,
           i - 1 AS n_institutions, CASE i WHEN 1 THEN '' WHEN 2 THEN 'C1' ELSE 'C1|C2' END AS countries
    FROM part, unnest(range(1, p_partkey % 4 + 1)) AS t(i)""")
def explode_structs_pos(spark, sf):
    rows = staging.work_authorships(f.landed_works(spark, sf))
    return rows.withColumn("countries", F.array_join("countries", "|"))


@register("explode_nested2", f"""
    SELECT {_WORK_ID} AS work_id, i AS author_seq, {_AUTHOR_ID} AS author_id,
           'Author ' || (p_partkey % 300 + i) AS author_name, 'I' || (p_partkey % 40 + j) AS institution_id,
           'Inst ' || j AS institution_name, 'C' || j AS country_code, p_type AS institution_type,
           CAST(p_partkey % 40 + j AS VARCHAR) AS ror
    FROM part, unnest(range(1, p_partkey % 4 + 1)) AS t(i), unnest(range(1, i)) AS u(j)""")
def explode_nested2(spark, sf):
    return staging.work_author_institutions(f.landed_works(spark, sf))


@register("explode_year_counts", """
    SELECT 'W' || p_partkey AS work_id, CAST(1988 + p_size % 8 AS INTEGER) AS publication_year,
           CAST(1987 + p_size % 8 + 2 * i AS INTEGER) AS citation_year, (p_partkey + i) % 9 AS cited_by_count,
           CAST(2 * i - 1 AS INTEGER) AS years_since_publication
    FROM part, unnest(range(0, least(p_partkey % 4, 3))) AS t(i) WHERE p_partkey % 53 <> 0""")
def explode_year_counts(spark, sf):
    return staging.work_citations(f.landed_works(spark, sf))


@register("explode_primary_flag", """
    SELECT 'W' || p_partkey AS work_id, 'T' || (n % 10) AS topic_id, 'Topic ' || (n % 10) AS topic,
           CAST(p_size AS DOUBLE) / 100 AS topic_score, p_type AS domain, p_brand AS field,
           'Sub ' || (n % 5) AS subfield,
           CASE WHEN p_partkey % 37 <> 0 THEN n % 10 = p_size % 10 END AS is_primary
    FROM (SELECT *, p_size + 3 * i AS n FROM part, unnest(range(0, p_partkey % 3)) AS t(i))
    WHERE p_partkey % 53 <> 0""")
def explode_primary_flag(spark, sf):
    return staging.work_topics(f.landed_works(spark, sf))


@register("event_grid", """
    SELECT record_id, retraction_year, event_time, retraction_year + event_time AS citation_year
    FROM (SELECT record_id, year(retraction_date) AS retraction_year FROM records),
         unnest(range(-3, 3)) AS t(event_time) WHERE retraction_year IS NOT NULL""")
def event_grid(spark, sf):
    known = f.records(spark, sf).filter("retraction_year IS NOT NULL").select("record_id", "retraction_year")
    return generators.cross_offsets(known, -3, 2, "event_time").withColumn(
        "citation_year", F.col("retraction_year") + F.col("event_time")
    )


@register("unpivot_features", """
    SELECT p_partkey, feature, value FROM (
        SELECT p_partkey, 'size' AS feature, CAST(p_size AS DOUBLE) AS value FROM part
        UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part
        UNION ALL SELECT p_partkey, 'name_length', CAST(length(p_name) AS DOUBLE) FROM part)""")
def unpivot_features(spark, sf):
    measures = {"size": F.col("p_size"), "price": F.col("p_retailprice"), "name_length": F.length("p_name")}
    return generators.unpivot(f.table(spark, sf, "part"), ["p_partkey"], measures, "feature", "value")


# --- joins and aggregates ---------------------------------------------------------------------

@register("records_enriched", "SELECT * FROM enriched")
def records_enriched(spark, sf):
    return f.build_enriched(spark, sf)


@register("reason_flags", "SELECT * FROM reason_flags")
def reason_flags(spark, sf):
    return models.reason_flags(f.reasons(spark, sf))


@register("first_last_author", "SELECT * FROM author_facts")
def first_last_author(spark, sf):
    return models.author_features(f.authors(spark, sf))


@register("cross_source_match", "SELECT * FROM works_enriched")
def cross_source_match(spark, sf):
    return f.build_works_enriched(spark, sf)


@register("match_rate_by_year", f"""
    SELECT publication_year AS year, count(*) AS total, count(*) FILTER (WHERE matched_in_records) AS matched,
           count(*) FILTER (WHERE NOT matched_in_records) AS unmatched,
           {o.ratio('100 * count(*) FILTER (WHERE matched_in_records)', 'count(*)', 2)} AS match_rate
    FROM works_enriched WHERE publication_year IS NOT NULL GROUP BY publication_year""")
def match_rate_by_year(spark, sf):
    return events.match_rate_by_year(f.works_enriched(spark, sf))


@register("multi_distinct", """
    SELECT l_returnflag, count(DISTINCT l_orderkey) AS n_orders, count(DISTINCT l_partkey) AS n_parts,
           count(DISTINCT l_suppkey) AS n_suppliers, count(DISTINCT year(l_shipdate)) AS n_years
    FROM lineitem GROUP BY l_returnflag""")
def multi_distinct(spark, sf):
    return aggregates.distinct_counts(f.table(spark, sf, "lineitem"), ["l_returnflag"], {
        "n_orders": F.col("l_orderkey"), "n_parts": F.col("l_partkey"), "n_suppliers": F.col("l_suppkey"),
        "n_years": F.year("l_shipdate"),
    })


@register("distinct_rollup", """
    SELECT l_returnflag, l_linestatus, count(DISTINCT l_orderkey) AS n_orders FROM lineitem
    GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""")
def distinct_rollup(spark, sf):
    """Distinct orders at three levels from the bitmaps of the finest one, which are stored."""
    fine = ["l_returnflag", "l_linestatus"]
    bitmaps = materialize(aggregates.distinct_bitmaps(f.table(spark, sf, "lineitem"), fine, F.col("l_orderkey")), "bitmaps")
    levels = []
    for by in (fine, fine[:1], []):
        counted = aggregates.count_bitmaps(bitmaps, by, "n_orders")
        levels.append(counted.select(*[F.col(c) if c in by else F.lit(None).cast("string").alias(c) for c in fine], "n_orders"))
    return levels[0].unionByName(levels[1]).unionByName(levels[2])


_RANK_ERROR = 0.02


@register("latency_quantiles", """
    SELECT journal, count(*) AS n, median(retraction_latency_days)::DOUBLE AS exact_median, TRUE AS sketch_is_near
    FROM enriched WHERE journal IS NOT NULL AND retraction_latency_days IS NOT NULL GROUP BY journal
    UNION ALL
    SELECT NULL, count(*), median(retraction_latency_days)::DOUBLE, TRUE
    FROM enriched WHERE journal IS NOT NULL AND retraction_latency_days IS NOT NULL""")
def latency_quantiles(spark, sf):
    """Sketches per journal and year, stored and merged to journals and to all, beside exact medians.

    The sketch's median is near if its rank among all values is off by ``_RANK_ERROR`` at most.
    """
    rows = f.enriched(spark, sf).filter(F.col("journal").isNotNull() & F.col("retraction_latency_days").isNotNull()).select(
        "journal", "retraction_year", F.col("retraction_latency_days").alias("days"))
    stored = materialize(aggregates.quantile_sketches(rows, ["journal", "retraction_year"], "days"), "sketches")
    medians = [
        aggregates.merge_sketches(stored, by).select(*by, aggregates.sketch_quantile("sketch", 0.5).alias("near"), aggregates.sketch_rows("sketch").alias("n"))
        for by in (["journal"], [])
    ]
    exact = [F.median("days").alias("exact_median"), F.avg((F.col("days") < F.col("near")).cast("double")).alias("below"),
             F.avg((F.col("days") <= F.col("near")).cast("double")).alias("upto")]
    out = [
        rows.join(medians[0], "journal").groupBy("journal", "n").agg(*exact),
        rows.crossJoin(F.broadcast(medians[1])).groupBy(F.lit(None).cast("string").alias("journal"), "n").agg(*exact),
    ]
    within = (F.col("below") - _RANK_ERROR <= 0.5) & (F.col("upto") + _RANK_ERROR >= 0.5)
    return out[0].unionByName(out[1]).select("journal", "n", "exact_median", within.alias("sketch_is_near"))


@register("mode_per_key", """
    SELECT l_partkey, l_suppkey, n FROM (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY n DESC, l_suppkey) = 1""")
def mode_per_key(spark, sf):
    return aggregates.mode_per_key(f.table(spark, sf, "lineitem"), "l_partkey", "l_suppkey")


@register("peak_per_group", """
    SELECT journal, year AS peak_period, n_retractions AS peak_rows FROM year_activity
    QUALIFY row_number() OVER (PARTITION BY journal ORDER BY n_retractions DESC, year DESC) = 1""")
def peak_per_group(spark, sf):
    return aggregates.peak_per_group(
        f.records(spark, sf).withColumnRenamed("retraction_year", "year"), "journal", "year"
    )


@register("group_year_activity", "SELECT * FROM year_activity")
def group_year_activity(spark, sf):
    return models.journal_year_activity(f.enriched(spark, sf))


@register("group_profile", "SELECT * FROM profile")
def group_profile(spark, sf):
    return models.journal_profile(f.enriched(spark, sf))


@register("author_activity", """
    SELECT author_name, count(DISTINCT a.record_id) AS n_retractions, count(DISTINCT journal) AS n_journals,
           count(DISTINCT subject_code) AS n_subject_areas, count(DISTINCT retraction_year) AS n_active_years,
           count(DISTINCT first_country) AS n_countries,
           min(original_paper_year) AS first_paper_year, max(original_paper_year) AS last_paper_year,
           min(retraction_year) AS first_retraction_year, max(retraction_year) AS last_retraction_year,
           count(*) FILTER (WHERE is_paper_mill) AS n_paper_mill,
           count(*) FILTER (WHERE is_peer_review_fraud) AS n_peer_review_fraud,
           count(*) FILTER (WHERE is_ai_generated) AS n_ai_generated,
           count(*) FILTER (WHERE author_position = 1) AS n_first_author,
           count(*) FILTER (WHERE author_position = n_authors) AS n_last_author,
           round(median(retraction_latency_days), 1) AS median_latency_days
    FROM authors a JOIN enriched e ON e.record_id = a.record_id GROUP BY author_name""")
def author_activity(spark, sf):
    return models.author_activity(f.authors(spark, sf), f.enriched(spark, sf))


@register("latest_snapshot", """
    SELECT o_orderkey, o_custkey, date_trunc('month', o_orderdate)::DATE AS snapshot FROM orders
    WHERE date_trunc('month', o_orderdate) = (SELECT max(date_trunc('month', o_orderdate)) FROM orders)""")
def latest_snapshot_rows(spark, sf):
    dated = f.table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.trunc("o_orderdate", "month").alias("snapshot")
    )
    return latest_snapshot(dated, "snapshot")


# --- windows and ranks ------------------------------------------------------------------------

@register("trend_yoy", "SELECT * FROM trends")
def trend_yoy(spark, sf):
    return marts.retraction_trends(f.enriched(spark, sf))


@register("trend_by_day", """
    SELECT day, n, amount, lag(n) OVER w AS previous_n, n - lag(n) OVER w AS change_n,
           round(100 * (n - lag(n) OVER w)::DOUBLE / nullif(lag(n) OVER w, 0), 1) AS change_pct,
           CAST(sum(n) OVER (ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative_n,
           round(avg(n) OVER (ORDER BY day ROWS 2 PRECEDING), 1) AS mean3_n
    FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 2) AS amount FROM events GROUP BY ALL)
    WINDOW w AS (ORDER BY day)""")
def trend_by_day(spark, sf):
    daily = f.table(spark, sf, "events").groupBy(F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), fn.round_to(F.sum("value"), 2).alias("amount")
    )
    return marts.with_period_changes(daily, "day", "n", {
        "previous": "previous_n", "change": "change_n", "change_pct": "change_pct",
        "cumulative": "cumulative_n", "moving_mean": "mean3_n",
    })


@register("percent_rank_scores", "SELECT journal, pr_paper_mill, pr_burst, pr_volume, pr_peer_review, pr_ai, "
                                 "pr_intensity FROM ranked")
def percent_rank_scores(spark, sf):
    eligible = f.profile(spark, sf).filter(F.col("n_retractions") >= v.MIN_GROUP_RECORDS)
    return marts.percent_ranks(eligible, "journal", marts.RISK_MEASURES)


@register("average_rank", """
    SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag, l_quantity,
           rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS min_rank,
           rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity)
               + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS avg_rank
    FROM lineitem""")
def average_rank(spark, sf):
    rows = f.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_quantity")
    ranks = ranking.value_ranks(rows, "l_quantity", ["l_returnflag"])
    return ranking.attach_ranks(rows, ranks, "l_quantity", ["l_returnflag"]).select(
        *rows.columns, ranking.rank_min().alias("min_rank"), ranking.average_rank().alias("avg_rank")
    )


@register("pct_rank_average", """
    SELECT c_custkey, c_mktsegment, c_acctbal,
           (rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal)
            + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2)
           / count(*) OVER (PARTITION BY c_mktsegment) AS pct_rank
    FROM customer WHERE c_acctbal IS NOT NULL""")
def pct_rank_average(spark, sf):
    rows = f.table(spark, sf, "customer").filter("c_acctbal IS NOT NULL").select("c_custkey", "c_mktsegment", "c_acctbal")
    ranks = ranking.value_ranks(rows, "c_acctbal", ["c_mktsegment"])
    return ranking.attach_ranks(rows, ranks, "c_acctbal", ["c_mktsegment"]).select(
        *rows.columns, ranking.percent_average_rank().alias("pct_rank")
    )


# --- scores -----------------------------------------------------------------------------------

@register("risk_scores", "SELECT * FROM risk")
def risk_scores(spark, sf):
    return marts.journal_risk(f.profile(spark, sf))


@register("auc_validation", "SELECT * FROM validation")
def auc_validation(spark, sf):
    return marts.risk_score_validation(f.risk(spark, sf))


@register("feature_auc", "SELECT * FROM features")
def feature_auc(spark, sf):
    return marts.feature_discriminative_power(f.risk(spark, sf))


@register("tier_lift", "SELECT * FROM tiers")
def tier_lift(spark, sf):
    return marts.risk_tier_performance(f.risk(spark, sf))


@register("country_leaderboard", "SELECT * FROM country_board")
def country_leaderboard(spark, sf):
    return marts.country_leaderboard(f.countries(spark, sf), f.enriched(spark, sf))


@register("country_leaderboard_top", """
    SELECT country, n_retractions, n_as_sole_country, n_cooperative, share_of_global_pct, n_paper_mill,
           paper_mill_share, peer_review_fraud_share, ai_generated_share, median_latency_days, n_recent_5y,
           active_years, n_journals, rank_by_volume FROM country_board ORDER BY rank_by_volume LIMIT 15""")
def country_leaderboard_top(spark, sf):
    return serving.country_leaderboard(f.country_board(spark, sf), 15)


@register("reason_landscape", "SELECT * FROM reason_board")
def reason_landscape(spark, sf):
    return marts.reason_landscape(f.reasons(spark, sf), f.enriched(spark, sf))


@register("reason_landscape_top", """
    SELECT reason, n_records, median_latency_days, china_share,
           regexp_matches(reason, '(?i)Paper Mill|Peer Review|Rogue Editor|Computer-Generated|Image') AS is_systemic
    FROM reason_board ORDER BY rank_by_records LIMIT 15""")
def reason_landscape_top(spark, sf):
    return serving.top_reasons(reason_landscape(spark, sf), 15)


@register("journal_risk_top", """
    SELECT journal, publisher, n_retractions, active_years, first_year, last_year, peak_year, peak_year_retractions,
           burst_ratio, n_paper_mill, paper_mill_share, peer_review_fraud_share, ai_generated_share,
           median_latency_days, china_share, risk_score, risk_tier, structural_score
    FROM risk WHERE n_retractions >= 8 AND risk_tier = '高' ORDER BY risk_score DESC, journal LIMIT 100""")
def journal_risk_top(spark, sf):
    return serving.journal_risk(f.risk(spark, sf), 8, "高", 100)


@register("journal_top_share", """
    SELECT journal, n_retractions, paper_mill_share FROM risk ORDER BY paper_mill_share DESC, journal LIMIT 6""")
def journal_top_share(spark, sf):
    return serving.worst_journals_by_share(f.risk(spark, sf))


# --- event study ------------------------------------------------------------------------------

@register("ols_fit", """
    SELECT l_returnflag, count(*) AS n_points, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope,
           round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept
    FROM lineitem WHERE l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL GROUP BY l_returnflag""")
def ols_fit(spark, sf):
    fit = regression.ols_fit(f.table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return fit.select(
        "l_returnflag", "n_points", fn.round_to("slope", 3).alias("slope"), fn.round_to("intercept", 2).alias("intercept")
    )


@register("event_panel", "SELECT * FROM panel")
def event_panel(spark, sf):
    return f.build_panel(spark, sf)


@register("event_study", "SELECT * FROM study")
def event_study(spark, sf):
    return events.event_study(f.panel(spark, sf))


@register("event_study_by_group", "SELECT * FROM group_study")
def event_study_by_group(spark, sf):
    return events.event_study_by_group(f.panel(spark, sf))


@register("event_summary", "SELECT * FROM penalty")
def event_summary(spark, sf):
    return events.penalty_summary(f.study(spark, sf))


@register("event_extremes", """
    SELECT arg_min(event_time, citation_gap_pct) FILTER (WHERE is_post_retraction) AS worst_event_time,
           min(citation_gap_pct) FILTER (WHERE is_post_retraction) AS worst_gap_pct,
           max(abs(citation_gap)) FILTER (WHERE NOT is_post_retraction) AS max_abs_gap_before FROM study""")
def event_extremes(spark, sf):
    return events.event_extremes(f.study(spark, sf))


# --- graph ------------------------------------------------------------------------------------

@register("pair_edges", "SELECT * FROM edges")
def pair_edges(spark, sf):
    return f.build_edges(spark, sf)


@register("edges_min_weight", "SELECT author_a, author_b, n_shared_works, n_fields FROM edges WHERE n_shared_works >= 3")
def edges_min_weight(spark, sf):
    strong = models.coauthor_edges(f.authorships(spark, sf), f.works_of_orders(spark, sf), min_shared=3)
    return strong.select("author_a", "author_b", "n_shared_works", "n_fields")


def _build_part_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Parts that were ordered together at least twice, weighted by the number of orders."""
    shared = pairs.shared_groups(f.table(spark, sf, "lineitem"), "l_orderkey", "l_partkey")
    return shared.groupBy("a", "b").agg(F.count(F.lit(1)).alias("weight"))


def _part_edges(spark: SparkSession, sf: str) -> DataFrame:
    return f.stored(spark, sf, "part_edges", _build_part_edges)


@register("weighted_pairs", "SELECT * FROM part_edges")
def weighted_pairs(spark, sf):
    return _build_part_edges(spark, sf)


@register("graph_stats", """
    SELECT (SELECT count(*) FROM (SELECT a FROM part_edges UNION SELECT b FROM part_edges)) AS n_nodes,
           (SELECT count(*) FROM part_edges) AS n_edges""")
def graph_stats(spark, sf):
    return graph.graph_stats(_part_edges(spark, sf))


@register("connected_components", "SELECT * FROM part_components")
def connected_components(spark, sf):
    return graph.connected_components(_part_edges(spark, sf))


def _part_communities(spark: SparkSession, sf: str) -> DataFrame:
    return f.stored(spark, sf, "part_communities", lambda s, d: graph.communities(_part_edges(s, d)))


@register("communities")
def communities(spark, sf):
    return _part_communities(spark, sf)


@register("community_quality", """
    SELECT count(*) AS n_rows, count(DISTINCT node) AS n_nodes, count(DISTINCT component) AS n_components,
           CAST(sum(component) AS BIGINT) AS component_sum, TRUE AS none_crosses, TRUE AS none_below_zero,
           TRUE AS split_well, TRUE AS all_connected
    FROM part_components
    WHERE component IN (SELECT component FROM part_components GROUP BY component HAVING count(*) >= 3)""")
def community_quality(spark, sf):
    """What any good labelling has; 0.58 is a bound for the part graph of the 0.01 tables."""
    labels = _part_communities(spark, sf)
    crossing = labels.groupBy("community").agg(F.count_distinct("component").alias("n")).agg(F.max("n").alias("most"))
    found = graph.community_modularity(_part_edges(spark, sf), labels)
    total = F.sum(F.col("modularity") * F.col("two_m")) / F.sum("two_m")
    split = found.agg(F.min("modularity").alias("least"), total.alias("total"))
    return labels.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("node").alias("n_nodes"),
        F.count_distinct("component").alias("n_components"), F.sum("component").alias("component_sum"),
    ).crossJoin(F.broadcast(crossing)).crossJoin(F.broadcast(split)).crossJoin(
        F.broadcast(graph.all_connected(_part_edges(spark, sf), labels))
    ).select(
        "all_connected", "n_rows", "n_nodes", "n_components", "component_sum", (F.col("most") == 1).alias("none_crosses"),
        (F.col("least") >= -1e-9).alias("none_below_zero"), (F.col("total") >= 0.58).alias("split_well"),
    )


@register("cluster_profile", "SELECT * FROM cluster_profile")
def cluster_profile(spark, sf):
    return network.cluster_profile(f.edges(spark, sf), f.membership(spark, sf))


@register("cluster_scores", "SELECT * FROM cluster_scores")
def cluster_scores(spark, sf):
    return network.cluster_scores(f.cluster_profile(spark, sf))


@register("cluster_validation", "SELECT * FROM cluster_validation")
def cluster_validation(spark, sf):
    n_pairs = pairs.count_pairs_by_edges(
        f.authorships(spark, sf), "work_id", "author_id", f.edges(spark, sf), "n_shared_works"
    )
    return network.cluster_validation(f.cluster_scores(spark, sf), n_pairs)


@register("cluster_members", "SELECT * FROM cluster_members")
def cluster_members(spark, sf):
    return network.cluster_members(f.membership(spark, sf), f.cluster_scores(spark, sf), f.authorships(spark, sf))


@register("density_by_size", """
    SELECT n_authors, count(*) AS n_clusters, round(avg(density), 4) AS avg_density,
           round(avg(CASE WHEN density >= 0.999 THEN 1::DOUBLE ELSE 0::DOUBLE END), 4) AS saturated_share
    FROM cluster_profile WHERE n_authors BETWEEN 3 AND 30 GROUP BY n_authors""")
def density_by_size(spark, sf):
    return network.density_by_size(f.cluster_profile(spark, sf))


@register("clusters_by", """
    SELECT cluster_id, n_authors, n_edges, density, total_shared_works, n_paper_mill_works, paper_mill_edge_share,
           max_journals_in_edge, max_fields_in_edge, first_year, last_year, year_span, works_per_author_year,
           cluster_risk_score, cluster_structural_score
    FROM cluster_scores WHERE n_authors >= 4 ORDER BY total_shared_works DESC, cluster_id LIMIT 50""")
def clusters_by(spark, sf):
    return serving.author_clusters(f.cluster_scores(spark, sf), 4, 50, "total_shared_works")


_SEVERITY, _STRUCTURAL = v.CLUSTER_SCORE_NAMES.values()


@register("network_summary", f"""
    SELECT (SELECT count(*) FROM (SELECT author_a FROM edges UNION SELECT author_b FROM edges)) AS n_nodes,
           (SELECT count(*) FROM edges) AS n_edges,
           (SELECT count(DISTINCT cluster_id) FROM membership) AS n_communities,
           (SELECT count(*) FROM cluster_scores) AS n_clusters_scored,
           (SELECT cluster_id FROM cluster_scores ORDER BY cluster_risk_score DESC, cluster_id LIMIT 1) AS top_cluster_id,
           (SELECT max(auc) FROM cluster_auc WHERE score_name = '{_SEVERITY}') AS auc_severity,
           (SELECT max(auc) FROM cluster_auc WHERE score_name = '{_STRUCTURAL}') AS auc_structural""")
def network_summary(spark, sf):
    return network.network_summary(f.edges(spark, sf), f.membership(spark, sf), f.cluster_scores(spark, sf))


# --- quality ----------------------------------------------------------------------------------

def _year_count(x: str) -> str:
    return f"(SELECT count(*) FROM {x})"


_ORPHANS = "SELECT count(*) FROM ({child}) c WHERE NOT EXISTS (SELECT 1 FROM staged p WHERE p.record_id = c.record_id)"
_BAD_SHARES = " OR ".join(
    f"{c} NOT BETWEEN 0 AND 1" for c in ("paper_mill_share", "peer_review_fraud_share", "ai_generated_share", "china_share")
)
CHECK_SQL = {
    "record key not null": "SELECT count(*) FROM staged WHERE record_id IS NULL",
    "record key unique": "SELECT count(*) - count(DISTINCT record_id) FROM staged",
    "date parse rate": "SELECT CASE WHEN count(retraction_date) / count(*) < 0.995 THEN 1 ELSE 0 END FROM staged",
    "date not in the future": "SELECT count(*) FROM staged WHERE retraction_date > DATE '2002-01-01'",
    "date not before 1900": "SELECT count(*) FROM staged WHERE retraction_date < DATE '1900-01-01'",
    "end date not before start date": "SELECT count(*) FROM staged WHERE retraction_date < original_paper_date",
    "nature in vocabulary": "SELECT count(*) FROM staged WHERE retraction_nature NOT IN "
                            f"({', '.join(repr(n) for n in v.NATURES)})",
    "reason not blank": "SELECT count(*) FROM lineitem WHERE l_linenumber = 7",
    "reasons have a record": _ORPHANS.format(child="SELECT 2 * l_orderkey AS record_id FROM lineitem"),
    "countries have a record": _ORPHANS.format(child="SELECT l_orderkey + 1000 AS record_id FROM lineitem"),
    "authors have a record": _ORPHANS.format(child="SELECT 3 * l_orderkey AS record_id FROM lineitem"),
    "author positions contiguous": "SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey "
                                   "HAVING min(l_linenumber) <> 1 OR max(l_linenumber) <> count(*))",
    "enough records": f"SELECT CASE WHEN {_year_count('staged')} < 50000 THEN 1 ELSE 0 END",
    "records fresh": "SELECT CASE WHEN max(retraction_date) < DATE '2002-01-01' - 400 THEN 1 ELSE 0 END FROM staged",
    "burst ratio in (0, 1]": "SELECT count(*) FROM profile WHERE burst_ratio <= 0 OR burst_ratio > 1.0001",
    "peak within total": "SELECT count(*) FROM profile WHERE peak_year_retractions > n_retractions",
    "shares in [0, 1]": f"SELECT count(*) FROM profile WHERE {_BAD_SHARES}",
    "score in [0, 100]": "SELECT count(*) FROM risk WHERE risk_score NOT BETWEEN 0 AND 100",
    "global share in [0, 100]": "SELECT count(*) FROM country_board WHERE share_of_global_pct NOT BETWEEN 0 AND 100",
    "sole within total": "SELECT count(*) FROM country_board WHERE n_as_sole_country > n_retractions",
    "every eligible journal scored": "SELECT abs((SELECT count(*) FROM risk) "
                                     "- (SELECT count(*) FROM profile WHERE n_retractions >= 5))",
    "trend covers every year": "SELECT abs((SELECT count(*) FROM trends) "
                               "- (SELECT count(DISTINCT retraction_year) FROM enriched))",
    "cumulative equals recomputed": "SELECT count(*) FROM (SELECT cumulative_retractions AS c, "
                                    "sum(n_retractions) OVER (ORDER BY year) AS again FROM trends) WHERE c <> again",
    "AUC in [0, 1]": "SELECT count(*) FROM features WHERE auc NOT BETWEEN 0 AND 1",
    "structural AUC at least 0.5": "SELECT CASE WHEN max(auc) < 0.5 THEN 1 ELSE 0 END FROM validation "
                                   "WHERE score_name LIKE 'structural%'",
    "tiers not inverted": "SELECT count(*) FROM (SELECT precision_rate AS p, "
                          "lag(precision_rate) OVER (ORDER BY min_score DESC) AS q FROM tiers) WHERE p > q + 0.05",
    "work key unique": "SELECT count(*) - count(DISTINCT work_id) FROM works",
    "author count equals author rows": "SELECT count(*) FROM works w LEFT JOIN (SELECT 'W' || p_partkey AS work_id, "
                                       "count(*) AS n FROM part, unnest(range(0, p_partkey % 4)) AS t(i) GROUP BY 1) a "
                                       "ON a.work_id = w.work_id WHERE w.n_authors <> coalesce(a.n, 0)",
    "few citations before publication": "SELECT CASE WHEN avg(CASE WHEN i = 0 THEN 1::DOUBLE ELSE 0::DOUBLE END) > 0.02 "
                                        "THEN 1 ELSE 0 END FROM part, unnest(range(0, p_partkey % 4)) AS t(i) "
                                        "WHERE p_partkey % 53 <> 0",
    "enough works": f"SELECT CASE WHEN {_year_count('works')} < 30000 THEN 1 ELSE 0 END",
    "sources share keys": "SELECT CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM works JOIN staged ON doi = original_paper_doi",
    "panel balanced": "SELECT CASE WHEN count(DISTINCT n_works) > 1 THEN 1 ELSE 0 END FROM study",
    "no bias before the event": "SELECT CASE WHEN abs(max(mean_gap_before_retraction)) > 0.5 THEN 1 ELSE 0 END FROM penalty",
    "panel covers the window": f"SELECT CASE WHEN {_year_count('study')} <> 6 THEN 1 ELSE 0 END",
    "match rate at least 40 %": "SELECT CASE WHEN avg(CASE WHEN matched_in_records THEN 1::DOUBLE ELSE 0::DOUBLE END) < 0.4 "
                                "THEN 1 ELSE 0 END FROM works_enriched",
    "members have a cluster": "SELECT count(*) FROM edges WHERE author_a NOT IN (SELECT cluster_id FROM cluster_scores)",
    "small clusters not all saturated": "SELECT CASE WHEN avg(CASE WHEN density >= 0.999 THEN 1::DOUBLE ELSE 0::DOUBLE END) "
                                        "> 0.99 THEN 1 ELSE 0 END FROM cluster_scores WHERE n_authors = 3",
    "cluster AUC at least 0.5": "SELECT CASE WHEN max(auc) < 0.5 THEN 1 ELSE 0 END FROM cluster_validation",
}


def _check_oracle(chosen: tuple[str, ...] | None) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS check_name, CAST(({sql}) AS BIGINT) AS violations"
        for name, sql in CHECK_SQL.items() if chosen is None or name in chosen
    )


def _check_tables(spark: SparkSession, sf: str, wanted: set[str]) -> dict[str, DataFrame]:
    """The tables the chosen checks read."""
    def children(key: Column, *more: Column) -> DataFrame:
        return f.table(spark, sf, "lineitem").select(key.cast("bigint").alias("record_id"), *more)

    makers: dict[str, Callable[[], DataFrame]] = {
        "records": lambda: f.staged(spark, sf),
        # Lines of shifted orders stand for children, so that these checks have something to find.
        "record_reasons": lambda: children(
            2 * F.col("l_orderkey"),
            F.when(F.col("l_linenumber") == 7, F.lit(" ")).otherwise(F.col("l_returnflag")).alias("reason"),
        ),
        "record_countries": lambda: children(F.col("l_orderkey") + 1000),
        "record_authors": lambda: children(3 * F.col("l_orderkey"), F.col("l_linenumber").alias("author_position")),
        "works": lambda: f.staged_works(spark, sf),
        "work_authorships": lambda: f.work_authorships(spark, sf),
        "work_citations": lambda: f.work_citations(spark, sf),
        "records_enriched": lambda: f.enriched(spark, sf),
        "journal_profile": lambda: f.profile(spark, sf),
        "journal_risk": lambda: f.risk(spark, sf),
        "feature_discriminative_power": lambda: f.features(spark, sf),
        "risk_score_validation": lambda: f.validation(spark, sf),
        "risk_tier_performance": lambda: f.tiers(spark, sf),
        "country_leaderboard": lambda: f.country_board(spark, sf),
        "retraction_trends": lambda: f.trends(spark, sf),
        "works_enriched": lambda: f.works_enriched(spark, sf),
        "event_study": lambda: f.study(spark, sf),
        "penalty_summary": lambda: f.penalty(spark, sf),
        "author_clusters": lambda: f.cluster_scores(spark, sf),
        # The lower author of an edge as its cluster: right only for the smallest author of a cluster.
        "author_cluster_members": lambda: f.edges(spark, sf).select(
            F.col("author_b").alias("author_id"), F.col("author_a").alias("cluster_id")
        ),
        "author_cluster_validation": lambda: f.cluster_validation(spark, sf),
    }
    return {name: make() for name, make in makers.items() if name in wanted}


def _run_checks(spark: SparkSession, sf: str, chosen: tuple[str, ...] | None) -> DataFrame:
    checks = [c for c in f.checks() if chosen is None or c.name in chosen]
    read = _check_tables(spark, sf, {t for c in checks for t in c.tables})
    return quality.run_checks(read, checks, f.observed(spark, sf))


CHECK_GROUPS = {
    "qc_keys": ("record key not null", "record key unique", "work key unique"),
    "qc_dates": ("date parse rate", "date not in the future", "date not before 1900",
                 "end date not before start date", "records fresh"),
    "qc_vocab": ("nature in vocabulary", "reason not blank"),
    "qc_fk_orphans": ("reasons have a record", "countries have a record", "authors have a record",
                      "members have a cluster"),
    "qc_position_contiguous": ("author positions contiguous",),
    "qc_ranges": ("burst ratio in (0, 1]", "peak within total", "shares in [0, 1]", "score in [0, 100]",
                  "global share in [0, 100]", "sole within total", "AUC in [0, 1]"),
    "qc_row_reconcile": ("every eligible journal scored", "trend covers every year"),
    "qc_cumulative": ("cumulative equals recomputed",),
    "qc_tier_inversion": ("tiers not inverted",),
    "qc_count_reconcile": ("author count equals author rows",),
    "qc_thresholds": ("enough records", "structural AUC at least 0.5", "few citations before publication",
                      "enough works", "sources share keys", "no bias before the event", "match rate at least 40 %",
                      "small clusters not all saturated", "cluster AUC at least 0.5"),
    "qc_panel_balance": ("panel balanced", "panel covers the window"),
}


def _register_group(key: str, chosen: tuple[str, ...]) -> None:
    @register(key, _check_oracle(chosen))
    def run(spark, sf):
        return _run_checks(spark, sf, chosen).select("check_name", "violations")


for _key, _chosen in CHECK_GROUPS.items():
    _register_group(_key, _chosen)


_WARNINGS = (
    "date not before 1900", "nature in vocabulary", "records fresh", "tiers not inverted",
    "author count equals author rows",
    "few citations before publication", "sources share keys", "no bias before the event", "match rate at least 40 %",
    "small clusters not all saturated",
)
_REPORT_SQL = f"""
    SELECT check_name, violations, severity,
           CASE WHEN violations = 0 THEN 'passed' ELSE 'failed_' || severity END AS status,
           violations > 0 AND severity = 'error' AS blocks_release
    FROM (SELECT *, CASE WHEN check_name IN ({', '.join(repr(n) for n in _WARNINGS)}) THEN 'warning' ELSE 'error' END
                 AS severity FROM ({_check_oracle(None)}))"""


def _build_report(spark: SparkSession, sf: str) -> DataFrame:
    return _run_checks(spark, sf, None)


def _report(spark: SparkSession, sf: str) -> DataFrame:
    return f.stored(spark, sf, "qc_report", _build_report)


@register("qc_report", _REPORT_SQL)
def qc_report(spark, sf):
    return _report(spark, sf).select("check_name", "violations", "severity", "status", "blocks_release")


@register("qc_summary", f"""
    SELECT count(*) AS total, count(*) FILTER (WHERE status = 'passed') AS passed, CAST(0 AS BIGINT) AS errored,
           count(*) FILTER (WHERE status = 'failed_error') AS failed_error,
           count(*) FILTER (WHERE status = 'failed_warning') AS failed_warning FROM ({_REPORT_SQL})""")
def qc_summary(spark, sf):
    return quality.summarize(_report(spark, sf))


# --- profile, audit, serving ------------------------------------------------------------------

@register("load_audit", f"""
    SELECT 'records' AS dataset, count(*) AS rows_read, count(*) FILTER (WHERE trim(id) <> '') AS rows_kept,
           count(*) FILTER (WHERE trim(id) = '') AS rows_dropped, '{v.BLANK_ROW_REASON}' AS drop_reason,
           {o.LOADED} AS loaded_at, 'orders' AS source_file FROM raw_records
    UNION ALL
    SELECT 'works', count(*), count(*) FILTER (WHERE p_partkey % 53 <> 0), count(*) FILTER (WHERE p_partkey % 53 = 0),
           '{v.NULL_KEY_REASON}', {o.LOADED}, 'part' FROM part""")
def load_audit(spark, sf):
    return staging.load_audit(f.raw_records(spark, sf), f.landed_works(spark, sf), f.LOADED_AT)


_TABLES = (
    "benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation",
    "orders", "pages", "part", "region", "supplier",
)


@register("table_row_counts", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in _TABLES))
def table_row_counts(spark, sf):
    return aggregates.row_counts({t: f.table(spark, sf, t) for t in _TABLES})


_STAGED_TEXT = ("title", "journal", "author_raw", "reason_raw", "notes", "urls", "retraction_date", "retraction_pubmed_id")


@register("null_rates", "SELECT column_name, null_pct FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(100 * avg(CASE WHEN {c} IS NULL THEN 1::DOUBLE ELSE 0::DOUBLE END), 1) "
    f"AS null_pct, avg(CASE WHEN {c} IS NULL THEN 1::DOUBLE ELSE 0::DOUBLE END) AS raw FROM staged"
    for c in _STAGED_TEXT) + ") ORDER BY raw DESC, column_name LIMIT 5")
def null_rates(spark, sf):
    return aggregates.null_rates(f.staged(spark, sf), _STAGED_TEXT)


# The serving functions over the built tables, with their own defaults.

@register("serving_trends", """
    SELECT year, n_retractions, n_paper_mill, n_peer_review_fraud, n_ai_generated, paper_mill_share, median_latency_days,
           ma3_retractions, yoy_change_pct, cumulative_retractions FROM trends WHERE year BETWEEN 1990 AND 2030""")
def serving_trends(spark, sf):
    return serving.trends(f.trends(spark, sf))


@register("serving_risk_validation", "SELECT score_name, n_journals_total, auc, auc_grade FROM validation")
def serving_risk_validation(spark, sf):
    return serving.risk_validation(marts.risk_score_validation(f.risk(spark, sf)))


@register("serving_feature_power", "SELECT * FROM features")
def serving_feature_power(spark, sf):
    return serving.feature_power(marts.feature_discriminative_power(f.risk(spark, sf)))


@register("serving_risk_tiers", "SELECT * FROM tiers")
def serving_risk_tiers(spark, sf):
    return serving.risk_tier_performance(marts.risk_tier_performance(f.risk(spark, sf)))


@register("serving_event_study", """
    SELECT event_time, n_works, mean_citations, counterfactual_citations, citation_gap, citation_gap_pct, data_coverage,
           is_post_retraction FROM study""")
def serving_event_study(spark, sf):
    return serving.event_study(f.study(spark, sf))


@register("serving_event_study_by_group", """
    SELECT group_name, event_time, n_works, mean_citations, counterfactual_citations, citation_gap, citation_gap_pct
    FROM group_study""")
def serving_event_study_by_group(spark, sf):
    return serving.event_study_by_group(events.event_study_by_group(f.panel(spark, sf)))


@register("serving_cluster_validation", "SELECT * FROM cluster_validation")
def serving_cluster_validation(spark, sf):
    return serving.cluster_validation(f.cluster_validation(spark, sf))


@register("exported_report", f"SELECT check_name, violations, status FROM ({_REPORT_SQL})")
def exported_report(spark, sf):
    """The report as written to JSON and read again."""
    path = scratch_path(spark, "report-json")
    tables.export_json(_report(spark, sf), path)
    return spark.read.schema("check_name string, violations long, status string").json(path)


@register("serving_risk_map", "SELECT journal, n_retractions, paper_mill_share, burst_ratio, risk_score, risk_tier FROM risk")
def serving_risk_map(spark, sf):
    return serving.risk_map(f.risk(spark, sf))


@register("serving_cluster_members", """
    SELECT author_name, orcid, author_id FROM cluster_members
    WHERE cluster_id = (SELECT min(cluster_id) FROM cluster_members) ORDER BY author_name, author_id LIMIT 50""")
def serving_cluster_members(spark, sf):
    members = network.cluster_members(f.membership(spark, sf), f.cluster_scores(spark, sf), f.authorships(spark, sf))
    return serving.cluster_members(members, members.agg(F.min("cluster_id")).first()[0])


@register("date_profile", f"""
    SELECT min(d) AS first_date, max(d) AS last_date, count(*) FILTER (WHERE d IS NULL) AS n_unparsable
    FROM (SELECT {o.parsed('retracted')} AS d FROM raw_records)""")
def date_profile(spark, sf):
    return profiling.date_profile(f.raw_records(spark, sf), "RetractionDate")


@register("top_values", """
    SELECT retraction_nature, count(*) AS n FROM staged WHERE retraction_nature IS NOT NULL
    GROUP BY ALL ORDER BY n DESC, retraction_nature LIMIT 10""")
def top_values(spark, sf):
    return aggregates.top_values(f.staged(spark, sf), "retraction_nature", 10)


@register("top_values_exploded", """
    SELECT trim(part) AS country, count(*) AS n FROM raw_records, unnest(string_split(country, ';')) AS t(part)
    WHERE trim(part) <> '' GROUP BY ALL ORDER BY n DESC, 1 LIMIT 10""")
def top_values_exploded(spark, sf):
    return profiling.top_values_exploded(f.raw_records(spark, sf), "Country", "country", 10)


@register("top_words", r"""
    SELECT word, count(*) AS n FROM (SELECT trim(part) AS word FROM documents, unnest(string_split(text, ' ')) AS t(part))
    WHERE word <> '' GROUP BY word ORDER BY n DESC, word LIMIT 15""")
def top_words(spark, sf):
    words = f.table(spark, sf, "documents").select(F.explode(fn.split_multi("text", " ")).alias("word"))
    return aggregates.top_values(words, "word", 15)


@register("count_by_year", f"""
    SELECT year({o.parsed('retracted')}) AS year, count(*) AS n FROM raw_records
    WHERE {o.parsed('retracted')} IS NOT NULL GROUP BY ALL""")
def count_by_year(spark, sf):
    return profiling.count_by_year(f.raw_records(spark, sf), "RetractionDate")


@register("latency_histogram", """
    SELECT bin, lo + bin * w AS bin_start, lo + (bin + 1) * w AS bin_end, count(*) AS n
    FROM (SELECT least(CAST(floor((x - lo) / w) AS BIGINT), 59) AS bin, lo, w
          FROM (SELECT x, min(x) OVER () AS lo, (max(x) OVER () - min(x) OVER ()) / 60::DOUBLE AS w
                FROM (SELECT datediff('day', original_paper_date, retraction_date) / 365.25::DOUBLE AS x FROM records)
                WHERE x BETWEEN 0 AND 12000 / 365.25::DOUBLE))
    GROUP BY bin, lo, w""")
def latency_histogram(spark, sf):
    dated = f.records(spark, sf).select(
        fn.days_between("original_paper_date", "retraction_date").alias("retraction_latency_days")
    )
    return aggregates.latency_histogram(dated)


@register("latency_by_year", """
    SELECT year, median_latency_days / 365.25::DOUBLE AS median_years, n_retractions FROM trends
    WHERE year BETWEEN 1990 AND 2025 AND median_latency_days IS NOT NULL""")
def latency_by_year(spark, sf):
    return serving.latency_by_year(f.trends(spark, sf), 1990)


@register("overview_metrics", """
    SELECT (SELECT count(*) FROM records) AS records, (SELECT count(DISTINCT journal) FROM records) AS journals,
           (SELECT count(*) FROM works) AS works, (SELECT count(*) FROM works_enriched) AS linked_works,
           (SELECT count(*) FROM works_enriched WHERE matched_in_records) AS matched,
           (SELECT count(*) FROM enriched WHERE is_paper_mill) AS paper_mill,
           (SELECT count(*) FROM risk) AS scored_journals, (SELECT count(*) FROM cluster_scores) AS clusters,
           (SELECT count(DISTINCT country) FROM countries) AS countries""")
def overview_metrics(spark, sf):
    return serving.overview_metrics(
        f.records(spark, sf), f.works(spark, sf), f.works_enriched(spark, sf), f.enriched(spark, sf),
        f.risk(spark, sf), f.cluster_scores(spark, sf), f.countries(spark, sf),
    )


_COLUMNS = {
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "labels": "doc_id bigint, quality int, toxic int",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "pages": "page_id bigint, url string, html string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
}
_PROFILE = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, CAST({n} AS INTEGER) AS position, '{c.split()[0]}' AS column_name, "
    f"'{c.split()[1]}' AS data_type, (SELECT count(*) FROM {t}) AS n_rows"
    for t, columns in _COLUMNS.items() for n, c in enumerate(columns.split(", "), start=1)
)


@register("table_profile", _PROFILE)
def table_profile(spark, sf):
    return profiling.table_profile({t: f.table(spark, sf, t) for t in _TABLES})


@register("doc_coverage", f"""
    SELECT table_name, count(*) AS n_columns, count(*) FILTER (WHERE column_name NOT LIKE '%key') AS n_documented,
           {o.ratio("100 * count(*) FILTER (WHERE column_name NOT LIKE '%key')", 'count(*)', 1)} AS coverage_pct
    FROM ({_PROFILE}) GROUP BY table_name""")
def doc_coverage(spark, sf):
    profile = table_profile(spark, sf)
    described = profile.filter(~F.col("column_name").endswith("key")).select(
        "column_name", F.col("data_type").alias("description")
    )
    return profiling.documentation_coverage(profile, described)


_DESCRIBED = {
    "region": {"r_name": "name of the region"},
    "nation": {"n_name": "name of the nation", "n_regionkey": "region of the nation"},
    "supplier": {"s_name": "name of the supplier", "s_nationkey": "nation of the supplier", "s_acctbal": "balance"},
    "part": {"p_brand": "brand", "p_size": "size, 1 to 50"},
}


def _described(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The tables published with comments and read back."""
    root = scratch_path(spark, "described")
    return {t: tables.publish(f.table(spark, sf, t), root, "dims", t, comments=notes) for t, notes in _DESCRIBED.items()}


@register("stored_comments", """
    SELECT * FROM (VALUES
        ('region', 'r_regionkey', NULL), ('region', 'r_name', 'name of the region'),
        ('nation', 'n_nationkey', NULL), ('nation', 'n_name', 'name of the nation'),
        ('nation', 'n_regionkey', 'region of the nation'),
        ('supplier', 's_suppkey', NULL), ('supplier', 's_name', 'name of the supplier'),
        ('supplier', 's_nationkey', 'nation of the supplier'), ('supplier', 's_acctbal', 'balance'),
        ('part', 'p_partkey', NULL), ('part', 'p_name', NULL), ('part', 'p_brand', 'brand'), ('part', 'p_type', NULL),
        ('part', 'p_size', 'size, 1 to 50'), ('part', 'p_retailprice', NULL)
    ) AS t(table_name, column_name, description)""")
def stored_comments(spark, sf):
    return profiling.stored_descriptions(_described(spark, sf))


@register("stored_coverage", """
    SELECT * FROM (VALUES ('region', 2::BIGINT, 1::BIGINT, 50.0::DOUBLE), ('nation', 3, 2, 66.7), ('supplier', 4, 3, 75.0),
                          ('part', 6, 2, 33.3)) AS t(table_name, n_columns, n_documented, coverage_pct)""")
def stored_coverage(spark, sf):
    return profiling.stored_coverage(_described(spark, sf))


_STAGED_COLUMNS = (
    "record_id", "title", "journal", "publisher", "institution_raw", "author_raw", "country_raw", "subject_raw",
    "article_type_raw", "reason_raw", "notes", "urls", "retraction_date", "original_paper_date", "retraction_year",
    "original_paper_year", "retraction_doi", "original_paper_doi", "retraction_pubmed_id", "original_paper_pubmed_id",
    "retraction_nature", "paywalled", "source_file", "loaded_at",
)


@register("source_profile", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(100 * avg(CASE WHEN {c} IS NULL THEN 1::DOUBLE ELSE 0::DOUBLE END), 1) AS null_pct, "
    f"count(*) AS n_rows, 24 AS n_columns FROM staged" for c in _STAGED_COLUMNS))
def source_profile(spark, sf):
    return profiling.source_profile(f.staged(spark, sf))


# --- sources and streaming --------------------------------------------------------------------

@register("scan_csv_records", "SELECT * EXCLUDE (source_file) FROM staged")
def scan_csv_records(spark, sf):
    path = scratch_path(spark, "records-csv")
    write_records_csv(f.raw_records(spark, sf), path)
    return staging.stage_records(read_records_csv(spark, path), f.LOADED_AT).drop("source_file")


@register("newest_snapshot_files", """
    SELECT o_orderkey, o_custkey FROM orders
    WHERE date_trunc('year', o_orderdate) = (SELECT max(date_trunc('year', o_orderdate)) FROM orders)""")
def newest_snapshot_files(spark, sf):
    """A dated file per year of orders; only those of the newest year are opened."""
    path = scratch_path(spark, "snapshots")
    dated = f.table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"))
    for (year,) in sorted(dated.select("y").distinct().collect()):  # a row per year
        dated.filter(F.col("y") == year).drop("y").write.option("header", True).csv(f"{path}/orders_{year}1231.csv")
    chosen = newest_files(spark, f"{path}/*", stamp=r"_(\d{8})\.csv/")
    return spark.read.option("header", True).schema("o_orderkey bigint, o_custkey bigint").csv(chosen)


@register("scan_json_pages", "SELECT * EXCLUDE (source_file) FROM works")
def scan_json_pages(spark, sf):
    path = scratch_path(spark, "work-pages")
    write_work_pages(f.landed_works(spark, sf).select(F.array("w").alias("results")), path)
    return staging.stage_works(read_work_pages(spark, f"{path}/*.json.gz", False), f.LOADED_AT).drop("source_file")


@register("incremental_load", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def incremental_load(spark, sf):
    """Two runs: even keys in several files; then odd keys, and every tenth key once more."""
    rows = f.table(spark, sf, "events")
    source, target = scratch_path(spark, "arriving"), scratch_path(spark, "landed")
    odd = F.col("event_id") % 2 == 1
    for arriving in (rows.filter(~odd), rows.filter(odd).unionByName(rows.filter(F.col("event_id") % 10 == 0))):
        arriving.repartition(4).write.mode("append").parquet(source)
        stream = stream_files(spark, source, rows.schema)
        land_new_files(stream, target, f"{target}-checkpoint", "event_id")
    return spark.read.schema(rows.schema).parquet(target)


_WORKS_PER_PAGE = 50


def _write_pages(spark: SparkSession, sf: str, path: str, chosen: Column | None = None) -> None:
    """Parts as gzip pages of up to 50 works, one file each; some are cut off, some have an error in place of the list."""
    page = (F.col("p_partkey") / _WORKS_PER_PAGE).cast("int")
    numbered = f.landed_works(spark, sf, "p_partkey").withColumn("page", page)
    if chosen is not None:
        numbered = numbered.filter(chosen)
    pages = numbered.groupBy("page").agg(F.collect_list("w").alias("results"))
    text = F.to_json(F.struct(F.struct(F.size("results").alias("count")).alias("meta"), "results"))
    cut = F.when(F.col("page") % 7 == 2, F.substring(text, F.lit(1), (F.length(text) / 2).cast("int"))).when(
        F.col("page") % 7 == 4, F.lit('{"error": "try again"}')).otherwise(text)
    # A file per page, as the source delivers them.
    out = pages.select("page", cut.alias("value")).repartition("page")
    out.write.mode("append").partitionBy("page").option("compression", "gzip").option("maxRecordsPerFile", 1).text(path)


def _landed_pages(spark: SparkSession, sf: str) -> tuple[DataFrame, str]:
    path = scratch_path(spark, "pages")
    _write_pages(spark, sf, path)
    return materialize(read_work_pages(spark, f"{path}/page=*/*.gz"), "landed-pages"), f"{path}/page=*/*.gz"


@register("quarantined_pages", f"""
    SELECT DISTINCT p_partkey // {_WORKS_PER_PAGE} AS page,
           CASE (p_partkey // {_WORKS_PER_PAGE}) % 7 WHEN 2 THEN 'malformed page' ELSE 'no list of works' END AS problem
    FROM part WHERE (p_partkey // {_WORKS_PER_PAGE}) % 7 IN (2, 4)""")
def quarantined_pages(spark, sf):
    """Broken pages by name."""
    landed, path = _landed_pages(spark, sf)
    return quarantine(landed, path).select(
        F.regexp_extract("source_file", r"page=(\d+)", 1).cast("bigint").alias("page"), "problem"
    )


@register("scan_pages_with_broken_ones", f"""
    SELECT * EXCLUDE (source_file) FROM works
    WHERE (CAST(substr(work_id, 2) AS BIGINT) // {_WORKS_PER_PAGE}) % 7 NOT IN (2, 4)""")
def scan_pages_with_broken_ones(spark, sf):
    """The works of all other pages."""
    landed, _ = _landed_pages(spark, sf)
    return staging.stage_works(works_of(landed), f.LOADED_AT).drop("source_file")


@register("quarantine_audit", f"""
    SELECT 'record_lines' AS dataset, count(*) AS rows_read, count(*) FILTER (WHERE o_orderkey % 50 <> 3) AS rows_kept,
           count(*) FILTER (WHERE o_orderkey % 50 = 3) AS rows_dropped, '{v.BROKEN_LINE_REASON}' AS drop_reason FROM orders
    UNION ALL
    SELECT 'work_pages', count(*), count(*) FILTER (WHERE page % 7 NOT IN (2, 4)), count(*) FILTER (WHERE page % 7 IN (2, 4)),
           '{v.BROKEN_PAGE_REASON}' FROM (SELECT DISTINCT p_partkey // {_WORKS_PER_PAGE} AS page FROM part)""")
def quarantine_audit(spark, sf):
    """Lines of which some are marked as broken, and pages of which some are."""
    key = F.regexp_extract("RetractionDOI", r"(\d+)$", 1).cast("bigint")
    lines = f.raw_records(spark, sf).withColumn("problem", F.when(key % 50 == 3, F.lit("marked")))
    landed, path = _landed_pages(spark, sf)
    return staging.quarantine_audit(lines, landed, quarantine(landed, path), f.LOADED_AT).drop("source_file", "loaded_at")


@register("stream_pages", f"""
    SELECT * EXCLUDE (source_file) FROM works
    WHERE (CAST(substr(work_id, 2) AS BIGINT) // {_WORKS_PER_PAGE}) % 7 NOT IN (2, 4)""")
def stream_pages(spark, sf):
    """Gzip pages landed by two runs of a stream: those that are there, then those that came later."""
    source, target = scratch_path(spark, "arriving-pages"), scratch_path(spark, "landed-pages")
    later = F.col("page") % 3 == 0
    for arriving in (~later, later):
        _write_pages(spark, sf, source, arriving)
        land_new_files(stream_work_pages(spark, f"{source}/page=*", name_filter="*.gz"), target, f"{target}-checkpoint")
    landed = spark.read.parquet(target)
    return staging.stage_works(works_of(landed), f.LOADED_AT).drop("source_file")


@register("merged_landing", """
    SELECT event_id, ts, user_id, event_type,
           CASE WHEN event_id % 10 = 0 THEN value + 1 WHEN event_id % 15 = 0 THEN value + 2 ELSE value END AS value, props,
           CASE WHEN event_id % 10 = 0 THEN 2 WHEN event_id % 15 = 0 THEN 3 ELSE 1 END AS version FROM events""")
def merged_landing(spark, sf):
    """Three runs into one table: even keys; odd keys with new and stale versions of old ones; and a repeat with a newer one.

    The second batch is merged once more by hand, as after a run that ended before its checkpoint was written.
    """
    rows = f.table(spark, sf, "events").withColumn("version", F.lit(1))
    source, target = scratch_path(spark, "arriving"), scratch_path(spark, "merged")
    key = F.col("event_id")

    def newer(chosen: Column, by: int, version: int) -> DataFrame:
        return rows.filter(chosen).withColumns({"value": F.col("value") + by, "version": F.lit(version)})

    odd = rows.filter(key % 2 == 1)
    second = odd.unionByName(newer(key % 10 == 0, 1, 2)).unionByName(newer(key % 4 == 0, 7, 0))
    third = newer((key % 15 == 0) & (key % 10 != 0), 2, 3).unionByName(odd)
    for arriving in (rows.filter(key % 2 == 0), second, third):
        arriving.repartition(4).write.mode("append").parquet(source)
        merge_new_files(stream_files(spark, source, rows.schema), target, f"{target}-checkpoint", "event_id", "version", 8)
    merge_batch(second.withColumn("version", F.lit(9)), target, f"{target}-checkpoint", 1, "event_id", "version")
    return read_merged(spark, target).select(*rows.columns)


@register("replaced_table", """
    SELECT l_returnflag, count(*) AS n, 2 AS version FROM lineitem GROUP BY ALL""")
def replaced_table(spark, sf):
    """A table replaced after a failed replacement, read with its log's last version."""
    root = scratch_path(spark, "replaced")
    lines = f.table(spark, sf, "lineitem")
    tables.publish(lines.filter("l_quantity > 10").select("l_returnflag"), root, "facts", "lines")
    try:
        bad = lines.select(F.when(F.col("l_quantity") > 0, F.raise_error(F.lit("stop"))).cast("string").alias("l_returnflag"))
        tables.publish(bad, root, "facts", "lines")
    except (PySparkException, Py4JJavaError):
        pass
    tables.publish(lines.select("l_returnflag"), root, "facts", "lines")
    return tables.load(spark, root, "facts", "lines").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")).withColumn(
        "version", F.lit(tables.last_version(spark, root, "facts", "lines")).cast("int"))
