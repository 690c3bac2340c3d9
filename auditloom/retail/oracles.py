"""DuckDB statements that define the expected result of each registered query."""

from __future__ import annotations

import re

from auditloom.plans import vocabulary as v

LOADED = "TIMESTAMP '2026-01-01 00:00:00'"
PUBLISHED = "(CAST(o_orderdate AS DATE) - CAST((o_custkey * 37 + o_orderkey * 11) % 1500 - 20 AS INTEGER))"
NATURE = """CASE WHEN o_orderstatus = 'F' THEN 'Retraction' WHEN o_orderstatus = 'O' THEN 'Expression of concern'
                 WHEN o_orderpriority = '5-LOW' THEN 'Reinstatement' ELSE 'Correction' END"""


def clean(x: str) -> str:
    return f"CASE WHEN lower(trim({x})) NOT IN ('', 'unavailable', 'n/a', 'none') THEN trim({x}) END"


def doi(x: str) -> str:
    return f"regexp_replace(lower({clean(x)}), '^https?://(dx\\.)?doi\\.org/', '')"


def pubmed(x: str) -> str:
    return f"CASE WHEN trim({x}) NOT IN ('', '0', 'unavailable') THEN trim({x}) END"


def parsed(x: str) -> str:
    formats = ("%m/%d/%Y %H:%M", "%m/%d/%Y %I:%M:%S %p", "%m/%d/%Y")
    tries = ", ".join(f"try_strptime(trim({x}), '{f}')" for f in formats)
    return f"CAST(coalesce({tries}) AS DATE)"


def last_segment(x: str) -> str:
    return f"regexp_extract({x}, '([^/]+)$', 1)"


def split(x: str, alias: str) -> str:
    return f"unnest(string_split({x}, ';')) AS {alias}(part)"


def bigint_sum(x: str) -> str:
    return f"CAST(sum({x}) AS BIGINT)"


def share(x: str, digits: int = 4) -> str:
    return f"round(avg(CASE WHEN {x} THEN 1::DOUBLE ELSE 0::DOUBLE END), {digits})"


def ratio(a: str, b: str, digits: int) -> str:
    return f"round(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), {digits})"


def ladder(x: str, cuts, rest: str) -> str:
    arms = " ".join(f"WHEN {x} >= {cut} THEN '{label}'" for cut, label in cuts)
    return f"CASE {arms} ELSE '{rest}' END"


def names(values) -> str:
    return ", ".join(f"'{x}'" for x in values)


FLAGS = tuple(v.REASON_FLAGS)

CTE: dict[str, str] = {}

CTE["records"] = f"""
    SELECT o_orderkey AS record_id, 'Order ' || o_orderkey AS title,
           CASE WHEN o_custkey % 211 <> 0 THEN 'J' || o_custkey END AS journal,
           o_orderpriority AS publisher, {NATURE} AS retraction_nature,
           CASE WHEN o_totalprice > 250000 THEN 'Yes' ELSE 'No' END AS paywalled,
           CASE WHEN o_orderkey % 41 <> 0 THEN {PUBLISHED} END AS original_paper_date,
           CASE WHEN o_orderkey % 97 <> 0 THEN CAST(o_orderdate AS DATE) END AS retraction_date,
           '10.1000/r' || o_orderkey AS retraction_doi,
           CASE WHEN o_orderkey % 7 <> 3 THEN '10.1000/p' || o_custkey END AS original_paper_doi,
           CAST(o_custkey AS VARCHAR) AS original_paper_pubmed_id,
           'orders' AS source_file, {LOADED} AS loaded_at
    FROM orders"""

CTE["reasons"] = """
    SELECT l_orderkey AS record_id,
           CASE WHEN l_returnflag = 'R' AND l_quantity >= 50 THEN 'Paper Mill'
                WHEN l_returnflag = 'R' AND l_quantity >= 47 THEN 'Compromised Peer Review'
                WHEN l_returnflag = 'A' AND l_quantity >= 49 THEN 'Concerns/Issues about Peer Review'
                WHEN l_returnflag = 'N' AND l_quantity >= 48 THEN 'Computer-Aided Content or Computer-Generated Content'
                WHEN l_returnflag = 'A' AND l_quantity <= 2 THEN 'Rogue Editor'
                WHEN l_returnflag = 'N' AND l_quantity <= 3 THEN 'Duplication of/in Image'
                WHEN l_returnflag = 'R' AND l_quantity <= 3 THEN 'Investigation by Third Party'
                WHEN l_linestatus = 'O' AND l_quantity <= 8 THEN 'Author Unresponsive'
                ELSE 'Concerns ' || l_returnflag || l_linestatus END AS reason
    FROM lineitem"""

CTE["countries"] = """
    SELECT l_orderkey AS record_id, n_name AS country
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"""

CTE["subjects"] = """
    SELECT l_orderkey AS record_id, '(' || p_brand || ') ' || p_type AS subject
    FROM lineitem JOIN part ON l_partkey = p_partkey"""

CTE["authors"] = """
    SELECT o_orderkey AS record_id, i AS author_position,
           'A' || (o_custkey * 100 + i * (o_orderkey % 7)) AS author_name
    FROM orders, unnest(range(1, o_orderkey % 5 + 1)) AS t(i)"""

CTE["reason_flags"] = f"""
    SELECT record_id, count(*) AS n_reasons,
           {", ".join(f"bool_or(reason IN ({names(r)})) AS {f}" for f, r in v.REASON_FLAGS.items())}
    FROM reasons GROUP BY record_id"""

CTE["country_facts"] = """
    SELECT record_id, count(*) AS n_countries, min(country) AS first_country,
           bool_or(country = 'NATION_3') AS involves_china
    FROM countries GROUP BY record_id"""

CTE["author_facts"] = """
    SELECT record_id, count(*) AS n_authors,
           max(author_name) FILTER (WHERE author_position = 1) AS first_author,
           arg_max(author_name, author_position) AS last_author
    FROM authors GROUP BY record_id"""

CTE["subject_facts"] = r"""
    SELECT record_id, count(*) AS n_subjects, min(subject) AS primary_subject,
           min(regexp_extract(subject, '^\(([^)]+)\)', 1)) AS subject_code,
           min(nullif(regexp_replace(subject, '^\([^)]+\)\s*', ''), '')) AS subject_name
    FROM subjects GROUP BY record_id"""

CTE["enriched"] = f"""
    SELECT r.record_id, title, journal, publisher, retraction_nature, paywalled, original_paper_date,
           retraction_date, year(original_paper_date) AS original_paper_year, year(retraction_date) AS retraction_year,
           datediff('day', original_paper_date, retraction_date) AS retraction_latency_days,
           round(datediff('day', original_paper_date, retraction_date) / 365.25::DOUBLE, 2) AS retraction_latency_years,
           retraction_doi, original_paper_doi, original_paper_pubmed_id,
           coalesce(n_reasons, 0) AS n_reasons,
           {", ".join(f"coalesce({f}, false) AS {f}" for f in FLAGS)},
           coalesce(n_countries, 0) AS n_countries, coalesce(n_countries, 0) > 1 AS is_international,
           coalesce(involves_china, false) AS involves_china,
           coalesce(n_authors, 0) AS n_authors, coalesce(n_institutions, 0) AS n_institutions,
           coalesce(n_subjects, 0) AS n_subjects, first_country, first_author, last_author,
           primary_subject, subject_code, subject_name, source_file, loaded_at
    FROM records r
    LEFT JOIN reason_flags f ON f.record_id = r.record_id
    LEFT JOIN country_facts c ON c.record_id = r.record_id
    LEFT JOIN author_facts a ON a.record_id = r.record_id
    LEFT JOIN (SELECT l_orderkey, count(*) AS n_institutions FROM lineitem GROUP BY 1) i ON i.l_orderkey = r.record_id
    LEFT JOIN subject_facts s ON s.record_id = r.record_id"""

CTE["year_activity"] = f"""
    SELECT journal, retraction_year AS year, count(*) AS n_retractions,
           count(*) FILTER (WHERE is_paper_mill) AS n_paper_mill,
           count(*) FILTER (WHERE is_peer_review_fraud) AS n_peer_review_fraud,
           count(*) FILTER (WHERE is_ai_generated) AS n_ai_generated,
           count(*) FILTER (WHERE is_rogue_editor) AS n_rogue_editor,
           {share('is_paper_mill')} AS paper_mill_share,
           {share('is_peer_review_fraud')} AS peer_review_fraud_share,
           {share('is_ai_generated')} AS ai_generated_share,
           round(median(retraction_latency_days), 1) AS median_latency_days,
           round(avg(retraction_latency_days), 1) AS mean_latency_days,
           round(avg(n_authors), 2) AS mean_authors, {share('involves_china')} AS china_share
    FROM enriched WHERE journal IS NOT NULL AND retraction_year IS NOT NULL GROUP BY ALL"""

CTE["profile"] = f"""
    SELECT t.*, peak_year, peak_year_retractions,
           {ratio('peak_year_retractions', 'n_retractions', 4)} AS burst_ratio,
           {ratio('n_retractions', 'greatest(active_years, 1)', 2)} AS retractions_per_active_year
    FROM (SELECT journal, min(publisher) AS publisher, count(*) AS n_retractions,
                 count(DISTINCT retraction_year) AS active_years,
                 min(retraction_year) AS first_year, max(retraction_year) AS last_year,
                 count(*) FILTER (WHERE is_paper_mill) AS n_paper_mill,
                 count(*) FILTER (WHERE is_peer_review_fraud) AS n_peer_review_fraud,
                 count(*) FILTER (WHERE is_ai_generated) AS n_ai_generated,
                 count(*) FILTER (WHERE retraction_nature = 'Expression of concern') AS n_expression_of_concern,
                 count(*) FILTER (WHERE is_international) AS n_international,
                 {share('is_paper_mill')} AS paper_mill_share,
                 {share('is_peer_review_fraud')} AS peer_review_fraud_share,
                 {share('is_ai_generated')} AS ai_generated_share,
                 round(median(retraction_latency_days), 1) AS median_latency_days,
                 round(avg(n_authors), 2) AS mean_authors, {share('involves_china')} AS china_share
          FROM enriched WHERE journal IS NOT NULL GROUP BY journal) t
    LEFT JOIN (SELECT journal, year AS peak_year, n_retractions AS peak_year_retractions FROM year_activity
               QUALIFY row_number() OVER (PARTITION BY journal ORDER BY n_retractions DESC, year DESC) = 1) p
    ON p.journal = t.journal"""

_MEASURES = {
    "paper_mill": "paper_mill_share", "burst": "burst_ratio", "volume": "ln(n_retractions)",
    "peer_review": "peer_review_fraud_share", "ai": "ai_generated_share",
    "intensity": "retractions_per_active_year",
}
_SEVERITY = "100 * (0.30::DOUBLE * pr_paper_mill + 0.25::DOUBLE * pr_burst + 0.20::DOUBLE * pr_volume " \
            "+ 0.15::DOUBLE * pr_peer_review + 0.10::DOUBLE * pr_ai)"

CTE["ranked"] = f"""
    SELECT *, {", ".join(f"percent_rank() OVER (ORDER BY {x} NULLS LAST) AS pr_{n}" for n, x in _MEASURES.items())}
    FROM profile WHERE n_retractions >= 5"""

CTE["risk"] = f"""
    SELECT journal, publisher, n_retractions, active_years, first_year, last_year, peak_year,
           peak_year_retractions, burst_ratio, n_paper_mill, paper_mill_share, peer_review_fraud_share,
           ai_generated_share, n_expression_of_concern, n_international, median_latency_days, mean_authors,
           china_share, retractions_per_active_year,
           {", ".join(f"round(100 * pr_{n}, 1) AS sev_{n}" for n in v.SEVERITY_WEIGHTS)},
           round({_SEVERITY}, 2) AS risk_score,
           {ladder(_SEVERITY, v.SEVERITY_TIERS, v.SEVERITY_REST)} AS risk_tier,
           round(100 * pr_volume, 1) AS struct_volume, round(100 * pr_intensity, 1) AS struct_intensity,
           round(100 * (0.60::DOUBLE * pr_volume + 0.40::DOUBLE * pr_intensity), 2) AS structural_score
    FROM ranked"""


def auc_ctes(source: str, by: str, value: str) -> str:
    """Rows (by, n_positive, n_negative, auc) by summing average ranks of the positives."""
    return f"""
        SELECT {by}, count(*) FILTER (WHERE label) AS n_positive, count(*) FILTER (WHERE NOT label) AS n_negative,
               (sum(avg_rank) FILTER (WHERE label)
                - count(*) FILTER (WHERE label) * (count(*) FILTER (WHERE label) + 1) / 2)
               / nullif(count(*) FILTER (WHERE label) * count(*) FILTER (WHERE NOT label), 0) AS auc
        FROM (SELECT {by}, label, rank() OVER (PARTITION BY {by} ORDER BY {value})
                     + (count(*) OVER (PARTITION BY {by}, {value}) - 1) / 2 AS avg_rank
              FROM ({source}) WHERE {value} IS NOT NULL)
        GROUP BY {by}"""


_SCORES = " UNION ALL ".join(
    f"SELECT '{label}' AS score_name, n_paper_mill > 0 AS label, {name} AS score FROM risk"
    for name, label in v.SCORE_NAMES.items()
)
CTE["validation"] = f"""
    SELECT score_name, n_positive AS n_journals_with_paper_mill, n_negative AS n_journals_without_paper_mill,
           n_positive + n_negative AS n_journals_total, round(auc, 4) AS auc,
           {ladder('auc', v.AUC_GRADES, v.AUC_REST)} AS auc_grade
    FROM ({auc_ctes(_SCORES, 'score_name', 'score')})"""

_FEATURES = {
    "burst_ratio": "burst_ratio", "ln_n_retractions": "ln(n_retractions)", "n_retractions": "n_retractions",
    "active_years": "active_years", "median_latency_days": "median_latency_days", "mean_authors": "mean_authors",
    "retractions_per_active_year": "retractions_per_active_year", "china_share": "china_share",
    "international_share": "n_international / n_retractions", "paper_mill_share": "paper_mill_share",
    "peer_review_fraud_share": "peer_review_fraud_share", "ai_generated_share": "ai_generated_share",
}
_REASON_FEATURES = ("paper_mill_share", "peer_review_fraud_share", "ai_generated_share")
FEATURE_ROWS = " UNION ALL ".join(
    f"SELECT journal, '{name}' AS feature, n_paper_mill > 0 AS label, CAST({x} AS DOUBLE) AS value FROM risk"
    for name, x in _FEATURES.items()
)
CTE["features"] = f"""
    SELECT feature, CASE WHEN feature IN ({names(_REASON_FEATURES)}) THEN 'reason_derived' ELSE 'structural' END
               AS feature_group,
           round(auc, 4) AS auc, round(greatest(auc, 1 - auc), 4) AS auc_abs,
           CASE WHEN auc >= 0.5 THEN '{v.HIGHER_IS_SUSPICIOUS}' ELSE '{v.LOWER_IS_SUSPICIOUS}' END
               AS suspicious_direction,
           CASE WHEN feature IN ({names(_REASON_FEATURES)}) THEN '{v.LEAKAGE_NOTES["reason_derived"]}'
                ELSE '{v.LEAKAGE_NOTES["structural"]}' END AS leakage_note
    FROM ({auc_ctes(FEATURE_ROWS, 'feature', 'value')})"""

CTE["tiers"] = f"""
    SELECT structural_tier, count(*) AS n_journals, count(*) FILTER (WHERE hit) AS n_with_paper_mill,
           {share('hit')} AS precision_rate, round(min(structural_score), 2) AS min_score,
           round(max(structural_score), 2) AS max_score, round(any_value(base), 4) AS overall_base_rate,
           round((count(*) FILTER (WHERE hit))::DOUBLE / count(*) / nullif(any_value(base), 0), 2) AS lift
    FROM (SELECT {ladder('structural_score', v.STRUCTURAL_TIERS, v.STRUCTURAL_REST)} AS structural_tier,
                 structural_score, n_paper_mill > 0 AS hit,
                 avg(CASE WHEN n_paper_mill > 0 THEN 1::DOUBLE ELSE 0::DOUBLE END) OVER () AS base FROM risk)
    GROUP BY structural_tier"""

CTE["trends"] = f"""
    SELECT *, lag(n_retractions) OVER w AS prev_year_retractions,
           n_retractions - lag(n_retractions) OVER w AS yoy_change,
           {ratio('100 * (n_retractions - lag(n_retractions) OVER w)', 'lag(n_retractions) OVER w', 1)} AS yoy_change_pct,
           CAST(sum(n_retractions) OVER (ORDER BY year ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative_retractions,
           round(avg(n_retractions) OVER (ORDER BY year ROWS 2 PRECEDING), 1) AS ma3_retractions
    FROM (SELECT retraction_year AS year, count(*) AS n_retractions,
                 count(*) FILTER (WHERE retraction_nature = 'Retraction') AS n_true_retraction,
                 count(*) FILTER (WHERE retraction_nature = 'Expression of concern') AS n_expression_of_concern,
                 count(*) FILTER (WHERE retraction_nature = 'Correction') AS n_correction,
                 count(*) FILTER (WHERE retraction_nature = 'Reinstatement') AS n_reinstatement,
                 count(*) FILTER (WHERE is_paper_mill) AS n_paper_mill,
                 count(*) FILTER (WHERE is_peer_review_fraud) AS n_peer_review_fraud,
                 count(*) FILTER (WHERE is_ai_generated) AS n_ai_generated,
                 count(*) FILTER (WHERE involves_china) AS n_china,
                 count(*) FILTER (WHERE is_international) AS n_international,
                 count(DISTINCT journal) AS n_journals,
                 round(avg(retraction_latency_days), 1) AS mean_latency_days,
                 round(median(retraction_latency_days), 1) AS median_latency_days,
                 round(avg(n_authors), 2) AS mean_authors,
                 {ratio('count(*) FILTER (WHERE is_paper_mill)', 'count(*)', 4)} AS paper_mill_share,
                 {ratio('count(*) FILTER (WHERE involves_china)', 'count(*)', 4)} AS china_share,
                 {ratio('count(*) FILTER (WHERE is_international)', 'count(*)', 4)} AS international_share
          FROM enriched WHERE retraction_year IS NOT NULL GROUP BY retraction_year)
    WINDOW w AS (ORDER BY year)"""

CTE["country_board"] = f"""
    SELECT *, n_retractions - n_as_sole_country AS n_cooperative,
           {ratio('100 * n_retractions', '(SELECT count(*) FROM enriched)', 2)} AS share_of_global_pct,
           {ratio('n_paper_mill', 'n_retractions', 4)} AS paper_mill_share,
           {ratio('n_peer_review_fraud', 'n_retractions', 4)} AS peer_review_fraud_share,
           {ratio('n_ai_generated', 'n_retractions', 4)} AS ai_generated_share,
           {ratio('n_recent_5y', 'n_retractions', 4)} AS recent_5y_share,
           row_number() OVER (ORDER BY n_retractions DESC, country) AS rank_by_volume
    FROM (SELECT country, count(DISTINCT c.record_id) AS n_retractions,
                 count(DISTINCT c.record_id) FILTER (WHERE NOT is_international) AS n_as_sole_country,
                 count(*) FILTER (WHERE is_paper_mill) AS n_paper_mill,
                 count(*) FILTER (WHERE is_peer_review_fraud) AS n_peer_review_fraud,
                 count(*) FILTER (WHERE is_ai_generated) AS n_ai_generated,
                 round(median(retraction_latency_days), 1) AS median_latency_days,
                 min(retraction_year) AS first_retraction_year, max(retraction_year) AS last_retraction_year,
                 count(DISTINCT retraction_year) AS active_years, count(DISTINCT journal) AS n_journals,
                 round(avg(n_authors), 2) AS mean_authors,
                 count(DISTINCT c.record_id) FILTER (
                     WHERE retraction_year >= (SELECT max(retraction_year) - 4 FROM enriched)) AS n_recent_5y
          FROM countries c JOIN enriched e ON e.record_id = c.record_id GROUP BY country)"""

CTE["reason_board"] = f"""
    SELECT *, {ratio('100 * n_records', '(SELECT count(*) FROM enriched)', 2)} AS pct_of_all_retractions,
           {ratio('n_recent_5y', 'n_occurrences', 4)} AS recent_5y_share,
           {ratio('n_involving_china', 'n_occurrences', 4)} AS china_share,
           row_number() OVER (ORDER BY n_records DESC, reason) AS rank_by_records
    FROM (SELECT reason, count(*) AS n_occurrences, count(DISTINCT r.record_id) AS n_records,
                 min(retraction_year) AS first_year, max(retraction_year) AS last_year,
                 round(median(retraction_latency_days), 1) AS median_latency_days,
                 count(*) FILTER (WHERE retraction_year >= (SELECT max(retraction_year) - 4 FROM enriched)) AS n_recent_5y,
                 count(*) FILTER (WHERE involves_china) AS n_involving_china
          FROM reasons r JOIN enriched e ON e.record_id = r.record_id GROUP BY reason)"""

# --- works ------------------------------------------------------------------------------------

CTE["works"] = f"""
    SELECT 'W' || p_partkey AS work_id,
           CASE WHEN p_partkey % 29 <> 0 THEN '10.1000/p' || p_partkey END AS doi, p_name AS title,
           CAST(1988 + p_size % 8 AS INTEGER) AS publication_year,
           CASE WHEN p_partkey % 31 <> 0 THEN make_date(1988 + p_size % 8, 1 + p_size % 12, 15) END AS publication_date,
           p_type AS work_type, CASE WHEN p_size % 4 = 0 THEN 'de' ELSE 'en' END AS language,
           p_size % 2 = 0 AS is_retracted, p_partkey * 7 % 50 AS cited_by_count,
           p_partkey % 30 AS referenced_works_count, p_retailprice / 1000 AS fwci,
           p_size % 3 = 0 AS is_oa, CASE WHEN p_size % 3 = 0 THEN 'gold' ELSE 'closed' END AS oa_status,
           CAST(NULL AS VARCHAR) AS oa_url,
           CASE WHEN p_partkey % 37 <> 0 THEN 'T' || (p_size % 10) END AS primary_topic_id,
           CASE WHEN p_partkey % 37 <> 0 THEN 'Topic ' || (p_size % 10) END AS primary_topic,
           CASE WHEN p_partkey % 37 <> 0 THEN CAST(p_size AS DOUBLE) / 100 END AS primary_topic_score,
           CASE WHEN p_partkey % 37 <> 0 THEN p_type END AS domain,
           CASE WHEN p_partkey % 37 <> 0 THEN p_brand END AS field,
           CASE WHEN p_partkey % 37 <> 0 THEN 'Sub ' || (p_size % 5) END AS subfield,
           p_partkey % 4 AS n_authors, CAST(p_partkey % 3 AS INTEGER) AS countries_distinct_count,
           CAST(p_partkey % 4 AS INTEGER) AS institutions_distinct_count,
           CAST(p_size AS VARCHAR) AS biblio_volume, CAST(NULL AS VARCHAR) AS biblio_issue,
           '1' AS biblio_first_page, CAST(p_size + 1 AS VARCHAR) AS biblio_last_page,
           'part' AS source_file, {LOADED} AS loaded_at
    FROM part WHERE p_partkey % 53 <> 0"""

_WORK_FLAGS = ("is_paper_mill", "is_peer_review_fraud", "is_ai_generated", "is_image_duplication", "is_rogue_editor")

CTE["works_enriched"] = f"""
    SELECT work_id, doi, title, publication_year, publication_date, work_type, language, cited_by_count,
           referenced_works_count, fwci, is_oa, oa_status, primary_topic, domain, field, subfield, n_authors,
           countries_distinct_count, institutions_distinct_count,
           record_doi IS NOT NULL AS matched_in_records, coalesce(n_records, 0) AS n_records,
           retraction_date, year(retraction_date) AS retraction_year, retraction_nature, record_journal,
           record_first_country,
           coalesce(latency, datediff('day', publication_date, retraction_date)) AS retraction_latency_days,
           {", ".join(f"coalesce({f}, false) AS {f}" for f in _WORK_FLAGS)},
           CASE WHEN publication_year < 2002 THEN {ratio('cited_by_count', '2002 - publication_year', 3)} END
               AS citations_per_year,
           source_file, loaded_at
    FROM works w LEFT JOIN (
        SELECT original_paper_doi AS record_doi, count(*) AS n_records, min(retraction_date) AS retraction_date,
               min(retraction_nature) AS retraction_nature, min(journal) AS record_journal,
               min(first_country) AS record_first_country, min(retraction_latency_days) AS latency,
               {", ".join(f"bool_or({f}) AS {f}" for f in _WORK_FLAGS)}
        FROM enriched WHERE original_paper_doi IS NOT NULL GROUP BY original_paper_doi) r ON r.record_doi = w.doi
    WHERE doi IS NOT NULL"""

CTE["citations"] = """
    SELECT 'W' || l_partkey AS work_id, year(l_shipdate) AS citation_year, count(*) AS n
    FROM lineitem GROUP BY ALL"""

CTE["panel"] = """
    SELECT g.work_id, event_time, g.citation_year, publication_year, retraction_year,
           g.citation_year - publication_year AS years_since_publication,
           coalesce(c.n, 0) AS cited_by_count, c.n IS NOT NULL AS has_observed_data,
           is_paper_mill, is_peer_review_fraud, is_ai_generated, field, domain,
           cited_by_count AS total_cited_by_count, n_authors
    FROM (SELECT *, retraction_year + event_time AS citation_year
          FROM works_enriched, unnest(range(-3, 3)) AS t(event_time)
          WHERE publication_year + 3 <= retraction_year AND retraction_year <= 1999) g
    LEFT JOIN citations c ON c.work_id = g.work_id AND c.citation_year = g.citation_year"""

_EXPECTED = "(intercept + slope * event_time)"
_GAPS = f"""round({_EXPECTED}, 4) AS counterfactual_citations,
           round(mean_citations - {_EXPECTED}, 4) AS citation_gap,
           round(100 * (mean_citations - {_EXPECTED}) / nullif({_EXPECTED}, 0), 2) AS citation_gap_pct"""


def line(source: str, by: str = "") -> str:
    """Least-squares line through (event_time, mean_citations) before the event."""
    group = f"GROUP BY {by}" if by else ""
    return f"""
        SELECT {by + ',' if by else ''} slope, (sy - slope * sx) / n AS intercept
        FROM (SELECT *, (n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0) AS slope
              FROM (SELECT {by + ',' if by else ''} count(*)::DOUBLE AS n, sum(event_time)::DOUBLE AS sx,
                           sum(mean_citations) AS sy, sum(event_time * mean_citations) AS sxy,
                           sum(event_time * event_time)::DOUBLE AS sxx
                    FROM {source} WHERE event_time < 0 {group}))"""


CTE["by_time"] = f"""
    SELECT event_time, count(DISTINCT work_id) AS n_works, count(*) AS n_observations,
           round(avg(cited_by_count), 4) AS mean_citations, round(median(cited_by_count), 3) AS median_citations,
           {share('has_observed_data')} AS data_coverage
    FROM panel GROUP BY event_time"""

CTE["study"] = f"""
    SELECT by_time.*, {_GAPS}, round(slope, 4) AS pre_trend_slope, round(intercept, 4) AS pre_trend_intercept,
           event_time >= 0 AS is_post_retraction
    FROM by_time, ({line('by_time')})"""

CTE["by_group"] = f"""
    SELECT CASE WHEN is_paper_mill THEN '{v.EVENT_GROUPS[True]}' ELSE '{v.EVENT_GROUPS[False]}' END AS group_name,
           event_time, count(DISTINCT work_id) AS n_works, avg(cited_by_count) AS mean_citations,
           median(cited_by_count) AS median_citations
    FROM panel GROUP BY ALL"""

CTE["group_study"] = f"""
    SELECT g.group_name, event_time, n_works, round(g.mean_citations, 4) AS mean_citations,
           round(median_citations, 3) AS median_citations, {_GAPS.replace('mean_citations', 'g.mean_citations')},
           event_time >= 0 AS is_post_retraction
    FROM by_group g JOIN ({line('by_group', 'group_name')}) l ON l.group_name = g.group_name"""

CTE["penalty"] = """
    SELECT count(*) FILTER (WHERE is_post_retraction) AS n_post_periods,
           round(avg(citation_gap) FILTER (WHERE is_post_retraction), 4) AS mean_gap_after_retraction,
           round(avg(citation_gap_pct) FILTER (WHERE is_post_retraction), 2) AS mean_gap_pct_after_retraction,
           round(avg(citation_gap) FILTER (WHERE NOT is_post_retraction), 4) AS mean_gap_before_retraction,
           round(max(pre_trend_slope), 4) AS pre_trend_slope
    FROM study"""

# --- graph ------------------------------------------------------------------------------------

CTE["order_works"] = """
    SELECT r.record_id AS work_id, coalesce(is_paper_mill, false) AS is_paper_mill, journal AS record_journal,
           publisher AS field, first_country AS record_first_country, year(retraction_date) AS publication_year
    FROM records r LEFT JOIN reason_flags f ON f.record_id = r.record_id
    LEFT JOIN country_facts c ON c.record_id = r.record_id"""

CTE["order_members"] = "SELECT DISTINCT record_id AS work_id, author_name AS author_id FROM authors"

CTE["edges"] = f"""
    SELECT *, last_year - first_year AS year_span,
           {ratio('n_shared_works', 'greatest(last_year - first_year + 1, 1)', 2)} AS works_per_year
    FROM (SELECT a.author_id AS author_a, b.author_id AS author_b, count(*) AS n_shared_works,
                 count(*) FILTER (WHERE is_paper_mill) AS n_shared_paper_mill,
                 {share('is_paper_mill')} AS shared_paper_mill_share,
                 count(DISTINCT record_journal) AS n_journals, count(DISTINCT field) AS n_fields,
                 count(DISTINCT record_first_country) AS n_countries,
                 min(publication_year) AS first_year, max(publication_year) AS last_year
          FROM order_members a JOIN order_members b ON a.work_id = b.work_id AND a.author_id < b.author_id
          JOIN order_works w ON w.work_id = a.work_id GROUP BY ALL HAVING count(*) >= 2)"""

CTE["part_members"] = "SELECT DISTINCT l_orderkey AS g, l_partkey AS i FROM lineitem"

CTE["part_edges"] = """
    SELECT x.i AS a, y.i AS b, count(*) AS weight
    FROM part_members x JOIN part_members y ON x.g = y.g AND x.i < y.i GROUP BY ALL HAVING count(*) >= 2"""


def components(edges: str, a: str, b: str) -> str:
    """Smallest reachable node of every node, by passing minima along until nothing changes."""
    return f"""
        SELECT node, component FROM (
            WITH RECURSIVE both_ways AS MATERIALIZED (
                SELECT {a} AS u, {b} AS w FROM {edges} UNION ALL SELECT {b}, {a} FROM {edges}),
            walk(node, component) USING KEY (node) AS (
                SELECT u, u FROM both_ways GROUP BY u
                UNION
                SELECT e.w, min(walk.component) FROM walk JOIN both_ways e ON e.u = walk.node
                JOIN recurring.walk AS known ON known.node = e.w
                WHERE walk.component < known.component GROUP BY e.w)
            SELECT node, component FROM walk)"""


CTE["author_components"] = components("edges", "author_a", "author_b")
CTE["part_components"] = components("part_edges", "a", "b")

CTE["membership"] = """
    SELECT node, component AS cluster_id FROM author_components
    WHERE component IN (SELECT component FROM author_components GROUP BY component HAVING count(*) >= 3)"""

CTE["cluster_profile"] = f"""
    SELECT cluster_id, n_authors, n_edges,
           round(2 * n_edges / (n_authors::DOUBLE * (n_authors - 1)), 6) AS density,
           total_shared_works, n_paper_mill_works, n_paper_mill_edges,
           {ratio('n_paper_mill_edges', 'n_edges', 4)} AS paper_mill_edge_share,
           max_journals_in_edge, max_fields_in_edge, first_year, last_year,
           last_year - first_year + 1 AS year_span,
           round(total_shared_works::DOUBLE / n_authors / (last_year - first_year + 1), 3) AS works_per_author_year
    FROM (SELECT cluster_id, count(*) AS n_authors FROM membership GROUP BY cluster_id)
    JOIN (SELECT m.cluster_id, count(*) AS n_edges, {bigint_sum('n_shared_works')} AS total_shared_works,
                 {bigint_sum('n_shared_paper_mill')} AS n_paper_mill_works,
                 count(*) FILTER (WHERE n_shared_paper_mill > 0) AS n_paper_mill_edges,
                 max(n_journals) AS max_journals_in_edge, max(n_fields) AS max_fields_in_edge,
                 min(first_year) AS first_year, max(last_year) AS last_year
          FROM edges JOIN membership m ON m.node = author_a GROUP BY m.cluster_id) USING (cluster_id)"""

_CLUSTER_MEASURES = ("paper_mill_edge_share", "density", "works_per_author_year", "field_journal_ratio")


def _pct(x: str) -> str:
    return (
        f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (ORDER BY {x} NULLS LAST) "
        f"+ (count(*) OVER (PARTITION BY {x}) - 1) / 2) / count({x}) OVER () END"
    )


CTE["cluster_scores"] = f"""
    SELECT *,
           round(100 * (0.40::DOUBLE * pr_paper_mill_edge_share + 0.25::DOUBLE * pr_density
                 + 0.20::DOUBLE * pr_works_per_author_year + 0.15::DOUBLE * pr_field_journal_ratio), 2) AS cluster_risk_score,
           round(100 * (0.45::DOUBLE * pr_density + 0.35::DOUBLE * pr_works_per_author_year
                 + 0.20::DOUBLE * pr_field_journal_ratio), 2) AS cluster_structural_score
    FROM (SELECT *, {_pct('paper_mill_edge_share')} AS pr_paper_mill_edge_share, {_pct('density')} AS pr_density,
                 coalesce({_pct('works_per_author_year')}, 0.5::DOUBLE) AS pr_works_per_author_year,
                 coalesce({_pct('field_journal_ratio')}, 0.5::DOUBLE) AS pr_field_journal_ratio
          FROM (SELECT *, max_fields_in_edge::DOUBLE / nullif(max_journals_in_edge, 0) AS field_journal_ratio
                FROM cluster_profile))"""

_CLUSTER_ROWS = " UNION ALL ".join(
    f"SELECT '{label}' AS score_name, n_paper_mill_works > 0 AS label, {name} AS score FROM cluster_scores"
    for name, label in v.CLUSTER_SCORE_NAMES.items()
)
CTE["cluster_auc"] = f"""
    SELECT score_name, round(auc, 4) AS auc
    FROM ({auc_ctes(_CLUSTER_ROWS, 'score_name', 'score')}) WHERE auc IS NOT NULL"""

CTE["cluster_validation"] = """
    SELECT score_name, auc, (SELECT count(*) FROM cluster_scores) AS n_clusters,
           (SELECT count(*) FROM cluster_scores WHERE n_paper_mill_works > 0) AS n_clusters_with_paper_mill,
           (SELECT count(*) FROM (SELECT DISTINCT a.author_id, b.author_id AS other FROM order_members a
                JOIN order_members b ON a.work_id = b.work_id AND a.author_id < b.author_id)) AS n_edges_total
    FROM cluster_auc"""

CTE["order_names"] = """
    SELECT author_id, author_name, orcid FROM (
        SELECT author_id, author_name, min(orcid) AS orcid, count(*) AS n
        FROM (SELECT author_name AS author_id, author_name || ' v' || (record_id % 3) AS author_name,
                     CASE WHEN record_id % 2 = 0 THEN '0000-' || author_name END AS orcid FROM authors)
        GROUP BY author_id, author_name)
    QUALIFY row_number() OVER (PARTITION BY author_id ORDER BY n DESC, author_name) = 1"""

CTE["cluster_members"] = """
    SELECT cluster_id, node AS author_id, author_name, orcid
    FROM membership LEFT JOIN order_names ON author_id = node
    WHERE cluster_id IN (SELECT cluster_id FROM cluster_scores)"""

# --- raw records ------------------------------------------------------------------------------


def _spelled(day: str) -> str:
    return (
        f"strftime({day}, '%-m/%-d/%Y') || CASE WHEN o_orderkey % 8 <= 2 THEN ' 0:00' "
        f"WHEN o_orderkey % 8 <= 4 THEN ' 12:00:00 AM' ELSE '' END"
    )


CTE["raw_records"] = f"""
    SELECT CASE WHEN o_orderkey % 1009 = 7 THEN '' WHEN o_orderkey % 1013 = 5 THEN 'x' || o_orderkey
                ELSE CAST(o_orderkey AS VARCHAR) END AS id,
           CASE WHEN o_orderkey % 17 = 0 THEN 'Unavailable' ELSE '  Order ' || o_orderkey || ' ' END AS title,
           '(' || o_orderstatus || ') Status;  (' || substr(o_orderpriority, 1, 1) || ') '
               || substr(o_orderpriority, 3) || ';' AS subject,
           'Customer ' || o_custkey || '; ; Desk ' || (o_custkey % 10) AS institution,
           CASE WHEN o_custkey % 211 = 0 THEN 'N/A' ELSE 'J' || o_custkey END AS journal,
           o_orderpriority AS publisher,
           'NATION_' || (o_custkey % 25) || CASE WHEN o_orderkey % 3 = 0 THEN ';NATION_' || (o_orderkey % 25)
               ELSE '' END || ';' AS country,
           coalesce((SELECT string_agg('A' || (o_custkey * 100 + i * (o_orderkey % 7)), '; ' ORDER BY i)
                     FROM unnest(range(1, o_orderkey % 5 + 1)) AS t(i)), '') AS author,
           CASE WHEN o_orderkey % 8 = 7 THEN 'some day' ELSE {_spelled('o_orderdate')} END AS retracted,
           'https://doi.org/10.1000/R' || o_orderkey AS retraction_doi,
           CAST(o_orderkey % 5 AS VARCHAR) AS retraction_pubmed, {_spelled(PUBLISHED)} AS published,
           CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'HTTPS://DOI.ORG/' ELSE 'http://dx.doi.org/' END
               || '10.1000/P' || o_custkey AS paper_doi,
           ' ' || o_custkey || ' ' AS paper_pubmed, {NATURE} AS nature,
           CASE WHEN o_orderkey % 23 = 0 THEN 'Paper Mill; Rogue Editor;'
                WHEN o_orderkey % 19 = 0 THEN 'Compromised Peer Review;Duplication of/in Image'
                WHEN o_orderkey % 29 = 0 THEN NULL
                ELSE 'Error in Data; Concerns ' || o_orderstatus || ';' END AS reason,
           CASE WHEN o_totalprice > 250000 THEN 'Yes' ELSE 'No' END AS paywalled,
           CASE WHEN o_orderkey % 13 = 0 THEN 'first line' || chr(10) || 'said "no", then; end' END AS notes
    FROM orders"""

CTE["staged"] = f"""
    SELECT TRY_CAST(trim(id) AS BIGINT) AS record_id, {clean('title')} AS title, {clean('journal')} AS journal,
           {clean('publisher')} AS publisher, {clean('institution')} AS institution_raw,
           {clean('author')} AS author_raw, {clean('country')} AS country_raw, {clean('subject')} AS subject_raw,
           'Research Article;' AS article_type_raw, {clean('reason')} AS reason_raw, {clean('notes')} AS notes,
           CAST(NULL AS VARCHAR) AS urls, {parsed('retracted')} AS retraction_date,
           {parsed('published')} AS original_paper_date, year({parsed('retracted')}) AS retraction_year,
           year({parsed('published')}) AS original_paper_year, {doi('retraction_doi')} AS retraction_doi,
           {doi('paper_doi')} AS original_paper_doi, {pubmed('retraction_pubmed')} AS retraction_pubmed_id,
           {pubmed('paper_pubmed')} AS original_paper_pubmed_id, {clean('nature')} AS retraction_nature,
           {clean('paywalled')} AS paywalled, 'orders' AS source_file, {LOADED} AS loaded_at
    FROM raw_records WHERE trim(id) <> ''"""


def statement(body: str) -> str:
    """The body preceded by the definitions it uses, in the order they are declared."""
    needed: set[str] = set()
    pending = [body]
    while pending:
        words = set(re.findall(r"\w+", pending.pop()))
        for name in CTE:
            if name in words and name not in needed:
                needed.add(name)
                pending.append(CTE[name])
    parts = [f"{name} AS MATERIALIZED ({CTE[name]})" for name in CTE if name in needed]
    return f"WITH {', '.join(parts)} {body}" if parts else body
