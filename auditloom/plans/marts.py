"""Marts: trends, group scores with their validation, leaderboards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.functions import count_where, ratio, round_to, share_where
from auditloom.operators.aggregates import join_median
from auditloom.operators.generators import unpivot
from auditloom.operators.persisting import materialize
from auditloom.operators.ranking import attach_ranks, percent_rank, rank_sum_auc, row_numbers, value_ranks
from auditloom.plans import vocabulary as v


def with_period_changes(yearly: DataFrame, period: str, amount: str, names: Mapping[str, str]) -> DataFrame:
    """Previous value, change, change in percent, running total and 3-period mean.

    One row per calendar period goes in, so the single ordered window is bounded by the calendar
    and not by the data.
    """
    order = Window.orderBy(period)
    before = F.lag(amount).over(order)
    change = F.col(amount) - before
    return yearly.select(
        "*",
        before.alias(names["previous"]),
        change.alias(names["change"]),
        round_to(ratio(change * 100, before), 1).alias(names["change_pct"]),
        F.sum(amount).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(names["cumulative"]),
        round_to(F.avg(amount).over(order.rowsBetween(-2, 0)), 1).alias(names["moving_mean"]),
    )


TREND_NAMES = {
    "previous": "prev_year_retractions", "change": "yoy_change", "change_pct": "yoy_change_pct",
    "cumulative": "cumulative_retractions", "moving_mean": "ma3_retractions",
}


def retraction_trends(enriched: DataFrame) -> DataFrame:
    nature = F.col("retraction_nature")
    n = F.col("n_retractions")
    dated = enriched.filter(F.col("retraction_year").isNotNull()).withColumnRenamed("retraction_year", "year")
    totals = dated.groupBy("year").agg(
        F.count(F.lit(1)).alias("n_retractions"),
        count_where(nature == "Retraction").alias("n_true_retraction"),
        count_where(nature == "Expression of concern").alias("n_expression_of_concern"),
        count_where(nature == "Correction").alias("n_correction"),
        count_where(nature == "Reinstatement").alias("n_reinstatement"),
        count_where(F.col("is_paper_mill")).alias("n_paper_mill"),
        count_where(F.col("is_peer_review_fraud")).alias("n_peer_review_fraud"),
        count_where(F.col("is_ai_generated")).alias("n_ai_generated"),
        count_where(F.col("involves_china")).alias("n_china"),
        count_where(F.col("is_international")).alias("n_international"),
        F.count_distinct("journal").alias("n_journals"),
        round_to(F.avg("retraction_latency_days"), 1).alias("mean_latency_days"),
        round_to(F.avg("n_authors"), 2).alias("mean_authors"),
    )
    yearly = join_median(totals, dated, ["year"], "retraction_latency_days", "median_latency_days").select(
        "*",
        round_to(ratio("n_paper_mill", n), 4).alias("paper_mill_share"),
        round_to(ratio("n_china", n), 4).alias("china_share"),
        round_to(ratio("n_international", n), 4).alias("international_share"),
    )
    return with_period_changes(yearly, "year", "n_retractions", TREND_NAMES)


RISK_MEASURES = {
    "paper_mill": "paper_mill_share",
    "burst": "burst_ratio",
    "volume": "n_retractions",
    "peer_review": "peer_review_fraud_share",
    "ai": "ai_generated_share",
    "intensity": "retractions_per_active_year",
}


def percent_ranks(df: DataFrame, key: str, measures: Mapping[str, str]) -> DataFrame:
    """Percent rank of each measure over all rows, one column ``pr_<name>`` per measure.

    All measures are ranked together in long form: one ordering pass instead of one per measure.
    """
    long = unpivot(df, [key], {name: F.col(c) for name, c in measures.items()}, "measure", "value")
    ranked = attach_ranks(long, value_ranks(long, "value", ["measure"]), "value", ["measure"])
    return ranked.select(key, "measure", percent_rank().alias("pr")).groupBy(key).agg(
        *[F.max(F.when(F.col("measure") == name, F.col("pr"))).alias(f"pr_{name}") for name in measures]
    )


def weighted_score(weights: Mapping[str, float], prefix: str = "pr_") -> Column:
    """100 times the weighted sum of ranks."""
    terms = [F.lit(weight) * F.col(f"{prefix}{name}") for name, weight in weights.items()]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return F.lit(100.0) * total


def tier_of(score: Column, cuts: Sequence[tuple[float, str]], rest: str) -> Column:
    """Label of the first cut the score reaches."""
    chosen = F.when(score >= cuts[0][0], F.lit(cuts[0][1]))
    for cut, label in cuts[1:]:
        chosen = chosen.when(score >= cut, F.lit(label))
    return chosen.otherwise(F.lit(rest))


def journal_risk(profile: DataFrame, min_records: int = v.MIN_GROUP_RECORDS) -> DataFrame:
    """Severity score (uses the label) and structural score (does not) of eligible journals.

    Volume is ranked on the count itself: its logarithm has the same order.
    """
    eligible = profile.filter(F.col("n_retractions") >= min_records)
    scored = eligible.join(percent_ranks(eligible, "journal", RISK_MEASURES), "journal")
    severity = weighted_score(v.SEVERITY_WEIGHTS)

    def points(name: str) -> Column:
        return round_to(F.lit(100.0) * F.col(f"pr_{name}"), 1)

    return scored.select(
        "journal", "publisher", "n_retractions", "active_years", "first_year", "last_year", "peak_year",
        "peak_year_retractions", "burst_ratio", "n_paper_mill", "paper_mill_share",
        "peer_review_fraud_share", "ai_generated_share", "n_expression_of_concern", "n_international",
        "median_latency_days", "mean_authors", "china_share", "retractions_per_active_year",
        *[points(name).alias(f"sev_{name}") for name in v.SEVERITY_WEIGHTS],
        round_to(severity, 2).alias("risk_score"),
        tier_of(severity, v.SEVERITY_TIERS, v.SEVERITY_REST).alias("risk_tier"),
        *[points(name).alias(f"struct_{name}") for name in v.STRUCTURAL_WEIGHTS],
        round_to(weighted_score(v.STRUCTURAL_WEIGHTS), 2).alias("structural_score"),
    )


def risk_score_validation(risk: DataFrame) -> DataFrame:
    """How well each score separates journals with a known label from the rest."""
    long = unpivot(
        risk.withColumn("label", F.col("n_paper_mill") > 0), ["label"],
        {label: F.col(name) for name, label in v.SCORE_NAMES.items()}, "score_name", "score",
    )
    return rank_sum_auc(long, "score", "label", ["score_name"]).select(
        "score_name",
        F.col("n_positive").alias("n_journals_with_paper_mill"),
        F.col("n_negative").alias("n_journals_without_paper_mill"),
        (F.col("n_positive") + F.col("n_negative")).alias("n_journals_total"),
        round_to("auc", 4).alias("auc"),
        tier_of(F.col("auc"), v.AUC_GRADES, v.AUC_REST).alias("auc_grade"),
    )


STRUCTURAL_FEATURES = (
    "burst_ratio", "ln_n_retractions", "n_retractions", "active_years", "median_latency_days",
    "mean_authors", "retractions_per_active_year", "china_share", "international_share",
)
REASON_FEATURES = ("paper_mill_share", "peer_review_fraud_share", "ai_generated_share")


def feature_discriminative_power(risk: DataFrame) -> DataFrame:
    """AUC of every single feature; rows without a value leave that feature's sample only."""
    derived = {
        "ln_n_retractions": F.log("n_retractions"),
        "international_share": ratio("n_international", "n_retractions"),
    }
    names = [*STRUCTURAL_FEATURES, *REASON_FEATURES]
    long = unpivot(
        risk.withColumn("label", F.col("n_paper_mill") > 0), ["label"],
        {name: derived[name] if name in derived else F.col(name) for name in names},
        "feature", "value",
    )
    group = F.when(F.col("feature").isin(*REASON_FEATURES), F.lit("reason_derived")).otherwise(F.lit("structural"))
    return rank_sum_auc(long, "value", "label", ["feature"]).select(
        "feature",
        group.alias("feature_group"),
        round_to("auc", 4).alias("auc"),
        round_to(F.greatest(F.col("auc"), F.lit(1.0) - F.col("auc")), 4).alias("auc_abs"),
        F.when(F.col("auc") >= 0.5, F.lit(v.HIGHER_IS_SUSPICIOUS))
        .otherwise(F.lit(v.LOWER_IS_SUSPICIOUS)).alias("suspicious_direction"),
        F.when(group == "reason_derived", F.lit(v.LEAKAGE_NOTES["reason_derived"]))
        .otherwise(F.lit(v.LEAKAGE_NOTES["structural"])).alias("leakage_note"),
    )


def risk_tier_performance(risk: DataFrame) -> DataFrame:
    """Precision of each structural tier and its lift over the base rate."""
    labelled = risk.select(
        tier_of(F.col("structural_score"), v.STRUCTURAL_TIERS, v.STRUCTURAL_REST).alias("structural_tier"),
        "structural_score",
        (F.col("n_paper_mill") > 0).alias("label"),
    )
    tiers = labelled.groupBy("structural_tier").agg(
        F.count(F.lit(1)).alias("n_journals"),
        count_where(F.col("label")).alias("n_with_paper_mill"),
        F.min("structural_score").alias("_lowest"),
        F.max("structural_score").alias("_highest"),
    )
    overall = tiers.agg((F.sum("n_with_paper_mill") / F.sum("n_journals")).alias("base_rate"))
    precision = ratio("n_with_paper_mill", "n_journals")
    return tiers.crossJoin(F.broadcast(overall)).select(
        "structural_tier", "n_journals", "n_with_paper_mill",
        round_to(precision, 4).alias("precision_rate"),
        round_to("_lowest", 2).alias("min_score"),
        round_to("_highest", 2).alias("max_score"),
        round_to("base_rate", 4).alias("overall_base_rate"),
        round_to(ratio(precision, "base_rate"), 2).alias("lift"),
    )


def _global_facts(enriched: DataFrame) -> DataFrame:
    """One row: number of records and first of the recent years."""
    return enriched.agg(
        F.count(F.lit(1)).alias("_all"), (F.max("retraction_year") - v.RECENT_YEARS).alias("_recent_from")
    )


def country_leaderboard(countries: DataFrame, enriched: DataFrame) -> DataFrame:
    """A record counts for each of its countries, once per country for the distinct counts.

    Repeated countries of a record are folded into a row weight before anything else, so distinct
    records become plain counts. They are dealt out by record, for the join too. The joined rows are written, as
    three aggregations read them.
    """
    facts = enriched.select(
        "record_id", "journal", "retraction_year", "retraction_latency_days", "is_international",
        "is_paper_mill", "is_peer_review_fraud", "is_ai_generated", "n_authors",
    )
    once = countries.repartition(F.col("record_id")).groupBy("record_id", "country").agg(F.count(F.lit(1)).alias("times"))
    joined = materialize(once.join(facts, "record_id").drop("record_id"), "country-records").crossJoin(
        F.broadcast(_global_facts(enriched))
    )

    def times_where(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("times")).otherwise(F.lit(0)))

    by_journal = joined.groupBy("country", "journal").agg(
        F.count(F.lit(1)).alias("n_retractions"),
        count_where(~F.col("is_international")).alias("n_as_sole_country"),
        times_where(F.col("is_paper_mill")).alias("n_paper_mill"),
        times_where(F.col("is_peer_review_fraud")).alias("n_peer_review_fraud"),
        times_where(F.col("is_ai_generated")).alias("n_ai_generated"),
        F.sum("times").alias("_rows"),
        F.sum(F.col("n_authors") * F.col("times")).alias("_signatures"),
        count_where(F.col("retraction_year") >= F.col("_recent_from")).alias("n_recent_5y"),
        F.min("retraction_year").alias("first_retraction_year"),
        F.max("retraction_year").alias("last_retraction_year"),
        F.first("_all").alias("_all"),
    )
    sums = ("n_retractions", "n_as_sole_country", "n_paper_mill", "n_peer_review_fraud", "n_ai_generated",
            "_rows", "_signatures", "n_recent_5y")
    totals = by_journal.groupBy("country").agg(
        *[F.sum(c).alias(c) for c in sums],
        F.min("first_retraction_year").alias("first_retraction_year"),
        F.max("last_retraction_year").alias("last_retraction_year"),
        F.count("journal").alias("n_journals"),
        F.max("_all").alias("_all"),
    )
    years = joined.select(F.col("country").alias("_country"), "retraction_year").distinct().groupBy("_country").agg(
        F.count("retraction_year").alias("active_years")
    )
    medians = joined.filter(F.col("retraction_latency_days").isNotNull()).groupBy(
        "country", "retraction_latency_days"
    ).agg(F.sum("times").alias("times")).groupBy("country").agg(
        round_to(F.percentile("retraction_latency_days", F.lit(0.5), F.col("times")), 1).alias("median_latency_days")
    )
    n = F.col("n_retractions")
    shares = totals.join(medians, "country", "left").join(years, F.col("country").eqNullSafe(F.col("_country"))).select(
        "country", "n_retractions", "n_as_sole_country",
        (n - F.col("n_as_sole_country")).alias("n_cooperative"),
        round_to(ratio(n * 100, "_all"), 2).alias("share_of_global_pct"),
        "n_paper_mill", round_to(ratio("n_paper_mill", n), 4).alias("paper_mill_share"),
        "n_peer_review_fraud",
        round_to(ratio("n_peer_review_fraud", n), 4).alias("peer_review_fraud_share"),
        "n_ai_generated", round_to(ratio("n_ai_generated", n), 4).alias("ai_generated_share"),
        "median_latency_days", "first_retraction_year", "last_retraction_year", "active_years",
        "n_journals", round_to(ratio("_signatures", "_rows"), 2).alias("mean_authors"), "n_recent_5y",
        round_to(ratio("n_recent_5y", n), 4).alias("recent_5y_share"),
    )
    return row_numbers(shares, [F.desc("n_retractions"), F.asc("country")], "rank_by_volume")


def reason_landscape(reasons: DataFrame, enriched: DataFrame) -> DataFrame:
    """How often each reason occurs, in how many records, how recently and how fast."""
    facts = enriched.select("record_id", "retraction_year", "retraction_latency_days", "involves_china")
    recent = F.col("retraction_year") >= F.col("_recent_from")
    overall = _global_facts(enriched)
    joined = reasons.join(facts, "record_id").crossJoin(F.broadcast(overall))
    totals = joined.groupBy("reason").agg(
        F.count(F.lit(1)).alias("n_occurrences"),
        F.count_distinct("record_id").alias("n_records"),
        F.min("retraction_year").alias("first_year"),
        F.max("retraction_year").alias("last_year"),
        count_where(recent).alias("n_recent_5y"),
        count_where(F.col("involves_china")).alias("n_involving_china"),
        F.first("_all").alias("_all"),
    )
    by_reason = join_median(totals, joined, ["reason"], "retraction_latency_days", "median_latency_days")
    shares = by_reason.select(
        "reason", "n_occurrences", "n_records",
        round_to(ratio(F.col("n_records") * 100, "_all"), 2).alias("pct_of_all_retractions"),
        "first_year", "last_year", "median_latency_days", "n_recent_5y",
        round_to(ratio("n_recent_5y", "n_occurrences"), 4).alias("recent_5y_share"),
        "n_involving_china",
        round_to(ratio("n_involving_china", "n_occurrences"), 4).alias("china_share"),
    )
    return row_numbers(shares, [F.desc("n_records"), F.asc("reason")], "rank_by_records")
