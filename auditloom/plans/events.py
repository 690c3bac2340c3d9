"""Event study: what happened after the event against the trend before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions import count_where, ratio, round_to
from auditloom.operators.regression import ols_fit
from auditloom.plans import vocabulary as v


def _expected() -> Column:
    return F.col("intercept") + F.col("slope") * F.col("event_time")


def _gap_columns() -> list[Column]:
    gap = F.col("mean_citations") - _expected()
    return [
        round_to(_expected(), 4).alias("counterfactual_citations"),
        round_to(gap, 4).alias("citation_gap"),
        round_to(F.lit(100.0) * gap / F.nullif(_expected(), F.lit(0.0)), 2).alias("citation_gap_pct"),
    ]


def _yearly_means(panel: DataFrame, keys: list[str]) -> DataFrame:
    """Panel reduced to its keys. The panel has one row per work and time, so works are its rows.

    The count per value comes first: medians and means then work on a few rows per key.
    """
    by_value = panel.groupBy(*keys, "cited_by_count").agg(
        F.count(F.lit(1)).alias("n"), count_where(F.col("has_observed_data")).alias("n_observed")
    )
    n = F.sum("n")
    return by_value.groupBy(*keys).agg(
        n.alias("n_works"),
        n.alias("n_observations"),
        (F.sum(F.col("cited_by_count") * F.col("n")) / n.cast("double")).alias("mean_citations"),
        F.percentile("cited_by_count", F.lit(0.5), F.col("n")).alias("median_citations"),
        (F.sum("n_observed") / n.cast("double")).alias("data_coverage"),
    )


def event_study(panel: DataFrame) -> DataFrame:
    """Mean per event time, the line through the (rounded) means before the event, and the gap.

    The panel is reduced to one row per event time before the fit, so the fit and the join of its
    one-row result work on a handful of rows.
    """
    by_time = _yearly_means(panel, ["event_time"]).select(
        "event_time", "n_works", "n_observations",
        round_to("mean_citations", 4).alias("mean_citations"),
        round_to("median_citations", 3).alias("median_citations"),
        round_to("data_coverage", 4).alias("data_coverage"),
    )
    line = ols_fit(by_time.filter(F.col("event_time") < 0), "event_time", "mean_citations")
    return by_time.crossJoin(F.broadcast(line)).select(
        "event_time", "n_works", "n_observations", "mean_citations", "median_citations", "data_coverage",
        *_gap_columns(),
        round_to("slope", 4).alias("pre_trend_slope"),
        round_to("intercept", 4).alias("pre_trend_intercept"),
        (F.col("event_time") >= 0).alias("is_post_retraction"),
    )


def event_study_by_group(panel: DataFrame, label: str = "is_paper_mill") -> DataFrame:
    """The same per label group, fitted on unrounded means; groups without a past drop out."""
    name = F.when(F.col(label), F.lit(v.EVENT_GROUPS[True])).otherwise(F.lit(v.EVENT_GROUPS[False]))
    by_time = _yearly_means(panel.withColumn("group_name", name), ["group_name", "event_time"])
    lines = ols_fit(by_time.filter(F.col("event_time") < 0), "event_time", "mean_citations", ["group_name"])
    return by_time.join(lines, "group_name").select(
        "group_name", "event_time", "n_works",
        round_to("mean_citations", 4).alias("mean_citations"),
        round_to("median_citations", 3).alias("median_citations"),
        *_gap_columns(),
        (F.col("event_time") >= 0).alias("is_post_retraction"),
    )


def penalty_summary(study: DataFrame) -> DataFrame:
    after = F.col("is_post_retraction")
    return study.agg(
        count_where(after).alias("n_post_periods"),
        round_to(F.avg(F.when(after, F.col("citation_gap"))), 4).alias("mean_gap_after_retraction"),
        round_to(F.avg(F.when(after, F.col("citation_gap_pct"))), 2).alias("mean_gap_pct_after_retraction"),
        round_to(F.avg(F.when(~after, F.col("citation_gap"))), 4).alias("mean_gap_before_retraction"),
        round_to(F.max("pre_trend_slope"), 4).alias("pre_trend_slope"),
    )


def event_extremes(study: DataFrame) -> DataFrame:
    """Worst gap after the event with its time, and the largest deviation before it."""
    after = F.col("is_post_retraction")
    worst = F.min(F.when(after, F.struct("citation_gap_pct", "event_time")))
    return study.agg(
        worst.alias("_worst"),
        F.max(F.when(~after, F.abs("citation_gap"))).alias("max_abs_gap_before"),
    ).select(
        F.col("_worst.event_time").alias("worst_event_time"),
        F.col("_worst.citation_gap_pct").alias("worst_gap_pct"),
        "max_abs_gap_before",
    )


def match_rate_by_year(works: DataFrame) -> DataFrame:
    """How many works of each year the records know."""
    by_year = works.filter(F.col("publication_year").isNotNull()).groupBy(
        F.col("publication_year").alias("year")
    ).agg(F.count(F.lit(1)).alias("total"), count_where(F.col("matched_in_records")).alias("matched"))
    return by_year.select(
        "year", "total", "matched", (F.col("total") - F.col("matched")).alias("unmatched"),
        round_to(ratio(F.col("matched") * 100, "total"), 2).alias("match_rate"),
    )
