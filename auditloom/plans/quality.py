"""Declarative data-quality checks.

A check counts violations. Checks that look at one table one row at a time are aggregate
expressions, and all of those over a table run in one pass; checks that compare tables or groups
build a one-row frame. A check that cannot be analysed (missing table or column) or fails while it runs
is reported as errored, never as passed, and takes no other check with it.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditloom.functions import count_where, share_where, trim_spaces
from auditloom.operators.persisting import materialize
from auditloom.plans import vocabulary as v

Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Check:
    """``measure`` gives an aggregate Column for a one-table check, a one-row frame otherwise."""

    name: str
    tables: tuple[str, ...]
    measure: Callable[..., Column | DataFrame]
    severity: str = "error"
    rationale: str = ""
    one_pass: bool = True
    distinct: bool = False

    def __post_init__(self) -> None:
        if self.severity not in ("error", "warning"):
            raise ValueError(f"unknown severity {self.severity!r}")


def row_check(
    name: str, table: str, measure: Callable[[], Column], severity: str = "error", rationale: str = "", distinct: bool = False
) -> Check:
    """``distinct``: the measure counts distinct values."""
    return Check(name, (table,), measure, severity, rationale, distinct=distinct)


def frame_check(
    name: str, tables: tuple[str, ...], measure: Callable[..., DataFrame], severity: str = "error", rationale: str = ""
) -> Check:
    return Check(name, tables, measure, severity, rationale, one_pass=False)


def fails_if(condition: Column) -> Column:
    """1 when the aggregate condition holds, 0 otherwise (also when it is unknown)."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


# --- shapes of checks -------------------------------------------------------------------------

def null_keys(key: str) -> Callable[[], Column]:
    return lambda: F.count_if(F.col(key).isNull())


def repeated_keys(key: str) -> Callable[[], Column]:
    return lambda: F.count(F.lit(1)) - F.count_distinct(key)


def violating(condition: Callable[[], Column]) -> Callable[[], Column]:
    return lambda: count_where(condition())


def outside(low: float, high: float, *columns: str) -> Callable[[], Column]:
    def measure() -> Column:
        bad = F.lit(False)
        for c in columns:
            bad = bad | F.coalesce(~F.col(c).between(low, high), F.lit(False))
        return count_where(bad)
    return measure


def orphans(key: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    def measure(child: DataFrame, parent: DataFrame) -> DataFrame:
        return child.join(parent.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("violations"))
    return measure


def positions_not_contiguous(children: DataFrame, key: str = "record_id", position: str = "author_position") -> DataFrame:
    per_key = children.groupBy(key).agg(
        F.min(position).alias("low"), F.max(position).alias("high"), F.count(F.lit(1)).alias("n")
    )
    return per_key.agg(count_where((F.col("low") != 1) | (F.col("high") != F.col("n"))).alias("violations"))


def row_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    n_left = left.agg(F.count(F.lit(1)).alias("n_left"))
    n_right = right.agg(F.count(F.lit(1)).alias("n_right"))
    return n_left.crossJoin(F.broadcast(n_right)).select(F.abs(F.col("n_left") - F.col("n_right")).alias("violations"))


def cumulative_mismatch(table: DataFrame, period: str = "year", amount: str = "n_retractions",
                        stored: str = "cumulative_retractions") -> DataFrame:
    """Over a table of one row per calendar period."""
    again = F.sum(amount).over(Window.orderBy(period))
    return table.select((F.col(stored) != again).alias("bad")).agg(count_where(F.col("bad")).alias("violations"))


def tier_inversions(tiers: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Tiers (a handful of rows) whose precision beats the next higher tier by more than allowed."""
    higher = F.lag("precision_rate").over(Window.orderBy(F.desc("min_score")))
    bad = F.col("precision_rate") > higher + tolerance
    return tiers.select(bad.alias("bad")).agg(count_where(F.col("bad")).alias("violations"))


def count_mismatch(parents: DataFrame, children: DataFrame, key: str = "work_id", stored: str = "n_authors") -> DataFrame:
    counted = children.groupBy(key).agg(F.count(F.lit(1)).alias("n_counted"))
    compared = parents.filter(F.col(stored).isNotNull()).join(counted, key, "left")
    bad = F.col(stored) != F.coalesce("n_counted", F.lit(0))
    return compared.agg(count_where(bad).alias("violations"))


def nothing_in_common(left_key: str, right_key: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    def measure(left: DataFrame, right: DataFrame) -> DataFrame:
        found = left.join(right.select(F.col(right_key).alias(left_key)), left_key, "left_semi").limit(1)
        return found.agg(fails_if(F.count(F.lit(1)) == 0).alias("violations"))
    return measure


# --- the standard set -------------------------------------------------------------------------

def standard_checks(as_of: dt.date, min_records: int = 50_000, min_works: int = 30_000) -> tuple[Check, ...]:
    """The 38 checks of the warehouse. ``as_of`` stands for today."""
    today = F.lit(as_of)
    share_columns = ("paper_mill_share", "peer_review_fraud_share", "ai_generated_share", "china_share")
    structural = v.SCORE_NAMES["structural_score"]

    def date_after_today() -> Column:
        return F.col("retraction_date") > today

    def panel_unbalanced() -> Column:
        return fails_if(F.count_distinct("n_works") > 1)

    def eligible_difference(risk: DataFrame, profile: DataFrame) -> DataFrame:
        return row_difference(risk, profile.filter(F.col("n_retractions") >= v.MIN_GROUP_RECORDS))

    def year_difference(trends: DataFrame, enriched: DataFrame) -> DataFrame:
        years = enriched.filter(F.col("retraction_year").isNotNull()).select("retraction_year").distinct()
        return row_difference(trends, years)

    return (
        row_check("record key not null", "records", null_keys("record_id"),
                  rationale="children join on it; a NULL key loses rows without an error"),
        row_check("record key unique", "records", repeated_keys("record_id"), distinct=True,
                  rationale="a repeated record inflates every count"),
        row_check("date parse rate", "records",
                  lambda: fails_if(F.count("retraction_date") / F.nullif(F.count(F.lit(1)), F.lit(0)) < 0.995),
                  rationale="a changed date format would silently empty part of every trend"),
        row_check("date not in the future", "records", violating(date_after_today),
                  rationale="a future date is an entry or parsing error"),
        row_check("date not before 1900", "records",
                  violating(lambda: F.col("retraction_date") < F.lit(dt.date(1900, 1, 1))), "warning",
                  "an old typing error must be seen but need not block"),
        row_check("end date not before start date", "records",
                  violating(lambda: F.col("retraction_date") < F.col("original_paper_date")),
                  rationale="an event cannot precede what it is about"),
        row_check("nature in vocabulary", "records",
                  violating(lambda: ~F.col("retraction_nature").isin(*v.NATURES)), "warning",
                  "a new value means the vocabulary of the source grew"),
        row_check("reason not blank", "record_reasons",
                  violating(lambda: F.col("reason").isNull() | (trim_spaces("reason") == "")),
                  rationale="a blank value would become a category of its own"),
        frame_check("reasons have a record", ("record_reasons", "records"), orphans("record_id"),
                    rationale="orphans vanish in joins"),
        frame_check("countries have a record", ("record_countries", "records"), orphans("record_id"),
                    rationale="orphans would change country shares"),
        frame_check("authors have a record", ("record_authors", "records"), orphans("record_id"),
                    rationale="orphans would remove nodes from the network"),
        frame_check("author positions contiguous", ("record_authors",), positions_not_contiguous,
                    rationale="first and last author depend on the order"),
        row_check("enough records", "records", lambda: fails_if(F.count(F.lit(1)) < min_records),
                  rationale="a truncated load must not pass"),
        row_check("records fresh", "records",
                  lambda: fails_if(F.max("retraction_date") < F.date_sub(today, 400)), "warning",
                  "a source can stop quietly"),
        row_check("burst ratio in (0, 1]", "journal_profile",
                  violating(lambda: (F.col("burst_ratio") <= 0) | (F.col("burst_ratio") > 1.0001)),
                  rationale="a share above one has a wrong denominator"),
        row_check("peak within total", "journal_profile",
                  violating(lambda: F.col("peak_year_retractions") > F.col("n_retractions")),
                  rationale="a part cannot exceed the whole"),
        row_check("shares in [0, 1]", "journal_profile", outside(0, 1, *share_columns),
                  rationale="a share outside is an aggregation error"),
        row_check("score in [0, 100]", "journal_risk", outside(0, 100, "risk_score"),
                  rationale="weights and ranks bound the score"),
        row_check("global share in [0, 100]", "country_leaderboard", outside(0, 100, "share_of_global_pct"),
                  rationale="a percentage is bounded"),
        row_check("sole within total", "country_leaderboard",
                  violating(lambda: F.col("n_as_sole_country") > F.col("n_retractions")),
                  rationale="a subset cannot be larger"),
        frame_check("every eligible journal scored", ("journal_risk", "journal_profile"), eligible_difference,
                    rationale="a join that drops rows raises no error"),
        frame_check("trend covers every year", ("retraction_trends", "records_enriched"), year_difference,
                    rationale="a missing year looks like a quiet one"),
        frame_check("cumulative equals recomputed", ("retraction_trends",), cumulative_mismatch,
                    rationale="a wrong frame gives a smooth but wrong curve"),
        row_check("AUC in [0, 1]", "feature_discriminative_power", outside(0, 1, "auc"),
                  rationale="outside means the ranks are wrong"),
        row_check("structural AUC at least 0.5", "risk_score_validation",
                  lambda: fails_if(F.max(F.when(F.col("score_name") == structural, F.col("auc"))) < 0.5),
                  rationale="the score without label inputs must order better than chance"),
        frame_check("tiers not inverted", ("risk_tier_performance",), tier_inversions, "warning",
                    "a lower tier should not be more precise"),
        row_check("work key unique", "works", repeated_keys("work_id"), distinct=True,
                  rationale="a page landed twice doubles counts"),
        frame_check("author count equals author rows", ("works", "work_authorships"), count_mismatch, "warning",
                    "two ways to count must agree"),
        row_check("few citations before publication", "work_citations",
                  lambda: fails_if(share_where(F.col("years_since_publication") < 0) > 0.02), "warning",
                  "notices inherit citations of the paper; more than a few mean a parsing error"),
        row_check("enough works", "works", lambda: fails_if(F.count(F.lit(1)) < min_works),
                  rationale="a truncated load must not pass"),
        frame_check("sources share keys", ("works", "records"), nothing_in_common("doi", "original_paper_doi"),
                    "warning", "no match at all means the key formats differ"),
        row_check("panel balanced", "event_study", panel_unbalanced, distinct=True,
                  rationale="differences between times must not come from different works"),
        row_check("no bias before the event", "penalty_summary",
                  lambda: fails_if(F.abs(F.max("mean_gap_before_retraction")) > 0.5), "warning",
                  "the fitted line must pass through the past"),
        row_check("panel covers the window", "event_study", lambda: fails_if(F.count(F.lit(1)) != 6),
                  rationale="a missing time means a wrong filter"),
        row_check("match rate at least 40 %", "works_enriched",
                  lambda: fails_if(share_where(F.col("matched_in_records")) < 0.40), "warning",
                  "a collapse means the key formats differ"),
        frame_check("members have a cluster", ("author_cluster_members", "author_clusters"), orphans("cluster_id"),
                    rationale="members of filtered clusters must be filtered too"),
        row_check("small clusters not all saturated", "author_clusters",
                  lambda: fails_if(
                      F.avg(F.when(F.col("n_authors") == 3, (F.col("density") >= 0.999).cast("double"))) > 0.99
                  ), "warning", "density carries no information in clusters of three"),
        row_check("cluster AUC at least 0.5", "author_cluster_validation", lambda: fails_if(F.max("auc") < 0.5),
                  rationale="one of the scores must order better than chance"),
    )


# --- running ----------------------------------------------------------------------------------

def missing_tables(tables: Tables, checks: Iterable[Check]) -> list[str]:
    """Tables that the checks need and the caller does not have."""
    return sorted({t for check in checks for t in check.tables if t not in tables})


def written_measures(checks: Iterable[Check], table: str) -> dict[str, Column]:
    """The one-pass checks of a table that can be counted while it is written, by name.

    Distinct counts can't: they need the rows of a key together.
    """
    return {
        c.name: F.coalesce(c.measure().cast("bigint"), F.lit(0).cast("bigint"))
        for c in checks if c.one_pass and not c.distinct and c.tables == (table,)
    }


def run_checks(
    tables: Tables, checks: Iterable[Check], observed: Mapping[str, Mapping[str, int]] | None = None
) -> DataFrame:
    """One row per check: violations, error text, status and whether it blocks a release.

    ``observed`` has counts of checks by table and name that were taken when the table was written.
    """
    known = {name: n for counts in (observed or {}).values() for name, n in counts.items()}
    checks = list(checks)
    spark = next(iter(tables.values())).sparkSession
    errors: dict[str, str] = {}
    by_table: dict[str, list[tuple[Check, Column]]] = {}
    frames: list[tuple[Check, DataFrame]] = []
    for check in checks:
        absent = [t for t in check.tables if t not in tables]
        if absent:
            errors[check.name] = f"missing table: {', '.join(absent)}"
            continue
        if check.name in known:
            continue
        inputs = [tables[t] for t in check.tables]
        try:
            if check.one_pass:
                measure = check.measure()
                inputs[0].agg(measure)
                by_table.setdefault(check.tables[0], []).append((check, measure))
            else:
                counted = check.measure(*inputs)
                frames.append((check, counted.select(
                    F.lit(check.name).alias("check_name"), F.col("violations").cast("bigint").alias("violations")
                )))
        except AnalysisException as problem:
            errors[check.name] = f"{type(problem).__name__}: {str(problem).splitlines()[0]}"
    alone = dict(frames)
    together = [frame for _, frame in frames]
    for table, measures in by_table.items():
        one_row = tables[table].agg(*[m.cast("bigint").alias(f"_{i}") for i, (_, m) in enumerate(measures)])
        rows = [
            F.struct(F.lit(check.name).alias("check_name"), F.col(f"_{i}").alias("violations"))
            for i, (check, _) in enumerate(measures)
        ]
        together.append(one_row.select(F.inline(F.array(*rows))))
        for check, m in measures:
            alone[check] = tables[table].agg(m.cast("bigint").alias("violations")).select(
                F.lit(check.name).alias("check_name"), "violations"
            )
    if known:
        seen = spark.createDataFrame(list(known.items()), "check_name string, violations bigint")
        together.append(seen)
        alone |= {check: seen.filter(F.col("check_name") == check.name) for check in checks if check.name in known}
    counted = _counted(spark, together, alone, errors)

    described = spark.createDataFrame(
        [(c.name, c.severity, c.rationale, errors.get(c.name)) for c in checks],
        "check_name string, severity string, rationale string, execution_error string",
    )
    broken = F.col("execution_error").isNotNull()
    failed = ~broken & (F.col("violations") > 0)
    is_error = F.col("severity") == "error"
    return described.join(F.broadcast(counted), "check_name", "left").withColumn(
        "violations", F.coalesce("violations", F.lit(0).cast("bigint"))
    ).select(
        "check_name", "severity", "rationale", "violations", "execution_error",
        F.when(broken, F.lit("errored")).when(failed & is_error, F.lit("failed_error"))
        .when(failed, F.lit("failed_warning")).otherwise(F.lit("passed")).alias("status"),
        (broken | (failed & is_error)).alias("blocks_release"),
    )


def _counted(
    spark: SparkSession, together: list[DataFrame], alone: Mapping[Check, DataFrame], errors: dict[str, str]
) -> DataFrame:
    """The counts of all checks in one job; if that fails, each by itself, so that only the broken ones err."""
    def united(frames: list[DataFrame]) -> DataFrame:
        rows = spark.createDataFrame([], "check_name string, violations bigint")
        for frame in frames:
            rows = rows.unionByName(frame)
        return rows

    try:
        return materialize(united(together), "checks")
    except (PySparkException, Py4JJavaError):
        done = []
        for check, frame in alone.items():
            try:
                done.append(materialize(frame, "check"))
            except (PySparkException, Py4JJavaError) as problem:
                errors[check.name] = f"{type(problem).__name__}: {str(problem).splitlines()[0]}"
        return united(done)


def summarize(report: DataFrame) -> DataFrame:
    """Five counters in one row."""
    def having(status: str) -> Column:
        return F.count_if(F.col("status") == status).alias(status)

    return report.agg(
        F.count(F.lit(1)).alias("total"), having("passed"), having("errored"),
        having("failed_error"), having("failed_warning"),
    )


def has_blocking_failure(report: DataFrame) -> bool:
    return not report.filter("blocks_release").isEmpty()
