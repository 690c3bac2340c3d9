"""Aggregations that need more than one built-in function."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions import count_where, round_to, years_from_days


def join_median(totals: DataFrame, rows: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    """Add the exact median of ``value`` per key to a frame of one row per key.

    Kept apart from distinct counts on purpose: those group by each counted value first, and a
    median inside would build one value map per such group. Alone it needs one map per key, with
    one entry per distinct value. Both sides are partitioned by the key, so the join moves nothing.
    """
    medians = rows.groupBy(*keys).agg(round_to(F.median(value), 1).alias(name))
    return totals.join(medians, list(keys), "left")


def mode_per_key(df: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent value of each key; the smaller value wins a tie."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("less"), F.col(value)))
    return counts.groupBy(key).agg(best.alias("_best")).select(
        key, F.col(f"_best.{value}").alias(value), (-F.col("_best.less")).alias("n")
    )


def peak_per_group(df: DataFrame, group: str, period: str) -> DataFrame:
    """Busiest period of each group with its row count; the later period wins a tie."""
    counts = (
        df.filter(F.col(group).isNotNull() & F.col(period).isNotNull())
        .groupBy(group, period)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    peak = F.max(F.struct("n", period))
    return counts.groupBy(group).agg(peak.alias("_peak")).select(
        group, F.col(f"_peak.{period}").alias("peak_period"), F.col("_peak.n").alias("peak_rows")
    )


def top_values(df: DataFrame, value: str, limit: int) -> DataFrame:
    """Most frequent non-null values; ties by value, so the list is stable."""
    return (
        df.filter(F.col(value).isNotNull())
        .groupBy(value)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc(value))
        .limit(limit)
    )


def null_rates(df: DataFrame, columns: Sequence[str], limit: int = 5) -> DataFrame:
    """Columns with the highest share of NULLs, in percent, from one pass over the data."""
    one_row = df.agg(
        *[(F.avg(F.col(f"`{c}`").isNull().cast("double")) * 100.0).alias(f"_{i}") for i, c in enumerate(columns)]
    )
    pairs = [
        F.struct(F.lit(c).alias("column_name"), round_to(f"_{i}", 1).alias("null_pct"), F.col(f"_{i}").alias("_raw"))
        for i, c in enumerate(columns)
    ]
    return (
        one_row.select(F.inline(F.array(*pairs)))
        .orderBy(F.desc("_raw"), F.asc("column_name"))
        .limit(limit)
        .select("column_name", "null_pct")
    )


def histogram(df: DataFrame, value: Column, bins: int) -> DataFrame:
    """Equal-width bins over the observed range; the last bin holds the maximum."""
    values = df.select(value.cast("double").alias("v")).filter(F.col("v").isNotNull())
    counted = values.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    bounds = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    place = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / width)).otherwise(F.lit(0))
    bin_no = F.least(place, F.lit(bins - 1).cast("bigint")).cast("bigint")
    return (
        counted.crossJoin(F.broadcast(bounds))
        .groupBy(bin_no.alias("bin"), "lo", "hi")
        .agg(F.sum("n").alias("n"))
        .select(
            "bin",
            (F.col("lo") + F.col("bin") * width).alias("bin_start"),
            (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_end"),
            "n",
        )
    )


def latency_histogram(
    records: DataFrame, days: str = "retraction_latency_days", longest: int = 12000, bins: int = 60
) -> DataFrame:
    """Distribution of a delay in years, over delays of 0..longest days."""
    return histogram(
        records.filter(F.col(days).between(0, longest)), years_from_days(days), bins
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table with its row count."""
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in tables.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def keep_and_count(df: DataFrame, keep: Column, *more: Column) -> DataFrame:
    """Rows read, kept and dropped by a filter, and ``more`` aggregates, in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("rows_read"), count_where(keep).alias("rows_kept"), *more
    ).withColumn("rows_dropped", F.col("rows_read") - F.col("rows_kept"))


# --- distinct counts and quantiles that can be stored and merged --------------------------------

def distinct_bitmaps(df: DataFrame, by: Sequence[str], value: Column) -> DataFrame:
    """(*by, bucket, bits): which whole numbers occur, 32,768 to a bitmap of 4 KB.

    A task sends one bitmap per group and range of numbers, however many rows it has. Good for few groups with very many
    values; for many groups with few values each, sets are smaller.
    """
    number = value.cast("bigint")
    return df.filter(number.isNotNull()).groupBy(*by, F.bitmap_bucket_number(number).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits")
    )


def count_bitmaps(bitmaps: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """(*by, name): exact distinct counts of coarser groups, from stored bitmaps."""
    united = bitmaps.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return united.groupBy(*by).agg(F.sum(F.bitmap_count("bits")).alias(name))


def distinct_counts(df: DataFrame, by: Sequence[str], columns: dict[str, Column]) -> DataFrame:
    """(*by, a column per name): exact distinct counts of whole-number columns, one pruned pass for each.

    Counting them in one aggregation would multiply every row by their number.
    """
    parts = [df.select(*by).distinct().select(*by, F.lit(-1).alias("_which"), F.lit(0).cast("bigint").alias("_n"))]
    for i, value in enumerate(columns.values()):
        parts.append(count_bitmaps(distinct_bitmaps(df, by, value), by, "_n").select(*by, F.lit(i).alias("_which"), "_n"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    counts = [F.sum(F.when(F.col("_which") == i, F.col("_n")).otherwise(0)).alias(name) for i, name in enumerate(columns)]
    return rows.groupBy(*by).agg(*counts)


#: Size of a quantile sketch; ranks are off by 1 % or so at this size.
SKETCH_SIZE = 400


def quantile_sketches(df: DataFrame, by: Sequence[str], value: str, size: int = SKETCH_SIZE) -> DataFrame:
    """(*by, sketch): KLL sketches of a whole-number column, a few KB each, to be stored and merged."""
    known = df.filter(F.col(value).isNotNull())
    return known.groupBy(*by).agg(F.kll_sketch_agg_bigint(F.col(value).cast("bigint"), F.lit(size)).alias("sketch"))


def merge_sketches(sketches: DataFrame, by: Sequence[str], size: int = SKETCH_SIZE) -> DataFrame:
    """Sketches of coarser groups, without another look at the rows; ``by`` may be empty."""
    return sketches.groupBy(*by).agg(F.kll_merge_agg_bigint("sketch", F.lit(size)).alias("sketch"))


def sketch_quantile(sketch: str, share: float) -> Column:
    return F.kll_sketch_get_quantile_bigint(F.col(sketch), F.lit(share))


def sketch_rows(sketch: str) -> Column:
    return F.kll_sketch_get_n_bigint(F.col(sketch))
