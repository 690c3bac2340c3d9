"""Ranks over whole tables without a window that gathers every row in one task.

Rows are first collapsed to (group, value, count), so a value held by a third of all rows is one
row. The collapsed frame is range-partitioned and written with its partition number; the totals
per partition are a frame of at most partitions + groups rows, and the running total inside a
partition is a normal partitioned window. Every rank follows from (n_less, n_equal, n_total).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.operators.persisting import materialize

SLOT = "_slot"
HOT_VALUES = 1000


def running_before(
    df: DataFrame,
    order: Sequence[Column],
    amounts: Mapping[str, Column],
    by: Sequence[str] = (),
    partitions: int | None = None,
) -> DataFrame:
    """Add ``<name>_before`` (sum over earlier rows) and ``<name>_total`` for each amount.

    ``order`` must be total within a group, ``by`` must not be NULL. The result is exact for any
    number of partitions; without one, adaptive execution merges small neighbouring ranges.
    """
    named = df.select("*", *[amount.cast("bigint").alias(name) for name, amount in amounts.items()])
    keys = [*[F.col(b) for b in by], *order]
    ranged = named.repartitionByRange(partitions, *keys) if partitions else named.repartitionByRange(*keys)
    placed = materialize(ranged.withColumn(SLOT, F.spark_partition_id()), "ordered")
    slots = placed.groupBy(*by, SLOT).agg(*[F.sum(name).alias(name) for name in amounts])
    earlier = Window.partitionBy(*by).orderBy(SLOT).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = slots.select(
        *by,
        SLOT,
        *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}_offset") for n in amounts],
        *[F.sum(n).over(whole).alias(f"{n}_total") for n in amounts],
    )
    inside = Window.partitionBy(*by, SLOT).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return placed.join(offsets, [*by, SLOT]).select(
        *df.columns,
        *[
            (F.col(f"{n}_offset") + F.coalesce(F.sum(n).over(inside), F.lit(0))).alias(f"{n}_before")
            for n in amounts
        ],
        *[f"{n}_total" for n in amounts],
    )


def value_ranks(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per (group, value): how many rows are smaller, equal, and in total. NULL is last."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n_equal"))
    ranked = running_before(
        counts, [F.col(value).asc_nulls_last()], {"n": F.col("n_equal")}, by
    )
    return ranked.select(
        *by, value, "n_equal", F.col("n_before").alias("n_less"), F.col("n_total")
    )


def rank_min() -> Column:
    return F.col("n_less") + 1


def percent_rank() -> Column:
    """(rank - 1) / (rows - 1); 0 for a single row."""
    return F.when(F.col("n_total") > 1, F.col("n_less") / (F.col("n_total") - 1.0)).otherwise(F.lit(0.0))


def average_rank() -> Column:
    """Rank with ties sharing the mean of their places."""
    return F.col("n_less") + (F.col("n_equal") + 1) / F.lit(2.0)


def percent_average_rank() -> Column:
    """Average rank over the number of rows; rank NULLs must have been removed before."""
    return average_rank() / F.col("n_total")


def attach_ranks(rows: DataFrame, ranks: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Give every row the counts of its value, however uneven the values are.

    A value held by more than 1/1000 of all rows is hot. There are fewer than 1000 hot values
    whatever the size of the data, so they are broadcast; their rows skip the shuffled lookup by
    a spread key instead of meeting in one task.
    """
    facts = ["n_equal", "n_less", "n_total"]
    keys = [*by, value]
    grand = ranks.agg(F.sum("n_equal").alias("_rows"))
    marked = ranks.crossJoin(F.broadcast(grand)).withColumn(
        "_hot", F.col("n_equal") * HOT_VALUES > F.col("_rows")
    )
    hot = marked.filter("_hot").select(
        *[F.col(k).alias(f"_h_{k}") for k in keys], *[F.col(f).alias(f"_h_{f}") for f in facts]
    )
    cold = marked.filter("NOT _hot").select(
        *[F.col(k).alias(f"_c_{k}") for k in keys],
        *[F.col(f).alias(f"_c_{f}") for f in facts],
        F.lit(-1).alias("_c_spread"),
    )
    on_hot = F.lit(True)
    on_cold = F.col("_spread") == F.col("_c_spread")
    for k in keys:
        on_hot = on_hot & F.col(k).eqNullSafe(F.col(f"_h_{k}"))
        on_cold = on_cold & F.col(k).eqNullSafe(F.col(f"_c_{k}"))
    spread = F.when(F.col("_h_n_equal").isNull(), F.lit(-1)).otherwise(
        F.pmod(F.xxhash64(*rows.columns), F.lit(4096)).cast("int")
    )
    return (
        rows.join(F.broadcast(hot), on_hot, "left")
        .withColumn("_spread", spread)
        .join(cold, on_cold, "left")
        .select(
            *rows.columns, *[F.coalesce(f"_h_{f}", f"_c_{f}").alias(f) for f in facts]
        )
    )


def row_numbers(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """1-based position in a global total order."""
    numbered = running_before(df, order, {"_one": F.lit(1)})
    return numbered.select(*df.columns, (F.col("_one_before") + 1).alias(name))


def rank_sum_auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve per group from the rank sum, ties counted half.

    Needs no rank per row: with positives and negatives per distinct score, each positive beats
    the negatives below it and ties with half of the equal ones. NULL when a class is missing.
    """
    usable = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    classes = usable.groupBy(*by, score).agg(
        F.count_if(F.col(label)).alias("n_pos"), F.count_if(~F.col(label)).alias("n_neg")
    )
    ordered = running_before(classes, [F.col(score).asc()], {"neg": F.col("n_neg")}, by)
    beaten = F.col("n_pos") * (F.col("neg_before") + F.col("n_neg") / F.lit(2.0))
    return ordered.groupBy(*by).agg(
        F.sum("n_pos").alias("n_positive"),
        F.sum("n_neg").alias("n_negative"),
        F.sum(beaten).alias("_wins"),
    ).select(
        *by,
        F.coalesce("n_positive", F.lit(0)).alias("n_positive"),
        F.coalesce("n_negative", F.lit(0)).alias("n_negative"),
        (
            F.col("_wins")
            / F.nullif(F.col("n_positive").cast("double") * F.col("n_negative"), F.lit(0.0))
        ).alias("auc"),
    )
