"""Mixing sources to target weights by weighted fair queueing.

Every copy of a document gets a virtual finish time: the words its source has queued up to and
including it, over the target of the source. Copies are sorted by finish time over all sources and
taken until the total budget is spent, so at any moment every source has been served in proportion
to its target. Running sums are exact range-partitioned prefix sums: a source with a third of all
rows is many partitions, and no window sees a whole source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import n_words
from auditloom.operators.persisting import materialize
from auditloom.operators.ranking import row_numbers, running_before

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_COPIES = 2


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES
) -> DataFrame:
    """(source, source_rank, source_size, target) from rows of (source, size).

    Sources ordered by code point, null last, take the weights in turn. Together they get ``share``
    of all words; a target above ``max_copies`` times its source stops there and the excess goes to
    the others by weight, until none is above. Only three sums a step reach the driver.
    """
    if share > max_copies:
        raise ValueError("no mix of at most max_copies of each document can hold that share")
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = row_numbers(totals, [F.col("source").asc_nulls_last()], "source_rank")
    turn = (F.col("source_rank") - 1) % len(weights) + 1
    weighed = materialize(
        ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int")))
        .withColumn("ceiling", max_copies * F.col("source_size")),
        "sources",
    )
    level, settled = 0.0, -1
    while True:
        above = F.col("ceiling") < F.lit(level) * F.col("weight")
        stopped, held, free, words = weighed.agg(
            F.count_if(above),
            F.sum(F.when(above, F.col("ceiling")).otherwise(0)),
            F.sum(F.when(above, 0).otherwise(F.col("weight"))),
            F.sum("source_size"),
        ).first()
        if stopped == settled or not free:
            break
        level, settled = (share * words - held) / free, stopped
    fair = F.lit(level) * F.col("weight")
    target = F.when(F.col("ceiling") < fair, F.col("ceiling").cast("double")).otherwise(fair)
    return weighed.select("source", "source_rank", "source_size", target.alias("target"))


def shuffled(seed: str) -> Column:
    """Sort key of a document in the shuffled order of its source."""
    return F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    max_copies: int = MAX_COPIES,
    seed: str = "mix",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken, text_hash.

    ``docs`` needs doc_id, text and source; other columns are ignored. A null text has size 0, a null
    source is a source of its own, and rows that repeat an id are documents of their own (equal rows
    are interchangeable). Documents of size 0 take no words; they count as taken when their place in
    the queue is before the cut. An empty table gives an empty mix. The order depends on the seed and
    the rows only.
    """
    sized = materialize(
        docs.select(
            "doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash"),
            shuffled(seed).alias("place"),
        ),
        "sized",
    )
    targets = source_targets(sized.select("source", "size"), weights, share, max_copies)
    targets = materialize(targets.withColumnRenamed("source", "named"), "targets")
    rows = sized.join(targets, F.col("source").eqNullSafe(F.col("named"))).drop("named")
    queued = running_before(
        rows, [F.col("place"), F.col("doc_id"), F.col("text_hash")], {"queue": F.col("size")}, ["source_rank"]
    )
    first = F.col("queue_before") + F.col("size")
    queued = materialize(queued.withColumn("first", first).drop("queue_before", "queue_total"), "queued")

    def finish(turn: Column) -> Column:
        return F.when(F.col("target") > 0, (F.col("first") + turn * F.col("source_size")) / F.col("target")).otherwise(0.0)

    def copy(turn: Column) -> Column:
        return F.struct(finish(turn).alias("finish"), "source_rank", turn.alias("turn"), "place", "doc_id", "text_hash")

    turns = F.explode(F.array(*[F.lit(t) for t in range(max_copies)]))
    copies = queued.select("*", turns.alias("turn")).select(copy(F.col("turn")).alias("at"), "size")
    served = running_before(copies, [F.col("at")], {"words": F.col("size")})
    # Finish times are scaled so that all targets are met at time 1: the budget is the sum of targets.
    budget = targets.agg(F.coalesce(F.sum("target"), F.lit(0.0)).alias("budget"))
    cut = (
        served.crossJoin(F.broadcast(budget))
        .filter(F.col("words_before") + F.col("size") <= F.col("budget") + 1e-6)
        .agg(F.max("at").alias("cut"))
    )
    taken = sum(
        (F.when(copy(F.lit(t)) <= F.col("cut"), 1).otherwise(0) for t in range(max_copies)), F.lit(0)
    )
    return (
        queued.crossJoin(F.broadcast(cut))
        .select(
            "doc_id", "source", "size", "source_size", "target", taken.cast("bigint").alias("copies"), "text_hash"
        )
        .withColumn("taken", F.col("copies") * F.col("size"))
    )
