"""Joins to one row per key, however uneven the keys are."""

from __future__ import annotations

from pyspark.sql import DataFrame


def lookup(rows: DataFrame, per_key: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``per_key``, which has one row per key.

    Adaptive execution splits the rows of a hot key over many tasks only if both inputs of the join are
    plain shuffles. A frame made by an aggregation on the key is not: it would be joined in the very
    partitions it was aggregated in, with all rows of a hot key in one task. It is therefore dealt out
    once more (one row per key), after which the join has its own shuffle on both sides.
    """
    return rows.join(per_key.hint("rebalance"), key, how)
