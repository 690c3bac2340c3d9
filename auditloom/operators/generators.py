"""Row generators: one row in, many rows out, always map-side."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions import split_multi


def explode_values(df: DataFrame, key: str, raw: str, value: str) -> DataFrame:
    """One row per (key, value) of a multi-valued text; keys without a value drop out."""
    return (
        df.filter(F.col(key).isNotNull())
        .select(key, F.explode(split_multi(raw)).alias(value))
    )


def explode_positions(df: DataFrame, key: str, raw: str, position: str, value: str) -> DataFrame:
    """As ``explode_values`` with the 1-based place of each value in its list."""
    return (
        df.filter(F.col(key).isNotNull())
        .select(key, F.posexplode(split_multi(raw)).alias("_at", value))
        .select(key, (F.col("_at") + 1).cast("bigint").alias(position), value)
    )


def cross_offsets(df: DataFrame, first: int, last: int, name: str) -> DataFrame:
    """Repeat every row for each integer offset first..last (both included)."""
    offsets = F.sequence(F.lit(first).cast("bigint"), F.lit(last).cast("bigint"))
    return df.select("*", F.explode(offsets).alias(name))


def unpivot(
    df: DataFrame, keep: list[str], measures: Mapping[str, Column], name: str, value: str
) -> DataFrame:
    """Wide to long in one map-side pass; every measure becomes a double."""
    pairs = [
        F.struct(F.lit(label).alias(name), column.cast("double").alias(value))
        for label, column in measures.items()
    ]
    return df.select(*keep, F.inline(F.array(*pairs)))
