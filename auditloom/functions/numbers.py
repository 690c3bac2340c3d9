"""Numeric helpers. All ratios are doubles: decimal literals would lose digits in averages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from auditloom.functions.text import _col


def round_to(c: Column | str, digits: int) -> Column:
    """Round half away from zero on the scaled double, the common database rule."""
    scale = float(10**digits)
    return F.round(_col(c).cast("double") * F.lit(scale)) / F.lit(scale)


def ratio(top: Column | str, bottom: Column | str) -> Column:
    """top / bottom as a double; NULL for a zero bottom."""
    return _col(top).cast("double") / F.nullif(_col(bottom).cast("double"), F.lit(0.0))


def share_where(condition: Column) -> Column:
    """Aggregate: share of rows that meet the condition (NULL counts as not met)."""
    return F.avg(F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0)))


def count_where(condition: Column) -> Column:
    """Aggregate: number of rows that meet the condition."""
    return F.count_if(F.coalesce(condition, F.lit(False)))
