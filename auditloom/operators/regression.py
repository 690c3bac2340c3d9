"""Straight-line fits from sums, so the data is reduced before anything is combined."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ols_fit(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares slope and intercept per group; NULL when x does not vary."""
    points = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(
        *by, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")
    )
    sums = points.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("x").alias("sx"),
        F.sum("y").alias("sy"),
        F.sum(F.col("x") * F.col("y")).alias("sxy"),
        F.sum(F.col("x") * F.col("x")).alias("sxx"),
    )
    spread = F.nullif(F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"), F.lit(0.0))
    sloped = sums.withColumn("slope", (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / spread)
    return sloped.select(
        *by,
        F.col("n").alias("n_points"),
        "slope",
        ((F.col("sy") - F.col("slope") * F.col("sx")) / F.nullif(F.col("n"), F.lit(0))).alias("intercept"),
    )
