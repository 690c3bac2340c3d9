"""Source profile and table catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions import parse_date, ratio, round_to, split_multi, year_of
from auditloom.operators.aggregates import null_rates, row_counts, top_values
from auditloom.sources.tables import comments_of


def date_profile(df: DataFrame, raw_date: str) -> DataFrame:
    """Earliest and latest date of a text column and the number of rows that are no date."""
    return df.select(parse_date(raw_date).alias("d")).agg(
        F.min("d").alias("first_date"), F.max("d").alias("last_date"),
        F.count_if(F.col("d").isNull()).alias("n_unparsable"),
    )


def top_values_exploded(df: DataFrame, raw: str, value: str, limit: int) -> DataFrame:
    """Most frequent single values of a multi-valued text column."""
    return top_values(df.select(F.explode(split_multi(raw)).alias(value)), value, limit)


def count_by_year(df: DataFrame, raw_date: str) -> DataFrame:
    """Rows per year; rows whose date does not parse are left out."""
    return (
        df.select(year_of(parse_date(raw_date)).alias("year")).filter(F.col("year").isNotNull())
        .groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    )


def table_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per column of every table: position, name, type, rows of the table."""
    spark = next(iter(tables.values())).sparkSession
    columns = [
        (name, place, field.name, field.dataType.simpleString())
        for name, df in tables.items() for place, field in enumerate(df.schema.fields, start=1)
    ]
    schema = "table_name string, position int, column_name string, data_type string"
    return spark.createDataFrame(columns, schema).join(row_counts(tables), "table_name")


def documentation_coverage(profile: DataFrame, described: DataFrame) -> DataFrame:
    """Share of columns that have a description (frame ``column_name, description``)."""
    known = described.filter(F.col("description").isNotNull()).select("column_name").distinct()
    marked = profile.join(known.withColumn("_known", F.lit(1)), "column_name", "left")
    return marked.groupBy("table_name").agg(
        F.count(F.lit(1)).alias("n_columns"), F.count("_known").alias("n_documented")
    ).withColumn("coverage_pct", round_to(ratio(F.col("n_documented") * 100, "n_columns"), 1))




def stored_descriptions(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, description) of every column, as the tables carry them; null without one."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(name, f.name, comments_of(df).get(f.name)) for name, df in tables.items() for f in df.schema.fields]
    return spark.createDataFrame(rows, "table_name string, column_name string, description string")


def stored_coverage(tables: dict[str, DataFrame]) -> DataFrame:
    """Share of the columns of every table that carry a description."""
    return stored_descriptions(tables).groupBy("table_name").agg(
        F.count(F.lit(1)).alias("n_columns"), F.count("description").alias("n_documented")
    ).withColumn("coverage_pct", round_to(ratio(F.col("n_documented") * 100, "n_columns"), 1))


def source_profile(df: DataFrame, limit: int | None = None) -> DataFrame:
    """One row per column of a source: null_pct, with n_rows and n_columns of the source; most nulls first."""
    rates = null_rates(df, df.columns, limit or len(df.columns))
    rows = df.agg(F.count(F.lit(1)).alias("n_rows"))
    return rates.crossJoin(F.broadcast(rows)).withColumn("n_columns", F.lit(len(df.columns)))
