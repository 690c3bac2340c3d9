"""Reader of the record CSV: all columns as text, quoted multi-line notes, a nameless last column.

A line with more or fewer cells than the header is not taken apart by guess: it lands with its text and what is wrong.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The column names in the header of a record file.
RECORD_COLUMNS = (
    "Record ID", "Title", "Subject", "Institution", "Journal", "Publisher", "Country", "Author",
    "URLS", "ArticleType", "RetractionDate", "RetractionDOI", "RetractionPubMedID",
    "OriginalPaperDate", "OriginalPaperDOI", "OriginalPaperPubMedID", "RetractionNature", "Reason",
    "Paywalled", "Notes",
)


#: Column of the reader that holds the text of a line it could not parse.
BROKEN = "_broken"
WRONG_SHAPE = "line of another number of cells"


def land_records(spark: SparkSession, path: str | list[str], strict: bool = False) -> DataFrame:
    """All named columns as strings, ``source_file``, ``problem`` and ``line``; no type is guessed.

    A line of another number of cells than the header has null cells, the problem ``WRONG_SHAPE`` and its text as
    ``line``; the nameless last column may be missing. ``strict`` raises instead. Columns come from the header
    of the first file. Land the result once; ``read_records_csv`` and ``broken_records`` are the two parts of it.
    """
    options = {"header": True, "multiLine": True, "escape": '"', "inferSchema": False}
    found = spark.read.options(**options).csv(path).columns
    named = [c for c in found if not _is_nameless(c)]
    mode = {"mode": "FAILFAST" if strict else "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}
    schema = ", ".join([f"`{c}` STRING" for c in [*found, BROKEN]])
    df = spark.read.options(**options, **mode).schema(schema).csv(path)
    # The same line against the named columns alone: whole when only the nameless cells are missing.
    again = F.from_csv(F.col(BROKEN), ", ".join([f"`{c}` STRING" for c in [*named, BROKEN]]), {"escape": '"', "columnNameOfCorruptRecord": BROKEN})
    # The cell keeps another column in the scan: Spark refuses to read the texts of broken lines alone.
    broken = F.col(BROKEN).isNotNull() & again[BROKEN].isNotNull() | (F.length(F.col(f"`{found[0]}`")) < 0)
    broken = F.coalesce(broken, F.lit(False))
    return df.select(
        *[F.when(~broken, F.col(f"`{c}`")).alias(c) for c in named], F.col("_metadata.file_path").alias("source_file"),
        F.when(broken, F.lit(WRONG_SHAPE)).alias("problem"), F.when(broken, F.col(BROKEN)).alias("line"),
    )


def records_of(landed: DataFrame) -> DataFrame:
    """The lines of a landed file that could be read: all named columns as strings plus ``source_file``."""
    return landed.filter(F.col("problem").isNull()).drop("problem", "line")


def broken_records(landed: DataFrame) -> DataFrame:
    """(source_file, problem, line): the lines that could not be read."""
    return landed.filter(F.col("problem").isNotNull()).select("source_file", "problem", "line")


def read_records_csv(spark: SparkSession, path: str | list[str], strict: bool = False) -> DataFrame:
    """All named columns of the lines that can be read, as strings, plus ``source_file``."""
    return records_of(land_records(spark, path, strict))


def _is_nameless(name: str) -> bool:
    return not name.strip() or (name.startswith("_c") and name[2:].isdigit())


def unmapped_columns(df: DataFrame) -> list[str]:
    """Columns the pipeline does not know, a sign that the source changed its layout."""
    return [c for c in df.columns if c not in (*RECORD_COLUMNS, "source_file", "problem", "line")]


def unmapped_report(landed: DataFrame) -> DataFrame:
    """(column_name, n_values): columns the pipeline does not know and how many values each has; one pass."""
    counts = [F.count(F.col(f"`{c}`")).alias(f"_{i}") for i, c in enumerate(unmapped_columns(landed))]
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"_{i}").alias("n_values")) for i, c in enumerate(unmapped_columns(landed))]
    if not rows:
        return landed.sparkSession.createDataFrame([], "column_name string, n_values long")
    return landed.agg(*counts).select(F.inline(F.array(*rows)))


def write_records_csv(df: DataFrame, path: str) -> None:
    """Write in the layout the reader expects, the nameless last column included."""
    with_tail = df.select(*[F.col(f"`{c}`") for c in RECORD_COLUMNS], F.lit(None).cast("string").alias(" "))
    with_tail.write.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
