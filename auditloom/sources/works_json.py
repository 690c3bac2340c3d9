"""Reader of gzip JSON pages: one object per page with a ``results`` array of works.

A page that can't be read is not lost: it lands as a row without a work that holds the page's text, and the
quarantine names it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Column of the reader that holds the text of a page it could not parse.
BROKEN = "_broken"
MALFORMED, NO_LIST, WRONG_VALUES, EMPTY, UNREADABLE_FILE = (
    "malformed page", "no list of works", "values of a wrong type", "empty list", "unreadable file",
)

_TOPIC = """
    STRUCT<id: STRING, display_name: STRING, score: DOUBLE, domain: STRUCT<display_name: STRING>,
           field: STRUCT<display_name: STRING>, subfield: STRUCT<display_name: STRING>>
"""
_WORK = f"""
    id STRING, doi STRING, title STRING, publication_year BIGINT, publication_date STRING,
    type STRING, language STRING, is_retracted BOOLEAN, cited_by_count BIGINT,
    referenced_works_count BIGINT, fwci DOUBLE, countries_distinct_count BIGINT,
    institutions_distinct_count BIGINT,
    open_access STRUCT<is_oa: BOOLEAN, oa_status: STRING, oa_url: STRING>,
    primary_topic {_TOPIC},
    topics ARRAY<{_TOPIC}>,
    biblio STRUCT<volume: STRING, issue: STRING, first_page: STRING, last_page: STRING>,
    counts_by_year ARRAY<STRUCT<year: BIGINT, cited_by_count: BIGINT>>,
    authorships ARRAY<STRUCT<author_position: STRING,
        author: STRUCT<id: STRING, display_name: STRING, orcid: STRING>,
        raw_author_name: STRING, is_corresponding: BOOLEAN, countries: ARRAY<STRING>,
        institutions: ARRAY<STRUCT<id: STRING, display_name: STRING, country_code: STRING,
                                   type: STRING, ror: STRING>>>>
"""


def work_schema() -> T.StructType:
    return T.StructType.fromDDL(_WORK)


def page_schema() -> T.StructType:
    return T.StructType([T.StructField("results", T.ArrayType(work_schema())), T.StructField(BROKEN, T.StringType())])


def page_options(one_page_per_file: bool, strict: bool) -> dict[str, str]:
    """Options of the JSON reader: a broken page keeps its text in a column of its own, or ends the job.

    A file of one page whose bytes can't be decompressed is passed over; ``quarantine`` names it. In a file of many
    pages that would lose the lines after the damage unseen, so there it ends the job.
    """
    kept = {"mode": "FAILFAST"} if strict else {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BROKEN}
    passed = {"ignoreCorruptFiles": "true"} if one_page_per_file and not strict else {}
    return {"multiLine": str(one_page_per_file).lower(), **kept, **passed}


def land_pages(pages: DataFrame) -> DataFrame:
    """(w, source_file, problem, page): one row per work, and one for each page that gave no, or not all, works.

    ``problem`` is null for works, ``MALFORMED`` for a page that isn't JSON (cut off, say), ``NO_LIST`` for one without
    a list of works, ``WRONG_VALUES`` for one in which some values have another type than the schema (its works
    are there, with nulls in their place) and ``EMPTY`` for an empty list. Such a row holds the text of the page, so every
    page that was read leaves a row. A null within a list is a work without an id.
    """
    broken, listed = F.col(BROKEN).isNotNull(), F.col("results").isNotNull()
    reason = (
        F.when(broken & listed, WRONG_VALUES).when(broken, MALFORMED).when(~listed, NO_LIST)
        .when(F.size("results") == 0, EMPTY)
    )
    no_text = F.lit(None).cast("string")
    works = F.transform("results", lambda w: F.struct(w.alias("w"), no_text.alias("problem"), no_text.alias("page")))
    page = F.struct(F.lit(None).cast(work_schema()).alias("w"), reason.alias("problem"), F.col(BROKEN).alias("page"))
    rows = F.concat(F.coalesce(works, F.array().cast(works_type())), F.when(reason.isNotNull(), F.array(page)).otherwise(F.array().cast(works_type())))
    return pages.select("source_file", F.inline(rows)).select("w", "source_file", "problem", "page")


def works_type() -> T.ArrayType:
    return T.ArrayType(T.StructType([
        T.StructField("w", work_schema()), T.StructField("problem", T.StringType()), T.StructField("page", T.StringType()),
    ]))


def read_work_pages(
    spark: SparkSession, path: str | list[str], one_page_per_file: bool = True, strict: bool = False
) -> DataFrame:
    """One row per work (``w``) and page file, and a row for every page that is broken or empty; see ``land_pages``.

    The schema is given, so no pass over the files is spent on inferring it. A gzip file is one task; land the
    result once as a table, and take ``works_of`` and ``quarantine`` from that. ``strict`` raises at the first page
    that isn't JSON of this schema instead.
    """
    pages = spark.read.schema(page_schema()).options(**page_options(one_page_per_file, strict)).json(path)
    return land_pages(pages.select("results", BROKEN, F.col("_metadata.file_path").alias("source_file")))


def works_of(landed: DataFrame) -> DataFrame:
    """The works of a landed table."""
    return landed.filter(F.col("problem").isNull()).select("w", "source_file")


def quarantine(landed: DataFrame, path: str | list[str] | None = None) -> DataFrame:
    """(source_file, problem, page): the broken pages of a landed table, with their text.

    With the ``path`` that was read, also the files (``UNREADABLE_FILE``) that are empty or whose bytes could not be
    decompressed: of these the landed table has nothing. Only the names of the files are listed for that.
    """
    broken = landed.filter(F.col("problem") != EMPTY).select("source_file", "problem", "page")
    if path is None:
        return broken
    spark = landed.sparkSession
    names = spark.read.format("binaryFile").load(path).inputFiles()  # the driver's own listing
    listed = spark.createDataFrame([(n,) for n in names], "source_file string").withColumn("_name", _plain("source_file"))
    missing = listed.join(landed.select(_plain("source_file").alias("_name")).distinct(), "_name", "left_anti")
    return broken.unionByName(missing.select("source_file", F.lit(UNREADABLE_FILE).alias("problem"), F.lit(None).cast("string").alias("page")))


def _plain(path: str) -> Column:
    """A file's address with one slash after the scheme: listings and scans differ there."""
    return F.regexp_replace(path, "^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/")


def write_work_pages(pages: DataFrame, path: str) -> None:
    """Write frames with a ``results`` column as gzip JSON, one page per line."""
    pages.select("results").write.option("compression", "gzip").json(path)
