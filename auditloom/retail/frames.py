"""Record- and work-shaped frames over the retail tables.

Every value is computed row by row from a table column, so the frames grow with the tables and
nothing is gathered to build them.

| role | table |
|---|---|
| record | order; journal = customer, publisher = priority |
| reason, institution, subject, country of a record | line of the order (with part, supplier) |
| author list of a record | text built from the order |
| work | part; nested like a work of the JSON pages |
| citations of a work in a year | lines that ship the part in that year |
"""

from __future__ import annotations

import contextlib
import datetime as dt
import functools
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from auditloom.functions import year_of
from auditloom.operators.generators import explode_positions
from auditloom.operators.persisting import write_scratch
from auditloom.plans import enriched as models
from auditloom.operators.pairs import count_pairs_by_edges
from auditloom.plans import events, marts, network, quality, staging
from auditloom.sources.works_json import work_schema

LOADED_AT = dt.datetime(2026, 1, 1)
AS_OF = dt.date(2002, 1, 1)
FOCUS = "NATION_3"
LAST_FULL_YEAR = 2001


@functools.lru_cache(maxsize=256)
def _schema(spark: SparkSession, path: str) -> StructType:
    return spark.read.parquet(path).schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Table scan; the schema of a file is looked up once per session, not once per mention."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.read.schema(_schema(spark, path)).parquet(path)


_WRITTEN: dict[tuple, tuple[str, StructType, dict[str, int]]] = {}


def checks() -> tuple[quality.Check, ...]:
    return quality.standard_checks(AS_OF)


def _version(spark: SparkSession, sf_dir: str) -> tuple:
    """Paths, sizes and times of the files of the retail tables, without their content."""
    files = spark.read.format("binaryFile").load(f"{sf_dir}/*").select("path", "length", "modificationTime")
    return tuple(sorted(tuple(r) for r in files.collect()))  # a row per file, which the driver lists anyway


_HELD: dict[str, tuple | None] = {}


@contextlib.contextmanager
def one_version(spark: SparkSession, sf_dir: str) -> Iterator[Callable[[], tuple]]:
    """The version of the retail tables, looked up once, if at all, for all that happens inside."""
    outer = sf_dir not in _HELD
    if outer:
        _HELD[sf_dir] = None

    def version() -> tuple:
        if _HELD[sf_dir] is None:
            _HELD[sf_dir] = _version(spark, sf_dir)
        return _HELD[sf_dir]

    try:
        yield version
    finally:
        if outer:
            del _HELD[sf_dir]


def stored(
    spark: SparkSession, sf_dir: str, name: str, build: Callable[[SparkSession, str], DataFrame]
) -> DataFrame:
    """A warehouse table: written by its first reader in a session, read by all others.

    It is rebuilt when a file of the retail tables changes. The checks that look at one row at a time are counted while
    it is written (``observed``).
    """
    with one_version(spark, sf_dir) as version:
        key = (spark.sparkContext.applicationId, sf_dir, version(), name)
        if key not in _WRITTEN:
            df, measures, counts = build(spark, sf_dir), quality.written_measures(checks(), name), {}
            if measures:
                seen = Observation(f"{name}-{uuid.uuid4().hex}")
                path = write_scratch(df.observe(seen, *[m.alias(check) for check, m in measures.items()]), name)
                counts = seen.get
            else:
                path = write_scratch(df, name)
            _WRITTEN[key] = (path, df.schema, counts)
        path, schema, _ = _WRITTEN[key]
    return spark.read.schema(schema).parquet(path)


def is_stored(spark: SparkSession, sf_dir: str, name: str) -> bool:
    with one_version(spark, sf_dir) as version:
        return (spark.sparkContext.applicationId, sf_dir, version(), name) in _WRITTEN


def observed(spark: SparkSession, sf_dir: str) -> dict[str, dict[str, int]]:
    """Counts of checks that were taken while the tables of this session were written, by table and check."""
    with one_version(spark, sf_dir) as version:
        own = (spark.sparkContext.applicationId, sf_dir, version())
    return {key[3]: counts for key, (_, _, counts) in _WRITTEN.items() if key[:3] == own and counts}


AUTHORS_OF_ORDER = """
    array_join(transform(
        slice(array(1, 2, 3, 4), 1, cast(o_orderkey % 5 as int)),
        i -> concat('A', o_custkey * 100 + i * (o_orderkey % 7))), '; ')
"""
NATURE_OF_ORDER = """
    CASE WHEN o_orderstatus = 'F' THEN 'Retraction' WHEN o_orderstatus = 'O' THEN 'Expression of concern'
         WHEN o_orderpriority = '5-LOW' THEN 'Reinstatement' ELSE 'Correction' END
"""
PUBLISHED = "date_sub(cast(o_orderdate as date), cast((o_custkey * 37 + o_orderkey * 11) % 1500 - 20 as int))"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed record table."""
    base = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS record_id",
        "concat('Order ', o_orderkey) AS title",
        "CASE WHEN o_custkey % 211 <> 0 THEN concat('J', o_custkey) END AS journal",
        "o_orderpriority AS publisher",
        f"{NATURE_OF_ORDER} AS retraction_nature",
        "CASE WHEN o_totalprice > 250000 THEN 'Yes' ELSE 'No' END AS paywalled",
        f"CASE WHEN o_orderkey % 41 <> 0 THEN {PUBLISHED} END AS original_paper_date",
        "CASE WHEN o_orderkey % 97 <> 0 THEN cast(o_orderdate as date) END AS retraction_date",
        "concat('10.1000/r', o_orderkey) AS retraction_doi",
        "CASE WHEN o_orderkey % 7 <> 3 THEN concat('10.1000/p', o_custkey) END AS original_paper_doi",
        "cast(o_custkey as string) AS original_paper_pubmed_id",
        f"{AUTHORS_OF_ORDER} AS author_raw",
        "'orders' AS source_file",
    )
    return base.select(
        "*",
        year_of("original_paper_date").alias("original_paper_year"),
        year_of("retraction_date").alias("retraction_year"),
        F.lit(LOADED_AT).cast("timestamp").alias("loaded_at"),
    )


def reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = """
        CASE WHEN l_returnflag = 'R' AND l_quantity >= 50 THEN 'Paper Mill'
             WHEN l_returnflag = 'R' AND l_quantity >= 47 THEN 'Compromised Peer Review'
             WHEN l_returnflag = 'A' AND l_quantity >= 49 THEN 'Concerns/Issues about Peer Review'
             WHEN l_returnflag = 'N' AND l_quantity >= 48 THEN 'Computer-Aided Content or Computer-Generated Content'
             WHEN l_returnflag = 'A' AND l_quantity <= 2 THEN 'Rogue Editor'
             WHEN l_returnflag = 'N' AND l_quantity <= 3 THEN 'Duplication of/in Image'
             WHEN l_returnflag = 'R' AND l_quantity <= 3 THEN 'Investigation by Third Party'
             WHEN l_linestatus = 'O' AND l_quantity <= 8 THEN 'Author Unresponsive'
             ELSE concat('Concerns ', l_returnflag, l_linestatus) END
    """
    return table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS record_id", f"{reason} AS reason")


def countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    return (
        lines.join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(F.col("l_orderkey").alias("record_id"), F.col("n_name").alias("country"))
    )


def institutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS record_id", "concat('Supplier ', l_suppkey) AS institution"
    )


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).selectExpr(
        "l_orderkey AS record_id", "concat('(', p_brand, ') ', p_type) AS subject"
    )


def authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_positions(
        records(spark, sf_dir), "record_id", "author_raw", "author_position", "author_name"
    )


def build_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.enrich_records(
        records(spark, sf_dir), reasons(spark, sf_dir), countries(spark, sf_dir), authors(spark, sf_dir),
        institutions(spark, sf_dir), subjects(spark, sf_dir), FOCUS,
    )


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "records_enriched", build_enriched)


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "journal_profile", lambda s, d: models.journal_profile(enriched(s, d)))


def risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "journal_risk", lambda s, d: marts.journal_risk(profile(s, d)))


def trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "retraction_trends", lambda s, d: marts.retraction_trends(enriched(s, d)))


def country_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(
        spark, sf_dir, "country_leaderboard", lambda s, d: marts.country_leaderboard(countries(s, d), enriched(s, d))
    )


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same orders as untyped text in the layout of the record CSV, with its usual dirt."""
    def spelled(day: str) -> str:
        return f"""
            concat(date_format({day}, 'M/d/yyyy'),
                   CASE WHEN o_orderkey % 8 <= 2 THEN ' 0:00' WHEN o_orderkey % 8 <= 4 THEN ' 12:00:00 AM' ELSE '' END)
        """
    return table(spark, sf_dir, "orders").selectExpr(
        """CASE WHEN o_orderkey % 1009 = 7 THEN '' WHEN o_orderkey % 1013 = 5 THEN concat('x', o_orderkey)
                ELSE cast(o_orderkey as string) END AS `Record ID`""",
        "CASE WHEN o_orderkey % 17 = 0 THEN 'Unavailable' ELSE concat('  Order ', o_orderkey, ' ') END AS Title",
        """concat('(', o_orderstatus, ') Status;  (', substr(o_orderpriority, 1, 1), ') ',
                  substr(o_orderpriority, 3), ';') AS Subject""",
        "concat('Customer ', o_custkey, '; ; Desk ', o_custkey % 10) AS Institution",
        "CASE WHEN o_custkey % 211 = 0 THEN 'N/A' ELSE concat('J', o_custkey) END AS Journal",
        "o_orderpriority AS Publisher",
        """concat('NATION_', o_custkey % 25, CASE WHEN o_orderkey % 3 = 0
                  THEN concat(';NATION_', o_orderkey % 25) ELSE '' END, ';') AS Country""",
        f"{AUTHORS_OF_ORDER} AS Author",
        "cast(NULL as string) AS URLS",
        "'Research Article;' AS ArticleType",
        f"""CASE WHEN o_orderkey % 8 = 7 THEN 'some day' ELSE {spelled('o_orderdate')} END AS RetractionDate""",
        "concat('https://doi.org/10.1000/R', o_orderkey) AS RetractionDOI",
        "cast(o_orderkey % 5 as string) AS RetractionPubMedID",
        f"{spelled(PUBLISHED)} AS OriginalPaperDate",
        """concat(CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'HTTPS://DOI.ORG/' ELSE 'http://dx.doi.org/' END,
                  '10.1000/P', o_custkey) AS OriginalPaperDOI""",
        "concat(' ', o_custkey, ' ') AS OriginalPaperPubMedID",
        f"{NATURE_OF_ORDER} AS RetractionNature",
        """CASE WHEN o_orderkey % 23 = 0 THEN 'Paper Mill; Rogue Editor;'
                WHEN o_orderkey % 19 = 0 THEN 'Compromised Peer Review;Duplication of/in Image'
                WHEN o_orderkey % 29 = 0 THEN NULL
                ELSE concat('Error in Data; Concerns ', o_orderstatus, ';') END AS Reason""",
        "CASE WHEN o_totalprice > 250000 THEN 'Yes' ELSE 'No' END AS Paywalled",
        "CASE WHEN o_orderkey % 13 = 0 THEN 'first line\\nsaid \"no\", then; end' END AS Notes",
        "'orders' AS source_file",
    )


def _spread(df: DataFrame) -> DataFrame:
    """The rows of a narrow table dealt over all cores, before each of them becomes much wider.

    Splits are cut by bytes, so a table of few bytes a row is one split for millions of rows.
    """
    spark = df.sparkSession
    return df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def landed_works(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """Parts as nested works, in the schema of the JSON pages; ``keep`` are columns of the part to go with them."""
    topic = """
        named_struct('id', concat('https://example.org/T', {n} % 10), 'display_name', concat('Topic ', {n} % 10),
            'score', p_size / 100.0D, 'domain', named_struct('display_name', p_type),
            'field', named_struct('display_name', p_brand),
            'subfield', named_struct('display_name', concat('Sub ', {n} % 5)))
    """
    institution = """
        named_struct('id', concat('https://example.org/I', p_partkey % 40 + j), 'display_name', concat('Inst ', j),
            'country_code', concat('C', j), 'type', p_type, 'ror', concat('https://ror.org/', p_partkey % 40 + j))
    """
    author = f"""
        named_struct('author_position', CASE WHEN i = 1 THEN 'first' ELSE 'middle' END,
            'author', named_struct(
                'id', CASE WHEN p_partkey % 5 = 0 AND i = 3 THEN NULL
                           ELSE concat('https://example.org/A', p_partkey % 300 + i) END,
                'display_name', concat('Author ', p_partkey % 300 + i),
                'orcid', CASE WHEN i = 2 THEN concat('https://orcid.org/0000-', p_partkey % 300 + i) END),
            'raw_author_name', concat('A. ', p_partkey % 300 + i), 'is_corresponding', i = 1,
            'countries', slice(array('C1', 'C2'), 1, i - 1),
            'institutions', transform(slice(array(1, 2), 1, i - 1), j -> {institution}))
    """
    flat = _spread(table(spark, sf_dir, "part")).selectExpr(
        "CASE WHEN p_partkey % 53 <> 0 THEN concat('https://example.org/W', p_partkey) END AS id",
        "CASE WHEN p_partkey % 29 <> 0 THEN concat('https://doi.org/10.1000/P', p_partkey) END AS doi",
        "p_name AS title",
        "cast(1988 + p_size % 8 as bigint) AS publication_year",
        """CASE WHEN p_partkey % 31 = 0 THEN 'unknown'
                ELSE concat(1988 + p_size % 8, '-', lpad(1 + p_size % 12, 2, '0'), '-15') END AS publication_date""",
        "p_type AS type",
        "CASE WHEN p_size % 4 = 0 THEN 'de' ELSE 'en' END AS language",
        "p_size % 2 = 0 AS is_retracted",
        "p_partkey * 7 % 50 AS cited_by_count",
        "p_partkey % 30 AS referenced_works_count",
        "p_retailprice / 1000.0D AS fwci",
        "p_partkey % 3 AS countries_distinct_count",
        "p_partkey % 4 AS institutions_distinct_count",
        """named_struct('is_oa', p_size % 3 = 0, 'oa_status', CASE WHEN p_size % 3 = 0 THEN 'gold' ELSE 'closed' END,
                        'oa_url', cast(NULL as string)) AS open_access""",
        f"CASE WHEN p_partkey % 37 <> 0 THEN {topic.format(n='p_size')} END AS primary_topic",
        f"slice(array({topic.format(n='p_size')}, {topic.format(n='(p_size + 3)')}), 1, cast(p_partkey % 3 as int)) AS topics",
        """named_struct('volume', cast(p_size as string), 'issue', cast(NULL as string), 'first_page', '1',
                        'last_page', cast(p_size + 1 as string)) AS biblio""",
        """transform(slice(array(0, 1, 2), 1, cast(p_partkey % 4 as int)),
                     i -> named_struct('year', cast(1987 + p_size % 8 + 2 * i as bigint),
                                       'cited_by_count', (p_partkey + i) % 9)) AS counts_by_year""",
        f"transform(slice(array(1, 2, 3), 1, cast(p_partkey % 4 as int)), i -> {author}) AS authorships",
        *keep,
    )
    schema = work_schema()
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields]
    return flat.select(F.struct(*typed).alias("w"), F.lit("part").alias("source_file"), *keep)


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staging.stage_works(landed_works(spark, sf_dir), LOADED_AT)


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines shipped per part and year."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_partkey", F.year("l_shipdate").alias("citation_year")).agg(F.count(F.lit(1)).alias("cited_by_count"))
        .select(F.concat(F.lit("W"), "l_partkey").alias("work_id"), "citation_year", "cited_by_count")
    )


def build_works_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.enrich_works(works(spark, sf_dir), enriched(spark, sf_dir), AS_OF.year)


def works_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "works_enriched", build_works_enriched)


def build_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.event_panel(works_enriched(spark, sf_dir), citations(spark, sf_dir), last_full_year=LAST_FULL_YEAR)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "event_panel", build_panel)


def study(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "event_study", lambda s, d: events.event_study(panel(s, d)))


def authorships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors of orders as authors of works; names are spelled in more than one way."""
    return authors(spark, sf_dir).select(
        F.col("record_id").alias("work_id"),
        F.col("author_name").alias("author_id"),
        F.concat("author_name", F.lit(" v"), F.col("record_id") % 3).alias("author_name"),
        F.when(F.col("record_id") % 2 == 0, F.concat(F.lit("0000-"), "author_name")).alias("orcid"),
    )


def works_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the edges need to know about an order; read from the enriched records where these are written already."""
    if is_stored(spark, sf_dir, "records_enriched"):
        return _works_of(enriched(spark, sf_dir))
    flags = models.reason_flags(reasons(spark, sf_dir)).select("record_id", "is_paper_mill")
    places = models.country_features(countries(spark, sf_dir), FOCUS).select("record_id", "first_country")
    return _works_of(
        records(spark, sf_dir).select("record_id", "journal", "publisher", "retraction_year")
        .join(flags, "record_id", "left").join(places, "record_id", "left")
    )


def _works_of(records: DataFrame) -> DataFrame:
    return records.select(
        F.col("record_id").alias("work_id"),
        F.coalesce("is_paper_mill", F.lit(False)).alias("is_paper_mill"),
        F.col("journal").alias("record_journal"), F.col("publisher").alias("field"),
        F.col("first_country").alias("record_first_country"),
        F.col("retraction_year").alias("publication_year"),
    )


def build_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.coauthor_edges(authorships(spark, sf_dir), works_of_orders(spark, sf_dir))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "coauthor_edges", build_edges)


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "author_cluster_membership", lambda s, d: network.component_membership(edges(s, d)))


def cluster_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(
        spark, sf_dir, "author_cluster_profile", lambda s, d: network.cluster_profile(edges(s, d), membership(s, d))
    )


def cluster_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "author_clusters", lambda s, d: network.cluster_scores(cluster_profile(s, d)))


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(
        spark, sf_dir, "records", lambda s, d: staging.stage_records(raw_records(s, d), LOADED_AT)
    )


def staged_works(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "works", works)


def work_authorships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "work_authorships", lambda s, d: staging.work_authorships(landed_works(s, d)))


def work_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "work_citations", lambda s, d: staging.work_citations(landed_works(s, d)))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(
        spark, sf_dir, "feature_discriminative_power", lambda s, d: marts.feature_discriminative_power(risk(s, d))
    )


def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "risk_score_validation", lambda s, d: marts.risk_score_validation(risk(s, d)))


def tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "risk_tier_performance", lambda s, d: marts.risk_tier_performance(risk(s, d)))


def penalty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "penalty_summary", lambda s, d: events.penalty_summary(study(s, d)))


def _build_cluster_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_pairs = count_pairs_by_edges(
        authorships(spark, sf_dir), "work_id", "author_id", edges(spark, sf_dir), "n_shared_works"
    )
    return network.cluster_validation(cluster_scores(spark, sf_dir), n_pairs)


def cluster_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "author_cluster_validation", _build_cluster_validation)
