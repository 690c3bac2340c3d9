from __future__ import annotations

import datetime as dt
import gzip
import json

from pyspark.sql import functions as F

from auditloom.operators.persisting import shared_folder
from auditloom.plans import staging
from auditloom.sources import records_csv, snapshots, tables, works_json
from auditloom.streaming import incremental

NOW = dt.datetime(2026, 1, 1)
HEADER = ",".join(records_csv.RECORD_COLUMNS) + ","


def line(**values):
    cells = [values.get(c.replace(" ", ""), "") for c in records_csv.RECORD_COLUMNS]
    return ",".join('"' + c.replace('"', '""') + '"' for c in cells) + ","


def record_lines():
    return [
        line(RecordID="1", Title=" A ", Country="China;United States;", Author="Li X; ;Wu Y;", Journal="J1",
             Reason="Paper Mill; Rogue Editor;", Subject="(B/T) Computer Science;(PHY) Engineering;",
             RetractionDate="4/20/2021 0:00", OriginalPaperDate="6/24/2018 12:00:00 AM", Institution="I1;I2",
             OriginalPaperDOI="https://doi.org/10.1/W1", RetractionNature="Retraction", RetractionPubMedID="0",
             Notes='two lines\nwith a "quote", done'),
        line(RecordID="2", Journal="n/a", RetractionDate="4/20/2022", OriginalPaperDOI="http://dx.doi.org/10.1/w1",
             RetractionNature="Correction", Reason="Error"),
        line(RecordID="x7", RetractionDate="garbage"),
        line(),
    ]


def write_csv(folder, lines):
    path = folder / "records.csv"
    path.write_text("\n".join([HEADER, *lines]) + "\n", encoding="utf-8")
    return str(path)


def author(n, *institutions):
    return {
        "author_position": "first", "author": {"id": f"https://example.org/A{n}" if n else None, "display_name": f"N{n}"},
        "countries": ["CN"], "institutions": [{"id": f"https://example.org/I{i}", "display_name": i} for i in institutions],
    }


def works():
    topic = {"id": "https://example.org/T1", "display_name": "t", "score": 0.5, "domain": {"display_name": "d"}}
    return [
        {"id": "https://example.org/W1", "doi": "https://doi.org/10.1/W1", "publication_year": 2017, "cited_by_count": 9,
         "primary_topic": topic, "topics": [topic, {**topic, "id": "https://example.org/T2"}],
         "counts_by_year": [{"year": 2016, "cited_by_count": 1}, {"year": 2019, "cited_by_count": 4}],
         "authorships": [author(1, "x", "y"), author(2), author(2, "x"), author(None)]},
        {"id": None, "doi": "10.1/none"},
        {"id": "https://example.org/W2", "doi": None, "authorships": [], "topics": [topic], "primary_topic": None},
    ]


def write_pages(folder, *pages):
    for n, page in enumerate(pages):
        with gzip.open(folder / f"page-{n:04d}.json.gz", "wt", encoding="utf-8") as out:
            json.dump({"meta": {"count": len(page)}, "results": page}, out)
    return f"{folder}/page-*.json.gz"


def test_record_csv(spark, tmp_path):
    raw = records_csv.read_records_csv(spark, write_csv(tmp_path, record_lines()))
    assert raw.columns == [*records_csv.RECORD_COLUMNS, "source_file"]
    assert records_csv.unmapped_columns(raw.withColumn("New", F.lit(1))) == ["New"]
    records = staging.stage_records(raw, NOW)
    rows = {r["title"] or r["record_id"]: r for r in records.collect()}
    assert set(rows) == {"A", 2, None}
    first = rows["A"]
    assert first["notes"] == 'two lines\nwith a "quote", done'
    assert (first["retraction_date"], first["original_paper_year"]) == (dt.date(2021, 4, 20), 2018)
    assert first["original_paper_doi"] == rows[2]["original_paper_doi"] == "10.1/w1"
    assert first["retraction_pubmed_id"] is None and rows[2]["journal"] is None
    assert rows[None]["record_id"] is None and first["source_file"].endswith("records.csv")
    assert [tuple(r) for r in staging.record_authors(records).orderBy("author_position").collect()] == [
        (1, 1, "Li X"), (1, 2, "Wu Y"),
    ]
    assert staging.record_countries(records).count() == 2


def test_work_pages_and_audit(spark, tmp_path):
    landed = works_json.read_work_pages(spark, write_pages(tmp_path, works()[:1], works()[1:]))
    flat = {r["work_id"]: r for r in staging.stage_works(landed, NOW).collect()}
    assert set(flat) == {"W1", "W2"}
    assert (flat["W1"]["doi"], flat["W1"]["n_authors"], flat["W2"]["n_authors"]) == ("10.1/w1", 4, 0)
    assert flat["W1"]["source_file"].endswith("page-0000.json.gz")
    people = staging.work_authorships(landed).orderBy("author_seq").collect()
    assert [(r["author_seq"], r["author_id"], r["n_institutions"]) for r in people] == [
        (1, "A1", 2), (2, "A2", 0), (3, "A2", 1), (4, None, 0),
    ]
    assert staging.work_author_institutions(landed).count() == 3
    years = staging.work_citations(landed).orderBy("citation_year").collect()
    assert [(r["citation_year"], r["years_since_publication"]) for r in years] == [(2016, -1), (2019, 2)]
    topics = {(r["work_id"], r["topic_id"]): r["is_primary"] for r in staging.work_topics(landed).collect()}
    assert topics == {("W1", "T1"): True, ("W1", "T2"): False, ("W2", "T1"): None}
    raw = records_csv.read_records_csv(spark, write_csv(tmp_path, record_lines()))
    audit = {r["dataset"]: (r["rows_read"], r["rows_kept"], r["rows_dropped"]) for r in staging.load_audit(raw, landed, NOW).collect()}
    assert audit == {"records": (4, 3, 1), "works": (3, 2, 1)}


def test_newest_snapshot_wins(spark):
    names = ["a/records_20250101.csv", "a/records_20251231.csv", "a/records_20250601.csv"]
    df = spark.createDataFrame([(n,) for n in names], "source_file string")
    assert snapshots.latest_snapshot(snapshots.with_snapshot_stamp(df), "snapshot").first()[0] == names[1]
    canonical = df.union(spark.createDataFrame([("a/records.csv",)], df.schema))
    assert snapshots.latest_snapshot(snapshots.with_snapshot_stamp(canonical), "snapshot").first()[0] == "a/records.csv"


def test_publish_replaces_and_appends(spark, tmp_path):
    root = str(tmp_path)
    df = spark.range(3)
    tables.publish(df, root, "marts", "t")
    assert tables.publish(df, root, "marts", "t").count() == 3
    assert tables.publish(df, root, "marts", "t", mode="append").count() == 6
    assert tables.load(spark, root, "marts", "t").count() == 6
    tables.export_json(df, f"{root}/report")
    assert spark.read.json(f"{root}/report").count() == 3


def test_incremental_landing_resumes_without_doubling(spark, tmp_path):
    pages, target, checkpoint = tmp_path / "pages", str(tmp_path / "out"), str(tmp_path / "cp")
    pages.mkdir()
    write_pages(pages, works()[:1])
    for expected in (1, 1):
        incremental.land_new_files(incremental.stream_work_pages(spark, str(pages)), target, checkpoint)
        assert spark.read.parquet(target).count() == expected
    write_pages(pages, works()[:1], works()[1:])
    incremental.land_new_files(incremental.stream_work_pages(spark, str(pages)), target, checkpoint)
    assert spark.read.parquet(target).filter("w.id IS NOT NULL").count() == 2


def test_shared_folder_is_the_configured_one(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
