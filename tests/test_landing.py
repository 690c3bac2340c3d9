"""Quarantine of broken input, atomic replace, keyed merges, snapshots and a build from a dirty folder."""

from __future__ import annotations

import datetime as dt
import gzip
import json

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from auditloom.plans import build, profiling, quality, staging
from auditloom.sources import records_csv, snapshots, tables, works_json
from auditloom.streaming import incremental
from tests.test_sources import HEADER, NOW, line, record_lines, works, write_csv, write_pages

FAILS = (PySparkException, Py4JJavaError)


def raw_page(folder, n, data):
    path = folder / f"page-{n:04d}.json.gz"
    path.write_bytes(data if isinstance(data, bytes) else gzip.compress(data.encode()))


def broken_pages(folder):
    whole = {"meta": {"count": 2}, "results": [{"id": "https://example.org/W3"}, {"id": "https://example.org/W4"}]}
    write_pages(folder, works())
    raw_page(folder, 1, json.dumps(whole)[:-20])
    raw_page(folder, 2, json.dumps({"results": [{"id": "https://example.org/W5"}]}))
    raw_page(folder, 3, json.dumps({"results": []}))
    raw_page(folder, 4, json.dumps({"error": "too many"}))
    raw_page(folder, 5, json.dumps({"results": [{"id": "https://example.org/W6", "publication_year": "soon"}, {"id": "https://example.org/W7"}]}))
    raw_page(folder, 6, gzip.compress(json.dumps(whole).encode() * 50)[:40])
    raw_page(folder, 7, b"no gzip")
    raw_page(folder, 8, b"")
    return f"{folder}/page-*.json.gz"


def test_broken_pages_are_named_and_the_others_read(spark, tmp_path):
    path = broken_pages(tmp_path)
    landed = works_json.read_work_pages(spark, path)
    landed.write.parquet(str(tmp_path / "landed"))
    landed = spark.read.parquet(str(tmp_path / "landed"))
    ids = {r["work_id"] for r in staging.stage_works(works_json.works_of(landed), NOW).collect()}
    assert ids == {"W1", "W2", "W5", "W6", "W7"}
    found = {r["source_file"][-12:-8]: (r["problem"], r["page"]) for r in works_json.quarantine(landed, path).collect()}
    assert {k: v[0] for k, v in found.items()} == {
        "0001": works_json.MALFORMED, "0004": works_json.NO_LIST, "0005": works_json.WRONG_VALUES,
        "0006": works_json.UNREADABLE_FILE, "0007": works_json.UNREADABLE_FILE, "0008": works_json.UNREADABLE_FILE,
    }
    assert "W3" in found["0001"][1] and "soon" in found["0005"][1]
    assert works_json.quarantine(landed).count() == 3
    lines = spark.createDataFrame([("f", None), ("f", "x")], "source_file string, problem string")
    audit = staging.quarantine_audit(lines, landed, works_json.quarantine(landed, path), NOW).collect()
    assert {r["dataset"]: (r["rows_read"], r["rows_kept"], r["rows_dropped"]) for r in audit} == {
        "record_lines": (2, 1, 1), "work_pages": (9, 4, 5),
    }


def test_strict_reading_raises(spark, tmp_path):
    write_pages(tmp_path, works())
    raw_page(tmp_path, 1, '{"results": [{"id": "W3"}, {"i')
    path = f"{tmp_path}/page-*.json.gz"
    assert works_json.works_of(works_json.read_work_pages(spark, path)).count() == 3
    with pytest.raises(FAILS):
        works_json.read_work_pages(spark, path, strict=True).collect()
    csv = write_csv(tmp_path, [*record_lines(), "9,only two"])
    assert records_csv.read_records_csv(spark, csv).count() == 4
    with pytest.raises(FAILS):
        records_csv.land_records(spark, csv, strict=True).collect()


def test_a_damaged_file_of_many_pages_raises(spark, tmp_path):
    pages = "\n".join(json.dumps({"results": [{"id": f"W{i}"}]}) for i in range(3000))
    raw_page(tmp_path, 0, gzip.compress(pages.encode())[:-400])
    with pytest.raises(FAILS):
        works_json.read_work_pages(spark, f"{tmp_path}/page-*.json.gz", one_page_per_file=False).collect()


def test_lines_of_another_shape(spark, tmp_path):
    extra = line(RecordID="8", Title="more") + "x,y,z"
    short = '9,"title, and no more"'
    bare = line(RecordID="10", Title="no last cell", Notes="a\nb")[:-1]
    landed = records_csv.land_records(spark, write_csv(tmp_path, [*record_lines(), extra, short, bare]))
    assert sorted(r["line"] for r in records_csv.broken_records(landed).collect()) == sorted([extra, short])
    kept = records_csv.records_of(landed)
    assert kept.columns == [*records_csv.RECORD_COLUMNS, "source_file"] and kept.count() == 5
    assert kept.filter("`Record ID` = '10'").first()["Notes"] == "a\nb"
    assert records_csv.unmapped_report(landed).count() == 0
    assert [tuple(r) for r in records_csv.unmapped_report(landed.withColumn("Extra", F.col("Title"))).collect()] == [("Extra", 2)]


def test_newest_files_only_are_opened(spark, tmp_path):
    for stamp, rows in (("20250101", 1), ("20251231", 3), ("20250601", 2)):
        (tmp_path / f"records_{stamp}.csv").write_text("Record ID\n" + "1\n" * rows)
    (tmp_path / "records_20250701.csv").write_bytes(b"\xff\xfe broken")
    chosen = snapshots.newest_files(spark, str(tmp_path))
    assert [c[-12:] for c in chosen] == ["20251231.csv"]
    read = records_csv.read_records_csv(spark, chosen)
    assert read.count() == 3 and {f[-12:] for f in read.inputFiles()} == {"20251231.csv"}
    assert snapshots.newest_files(spark, str(tmp_path), "20250601")[0].endswith("records_20250601.csv")
    with pytest.raises(snapshots.MissingSnapshot):
        snapshots.newest_files(spark, str(tmp_path), "20240101")
    (tmp_path / "records.csv").write_text("Record ID\n1\n")
    assert snapshots.newest_files(spark, str(tmp_path))[0].endswith("records.csv")


# tables


def test_a_failed_replace_leaves_the_table_and_its_readers(spark, tmp_path):
    root = str(tmp_path)
    opened = tables.publish(spark.range(5), root, "marts", "t")
    bad = spark.range(5).select(F.when(F.col("id") > 2, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(FAILS):
        tables.publish(bad, root, "marts", "t")
    assert tables.load(spark, root, "marts", "t").count() == 5 and tables.last_version(spark, root, "marts", "t") == 1
    tables.publish(spark.range(7), root, "marts", "t")
    tables.publish(tables.load(spark, root, "marts", "t").filter("id > 0"), root, "marts", "t")  # from itself
    assert (opened.count(), tables.load(spark, root, "marts", "t").count()) == (5, 6)
    assert tables.load(spark, root, "marts", "t", version=2).count() == 7
    assert tables.vacuum(spark, root, "marts", "t", keep=1) == 2
    assert tables.load(spark, root, "marts", "t").count() == 6
    with pytest.raises(tables.NoSuchTable):
        tables.load(spark, root, "marts", "absent")
    with pytest.raises(ValueError):
        tables.publish(spark.range(1), root, "marts", "t", mode="ignore")


def test_comments_and_measures_come_with_the_write(spark, tmp_path):
    measured = {}
    df = spark.createDataFrame([(1, None), (2, "x")], "a long, b string")
    out = tables.publish(
        df, str(tmp_path), "marts", "t", comments={"a": "first", "zz": "not there"},
        measures={"n": F.count(F.lit(1)), "no b": F.count_if(F.col("b").isNull())}, measured=measured,
    )
    assert measured == {"n": 2, "no b": 1}
    assert tables.comments_of(out) == {"a": "first"} and out.columns == ["a", "b"]
    again = tables.publish(out.withColumn("c", F.lit(1)), str(tmp_path), "marts", "t")
    assert tables.comments_of(again) == {"a": "first"}
    rows = {(r["column_name"], r["description"]) for r in profiling.stored_descriptions({"t": again}).collect()}
    assert rows == {("a", "first"), ("b", None), ("c", None)}
    assert [tuple(r) for r in profiling.stored_coverage({"t": again}).collect()] == [("t", 3, 1, 33.3)]


# merges


def merged(spark, target):
    return {r["k"]: (r["v"], r["x"]) for r in incremental.read_merged(spark, target).collect() if r["k"] is not None}


def test_newest_version_wins_and_batches_are_merged_once(spark, tmp_path, monkeypatch):
    target, source, checkpoint = str(tmp_path / "t"), str(tmp_path / "in"), str(tmp_path / "cp")
    kinds = "k long, v int, x string"

    def run(*rows):
        spark.createDataFrame(list(rows), kinds).write.mode("append").parquet(source)
        incremental.merge_new_files(incremental.stream_files(spark, source, spark.createDataFrame([], kinds).schema), target, checkpoint, "k", "v", 4)

    with pytest.raises(LookupError):
        incremental.read_merged(spark, target)
    run(*[(i, 1, "a") for i in range(20)], (None, 1, "n"), (3, 0, "older"))
    before = incremental.read_merged(spark, target)
    assert merged(spark, target) == {i: (1, "a") for i in range(20)}

    def ends(*_):
        raise RuntimeError("between data and log")

    with monkeypatch.context() as patched:
        patched.setattr(incremental, "_commit", ends)
        with pytest.raises(PySparkException):
            run((3, 2, "b"), (5, 0, "stale"), (40, 1, "new"))
    assert merged(spark, target) == {i: (1, "a") for i in range(20)}
    run((None, 1, "n"))
    want = {i: (1, "a") for i in range(20)} | {3: (2, "b"), 40: (1, "new")}
    assert merged(spark, target) == want
    assert incremental.read_merged(spark, target).filter("k is null").count() == 2
    assert before.count() == 21  # opened earlier, still whole
    again = spark.createDataFrame([(3, 9, "again")], kinds)
    last = max(r["batch"] for r in incremental._merges(spark, target))
    assert not incremental.merge_batch(again, target, checkpoint, last, "k", "v")
    assert incremental.merge_batch(again, target, "another source", 0, "k", "v")
    assert merged(spark, target) == want | {3: (9, "again")}


def test_only_touched_parts_are_written_again(spark, tmp_path):
    target, kinds = str(tmp_path / "t"), "k long, v int"
    incremental.merge_batch(spark.createDataFrame([(i, 1) for i in range(100)], kinds), target, "s", 0, "k", "v", 16)
    first = incremental._merges(spark, target)[0]["folders"]
    incremental.merge_batch(spark.createDataFrame([(7, 2)], kinds), target, "s", 1, "k", "v", 99)
    last = incremental._merges(spark, target)[0]
    assert last["parts"] == 16 and sum(first[p] != last["folders"][p] for p in first) == 1
    rows = incremental.read_merged(spark, target)
    assert rows.count() == 100 and rows.filter("v = 2").count() == 1
    incremental.merge_batch(spark.createDataFrame([], kinds), target, "s", 2, "k", "v")
    assert incremental.read_merged(spark, target).count() == 100


def test_equal_versions_take_the_later_row(spark):
    rows = spark.createDataFrame([(1, 1, "old", False), (1, 1, "new", True), (2, None, "x", False), (2, 0, "y", False)], "k long, v int, x string, p boolean")
    assert {(r["k"], r["x"]) for r in incremental.newest_per_key(rows, "k", "v", "p").collect()} == {(1, "new"), (2, "y")}


# the whole build


def test_build_of_a_dirty_folder(spark, tmp_path):
    pages, records = tmp_path / "pages", tmp_path / "csv"
    pages.mkdir()
    records.mkdir()
    path = broken_pages(pages)
    (records / "records_20240101.csv").write_text("\n".join([HEADER, line(RecordID="99", Title="old")]) + "\n")
    (records / "records_20250101.csv").write_text("\n".join([HEADER, *record_lines(), "3,x"]) + "\n")
    root = str(tmp_path / "wh")
    built = build.build_warehouse(spark, str(records), path, root, NOW)
    assert built["records"].count() == 3 and built["records"].filter("record_id = 99").count() == 0
    assert built["quarantined_pages"].count() == 6 and built["quarantined_lines"].count() == 1
    audit = {r["dataset"]: (r["rows_read"], r["rows_kept"], r["rows_dropped"]) for r in built["load_audit"].collect()}
    assert audit == {"records": (4, 3, 1), "works": (6, 5, 1), "record_lines": (5, 4, 1), "work_pages": (9, 4, 5)}
    assert tables.comments_of(built["records"])["record_id"]
    # Checks counted while the tables were written say the same as a scan.
    today = NOW.date()
    seen = {r["check_name"]: (r["violations"], r["status"]) for r in build.check_warehouse(built, today).collect()}
    scanned = {r["check_name"]: (r["violations"], r["status"]) for r in quality.run_checks(dict(built), quality.standard_checks(today)).collect()}
    assert seen == scanned and len(seen) == 38
    assert built.observed["records"]["record key not null"] == 1 and "record key unique" not in built.observed["records"]
    later = {r["check_name"]: r["violations"] for r in build.check_warehouse(built, today + dt.timedelta(days=5000)).collect()}
    assert later["records fresh"] == 1
    # A second build that fails leaves the tables of the first.
    with pytest.raises(FAILS):
        build.build_warehouse(spark, str(records), path, root, NOW, strict=True)
    assert tables.load(spark, root, "staging", "records").count() == 3
    assert built["records"].count() == 3


def exchanges_on(df, key):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if "Exchange" in x and key in x]


def test_records_are_joined_to_their_children_without_an_exchange(spark, tmp_path):
    from auditloom.plans import enriched

    path = write_pages(tmp_path, works())
    root = str(tmp_path / "wh")
    build.build_warehouse(spark, write_csv(tmp_path, record_lines()), path, root, NOW)
    names = ("records", "record_reasons", "record_countries", "record_authors", "record_institutions", "record_subjects")
    saved = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        read = [tables.load(spark, root, "staging", n) for n in names]
        joined = enriched.enrich_records(*read)
        assert exchanges_on(joined, "record_id") == [] and joined.count() == 3
        plain = enriched.enrich_records(*[spark.createDataFrame(t.collect(), t.schema) for t in read])
        assert len(exchanges_on(plain, "record_id")) == 6
        assert sorted(map(str, joined.collect())) == sorted(map(str, plain.collect()))
        # A session that has not written the tables finds the layout in the log.
        for name in spark.catalog.listTables():
            if name.name.startswith("auditloom_"):
                spark.sql(f"DROP TABLE {name.name}")
        again = enriched.enrich_records(*[tables.load(spark, root, "staging", n) for n in names])
        assert exchanges_on(again, "record_id") == [] and again.count() == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", saved)


def test_distinct_counts_multiply_no_rows(spark):
    from auditloom.operators import aggregates
    from auditloom.plans import enriched

    df = spark.createDataFrame(
        [("a", 1, 5), ("a", 1, None), ("a", -70000, 7), ("b", None, None), (None, 32768, 5), (None, 32769, 5)], "k string, x long, y int"
    )
    counted = aggregates.distinct_counts(df, ["k"], {"n_x": F.col("x"), "n_y": F.col("y")})
    assert {r["k"]: (r["n_x"], r["n_y"]) for r in counted.collect()} == {"a": (2, 2), "b": (0, 0), None: (2, 1)}
    assert "Expand" not in counted._jdf.queryExecution().executedPlan().toString()
    facts = "record_id long, journal string, subject_code string, retraction_year int, original_paper_year int, first_country string, " \
            "n_authors long, is_paper_mill boolean, is_peer_review_fraud boolean, is_ai_generated boolean, retraction_latency_days int"
    records = spark.createDataFrame([(1, "j", "s", 2000, 1999, None, 2, True, False, False, 10), (2, "k", "s", 2001, None, "c", 1, False, False, True, None)], facts)
    people = spark.createDataFrame([(1, 1, "A"), (1, 2, "A"), (2, 1, "A"), (9, 1, "B")], "record_id long, author_position int, author_name string")
    activity = enriched.author_activity(people, records)
    plan = activity._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and sum("Join" in x for x in plan.splitlines()) == 1
    (row,) = activity.collect()
    assert (row["n_retractions"], row["n_journals"], row["n_countries"], row["n_paper_mill"], row["n_first_author"], row["n_last_author"]) == (2, 2, 1, 2, 2, 2)
    assert row["median_latency_days"] == 10.0
