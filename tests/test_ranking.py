from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from auditloom.operators import aggregates, ranking, regression


def auc(spark, rows):
    df = spark.createDataFrame(rows, "label boolean, score double")
    return ranking.rank_sum_auc(df, "score", "label").first()["auc"]


def test_auc_by_hand(spark):
    assert auc(spark, [(True, 2.0), (False, 1.0)]) == 1.0
    assert auc(spark, [(True, 1.0), (False, 2.0)]) == 0.0
    assert auc(spark, [(True, 1.0), (False, 1.0), (False, 1.0)]) == 0.5
    assert auc(spark, [(True, 1.0), (True, 2.0)]) is None
    assert auc(spark, [(True, 2.0), (False, 2.0), (False, 1.0), (True, None)]) == 0.75


def uneven_rows(n=4000):
    rng = random.Random(3)
    for i in range(n):
        value = 7.0 if i % 3 == 0 else (None if i % 50 == 1 else float(rng.randrange(3000)))
        yield (i, "ab"[i % 2], value)


@pytest.mark.parametrize("partitions", [None, 1, 13])
def test_running_totals_do_not_depend_on_partitions(spark, partitions):
    df = spark.createDataFrame([(g, v) for _, g, v in uneven_rows() if v is not None], "g string, v double")
    counts = df.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n"))
    got = ranking.running_before(counts, [F.col("v").asc()], {"k": F.col("n")}, ["g"], partitions).collect()
    for group in "ab":
        total = 0
        for row in sorted((r for r in got if r["g"] == group), key=lambda r: r["v"]):
            assert row["k_before"] == total
            total += row["n"]
        assert {r["k_total"] for r in got if r["g"] == group} == {total}


def test_ranks_of_uneven_values_match_brute_force(spark):
    rows = list(uneven_rows())
    df = spark.createDataFrame(rows, "id int, g string, v double").repartition(7)
    ranks = ranking.value_ranks(df, "v", ["g"])
    got = {
        r["id"]: (r["pr"], r["avg"]) for r in ranking.attach_ranks(df, ranks, "v", ["g"]).select(
            "id", ranking.percent_rank().alias("pr"), ranking.average_rank().alias("avg")
        ).collect()
    }
    assert len(got) == len(rows)
    for group in "ab":
        values = [v for _, g, v in rows if g == group]
        key = lambda v: (v is None, v or 0.0)
        for i, g, v in rows[:300]:
            if g == group:
                less = sum(key(x) < key(v) for x in values)
                equal = sum(key(x) == key(v) for x in values)
                assert got[i] == (less / (len(values) - 1), less + (equal + 1) / 2)


def test_percent_rank_differs_from_percent_average_rank(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (2.0,)], "v double")
    got = {
        r["v"]: (r["p"], r["a"]) for r in ranking.value_ranks(df, "v").select(
            "v", ranking.percent_rank().alias("p"), ranking.percent_average_rank().alias("a")).collect()
    }
    assert got == {1.0: (0.0, 0.5), 2.0: (1.0, 1.0)}
    single = spark.createDataFrame([(5.0,)], "v double")
    assert ranking.value_ranks(single, "v").select(ranking.percent_rank().alias("p")).first()["p"] == 0.0


def test_row_numbers(spark):
    df = spark.createDataFrame([(i * 37 % 101, i) for i in range(300)], "n int, k int").repartition(5)
    got = ranking.row_numbers(df, [F.desc("n"), F.asc("k")], "place").collect()
    expected = sorted(((r["n"], r["k"]) for r in got), key=lambda x: (-x[0], x[1]))
    assert [(r["n"], r["k"]) for r in sorted(got, key=lambda r: r["place"])] == expected
    assert sorted(r["place"] for r in got) == list(range(1, 301))


def test_unpartitioned_windows_only_see_one_row_per_partition(spark):
    df = spark.range(1000).select((F.col("id") % 10).cast("double").alias("v"))
    plan = ranking.value_ranks(df, "v")._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = [i for i, line in enumerate(plan) if "Window [" in line and ", [_slot" not in line]
    assert at and all(any("Aggregate [_slot" in below for below in plan[i:i + 4]) for i in at)


def test_line_by_hand(spark):
    df = spark.createDataFrame([(-3, 3.25), (-2, 4.45), (-1, 4.75)], "x int, y double")
    row = regression.ols_fit(df, "x", "y").first()
    assert (round(row["slope"], 9), round(row["intercept"], 9)) == (0.75, 5.65)
    flat = spark.createDataFrame([(1, 2.0), (1, 3.0)], "x int, y double")
    assert regression.ols_fit(flat, "x", "y").first()["slope"] is None


def test_mode_and_peak_tie_breaks(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5), ("b", 5), ("b", 4)], "g string, y int")
    assert {r["g"]: r["y"] for r in aggregates.mode_per_key(df, "g", "y").collect()} == {"a": 1, "b": 5}
    assert {r["g"]: r["peak_period"] for r in aggregates.peak_per_group(df, "g", "y").collect()} == {"a": 2, "b": 5}
