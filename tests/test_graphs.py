from __future__ import annotations

import random
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from auditloom.operators import graph, pairs
from auditloom.operators.lookup import lookup


def memberships():
    """Groups of very uneven size: two of them hold most items, items repeat inside a group."""
    rng = random.Random(11)
    rows = [(0, i) for i in range(40)] + [(1, i) for i in range(20, 60)] + [(2, i) for i in range(0, 60, 3)]
    rows += [(g, rng.randrange(60)) for g in range(3, 60) for _ in range(4)]
    return rows + rows[:10] + [(None, 1), (5, None)]


def brute_force(rows, min_shared):
    groups = {}
    for g, i in rows:
        if g is not None and i is not None:
            groups.setdefault(g, set()).add(i)
    count = Counter(p for items in groups.values() for p in combinations(sorted(items), 2))
    return {p: n for p, n in count.items() if n >= min_shared}, len(count)


@pytest.mark.parametrize("tile", [2, 5, 25, 1000])
@pytest.mark.parametrize("min_shared", [2, 3])
def test_pairs_match_brute_force_at_every_threshold(spark, tile, min_shared):
    rows = memberships()
    df = spark.createDataFrame(rows, "g int, i int")
    shared = pairs.shared_groups(df, "g", "i", min_shared, tile).collect()
    assert len(shared) == len(set(map(tuple, shared)))
    assert Counter((r["a"], r["b"]) for r in shared) == brute_force(rows, min_shared)[0]


def test_all_pairs_are_counted_without_listing_them(spark):
    rows = memberships()
    df = spark.createDataFrame(rows, "g int, i int")
    repeats = pairs.shared_groups(df, "g", "i", 2, 5)
    assert pairs.count_all_pairs(df, "g", "i", repeats).first()["n_pairs"] == brute_force(rows, 2)[1]


def test_groups_shared_by_all_cost_no_more_than_listing_them(spark):
    rows = [(g, i) for g in range(40) for i in range(40)]
    df = spark.createDataFrame(rows, "g int, i int")
    kept = df.withColumn("size", F.lit(40))
    assert not pairs._lookup_is_smaller(kept, 25)
    assert pairs.meetings(df, "g", "i", 2, 25).count() == 40 * 40 * 39 // 2


@pytest.mark.parametrize("min_shared", [2, 3])
def test_large_groups_are_looked_up_where_that_is_less(spark, min_shared):
    """Two groups of 300 with few items in common: looking up is chosen, and exact."""
    rows = [(0, i) for i in range(300)] + [(1, i) for i in range(290, 590)] + [(g, g) for g in range(2, 590)]
    rows += [(1000 + i, i) for i in range(590)] + [(1000 + i, i + 1) for i in range(0, 589, 2)]
    df = spark.createDataFrame(rows, "g int, i int")
    shared = Counter((r["a"], r["b"]) for r in pairs.shared_groups(df, "g", "i", min_shared, 50).collect())
    assert shared == brute_force(rows, min_shared)[0]
    sizes = df.groupBy("g").agg(F.count(F.lit(1)).alias("size"))
    assert pairs._lookup_is_smaller(df.join(sizes, "g"), 50)


def test_a_hub_is_split_over_tasks(spark):
    """The rows of one key are read by several tasks once they exceed the threshold of adaptive execution."""
    low = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    }
    before = {k: spark.conf.get(k, None) for k in low}
    try:
        for k, value in low.items():
            spark.conf.set(k, value)
        leaves = spark.range(1, 200_001, 1, 16).select(F.col("id").alias("u"), F.lit(0).cast("bigint").alias("v"))
        hub = leaves.select(F.col("v").alias("u"), F.col("u").alias("v"))
        smallest = hub.groupBy("u").agg(F.min("v").alias("low"))
        found = lookup(hub, smallest, "u").withColumn("task", F.spark_partition_id())
        rows = [r["count"] for r in found.groupBy("task").count().collect()]
        assert sum(rows) == 200_000 and max(rows) < 100_000
        assert graph.connected_components(leaves, "u", "v").filter("component = 0").count() == 200_001
    finally:
        for k, value in before.items():
            spark.conf.unset(k) if value is None else spark.conf.set(k, value)


def test_pairs_that_meet_once_cannot_be_listed(spark):
    with pytest.raises(ValueError):
        pairs.shared_groups(spark.createDataFrame([(1, 1)], "g int, i int"), "g", "i", 1)


def components(spark, edges, kind="int"):
    df = spark.createDataFrame(edges, f"a {kind}, b {kind}").repartition(4)
    rows = graph.connected_components(df).collect()
    found = {r["node"]: r["component"] for r in rows}
    assert len(found) == len(rows)
    return found


def test_components_of_chain_hub_and_cycle(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(500, i) for i in range(501, 600)]
    cycle = [(i, 900 + (i - 899) % 7) for i in range(900, 907)]
    found = components(spark, chain + hub + cycle + [(7, 7), (3, 2), (2, 3)])
    assert {found[i] for i in range(100, 161)} == {100}
    assert {found[i] for i in range(500, 600)} == {500}
    assert {found[i] for i in range(900, 907)} == {900}
    assert found[3] == found[2] == 2 and 7 not in found


def test_components_of_text_ids_and_random_graph(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(150):03d}", f"n{rng.randrange(150):03d}") for _ in range(110)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    expected = {x: root(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark, edges, "string") == expected


def two_cliques():
    left, right = range(0, 5), range(10, 15)
    edges = [(a, b, 3) for side in (left, right) for a, b in combinations(side, 2)]
    return edges + [(4, 10, 1), (100, 101, 2), (101, 102, 2), (200, 201, 9)]


@pytest.mark.parametrize("parts", [1, 6])
def test_communities_split_cliques_and_skip_pairs(spark, parts):
    df = spark.createDataFrame(two_cliques(), "a int, b int, weight int").repartition(parts)
    found = {r["node"]: (r["component"], r["community"]) for r in graph.communities(df).collect()}
    assert set(found) == {*range(0, 5), *range(10, 15), 100, 101, 102}
    assert {found[i] for i in range(0, 5)} == {(0, 0)}
    assert {found[i] for i in range(10, 15)} == {(0, 10)}
    assert {found[i][0] for i in (100, 101, 102)} == {100}


def test_large_components_drop_pairs(spark):
    df = spark.createDataFrame([(1, 2), (5, 6), (6, 7)], "a int, b int")
    kept = graph.large_components(graph.connected_components(df), 3)
    assert {r["node"] for r in kept.collect()} == {5, 6, 7}
    assert graph.graph_stats(df).first().asDict() == {"n_nodes": 5, "n_edges": 3}


def test_no_cartesian_product(spark):
    df = spark.createDataFrame(memberships(), "g int, i int")
    plan = pairs.shared_groups(df, "g", "i")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
