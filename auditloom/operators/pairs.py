"""Pairs of items that share at least ``min_shared`` groups.

A pair in the result shares two or more groups, so an item of fewer than ``min_shared`` groups is
removed first. The pairs of a group are listed tile against tile: its members are dealt into tiles of
about ``tile`` items, and every two tiles meet in a task of their own, so a group of any size is spread.

Groups of more than ``tile`` items have a second exact route, which doesn't list their pairs: a pair that
meets in a small group looks its large groups up, and a pair that meets only in large groups is found
through two of them. The rows of both routes are counted first and the smaller one is taken, so there are
never more than by plain listing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.operators.lookup import lookup
from auditloom.operators.persisting import materialize

TILE = 256


def distinct_members(df: DataFrame, group: str, item: str) -> DataFrame:
    return (
        df.filter(F.col(group).isNotNull() & F.col(item).isNotNull())
        .select(F.col(group).alias("g"), F.col(item).alias("i"))
        .distinct()
    )


def shared_groups(df: DataFrame, group: str, item: str, min_shared: int = 2, tile: int = TILE) -> DataFrame:
    """One row (a, b, group) per group shared by a pair a < b of the result."""
    met = meetings(df, group, item, min_shared, tile)
    n = F.count(F.lit(1)).over(Window.partitionBy("a", "b"))
    return met.withColumn("_n", n).filter(F.col("_n") >= min_shared).select("a", "b", F.col("g").alias(group))


def meetings(
    df: DataFrame, group: str, item: str, min_shared: int = 2, tile: int = TILE, facts: DataFrame | None = None
) -> DataFrame:
    """(a, b, g) for every shared group of every pair a < b that may share ``min_shared`` of them.

    All meetings of pairs of the result are there; pairs that meet less often are to be removed by
    their count, in the aggregation that reads this. ``facts`` (one row per group, first column the group)
    goes along.
    """
    if min_shared < 2:
        raise ValueError("min_shared must be at least 2; pairs that meet once are only counted")
    members = distinct_members(df, group, item)
    frequent = members.groupBy("i").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_shared)
    useful = lookup(members, frequent, "i").select("g", "i")
    sizes = useful.groupBy("g").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= 2)
    if facts is not None:
        sizes = sizes.join(facts.withColumnRenamed(facts.columns[0], "g"), "g")
    kept = materialize(lookup(useful, sizes, "g"), "members")
    carried = [c for c in kept.columns if c not in ("g", "i", "size")]

    large = kept.filter(F.col("size") > tile)
    if not _lookup_is_smaller(kept, tile):
        return _listed(kept, ["g"], tile, carried)
    met = materialize(_listed(kept.filter(F.col("size") <= tile), ["g"], tile, carried), "small-group-pairs")
    found = _large_meetings(met, large, tile)
    if carried:
        found = lookup(found, large.select("g", *carried).distinct(), "g")
    return met.unionByName(found.select("a", "b", "g", *carried))


def _listed(members: DataFrame, keys: Sequence[str], tile: int, carried: Sequence[str] = ()) -> DataFrame:
    """Every pair a < b of every group once; members: (*keys, i, size, *carried)."""
    n_tiles = F.ceil(F.col("size") / tile).cast("int")
    dealt = members.withColumn("_n", n_tiles).withColumn(
        "_t", F.when(F.col("_n") > 1, F.pmod(F.xxhash64("i"), F.col("_n")).cast("int")).otherwise(F.lit(0))
    )
    upper = dealt.select(
        *keys, *carried, F.col("i").alias("_x"), F.col("_t").alias("_lo"),
        F.explode(F.sequence(F.col("_t"), F.col("_n") - 1)).alias("_hi"),
    )
    lower = dealt.select(
        *keys, F.col("i").alias("_y"), F.explode(F.sequence(F.lit(0), F.col("_t"))).alias("_lo"),
        F.col("_t").alias("_hi"),
    )
    once = (F.col("_lo") < F.col("_hi")) | (F.col("_x") < F.col("_y"))
    return upper.join(lower, [*keys, "_lo", "_hi"]).filter(once).select(
        F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"), *keys, *carried
    )


def _in_two(large: DataFrame) -> DataFrame:
    """(g1, g2, i): items with every two large groups they are in."""
    mine = large.groupBy("i").agg(F.sort_array(F.collect_list("g")).alias("gs"))
    first = mine.select("i", "gs", F.posexplode("gs").alias("p", "g1"))
    return first.select("i", "g1", F.explode(F.slice("gs", F.col("p") + 2, F.size("gs"))).alias("g2"))


def _lookup_is_smaller(kept: DataFrame, tile: int) -> bool:
    """True if finding the pairs of large groups by lookup makes fewer rows than listing them."""
    def two_of(n: str):
        return F.coalesce(F.sum(F.col(n).cast("double") * (F.col(n) - 1) / 2), F.lit(0.0))

    per_group = kept.groupBy("g").agg(F.first("size").alias("size"))
    is_large = F.col("size") > tile
    small = per_group.filter(~is_large).agg(two_of("size").alias("n_small"))
    listing, n_small = per_group.filter(is_large).agg(two_of("size").alias("n_large")).crossJoin(
        F.broadcast(small)
    ).first()
    if listing == 0:
        return False
    large = kept.filter(is_large)
    twice = large.groupBy("i").agg(F.count(F.lit(1)).alias("h")).agg(two_of("h")).first()[0]
    if n_small + twice >= listing:
        return False
    shared = _in_two(large).groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("c")).agg(two_of("c")).first()[0]
    return n_small + twice + shared < listing


def _large_meetings(met: DataFrame, large: DataFrame, tile: int) -> DataFrame:
    """Large groups shared by pairs that meet in a small group or in two large ones."""
    twice = _in_two(large)
    sizes = twice.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= 2)
    both = twice.join(sizes.hint("rebalance"), ["g1", "g2"])
    candidates = met.select("a", "b").unionByName(_listed(both, ["g1", "g2"], tile).select("a", "b")).distinct()
    mine = large.groupBy("i").agg(F.collect_list("g").alias("gs"))
    of_a = mine.select(F.col("i").alias("a"), F.col("gs").alias("of_a"))
    of_b = mine.select(F.col("i").alias("b"), F.col("gs").alias("of_b"))
    shared = F.explode(F.array_intersect("of_a", "of_b")).alias("g")
    return lookup(lookup(candidates, of_a, "a"), of_b, "b").select("a", "b", shared)


def _count_meetings(df: DataFrame, group: str, item: str) -> DataFrame:
    """One row: the meetings of all groups. Members are dealt out by group once, for both of their counts."""
    dealt = df.filter(F.col(group).isNotNull() & F.col(item).isNotNull()).select(group, item).repartition(F.col(group))
    sizes = distinct_members(dealt, group, item).groupBy("g").agg(F.count(F.lit(1)).alias("k"))
    pairs_of = (F.col("k") * (F.col("k") - 1) / 2).cast("bigint")
    return sizes.agg(F.coalesce(F.sum(pairs_of), F.lit(0)).alias("n_meetings"))


def count_all_pairs(df: DataFrame, group: str, item: str, repeats: DataFrame) -> DataFrame:
    """Number of distinct pairs that share one group or more, as a one-row frame ``n_pairs``.

    Counted, not listed: the meetings of all groups, sum k(k-1)/2, minus what pairs of
    ``repeats`` (the result of ``shared_groups`` with min_shared = 2) add beyond their first.
    """
    meetings = _count_meetings(df, group, item)
    again = (
        repeats.groupBy("a", "b").agg((F.count(F.lit(1)) - 1).alias("extra"))
        .agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("n_again"))
    )
    return meetings.crossJoin(F.broadcast(again)).select(
        (F.col("n_meetings") - F.col("n_again")).alias("n_pairs")
    )


def count_pairs_by_edges(df: DataFrame, group: str, item: str, edges: DataFrame, shared: str) -> DataFrame:
    """As ``count_all_pairs``, from a table of the pairs that share two groups or more.

    ``edges`` has one row per pair and the number of groups it shares, so no pair is looked for again.
    """
    meetings = _count_meetings(df, group, item)
    again = edges.agg(F.coalesce(F.sum(F.col(shared) - 1), F.lit(0)).alias("n_again"))
    return meetings.crossJoin(F.broadcast(again)).select(
        (F.col("n_meetings") - F.col("n_again")).cast("bigint").alias("n_pairs")
    )
