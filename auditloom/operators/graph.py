"""Graphs as edge tables: components and communities by iterated joins.

Every round is written to the shared folder; only counts that decide when to stop reach the
driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.operators.lookup import lookup
from auditloom.operators.persisting import materialize, materialize_counted


#: When fewer than one node in so many wants to move, the next round looks at part of the nodes only.
FEW = 50


def graph_stats(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row: number of edges and of distinct nodes."""
    nodes = edges.select(F.col(a).alias("node")).unionByName(edges.select(F.col(b).alias("node")))
    n_nodes = nodes.distinct().agg(F.count(F.lit(1)).alias("n_nodes"))
    n_edges = edges.agg(F.count(F.lit(1)).alias("n_edges"))
    return n_edges.crossJoin(F.broadcast(n_nodes)).select("n_nodes", "n_edges")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) with the smallest node id of the component as its name.

    Alternates the large-star and small-star steps of Kiveris et al. (2014), which shorten long
    chains in a logarithmic number of rounds where passing labels along needs one per hop. The
    minimum per node is combined before the shuffle, so a node with very many neighbours is one
    small row per task; the lookup that follows splits its rows.
    """
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter(F.col("x") != F.col("y"))
    current = materialize(
        ends.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "stars"
    )
    while not _only_stars(current):
        current = materialize(_small_star(materialize(_large_star(current), "large-stars")), "stars")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _large_star(stars: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = stars.select("u", "v").unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
    smallest = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return (
        lookup(both.filter(F.col("v") > F.col("u")), smallest, "u")
        .select(F.col("v").alias("u"), F.col("low").alias("v"))
    )


def _small_star(stars: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    smallest = stars.groupBy("u").agg(F.min("v").alias("low"))
    moved = (
        lookup(stars, smallest, "u").filter(F.col("v") != F.col("low"))
        .select(F.col("v").alias("u"), F.col("low").alias("v"))
    )
    return moved.unionByName(smallest.select("u", F.col("low").alias("v"))).distinct()


def _only_stars(stars: DataFrame) -> bool:
    """True when every node points to one root and no root points anywhere."""
    seen = stars.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(
        stars.select(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in"))
    )
    node = seen.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
    return node.filter((F.col("out") > 1) | ((F.col("out") > 0) & (F.col("in") > 0))).isEmpty()


def component_sizes(membership: DataFrame) -> DataFrame:
    return membership.groupBy("component").agg(F.count(F.lit(1)).alias("n_nodes"))


def large_components(membership: DataFrame, min_size: int = 3) -> DataFrame:
    """Membership rows of components with at least ``min_size`` nodes."""
    big = component_sizes(membership).filter(F.col("n_nodes") >= min_size)
    return lookup(membership, big, "component").select("node", "component")


def communities(
    edges: DataFrame, a: str = "a", b: str = "b", weight: str = "weight", min_component: int = 3
) -> DataFrame:
    """(node, component, community): communities of high modularity inside each component.

    Local moving and contraction after Blondel et al. (2008), in rounds of moves that cannot undo
    each other (see ``_accepted``). The first sweep contracts after every round, which reaches few,
    large nodes early; each later sweep starts again from single nodes, moves them to rest, contracts,
    moves the communities to rest, and so on. It ends when a sweep moves nothing: neither a node
    nor a whole community gains by moving. Every round raises the modularity of whole-number weights
    strictly, so the loop ends by itself; there is no limit on rounds or levels. Communities that are not connected
    are parted at the end. The result does not depend on partitioning. A community is named by its smallest node.
    """
    weighted = edges.groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.sum(weight).cast("bigint").alias("w"))
    weighted = materialize(weighted.filter(F.col("x") != F.col("y")), "weighted")
    home = materialize(large_components(connected_components(weighted, "x", "y"), min_component), "home")
    links = weighted.select(F.col("x").alias("src"), F.col("y").alias("dst"), "w").unionByName(
        weighted.select(F.col("y").alias("src"), F.col("x").alias("dst"), "w")
    )
    links = links.join(home, links["src"] == home["node"]).select("src", "dst", "w", "component")
    strength = materialize(links.groupBy("src", "component").agg(F.sum("w").alias("k")), "strength")
    volume = strength.groupBy("component").agg(F.sum("k").alias("two_m"))
    base = materialize(
        lookup(strength, volume, "component").select(F.col("src").alias("node"), "component", "k", "two_m"), "nodes"
    )
    of_src = base.select(F.col("node").alias("src"), "k", "two_m")
    base_links = materialize(links.select("src", "dst", "w").join(of_src, "src"), "links")

    member = base.select("node", F.col("node").alias("comm"))
    first = True
    while True:
        start = materialize(base.join(member, "node").select("node", "comm", "k", "two_m"), "moving")
        settled, changed = _local_moving(start, base_links, once=first)
        member = settled.select("node", "comm")
        nodes, links, moved = settled, base_links, changed
        while moved:
            nodes, links = _contracted(nodes, links)
            nodes, moved = _local_moving(nodes, links, once=first)
            if moved:
                step = nodes.select(F.col("node").alias("comm"), F.col("comm").alias("next"))
                member = materialize(
                    member.join(step, "comm").select("node", F.col("next").alias("comm")), "member"
                )
        if not changed:
            return _name_communities(base, base_links, _connected_parts(base_links, member))
        first = False


def _contracted(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Communities as the nodes of the next level; a community's inner links become a loop."""
    next_nodes = materialize(
        nodes.groupBy("comm").agg(F.sum("k").alias("k"), F.first("two_m").alias("two_m"))
        .select(F.col("comm").alias("node"), "comm", "k", "two_m"),
        "nodes",
    )
    of_src = nodes.select(F.col("node").alias("src"), F.col("comm").alias("c_src"))
    of_dst = nodes.select(F.col("node").alias("dst"), F.col("comm").alias("c_dst"))
    between = (
        links.select("src", "dst", "w").join(of_src, "src").join(of_dst, "dst")
        .groupBy(F.col("c_src").alias("src"), F.col("c_dst").alias("dst")).agg(F.sum("w").alias("w"))
    )
    facts = next_nodes.select(F.col("node").alias("src"), "k", "two_m")
    return next_nodes, materialize(lookup(facts, between, "src").select("src", "dst", "w", "k", "two_m"), "links")


def _local_moving(nodes: DataFrame, links: DataFrame, once: bool) -> tuple[DataFrame, bool]:
    """Rounds of moves until none gains, or a single round; and whether anything moved.

    nodes: (node, comm, k, two_m), written. links: (src, dst, w) with k and two_m of src, both directions.
    After a round only the nodes that it can have changed the mind of are looked at again (``_unsettled``); the others
    would answer as before, so the rounds are the same as over all nodes and an empty one means rest.
    """
    outside = links.filter(F.col("src") != F.col("dst"))
    active: DataFrame | None = None
    changed, n_nodes = False, 0 if once else nodes.count()
    while True:
        wanted, n_wanted = materialize_counted(_wanted(nodes, outside, active), "wanted")
        if not n_wanted:
            return nodes, changed
        # Both ways are exact; finding the nodes to look at again costs a round of its own where many want to move.
        narrow = not once and n_wanted * FEW < n_nodes
        moves = materialize(_accepted(wanted), "moves") if narrow else _accepted(wanted)
        to = moves.select("node", F.col("to").alias("_to"))
        nodes = materialize(
            nodes.join(to, "node", "left").select("node", F.coalesce("_to", "comm").alias("comm"), "k", "two_m"),
            "moving",
        )
        changed = True
        if once:
            return nodes, changed
        active = materialize(_unsettled(nodes, outside, wanted, moves), "unsettled") if narrow else None


def _unsettled(nodes: DataFrame, outside: DataFrame, wanted: DataFrame, moves: DataFrame) -> DataFrame:
    """(node): who may gain after the ``moves``.

    What a node gains depends on its own community and those of its neighbours: on their members next to the node and on
    their strength. A move changes two communities. So only their members, the neighbours of these, and nodes that
    wanted to move and had to wait can answer otherwise than before.
    """
    touched = moves.select(F.explode(F.array("from", "to")).alias("comm")).distinct()
    inside = nodes.join(touched, "comm", "left_semi").select("node")
    beside = outside.join(inside.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("node"))
    return inside.unionByName(beside).unionByName(wanted.select("node")).distinct()


def _wide(column: str) -> Column:
    """Whole numbers whose products must not overflow."""
    return F.col(column).cast("decimal(19,0)")


def _wanted(nodes: DataFrame, outside: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """(node, k, from, to, gain): the best move of each (active) node that gains by moving.

    A node's own community comes in as a row of weight 0, so all that a node needs is in rows
    keyed by the node, and they are combined before the shuffle however many neighbours it has.
    """
    totals = nodes.groupBy("comm").agg(F.sum("k").alias("tot")).withColumnRenamed("comm", "to")
    of_dst = nodes.select(F.col("node").alias("dst"), F.col("comm").alias("to"))
    if active is not None:
        outside = outside.join(active.withColumnRenamed("node", "src"), "src", "left_semi")
        nodes = nodes.join(active, "node", "left_semi")
    near = outside.join(of_dst, "dst").select("src", "to", "w", "k", "two_m", F.lit(False).alias("own"))
    own = nodes.select(
        F.col("node").alias("src"), F.col("comm").alias("to"), F.lit(0).cast("bigint").alias("w"), "k", "two_m",
        F.lit(True).alias("own"),
    )
    pull = near.unionByName(own).groupBy("src", "to").agg(
        F.sum("w").alias("w"), F.bool_or("own").alias("own"), F.first("k").alias("k"), F.first("two_m").alias("two_m")
    )
    others = F.when(F.col("own"), _wide("tot") - _wide("k")).otherwise(_wide("tot")).cast("decimal(19,0)")
    valued = lookup(pull, totals, "to").withColumn("value", _wide("two_m") * _wide("w") - _wide("k") * others)
    best = valued.groupBy("src").agg(
        F.first("k").alias("k"),
        F.min(F.when(F.col("own"), F.struct("value", "to"))).alias("here"),
        F.min(F.when(~F.col("own"), F.struct((-F.col("value")).alias("loss"), "to"))).alias("best"),
    )
    gain = -F.col("best.loss") - F.col("here.value")
    return best.filter(gain > 0).select(
        F.col("src").alias("node"), "k", F.col("here.to").alias("from"), F.col("best.to").alias("to"),
        gain.alias("gain"),
    )


def _accepted(wanted: DataFrame) -> DataFrame:
    """Moves that raise modularity together.

    The best move touching a community (by gain, then node) says whether the community gives or takes
    nodes in this round; moves against that wait. A move that is the best one for both of its
    communities is taken. Two movers that leave or enter the same community cost at most the
    product of their strengths. A further move is taken if its gain exceeds its half of that cost
    to all other movers there and the whole of it to the best one. So the gains left over add up
    to a rise, and the best move of a component is always taken.
    """
    touched = wanted.select(
        "node", "gain", "k",
        F.inline(F.array(
            F.struct(F.col("from").alias("comm"), F.lit(False).alias("takes")),
            F.struct(F.col("to").alias("comm"), F.lit(True).alias("takes")),
        )),
    )
    first = F.min(F.struct((-F.col("gain")).alias("loss"), "node", "takes", "k"))
    sides = touched.groupBy("comm").agg(
        first.alias("top"),
        F.sum(F.when(F.col("takes"), F.col("k")).otherwise(0)).alias("k_in"),
        F.sum(F.when(F.col("takes"), F.lit(0)).otherwise(F.col("k"))).alias("k_out"),
    )
    givers = sides.filter(~F.col("top.takes")).select(
        F.col("comm").alias("from"), F.col("top.node").alias("top_from"),
        (F.col("k_out") + F.col("top.k")).alias("k_from"),
    )
    takers = sides.filter("top.takes").select(
        F.col("comm").alias("to"), F.col("top.node").alias("top_to"), (F.col("k_in") + F.col("top.k")).alias("k_to"),
    )
    met = lookup(lookup(wanted, givers, "from"), takers, "to")
    leading = (F.col("node") == F.col("top_from")) & (F.col("node") == F.col("top_to"))
    crowd = (_wide("k_from") + _wide("k_to") - 2 * _wide("k")).cast("decimal(19,0)")
    return met.filter(leading | (2 * F.col("gain") > _wide("k") * crowd))


def _connected_parts(links: DataFrame, member: DataFrame) -> DataFrame:
    """(node, comm) with every community cut into its connected parts.

    Moves can leave a community whose parts no longer touch. Parting them loses no inner edge and lowers the expected
    share, so it raises the modularity. A part is named by its smallest node.
    """
    of_src = member.select(F.col("node").alias("src"), F.col("comm").alias("c_src"))
    of_dst = member.select(F.col("node").alias("dst"), F.col("comm").alias("c_dst"))
    inner = links.filter(F.col("src") < F.col("dst")).select("src", "dst").join(of_src, "src").join(of_dst, "dst")
    inner = materialize(inner.filter(F.col("c_src") == F.col("c_dst")).select("src", "dst"), "inner")
    parts = connected_components(inner, "src", "dst").select("node", F.col("component").alias("part"))
    return materialize(
        member.join(parts, "node", "left").select("node", F.coalesce("part", "node").alias("comm")), "parted"
    )


def all_connected(edges: DataFrame, labels: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row: whether every community of ``labels`` (node, community) is connected by its own edges."""
    of_a = labels.select(F.col("node").alias("_a"), F.col("community").alias("_c"))
    of_b = labels.select(F.col("node").alias("_b"), F.col("community").alias("_d"))
    ends = edges.select(F.col(a).alias("_a"), F.col(b).alias("_b"))
    inner = materialize(ends.join(of_a, "_a").join(of_b, "_b").filter(F.col("_c") == F.col("_d")).select("_a", "_b"), "inner")
    parts = connected_components(inner, "_a", "_b").select("node", F.col("component").alias("part"))
    placed = labels.select("node", "community").join(parts, "node", "left")
    n = placed.groupBy("community").agg(F.count_distinct(F.coalesce("part", "node")).alias("n"))
    return n.agg(F.coalesce(F.max("n") <= 1, F.lit(True)).alias("all_connected"))


def _name_communities(base: DataFrame, links: DataFrame, member: DataFrame) -> DataFrame:
    """Final labels; a component whose split scores below no split at all stays whole."""
    names = member.groupBy("comm").agg(F.min("node").alias("community"))
    named = materialize(lookup(member, names, "comm").select("node", "community"), "named")
    scores = modularity(base, links, named)
    labelled = lookup(base.select("node", "component").join(named, "node"), scores, "component")
    return labelled.select(
        "node", "component",
        F.when(F.col("modularity") < 0, F.col("component")).otherwise(F.col("community")).alias("community"),
    )


def community_modularity(
    edges: DataFrame, labels: DataFrame, a: str = "a", b: str = "b", weight: str = "weight"
) -> DataFrame:
    """(component, two_m, modularity) of a labelling (node, component, community) of a weighted graph."""
    ends = edges.filter(F.col(a) != F.col(b)).select(F.col(a).alias("x"), F.col(b).alias("y"), F.col(weight).alias("w"))
    links = ends.select(F.col("x").alias("src"), F.col("y").alias("dst"), "w").unionByName(
        ends.select(F.col("y").alias("src"), F.col("x").alias("dst"), "w")
    )
    degrees = links.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k"))
    strength = materialize(labels.select("node", "component").join(degrees, "node"), "strength")
    volume = strength.groupBy("component").agg(F.sum("k").alias("two_m"))
    nodes = lookup(strength, volume, "component")
    return volume.join(modularity(nodes, links, labels.select("node", "community")), "component")


def modularity(nodes: DataFrame, links: DataFrame, membership: DataFrame) -> DataFrame:
    """Modularity of a labelling in each component.

    nodes: (node, component, k, two_m); links: both directions of every edge (src, dst, w).
    """
    links = links.select("src", "dst", "w")
    of_src = membership.select(F.col("node").alias("src"), F.col("community").alias("c"))
    of_dst = membership.select(F.col("node").alias("dst"), F.col("community").alias("c_dst"))
    inner = (
        links.join(of_src, "src").join(of_dst, "dst").filter(F.col("c") == F.col("c_dst"))
        .groupBy("c").agg(F.sum("w").alias("inside"))
    )
    totals = (
        nodes.join(membership, "node").groupBy("component", F.col("community").alias("c"))
        .agg(F.sum("k").alias("tot"), F.first("two_m").alias("two_m"))
    )
    part = F.coalesce("inside", F.lit(0)) / F.col("two_m") - F.pow(F.col("tot") / F.col("two_m"), F.lit(2.0))
    return (
        totals.join(inner, "c", "left").groupBy("component").agg(F.sum(part).alias("modularity"))
    )
