"""Author clusters: profile, scores, validation. Works for any (node, cluster_id) membership."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions import count_where, ratio, round_to
from auditloom.operators.generators import unpivot
from auditloom.operators.graph import communities, connected_components, large_components
from auditloom.operators.ranking import attach_ranks, percent_average_rank, rank_sum_auc, value_ranks
from auditloom.plans import vocabulary as v
from auditloom.plans.marts import weighted_score


def component_membership(edges: DataFrame, min_size: int = v.MIN_CLUSTER_AUTHORS) -> DataFrame:
    """Clusters = connected components of at least ``min_size`` authors."""
    found = connected_components(edges, "author_a", "author_b")
    return large_components(found, min_size).select("node", F.col("component").alias("cluster_id"))


def community_membership(edges: DataFrame, min_size: int = v.MIN_CLUSTER_AUTHORS) -> DataFrame:
    """Clusters = communities inside those components."""
    found = communities(edges, "author_a", "author_b", "n_shared_works", min_size)
    return found.select("node", F.col("community").alias("cluster_id"))


def cluster_profile(
    edges: DataFrame, membership: DataFrame, min_authors: int = v.MIN_CLUSTER_AUTHORS
) -> DataFrame:
    """One row per cluster of at least ``min_authors``, from the edges inside it."""
    sizes = (
        membership.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_authors"))
        .filter(F.col("n_authors") >= min_authors)
    )
    of_a = membership.select(F.col("node").alias("author_a"), "cluster_id")
    of_b = membership.select(F.col("node").alias("author_b"), F.col("cluster_id").alias("_other"))
    inside = edges.join(of_a, "author_a").join(of_b, "author_b").filter(F.col("cluster_id") == F.col("_other"))
    facts = inside.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n_edges"),
        F.sum("n_shared_works").alias("total_shared_works"),
        F.sum("n_shared_paper_mill").alias("n_paper_mill_works"),
        count_where(F.col("n_shared_paper_mill") > 0).alias("n_paper_mill_edges"),
        F.max("n_journals").alias("max_journals_in_edge"),
        F.max("n_fields").alias("max_fields_in_edge"),
        F.min("first_year").alias("first_year"),
        F.max("last_year").alias("last_year"),
    )
    n = F.col("n_authors").cast("double")
    span = F.col("last_year") - F.col("first_year") + 1
    zero = F.lit(0).cast("bigint")
    counts = ["n_edges", "total_shared_works", "n_paper_mill_works", "n_paper_mill_edges",
              "max_journals_in_edge", "max_fields_in_edge"]
    filled = sizes.join(facts, "cluster_id", "left").select(
        "cluster_id", "n_authors", *[F.coalesce(c, zero).alias(c) for c in counts],
        "first_year", "last_year", span.alias("year_span"),
    )
    per_author = F.col("total_shared_works") / n
    return filled.select(
        "cluster_id", "n_authors", "n_edges",
        round_to(F.lit(2.0) * F.col("n_edges") / (n * (n - 1.0)), 6).alias("density"),
        "total_shared_works", "n_paper_mill_works", "n_paper_mill_edges",
        F.coalesce(round_to(ratio("n_paper_mill_edges", "n_edges"), 4), F.lit(0.0)).alias("paper_mill_edge_share"),
        "max_journals_in_edge", "max_fields_in_edge", "first_year", "last_year", "year_span",
        F.when(F.col("year_span") > 0, round_to(per_author / F.col("year_span"), 3)).alias("works_per_author_year"),
    )


def cluster_scores(profile: DataFrame) -> DataFrame:
    """Severity and structural score from percentile ranks; a missing rank counts as the middle."""
    base = profile.withColumn("field_journal_ratio", ratio("max_fields_in_edge", "max_journals_in_edge"))
    measures = {name: F.col(name) for name in v.CLUSTER_SEVERITY_WEIGHTS}
    long = unpivot(base, ["cluster_id"], measures, "measure", "value").filter(F.col("value").isNotNull())
    ranked = attach_ranks(long, value_ranks(long, "value", ["measure"]), "value", ["measure"])
    wide = ranked.select("cluster_id", "measure", percent_average_rank().alias("pr")).groupBy("cluster_id").agg(
        *[F.max(F.when(F.col("measure") == name, F.col("pr"))).alias(f"pr_{name}") for name in measures]
    )
    filled = base.join(wide, "cluster_id").select(
        *base.columns, "pr_paper_mill_edge_share", "pr_density",
        *[F.coalesce(c, F.lit(0.5)).alias(c) for c in ("pr_works_per_author_year", "pr_field_journal_ratio")],
    )
    return filled.select(
        "*",
        round_to(weighted_score(v.CLUSTER_SEVERITY_WEIGHTS), 2).alias("cluster_risk_score"),
        round_to(weighted_score(v.CLUSTER_STRUCTURAL_WEIGHTS), 2).alias("cluster_structural_score"),
    )


def cluster_auc(scores: DataFrame) -> DataFrame:
    """AUC of both scores; no row when one class is missing."""
    long = unpivot(
        scores.withColumn("label", F.col("n_paper_mill_works") > 0), ["label"],
        {label: F.col(name) for name, label in v.CLUSTER_SCORE_NAMES.items()}, "score_name", "score",
    )
    auc = rank_sum_auc(long, "score", "label", ["score_name"])
    return auc.filter(F.col("auc").isNotNull()).select("score_name", round_to("auc", 4).alias("auc"))


def cluster_validation(scores: DataFrame, n_pairs: DataFrame) -> DataFrame:
    """AUC rows with the size of the sample; ``n_pairs`` is a one-row frame of all author pairs."""
    counts = scores.agg(
        F.count(F.lit(1)).alias("n_clusters"),
        count_where(F.col("n_paper_mill_works") > 0).alias("n_clusters_with_paper_mill"),
    )
    return (
        cluster_auc(scores).crossJoin(F.broadcast(counts))
        .crossJoin(F.broadcast(n_pairs.select(F.col("n_pairs").alias("n_edges_total"))))
    )


def main_names(authorships: DataFrame) -> DataFrame:
    """Most frequent name of each author id and one ORCID seen with it."""
    spelled = authorships.filter(F.col("author_id").isNotNull()).groupBy("author_id", "author_name").agg(
        F.count(F.lit(1)).alias("n"), F.min("orcid").alias("orcid")
    )
    best = F.min(F.struct((-F.col("n")).alias("less"), "author_name", "orcid"))
    return spelled.groupBy("author_id").agg(best.alias("_best")).select(
        "author_id", F.col("_best.author_name").alias("author_name"), F.col("_best.orcid").alias("orcid")
    )


def cluster_members(membership: DataFrame, scores: DataFrame, authorships: DataFrame) -> DataFrame:
    """Members of scored clusters with their names."""
    kept = membership.join(scores.select("cluster_id"), "cluster_id", "left_semi")
    return (
        kept.select("cluster_id", F.col("node").alias("author_id"))
        .join(main_names(authorships), "author_id", "left")
        .select("cluster_id", "author_id", "author_name", "orcid")
    )


def density_by_size(scores: DataFrame, smallest: int = 3, largest: int = 30) -> DataFrame:
    """How density depends on cluster size."""
    return scores.filter(F.col("n_authors").between(smallest, largest)).groupBy("n_authors").agg(
        F.count(F.lit(1)).alias("n_clusters"),
        round_to(F.avg("density"), 4).alias("avg_density"),
        round_to(count_where(F.col("density") >= 0.999) / F.count(F.lit(1)), 4).alias("saturated_share"),
    )


def network_summary(edges: DataFrame, membership: DataFrame, scores: DataFrame) -> DataFrame:
    """One row about a run: graph size, clusters, the worst cluster, both AUCs."""
    nodes = edges.select(F.explode(F.array("author_a", "author_b")).alias("node"))
    severity, structural = v.CLUSTER_SCORE_NAMES.values()
    auc = cluster_auc(scores).agg(
        F.max(F.when(F.col("score_name") == severity, F.col("auc"))).alias("auc_severity"),
        F.max(F.when(F.col("score_name") == structural, F.col("auc"))).alias("auc_structural"),
    )
    top = F.min(F.struct((-F.col("cluster_risk_score")).alias("less"), "cluster_id"))["cluster_id"]
    parts = [
        edges.agg(F.count(F.lit(1)).alias("n_edges")),
        membership.agg(F.count_distinct("cluster_id").alias("n_communities")),
        scores.agg(F.count(F.lit(1)).alias("n_clusters_scored"), top.alias("top_cluster_id")),
        auc,
    ]
    row = nodes.agg(F.count_distinct("node").alias("n_nodes"))
    for part in parts:
        row = row.crossJoin(F.broadcast(part))
    return row
