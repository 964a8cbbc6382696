"""Components of accepted pairs, and pool clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketflow.operators import aggs
from ticketflow.operators.joins import SMALL_ROWS
from ticketflow.operators.lineage import cut
from ticketflow.operators.windows import accepted_edges, marked_weak, topn_neighbours, weakest_edges


def connected_components(edges: DataFrame, max_iter: int = 50) -> DataFrame:
    """G1: (a, b) -> node, component (the smallest node), for nodes with an edge.

    Every round takes the smallest label among the neighbours, then the label of the label, and is
    kept in the checkpoint folder; it ends when nothing changes.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component")))
    hint = "broadcast" if labels.count() <= SMALL_ROWS else "merge"
    for _ in range(max_iter):
        near = both.join(labels.withColumnRenamed("node", "b").hint(hint), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near.hint(hint), "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        up = step.select(F.col("node").alias("component"), F.col("component").alias("up"))
        new = cut(step.join(up.hint(hint), "component", "left").select("node", "was", F.least("component", "up").alias("component")))
        labels = new.select("node", "component")
        if new.filter("was <> component").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_iter} rounds")


def oversize_guard(edges: DataFrame, comps: DataFrame, verdicts: DataFrame | None, threshold: int = 20) -> DataFrame:
    """Edges without the weak ones of oversized components that got no second YES.

    Without a table of verdicts the edges bring theirs (`second`), and none of them are shuffled or kept.
    """
    if verdicts is None:
        return marked_weak(edges, comps, threshold).filter(~F.col("weak") | F.coalesce(F.col("second") == "YES", F.lit(False))).select("a", "b", "sim")
    weak = weakest_edges(edges, comps, threshold).select("a", "b")
    confirmed = verdicts.filter("second = 'YES'").select("a", "b").distinct()
    return edges.join(weak.join(confirmed, ["a", "b"], "left_anti"), ["a", "b"], "left_anti")


def drift_prune(comps: DataFrame, removals: DataFrame, at_least: int = 4) -> DataFrame:
    """Components of four or more lose the listed members, and stay if two are left; smaller ones don't change."""
    size = comps.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    listed = removals.select(F.col("ticket_id").alias("node"), F.lit(True).alias("listed")).distinct()
    rows = comps.join(size, "component").join(listed, "node", "left")
    kept = rows.filter(F.col("listed").isNull() | (F.col("n") < at_least)).select("node", "component")
    left = kept.groupBy("component").agg(F.count(F.lit(1)).alias("m")).filter("m >= 2").select("component")
    return kept.join(left, "component", "left_semi").select("node", "component")


def pool_proposals(st: DataFrame, vectors: DataFrame, pairs: DataFrame, verdicts: DataFrame, removals: DataFrame, floor: float = 0.40, auto: float = 0.90, top: int = 10, min_size: int = 3, min_sim: float = 0.45, cap: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ticket_id, service), (ticket_id, embedding) and similar pairs inside offerings (nearest_pairs are enough) -> (proposals, needs_review), a row for each component, and the members of both, a row each."""
    edges = cut(accepted_edges(topn_neighbours(pairs, top, floor), verdicts, auto))
    edges = cut(oversize_guard(edges, connected_components(edges), verdicts))
    comps = cut(drift_prune(connected_components(edges), removals))
    size = comps.groupBy("component").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") >= min_size).select("component")
    members = cut(comps.join(size, "component", "left_semi").select("component", F.col("node").alias("ticket_id")))
    named = members.join(st.select("ticket_id", "service"), "ticket_id")
    flags = aggs.member_purity_flags(named.withColumnRenamed("component", "cluster_id")).withColumnRenamed("cluster_id", "component")
    gate = cut(aggs.cohesion_gate(members, vectors, flags, min_sim=min_sim, cap=cap))
    return gate.filter("passed"), gate.filter(~F.col("passed")), members
