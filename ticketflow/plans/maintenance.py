"""Compositions: sweep of the unassigned pool (M19) and re-pooling by offering."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketflow.functions import scalars as S
from ticketflow.operators import aggs, graph, joins, state, windows


def sweep(st: DataFrame, cl: DataFrame, mb: DataFrame, lg: DataFrame, embeddings: DataFrame, now: Column, min_score: float, answer: Callable[[DataFrame], DataFrame] | None = None, status: str = "proposed") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Demote, evict, shortlist the eligible pool without vetoed clusters, assign what scores at least `min_score`, batch the rest by system and group it.

    The assignment is the best score's, where a user has no verdicts to join. `answer` turns the batches, (batch, ticket_id), into
    group verdicts (batch, group_no, name, ticket_id), which M4 applies; without it the rest stays in its batches. Returns
    clusters and members, with text ids, and one row of figures.
    """
    cl, mb, demoted = state.demote_small(cl, mb)
    mb, evicted = state.evict_cross_system(cl, mb, st)
    cl, mb, vetoes = graph.cut(cl), graph.cut(mb), graph.cut(windows.live_vetoes(lg, now))
    pool = joins.unassigned_pool(st, mb).join(embeddings, "ticket_id")
    cards = graph.cut(joins.candidate_clusters(pool, cl, mb, vetoes))
    best = cards.groupBy("ticket_id").agg(F.max(F.struct("score", (-F.col("cluster_id")).alias("c"))).alias("b")).select("ticket_id", F.lit("assign").alias("action"), (-F.col("b.c")).alias("cluster_id"), F.when(F.col("b.score") >= min_score, "high").otherwise("low").alias("confidence"))
    cl, members, log = state.apply_assign_verdicts(cl, mb, st, cards, graph.cut(best))
    cl, members = graph.cut(cl), graph.cut(members)
    left = windows.batch_assign(joins.unassigned_pool(st, members).select("ticket_id", S.system_of(F.col("affected_system")).alias("system")), 20, ["system"], ["ticket_id"])
    batches = graph.cut(left.select(F.concat_ws("|", "system", "batch").alias("batch"), "ticket_id"))
    groups = graph.cut(answer(batches)) if answer else batches.limit(0).select("batch", F.lit(None).cast("long").alias("group_no"), F.lit(None).cast("string").alias("name"), "ticket_id")
    shown = batches.join(groups.select("batch").distinct(), "batch", "left_semi")
    cl, members, verdicts = state.apply_group_verdicts(cl, members, st, shown, groups, vetoes, status)
    figures = demoted.agg(F.count(F.lit(1)).alias("demoted")).crossJoin(evicted.agg(F.count(F.lit(1)).alias("evicted"))).crossJoin(log.agg(F.count_if(F.col("outcome") == "assign").alias("assigned"))).crossJoin(batches.agg(F.count(F.lit(1)).alias("pool"), F.countDistinct("batch").alias("batches"))).crossJoin(verdicts.agg(F.count_if(F.col("reason").isNull()).alias("groups"), F.count_if(F.col("reason") == "evicted before").alias("veto_skipped"), F.count_if(F.col("reason") == "several services").alias("service_skipped")))
    return cl, members, figures


def repool(st: DataFrame, embeddings: DataFrame, exemplars: DataFrame, own: float = 0.60, cross: float = 0.75, min_count: int = 3, verdicts: DataFrame | None = None, removals: DataFrame | None = None, **proposing) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Match tickets to exemplars of their offering, then to any at a stricter threshold; propose groups from the pools of `min_count` tickets or more that are left.

    `verdicts` and `removals` are those of pool_proposals (none: pairs are joined by similarity alone), `proposing` its other
    arguments. Returns the sizes of the pools, proposals, proposals to review, the members of both, and one row of figures. Nothing is
    changed: decide_pool_proposals does that with the decisions on what is returned here.
    """
    t = st.join(embeddings, "ticket_id")
    first = graph.cut(joins.exemplar_match(t, exemplars, own))
    rest = t.join(first.filter("outcome = 'pool'").select("ticket_id"), "ticket_id", "left_semi")
    second = graph.cut(joins.cross_group_match(rest, exemplars, cross))
    pool = graph.cut(rest.join(second.select("ticket_id"), "ticket_id", "left_anti").withColumn("offering", F.coalesce(S.offering_key(F.col("service")), F.lit(S.NO_OFFERING))))
    sizes = aggs.pool_sizes(pool, min_count)
    open_ = pool.join(sizes.select("offering"), "offering", "left_semi")
    pairs = graph.cut(joins.nearest_pairs(open_.withColumnRenamed("ticket_id", "vec_id"), proposing.get("top", 10), proposing.get("floor", 0.40), "offering"))
    verdicts = pairs.limit(0).select("a", "b", F.lit("YES").alias("verdict"), F.lit("YES").alias("second")) if verdicts is None else verdicts
    removals = pool.limit(0).select("ticket_id") if removals is None else removals
    good, review, members = graph.pool_proposals(open_, open_, pairs, verdicts, removals, **proposing)
    figures = first.agg(F.count_if(F.col("outcome") == "matched").alias("own_matched")).crossJoin(second.agg(F.count(F.lit(1)).alias("cross_matched"))).crossJoin(pool.agg(F.count(F.lit(1)).alias("left"))).crossJoin(good.agg(F.count(F.lit(1)).alias("proposals"))).crossJoin(review.agg(F.count(F.lit(1)).alias("needs_review")))
    return sizes, good, review, members, figures
