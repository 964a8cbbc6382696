"""Joins over tickets, clusters, members and the taxonomy.

Dimension tables (taxonomy, clusters) are joined without hints where Spark knows their size; a side is
broadcast by hint only after its rows were counted (`small`). Tables from explode are joined by merge, as
their size cannot be estimated.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketflow.functions import scalars as S
from ticketflow.operators import scan
from ticketflow.operators.lineage import cut
from ticketflow.operators.vectors import Index, best_groups, build_index, close_pairs, unit

SMALL_ROWS = 200_000


def small(df: DataFrame, limit: int = SMALL_ROWS) -> DataFrame:
    """The table with a broadcast hint if it has few rows, else with a merge join hint."""
    return df.hint("broadcast" if df.limit(limit + 1).count() <= limit else "merge")


def member_details(mb: DataFrame, st: DataFrame) -> DataFrame:
    """Members with their tickets, in order of assignment."""
    rows = mb.select("cluster_id", "ticket_id", "assigned_by", "assigned_at").join(st, "ticket_id")
    return scan.numbered(rows, ["cluster_id"], ["assigned_at", "ticket_id"], "position")


def member_vectors(mb: DataFrame, st: DataFrame) -> DataFrame:
    """Members that have a vector and a ticket."""
    return mb.filter(F.col("embedding").isNotNull()).join(st.select("ticket_id"), "ticket_id").select("cluster_id", "ticket_id", "embedding")


def unassigned_pool(st: DataFrame, mb: DataFrame, kinds: Sequence[str] = S.CLUSTER_KINDS) -> DataFrame:
    """Tickets of eligible kinds in no cluster of any status."""
    return st.filter(S.ticket_kind(F.col("ticket_kind")).isin(*kinds)).join(mb.select("ticket_id"), "ticket_id", "left_anti")


def cluster_of_ticket(mb: DataFrame, cl: DataFrame) -> DataFrame:
    """Each member ticket with its cluster."""
    return mb.select("ticket_id", "cluster_id").join(cl, "cluster_id")


def pool_details(pool: DataFrame, st: DataFrame) -> DataFrame:
    """Pool rows with what is known of their ticket."""
    return pool.join(st.select("ticket_id", "title", "service"), "ticket_id", "left")


def queue_details(queue: DataFrame, st: DataFrame) -> DataFrame:
    """Open review rows with titles, '' where the ticket is missing."""
    return queue.filter(~F.col("reviewed")).join(st.select("ticket_id", "title"), "ticket_id", "left").withColumn("title", F.coalesce("title", F.lit("")))


def proposal_details(props: DataFrame, st: DataFrame) -> DataFrame:
    """Proposals with their members' titles, in the members' order."""
    each = props.select("proposal_id", F.posexplode("member_ids").alias("position", "ticket_id")).hint("merge").join(st.select("ticket_id", "title", "service"), "ticket_id", "left")
    rows = each.groupBy("proposal_id").agg(F.array_sort(F.collect_list(F.struct("position", "ticket_id", "title", "service"))).alias("members"))
    return rows


def lookup_by_reference(st: DataFrame, refs: DataFrame) -> DataFrame:
    """The newest ticket whose source ids hold the reference."""
    each = st.select("ticket_id", "created_at", F.explode("source_ticket_ids").alias("reference"))
    hits = each.hint("merge").join(refs.select("reference").distinct(), "reference")
    return hits.groupBy("reference").agg(F.max_by("ticket_id", F.struct("created_at", "ticket_id")).alias("ticket_id"))


def cross_system_members(mb: DataFrame, cl: DataFrame, st: DataFrame) -> DataFrame:
    """Members whose ticket's system is not their cluster's; clusters without a system are exempt."""
    rows = mb.select("cluster_id", "ticket_id").join(cl.select("cluster_id", F.trim("affected_system").alias("cluster_system")), "cluster_id")
    rows = rows.filter("cluster_system <> ''").join(st.select("ticket_id", S.system_of(F.col("affected_system")).alias("ticket_system")), "ticket_id")
    return rows.filter("cluster_system <> ticket_system")


def prefixes(service: Column) -> Column:
    """All prefixes of a text that end before a dot, and the text itself."""
    parts = F.split(service, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))


def split_service(df: DataFrame, tx: DataFrame) -> DataFrame:
    """The longest taxonomy service that equals `service` or is a prefix of it before a dot, and the rest as offering.

    A prefix condition would be a nested loop; exploding each value's few prefixes makes it an equi
    join. Only distinct values take part, so a service that many tickets share is matched once.
    """
    values = df.select("service").filter("service is not null").distinct()
    keys = tx.select(F.col("service").alias("key")).distinct()
    hit = values.select("service", F.explode(prefixes(F.col("service"))).alias("key")).hint("merge").join(keys, "key")
    best = hit.groupBy("service").agg(F.max_by("key", F.length("key")).alias("service_key"))
    out = df.join(small(best), "service", "left")
    rest = F.expr("substring(service, length(service_key) + 2)")
    return out.withColumn("offering", F.nullif(rest, F.lit(""))).withColumn("service_key", F.coalesce("service_key", "service"))


def taxonomy_audit(st: DataFrame, tx: DataFrame) -> DataFrame:
    """Each distinct service value with its verdict."""
    rows = split_service(st.select("service").distinct(), tx)
    known = tx.select(F.col("service").alias("service_key"), F.col("offering").alias("known_offering")).filter("known_offering is not null").distinct()
    keys = tx.select(F.col("service").alias("service_key")).distinct().withColumn("is_key", F.lit(True))
    rows = rows.join(keys.hint("merge"), "service_key", "left").join(known.hint("merge"), (rows["service_key"] == known["service_key"]) & (rows["offering"] == F.col("known_offering")), "left").drop(known["service_key"])
    verdict = F.when(F.col("is_key").isNull(), "INVALID").when(F.col("offering").isNull(), "OK-bare").when(F.col("offering") == S.GAP[1:], "OK-gap").when(F.col("known_offering").isNotNull(), "OK-offering").otherwise("INVALID")
    return rows.select("service", verdict.alias("verdict"))


def validate_service(df: DataFrame, tx: DataFrame) -> DataFrame:
    """(ticket_id, affected_system, service) with the owning system put right, or a reason for rejection."""
    rows = split_service(df, tx)
    owner = tx.groupBy(F.col("service").alias("service_key")).agg(F.min("system").alias("owner"), F.collect_set("offering").alias("offerings"))
    rows = rows.join(owner.hint("merge"), "service_key", "left")
    ok = F.col("offering").isNull() | (F.col("offering") == S.GAP[1:]) | F.array_contains("offerings", F.col("offering"))
    reason = F.when(F.col("owner").isNull(), "unknown service").when(~ok, "unknown offering")
    return rows.select("ticket_id", "service", F.when(reason.isNull(), F.col("owner")).alias("system"), (reason.isNull() & ~F.col("affected_system").eqNullSafe(F.col("owner"))).alias("corrected"), reason.alias("reason"))


def snap_service(df: DataFrame, tx: DataFrame, system_pattern: str) -> DataFrame:
    """(affected_system, service) with the taxonomy service it means: exact, as prefix, or by an unambiguous core; else null."""
    keys = tx.select(F.col("system").alias("affected_system"), F.col("service").alias("key")).distinct()
    values = df.select("affected_system", "service").distinct()
    hit = values.select("affected_system", "service", F.explode(prefixes(F.trim("service"))).alias("key")).hint("merge").join(keys, ["affected_system", "key"])
    exact = hit.groupBy("affected_system", "service").agg(F.max_by("key", F.length("key")).alias("by_prefix"))
    core = keys.withColumn("core", S.service_core(F.col("key"), system_pattern)).filter("core <> ''").groupBy("affected_system", "core").agg(F.count("*").alias("n"), F.min("key").alias("by_core")).filter("n = 1").drop("n")
    out = values.withColumn("core", S.service_core(F.col("service"), system_pattern)).join(core.hint("merge"), ["affected_system", "core"], "left").join(exact.hint("merge"), ["affected_system", "service"], "left")
    found = out.select("affected_system", "service", F.coalesce("by_prefix", "by_core").alias("snapped"))
    return df.join(found.hint("merge"), ["affected_system", "service"], "left")


def generic_service(tx: DataFrame) -> DataFrame:
    """Each system's catch-all service."""
    first = F.min(F.when(F.startswith(F.lower("service"), F.lit("system/application")), F.col("service")))
    return tx.groupBy("system").agg(F.coalesce(first, F.min("service"), F.lit(S.GENERAL)).alias("generic"))


def pinned_system(df: DataFrame, tx: DataFrame, system_pattern: str) -> DataFrame:
    """A given valid system wins and its service is snapped onto it; an invalid one becomes null."""
    known = generic_service(tx).withColumnRenamed("system", "pinned")
    rows = df.withColumn("pinned_as", F.trim("affected_system")).join(known, F.col("pinned_as") == F.col("pinned"), "left")
    snapped = snap_service(rows.select("ticket_id", F.col("pinned").alias("affected_system"), "service"), tx, system_pattern).select("ticket_id", "snapped")
    return rows.join(snapped.hint("merge"), "ticket_id", "left").select("ticket_id", "pinned", F.when(F.col("pinned").isNotNull(), F.coalesce("snapped", "generic")).otherwise(F.col("service")).alias("service"))


def block_pairs(vec: DataFrame, floor: float, block: str) -> DataFrame:
    """Unordered pairs of one block with a cosine of `floor` or more; blocks are cut into cells and tiles, which are multiplied as matrices."""
    return close_pairs(vec.select(F.col("vec_id").alias("id"), F.col(block).alias("block"), unit("embedding").alias("v")), floor)


def similar_pairs(vec: DataFrame, floor: float = 0.40, block: str | None = None) -> DataFrame:
    """block_pairs; without a block all vectors form one."""
    return block_pairs(vec if block else vec.withColumn("all", F.lit(0)), floor, block or "all").select("a", "b", "sim")


def nearest_pairs(vec: DataFrame, n: int = 10, floor: float = 0.40, block: str | None = None) -> DataFrame:
    """W3 over vectors: topn_neighbours of similar_pairs, exact, without a row for each pair."""
    v = vec.select(F.col("vec_id").alias("query"), (F.col(block) if block else F.lit(0)).alias("block"), unit("embedding").alias("v"))
    best = best_groups(v, build_index(v.withColumnRenamed("query", "grp")), n, floor, apart=True)
    return best.groupBy(F.least("query", "grp").alias("a"), F.greatest("query", "grp").alias("b")).agg(F.max("score").alias("sim"))


def vector_index(vec: DataFrame) -> Index:
    """(vec_id, embedding) as an index for knn_similar."""
    return build_index(vec.select(F.lit(0).alias("block"), F.col("vec_id").alias("grp"), unit("embedding").alias("v")))


def knn_similar(queries: DataFrame, vec: DataFrame | Index, threshold: float = 0.80, k: int = 5) -> DataFrame:
    """Of each query the k nearest other vectors with a cosine of `threshold` or more, exact; `vec` may be an index that was built before."""
    index = vec if isinstance(vec, Index) else vector_index(vec)
    q = queries.select(F.col("vec_id").alias("query"), F.lit(0).alias("block"), unit("embedding").alias("v"))
    return best_groups(q, index, k, threshold, apart=True).select(F.col("query").alias("query_id"), F.col("grp").alias("vec_id"), F.col("score").alias("sim"), "rank")


def centroids(mb: DataFrame) -> DataFrame:
    """Normalised mean of the normalised member vectors of each cluster; null for a zero sum."""
    rows = mb.select("cluster_id", unit("embedding").alias("v")).filter("v is not null")
    mean = rows.groupBy("cluster_id").agg(vector_to_array(Summarizer.mean(array_to_vector("v"))).alias("c"))
    return mean.select("cluster_id", F.when(S.norm(F.col("c")) > 0, S.l2_normalize(F.col("c"))).alias("centroid"))


def cluster_index(cl: DataFrame, mb: DataFrame) -> Index:
    """Centroids and members of active clusters, by system, as an index that many shortlists can use."""
    active = cl.filter("status = 'active'").select("cluster_id", S.system_of(F.col("affected_system")).alias("block"))
    points = centroids(mb).filter("centroid is not null").select("cluster_id", F.col("centroid").alias("v")).unionByName(mb.select("cluster_id", unit("embedding").alias("v")))
    return build_index(points.join(active, "cluster_id").select("block", F.col("cluster_id").alias("grp"), "v"))


def shortlist(st: DataFrame, index: Index, vetoes: DataFrame | None = None, k: int = 5, veto_first: bool = False) -> DataFrame:
    """Of each (ticket_id, affected_system, embedding) the k clusters of its system with the best score: the larger of the cosine to the centroid and to the best member.

    Vetoed clusters go after the cut, or before it with `veto_first`.
    """
    t = st.select(F.col("ticket_id").alias("query"), S.system_of(F.col("affected_system")).alias("block"), unit("embedding").alias("v"))
    early = vetoes is not None and veto_first
    more = (vetoes.groupBy("ticket_id").agg(F.countDistinct("cluster_id").alias("c")).agg(F.max("c")).first()[0] or 0) if early else 0
    top = best_groups(t, index, k + more).select(F.col("query").alias("ticket_id"), F.col("grp").alias("cluster_id"), "score", "rank")
    if vetoes is not None:
        top = top.join(vetoes, ["ticket_id", "cluster_id"], "left_anti")
    if early:
        w = Window.partitionBy("ticket_id").orderBy("rank")
        top = top.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return top


def candidate_clusters(st: DataFrame, cl: DataFrame, mb: DataFrame, vetoes: DataFrame | None = None, k: int = 5, veto_first: bool = False) -> DataFrame:
    """Shortlist over an index of the clusters as they are."""
    return shortlist(st, cluster_index(cl, mb), vetoes, k, veto_first)


def exemplar_match(st: DataFrame, exemplars: DataFrame, threshold: float = 0.60) -> DataFrame:
    """The best exemplar of the ticket's own offering; below `threshold` the ticket goes to the pool. Ties go to the smaller group."""
    t = st.select(F.col("ticket_id").alias("query"), F.coalesce(S.offering_key(F.col("service")), F.lit(S.NO_OFFERING)).alias("block"), unit("embedding").alias("v"))
    index = build_index(exemplars.select(F.col("offering").alias("block"), F.col("group_id").alias("grp"), unit("embedding").alias("v")))
    best = best_groups(t, index, 1).select(F.col("query").alias("ticket_id"), F.col("grp").alias("best"), F.col("score").alias("sim"))
    hit = F.col("sim") >= threshold
    out = t.select(F.col("query").alias("ticket_id"), F.col("block").alias("offering")).join(best, "ticket_id", "left")
    return out.select("ticket_id", "offering", F.when(hit, F.col("best")).alias("group_id"), "sim", F.when(hit, "matched").otherwise("pool").alias("outcome"))


def cross_group_match(st: DataFrame, exemplars: DataFrame, threshold: float = 0.75) -> DataFrame:
    """The best exemplar of any offering, if it is close enough."""
    t = st.select(F.col("ticket_id").alias("query"), F.lit(0).alias("block"), unit("embedding").alias("v"))
    index = build_index(exemplars.select(F.lit(0).alias("block"), F.col("group_id").alias("grp"), unit("embedding").alias("v")))
    return best_groups(t, index, 1, threshold).select(F.col("query").alias("ticket_id"), F.col("grp").alias("group_id"), F.col("score").alias("sim"))


def verdict_coverage(presented: DataFrame, returned: DataFrame) -> DataFrame:
    """(batch, ticket_id) shown and answered -> per batch missing, invented and repeated ids, and whether it is accepted."""
    p = presented.select("batch", "ticket_id").distinct().withColumn("shown", F.lit(1))
    r = returned.groupBy("batch", "ticket_id").agg(F.count(F.lit(1)).alias("times"))
    rows = p.join(r, ["batch", "ticket_id"], "full_outer")
    out = rows.groupBy("batch").agg(F.count_if(F.col("times").isNull()).alias("missing"), F.count_if(F.col("shown").isNull()).alias("invented"), F.count_if(F.col("times") > 1).alias("repeated"))
    return out.withColumn("accepted", (F.col("missing") == 0) & (F.col("invented") == 0) & (F.col("repeated") == 0))


def remint_guard(groups: DataFrame, cl: DataFrame, vetoes: DataFrame) -> DataFrame:
    """(group_id, system, name, ticket_id) groups that a cluster of the same name and system has evicted a member of."""
    named = cl.select("cluster_id", S.system_of(F.col("affected_system")).alias("system"), F.trim("name").alias("name"))
    rows = groups.select("group_id", "system", F.trim("name").alias("name"), "ticket_id").filter("name <> ''").join(named, ["system", "name"]).join(vetoes, ["ticket_id", "cluster_id"])
    return rows.groupBy("group_id").agg(F.min("cluster_id").alias("blocked_by"))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Clusters whose dominant system or service changed."""
    b = before.select("cluster_id", F.col("system").alias("old_system"), F.col("service").alias("old_service"))
    rows = b.join(after.select("cluster_id", "system", "service"), "cluster_id")
    return rows.filter(~F.col("system").eqNullSafe(F.col("old_system")) | ~F.col("service").eqNullSafe(F.col("old_service")))


def prediction_vs_truth(df: DataFrame, tx: DataFrame) -> DataFrame:
    """Match flags of model and user at three levels; the offering flag is null where the truth has none."""
    out, values = df, None
    for who in ("true", "model", "user"):
        more = df.select(F.col(f"{who}_service").alias("service"))
        values = more if values is None else values.unionByName(more)
    split = small(cut(split_service(values.distinct(), tx)))
    for who in ("true", "model", "user"):
        out = out.join(split.select(F.col("service").alias(f"{who}_service"), F.col("service_key").alias(f"{who}_key"), F.col("offering").alias(f"{who}_offering")), f"{who}_service", "left")
    flags = []
    for who in ("model", "user"):
        flags += [F.col(f"{who}_system").eqNullSafe(F.col("true_system")).alias(f"{who}_system_ok"), F.col(f"{who}_key").eqNullSafe(F.col("true_key")).alias(f"{who}_service_ok"), F.when(F.col("true_offering").isNotNull(), F.col(f"{who}_key").eqNullSafe(F.col("true_key")) & F.col(f"{who}_offering").eqNullSafe(F.col("true_offering"))).alias(f"{who}_offering_ok")]
    return out.select("ticket_id", "true_system", *flags)


def rerun_agreement(a: DataFrame, b: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Share of tickets on which two runs agree, for each field."""
    rows = a.select("ticket_id", *[F.col(f).alias(f"a_{f}") for f in fields]).join(b.select("ticket_id", *[F.col(f).alias(f"b_{f}") for f in fields]), "ticket_id")
    same = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").eqNullSafe(F.col(f"b_{f}")).alias("same")) for f in fields])).alias("x")
    return rows.select(same).groupBy("x.field").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("x.same").cast("double")), 6).alias("agreement"))
