"""Aggregations for reports and quality figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketflow.functions import scalars as S
from ticketflow.operators.joins import centroids, unassigned_pool
from ticketflow.operators.scan import numbered
from ticketflow.operators.vectors import unit


def joined(ids: Column) -> Column:
    """A group's sorted ids in one row, for groups that fit a row; for others take the rows that the functions beside offer."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(ids)), lambda x: x.cast("string")), ",")


def _worst() -> Column:
    return S.severity_name(F.max(S.severity_rank(F.coalesce("severity", F.lit("Minor")))))


def _by_subsystem(st: DataFrame) -> DataFrame:
    active = st.filter((S.local_status(F.col("source_status")) == "active") & S.ticket_kind(F.col("ticket_kind")).isin(*S.CLUSTER_KINDS))
    return active.select(S.system_of(F.col("affected_system")).alias("system"), S.system_of(F.col("service")).alias("service"), "ticket_id", "severity")


def subsystem_rollup(st: DataFrame, min_count: int = 2, ids: bool = False) -> DataFrame:
    """A1: active tickets of eligible kinds by system and service: count and worst severity; `ids`: also their ids in one row."""
    more = [joined(F.col("ticket_id")).alias("ids")] if ids else []
    return _by_subsystem(st).groupBy("system", "service").agg(F.count(F.lit(1)).alias("n"), _worst().alias("worst"), *more).filter(F.col("n") >= min_count)


def subsystem_tickets(st: DataFrame, min_count: int = 2) -> DataFrame:
    """A1: the tickets behind subsystem_rollup, a row each."""
    large = subsystem_rollup(st, min_count).select("system", "service")
    return _by_subsystem(st).select("system", "service", "ticket_id").join(large, ["system", "service"], "left_semi")


def worst_severity(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """A2: worst severity of each group; an absent one counts as Minor."""
    return df.groupBy(*by).agg(S.severity_name(F.max(S.severity_rank(F.coalesce("severity", F.lit("Minor"))))).alias("worst"))


def mode_label(df: DataFrame, by: Sequence[str], value: Column, name: str = "label") -> DataFrame:
    """The most frequent non-null value of each group; ties go to the smaller value. Counts first, so that a hot group is reduced before it meets."""
    counts = df.withColumn(name, value).filter(F.col(name).isNotNull()).groupBy(*by, name).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), name)
    return counts.withColumn("r", F.row_number().over(w)).filter("r = 1").select(*by, name)


def dominant_labels(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """A3: most frequent system and service of each group."""
    return mode_label(df, by, S.system_of(F.col("affected_system")), "system").join(mode_label(df, by, S.blank_to_null(F.col("service")), "service"), list(by), "left")


def centroid_similarity(mb: DataFrame) -> DataFrame:
    """Each member's cosine to its cluster's centroid; null for clusters with fewer than two vectors."""
    n = mb.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    rows = mb.select("cluster_id", "ticket_id", F.col("embedding").cast("array<double>").alias("v")).join(centroids(mb), "cluster_id").join(n, "cluster_id")
    return rows.select("cluster_id", "ticket_id", F.when((F.col("n") >= 2) & F.col("centroid").isNotNull(), F.round(S.cosine(F.col("v"), F.col("centroid")), 3)).alias("similarity"))


def cluster_summary(cl: DataFrame, mb: DataFrame, st: DataFrame, min_members: int = 2, ids: bool = False) -> DataFrame:
    """A5: active clusters with members: system, service, worst severity and count; `ids`: also their members' ids in one row."""
    rows = cl.filter("status = 'active'").select("cluster_id", "name", F.col("affected_system").alias("own_system")).join(mb.select("cluster_id", "ticket_id"), "cluster_id").join(st.select("ticket_id", "affected_system", "service", "severity"), "ticket_id")
    more = [joined(F.col("ticket_id")).alias("ids")] if ids else []
    base = rows.groupBy("cluster_id", "name", "own_system").agg(F.count(F.lit(1)).alias("n"), _worst().alias("worst"), *more)
    out = base.filter(F.col("n") >= min_members).join(dominant_labels(rows, ["cluster_id"]), "cluster_id", "left")
    return out.select("cluster_id", "name", F.coalesce(S.blank_to_null(F.col("own_system")), "system").alias("system"), "service", "worst", "n", *(["ids"] if ids else []))


def cluster_report(cl: DataFrame, mb: DataFrame, st: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A4: A5 with names and texts, its members with their similarity in percent, a row each, and one row of totals.

    A cluster without a name takes `name_en`, then "Cluster"; without a description, its name. `place` ranks by members, largest first.
    """
    blank = lambda c: S.blank_to_null(F.col(c)) if c in cl.columns else F.lit(None).cast("string")
    name = F.coalesce(blank("name"), blank("name_en"), F.lit("Cluster"))
    labels = cl.select("cluster_id", name.alias("name"), F.coalesce(blank("description"), name).alias("description"))
    summary = cluster_summary(cl, mb, st).drop("name").join(labels, "cluster_id")
    summary = summary.withColumn("summary", F.concat_ws(" — ", F.concat("n", F.lit(" tickets")), "name"))
    ranked = summary.select("cluster_id", "n").withColumn("one", F.lit(0))
    place = numbered(ranked.withColumn("less", -F.col("n")), ["one"], ["less", "cluster_id"], "place").select("cluster_id", "place")
    summary = summary.join(place, "cluster_id")
    sim = centroid_similarity(mb.join(st.select("ticket_id"), "ticket_id", "left_semi"))
    members = sim.join(summary.select("cluster_id"), "cluster_id", "left_semi").select("cluster_id", "ticket_id", F.round(F.col("similarity") * 100, 1).alias("percent"))
    totals = st.agg(F.count(F.lit(1)).alias("tickets")).crossJoin(summary.agg(F.count(F.lit(1)).alias("clusters"), F.coalesce(F.sum("n"), F.lit(0)).alias("clustered")))
    return summary, members, totals


def status_summary(st: DataFrame, cl: DataFrame, mb: DataFrame) -> DataFrame:
    """One row of counts."""
    active = S.local_status(F.col("source_status")) == "active"
    t = st.agg(F.count(F.lit(1)).alias("tickets"), F.count_if(F.col("classification_status") != "failed").alias("ok"), F.count_if(F.col("classification_status") == "failed").alias("failed"), F.count_if(active).alias("active"), F.count_if(~active).alias("resolved"))
    c = cl.agg(F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("status") == "active").alias("clusters_active"), F.count_if(F.col("status") == "proposed").alias("clusters_proposed"))
    return t.crossJoin(c).crossJoin(unassigned_pool(st, mb).agg(F.count(F.lit(1)).alias("unassigned")))


def gap_rollup(events: DataFrame) -> DataFrame:
    """(service, suggested_offering, ref, at) -> count, first and last sighting. The refs, in order of `at`, are the events' own rows."""
    return events.groupBy("service", "suggested_offering").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"))


def occurrence_rollup(df: DataFrame, key: str) -> DataFrame:
    """Sightings of each key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("occurrence_count"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"))


def occurrence_ids(df: DataFrame, key: str) -> DataFrame:
    """The source ids of each key, a row each."""
    return df.select(key, "ticket_id").distinct()


def accuracy_report(flags: DataFrame, names: Sequence[str]) -> DataFrame:
    """A10: right and judged counts of each flag, overall and by true system, in one pass over grouping sets; null flags don't count."""
    aggs = [a for f in names for a in (F.sum(F.col(f).cast("int")).alias(f"{f}_n"), F.count(f).alias(f"{f}_d"))]
    rows = flags.groupingSets([["true_system"], []], "true_system").agg(F.grouping("true_system").cast("int").alias("overall"), *aggs)
    for f in names:
        rows = rows.withColumn(f"{f}_pct", F.when(F.col(f"{f}_d") > 0, F.round(100.0 * F.col(f"{f}_n") / F.col(f"{f}_d"), 1)))
    return rows


def attachment_accuracy(got: DataFrame, truth: DataFrame) -> DataFrame:
    """(file, field, values) against (file, field, values): per field correct, missed, invented values."""
    rows = truth.select("file", "field", F.col("values").alias("t")).join(got.select("file", "field", F.col("values").alias("g")), ["file", "field"], "full_outer")
    none = F.array().cast("array<string>")
    t, g = F.coalesce("t", none), F.coalesce("g", none)
    return rows.groupBy("field").agg(F.sum(F.size(F.array_intersect(t, g))).alias("correct"), F.sum(F.size(F.array_except(t, g))).alias("missed"), F.sum(F.size(F.array_except(g, t))).alias("invented"))


def attachment_stats(df: DataFrame) -> DataFrame:
    """Files, distinct contents, share that a cache would answer, files with a signal and their share."""
    n = F.count(F.lit(1))
    signal = F.count_if(F.col("has_signal"))
    return df.agg(n.alias("files"), F.countDistinct("sha").alias("unique_files"), F.round(1 - F.countDistinct("sha") / n, 6).alias("hit_rate"), signal.alias("with_signal"), F.round(signal / n, 4).alias("signal_share"))


def attachment_counts(df: DataFrame, top: int = 50) -> DataFrame:
    """(quality, status, page, codes, types) of files -> list, value, n: files by quality and by status, and the `top` most frequent pages, signal codes and object types."""
    page = S.blank_to_null(S.normalize_page(F.col("page")))
    lists = [("quality", F.array("quality")), ("status", F.array("status")), ("page", F.array(page)), ("code", F.col("codes")), ("type", F.transform("types", lambda x: F.coalesce(S.blank_to_null(x), F.lit("(empty)"))))]
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(name).alias("list"), v.alias("v")) for name, v in lists])).alias("x")).select("x.list", F.explode("x.v").alias("value"))
    counts = rows.filter("value is not null and value <> ''").groupBy("list", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("list").orderBy(F.desc("n"), "value")
    return counts.withColumn("place", F.row_number().over(w)).filter(F.col("list").isin("quality", "status") | (F.col("place") <= top)).drop("place")


def member_purity_flags(mb: DataFrame) -> DataFrame:
    """(cluster_id, ticket_id, service): flagged unless the service's count exceeds the third-ranked count (0 with fewer services)."""
    counts = mb.groupBy("cluster_id", "service").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("cluster_id").orderBy(F.desc("n"), "service").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kept = counts.withColumn("third", F.coalesce(F.nth_value("n", 3).over(w), F.lit(0))).select("cluster_id", "service", (F.col("n") <= F.col("third")).alias("flagged"))
    return mb.join(kept, ["cluster_id", "service"])


def cohesion(comps: DataFrame, vectors: DataFrame) -> DataFrame:
    """(component, ticket_id), (ticket_id, embedding) -> component, mean_sim: the mean cosine over all pairs of members with a vector, null with fewer than two.

    Over all pairs the cosines sum to (|sum of unit vectors|^2 - sum of their squares) / 2, so one vector
    aggregate for each component takes the place of its pairs.
    """
    rows = comps.select("component", "ticket_id").join(vectors.select("ticket_id", unit("embedding").alias("v")).filter("v is not null"), "ticket_id")
    sums = rows.groupBy("component").agg(vector_to_array(Summarizer.sum(array_to_vector("v"))).alias("s"), F.count(F.lit(1)).alias("m"), F.sum(S.dot(F.col("v"), F.col("v"))).alias("own"))
    return sums.select("component", F.when(F.col("m") > 1, F.round((S.dot(F.col("s"), F.col("s")) - F.col("own")) / (F.col("m") * (F.col("m") - 1)), 6)).alias("mean_sim"))


def cohesion_gate(comps: DataFrame, vectors: DataFrame, flags: DataFrame, min_sim: float = 0.45, max_services: int = 6, cap: int | None = None) -> DataFrame:
    """(component, ticket_id), (ticket_id, embedding), (component, ticket_id, service, flagged) -> figures and whether a component passes.

    A component of one vector or none has no cohesion (0.0) and fails; members without a service count as one service more.
    """
    size = comps.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    f = flags.groupBy("component").agg(F.count_if("flagged").alias("flagged"), F.countDistinct(F.coalesce(F.col("service").cast("string"), F.lit("?"))).alias("services"))
    rows = size.join(cohesion(comps, vectors), "component", "left").join(f, "component", "left").na.fill({"mean_sim": 0.0, "flagged": 0, "services": 0})
    out = (F.col("flagged") >= F.greatest(F.lit(1), F.floor(F.col("n") / 3))) | (F.col("mean_sim") < min_sim) | (F.col("services") > max_services)
    return rows.withColumn("passed", ~(out if cap is None else out | (F.col("n") > cap)))


def majority_vote(runs: DataFrame, fields: Sequence[str], min_votes: int = 2) -> DataFrame:
    """(ticket_id, run, fields) -> per ticket and field the value with at least `min_votes`; needs_review without one."""
    stacked = runs.select("ticket_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("x")).select("ticket_id", "x.field", "x.value")
    votes = stacked.groupBy("ticket_id", "field", "value").agg(F.count(F.lit(1)).alias("n"))
    enough = (F.col("n") >= min_votes) & F.col("value").isNotNull()
    best = votes.groupBy("ticket_id", "field").agg(F.max(F.when(enough, F.struct("n", "value"))).alias("b"))
    return best.select("ticket_id", "field", F.col("b.value").alias("value"), F.col("b").isNull().alias("needs_review"))


def manager_kpis(cl: DataFrame, mb: DataFrame, st: DataFrame) -> DataFrame:
    """The dashboard's figures in one row."""
    s = cluster_summary(cl, mb, st)
    c = s.agg(F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("worst") == "Critical").alias("critical"), F.countDistinct("system").alias("systems"), F.coalesce(F.sum("n"), F.lit(0)).alias("grouped"))
    t = st.agg(F.count(F.lit(1)).alias("tickets"))
    open_ = F.col("tickets") - F.col("grouped")
    pct = lambda a, b: F.when(b > 0, F.round(100.0 * a / b, 1)).otherwise(F.lit(0.0))
    rows = t.crossJoin(c)
    replies = F.greatest(F.lit(1), F.round(2.5 * F.col("clusters")).cast("long"))
    return rows.select("tickets", "clusters", "critical", pct(F.col("critical"), F.col("clusters")).alias("critical_pct"), "systems", open_.alias("ungrouped"), pct(open_, F.col("tickets")).alias("ungrouped_pct"), F.when(F.col("tickets") > 10, F.round(F.col("tickets") / F.greatest(F.lit(1.0), F.round(F.col("tickets") / 6.0)), 2)).alias("deflection"), replies.alias("replies"), F.round((F.col("tickets") - replies) * 3 / 60).cast("long").alias("hours"))


def team_load(st: DataFrame, roster: DataFrame) -> DataFrame:
    """Tickets of each assignee on the roster, zero included."""
    n = st.groupBy("assignee").agg(F.count(F.lit(1)).alias("n"))
    return roster.select("assignee").distinct().join(n, "assignee", "left").na.fill({"n": 0})


def status_breakdown(mb: DataFrame, st: DataFrame, order: Sequence[str]) -> DataFrame:
    """Tickets by status inside each cluster, in a fixed order, unknown ones last."""
    s = F.coalesce(S.blank_to_null(F.col("source_status")), F.lit("unknown"))
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), s), F.lit(0)), F.lit(len(order) + 1))
    return mb.select("cluster_id", "ticket_id").join(st, "ticket_id").groupBy("cluster_id", s.alias("status"), place.alias("place")).agg(F.count(F.lit(1)).alias("n"))


def recurring_top(cl: DataFrame, mb: DataFrame, st: DataFrame, now: Column, n: int = 8) -> DataFrame:
    """The n largest active clusters, with what came in the last 24 hours and cumulative daily age buckets."""
    rows = cl.filter("status = 'active'").select("cluster_id").join(mb.select("cluster_id", "ticket_id"), "cluster_id").join(st.select("ticket_id", "created_at"), "ticket_id")
    hours = (F.unix_micros(now) - F.unix_micros(F.col("created_at").cast("timestamp"))) / 3.6e9
    return rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(hours < 24 * k).alias(f"days_{k}") for k in range(1, 6)]).orderBy(F.desc("n"), "cluster_id").limit(n)


def system_totals(cl: DataFrame, mb: DataFrame, st: DataFrame) -> DataFrame:
    """Clustered tickets of each system."""
    return cluster_summary(cl, mb, st).groupBy("system").agg(F.sum("n").alias("tickets"))


def review_hints(cl: DataFrame, mb: DataFrame, st: DataFrame, max_size: int = 12, mixed_size: int = 5, low_sim: float = 72.0) -> DataFrame:
    """Large clusters to split, mixed-language ones to verify, and in each cluster the first member far from the centroid."""
    sizes = mb.select("cluster_id", "ticket_id").join(st.select("ticket_id", "lang"), "ticket_id").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("lang").alias("langs"))
    hint = F.when(F.col("n") >= max_size, "split").when((F.col("langs") > 1) & (F.col("n") >= mixed_size), "verify")
    size_rows = sizes.select("cluster_id", hint.alias("hint"), F.lit(None).cast("long").alias("ticket_id")).filter("hint is not null")
    far = centroid_similarity(mb).filter(F.col("similarity") * 100 < low_sim).groupBy("cluster_id").agg(F.min("ticket_id").alias("ticket_id")).select("cluster_id", F.lit("outlier").alias("hint"), "ticket_id")
    active = cl.filter("status = 'active'").select("cluster_id")
    return size_rows.unionByName(far).join(active, "cluster_id", "left_semi")


def decision_log_rollup(lg: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows and distinct tickets over the cube of `by`; a column that is summed over is null."""
    return lg.cube(*by).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ticket_id").alias("tickets"), F.grouping_id(*by).cast("int").alias("level"))


def decision_log(lg: DataFrame, limit: int = 100, actions: Sequence[str] | None = None, ticket_id: int | None = None) -> DataFrame:
    """The newest rows of the log, of some actions or one ticket if they are given."""
    if actions is not None:
        lg = lg.filter(F.col("action").isin(*actions))
    if ticket_id is not None:
        lg = lg.filter(F.col("ticket_id") == ticket_id)
    return lg.orderBy(F.desc("created_at"), F.desc("log_id")).limit(limit)


def logged_kinds(lg: DataFrame, st: DataFrame) -> DataFrame:
    """By action and kind of ticket, the log's rows and tickets; a ticket that is not known has the kind `unknown`. Rows of a ticket are counted first, so that they meet once."""
    each = lg.groupBy("action", "ticket_id").agg(F.count(F.lit(1)).alias("rows"))
    kinds = st.select("ticket_id", S.ticket_kind(F.col("ticket_kind")).alias("kind"))
    return each.join(kinds, "ticket_id", "left").groupBy("action", F.coalesce("kind", F.lit("unknown")).alias("kind")).agg(F.sum("rows").alias("rows"), F.count(F.lit(1)).alias("tickets"))


def pool_sizes(st: DataFrame, min_count: int = 3) -> DataFrame:
    """Tickets of each offering."""
    return st.groupBy(F.coalesce(S.offering_key(F.col("service")), F.lit(S.NO_OFFERING)).alias("offering")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def invariant_check(st: DataFrame, cl: DataFrame, mb: DataFrame) -> DataFrame:
    """Four counts that must be zero."""
    from ticketflow.operators.joins import cross_system_members

    cross = cross_system_members(mb, cl, st).agg(F.count(F.lit(1)).alias("n")).withColumn("check", F.lit("cross_system_members"))
    empty = cl.filter("status = 'active'").join(mb, "cluster_id", "left_anti").agg(F.count(F.lit(1)).alias("n")).withColumn("check", F.lit("empty_active_clusters"))
    multi = mb.groupBy("ticket_id").agg(F.countDistinct("cluster_id").alias("c")).filter("c > 1").agg(F.count(F.lit(1)).alias("n")).withColumn("check", F.lit("tickets_in_several_clusters"))
    names = cl.filter("status <> 'retired'").groupBy("name", "affected_system").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").agg(F.count(F.lit(1)).alias("n")).withColumn("check", F.lit("duplicate_live_names"))
    return cross.unionByName(empty).unionByName(multi).unionByName(names)


def service_consistency(groups: DataFrame) -> DataFrame:
    """(group_id, service) -> number of specific services and whether the group is rejected."""
    return groups.groupBy("group_id").agg(F.countDistinct(F.nullif(S.service_key(F.col("service")), F.lit(""))).alias("services")).withColumn("rejected", F.col("services") > 1)


def volume_sensitivity(st: DataFrame, lo: int = 20, hi: int = 150) -> DataFrame:
    """Similarity threshold and least group size from the number of active tickets, linear between two volumes."""
    n = st.agg(F.count_if(S.local_status(F.col("source_status")) == "active").alias("active"))
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("active") - lo) / F.lit(float(hi - lo))))
    return n.select("active", F.round(0.40 + 0.20 * x, 3).alias("threshold"), F.round(2 + 2 * x).cast("int").alias("min_size"))
