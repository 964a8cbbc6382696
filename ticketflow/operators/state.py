"""State transitions (M1-M20): old tables and decisions in, new tables and log rows out; `now` is always an argument."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketflow.functions import scalars as S
from ticketflow.operators.graph import cut
from ticketflow.operators.joins import cross_system_members, generic_service, remint_guard, small, snap_service, split_service, verdict_coverage

PINNED = ("human", "admin")
#: Fixed value: the name of a group that has no other.
GENERIC_NAME = "مقترح جديد"


def upsert_tickets(old: DataFrame, new: DataFrame, keep: Sequence[str] = ("created_at", "source_status")) -> DataFrame:
    """M1: by ticket_id; new values win except in the kept columns; of several new rows of an id the one with the largest seq."""
    last = new.withColumn("_r", F.row_number().over(Window.partitionBy("ticket_id").orderBy(F.desc("seq")))).filter("_r = 1")
    cols = [c for c in old.columns if c != "ticket_id"]
    o, n = old.select("ticket_id", F.lit(True).alias("_old"), *[F.col(c).alias(f"o_{c}") for c in cols]), last.select("ticket_id", F.lit(True).alias("_new"), *[F.col(c).alias(f"n_{c}") for c in cols])
    rows = o.join(n, "ticket_id", "full_outer")
    pick = lambda c: F.when(F.col("_new").isNull(), F.col(f"o_{c}")).when(F.col("_old").isNotNull() & F.lit(c in keep), F.col(f"o_{c}")).otherwise(F.col(f"n_{c}"))
    return rows.select("ticket_id", *[pick(c).alias(c) for c in cols])


def apply_memberships(cl: DataFrame, mb: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M2: (ticket_id, system, cluster_id, assigned_by, seq) -> clusters, members, refused.

    A ticket has one cluster: its last request wins. A cluster without a system is claimed by
    its first request; one of another system is refused.
    """
    r = requests.join(cl.select("cluster_id", F.coalesce(S.blank_to_null(F.col("affected_system"))).alias("own")), "cluster_id", "left").join(cl.select("cluster_id", F.lit(True).alias("known")), "cluster_id", "left")
    claims = r.filter("known and own is null").groupBy("cluster_id").agg(F.min_by("system", "seq").alias("claimed"))
    r = r.join(claims, "cluster_id", "left").withColumn("target", F.coalesce("own", "claimed"))
    good = F.coalesce(F.col("known") & (F.col("target") == F.col("system")), F.lit(False))
    refused = r.filter(~good).select("ticket_id", "cluster_id", F.when(F.col("known").isNull(), "unknown cluster").otherwise("other system").alias("reason"))
    last = r.filter(good).withColumn("_r", F.row_number().over(Window.partitionBy("ticket_id").orderBy(F.desc("seq")))).filter("_r = 1")
    members = mb.select("cluster_id", "ticket_id", "assigned_by").join(last.select("ticket_id"), "ticket_id", "left_anti").select("cluster_id", "ticket_id", "assigned_by").unionByName(last.select("cluster_id", "ticket_id", "assigned_by"))
    clusters = cl.join(claims, "cluster_id", "left").withColumn("affected_system", F.coalesce(S.blank_to_null(F.col("affected_system")), "claimed", "affected_system")).drop("claimed")
    return clusters, members, refused


def judge_assignments(shortlist: DataFrame, verdicts: DataFrame) -> DataFrame:
    """M3: (ticket_id, cluster_id) candidates, (ticket_id, action, cluster_id, confidence) verdicts -> each verdict with its outcome and the safeguard that applied."""
    c = shortlist.groupBy("ticket_id").agg(F.collect_set("cluster_id").alias("candidates"))
    rows = verdicts.join(c, "ticket_id", "left")
    known = F.coalesce(F.array_contains("candidates", F.col("cluster_id")), F.lit(False))
    is_assign = F.col("action") == "assign"
    ok = is_assign & known & F.col("confidence").isin("high", "medium")
    guard = F.when(is_assign & F.col("cluster_id").isNotNull() & ~known, "cluster not among candidates").when(~F.col("action").isin("assign", "none_fit"), "unexpected action")
    return rows.select("ticket_id", F.when(F.coalesce(ok, F.lit(False)), "assign").otherwise("none_fit").alias("outcome"), F.when(ok, F.col("cluster_id")).alias("cluster_id"), guard.alias("safeguard"))


def apply_assign_verdicts(cl: DataFrame, mb: DataFrame, st: DataFrame, shortlist: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M3 and M2: clusters, members, and a log row for every verdict."""
    log = judge_assignments(shortlist, verdicts)
    asked = log.filter("outcome = 'assign'").join(st.select("ticket_id", S.system_of(F.col("affected_system")).alias("system")), "ticket_id").select("ticket_id", "system", "cluster_id", F.lit("llm").alias("assigned_by"), F.lit(0).alias("seq"))
    clusters, members, _ = apply_memberships(cl, mb, asked)
    return clusters, members, log


def guard_names(groups: DataFrame, st: DataFrame, generic: str = GENERIC_NAME, most: int = 120) -> DataFrame:
    """The label guard of M4: a group's name if it is Arabic, else its smallest member's title, else the generic name, capped."""
    titles = groups.filter("group_no is not null").join(st.select("ticket_id", "title"), "ticket_id").groupBy("batch", "group_no").agg(F.min_by("title", "ticket_id").alias("_title"))
    name = F.when(F.col("name").rlike(S.ARABIC), S.cap_chars(F.col("name"), most)).otherwise(F.coalesce(S.blank_to_null(S.cap_chars(F.col("_title"), most)), F.lit(generic)))
    return groups.join(titles, ["batch", "group_no"], "left").withColumn("name", name).select(*groups.columns)


def judge_groups(presented: DataFrame, groups: DataFrame, st: DataFrame, blocked: DataFrame | None = None) -> DataFrame:
    """M4: (batch, ticket_id) shown, (batch, group_no, name, ticket_id) answered (group_no null for singletons) -> each group with its new id or the reason against it.

    A group's ids meet in one row for its stable id; they come from one batch, which holds some 20 tickets.
    """
    cover = verdict_coverage(presented, groups)
    rows = groups.filter("group_no is not null").join(st.select("ticket_id", "service", S.system_of(F.col("affected_system")).alias("system")), "ticket_id", "left")
    key = F.nullif(S.service_key(F.col("service")), F.lit(""))
    g = rows.groupBy("batch", "group_no", "name").agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("services"), F.min("system").alias("system"), F.collect_list(F.col("ticket_id").cast("string")).alias("ids"))
    g = g.join(cover.select("batch", "accepted"), "batch", "left")
    reason = F.when(~F.col("accepted"), "coverage").when(F.col("n") < 2, "too few").when(F.col("services") > 1, "several services")
    out = g.withColumn("reason", reason)
    if blocked is not None:
        out = out.join(blocked.select("batch", "group_no", F.lit(True).alias("is_blocked")), ["batch", "group_no"], "left").withColumn("reason", F.coalesce("reason", F.when(F.col("is_blocked"), "evicted before"))).drop("is_blocked")
    return out.select("batch", "group_no", "name", "system", "n", F.when(F.col("reason").isNull(), S.cluster_id(F.col("system"), F.col("name"), F.col("ids"))).alias("cluster_id"), "reason")


def apply_group_verdicts(cl: DataFrame, mb: DataFrame, st: DataFrame, presented: DataFrame, groups: DataFrame, vetoes: DataFrame | None = None, status: str = "proposed") -> tuple[DataFrame, DataFrame, DataFrame]:
    """M4: clusters, members, log. cluster_id is text, as new ids are.

    Names pass the label guard; a group is refused for a wrong coverage of its batch, fewer than two members, members of several
    services, or a live veto by a cluster of its name and system (J20). A group whose id is known is skipped; the others become clusters with `status`, of
    their members' smallest system; members of another system are not taken in (M2).
    """
    named = guard_names(groups, st)
    blocked = None
    if vetoes is not None:
        each = named.filter("group_no is not null").join(st.select("ticket_id", S.system_of(F.col("affected_system")).alias("system")), "ticket_id")
        blocked = remint_guard(each.select(F.struct("batch", "group_no").alias("group_id"), "system", "name", "ticket_id"), cl, vetoes).select("group_id.batch", "group_id.group_no")
    log = judge_groups(presented, named, st, blocked)
    log = log.join(cl.select(F.col("cluster_id").cast("string").alias("cluster_id"), F.lit("known id").alias("known")).distinct(), "cluster_id", "left").withColumn("reason", F.coalesce("reason", "known"))
    log = cut(log.select("batch", "group_no", "name", "system", "n", "cluster_id", "reason"))
    new = log.filter("reason is null")
    text = lambda df: df.withColumn("cluster_id", F.col("cluster_id").cast("string"))
    minted = new.groupBy("cluster_id").agg(F.min("name").alias("name"), F.lit(status).alias("status"), F.min("system").alias("affected_system"))
    clusters = text(cl).select("cluster_id", "name", "status", "affected_system").unionByName(minted)
    own = st.select("ticket_id", S.system_of(F.col("affected_system")).alias("system"))
    asked = named.join(new.select("batch", "group_no", "cluster_id"), ["batch", "group_no"]).join(own, "ticket_id").select("ticket_id", "system", "cluster_id", F.lit("llm").alias("assigned_by"), F.lit(0).alias("seq"))
    clusters, members, _ = apply_memberships(clusters, text(mb), asked)
    return clusters, members, log


def apply_audit_verdicts(cl: DataFrame, mb: DataFrame, verdicts: DataFrame, floor: float = 0.85) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M5: (cluster_id, ticket_id, decision) -> clusters, members, log.

    A cluster's audit counts if it names each member once, nobody else, and does not remove more than
    `floor`. Pinned members stay. A cluster left with fewer than two members and no pin is retired and emptied.
    """
    m = mb.select("cluster_id", "ticket_id", "assigned_by")
    v = verdicts.groupBy("cluster_id", "ticket_id").agg(F.count(F.lit(1)).alias("times"), F.min("decision").alias("decision"))
    audited = v.select("cluster_id").distinct()
    rows = m.join(audited, "cluster_id", "left_semi").join(v, ["cluster_id", "ticket_id"], "full_outer")
    pin = F.coalesce(F.col("assigned_by").isin(*PINNED), F.lit(False))
    gone = (F.col("decision") == "remove") & ~pin
    per = rows.groupBy("cluster_id").agg(F.count("assigned_by").alias("n"), F.count_if(F.col("times").isNull() | F.col("assigned_by").isNull() | (F.col("times") > 1)).alias("wrong"), F.count_if(F.col("decision") == "remove").alias("removed"), F.count_if(~F.coalesce(gone, F.lit(False)) & F.col("assigned_by").isNotNull()).alias("left"), F.max(pin.cast("int")).alias("pins"))
    result = F.when(F.col("wrong") > 0, "coverage").when(F.col("removed") > floor * F.col("n"), "floor").when((F.col("left") < 2) & (F.col("pins") == 0), "retired").otherwise("applied")
    log = per.select("cluster_id", "n", "removed", result.alias("result"))
    dropped = rows.filter(gone).join(log.filter("result = 'applied'"), "cluster_id", "left_semi").select("cluster_id", "ticket_id")
    retired = log.filter("result = 'retired'").select("cluster_id")
    members = m.join(dropped, ["cluster_id", "ticket_id"], "left_anti").join(retired, "cluster_id", "left_anti")
    clusters = cl.join(retired.withColumn("_x", F.lit(1)), "cluster_id", "left").withColumn("status", F.when(F.col("_x").isNotNull(), "retired").otherwise(F.col("status"))).drop("_x")
    return clusters, members, log


def demote_small(cl: DataFrame, mb: DataFrame, at_least: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M6: active clusters with too few members are retired and emptied."""
    size = mb.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"))
    small = cl.filter("status = 'active'").join(size, "cluster_id", "left").filter(F.coalesce("n", F.lit(0)) < at_least).select("cluster_id")
    clusters = cl.join(small.withColumn("_x", F.lit(1)), "cluster_id", "left").withColumn("status", F.when(F.col("_x").isNotNull(), "retired").otherwise(F.col("status"))).drop("_x")
    log = mb.select("cluster_id", "ticket_id").join(small, "cluster_id", "left_semi").withColumn("action", F.lit("demoted"))
    return clusters, mb.join(small, "cluster_id", "left_anti"), log


def evict_cross_system(cl: DataFrame, mb: DataFrame, st: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M7: members of another system leave; the log says system_evict, which is no veto."""
    out = cross_system_members(mb, cl, st).select("cluster_id", "ticket_id")
    return mb.join(out, ["cluster_id", "ticket_id"], "left_anti"), out.withColumn("action", F.lit("system_evict"))


def backfill_cluster_system(cl: DataFrame, mb: DataFrame, st: DataFrame) -> DataFrame:
    """M8: clusters without a system get their members' most frequent one."""
    from ticketflow.operators.aggs import mode_label

    rows = mb.select("cluster_id", "ticket_id").join(st.select("ticket_id", "affected_system"), "ticket_id")
    best = mode_label(rows, ["cluster_id"], S.blank_to_null(F.col("affected_system")), "found")
    return cl.join(best, "cluster_id", "left").withColumn("affected_system", F.coalesce(S.blank_to_null(F.col("affected_system")), "found", "affected_system")).drop("found")


def decide_proposals(cl: DataFrame, mb: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M9: (cluster_id, decision, seq): the first decision on a proposed cluster counts, all others are conflicts; a rejected one releases its members."""
    w = Window.partitionBy("cluster_id").orderBy("seq")
    d = decisions.join(cl.select("cluster_id", "status"), "cluster_id", "left").withColumn("place", F.row_number().over(w))
    ok = (F.col("place") == 1) & F.coalesce(F.col("status") == "proposed", F.lit(False))
    done = d.filter(ok).select("cluster_id", F.when(F.col("decision") == "approve", "active").otherwise("retired").alias("new_status"))
    clusters = cl.join(done, "cluster_id", "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")
    members = mb.join(done.filter("new_status = 'retired'").select("cluster_id"), "cluster_id", "left_anti")
    return clusters, members, d.filter(~ok).select("cluster_id", "seq", "decision")


def decide_pool_proposals(props: DataFrame, exemplars: DataFrame, pool: DataFrame, decisions: DataFrame, now: Column, cooldown_hours: int = 24) -> tuple[DataFrame, DataFrame]:
    """(proposal_id, member_ids), (proposal_id, decision, target) -> exemplars and pool: approved and merged members become exemplars and leave the pool, rejected ones cool down."""
    rows = props.join(decisions, "proposal_id").select("proposal_id", "decision", "target", F.explode("member_ids").alias("ticket_id"))
    taken = rows.filter(F.col("decision").isin("approve", "merge")).select(F.when(F.col("decision") == "merge", F.col("target")).otherwise(F.col("proposal_id")).alias("group_id"), "ticket_id")
    cool = rows.filter("decision = 'reject'").select("ticket_id", F.lit(True).alias("_cool")).distinct()
    left = pool.join(taken.select("ticket_id").hint("merge"), "ticket_id", "left_anti").join(cool.hint("merge"), "ticket_id", "left")
    left = left.withColumn("cooldown_until", F.when(F.col("_cool"), now + F.make_interval(hours=F.lit(cooldown_hours))).otherwise(F.col("cooldown_until"))).drop("_cool")
    return exemplars.unionByName(taken).distinct(), left


def check_pool_decisions(props: DataFrame, groups: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Proposals (proposal_id, offering_id, status), groups (group_id) and decisions (proposal_id, decision, target, new_offering) -> (proposals, new groups, refused decisions).

    Only a pending proposal can be decided; a merge needs a target that is a group. An approved proposal becomes a group of
    its own, under the new offering if one is named. Of several decisions on a proposal none counts.
    """
    times = decisions.groupBy("proposal_id").agg(F.count(F.lit(1)).alias("times"))
    known = groups.select(F.col("group_id").alias("target")).distinct().withColumn("has_target", F.lit(True))
    rows = decisions.join(times.hint("merge"), "proposal_id").join(props.select("proposal_id", "offering_id", "status"), "proposal_id", "left").join(known.hint("merge"), "target", "left")
    merge = F.col("decision") == "merge"
    reason = F.when(F.col("status").isNull(), "unknown proposal").when(F.col("status") != "pending", F.concat(F.lit("already decided: "), "status")).when(F.col("times") > 1, "several decisions").when(~F.coalesce(F.col("decision").isin("approve", "reject", "merge"), F.lit(False)), "unknown decision")
    rows = cut(rows.withColumn("reason", reason.when(merge & F.col("target").isNull(), "merge without a target").when(merge & F.col("has_target").isNull(), "unknown target")))
    good = rows.filter("reason is null")
    minted = good.filter("decision = 'approve'").select(F.col("proposal_id").alias("group_id"), F.coalesce(S.blank_to_null(F.col("new_offering")), "offering_id").alias("offering_id"))
    done = good.select("proposal_id", F.col("decision").alias("new_status"), F.when(F.col("decision") == "approve", F.col("proposal_id")).when(merge, F.col("target")).alias("group_id"))
    out = props.join(done.hint("merge"), "proposal_id", "left").withColumn("status", F.coalesce("new_status", "status")).drop("new_status")
    return out, minted, rows.filter("reason is not null").select("proposal_id", "decision", "reason")


def active_pool(pool: DataFrame, now: Column) -> DataFrame:
    """Pool rows that are not cooling down."""
    return pool.filter(F.col("cooldown_until").isNull() | (F.col("cooldown_until") <= now))


def heal_failed(st: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Failed tickets take a new result (ticket_id, service, classification_status) that did not fail; counts of both."""
    r = results.select("ticket_id", F.col("service").alias("new_service"), F.col("classification_status").alias("new_status"))
    rows = st.join(r, "ticket_id", "left")
    tried = (F.col("classification_status") == "failed") & F.col("new_status").isNotNull()
    heals = tried & (F.col("new_status") != "failed")
    out = rows.select(*[F.when(heals, F.col({"service": "new_service", "classification_status": "new_status"}[c])).otherwise(F.col(c)).alias(c) if c in ("service", "classification_status") else c for c in st.columns])
    return out, rows.agg(F.count_if(heals).alias("healed"), F.count_if(tried & ~heals).alias("still_failed"))


def recover_or_queue(st: DataFrame, results: DataFrame, queue: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Failed tickets outside the queue take a good result; those that fail again enter it with one attempt more."""
    todo = st.filter("classification_status = 'failed'").join(queue.select("ticket_id"), "ticket_id", "left_anti").select("ticket_id")
    r = todo.join(results.select("ticket_id", "classification_status"), "ticket_id")
    failed = r.filter("classification_status = 'failed'").select("ticket_id", F.lit(1).alias("more"))
    out, _ = heal_failed(st, results.join(todo, "ticket_id", "left_semi"))
    q = queue.join(failed, "ticket_id", "full_outer").select("ticket_id", (F.coalesce("attempts", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("attempts"))
    return out, q


NONE = "NONE_OF_THE_ABOVE"


def _abstains(value: Column) -> Column:
    return (value == NONE) | F.endswith(value, F.lit(f".{NONE}"))


def _offerings(tx: DataFrame) -> DataFrame:
    """key, owner, offerings of each taxonomy service, with a join hint by its size."""
    return small(tx.groupBy(F.col("service").alias("key")).agg(F.min("system").alias("owner"), F.array_sort(F.collect_set("offering")).alias("offerings")))


def apply_corrections(st: DataFrame, corrections: DataFrame, tx: DataFrame, allowed: dict[str, Sequence[str]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A verifier's corrections (ticket_id, field, value) of affected_system, service and the fields of `allowed` -> (tickets, log, gaps).

    A service must be in the taxonomy (J12) and brings its owning system; a bare one with a single offering takes that, one with several
    stays bare at low confidence. NONE_OF_THE_ABOVE makes the ticket's service a gap at low confidence and writes a gap row. A system must be
    known and own the service that the ticket then has. Of several corrections of a field the first by value counts. The log has every correction with its outcome and reason.
    """
    fields = ["affected_system", "service", *allowed]
    given = corrections.withColumn("value", F.trim("value")).join(st.select("ticket_id"), "ticket_id", "left_semi")
    first = given.filter(F.col("field").isin(fields)).groupBy("ticket_id", "field").agg(F.min("value").alias("value"))
    wide = first.groupBy("ticket_id").pivot("field", fields).agg(F.first("value")).select("ticket_id", *[F.col(f).alias(f"new_{f}") for f in fields])
    own = st.select("ticket_id", *[F.col(f).alias(f"old_{f}") for f in fields])
    rows = own.join(wide.hint("merge"), "ticket_id")
    known = tx.select(F.col("system").alias("new_affected_system")).distinct().withColumn("known", F.lit(True))
    keys = _offerings(tx)
    asked = cut(rows.select("new_service").unionByName(rows.select(F.col("old_service").alias("new_service"))).filter("new_service is not null").distinct())
    split = small(cut(split_service(asked.withColumnRenamed("new_service", "service"), tx)))
    of = lambda prefix: split.select(F.col("service").alias(f"{prefix}_service"), F.col("service_key").alias(f"{prefix}_key"), F.col("offering").alias(f"{prefix}_offering"))
    info = lambda prefix: keys.select(F.col("key").alias(f"{prefix}_key"), F.col("owner").alias(f"{prefix}_owner"), F.col("offerings").alias(f"{prefix}_offerings"))
    for prefix in ("new", "old"):
        rows = rows.join(of(prefix), f"{prefix}_service", "left").join(info(prefix), f"{prefix}_key", "left")
    rows = rows.join(small(known), "new_affected_system", "left")
    gap = F.coalesce(_abstains(F.col("new_service")), F.lit(False))
    wrong = F.when(gap, F.when(F.col("old_owner").isNull(), "no service to name a gap of")).when(F.col("new_owner").isNull(), "unknown service").when(F.col("new_offering").isNotNull() & (F.col("new_offering") != S.GAP[1:]) & ~F.array_contains("new_offerings", F.col("new_offering")), "unknown offering")
    fits = F.col("new_service").isNotNull() & wrong.isNull()
    bare = F.col("new_offering").isNull() & ~gap
    only = F.when(bare & (F.size("new_offerings") == 1), F.concat("new_key", F.lit("."), F.col("new_offerings")[0]))
    service = F.when(fits & gap, F.concat("old_key", F.lit(S.GAP))).when(fits, F.coalesce(only, "new_service")).otherwise(F.col("old_service"))
    owner = F.when(fits & ~gap, F.col("new_owner")).otherwise(F.col("old_owner"))
    rows = cut(rows.withColumns({"is_gap": fits & gap, "fits": fits, "service_reason": wrong, "system_reason": F.when(F.col("known").isNull(), "unknown system").when(owner.isNotNull() & (owner != F.col("new_affected_system")), "system of another service"), "out_service": service, "owner": owner, "low": (fits & gap) | (fits & bare & (F.size("new_offerings") > 1))}))
    moved = F.when(F.col("new_affected_system").isNotNull() & F.col("system_reason").isNull(), F.col("new_affected_system")).when(F.col("fits") & ~F.col("is_gap"), F.col("owner")).otherwise(F.col("old_affected_system"))
    made = {"affected_system": moved, "service": F.col("out_service")} | {f: F.when(F.col(f"new_{f}").isin(*values), F.col(f"new_{f}")).otherwise(F.col(f"old_{f}")) for f, values in allowed.items()}
    changed = rows.select("ticket_id", *[c.alias(f"c_{f}") for f, c in made.items()], F.when(F.col("low"), "low").otherwise("kept").alias("confidence"), F.lit(True).alias("hit"))
    out = st.join(changed.hint("merge"), "ticket_id", "left").select(*[F.when(F.col("hit"), F.col(f"c_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in st.columns], F.coalesce("confidence", F.lit("kept")).alias("confidence"))
    reasons = rows.select("ticket_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"new_{f}").alias("value"), r.alias("reason")) for f, r in {"affected_system": F.col("system_reason"), "service": F.col("service_reason"), **{f: F.when(~F.col(f"new_{f}").isin(*values), "unknown value") for f, values in allowed.items()}}.items()])).alias("x")).select("ticket_id", "x.*").filter("value is not null")
    none = given.filter(~F.coalesce(F.col("field").isin(fields), F.lit(False))).select("ticket_id", "field", "value", F.lit("not a field to correct").alias("reason"))
    log = reasons.unionByName(none).withColumn("outcome", F.when(F.col("reason").isNull(), "applied").otherwise("discarded"))
    return out, log, rows.filter("is_gap").select("ticket_id", F.col("old_key").alias("service"), F.lit("(unspecified)").alias("suggested_offering"))


def resolve_cascade(st: DataFrame, answers: DataFrame, tx: DataFrame, system_pattern: str, rule: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Tickets (ticket_id, affected_system and what `rule` reads) and stage answers (ticket_id, stage, attempt, value, suggested) -> (results, gaps).

    System: the ticket's own if the taxonomy has it, else the rule's (P10), else the first answer of stage `system`; without any the ticket is unspecified.
    Service: the first answer of stage `service` that snaps onto a service of that system (J13), else the system's generic one.
    Offering: none where the service has none, the only one where it has one, else the first valid answer of stage `offering`; an abstention is a
    gap, and answers that all fail leave the bare service. `path` says which way was taken; all but picked and forced offerings and services without any are of low confidence.
    """
    systems = small(generic_service(tx).withColumnRenamed("system", "known"))
    base = st.select("ticket_id", F.trim("affected_system").alias("pin"), (rule if rule is not None else F.lit(None).cast("string")).alias("rule"))
    usable = answers.filter("value is not null")
    stage = lambda name: usable.filter(F.col("stage") == name)
    said = stage("system").groupBy("ticket_id").agg(F.min_by("value", "attempt").alias("said"))
    rows = base.join(systems.select(F.col("known").alias("pin"), F.lit(True).alias("pinned")), "pin", "left").join(said.hint("merge"), "ticket_id", "left")
    rows = cut(rows.select("ticket_id", F.coalesce(F.when(F.col("pinned"), F.col("pin")), "rule", "said").alias("system")))
    services = stage("service").select("ticket_id", "attempt", F.col("value").alias("service")).join(rows.hint("merge"), "ticket_id").withColumnRenamed("system", "affected_system")
    snapped = snap_service(services, tx, system_pattern).filter("snapped is not null").groupBy("ticket_id").agg(F.min_by("snapped", "attempt").alias("key"))
    rows = rows.join(snapped.hint("merge"), "ticket_id", "left").join(systems.select(F.col("known").alias("system"), "generic"), "system", "left").join(_offerings(tx), "key", "left")
    rows = cut(rows.withColumn("size", F.coalesce(F.size("offerings"), F.lit(0))))
    picks = stage("offering").select("ticket_id", "attempt", "value", "suggested").join(rows.filter("size > 1").select("ticket_id", "key", "offerings").hint("merge"), "ticket_id")
    bare = F.when(F.startswith("value", F.concat("key", F.lit("."))), F.expr("substring(value, length(key) + 2)")).otherwise(F.col("value"))
    picks = picks.withColumn("offering", F.when(_abstains(F.col("value")), F.lit(S.GAP[1:])).otherwise(bare))
    valid = (F.col("offering") == S.GAP[1:]) | F.array_contains("offerings", F.col("offering"))
    picked = picks.filter(valid).groupBy("ticket_id").agg(F.min_by(F.struct("offering", "suggested"), "attempt").alias("pick"))
    rows = rows.join(picked.hint("merge"), "ticket_id", "left")
    gap = F.col("pick.offering") == S.GAP[1:]
    path = F.when(F.col("system").isNull(), "no system").when(F.col("key").isNull(), "no service").when(F.col("size") == 0, "no offerings").when(F.col("size") == 1, "forced").when(F.col("pick").isNull(), "failed").when(gap, "gap").otherwise("picked")
    tail = F.when(F.col("size") == 1, F.col("offerings")[0]).otherwise(F.col("pick.offering"))
    service = F.when(F.col("key").isNull(), F.coalesce("generic", F.lit(S.GENERAL))).otherwise(F.concat_ws(".", "key", F.when(F.col("size") > 0, tail)))
    rows = cut(rows.select("ticket_id", F.coalesce("system", F.lit("Other")).alias("system"), "key", service.alias("service"), path.alias("path"), F.col("pick.suggested").alias("suggested")))
    results = rows.select("ticket_id", "system", "service", F.when(F.col("path").isin("picked", "forced", "no offerings"), "high").otherwise("low").alias("confidence"), "path")
    return results, rows.filter("path = 'gap'").select("ticket_id", F.col("key").alias("service"), F.coalesce(F.nullif(F.trim("suggested"), F.lit("")), F.lit("(unspecified)")).alias("suggested_offering"))


def status_update(st: DataFrame, updates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The newest (reference, source_status, updated_at) of each ticket; unknown references are returned."""
    last = updates.groupBy("reference").agg(F.max_by("source_status", F.struct("updated_at", "update_id")).alias("new_status"), F.max("updated_at").alias("last_seen"))
    rows = st.join(last.withColumnRenamed("reference", "ticket_id"), "ticket_id", "left")
    out = rows.withColumn("source_status", F.coalesce("new_status", "source_status")).drop("new_status").withColumn("status", S.local_status(F.col("source_status")))
    return out, last.join(st.select(F.col("ticket_id").alias("reference")), "reference", "left_anti").select("reference")


def resync_columns(st: DataFrame, json: str) -> DataFrame:
    """ticket_kind and classification_status from the classification's JSON, where it has them."""
    c = S.parse_classification(F.col(json))
    return st.withColumn("ticket_kind", F.coalesce(c["ticket_kind"], F.col("ticket_kind"))).withColumn("classification_status", F.coalesce(c["classification_status"], F.col("classification_status")))


def seed_clusters(snapshot: DataFrame, cl: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(system, name, member_ids) -> new clusters with stable ids, and their members; known ids are skipped."""
    rows = snapshot.withColumn("cluster_id", S.cluster_id(F.col("system"), F.col("name"), F.transform("member_ids", lambda x: x.cast("string")))).join(cl.select("cluster_id"), "cluster_id", "left_anti")
    return rows.select("cluster_id", "name", F.lit("active").alias("status"), F.col("system").alias("affected_system")), rows.select("cluster_id", F.explode("member_ids").alias("ticket_id"), F.lit("seed").alias("assigned_by"))
