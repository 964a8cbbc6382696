"""Ticket-shaped views over the given tables, as SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Table names stand in braces. What a view needs comes before it.
VIEWS: dict[str, str] = {
    "tickets": """SELECT d.doc_id AS ticket_id, substring(d.text, 1, 80) AS title, substring(d.text, 81) AS description, d.lang,
 CASE WHEN d.doc_id % 10 = 0 THEN NULL WHEN d.lang = 'en' THEN 'SysA' WHEN d.lang = 'fr' THEN 'SysB' WHEN d.lang = 'de' THEN 'SysC' ELSE 'SysD' END AS affected_system,
 CASE WHEN d.doc_id % 17 = 0 THEN 'General / Unspecified' WHEN d.doc_id % 13 = 0 THEN concat('Svc ', d.source, ' - SysA.OFFERING-GAP') WHEN d.doc_id % 5 = 0 THEN concat('Svc ', d.source, ' - SysA')
      WHEN d.source = 'src7' THEN concat('7.1 Svc src7 - SysA.Off', CAST(d.doc_id % 3 AS STRING)) ELSE concat('Svc ', d.source, ' - SysA.Off', CAST(d.doc_id % 3 AS STRING)) END AS service,
 CASE WHEN l.toxic = 1 THEN 'Critical' WHEN l.quality = 0 THEN 'Major' WHEN l.quality = 1 THEN 'Minor' END AS severity,
 CASE d.doc_id % 8 WHEN 0 THEN 'inquiry' WHEN 1 THEN 'administrative' WHEN 2 THEN NULL WHEN 3 THEN 'service_request' ELSE 'incident' END AS ticket_kind,
 CASE d.doc_id % 6 WHEN 0 THEN 'Closed' WHEN 1 THEN ' resolved ' WHEN 2 THEN 'DUPLICATE' WHEN 3 THEN NULL WHEN 4 THEN 'In Progress' ELSE 'active' END AS source_status,
 CASE WHEN d.doc_id % 29 = 0 THEN 'failed' ELSE 'ok' END AS classification_status,
 CASE WHEN d.doc_id % 9 = 0 THEN NULL ELSE concat('agent', CAST(d.doc_id % 7 AS STRING)) END AS assignee,
 CASE d.doc_id % 4 WHEN 0 THEN 'Billing desk' WHEN 1 THEN 'network-gate' WHEN 2 THEN 'Field ops' ELSE '' END AS assign_group, e.ts AS created_at
 FROM {documents} d JOIN {events} e ON e.event_id = d.doc_id LEFT JOIN {labels} l ON l.doc_id = d.doc_id""",
    "clusters": """SELECT DISTINCT label AS cluster_id, concat('Problem ', CAST(label % 7 AS STRING)) AS name,
 CASE WHEN label = 9 THEN 'retired' WHEN label % 5 = 0 THEN 'proposed' ELSE 'active' END AS status,
 CASE WHEN label = 8 THEN '' WHEN label % 2 = 0 THEN 'SysA' ELSE 'SysB' END AS affected_system FROM {embeddings}""",
    "members": """SELECT v.label AS cluster_id, v.vec_id AS ticket_id, CASE WHEN v.vec_id % 11 = 0 THEN 'human' WHEN v.vec_id % 3 = 0 THEN 'seed' ELSE 'llm' END AS assigned_by, e.ts AS assigned_at, v.embedding
 FROM {embeddings} v JOIN {events} e ON e.event_id = v.vec_id JOIN {documents} d ON d.doc_id = v.vec_id WHERE v.vec_id % 6 <> 5""",
    "assignment_log": """SELECT event_id AS log_id, user_id AS ticket_id, event_id % 10 AS cluster_id,
 CASE event_type WHEN 'error' THEN 'audit_remove' WHEN 'view' THEN 'audit_keep' WHEN 'click' THEN 'assign' WHEN 'signup' THEN 'none_fit' ELSE 'system_evict' END AS action, ts AS created_at FROM {events}""",
    "attempts": """SELECT event_id AS attempt_id, user_id AS reference, CASE WHEN event_type IN ('error','signup','view') THEN 'failed' ELSE 'ok' END AS outcome,
 CASE event_type WHEN 'error' THEN 'connection refused' WHEN 'signup' THEN 'request timeout' WHEN 'view' THEN 'embedding dim mismatch' END AS message, ts FROM {events}""",
    "eval_rows": """SELECT ticket_id, affected_system AS true_system, service AS true_service, CASE WHEN ticket_id % 25 = 0 THEN 'Other' ELSE affected_system END AS model_system,
 CASE WHEN ticket_id % 4 = 0 THEN 'General / Unspecified' ELSE service END AS model_service, CASE WHEN ticket_id % 3 = 0 THEN 'SysA' ELSE affected_system END AS user_system, service AS user_service
 FROM {tickets} WHERE affected_system IS NOT NULL""",
    "replies": """SELECT ticket_id, CASE ticket_id % 4 WHEN 0 THEN concat('{{"kind":"incident","id":', CAST(ticket_id AS STRING), '}}') WHEN 1 THEN concat('```json {{"kind":"inquiry","id":', CAST(ticket_id AS STRING), '}} ```')
 WHEN 2 THEN concat('Sure, here it is: {{"kind":"test","id":', CAST(ticket_id AS STRING), '}}') ELSE '{{"kind":"administrative","reason":"cut off' END AS raw FROM {tickets}""",
    "probes": """SELECT event_type AS service, ts, CASE WHEN value < 5 THEN 'unreachable' ELSE 'ok' END AS status, event_id FROM {events}""",
    "discussions": """SELECT conv_id AS ticket_id, turn, role, text FROM {conversations}""",
    "status_updates": """SELECT o_orderkey AS update_id, o_custkey AS reference, CASE o_orderstatus WHEN 'F' THEN 'Closed' WHEN 'P' THEN 'third_party' ELSE 'active' END AS source_status,
 o_orderpriority AS priority, o_orderdate AS updated_at FROM {orders}""",
    "taxonomy": """SELECT DISTINCT system, regexp_replace(service, '[.](Off[0-9]+|OFFERING-GAP)$', '') AS service, CASE WHEN regexp_extract(service, '[.](Off[0-9]+)$', 1) <> '' THEN regexp_extract(service, '[.](Off[0-9]+)$', 1) END AS offering
 FROM (SELECT 'SysA' AS system, service FROM {tickets} WHERE ticket_id % 11 <> 3)
 WHERE service NOT LIKE '%src13 %'""",
    "pairs": """SELECT a.vec_id AS a, b.vec_id AS b, a.label AS block FROM {embeddings} a JOIN {embeddings} b ON a.label = b.label AND a.vec_id < b.vec_id""",
}
BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
NEEDS = {"eval_rows": ["tickets"], "replies": ["tickets"], "taxonomy": ["tickets"]}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or a view."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    used = [t for t in (*BASE, *VIEWS) if f"{{{t}}}" in VIEWS[name]]
    return spark.sql(VIEWS[name], **{t: table(spark, sf_dir, t) for t in used})


def sql(body: str, *views: str) -> str:
    """DuckDB SQL: `body` after the views it names."""
    order: list[str] = []
    for v in views:
        for x in [*NEEDS.get(v, []), v]:
            if x not in order:
                order.append(x)
    names = {t: t for t in (*BASE, *VIEWS)}
    ctes = [f"{v} AS ({VIEWS[v].format(**names)})" for v in order]
    body, head = body.strip(), "WITH "
    if ctes and body.startswith("WITH RECURSIVE "):
        head = "WITH RECURSIVE "
    if ctes and body.startswith("WITH "):
        body = ", " + body.removeprefix(head)
    return (head + ", ".join(ctes) + " " if ctes else "") + body
