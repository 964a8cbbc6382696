"""Reading, mapping and validating tickets, and writing results."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketflow.functions import scalars as S
from ticketflow.operators.lineage import cut

# Field names that a ticket may arrive under.
TITLE = ("DisplayLabel", "display_label", "title", "Title")
DESCRIPTION = ("Description", "description", "desc")
WRAPPERS = ("event", "data", "incident", "ticket", "record", "payload")
ENTITY = {
    "reference": ("Id", "id", "ticket_id"), "title": ("DisplayLabel", "displayLabel", "title", "Name"), "description": ("Description", "description", "details"),
    "status": ("Status", "status"), "created_at": ("EmsCreationTime", "emsCreationTime", "created_at"), "updated_at": ("LastUpdateTime", "lastUpdateTime", "updated_at"),
}
RULES = {"source_reference": (1, 128), "title": (1, 300), "description": (0, 8000), "status": (1, 64), "affected_system": (0, 64)}


def read_ticket_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that hold an array of tickets; anything else is an error."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def alias_coalesce(df: DataFrame, aliases: dict[str, Sequence[str]], defaults: dict[str, str] | None = None) -> DataFrame:
    """Each output field is the first of its aliases that has text, trimmed."""
    have = set(df.columns)
    cols = [F.coalesce(*[S.blank_to_null(F.col(f"`{a}`").cast("string")) for a in names if a in have], F.lit((defaults or {}).get(out)).cast("string")).alias(out) for out, names in aliases.items()]
    return df.select(*cols)


def map_ticket(df: DataFrame) -> DataFrame:
    """S3: the normal shape with defaults; rows without a title go."""
    aliases = {"title": TITLE, "description": DESCRIPTION, "status": ("Status", "status"), "assignee": ("Assignee", "assignee"), "assign_group": ("AssignGroup", "assign_group"), "priority": ("Priority", "priority"), "affected_system": ("AffectedSystem", "affected_system", "System", "system")}
    return alias_coalesce(df, aliases, {"status": "active", "priority": "medium"}).filter("title is not null")


def wire_time(c: Column) -> Column:
    """Epoch milliseconds or an ISO time; null for anything else."""
    digits = c.rlike("^[0-9]{10,17}$")
    return F.when(digits, F.timestamp_millis(F.when(digits, c).cast("long"))).otherwise(F.try_to_timestamp(F.when(~digits, c)))


def normalize_entity(df: DataFrame, json: str) -> DataFrame:
    """An entity's JSON, with or without `properties`, in the normal shape."""
    c = F.col(json)
    props = F.coalesce(F.get_json_object(c, "$.properties"), c)
    first = lambda names: F.coalesce(*[S.blank_to_null(F.get_json_object(props, f"$.{n}")) for n in names])
    keep = [x for x in df.columns if x != json]
    return df.select(*keep, *[F.coalesce(first(ENTITY[k]), F.lit("")).alias(k) for k in ("reference", "title", "description")], F.coalesce(first(ENTITY["status"]), F.lit("active")).alias("status"), *[wire_time(first(ENTITY[k])).alias(k) for k in ("created_at", "updated_at")])


def unwrap_event(json: Column, depth: int = 5) -> Column:
    """The innermost object under up to `depth` wrappers."""

    def peel(j: Column) -> Column:
        inner = F.coalesce(*[F.get_json_object(j, f"$.{w}") for w in WRAPPERS])
        return F.when(F.startswith(inner, F.lit("{")), inner).otherwise(j)

    return F.aggregate(F.sequence(F.lit(1), F.lit(depth)), json, lambda j, _: peel(j))


def explode_attachments(df: DataFrame, key: str, json: str) -> tuple[DataFrame, DataFrame]:
    """(files, errors) of a JSON list of attachments; hidden ones go, a negative size is an error."""
    kind = "array<struct<name:string,mime:string,size:long,hidden:boolean>>"
    rows = df.select(key, F.explode(F.from_json(json, kind)).alias("f")).select(key, "f.*").filter(~F.coalesce("hidden", F.lit(False))).drop("hidden")
    return rows.filter(F.coalesce(F.col("size") >= 0, F.lit(True))), rows.filter(F.col("size") < 0)


def date_range_filter(df: DataFrame, ts: str, start: str | None = None, end: str | None = None, ids: Sequence[int] | None = None, id_col: str = "ticket_id", offset_hours: int = 3) -> DataFrame:
    """Inclusive calendar days of a fixed offset; no condition at all is an error. The bounds are literals, so they reach the scan."""
    if start is None and end is None and ids is None:
        raise ValueError("a date or an id list is needed")
    t = F.col(ts)
    shift = F.make_interval(hours=F.lit(offset_hours))
    if start is not None:
        df = df.filter(t >= F.lit(start).cast("timestamp_ntz") - shift)
    if end is not None:
        df = df.filter(t < F.lit(end).cast("timestamp_ntz") + F.make_interval(days=F.lit(1)) - shift)
    return df if ids is None else df.filter(F.col(id_col).isin(*ids))


def changed_since(df: DataFrame, outcome: DataFrame, stamp: int) -> tuple[DataFrame, DataFrame]:
    """Rows (reference, change_ms) from `stamp` on, those without a time included, and the next stamp.

    `outcome` (reference, result ok / failed / held) decides: one past the newest ok row, but never past the
    earliest failed or held one; a failed row without a time holds the stamp.
    """
    batch = df.filter(F.col("change_ms").isNull() | (F.col("change_ms") >= stamp))
    o = batch.join(outcome, "reference")
    ok = F.max(F.when(F.col("result") == "ok", F.col("change_ms"))) + 1
    bad = F.min(F.when(F.col("result") != "ok", F.col("change_ms"))) - 1
    hold = F.max((F.col("result") != "ok").cast("int") * F.col("change_ms").isNull().cast("int"))
    s = o.agg(ok.alias("ok"), bad.alias("bad"), hold.alias("hold"))
    return batch, s.select(F.greatest(F.lit(stamp), F.when(F.coalesce(F.col("hold") == 1, F.lit(False)), F.lit(stamp)).otherwise(F.coalesce(F.least("ok", "bad"), F.lit(stamp)))).alias("next_stamp"))


def capped_extract(df: DataFrame, cap: int, order: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The oldest `cap` rows, and the one held back after them."""
    rows = df.orderBy(*order).limit(cap + 1).withColumn("_n", F.row_number().over(Window.orderBy(*order)))
    return rows.filter(F.col("_n") <= cap).drop("_n"), rows.filter(F.col("_n") > cap).drop("_n")


def poll_changes(read: Callable[[], DataFrame], handle: Callable[[DataFrame], DataFrame], stamp: int, cap: int, keep: Callable[[int], None], rounds: int = 1000) -> int:
    """Read (reference, change_ms, ...) from `stamp` on in portions of `cap`, until a round brings the stamp no further; returns the last stamp.

    `handle` gives (reference, result ok / failed) of a portion; the row held back after it counts as held. Each new stamp is given to
    `keep` once its portion is handled, so a run that starts from a kept stamp misses nothing; rows at the stamp itself may come again.
    """
    for _ in range(rounds):
        batch = read().filter(F.col("change_ms").isNull() | (F.col("change_ms") >= stamp))
        portion, held = capped_extract(batch, cap, ["change_ms", "reference"])
        portion = cut(portion)
        outcome = cut(handle(portion).select("reference", "result").unionByName(held.select("reference", F.lit("held").alias("result"))))
        seen = portion.select("reference", "change_ms").unionByName(held.select("reference", "change_ms"))
        new = changed_since(seen, outcome, stamp)[1].first()[0]
        if new <= stamp:
            return stamp
        stamp = int(new)
        keep(stamp)
    return stamp


def validate_payload(df: DataFrame, rules: dict[str, tuple[int, int]] = RULES) -> tuple[DataFrame, DataFrame]:
    """Rows within the length limits, and the others with their error codes."""
    errors = []
    for name, (low, high) in rules.items():
        if name in df.columns:
            n = F.length(F.coalesce(F.trim(name), F.lit("")))
            errors += [F.when(n < low, F.lit(f"{name}:required")), F.when(n > high, F.lit(f"{name}:too_long"))]
    errors += [F.lit(f"{c}:unknown") for c in df.columns if c not in rules]
    rows = df.withColumn("errors", F.array_compact(F.array(*errors)))
    return rows.filter(F.size("errors") == 0).drop("errors"), rows.filter(F.size("errors") > 0)


def read_labeled_csv(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """Labelled rows; comment lines are skipped, a missing column is an error."""
    df = spark.read.csv(path, header=True, comment="#", encoding="UTF-8")
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def flatten_taxonomy(df: DataFrame, json: str) -> DataFrame:
    """{system: {service: [offering]}} as rows, a service without offerings included."""
    m = df.select(F.explode(F.from_json(json, "map<string,map<string,array<string>>>")).alias("system", "services"))
    return m.select("system", F.explode("services").alias("service", "offerings")).select("system", "service", F.explode_outer("offerings").alias("offering"))


def suggestion_payload(df: DataFrame) -> Column:
    """(affected_system, service, severity, similar, suggestions, confidence) as one JSON document."""
    return F.to_json(F.struct(F.struct("affected_system", "service", "severity").alias("classification"), F.col("similar").alias("similar_ticket_ids"), F.slice("suggestions", 1, 3).alias("suggestions"), "confidence"), {"ignoreNullFields": "false"})


def write_results(df: DataFrame, path: str, fmt: str, mask: Sequence[str] = ()) -> None:
    """CSV or JSON lines with the named texts masked."""
    for c in mask:
        df = df.withColumn(c, S.mask_pii(F.col(c)))
    df.write.mode("overwrite").format({"jsonl": "json"}.get(fmt, fmt)).options(header=True).save(path)


def cluster_snapshot(cl: DataFrame, mb: DataFrame, st: DataFrame) -> DataFrame:
    """Name, dominant system and service, and size of each cluster with members."""
    from ticketflow.operators.aggs import dominant_labels

    rows = mb.select("cluster_id", "ticket_id").join(st.select("ticket_id", "affected_system", "service"), "ticket_id")
    size = rows.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    return cl.select("cluster_id", "name").join(size, "cluster_id").join(dominant_labels(rows, ["cluster_id"]), "cluster_id", "left")


def backfill_batch(df: DataFrame, known: DataFrame, key: str, size: int = 200, parts: int = 64) -> DataFrame:
    """Rows whose reference is new, once each, with batch numbers of at most `size` rows; numbered inside hash parts, so that no task gets all rows."""
    new = df.dropDuplicates([key]).join(known.select(key).distinct(), key, "left_anti").withColumn("part", F.pmod(F.xxhash64(key), F.lit(parts)))
    return new.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1) / size))
