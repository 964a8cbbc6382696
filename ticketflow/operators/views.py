"""Projections and searches over tickets and clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketflow.functions import scalars as S
from ticketflow.operators.aggs import cluster_summary
from ticketflow.operators.joins import small
from ticketflow.operators.lineage import cut


def combine_texts(turns: DataFrame, most: int = 20_000) -> DataFrame:
    """(ticket_id, turn, role, text) -> ticket_id, text: a ticket's non-empty turns in order, headed by their role, up to `most` characters."""
    each = turns.filter("text <> ''").groupBy("ticket_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    text = F.array_join(F.transform("turns", lambda x: F.concat(F.lit("["), x["role"], F.lit("]\n"), x["text"])), "\n\n")
    return each.select("ticket_id", F.substring(text, 1, most).alias("text"))


def list_tickets(st: DataFrame, status: str | None = None, system: str | None = None, limit: int = 50, offset: int = 0, classification_status: str | None = None) -> DataFrame:
    """A page of tickets, newest first, of a status, a classification status and a system if they are given."""
    if status is not None:
        st = st.filter(S.local_status(F.col("source_status")) == status)
    if classification_status is not None:
        st = st.filter(F.col("classification_status") == classification_status)
    if system is not None:
        st = st.filter(F.col("affected_system") == system)
    return st.orderBy(F.desc("created_at"), "ticket_id").offset(offset).limit(limit)


#: Characters of a posting's gram, and folders of each search table.
GRAM, BUCKETS = 3, 64


def _searched() -> Column:
    """What a search looks at, in lower case; a character that no one types keeps the parts apart."""
    return F.lower(F.concat_ws("\x00", F.coalesce("title", F.lit("")), F.col("ticket_id").cast("string"), F.coalesce("description", F.lit(""))))


def _grams(texts: DataFrame) -> DataFrame:
    """A row for each distinct gram of each text, as `gram`: its code points in one number, mixed so that every bit tells (no two grams share one)."""
    kept = [c for c in texts.columns if c != "text"]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                found = []
                for text in part.column("text").to_pylist():
                    at = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
                    ends = max(0, len(at) - GRAM + 1)
                    gram = np.zeros(ends, np.uint64)
                    for k in range(GRAM):
                        gram = gram << np.uint64(21) | at[k : k + ends]
                    gram = np.unique(gram) * np.uint64(0x9E3779B97F4A7C15)
                    found.append((gram ^ gram >> np.uint64(32)).view(np.int64))
                rows = pa.array(np.repeat(np.arange(len(found)), [len(g) for g in found]))
                yield pa.RecordBatch.from_arrays([*[part.column(c).take(rows) for c in kept], pa.array(np.concatenate(found))], [*kept, "gram"])

    schema = ", ".join([*[f"{c} {texts.schema[c].dataType.simpleString()}" for c in kept], "gram long"])
    return texts.filter(F.length("text") >= GRAM).mapInArrow(each, schema)


def save_search(st: DataFrame, path: str) -> None:
    """Write the tables that a search reads: texts, dealt by a hash of the ticket, and postings (gram, ticket_id), dealt by gram."""
    texts = st.select("ticket_id", _searched().alias("text")).withColumn("bucket", F.pmod(F.xxhash64("ticket_id"), F.lit(BUCKETS)).cast("int"))
    texts.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/texts")
    postings = _grams(texts.select("ticket_id", "text")).withColumn("bucket", F.pmod("gram", F.lit(BUCKETS)).cast("int"))
    postings.repartition("bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{path}/postings")


def search_tickets(spark: SparkSession, path: str, text: str) -> DataFrame:
    """ticket_id of the tickets whose title, id or description holds the text, in any case.

    Tickets that have all of the text's grams are the only ones whose text is read: postings and texts are pruned to the
    folders of those grams and tickets. A text shorter than a gram is looked for in all texts.
    """
    wanted = text.lower()
    texts = spark.read.parquet(f"{path}/texts")
    if len(wanted) >= GRAM:
        hashes = [r["gram"] for r in _grams(spark.createDataFrame([(wanted,)], "text string")).collect()]
        postings = spark.read.parquet(f"{path}/postings").filter(F.col("bucket").isin(sorted({h % BUCKETS for h in hashes})) & F.col("gram").isin(hashes))
        found = cut(postings.groupBy("ticket_id").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") == len(hashes)).select("ticket_id", F.pmod(F.xxhash64("ticket_id"), F.lit(BUCKETS)).cast("int").alias("b")))
        held = [r["b"] for r in found.select("b").distinct().collect()]  # BUCKETS at most
        texts = texts.filter(F.col("bucket").isin(held)).join(small(found.select("ticket_id")), "ticket_id", "left_semi")
    return texts.filter(F.contains("text", F.lit(wanted))).select("ticket_id")


def search_clusters(cl: DataFrame, mb: DataFrame, st: DataFrame, text: str = "", team: str | None = None, system: str | None = None, severity: str | None = None, tables: str | None = None) -> DataFrame:
    """Summaries of clusters whose name, or a member's title, id or description, holds the text in any case; largest first, then by severity.

    With a team only its tickets count as members, and clusters without any are left out; system and severity are the cluster's. With
    `tables` (see save_search) the text is looked up there, else in all members' texts.
    """
    summary = cluster_summary(cl, mb, st).drop("n")
    mine = st if team is None else st.filter(F.col("assign_group") == team)
    members = mb.select("cluster_id", "ticket_id").join(mine.select("ticket_id"), "ticket_id")
    out = summary.join(members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")), "cluster_id")
    if system is not None:
        out = out.filter(F.col("system") == system)
    if severity is not None:
        out = out.filter(F.col("worst") == severity)
    if text.strip():
        wanted = text.strip().lower()
        tickets = search_tickets(st.sparkSession, tables, wanted) if tables else mine.filter(F.contains(_searched(), F.lit(wanted))).select("ticket_id")
        hits = members.join(tickets.hint("merge"), "ticket_id", "left_semi").select("cluster_id").distinct().withColumn("hit", F.lit(True))
        out = out.join(hits.hint("merge"), "cluster_id", "left").filter(F.coalesce("hit", F.contains(F.lower("name"), F.lit(wanted)))).drop("hit")
    return out.orderBy(F.desc("n"), S.severity_rank(F.col("worst")).desc(), "cluster_id")


def routed_projection(st: DataFrame) -> DataFrame:
    """Severity only for the kinds that are clustered, and for the others the service without its offering."""
    clustered = S.ticket_kind(F.col("ticket_kind")).isin(*S.CLUSTER_KINDS)
    service = F.when(clustered, F.col("service")).otherwise(F.coalesce(S.offering_key(F.col("service")), "service"))
    return st.select("ticket_id", F.when(clustered, F.col("severity")).alias("severity"), service.alias("service"))
