"""Scans of dealt keys give what windows over whole keys give, and a hot key's rows reach many tasks."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ticketflow.operators import joins as J
from ticketflow.operators import scan
from ticketflow.operators import windows as W


@pytest.fixture(scope="module")
def events(spark):
    """One key has 90 % of the rows; a null key, keys of one row, equal times, long runs of failures."""
    rng = random.Random(3)
    rows, t, run = [], 0, 0
    for k in range(2000):
        t += rng.choice([0, 1, 1, 2, 30])
        run = rng.choice([0, 0, 3, 12]) if run <= 0 else run - 1
        rows.append(("hot" if k % 10 else rng.choice([None, "a", "b", f"k{k}"]), k, t, "failed" if run > 0 else "ok"))
    return spark.createDataFrame(rows, "key string, attempt_id long, t long, outcome string").withColumn("ts", F.timestamp_seconds(F.col("t") * 3600)).withColumn("ticket_id", F.col("attempt_id")).repartition(5)


@pytest.fixture(params=[10**6, 60])
def segment(request, monkeypatch):
    monkeypatch.setattr(scan, "SEGMENT", request.param)
    return request.param


def same(a, b):
    a, b = a.select(*sorted(b.columns)), b.select(*sorted(b.columns))
    assert a.count() == b.count() and a.exceptAll(b).isEmpty()


def test_dealt_rows(events, monkeypatch):
    monkeypatch.setattr(scan, "SEGMENT", 60)
    rows, several = scan.deal(events, ["key"], ["ts", "attempt_id"])
    parts = rows.groupBy("key", "_part").agg(F.count("*").alias("n"), F.min("t").alias("low"), F.max("t").alias("high")).orderBy("key", "_part").collect()
    hot = [r for r in parts if r["key"] == "hot"]
    assert several and len(hot) > 20 and max(r["n"] for r in hot) < 200 and rows.count() == 2000
    assert all(a["high"] <= b["low"] for a, b in zip(hot, hot[1:]))
    assert all(r["_part"] == -1 for r in parts if r["key"] in ("a", "b", "k0"))


def test_batches(events, segment):
    w = Window.partitionBy("key").orderBy("ts", "attempt_id")
    same(W.batch_assign(events, 20, ["key"], ["ts", "attempt_id"]), events.withColumn("batch", F.floor((F.row_number().over(w) - 1) / 20)))


def test_batches_of_all_rows(events, segment):
    w = Window.partitionBy(F.lit(0)).orderBy("attempt_id")
    same(W.batch_assign(events.withColumn("one", F.lit(1)), 7, ["one"], ["attempt_id"]).drop("one"), events.withColumn("batch", F.floor((F.row_number().over(w) - 1) / 7)))


@pytest.mark.parametrize("k", [3, 5, 12])
def test_circuit_breaker(events, segment, k):
    """Few keys trip early: the hot key is cut into keys that trip at different places, too."""
    rows = events.withColumn("key", F.when((F.col("key") == "hot") & (F.col("attempt_id") > 700), "late").otherwise(F.col("key")))
    order = [r for r in sorted(rows.collect(), key=lambda r: r["attempt_id"])]
    want, run, gone = {}, {}, set()
    for r in order:
        want[r["attempt_id"]] = r["key"] not in gone
        run[r["key"]] = run.get(r["key"], 0) + 1 if r["outcome"] != "ok" else 0
        if run[r["key"]] >= k:
            gone.add(r["key"])
    assert {r["attempt_id"]: r["attempted"] for r in W.circuit_breaker(rows, "key", k).collect()} == want


def test_gap_dedupe(events, segment):
    w = Window.partitionBy("key").orderBy("ts", "ticket_id")
    m = F.unix_micros("ts")
    fresh = (F.lag(m).over(w).isNull() | (m - F.lag(m).over(w) >= 86_400_000_000)).cast("int")
    rows = events.withColumn("f", fresh).withColumn("island", F.sum("f").over(w)).groupBy("key", "island").agg(F.count("*").alias("occurrence_count"), F.min("ticket_id").alias("ticket_id"), F.min(m).alias("first_seen"), F.max(m).alias("last_seen"))
    same(W.gap_dedupe(events, F.col("key"), "ts", 1), rows)


def test_state_changes(events, segment):
    w = Window.partitionBy("key").orderBy("ts", "attempt_id")
    rows = events.withColumn("b", F.lag("outcome").over(w)).filter("b <> outcome").withColumn("change", F.when(F.col("outcome") == "failed", "DOWN").otherwise("RECOVERED")).drop("b")
    same(W.state_changes(events, "key", ["ts", "attempt_id"], "outcome", "failed"), rows)


def test_member_details(events, segment):
    mb = events.select(F.col("key").alias("cluster_id"), "ticket_id", F.lit("llm").alias("assigned_by"), F.col("ts").alias("assigned_at"))
    st = events.select("ticket_id", F.lit("x").alias("title"))
    w = Window.partitionBy("cluster_id").orderBy("assigned_at", "ticket_id")
    same(J.member_details(mb, st), mb.withColumn("position", F.row_number().over(w)).withColumn("title", F.lit("x")))
