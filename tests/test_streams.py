"""Streams over shuffled input in many batches against the batch operators, clocks and replays."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from ticketflow.operators import windows as W
from ticketflow.sources import intake as I
from ticketflow.streaming import streams as ST

START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def cut_into(spark, rows, schema, folder, batches):
    """A stream of the rows, a file and batch for each part."""
    size = -(-len(rows) // batches)
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size], schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def ran(spark, stream, mode, folder):
    """What the batches gave, with their number."""
    before = ST.rocksdb(spark)
    write = lambda df, n: df.withColumn("batch_no", F.lit(n)).write.mode("append").parquet(f"{folder}/out")
    stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    for name, value in before.items():
        spark.conf.set(name, value)
    return spark.read.parquet(f"{folder}/out")


def test_probe_changes_on_shuffled_batches(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), START + timedelta(minutes=rng.randrange(600)), k, rng.choice(["ok", "ok", "unreachable"])) for k in range(300)]
    schema = "service string, ts timestamp, event_id long, status string"
    rng.shuffle(rows)
    late = [("a", START + timedelta(days=9), 9999, "ok")]
    stream = cut_into(spark, rows + late, schema, tmp_path / "in", 4)
    got = ran(spark, ST.probe_changes(stream, delay="11 hours"), "append", tmp_path)
    want = W.state_changes(spark.createDataFrame(rows, schema), "service", ["ts", "event_id"], "status", "unreachable").select("service", "event_id", "change")
    assert sorted(map(tuple, got.select("service", "event_id", "change").collect())) == sorted(map(tuple, want.collect()))
    assert got.select("batch_no").distinct().count() >= 1


def test_probes_that_wait_are_kept_as_arrays():
    """A row that waits takes some 20 bytes of a Python worker (as a tuple it took over 200); rows without a status are no change."""
    import tracemalloc

    import pandas as pd

    class Kept(list):
        get, appendValue, exists = (lambda self: iter(list(self))), list.append, (lambda self: len(self) > 0)

        def update(self, value):
            self[:] = [value]

    class Handle:
        timers, states = [], {}
        listTimers = lambda self: iter(list(self.timers))
        registerTimer = lambda self, ms: self.timers.append(ms)
        deleteTimer = lambda self, ms: self.timers.remove(ms)
        getListState = getValueState = lambda self, name, schema: self.states.setdefault(name, Kept())

    class Now:
        getCurrentWatermarkInMs = staticmethod(lambda: 10**12)

    task, n = ST.OrderedChanges("unreachable"), 200_000
    task.init(Handle())
    frames = (pd.DataFrame({"us": range(k, k + 10_000), "event_id": range(k, k + 10_000), "status": ["ok", "unreachable", None, "ok", "ok"] * 2000}) for k in range(0, n, 10_000))
    tracemalloc.start()
    list(task.handleInputRows(("s",), frames, Now))
    assert tracemalloc.get_traced_memory()[0] < 40 * n
    tracemalloc.stop()
    out = pd.concat(list(task.handleExpiredTimer(("s",), Now, None)))
    assert list(out["event_id"]) == list(range(1, n, 5)) and set(out["change"]) == {"DOWN"}
    assert not Handle.timers


def test_gap_dedupe_online_is_gap_dedupe(spark, tmp_path):
    """Gaps of just seven days, one microsecond less and one more, in shuffled batches."""
    rng = random.Random(2)
    rows, ticket = [], 0
    for key in range(12):
        at = START
        for _ in range(12):
            at += rng.choice([timedelta(days=7), timedelta(days=7, microseconds=-1), timedelta(days=7, microseconds=1), timedelta(hours=5), timedelta(0)])
            rows.append((key, at, ticket))
            ticket += 1
    rng.shuffle(rows)
    schema = "key long, ts timestamp, ticket_id long"
    stream = cut_into(spark, rows + [(99, START + timedelta(days=900), ticket)], schema, tmp_path / "in", 6)
    got = ran(spark, ST.stream_gap_dedupe(stream, "key", "ts", delay="400 days"), "append", tmp_path)
    got = got.select("key", "occurrence_count", F.unix_micros("first_seen").alias("a"), F.unix_micros("last_seen").alias("b"))
    want = W.gap_dedupe(spark.createDataFrame(rows, schema), F.col("key"), "ts", 7).select("key", "occurrence_count", F.col("first_seen").alias("a"), F.col("last_seen").alias("b"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


ATTEMPTS = "reference long, attempt_id long, outcome string, ts timestamp"


def test_job_state_by_timers_is_the_batch_form(spark, tmp_path):
    """Attempts in any order and twice; the clock is moved by other jobs' rows until stuck ones are due again."""
    rng = random.Random(3)
    rows = []
    for job in range(40):
        for k in range(rng.randrange(1, 7)):
            rows.append((job, job * 100 + k, rng.choice(["failed", "failed", "failed", "processing", "ok"] if job % 3 else ["failed", "processing"]), START + timedelta(minutes=k, seconds=job)))
    rows += [(50, 5000 + k, "failed", START + timedelta(minutes=k)) for k in range(6)]
    shuffled = rows + rows[::3]
    rng.shuffle(shuffled)
    clock = [(1000 + k, 1, "ok", START + timedelta(hours=3 * (k + 1))) for k in range(3)]
    stream = cut_into(spark, shuffled + clock, ATTEMPTS, tmp_path / "in", 4)
    got = ST.latest_of(ran(spark, ST.job_state_stream(stream, delay="2 hours"), "update", tmp_path).filter("reference < 1000"), ["reference"], ["batch_no"])
    now = F.lit((START + timedelta(hours=7)).isoformat()).cast("timestamp")
    want = ST.job_state(spark.createDataFrame(rows, ATTEMPTS), now)
    columns = ["reference", "failures", "status", "next_retry_us"]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    assert {r["status"] for r in want.collect()} == {"succeeded", "flagged", "retryable"}


def test_a_job_is_processing_until_its_timer_and_forgotten_after_its_end(spark, tmp_path):
    at = lambda **x: START + timedelta(**x)
    steps = [[(1, 1, "processing", at(minutes=0)), (2, 1, "ok", at(minutes=0))], [(9, 1, "ok", at(minutes=10))], [(9, 2, "ok", at(minutes=40))], [(9, 3, "ok", at(days=3))], [(9, 4, "ok", at(days=4))], [(2, 2, "failed", at(days=4))]]
    for step in steps:
        spark.createDataFrame(step, ATTEMPTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ATTEMPTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows = ran(spark, ST.job_state_stream(stream, keep_days=1, delay="1 minute"), "update", tmp_path).orderBy("batch_no").collect()
    told = lambda job: [(r["status"], r["failures"]) for r in rows if r["reference"] == job]
    assert told(1) == [("processing", 0), ("retryable", 0)]
    assert told(2) == [("succeeded", 0), ("retryable", 1)]


def test_once_sink_survives_replays(spark, tmp_path):
    schema = "ref long, ts timestamp, x string"
    sink = ST.once_sink(str(tmp_path / "table"), "ref", "ts", 4)
    day = lambda rows, d: spark.createDataFrame([(r, START + timedelta(days=d, hours=r), f"{r}-{d}") for r in rows], schema)
    table = lambda: sorted((r["ref"], r["x"]) for r in spark.read.parquet(str(tmp_path / "table")).collect())
    sink(day([1, 2, 3], 0).unionByName(day([2], 1)), 0)
    sink(day([3, 4], 1), 1)
    want = [(1, "1-0"), (2, "2-0"), (3, "3-0"), (4, "4-1")]
    assert table() == want
    sink(day([3, 4], 1), 1)  # the batch again
    sink(day([1, 4], 31), 2)  # a month later
    sink(day([1, 2, 3], 0), 3)
    assert table() == want


def test_stamp_is_held_by_a_failed_row_without_a_time(spark):
    df = spark.createDataFrame([(1, 100), (2, 200), (3, None)], "reference int, change_ms long")
    out = lambda third: spark.createDataFrame([(1, "ok"), (2, "ok"), (3, third)], "reference int, result string")
    assert I.changed_since(df, out("failed"), 50)[1].first()[0] == 50
    assert I.changed_since(df, out("ok"), 50)[1].first()[0] == 201


@pytest.mark.parametrize("cap", [2, 100])
def test_poll_changes_restarts_from_its_stamp(spark, cap):
    """A row fails: the stamp waits for it, and goes on once it no longer does; a run that stops and starts again misses nothing."""
    df = spark.createDataFrame([(k, 100 * k) for k in range(1, 9)], "reference int, change_ms long").coalesce(1)
    seen, stamps, failing = [], [0], [True]

    def handle(portion):
        ids = [r["reference"] for r in portion.collect()]
        seen.extend(ids)
        return portion.select("reference", F.when((F.col("reference") == 4) & F.lit(failing[0]), "failed").otherwise("ok").alias("result"))

    assert I.poll_changes(lambda: df, handle, 0, cap, stamps.append) == stamps[-1] == 399
    failing[0] = False
    assert I.poll_changes(lambda: df, handle, stamps[-1], cap, stamps.append) == 801
    assert set(seen) == set(range(1, 9)) and stamps == sorted(stamps)
