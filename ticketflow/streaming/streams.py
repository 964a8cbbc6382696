"""Structured Streaming forms of intake, deduplication and state (ST1-ST8). Event times are timestamps with zone."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from ticketflow.operators.joins import cluster_index, shortlist
from ticketflow.operators.lineage import cut


def ingest_once(stream: DataFrame, ref: str, ts: str, delay: str = "1 hour") -> DataFrame:
    """ST1: the first row of each reference; replays within the delay do nothing."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([ref])


def once_sink(path: str, ref: str, ts: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """ST1, table sink: a function for foreachBatch that adds each reference to the table once, however late or often it comes again.

    The table is dealt by a hash of the reference, so a batch is joined with the buckets that it touches alone. A batch writes
    its own folder and does not look at it: run again, it replaces what it wrote. Of a reference's rows in a batch the earliest counts.
    """

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c != ts]
        first = batch.groupBy(F.col(ref).alias("_ref")).agg(F.min(F.struct(ts, *rest)).alias("_x")).select(*[F.col("_x")[c].alias(c) for c in batch.columns])
        rows = cut(first.withColumn("bucket", F.pmod(F.xxhash64(ref), F.lit(buckets)).cast("int")))
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        old = folder.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch_no=*"))
        if len(old):
            touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # `buckets` at most
            known = spark.read.option("basePath", path).schema(f"{ref} {batch.schema[ref].dataType.simpleString()}, bucket int, batch_no long").parquet(path)
            known = known.filter(F.col("bucket").isin(touched) & (F.col("batch_no") != n)).select(ref)
            rows = rows.join(known.hint("merge"), ref, "left_anti")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch_no={n}")

    return write


def job_state(attempts: DataFrame, now: Column, base_s: int = 5, max_attempts: int = 5, stuck_minutes: int = 15) -> DataFrame:
    """ST2, batch: (reference, attempt_id, outcome ok / failed / processing, ts) folded to each job's state."""
    failed = F.count_if(F.col("outcome") == "failed")
    rows = attempts.groupBy("reference").agg(failed.alias("failures"), F.max((F.col("outcome") == "ok").cast("int")).alias("done"), F.max_by(F.struct("outcome", "ts"), "attempt_id").alias("last"))
    late = F.col("last.ts").cast("timestamp") < now - F.make_interval(mins=F.lit(stuck_minutes))
    status = F.when(F.col("done") == 1, "succeeded").when(F.col("failures") >= max_attempts, "flagged").when(F.col("last.outcome") == "failed", "retryable").when(late, "retryable").otherwise("processing")
    retry = F.unix_micros(F.col("last.ts").cast("timestamp")) + F.col("failures") * F.lit(base_s * 1_000_000)
    return rows.select("reference", "failures", status.alias("status"), F.when(status == "retryable", retry).alias("next_retry_us"))


class JobFold(StatefulProcessor):
    """A job's attempts so far, each once; a timer turns a job that is stuck in processing into a retryable one, another forgets an ended one."""

    def __init__(self, base_s: int, max_attempts: int, stuck_ms: int, keep_ms: int):
        self.base_us, self.max_attempts, self.stuck_ms, self.keep_ms = base_s * 1_000_000, max_attempts, stuck_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "attempt_id long", "outcome string")
        self.job = handle.getValueState("job", "failures long, done boolean, attempt_id long, outcome string, us long")

    def _answer(self, key: tuple, now_ms: int) -> pd.DataFrame:
        failures, done, _, outcome, us = self.job.get()
        late = outcome == "processing" and us // 1000 + self.stuck_ms < now_ms
        status = "succeeded" if done else "flagged" if failures >= self.max_attempts else "retryable" if outcome == "failed" or late else "processing"
        retry = us + failures * self.base_us if status == "retryable" else None
        return pd.DataFrame({"reference": [key[0]], "failures": [failures], "status": [status], "next_retry_us": pd.array([retry], dtype="Int64")})

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        failures, done, newest, outcome, us = self.job.get() if self.job.exists() else (0, False, -1, "", 0)
        for frame in rows:
            for attempt, result, at in zip(frame["attempt_id"].tolist(), frame["outcome"].tolist(), frame["us"].tolist()):
                if self.seen.containsKey((attempt,)):
                    continue
                self.seen.updateValue((attempt,), (result,))
                failures, done = failures + (result == "failed"), done or result == "ok"
                if attempt > newest:
                    newest, outcome, us = attempt, result, at
        self.job.update((failures, done, newest, outcome, us))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        ended = done or failures >= self.max_attempts
        if ended or outcome == "processing":
            self.handle.registerTimer(us // 1000 + (self.keep_ms if ended else self.stuck_ms) + 1)
        yield self._answer(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        failures, done, _, _, _ = self.job.get()
        if done or failures >= self.max_attempts:
            self.seen.clear()
            self.job.clear()
        else:
            yield self._answer(key, expiredTimerInfo.getExpiryTimeInMs() + 1)

    def close(self) -> None:
        pass


def job_state_stream(attempts: DataFrame, base_s: int = 5, max_attempts: int = 5, stuck_minutes: int = 15, keep_days: int = 30, delay: str = "1 hour") -> DataFrame:
    """ST2, stream: (reference, attempt_id, outcome, ts) -> a job's failures, status and next retry, whenever rows or a timer change them.

    The clock is the watermark. An attempt that comes twice counts once, in any order. What an ended job needs is forgotten
    `keep_days` after its end. Needs the session's state store to be RocksDB (see rocksdb).
    """
    rows = attempts.withColumn("us", F.unix_micros("ts")).withWatermark("ts", delay).select("reference", "attempt_id", "outcome", "us", "ts")
    fold = JobFold(base_s, max_attempts, stuck_minutes * 60_000, keep_days * 86_400_000)
    return rows.groupBy("reference").transformWithStateInPandas(fold, "reference long, failures long, status string, next_retry_us long", "Update", "EventTime")


def latest_status(stream: DataFrame) -> DataFrame:
    """ST3: the newest status of each reference, by update mode."""
    return stream.groupBy("reference").agg(F.max_by("source_status", F.struct("updated_at", "update_id")).alias("source_status"), F.max("updated_at").alias("updated_at"))


def stream_gap_dedupe(stream: DataFrame, key: str, ts: str, gap: timedelta = timedelta(days=7), delay: str = "1 hour") -> DataFrame:
    """ST4: W10 online: sightings of a key less than `gap` after the one before are one session."""
    w = F.session_window(ts, f"{round(gap.total_seconds() * 1_000_000) - 1} microseconds")  # a session takes in what comes just at its end
    return stream.withWatermark(ts, delay).groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("occurrence_count"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen")).drop("w")


def arrival_counts(stream: DataFrame, ts: str, by: str, size: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """ST5: arrivals by type in tumbling or sliding windows; rows behind the watermark are dropped."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return stream.withWatermark(ts, delay).groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


def assign_on_arrival(stream: DataFrame, cl: DataFrame, mb: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """ST6: the shortlist of every micro-batch's tickets against the clusters, given to `sink`. The clusters' index is built once and its tables serve all batches."""
    index = cluster_index(cl, mb)
    return stream.writeStream.foreachBatch(lambda df, n: sink(shortlist(df, index), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class OrderedChanges(StatefulProcessor):
    """Rows of a service wait until the watermark has passed them, and are then compared in order of time."""

    def __init__(self, bad: str):
        self.bad = bad

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us binary, event_id binary, code binary, names array<string>")  # an item holds many rows, as arrays
        self.before = handle.getValueState("before", "status string")

    def _wake(self, least: int | None) -> None:
        """Keep one timer, for the earliest row that waits."""
        timers = list(self.handle.listTimers())
        due = [] if least is None else [least // 1000 + 1]
        for timer in timers:
            self.handle.deleteTimer(timer)
        if due or timers:
            self.handle.registerTimer(min(due + timers))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        least = []
        for frame in rows:
            if len(frame):
                us = frame["us"].to_numpy(np.int64)
                least.append(int(us.min()))
                self._keep(us, frame["event_id"].to_numpy(np.int64), *pd.factorize(frame["status"]))
        self._wake(min(least) if least else None)
        return iter(())

    def _keep(self, us: np.ndarray, event_id: np.ndarray, code: np.ndarray, names: np.ndarray) -> None:
        self.waiting.appendValue((us.tobytes(), event_id.tobytes(), code.astype(np.int32).tobytes(), [str(n) for n in names]))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = timerValues.getCurrentWatermarkInMs() * 1000
        items = [(np.frombuffer(us, np.int64), np.frombuffer(event_id, np.int64), np.frombuffer(code, np.int32), names) for us, event_id, code, names in (self.waiting.get() if self.waiting.exists() else [])]
        self.waiting.clear()
        names = sorted({n for item in items for n in item[3]})
        ready, least = [], []
        for us, event_id, code, own in items:
            later = us >= due
            if later.any():
                least.append(int(us[later].min()))
                self._keep(us[later], event_id[later], code[later], np.array(own, object))
            ready.append((us[~later], event_id[~later], np.array([*[names.index(n) for n in own], -1], np.int32)[code[~later]]))  # no status: -1
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self._wake(min(least) if least else None)
        us, event_id, code = (np.concatenate(c) for c in zip(*ready)) if ready else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))
        if not len(us):
            return
        order = np.lexsort((code, event_id, us))
        event_id, code = event_id[order], code[order]
        before = self.before.get()[0] if self.before.exists() else None
        previous = np.append(-1 if before is None else names.index(before) if before in names else len(names), code[:-1])
        at = np.flatnonzero((code != previous) & (code >= 0) & (previous >= 0))
        self.before.update((names[code[-1]] if code[-1] >= 0 else None,))
        for k in range(0, len(at), 50_000):
            some = at[k : k + 50_000]
            change = np.where(code[some] == (names.index(self.bad) if self.bad in names else -1), "DOWN", "RECOVERED")
            yield pd.DataFrame({"service": key[0], "event_id": event_id[some], "change": change})

    def close(self) -> None:
        pass


def probe_changes(stream: DataFrame, bad: str = "unreachable", delay: str = "1 hour") -> DataFrame:
    """ST7: W11 online: (service, ts, event_id, status) -> changes of a service's status in order of ts and event_id, once the watermark has passed them.

    So rows may come in any order inside `delay`; later ones are dropped. Needs the session's state store to be RocksDB (see rocksdb).
    """
    rows = stream.withColumn("us", F.unix_micros("ts")).withWatermark("ts", delay).select("service", "event_id", "status", "us", "ts")
    return rows.groupBy("service").transformWithStateInPandas(OrderedChanges(bad), "service string, event_id long, change string", "Append", "EventTime")


def rocksdb(spark: SparkSession) -> dict[str, str]:
    """Set the state store that timers need, for streams that start from now on; returns what was set before."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = {name: spark.conf.get(name)}
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return before


def incremental_extract(spark: SparkSession, path: str, schema, fmt: str = "parquet", files: int = 100) -> DataFrame:
    """ST8: new files of a folder as a stream; the checkpoint takes the place of a stamp."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files).load(path)


def latest_of(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of rows that update mode wrote more than once, the last of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order]))).filter("_r = 1").drop("_r")
