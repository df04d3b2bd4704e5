"""Live state of runs as streams: progress with elapsed time and time left, locks that expire by themselves, errors in windows
of event time, and chunks that are done exactly once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from gristmill.functions import scalars as S
from gristmill.streaming.progress import progress_event

ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def rocks_state(spark: SparkSession, empty_batches: bool = True) -> Iterator[None]:
    """Streams that are started here keep their state in RocksDB, which custom state needs; its changes go to the checkpoint.
    empty_batches: whether batches without new rows are run, as timers and closing windows of event time need; by processing
    time there would be no end of them where all that is available is read once."""
    conf = dict([ROCKS, ("spark.sql.streaming.noDataMicroBatches.enabled", str(empty_batches).lower())])
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


# --- what a stream has written


def write_batches(out: str) -> Callable[[DataFrame, int], None]:
    """A sink for foreachBatch that writes each batch to a folder of its own. A batch that is done again, because the
    stream broke off before it noted the batch as done, replaces what it had written."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={batch_id}")

    return write


def committed(spark: SparkSession, out: str, checkpoint: str, schema: str) -> DataFrame:
    """The rows of all batches that the stream has noted as done, with their batch; what a broken batch left is not read."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    commits = fs_path(f"{checkpoint.rstrip('/')}/commits")
    fs = commits.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(commits)] if fs.exists(commits) else []
    last = max((int(n) for n in names if n.isdigit()), default=-1)
    if not fs.exists(fs_path(out)):
        return spark.createDataFrame([], f"{schema}, batch long")
    return spark.read.schema(f"{schema}, batch long").parquet(out).where(F.col("batch") <= last)


# --- progress

#: For each figure the part of an event that it is taken from, and the kinds of events that tell it.
FIGURES = {
    "file_current": ("file", ("chunk", "chunks_total")), "chunk_done": ("done", ("chunk",)), "chunk_total": ("total", ("chunk", "chunks_total")),
    "item_done": ("done", ("item",)), "item_total": ("total", ("item",)), "retry_attempt": ("attempt", ("retry",)),
}
_TYPES = {c: "string" if c == "file_current" else "long" for c in FIGURES}
STATE = "started timestamp, latest timestamp, events long, lines long, " + ", ".join(f"{c} {t}, {c}_seq long" for c, t in _TYPES.items())
REDUCED = "run string, started timestamp, latest timestamp, " + ", ".join(f"{c} {t}" for c, t in _TYPES.items()) + ", events long, lines long, idle boolean"
LIVE = f"{REDUCED}, elapsed_s long, eta_s long"


class ProgressReducer(StatefulProcessor):
    """The state of each run: of each figure the value with the highest seq, the first and the last time, and counts. A run
    without a line for idle_ms of event time is told once as idle; the next line wakes it."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("progress", STATE)

    def row(self, run: str, state: dict, idle: bool) -> pd.DataFrame:
        cells = {"run": run} | {c: state[c] for c in ("started", "latest", *FIGURES, "events", "lines")} | {"idle": idle}
        return pd.DataFrame([cells]).astype({c: "Int64" for c, t in _TYPES.items() if t == "long"})

    def known(self) -> dict:
        names = [c.split()[0] for c in STATE.split(", ")]
        return dict(zip(names, self.state.get(), strict=True)) if self.state.exists() else dict.fromkeys(names) | {"events": 0, "lines": 0}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = self.known()
        for pdf in rows:
            state["lines"] += len(pdf)
            state["events"] += int(pdf["kind"].notna().sum())
            first, last = pdf["ts"].min().to_pydatetime(), pdf["ts"].max().to_pydatetime()
            state["started"] = min(state["started"] or first, first)
            state["latest"] = max(state["latest"] or last, last)
            for figure, (part, kinds) in FIGURES.items():
                told = pdf[pdf["kind"].isin(kinds) & pdf[part].notna()]
                if len(told):
                    best = told.loc[told["seq"].idxmax()]
                    if state[f"{figure}_seq"] is None or best["seq"] > state[f"{figure}_seq"]:
                        state[figure], state[f"{figure}_seq"] = best[part] if part == "file" else int(best[part]), int(best["seq"])
        self.state.update(tuple(state.values()))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t if isinstance(t, int) else t[0])
        self.handle.registerTimer(int(pd.Timestamp(state["latest"], tz="UTC").timestamp() * 1000) + self.idle_ms)
        yield self.row(key[0], state, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self.row(key[0], self.known(), True)

    def close(self) -> None:
        pass


def live_progress(lines: DataFrame, idle: str = "1 hour", delay: str = "0 seconds") -> DataFrame:
    """A row for each run whose state a batch changes: figures as progress_state has them, when it started, its last line,
    whether it is idle, elapsed seconds, and seconds left once two chunks, or else items, are done. lines, a stream: run, seq,
    ts, line. For update mode; what is kept is one row a run."""
    e = lines.withWatermark("ts", delay).select("run", "seq", "ts", progress_event(F.col("line")).alias("e"))
    parts = e.select("run", "seq", "ts", "e.kind", "e.file", "e.done", "e.total", "e.attempt")
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    state = parts.groupBy("run").transformWithStateInPandas(ProgressReducer(idle_ms), outputStructType=REDUCED, outputMode="Update", timeMode="EventTime")
    gone = F.timestamp_diff("SECOND", F.col("started"), F.col("latest"))
    by_chunk = F.coalesce("chunk_total", F.lit(0)) > 0
    done, total = (F.when(by_chunk, F.col(f"chunk_{x}")).otherwise(F.col(f"item_{x}")) for x in ("done", "total"))
    return state.select(*[c.split()[0] for c in REDUCED.split(", ")], gone.alias("elapsed_s"), S.eta(gone, done, total).alias("eta_s"))


def run_live_progress(lines: DataFrame, out: str, checkpoint: str, idle: str = "1 hour", delay: str = "0 seconds") -> DataFrame:
    """Reduces all lines that are there and gives each run's newest state. A batch writes the runs that it changes and no others."""
    spark = lines.sparkSession
    with rocks_state(spark):
        query = live_progress(lines, idle, delay).writeStream.outputMode("update").foreachBatch(write_batches(out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    rows = committed(spark, out, checkpoint, LIVE)
    names = [c for c in rows.columns if c not in ("run", "batch")]
    return rows.groupBy("run").agg(F.max_by(F.struct(*names), F.struct("batch", "idle")).alias("s")).select("run", "s.*")


# --- locks

#: A lock that is not renewed for so long is free again.
HELD_FOR = "2 hours"
LOCK_OUTCOME = "case_id string, seq long, owner string, outcome string"


class LockKeeper(StatefulProcessor):
    """One lock a case, as state that expires by itself: a lock that nobody renews in time is gone, without a sweep."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle) -> None:
        self.lock = handle.getValueState("lock", "owner string", self.ttl_ms)

    def outcome(self, action: str, owner: str) -> str:
        holder = self.lock.get()[0] if self.lock.exists() else None
        if action == "release":
            if holder != owner:
                return "ignored"
            self.lock.clear()
            return "released"
        if holder not in (None, owner):
            return "denied"
        self.lock.update((owner,))
        return "renewed" if holder == owner else "acquired"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        asked = pd.concat(list(rows)).sort_values("seq")
        yield pd.DataFrame({"case_id": key[0], "seq": asked["seq"], "owner": asked["owner"], "outcome": [self.outcome(a, o) for a, o in zip(asked["action"], asked["owner"], strict=True)]})

    def close(self) -> None:
        pass


def lock_outcomes(requests: DataFrame, ttl: str = HELD_FOR) -> DataFrame:
    """What becomes of each request (case_id, seq, owner, action, one of acquire and release) of a stream: acquired, renewed,
    denied while another holds the lock, released, or ignored. A lock is free again when it was not acquired or renewed for ttl."""
    ttl_ms = int(pd.Timedelta(ttl).total_seconds() * 1000)
    rows = requests.select("case_id", "seq", "owner", "action")
    return rows.groupBy("case_id").transformWithStateInPandas(LockKeeper(ttl_ms), outputStructType=LOCK_OUTCOME, outputMode="Append", timeMode="ProcessingTime")


def lock_periods(renewals: DataFrame, held_for: str = HELD_FOR, delay: str = "1 hour") -> DataFrame:
    """case_id, acquired, expires, renewals: when each case was locked, by the event times of its renewals (case_id, ts). The same
    for a table and for a stream, where a period comes out once the watermark is past its end."""
    rows = renewals.withWatermark("ts", delay) if renewals.isStreaming else renewals
    held = rows.groupBy("case_id", F.session_window("ts", held_for)).agg(F.count(F.lit(1)).alias("renewals"))
    return held.select("case_id", F.col("session_window.start").alias("acquired"), F.col("session_window.end").alias("expires"), "renewals")


# --- errors in event time


def error_windows(events: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """case_id, start, errors, cases of retry: the errors of each case by windows of event time. events: event_id, case_id, ts, kind.

    An event that comes again counts once. In a stream, events that come later than delay after the newest are left out, what
    is known of ids and windows is let go once the watermark has passed them, and a window comes out when it is closed."""
    rows = events.where(F.col("kind").isin("error", "retry")).select("event_id", "case_id", "ts", "kind")
    rows = rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else rows.dropDuplicates(["event_id"])
    out = rows.groupBy("case_id", F.window("ts", window)).agg(F.count_if(F.col("kind") == "error").alias("errors"), F.count_if(F.col("kind") == "retry").alias("retries"))
    return out.select("case_id", F.col("window.start").alias("start"), "errors", "retries")


# --- chunks, exactly once


def once_each(chunks: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: tuple[str, ...] = ("file", "chunk"), done: DataFrame | None = None):
    """A started stream that does the work of each chunk once, however often the chunk or the stream comes again.

    Which chunks have come is the stream's state; a batch is written to a folder of its own, which a repetition of the batch
    replaces, and committed() reads finished batches only. So a stream that is stopped at any place, also between a batch's
    writing and its note, goes on without doing a chunk twice or leaving one out. done: chunks that earlier runs, with other
    checkpoints, have done."""
    todo = chunks if done is None else chunks.join(done.select(*key).distinct(), list(key), "left_anti")
    write = write_batches(out)
    return (
        todo.dropDuplicates(list(key)).writeStream.foreachBatch(lambda batch, batch_id: write(work(batch), batch_id))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
