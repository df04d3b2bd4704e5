"""Streams that are run in pieces, broken off and started again, with late and repeated rows."""

import time
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from gristmill.streaming import runs
from gristmill.streaming.progress import progress_state
from pyspark.sql import functions as F

AT = datetime(2024, 5, 1, 8)


class Log:
    """JSON files that a stream reads one after the other."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, Path(folder), schema, 0
        self.folder.mkdir()

    def add(self, *rows):
        self.spark.createDataFrame(list(rows), self.schema).coalesce(1).write.json(str(self.folder / f"part{self.n}"))
        self.n += 1
        time.sleep(0.02)  # files are read in the order of their times

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).json(str(self.folder))

    def table(self):
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", True).json(str(self.folder))


def test_progress_over_batches_and_a_restart(spark, tmp_path):
    log = Log(spark, tmp_path / "log", "run string, seq long, ts timestamp, line string")
    s = lambda k: AT + timedelta(seconds=k)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    log.add(("a", 1, s(0), "[INFO] x.docx: 9 chunks"), ("a", 2, s(10), "[PROGRESS] x.docx chunk 1/9"), ("b", 1, s(0), "  [1/5] Q1"), ("c", 1, s(5), "nothing told"))
    got = {r.run: r for r in runs.run_live_progress(log.stream(), out, state, "100 seconds", "0 seconds").collect()}
    assert (got["a"].chunk_done, got["a"].chunk_total, got["a"].elapsed_s, got["a"].eta_s) == (1, 9, 10, None)  # one chunk tells no pace
    assert (got["b"].item_done, got["b"].item_total, got["c"].events, got["c"].lines) == (1, 5, 0, 1)
    log.add(("a", 4, s(40), "[PROGRESS] x.docx chunk 4/9"), ("a", 3, s(30), "[PROGRESS] x.docx chunk 3/9"), ("b", 2, s(20), "  [2/5] Q2"))
    log.add(("a", 5, s(200), "[WARN] LLM call failed (attempt 2/3): x -> sleep 2.5s"))
    got = {r.run: r for r in runs.run_live_progress(log.stream(), out, state, "100 seconds", "0 seconds").collect()}
    assert (got["a"].chunk_done, got["a"].elapsed_s, got["a"].eta_s, got["a"].retry_attempt, got["a"].idle) == (4, 200, 250, 2, False)
    assert (got["b"].item_done, got["b"].elapsed_s, got["b"].eta_s, got["b"].idle, got["c"].idle) == (2, 20, 30, True, True)  # silent for more than 100 seconds
    want = {r.run: r for r in progress_state(log.table()).collect()}
    figures = [c for c in want["a"].__fields__]
    assert {r: tuple(got[r][c] for c in figures) for r in got} == {r: tuple(want[r][c] for c in figures) for r in want}
    n = len(list(Path(out).glob("batch=*")))
    log.add(("b", 3, s(210), "  [4/5] Q4"))
    got = {r.run: r for r in runs.run_live_progress(log.stream(), out, state, "100 seconds", "0 seconds").collect()}
    assert (got["b"].item_done, got["b"].lines, got["b"].idle, got["a"].lines) == (4, 3, False, 5)
    changed = spark.read.parquet(*[str(p) for p in Path(out).glob("batch=*") if int(p.name[6:]) >= n]).select("run").distinct().collect()
    assert [r.run for r in changed] == ["b"]  # update mode: other runs are not written again


def test_locks_expire_by_themselves(spark, tmp_path):
    log = Log(spark, tmp_path / "log", "case_id string, seq long, owner string, action string")
    out, state, ttl = str(tmp_path / "out"), str(tmp_path / "state"), 25

    def run(*rows):
        log.add(*rows)
        with runs.rocks_state(spark, empty_batches=False):
            runs.lock_outcomes(log.stream(), f"{ttl} seconds").writeStream.outputMode("append").foreachBatch(runs.write_batches(out)).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
        seqs = {r[1] for r in rows}
        return {r.seq: r.outcome for r in runs.committed(spark, out, state, runs.LOCK_OUTCOME).collect() if r.seq in seqs}

    began = time.time()
    assert run(("x", 1, "ann", "acquire"), ("y", 2, "ann", "acquire"), ("z", 3, "ann", "acquire"), ("x", 4, "bob", "acquire"), ("z", 5, "bob", "release"), ("z", 6, "ann", "release"), ("z", 7, "bob", "acquire")) == {1: "acquired", 2: "acquired", 3: "acquired", 4: "denied", 5: "ignored", 6: "released", 7: "acquired"}
    second = run(("x", 10, "ann", "acquire"), ("y", 11, "bob", "acquire"))
    if time.time() - began > ttl - 2:
        pytest.skip("this machine is too slow for the lock's time")
    assert second == {10: "renewed", 11: "denied"}
    time.sleep(ttl + 2)
    assert run(("x", 20, "bob", "acquire"), ("y", 21, "bob", "acquire"), ("z", 22, "bob", "release")) == {20: "acquired", 21: "acquired", 22: "ignored"}


def test_lock_periods_of_a_stream_are_those_of_the_table(spark, tmp_path):
    log = Log(spark, tmp_path / "log", "case_id string, ts timestamp")
    h = lambda k: AT + timedelta(hours=k)
    log.add(("x", h(0)), ("x", h(1)), ("y", h(0)))
    log.add(("x", h(2.5)), ("y", h(2)), ("z", h(3)))  # y's lock is renewed in its last moment
    log.add(("x", h(9)), ("end", h(40)))
    log.add(("end", h(41)))
    with runs.rocks_state(spark):
        out, state = str(tmp_path / "out"), str(tmp_path / "state")
        runs.lock_periods(log.stream()).writeStream.outputMode("append").foreachBatch(runs.write_batches(out)).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    schema = "case_id string, acquired timestamp, expires timestamp, renewals long"
    closed = lambda df: sorted(map(tuple, df.where("case_id <> 'end'").select("case_id", "acquired", "expires", "renewals").collect()))
    assert closed(runs.committed(spark, out, state, schema)) == closed(runs.lock_periods(log.table())) == [("x", h(0), h(4.5), 3), ("x", h(9), h(11), 1), ("y", h(0), h(4), 2), ("z", h(3), h(5), 1)]


def test_late_and_repeated_errors(spark, tmp_path):
    log = Log(spark, tmp_path / "log", "event_id long, case_id string, ts timestamp, kind string")
    m = lambda k: AT + timedelta(minutes=k)
    log.add((1, "x", m(1), "error"), (1, "x", m(1), "error"), (2, "x", m(50), "retry"), (3, "y", m(5), "ok"))
    log.add((1, "x", m(1), "error"), (4, "x", m(45), "error"), (5, "y", m(70), "error"))  # 1 comes again; 4 is late, but not by more than the delay
    log.add((6, "x", m(200), "error"))
    log.add((7, "x", m(20), "error"), (8, "x", m(195), "retry"))  # 7 is too late
    log.add((9, "x", m(2_000), "error"))
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    with runs.rocks_state(spark):
        runs.error_windows(log.stream()).writeStream.outputMode("append").foreachBatch(runs.write_batches(out)).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    got = runs.committed(spark, out, state, "case_id string, start timestamp, errors long, retries long")
    rows = sorted(map(tuple, got.drop("batch").collect()))
    assert rows == [("x", m(0), 2, 1), ("x", m(180), 1, 1), ("y", m(60), 1, 0)]
    whole = sorted(map(tuple, runs.error_windows(log.table()).collect()))
    assert [r for r in whole if r not in rows] == [("x", m(0), 3, 1), ("x", m(1980), 1, 0)]  # a table has no late rows


def test_chunks_are_done_once_over_broken_runs(spark, tmp_path):
    log = Log(spark, tmp_path / "log", "file string, chunk int, text string")
    out, state, schema = str(tmp_path / "out"), str(tmp_path / "state"), "file string, chunk int, text string, run int"
    log.add(*[("a", k, f"a{k}") for k in range(5)], ("a", 0, "a0"))
    log.add(*[("a", k, "again") for k in range(3)], ("b", 1, "b1"))
    log.add(("b", 1, "again"), ("b", 2, "stop here"), ("b", 3, "b3"))

    def run(number, stops=False):
        def work(df):
            if stops and not df.where("text = 'stop here'").isEmpty():
                raise RuntimeError("stopped")
            return df.withColumn("run", F.lit(number))

        runs.once_each(log.stream(), work, out, state).awaitTermination()

    told = lambda: sorted((r.file, r.chunk, r.run) for r in runs.committed(spark, out, state, schema).collect())
    with pytest.raises(Exception, match="stopped"):
        run(1, stops=True)
    assert told() == [*[("a", k, 1) for k in range(5)], ("b", 1, 1)]
    run(2)
    finished = [*[("a", k, 1) for k in range(5)], ("b", 1, 1), ("b", 2, 2), ("b", 3, 2)]
    assert told() == finished
    log.add(("b", 4, "b4"), ("a", 1, "again"))
    run(3)
    last = max(int(p.name) for p in (tmp_path / "state" / "commits").iterdir() if p.name.isdigit())
    assert told() == [*finished, ("b", 4, 3)]
    for p in (tmp_path / "state" / "commits").iterdir():  # as if the stream had ended after the batch's writing, before its note
        if p.name.strip(".").split(".")[0] == str(last):
            p.unlink()
    assert told() == finished  # what is not noted is not read
    run(4)
    assert told() == [*finished, ("b", 4, 4)]
    run(5)
    assert told() == [*finished, ("b", 4, 4)]
    assert runs.committed(spark, str(tmp_path / "none"), state, schema).count() == 0


def test_chunks_that_earlier_runs_have_done_are_left_out(spark, tmp_path):
    log = Log(spark, tmp_path / "log", "file string, chunk int")
    log.add(("c", 1), ("c", 2), ("c", 2), ("d", 1))
    done = spark.createDataFrame([("c", 1), ("c", 1), ("d", 7)], "file string, chunk int")
    runs.once_each(log.stream(), lambda df: df, str(tmp_path / "out"), str(tmp_path / "state"), done=done).awaitTermination()
    assert sorted((r.file, r.chunk) for r in runs.committed(spark, str(tmp_path / "out"), str(tmp_path / "state"), "file string, chunk int").collect()) == [("c", 2), ("d", 1)]
