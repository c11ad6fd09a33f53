"""Streams, durable jobs and the trace store over restarts, against plain simulations."""

from __future__ import annotations

import datetime
import random
import tracemalloc

import pandas as pd
import pytest
from pyspark.sql import functions as F

from assayflow.operators import jobs, store
from assayflow.streaming import monitor

T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)


def minutes(m):
    return T0 + datetime.timedelta(minutes=m)


def retained_slow(rows, capacity, keep):
    out = []
    for inst in sorted({r[0] for r in rows}):
        held, last = {}, -1
        for _, seq, at, trace, sampled, negative, payload in sorted((r for r in rows if r[0] == inst), key=lambda r: r[1]):
            if seq <= last:
                continue
            last = seq
            held = {i: x for i, x in held.items() if at - x[1] <= keep}
            if sampled is not None:
                if sampled:
                    out.append((inst, trace, payload, False))
                else:
                    held.pop(trace, None)
                    held[trace] = (payload, at)
                    held = dict(list(held.items())[-capacity:])
            elif negative and trace in held:
                out.append((inst, trace, held.pop(trace)[0], True))
    return sorted(out)


def test_retained_traces_over_restarts(spark, tmp_path):
    """Late and repeated feedback, more traces than the buffer holds, rows handed in twice, and a new query after every file."""
    rng, rows = random.Random(3), []
    for inst in "ab":
        for seq in range(120):
            trace, at = f"{inst}{rng.randrange(seq + 1)}", minutes(seq)
            rows.append((inst, seq, at, f"{inst}{seq}", rng.random() < 0.3, None, f"p{seq}") if rng.random() < 0.6 else (inst, seq, at, trace, None, rng.random() < 0.7, None))
    schema = "instance string, seq long, at timestamp, trace_id string, sampled boolean, negative boolean, payload string"
    parts = [rows[i::2] for i in range(2)]
    ordered = sorted(rows, key=lambda r: r[1])
    chunks = [ordered[i : i + 48] for i in range(0, len(ordered), 48)]
    assert sum(map(len, parts)) == len(rows)
    for i, chunk in enumerate(chunks):
        again = chunks[i - 1][-6:] if i else []  # handed in twice
        spark.createDataFrame(chunk + again, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        q = monitor.retained(stream, 10, "45 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    want = retained_slow(rows, 10, datetime.timedelta(minutes=45))
    assert got == want and any(r[3] for r in want) and not all(r[3] for r in want)


def test_sliding_windows_of_a_stream(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, minutes(rng.randrange(240)), "error" if rng.random() < 0.3 else "view") for i in range(300)]
    spark.createDataFrame(rows, "event_id long, at timestamp, event_type string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("event_id long, at timestamp, event_type string").parquet(f"{tmp_path}/in")
    q = monitor.windowed(stream, "1 hour", "20 minutes").writeStream.format("memory").queryName("slides").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.w.start.replace(tzinfo=datetime.UTC), r.n, r.bad) for r in spark.table("slides").collect()}
    want = set()
    for k in range(-3, 13):
        inside = [r for r in rows if minutes(20 * k) <= r[1] < minutes(20 * k + 60)]
        if inside:
            want.add((minutes(20 * k), len(inside), sum(r[2] == "error" for r in inside)))
    assert got == want


class Crash(Exception):
    pass


def flow(crash_at=None):
    """Three steps; jobs whose source ends in 3 fail twice in the second, those ending in 7 always, those in 5 wait after the first."""
    from pyspark.sql import DataFrame

    def step(name):
        def run(df: DataFrame) -> DataFrame:
            if crash_at == name and df.limit(1).count():
                raise Crash(name)
            ends = F.substring("source", -1, 1)
            bad = (F.lit(name == "extract") & (ends == "3") & (F.col("attempts") < 2)) | (F.lit(name == "extract") & (ends == "7"))
            return df.where(~((ends == "9") & F.lit(name == "check"))).select("job", (~bad).alias("ok"), F.when(bad, "boom").alias("message"), F.concat(F.lit(f"{name}:"), "source").alias("output"), (F.lit(name == "read") & (ends == "5")).alias("wait"))

        return run

    return jobs.Workflow({n: step(n) for n in ("read", "extract", "check")}, max_retries=2)


def test_jobs_over_a_crash(spark, tmp_path):
    folder = str(tmp_path / "jobs")
    sources = spark.createDataFrame([(f"doc{i}",) for i in range(10)] + [("doc1",), (None,)], "source string")
    jobs.submit(sources, folder)
    jobs.submit(sources.limit(3), folder)  # handed in again
    with pytest.raises(Crash):
        jobs.run(spark, folder, flow("extract"))
    half = {r.source: r.state for r in jobs.states(spark, folder, flow()).collect()}
    assert len(half) == 10 and set(half.values()) == {"extract"}
    # A round that was written in part: without its mark it does not count.
    spark.createDataFrame([("x", "extract", "check", True, None, "half", False, 1)], jobs.LOG).write.parquet(f"{folder}/log/round-1")
    (tmp_path / "jobs/log/round-1/_SUCCESS").unlink()
    assert jobs.run(spark, folder, flow()) > 0
    got = {r.source: (r.state, r.attempts, r.waits) for r in jobs.states(spark, folder, flow()).collect()}
    want = {f"doc{i}": ("done", 0, False) for i in range(10)} | {"doc3": ("done", 2, False), "doc7": ("failed", 3, False), "doc9": ("failed", 3, False), "doc5": ("extract", 0, True)}
    assert got == want
    rows = jobs.log(spark, folder).collect()
    good = [(r.job, r.from_state) for r in rows if r.ok]
    assert len(good) == len(set(good)) and "x" not in {r.job for r in rows}  # no step was done twice
    assert jobs.run(spark, folder, flow()) == 0
    jobs.release(spark, folder, flow(), jobs.states(spark, folder, flow()).where("waits"))
    jobs.run(spark, folder, flow())
    assert {r.source: r.state for r in jobs.states(spark, folder, flow()).collect()}["doc5"] == "done"


def test_jobs_from_a_stream(spark, tmp_path):
    folder, names = str(tmp_path / "jobs"), [["doc1", "doc2"], ["doc2", "doc4"]]
    for part in names:
        spark.createDataFrame([(n,) for n in part], "source string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        jobs.serve(spark.readStream.schema("source string").parquet(f"{tmp_path}/in"), folder, flow(), f"{tmp_path}/check").awaitTermination()
    assert {r.source: r.state for r in jobs.states(spark, folder, flow()).collect()} == {"doc1": "done", "doc2": "done", "doc4": "done"}


@pytest.fixture
def stored(spark, tmp_path):
    traces = [(i, minutes(i), f"r{i}", float(i % 5) if i % 2 else None, i % 7 == 0) for i in range(60)]
    store.create(spark.createDataFrame(traces, "trace_id long, start_ts timestamp, response string, judge double, negative_feedback boolean"), str(tmp_path), "traces", 8)
    for name, n in (("spans", 3), ("feedback", 1), ("scores", 2)):
        store.create(spark.createDataFrame([(i, f"{name}{k}") for i in range(60) for k in range(n)], "trace_id long, note string"), str(tmp_path), name, 8)
    return str(tmp_path), traces


def test_prune(spark, stored):
    folder, _ = stored
    assert store.prune(spark, folder, "2024-01-01 00:20:00") == 20 and store.prune(spark, folder, "2024-01-01 00:20:00") == 0
    left = {n: sorted(r.trace_id for r in store.read(spark, folder, n).collect()) for n in ("traces", *store.CHILDREN)}
    assert left == {n: [i for i in range(20, 60) for _ in range(k)] for n, k in (("traces", 1), ("spans", 3), ("feedback", 1), ("scores", 2))}
    assert store.prune(spark, folder, "2030-01-01") == 40 and not list(__import__("pathlib").Path(folder, "traces").glob("part=*"))


@pytest.mark.parametrize("resets", [True, False])
def test_upsert(spark, stored, resets):
    folder, traces = stored
    new = [(3, minutes(3), "new3", 1), (3, minutes(4), "newer3", 2), (7, minutes(7), "new7", 1), (99, minutes(99), "new99", 1)]
    store.upsert(spark, folder, spark.createDataFrame(new, "trace_id long, start_ts timestamp, response string, seq int"), 8, resets)
    got = {r.trace_id: (r.response, r.judge, r.negative_feedback) for r in store.read(spark, folder, "traces").collect()}
    want = {i: (t, j, n) for i, _, t, j, n in traces} | {99: ("new99", None, False)}
    want |= {3: ("newer3", None, False), 7: ("new7", None, False)} if resets else {3: ("newer3", 3.0, False), 7: ("new7", 2.0, True)}
    assert got == want


def test_a_round_reads_the_log_once(spark, tmp_path):
    """Steps start from open jobs that were written, not from the log and the jobs once more for every step; states without open jobs have no step."""
    read, folder = [], str(tmp_path / "jobs")

    def step(name):
        def run(df):
            read.append((name, df.inputFiles()))
            return df.select("job", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("message"), F.lit(name).alias("output"), F.lit(False).alias("wait"))

        return run

    work = jobs.Workflow({n: step(n) for n in ("one", "two")})
    jobs.submit(spark.createDataFrame([("a",), ("b",)], "source string"), folder)
    assert jobs.run(spark, folder, work) == 2
    assert [n for n, _ in read] == ["one", "two"] and not any("/jobs/" in f for _, files in read for f in files)
    assert {r.state for r in jobs.states(spark, folder, work).collect()} == {"done"}


def test_a_backlog_is_not_held_as_objects():
    """All rows of an instance in one batch of a stream: in the order of ``seq``, without those seen before, and most of them as Arrow columns."""
    n, size = 200_000, 10_000

    def batches():
        for i in range(0, n, size):
            seq = [(j * 7919) % n for j in range(i, i + size)]
            yield pd.DataFrame({"instance": "a", "seq": seq, "at": pd.Timestamp("2024-01-01"), "trace_id": [f"trace-{j:030d}" for j in seq], "sampled": [None if j % 3 else True for j in seq], "negative": None, "payload": [None if j % 5 else "ok" for j in seq]})

    tracemalloc.start()
    expect = 100
    for lot in monitor.in_order(batches(), 99):
        assert lot["seq"].tolist() == list(range(expect, expect + len(lot)))
        assert lot["trace_id"].iloc[0] == f"trace-{expect:030d}" and [x is True for x in lot["sampled"][:6]] == [j % 3 == 0 for j in range(expect, expect + 6)]
        assert [x == "ok" for x in lot["payload"][:6]] == [j % 5 == 0 for j in range(expect, expect + 6)]
        expect += len(lot)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert expect == n and peak < 25_000_000 and list(monitor.in_order(iter(()), -1)) == []


def test_a_full_buffer_gives_up_its_oldest_at_once():
    """Traces beyond the capacity go one by one, each in constant time: in a plain dictionary the gaps of those before are passed over each time."""
    import time

    class State:
        exists = hasTimedOut = False

        def update(self, value):
            self.value = value

        def setTimeoutTimestamp(self, at):
            self.at = at

        def getCurrentWatermarkMs(self):
            return 0

    taken = {}

    class Stream:
        def withWatermark(self, *_):
            return self

        groupBy = withWatermark

        def applyInPandasWithState(self, step, *_):
            taken["step"] = step

    n, capacity = 300_000, 100_000
    monitor.retained(Stream(), capacity, "36500 days")
    rows = pd.DataFrame({"instance": "a", "seq": range(n), "at": pd.Timestamp("2024-01-01"), "trace_id": [str(i) for i in range(n)], "sampled": pd.Series([False] * n, dtype="object"), "negative": None, "payload": "ok"})
    rows.loc[n - 1, ["trace_id", "sampled", "negative"]] = [str(n - 50), None, True]
    state, began = State(), time.process_time()
    out = pd.concat(list(taken["step"](("a",), iter([rows]), state)))
    assert time.process_time() - began < 10
    assert out.to_numpy().tolist() == [["a", str(n - 50), "ok", True]]
    assert state.value[0] == n - 1 and state.value[1] == [str(i) for i in range(n - 1 - capacity, n - 1) if i != n - 50] and len(state.value[3]) == capacity - 1
    assert state.at == (pd.Timestamp("2024-01-01") + pd.Timedelta("36500 days")).timestamp() * 1000
