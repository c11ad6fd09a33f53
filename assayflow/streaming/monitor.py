"""Structured Streaming monitor: idempotent ingestion, windowed indicators, escalation state."""

from __future__ import annotations

import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources import adapters as A


def folder(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; a temporary one only for a local master without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="assayflow-")
    return f"{root}/stream-{uuid.uuid4().hex}"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of its files; ids seen within the watermark are taken once."""
    schema = A.table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("at", F.col("ts").cast("timestamp"))


def once(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark("at", delay).dropDuplicatesWithinWatermark(["event_id"])


def windowed(stream: DataFrame, length: str = "1 hour", slide: str | None = None, delay: str | None = "1 hour") -> DataFrame:
    """Requests and errors per window of event time; rows later than the delay are left out once a window is closed. Without a delay the stream has its own, as from ``once``."""
    window = F.window("at", length, slide) if slide else F.window("at", length)
    counts = (stream.withWatermark("at", delay) if delay else stream).groupBy(window.alias("w"))
    return counts.agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("bad"))


def escalation(ticks: DataFrame, after: int = 2) -> DataFrame:
    """Severity per alert from a stream of ticks (``name, tick, fired``): state keeps each alert's run of fired ticks, a quiet tick ends it."""

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, run = state.get if state.exists else (None, 0)
        out = []
        rows = sorted((t, f) for b in batches for t, f in zip(b["tick"], b["fired"], strict=True))
        for tick, fired in rows:
            run = (run + 1 if last is not None and tick == last + 1 else 1) if fired else 0
            last = tick
            if fired:
                out.append((key[0], tick, run, "critical" if run >= after else "warning"))
        state.update((int(last), int(run)))
        yield pd.DataFrame(out, columns=["name", "tick", "consecutive", "severity"])

    return ticks.groupBy("name").applyInPandasWithState(step, "name string, tick long, consecutive long, severity string", "last long, run long", "append", GroupStateTimeout.NoTimeout)


#: Rows that are Python objects at a time.
LOT = 10_000


def in_order(batches: Iterator[pd.DataFrame], last: int) -> Iterator[pd.DataFrame]:
    """The rows of ``batches`` with a ``seq`` above ``last`` in its order, in lots. A backlog may be all of an instance's rows: until their turn they are
    Arrow columns, with strings that repeat held once a batch, and not objects."""
    held = []
    for b in batches:
        b = b[b["seq"] > last].drop(columns="instance", errors="ignore")
        if len(b):
            table = pa.table({"seq": pa.array(b["seq"], pa.int64()), "at": pa.array(b["at"]), "trace_id": pa.array(b["trace_id"], pa.string())} | {n: pa.array(b[n], pa.bool_(), from_pandas=True) for n in ("sampled", "negative")})
            held.append(table.append_column("payload", pa.chunked_array([pa.array(b["payload"], pa.string(), from_pandas=True).dictionary_encode()])))
    if not held:
        return
    rows = pa.concat_tables(held).unify_dictionaries().combine_chunks()
    held.clear()
    order = np.argsort(rows.column("seq").to_numpy(), kind="stable")
    for i in range(0, len(order), LOT):
        part = rows.take(pa.array(order[i : i + LOT]))
        yield part.set_column(part.column_names.index("payload"), "payload", part.column("payload").cast(pa.string())).to_pandas()


def _micros(times: np.ndarray) -> list[int | None]:
    return [None if none else t for t, none in zip(times.astype("int64").tolist(), np.isnat(times).tolist(), strict=True)]


def retained(events: DataFrame, capacity: int = 500, keep: str = "1 hour") -> DataFrame:
    """Exported traces of a stream of ``instance, seq, at, trace_id, sampled, negative, payload``: traces (``sampled`` not null) and feedback on them (``negative``).

    A sampled trace is exported at once. The others are retained, the last ``capacity`` of each instance and for ``keep`` of event time, and one is promoted, once,
    when negative feedback on it comes in; feedback that comes too late, or is repeated, promotes nothing. Rows of an instance go by ``seq``; a row seen before is ignored.
    """
    schema = "instance string, trace_id string, payload string, promoted boolean"
    state_schema = "last long, ids array<string>, payloads array<string>, times array<timestamp>"
    span = pd.Timedelta(keep) // pd.Timedelta("1us")

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, ids, payloads, times = state.get if state.exists else (-1, [], [], [])
        # Times are microseconds. The oldest goes first and often: in a plain dictionary the places of those that went would be passed over each time.
        held = OrderedDict((i, (p, t)) for i, p, t in zip(ids, payloads, _micros(np.array(times, "datetime64[us]")), strict=True))
        del ids, payloads, times
        names = ["instance", "trace_id", "payload", "promoted"]
        for lot in in_order(batches if not state.hasTimedOut else iter(()), last):
            out = []
            for seq, now, trace, sampled, negative, payload in zip(lot["seq"].tolist(), _micros(lot["at"].to_numpy("datetime64[us]")), *(lot[n].tolist() for n in ("trace_id", "sampled", "negative", "payload")), strict=True):
                if seq <= last:
                    continue
                last = seq
                while held and now is not None:
                    oldest = next(iter(held.values()))[1]
                    if oldest is None or now - oldest <= span:
                        break
                    held.popitem(last=False)
                if sampled is not None:
                    if sampled:
                        out.append((key[0], trace, payload, False))
                    else:
                        held.pop(trace, None)
                        held[trace] = (payload, now)
                        while len(held) > capacity:
                            held.popitem(last=False)
                elif negative and trace in held:
                    out.append((key[0], trace, held.pop(trace)[0], True))
            if out:
                yield pd.DataFrame(out, columns=names)
        if state.hasTimedOut:
            held = {}
        if held:
            state.update((int(last), list(held), [p for p, _ in held.values()], np.array([t for _, t in held.values()], "datetime64[us]").tolist()))
            newest = max((t for _, t in held.values() if t is not None), default=None)
            state.setTimeoutTimestamp(max((newest + span) // 1000 if newest is not None else 0, state.getCurrentWatermarkMs() + 1))
        else:
            state.update((int(last), [], [], []))
        yield pd.DataFrame([], columns=names)

    stream = events.withWatermark("at", keep)
    return stream.groupBy("instance").applyInPandasWithState(step, schema, state_schema, "append", GroupStateTimeout.EventTimeTimeout)


def hourly_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replays the events as a stream to its end and returns the hourly counts: each event once, each window written when the watermark closes it, and the open ones from the rows that remain."""
    out = folder(spark)
    stream = windowed(once(events(spark, sf_dir)), delay=None).select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "n", "bad")
    query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    closed = spark.read.schema(stream.schema).parquet(f"{out}/rows")
    # Windows that no later event closed stay open in a stream; a replay that has ended counts them from the table.
    rows = A.table(spark, sf_dir, "events").dropDuplicates(["event_id"])
    whole = rows.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("bad"))
    return closed.unionByName(whole.join(closed.select("hour"), "hour", "left_anti"))
