"""Queries on what lasts over runs: promoted traces, the store after retention and upsert, jobs with retries; each beside its SQL twin."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import jobs, store
from ..sources import adapters as A
from ..sources.staging import shared_folder, staged
from ..streaming import monitor
from .registry import query

_TR = f"WITH {A.TRACES}"
_CUT = "2024-01-15 00:00:00"


def _folder(spark):
    return f"{shared_folder(spark)}/assayflow/durable-{uuid.uuid4().hex}"


@query(f"{_TR} SELECT trace_id, bool_and(promoted) AS promoted FROM (SELECT trace_id, false AS promoted FROM tr WHERE k % 10 = 0 UNION ALL SELECT f.trace_id - 40, true FROM tr f JOIN tr t ON t.trace_id = f.trace_id - 40 WHERE f.status = 'error' AND t.k % 10 <> 0) GROUP BY 1")
def retained_promotions(spark, sf):
    """Traces as a stream, a tenth sampled; an error is negative feedback on the trace forty before, of the same instance."""
    t = A.traces(spark, sf)
    none = F.lit(None).cast("boolean")
    at = F.col("ts").cast("timestamp")
    made = t.select((F.col("trace_id") % 4).cast("string").alias("instance"), (F.col("trace_id") * 2).alias("seq"), at.alias("at"), F.col("trace_id").cast("string").alias("trace_id"), (F.col("k") % 10 == 0).alias("sampled"), none.alias("negative"), F.col("status").alias("payload"))
    said = t.where("status = 'error'").select((F.col("trace_id") % 4).cast("string").alias("instance"), (F.col("trace_id") * 2 + 1).alias("seq"), at.alias("at"), (F.col("trace_id") - 40).cast("string").alias("trace_id"), none.alias("sampled"), F.lit(True).alias("negative"), F.lit(None).cast("string").alias("payload"))
    rows, folder = staged(made.unionByName(said), "feed"), _folder(spark)
    stream = spark.readStream.schema(rows.schema).parquet(rows.inputFiles()[0].rsplit("/", 1)[0])
    q = monitor.retained(stream, 10**6, "36500 days").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("instance string, trace_id string, payload string, promoted boolean").parquet(f"{folder}/out").select(F.col("trace_id").cast("long").alias("trace_id"), "promoted")


@query(f"""{_TR}, left_ AS (SELECT * FROM tr WHERE ts >= TIMESTAMP '{_CUT}') SELECT 'traces' AS name, count(*) AS n FROM left_ UNION ALL SELECT 'spans', coalesce(sum(k % 3 + 1), 0)::BIGINT FROM left_ UNION ALL SELECT 'feedback', count(*) FILTER (negative_feedback) FROM left_ UNION ALL SELECT 'scores', count(judge) FROM left_""")
def retention_cascade(spark, sf):
    """A store of traces, spans, feedback and scores on files, after what began before a day is removed from all four."""
    t = A.traces(spark, sf).withColumn("start_ts", F.col("ts").cast("timestamp"))
    folder = _folder(spark)
    store.create(t.select("trace_id", "start_ts", "status"), folder, "traces")
    store.create(t.select("trace_id", F.explode(F.sequence(F.lit(0), F.col("k") % 3)).alias("i")), folder, "spans")
    store.create(t.where("negative_feedback").select("trace_id", F.lit(-1).alias("value")), folder, "feedback")
    store.create(t.where("judge IS NOT NULL").select("trace_id", "judge"), folder, "scores")
    store.prune(spark, folder, _CUT)
    kinds = {"traces": "start_ts timestamp", "spans": "i int", "feedback": "value int", "scores": "judge double"}
    counts = [spark.read.schema(f"trace_id long, {kind}, part int").parquet(f"{folder}/{name}").agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, kind in kinds.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query(f"{_TR} SELECT trace_id, CASE WHEN k % 5 = 0 THEN 'again' ELSE status END AS status, CASE WHEN trace_id % 2 = 0 OR k % 5 <> 0 THEN judge END AS judge FROM tr")
def upsert_store(spark, sf):
    """A fifth of the traces ingested again: even ones keep what a judge said of them, odd ones are written with the reset."""
    t = A.traces(spark, sf)
    folder = _folder(spark)
    store.create(t.select("trace_id", "status", "judge"), folder, "traces")
    new = t.where("k % 5 = 0").select("trace_id", F.lit("again").alias("status"), F.lit(1).alias("seq"))
    store.upsert(spark, folder, new.where("trace_id % 2 = 0"))
    store.upsert(spark, folder, new.where("trace_id % 2 = 1"), replace_resets=True)
    return store.read(spark, folder, "traces").select("trace_id", "status", "judge")


def _steps():
    def step(name):
        def run(df):
            n = F.col("source").cast("long")
            bad = (n % 11 == 0) | ((n % 7 == 0) & (F.col("attempts") < 2)) if name == "validated" else F.lit(False)
            return df.select("job", (~bad).alias("ok"), F.when(bad, "refused").alias("message"), F.concat_ws(":", F.lit(name), "source").alias("output"), ((n % 13 == 0) & F.lit(name == "extracted")).alias("wait"))

        return run

    return jobs.Workflow({n: step(n) for n in ("received", "extracted", "validated")})


@query("""SELECT state, attempts, waits, count(*) AS n FROM (SELECT o_orderkey % 13 = 0 AS waits, CASE WHEN o_orderkey % 13 = 0 THEN 'validated' WHEN o_orderkey % 11 = 0 THEN 'failed' ELSE 'done' END AS state,
 CASE WHEN o_orderkey % 13 = 0 THEN 0 WHEN o_orderkey % 11 = 0 THEN 3 WHEN o_orderkey % 7 = 0 THEN 2 ELSE 0 END AS attempts FROM orders) GROUP BY ALL""")
def job_rounds(spark, sf):
    """Every order as a job through three steps with refusals, retries and reviewers, run to the end in rounds."""
    folder, flow = _folder(spark), _steps()
    jobs.submit(A.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("source")), folder)
    jobs.run(spark, folder, flow)
    return jobs.states(spark, folder, flow).groupBy("state", "attempts", "waits").agg(F.count("*").alias("n"))
