"""Durable jobs: a state machine over many jobs at once, whose log on files is the only state.

A round takes every open job one step on; its transitions go to a folder of their own, named by the round, which counts only once it is complete. A run that
ends half way through a round therefore leaves nothing behind that a later one would count, and a repeated round overwrites its folder: no step is logged twice,
and what a step made stands beside its transition. A job that fails is tried again in later rounds, up to a number of failures.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import staged

#: A step: rows ``job, source, attempts`` of jobs in its state to ``job, ok, message, output, wait``. A job it gives no row for failed.
Step = Callable[[DataFrame], DataFrame]
DONE, FAILED = "done", "failed"
LOG = "job string, from_state string, to_state string, ok boolean, message string, output string, waits boolean, round int"


@dataclass(frozen=True)
class Workflow:
    """Steps by state, in order; the state after the last is ``done``."""

    steps: dict[str, Step]
    max_retries: int = 2

    def after(self, state: str) -> str:
        names = [*self.steps, DONE]
        return names[names.index(state) + 1]


def _complete(spark: SparkSession, folder: str) -> list[int]:
    """The rounds that ended."""
    fs = spark._jvm.org.apache.hadoop.fs
    root = fs.Path(f"{folder}/log")
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(root):
        return []
    rounds = [int(s.getPath().getName().split("-")[1]) for s in system.listStatus(root)]
    return sorted(r for r in rounds if system.exists(fs.Path(f"{folder}/log/round-{r}/_SUCCESS")))


def submit(jobs: DataFrame, folder: str) -> None:
    """Adds jobs for sources (``source``) that have none yet: a job is named by its source, so one that is handed in twice is one job. Calls are one at a time."""
    spark = jobs.sparkSession
    new = jobs.select("source").where("source IS NOT NULL").distinct().withColumn("job", F.substring(F.sha2("source", 256), 1, 12))
    try:
        known = spark.read.schema("source string, job string").parquet(f"{folder}/jobs").select("job")
    except Exception as e:  # nothing was handed in before
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = spark.createDataFrame([], "job string")
    new.join(known, "job", "left_anti").select("source", "job").write.mode("append").parquet(f"{folder}/jobs")


def log(spark: SparkSession, folder: str) -> DataFrame:
    """All transitions of complete rounds."""
    rounds = _complete(spark, folder)
    return spark.read.schema(LOG).parquet(*[f"{folder}/log/round-{r}" for r in rounds]) if rounds else spark.createDataFrame([], LOG)


def states(spark: SparkSession, folder: str, flow: Workflow) -> DataFrame:
    """Per job its ``source``, ``state``, ``attempts`` (failures so far), ``waits`` for a reviewer, and its last message."""
    past = log(spark, folder).groupBy("job").agg(F.max_by("to_state", "round").alias("state"), F.count_if(~F.col("ok")).alias("attempts"), F.max_by("waits", "round").alias("waits"), F.max_by("message", "round").alias("message"))
    jobs = spark.read.schema("source string, job string").parquet(f"{folder}/jobs")
    return jobs.join(past, "job", "left").select("job", "source", F.coalesce("state", F.lit(next(iter(flow.steps)))).alias("state"), F.coalesce("attempts", F.lit(0)).alias("attempts"), F.coalesce("waits", F.lit(False)).alias("waits"), "message")


def run(spark: SparkSession, folder: str, flow: Workflow, rounds: int | None = None) -> int:
    """Takes open jobs on until all are done, failed or waiting (or for so many rounds); returns the rounds it took."""
    taken = 0
    while rounds is None or taken < rounds:
        at = (_complete(spark, folder) or [-1])[-1] + 1
        # Written once: the log and the jobs are read and joined once a round, however many steps there are, and each step reads its own jobs.
        open_ = staged(states(spark, folder, flow).where(~F.col("state").isin(DONE, FAILED) & ~F.col("waits")).select("job", "source", "state", "attempts"), "open")
        here = {r.state for r in open_.select("state").distinct().collect()}
        parts = None
        for state, step in flow.steps.items():
            if state not in here:
                continue
            mine = open_.where(F.col("state") == state).select("job", "source", "attempts")
            made = step(mine).select("job", F.col("ok").cast("boolean").alias("ok"), F.col("message").cast("string").alias("message"), F.col("output").cast("string").alias("output"), F.col("wait").cast("boolean").alias("wait"))
            both = mine.join(made, "job", "left")
            ok = F.coalesce("ok", F.lit(False))
            to = F.when(ok, flow.after(state)).when(F.col("attempts") + 1 > flow.max_retries, FAILED).otherwise(state)
            rows = both.select("job", F.lit(state).alias("from_state"), to.alias("to_state"), ok.alias("ok"), F.when(~ok, F.coalesce("message", F.lit("no result"))).alias("message"), F.when(ok, F.col("output")).alias("output"), (ok & F.coalesce("wait", F.lit(False))).alias("waits"), F.lit(at).alias("round"))
            parts = rows if parts is None else parts.unionByName(rows)
        if parts is None:
            break
        parts.write.mode("overwrite").parquet(f"{folder}/log/round-{at}")
        taken += 1
    return taken


def release(spark: SparkSession, folder: str, flow: Workflow, approved: DataFrame) -> None:
    """Lets waiting jobs (``job``) that a reviewer approved go on, as a round of its own."""
    at = (_complete(spark, folder) or [-1])[-1] + 1
    waiting = states(spark, folder, flow).where("waits").join(approved.select("job").distinct(), "job", "left_semi")
    rows = waiting.select("job", F.col("state").alias("from_state"), F.col("state").alias("to_state"), F.lit(True).alias("ok"), F.lit(None).cast("string").alias("message"), F.lit(None).cast("string").alias("output"), F.lit(False).alias("waits"), F.lit(at).alias("round"))
    rows.write.mode("overwrite").parquet(f"{folder}/log/round-{at}")


def serve(inbox: DataFrame, folder: str, flow: Workflow, checkpoint: str):
    """A stream of handed-in sources (``source``): every batch is submitted and all open jobs are run. A batch that is delivered again adds no job twice."""

    def batch(rows: DataFrame, _: int) -> None:
        submit(rows, folder)
        run(rows.sparkSession, folder, flow)

    return inbox.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(batch).start()
