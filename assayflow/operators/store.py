"""A trace store on files: four tables dealt by a hash of the trace id, upsert and retention that rewrite only the parts they touch.

A table is a folder of Parquet parts (``part=<n>``). A change is staged whole before parts are replaced, so that a repeated call after a
failure starts from the staged rows' source again; parts that end up empty are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.staging import staged

PARTS = 64
#: Tables that hang on traces, and the signals that come in after a trace was written.
CHILDREN = ("spans", "feedback", "scores")
LATE = {"judge": None, "negative_feedback": False}


def part_of(key: Column, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def create(df: DataFrame, folder: str, name: str, parts: int = PARTS) -> None:
    df.withColumn("part", part_of(F.col("trace_id"), parts)).repartition("part").write.partitionBy("part").mode("errorifexists").parquet(f"{folder}/{name}")


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def _parts(df: DataFrame) -> list[int]:
    """Numbers of parts, as many as a table has at most."""
    return sorted(r.part for r in df.select("part").distinct().collect())


def _replace(spark: SparkSession, folder: str, name: str, rows: DataFrame, touched: list[int]) -> None:
    """Replaces the touched parts of a table by ``rows``, which may come from the table itself."""
    held = staged(rows, name)
    full = _parts(held)
    if full:
        held.repartition("part").write.partitionBy("part").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{folder}/{name}")
    fs = spark._jvm.org.apache.hadoop.fs
    for part in set(touched) - set(full):
        path = fs.Path(f"{folder}/{name}/part={part}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def upsert(spark: SparkSession, folder: str, new: DataFrame, parts: int = PARTS, replace_resets: bool = False) -> None:
    """Writes traces; one with a known id replaces the row. Of equal new ids the one of the greatest ``seq`` counts.

    What came in late for a replaced row (``LATE``) is kept where the new row has none; with ``replace_resets`` it goes back to its default.
    """
    latest = new.groupBy("trace_id").agg(F.max_by(F.struct(*[c for c in new.columns if c != "trace_id"]), "seq").alias("r")).select("trace_id", "r.*")
    latest = staged(latest.withColumn("part", part_of(F.col("trace_id"), parts)), "new")
    touched = _parts(latest)
    old = read(spark, folder, "traces").where(F.col("part").isin(touched))
    names = [c for c in old.columns if c != "part"]
    late = [c for c in LATE if c in names]
    for c in set(names) - set(latest.columns):
        latest = latest.withColumn(c, F.lit(LATE.get(c)).cast(old.schema[c].dataType))
    if not replace_resets and late:
        before = old.select("trace_id", *[F.col(c).alias(f"{c}_before") for c in late])
        latest = latest.join(before, "trace_id", "left")
        for c in late:
            fresh = F.col(c) if LATE[c] is None else F.nullif(F.col(c), F.lit(LATE[c]))
            latest = latest.withColumn(c, F.coalesce(fresh, f"{c}_before", F.lit(LATE[c]).cast(old.schema[c].dataType)))
    kept = old.join(latest.select("trace_id"), "trace_id", "left_anti")
    _replace(spark, folder, "traces", kept.select(*names, "part").unionByName(latest.select(*names, "part")), touched)


def prune(spark: SparkSession, folder: str, cutoff: str, children: tuple[str, ...] = CHILDREN) -> int:
    """Removes traces that began before the cutoff and what hangs on them; returns how many. Children go first, so that a call that failed half way can be repeated."""
    traces = read(spark, folder, "traces")
    old = staged(traces.where(F.col("start_ts") < F.lit(cutoff).cast("timestamp")).select("trace_id", "part").distinct(), "old")
    n, touched = old.count(), _parts(old)
    if n:
        for name in (*children, "traces"):
            rows = read(spark, folder, name).where(F.col("part").isin(touched))
            _replace(spark, folder, name, rows.join(old.select("trace_id"), "trace_id", "left_anti").select(*rows.columns), touched)
    return n
