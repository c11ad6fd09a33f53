"""Readers and writers: JSON lines, versioned data sets, transcripts, spans in the open telemetry form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as t

from ..functions import text as T

TRACE = "trace_id string, session_id string, prompt_version string, start_ts double, end_ts double, status string, error_class string, input_text string, output_text string, prompt_tokens int, completion_tokens int, cost_usd double"


def read_jsonl(spark: SparkSession, path: str, schema: str | t.StructType = TRACE) -> DataFrame:
    """One object per non-blank line, with a given schema; no pass to infer one."""
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)


def write_version(df: DataFrame, root: str, name: str, version: int, id_col: str) -> DataFrame:
    """An immutable version with a manifest of its size and content hash; writing one twice is an error."""
    df.write.mode("errorifexists").parquet(f"{root}/{name}/v{version}/rows")
    made = manifest(df.sparkSession.read.parquet(f"{root}/{name}/v{version}/rows"), id_col)
    made.write.mode("errorifexists").json(f"{root}/{name}/v{version}/manifest")
    return made


def manifest(df: DataFrame, id_col: str) -> DataFrame:
    """The number of rows and a digest of them that depends on no order, from partial sums."""
    return df.agg(F.count(id_col).alias("n"), T.set_digest(F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)).alias("hash"))


def read_version(spark: SparkSession, root: str, name: str, version: int, id_col: str) -> DataFrame:
    """A version's rows, after checking them against its manifest."""
    rows = spark.read.parquet(f"{root}/{name}/v{version}/rows")
    held = spark.read.schema("n long, hash string").json(f"{root}/{name}/v{version}/manifest").first()
    if tuple(manifest(rows, id_col).first()) != tuple(held):
        raise ValueError(f"{name} v{version} does not match its manifest")
    return rows


def upsert(log: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key of an append-only log."""
    last = F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))
    return log.withColumn("__r", last).where("__r = 1").drop("__r")


_LINE = r"^(?:(s[0-9]{3,}) )?(?:\[(?:([0-9]{1,2}):)?([0-9]{1,2}):([0-9]{2})\] )?(?:([A-Za-z][A-Za-z .'-]{0,40}?)(?: \(([a-z ]+)\))?: )?(.*)$"


def parse_transcript(lines: DataFrame) -> DataFrame:
    """Segments from lines (``meeting_id, pos, line``): id, time, speaker and role, each optional.

    A missing id is the position's, a missing time ten seconds a line, a missing speaker ``unknown``; ``[a:b]`` is minutes and
    seconds. Header lines ``# key: value`` are left out.
    """
    part = lambda i: F.regexp_extract("line", _LINE, i)
    or_ = lambda c, d: F.when(c != "", c).otherwise(d)
    seconds = F.coalesce(F.try_to_number(part(2), F.lit("99")), F.lit(0)) * 3600 + part(3).try_cast("int") * 60 + part(4).try_cast("int")
    rows = lines.where(~F.col("line").startswith("#") & (F.trim("line") != ""))
    return rows.select(
        "meeting_id", "pos", or_(part(1), F.format_string("s%03d", F.col("pos") + 1)).alias("seg_id"), F.coalesce(seconds.cast("long"), F.col("pos") * 10).alias("t"),
        or_(part(5), F.lit("unknown")).alias("speaker"), F.nullif(part(6), F.lit("")).alias("role"), part(7).alias("text"),
    )


def to_otlp(traces: DataFrame) -> DataFrame:
    """One root span per trace with typed attributes, times as strings of nanoseconds."""
    nanos = lambda c: (F.col(c).cast("decimal(20,6)") * 1000000000).cast("decimal(20,0)").cast("string")
    attribute = lambda k, kind: F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value"), F.lit(kind).alias("type"))
    return traces.select(
        F.md5("trace_id").alias("traceId"), F.substring(F.sha1(F.concat("trace_id", F.lit(":0"))), 1, 16).alias("spanId"), nanos("start_ts").alias("startTimeUnixNano"), nanos("end_ts").alias("endTimeUnixNano"),
        F.array(attribute("session_id", "string"), attribute("prompt_tokens", "int"), attribute("cost_usd", "double")).alias("attributes"), F.when(F.col("status") == "error", 2).otherwise(1).alias("status"),
    )
