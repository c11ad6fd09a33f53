"""Canonical frames over the driver's tables: traces, feedback, transcript segments, claims, predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket(session: Column) -> Column:
    """The canary bucket 0 to 99: the first eight hex digits of the session's SHA-256, modulo 100."""
    return F.conv(F.substring(F.sha2(session.cast("string"), 256), 1, 8), 16, 10).cast("long") % 100


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request per event; signals that do not apply are null, never false."""
    e = table(spark, sf_dir, "events")
    k, ok = F.regexp_extract("props", '"k": *([0-9]+)', 1).cast("int"), F.col("event_type") != "error"
    e = e.select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"))
    k = F.col("k")
    return e.select(
        F.col("event_id").alias("trace_id"), F.col("user_id").alias("session_id"), "ts", "k",
        F.when(ok, "ok").otherwise("error").alias("status"),
        F.when(~ok, F.when(k % 3 == 0, "timeout").when(k % 3 == 1, "tool_error")).alias("error_class"),
        (F.col("value") * 50).alias("latency_ms"), F.when(k % 10 != 0, F.col("value") / 100000).alias("cost_usd"),
        F.when(ok & (k % 2 == 0), k % 17 == 0).when(ok, F.lit(False)).alias("refusal"), (k % 5 == 0).alias("json_expected"),
        F.when(k % 5 == 0, k % 15 != 0).alias("json_valid"), F.when(ok, k % 23 == 0).alias("pii_leak"), F.when(ok & (k % 3 != 0), k % 7 != 0).alias("grounded"),
        F.when(ok, 1 - F.col("value") / 500).alias("quality"), F.when(k % 4 == 0, (1 + k % 5).cast("double")).alias("judge"),
        ((F.col("event_type") == "click") & (F.col("value") > 60)).alias("negative_feedback"), bucket(F.col("user_id")).alias("bucket"),
        F.concat(F.lit("v"), (F.col("user_id") % 3).cast("string")).alias("version"),
    )


#: The same in DuckDB's SQL, to stand first in a WITH.
TRACES = """tr AS (SELECT event_id AS trace_id, user_id AS session_id, ts, k, CASE WHEN ok THEN 'ok' ELSE 'error' END AS status,
 CASE WHEN NOT ok THEN CASE k % 3 WHEN 0 THEN 'timeout' WHEN 1 THEN 'tool_error' END END AS error_class, value * 50 AS latency_ms, CASE WHEN k % 10 <> 0 THEN value / 100000 END AS cost_usd,
 CASE WHEN ok AND k % 2 = 0 THEN k % 17 = 0 WHEN ok THEN false END AS refusal, k % 5 = 0 AS json_expected, CASE WHEN k % 5 = 0 THEN k % 15 <> 0 END AS json_valid,
 CASE WHEN ok THEN k % 23 = 0 END AS pii_leak, CASE WHEN ok AND k % 3 <> 0 THEN k % 7 <> 0 END AS grounded, CASE WHEN ok THEN 1 - value / 500 END AS quality,
 CASE WHEN k % 4 = 0 THEN CAST(1 + k % 5 AS DOUBLE) END AS judge, event_type = 'click' AND value > 60 AS negative_feedback,
 CAST('0x' || substr(sha256(CAST(user_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS bucket, 'v' || CAST(user_id % 3 AS VARCHAR) AS version
 FROM (SELECT *, event_type <> 'error' AS ok, CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) AS k FROM events))"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript segments: ten seconds and one numbered id per turn."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("meeting_id"), F.format_string("s%03d", F.col("turn") + 1).alias("seg_id"), F.col("turn").alias("pos"), (F.col("turn") * 10).alias("t"), F.col("role").alias("speaker"), "text")


SEGMENTS = "sg AS (SELECT conv_id AS meeting_id, printf('s%03d', turn + 1) AS seg_id, turn AS pos, turn * 10 AS t, role AS speaker, text FROM conversations)"


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as claims that cite the turn before; every seventh cites a segment that does not exist."""
    s = segments(spark, sf_dir)
    before = F.lag("seg_id").over(W.partitionBy("meeting_id").orderBy("pos"))
    cited = F.when((F.col("meeting_id") + F.col("pos")) % 7 == 0, F.lit("s999")).otherwise(F.col("before"))
    made = s.withColumn("before", before).where("speaker = 'assistant'")
    return made.select("meeting_id", F.col("pos").alias("idx"), "text", F.array_compact(F.array(cited)).alias("evidence"))


CLAIMS = SEGMENTS + """, cl AS (SELECT meeting_id, pos AS idx, text, list_filter([CASE WHEN (meeting_id + pos) % 7 = 0 THEN 's999' ELSE before END], lambda x: x IS NOT NULL) AS evidence
 FROM (SELECT *, lag(seg_id) OVER (PARTITION BY meeting_id ORDER BY pos) AS before FROM sg) WHERE speaker = 'assistant')"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score per labelled document, the share of distinct words, and the label as truth."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    words = F.filter(F.split("text", "[ \t\n\r\x0b\x0c]+"), lambda w: w != "")
    scored = d.select("doc_id", "lang", words.alias("w")).select("doc_id", "lang", (F.size(F.array_distinct("w")) / F.greatest(F.size("w"), F.lit(1))).alias("p"))
    return scored.join(labels.select("doc_id", F.col("quality").alias("y")), "doc_id")


PREDICTIONS = """pr AS (SELECT doc_id, lang, p, quality AS y FROM (SELECT doc_id, lang, len(list_distinct(w)) / greatest(len(w), 1) AS p
 FROM (SELECT doc_id, lang, list_filter(string_split_regex(text, '[ \\t\\n\\r\\x0b\\x0c]+'), lambda x: x <> '') AS w FROM documents)) JOIN labels USING (doc_id))"""
