"""Drafting strategies: metrics per meeting brought together with bootstrap intervals, and gates on their conservative ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import resample

#: The least lower end or the greatest upper end of a metric's interval, and limits of totals.
AT_LEAST = {"macro_f1": 0.9, "decisions_f1": 0.9}
AT_MOST = {"hallucination_rate": 0.02, "omission_rate": 0.1}
MIN_SURFACED, MAX_FAILED = 0.9, 0
MIN_DETECTION, MAX_FALSE_ALARMS = 0.9, 0.05
SUMS, MEAN = {"s": "value", "m": "CASE WHEN value IS NOT NULL THEN 1 END"}, "s / nullif(m, 0)"


def aggregated(scores: DataFrame, metrics: list[str], draws: int = 400) -> DataFrame:
    """Per ``strategy`` and ``metric`` the mean over meetings (``meeting_id``; nulls, as of failed drafts, do not count) and its interval."""
    rows = scores.unpivot(["strategy", "meeting_id"], metrics, "metric", "value")
    ends = resample.interval(rows, "meeting_id", SUMS, MEAN, ("strategy", "metric"), draws)
    return ends.select("strategy", "metric", F.col("point").alias("mean"), "low", "high")


def totals(scores: DataFrame) -> DataFrame:
    """Per strategy the pooled share of disagreements that were surfaced (1 without any) and the number of failed drafts."""
    share = F.coalesce(F.try_divide(F.sum("surfaced"), F.sum("disagreements")), F.lit(1.0))
    return scores.groupBy("strategy").agg(share.alias("surfaced_rate"), F.count_if("failed").alias("failed"))


def failures_sql() -> str:
    """Why a strategy does not pass, as SQL columns that either engine reads, from ``low_<metric>``, ``high_<metric>``, ``surfaced_rate`` and ``failed``."""
    why = [f"CASE WHEN low_{m} < {x} THEN '{m}' END" for m, x in AT_LEAST.items()] + [f"CASE WHEN high_{m} > {x} THEN '{m}' END" for m, x in AT_MOST.items()]
    why += [f"CASE WHEN surfaced_rate < {MIN_SURFACED} THEN 'surfaced_rate' END", f"CASE WHEN failed > {MAX_FAILED} THEN 'failed' END"]
    return f"coalesce(concat_ws(',', {', '.join(why)}), '')"


def gated(aggregate: DataFrame, pooled: DataFrame) -> DataFrame:
    """Per strategy the metrics and totals that fail, and whether it passes."""
    ends = [F.max(F.when(F.col("metric") == m, F.col(side))).alias(f"{side}_{m}") for side, names in (("low", AT_LEAST), ("high", AT_MOST)) for m in names]
    held = aggregate.groupBy("strategy").agg(*ends).join(pooled, "strategy").withColumn("failures", F.expr(failures_sql()))
    return held.select("strategy", "failures", (F.col("failures") == "").alias("passed"))


def detection_gate(kinds: DataFrame) -> DataFrame:
    """One row over planted kinds (``planted, detected, quiet, alarms``): whether every kind is detected often enough and alarms are rare."""
    rate = F.try_divide("detected", "planted")
    alarms = F.coalesce(F.try_divide(F.sum("alarms"), F.sum("quiet")), F.lit(0.0))
    out = kinds.agg(F.min(rate).alias("least"), alarms.alias("false_alarms"))
    return out.withColumn("passed", F.coalesce(F.col("least") >= MIN_DETECTION, F.lit(True)) & (F.col("false_alarms") <= MAX_FALSE_ALARMS))
