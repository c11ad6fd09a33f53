"""Queries on drafting strategies and on words hashed to vectors, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..operators import notes
from ..operators import resample as B
from ..operators import strategy as S
from ..sources import adapters as A
from .notes import _SAID, _segments
from .registry import query

c = F.col
METRICS = [*S.AT_LEAST, *S.AT_MOST]
#: Two strategies over the turns of every conversation: the second misses fewer; a conversation whose id ends in 99 failed to draft.
_SCORES = """tu AS (SELECT conv_id AS meeting_id, turn, k, conv_id % 100 = 99 AS failed, (conv_id * 7 + turn * 3) % 20 AS r FROM conversations, (VALUES (1), (2)) s(k)),
sc AS (SELECT CASE k WHEN 1 THEN 'one_pass' ELSE 'verified' END AS strategy, meeting_id, bool_or(failed) AS failed, CASE WHEN NOT bool_or(failed) THEN avg(CASE WHEN r < 18 + k - 1 THEN 1.0 ELSE 0 END) END AS macro_f1, CASE WHEN NOT bool_or(failed) THEN avg(CASE WHEN r <> 4 THEN 1.0 ELSE 0 END) END AS decisions_f1,
 CASE WHEN NOT bool_or(failed) THEN avg(CASE WHEN r >= 18 + k THEN 1.0 ELSE 0 END) END AS hallucination_rate, CASE WHEN NOT bool_or(failed) THEN avg(CASE WHEN r < 2 THEN 1.0 ELSE 0 END) END AS omission_rate, count(*) FILTER (r >= 15) AS disagreements, count(*) FILTER (r >= 18 - k) AS surfaced FROM tu GROUP BY k, meeting_id)"""
_LONG = "lo AS (SELECT strategy || ':' || metric AS g, meeting_id, value FROM (UNPIVOT (SELECT strategy, meeting_id, {0} FROM sc) ON {0} INTO NAME metric VALUE value))".format(", ".join(METRICS))
_AGG = B.interval_sql("lo", "meeting_id", S.SUMS, S.MEAN, "g")


def _scores(spark, sf):
    t = A.table(spark, sf, "conversations").select(c("conv_id").alias("meeting_id"), "turn", F.explode(F.array(F.lit(1), F.lit(2))).alias("k"), (c("conv_id") % 100 == 99).alias("failed"), ((c("conv_id") * 7 + c("turn") * 3) % 20).alias("r"))
    share = lambda when: F.when(~F.bool_or("failed"), F.avg(when.cast("int")))
    return t.groupBy(F.when(c("k") == 1, "one_pass").otherwise("verified").alias("strategy"), "meeting_id").agg(
        F.bool_or("failed").alias("failed"), share(c("r") < 17 + c("k")).alias("macro_f1"), share(c("r") != 4).alias("decisions_f1"), share(c("r") >= 18 + c("k")).alias("hallucination_rate"), share(c("r") < 2).alias("omission_rate"),
        F.count_if(c("r") >= 15).alias("disagreements"), F.count_if(c("r") >= 18 - c("k")).alias("surfaced"),
    )


@query(f"WITH {_SCORES}, {_LONG}, {_AGG} SELECT split_part(g, ':', 1) AS strategy, split_part(g, ':', 2) AS metric, round(point, 6) AS mean, round(low, 6) AS low, round(high, 6) AS high FROM interval_")
def strategy_aggregate(spark, sf):
    return S.aggregated(_scores(spark, sf), METRICS).select("strategy", "metric", *[F.round(x, 6).alias(x) for x in ("mean", "low", "high")])


@query(f"""WITH {_SCORES}, {_LONG}, {_AGG}, en AS (SELECT split_part(g, ':', 1) AS strategy, {", ".join(f"max(low) FILTER (split_part(g, ':', 2) = '{m}') AS low_{m}, max(high) FILTER (split_part(g, ':', 2) = '{m}') AS high_{m}" for m in METRICS)} FROM interval_ GROUP BY 1),
 po AS (SELECT strategy, coalesce(sum(surfaced) / nullif(sum(disagreements), 0), 1) AS surfaced_rate, count(*) FILTER (failed) AS failed FROM sc GROUP BY 1), fa AS (SELECT strategy, {S.failures_sql()} AS failures FROM en JOIN po USING (strategy)) SELECT strategy, failures, failures = '' AS passed FROM fa""")
def drafting_gate(spark, sf):
    scores = _scores(spark, sf)
    return S.gated(S.aggregated(scores, METRICS), S.totals(scores))


@query("WITH ki AS (SELECT o_orderpriority AS kind, count(*) FILTER (o_orderkey % 9 = 0) AS planted, count(*) FILTER (o_orderkey % 9 = 0 AND o_custkey % 50 > 0) AS detected, count(*) FILTER (o_orderkey % 9 > 0) AS quiet, count(*) FILTER (o_orderkey % 9 > 0 AND o_custkey % 40 = 0) AS alarms FROM orders GROUP BY 1), g AS (SELECT min(detected / nullif(planted, 0)) AS least, coalesce(sum(alarms) / nullif(sum(quiet), 0), 0) AS false_alarms FROM ki) SELECT round(least, 6) AS least, round(false_alarms, 6) AS false_alarms, coalesce(least >= 0.9, true) AND false_alarms <= 0.05 AS passed FROM g")
def monitor_gate(spark, sf):
    planted = c("o_orderkey") % 9 == 0
    kinds = A.table(spark, sf, "orders").groupBy(c("o_orderpriority").alias("kind")).agg(F.count_if(planted).alias("planted"), F.count_if(planted & (c("o_custkey") % 50 > 0)).alias("detected"), F.count_if(~planted).alias("quiet"), F.count_if(~planted & (c("o_custkey") % 40 == 0)).alias("alarms"))
    return S.detection_gate(kinds).select(F.round("least", 6).alias("least"), F.round("false_alarms", 6).alias("false_alarms"), "passed")


@query(f"""WITH {_SAID}, w AS (SELECT meeting_id, pos, sha1(unnest({notes.content_sql("text")})) AS h FROM sg), b AS (SELECT meeting_id, pos, CAST('0x' || right(h, 2) AS BIGINT) AS bucket, sum(CASE WHEN CAST('0x' || substr(h, 35, 1) AS BIGINT) % 2 = 0 THEN 1 ELSE -1 END) AS v FROM w GROUP BY ALL)
 SELECT meeting_id, pos, bucket, round(v / sqrt(sum(v * v) OVER (PARTITION BY meeting_id, pos)), 6) AS value FROM b WHERE v <> 0""")
def note_embedding(spark, sf):
    """Stems of every turn hashed into 256 signed buckets, of length one; the buckets that are not zero."""
    e = _segments(spark, sf).select("meeting_id", "pos", F.inline(N.stem_buckets(notes.content_words("text"), 256)))
    return e.select("meeting_id", "pos", c("bucket").cast("long").alias("bucket"), F.round("value", 6).alias("value"))
