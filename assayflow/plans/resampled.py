"""Decisions from bootstrap intervals, each beside its SQL twin: both engines take the same weights from the same hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import release as R
from ..operators import resample as B
from ..sources import adapters as A
from . import releases
from .catalogue import _PAIR, _paired
from .registry import query

_BOTH = "bo AS (SELECT * FROM pa WHERE cand IS NOT NULL AND base IS NOT NULL)"
_TAGS = B.interval_sql("bo", "case_id", B.PAIR_SUMS, B.MEAN_DELTA, "tag")


@query(f"""WITH {_PAIR}, {_BOTH}, {_TAGS}, n_ AS (SELECT tag, count(*) AS n, count(*) FILTER (cand > base) AS wins, count(*) FILTER (cand < base) AS losses, count(*) FILTER (cand = base) AS ties FROM bo GROUP BY 1)
 SELECT tag, n, round(point, 6) AS delta, round(low, 6) AS low, round(high, 6) AS high, round(positive, 6) AS p_better, wins, losses, ties, {B.verdict_sql(0.05)} AS verdict FROM n_ JOIN interval_ USING (tag)""")
def paired_bootstrap(spark, sf):
    p = B.paired(_paired(spark, sf), "case_id", ("tag",))
    return p.select("tag", "n", *[F.round(c, 6).alias(c) for c in ("delta", "low", "high", "p_better")], "wins", "losses", "ties", "verdict")


@query(releases.gate_sql(f"""{B.interval_sql("b", "case_id", B.PAIR_SUMS, B.MEAN_DELTA)}, t AS (SELECT (SELECT count(*) FROM b) AS n, point AS delta, low, high FROM interval_)"""))
def gate_bootstrap(spark, sf):
    return R.gate(_paired(spark, sf), releases.gate_rates(spark, sf), whole=B.paired(_paired(spark, sf), "case_id"))


_STAGED = "st AS (SELECT * FROM tr, (VALUES (10), (50), (100)) s(stage))"


@query(f"""WITH {A.TRACES}, {_STAGED}, {B.interval_sql("st", "session_id", R.QUALITY_SUMS, R.QUALITY_DELTA, "stage")}, co AS (SELECT stage, {releases.COHORT} FROM st GROUP BY stage), bo AS (SELECT co.*, low AS quality_low, high AS quality_high FROM co LEFT JOIN interval_ USING (stage))
 SELECT {", ".join(R.canary_columns("quality_high"))}, round(quality_low, 6) AS quality_low, round(quality_high, 6) AS quality_high FROM bo""")
def canary_bootstrap(spark, sf):
    return R.canary_resampled(A.traces(spark, sf))


_RATES = {"e": "CASE WHEN status <> 'ok' THEN 1 END", "x": "latency_ms", "c": "cost_usd", "k": "CASE WHEN cost_usd IS NOT NULL THEN 1 END", "m": "1"}


@query(f"WITH {A.TRACES}, {B.interval_sql('tr', 'session_id', _RATES, '(e / nullif(m, 0)) / nullif(c / nullif(k, 0), 0)', 'version')} SELECT version, round(point, 4) AS point, round(low, 4) AS low, round(high, 4) AS high, positive FROM interval_")
def ratio_bootstrap(spark, sf):
    """A ratio of two rates, as no single mean has it: the error rate over the mean cost, sessions drawn."""
    r = B.interval(A.traces(spark, sf), "session_id", _RATES, "(e / nullif(m, 0)) / nullif(c / nullif(k, 0), 0)", ("version",))
    return r.select("version", *[F.round(c, 4).alias(c) for c in ("point", "low", "high")], "positive")
