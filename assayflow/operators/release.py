"""Release decisions: proportions, paired intervals, gate and canary verdicts, canary state, drift.

Every decision starts from one aggregate over the traces (a partial sum per task); what follows works on as many rows as there are
cohorts, tags or metrics. Intervals of means are the normal ones, or those that ``resample`` draws.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import decisions, matching, resample

#: Limits of gate and canary.
GATE = {"margin": 0.05, "alpha": 0.05, "slice_margin": 0.15, "slice_min_cases": 5, "json_validity_floor": 0.95, "cost_budget_ratio": 1.5, "min_cases": 20}
CANARY = {"min_samples": 100, "error_rate_delta": 0.02, "refusal_rate_delta": 0.05, "quality_margin": 0.05, "alpha": 0.05}
STAGES = (10, 50, 100)
Z95 = 1.959963985


def upper_tail(z: str) -> str:
    """The normal distribution's share above ``z``, as SQL that either engine reads; to seven decimals (a published polynomial)."""
    t, a = f"(1 / (1 + 0.2316419e0 * abs({z})))", f"abs({z})"
    series = f"{t} * (0.31938153e0 + {t} * (-0.356563782e0 + {t} * (1.781477937e0 + {t} * (-1.821255978e0 + {t} * 1.330274429e0))))"
    tail = f"(exp(-{a} * {a} / 2) * 0.3989422804e0 * ({series}))"
    return f"(CASE WHEN {z} >= 0 THEN {tail} ELSE 1 - {tail} END)"


def pooled_z(ka: str, na: str, kb: str, nb: str) -> str:
    """z of two proportions, pooled; 0 without spread or rows."""
    pool = f"(({ka} + {kb}) * 1e0 / nullif({na} + {nb}, 0))"
    se = f"sqrt({pool} * (1 - {pool}) * (1e0 / nullif({na}, 0) + 1e0 / nullif({nb}, 0)))"
    return f"coalesce((1e0 * {ka} / nullif({na}, 0) - 1e0 * {kb} / nullif({nb}, 0)) / nullif({se}, 0), 0e0)"


def paired(pairs: DataFrame, *by: str) -> DataFrame:
    """Per group of ``pairs`` (``cand``, ``base``): n, mean delta, its 95 % interval, wins, losses and a verdict under the gate's margin."""
    d = F.col("cand") - F.col("base")
    s = pairs.where("cand IS NOT NULL AND base IS NOT NULL").groupBy(*by).agg(F.count("*").alias("n"), F.avg(d).alias("delta"), F.coalesce(F.stddev_samp(d), F.lit(0.0)).alias("sd"), F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"))
    half = F.try_divide(F.lit(Z95) * F.col("sd"), F.sqrt("n"))
    s = s.withColumn("low", F.col("delta") - half).withColumn("high", F.col("delta") + half)
    return s.withColumn("verdict", F.expr(verdict_sql()))


def verdict_sql(margin: float = GATE["margin"]) -> str:
    return f"CASE WHEN low > 0 THEN 'better' WHEN high < -{margin} THEN 'worse' WHEN low >= -{margin} THEN 'non-inferior' ELSE 'inconclusive' END"


def gate(pairs: DataFrame, rates: DataFrame, passed: float = 0.71, whole: DataFrame | None = None) -> DataFrame:
    """One row: the decision on a candidate, and why. ``pairs`` has ``tag``, ``cand`` and ``base``; ``rates`` one row of ``json_rate`` and ``cost_ratio``.

    ``whole`` has the mean delta with its interval, as ``paired`` (the normal one, the default) or ``resample.paired`` gives it.
    """
    whole = paired(pairs) if whole is None else whole
    both = pairs.where("cand IS NOT NULL AND base IS NOT NULL")
    good = lambda c: F.col(c) > passed
    cases = both.agg(F.count_if(good("cand") & ~good("base")).alias("w"), F.count_if(good("base") & ~good("cand")).alias("l"))
    p = cases.select("w", "l", decisions.mcnemar(F.col("w"), F.col("l")).alias("p"))
    tags = both.groupBy("tag").agg(F.count("*").alias("k"), (F.avg("cand") - F.avg("base")).alias("d")).where(F.col("k") >= GATE["slice_min_cases"])
    slices = tags.agg(F.count_if(F.col("d") < -GATE["slice_margin"]).alias("bad_slices"))
    one = whole.crossJoin(F.broadcast(p)).crossJoin(F.broadcast(slices)).crossJoin(F.broadcast(rates))  # one row each
    why = [
        (F.col("low") < -GATE["margin"], "not_non_inferior"), ((F.col("l") > F.col("w")) & (F.col("p") < GATE["alpha"]), "mcnemar"), (F.col("bad_slices") > 0, "slice"),
        (F.col("json_rate") < GATE["json_validity_floor"], "json_validity"), (F.col("cost_ratio") > GATE["cost_budget_ratio"], "cost"),
    ]
    reasons = F.when(F.col("n") < GATE["min_cases"], F.array(F.lit("too_few_cases"))).otherwise(F.array_compact(F.array(*[F.when(c, F.lit(r)) for c, r in why])))
    out = one.withColumn("reasons", reasons)
    decision = F.when(F.col("n") < GATE["min_cases"], "INSUFFICIENT_DATA").when(F.size("reasons") > 0, "FAIL").otherwise("PASS")
    return out.select(decision.alias("decision"), F.array_join("reasons", ",").alias("reasons"), "n", F.round("delta", 6).alias("delta"), F.round("low", 6).alias("ci_low"), F.round("high", 6).alias("ci_high"), F.round("p", 6).alias("p_mcnemar"))


def canary(traces: DataFrame, stages: tuple[int, ...] = STAGES) -> DataFrame:
    """Per stage the action on a canary whose cohort are the sessions below it, against the others: hold, rollback, advance or promote."""
    return cohort_sums(traces, stages).selectExpr(*canary_columns())


#: Sums of a trace in the canary's and the other cohort, and the difference of their mean qualities.
QUALITY_SUMS = {f"{n}_{c}": f"CASE WHEN {of} AND status = 'ok' AND quality IS NOT NULL THEN {e} END" for c, of in (("c", "bucket < stage"), ("t", "bucket >= stage")) for n, e in (("s", "quality"), ("k", "1"))}
QUALITY_DELTA = "s_c / nullif(k_c, 0) - s_t / nullif(k_t, 0)"


def canary_resampled(traces: DataFrame, stages: tuple[int, ...] = STAGES, draws: int = 400) -> DataFrame:
    """As ``canary``, with the bootstrap interval of the difference of mean qualities, for which sessions are drawn."""
    each = traces.withColumn("stage", F.explode(F.array(*[F.lit(s) for s in stages])))
    ends = resample.interval(each, "session_id", QUALITY_SUMS, QUALITY_DELTA, ("stage",), draws).select("stage", F.col("low").alias("quality_low"), F.col("high").alias("quality_high"))
    return cohort_sums(traces, stages).join(ends, "stage", "left").selectExpr(*canary_columns("quality_high"), "round(quality_low, 6) AS quality_low", "round(quality_high, 6) AS quality_high")


def cohort_sums(traces: DataFrame, stages: tuple[int, ...] = STAGES) -> DataFrame:
    """Per stage the counts and moments of the cohorts."""
    each = traces.withColumn("stage", F.explode(F.array(*[F.lit(s) for s in stages])))
    mine, ok = F.col("bucket") < F.col("stage"), F.col("status") == "ok"
    sums = []
    for name, of in (("c", mine), ("t", ~mine)):
        quality = F.when(of & ok, F.col("quality"))
        sums += [F.count_if(of).alias(f"n_{name}"), F.count_if(of & ~ok).alias(f"e_{name}"), F.count_if(of & ok & F.col("refusal")).alias(f"r_{name}"), F.count(quality).alias(f"q_{name}"), F.avg(quality).alias(f"m_{name}"), F.coalesce(F.var_samp(quality), F.lit(0.0)).alias(f"v_{name}")]
    return each.groupBy("stage").agg(*sums)


def canary_columns(quality_high: str | None = None) -> list[str]:
    """The decision from the cohorts' sums, as SQL columns that either engine reads; ``quality_high`` is the upper end of the difference of qualities, by default the normal one."""
    error, refusal = pooled_z("e_c", "n_c", "e_t", "n_t"), pooled_z("r_c", "n_c - e_c", "r_t", "n_t - e_t")
    rates = {"error": ("1e0 * e_c / nullif(n_c, 0) - 1e0 * e_t / nullif(n_t, 0)", error), "refusal": ("1e0 * r_c / nullif(n_c - e_c, 0) - 1e0 * r_t / nullif(n_t - e_t, 0)", refusal)}
    worse = {k: f"({d} > {CANARY[f'{k}_rate_delta']} AND {upper_tail(z)} < {CANARY['alpha']})" for k, (d, z) in rates.items()}
    worse["quality"] = f"({quality_high or f'm_c - m_t + {Z95} * sqrt(v_c / nullif(q_c, 0) + v_t / nullif(q_t, 0))'} < -{CANARY['quality_margin']})"
    few = f"least(n_c, n_t) < {CANARY['min_samples']}"
    any_ = " OR ".join(f"coalesce({w}, false)" for w in worse.values())
    reasons = ", ".join(f"CASE WHEN {w} THEN '{k}' END" for k, w in worse.items())
    return [
        "stage", "n_c", "n_t", f"CASE WHEN {few} THEN 'hold' WHEN {any_} THEN 'rollback' WHEN stage >= {max(STAGES)} THEN 'promote' ELSE 'advance' END AS action",
        f"CASE WHEN {few} THEN 'insufficient_samples' ELSE coalesce(concat_ws(',', {reasons}), '') END AS reasons", f"round({upper_tail(error)}, 4) AS p_error", f"round({upper_tail(refusal)}, 4) AS p_refusal",
    ]


def canary_state(events: DataFrame) -> DataFrame:
    """Per release the state after its events (``release``, ``seq``, ``event``, ``version``, ``stage``): canary, its stage, and the active version.

    A start or an advance leaves a canary in flight, a rollback or a promotion none; the active version is that of the last promotion.
    """
    flying = F.col("event").isin("start", "advance")
    last = lambda c: F.max_by(F.when(flying, F.col(c)), "seq")
    promoted = F.when(F.col("event") == "promote", F.col("seq"))
    return events.groupBy("release").agg(last("version").alias("canary"), last("stage").alias("stage"), F.max_by("version", promoted).alias("active"), F.count("*").alias("events"))


def js_distance(a: np.ndarray, b: np.ndarray) -> float:
    """Jensen-Shannon distance of two count vectors, base 2."""
    p, q = a / a.sum(), b / b.sum()
    m = (p + q) / 2
    part = lambda x: float(np.sum(x[x > 0] * np.log2(x[x > 0] / m[x > 0])))
    return math.sqrt(max(0.0, (part(p) + part(q)) / 2))


def chance_distance(base: np.ndarray, n: int, draws: int = 200, quantile: float = 0.99, seed: int = 0) -> float:
    """The distance that ``n`` draws from the baseline's own mix reach by chance; infinite for an empty baseline."""
    if base.sum() <= 0 or n <= 0:
        return math.inf
    mix = base / base.sum()
    return float(np.quantile([js_distance(mix, x.astype(float)) for x in np.random.default_rng(seed).multinomial(n, mix, draws)], quantile))


def chi2_upper(x: float, d: int) -> float:
    """The share of chi-square above ``x``: one minus the series of the incomplete gamma function."""
    if x <= 0:
        return 1.0
    a, z = d / 2, x / 2
    term = total = 1 / a
    while term > 1e-16 * total:
        a += 1
        term *= z / a
        total += term
    return max(0.0, 1 - total * math.exp(-z + d / 2 * math.log(z) - math.lgamma(d / 2)))


def two_samples(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Chi-square of two count vectors and its p; categories empty in both do not count, and fewer than two give (0, 1)."""
    some = (a + b) > 0
    a, b = a[some], b[some]
    if len(a) < 2 or not a.sum() or not b.sum():
        return 0.0, 1.0
    expected = np.outer([a.sum(), b.sum()], (a + b) / (a.sum() + b.sum()))
    x = float((((np.array([a, b]) - expected) ** 2) / expected).sum())
    return x, chi2_upper(x, len(a) - 1)


def drift(counts: DataFrame, novel: int, alpha: float = 0.01, novel_alpha: float = 0.001, least_novel: int = 5) -> DataFrame:
    """One row: whether the topic mix moved, or the novel topic grew. ``counts``: a row per topic with ``base`` and ``now``, as many as topics, so the driver takes them."""
    rows = sorted(counts.select("topic", "base", "now").collect())
    base, now = (np.array([float(r[i] or 0) for r in rows]) for i in (1, 2))
    spark = counts.sparkSession
    schema = "js double, threshold double, chi2 double, p double, novel_p double, `trigger` string, grown string"
    if not rows or not base.sum() or not now.sum():
        return spark.createDataFrame([(0.0, math.inf, 0.0, 1.0, 1.0, "", "")], schema)
    x, p = two_samples(base, now)
    js, threshold = js_distance(base, now), chance_distance(base, int(now.sum()))
    at = [r[0] for r in rows].index(novel) if novel in [r[0] for r in rows] else None
    novel_p, k, n = 1.0, 0, int(now.sum())
    if at is not None and 0 < base[at] < base.sum():
        share, k = float(base[at] / base.sum()), int(now[at])
        novel_p = min(1.0, matching.at_least(k, n, share))  # stops at small terms, however many rows there are
    triggers = [name for name, on in (("mix", p < alpha and js > threshold), ("novel", novel_p < novel_alpha and k >= least_novel)) if on]
    gain = now / now.sum() - base / base.sum()
    grown = [str(rows[i][0]) for i in np.argsort(-gain, kind="stable") if gain[i] > 0.02]
    return spark.createDataFrame([(js, threshold, x, p, novel_p, "+".join(triggers), ",".join(grown))], schema)


def faults(minutes: DataFrame, incidents: DataFrame) -> DataFrame:
    """Per minute the incidents active then (start <= minute < end), the product of their multipliers and the greatest rate; 1 and 0 without any.

    An incident becomes a row for each of its minutes, so any number of incidents is joined by minute.
    """
    each = incidents.where("start < end").withColumn("minute", F.explode(F.sequence("start", F.col("end") - 1))).groupBy("minute")
    sums = each.agg(F.count("*").alias("active"), F.exp(F.sum(F.log("multiplier"))).alias("product"), F.max("rate").alias("rate"))
    joined = minutes.join(sums, "minute", "left")
    return joined.select("minute", F.coalesce("active", F.lit(0)).alias("active"), F.round(F.coalesce("product", F.lit(1.0)), 6).alias("latency"), F.coalesce("rate", F.lit(0.0)).alias("rate"))


def worse_when_high(metric: Column) -> Column:
    """-1 for metrics where less is better, by which their deltas are turned for a verdict."""
    return F.when(metric.isin("cost", "latency"), F.lit(-1)).otherwise(F.lit(1))
