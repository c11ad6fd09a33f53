"""Row-level scores and states: weighted checks, feedback reasons, gauges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The weight of each answer check, and those that a passed answer must not fail.
WEIGHTS = {"non_empty": 1.0, "no_refusal": 3.0, "no_pii": 2.0, "grounded": 3.0, "json_valid": 2.0, "length_ok": 0.5, "tone_ok": 0.5, "must_contain": 2.0, "must_not_contain": 2.0}
HARD = ("non_empty", "no_pii", "grounded", "no_refusal", "json_valid", "must_contain", "must_not_contain")
#: Upper bounds of the latency histogram, in seconds.
BUCKETS = (0.01, 0.05, 0.1, 0.5, 1.0, 2.0, 5.0, 10.0, 30.0, 60.0)


def answer_score(checks: dict[str, Column]) -> tuple[Column, Column]:
    """(quality, passed): the weighted share of the checks that apply, and whether all hard ones hold; a null check does not apply."""
    weight = lambda name, ok: F.when(ok, WEIGHTS[name]).otherwise(0.0)
    total = sum((weight(n, c.isNotNull()) for n, c in checks.items()), F.lit(0.0))
    good = sum((weight(n, F.coalesce(c, F.lit(False))) for n, c in checks.items()), F.lit(0.0))
    passed = F.lit(True)
    for name in HARD:
        if name in checks:
            passed = passed & F.coalesce(checks[name], F.lit(True))
    return F.try_divide(good, total), passed


def feedback_reasons(thumbs: Column, regenerated: Column, ratio: Column, wrong_part: Column, threshold: float = 0.3) -> Column:
    """Why a feedback is negative, in order; a wrong part counts only without a thumb down. It is negative if there is any reason."""
    down = F.coalesce(thumbs == "down", F.lit(False))
    return F.array_compact(F.array(
        F.when(down, "thumbs_down"), F.when(regenerated, "regenerated"), F.when(ratio >= threshold, F.format_string("edited(%.2f)", ratio.cast("double"))),
        F.when(~down & wrong_part.isNotNull(), F.concat(F.lit("wrong_part="), wrong_part)),
    ))


def histogram(df: DataFrame, value: Column, *keys: str) -> DataFrame:
    """Cumulative counts per upper bound, as a metrics exporter gives them; the last bound is infinite. Nulls are not counted."""
    per = df.groupBy(*keys).agg(*[F.count_if(value <= b).alias(str(i)) for i, b in enumerate(BUCKETS)], F.count(value).alias("all"))
    rows = [F.struct(F.lit(str(b)).alias("le"), F.col(str(i)).alias("n")) for i, b in enumerate(BUCKETS)]
    return per.select(*keys, F.inline(F.array(*rows, F.struct(F.lit("+Inf").alias("le"), F.col("all").alias("n")))))


def alert_gauges(best: DataFrame, known: DataFrame, tick: Column) -> DataFrame:
    """1 for each alert (slo, rule) of the given tick, 0 for the known ones that are silent."""
    active = best.where(F.col("tick") == tick).select("slo", "rule", F.lit(1.0).alias("on")).distinct()
    return known.join(active, ["slo", "rule"], "full").select("slo", "rule", F.coalesce("on", F.lit(0.0)).alias("active"))
