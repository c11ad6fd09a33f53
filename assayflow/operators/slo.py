"""Service-level indicators: eligibility and badness, sliding windows by panes, burn alerts, escalation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import quantiles

#: Indicator, error budget. Thresholds stand in ``signals``.
BUDGETS = {"latency": 0.05, "error": 0.01, "cost": 0.10, "quality": 0.15, "judge": 0.10, "refusal": 0.06, "negative_feedback": 0.10, "invalid_json": 0.05, "pii_leak": 0.005, "grounding": 0.10}
#: Window name, long and short hours, burn rate, severity rank, least bad rows.
RULES = [("page", 12, 3, 3.0, 2, 3), ("fast", 48, 12, 2.0, 2, 3), ("slow", 168, 24, 1.0, 1, 5)]
STEP_HOURS, MIN_ROWS = 6, 10


def signals(t: DataFrame) -> dict[str, tuple[Column, Column]]:
    """Indicator -> (eligible, bad); null signals are not eligible, errors and feedback count every row."""
    ok = F.col("status") == "ok"
    c = F.col
    return {
        "latency": (ok, c("latency_ms") > 2500), "error": (F.lit(True), ~ok), "cost": (c("cost_usd").isNotNull(), c("cost_usd") > 0.0005),
        "quality": (c("quality").isNotNull(), c("quality") < 0.75), "judge": (c("judge").isNotNull(), c("judge") < 3.5), "refusal": (ok & c("refusal").isNotNull(), c("refusal")),
        "negative_feedback": (F.lit(True), c("negative_feedback")), "invalid_json": (c("json_expected") & c("json_valid").isNotNull(), ~c("json_valid")),
        "pii_leak": (ok & c("pii_leak").isNotNull(), c("pii_leak")), "grounding": (ok & c("grounded").isNotNull(), ~c("grounded")),
    }


def long_form(t: DataFrame) -> DataFrame:
    """A row per trace and indicator it is eligible for: ``slo``, ``bad``, ``budget``; one pass, no join."""
    rows = [F.struct(F.lit(n).alias("slo"), e.alias("eligible"), b.alias("bad"), F.lit(BUDGETS[n]).alias("budget")) for n, (e, b) in signals(t).items()]
    return t.select("trace_id", "ts", F.inline(F.array(*rows))).where("eligible").drop("eligible")


def evaluate(rows: DataFrame, *keys: str) -> DataFrame:
    """Per keys and indicator: n, bad, fraction and burn."""
    agg = rows.groupBy(*keys, "slo", "budget").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"))
    return agg.select(*keys, "slo", "n", "bad", F.round(F.col("bad") / F.col("n"), 6).alias("fraction"), F.round(F.col("bad") / F.col("n") / F.col("budget"), 6).alias("burn"))


def panes(rows: DataFrame, hours: int = STEP_HOURS) -> DataFrame:
    """Counts per indicator and pane; a pane is named by its closing tick, and a row on a tick belongs to the pane it closes."""
    s = F.unix_timestamp(F.date_trunc("second", F.col("ts").cast("timestamp"))) + F.when(F.date_trunc("second", F.col("ts")) == F.col("ts"), 0).otherwise(1)
    tick = F.ceil(s / F.lit(hours * 3600)).cast("long")
    return rows.groupBy("slo", "budget", tick.alias("tick")).agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"))


def windows(pane: DataFrame, hours: int, ticks: DataFrame, step: int = STEP_HOURS) -> DataFrame:
    """Sliding sums over (tick - hours, tick], for every tick: a window over panes in place of a range join over rows."""
    # Ticks and indicators are few; the dense grid is what quiet ticks need.
    grid = ticks.join(F.broadcast(pane.select("slo", "budget").distinct()))
    full = grid.join(pane, ["slo", "budget", "tick"], "left").na.fill(0, ["n", "bad"])
    over = W.partitionBy("slo").orderBy("tick").rangeBetween(-(hours // step - 1), 0)
    return full.select("slo", "budget", "tick", F.sum("n").over(over).alias("n"), F.sum("bad").over(over).alias("bad"))


def tick_grid(pane: DataFrame) -> DataFrame:
    return pane.agg(F.min("tick").alias("lo"), F.max("tick").alias("hi")).select(F.explode(F.sequence("lo", "hi")).alias("tick"), "lo")


def burn_alerts(pane: DataFrame) -> DataFrame:
    """Alerts by rule: both windows burn at the rule's rate, have rows enough, and the long one is full and has enough bad rows."""
    ticks = tick_grid(pane)
    out = None
    for name, long, short, rate, rank, least in RULES:
        a = windows(pane, long, ticks.select("tick"))
        b = windows(pane, max(short, STEP_HOURS), ticks.select("tick")).select("slo", "tick", F.col("n").alias("n_short"), F.col("bad").alias("bad_short"))
        burn, burn_short = F.try_divide("bad", "n") / F.col("budget"), F.try_divide("bad_short", "n_short") / F.col("budget")
        full = a.join(b, ["slo", "tick"]).join(F.broadcast(ticks.select(F.min("lo").alias("first"))))
        fired = full.where((F.col("n") >= MIN_ROWS) & (F.col("n_short") >= max(3, MIN_ROWS // 4)) & (F.col("bad") >= least) & (F.col("tick") - long // STEP_HOURS >= F.col("first") - 1))
        fired = fired.where((burn >= rate) & (burn_short >= rate))
        part = fired.select("slo", "tick", F.lit(name).alias("rule"), F.lit(rank).alias("rank"), F.lit(long).alias("long_hours"), F.round(burn, 6).alias("burn"), F.round(burn_short, 6).alias("burn_short"))
        out = part if out is None else out.unionByName(part)
    return out


def best_alerts(alerts: DataFrame) -> DataFrame:
    """One alert per tick and indicator: the gravest, of equals the shortest window."""
    first = F.row_number().over(W.partitionBy("slo", "tick").orderBy(F.desc("rank"), "long_hours"))
    return alerts.withColumn("r", first).where("r = 1").drop("r")


def escalated(best: DataFrame, after: int = 2) -> DataFrame:
    """Consecutive ticks of an indicator's alert; a warning becomes critical from the ``after``-th on."""
    island = F.col("tick") - F.row_number().over(W.partitionBy("slo").orderBy("tick"))
    runs = best.withColumn("island", island)
    count = F.row_number().over(W.partitionBy("slo", "island").orderBy("tick")).cast("long")
    return runs.withColumn("consecutive", count).select("slo", "tick", "rule", "consecutive", F.when((F.col("rank") >= 2) | (F.col("consecutive") >= after), "critical").otherwise("warning").alias("severity"))


def summary(t: DataFrame, *keys: str | Column) -> DataFrame:
    ok = F.col("status") == "ok"
    share = lambda c: F.round(F.avg(F.when(ok, c.cast("int"))), 6)
    names = t.select(*keys).columns
    t = t.withColumns({n: F.col(k) if isinstance(k, str) else k for n, k in zip(names, keys, strict=True)})
    sums = t.groupBy(*names).agg(
        F.count("*").alias("requests"), F.count_if(~ok).alias("errors"),
        F.round(F.avg("cost_usd"), 9).alias("mean_cost"), F.count_if(F.col("cost_usd").isNull()).alias("cost_missing"), F.round(F.avg(F.when(ok, F.col("quality"))), 6).alias("quality"),
        share(F.col("refusal")).alias("refusal_rate"), share(F.col("pii_leak")).alias("pii_rate"), share(F.col("grounded")).alias("grounded_rate"),
    )
    q = quantiles.quantiles(t, names, "latency_ms", {"p50": 0.5, "p95": 0.95})
    held = quantiles.keyed(sums, names).join(q, "key_", "left")
    return held.select(*names, "requests", "errors", F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"), *[c for c in sums.columns if c not in (*names, "requests", "errors")])
