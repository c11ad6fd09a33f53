"""Named queries over the driver's tables, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..functions import text as T
from ..operators import decisions as D
from ..operators import models, slo
from ..operators.ranks import running
from ..sources import adapters as A
from ..sources import files
from ..streaming import monitor
from .registry import ORACLE_SQL, QUERIES, query  # noqa: F401

FLAGSHIP = "slo_hourly_error"

_TR, _SG, _CL, _PR = (f"WITH {x} " for x in (A.TRACES, A.SEGMENTS, A.CLAIMS, A.PREDICTIONS))
_LONG = A.TRACES + ", lf AS (" + " UNION ALL ".join(f"SELECT trace_id, ts, '{n}' AS slo, CAST({slo.BUDGETS[n]} AS DOUBLE) AS budget, {bad} AS bad FROM tr WHERE {e}" for n, e, bad in [
    ("latency", "status = 'ok'", "latency_ms > 2500"), ("error", "true", "status <> 'ok'"), ("cost", "cost_usd IS NOT NULL", "cost_usd > 0.0005"), ("quality", "quality IS NOT NULL", "quality < 0.75"), ("judge", "judge IS NOT NULL", "judge < 3.5"),
    ("refusal", "status = 'ok' AND refusal IS NOT NULL", "refusal"), ("negative_feedback", "true", "negative_feedback"), ("invalid_json", "json_expected AND json_valid IS NOT NULL", "NOT json_valid"), ("pii_leak", "status = 'ok' AND pii_leak IS NOT NULL", "pii_leak"), ("grounding", "status = 'ok' AND grounded IS NOT NULL", "NOT grounded")]) + ")"
_EVAL = "count(*) AS n, CAST(sum(CAST(bad AS INTEGER)) AS BIGINT) AS bad, round(avg(CAST(bad AS INTEGER)), 6) AS fraction, round(avg(CAST(bad AS INTEGER)) / budget, 6) AS burn"
_PANE = _LONG + f", pn AS (SELECT slo, budget, CAST(ceil(epoch_us(ts) / {slo.STEP_HOURS * 3600e6:.1f}) AS BIGINT) AS tick, count(*) AS n, CAST(sum(CAST(bad AS INTEGER)) AS BIGINT) AS bad FROM lf GROUP BY ALL), tk AS (SELECT unnest(range(min(tick), max(tick) + 1)) AS tick, min(tick) AS first FROM pn), gr AS (SELECT s.slo, s.budget, t.tick, t.first, coalesce(p.n, 0) AS n, coalesce(p.bad, 0) AS bad FROM (SELECT DISTINCT slo, budget FROM pn) s CROSS JOIN tk t LEFT JOIN pn p ON p.slo = s.slo AND p.tick = t.tick)"


def _frame(h: int) -> str:
    return f"OVER (PARTITION BY slo ORDER BY tick RANGE BETWEEN {max(h, 6) // 6 - 1} PRECEDING AND CURRENT ROW)"


_ALERTS = _PANE + ", al AS (" + " UNION ALL ".join(f"SELECT slo, tick, '{r}' AS rule, {rank} AS rank, {long} AS long_hours, round(b1 / n1 / budget, 6) AS burn, round(b2 / n2 / budget, 6) AS burn_short FROM (SELECT *, sum(n) {_frame(long)} AS n1, sum(bad) {_frame(long)} AS b1, sum(n) {_frame(short)} AS n2, sum(bad) {_frame(short)} AS b2 FROM gr) WHERE n1 >= 10 AND n2 >= 3 AND b1 >= {least} AND tick - {long // 6} >= first - 1 AND b1 / n1 / budget >= {rate} AND b2 / n2 / budget >= {rate}" for r, long, short, rate, rank, least in slo.RULES) + ")"
_BEST = _ALERTS + ", be AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY slo, tick ORDER BY rank DESC, long_hours) = 1)"


# Service levels


@query(f"WITH {_LONG} SELECT date_trunc('hour', ts) AS hour, slo, {_EVAL} FROM lf WHERE slo = 'error' GROUP BY 1, 2, budget")
def slo_hourly_error(spark, sf):
    rows = slo.long_form(A.traces(spark, sf)).where("slo = 'error'").withColumn("hour", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    return slo.evaluate(rows, "hour")


@query(f"WITH {_LONG} SELECT slo, {_EVAL} FROM lf GROUP BY slo, budget")
def slo_all(spark, sf):
    return slo.evaluate(slo.long_form(A.traces(spark, sf)))


def _panes(spark, sf):
    return slo.panes(slo.long_form(A.traces(spark, sf)))


@query(f"WITH {_PANE} SELECT slo, tick, CAST(sum(n) {_frame(48)} AS BIGINT) AS n, CAST(sum(bad) {_frame(48)} AS BIGINT) AS bad FROM gr")
def slo_sliding_all(spark, sf):
    p = _panes(spark, sf)
    return slo.windows(p, 48, slo.tick_grid(p).select("tick")).drop("budget")


@query(f"WITH {_ALERTS} SELECT * FROM al")
def slo_burn_alerts(spark, sf):
    return slo.burn_alerts(_panes(spark, sf))


@query(f"WITH {_BEST} SELECT * FROM be")
def alert_best(spark, sf):
    return slo.best_alerts(slo.burn_alerts(_panes(spark, sf)))


@query(f"WITH {_BEST}, il AS (SELECT *, tick - row_number() OVER (PARTITION BY slo ORDER BY tick) AS island FROM be), cn AS (SELECT *, row_number() OVER (PARTITION BY slo, island ORDER BY tick) AS consecutive FROM il) SELECT slo, tick, rule, consecutive, CASE WHEN rank >= 2 OR consecutive >= 2 THEN 'critical' ELSE 'warning' END AS severity FROM cn")
def alert_escalation(spark, sf):
    return slo.escalated(slo.best_alerts(slo.burn_alerts(_panes(spark, sf))))


@query(f"WITH {_PANE}, w AS (SELECT *, sum(n) {_frame(168)} AS n1, sum(bad) {_frame(168)} AS b1 FROM gr WHERE slo = 'refusal') SELECT slo || '_low' AS name, tick, round(b1 / n1, 6) AS value FROM w WHERE n1 >= 10 AND tick - 28 >= first - 1 AND b1 / n1 < 0.028")
def slo_floor_alerts(spark, sf):
    p = _panes(spark, sf)
    ticks = slo.tick_grid(p)
    w = slo.windows(p.where("slo = 'refusal'"), 168, ticks.select("tick")).join(F.broadcast(ticks.select(F.min("lo").alias("first"))))
    return w.where("n >= 10 AND tick - 28 >= first - 1 AND bad / n < 0.028").select(F.concat("slo", F.lit("_low")).alias("name"), "tick", F.round(F.col("bad") / F.col("n"), 6).alias("value"))


_SUM = "count(*) AS requests, count(*) FILTER (status <> 'ok') AS errors, round(quantile_cont(latency_ms, 0.5), 4) AS p50, round(quantile_cont(latency_ms, 0.95), 4) AS p95, round(avg(cost_usd), 9) AS mean_cost, count(*) FILTER (cost_usd IS NULL) AS cost_missing, round(avg(quality) FILTER (status = 'ok'), 6) AS quality, " + ", ".join(f"round(avg(CAST({c} AS INTEGER)) FILTER (status = 'ok'), 6) AS {n}" for c, n in (("refusal", "refusal_rate"), ("pii_leak", "pii_rate"), ("grounded", "grounded_rate")))


@query(f"{_TR} SELECT date_trunc('day', ts) AS day, {_SUM} FROM tr GROUP BY 1")
def window_summary(spark, sf):
    return slo.summary(A.traces(spark, sf), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day"))


@query(f"{_TR} SELECT version, {_SUM} FROM tr GROUP BY 1")
def traffic_by_version(spark, sf):
    return slo.summary(A.traces(spark, sf), "version")


@query(f"{_TR} SELECT coalesce(error_class, 'None') AS error_class, count(*) AS n FROM tr WHERE status = 'error' GROUP BY 1")
def error_class_counts(spark, sf):
    return A.traces(spark, sf).where("status = 'error'").groupBy(F.coalesce("error_class", F.lit("None")).alias("error_class")).agg(F.count("*").alias("n"))


@query(f"{_TR} SELECT trace_id, ts, latency_ms FROM tr WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-12' AND status = 'ok' AND version = 'v1'")
def trace_scan(spark, sf):
    return A.traces(spark, sf).where("ts >= TIMESTAMP_NTZ '2024-01-10' AND ts < TIMESTAMP_NTZ '2024-01-12' AND status = 'ok' AND version = 'v1'").select("trace_id", "ts", "latency_ms")


@query("SELECT count(*) AS n, min(ts) AS first, max(ts) AS last FROM events")
def trace_range(spark, sf):
    return A.table(spark, sf, "events").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) - INTERVAL 7 DAY FROM events) GROUP BY 1")
def retention_prune(spark, sf):
    e = A.table(spark, sf, "events").select("ts", "event_type")
    cut = e.agg((F.max("ts") - F.expr("INTERVAL 7 DAYS")).alias("cut"))
    return e.join(F.broadcast(cut), F.col("ts") >= F.col("cut")).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT user_id AS id, max(ts) AS ts, arg_max(event_id, event_id) AS trace_id FROM (SELECT *, max(ts) OVER (PARTITION BY user_id) AS m FROM events) WHERE ts = m GROUP BY 1")
def latest_upsert(spark, sf):
    e = A.table(spark, sf, "events").groupBy(F.col("user_id").alias("id")).agg(F.max(F.struct("ts", "event_id")).alias("x"))
    return e.select("id", "x.ts", F.col("x.event_id").alias("trace_id"))


@query("SELECT user_id, bool_or(value > 60) AS negative, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1")
def feedback_flags(spark, sf):
    return A.table(spark, sf, "events").where("event_type = 'click'").groupBy("user_id").agg(F.bool_or(F.col("value") > 60).alias("negative"), F.count("*").alias("n"))


@query("SELECT event_type AS model, count(*) AS n, count(price) AS priced, round(sum((value * 3 * price + value * price * 4) / 1e6), 9) AS cost FROM events LEFT JOIN (VALUES ('view', 0.5), ('click', 1.0), ('purchase', 3.0)) p(m, price) ON event_type = m GROUP BY 1")
def prompt_cost_by_model(spark, sf):
    prices = spark.createDataFrame([("view", 0.5), ("click", 1.0), ("purchase", 3.0)], "event_type string, price double")
    e = A.table(spark, sf, "events").select("event_type", "value").join(F.broadcast(prices), "event_type", "left")
    return e.groupBy(F.col("event_type").alias("model")).agg(F.count("*").alias("n"), F.count("price").alias("priced"), F.round(F.sum((F.col("value") * 3 * F.col("price") + F.col("value") * F.col("price") * 4) / 1e6), 9).alias("cost"))


# Incidents

_KIND = A.TRACES + ", kd AS (" + " UNION ALL ".join(f"SELECT trace_id, ts, version, '{n}' AS kind FROM tr WHERE {b}" for n, b in [("timeout", "status = 'error' AND error_class = 'timeout'"), ("tool_error", "status = 'error' AND error_class = 'tool_error'"), ("provider_error", "status = 'error' AND error_class IS NULL"), ("invalid_json", "NOT json_valid"), ("pii_leak", "pii_leak"), ("ungrounded", "NOT grounded"), ("refusal", "refusal"), ("low_judge", "judge < 3.0"), ("negative_feedback", "negative_feedback")]) + ")"
_LINE = A.TRACES + ", r AS (SELECT CAST(floor(epoch_us(ts) / 21600e6) AS BIGINT) AS bucket, count(*) AS requests, count(*) FILTER (status = 'error') AS errors FROM tr GROUP BY 1), ln AS (SELECT bucket, coalesce(requests, 0) AS requests, coalesce(errors, 0) AS errors FROM (SELECT unnest(range(min(bucket), max(bucket) + 1)) AS bucket FROM r) LEFT JOIN r USING (bucket))"
_ELEV = _LINE + ", ab AS (SELECT *, bucket - row_number() OVER (ORDER BY bucket) AS island FROM ln WHERE requests > 0 AND errors / requests > (SELECT sum(errors) / sum(requests) FROM ln)), se AS (SELECT min(bucket) AS first, max(bucket) AS last, CAST(sum(requests) AS BIGINT) AS requests, CAST(sum(errors) AS BIGINT) AS errors FROM ab WHERE island = (SELECT island FROM ab ORDER BY errors / requests DESC, requests DESC, bucket LIMIT 1))"


@query(f"WITH {_KIND} SELECT version, kind, count(*) AS n FROM kd GROUP BY 1, 2")
def failure_kinds(spark, sf):
    return D.failure_kinds(A.traces(spark, sf)).groupBy("version", "kind").agg(F.count("*").alias("n"))


@query(f"WITH {_LINE} SELECT bucket, requests, errors, round(errors / nullif(requests, 0), 6) AS rate FROM ln")
def incident_timeline(spark, sf):
    return D.timeline(A.traces(spark, sf), 6)


@query(f"WITH {_ELEV} SELECT * FROM se")
def elevated_segment(spark, sf):
    return D.elevated_segment(D.timeline(A.traces(spark, sf), 6))


@query(f"WITH {_LINE}, s AS (SELECT bucket, row_number() OVER o AS i, count(*) OVER () AS m, sum(errors) OVER o AS e0, sum(requests) OVER o AS n0, sum(errors) OVER () AS e, sum(requests) OVER () AS n FROM ln WINDOW o AS (ORDER BY bucket)) SELECT bucket, round(abs((e - e0) / (n - n0) - e0 / n0) / greatest(sqrt(e / n * (1 - e / n) * (1 / n0 + 1 / (n - n0))), 1e-9), 6) AS stat FROM s WHERE i >= 2 AND i <= m - 2 ORDER BY 2 DESC, 1 LIMIT 1")
def change_point(spark, sf):
    return D.change_point(D.timeline(A.traces(spark, sf), 6))


@query(f"WITH {_ELEV}, {_KIND.split('), kd AS')[1].join(['kd AS', ''])}, t2 AS (SELECT floor(epoch_us(ts) / 21600e6) BETWEEN (SELECT first FROM se) AND (SELECT last FROM se) AS inside FROM tr), k2 AS (SELECT kind, floor(epoch_us(ts) / 21600e6) BETWEEN (SELECT first FROM se) AND (SELECT last FROM se) AS inside FROM kd) SELECT kind, round(count(*) FILTER (inside) / (SELECT count(*) FILTER (inside) FROM t2), 6) AS inside, round(count(*) FILTER (NOT inside) / (SELECT count(*) FILTER (NOT inside) FROM t2), 6) AS outside FROM k2 GROUP BY 1")
def failure_group_increase(spark, sf):
    t = A.traces(spark, sf)
    return D.group_increase(D.failure_kinds(t), t, D.elevated_segment(D.timeline(t, 6)), 6)


_INCIDENTS = [("error", 10, 20), ("latency", 40, 50), ("quality", 60, 64), ("refusal", 80, 84)]


@query(f"WITH {_BEST}, ic(kind, a, b) AS (VALUES {', '.join(map(str, _INCIDENTS))}), z AS (SELECT min(first) AS f FROM gr), h AS (SELECT kind, min(tick - f - a) AS ttd FROM ic CROSS JOIN z LEFT JOIN be ON slo = kind AND tick - f >= a AND tick - f < b + 28 GROUP BY 1) SELECT kind, ttd IS NOT NULL AS detected, ttd * 6 AS ttd_hours FROM h")
def incident_ttd(spark, sf):
    p = _panes(spark, sf)
    incidents = spark.createDataFrame(_INCIDENTS, "kind string, a long, b long")
    first = slo.tick_grid(p).select(F.min("lo").alias("f"))
    best = slo.best_alerts(slo.burn_alerts(p)).join(F.broadcast(first)).select("slo", (F.col("tick") - F.col("f")).alias("at"))
    hit = F.broadcast(incidents).join(best, (F.col("slo") == F.col("kind")) & (F.col("at") >= F.col("a")) & (F.col("at") < F.col("b") + 28), "left")
    return hit.groupBy("kind").agg(F.min(F.col("at") - F.col("a")).alias("ttd")).select("kind", F.col("ttd").isNotNull().alias("detected"), (F.col("ttd") * 6).alias("ttd_hours"))


# Experiments


@query("SELECT user_id, CAST('0x' || substr(sha256(CAST(user_id AS VARCHAR)), 1, 8) AS BIGINT) % 100 AS bucket, count(*) AS n FROM events GROUP BY 1")
def canary_bucket(spark, sf):
    return A.table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n")).select("user_id", A.bucket(F.col("user_id")).alias("bucket"), "n")


_CO = A.TRACES + ", co AS (SELECT CASE WHEN bucket < 10 THEN 'canary' ELSE 'control' END AS cohort, count(*) AS n, count(*) FILTER (status <> 'ok') AS errors, count(*) FILTER (status = 'ok' AND refusal) AS refusals, count(*) FILTER (status = 'ok') AS ok, round(avg(quality) FILTER (status = 'ok'), 6) AS quality, round(quantile_cont(latency_ms, 0.95), 4) AS p95, round(avg(cost_usd), 9) AS cost FROM tr GROUP BY 1)"


@query(f"WITH {_CO} SELECT * FROM co")
def canary_cohorts(spark, sf):
    return D.cohorts(A.traces(spark, sf))


@query(f"WITH {_CO}, x AS (SELECT CAST(a.errors AS DOUBLE) ka, CAST(a.n AS DOUBLE) na, CAST(b.errors AS DOUBLE) kb, CAST(b.n AS DOUBLE) nb FROM co a, co b WHERE a.cohort = 'canary' AND b.cohort = 'control') SELECT round(ka / na - kb / nb, 6) AS delta, round((ka / na - kb / nb) / sqrt((ka + kb) / (na + nb) * (1 - (ka + kb) / (na + nb)) * (1 / na + 1 / nb)), 4) AS z FROM x")
def canary_ztest(spark, sf):
    return D.two_proportions(D.cohorts(A.traces(spark, sf)), "errors", "n")


_PAIR = A.TRACES + ", pa AS (SELECT session_id % 50 AS case_id, session_id % 5 AS tag, avg(quality) FILTER (version = 'v0') AS base, avg(quality) FILTER (version = 'v1') AS cand FROM tr GROUP BY 1, 2)"


def _paired(spark, sf):
    t = A.traces(spark, sf)
    arm = lambda v: F.avg(F.when(F.col("version") == v, F.col("quality")))
    return t.groupBy((F.col("session_id") % 50).alias("case_id"), (F.col("session_id") % 5).alias("tag")).agg(arm("v0").alias("base"), arm("v1").alias("cand"))


@query(f"WITH {_PAIR} SELECT count(*) AS n, round(avg(cand - base), 6) AS delta, count(*) FILTER (cand > base) AS wins, count(*) FILTER (cand < base) AS losses, count(*) FILTER (cand = base) AS ties FROM pa WHERE base IS NOT NULL AND cand IS NOT NULL")
def gate_paired_deltas(spark, sf):
    d = F.col("cand") - F.col("base")
    return _paired(spark, sf).where("base IS NOT NULL AND cand IS NOT NULL").agg(F.count("*").alias("n"), F.round(F.avg(d), 6).alias("delta"), F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"), F.count_if(d == 0).alias("ties"))


@query(f"WITH {_PAIR} SELECT tag, count(*) AS n, round(avg(cand) - avg(base), 6) AS delta, avg(cand) - avg(base) >= -0.15 AS ok FROM pa WHERE base IS NOT NULL AND cand IS NOT NULL GROUP BY 1 HAVING count(*) >= 5")
def gate_slices(spark, sf):
    s = _paired(spark, sf).where("base IS NOT NULL AND cand IS NOT NULL").groupBy("tag").agg(F.count("*").alias("n"), (F.avg("cand") - F.avg("base")).alias("d")).where("n >= 5")
    return s.select("tag", "n", F.round("d", 6).alias("delta"), (F.col("d") >= -0.15).alias("ok"))


@query(f"WITH {_PAIR}, x AS (SELECT count(*) FILTER (cand > 0.71 AND base <= 0.71) AS wins, count(*) FILTER (base > 0.71 AND cand <= 0.71) AS losses FROM pa), y AS (SELECT *, wins + losses AS n, least(wins, losses) AS m FROM x) SELECT wins, losses, round(CASE WHEN n = 0 THEN 1 ELSE least(1, 2 * (SELECT sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2))) FROM (SELECT unnest(range(0, m + 1)) AS k))) END, 6) AS p FROM y")
def gate_mcnemar(spark, sf):
    good = lambda c: F.col(c) > 0.71
    x = _paired(spark, sf).agg(F.count_if(good("cand") & ~good("base")).alias("wins"), F.count_if(good("base") & ~good("cand")).alias("losses"))
    return x.select("wins", "losses", F.round(D.mcnemar(F.col("wins"), F.col("losses")), 6).alias("p"))


@query(f"{_TR} SELECT round(avg(cost_usd) FILTER (version = 'v1') / avg(cost_usd) FILTER (version = 'v0'), 6) AS cost_ratio, round(avg(CAST(json_valid AS INTEGER)), 6) AS json_rate FROM tr")
def gate_cost_ratio(spark, sf):
    cost = lambda v: F.avg(F.when(F.col("version") == v, F.col("cost_usd")))
    return A.traces(spark, sf).agg(F.round(cost("v1") / cost("v0"), 6).alias("cost_ratio"), F.round(F.avg(F.col("json_valid").cast("int")), 6).alias("json_rate"))


# Sampling, splits, data sets

_STRAT = "CASE WHEN status = 'error' THEN 0 WHEN negative_feedback THEN 1 WHEN quality < 0.75 THEN 2 ELSE 3 END"


@query(f"{_TR}, s AS (SELECT trace_id, ts, {_STRAT} AS stratum FROM tr) SELECT trace_id, stratum FROM s ORDER BY stratum, CASE WHEN stratum < 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S.%f') ELSE md5('7|' || trace_id) END, trace_id LIMIT 2000")
def sample_stratified(spark, sf):
    return D.stratified_sample(A.traces(spark, sf), 2000)


@query("SELECT event_id AS trace_id FROM events ORDER BY md5('1|' || event_id), event_id LIMIT 500")
def sample_uniform(spark, sf):
    e = A.table(spark, sf, "events").select(F.col("event_id").alias("trace_id"))
    return e.orderBy(D.seeded("1", F.col("trace_id")), "trace_id").limit(500)


@query("SELECT doc_id, quality AS y, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY md5('3|' || doc_id), doc_id) <= CASE WHEN count(*) OVER (PARTITION BY quality) > 1 THEN greatest(1, CAST(round_even(count(*) OVER (PARTITION BY quality) * 0.25, 0) AS INTEGER)) ELSE 0 END THEN 'test' ELSE 'train' END AS split FROM labels")
def split_stratified(spark, sf):
    return D.stratified_split(A.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("y")), 0.25)


@query("SELECT conv_id, CASE WHEN row_number() OVER (ORDER BY md5('5|' || conv_id)) <= greatest(1, count(*) OVER () // 5) THEN 'calibration' ELSE 'train' END AS split FROM (SELECT DISTINCT conv_id FROM conversations)")
def split_grouped(spark, sf):
    c = A.table(spark, sf, "conversations").select("conv_id").distinct()
    keyed = c.select("conv_id", D.seeded("5", F.col("conv_id")).alias("key"), F.lit(1).alias("one"))
    ranked = running(keyed, F.conv(F.substring("key", 1, 3), 16, 10).cast("long"), ["key"], {"one": "rank"})
    total = F.broadcast(c.agg(F.greatest(F.lit(1), F.floor(F.count("*") / 5)).alias("size")))
    return ranked.join(total).select("conv_id", F.when(F.col("rank") <= F.col("size"), "calibration").otherwise("train").alias("split"))


@query("WITH a AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 10 <> 0), b AS (SELECT doc_id, md5(CASE WHEN doc_id % 7 = 0 THEN text || '.' ELSE text END) AS h FROM documents WHERE doc_id % 11 <> 0) SELECT CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' WHEN a.h <> b.h THEN 'changed' ELSE 'same' END AS change, count(*) AS n FROM a FULL JOIN b USING (doc_id) GROUP BY 1")
def dataset_diff(spark, sf):
    d = A.table(spark, sf, "documents").select("doc_id", "text")
    a = d.where("doc_id % 10 <> 0").select("doc_id", F.md5("text").alias("ha"))  # two versions of a data set, made here
    b = d.where("doc_id % 11 <> 0").select("doc_id", F.md5(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text"))).alias("hb"))
    change = F.when(F.col("ha").isNull(), "added").when(F.col("hb").isNull(), "removed").when(F.col("ha") != F.col("hb"), "changed").otherwise("same")
    return a.join(b, "doc_id", "full").groupBy(change.alias("change")).agg(F.count("*").alias("n"))


@query(f"SELECT lang, {T.set_digest_sql('h')} AS hash, count(*) AS n FROM (SELECT lang, sha256(doc_id || '|' || source || '|' || text) AS h FROM documents) GROUP BY 1")
def dataset_hash(spark, sf):
    """A digest of each language's rows: the same in any order, and partial sums per task."""
    h = F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "source", "text"), 256)
    return A.table(spark, sf, "documents").select("lang", h.alias("h")).groupBy("lang").agg(T.set_digest(F.col("h")).alias("hash"), F.count("*").alias("n"))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(trim(regexp_replace(lower(text), '[ \\t\\n\\r]+', ' ', 'g')))) AS first_id FROM documents")
def neardup_exact_norm(spark, sf):
    d = A.table(spark, sf, "documents").select("doc_id", F.md5(T.normal(F.col("text"))).alias("h"))
    return d.join(d.groupBy("h").agg(F.min("doc_id").alias("first_id")), "h").select("doc_id", "first_id")


# Text


@query(f"SELECT lang, token, n FROM (SELECT lang, token, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS r FROM (SELECT lang, token, count(*) AS n FROM (SELECT lang, unnest({T.tokens_sql('text')}) AS token FROM documents) GROUP BY 1, 2)) WHERE r <= 4")
def tokens_topterms(spark, sf):
    n = A.table(spark, sf, "documents").select("lang", F.explode(T.tokens(F.col("text"))).alias("token")).groupBy("lang", "token").agg(F.count("*").alias("n"))
    return n.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "token"))).where("r <= 4").drop("r")


@query(f"WITH v AS (SELECT DISTINCT unnest({T.tokens_sql('text')}) AS w FROM benchmark), t AS (SELECT doc_id, unnest({T.tokens_sql('text')}) AS w FROM documents) SELECT t.doc_id, round(count(*) FILTER (v.w IS NULL) / count(*), 6) AS oov FROM t LEFT JOIN v USING (w) GROUP BY 1")
def oov_share(spark, sf):
    known = A.table(spark, sf, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("w")).distinct().withColumn("known", F.lit(True))
    words = A.table(spark, sf, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("w")).groupBy("doc_id", "w").agg(F.count("*").alias("n"))
    return words.join(known, "w", "left").groupBy("doc_id").agg(F.round(F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)) / F.sum("n"), 6).alias("oov"))


@query("SELECT role, count(*) AS n, count(*) FILTER (regexp_matches(text, '(?i)\\b(later|next time|not yet|defer|postpone|think about it)\\b')) AS deferrals, CAST(sum(greatest(1, CAST(round_even(length(text) / 4, 0) AS BIGINT))) AS BIGINT) AS tokens FROM conversations GROUP BY 1")
def deferral_counts(spark, sf):
    return A.table(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.count_if(T.matches(F.col("text"), T.DEFERRAL)).alias("deferrals"), F.sum(T.token_estimate(F.col("text"))).alias("tokens"))


@query()
def edit_ratio_negative(spark, sf):
    """Whole turns by code points; DuckDB's distance counts bytes, so tests hold this against a plain table of edits."""
    c = A.table(spark, sf, "conversations").withColumn("before", F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))).where("before IS NOT NULL")
    return c.select("conv_id", "turn", F.round(T.edit_ratio(F.col("text"), F.col("before")), 6).alias("ratio"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+')) AS emails, md5(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+', '[EMAIL]', 'g')) AS redacted FROM documents")
def redact_email(spark, sf):
    p = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+"
    return A.table(spark, sf, "documents").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))).cast("long").alias("emails"), F.md5(T.redact_email(F.col("text"))).alias("redacted"))


def _weighted_sql(d: str, weights: list[int], first: int) -> str:
    return " + ".join(f"(CAST(substr({d}, {i + 1}, 1) AS INTEGER) - {first if i == 0 else 0}) * {w}" for i, w in enumerate(weights))


@query(f"WITH x AS (SELECT o_orderkey, lpad(CAST((o_orderkey * 7919 + 12345) % 900000000 + 100000000 AS VARCHAR), 9, '0') AS tfn, CAST((o_orderkey * 104729 + 7) % 90000000000 + 10000000000 AS VARCHAR) AS abn FROM orders) SELECT o_orderkey, ({_weighted_sql('tfn', [1, 4, 3, 7, 5, 8, 6, 9, 10], 0)}) % 11 = 0 AS tfn_ok, ({_weighted_sql('abn', [10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19], 1)}) % 89 = 0 AS abn_ok FROM x")
def tfn_abn_checksums(spark, sf):
    o, k = A.table(spark, sf, "orders"), F.col("o_orderkey")
    x = o.select("o_orderkey", ((k * 7919 + 12345) % 900000000 + 100000000).cast("string").alias("tfn"), ((k * 104729 + 7) % F.lit(90000000000) + F.lit(10000000000)).cast("string").alias("abn"))
    return x.select("o_orderkey", T.tfn_valid(F.col("tfn")).alias("tfn_ok"), T.abn_valid(F.col("abn")).alias("abn_ok"))


# Evaluation


@query(f"{_PR} SELECT y AS gold, count(*) FILTER (p >= 0.6) AS said_1, count(*) FILTER (p < 0.4) AS said_0, count(*) FILTER (p >= 0.4 AND p < 0.6) AS unknown FROM pr GROUP BY 1")
def confusion_matrix(spark, sf):
    p = F.col("p")
    return A.predictions(spark, sf).groupBy(F.col("y").alias("gold")).agg(F.count_if(p >= 0.6).alias("said_1"), F.count_if(p < 0.4).alias("said_0"), F.count_if((p >= 0.4) & (p < 0.6)).alias("unknown"))


_PRF = A.PREDICTIONS + ", pf AS (SELECT class, count(*) FILTER (g = class AND y = class) AS tp, count(*) FILTER (g = class AND y <> class) AS fp, count(*) FILTER (g <> class AND y = class) AS fn FROM (SELECT CAST(p >= 0.5 AS INTEGER) AS g, y, unnest([0, 1]) AS class FROM pr) GROUP BY 1), pq AS (SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM pf)"


@query(f"WITH {_PRF} SELECT * FROM pq")
def per_class_prf(spark, sf):
    return D.prf(A.predictions(spark, sf), 0.5)


@query(f"WITH {_PRF} SELECT round(avg(f1), 6) AS macro_f1 FROM pq")
def macro_f1(spark, sf):
    return D.prf(A.predictions(spark, sf), 0.5).agg(F.round(F.avg("f1"), 6).alias("macro_f1"))


@query(f"{_PR} SELECT t AS threshold, round(avg(CAST(greatest(p, 1 - p) < t AS INTEGER)), 6) AS abstain, round(avg(CAST((p >= 0.5) = (y = 1) AS INTEGER)) FILTER (greatest(p, 1 - p) >= t), 6) AS accuracy FROM (SELECT *, CAST(unnest([0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99, 1.0]) AS DOUBLE) AS t FROM pr) GROUP BY 1")
def abstain_curve(spark, sf):
    p = A.predictions(spark, sf).withColumn("t", F.explode(F.array(*[F.lit(x) for x in (0.5, 0.6, 0.7, 0.8, 0.9, 0.95, 0.99, 1.0)])))
    sure, right = F.greatest(F.col("p"), 1 - F.col("p")) >= F.col("t"), (F.col("p") >= 0.5) == (F.col("y") == 1)
    return p.groupBy(F.col("t").alias("threshold")).agg(F.round(F.avg((~sure).cast("int")), 6).alias("abstain"), F.round(F.avg(F.when(sure, right.cast("int"))), 6).alias("accuracy"))


_REL = A.PREDICTIONS + ", rl AS (SELECT CAST(least(floor(p * 10), 9) AS BIGINT) AS bin, count(*) AS n, round(avg(p), 6) AS confidence, round(avg(y), 6) AS accuracy FROM pr GROUP BY 1)"


@query(f"WITH {_REL} SELECT * FROM rl")
def ece_bins(spark, sf):
    return D.reliability(A.predictions(spark, sf))


@query(f"WITH {_REL} SELECT round(sum(n * abs(confidence - accuracy)) / sum(n), 5) AS ece FROM rl")
def ece(spark, sf):
    return D.reliability(A.predictions(spark, sf)).agg(F.round(F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n"), 5).alias("ece"))


_RC = A.PREDICTIONS + ", g AS (SELECT p, count(*) AS n, sum(1 - y) AS w FROM pr GROUP BY 1), rc AS (SELECT p, CAST(sum(n) OVER o AS BIGINT) AS accepted, sum(n) OVER o / sum(n) OVER () AS coverage, sum(w) OVER o / sum(n) OVER o AS risk FROM g WINDOW o AS (ORDER BY p DESC))"


@query(f"WITH {_RC} SELECT round(p, 9) AS p, accepted, round(coverage, 6) AS coverage, round(risk, 6) AS risk FROM rc")
def risk_coverage(spark, sf):
    return D.risk_coverage(A.predictions(spark, sf)).select(F.round("p", 9).alias("p"), "accepted", F.round("coverage", 6).alias("coverage"), F.round("risk", 6).alias("risk"))


@query(f"WITH {_RC} SELECT round(sum((coverage - coalesce(before, 0)) * risk), 6) AS aurc FROM (SELECT *, lag(coverage) OVER (ORDER BY p DESC) AS before FROM rc)")
def aurc(spark, sf):
    return D.risk_coverage(A.predictions(spark, sf)).agg(F.round(F.sum(F.col("share") * F.col("risk")), 6).alias("aurc"))


@query(f"WITH {_RC} SELECT round(coalesce(min(p) FILTER (risk <= 0.02), 1.0001), 6) AS tau FROM rc")
def choose_tau(spark, sf):
    return D.risk_coverage(A.predictions(spark, sf)).agg(F.round(F.coalesce(F.min(F.when(F.col("risk") <= 0.02, F.col("p"))), F.lit(1.0001)), 6).alias("tau"))


# Reconciliation and validation

_REC = "rc AS (SELECT coalesce(o_orderkey, l_orderkey) AS key, o_totalprice AS expected, held, CASE WHEN held IS NULL THEN 'not_implemented' WHEN o_totalprice IS NULL THEN 'unexpected' WHEN abs(CAST(held AS DOUBLE) - o_totalprice) > 0.05 * abs(o_totalprice) THEN 'amount_mismatch' ELSE 'ok' END AS verdict FROM orders FULL JOIN (SELECT l_orderkey, sum(CAST(l_extendedprice AS DECIMAL(15, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))) AS held FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"


def _reconciled(spark, sf):
    expected = A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("expected"))
    held = A.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.sum(F.col("l_extendedprice").cast("decimal(15,2)") * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("double").alias("held"))
    return D.reconciled(expected, held)


@query(f"WITH {_REC} SELECT key, expected, CAST(held AS DOUBLE) AS held, verdict FROM rc")
def reconcile_orders(spark, sf):
    return _reconciled(spark, sf)


@query(f"WITH {_REC} SELECT verdict, count(*) AS n FROM rc GROUP BY ROLLUP (verdict)")
def reconcile_rollup(spark, sf):
    return _reconciled(spark, sf).rollup("verdict").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, unnest(list_filter([CASE WHEN o_totalprice > 300000 THEN 'amount_large' END, CASE WHEN o_orderdate < TIMESTAMP '1995-01-01' THEN 'date_old' END, CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'status_open' END], lambda x: x IS NOT NULL)) AS violation FROM orders")
def validate_orders(spark, sf):
    c = F.col
    checks = [F.when(c("o_totalprice") > 300000, "amount_large"), F.when(c("o_orderdate") < F.expr("TIMESTAMP_NTZ '1995-01-01'"), "date_old"), F.when(~c("o_orderstatus").isin("O", "F"), "status_open")]
    return A.table(spark, sf, "orders").select("o_orderkey", F.explode(F.array_compact(F.array(*checks))).alias("violation"))


@query("SELECT l_suppkey, l_returnflag, round(sum(l_extendedprice), 2) AS amount FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1, 2")
def expected_positions(spark, sf):
    return A.table(spark, sf, "lineitem").where("l_returnflag <> 'R'").groupBy("l_suppkey", "l_returnflag").agg(F.round(F.sum("l_extendedprice"), 2).alias("amount"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def topk_holdings(spark, sf):
    r = F.row_number().over(W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return A.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", r.alias("r")).where("r <= 3").drop("r")


@query("SELECT o_orderstatus AS state, o_orderpriority AS type, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def workflow_grouping_sets(spark, sf):
    o = A.table(spark, sf, "orders").select(F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("type"))
    return o.groupingSets([("state",), ("type",), ()], "state", "type").agg(F.count("*").alias("n"))


# Claims

_CE = A.CLAIMS + ", ct AS (SELECT meeting_id, idx, unnest(evidence) AS seg_id FROM cl), ev AS (SELECT meeting_id, idx, coalesce(string_agg(sg.text, ' '), '') AS said, count(*) FILTER (sg.text IS NULL) AS unknown FROM ct LEFT JOIN sg USING (meeting_id, seg_id) GROUP BY 1, 2), ce AS (SELECT cl.meeting_id, cl.idx, cl.text, coalesce(said, '') AS said, coalesce(unknown, 0) AS unknown FROM cl LEFT JOIN ev USING (meeting_id, idx))"
_OV = f"ov AS (SELECT meeting_id, idx, unknown, CASE WHEN len(c) = 0 THEN 1.0 ELSE len(list_intersect(c, e)) / len(c) END AS o FROM (SELECT *, list_distinct({T.tokens_sql('text')}) AS c, list_distinct({T.tokens_sql('said')}) AS e FROM ce))"


def _claims(spark, sf):
    return D.claim_evidence(A.claims(spark, sf), A.segments(spark, sf))


@query(f"WITH {_CE} SELECT meeting_id, idx, length(said) AS said_chars, unknown FROM ce")
def claim_evidence_join(spark, sf):
    return _claims(spark, sf).select("meeting_id", "idx", F.length("said").cast("long").alias("said_chars"), "unknown")


@query(f"WITH {_CE}, {_OV} SELECT meeting_id, idx, CASE WHEN unknown > 0 OR o < 0.25 THEN 'unsupported' WHEN o < 0.5 THEN 'weak' ELSE 'supported' END AS verdict, round(CASE WHEN unknown > 0 THEN 0 WHEN o < 0.25 THEN 0.5 * o WHEN o < 0.5 THEN 0.5 + 0.3 * o ELSE least(1, 0.7 + 0.3 * o) END, 6) AS score FROM ov")
def claim_verdicts(spark, sf):
    return D.verdicts(_claims(spark, sf))


@query(f"WITH {A.CLAIMS} SELECT meeting_id, seg_id, count(*) AS n FROM (SELECT meeting_id, unnest(evidence) AS seg_id FROM cl) x WHERE NOT EXISTS (SELECT 1 FROM sg WHERE sg.meeting_id = x.meeting_id AND sg.seg_id = x.seg_id) GROUP BY 1, 2")
def unknown_evidence(spark, sf):
    cited = A.claims(spark, sf).select("meeting_id", F.explode("evidence").alias("seg_id"))
    return cited.join(A.segments(spark, sf).select("meeting_id", "seg_id"), ["meeting_id", "seg_id"], "left_anti").groupBy("meeting_id", "seg_id").agg(F.count("*").alias("n"))


@query(f"{_SG} SELECT meeting_id, max(pos) AS version, arg_max(speaker, pos) AS speaker FROM sg GROUP BY 1")
def note_version_latest(spark, sf):
    return A.segments(spark, sf).groupBy("meeting_id").agg(F.max("pos").alias("version"), F.max_by("speaker", "pos").alias("speaker"))


@query("SELECT doc_id, line, last_value(h IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line) AS section FROM (SELECT doc_id, line, CASE WHEN line = 0 OR length(text) <= 20 THEN line END AS h FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents))")
def section_forward_fill(spark, sf):
    lines = A.table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).select("doc_id", F.col("line").cast("long").alias("line"), "text")
    head = F.when((F.col("line") == 0) | (F.length("text") <= 20), F.col("line"))
    return lines.select("doc_id", "line", F.last(head, ignorenulls=True).over(W.partitionBy("doc_id").orderBy("line")).alias("section"))


# Vectors and drift


@query("WITH c AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2), d AS (SELECT vec_id, c.label, sum((x - m) * (x - m)) AS d FROM (SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) JOIN c USING (i) GROUP BY 1, 2) SELECT vec_id, arg_min(label, d) AS nearest, round(sqrt(min(d)), 4) AS distance FROM d GROUP BY 1")
def nearest_centroid(spark, sf):
    v = A.table(spark, sf, "embeddings")
    means = v.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    centres = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    held = F.broadcast(centres.agg(F.collect_list(F.struct("label", "c")).alias("cs")))  # one centre per label: ten
    away = lambda e, c: F.aggregate(F.zip_with(e, c, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda a, x: a + x)
    best = v.join(held).select("vec_id", F.array_min(F.transform("cs", lambda s: F.struct(away(F.col("embedding"), s["c"]).alias("d"), s["label"].alias("label")))).alias("b"))
    return best.select("vec_id", F.col("b.label").alias("nearest"), F.round(F.sqrt("b.d"), 4).alias("distance"))


_MIX = "m AS (SELECT event_type, count(*) FILTER (h) AS a, count(*) FILTER (NOT h) AS b FROM (SELECT event_type, ts < TIMESTAMP '2024-01-15' AS h FROM events) GROUP BY 1), q AS (SELECT *, a / sum(a) OVER () AS p, b / sum(b) OVER () AS r FROM m)"


def _mix(spark, sf):
    h = F.col("ts") < F.expr("TIMESTAMP_NTZ '2024-01-15'")
    m = A.table(spark, sf, "events").groupBy("event_type").agg(F.count_if(h).alias("a"), F.count_if(~h).alias("b"))
    return m.withColumn("p", F.col("a") / F.sum("a").over(W.partitionBy())).withColumn("r", F.col("b") / F.sum("b").over(W.partitionBy()))


@query(f"WITH {_MIX} SELECT round(sqrt(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + r)) ELSE 0 END + CASE WHEN r > 0 THEN r * log2(2 * r / (p + r)) ELSE 0 END) / 2), 6) AS js FROM q")
def js_drift(spark, sf):
    p, r = F.col("p"), F.col("r")
    term = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + r))).otherwise(0.0)
    return _mix(spark, sf).agg(F.round(F.sqrt(F.sum(term(p) + term(r)) / 2), 6).alias("js"))


@query(f"WITH {_MIX}, t AS (SELECT *, sum(a) OVER () AS ta, sum(b) OVER () AS tb FROM q) SELECT round(sum(pow(a - (a + b) * ta / (ta + tb), 2) / ((a + b) * ta / (ta + tb)) + pow(b - (a + b) * tb / (ta + tb), 2) / ((a + b) * tb / (ta + tb))), 4) AS chi2, count(*) - 1 AS df FROM t")
def chi2_drift(spark, sf):
    w, a, b = W.partitionBy(), F.col("a"), F.col("b")
    t = _mix(spark, sf).withColumn("ta", F.sum("a").over(w)).withColumn("tb", F.sum("b").over(w))
    part = lambda x, s: F.pow(x - (a + b) * F.col(s) / (F.col("ta") + F.col("tb")), 2) / ((a + b) * F.col(s) / (F.col("ta") + F.col("tb")))
    return t.agg(F.round(F.sum(part(a, "ta") + part(b, "tb")), 4).alias("chi2"), (F.count("*") - 1).alias("df"))


@query("WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), g AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM s) SELECT user_id, min(ts) AS first, count(*) AS events FROM g GROUP BY user_id, n")
def session_windows(spark, sf):
    e = A.table(spark, sf, "events").select("user_id", "ts")
    return e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.min("ts").alias("first"), F.count("*").alias("events")).drop("w")


@query(f"{_TR}, m AS (SELECT version, avg(latency_ms) AS a, stddev_pop(latency_ms) AS s FROM tr GROUP BY 1) SELECT trace_id, round((latency_ms - a) / s, 4) AS z FROM tr JOIN m USING (version) WHERE abs((latency_ms - a) / s) > 3")
def feature_zscores(spark, sf):
    t = A.traces(spark, sf).select("trace_id", "version", "latency_ms")
    m = t.groupBy("version").agg(F.avg("latency_ms").alias("a"), F.stddev_pop("latency_ms").alias("s"))
    return t.join(m, "version").select("trace_id", F.round((F.col("latency_ms") - F.col("a")) / F.col("s"), 4).alias("z"), ((F.col("latency_ms") - F.col("a")) / F.col("s")).alias("raw")).where("abs(raw) > 3").drop("raw")


# Streams, fuzzy matching, models, exports


@query(f"WITH {_LONG} SELECT date_trunc('hour', ts) AS hour, count(*) AS n, CAST(sum(CAST(bad AS INTEGER)) AS BIGINT) AS bad FROM lf WHERE slo = 'error' GROUP BY 1")
def stream_slo_hourly(spark, sf):
    return monitor.hourly_errors(spark, sf)


@query("SELECT event_id, json_valid(CASE WHEN event_id % 13 = 0 THEN props || '}' ELSE props END) AS valid FROM events")
def json_validity(spark, sf):
    e = A.table(spark, sf, "events")
    return e.select("event_id", fuzzy.json_valid(F.when(F.col("event_id") % 13 == 0, F.concat("props", F.lit("}"))).otherwise(F.col("props"))).alias("valid"))


@query()
def fuzzy_lookup(spark, sf):
    """The best of the nations for each customer's mangled nation name, as the name's first letters doubled."""
    nations = [r.n_name for r in A.table(spark, sf, "nation").select("n_name").orderBy("n_name").collect()]  # a fixed list of 25
    c = A.table(spark, sf, "customer").join(F.broadcast(A.table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select("c_custkey", "n_name", fuzzy.best_match(nations)(F.concat(F.substring("n_name", 1, 1), F.lower("n_name"))).alias("found"))


@query("SELECT user_id, count(*) AS n, string_agg(event_type, ',' ORDER BY ts, event_id) AS kinds FROM events GROUP BY 1")
def export_rows(spark, sf):
    e = A.table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))).alias("x"))
    return e.select("user_id", "n", F.array_join(F.transform("x", lambda v: v["event_type"]), ",").alias("kinds"))


@query("SELECT conv_id AS meeting_id, printf('s%03d', turn + 1) AS seg_id, role AS speaker, turn * 10 AS t FROM conversations")
def transcript_parse(spark, sf):
    """Writes each turn as a transcript line and parses it back."""
    c = A.table(spark, sf, "conversations")
    lines = c.select(F.col("conv_id").alias("meeting_id"), F.col("turn").alias("pos"), F.concat(F.format_string("s%03d [%02d:%02d] ", F.col("turn") + 1, F.floor(F.col("turn") / 6), F.col("turn") % 6 * 10), "role", F.lit(": "), F.regexp_replace("text", "\n", " ")).alias("line"))
    return files.parse_transcript(lines).select("meeting_id", "seg_id", "speaker", "t")


@query()
def kmeans_topics(spark, sf):
    return models.topics(A.table(spark, sf, "embeddings"))


@query()
def tfidf_classifier(spark, sf):
    docs = A.table(spark, sf, "documents").join(A.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")
    return models.classify(docs)


@query()
def router_calibrated(spark, sf):
    return models.calibrated(A.predictions(spark, sf))


@query()
def bootstrap_ci(spark, sf):
    t = A.traces(spark, sf).select("version", "session_id", F.when(F.col("status") == "ok", F.col("quality")).alias("x")).where("x IS NOT NULL")
    return models.bootstrap(t, "version", "session_id", "x")
