"""Queries on releases, the trace store, jobs, prompts and incidents, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import release as R
from ..sources import adapters as A
from .catalogue import _PAIR, _paired
from .registry import query

_TR = f"WITH {A.TRACES}"

# Decisions

COHORT = ", ".join(
    f"count(*) FILTER ({of}) AS n_{c}, count(*) FILTER ({of} AND status <> 'ok') AS e_{c}, count(*) FILTER ({of} AND status = 'ok' AND refusal) AS r_{c}, count(quality) FILTER ({of} AND status = 'ok') AS q_{c}, "
    f"avg(quality) FILTER ({of} AND status = 'ok') AS m_{c}, coalesce(var_samp(quality) FILTER ({of} AND status = 'ok'), 0) AS v_{c}"
    for c, of in (("c", "bucket < stage"), ("t", "bucket >= stage"))
)


@query(f"{_TR}, co AS (SELECT stage, {COHORT} FROM tr, (VALUES (10), (50), (100)) s(stage) GROUP BY stage) SELECT {', '.join(R.canary_columns())} FROM co")
def canary_decision(spark, sf):
    return R.canary(A.traces(spark, sf))


_EVENTS = "ev AS (SELECT user_id % 20 AS release, event_id AS seq, CASE k % 4 WHEN 0 THEN 'start' WHEN 1 THEN 'advance' WHEN 2 THEN 'rollback' ELSE 'promote' END AS event, version, CASE WHEN k % 4 < 2 THEN CASE k % 3 WHEN 0 THEN 10 WHEN 1 THEN 50 ELSE 100 END END AS stage FROM (SELECT trace_id AS event_id, session_id AS user_id, k, version FROM tr))"


@query(f"{_TR}, {_EVENTS} SELECT release, last.c AS canary, last.s AS stage, active, events FROM (SELECT release, arg_max(struct_pack(c := CASE WHEN event IN ('start', 'advance') THEN version END, s := CASE WHEN event IN ('start', 'advance') THEN stage END), seq) AS last, arg_max(version, seq) FILTER (event = 'promote') AS active, count(*) AS events FROM ev GROUP BY 1)")
def canary_state(spark, sf):
    k = F.col("k")
    event = F.when(k % 4 == 0, "start").when(k % 4 == 1, "advance").when(k % 4 == 2, "rollback").otherwise("promote")
    stage = F.when(k % 4 < 2, F.when(k % 3 == 0, 10).when(k % 3 == 1, 50).otherwise(100))
    return R.canary_state(A.traces(spark, sf).select((F.col("session_id") % 20).alias("release"), F.col("trace_id").alias("seq"), event.alias("event"), "version", stage.alias("stage")))


_PAIRED = f"{{}}, count(*) AS n, avg(cand - base) AS delta, coalesce(stddev_samp(cand - base), 0) AS sd, count(*) FILTER (cand > base) AS wins, count(*) FILTER (cand < base) AS losses"
_LIMITS = f"delta - {R.Z95} * sd / nullif(sqrt(n), 0) AS low, delta + {R.Z95} * sd / nullif(sqrt(n), 0) AS high"


@query(f"WITH {_PAIR}, s AS (SELECT {_PAIRED.format('tag')} FROM pa WHERE cand IS NOT NULL AND base IS NOT NULL GROUP BY tag), t AS (SELECT *, {_LIMITS} FROM s) SELECT tag, n, round(delta, 6) AS delta, round(low, 6) AS ci_low, round(high, 6) AS ci_high, wins, losses, {R.verdict_sql()} AS verdict FROM t")
def paired_verdicts(spark, sf):
    p = R.paired(_paired(spark, sf), "tag")
    return p.select("tag", "n", *[F.round(c, 6).alias(n) for c, n in (("delta", "delta"), ("low", "ci_low"), ("high", "ci_high"))], "wins", "losses", "verdict")


_GATE_WHY = "[CASE WHEN low < -0.05 THEN 'not_non_inferior' END, CASE WHEN l > w AND p < 0.05 THEN 'mcnemar' END, CASE WHEN bad > 0 THEN 'slice' END, CASE WHEN json_rate < 0.95 THEN 'json_validity' END, CASE WHEN cost_ratio > 1.5 THEN 'cost' END]"


def gate_sql(interval: str) -> str:
    """The gate in SQL, with CTEs that end in ``t`` (n, delta, low, high) over the pairs ``b``."""
    return f"""WITH {_PAIR}, b AS (SELECT * FROM pa WHERE cand IS NOT NULL AND base IS NOT NULL), {interval},
 c AS (SELECT count(*) FILTER (cand > 0.71 AND base <= 0.71) AS w, count(*) FILTER (base > 0.71 AND cand <= 0.71) AS l FROM b),
 m AS (SELECT w, l, CASE WHEN w + l = 0 THEN 1 ELSE least(1, 2 * (SELECT sum(exp(lgamma(w + l + 1) - lgamma(k + 1) - lgamma(w + l - k + 1) - (w + l) * ln(2))) FROM (SELECT unnest(range(0, least(w, l) + 1)) AS k))) END AS p FROM c),
 g AS (SELECT count(*) FILTER (d < -0.15) AS bad FROM (SELECT avg(cand) - avg(base) AS d FROM b GROUP BY tag HAVING count(*) >= 5)),
 r AS (SELECT avg(CAST(json_valid AS INTEGER)) FILTER (version = 'v1') AS json_rate, avg(cost_usd) FILTER (version = 'v1') / avg(cost_usd) FILTER (version = 'v0') AS cost_ratio FROM tr),
 z AS (SELECT *, CASE WHEN n < 20 THEN ['too_few_cases'] ELSE list_filter({_GATE_WHY}, lambda x: x IS NOT NULL) END AS why FROM t, m, g, r)
 SELECT CASE WHEN n < 20 THEN 'INSUFFICIENT_DATA' WHEN len(why) > 0 THEN 'FAIL' ELSE 'PASS' END AS decision, array_to_string(why, ',') AS reasons, n, round(delta, 6) AS delta, round(low, 6) AS ci_low, round(high, 6) AS ci_high, round(p, 6) AS p_mcnemar FROM z"""


def gate_rates(spark, sf):
    of = lambda c, v: F.avg(F.when(F.col("version") == v, c))
    return A.traces(spark, sf).agg(of(F.col("json_valid").cast("int"), "v1").alias("json_rate"), (of(F.col("cost_usd"), "v1") / of(F.col("cost_usd"), "v0")).alias("cost_ratio"))


@query(gate_sql(f"s AS (SELECT {_PAIRED.format('1 AS one')} FROM b), t AS (SELECT *, {_LIMITS} FROM s)"))
def gate_decision(spark, sf):
    return R.gate(_paired(spark, sf), gate_rates(spark, sf))


_METRICS = "mt AS (SELECT session_id % 50 AS case_id, metric, avg(x) FILTER (version = 'v1') AS cand, avg(x) FILTER (version = 'v0') AS base FROM (UNPIVOT (SELECT session_id, version, quality, latency_ms AS latency, CAST(cost_usd AS DOUBLE) AS cost FROM tr) ON quality, latency, cost INTO NAME metric VALUE x) GROUP BY 1, 2)"


@query(f"{_TR}, {_METRICS}, sg AS (SELECT metric, CASE WHEN metric IN ('cost', 'latency') THEN -1 ELSE 1 END AS sign, cand, base FROM mt WHERE cand IS NOT NULL AND base IS NOT NULL), s AS (SELECT metric, any_value(sign) AS sign, count(*) AS n, avg(sign * (cand - base)) AS delta, coalesce(stddev_samp(sign * (cand - base)), 0) AS sd, avg(cand) AS c, avg(base) AS b FROM sg GROUP BY 1), t AS (SELECT *, {_LIMITS} FROM s) SELECT metric, n, round(c, 6) AS candidate, round(b, 6) AS baseline, {R.verdict_sql()} AS verdict FROM t")
def metric_directions(spark, sf):
    """Raw means are reported; verdicts take metrics where less is better with the other sign."""
    t = A.traces(spark, sf).select((F.col("session_id") % 50).alias("case_id"), "version", F.expr("stack(3, 'quality', quality, 'latency', latency_ms, 'cost', cost_usd) AS (metric, x)"))
    arm = lambda v: F.avg(F.when(F.col("version") == v, F.col("x")))
    m = t.groupBy("case_id", "metric").agg(arm("v1").alias("cand"), arm("v0").alias("base")).where("cand IS NOT NULL AND base IS NOT NULL")
    sign = R.worse_when_high(F.col("metric"))
    v = R.paired(m.select("metric", (sign * F.col("cand")).alias("cand"), (sign * F.col("base")).alias("base")), "metric").select("metric", "verdict")
    return m.groupBy("metric").agg(F.count("*").alias("n"), F.round(F.avg("cand"), 6).alias("candidate"), F.round(F.avg("base"), 6).alias("baseline")).join(v, "metric")


@query()
def drift_decision(spark, sf):
    """Labels of vectors as topics: the first half against the second, topic 9 as the novel one; tests hold the statistics against plain ones."""
    e = A.table(spark, sf, "embeddings").groupBy(F.col("label").alias("topic")).agg(F.count_if(F.col("vec_id") % 2 == 0).alias("base"), F.count_if(F.col("vec_id") % 2 == 1).alias("now"))
    return R.drift(e, 9)


# The trace store

SPANS = """sp AS (SELECT trace_id, trace_id * 10 + i AS span_id, i, kind, kind || '-' || CAST((trace_id * 7 + i) % 4 AS VARCHAR) AS name, ts, CASE WHEN status = 'error' AND i = k % 3 THEN 'error' ELSE 'ok' END AS status, error_class,
 CASE WHEN (trace_id + i) % 11 <> 0 THEN (trace_id + i) % 500 END AS tokens, kind = 'llm' AND (trace_id + i) % 10 = 0 AS cost_missing, CASE WHEN NOT (kind = 'llm' AND (trace_id + i) % 10 = 0) THEN (trace_id + i) % 500 / 100000 END AS cost
 FROM (SELECT *, CASE (trace_id + i) % 3 WHEN 0 THEN 'llm' WHEN 1 THEN 'tool' ELSE 'retrieval' END AS kind FROM (SELECT *, unnest(range(0, k % 3 + 1)) AS i FROM tr)))"""


def spans(spark, sf):
    """One to three spans a trace, of three kinds; the last one has the trace's error."""
    t = A.traces(spark, sf).select("*", F.explode(F.sequence(F.lit(0), F.col("k") % 3)).alias("i"))
    n = F.col("trace_id") + F.col("i")
    t = t.withColumn("kind", F.when(n % 3 == 0, "llm").when(n % 3 == 1, "tool").otherwise("retrieval"))
    missing = (F.col("kind") == "llm") & (n % 10 == 0)
    return t.select(
        "trace_id", (F.col("trace_id") * 10 + F.col("i")).alias("span_id"), "i", "kind", F.concat_ws("-", "kind", ((F.col("trace_id") * 7 + F.col("i")) % 4).cast("string")).alias("name"), "ts",
        F.when((F.col("status") == "error") & (F.col("i") == F.col("k") % 3), "error").otherwise("ok").alias("status"), "error_class", F.when(n % 11 != 0, n % 500).alias("tokens"), missing.alias("cost_missing"), F.when(~missing, n % 500 / 100000).alias("cost"),
    )


@query(f"{_TR} SELECT trace_id, session_id, version, status, latency_ms FROM tr WHERE status = 'ok' AND version = 'v1' ORDER BY ts, trace_id LIMIT 1000")
def trace_query(spark, sf):
    """The first thousand traces of a status and version, in order of time: the store's default limit."""
    return A.traces(spark, sf).where("status = 'ok' AND version = 'v1'").orderBy("ts", "trace_id").limit(1000).select("trace_id", "session_id", "version", "status", "latency_ms")


@query(f"{_TR} SELECT trace_id, session_id, version, status, error_class, latency_ms, judge FROM tr WHERE trace_id = 42")
def trace_lookup(spark, sf):
    return A.traces(spark, sf).where("trace_id = 42").select("trace_id", "session_id", "version", "status", "error_class", "latency_ms", "judge")


@query(f"{_TR}, {SPANS}, r AS (SELECT min(ts) AS a, max(ts) AS b FROM tr) SELECT trace_id, kind, name, error_class FROM sp, r WHERE status = 'error' AND ts >= a AND ts < b")
def span_errors(spark, sf):
    s = spans(spark, sf)
    r = F.broadcast(A.traces(spark, sf).agg(F.min("ts").alias("a"), F.max("ts").alias("b")))
    return s.where("status = 'error'").join(r, (F.col("ts") >= F.col("a")) & (F.col("ts") < F.col("b"))).select("trace_id", "kind", "name", "error_class")


@query(f"""{_TR}, ch AS (SELECT event_id - event_id % 5 AS trace_id, 'feedback' AS kind, event_id AS id, props FROM events WHERE event_type = 'click' UNION ALL SELECT event_id - event_id % 7, 'score', event_id, props FROM events WHERE event_id % 3 = 0)
 SELECT trace_id, ch.kind, ch.id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM ch JOIN tr USING (trace_id)""")
def trace_children(spark, sf):
    """Feedback and scores of each trace, their payload's fields beside the row's."""
    e = A.table(spark, sf, "events")
    row = lambda d, step, kind: d.select((F.col("event_id") - F.col("event_id") % step).alias("trace_id"), F.lit(kind).alias("kind"), F.col("event_id").alias("id"), F.from_json("props", "k int").alias("p"))
    children = row(e.where("event_type = 'click'"), 5, "feedback").unionByName(row(e.where("event_id % 3 = 0"), 7, "score"))
    return children.join(A.traces(spark, sf).select("trace_id"), "trace_id").select("trace_id", "kind", "id", "p.k")


@query(f"{_TR}, {SPANS} SELECT trace_id, CAST(sum(coalesce(tokens, 0)) FILTER (kind = 'llm') AS BIGINT) AS tokens, coalesce(bool_or(cost_missing), false) AS cost_missing, round(CASE WHEN bool_or(cost_missing) THEN NULL ELSE coalesce(sum(cost) FILTER (kind = 'llm'), 0) END, 9) AS cost FROM sp GROUP BY 1")
def trace_rollup(spark, sf):
    """Tokens and cost of a trace's model spans: unknown if any is, 0 without such a span."""
    llm = F.col("kind") == "llm"
    g = spans(spark, sf).groupBy("trace_id").agg(F.sum(F.when(llm, F.coalesce("tokens", F.lit(0)))).alias("tokens"), F.bool_or("cost_missing").alias("cost_missing"), F.sum(F.when(llm, F.col("cost"))).alias("c"))
    return g.select("trace_id", "tokens", "cost_missing", F.round(F.when(~F.col("cost_missing"), F.coalesce("c", F.lit(0.0))), 9).alias("cost"))


@query(f"{_TR}, {SPANS} SELECT trace_id, name, arg_max(span_id, i) AS output, count(*) AS calls FROM sp WHERE kind = 'tool' GROUP BY 1, 2")
def trace_tools(spark, sf):
    """Tool outputs by name; of several spans of a name the last one counts."""
    return spans(spark, sf).where("kind = 'tool'").groupBy("trace_id", "name").agg(F.max_by("span_id", "i").alias("output"), F.count("*").alias("calls"))


@query(f"{_TR}, lt AS (SELECT event_id AS trace_id, CAST(event_id % 5 + 1 AS DOUBLE) AS judge, event_id % 2 = 0 AS negative FROM events WHERE event_id % 9 = 0) SELECT trace_id, coalesce(lt.judge, tr.judge) AS judge, negative_feedback OR coalesce(lt.negative, false) AS negative_feedback FROM tr LEFT JOIN lt USING (trace_id)")
def late_signals(spark, sf):
    """Signals that come after their trace replace its own; negative feedback stays."""
    late = A.table(spark, sf, "events").where("event_id % 9 = 0").select(F.col("event_id").alias("trace_id"), (F.col("event_id") % 5 + 1).cast("double").alias("late"), (F.col("event_id") % 2 == 0).alias("negative"))
    return A.traces(spark, sf).join(late, "trace_id", "left").select("trace_id", F.coalesce("late", "judge").alias("judge"), (F.col("negative_feedback") | F.coalesce("negative", F.lit(False))).alias("negative_feedback"))


@query(f"{_TR} SELECT version, count(*) AS started, count(*) FILTER (status = 'error') AS errors_kept, count(*) FILTER (status <> 'error' AND bucket < 10) AS sampled, count(*) FILTER (status <> 'error' AND bucket >= 10 AND negative_feedback) AS promoted, count(*) FILTER (status <> 'error' AND bucket >= 10 AND NOT negative_feedback) AS sampled_out FROM tr GROUP BY 1")
def tracer_counters(spark, sf):
    """What a tracer keeps: errors, the sampled tenth, and unsampled traces that late negative feedback promotes."""
    error, in_, bad = F.col("status") == "error", F.col("bucket") < 10, F.col("negative_feedback")
    return A.traces(spark, sf).groupBy("version").agg(F.count("*").alias("started"), F.count_if(error).alias("errors_kept"), F.count_if(~error & in_).alias("sampled"), F.count_if(~error & ~in_ & bad).alias("promoted"), F.count_if(~error & ~in_ & ~bad).alias("sampled_out"))


@query(f"{_TR} SELECT version, count(*) FILTER (k % 4 = 0 OR k % 9 = 0) AS judged, count(judge) AS scored, count(*) FILTER (judge IS NULL AND k % 9 = 0) AS missing, round(avg(judge), 6) AS mean FROM tr GROUP BY 1")
def judge_summary(spark, sf):
    missing = F.col("judge").isNull() & (F.col("k") % 9 == 0)
    return A.traces(spark, sf).groupBy("version").agg(F.count_if((F.col("k") % 4 == 0) | (F.col("k") % 9 == 0)).alias("judged"), F.count("judge").alias("scored"), F.count_if(missing).alias("missing"), F.round(F.avg("judge"), 6).alias("mean"))


@query(f"{_TR} SELECT count(*) FILTER (bucket < 35 AND refusal) AS refusal, count(*) FILTER (NOT coalesce(refusal, false) AND bucket < 25 AND NOT grounded) AS ungrounded, count(*) FILTER (bucket < p) AS negative, round(avg(p), 6) AS expected FROM (SELECT *, CASE WHEN refusal THEN 35 WHEN NOT grounded THEN 25 WHEN pii_leak OR NOT json_valid THEN 30 ELSE 2 END AS p FROM tr)")
def feedback_propensity(spark, sf):
    """Negative feedback drawn by outcome: the chance in per cent against the session's hash."""
    p = F.when(F.col("refusal"), 35).when(~F.col("grounded"), 25).when(F.col("pii_leak") | ~F.col("json_valid"), 30).otherwise(2)
    t, b = A.traces(spark, sf).withColumn("p", p), F.col("bucket")
    return t.agg(F.count_if((b < 35) & F.col("refusal")).alias("refusal"), F.count_if(~F.coalesce("refusal", F.lit(False)) & (b < 25) & ~F.col("grounded")).alias("ungrounded"), F.count_if(b < F.col("p")).alias("negative"), F.round(F.avg("p"), 6).alias("expected"))


@query("SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso, CAST(floor((epoch(ts) - epoch(first)) / 60) AS BIGINT) AS minutes FROM events, (SELECT min(ts) AS first FROM events)")
def time_forms(spark, sf):
    e = A.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("t"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))
    first = F.broadcast(e.agg(F.min("t").alias("first")))
    return e.join(first).select("event_id", F.unix_seconds("t").alias("seconds"), "iso", F.floor((F.unix_micros("t") - F.unix_micros("first")) / 60000000).cast("long").alias("minutes"))


# Jobs, corrections, prompts

_JOBS = "jb AS (SELECT l_orderkey AS job, l_linenumber AS seq, CASE l_linenumber % 4 WHEN 1 THEN 'classified' WHEN 2 THEN 'extracted' WHEN 3 THEN 'routed' ELSE 'done' END AS state, l_quantity > 45 AS failed, CAST(l_quantity AS BIGINT) * 10 AS ms FROM lineitem)"


def _jobs(spark, sf):
    n = F.col("l_linenumber")
    state = F.when(n % 4 == 1, "classified").when(n % 4 == 2, "extracted").when(n % 4 == 3, "routed").otherwise("done")
    return A.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("job"), n.alias("seq"), state.alias("state"), (F.col("l_quantity") > 45).alias("failed"), (F.col("l_quantity").cast("long") * 10).alias("ms"))


@query(f"WITH {_JOBS} SELECT job, arg_max(state, seq) AS state, count(*) FILTER (failed) AS failures, CAST(sum(ms) AS BIGINT) AS ms, bool_or(failed AND seq >= 3) AS gave_up FROM jb GROUP BY 1")
def job_states(spark, sf):
    """Each job's state from its log of transitions: the last one's, with failures and time; a failure from the third try on gives up."""
    return _jobs(spark, sf).groupBy("job").agg(F.max_by("state", "seq").alias("state"), F.count_if("failed").alias("failures"), F.sum("ms").alias("ms"), F.bool_or(F.col("failed") & (F.col("seq") >= 3)).alias("gave_up"))


@query(f"WITH {_JOBS} SELECT job, seq, state, ms FROM jb")
def job_transitions(spark, sf):
    return _jobs(spark, sf).select("job", "seq", "state", "ms")


@query("""WITH o AS (SELECT o_orderkey AS doc, o_orderpriority AS a, CASE WHEN o_orderkey % 5 = 0 THEN lower(o_orderpriority) ELSE o_orderpriority END AS b, o_orderstatus AS c, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS d FROM orders)
 SELECT doc, 'priority' AS field, a AS before, b AS after FROM o WHERE a <> b UNION ALL SELECT doc, 'status', c, d FROM o WHERE c <> d UNION ALL SELECT doc, '*', NULL, NULL FROM o WHERE a = b AND c = d""")
def correction_log(spark, sf):
    """One row per field that a reviewer changed, and one with * for what was approved unchanged."""
    o, k = A.table(spark, sf, "orders"), F.col("o_orderkey")
    change = lambda name, old, new: F.when(old != new, F.struct(F.lit(name).alias("field"), old.alias("before"), new.alias("after")))
    p, s = F.col("o_orderpriority"), F.col("o_orderstatus")
    changes = F.array_compact(F.array(change("priority", p, F.when(k % 5 == 0, F.lower(p)).otherwise(p)), change("status", s, F.when(k % 7 == 0, F.lit("X")).otherwise(s))))
    none = F.array(F.struct(F.lit("*").alias("field"), F.lit(None).cast("string").alias("before"), F.lit(None).cast("string").alias("after")))
    return o.select(k.alias("doc"), F.inline(F.when(F.size(changes) > 0, changes).otherwise(none)))


_PROMPTS = "pm AS (SELECT p_partkey AS n, p_brand || '@' || CAST(p_partkey % 40 AS VARCHAR) AS label, sha256(p_type) AS hash FROM part)"


def _prompts(spark, sf):
    return A.table(spark, sf, "part").select(F.col("p_partkey").alias("n"), F.concat_ws("@", "p_brand", (F.col("p_partkey") % 40).cast("string")).alias("label"), F.sha2("p_type", 256).alias("hash"))


@query(f"WITH {_PROMPTS}, f AS (SELECT label, arg_min(hash, n) AS kept FROM pm GROUP BY 1) SELECT n, label, CASE WHEN n = (min(n) OVER (PARTITION BY label)) THEN 'registered' WHEN hash = kept THEN 'no-op' ELSE 'error' END AS outcome FROM pm JOIN f USING (label)")
def prompt_register(spark, sf):
    """A label keeps its first text: the same hash again changes nothing, another is an error."""
    p = _prompts(spark, sf)
    first = p.groupBy("label").agg(F.min("n").alias("first"), F.min_by("hash", "n").alias("kept"))
    return p.join(first, "label").select("n", "label", F.when(F.col("n") == F.col("first"), "registered").when(F.col("hash") == F.col("kept"), "no-op").otherwise("error").alias("outcome"))


@query(f"WITH {_PROMPTS}, q AS (SELECT n, CASE WHEN n % 2 = 0 THEN label ELSE substr(hash, 1, 12) END AS ref FROM pm), l AS (SELECT label, min(n) AS spec FROM pm GROUP BY 1), h AS (SELECT substr(hash, 1, 12) AS p, min(n) AS spec FROM pm GROUP BY 1) SELECT q.n, ref, coalesce(l.spec, h.spec) AS spec FROM q LEFT JOIN l ON ref = label LEFT JOIN h ON ref = p")
def prompt_resolution(spark, sf):
    """A reference names a label, or else begins the hash of a text, whose first registration it is."""
    p = _prompts(spark, sf)
    prefix = F.substring("hash", 1, 12)
    asked = p.select("n", F.when(F.col("n") % 2 == 0, F.col("label")).otherwise(prefix).alias("ref"))
    labels = p.groupBy(F.col("label").alias("ref")).agg(F.min("n").alias("by_label"))
    hashes = p.groupBy(prefix.alias("ref")).agg(F.min("n").alias("by_hash"))
    return asked.join(labels, "ref", "left").join(hashes, "ref", "left").select("n", "ref", F.coalesce("by_label", "by_hash").alias("spec"))


@query("""WITH t AS (SELECT p_partkey AS n, 'Dear {{client}}, ' || CASE WHEN p_size > 30 THEN '{{fee}} ' ELSE '' END || CASE WHEN p_partkey % 11 = 0 THEN '{oops} ' ELSE '' END || p_name AS body, CASE WHEN p_size % 2 = 0 THEN ['client', 'fee'] ELSE ['client'] END AS declared FROM part),
 u AS (SELECT n, body, declared, list_distinct(regexp_extract_all(body, '\\{\\{([a-z_]+)\\}\\}', 1)) AS used FROM t)
 SELECT n, array_to_string(list_sort(list_filter(used, lambda x: NOT list_contains(declared, x))), ',') AS undeclared, array_to_string(list_sort(list_filter(declared, lambda x: NOT list_contains(used, x))), ',') AS unused, regexp_matches(regexp_replace(body, '\\{\\{[a-z_]+\\}\\}', '', 'g'), '[{}]') AS single_brace, length(body) > 160 AS too_long FROM u""")
def prompt_lint(spark, sf):
    """Placeholders that are undeclared or unused, single braces, and a budget."""
    p = A.table(spark, sf, "part")
    body = F.concat(F.lit("Dear {{client}}, "), F.when(F.col("p_size") > 30, "{{fee}} ").otherwise(""), F.when(F.col("p_partkey") % 11 == 0, "{oops} ").otherwise(""), "p_name")
    t = p.select(F.col("p_partkey").alias("n"), body.alias("body"), F.when(F.col("p_size") % 2 == 0, F.array(F.lit("client"), F.lit("fee"))).otherwise(F.array(F.lit("client"))).alias("declared"))
    t = t.withColumn("used", F.array_distinct(F.regexp_extract_all("body", F.lit(r"\{\{([a-z_]+)\}\}"), F.lit(1))))
    names = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), ",")
    return t.select("n", names("used", "declared").alias("undeclared"), names("declared", "used").alias("unused"), F.regexp_replace("body", r"\{\{[a-z_]+\}\}", "").rlike("[{}]").alias("single_brace"), (F.length("body") > 160).alias("too_long"))


# Incidents by the minute

_INCIDENTS = """ic AS (SELECT s_suppkey AS incident, s_suppkey * 13 % 97 AS "start", s_suppkey * 13 % 97 + 5 + s_suppkey % 13 AS "end", CASE s_suppkey % 3 WHEN 0 THEN 'regressed_prompt' WHEN 1 THEN 'latency_spike' ELSE 'error_burst' END AS kind, 1 + s_suppkey % 3 * 0.5 AS multiplier, s_suppkey % 10 / 20 AS rate FROM supplier)"""


def _incidents(spark, sf):
    k = F.col("s_suppkey")
    kind = F.when(k % 3 == 0, "regressed_prompt").when(k % 3 == 1, "latency_spike").otherwise("error_burst")
    return A.table(spark, sf, "supplier").select(k.alias("incident"), (k * 13 % 97).alias("start"), (k * 13 % 97 + 5 + k % 13).alias("end"), kind.alias("kind"), (1 + k % 3 * 0.5).alias("multiplier"), (k % 10 / 20).alias("rate"))


@query(f'WITH {_INCIDENTS} SELECT minute, count(incident) AS active, round(coalesce(exp(sum(ln(multiplier))), 1), 6) AS latency, coalesce(max(rate), 0) AS rate FROM range(0, 120) m(minute) LEFT JOIN ic ON "start" <= minute AND minute < "end" GROUP BY 1')
def active_faults(spark, sf):
    return R.faults(spark.range(0, 120, 1, 2).select(F.col("id").alias("minute")), _incidents(spark, sf))


@query(f"""{_TR}, {_INCIDENTS}, m AS (SELECT trace_id, bucket, trace_id % 120 AS minute FROM tr) SELECT trace_id, CASE WHEN bool_or(incident IS NOT NULL) THEN 'regressed' WHEN any_value(minute) >= 90 THEN 'v2' WHEN any_value(bucket) < 10 THEN 'canary' ELSE 'active' END AS served
 FROM m LEFT JOIN ic ON kind = 'regressed_prompt' AND "start" <= minute AND minute < "end" GROUP BY 1""")
def version_at(spark, sf):
    """Which prompt served a trace: an incident's, else a release's from its minute on, else the canary's for its sessions, else the active one."""
    minutes = spark.range(0, 120, 1, 2).select(F.col("id").alias("minute"))
    bad = _incidents(spark, sf).where("kind = 'regressed_prompt'")
    hit = minutes.join(R.faults(minutes, bad).where("active > 0"), "minute").select("minute", F.lit(True).alias("hit"))  # as many rows as minutes
    t = A.traces(spark, sf).select("trace_id", "bucket", (F.col("trace_id") % 120).alias("minute")).join(F.broadcast(hit), "minute", "left")
    return t.select("trace_id", F.when(F.col("hit"), "regressed").when(F.col("minute") >= 90, "v2").when(F.col("bucket") < 10, "canary").otherwise("active").alias("served"))


# Clients


@query("""WITH o AS (SELECT o_custkey AS client, o_orderpriority AS holding, sum(o_totalprice) AS amount FROM orders GROUP BY 1, 2), r AS (SELECT *, sum(amount) OVER (PARTITION BY client) AS total, row_number() OVER (PARTITION BY client ORDER BY amount DESC, holding) AS place FROM o)
 SELECT client, round(sum(amount) FILTER (holding IN ('1-URGENT', '2-HIGH')) / any_value(total), 6) AS growth, string_agg(holding, ',' ORDER BY place) FILTER (place <= 3) AS top, round(sum(amount) FILTER (place <= 3) / any_value(total), 6) AS top_share FROM r GROUP BY 1""")
def client_metrics(spark, sf):
    """Growth share and the three largest holdings of each client."""
    o = A.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("client"), F.col("o_orderpriority").alias("holding")).agg(F.sum("o_totalprice").alias("amount"))
    mine = W.partitionBy("client")
    r = o.select("*", F.sum("amount").over(mine).alias("total"), F.row_number().over(mine.orderBy(F.desc("amount"), "holding")).alias("place"))
    growth, top = F.col("holding").isin("1-URGENT", "2-HIGH"), F.col("place") <= 3
    names = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(top, F.struct("place", "holding")))), lambda x: x["holding"]), ",")
    return r.groupBy("client").agg(F.round(F.sum(F.when(growth, F.col("amount"))) / F.first("total"), 6).alias("growth"), names.alias("top"), F.round(F.sum(F.when(top, F.col("amount"))) / F.first("total"), 6).alias("top_share"))


@query("SELECT o_orderkey AS draft, o_custkey AS author FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50")
def latest_drafts(spark, sf):
    """The fifty latest drafts, a feature of the store's list."""
    return A.table(spark, sf, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(50).select(F.col("o_orderkey").alias("draft"), F.col("o_custkey").alias("author"))


@query("SELECT tag, count(*) AS n FROM (SELECT doc_id, unnest([lang, source, CASE WHEN length(text) > 2000 THEN 'long' END]) AS tag FROM documents) WHERE tag IS NOT NULL GROUP BY 1 HAVING count(*) >= 5")
def tag_slices(spark, sf):
    d = A.table(spark, sf, "documents").select(F.explode(F.array_compact(F.array("lang", "source", F.when(F.length("text") > 2000, "long")))).alias("tag"))
    return d.groupBy("tag").agg(F.count("*").alias("n")).where("n >= 5")


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '^[^a-z]*(what|how|when|why)\\b') THEN 'question' WHEN regexp_matches(lower(text), '[0-9]') THEN 'figures' WHEN regexp_matches(text, '\\n') THEN 'list' ELSE 'other' END AS intent FROM conversations")
def template_intent(spark, sf):
    """The first pattern that a turn matches names its intent."""
    low = F.lower("text")
    intent = F.when(T.matches(low, r"^[^a-z]*(what|how|when|why)\b"), "question").when(low.rlike("[0-9]"), "figures").when(F.col("text").rlike(r"\n"), "list").otherwise("other")
    return A.table(spark, sf, "conversations").select("conv_id", "turn", intent.alias("intent"))


@query("SELECT conv_id, max(turn) + 1 AS turns, count(*) FILTER (regexp_matches(text, '(?i)\\b(i (cannot|can''t|am unable to)|unable to (help|assist)|as an ai)\\b')) AS refusals, CAST(sum(length(text)) AS BIGINT) AS chars FROM conversations GROUP BY 1")
def conversation_refusals(spark, sf):
    return A.table(spark, sf, "conversations").groupBy("conv_id").agg((F.max("turn") + 1).alias("turns"), F.count_if(T.matches(F.col("text"), T.REFUSAL)).alias("refusals"), F.sum(F.length("text")).alias("chars"))
