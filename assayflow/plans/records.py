"""Queries on records, feedback, scores, audit entries and identifiers over the driver's tables, each beside its SQL twin."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import identifiers as I
from ..functions import numbers as N
from ..functions import text as T
from ..operators import matching as M
from ..operators import scoring, slo
from ..operators import validators as V
from ..sources import adapters as A
from .catalogue import _BEST
from .registry import query

# Records: an order is a document, its line items are recommendations and replacements.

_RECORDS = """ad AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 97 <> 0 THEN 'Adviser ' || o_custkey END AS adviser_name, CASE WHEN o_orderkey % 89 <> 0 THEN CAST(o_orderdate AS DATE) END AS advice_date, DATE '1996-06-30' AS document_date,
 CASE WHEN o_orderkey % 83 <> 0 THEN o_orderpriority END AS risk_profile, CASE WHEN o_orderkey % 61 <> 0 THEN o_totalprice % 500 - 5 END AS fee_initial, CASE WHEN o_orderkey % 61 <> 0 THEN o_totalprice / 100 - 20 END AS fee_ongoing,
 CASE WHEN o_orderkey % 3 = 0 THEN 'percent' ELSE 'flat' END AS fee_basis, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0 THEN 1.0 WHEN o_orderkey % 7 = 0 THEN 0.5 END AS fee_percent,
 CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice * 0.6 END AS available_funds FROM orders), rc AS (SELECT l_orderkey AS doc_id, l_linenumber AS idx, CASE l_returnflag WHEN 'A' THEN 'establish' WHEN 'N' THEN 'contribute' ELSE 'retain' END AS action,
 CASE WHEN l_partkey % 5 = 0 THEN 'insurance' ELSE 'fund' END AS product_type, CASE WHEN l_partkey % 50 = 0 THEN -l_extendedprice ELSE l_extendedprice END AS amount FROM lineitem),
 dt AS (SELECT ad.*, coalesce(n_recs, 0) AS n_recs, coalesce(invested, 0) AS invested, coalesce(new_money, 0) AS new_money FROM ad LEFT JOIN (SELECT doc_id, count(*) AS n_recs, sum(amount) FILTER (product_type <> 'insurance') AS invested,
 sum(amount) FILTER (product_type <> 'insurance' AND action <> 'retain') AS new_money FROM rc GROUP BY 1) USING (doc_id))"""
_CHECKS = {
    "required": [("adviser_name IS NULL", "missing_field", "error", "adviser_name"), ("advice_date IS NULL", "missing_field", "error", "advice_date"), ("risk_profile IS NULL", "missing_field", "error", "risk_profile"), ("n_recs = 0", "missing_field", "error", "recommendations"), ("fee_initial IS NULL AND fee_ongoing IS NULL", "missing_field", "error", "fees")],
    "fees": [("fee_initial < 0", "fee_negative", "error", "fees.initial_advice_fee"), ("fee_ongoing < 0", "fee_negative", "error", "fees.ongoing_advice_fee_pa"), ("fee_basis = 'percent' AND fee_percent IS NULL", "fee_basis_inconsistent", "error", "fees.ongoing_fee_percent"),
             ("fee_basis = 'percent' AND invested > 0 AND abs(fee_percent / 100 * invested - fee_ongoing) > greatest(1, fee_percent / 100 * invested * 0.02)", "fee_arithmetic", "error", "fees.ongoing_advice_fee_pa"), ("fee_basis <> 'percent' AND fee_percent IS NOT NULL", "fee_basis_inconsistent", "warning", "fees.ongoing_fee_percent")],
    "funds": [("new_money > available_funds", "amount_exceeds_available_funds", "error", "recommendations")],
    "dates": [("abs(date_diff('day', document_date, advice_date)) > 730", "date_implausible", "error", "advice_date")],
}


def _checks_sql(*groups: str) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, '{code}' AS code, '{severity}' AS severity, '{field}' AS field FROM dt WHERE {when}" for g in groups for when, code, severity, field in _CHECKS[g])


_NEGATIVE = "SELECT doc_id, 'amount_negative' AS code, 'error' AS severity, 'recommendations[' || idx || '].amount' AS field FROM rc WHERE amount < 0"


def _recs(spark, sf):
    action = F.when(F.col("l_returnflag") == "A", "establish").when(F.col("l_returnflag") == "N", "contribute").otherwise("retain")
    return A.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("idx"), action.alias("action"), F.when(F.col("l_partkey") % 5 == 0, "insurance").otherwise("fund").alias("product_type"),
        F.when(F.col("l_partkey") % 50 == 0, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).alias("amount"), "l_partkey")


def _records(spark, sf):
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    docs = A.table(spark, sf, "orders").select(
        k.alias("doc_id"), F.array(F.lit("client")).alias("client_names"), F.when(k % 97 != 0, F.concat(F.lit("Adviser "), "o_custkey")).alias("adviser_name"), F.when(k % 89 != 0, F.to_date("o_orderdate")).alias("advice_date"),
        F.lit("1996-06-30").cast("date").alias("document_date"), F.when(k % 83 != 0, F.col("o_orderpriority")).alias("risk_profile"), F.when(k % 61 != 0, price % 500 - 5).alias("fee_initial"), F.when(k % 61 != 0, price / 100 - 20).alias("fee_ongoing"),
        F.when(k % 3 == 0, "percent").otherwise("flat").alias("fee_basis"), F.when((k % 3 == 0) & (k % 5 != 0), 1.0).when(k % 7 == 0, 0.5).alias("fee_percent"), F.when(k % 4 == 0, price * 0.6).alias("available_funds"))
    return V.with_totals(docs, _recs(spark, sf))


@query(f"WITH {_RECORDS} {_checks_sql('required')}")
def validate_required(spark, sf):
    return V.required(_records(spark, sf))


@query(f"WITH {_RECORDS} {_checks_sql('fees')}")
def validate_fees(spark, sf):
    return V.fees(_records(spark, sf))


@query(f"WITH {_RECORDS} {_checks_sql('funds')} UNION ALL {_NEGATIVE}")
def validate_amounts(spark, sf):
    return V.funds(_records(spark, sf)).unionByName(V.amounts(_recs(spark, sf)))


@query(f"WITH {_RECORDS} {_checks_sql('dates')}")
def validate_dates(spark, sf):
    return V.dates(_records(spark, sf))


@query(f"WITH {_RECORDS}, v AS ({_checks_sql(*_CHECKS)} UNION ALL {_NEGATIVE}) SELECT CASE regexp_extract(field, '^[^.\\[]*') WHEN 'risk_profile' THEN 'risk' WHEN 'recommendations' THEN 'recommendations' WHEN 'fees' THEN 'fees' ELSE 'header' END AS section, severity, count(*) AS n, count(DISTINCT doc_id) AS documents FROM v GROUP BY 1, 2")
def violations_by_section(spark, sf):
    d = _records(spark, sf)
    v = V.required(d).unionByName(V.fees(d)).unionByName(V.funds(d)).unionByName(V.dates(d)).unionByName(V.amounts(_recs(spark, sf)))
    return v.groupBy(V.section(F.col("field")).alias("section"), "severity").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"))


@query()
def validate_products(spark, sf):
    """Part types as the product master; every thirteenth name has letters doubled, every 29th is another's."""
    kind = F.when(F.length("p_type") % 5 == 0, "insurance").otherwise("fund")
    part = A.table(spark, sf, "part").select("p_partkey", "p_type")
    master = part.select(F.col("p_type").alias("name"), kind.alias("product_type")).distinct()
    named = F.when(F.col("p_partkey") % 29 == 0, F.reverse("p_type")).when(F.col("p_partkey") % 13 == 0, F.concat("p_type", F.lit("s"))).otherwise(F.col("p_type"))
    recs = _recs(spark, sf).join(part.select("p_partkey", named.alias("product_name")), F.col("l_partkey") == F.col("p_partkey"))
    return V.products(recs.select("doc_id", "idx", "product_name", "product_type"), master)


_REPS = "rp AS (SELECT l_orderkey AS doc_id, l_linenumber AS idx, CASE WHEN l_suppkey % 10 = 0 THEN ' ' ELSE 'x' END AS a, CASE WHEN l_partkey % 10 <> 0 THEN 'y' END AS b, CASE WHEN l_quantity > 5 THEN 'cheaper' ELSE '' END AS reason FROM lineitem WHERE l_returnflag = 'R')"


@query(f"WITH {_REPS} SELECT doc_id, 'replacement_incomplete' AS code, 'error' AS severity, 'replacements[' || idx || ']' AS field FROM rp WHERE trim(a) = '' OR coalesce(trim(b), '') = '' UNION ALL SELECT doc_id, 'replacement_reason_missing', 'warning', 'replacements[' || idx || '].reason' FROM rp WHERE trim(reason) = ''")
def validate_replacements(spark, sf):
    c = F.col
    reps = A.table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(c("l_orderkey").alias("doc_id"), c("l_linenumber").alias("idx"), F.when(c("l_suppkey") % 10 == 0, " ").otherwise("x").alias("from_product"), F.when(c("l_partkey") % 10 != 0, "y").alias("to_product"), F.when(c("l_quantity") > 5, "cheaper").otherwise("").alias("reason"))
    return V.replacements(reps)


@query()
def validate_identifiers(spark, sf):
    """Number-shaped passages of documents; SQL has no look-behind, so this is held against the row-wise dialect in tests."""
    body = F.concat_ws(" ", "text", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("ABN 51 824 753 55"), (F.col("doc_id") % 10).cast("string"))), F.when(F.col("doc_id") % 7 == 0, F.lit("TFN 123 456 782")))
    return V.identifiers_in(A.table(spark, sf, "documents").select("doc_id", body.alias("text")))


# Identifiers and pseudonyms


def _kinds(spark, sf, dialect):
    d = A.table(spark, sf, "documents").select("doc_id", I.spans(F.col("text"), dialect).alias("s"))
    return d.select("doc_id", F.explode("s").alias("s")).groupBy("doc_id", F.col("s.kind").alias("kind")).agg(F.count("*").alias("n"))


@query()
def identifiers_chat(spark, sf):
    return _kinds(spark, sf, "chat")


@query()
def identifiers_meeting(spark, sf):
    return _kinds(spark, sf, "meeting")


@query()
def redacted_documents(spark, sf):
    d = A.table(spark, sf, "documents").select("doc_id", "text", I.spans(F.col("text"), "meeting").alias("s"))
    return d.where(F.size("s") > 0).select("doc_id", I.redacted(F.col("text"), F.col("s")).alias("text"))


@query("SELECT conv_id AS meeting_id, turn, CASE role WHEN 'user' THEN 'CLIENT_1' ELSE 'ADVISER' END || ': ' || text AS text, true AS restored FROM conversations")
def pseudonymised_segments(spark, sf):
    """Names put before each turn, replaced by aliases, and back; two clients and one adviser attend each meeting."""
    c = A.table(spark, sf, "conversations").select(F.col("conv_id").alias("meeting_id"), "turn", "role", "text")
    people = [(0, "Xylia Quorvane", "client"), (1, "Brumhild Ostrakov", "client"), (2, "Ytterby Fjordsen", "adviser")]
    seats = spark.createDataFrame(people, "pos int, name string, role string")
    attend = c.select("meeting_id").distinct().select("meeting_id", F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(p, seats.columns, strict=True)]) for p in people])).alias("p")).select("meeting_id", "p.*")
    said = c.withColumn("named", F.concat(F.when(F.col("role") == "user", "Xylia").otherwise("Ytterby Fjordsen"), F.lit(": "), "text"))
    out = said.join(I.pseudonyms(attend), "meeting_id").withColumn("hidden", I.renamed("named", "names"))
    full = F.concat(F.when(F.col("role") == "user", "Xylia Quorvane").otherwise("Ytterby Fjordsen"), F.lit(": "), "text")
    return out.select("meeting_id", "turn", F.col("hidden").alias("text"), (I.renamed("hidden", "aliases") == full).alias("restored"))


# Scores, feedback, gauges, audit

_SCORE = "x AS (SELECT trace_id, [ (1.0, true), (3.0, CASE WHEN k % 6 <> 0 THEN NOT coalesce(refusal, false) END), (2.0, NOT coalesce(pii_leak, false)), (3.0, coalesce(grounded, true)), (2.0, json_valid), (0.5, latency_ms < 3000), (0.5, CASE WHEN NOT json_expected THEN k % 8 <> 0 END) ] AS c FROM tr WHERE status = 'ok')"


@query(f"WITH {A.TRACES}, {_SCORE} SELECT trace_id, round(list_sum([CASE WHEN v[2] THEN v[1] ELSE 0 END for v in c]) / list_sum([CASE WHEN v[2] IS NOT NULL THEN v[1] ELSE 0 END for v in c]), 6) AS quality, NOT list_contains([v[2] for v in c[1:5]], false) AS passed FROM x".replace("v[1]", "struct_extract(v, 1)").replace("v[2]", "struct_extract(v, 2)"))
def answer_scores(spark, sf):
    c, no = F.col, lambda name: ~F.coalesce(F.col(name), F.lit(False))
    checks = {"non_empty": F.lit(True), "no_refusal": F.when(c("k") % 6 != 0, no("refusal")), "no_pii": no("pii_leak"), "grounded": F.coalesce("grounded", F.lit(True)), "json_valid": c("json_valid"), "length_ok": c("latency_ms") < 3000, "tone_ok": F.when(~c("json_expected"), c("k") % 8 != 0)}
    quality, passed = scoring.answer_score(checks)
    return A.traces(spark, sf).where("status = 'ok'").select("trace_id", F.round(quality, 6).alias("quality"), passed.alias("passed"))


@query(f"WITH {A.TRACES}, x AS (SELECT trace_id, list_filter([CASE WHEN negative_feedback THEN 'thumbs_down' END, CASE WHEN k % 11 = 0 THEN 'regenerated' END, CASE WHEN k % 100 >= 30 THEN printf('edited(0.%02d)', k % 100) END, CASE WHEN NOT negative_feedback AND k % 9 = 0 THEN 'wrong_part=cost' END], lambda r: r IS NOT NULL) AS r FROM tr) SELECT trace_id, array_to_string(r, ';') AS reasons, len(r) > 0 AS negative FROM x")
def feedback_negativity(spark, sf):
    c = F.col
    reasons = scoring.feedback_reasons(F.when(c("negative_feedback"), "down"), c("k") % 11 == 0, c("k") % 100 / 100, F.when(c("k") % 9 == 0, "cost"))
    return A.traces(spark, sf).select("trace_id", reasons.alias("r")).select("trace_id", F.array_join("r", ";").alias("reasons"), (F.size("r") > 0).alias("negative"))


@query(f"WITH {A.TRACES} SELECT version, le, count(*) FILTER (latency_ms / 1000 <= CAST(le AS DOUBLE)) AS n FROM tr, (VALUES {', '.join(f'({b!r})' for b in [*map(str, scoring.BUCKETS), '+Inf'])}) b(le) GROUP BY 1, 2".replace("CAST(le AS DOUBLE)", "CAST(replace(le, '+Inf', 'inf') AS DOUBLE)"))
def latency_histogram(spark, sf):
    return scoring.histogram(A.traces(spark, sf), F.col("latency_ms") / 1000, "version")


@query(f"WITH {_BEST}, m AS (SELECT max(tick) AS t FROM be), kn AS (SELECT s.slo, r.rule FROM (VALUES {', '.join(f'({n!r})' for n in slo.BUDGETS)}) s(slo), (VALUES {', '.join(f'({r[0]!r})' for r in slo.RULES)}) r(rule)) SELECT slo, rule, CASE WHEN EXISTS (SELECT 1 FROM be, m WHERE be.tick = m.t AND be.slo = kn.slo AND be.rule = kn.rule) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS active FROM kn")
def alert_gauges(spark, sf):
    best = slo.best_alerts(slo.burn_alerts(slo.panes(slo.long_form(A.traces(spark, sf)))))
    known = spark.createDataFrame([(n, r[0]) for n in slo.BUDGETS for r in slo.RULES], "slo string, rule string")
    last = best.agg(F.max("tick").alias("last"))  # one row
    return scoring.alert_gauges(best.join(F.broadcast(last)), known, F.col("last"))


@query("SELECT conv_id AS draft_id, turn AS n, role AS actor, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+', '[EMAIL]', 'g') AS entry FROM conversations")
def audit_entries(spark, sf):
    """Append-only entries: every string but the actor's is redacted."""
    c = A.table(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("draft_id"), F.col("turn").alias("n"), F.col("role").alias("actor"), T.redact_email(F.col("text")).alias("entry"))


@query(f"WITH {A.TRACES}, s AS (SELECT session_id AS draft_id, max_by(judge, trace_id) FILTER (judge IS NOT NULL) AS judge, bool_or(negative_feedback) AS negative FROM tr GROUP BY 1) SELECT * FROM s")
def sticky_signals(spark, sf):
    """Per session the last judge score that is not null, and whether any feedback was negative."""
    t = A.traces(spark, sf).groupBy(F.col("session_id").alias("draft_id"))
    return t.agg(F.max_by(F.col("judge"), F.when(F.col("judge").isNotNull(), F.col("trace_id"))).alias("judge"), F.bool_or("negative_feedback").alias("negative"))


@query(f"WITH {A.TRACES} SELECT trace_id FROM tr a WHERE NOT EXISTS (SELECT 1 FROM tr b WHERE b.session_id = a.session_id AND b.judge = 5)")
def unjudged_traces(spark, sf):
    t = A.traces(spark, sf)
    return t.select("trace_id", "session_id").join(t.where("judge = 5").select("session_id").distinct(), "session_id", "left_anti").select("trace_id")


@query(f"WITH {A.PREDICTIONS} SELECT doc_id, CASE WHEN greatest(p, 1 - p) < 0.6 THEN 'unknown' WHEN p >= 0.5 THEN 'good' ELSE 'bad' END AS label FROM pr")
def final_labels(spark, sf):
    p = F.col("p")
    return A.predictions(spark, sf).select("doc_id", F.when(F.greatest(p, 1 - p) < 0.6, "unknown").when(p >= 0.5, "good").otherwise("bad").alias("label"))


@query("SELECT conv_id, turn // 4 AS section, count(*) AS n, string_agg(printf('s%03d', turn + 1), ',' ORDER BY turn) AS segments FROM conversations GROUP BY 1, 2")
def section_windows(spark, sf):
    s = A.table(spark, sf, "conversations").groupBy("conv_id", F.floor(F.col("turn") / 4).alias("section")).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("turn")).alias("t"))
    return s.select("conv_id", "section", "n", F.array_join(F.transform("t", lambda v: F.format_string("s%03d", v + 1)), ",").alias("segments"))


@query("SELECT conv_id, turn, substr(sha1(conv_id || ':' || turn), 1, 16) AS span_id, substr(sha256(role || chr(0) || text), 1, 16) AS message_hash, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS version FROM conversations")
def span_and_message_hashes(spark, sf):
    c = A.table(spark, sf, "conversations")
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return c.select("conv_id", "turn", F.substring(F.sha1(key), 1, 16).alias("span_id"), F.substring(F.sha2(F.concat("role", F.lit("\0"), "text"), 256), 1, 16).alias("message_hash"), F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).cast("long").alias("version"))


@query()
def head_sampled(spark, sf):
    """A tenth of the traces by checksum, and every error; DuckDB has no CRC-32, so tests hold it against zlib."""
    t = A.traces(spark, sf)
    return t.where((F.crc32(F.col("trace_id").cast("string")) % 10000 < 1000) | (F.col("status") == "error")).select("trace_id", "status")


# Numbers, names and matching


@query("SELECT c_custkey, array_to_string(list_filter([regexp_replace(x, '^[ .]+|[ .]+$', '', 'g') for x in string_split_regex(c_name || ' and B. Other (c/o X); ' || c_mktsegment, '\\s+and\\s+|\\s*;\\s*|\\s*&\\s*|,\\s+')], lambda n: n <> ''), '|') AS names FROM customer".replace("c_name || ' and B. Other (c/o X); ' || c_mktsegment", "regexp_replace(c_name || ' and B. Other (c/o X); ' || c_custkey, '\\([^)]*\\)', '', 'g')"))
def split_names(spark, sf):
    listed = F.concat("c_name", F.lit(" and B. Other (c/o X); "), F.col("c_custkey").cast("string"))
    return A.table(spark, sf, "customer").select("c_custkey", F.array_join(N.names(listed), "|").alias("names"))


@query("SELECT o_orderkey, o_orderdate::DATE AS first_date, CAST(round(o_totalprice, 2) AS DECIMAL(20,4)) AS amount FROM orders")
def dates_and_money(spark, sf):
    """Each order's date and price written into a sentence and found again."""
    o = A.table(spark, sf, "orders")
    day = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "d MMMM yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "d/M/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    said = F.concat(F.lit("On "), day, F.lit(" the fee was AUD "), F.format_number("o_totalprice", 2), F.lit(" (not 31/2/2020)."))
    return o.select("o_orderkey", said.alias("s")).select("o_orderkey", N.dates(F.col("s"))[0].alias("first_date"), N.money(F.col("s"))[0].alias("amount"))


@query()
def numeric_grounding(spark, sf):
    """Numbers and dates of each turn that the turn before does not hold."""
    before = F.lag("text").over(W.partitionBy("conv_id").orderBy("turn"))
    c = A.table(spark, sf, "conversations").select("conv_id", "turn", "text", before.alias("before")).where("before IS NOT NULL")
    values = N.number_forms(F.transform(N.numbers(F.col("before")), lambda n: n["value"]))
    return c.select("conv_id", "turn", F.size(N.numbers(F.col("text"))).alias("n"), F.array_join(N.ungrounded(F.col("text"), values, F.col("before")), ";").alias("ungrounded"))


@query()
def hashed_embedding(spark, sf):
    return N.embedded(A.table(spark, sf, "benchmark"), "item_id", "text")


@query("WITH x AS (SELECT l_orderkey AS doc_id, count(*) AS n_gold, count(*) FILTER (l_linenumber <> 3) AS n_pred, count(*) FILTER (l_linenumber <> 3 AND l_quantity > 10) AS correct FROM lineitem GROUP BY 1), y AS (SELECT *, CASE WHEN n_pred > 0 THEN correct / n_pred WHEN n_gold = 0 THEN 1 ELSE 0 END AS p, CASE WHEN n_gold > 0 THEN correct / n_gold WHEN n_pred = 0 THEN 1 ELSE 0 END AS r FROM x) SELECT doc_id, n_pred, n_gold, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1 FROM y")
def list_scores(spark, sf):
    c = F.col
    x = A.table(spark, sf, "lineitem").groupBy(c("l_orderkey").alias("doc_id")).agg(F.count("*").alias("n_gold"), F.count_if(c("l_linenumber") != 3).alias("n_pred"), F.count_if((c("l_linenumber") != 3) & (c("l_quantity") > 10)).alias("correct"))
    return x.select("doc_id", "n_pred", "n_gold", *[F.round(v, 6).alias(n) for v, n in zip(M.list_scores(c("n_pred"), c("n_gold"), c("correct")), ("precision", "recall", "f1"), strict=True)])


@query("SELECT l_orderkey AS doc_id, count(*) AS matched, count(*) FILTER (l_linenumber <> 2) AS correct FROM lineitem GROUP BY 1")
def recommendation_matching(spark, sf):
    """Each order's line items against themselves in reverse order, the second with another amount."""
    c, order = F.col, "l_orderkey"
    item = lambda amount: F.struct("l_linenumber", F.md5(F.concat_ws("-", *[c(n).cast("string") for n in ("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")])).alias("product"), c("l_returnflag").alias("action"), amount.alias("amount"))
    x = A.table(spark, sf, "lineitem").groupBy(c(order).alias("doc_id")).agg(F.sort_array(F.collect_list(item(c("l_extendedprice")))).alias("gold"), F.sort_array(F.collect_list(item(F.when(c("l_linenumber") == 2, 0.0).otherwise(c("l_extendedprice")))), asc=False).alias("pred"))
    m = x.select("doc_id", M.match_recommendations("pred", "gold").alias("m"))
    return m.select("doc_id", F.col("m.matched").cast("long").alias("matched"), F.col("m.correct").cast("long").alias("correct"))


@query("SELECT l_orderkey AS doc_id, count(*) AS matched, count(*) FILTER (l_linenumber NOT IN (2, 3)) AS correct FROM lineitem GROUP BY 1")
def replacement_matching(spark, sf):
    """Each order's line items as replacements against themselves in reverse order, the second with another fee, the third with another impact."""
    c = F.col
    name = lambda *of: F.md5(F.concat_ws("-", *[c(n).cast("string") for n in ("l_orderkey", "l_linenumber", "l_extendedprice", *of)]))
    item = lambda fee, impact: F.struct("l_linenumber", name("l_partkey").alias("old"), name("l_suppkey").alias("new"), fee.alias("fee"), impact.alias("impact"))
    fee, impact = c("l_extendedprice").cast("double"), c("l_returnflag")
    changed = item(F.when(c("l_linenumber") == 2, 0.0).otherwise(fee), F.when(c("l_linenumber") == 3, "none").otherwise(impact))
    x = A.table(spark, sf, "lineitem").groupBy(c("l_orderkey").alias("doc_id")).agg(F.sort_array(F.collect_list(item(fee, impact))).alias("gold"), F.sort_array(F.collect_list(changed), asc=False).alias("pred"))
    m = x.select("doc_id", M.match_replacements("pred", "gold").alias("m"))
    return m.select("doc_id", F.col("m.matched").cast("long").alias("matched"), F.col("m.correct").cast("long").alias("correct"))


@query()
def claim_matching(spark, sf):
    """Assistant turns of a conversation against all its turns, one to one."""
    item = lambda when: F.sort_array(F.collect_list(F.when(when, F.struct("turn", "text", F.lit(None).cast("string").alias("owner"), F.transform(N.numbers(F.col("text")), lambda n: n["token"]).alias("facts")))))
    c = A.table(spark, sf, "conversations").groupBy("conv_id").agg(item(F.col("role") == "assistant").alias("pred"), item(F.lit(True)).alias("gold"))
    return c.select("conv_id", F.explode(M.match_claims(F.col("pred"), F.col("gold"))).alias("m")).select("conv_id", "m.i", "m.j", "m.score")


@query()
def error_intervals(spark, sf):
    """The exact interval of each version's error rate."""
    t = A.traces(spark, sf).groupBy("version").agg(F.count_if(F.col("status") == "error").alias("errors"), F.count("*").alias("n"))
    return t.withColumn("x", M.binomial_interval("errors", "n")).select("version", "errors", "n", "x.low", "x.high")


@query("SELECT source, lang, count(*) AS n, round(avg(CAST(n_chars = length(text) AS INTEGER)), 6) AS chars_right, round(avg(CAST(lang = 'en' AS INTEGER)), 6) AS lang_right FROM documents GROUP BY ROLLUP (source, lang)")
def metadata_accuracy(spark, sf):
    right = lambda x, name: F.round(F.avg(x.cast("int")), 6).alias(name)
    return A.table(spark, sf, "documents").rollup("source", "lang").agg(F.count("*").alias("n"), right(F.col("n_chars") == F.length("text"), "chars_right"), right(F.col("lang") == "en", "lang_right"))


@query(f"WITH {A.PREDICTIONS} SELECT doc_id % 50 AS document, round(min(p), 9) AS min_p, bool_or(y = 0) AS wrong, count(*) AS fields FROM pr GROUP BY 1")
def document_rollup(spark, sf):
    return A.predictions(spark, sf).groupBy((F.col("doc_id") % 50).alias("document")).agg(F.round(F.min("p"), 9).alias("min_p"), F.bool_or(F.col("y") == 0).alias("wrong"), F.count("*").alias("fields"))
