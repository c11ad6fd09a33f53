"""Queries on notes, claims, extraction and review, each beside its SQL twin where SQL can express it."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import diff, jsonfix, spoken
from ..functions import text as T
from ..operators import notes as N
from ..sources import adapters as A
from .registry import ORACLE_SQL, query

# Turns as segments: users are clients, assistants advisers, systems paraplanners.

_ROLE = "CASE role WHEN 'user' THEN 'client' WHEN 'assistant' THEN 'adviser' ELSE 'paraplanner' END"
_SAID = f"sg AS (SELECT conv_id AS meeting_id, printf('s%03d', turn + 1) AS seg_id, turn AS pos, {_ROLE} AS role, text FROM conversations)"


def _segments(spark, sf):
    role = F.when(F.col("role") == "user", "client").when(F.col("role") == "assistant", "adviser").otherwise("paraplanner")
    c = A.table(spark, sf, "conversations")
    return c.select(F.col("conv_id").alias("meeting_id"), F.format_string("s%03d", F.col("turn") + 1).alias("seg_id"), F.col("turn").alias("pos"), role.alias("role"), "text")


def _claims(spark, sf):
    """Claims that quote the turn before, in five sections by turn; every seventh cites what is not there, every sixth changes a figure or a date."""
    s = _segments(spark, sf)
    w = W.partitionBy("meeting_id").orderBy("pos")
    made = s.select("meeting_id", "pos", F.lag("seg_id").over(w).alias("cited"), F.lag("text").over(w).alias("said")).where("cited IS NOT NULL")
    n = F.col("meeting_id") + F.col("pos")
    section = F.element_at(F.array(*[F.lit(x) for x in ("goals", "decisions", "action_items", "follow_up", "circumstance_changes")]), (n % 5 + 1).cast("int"))
    text = F.concat(F.substring_index("said", ".", 1), F.when(n % 6 == 0, " of 85 thousand").when(n % 6 == 1, " by 3 March 2025").otherwise(""))
    owner = F.when(n % 3 == 0, "adviser").when(n % 3 == 1, "client").otherwise("paraplanner")
    return made.select("meeting_id", section.alias("section"), F.col("pos").alias("idx"), text.alias("text"), F.when(n % 5 == 2, owner).alias("owner"), F.lit(None).cast("date").alias("due"), F.array(F.when(n % 7 == 0, F.lit("s999")).otherwise(F.col("cited"))).alias("evidence"), (n % 4 == 0).alias("edited"), (n % 8 == 0).alias("unsupported"))


@query()
def claim_verdicts_full(spark, sf):
    """Figures and dates are spoken forms, which SQL cannot read; tests hold the verdicts against plain Python."""
    return N.verdicts(_claims(spark, sf), _segments(spark, sf)).select("meeting_id", "section", "idx", "status", "score", F.array_join("reasons", ",").alias("reasons"))


@query()
def verification_report(spark, sf):
    s = _segments(spark, sf)
    return N.report(N.verdicts(_claims(spark, sf), s), s)


@query()
def verdicts_applied(spark, sf):
    """Per meeting the claims that stay unsupported, those a person edited left alone, and whether approval is refused."""
    c = _claims(spark, sf)
    a = N.applied(c, N.verdicts(c, _segments(spark, sf)))
    g = a.groupBy("meeting_id").agg(F.count("*").alias("claims"), F.count_if(F.col("unsupported") & ~F.col("edited")).alias("open"), F.count_if(F.col("unsupported") & F.col("edited")).alias("edited"))
    return g.select("*", (F.col("open") > 0).alias("refused"))


def _matches(patterns):
    return f"regexp_matches(text, '{N.any_of(patterns).replace(chr(39), chr(39) * 2)}')"


@query(f"WITH {_SAID} SELECT meeting_id, pos, {_matches(N.COMMITMENT)} AS commits, {_matches(N.DEFERRAL)} AS defers FROM sg")
def decision_language(spark, sf):
    t = F.col("text")
    return _segments(spark, sf).select("meeting_id", "pos", T.matches(t, N.any_of(N.COMMITMENT)).alias("commits"), T.matches(t, N.any_of(N.DEFERRAL)).alias("defers"))


_LOW = lambda p: f"regexp_matches(lower(text), '{p.replace(chr(39), chr(39) * 2)}')"


@query(f"""WITH {_SAID}, o AS (SELECT meeting_id, CASE role WHEN 'paraplanner' THEN CASE WHEN {_LOW(N.PARAPLANNER_WILL)} THEN 'paraplanner' END WHEN 'adviser' THEN CASE WHEN {_LOW(N.ADVISER_ASKS)} THEN 'client' WHEN {_LOW(N.PARAPLANNER_NAMED)} THEN 'paraplanner' WHEN {_LOW(N.ADVISER_WILL)} THEN 'adviser' END
 ELSE CASE WHEN {_LOW(N.CLIENT_WILL)} THEN 'client' END END AS owner FROM sg) SELECT meeting_id, owner, count(*) AS n FROM o WHERE owner IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT meeting_id, 'nobody', count(*) FILTER (owner IS NULL) FROM o GROUP BY 1""")
def implied_owners(spark, sf):
    o = _segments(spark, sf).select("meeting_id", N.implied_owner(F.col("role"), F.col("text")).alias("owner"))
    return o.where("owner IS NOT NULL").groupBy("meeting_id", "owner").agg(F.count("*").alias("n")).unionByName(o.groupBy("meeting_id").agg(F.lit("nobody").alias("owner"), F.count_if(F.col("owner").isNull()).alias("n")))


@query(f"WITH {_SAID} SELECT meeting_id, pos, len(w) AS words, array_to_string(list_sort(w), ' ') AS stems, len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in N.ADVICE)}))) AS terms FROM (SELECT meeting_id, pos, {N.content_sql('text')} AS w FROM sg)")
def content_terms(spark, sf):
    """Stems with content, and how many of them are terms of advice; a claim and evidence without any are off topic."""
    w = _segments(spark, sf).select("meeting_id", "pos", N.content_words("text").alias("w"))
    return w.select("meeting_id", "pos", F.size("w").cast("long").alias("words"), F.array_join(F.array_sort("w"), " ").alias("stems"), F.size(F.filter("w", lambda x: x.isin(N.ADVICE))).cast("long").alias("terms"))


@query()
def spoken_numbers(spark, sf):
    """Figures and dates of every document; the parser is tested on spoken and written forms."""
    d = A.table(spark, sf, "documents").select("doc_id", spoken.numbers_in("text").alias("n"), spoken.dates_in("text").alias("d"))
    return d.select("doc_id", F.size("n").alias("numbers"), F.size("d").alias("dates"))


@query()
def json_repairs(spark, sf):
    """Answers that hold an object among other text, cut off in every third: what either dialect makes of them."""
    k = F.col("event_id")
    whole = F.concat(F.lit('{"id": '), k.cast("string"), F.lit(', "props": '), "props", F.lit(', "tags": ["a", "b"],}'))
    answer = F.when(k % 3 == 0, F.substring(whole, 1, 30)).when(k % 3 == 1, F.concat(F.lit("Sure:\n```json\n"), whole, F.lit("\n```"))).otherwise("props")
    e = A.table(spark, sf, "events").select(k.alias("event_id"), answer.alias("a"))
    return e.select("event_id", jsonfix.repaired_as(F.col("a"), "document").alias("d"), jsonfix.repaired_as(F.col("a"), "note").alias("n")).select("event_id", F.col("d.object").alias("document"), F.col("n.object").alias("note"), F.col("d.repaired").alias("repaired"))


@query()
def lenient_notes(spark, sf):
    """Claims of notes read leniently: missing parts take their defaults."""
    c = A.table(spark, sf, "conversations").select("conv_id", "turn", F.to_json(F.struct(F.array("text").alias("goals"), F.array(F.struct(F.col("text").alias("text"), F.col("role").alias("owner"))).alias("action_items"))).alias("j"))
    return c.select("conv_id", "turn", F.inline(jsonfix.shaped_claims(F.col("j")))).select("conv_id", "turn", "section", "idx", F.array_join("evidence", ",").alias("evidence"), "owner", "due")


@query(f"WITH v AS ({ORACLE_SQL['claim_verdicts']}) SELECT meeting_id, count(*) AS claims, count(*) FILTER (verdict = 'supported') AS supported, round(count(*) FILTER (verdict = 'supported') / count(*), 6) AS share, count(*) FILTER (verdict = 'unsupported') > 0 AS blocked FROM v GROUP BY 1")
def claim_blocks(spark, sf):
    """Approval is refused while a claim is unsupported."""
    from .registry import QUERIES

    v = QUERIES["claim_verdicts"](spark, sf)
    of = lambda s: F.count_if(F.col("verdict") == s)
    return v.groupBy("meeting_id").agg(F.count("*").alias("claims"), of("supported").alias("supported"), F.round(of("supported") / F.count("*"), 6).alias("share"), (of("unsupported") > 0).alias("blocked"))


@query("SELECT conv_id, section, row_number() OVER (PARTITION BY conv_id, section ORDER BY turn) - 1 AS idx, turn FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'goals' WHEN 1 THEN 'decisions' ELSE 'action_items' END AS section FROM conversations)")
def claim_unpivot(spark, sf):
    """A note as one list per section, turned into rows of section and place."""
    part = lambda r: F.array_sort(F.collect_list(F.when(F.col("turn") % 3 == r, F.col("turn"))))
    note = A.table(spark, sf, "conversations").groupBy("conv_id").agg(part(0).alias("goals"), part(1).alias("decisions"), part(2).alias("action_items"))
    rows = [note.select("conv_id", F.lit(s).alias("section"), F.posexplode(s).alias("idx", "turn")) for s in ("goals", "decisions", "action_items")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


_TOK = T.tokens_sql("text")


@query(f"""WITH {A.CLAIMS}, s AS (SELECT meeting_id, seg_id, pos, unnest(list_distinct({_TOK})) AS w FROM sg), c AS (SELECT meeting_id, idx, unnest(list_distinct({_TOK})) AS w FROM cl),
 n AS (SELECT c.meeting_id, idx, seg_id, pos, count(*) AS shared FROM c JOIN s USING (meeting_id, w) GROUP BY ALL) SELECT meeting_id, idx, seg_id, shared FROM (SELECT *, row_number() OVER (PARTITION BY meeting_id, idx ORDER BY shared DESC, pos) AS place FROM n) WHERE place <= 5""")
def repair_candidates(spark, sf):
    """For each claim to repair the five segments of its meeting that share most words with it, earlier ones first."""
    words = lambda d, *keys: d.select(*keys, F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("w"))
    c = words(A.claims(spark, sf), "meeting_id", "idx")
    n = c.join(words(A.segments(spark, sf), "meeting_id", "seg_id", "pos"), ["meeting_id", "w"]).groupBy("meeting_id", "idx", "seg_id", "pos").agg(F.count("*").alias("shared"))
    place = F.row_number().over(W.partitionBy("meeting_id", "idx").orderBy(F.desc("shared"), "pos"))
    return n.withColumn("place", place).where("place <= 5").select("meeting_id", "idx", "seg_id", "shared")


@query("""WITH f AS (SELECT conv_id % 5 AS category, lower(trim(role)) AS fact, min(conv_id * 1000 + turn) AS first, count(*) AS merged, arg_min(CASE WHEN turn % 3 = 0 THEN 'owner' || turn END, conv_id * 1000 + turn) FILTER (turn % 3 = 0) AS owner, count(DISTINCT turn) AS evidence FROM conversations GROUP BY 1, 2)
 SELECT category, fact, row_number() OVER (PARTITION BY category ORDER BY first) AS place, merged, owner, evidence FROM f""")
def fact_composition(spark, sf):
    """Equal facts merged: the place of the first, all evidence once, the first owner that is named."""
    at = F.col("conv_id") * 1000 + F.col("turn")
    named = F.when(F.col("turn") % 3 == 0, at)
    f = A.table(spark, sf, "conversations").groupBy((F.col("conv_id") % 5).alias("category"), F.lower(F.trim("role")).alias("fact")).agg(F.min(at).alias("first"), F.count("*").alias("merged"), F.min_by(F.concat(F.lit("owner"), F.col("turn").cast("string")), named).alias("owner"), F.count_distinct("turn").alias("evidence"))
    return f.select("category", "fact", F.row_number().over(W.partitionBy("category").orderBy("first")).alias("place"), "merged", "owner", "evidence")


@query("SELECT min(n) AS least, round(avg(n), 6) AS mean, max(n) AS most, count(*) AS meetings, CAST(sum(users) AS BIGINT) AS users FROM (SELECT conv_id, count(*) AS n, count(*) FILTER (role = 'user') AS users FROM conversations GROUP BY 1)")
def corpus_stats(spark, sf):
    m = A.table(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "user").alias("users"))
    return m.agg(F.min("n").alias("least"), F.round(F.avg("n"), 6).alias("mean"), F.max("n").alias("most"), F.count("*").alias("meetings"), F.sum("users").alias("users"))


@query("""WITH g AS (SELECT conv_id, count(*) AS gold FROM conversations WHERE turn % 2 = 0 GROUP BY 1), p AS (SELECT conv_id, count(*) AS said, count(*) FILTER (turn % 6 = 0) AS tp FROM conversations WHERE turn % 3 = 0 AND conv_id % 5 <> 0 GROUP BY 1)
 SELECT conv_id, coalesce(tp, 0) AS tp, coalesce(said, 0) - coalesce(tp, 0) AS fp, gold - coalesce(tp, 0) AS fn, round(CASE WHEN coalesce(said, 0) = 0 THEN CASE WHEN gold = 0 THEN 1 ELSE 0 END ELSE tp / said END, 6) AS precision, round(CASE WHEN gold = 0 THEN 1 ELSE coalesce(tp, 0) / gold END, 6) AS recall, said IS NULL AS failed FROM g LEFT JOIN p USING (conv_id)""")
def note_scores(spark, sf):
    """Precision and recall of notes; a draft that failed has recall 0 and is never dropped."""
    c = A.table(spark, sf, "conversations")
    gold = c.where("turn % 2 = 0").groupBy("conv_id").agg(F.count("*").alias("gold"))
    said = c.where("turn % 3 = 0 AND conv_id % 5 <> 0").groupBy("conv_id").agg(F.count("*").alias("said"), F.count_if(F.col("turn") % 6 == 0).alias("hit"))
    b = gold.join(said, "conv_id", "left").withColumn("failed", F.col("said").isNull()).na.fill({"said": 0, "hit": 0})
    fn = F.col("gold") - F.col("hit")
    precision = F.when(F.col("said") == 0, F.when(fn == 0, 1.0).otherwise(0.0)).otherwise(F.try_divide("hit", "said"))
    recall = F.when(F.col("gold") == 0, 1.0).otherwise(F.try_divide("hit", "gold"))
    return b.select("conv_id", F.col("hit").alias("tp"), (F.col("said") - F.col("hit")).alias("fp"), fn.alias("fn"), F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), "failed")


# Extraction and review

_FIELDS = ["adviser_name", "advice_date", "risk_profile", "fee_initial", "fee_ongoing", "recommendations"]
_NEAR = "abs({a} - {b}) <= greatest(1, abs({b}) * 0.005)"
_COMPARED = f"""cm AS (SELECT o_orderkey AS doc_id, o_orderkey % 31 <> 0 AS ok_adviser_name, o_orderkey % 17 <> 0 OR o_orderkey % 34 = 0 AS ok_advice_date, o_orderpriority = CASE WHEN o_orderkey % 23 = 0 THEN '1-URGENT' ELSE o_orderpriority END AS ok_risk_profile,
 {_NEAR.format(a='o_totalprice * (1 + o_orderkey % 13 / 1000)', b='o_totalprice')} AS ok_fee_initial, {_NEAR.format(a='(o_totalprice / 100 + o_orderkey % 3)', b='(o_totalprice / 100)')} AS ok_fee_ongoing, coalesce(n, 0) >= 2 AS ok_recommendations
 FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)"""


def _compared(spark, sf):
    """An extraction of every order with planted faults: names, dates, priorities, and fees off by up to 1.2 per cent."""
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    near = lambda a, b: T.numbers_match(a, b)
    lines = A.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    o = A.table(spark, sf, "orders").join(lines, "o_orderkey", "left")
    said = F.when(k % 23 == 0, "1-URGENT").otherwise(F.col("o_orderpriority"))
    both = o.select(k.alias("doc_id"), (k % 31 != 0).alias("ok_adviser_name"), ((k % 17 != 0) | (k % 34 == 0)).alias("ok_advice_date"), (F.col("o_orderpriority") == said).alias("ok_risk_profile"), near(price * (1 + k % 13 / 1000), price).alias("ok_fee_initial"), near(price / 100 + k % 3, price / 100).alias("ok_fee_ongoing"), (F.coalesce("n", F.lit(0)) >= 2).alias("ok_recommendations"))
    return N.compared(both, _FIELDS)


_RIGHT = " AND ".join(f"ok_{f}" for f in _FIELDS)
_SHARE = " + ".join(f"CAST(ok_{f} AS INTEGER)" for f in _FIELDS)


@query(f"WITH {_COMPARED} SELECT *, {_RIGHT} AS doc_correct, round(({_SHARE}) / {len(_FIELDS)}, 6) AS field_accuracy FROM cm")
def extraction_compared(spark, sf):
    return _compared(spark, sf)


@query(f"WITH {_COMPARED} SELECT field, count(*) AS n, round(avg(CAST(ok AS INTEGER)), 6) AS accuracy FROM (UNPIVOT (SELECT * EXCLUDE (doc_id), {_RIGHT} AS ok_document FROM cm) ON {', '.join(f'ok_{f}' for f in _FIELDS)}, ok_document INTO NAME field VALUE ok) GROUP BY 1")
def extraction_summary(spark, sf):
    """Accuracy of each field and of whole documents."""
    c = _compared(spark, sf)
    names = [*[f"ok_{f}" for f in _FIELDS], "doc_correct"]
    rows = c.select(F.expr(f"stack({len(names)}, " + ", ".join(f"'{n.replace('doc_correct', 'ok_document')}', {n}" for n in names) + ") AS (field, ok)"))
    return rows.groupBy("field").agg(F.count("*").alias("n"), F.round(F.avg(F.col("ok").cast("int")), 6).alias("accuracy"))


_ROUTED = f"WITH {A.PREDICTIONS}, rt AS (SELECT doc_id, y, p < 0.6 AS low, doc_id % 11 = 0 AS violated, doc_id % 2 = 0 AS decided FROM pr)"


def _routed(spark, sf):
    p, d = A.predictions(spark, sf), F.col("doc_id")
    return p.select(d, "y", (F.col("p") < 0.6).alias("low"), (d % 11 == 0).alias("violated"), (d % 2 == 0).alias("decided"))


@query(f"{_ROUTED} SELECT doc_id, CASE WHEN low OR violated THEN 'review' ELSE 'auto' END AS route, (low OR violated) AND NOT decided AS awaiting FROM rt")
def review_routes(spark, sf):
    """A low score or a hard violation sends a document to review, where it waits for a decision."""
    review = F.col("low") | F.col("violated")
    return _routed(spark, sf).select("doc_id", F.when(review, "review").otherwise("auto").alias("route"), (review & ~F.col("decided")).alias("awaiting"))


@query(f"{_ROUTED} SELECT policy, round(avg(CAST(reviewed AS INTEGER)), 6) AS review_rate, round(coalesce(avg(1 - y) FILTER (NOT reviewed), 0), 6) AS residual FROM (SELECT y, policy, CASE policy WHEN 'all' THEN true WHEN 'none' THEN false WHEN 'validator' THEN violated ELSE low OR violated END AS reviewed FROM rt, (VALUES ('all'), ('none'), ('validator'), ('router')) v(policy)) GROUP BY 1")
def review_policies(spark, sf):
    """What each policy reviews, and the error it leaves in the rest."""
    r = _routed(spark, sf).withColumn("policy", F.explode(F.array(*[F.lit(x) for x in ("all", "none", "validator", "router")])))
    reviewed = F.when(F.col("policy") == "all", True).when(F.col("policy") == "none", False).when(F.col("policy") == "validator", F.col("violated")).otherwise(F.col("low") | F.col("violated"))
    r = r.withColumn("reviewed", reviewed)
    return r.groupBy("policy").agg(F.round(F.avg(F.col("reviewed").cast("int")), 6).alias("review_rate"), F.round(F.coalesce(F.avg(F.when(~F.col("reviewed"), 1 - F.col("y"))), F.lit(0.0)), 6).alias("residual"))


@query("""WITH a AS (SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS risk, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice END AS fee FROM orders), b AS (SELECT o_orderkey AS doc, lower(o_orderpriority) AS risk, CASE WHEN o_orderkey % 4 = 1 THEN o_totalprice * 2 END AS fee FROM orders WHERE o_orderkey % 2 = 0)
 SELECT doc, coalesce(b.risk, a.risk) AS risk, coalesce(b.fee, a.fee) AS fee FROM a LEFT JOIN b USING (doc)""")
def section_merge(spark, sf):
    """Later sections overlay earlier ones, field by field where they are not null."""
    o, k = A.table(spark, sf, "orders"), F.col("o_orderkey")
    a = o.select(k.alias("doc"), F.when(k % 3 != 0, F.col("o_orderpriority")).alias("risk"), F.when(k % 4 == 0, F.col("o_totalprice")).alias("fee"))
    b = o.where("o_orderkey % 2 = 0").select(k.alias("doc"), F.lower("o_orderpriority").alias("risk_b"), F.when(k % 4 == 1, F.col("o_totalprice") * 2).alias("fee_b"))
    return a.join(b, "doc", "left").select("doc", F.coalesce("risk_b", "risk").alias("risk"), F.coalesce("fee_b", "fee").alias("fee"))


@query("""WITH a AS (SELECT l_orderkey AS doc, l_linenumber AS idx, l_partkey AS product, l_returnflag AS action, l_extendedprice AS amount FROM lineitem), b AS (SELECT doc, product, action, CASE WHEN idx % 5 = 0 THEN amount * 2 ELSE amount END AS amount FROM a WHERE doc % 6 <> 0)
 SELECT doc, idx, EXISTS (SELECT 1 FROM b WHERE b.doc = a.doc AND b.product = a.product AND b.action = a.action AND abs(b.amount - a.amount) <= greatest(1, abs(a.amount) * 0.005)) AS agrees FROM a""")
def rules_agreement(spark, sf):
    """Whether the rules found a recommendation of the same product, action and amount."""
    a = A.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("idx"), F.col("l_partkey").alias("product"), F.col("l_returnflag").alias("action"), F.col("l_extendedprice").alias("amount"))
    b = a.where("doc % 6 <> 0").select("doc", "product", "action", F.when(F.col("idx") % 5 == 0, F.col("amount") * 2).otherwise(F.col("amount")).alias("theirs"))
    near = F.abs(F.col("theirs") - F.col("amount")) <= F.greatest(F.lit(1.0), F.abs("amount") * 0.005)
    found = a.join(b, ["doc", "product", "action"]).where(near).select("doc", "idx").distinct().withColumn("agrees", F.lit(True))
    return a.select("doc", "idx").join(found, ["doc", "idx"], "left").select("doc", "idx", F.coalesce("agrees", F.lit(False)).alias("agrees"))


@query("""WITH a AS (SELECT doc_id, length(text) % 7 AS x FROM documents WHERE doc_id % 10 <> 3), b AS (SELECT doc_id, length(text) % 5 AS x FROM documents) SELECT count(*) AS n, CASE WHEN count(*) = (SELECT count(*) FROM a) THEN round(avg(a.x - b.x), 6) END AS delta FROM a JOIN b USING (doc_id)""")
def strategy_pairing(spark, sf):
    """Two strategies on the same documents; no comparison unless every document of the first has its pair."""
    d = A.table(spark, sf, "documents").select("doc_id", F.length("text").alias("n"))
    a, b = d.where("doc_id % 10 <> 3").select("doc_id", (F.col("n") % 7).alias("x")), d.select("doc_id", (F.col("n") % 5).alias("y"))
    j = a.join(b, "doc_id", "left").agg(F.count("y").alias("n"), F.count("*").alias("all"), F.avg(F.col("x") - F.col("y")).alias("d"))
    return j.select("n", F.when(F.col("n") == F.col("all"), F.round("d", 6)).alias("delta"))


# Edits


@query("SELECT doc_id, 2 * len(list_filter(range(len(l)), lambda i: i % 7 = 3)) AS changed FROM (SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(text, chr(10)) END AS l FROM documents)")
def draft_diffs(spark, sf):
    """Whole documents against themselves with every seventh line edited: lines that a shortest diff takes out and puts in."""
    edited = F.array_join(F.transform(F.split("text", "\n"), lambda line, i: F.when(i % 7 == 3, F.concat(line, F.lit(" \x04"))).otherwise(line)), "\n")
    d = A.table(spark, sf, "documents").select("doc_id", diff.unified(F.col("text"), edited).alias("d"))
    return d.select("doc_id", F.col("d.changed").cast("long").alias("changed"))
