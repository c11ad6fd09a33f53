"""Validators, identifier dialects, pseudonyms and scores on small rows, against plain Python where SQL has no form."""

from __future__ import annotations

import zlib
from datetime import date

from pyspark.sql import functions as F

from assayflow.functions import identifiers as I
from assayflow.operators import matching, scoring
from assayflow.operators import validators as V
from assayflow.plans import records

SF = "/root/testdata/sf0.001"
TFN, ABN = "123 456 782", "51 824 753 556"


def kinds(text, dialect):
    return [(s.kind, text[s.start : s.end]) for s in I.DIALECTS[dialect](text)]


def test_checksums():
    assert I.tfn_ok(TFN) and not I.tfn_ok("123 456 789") and not I.tfn_ok("12345678")
    assert I.abn_ok(ABN) and not I.abn_ok("51 824 753 557") and not I.abn_ok("")


def test_dialects_differ():
    text = f"mail a.b@c.org, abn {ABN}, tfn {TFN}, call 0412 345 678, bad 51 824 753 557"
    assert kinds(text, "chat") == [("email", "a.b@c.org"), ("abn", ABN), ("tfn", TFN), ("phone", "0412 345 678")]
    assert kinds(text, "document") == [("abn", ABN), ("tfn", TFN), ("abn", "51 824 753 557")]
    assert kinds(text, "meeting") == [("EMAIL", "a.b@c.org"), ("TFN", TFN), ("PHONE", "0412 345 678")]
    assert kinds("born on 3 May 1970 at 12 Long Hill Road, Perth WA 6000", "meeting") == [("DOB", "3 May 1970"), ("ADDRESS", "12 Long Hill Road, Perth WA 6000")]
    assert all(kinds("", d) == [] for d in I.DIALECTS)


def test_spans_and_redaction(spark):
    rows = [(1, f"é tfn {TFN} and a@b.org."), (2, None), (3, ""), (4, "nothing")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("s", I.spans(F.col("text"), "chat"))
    got = {r.doc_id: (len(r.s), r.out) for r in df.select("doc_id", "s", I.redacted(F.col("text"), F.col("s")).alias("out")).collect()}
    assert got == {1: (2, "é tfn [TFN] and [EMAIL]."), 2: (0, None), 3: (0, ""), 4: (0, "nothing")}


def test_pseudonyms(spark):
    seats = [(1, 0, "James Chen", "client"), (1, 1, "Mary Chen", "client"), (1, 2, "Mary Poe", "adviser"), (2, 0, "Solo", "odd")]
    p = I.pseudonyms(spark.createDataFrame(seats, "meeting_id long, pos int, name string, role string"))
    said = spark.createDataFrame([(1, "James Chen, James and Mary met Mary Poe and Jameson"), (2, "Solo spoke"), (2, None), (3, "James")], "meeting_id long, text string")
    out = said.join(p, "meeting_id", "left").withColumn("h", I.renamed("text", "names")).select("meeting_id", "h", I.renamed("h", "aliases").alias("back"))
    assert sorted(out.collect(), key=str) == sorted([
        (1, "CLIENT_1, CLIENT_1 and Mary met ADVISER and Jameson", "James Chen, James Chen and Mary met Mary Poe and Jameson"),
        (2, "SPEAKER spoke", "Solo spoke"), (2, None, None), (3, "James", "James")], key=str)


def test_products(spark):
    master = spark.createDataFrame([("Growth Fund", "fund"), ("Life Cover", "insurance")], "name string, product_type string")
    recs = spark.createDataFrame([(1, 0, "growth fund", "fund"), (1, 1, "Growth Funds", "insurance"), (2, 0, "zzz", "fund"), (2, 1, None, "fund")], "doc_id long, idx int, product_name string, product_type string")
    reps = spark.createDataFrame([(3, 0, "Life Cover", "qqq", ""), (3, 1, " ", None, "why")], "doc_id long, idx int, from_product string, to_product string, reason string")
    got = sorted((r.doc_id, r.code, r.field) for r in V.products(recs, master, reps).collect())
    assert got == [(1, "product_type_mismatch", "recommendations[1].product_type"), (2, "product_unknown", "recommendations[0].product_name"), (2, "product_unknown", "recommendations[1].product_name"), (3, "product_unknown", "replacements[0].to_product")]
    assert sorted((r.code, r.field) for r in V.replacements(reps).collect()) == [("replacement_incomplete", "replacements[1]"), ("replacement_reason_missing", "replacements[0].reason")]


def test_fees_and_dates(spark):
    schema = "doc_id long, fee_initial double, fee_ongoing double, fee_basis string, fee_percent double, invested double, advice_date date, document_date date"
    rows = [(1, 0.0, 1000.0, "percent", 1.0, 100000.0, date(2020, 1, 1), date(2022, 1, 1)), (2, -1.0, 1030.0, "percent", 1.0, 100000.0, date(2020, 1, 1), date(2021, 12, 31)),
            (3, None, None, None, None, 0.0, None, None), (4, 0.0, -5.0, "flat", 1.0, 0.0, None, None), (5, 0.0, 0.0, "percent", None, 5.0, None, None)]
    d = spark.createDataFrame(rows, schema)
    assert sorted((r.doc_id, r.code, r.severity) for r in V.fees(d).collect()) == [(2, "fee_arithmetic", "error"), (2, "fee_negative", "error"), (4, "fee_basis_inconsistent", "warning"), (4, "fee_negative", "error"), (5, "fee_basis_inconsistent", "error")]
    assert [r.doc_id for r in V.dates(d).collect()] == [1]


def test_identifier_rows_agree_with_the_dialect(spark):
    texts = [f"ABN {ABN} TFN {TFN}", "51 824 753 557 and 51824753558", "1234567820", None, "", f"{ABN}-1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.code) for r in V.identifiers_in(df).collect())
    want = []
    for i, text in enumerate(texts):
        found = kinds(text or "", "document")
        want += [(i, "abn_invalid") for k, x in found if k == "abn" and not I.abn_ok(x)] + [(i, "tfn_present")] * any(k == "tfn" for k, _ in found)
    assert got == sorted(want)


def test_head_sampling(spark):
    traces = records.A.traces(spark, SF).select("trace_id", "status").collect()
    want = {r.trace_id for r in traces if zlib.crc32(str(r.trace_id).encode()) % 10000 < 1000 or r.status == "error"}
    assert {r.trace_id for r in records.head_sampled(spark, SF).collect()} == want


def test_answer_score_without_checks_that_apply(spark):
    quality, passed = scoring.answer_score({"json_valid": F.col("x")})
    rows = spark.createDataFrame([(None,), (True,), (False,)], "x boolean").select(quality, passed).collect()
    assert [tuple(r) for r in rows] == [(None, True), (1.0, True), (0.0, False)]


def test_alert_gauges(spark):
    best = spark.createDataFrame([("error", 7, "page"), ("cost", 6, "page")], "slo string, tick long, rule string")
    known = spark.createDataFrame([("error", "page"), ("cost", "page")], "slo string, rule string")
    assert sorted(map(tuple, scoring.alert_gauges(best, known, F.lit(7)).collect())) == [("cost", "page", 0.0), ("error", "page", 1.0)]


def test_replacements_match_one_to_one():
    item = lambda old, new, fee=10.0, impact="none": {"old": old, "new": new, "fee": fee, "impact": impact}
    gold = [item("Alpha Super", "Beta Super"), item("Gamma Growth Fund", "Beta Super", None)]
    assert matching.replacement_match(gold, gold) == (2, 2)
    assert matching.replacement_match([gold[0], gold[0]], gold) == (1, 1)
    assert matching.replacement_match([item("alpha super", "BETA SUPER", 10.5), item("Gamma Growth Fund", "Beta Super", 0.0)], gold) == (2, 1)
    assert matching.replacement_match([item("Alpha Super", "Beta Super", impact="lost"), item(None, "Beta Super")], gold) == (1, 0)
    assert matching.replacement_match([], gold) == matching.replacement_match(gold, []) == (0, 0)
