"""Functions and operators on small fixtures with known results."""

from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assayflow.functions import fuzzy
from assayflow.functions import text as T
from assayflow.operators import decisions, models, slo
from assayflow.operators.ranks import running
from assayflow.sources import files
from assayflow.streaming import monitor


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_lcs(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        before = row[:]
        for j, d in enumerate(b):
            row[j + 1] = before[j] + 1 if c == d else max(row[j], before[j + 1])
    assert fuzzy.lcs(a, b) == row[-1]
    assert fuzzy.indel_ratio(a, b) == fuzzy.indel_ratio(b, a)


def test_fuzzy():
    assert fuzzy.indel_ratio("", "") == 100
    assert fuzzy.token_set_ratio("a b c", "c b") == 100
    assert fuzzy.token_set_ratio("", "a") == 0


def test_json(spark):
    assert fuzzy.parses('{"a": NaN}') and not fuzzy.parses('{"a": 1} x') and fuzzy.parses(None) is None
    assert fuzzy.repaired('```json\n{"a": [1, 2,],}\n```') == ('{"a": [1, 2]}', 2)
    assert fuzzy.repaired("no object")[0] is None
    df = spark.createDataFrame([("{}",), ("{",), (None,)], "t string")
    assert [r.v for r in df.select(fuzzy.json_valid("t").alias("v")).collect()] == [True, False, None]
    assert df.select(fuzzy.json_repaired("t").alias("v")).collect()[0].v.text == "{}"


@pytest.mark.parametrize(("a", "b", "want"), [(1000.0, 1004.0, True), (1000.0, 1006.0, False), (None, None, True), (None, 1.0, False), (0.0, 1.0, True)])
def test_numbers_match(spark, a, b, want):
    assert one(spark, T.numbers_match(F.lit(a).cast("double"), F.lit(b).cast("double"))) is want


def test_identifiers(spark):
    assert one(spark, T.tfn_valid(F.lit("123456782"))) and not one(spark, T.tfn_valid(F.lit("123456783"))) and not one(spark, T.tfn_valid(F.lit("12")))
    assert one(spark, T.abn_valid(F.lit("51824753556"))) and not one(spark, T.abn_valid(F.lit("51824753557")))


def test_text(spark):
    assert one(spark, T.edit_ratio(F.lit(""), F.lit(""))) == 0
    assert one(spark, T.normal_name(F.lit("  Ab,\n C-3 "))) == "ab c3"
    assert one(spark, T.overlap(F.array().cast("array<string>"), F.array(F.lit("a")))) == 1
    assert one(spark, T.token_estimate(F.lit("a" * 10))) == 2
    assert one(spark, T.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0
    assert one(spark, F.lit("I cannot help").rlike(T.REFUSAL))


@pytest.mark.parametrize(("w", "n", "p"), [(10, 0, 2 / 1024), (5, 5, 1.0), (0, 0, 1.0)])
def test_mcnemar(spark, w, n, p):
    assert one(spark, decisions.mcnemar(F.lit(w), F.lit(n))) == pytest.approx(p)


def test_running_is_a_running_sum(spark):
    df = spark.range(100).select(((F.col("id") * 37) % 100).alias("k"), (F.col("id") % 7).alias("v"))
    got = {r.k: r.s for r in running(df, F.floor(F.col("k") / 9), ["k"], {"v": "s"}).collect()}
    rows, total = dict(df.collect()), 0
    for k in sorted(rows):
        total += rows[k]
        assert got[k] == total


def test_panes_close_on_the_right(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 06:00:00"), (2, "2024-01-01 06:00:01"), (3, "2024-01-01 12:00:00")], "id int, at string").select(F.lit("s").alias("slo"), F.lit(0.1).alias("budget"), F.col("at").cast("timestamp_ntz").alias("ts"), F.lit(True).alias("bad"))
    assert sorted(r.n for r in slo.panes(rows).collect()) == [1, 2]


def test_versions(spark, tmp_path):
    df = spark.range(5).withColumn("x", F.col("id") * 2)
    files.write_version(df, str(tmp_path), "d", 1, "id")
    assert files.read_version(spark, str(tmp_path), "d", 1, "id").count() == 5
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_version(df, str(tmp_path), "d", 1, "id")
    spark.range(4).withColumn("x", F.lit(1).cast("long")).write.mode("overwrite").parquet(f"{tmp_path}/d/v1/rows")
    with pytest.raises(ValueError, match="manifest"):
        files.read_version(spark, str(tmp_path), "d", 1, "id")


def test_transcripts(spark):
    lines = ["# date: 2024", "s007 [01:02:03] Ann Lee (adviser): Hello: you", "[02:05] Bob: hi", "just text", ""]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "meeting_id long, pos long, line string")
    got = [tuple(r) for r in files.parse_transcript(df).select("seg_id", "t", "speaker", "role", "text").orderBy("pos").collect()]
    assert got == [("s007", 3723, "Ann Lee", "adviser", "Hello: you"), ("s003", 125, "Bob", None, "hi"), ("s004", 30, "unknown", None, "just text")]


def test_upsert_and_otlp(spark):
    log = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 3.0), ("b", 1, 1.0)], "k string, n int, v double")
    assert {(r.k, r.v) for r in files.upsert(log, "k", "n").collect()} == {("a", 3.0), ("b", 1.0)}
    t = spark.createDataFrame([("x", "s", "v", 1.5, 2.0, "error", None, "", "", 3, 4, 0.1)], files.TRACE)
    assert files.to_otlp(t).first().startTimeUnixNano == "1500000000"


def test_escalation_stream(spark, tmp_path):
    rows = [("a", t, t != 3) for t in range(1, 6)] + [("b", 2, True)]
    spark.createDataFrame(rows, "name string, tick long, fired boolean").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("name string, tick long, fired boolean").parquet(f"{tmp_path}/in")
    q = monitor.escalation(stream).writeStream.format("memory").queryName("esc").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.name, r.tick): (r.consecutive, r.severity) for r in spark.table("esc").collect()}
    assert got == {("a", 1): (1, "warning"), ("a", 2): (2, "critical"), ("a", 4): (1, "warning"), ("a", 5): (2, "critical"), ("b", 2): (1, "warning")}


def test_deduplicated_stream(spark):
    s = monitor.once(monitor.events(spark, "/root/testdata/sf0.001"))
    q = s.writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("once").count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id").distinct().count()


def test_bootstrap_brackets_the_mean(spark):
    rows = spark.range(400).select((F.col("id") % 2).alias("g"), (F.col("id") % 40).alias("c"), (F.col("id") % 17).cast("double").alias("x"))
    for r in models.bootstrap(rows, "g", "c", "x").collect():
        assert r.low <= r["mean"] <= r.high
