"""Spoken figures, dates, repairs, claim verdicts and release statistics against plain computations."""

from __future__ import annotations

import datetime
import re

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from assayflow.functions import jsonfix, spoken
from assayflow.functions import text as T
from assayflow.operators import notes as N
from assayflow.operators import release as R
from assayflow.plans import catalogue, notes, registry

SF = "/root/testdata/sf0.001"


FIGURES = [
    ("eighty-five thousand", [85000]), ("$85k", [85000]), ("A$ 85,000.50", [85000.5]), ("85 thousand dollars", [85000]), ("one point two million", [1200000]), ("nine point five percent", [9.5]),
    ("s034 CLIENT_2 x12 and 12%", [12]), ("two hundred and fifty then 3", [250, 3]), ("on 3 March 2025 we moved 4,500.50", [4500.5]), ("no figures and a point", []), ("", []), (None, []),
    ("twenty-seven thousand five hundred", [27500]), ("a million", [1000000]), ("2.5 mil", [2500000]), ("half of 10 per cent", [10]), ("point", []), ("seven point", [7]), ("85 thousand and five hundred", [85000]),
    ("85k five hundred", [85000, 500]), ("85 hundred and 3 grand four", [85, 100, 3000]), ("1.5m, 2bn and 7mil", [1.5e6, 2e9, 7e6]), ("point five", [0.5]), ("one point two point five", [1.7]), ("\x01 4 \x03", [4]),
]


def evaluated(spark, texts, of):
    """What the column expression ``of`` gives for each text."""
    held = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    rows = {r.i: r.x for r in held.select("i", of("text").alias("x")).collect()}
    return [[tuple(x) if isinstance(x, Row) else x for x in rows[i]] for i in range(len(texts))]


def test_numbers(spark):
    assert evaluated(spark, [t for t, _ in FIGURES], spoken.figures_in) == [w for _, w in FIGURES]
    assert evaluated(spark, ["3 or three, 2"], spoken.numbers_in) == [[2, 3]]


def test_long_runs_of_number_words(spark):
    """Runs of thousands of words are matched without recursion; Java's stack would end the executor."""
    texts = ["one and " * 20_000, "5 thousand " + "and " * 20_000 + "x 7", "point " + "one " * 3000, "two " + "a an and " * 5000 + "point five, 3"]
    got = evaluated(spark, texts, spoken.figures_in)
    assert [len(g) for g in got] == [1, 2, 1, 2]
    assert got[0] == [20_000] and got[1] == [5000, 7] and got[3] == [2.5, 3]


def test_dates(spark):
    texts = ["2025-03-04, 5/6/2024 and 1st of July, August 9, 2023; Sept 2022 but not 45 March", "May 5 June", "13/13/2024", None]
    assert evaluated(spark, texts, spoken.dates_in) == [[(3, 4, 2025), (6, 5, 2024), (7, 1, None), (8, 9, 2023), (9, None, 2022)], [(6, 5, None)], [], []]


def agree_slow(a, b):
    return a[0] == b[0] and all(x is None or y is None or x == y for x, y in zip(a[1:], b[1:], strict=True))


def test_dates_agree(spark):
    pairs = [((3, None, 2025), (3, 4, None)), ((3, 4, 2025), (3, 5, 2025)), ((3, 4, None), (4, 4, None)), ((3, 4, 2025), (3, 4, 2025)), ((3, 4, 2025), (3, 4, 2024))]
    held = spark.createDataFrame(pairs, "a struct<month:int,day:int,year:int>, b struct<month:int,day:int,year:int>")
    assert [r.x for r in held.select(spoken.agree(F.col("a"), F.col("b")).alias("x")).collect()] == [agree_slow(*p) for p in pairs] == [True, False, False, True, False]


def test_words_and_back(spark):
    figures = [0, 1, 13, 20, 42, 100, 215, 999, 1000, 27500, 85000, 1200000, 1000000, 2000001, 10**9, 9.5, 0.25, 2345678901.125]
    held = spark.createDataFrame([(float(n),) for n in figures], "n double").withColumn("text", spoken.said(F.col("n")))
    assert [r.x for r in held.select(spoken.figures_in("text").alias("x")).collect()] == [[n] for n in figures]
    said = spark.createDataFrame([(-3.0,), (1200000.0,), (1e12,)], "n double").select(spoken.said(F.col("n")), spoken.amount(F.col("n"))).collect()
    assert [tuple(r) for r in said[:2]] == [("minus three", "$-3"), ("one point two million", "$1,200,000")] and said[2][0] is None


def test_json_repairs():
    both = lambda t: (jsonfix.repaired(t, "document"), jsonfix.repaired(t, "note"))
    assert both('{"a": 1}') == (({"a": 1}, False),) * 2 and both('x {"a": [1, 2,],} y') == (({"a": [1, 2]}, True),) * 2 and both("none") == ((None, True),) * 2 == both(None)
    assert both('```json\n{"a": "}"}\n```') == (({"a": "}"}, True),) * 2
    assert both('{"a": 1, "b": [1, 2') == (({"a": 1, "b": [1, 2]}, True), (None, True))
    assert jsonfix.repaired('{"a": {"b": 1}, "c": "tr', "document")[0] == {"a": {"b": 1}}
    made = jsonfix.shaped({"goals": ["x", {"text": "y", "evidence": ["s1"]}], "action_items": [{"text": "z", "owner": "bob", "due": "soon"}, {"text": "w", "owner": "client", "due": "2025-03-04"}], "decisions": 3})
    assert made == [("goals", 0, "x", ["unknown"], None, None), ("goals", 1, "y", ["s1"], None, None), ("action_items", 0, "z", ["unknown"], "adviser", None), ("action_items", 1, "w", ["unknown"], "client", "2025-03-04")]


def words_slow(text):
    out = set()
    for w in re.findall("[a-z][a-z'-]*[a-z]|[a-z]", text.lower()):
        w = w.removesuffix("'s")
        if len(w) > 2 and w not in N.STOP and w not in spoken.NUMBER_WORDS:
            out.add(N.stem(w))
    return out


def owner_slow(role, text):
    t = text.lower()
    if role == "adviser":
        return next((o for p, o in ((N.ADVISER_ASKS, "client"), (N.PARAPLANNER_NAMED, "paraplanner"), (N.ADVISER_WILL, "adviser")) if re.search(p, t)), None)
    return role if re.search(N.CLIENT_WILL if role == "client" else N.PARAPLANNER_WILL, t) else None


def verdict_slow(claim, said, figures, dates):
    there = [said[e] for e in claim.evidence if e in said]
    text = " ".join(t for _, t in there)
    claimed = claim.text + (f" due {claim.due}" if claim.due else "")
    own, theirs = words_slow(claim.text), words_slow(text)
    lex = len(own & theirs) / len(own) if own else 1.0
    hard = ["unknown_segment"] if len(there) < len(claim.evidence) else [] if there else ["no_evidence"]
    if there:
        if set(figures[claimed]) - set(figures[text]):
            hard.append("figure")
        if any(not any(agree_slow(d, e) for e in dates[text]) for d in dates[claimed]):
            hard.append("date")
        hit = lambda ps, t: re.search(N.any_of(ps), t) is not None
        if claim.section == "decisions" and not any(hit(N.COMMITMENT, t) and not hit(N.DEFERRAL, t) for _, t in there):
            hard.append("deferral" if any(hit(N.DEFERRAL, t) for _, t in there) else "no_commitment")
        owners = {owner_slow(*x) for x in there} - {None}
        if claim.section == "action_items" and owners and claim.owner not in owners:
            hard.append("owner")
        if claim.section != "follow_up" and not (own | theirs) & set(N.ADVICE):
            hard.append("off_topic")
    wrong = claim.section in N.SPEAKERS and not any(r in N.SPEAKERS[claim.section] for r, _ in there)
    if hard:
        return "unsupported", 0.0, hard
    if lex < 0.25:
        return "unsupported", 0.5 * lex, ["overlap"]
    if lex < 0.5 or wrong:
        return "weak", 0.5 + 0.3 * lex, ["speaker" if wrong else "overlap"]
    return "supported", 0.7 + 0.3 * lex, []


ODD = [
    ("goals", "retire at sixty with super of $85k", None, None, ["s1"]), ("goals", "retire at sixty with super of $95k", None, None, ["s1"]), ("decisions", "increase salary sacrifice", None, None, ["s2"]), ("decisions", "hold the insurance", None, None, ["s3"]),
    ("action_items", "send super statement", "adviser", datetime.date(2025, 3, 4), ["s4"]), ("action_items", "send super statement", "client", datetime.date(2025, 3, 4), ["s4"]), ("goals", "the footy was great", None, None, ["s5"]),
    ("follow_up", "the footy was great", None, None, ["s5"]), ("goals", "new mortgage", None, None, []), ("goals", "new mortgage", None, None, ["s9", "s1"]), ("goals", "retire with super soon by June", None, None, ["s1", "s6"]), ("decisions", "agree on super", None, None, ["s6"]),
]
SAID = [
    ("s1", "client", "I want to retire at sixty with eighty-five thousand in super"), ("s2", "client", "Yes, let's go ahead and increase the salary sacrifice"), ("s3", "client", "Let me think about the insurance until next review"),
    ("s4", "adviser", "Could you send the super statement by 4 March?"), ("s5", "client", "The footy was great"), ("s6", "paraplanner", "We agree to proceed with super in June"),
]


def test_claim_verdicts(spark):
    claims = spark.createDataFrame([(1, s, i, t, o, d, e) for i, (s, t, o, d, e) in enumerate(ODD)], "meeting_id int, section string, idx int, text string, owner string, due date, evidence array<string>")
    segments = spark.createDataFrame([(1, *x) for x in SAID], "meeting_id int, seg_id string, role string, text string")
    tables = [(claims, segments), (notes._claims(spark, SF), notes._segments(spark, SF))]
    for c, s in tables:
        said = {}
        for r in s.collect():
            said.setdefault(r.meeting_id, {})[r.seg_id] = (r.role, r.text)
        got = {(r.meeting_id, r.section, r.idx): (r.status, r.score, r.reasons) for r in N.verdicts(c, s).collect()}
        rows = c.collect()
        assert len(got) == len(rows)
        texts = sorted({r.text + (f" due {r.due}" if r.due else "") for r in rows} | {" ".join(said[r.meeting_id][e][1] for e in r.evidence if e in said[r.meeting_id]) for r in rows})
        figures, dates = (dict(zip(texts, evaluated(spark, texts, of), strict=True)) for of in (spoken.figures_in, spoken.dates_in))
        for r in rows:
            status, score, reasons = verdict_slow(r, said[r.meeting_id], figures, dates)
            assert got[r.meeting_id, r.section, r.idx] == (status, pytest.approx(round(min(1, score), 4)), reasons), r
    first = {r.idx: r.status for r in N.verdicts(*tables[0]).collect()}
    assert [first[i] for i in range(5)] == ["supported", "unsupported", "supported", "unsupported", "unsupported"] and first[5] == "supported"
    edited = claims.withColumn("edited", F.col("idx") == 1).withColumn("unsupported", F.lit(False))
    after = {r.idx: r.unsupported for r in N.applied(edited, N.verdicts(*tables[0])).collect()}
    assert after[1] is False and after[3] is True and after[0] is False
    one = N.report(N.verdicts(*tables[0]), segments).first()
    assert one.claims == len(ODD) and one.figures == 3 and one.ungrounded == 1


def test_release_statistics(spark):
    a, b = np.array([50.0, 30, 20, 0]), np.array([20.0, 30, 50, 0])
    x, p = R.two_samples(a, b)
    assert x == pytest.approx(25.714286) and p == pytest.approx(2.6e-6, rel=0.05)
    assert R.two_samples(np.array([10.0]), np.array([10.0])) == (0.0, 1.0) and R.js_distance(np.array([1.0, 0]), np.array([0, 1.0])) == 1.0
    assert R.chi2_upper(3.841459, 1) == pytest.approx(0.05, abs=1e-5) and R.chance_distance(np.zeros(2), 5) == float("inf")
    counts = lambda base, now: spark.createDataFrame([(i, int(x), int(y)) for i, (x, y) in enumerate(zip(base, now, strict=True))], "topic int, base int, now int")
    assert R.drift(counts(a, b), 9).first().trigger == "mix" and R.drift(counts(a, a), 9).first().trigger == ""
    assert "novel" in R.drift(counts([500, 490, 10], [480, 480, 60]), 2).first().trigger and R.drift(counts([0, 0], [1, 1]), 0).first().trigger == ""
    assert spark.range(1).selectExpr(f"{R.upper_tail('1.644854e0')} AS p").first().p == pytest.approx(0.05, abs=1e-6)


@pytest.mark.parametrize(
    ("canary", "control", "stage", "want"),
    [
        ((20, 0, 0, 0.9), (200, 0, 0, 0.9), 10, "hold"), ((100, 0, 0, 0.9), (300, 0, 0, 0.9), 10, "advance"), ((100, 15, 0, 0.9), (300, 1, 0, 0.9), 10, "rollback"), ((100, 0, 20, 0.9), (300, 0, 3, 0.9), 10, "rollback"),
        ((100, 0, 0, 0.7), (300, 0, 0, 0.95), 10, "rollback"), ((200, 0, 0, 0.9), (100, 0, 0, 0.9), 100, "promote"),
    ],
)
def test_canary_actions(spark, canary, control, stage, want):
    sums = {"stage": stage}
    for c, (n, errors, refusals, quality) in (("c", canary), ("t", control)):
        sums |= {f"n_{c}": n, f"e_{c}": errors, f"r_{c}": refusals, f"q_{c}": n - errors, f"m_{c}": quality, f"v_{c}": 0.01}
    assert spark.createDataFrame([tuple(sums.values())], list(sums)).selectExpr(*R.canary_columns()).first().action == want


def test_edit_ratio_of_whole_texts(spark):
    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1] / max(len(a), len(b)) if a or b else 0.0

    pairs = [("straße\nzwei", "strasse\ndrei"), ("", ""), ("a", ""), ("é\nlong tail here", "e\nlong tale there"), ("x" * 300, "x" * 290 + "y" * 30)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").select("i", T.edit_ratio(F.col("a"), F.col("b")).alias("r"))
    assert {r.i: r.r for r in df.collect()} == {i: pytest.approx(slow(*p)) for i, p in enumerate(pairs)}
    assert "edit_ratio_negative" in registry.QUERIES and catalogue.QUERIES is registry.QUERIES


def test_edges_of_words_as_in_sql(spark):
    """A letter with an accent ends a word, a dot takes any character but a newline, case is Unicode's: as the SQL reads the patterns."""
    import duckdb

    texts = ["aes. yes\u00f1a", "\u00e9yes", "yes_", "yes", "paraplanner\rwill", "paraplanner\u2028will", "paraplanner\nwill", "we\u0301ll", "thin\u212a about", None]
    for pattern in (N.CLIENT_WILL, N.PARAPLANNER_NAMED, N.any_of(N.DEFERRAL)):
        held = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
        found = [r.x for r in held.orderBy("i").select(T.matches(F.col("text"), pattern).alias("x")).collect()]
        assert found == [duckdb.execute("SELECT regexp_matches(?, ?)", [t, pattern]).fetchone()[0] if t is not None else None for t in texts], pattern
    owners = held.orderBy("i").select(N.implied_owner(F.lit("client"), F.col("text")).alias("x")).collect()
    assert [r.x for r in owners][:4] == ["client", "client", None, "client"]
