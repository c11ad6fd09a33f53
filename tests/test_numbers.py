"""Numbers, dates, money, names, grounding, embeddings, matching and intervals on small rows."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from datetime import date
from decimal import Decimal
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from assayflow.functions import fuzzy
from assayflow.functions import numbers as N
from assayflow.functions import text as T
from assayflow.operators import matching as M
from assayflow.plans import records


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_numbers(spark):
    got = one(spark, "On 2024-05-01 pay $1,200.50 or -3 %, 7% of v2.1, s034 and 8.", N.numbers)
    assert [(r.token, r.value) for r in got] == [("$1,200.50", 1200.5), ("-3 %", -3.0), ("7%", 7.0), ("8", 8.0)]
    assert one(spark, None, N.numbers) == [] and one(spark, "", N.numbers) == []


def test_dates_money_names(spark):
    text = "ISO 2020-02-30, then 3 march 2021, 1/2/2020 and 2019-12-31; 32/1/2020."
    assert one(spark, text, N.dates) == [date(2021, 3, 3), date(2020, 2, 1), date(2019, 12, 31)]
    assert one(spark, "-$1,000, AUD -2.5, 7 dollars, -8 dollars, 9", N.money) == [Decimal(x).quantize(Decimal("1.0000")) for x in ("-1000", "-2.5", "7", "-8")]
    assert one(spark, "A. Bee <a@b.c> and C; D & E, F (x, y).", N.names) == ["A. Bee", "C", "D", "E", "F"]
    assert [one(spark, None, f) for f in (N.dates, N.money, N.names)] == [[], [], []]


def test_grounding(spark):
    rows = [("It is 25% or 1,000.004 on 2024-01-02", "0.25 and 1000"), ("It is 26 on 2024-01-03", "0.25"), ("none", None), (None, "1"), ("code 77", "x77y")]
    df = spark.createDataFrame(rows, "a string, e string")
    values = N.number_forms(F.transform(N.numbers(F.col("e")), lambda n: n["value"]))
    got = [r[0] for r in df.select(N.ungrounded(F.col("a"), values, F.col("e"))).collect()]
    assert got == [["2024-01-02"], ["26", "2024-01-03"], [], [], []]


def test_embedding_against_plain_python(spark):
    rows = [(1, "growth fund growth Fees"), (2, ""), (3, None), (4, "only")]
    df = spark.createDataFrame(rows, "item_id long, text string")
    got = {r.item_id: r.vector for r in N.embedded(df, "item_id", "text", 32).collect()}
    for key, words in [(r.item_id, r.w) for r in df.select("item_id", T.tokens(F.coalesce("text", F.lit(""))).alias("w")).collect()]:
        want = [0.0] * 32
        for gram in words + [f"{a}_{b}" for a, b in pairwise(words)]:
            h = zlib.crc32(gram.encode())
            want[h % 32] += 1.0 if h >> 31 else -1.0
        norm = math.sqrt(sum(v * v for v in want)) or 1.0
        assert got[key] == pytest.approx([v / norm for v in want])


def test_token_set_ratio_without_shared_words():
    assert fuzzy.token_set_ratio("abc", "abd") == pytest.approx(200 * 2 / 6)


def test_claims_are_matched_once_best_first():
    item = lambda text, owner=None, facts=(): {"text": text, "owner": owner, "facts": facts}
    pred = [item("send the form", "adviser"), item("Send the form today", "adviser"), item("pay 5", None, ["5"])]
    gold = [item("send the form today", "adviser"), item("send the form today", "client"), item("pay 6", None, ["6"])]
    assert [(m["i"], m["j"], m["score"]) for m in M.claim_pairs(pred, gold, 80)] == [(0, 0, 100.0)]
    assert M.claim_pairs([], gold, 80) == []


def test_claims_match_as_by_all_scores():
    r = random.Random(3)
    item = lambda: {"text": " ".join(r.choices("a bb ccc dddd eeeee".split(), k=r.randint(0, 5))), "owner": r.choice([None, "x", "y"]), "facts": r.choice([[], ["1"]])}
    for _ in range(300):
        pred, gold = ([item() for _ in range(r.randint(0, 6))] for _ in range(2))
        scores = sorted((-fuzzy.token_set_ratio(p["text"], g["text"]), i, j) for i, p in enumerate(pred) for j, g in enumerate(gold) if p["facts"] == g["facts"] and (None in (p["owner"], g["owner"]) or p["owner"] == g["owner"]))
        want, used = [], set()
        for score, i, j in scores:
            if -score >= 60 and not {("i", i), ("j", j)} & used:
                used |= {("i", i), ("j", j)}
                want.append({"i": i, "j": j, "score": -score})
        assert M.claim_pairs(pred, gold, 60) == want


def test_claims_are_whole_texts(spark, tmp_path):
    head = " ".join(f"word{i}" for i in range(40))
    turns = [(1, 0, "user", f"{head} then red"), (1, 1, "user", f"{head} pay 6"), (1, 2, "assistant", f"{head} pay 5"), (1, 3, "assistant", f"{head} then blue")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = records.claim_matching(spark, str(tmp_path)).collect()
    assert sorted((r.i, r.j, r.score) for r in got) == [(0, 2, 100.0), (1, 3, 100.0)]


def test_recommendations_prefer_the_same_action():
    rec = lambda product, action, amount: {"product": product, "action": action, "amount": amount}
    gold = [rec("Growth Fund", "retain", 10.0), rec("growth fund", "redeem", None), rec("Other", "retain", 1.0)]
    pred = [rec("Growth Fund", "redeem", None), rec("Growth Fund", "insure", 10.0), rec("none", "retain", 1.0)]
    assert M.recommendation_match(pred, gold) == (2, 1)


@pytest.mark.parametrize(("hits", "n"), [(0, 10), (10, 10), (3, 20), (1, 1), (120, 400), (5, 100_000)])
def test_exact_interval(hits, n):
    low, high = M.exact_interval(hits, n)
    below = lambda p: math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)) for k in range(hits + 1))
    assert high == 1.0 if hits == n else below(high) == pytest.approx(0.025, rel=1e-6)
    if hits:
        at = math.exp(math.lgamma(n + 1) - math.lgamma(hits + 1) - math.lgamma(n - hits + 1) + hits * math.log(low) + (n - hits) * math.log1p(-low))
        assert 1 - below(low) + at == pytest.approx(0.025, rel=1e-6)
    else:
        assert low == 0.0


def test_no_trials_have_no_interval():
    assert all(map(math.isnan, M.exact_interval(0, 0)))


@pytest.mark.parametrize("dim", [256, 300])
def test_stem_buckets(spark, dim):
    """Buckets that are not zero, by plain Python; thousands of stems are no thousands of passes."""
    texts = [[], ["super", "fee"], [f"w{i}" for i in range(3000)], None]
    held = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, stems array<string>")
    rows = held.select("i", N.stem_buckets(F.col("stems"), dim).alias("b"), N.stem_embedding(F.col("stems"), dim).alias("e")).orderBy("i").collect()
    for r in rows[:3]:
        want = [0.0] * dim
        for w in texts[r.i]:
            h = int(hashlib.sha1(w.encode()).hexdigest(), 16)
            want[h % dim] += 1 if (h >> 20) % 2 == 0 else -1
        norm = math.sqrt(sum(x * x for x in want)) or 1
        assert r.e == pytest.approx([x / norm for x in want])
        assert {x.bucket: x.value for x in r.b} == pytest.approx({i: x / norm for i, x in enumerate(want) if x})
    assert rows[3].b is None


def test_names_ruled_out_are_unlike():
    """No pair that reaches the threshold is ruled out, and names with nothing in common are, without a ratio; both matchers as the plain sequence."""
    rng = random.Random(11)
    for least in (60.0, 88.0, 95.0, 100.0):
        for _ in range(3000):
            x = "".join(rng.choices("ab", k=rng.randrange(40)))
            y = "".join(c for c in x if rng.random() > 0.04) + "ba"[: rng.randrange(3)]
            assert M.may_reach(x, y, least) or fuzzy.indel_ratio(x, y) < least
    assert not M.may_reach("0123456789abcdef" * 2, "fedcba9876543210" * 2, 95.0)

    def plain(pred, gold):
        free, correct = list(range(len(gold))), 0
        for p in pred:
            same = [j for j in free if p["product"] is not None and gold[j]["product"] is not None and fuzzy.indel_ratio(M.bare_name(p["product"]), M.bare_name(gold[j]["product"])) >= 95]
            best = next((j for j in same if gold[j]["action"] == p["action"]), same[0] if same else None)
            if best is not None:
                free.remove(best)
                correct += gold[best]["action"] == p["action"] and M.agrees(p["amount"], gold[best]["amount"])
        return len(gold) - len(free), correct

    names = ["Growth Fund Number One of Ten", "growth fund  number one of ten!", "growth fund number on of ten", "other", "", "!", None]
    for _ in range(500):
        pred, gold = ([{"product": rng.choice(names), "action": rng.choice("ab"), "amount": rng.choice([1.0, 5.0, None])} for _ in range(rng.randrange(6))] for _ in range(2))
        assert M.recommendation_match(pred, gold) == plain(pred, gold)
