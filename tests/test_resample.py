"""Bootstraps and exact tails against plain computations."""

from __future__ import annotations

import hashlib
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayflow.operators import decisions as D
from assayflow.operators import matching, resample

POISSON = [math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) for k in range(8)]


def weight_slow(seed, key, draw):
    part = hashlib.md5(f"{seed}|{key}|{draw // 4}".encode()).hexdigest()[draw % 4 * 8 :][:8]
    return sum(int(part, 16) >= int(p * 2**32) for p in POISSON)


def interval_slow(rows, statistic, draws, seed="0"):
    """rows: key, sums; returns point, low, high, share above 0."""
    sums = lambda w: [sum(w(k) * v[i] for k, v in rows) for i in range(len(rows[0][1]))]
    drawn = [statistic(*sums(lambda k: weight_slow(seed, k, d))) for d in range(draws)]  # noqa: B023
    drawn = [x for x in drawn if x is not None]
    return statistic(*sums(lambda k: 1)), *np.quantile(drawn, [0.025, 0.975]), np.mean([x > 0 for x in drawn])


def test_interval_of_a_ratio(spark):
    rng = random.Random(2)
    rows = [(g, rng.randrange(40), rng.gauss(0.2, 1), rng.random()) for g in "ab" for _ in range(150)]
    table = spark.createDataFrame(rows, "g string, key int, x double, y double").repartition(5)
    got = {r.g: r for r in resample.interval(table, "key", {"a": "x", "b": "y"}, "a / nullif(b, 0)", ("g",), draws=50).collect()}
    for g in "ab":
        own = [(k, (x, y)) for h, k, x, y in rows if h == g]
        want = interval_slow(own, lambda a, b: a / b if b else None, 50)
        assert [got[g][c] for c in ("point", "low", "high", "positive")] == pytest.approx(want), g


def test_interval_without_spread(spark):
    table = spark.createDataFrame([("one", 1, 2.0), ("one", 1, 4.0), ("none", 2, None), ("none", 3, None)], "g string, key int, x double")
    mean = resample.interval(table, "key", {"s": "x", "n": "IF(x IS NOT NULL, 1, 0)"}, "s / nullif(n, 0)", ("g",), draws=8)
    got = {r.g: tuple(r)[1:] for r in mean.collect()}
    assert got == {"one": (3.0, 3.0, 3.0, 1.0), "none": (None, None, None, None)}
    assert tuple(resample.interval(table.limit(0), "key", {"s": "x"}, "s", draws=8).first()) == (None, None, None, None)


def test_paired_verdicts_of_resampling(spark):
    rows = [(g, i, 0.5 + d + i % 7 / 50, 0.5 + i % 5 / 50) for g, d in (("up", 0.2), ("down", -0.3), ("same", 0.0)) for i in range(60)] + [("up", 99, None, 1.0)]
    got = {r.g: r for r in resample.paired(spark.createDataFrame(rows, "g string, i int, cand double, base double"), "i", ("g",), draws=100).collect()}
    assert {g: r.verdict for g, r in got.items()} == {"up": "better", "down": "worse", "same": "better" if got["same"].low > 0 else "non-inferior"}
    assert got["up"].n == 60 and got["up"].wins == 60 and got["up"].p_better == 1.0 and got["down"].p_better == 0.0


def exact(w, n):
    m = min(w, n - w)
    return min(1.0, 2 * sum(math.comb(n, k) for k in range(m + 1)) / 2**n)


def test_mcnemar_of_many_pairs(spark):
    pairs = [(0, 0), (0, 1), (1, 0), (5, 5), (3, 12), (200, 150), (500, 500), (1000, 1100), (10, 900), (2000, 1990)]
    got = spark.createDataFrame(pairs, "w long, l long").select(D.mcnemar(F.col("w"), F.col("l")).alias("p")).collect()
    for (w, l), r in zip(pairs, got, strict=True):
        assert r.p == pytest.approx(exact(w, w + l) if w + l else 1.0, rel=1e-6), (w, l)
    million = spark.createDataFrame([(500_500, 499_500)], "w long, l long").select(D.mcnemar(F.col("w"), F.col("l")).alias("p"))
    began = time.perf_counter()
    p = million.first().p
    assert time.perf_counter() - began < 20 and p == pytest.approx(math.erfc(999 / 1000 / math.sqrt(2)), rel=1e-3)


def test_log_gamma(spark):
    x = [1.0, 1.5, 2.0, 10.0, 170.0, 1e6]
    got = spark.createDataFrame([(v,) for v in x], "x double").select(D.log_gamma(F.col("x")).alias("y")).collect()
    assert [r.y for r in got] == pytest.approx([math.lgamma(v) for v in x], abs=1e-9, rel=1e-11)


def test_tail_of_very_many():
    began = time.perf_counter()
    assert matching.at_least(10**9 + 40_000, 10**10, 0.1) == pytest.approx(0.5 * math.erfc(40_000 / 30_000 / math.sqrt(2)), rel=1e-3)
    assert time.perf_counter() - began < 2
