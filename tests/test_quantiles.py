"""Exact quantiles against numpy, where sketches, ties, outliers and nulls could go wrong."""

from __future__ import annotations

import random

import numpy as np
import pytest

from assayflow.operators import quantiles as Q


@pytest.mark.parametrize(("accuracy", "margin"), [(10_000, None), (10, None), (4, 0.0), (100, 0.001)])
def test_quantiles(spark, accuracy, margin):
    rng = random.Random(accuracy)
    values = {"many": [rng.lognormvariate(0, 3) for _ in range(3000)], "ties": [rng.randrange(4) for _ in range(500)], "one": [7.5], "two": [1.0, 2.0], "odd": [-1e300, 0.0, 1e-300, 1e300], None: [3.0, 1.0]}
    rows = [(k, float(x)) for k, v in values.items() for x in v] + [("many", None), ("none", None)]
    rng.shuffle(rows)
    shares = {"low": 0.0, "q1": 0.25, "mid": 0.5, "p95": 0.95, "p999": 0.999, "top": 1.0}
    table = spark.createDataFrame(rows, "g string, x double").repartition(7)
    got = {r.key_: r for r in Q.quantiles(table, ["g"], "x", shares, accuracy, margin).collect()}
    keys = {r.g: r.key_ for r in Q.keyed(table, ["g"]).select("g", "key_").distinct().collect()}
    assert set(got) == {keys[k] for k in values}
    for k, v in values.items():
        for name, q in shares.items():
            assert got[keys[k]][name] == pytest.approx(np.quantile(v, q), rel=1e-12), (k, name)


def test_quantiles_of_all(spark):
    table = spark.range(0, 1001, 1, 3).selectExpr("id * 2 AS x")
    assert tuple(Q.quantiles(table, [], "x", {"p95": 0.95}).first()) == ("", 1900.0)
    assert Q.quantiles(table.limit(0), [], "x", {"p95": 0.95}).collect() == []
