"""Unified diffs: hunks rebuild the other text, and no script is shorter."""

from __future__ import annotations

import random
import re
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from assayflow.functions import diff
from assayflow.functions import text as T


def common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row
        row = [0]
        for j, y in enumerate(b):
            row.append(old[j] + 1 if x == y else max(old[j + 1], row[-1]))
    return row[-1]


def patched(a, hunks):
    """``a`` after the hunks, by their headers."""
    out, at = [], 0
    for line in hunks:
        if m := re.fullmatch(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", line):
            start = int(m[1]) - (m[2] != "0")
            out += a[at:start]
            at = start
        elif line[0] == "+":
            out.append(line[1:])
        else:
            assert a[at] == line[1:]
            out += [line[1:]] if line[0] == " " else []
            at += 1
    return out + a[at:]


def test_hunks():
    rng = random.Random(1)
    for _ in range(600):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(25))] for _ in range(2))
        if rng.random() < 0.5:
            b = [x for x in a if rng.random() < 0.9]
        for context in (0, 1, 3):
            got = diff.hunks(a, b, context)
            assert patched(a, got) == b, (a, b, got)
            assert sum(x[0] in "+-" for x in got) == len(a) + len(b) - 2 * common(a, b)
    assert diff.hunks(["x"], ["x"]) == [] and diff.hunks([], []) == [] and diff.hunks([], ["a"]) == ["@@ -0,0 +1 @@", "+a"]
    assert diff.hunks(list("abcdefgh"), list("abcXefgh"), 1) == ["@@ -3,3 +3,3 @@", " c", "-d", "+X", " e"]


def test_unified(spark):
    rows = [("a\nb", "a\nc"), (None, "x"), ("same", "same"), ("", None)]
    got = spark.createDataFrame(rows, "a string, b string").select(diff.unified(F.col("a"), F.col("b")).alias("d")).select("d.*").collect()
    assert [tuple(r) for r in got] == [("@@ -1,2 +1,2 @@\n a\n-b\n+c", 2), ("@@ -0,0 +1 @@\n+x", 1), ("", 0), ("", 0)]


def test_digest_of_a_set(spark):
    """No order, but any change: also one that leaves the sum of the rows' hashes as it was."""
    of = lambda values: spark.createDataFrame([(v,) for v in values], "h string").select(T.set_digest(F.col("h")).alias("d")).first().d
    low, high = f"{5:08x}" * 8, f"{9:08x}" * 8
    assert of([low, high]) == of([high, low]) != of([f"{7:08x}" * 8] * 2)
    assert of([low]) != of([low, low]) and of([]) != of([f"{0:08x}" * 8])


def test_names_match(spark):
    rows = [("Ann  Lee", "ann lee!", True), (None, "", True), (None, "x", False), ("", "", True), ("a", "b", False)]
    table = spark.createDataFrame([r[:2] for r in rows], "a string, b string")
    assert [r.m for r in table.select(T.names_match(F.col("a"), F.col("b")).alias("m")).collect()] == [r[2] for r in rows]
    lists = spark.createDataFrame([(["Bo", "Al!"], ["al", "BO"]), (["a", "a"], ["a"]), (None, [])], "a array<string>, b array<string>")
    assert [r.m for r in lists.select(T.name_lists_match(F.col("a"), F.col("b")).alias("m")).collect()] == [True, False, True]


def test_memory_of_many_edits_and_texts():
    """The way back keeps a number for each diagonal it may ask for, and texts of a batch are not all objects at once."""
    a, b = [f"a{i}" for i in range(700)], [f"b{i}" for i in range(700)]
    texts = pa.array(["\n".join(f"line {i} of {k}" for i in range(40)) for k in range(2000)])
    edited = pa.array([None if k % 100 == 0 else t.as_py() + " x" for k, t in enumerate(texts)])
    tracemalloc.start()
    steps = diff.script(a, b)
    first = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    found = diff.changes(texts, edited)
    second = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(steps) == 1400 and first < 16_000_000
    assert found.field("changed").to_pylist() == [40 if k % 100 == 0 else 2 for k in range(2000)] and second < 3_000_000
