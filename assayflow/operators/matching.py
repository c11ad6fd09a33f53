"""One-to-one matching of predicted with true items, precision and recall of lists, exact binomial intervals.

Matching works on the lists of one record, which its schema bounds; records are spread over the cluster.
"""

from __future__ import annotations

import math
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as t

from ..functions import fuzzy

_SPACE, _OTHER = re.compile("[ \t\n\r]+"), re.compile("[^a-z0-9 ]")


def claim_pairs(pred: list[Any], gold: list[Any], least: float) -> list[dict]:
    """The best-scored pairs first, each item once. Items are (text, owner, facts); facts are the numbers and dates that must agree, and a null owner agrees with any."""
    free_i, free_j, out = set(range(len(pred))), set(range(len(gold))), []
    a, b = ([(x["text"].lower(), frozenset(x["text"].lower().split()), list(x["facts"]), x["owner"]) for x in side] for side in (pred, gold))

    def take(score: float, i: int, j: int) -> None:
        if i in free_i and j in free_j:
            free_i.remove(i)
            free_j.remove(j)
            out.append({"i": i, "j": j, "score": score})

    def allowed() -> list[tuple[int, int]]:
        free = sorted(free_j)
        return [(i, j) for i in sorted(free_i) for j in free if a[i][2] == b[j][2] and (a[i][3] is None or b[j][3] is None or a[i][3] == b[j][3])]

    # Words that all stand in the other's score 100, and nothing else does: these go first, and no ratio of an item they take is needed.
    for i, j in allowed() if least <= 100 else ():
        x, y = a[i][1], b[j][1]
        if x and y and (x <= y or y <= x):
            take(100.0, i, j)
    scored = [(-fuzzy.token_set_ratio(a[i][0], b[j][0]), i, j) for i, j in allowed()]
    for score, i, j in sorted(s for s in scored if -s[0] >= least):
        take(-score, i, j)
    return out


def match_claims(pred: Column, gold: Column, least: float = 80.0) -> Column:
    """Array of (i, j, score) for arrays of (text, owner, facts)."""

    @F.pandas_udf("array<struct<i:int,j:int,score:double>>")
    def run(ps: pd.Series, gs: pd.Series) -> pd.Series:
        return pd.Series([claim_pairs(list(p) if p is not None else [], list(g) if g is not None else [], least) for p, g in zip(ps, gs, strict=True)], dtype="object")

    return run(pred, gold)


def agrees(a: float | None, b: float | None) -> bool:
    """As ``text.numbers_match``."""
    return a is b if a is None or b is None else abs(a - b) <= max(1.0, abs(b) * 0.005)


def bare_name(n: str | None) -> str | None:
    """A name as ``text.normal_name`` gives it."""
    return None if n is None else _OTHER.sub("", _SPACE.sub(" ", n.lower()).strip(" "))


def may_reach(x: str, y: str, least: float) -> bool:
    """False only for texts whose ratio is below ``least``: characters of either that no common subsequence of the length needed has spoil a piece each,
    so of one piece more than these one must stand whole in the other text."""
    need = math.ceil(least * (len(x) + len(y)) / 200 - 1e-9)
    if need > min(len(x), len(y)):
        return False
    pieces = len(x) + len(y) - 2 * need + 1
    cuts = [len(x) * i // pieces for i in range(pieces + 1)]
    return any(x[i:j] in y for i, j in zip(cuts, cuts[1:]))


def _first_alike(keys: list[tuple], least: float):
    """The free truths that are alike in all names, in their order: ``alike(names)`` yields places, equal ones found without a comparison; ``take(j)`` removes one.

    ``keys`` are tuples of bare names. Of unlike names the ratio is taken only where ``may_reach`` does not rule it out, and of each distinct pair once.
    """
    free, seen = dict.fromkeys(range(len(keys))), {}

    def near(x: str | None, y: str | None) -> bool:
        if x is None or y is None:
            return False
        if x == y:
            return True
        if (x, y) not in seen:
            seen[x, y] = may_reach(x, y, least) and fuzzy.indel_ratio(x, y) >= least
        return seen[x, y]

    def alike(names: tuple):
        return (j for j in list(free) if all(near(x, y) for x, y in zip(names, keys[j], strict=True)))

    return free, alike


def recommendation_match(pred: list[Any], gold: list[Any], least: float = 95.0) -> tuple[int, int]:
    """(matched, correct): each prediction in turn takes a free truth of its product, if possible of its action."""
    correct = 0
    free, alike = _first_alike([(bare_name(g["product"]),) for g in gold], least)
    for p in pred:
        best = None
        for j in alike((bare_name(p["product"]),)):
            if gold[j]["action"] == p["action"]:
                best = j
                break
            best = j if best is None else best
        if best is not None:
            del free[best]
            correct += gold[best]["action"] == p["action"] and agrees(p["amount"], gold[best]["amount"])
    return len(gold) - len(free), correct


@F.pandas_udf(t.StructType([t.StructField("matched", t.IntegerType()), t.StructField("correct", t.IntegerType())]))
def match_recommendations(pred: pd.Series, gold: pd.Series) -> pd.DataFrame:
    """For arrays of (product, action, amount)."""
    rows = [recommendation_match(list(p) if p is not None else [], list(g) if g is not None else []) for p, g in zip(pred, gold, strict=True)]
    return pd.DataFrame(rows, columns=["matched", "correct"])


def replacement_match(pred: list[Any], gold: list[Any], least: float = 95.0) -> tuple[int, int]:
    """(matched, correct): each prediction in turn takes the first free truth whose old and new product are both its own. A null product matches none."""
    correct = 0
    free, alike = _first_alike([(bare_name(g["old"]), bare_name(g["new"])) for g in gold], least)
    for p in pred:
        best = next(alike((bare_name(p["old"]), bare_name(p["new"]))), None)
        if best is not None:
            del free[best]
            correct += agrees(p["fee"], gold[best]["fee"]) and p["impact"] == gold[best]["impact"]
    return len(gold) - len(free), correct


@F.pandas_udf(t.StructType([t.StructField("matched", t.IntegerType()), t.StructField("correct", t.IntegerType())]))
def match_replacements(pred: pd.Series, gold: pd.Series) -> pd.DataFrame:
    """For arrays of (old, new, fee, impact)."""
    rows = [replacement_match(list(p) if p is not None else [], list(g) if g is not None else []) for p, g in zip(pred, gold, strict=True)]
    return pd.DataFrame(rows, columns=["matched", "correct"])


def list_scores(n_pred: Column, n_gold: Column, correct: Column) -> tuple[Column, Column, Column]:
    """(precision, recall, F1) of a list; an empty side scores 1 if the other is empty too, else 0."""
    share = lambda n, other: F.when(n > 0, correct / n).when(other == 0, 1.0).otherwise(0.0)
    p, r = share(n_pred, n_gold), share(n_gold, n_pred)
    return p, r, F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))


def at_least(k: int, n: int, p: float) -> float:
    """The chance of ``k`` or more hits in ``n``: the sum over its greatest terms, outwards from the most likely count."""
    if k <= 0 or p >= 1:
        return 1.0
    if p <= 0:
        return 0.0
    log = lambda x: math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) + x * math.log(p) + (n - x) * math.log1p(-p)
    top = min(n, int((n + 1) * p))
    upper = k > top
    x, total = (k if upper else k - 1), 0.0
    term, step = math.exp(log(x)), 1 if upper else -1
    while 0 <= x <= n and term > 1e-18 * total:
        total += term
        term *= (n - x) / (x + 1) * p / (1 - p) if upper else x / (n - x + 1) * (1 - p) / p
        x += step
    return total if upper else 1.0 - total


def exact_interval(hits: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Clopper-Pearson by bisection; not a number for ``n`` = 0."""
    if n == 0:
        return math.nan, math.nan
    tail = (1 - level) / 2

    def where(k: int, chance: float) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if at_least(k, n, mid) < chance else (lo, mid)
        return (lo + hi) / 2

    return where(hits, tail) if hits else 0.0, where(hits + 1, 1 - tail) if hits < n else 1.0


@F.pandas_udf(t.StructType([t.StructField("low", t.DoubleType()), t.StructField("high", t.DoubleType())]))
def binomial_interval(hits: pd.Series, n: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([exact_interval(int(a), int(b)) for a, b in zip(hits, n, strict=True)], columns=["low", "high"])
