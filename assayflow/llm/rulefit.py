"""A sparse rule ensemble for text quality: boosted trees give rules, the lasso picks them, Spark scores them.

Statistics of whole texts are native columns (``features``). Shallow gradient-boosted trees are grown on
a sample of labelled rows; every path from a root to a node is a conjunctive rule. A logistic model with an L1
penalty over the rules keeps few of them, and these are compiled into one column expression: a
sum of weights of the rules that hold, through the logistic function. Scoring is a projection without a shuffle.

Only the fit is bounded: ``TRAIN_ROWS`` labelled rows at most, those of least id hash, so the sample
does not depend on partitions. Rows without a label, id or matching document are not learnt from. Without
labels of both classes the score is the constant ``(positives + 1) / (rows + 2)``. Null and empty texts get
a score like any other. Repeated documents are scored row by row; a label counts once for an id, with its text of
the least hash. An empty table gives an empty one, texts are taken whole, and other columns may have any names but ``out``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import count_chars, let, words_of

TRAIN_ROWS = 20_000
TREES = 24
DEPTH = 3
RATE = 0.2
L1 = 0.002
CUTS = 48
THRESHOLD = 0.3
FOLDS = 5


def features(text: Column) -> Column:
    """A struct of doubles; every value is finite and non-null."""

    def made(x: Column) -> Column:
        t, w = x["t"], x["w"]
        n, chars = F.size(w).cast("double"), F.length(t).cast("double")
        per_word = lambda c: c / (n + F.lit(1.0))
        follow = F.size(F.filter(w, lambda v, i: (i > 0) & (v == F.get(w, F.greatest(i - 1, F.lit(0))))))
        lines = F.filter(F.split(t, "\n"), lambda line: line != "")
        dup = let(lines, lambda v: (F.size(v) - F.size(F.array_distinct(v))) / (F.size(v) + F.lit(1.0)))
        digits = F.length(t) - F.length(F.regexp_replace(t, "[0-9]+", ""))
        upper = F.length(t) - F.length(F.regexp_replace(t, "[A-Z]+", ""))
        return F.struct(
            F.log1p(n).alias("log_words"), per_word(chars).alias("chars_per_word"), per_word(count_chars(t, "#*$%&<>")).alias("symbols"),
            per_word(count_chars(t, "|")).alias("bars"), per_word(count_chars(t, "!?")).alias("marks"), (upper / (chars + F.lit(1.0))).alias("upper"),
            (digits / (chars + F.lit(1.0))).alias("digits"), per_word(F.size(F.array_distinct(w)).cast("double")).alias("distinct"),
            per_word(follow.cast("double")).alias("repeats"), dup.alias("dup_lines"),
        )

    return let(F.struct(F.coalesce(text, F.lit("")).alias("t"), words_of(text).alias("w")), made)


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


@dataclass(frozen=True)
class Rule:
    """All of ``(feature, above, cut)``: the feature is above the cut, or not."""

    terms: tuple[tuple[str, bool, float], ...]
    weight: float = 0.0

    def column(self, f: Column) -> Column:
        out = F.lit(True)
        for name, above, cut in self.terms:
            out = out & (f[name] > F.lit(cut) if above else f[name] <= F.lit(cut))
        return out

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return np.logical_and.reduce([(x[n] > c) == above for n, above, c in self.terms])


@dataclass(frozen=True)
class RuleModel:
    bias: float
    rules: tuple[Rule, ...]

    def column(self, f: Column) -> Column:
        total = F.lit(float(self.bias))
        for rule in self.rules:
            total = total + F.when(rule.column(f), F.lit(float(rule.weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score(self, x: dict[str, np.ndarray]) -> np.ndarray:
        total = self.bias + sum((r.weight * r.holds(x) for r in self.rules), np.zeros(len(next(iter(x.values())))))
        return 1 / (1 + np.exp(-total))


def binned(data: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Per column at most ``CUTS`` cuts between its values, and each value's number of cuts below it."""
    cuts = []
    for column in data.T:
        values = np.unique(column)
        middle = (values[1:] + values[:-1]) / 2
        cuts.append(middle if len(middle) <= CUTS else np.unique(np.quantile(middle, np.linspace(0, 1, CUTS))))
    return cuts, np.column_stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, data.T, strict=True)])


def grow(x: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], residual: np.ndarray, hess: np.ndarray, depth: int) -> tuple[list, list, np.ndarray]:
    """Grows one tree; returns the paths to its nodes, its leaves as (path, value), and its prediction."""
    paths, leaves, out = [], [], np.zeros(len(residual))
    todo = [(np.arange(len(residual)), ())]
    for level in range(depth + 1):
        following = []
        for rows, path in todo:
            if path:
                paths.append(path)
            g, h = residual[rows], hess[rows]
            best = (1e-6, None)
            if level < depth and len(rows) >= 20:
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    gs = np.bincount(bins[rows, j], g, len(c) + 1).cumsum()[:-1]
                    hs = np.bincount(bins[rows, j], h, len(c) + 1).cumsum()[:-1]
                    ns = np.bincount(bins[rows, j], minlength=len(c) + 1).cumsum()[:-1]
                    gain = gs**2 / (hs + 1) + (g.sum() - gs) ** 2 / (h.sum() - hs + 1) - g.sum() ** 2 / (h.sum() + 1)
                    gain[(ns < 5) | (len(rows) - ns < 5)] = -1
                    if gain.max() > best[0]:
                        best = (gain.max(), (j, int(gain.argmax())))
            if best[1] is None:
                out[rows] = value = g.sum() / (h.sum() + 1)
                leaves.append((path, value))
                continue
            j, k = best[1]
            left = bins[rows, j] <= k
            following += [(rows[left], (*path, (j, False, k))), (rows[~left], (*path, (j, True, k)))]
        todo = following
    return paths, leaves, out


def _lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty on all but the bias, by accelerated proximal gradient."""
    w, b = np.zeros(r.shape[1]), float(np.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9)))
    v, c, t = w.copy(), b, 1.0
    lipschitz = 0.25 * (np.linalg.norm(r.T @ r / len(y), 2) + 1) if r.shape[1] else 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(r @ v + c)))
        w1 = v - r.T @ (p - y) / len(y) / lipschitz
        w1 = np.sign(w1) * np.maximum(np.abs(w1) - penalty / lipschitz, 0)
        b1 = c - (p - y).mean() / lipschitz
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w1 + (t - 1) / t1 * (w1 - w), b1 + (t - 1) / t1 * (b1 - b)
        w, b, t = w1, b1, t1
    return b, w


def fit(x: dict[str, np.ndarray], y: np.ndarray, trees: int = TREES, depth: int = DEPTH, l1: float = L1) -> RuleModel:
    """Fits rules to features and 0/1 labels."""
    y = np.asarray(y, float)
    if len(y) == 0 or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return RuleModel(float(np.log(p / (1 - p))), ())
    names = list(x)
    data = np.column_stack([np.asarray(x[n], float) for n in names])
    cuts, bins = binned(data)
    score = np.full(len(y), np.log(y.mean() / (1 - y.mean())))
    found: dict[tuple, None] = {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        paths, _, out = grow(data, bins, cuts, y - p, p * (1 - p), depth)
        score += RATE * out
        found |= {tuple(sorted(path)): None for path in paths}
    rules = [Rule(tuple((names[j], above, float(cuts[j][k])) for j, above, k in path)) for path in found]
    held = {n: data[:, j] for j, n in enumerate(names)}
    columns: dict[bytes, Rule] = {}
    for rule in rules:
        h = rule.holds(held)
        if h.any() and not h.all():
            columns.setdefault(h.tobytes(), rule)
    matrix = np.column_stack([np.frombuffer(h, bool) for h in columns]).astype(float) if columns else np.zeros((len(y), 0))
    bias, weights = _lasso(matrix, y, l1)
    return RuleModel(bias, tuple(Rule(r.terms, float(w)) for r, w in zip(columns.values(), weights, strict=True) if abs(w) > 1e-6))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", rows: int = TRAIN_ROWS) -> RuleModel:
    """Learns from at most ``rows`` labelled documents outside the held-out fold 0."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    known = known.where(fold(F.col("id")) != 0).orderBy(F.xxhash64("id"), "id", "y").limit(rows)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).alias("t"))
    # One text per id and label, however often the id occurs: that of the least hash.
    one = texts.join(F.broadcast(known), "id").groupBy("id", "y").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t")).alias("m"))
    sample = one.select("y", features(F.col("m.t")).alias("f")).select("y", "f.*").toPandas()
    names = [c for c in sample.columns if c != "y"]
    order = sample.sort_values(list(sample.columns), ignore_index=True)  # sums in one order give one model
    return fit({n: order[n].to_numpy() for n in names}, order["y"].to_numpy())


def scored(docs: DataFrame, model: RuleModel, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the column ``out``; one of that name is replaced."""
    held = docs.select(F.struct("*").alias("row"), features(F.col(text)).alias("f"))
    names = [c for c in docs.columns if c != out]
    return held.select(*[F.col("row")[c].alias(c) for c in names], model.column(F.col("f")).alias(out))
