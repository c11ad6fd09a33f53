"""Robust multivariate outliers: minimum-covariance-determinant estimates per language and source.

Each text's statistics are turned into coordinates (``coordinates``), logarithms of rates, most of which vary
in clean text. For each language and source, each language, and all rows the estimate starts at the coordinates' medians
and quartile ranges and takes concentration steps until no determinant moves any more (a warning says so if ``MOST_STEPS`` do not reach that): the
``SUPPORT`` share of documents with the least Mahalanobis distance gives the next mean and covariance. The
share's limit is read off a histogram of log distances whose cells also hold the moments, so a step is one
job with one aggregation of at most ``CELLS`` partial rows per group and task, whatever a group's size, with sums in
place of sorted groups; how far the step moved is observed as it is written.

A group of ``n`` documents is judged by its own estimate with weight ``n / (n + PRIOR)`` and by its language's with the rest, which in
turn has weight ``n / (n + PRIOR)`` of its ``n`` documents against the estimate of all: a rule without a step, by which a
verdict moves little when a group grows. Where a coordinate hardly varies (symbols, which most clean texts have none of) its
variance would be zero and any deviation infinite; such a variance, and no other, is raised to ``SINGULAR`` of the
coordinate's plain variance over all rows.

Documents beyond ``CUTOFF``, a quantile of the squared distance of normal documents, are
rejected, and so are those that fail the base rules. Everything is DataFrame expressions; no Python
runs on the executors, and what the driver learns is a variance per coordinate and how far the last step moved.

Nulls in language or source form a group of their own. Null and empty texts have no words, fail the base
rules and are rejected, but count in no estimate. Repeated rows count as often as they occur. An empty table gives an
empty one; texts are taken whole, whatever their length. Columns of ``docs`` may have any names; only one named as the result is replaced.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, broadcast_if_small, drop_table, materialised
from .textstats import base_statistics

DIMENSIONS = ("word_length", "line_words", "marks", "variety", "symbols")
SUPPORT = 0.75
MOST_STEPS = 40
#: A step that changes no determinant's logarithm by more than twice this is the last.
MOVED = 1e-3
#: Documents at which a group's own estimate and the one above it weigh the same.
PRIOR = 200
SINGULAR = 0.05
#: Words by which each rate is smoothed, as if a text began with so many usual words: one case is a small share in short texts, too.
USUAL = 60
#: Histogram cells: eight to each doubling of the squared distance, from 2^-20 to 2^44.
CELLS = 512


def chi2_below(x: float, d: int) -> float:
    """The share of chi-square with ``d`` degrees of freedom below ``x``."""
    a, z = d / 2, x / 2
    term = total = 1 / a
    while term > 1e-16 * total:
        a += 1
        term *= z / a
        total += term
    return total * math.exp(-z + d / 2 * math.log(z) - math.lgamma(d / 2))


def chi2_quantile(p: float, d: int) -> float:
    low, high = 1e-9, 1e4
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_below(middle, d) < p else (low, middle)
    return low


#: Of a hundred thousand normal documents one is beyond it: tables are large, and clean documents are to stay.
CUTOFF = chi2_quantile(0.99999, len(DIMENSIONS))
#: Covariance of a normal sample relative to that of its nearest ``SUPPORT``.
CONSISTENCY = SUPPORT / chi2_below(chi2_quantile(SUPPORT, len(DIMENSIONS)), len(DIMENSIONS) + 2)


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


def coordinates(s: Column) -> dict[str, Column]:
    """Logarithms of rates, so that a factor counts alike at any level. Duplicate lines and repeated passages show as little variety."""
    n = s["n_words"] + F.lit(USUAL)
    return {
        "word_length": F.log((s["word_chars"] + F.lit(5 * USUAL)) / n),
        "line_words": F.log(n / (s["n_lines"] + F.lit(1))),
        "marks": F.log((s["n_marks"] + F.lit(0.15 * USUAL)) / n),
        "variety": F.log(s["n_distinct"] + F.lit(USUAL)) / F.log(n),
        "symbols": F.log1p(F.lit(20) * s["n_symbols"] / (s["n_words"] + F.lit(10))),
    }


_PAIRS = [(a, b) for i, a in enumerate(DIMENSIONS) for b in DIMENSIONS[: i + 1]]
_ESTIMATE = [*[f"m_{x}" for x in DIMENSIONS], *[f"c_{a}_{b}" for a, b in _PAIRS]]
_SUMS = {**{f"s_{x}": x for x in DIMENSIONS}, **{f"s_{a}_{b}": f"{a} * {b}" for a, b in _PAIRS}}


def factored(estimates_: DataFrame, least: dict[str, float]) -> DataFrame:
    """Adds the Cholesky factor ``l_x_y`` of the covariance, whose variances below ``least`` are raised to it; directions without variance get a thousandth of their coordinate's."""
    out = estimates_
    for i, b in enumerate(DIMENSIONS):
        rest = lambda a, start: " - ".join([start, *[f"l_{a}_{k} * l_{b}_{k}" for k in DIMENSIONS[:i]]])  # noqa: B023, E731
        variance = f"greatest(c_{b}_{b}, {least[b] + 1e-12!r}D)"
        out = out.selectExpr("*", f"sqrt(greatest({rest(b, variance)}, {variance} * 1e-3D)) AS l_{b}_{b}")
        out = out.selectExpr("*", *[f"({rest(a, f'c_{a}_{b}')}) / l_{b}_{b} AS l_{a}_{b}" for a in DIMENSIONS[i + 1 :]])
    return out


def with_distance(rows: DataFrame) -> DataFrame:
    """Adds ``d2``, the squared Mahalanobis distance, by forward substitution over the columns that ``factored`` made."""
    out = rows
    for i, a in enumerate(DIMENSIONS):
        left = " - ".join([f"{a} - m_{a}", *[f"l_{a}_{b} * z_{b}" for b in DIMENSIONS[:i]]])
        out = out.selectExpr("*", f"({left}) / l_{a}_{a} AS z_{a}")
    return out.selectExpr("*", f"{' + '.join(f'z_{a} * z_{a}' for a in DIMENSIONS)} AS d2")


#: Half the logarithm of the determinant.
_VOLUME = " + ".join(f"ln(l_{a}_{a})" for a in DIMENSIONS)


#: The key of all rows.
ALL = "*"


def _keys() -> Column:
    """The keys under which a row counts: its group's, its language's, and that of all rows. A group's tells where its language's name ends."""
    return F.array(F.concat(F.lit("g"), F.length("lang_key"), F.lit(":"), F.col("lang_key"), F.col("source_key")), F.concat(F.lit("l"), F.col("lang_key")), F.lit(ALL))


def _language_key(group: Column) -> Column:
    size = F.regexp_extract(group, "^g([0-9]+):", 1)
    return F.concat(F.lit("l"), F.substr(group, F.length(size) + F.lit(3), size.cast("int")))


def estimates(stats: DataFrame, least: dict[str, float], most_steps: int = MOST_STEPS, support: float = SUPPORT) -> DataFrame:
    """Count, location ``m_x`` and covariance ``c_x_y`` per ``key`` of ``stats`` (``lang_key``, ``source_key`` and the coordinates)."""
    rows = stats.withColumn("key", F.explode(_keys()))
    start = rows.groupBy("key").agg(F.count("*").alias("n"), *[F.expr(f"percentile(round({x}, 4), array(0.25, 0.5, 0.75)) AS {x}") for x in DIMENSIONS])
    cov = [f"pow(({a}[2] - {a}[0]) / 1.349D, 2) AS c_{a}_{a}" if a == b else f"0D AS c_{a}_{b}" for a, b in _PAIRS]
    now = materialised(factored(start.selectExpr("key", "n", *[f"{x}[1] AS m_{x}" for x in DIMENSIONS], *cov), least).selectExpr("*", f"{_VOLUME} AS volume"), "mcd")
    side = F.broadcast if now.count() <= BROADCAST_ROWS else lambda df: df  # every step has the same keys
    total = Window.partitionBy("key")
    below = total.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    for _ in range(most_steps):
        near = with_distance(rows.join(side(now.drop("n")), "key"))
        cell = F.expr(f"least(floor(log2(greatest(d2, pow(2D, -20))) * 8 + 160), {CELLS})").alias("cell")
        cells = near.groupBy("key", cell).agg(F.expr("count(*) AS n"), F.expr("first(volume) AS old"), *[F.expr(f"sum({e}) AS {c}") for c, e in _SUMS.items()])
        upto = F.coalesce(F.sum("n").over(below), F.lit(0))
        # The cell that the limit falls into counts in part, so that every step takes the same share.
        kept = cells.withColumn("of", F.sum("n").over(total)).withColumn("part", F.least(F.lit(1.0), (F.lit(support) * F.col("of") - upto) / F.col("n"))).where("part > 0")
        sums = kept.groupBy("key").agg(F.expr("first(of) AS of"), F.expr("first(old) AS old"), *[F.expr(f"sum(part * {c}) AS {c}") for c in ("n", *_SUMS)])
        cov = [f"s_{a}_{b} / n - s_{a} * s_{b} / n / n AS c_{a}_{b}" for a, b in _PAIRS]
        found = factored(sums.selectExpr("key", "of AS n", "old", *[f"s_{x} / n AS m_{x}" for x in DIMENSIONS], *cov), least)
        moved = Observation()
        found = found.selectExpr("*", f"{_VOLUME} AS volume").observe(moved, F.expr("max(abs(volume - old)) AS most"))
        last, now = now, materialised(found.drop("old"), "mcd")
        drop_table(last)
        if (moved.get["most"] or 0) <= MOVED:
            break
    else:
        if most_steps:
            warnings.warn(f"estimates still moved after {most_steps} steps", stacklevel=2)
    return now.selectExpr("key", "n", *[f"m_{x}" for x in DIMENSIONS], *[f"c_{a}_{b} * {CONSISTENCY!r}D AS c_{a}_{b}" for a, b in _PAIRS])


def _shrunk(own: DataFrame, above: DataFrame, parent: Column, prior: float) -> DataFrame:
    """``own`` estimates drawn towards those of ``above`` that ``parent`` names, by their number of documents."""
    named = broadcast_if_small(above.selectExpr("key AS parent", *[f"{c} AS a_{c}" for c in _ESTIMATE]))
    mixed = [f"(n * {c} + {float(prior)!r}D * a_{c}) / (n + {float(prior)!r}D) AS {c}" for c in _ESTIMATE]
    return own.withColumn("parent", parent).join(named, "parent").selectExpr("key", "n", *mixed)


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep: tuple[str, ...] | None = None, cutoff: float = CUTOFF, prior: float = PRIOR, out: str = "quality") -> DataFrame:
    """``docs`` with the struct ``out``: the base statistics, ``base_failed``, ``distance`` and ``kept``.

    ``keep`` names the columns of ``docs`` to return, all of them by default. An existing column named as ``out`` is replaced.
    """
    held = F.struct(*[F.col(c) for c in keep]) if keep else F.struct("*")
    name = lambda c: F.when(F.col(c).isNull(), F.lit("n")).otherwise(F.concat(F.lit("="), F.col(c).cast("string")))
    rows = materialised(docs.select(held.alias("row"), name(lang).alias("lang_key"), name(source).alias("source_key"), base_statistics(F.col(text)).alias("s")), "stats")
    placed = rows.select("row", "lang_key", "source_key", "s", base_failed(F.col("s")).alias("failed"), *[c.cast("double").alias(x) for x, c in coordinates(F.col("s")).items()])
    fit = materialised(placed.where(~F.col("failed")).select("lang_key", "source_key", *DIMENSIONS), "fit")
    variances = fit.agg(*[F.var_pop(x).alias(x) for x in DIMENSIONS]).first()
    least = {x: SINGULAR * (variances[x] or 0.0) for x in DIMENSIONS}
    found = estimates(fit, least)
    of = lambda mark: found.where(F.col("key").startswith(mark))
    langs = _shrunk(of("l"), of(ALL), F.lit(ALL), prior)
    groups = _shrunk(of("g"), langs, _language_key(F.col("key")), prior)
    known = materialised(factored(groups.drop("n"), least).drop(*[f"c_{a}_{b}" for a, b in _PAIRS]), "known")
    both = placed.withColumn("key", F.element_at(_keys(), 1)).join(broadcast_if_small(known), "key", "left")
    d2 = with_distance(both)
    keeps = ~F.col("failed") & F.coalesce(F.col("d2") <= F.lit(cutoff), F.lit(True))
    quality = F.struct("s.n_words", "s.word_chars", "s.n_symbols", "s.n_dup_lines", "s.n_repeat_words", F.col("failed").alias("base_failed"), F.col("d2").alias("distance"), keeps.alias("kept"))
    columns = [c for c in rows.schema["row"].dataType.names if c.lower() != out.lower()]
    return d2.select(*[F.col("row")[c].alias(c) for c in columns], quality.alias(out))
