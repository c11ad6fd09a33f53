"""Exact quantiles of groups of any size: a mergeable sketch brackets each rank, and only the rows between its ends are put in order.

``percentile`` holds all distinct values of a group in one task; here a task holds a few ten-thousandths of them. Values are interpolated as
``percentile`` does. The sketch's promise is checked by counting; if a rank were outside, the bracket is widened.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000


def keyed(rows: DataFrame, by: list[str]) -> DataFrame:
    """Adds ``key_``, one text for each group, null keys included."""
    key = F.to_json(F.struct(*by), {"ignoreNullFields": "false"}) if by else F.lit("")
    return rows.withColumn("key_", key)


def quantiles(rows: DataFrame, by: list[str], column: str, shares: dict[str, float], accuracy: int = ACCURACY, margin: float | None = None) -> DataFrame:
    """Per group (``key_``, as ``keyed`` gives it) a column per name of ``shares``: that share's quantile of ``column``. Nulls do not count; a group without values has no row."""
    margin = 2 / accuracy if margin is None else margin
    held = keyed(rows, by).select("key_", F.col(column).cast("double").alias("x")).where("x IS NOT NULL")
    ends = [min(1.0, max(0.0, q + d)) for q in shares.values() for d in (-margin, margin)]
    spans = held.groupBy("key_").agg(F.count("*").alias("n"), F.percentile_approx("x", ends, accuracy).alias("e"))
    wanted = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(q)).alias("q"), F.get("e", F.lit(2 * i)).alias("low"), F.get("e", F.lit(2 * i + 1)).alias("high")) for i, (n, q) in enumerate(shares.items())])
    place = F.col("q") * (F.col("n") - 1)
    targets = spans.select("key_", "n", F.inline(wanted)).withColumns({"p": place, "r0": F.floor(place), "r1": F.ceil(place)})
    rows_ = held.join(targets, "key_")
    inside = F.col("x").between(F.col("low"), F.col("high"))
    near = rows_.where(inside).groupBy("key_", "name", "x").agg(F.count("*").alias("c"))
    counts = rows_.groupBy("key_", "name").agg(F.count_if(F.col("x") < F.col("low")).alias("below"), F.count_if(inside).alias("inside"), *[F.first(c).alias(c) for c in ("p", "r0", "r1")])
    if margin < 1 and counts.where("below > r0 OR below + inside <= r1").limit(1).count():
        return quantiles(rows, by, column, shares, accuracy, min(1.0, 16 * max(margin, 1 / accuracy)))
    upto = F.sum("c").over(Window.partitionBy("key_", "name").orderBy("x"))
    ranked = near.withColumn("upto", upto).join(counts, ["key_", "name"])
    at = lambda r: F.min(F.when(F.col("below") + F.col("upto") > F.col(r), F.col("x")))
    found = ranked.groupBy("key_", "name").agg(at("r0").alias("v0"), at("r1").alias("v1"), F.first(F.col("p") - F.col("r0")).alias("part"))
    value = F.col("v0") + (F.col("v1") - F.col("v0")) * F.col("part")
    return found.groupBy("key_").agg(*[F.max(F.when(F.col("name") == n, value)).alias(n) for n in shares])
