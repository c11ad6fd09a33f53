"""Bootstrap of any statistic of sums: paired deltas, ratios, differences of cohorts.

A row (or a whole cluster, by the key given) has a Poisson(1) weight in each replicate, taken from a hash of seed, key and
replicate; so a result depends on no order or partition, and all replicates are one aggregation whose partial sums are
combined before the shuffle. A statistic is an expression over the sums; a replicate in which it is null (an empty cohort) is
left out of the interval. Every hash serves four replicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The Poisson(1) distribution function at 0, 1, ... as 32-bit fractions in hex: a weight is how many of these a hash reaches.
_REACH = [f"{int(p * 2**32):08x}" for p in (0.36787944117, 0.73575888234, 0.91969860293, 0.98101184312, 0.99634015317, 0.99940581518, 0.99991675885, 0.99998975077)]


def weight_sql(digest: str, place: str) -> str:
    """The weight at ``place`` (0 to 3) of an MD5 in hex, as SQL that either engine reads."""
    part = f"substr({digest}, {place} * 8 + 1, 8)"
    return "(" + " + ".join(f"CASE WHEN {part} >= '{r}' THEN 1 ELSE 0 END" for r in _REACH) + ")"


def replicates(rows: DataFrame, key: str, sums: dict[str, str], by: tuple[str, ...] = (), draws: int = 400, seed: str = "0") -> DataFrame:
    """Per group and replicate the weighted sums of the SQL expressions ``sums``; nulls count as 0."""
    held = rows.select(*by, F.expr(f"CAST({key} AS STRING)").alias("key_"), *[F.expr(f"coalesce(CAST({e} AS DOUBLE), 0D)").alias(n) for n, e in sums.items()])
    each = held.groupBy(*by, "key_").agg(*[F.sum(n).alias(n) for n in sums]).withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(-(-draws // 4) - 1))))
    each = each.withColumn("digest", F.md5(F.concat_ws("|", F.lit(seed), "key_", "lot")))
    each = each.select(*by, "lot", *sums, *[F.expr(weight_sql("digest", str(j))).alias(f"w{j}") for j in range(4)])
    totals = each.groupBy(*by, "lot").agg(*[F.sum(F.col(f"w{j}") * F.col(n)).alias(f"{n}_{j}") for j in range(4) for n in sums])
    parts = F.array(*[F.struct((F.col("lot") * 4 + j).alias("draw"), *[F.col(f"{n}_{j}").alias(n) for n in sums]) for j in range(4)])
    return totals.select(*by, F.inline(parts)).where(F.col("draw") < draws)


def interval(rows: DataFrame, key: str, sums: dict[str, str], statistic: str, by: tuple[str, ...] = (), draws: int = 400, level: float = 0.95, seed: str = "0") -> DataFrame:
    """Per group: ``point``, ``low`` and ``high`` of ``statistic`` (SQL over the names of ``sums``), and ``positive``, the share of replicates above 0.

    Rows are resampled by ``key``, which names a row, or a cluster that stays together. A group of one key has its point for both ends; without
    rows all are null.
    """
    tail = (1 - level) / 2
    drawn = replicates(rows, key, sums, by, draws, seed).select(*by, F.expr(statistic).alias("s"))
    ends = drawn.groupBy(*by).agg(F.percentile("s", F.lit(tail)).alias("low"), F.percentile("s", F.lit(1 - tail)).alias("high"), F.avg(F.expr("IF(s > 0, 1D, IF(s IS NULL, NULL, 0D))")).alias("positive"))
    whole = rows.groupBy(*by).agg(F.expr(f"min({key}) = max({key})").alias("alone"), *[F.expr(f"sum(coalesce(CAST({e} AS DOUBLE), 0D))").alias(n) for n, e in sums.items()])
    point = whole.select(*by, "alone", F.expr(statistic).alias("point"))
    both = point.join(ends, list(by), "left") if by else point.crossJoin(F.broadcast(ends))  # one row each
    end = lambda c, of: F.when(F.col("alone"), F.expr(of)).otherwise(F.col(c)).alias(c)
    return both.select(*by, "point", end("low", "point"), end("high", "point"), end("positive", "IF(point > 0, 1D, 0D)"))


def interval_sql(rows: str, key: str, sums: dict[str, str], statistic: str, by: str = "", draws: int = 400, level: float = 0.95, seed: str = "0") -> str:
    """The same as CTEs ``each_``, ``point_`` and ``ends_`` in DuckDB's SQL, over the CTE ``rows``; ``by`` is one column or none."""
    tail, group, also = (1 - level) / 2, f"GROUP BY {by}" if by else "", f"{by}, " if by else ""
    weight = weight_sql("md5(concat_ws('|', '%s', key_, lot))" % seed, "j")
    each = f"each_ AS (SELECT {also}CAST({key} AS VARCHAR) AS key_, {', '.join(f'sum(coalesce(CAST({e} AS DOUBLE), 0)) AS {n}' for n, e in sums.items())} FROM {rows} GROUP BY ALL)"
    drawn = f"drawn_ AS (SELECT {also}lot * 4 + j AS draw, {', '.join(f'sum({weight} * {n}) AS {n}' for n in sums)} FROM each_, range({-(-draws // 4)}) l(lot), range(4) p(j) GROUP BY ALL HAVING draw < {draws})"
    ends = f"ends_ AS (SELECT {also}quantile_cont(s, {tail}) AS low, quantile_cont(s, {1 - tail}) AS high, avg(CASE WHEN s > 0 THEN 1 WHEN s IS NOT NULL THEN 0 END) AS positive FROM (SELECT {also}{statistic} AS s FROM drawn_) {group})"
    point = f"point_ AS (SELECT {also}min(key_) = max(key_) AS alone, {', '.join(f'sum({n}) AS {n}' for n in sums)} FROM each_ {group}), spot_ AS (SELECT {also}alone, {statistic} AS point FROM point_)"
    join = f"JOIN ends_ USING ({by})" if by else ", ends_"
    picked = f"SELECT {also}point, CASE WHEN alone THEN point ELSE low END AS low, CASE WHEN alone THEN point ELSE high END AS high, CASE WHEN NOT alone THEN positive WHEN point > 0 THEN 1 ELSE 0 END AS positive FROM spot_ {join}"
    return f"{each}, {drawn}, {ends}, {point}, interval_ AS ({picked})"


#: Sums of pairs ``cand`` and ``base``, and their mean delta.
PAIR_SUMS, MEAN_DELTA = {"d": "cand - base", "m": "1"}, "d / nullif(m, 0)"


def paired(pairs: DataFrame, key: str, by: tuple[str, ...] = (), margin: float = 0.05, draws: int = 400, seed: str = "0") -> DataFrame:
    """Per group of pairs: n, mean delta with its bootstrap interval, P(delta > 0), wins, losses, ties and a verdict under the margin."""
    both = pairs.where("cand IS NOT NULL AND base IS NOT NULL")
    d = F.col("cand") - F.col("base")
    counts = both.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(d > 0).alias("wins"), F.count_if(d < 0).alias("losses"), F.count_if(d == 0).alias("ties"))
    ends = interval(both, key, PAIR_SUMS, MEAN_DELTA, by, draws, seed=seed).withColumnsRenamed({"point": "delta", "positive": "p_better"})
    out = counts.join(ends, list(by)) if by else counts.crossJoin(F.broadcast(ends))
    return out.withColumn("verdict", F.expr(verdict_sql(margin)))


def verdict_sql(margin: float) -> str:
    return f"CASE WHEN low > 0 THEN 'better' WHEN high < -{margin} THEN 'worse' WHEN low >= -{margin} THEN 'non-inferior' ELSE 'inconclusive' END"
