"""Running sums over a whole table without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running(df: DataFrame, bucket: Column, order: list, sums: dict[str, str]) -> DataFrame:
    """Adds the running sum of each column of ``sums`` under its new name, in ``order``.

    ``bucket`` is monotone in the order and has few values (thousands at most). Each bucket's total comes first, a
    window over the few buckets turns totals into offsets, and the rows are summed within their bucket alone.
    """
    rows = df.withColumn("__bucket", bucket)
    totals = rows.groupBy("__bucket").agg(*[F.sum(c).alias(f"__{c}") for c in sums])
    before = W.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("__bucket", *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}") for c in sums])
    inside = W.partitionBy("__bucket").orderBy(*order)
    both = rows.join(F.broadcast(offsets), "__bucket")
    return both.select(*df.columns, *[(F.sum(c).over(inside) + F.col(f"__{c}")).alias(n) for c, n in sums.items()])
