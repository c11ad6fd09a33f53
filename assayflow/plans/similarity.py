"""Queries by similar names and texts. SQL has no ratio of this kind; tests hold them against plain Python over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reconcile as C
from ..operators import similar as S
from ..sources import adapters as A
from .registry import query

c = F.col


def advice(spark, sf):
    """Recommendations, holdings, master and fees: every line item is advised to its order's customer under its part's name, which the platform spells a little differently."""
    part = A.table(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.substring(F.md5(c("p_partkey").cast("string")), 1, 12), "p_type").alias("product"))
    orders = A.table(spark, sf, "orders").select("o_orderkey", c("o_custkey").alias("client"), "o_totalprice")
    action = F.when(c("l_returnflag") == "R", "redeem").when(c("l_returnflag") == "A", "contribute").otherwise("establish")
    items = A.table(spark, sf, "lineitem").join(orders, c("l_orderkey") == c("o_orderkey")).join(part, c("l_partkey") == c("p_partkey"))
    items = items.select("client", (((c("l_orderkey") * 10 + c("l_linenumber")) * 100_000 + c("l_partkey")) * 10_000 + c("l_suppkey")).alias("place"), "product", action.alias("action"), c("l_extendedprice").alias("amount"), c("l_suppkey").alias("k"))
    dropped = F.concat(F.substring("product", 1, 3), F.expr("substring(product, 5)"))
    recs = items.select("client", "place", F.when(c("place") % 3 == 0, dropped).otherwise(c("product")).alias("product"), "action", "amount")
    gone, late = c("place") % 7 == 0, (c("action") == "redeem") & (c("place") % 3 > 0)
    spelt = F.when(c("place") % 5 == 0, F.concat("product", F.lit("s"))).otherwise(F.upper("product"))
    holdings = items.where(~gone & ~late).select("client", c("place").alias("j"), spelt.alias("product"), F.round(c("amount") * F.when(c("k") % 4 == 0, 1.2).otherwise(1.0), 2).alias("balance"))
    fees = orders.groupBy("client").agg(F.round(F.sum("o_totalprice") / 100, 2).alias("agreed")).withColumn("charged", F.round(c("agreed") * F.when(c("client") % 6 == 0, 1.5).otherwise(1.0), 2))
    return recs, holdings, part.select(c("product").alias("name"), c("p_partkey").alias("place")), fees


@query()
def reconcile_advice(spark, sf):
    return C.reconciled(*advice(spark, sf))


@query()
def reconcile_evaluation(spark, sf):
    """Against what the altered fees are known to be: fee discrepancies of every sixth client."""
    recs, held, master, fees = advice(spark, sf)
    planted = fees.where("client % 6 = 0 AND abs(charged - agreed) > 1").select("client", F.lit("fee_mismatch").alias("kind"), F.lit("advice_fee").alias("product"))
    rows = C.evaluated(C.reconciled(recs, held, master, fees), planted, fees.select("client"))
    return rows.select("kind", "planted", "detected", "alarm_clients", *[F.round(n, 6).alias(n) for n in ("rate", "low", "high", "alarm_rate", "alarm_low", "alarm_high")])


def cases(spark, sf):
    """Turns of conversations as cases to add, and a third of them once more with a letter less, behind the benchmark's items as existing ones."""
    turns = A.table(spark, sf, "conversations").select(F.format_string("c%d-%d", "conv_id", "turn").alias("id"), (c("conv_id") * 100 + c("turn")).alias("place"), "text", F.lit(False).alias("existing"))
    again = turns.where(c("place") % 3 == 1).select(F.concat("id", F.lit("-again")), c("place") + 10**9, F.concat(F.substring("text", 1, 9), F.expr("substring(text, 11)")), "existing")
    return turns.union(again).union(A.table(spark, sf, "benchmark").select(F.format_string("b%d", "item_id"), "item_id", "text", F.lit(True)))


@query()
def neardup_ratio(spark, sf):
    return S.deduplicated(cases(spark, sf)).select("id", "duplicate_of", "ratio").where("duplicate_of IS NOT NULL")
