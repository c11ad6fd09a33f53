"""Advice against what is held: names resolved against a master, positions matched one to one by similar names, verdicts, and their evaluation.

Names are compared within a client, whose list is met with its other one row by row as long as that is bounded; a client with longer lists meets through a similarity join of their distinct
names. Matching in order runs in rounds (``similar.first_come``), so a client may have any number of positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fuzzy
from ..functions import text as T
from ..sources.staging import staged
from . import resample, similar

#: Actions that should leave money in a product, kinds of discrepancies, their severities, and least ratios for the master and between names.
INVEST = ("establish", "contribute", "rollover", "switch", "retain", "insure")
SEVERITY = {"not_implemented": "high", "amount_mismatch": "medium", "unexpected_product": "medium", "fee_mismatch": "high"}
KNOWN, SAME = 85.0, 95.0
#: Most pairs of rows of a client that are compared one by one.
MET = 1_000_000


def expected(recs: DataFrame, master: DataFrame) -> DataFrame:
    """What advice (``client, place, product, action, amount``) should come to: ``client, product, i, amount, redeemed``.

    A product takes the name of the most alike in ``master`` (``name, place``), or keeps its own. Amounts of a product add up in the place of its first; a
    null amount or another action gives no position; places are distinct within a client. Products to be redeemed are rows of their own.
    """
    names = similar.best(recs.select(F.col("product").alias("name")), master, KNOWN, F.trim, similar.STEPS).withColumnsRenamed({"name": "product", "found": "known"})
    named = recs.join(names.drop("ratio"), "product", "left").withColumn("product", F.coalesce("known", "product"))
    redeemed = F.col("action") == "redeem"
    wanted = named.where(redeemed | (F.col("action").isin(*INVEST) & F.col("amount").isNotNull()))
    return wanted.groupBy("client", "product", redeemed.alias("redeemed")).agg(F.min("place").alias("i"), F.sum("amount").alias("amount"))


def alike(left: DataFrame, right: DataFrame, least: float = SAME) -> DataFrame:
    """Rows of both sides (``client``, ``product``, others under names of their own) whose client is the same and whose product names are alike.

    Names that reach ``least`` are as many edits from each other as it allows, at most, which Spark tells by itself; only what is left has its ratio taken.
    """
    right = right.withColumnRenamed("product", "product_b")
    sizes = left.groupBy("client").agg(F.count("product").alias("n")).join(right.groupBy("client").agg(F.count("product_b").alias("m")), "client")
    long = staged(sizes.where(F.col("n") * F.col("m") > MET).select("client"), "long")
    # Names are normalised where clients meet, which spreads that over all tasks.
    parts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a, b = (df.repartition(parts, "client").withColumn(n, T.normal_name(F.col(p))) for df, n, p in ((left, "a", "product"), (right, "b", "product_b")))
    edits = f"CAST(floor({1 - least / 100!r}D * (length(a) + length(b)) + 1e-9D) AS INT)"
    some = bool(long.limit(1).count())
    short = (a.join(long, "client", "left_anti") if some else a).join(b, "client")
    short = short.where(F.expr(f"abs(length(a) - length(b)) <= {edits}")).where(F.expr(f"levenshtein(a, b, {edits}) >= 0")).where(fuzzy.ratio("a", "b") >= least)
    short = short.select("client", *[c for c in [*a.columns, *b.columns] if c not in ("client", "a", "b")])
    if not some:
        return short
    mine, theirs = a.join(long, "client", "left_semi"), b.join(long, "client", "left_semi")
    names = similar.pairs(mine.select("a"), least, theirs.select("b")).drop("ratio")
    return short.unionByName(mine.join(names, "a").join(theirs, ["client", "b"]).drop("a", "b"))


def reconciled(recs: DataFrame, holdings: DataFrame, master: DataFrame, fees: DataFrame, amount_tolerance: float = 0.05, fee_tolerance: float = 0.05) -> DataFrame:
    """Verdicts ``client, kind, product, expected, observed, severity``; positions as advised are of kind ``matched``.

    ``holdings``: ``client, j, product, balance`` with ``j`` distinct within a client; ``fees``: ``client, agreed, charged``. Each position takes, in order, the first holding of
    a like name that is free. A holding that nothing took is ``not_implemented`` if its product was to be redeemed, else ``unexpected_product``.
    """
    wanted, holdings = staged(expected(recs, master), "expected"), staged(holdings, "holdings")
    invest, redeemed = wanted.where("NOT redeemed").drop("redeemed"), wanted.where("redeemed").select("client", "product")
    edges = alike(invest.select("client", "product", "i"), holdings.select("client", "product", "j")).select(F.col("client").alias("key"), "i", "j")
    matched = staged(similar.first_come(edges).withColumnRenamed("key", "client"), "matched")
    positions = invest.join(matched, ["client", "i"], "left").join(holdings.select("client", "j", "balance"), ["client", "j"], "left")
    off = (F.col("amount") > 0) & (F.abs(F.col("balance") - F.col("amount")) > F.col("amount") * amount_tolerance)
    kind = F.when(F.col("j").isNull(), "not_implemented").when(off, "amount_mismatch").otherwise("matched")
    number = lambda c: F.format_string("%.2f", F.col(c).cast("double"))
    first = positions.select("client", kind.alias("kind"), "product", number("amount").alias("expected"), F.when(F.col("j").isNull(), "absent").otherwise(number("balance")).alias("observed"))
    left = holdings.join(matched, ["client", "j"], "left_anti")
    kept = alike(left.select("client", "product", "j"), redeemed).select("client", "j", F.lit(True).alias("kept")).distinct()
    kept = left.join(kept, ["client", "j"], "left").withColumn("kept", F.coalesce("kept", F.lit(False)))
    second = kept.select("client", F.when(F.col("kept"), "not_implemented").otherwise("unexpected_product").alias("kind"), "product", F.when(F.col("kept"), "redeemed").otherwise("absent").alias("expected"), number("balance").alias("observed"))
    wrong = F.abs(F.col("charged") - F.col("agreed")) > F.greatest(F.lit(1.0), F.col("agreed") * fee_tolerance)
    third = fees.where(wrong).select("client", F.lit("fee_mismatch").alias("kind"), F.lit("advice_fee").alias("product"), number("agreed").alias("expected"), number("charged").alias("observed"))
    return first.unionByName(second).unionByName(third).withColumn("severity", _severity(F.col("kind")))


def _severity(kind: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])[kind]


def evaluated(verdicts: DataFrame, planted: DataFrame, clients: DataFrame, draws: int = 400) -> DataFrame:
    """Per kind: planted, detected, clients with a false alarm, and both rates with bootstrap intervals over clients; a row ``clean`` tells how many clients
    without anything planted were flagged.

    ``planted``: ``client, kind, product``. A verdict detects what was planted for its client under its kind and a like name; without that it is a false alarm.
    """
    found = staged(verdicts.where("kind <> 'matched'").select("client", "kind", "product").distinct(), "found")
    truth = staged(planted.select("client", "kind", "product").distinct().withColumn("n", F.monotonically_increasing_id()), "planted")
    both = staged(alike(found, truth.withColumnRenamed("kind", "kind_b")).where("kind = kind_b").select("client", "kind", "product", "n"), "hits")
    hits = both.select("n").distinct().withColumn("hit", F.lit(1))
    per = truth.join(hits, "n", "left").groupBy("client", "kind").agg(F.count("*").alias("planted"), F.count("hit").alias("detected"))
    alarms = found.join(both.select("client", "kind", "product").distinct(), ["client", "kind", "product"], "left_anti").groupBy("client", "kind").agg(F.lit(1).alias("alarm"))
    kinds = clients.select("client").distinct().withColumn("kind", F.explode(F.array(*[F.lit(k) for k in SEVERITY])))
    cases = staged(kinds.join(per, ["client", "kind"], "left").join(alarms, ["client", "kind"], "left").na.fill(0, ["planted", "detected", "alarm"]), "cases")
    sums = {"p": "planted", "d": "detected", "f": "alarm", "m": "1"}
    rate = lambda rows, s: resample.interval(rows, "client", sums, s, ("kind",), draws).select("kind", F.col("point").alias("rate"), "low", "high")
    both_rates = rate(cases, "d / nullif(p, 0)").join(rate(cases, "f / nullif(m, 0)").withColumnsRenamed({"rate": "alarm_rate", "low": "alarm_low", "high": "alarm_high"}), "kind")
    counts = cases.groupBy("kind").agg(F.sum("planted").alias("planted"), F.sum("detected").alias("detected"), F.sum("alarm").cast("long").alias("alarm_clients"))
    clean = cases.groupBy("client").agg(F.sum("planted").alias("planted"), F.max("alarm").alias("alarm"), F.lit(0).alias("detected")).where("planted = 0").withColumn("kind", F.lit("clean"))
    flagged = rate(clean, "f / nullif(m, 0)").withColumnsRenamed({"rate": "alarm_rate", "low": "alarm_low", "high": "alarm_high"})
    flagged = flagged.join(clean.groupBy("kind").agg(F.sum("alarm").cast("long").alias("alarm_clients")), "kind")
    return counts.join(both_rates, "kind").unionByName(flagged, allowMissingColumns=True)
