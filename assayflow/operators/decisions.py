"""Incidents, experiments, sampling, evaluation, reconciliation, claims: DataFrame to DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .quantiles import keyed, quantiles
from .ranks import running


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    return F.round(F.try_divide(a, b), digits)


# Incidents ------------------------------------------------------------------


def failure_kinds(t: DataFrame) -> DataFrame:
    """One row per trace and kind of failure, in a fixed order of kinds; a trace may have several."""
    error, c = F.col("status") == "error", F.col
    kinds = [("timeout", error & (c("error_class") == "timeout")), ("tool_error", error & (c("error_class") == "tool_error")), ("provider_error", error & c("error_class").isNull()),
             ("invalid_json", ~c("json_valid")), ("pii_leak", c("pii_leak")), ("ungrounded", ~c("grounded")), ("refusal", c("refusal")), ("low_judge", c("judge") < 3.0), ("negative_feedback", c("negative_feedback"))]
    return t.select("trace_id", "ts", "version", F.explode(F.array_compact(F.array(*[F.when(b, F.lit(n)) for n, b in kinds]))).alias("kind"))


def timeline(t: DataFrame, hours: int) -> DataFrame:
    """Dense buckets of requests and errors; the rate of an empty one is null."""
    at = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / F.lit(hours * 3600)).cast("long")
    rows = t.groupBy(at.alias("bucket")).agg(F.count("*").alias("requests"), F.count_if(F.col("status") == "error").alias("errors"))
    span = rows.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).select(F.explode(F.sequence("a", "b")).alias("bucket"))
    return span.join(rows, "bucket", "left").na.fill(0, ["requests", "errors"]).withColumn("rate", ratio(F.col("errors"), F.col("requests")))


def elevated_segment(line: DataFrame) -> DataFrame:
    """The run of buckets above the overall rate that holds the peak (greatest rate, then count, then first)."""
    overall = line.agg(F.sum("errors").alias("e"), F.sum("requests").alias("n")).select((F.col("e") / F.col("n")).alias("overall"))
    above = line.join(F.broadcast(overall)).where(F.try_divide("errors", "requests") > F.col("overall"))
    runs = above.withColumn("island", F.col("bucket") - F.row_number().over(W.orderBy("bucket")))
    peak = runs.agg(F.max_by("island", F.struct(F.try_divide("errors", "requests"), "requests", -F.col("bucket"))).alias("island"))
    return runs.join(F.broadcast(peak), "island").agg(F.min("bucket").alias("first"), F.max("bucket").alias("last"), F.sum("requests").alias("requests"), F.sum("errors").alias("errors"))


def change_point(line: DataFrame) -> DataFrame:
    """The split with the greatest difference of mean rates, from prefix sums; at least two buckets on either side."""
    order = W.orderBy("bucket")
    s = line.select("bucket", "errors", "requests", F.row_number().over(order).alias("i"), F.count("*").over(W.partitionBy()).alias("m"), F.sum("errors").over(order).alias("e0"), F.sum("requests").over(order).alias("n0"), F.sum("errors").over(W.partitionBy()).alias("e"), F.sum("requests").over(W.partitionBy()).alias("n"))
    before, after = F.col("e0") / F.col("n0"), (F.col("e") - F.col("e0")) / (F.col("n") - F.col("n0"))
    p = F.col("e") / F.col("n")
    se = F.greatest(F.sqrt(p * (1 - p) * (1 / F.col("n0") + 1 / (F.col("n") - F.col("n0")))), F.lit(1e-9))
    z = F.round(F.abs(after - before) / se, 6)
    return s.where("i >= 2 AND i <= m - 2").select("bucket", z.alias("stat")).orderBy(F.desc("stat"), "bucket").limit(1)


def group_increase(kinds: DataFrame, t: DataFrame, segment: DataFrame, hours: int) -> DataFrame:
    """Each kind's share of requests inside and outside the elevated segment."""
    at = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / F.lit(hours * 3600))
    mark = lambda d: d.join(F.broadcast(segment.select("first", "last"))).withColumn("inside", at.between(F.col("first"), F.col("last")))
    total = mark(t).agg(F.count_if("inside").alias("n_in"), F.count_if(~F.col("inside")).alias("n_out"))
    return mark(kinds).groupBy("kind").agg(F.count_if("inside").alias("a"), F.count_if(~F.col("inside")).alias("b")).join(F.broadcast(total)).select("kind", ratio(F.col("a"), F.col("n_in")).alias("inside"), ratio(F.col("b"), F.col("n_out")).alias("outside"))


# Experiments ----------------------------------------------------------------


def cohorts(t: DataFrame, stage: int = 10) -> DataFrame:
    """Canary and control metrics by hash bucket."""
    ok = F.col("status") == "ok"
    t = t.withColumn("cohort", F.when(F.col("bucket") < stage, "canary").otherwise("control"))
    sums = t.groupBy("cohort").agg(F.count("*").alias("n"), F.count_if(~ok).alias("errors"), F.count_if(ok & F.col("refusal")).alias("refusals"), F.count_if(ok).alias("ok"), F.round(F.avg(F.when(ok, F.col("quality"))), 6).alias("quality"), F.round(F.avg("cost_usd"), 9).alias("cost"))
    q = quantiles(t, ["cohort"], "latency_ms", {"p95": 0.95})
    return keyed(sums, ["cohort"]).join(q, "key_", "left").select("cohort", "n", "errors", "refusals", "ok", "quality", F.round("p95", 4).alias("p95"), "cost")


def two_proportions(c: DataFrame, hit: str, total: str) -> DataFrame:
    """Pooled z of canary against control; zero without spread."""
    of = lambda k, v: F.max(F.when(F.col("cohort") == k, F.col(v))).cast("double")
    s = c.agg(of("canary", hit).alias("ka"), of("canary", total).alias("na"), of("control", hit).alias("kb"), of("control", total).alias("nb"))
    pool = (F.col("ka") + F.col("kb")) / (F.col("na") + F.col("nb"))
    se = F.sqrt(pool * (1 - pool) * (1 / F.col("na") + 1 / F.col("nb")))
    delta = F.col("ka") / F.col("na") - F.col("kb") / F.col("nb")
    return s.select(F.round(delta, 6).alias("delta"), F.round(F.when(se > 0, delta / se).otherwise(0.0), 4).alias("z"))


def log_gamma(x: Column) -> Column:
    """ln of the gamma function for ``x`` >= 1 to ten decimals: Stirling's series eight further on, less the factors between."""
    y = x + 8
    series = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y) - 1 / (1680 * y * y * y * y * y * y * y)
    product = x
    for i in range(1, 8):
        product = product * (x + i)
    return series - F.log(product)


def mcnemar(wins: Column, losses: Column) -> Column:
    """Two-sided exact binomial p on discordant pairs; 1 without any.

    The tail is summed from its greatest term downwards, each from the one before; terms ten times the root of the pairs further
    down are below any double beside it.
    """
    n, m = (wins + losses).cast("double"), F.least(wins, losses).cast("double")
    top = F.exp(log_gamma(n + 1) - log_gamma(m + 1) - log_gamma(n - m + 1) - n * F.log(F.lit(2.0)))
    steps = F.least(m, F.ceil(10 * F.sqrt(n)) + 50).cast("int")
    start = F.struct(top.alias("term"), top.alias("total"))

    def step(a: Column, i: Column) -> Column:
        term = a["term"] * (m - i + 1) / (n - m + i)
        return F.struct(term.alias("term"), (a["total"] + term).alias("total"))

    tail = F.aggregate(F.when(steps > 0, F.sequence(F.lit(1), F.greatest(steps, F.lit(1)))).otherwise(F.array().cast("array<int>")), start, step, lambda a: a["total"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


# Sampling and splits --------------------------------------------------------


def seeded(seed: str, key: Column) -> Column:
    """A shuffle key that any engine reproduces."""
    return F.md5(F.concat(F.lit(seed + "|"), key.cast("string")))


def stratified_sample(t: DataFrame, budget: int, seed: str = "7") -> DataFrame:
    """Errors, then negative feedback (both by time), then low quality and the rest (shuffled), up to the budget."""
    stratum = F.when(F.col("status") == "error", 0).when(F.col("negative_feedback"), 1).when(F.col("quality") < 0.75, 2).otherwise(3)
    ordered = t.select("trace_id", stratum.alias("stratum"), F.when(stratum < 2, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).otherwise(seeded(seed, F.col("trace_id"))).alias("o"))
    return ordered.orderBy("stratum", "o", "trace_id").limit(budget).select("trace_id", "stratum")


def stratified_split(labels: DataFrame, part: float, seed: str = "3") -> DataFrame:
    """Per label a seeded share for test: at least one of two or more. Places are running sums over buckets of the hash, so no task sorts a label."""
    keyed = labels.withColumn("key", seeded(seed, F.col("doc_id"))).withColumn("one", F.lit(1)).withColumn("bucket", F.concat_ws("|", F.col("y").cast("string"), F.substring("key", 1, 2)))
    sizes = keyed.groupBy("bucket", "y").agg(F.count("*").alias("n"))  # a few hundred buckets per label
    mine = W.partitionBy("y")
    before = sizes.select("bucket", F.coalesce(F.sum("n").over(mine.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(mine).alias("all"))
    place = F.row_number().over(W.partitionBy("bucket").orderBy("key", "doc_id")) + F.col("before")
    size = F.when(F.col("all") > 1, F.greatest(F.lit(1), F.bround(F.col("all") * part).cast("int"))).otherwise(0)
    return keyed.join(F.broadcast(before), "bucket").select("doc_id", "y", F.when(place <= size, "test").otherwise("train").alias("split"))


# Evaluation -----------------------------------------------------------------


def prf(p: DataFrame, threshold: float) -> DataFrame:
    """Per class precision, recall and F1; zero where undefined."""
    rows = p.select((F.col("p") >= threshold).cast("int").alias("g"), "y").select(F.explode(F.array(F.lit(0), F.lit(1))).alias("class"), "g", "y")
    hit, said, true = (F.col("g") == F.col("class")) & (F.col("y") == F.col("class")), F.col("g") == F.col("class"), F.col("y") == F.col("class")
    a = rows.groupBy("class").agg(F.count_if(hit).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(true & ~said).alias("fn"))
    zero = lambda x, y: F.round(F.coalesce(F.try_divide(x, y), F.lit(0.0)), 6)
    return a.select("class", "tp", "fp", "fn", zero(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), zero(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), zero(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))


def reliability(p: DataFrame, bins: int = 10) -> DataFrame:
    """Equal bins, the last one closed; empty ones are not listed."""
    b = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("long")
    return p.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("p"), 6).alias("confidence"), F.round(F.avg("y"), 6).alias("accuracy"))


def risk_coverage(p: DataFrame) -> DataFrame:
    """One point per distinct score, from the highest: tied documents are accepted together."""
    g = p.groupBy("p").agg(F.count("*").alias("n"), F.sum(1 - F.col("y")).alias("wrong"))
    c = running(g, -F.floor(F.col("p") * 1000), [F.desc("p")], {"n": "accepted", "wrong": "errors"}).join(F.broadcast(g.agg(F.sum("n").alias("total"))))
    return c.select("p", "accepted", (F.col("n") / F.col("total")).alias("share"), (F.col("accepted") / F.col("total")).alias("coverage"), (F.col("errors") / F.col("accepted")).alias("risk"))


# Reconciliation -------------------------------------------------------------


def reconciled(expected: DataFrame, held: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Full outer by key: not_implemented, unexpected, amount_mismatch beyond the tolerance, or ok."""
    both = expected.join(held, "key", "full")
    off = F.abs(F.col("held") - F.col("expected")) > tolerance * F.abs(F.col("expected"))
    return both.withColumn("verdict", F.when(F.col("held").isNull(), "not_implemented").when(F.col("expected").isNull(), "unexpected").when(off, "amount_mismatch").otherwise("ok"))


# Claims ---------------------------------------------------------------------


def claim_evidence(claims: DataFrame, segments: DataFrame) -> DataFrame:
    """Claims with the text they cite, in citation order, and the citations that do not exist."""
    cited = claims.select("meeting_id", "idx", F.posexplode("evidence").alias("k", "seg_id"))
    found = cited.join(segments.select("meeting_id", "seg_id", F.col("text").alias("said")), ["meeting_id", "seg_id"], "left")
    per = found.groupBy("meeting_id", "idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("said").isNotNull(), F.struct("k", "said")))), lambda x: x["said"]), " ").alias("said"), F.count_if(F.col("said").isNull()).alias("unknown"))
    return claims.join(per, ["meeting_id", "idx"], "left").na.fill({"said": "", "unknown": 0})


def verdicts(joined: DataFrame) -> DataFrame:
    """unsupported for an unknown citation or little overlap, weak for some, supported for more."""
    s = joined.select("meeting_id", "idx", "unknown", T.overlap(T.tokens(F.col("text")), T.tokens(F.col("said"))).alias("o"))
    o = F.col("o")
    v = F.when((F.col("unknown") > 0) | (o < 0.25), "unsupported").when(o < 0.5, "weak").otherwise("supported")
    score = F.when(F.col("unknown") > 0, F.lit(0.0)).when(o < 0.25, 0.5 * o).when(o < 0.5, 0.5 + 0.3 * o).otherwise(F.least(F.lit(1.0), 0.7 + 0.3 * o))
    return s.select("meeting_id", "idx", v.alias("verdict"), F.round(score, 6).alias("score"))
