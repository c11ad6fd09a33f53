"""Learnt operators: topics, a TF-IDF classifier, a calibrated router, hash bootstrap."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import IDF, HashingTF, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .quantiles import keyed, quantiles


def topics(vectors: DataFrame, k: int = 8, seed: int = 7) -> DataFrame:
    """Topic and novelty of each vector: k-means fitted on one half by hash, its radius on the other."""
    v = vectors.select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), (F.crc32(F.col("vec_id").cast("string").cast("binary")) % 2).alias("half"))
    model = KMeans(k=k, seed=seed, maxIter=20).fit(v.where("half = 0"))
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    away = F.aggregate(F.zip_with(vector_to_array("features"), F.get(centres, F.col("topic")), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    placed = model.transform(v).withColumnRenamed("prediction", "topic").select("vec_id", "half", "topic", F.sqrt(away).alias("distance"))
    radius = quantiles(placed.where("half = 1"), ["topic"], "distance", {"radius": 0.95})  # as many rows as topics
    return keyed(placed, ["topic"]).join(F.broadcast(radius), "key_", "left").select("vec_id", F.when(F.col("distance") > F.col("radius"), F.lit(k)).otherwise(F.col("topic")).alias("topic"), "distance")


def classify(docs: DataFrame, features: int = 1 << 14) -> DataFrame:
    """Probability of class 1 for every document, learnt on four folds of five by id hash; below 0.6 either way it abstains."""
    d = docs.select("doc_id", F.col("y").cast("double").alias("label"), T.tokens(F.col("text")).alias("words"), (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5).alias("fold"))
    steps = [HashingTF(inputCol="words", outputCol="tf", numFeatures=features), IDF(inputCol="tf", outputCol="features", minDocFreq=2), LogisticRegression(maxIter=30, regParam=0.01)]
    p = Pipeline(stages=steps).fit(d.where("fold <> 0")).transform(d).select("doc_id", "label", (F.col("fold") == 0).alias("held_out"), F.get(vector_to_array("probability"), 1).alias("p"))
    return p.withColumn("said", F.when(F.greatest(F.col("p"), 1 - F.col("p")) < 0.6, "unknown").otherwise((F.col("p") >= 0.5).cast("int").cast("string")))


def calibrated(predictions: DataFrame) -> DataFrame:
    """Isotonic probability of being right per document, fitted on other documents than it is applied to."""
    p = predictions.select("doc_id", "p", F.col("y").cast("double").alias("label"), (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2).alias("half"))
    vec = VectorAssembler(inputCols=["p"], outputCol="features").transform(p)
    parts = [IsotonicRegression().fit(vec.where(F.col("half") != h)).transform(vec.where(F.col("half") == h)) for h in (0, 1)]
    return parts[0].unionByName(parts[1]).select("doc_id", "p", F.col("prediction").alias("calibrated"), "label")


def bootstrap(rows: DataFrame, group: str, cluster: str, value: str, draws: int = 200) -> DataFrame:
    """Percentile interval of each group's mean, resampling clusters.

    Clusters are summed first. A cluster's weight in a draw is Poisson(1), from a hash of cluster and draw, so the
    result depends on no order or partition and one aggregation does all draws.
    """
    c = rows.groupBy(group, cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    u = F.pmod(F.xxhash64(F.col(cluster), F.col("draw")), F.lit(1 << 30)) / float(1 << 30)
    cuts = (0.367879, 0.735759, 0.919699, 0.981012, 0.996340, 0.999406)  # Poisson(1) distribution function
    weight = sum((F.when(u > x, 1).otherwise(0) for x in cuts), F.lit(0))
    d = c.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("w", weight)
    means = d.groupBy(group, "draw").agg(F.try_divide(F.sum(F.col("w") * F.col("s")), F.sum(F.col("w") * F.col("n"))).alias("m"))
    ends = means.groupBy(group).agg(F.percentile("m", F.lit(0.025)).alias("low"), F.percentile("m", F.lit(0.975)).alias("high"))
    return c.groupBy(group).agg((F.sum("s") / F.sum("n")).alias("mean")).join(ends, group)
