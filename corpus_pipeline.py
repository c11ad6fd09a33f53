"""Corpus pipeline: quality classifier, quality rules, near-duplicates, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before kept; all but the last return the
columns of ``documents``, whatever further columns it has and whatever their names. A null or empty text is a text without
words in every stage, a null id is kept as it is, texts are processed whole whatever their length, repeated rows are rows of
their own but for the near-duplicates, and an empty table gives an empty one. What a stage does beyond that its docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayflow.llm import outliers, packing, pii, rulefit, simhash
from assayflow.llm.shared import free_name, materialised


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier scores below its threshold; learns from the labels of the documents it is given.

    Without labels of both classes all documents get one score. A score at the threshold stays; equal texts have equal scores.
    """
    model = rulefit.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name(docs, "score")
    return rulefit.scored(docs, model, out=score).where(F.col(score) >= rulefit.THRESHOLD).drop(score)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or lie outside the robust estimate of their language and source.

    Texts of fewer than ten words, null and empty ones too, fail the base rules. A null language or source is one of its own. Rows of one group with equal texts share a verdict.
    """
    verdict = free_name(docs, "quality")
    return outliers.judged(docs, out=verdict).where(F.col(verdict)["kept"]).drop(verdict)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of linked fingerprints: that of the least id, a null id only if there is no other; of rows with that id one."""
    return simhash.drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; of overlapping spans one replacement is made. Null stays null; ``n_chars`` follows a changed text."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences, a row per piece; a null or empty text is its end id alone, and ties in length go by the ids' bytes."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality_classifier), ("quality rules", quality_rules), ("near-duplicates", near_duplicates), ("personal data", personal_data), ("packing", pack)]

#: No SQL expresses the learnt and tokenising stages; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialised(stage(spark, docs, sf_dir), "-".join(name.split()))
    return STAGES[-1][1](spark, docs, sf_dir)
