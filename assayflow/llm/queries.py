"""The registered queries of this subpackage: thin columns over each operator, on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import htmltext, lexical, licences, outliers, packing, pii, prefixtrie, rulefit, search, sentencepieces, simhash, substrings, tokenfile


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op3_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return search.top_k(docs, docs.where("doc_id % 100 = 0")).withColumn("score", F.round("score", 6))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(_table(spark, sf_dir, "documents"), ids=False)


def op5_tokenfile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.read_tokens(tokenfile.write_tokens(_table(spark, sf_dir, "documents")), ids=False)


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.size("sentences").cast("long").alias("n_sentences"), F.array_join("sentences", ",").alias("sentences"), F.array_join("licences", ",").alias("licences"))


def op7_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = outliers.judged(_table(spark, sf_dir, "documents"), keep=("doc_id",))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
    return found.select("doc_id", *[f"quality.{c}" for c in names])


def op8_rulefit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = rulefit.train(docs, _table(spark, sf_dir, "labels"))
    found = rulefit.scored(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (rulefit.fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= rulefit.THRESHOLD).cast("int").alias("predicted"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(_table(spark, sf_dir, "pages"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(_table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in pii.KINDS]  # noqa: B023
    return found.select("doc_id", *counts, F.sha2(pii.listed(F.col("base")), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op11_prefixtrie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.trie(prefixtrie.rebuilt(prefixtrie.turns_of(_table(spark, sf_dir, "conversations"))))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.top_k(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).withColumnRenamed("query_id", "item_id")


def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_simhash, op2_packing, op3_search, op4_sentencepiece, op5_tokenfile, op6_licences, op7_outliers, op8_rulefit, op9_html, op10_pii, op11_prefixtrie, op12_lexical, op13_substrings)}

#: Where SQL can express the query over whole tables in reasonable time.
ORACLE_SQL: dict[str, str] = {"op6_licences": licences.oracle(), "op11_prefixtrie": prefixtrie.oracle(), "op12_lexical": lexical.oracle(), "op13_substrings": substrings.oracle()}
