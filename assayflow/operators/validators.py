"""Validators of extracted records: required fields, fees, amounts, products, replacements, dates, identifiers.

All give rows ``doc_id, code, severity, field``. Sums over a document's recommendations are two-phase aggregates, so
a document with very many recommendations is never gathered. A null amount counts as 0; a check whose inputs are null passes, but for
required fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identifiers
from ..functions import text as T
from . import similar

#: Actions that bring new money, and those that leave money invested; a document's section by field.
NEW_MONEY = ("establish", "contribute", "rollover")
INVEST = (*NEW_MONEY, "switch", "retain")
SECTIONS = {
    "client_names": "header", "adviser_name": "header", "licensee": "header", "advice_date": "header", "risk_profile": "risk", "scope": "scope",
    "recommendations": "recommendations", "fees": "fees", "replacements": "replacement", "authority_to_proceed_signed": "authority", "document": "document",
}


def _bad(when: Column, code: str, severity: str, field: str) -> Column:
    return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit(field).alias("field")))


def _rows(df: DataFrame, checks: list[Column]) -> DataFrame:
    return df.select("doc_id", F.inline(F.array_compact(F.array(*checks))))


def with_totals(docs: DataFrame, recs: DataFrame) -> DataFrame:
    """``docs`` with ``n_recs``, ``invested`` and ``new_money``; insurance is neither."""
    paid = lambda actions: F.sum(F.when(F.col("action").isin(*actions) & (F.col("product_type") != "insurance"), F.col("amount")))
    totals = recs.groupBy("doc_id").agg(F.count("*").alias("n_recs"), paid(INVEST).alias("invested"), paid(NEW_MONEY).alias("new_money"))
    return docs.join(totals, "doc_id", "left").fillna(0, ["n_recs", "invested", "new_money"])


def required(docs: DataFrame) -> DataFrame:
    c = F.col
    blank = lambda name: F.coalesce(F.length(name), F.lit(0)) == 0
    missing = {
        "client_names": F.coalesce(F.size("client_names"), F.lit(0)) <= 0, "adviser_name": blank("adviser_name"), "advice_date": c("advice_date").isNull(),
        "risk_profile": c("risk_profile").isNull(), "recommendations": c("n_recs") == 0, "fees": c("fee_initial").isNull() & c("fee_ongoing").isNull(),
    }
    return _rows(docs, [_bad(when, "missing_field", "error", field) for field, when in missing.items()])


def fees(docs: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """Negative fees; a percentage that is missing, needless, or does not give the ongoing fee of the invested total."""
    c, percent = F.col, F.col("fee_basis") == "percent"
    implied = c("fee_percent") / 100 * c("invested")
    off = F.abs(implied - c("fee_ongoing")) > F.greatest(F.lit(1.0), implied * tolerance)
    return _rows(docs, [
        _bad(c("fee_initial") < 0, "fee_negative", "error", "fees.initial_advice_fee"),
        _bad(c("fee_ongoing") < 0, "fee_negative", "error", "fees.ongoing_advice_fee_pa"),
        _bad(percent & c("fee_percent").isNull(), "fee_basis_inconsistent", "error", "fees.ongoing_fee_percent"),
        _bad(percent & (c("invested") > 0) & off, "fee_arithmetic", "error", "fees.ongoing_advice_fee_pa"),
        _bad((c("fee_basis") != "percent") & c("fee_percent").isNotNull(), "fee_basis_inconsistent", "warning", "fees.ongoing_fee_percent"),
    ])


def funds(docs: DataFrame) -> DataFrame:
    return _rows(docs, [_bad(F.col("new_money") > F.col("available_funds"), "amount_exceeds_available_funds", "error", "recommendations")])


def dates(docs: DataFrame, days: int = 730) -> DataFrame:
    return _rows(docs, [_bad(F.abs(F.date_diff("advice_date", "document_date")) > days, "date_implausible", "error", "advice_date")])


def _at(rows: DataFrame, of: str, side: str = "") -> DataFrame:
    """Puts the place among the document's rows into the field: ``recommendations[2].amount``."""
    return rows.withColumn("field", F.concat(F.lit(f"{of}["), F.col("idx").cast("string"), F.lit("]" + side)))


def amounts(recs: DataFrame) -> DataFrame:
    bad = recs.where("amount < 0").select("doc_id", "idx", F.lit("amount_negative").alias("code"), F.lit("error").alias("severity"))
    return _at(bad, "recommendations", ".amount").drop("idx")


def products(recs: DataFrame, master: DataFrame, reps: DataFrame | None = None, least: float = 90.0) -> DataFrame:
    """Names that resolve to no product of ``master`` (name, product_type), and types that differ from the product's; both sides
    of replacements too, where they are named."""
    known = master.groupBy("name").agg(F.max("product_type").alias("known_type"))
    field = lambda of, side: F.concat(F.lit(f"{of}["), F.col("idx").cast("string"), F.lit(f"].{side}"))
    used = recs.select("doc_id", field("recommendations", "product_name").alias("field"), field("recommendations", "product_type").alias("type_field"), "product_name", "product_type")
    for side in ("from_product", "to_product") if reps is not None else ():
        one = reps.where(F.trim(side) != "").select("doc_id", field("replacements", side).alias("field"), F.lit("").alias("type_field"), F.col(side).alias("product_name"), F.lit(None).cast("string").alias("product_type"))
        used = used.unionByName(one)
    # Each distinct name is matched once, however many rows repeat it, by a similarity join with the master, however large.
    names = similar.best(used.select(F.col("product_name").alias("name")), known.select("name", F.col("name").alias("place")), least)
    resolved = names.join(known.withColumnRenamed("name", "found"), "found").select(F.col("name").alias("product_name"), "found", "known_type")
    matched = used.join(resolved, "product_name", "left")
    unknown = F.col("found").isNull()
    code = F.when(unknown, "product_unknown").when(F.col("known_type") != F.col("product_type"), "product_type_mismatch")
    rows = matched.select("doc_id", code.alias("code"), F.lit("error").alias("severity"), F.when(unknown, F.col("field")).otherwise(F.col("type_field")).alias("field"))
    return rows.where("code IS NOT NULL")


def replacements(reps: DataFrame) -> DataFrame:
    blank = lambda name: F.trim(F.coalesce(F.col(name), F.lit(""))) == ""
    made = reps.select("doc_id", "idx", F.inline(F.array_compact(F.array(
        _bad(blank("from_product") | blank("to_product"), "replacement_incomplete", "error", ""), _bad(blank("reason"), "replacement_reason_missing", "warning", ".reason"))))).withColumnRenamed("field", "side")
    return _at(made, "replacements").withColumn("field", F.concat("field", "side")).drop("idx", "side")


def identifiers_in(docs: DataFrame, text: str = "text") -> DataFrame:
    """A warning per business-number shape that fails its checksum, an error where a valid tax file number stands outside such shapes."""
    digits = lambda x: F.regexp_replace(x, "[ -]", "")
    body, abn, tfn = F.coalesce(F.col(text), F.lit("")), identifiers.DOCUMENT["abn"], identifiers.DOCUMENT["tfn"]
    wrong = F.filter(F.regexp_extract_all(body, F.lit(abn), F.lit(0)), lambda x: ~T.abn_valid(digits(x)))
    leaks = F.exists(F.regexp_extract_all(F.regexp_replace(body, abn, " "), F.lit(tfn), F.lit(0)), lambda x: T.tfn_valid(digits(x)))
    row = lambda code, severity: F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit("document").alias("field"))
    return docs.select("doc_id", F.inline(F.concat(F.transform(wrong, lambda _: row("abn_invalid", "warning")), F.when(leaks, F.array(row("tfn_present", "error"))).otherwise(F.array().cast("array<struct<code:string,severity:string,field:string>>")))))


def section(field: Column) -> Column:
    """The section of a violated field, by the head of its path."""
    table = F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv])
    return F.coalesce(table[F.regexp_extract(field, r"^[^.\[]*", 0)], F.lit("document"))
