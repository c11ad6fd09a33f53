"""Text, number, identifier and hash functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stop words of topic tokens here, and refusal and deferral phrases.
STOP = "a an and are as at be by for from has have he her his in is it its not of on or our she so that the their them then there they this to was we were what when will with you your".split()
REFUSAL = r"(?i)\b(i (cannot|can't|am unable to)|unable to (help|assist)|as an ai)\b"
DEFERRAL = r"(?i)\b(later|next time|not yet|defer|postpone|think about it)\b"
#: A word's edge where words are ``[0-9A-Za-z_]``; ``\\b`` counts letters of all alphabets on some versions of Java.
EDGE = "(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"


def matches(text: Column, pattern: str) -> Column:
    """Whether the text has the pattern as SQL's ``regexp_matches`` reads it: edges of words as in ``EDGE``, a dot for all but newlines, case by Unicode."""
    # Next to a literal character of a word one side of an edge is known.
    p = re.sub(r"(?<!\\)([0-9A-Za-z_])\\b", r"\1(?!\\w)", re.sub(r"\\b(?=[0-9A-Za-z_])", r"(?<!\\w)", pattern))
    return text.rlike("(?d)" + p.replace(r"\b", EDGE).replace("(?i)", "(?iu)"))


def tokens(text: Column) -> Column:
    """Lower-case words of three or more of ``a-z'-``, without stop words, in order."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z][a-z'-]{2,}"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(STOP))


def tokens_sql(text: str) -> str:
    stop = ", ".join(f"'{w}'" for w in STOP)
    return f"list_filter(regexp_extract_all(lower({text}), '[a-z][a-z''-]{{2,}}'), lambda x: x NOT IN ({stop}))"


def overlap(claim: Column, evidence: Column) -> Column:
    """The share of a claim's distinct words that the evidence has; 1 for a claim without words."""
    own = F.array_distinct(claim)
    return F.when(F.size(own) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(own, evidence)) / F.size(own))


def normal(text: Column) -> Column:
    """Trimmed, lower case, white space made one space."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\r]+", " "))


def normal_name(text: Column) -> Column:
    return F.regexp_replace(normal(text), "[^a-z0-9 ]", "")


def edit_ratio(a: Column, b: Column) -> Column:
    """Levenshtein distance over the longer length; 0 for two empty texts."""
    return F.coalesce(F.try_divide(F.levenshtein(a, b), F.greatest(F.length(a), F.length(b))), F.lit(0.0))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.bround(F.length(text) / 4).cast("long"))


def numbers_match(a: Column, b: Column) -> Column:
    """Both null match, one null does not; else within 1 or 0.5 % of ``b``."""
    near = F.abs(a - b) <= F.greatest(F.lit(1.0), F.abs(b) * 0.005)
    return F.when(a.isNull() & b.isNull(), True).when(a.isNull() | b.isNull(), False).otherwise(near)


def _weighted(digits: Column, weights: list[int], first: int = 0) -> Column:
    digit = lambda i: F.substring(digits, i + 1, 1).cast("int") - (first if i == 0 else 0)
    total = digit(0) * weights[0]
    for i, w in enumerate(weights[1:], 1):
        total = total + digit(i) * w
    return total


def tfn_valid(digits: Column) -> Column:
    """A tax file number of nine digits: weighted sum divisible by 11."""
    return F.when(digits.rlike("^[0-9]{9}$"), _weighted(digits, [1, 4, 3, 7, 5, 8, 6, 9, 10]) % 11 == 0).otherwise(False)


def abn_valid(digits: Column) -> Column:
    """A business number of eleven digits: one taken from the first, weighted sum divisible by 89."""
    return F.when(digits.rlike("^[1-9][0-9]{10}$"), _weighted(digits, [10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19], 1) % 89 == 0).otherwise(False)


def redact_email(text: Column) -> Column:
    return F.regexp_replace(text, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+", "[EMAIL]")


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b))), F.lit(0.0))


def content_hash(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def set_digest(digest: Column) -> Column:
    """An aggregate over rows' SHA-256 digests in hex that depends on no order: sums and exclusive ors of all eight 32-bit lanes and the number of rows, hashed once more."""
    lanes = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(8)]
    parts = [F.coalesce(F.sum(x.cast("decimal(30,0)")), F.lit(0)).cast("string") for x in lanes] + [F.coalesce(F.bit_xor(x), F.lit(0)).cast("string") for x in lanes]
    return F.sha2(F.concat_ws("|", F.count(digest).cast("string"), *parts), 256)


def set_digest_sql(digest: str) -> str:
    lanes = [f"CAST('0x' || substr({digest}, {8 * i + 1}, 8) AS BIGINT)" for i in range(8)]
    parts = [f"CAST(coalesce(sum({x}), 0) AS VARCHAR)" for x in lanes] + [f"CAST(coalesce(bit_xor({x}), 0) AS VARCHAR)" for x in lanes]
    return f"sha256(concat_ws('|', CAST(count({digest}) AS VARCHAR), {', '.join(parts)}))"


def names_match(a: Column, b: Column) -> Column:
    """Equal as ``normal_name`` gives them; a null name equals an empty one alone."""
    blank = F.coalesce(a, F.lit("")) == F.coalesce(b, F.lit(""))
    return F.when(a.isNull() | b.isNull(), blank).otherwise(normal_name(a) == normal_name(b))


def name_lists_match(a: Column, b: Column) -> Column:
    """Equal names in any order, repeats counted."""
    form = lambda x: F.array_sort(F.transform(F.coalesce(x, F.array().cast("array<string>")), normal_name))
    return form(a) == form(b)
