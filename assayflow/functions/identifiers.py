"""Three dialects of personal identifiers as spans, redaction by kind, and reversible pseudonyms.

Spans are offsets in code points. Each dialect keeps its own patterns and its own way with overlaps, so that none
is a special case of another: ``chat`` drops a weaker kind that begins inside a stronger one, ``document`` masks all
business-number shapes before it looks for tax file numbers, ``meeting`` takes the earliest, then the longest.
Nulls and empty texts have no spans.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Patterns of each dialect, checksum weights, prefixes of pseudonyms.
CHAT = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "abn": r"(?<!\d)\d{2}[ -]?\d{3}[ -]?\d{3}[ -]?\d{3}(?!\d)",
    "tfn": r"(?<!\d)\d{3}[ -]?\d{3}[ -]?\d{3}(?!\d)",
    "phone": r"(?<![\d)])(?:\+61[ -]?|\(0\)|0)[2-478](?:[ -]?\d){8}(?!\d)",
}
DOCUMENT = {
    "abn": r"(?<![\d-])\d{2}[ -]?\d{3}[ -]?\d{3}[ -]?\d{3}(?![\d-])",
    "tfn": r"(?<![\d-])\d{3}[ -]?\d{3}[ -]?\d{3}(?![\d-])",
}
MEETING = {
    "DOB": r"(?i)(?:\b(?:born(?: on)?|date of birth|DOB|D\.O\.B\.)\s*(?:is|was|:)?\s*)(?P<span>\d{1,2}(?:st|nd|rd|th)?(?:\s+of)?\s+[A-Za-z]{3,9}\.?,?\s+\d{4}|\d{1,2}/\d{1,2}/\d{4}|\d{4}-\d{2}-\d{2})",
    "TFN": r"(?<![\w-])\d{3}[ -]?\d{3}[ -]?\d{3}(?![\w-])",
    "PHONE": r"(?<![\w-])(?:\+61[ -]?|0)(?:4\d{2}[ -]?\d{3}[ -]?\d{3}|[2378][ -]?\d{4}[ -]?\d{4})(?![\w-])",
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ADDRESS": r"\b\d{1,4}[A-Za-z]?(?:/\d{1,4})?\s+(?:[A-Z][a-z]+\s+){1,3}(?:Street|St|Road|Rd|Avenue|Ave|Drive|Dr|Court|Ct|Place|Pl|Lane|Ln|Crescent|Cres|Parade|Pde|Way|Terrace|Tce|Boulevard|Blvd|Close|Cl)\b(?:,?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)?(?:,?\s+(?:NSW|VIC|QLD|WA|SA|TAS|ACT|NT))?(?:\s+\d{4})?",
}
TFN_WEIGHTS = (1, 4, 3, 7, 5, 8, 6, 9, 10)
ABN_WEIGHTS = (10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19)
PREFIXES = {"adviser": "ADVISER", "client": "CLIENT", "paraplanner": "PARAPLANNER", "unknown": "SPEAKER"}


class Span(NamedTuple):
    start: int
    end: int
    kind: str


def tfn_ok(shape: str) -> bool:
    digits = [int(c) for c in shape if c.isdecimal()]
    return len(digits) == len(TFN_WEIGHTS) and sum(d * w for d, w in zip(digits, TFN_WEIGHTS, strict=True)) % 11 == 0


def abn_ok(shape: str) -> bool:
    digits = [int(c) for c in shape if c.isdecimal()]
    if len(digits) != len(ABN_WEIGHTS):
        return False
    return (sum(d * w for d, w in zip(digits, ABN_WEIGHTS, strict=True)) - ABN_WEIGHTS[0]) % 89 == 0


def _hits(patterns: dict[str, str], kind: str, text: str) -> Iterator[Span]:
    """The spans of one kind that pass its checksum, if it has one."""
    check = {"tfn": tfn_ok, "abn": abn_ok}.get(kind.lower(), lambda _: True)
    for m in re.finditer(patterns[kind], text):
        a, b = m.span("span") if "span" in m.re.groupindex else m.span()
        if check(text[a:b]):
            yield Span(a, b, kind)


def chat_spans(text: str) -> list[Span]:
    found: list[Span] = []
    for kind in CHAT:
        strong = found if kind == "phone" else [s for s in found if (kind, s.kind) == ("tfn", "abn")]
        taken = [range(s.start, s.end) for s in strong]
        found += [s for s in _hits(CHAT, kind, text) if not any(s.start in r for r in taken)]
    return sorted(found, key=lambda s: s.start)


def document_spans(text: str) -> list[Span]:
    """Every business-number shape, valid or not, and the valid tax file numbers outside them."""
    shapes = [Span(*m.span(), "abn") for m in re.finditer(DOCUMENT["abn"], text)]
    masked = re.sub(DOCUMENT["abn"], lambda m: " " * len(m[0]), text)
    return sorted([*shapes, *_hits(DOCUMENT, "tfn", masked)])


def meeting_spans(text: str) -> list[Span]:
    kept: list[Span] = []
    for span in sorted((s for kind in MEETING for s in _hits(MEETING, kind, text)), key=lambda s: (s.start, -s.end)):
        if not kept or span.start >= kept[-1].end:
            kept.append(span)
    return kept


DIALECTS: dict[str, Callable[[str], list[Span]]] = {"chat": chat_spans, "document": document_spans, "meeting": meeting_spans}


def spans(text: Column, dialect: str) -> Column:
    """The spans of a dialect, as an array of (start, end, kind) in order."""
    find = DIALECTS[dialect]

    @F.pandas_udf("array<struct<start:int,end:int,kind:string>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([[s._asdict() for s in find(x)] if x else [] for x in texts], dtype="object")

    return run(text)


def redacted(text: Column, found: Column) -> Column:
    """``text`` with each span replaced by its kind in brackets; spans must not overlap."""
    step = lambda s, p: F.struct(
        F.concat(s["out"], F.substring(text, s["at"] + 1, p["start"] - s["at"]), F.lit("["), F.upper(p["kind"]), F.lit("]")).alias("out"), p["end"].alias("at")
    )
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    return F.aggregate(found, begin, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))


def pseudonyms(attendees: DataFrame) -> DataFrame:
    """One row per meeting: ``names``, each full or unambiguous first name with its ``alias``, and ``aliases``, each with its full name.

    ``attendees`` has meeting_id, pos, name, role. A role's alias is numbered only where the meeting has several of
    it. A first name that two attendees share, or that is the whole name of one, is not a name of its own. A meeting's
    attendees are few by nature; they are gathered per meeting, never across meetings.
    """
    role = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PREFIXES.items() for x in kv]), F.col("role")), F.lit(PREFIXES["unknown"]))
    first = F.split("name", r"\s+")[0]
    of_role, of_first = W.partitionBy("meeting_id", "prefix"), W.partitionBy("meeting_id", "first")
    a = attendees.withColumn("prefix", role).withColumn("first", first)
    number = F.row_number().over(of_role.orderBy("pos")).cast("string")
    a = a.withColumn("alias", F.when(F.count("*").over(of_role) > 1, F.concat("prefix", F.lit("_"), number)).otherwise(F.col("prefix")))
    a = a.withColumn("own", (F.count("*").over(of_first) == 1) & (F.col("first") != F.col("name")))
    known = F.array_compact(F.array(F.struct("name", "alias"), F.when(F.col("own"), F.struct(F.col("first").alias("name"), "alias"))))
    return a.groupBy("meeting_id").agg(F.flatten(F.collect_list(known)).alias("names"), F.collect_list(F.struct(F.col("alias").alias("name"), F.col("name").alias("alias"))).alias("aliases"))


@F.pandas_udf(StringType())
def renamed(texts: pd.Series, names: pd.Series) -> pd.Series:
    """Each whole-word name replaced by its alias in one pass, longest names first, so that a replacement is never replaced."""
    made: dict[tuple, tuple[re.Pattern, dict]] = {}

    def one(text: str | None, pairs: list | None) -> str | None:
        if not text or pairs is None or not len(pairs):
            return text
        key = tuple((p["name"], p["alias"]) for p in pairs)
        if key not in made:
            order = sorted(dict(key), key=len, reverse=True)
            made[key] = re.compile(r"\b(?:" + "|".join(map(re.escape, order)) + r")\b"), dict(key)
        pattern, alias = made[key]
        return pattern.sub(lambda m: alias[m[0]], text)

    return pd.Series([one(*x) for x in zip(texts, names, strict=True)], dtype="object")
