"""Tolerant reading of JSON objects in answers, in the two dialects of documents and notes, and lenient shaping.

Both try the text, what a fence holds, the outermost object, and that without trailing commas. The document dialect also closes what a
truncated answer left open; the note dialect never does, and takes an object only if its braces balance outside strings.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S | re.I)
_COMMA = re.compile(r",(\s*[}\]])")
#: How many ends of a truncated text are cut off before closing it.
CUTS = 6


def _scan(text: str) -> tuple[str | None, list[tuple[int, str]]]:
    """From the first brace on: the object if it closes, and else places outside strings after which a cut is possible, with what closes the text there."""
    start = text.find("{")
    if start < 0:
        return None, []
    open_: list[str] = []
    places: list[tuple[int, str]] = []
    for m in re.finditer(r'"(?:[^"\\]|\\.)*"|[{}\[\],]', text[start:], re.S):
        c = m[0]
        if c in "{[":
            open_.append("}" if c == "{" else "]")
            places.append((start + m.end(), "".join(reversed(open_))))
        elif c in "}]":
            if not open_ or open_.pop() != c:
                return None, places
            if not open_:
                return text[start : start + m.end()], places
            places.append((start + m.end(), "".join(reversed(open_))))
        elif c == ",":
            places.append((start + m.start(), "".join(reversed(open_))))
    if open_ and text[start:].count('"') % 2 == 0:
        places.append((len(text), "".join(reversed(open_))))
    return None, places


def _object(text: str) -> dict | None:
    try:
        found = json.loads(text)
    except ValueError:
        return None
    return found if isinstance(found, dict) else None


def repaired(text: str | None, dialect: str) -> tuple[dict | None, bool]:
    """The object and whether it took a repair; None if there is none."""
    text = text or ""
    found = _object(text)
    if found is not None:
        return found, False
    inner = (_FENCE.search(text) or [None, text])[1]
    whole, places = _scan(inner)
    tries = [inner, *([whole, _COMMA.sub(r"\1", whole)] if whole else [])]
    if dialect == "document" and not whole:
        start = inner.find("{")
        tries += [_COMMA.sub(r"\1", inner[start:end].rstrip().rstrip(",") + close) for end, close in reversed(places[-CUTS:])]
    for candidate in tries:
        found = _object(candidate)
        if found is not None:
            return found, True
    return None, True


#: The list sections of a note, and who may own an action.
SECTIONS = ("goals", "circumstance_changes", "decisions", "action_items", "vulnerability_indicators")
OWNERS = ("adviser", "client", "paraplanner")


def shaped(found: dict | None) -> list[tuple[str, int, str, list[str], str | None, str | None]]:
    """Claims of a note as (section, idx, text, evidence, owner, due): missing sections are empty, a claim without evidence cites ``unknown``, an unknown owner of an action is the adviser, and what is no date is no due date."""
    out = []
    for section in SECTIONS:
        held = (found or {}).get(section)
        for i, item in enumerate(held if isinstance(held, list) else []):
            item = item if isinstance(item, dict) else {"text": item}
            evidence = item.get("evidence")
            evidence = [str(e) for e in (evidence if isinstance(evidence, list) else [evidence] if evidence else [])] or ["unknown"]
            owner, due = None, None
            if section == "action_items":
                owner = item.get("owner") if item.get("owner") in OWNERS else "adviser"
                due = item["due"] if isinstance(item.get("due"), str) and not pd.isna(pd.to_datetime(item["due"], format="%Y-%m-%d", errors="coerce")) else None
            out.append((section, i, str(item.get("text") or ""), evidence, owner, due))
    return out


def repaired_as(text: Column, dialect: str) -> Column:
    """A struct of the object, its keys sorted, and whether it took a repair."""

    def run(texts: pd.Series) -> pd.DataFrame:
        found = [repaired(t, dialect) for t in texts]
        return pd.DataFrame({"object": [None if o is None else json.dumps(o, sort_keys=True) for o, _ in found], "repaired": [r for _, r in found]})

    return F.pandas_udf(run, "struct<object:string,repaired:boolean>")(text)


def shaped_claims(text: Column) -> Column:
    def run(texts: pd.Series) -> pd.Series:
        names = ("section", "idx", "text", "evidence", "owner", "due")
        return texts.map(lambda t: [dict(zip(names, c, strict=True)) for c in shaped(repaired(t, "note")[0])])

    return F.pandas_udf(run, "array<struct<section:string,idx:int,text:string,evidence:array<string>,owner:string,due:string>>")(text)
