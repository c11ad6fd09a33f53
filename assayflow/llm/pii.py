"""Personal data: base patterns, and boosted trees over what high-recall generators propose.

Base spans (email, ip, card, phone) are matches of the ``BASE`` patterns that pass their check. Further
spans come from candidates: generators (``CANDIDATES``) match far more than is personal, such as any long group of
digits or any long token with a digit; they also propose a kind of their own, ``secret`` (keys, tokens, passwords).
Boosted trees score each candidate by its format and its context, and those at or above a
threshold are added. The threshold of each kind is calibrated: the least score of 0.5 or more at which ``PRECISION`` of the
calibration snippets' candidates at or above it are personal. Trees and thresholds are fitted when first
needed, on the synthetic snippets of ``_snippets``, whose labels are known by construction: forms to be found, and things of
like form that are not personal (dates, versions, checksums, numbers that fail a check). Two thirds fit, one third calibrates.

All work on texts is native expressions. Positions come from the lengths of matches and of the text
between them, contexts from the text between matches, and overlaps from running greatest ends, with sums and maxima taken in blocks, so
long texts with many matches take near-linear time. A candidate that overlaps a base span is dropped; of candidates that overlap each other
the one of the greatest score is taken, then the next that overlaps none taken (equal scores: by kind as in ``TURNS``, then by place).

Spans are ``(start, end, kind)``, in code points, end exclusive. Null and empty texts have none. Repeated rows
are treated one by one, an empty table gives an empty one, and columns besides the text may have any names.
"""

from __future__ import annotations

import json
import random
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rulefit
from .shared import let

#: Base kinds in their order, and all kinds.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
#: The order of kinds among equal scores.
TURNS = ("email", "ip", "card", "secret", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
#: The base patterns in Java's syntax. Look-behind and possessive repeats only save steps: no other match is found.
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_HEX = "[0-9A-Fa-f]"
_LONG = "[A-Za-z0-9+/_-]"
CANDIDATES = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++\x20?[\[(](?i:at)[\])]\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(](?i:dot)[\])]\x20?)[A-Za-z0-9-]++)++",
    "ip": rf"(?<![0-9])[0-9]{{1,3}}(?:\x20?[\[(]\.[\])]\x20?[0-9]{{1,3}}){{3}}(?![0-9])|(?<![0-9A-Za-z:]){_HEX}{{1,4}}(?::{{1,2}}{_HEX}{{1,4}}){{2,7}}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9])[0-9]{4,6}(?:[\x20._/-]{1,2}[0-9]{3,6}){2,4}(?![0-9])",
    "phone": r"(?<![0-9+])(?:\([0-9]{2,6}\)|[0-9]{2,6})(?:[\x20./-]{1,2}[0-9]{2,10}){1,6}(?![0-9])|(?<![0-9A-Za-z+_-])0[0-9]{8,13}(?![0-9A-Za-z_-])",
    "secret": rf"(?<!{_LONG})(?=[A-Za-z+/_-]*+[0-9]){_LONG}{{16,}}+={{0,2}}",
}
#: A text without these has no match of the kind; a test far cheaper than the pattern.
NEEDS = {"email": "@", "ip": "[0-9][.][0-9]", "card": "[0-9]", "phone": r"\+[0-9]"}
CANDIDATE_NEEDS = {"email": r"(?i)[\[(]at[\])]", "ip": rf"[0-9] ?[\[(][.]|{_HEX}:{_HEX}|::", "card": "[0-9]{3}[ ._/-]", "phone": "[0-9][ ./)-]|0[0-9]{8}", "secret": f"[0-9]{_LONG}{{7}}|{_LONG}{{15}}[0-9]"}
#: A text without any of these has neither base spans nor candidates.
ANY = r"[0-9@]|[\[(][Aa][Tt][\])]|::"
BLOCK = 64
#: Below every position and its negative.
LEAST = -(1 << 62)
CONTEXT = 24
#: Words beside which a candidate is likely personal.
WORDS = {
    "email": "mail|contact|write|reach|kontakt|correo|courriel", "ip": "ip|host|address|server|client|from|adresse|dirección",
    "card": "card|visa|master|amex|credit|debit|karte|carte|tarjeta", "phone": "phone|tel|call|fax|mobile|cell|dial|anruf|llam|appel",
    "secret": "token|secret|passw|pwd|key|auth|bearer|credential|schlüssel|clave|jeton",
}
TREES, DEPTH, RATE, PRECISION, SNIPPETS = 24, 3, 0.3, 0.98, 900


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


# Long expressions are written as SQL text: one call to the JVM in place of a hundred.


def _bound(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` for ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _running(values: str, of: str, join: str, start: str) -> str:
    """Running sums or maxima: of each block, of the blocks before, and within the block, so that no step copies a long array."""
    block = f"CAST(floor(i / {BLOCK}) AS INT)"
    part = lambda n: of.format(f"slice(v, b * {BLOCK} + 1, {n})")
    each = f"transform(sequence(0, CAST(floor((size(v) - 1) / {BLOCK}) AS INT)), b -> {part(BLOCK)})"
    heads = f"aggregate({each}, array({start}), (a, x) -> concat(a, array({join.format('element_at(a, -1)', 'x')})))"
    own = _bound(block, "b", join.format("get(h, b)", part(f"i % {BLOCK} + 1")))
    return _bound(values, "v", f"IF(size(v) > 0, {_bound(heads, 'h', f'transform(v, (y, i) -> {own})')}, v)")


def _running_sum(values: str) -> str:
    return _running(values, "aggregate({0}, 0L, (t, y) -> t + y)", "{0} + {1}", "0L")


def _running_max(values: str) -> str:
    return _running(values, f"coalesce(array_max({{0}}), {LEAST}L)", "greatest({0}, {1})", f"{LEAST}L")


def _matches(text: str, pattern: str, needs: str, context: bool = False) -> str:
    """All matches in the column ``text``, leftmost first and not overlapping: structs of start, end and body, and if asked for the text beside it, up to the next match."""
    beside = f", 'before', right(get(p.s, i), {CONTEXT}), 'after', left(get(p.s, i + 1), 8)" if context else ""
    ends = _running_sum("transform(p.m, (w, i) -> CAST(length(get(p.s, i)) + length(w) AS BIGINT))")
    placed = _bound(ends, "e", f"transform(p.m, (w, i) -> named_struct('start', get(e, i) - length(w), 'end', get(e, i), 'body', w{beside}))")
    none = "CAST(array() AS ARRAY<STRUCT<start: BIGINT, end: BIGINT, body: STRING" + ", before: STRING, after: STRING" * context + ">>)"
    parts = f"named_struct('m', regexp_extract_all({text}, r'{pattern}', 0), 's', split({text}, r'{pattern}', -1))"
    return f"IF({text} RLIKE r'{needs}', {_bound(parts, 'p', f'IF(size(p.m) > 0, {placed}, {none})')}, {none})"


def _digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    value = lambda d: F.when(d > 9, d - 9).otherwise(d)

    def sums(r: Column) -> Column:
        digit = lambda i: F.substr(r, i, F.lit(1)).cast("int")
        terms = F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: value(digit(i) * F.when(i % 2 == 0, F.lit(2)).otherwise(F.lit(1))).cast("long"))
        return _total(terms) % 10 == 0

    return let(F.reverse(digits), sums)


def _part_fits(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+(?=.)", "")
    return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= F.lit("255")))


CHECKS: dict[str, Callable[[Column], Column]] = {
    "email": lambda body: F.lit(True),
    "ip": lambda body: F.forall(F.split(body, r"\."), _part_fits),
    "card": lambda body: let(_digits(body), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(F.lit(False))),
    "phone": lambda body: F.length(_digits(body)).between(10, 15),
}


def base_spans(text: str, kind: str) -> Column:
    """The kind's spans in the column ``text`` that pass its check, as structs ``start, end, kind``."""
    passed = F.filter(F.expr(_matches(text, BASE[kind], NEEDS[kind])), lambda m: CHECKS[kind](m["body"]))
    return F.transform(passed, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind")))


def _features(m: str, kind: str) -> str:
    """Format and context of a candidate ``m`` as an SQL struct of doubles. One text in place of a hundred calls to the JVM."""
    body, before, after = f"{m}.body", f"{m}.before", f"{m}.after"
    groups = f"split(regexp_replace({body}, '^[^0-9A-Za-z]+|[^0-9A-Za-z]+$', ''), '[^0-9A-Za-z]+')"
    sizes = f"transform({groups}, g -> length(g))"
    digits = f"regexp_replace({body}, '[^0-9]', '')"
    term = "CAST(substr(r, i, 1) AS INT) * IF(i % 2 = 0, 2, 1)"
    luhn_sum = f"element_at(transform(array(reverse({digits})), r -> aggregate(sequence(1, length(r)), 0, (a, i) -> a + {term} - IF({term} > 9, 9, 0))), 1)"
    count = lambda chars: f"length({body}) - length(regexp_replace({body}, '{chars}', ''))"
    flag = lambda c: f"CAST({c} AS INT)"
    values = {
        "length": f"length({body})", "digits": f"length({digits})", "lower": count("[a-z]"), "upper": count("[A-Z]"), "hex": flag(f"{body} RLIKE '^(?:[0-9a-f]+|[0-9A-F]+)$'"),
        "groups": f"size({groups})", "longest": f"array_max({sizes})", "shortest": f"array_min({sizes})", "first": f"get({sizes}, 0)", "last": f"element_at({sizes}, -1)",
        "largest": f"coalesce(array_max(transform({groups}, g -> coalesce(try_cast(g AS BIGINT), 0))), 0)", "dots": count("[.]"), "spaces": count("[ ]"), "dashes": count("[-_]"), "slashes": count("[/]"),
        "opens": flag(f"{body} LIKE '(%'"), "bracketed": flag(f"{body} LIKE '%[%' OR {body} LIKE '%(.%'"), "luhn": flag(f"IF(length({digits}) > 0, {luhn_sum} % 10 = 0, false)"),
        "year": flag(rf"{body} RLIKE r'^(?:19|20)[0-9]{{2}}\b'"), "named": flag(rf"{before} RLIKE r'(?i)(?:{WORDS[kind]})[^\n]{{0,12}}$'"), "assigned": flag(rf"{before} RLIKE r'[=:]\s*[\x22\x27]?$'"),
        "quoted": flag(rf"{before} RLIKE r'[\x22\x27]$'"), "joined_before": flag(f"{before} RLIKE '[A-Za-z0-9_#$€.,/:-]$'"), "joined_after": flag(f"{after} RLIKE '^[A-Za-z0-9_%/:-]'"),
        "numbered": flag(f"{before} RLIKE '(?i)(?:no|nr|id|ref|order|invoice|version|isbn|page|date|commit|sha1?|md5|sum|file|img)[^a-z]{{0,3}}$'"),
    }
    return "named_struct(" + ", ".join(f"'{name}', CAST({value} AS DOUBLE)" for name, value in values.items()) + ")"


@dataclass(frozen=True)
class KindModel:
    """Trees as leaves ``(path, value)`` over named features, the score from which a candidate is personal, and what that gave on the calibration part."""

    bias: float
    trees: tuple[tuple[tuple[tuple[tuple[str, bool, float], ...], float], ...], ...]
    threshold: float
    precision: float = 0.0
    recall: float = 0.0

    def sql(self, f: str) -> str:
        """The score as an SQL expression over the fields of ``f``."""

        def grown(leaves: list, depth: int) -> str:
            if len(leaves) == 1 and len(leaves[0][0]) == depth:
                return f"{leaves[0][1]!r}D"
            name, _, cut = leaves[0][0][depth]
            side = lambda above: grown([x for x in leaves if x[0][depth][1] == above], depth + 1)
            return f"IF({f}.{name} > {cut!r}D, {side(True)}, {side(False)})"

        total = " + ".join([f"{self.bias!r}D", *(grown(list(leaves), 0) for leaves in self.trees)])
        return f"1D / (1D + exp(-({total})))"


def _snippets(kind: str, n: int = SNIPPETS, seed: int = 11) -> list[tuple[str, int]]:
    """Synthetic texts with one candidate each, and whether it is personal."""
    rng = random.Random(f"{seed}{kind}")
    d = lambda k: "".join(rng.choices("0123456789", k=k))
    h = lambda k: "".join(rng.choices("0123456789abcdef", k=k))
    long_ = lambda: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", k=rng.randint(30, 60))) + rng.choice("0123456789")
    any_ = lambda k: rng.choice("abcxyz") + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=k - 2)) + rng.choice("0123456789")
    word = lambda: "".join(rng.choices("aabcdeefghiilmnoorrssttuuäéñ", k=rng.randint(2, 11))) + rng.choice(["", "", "", "", ".", ",", "!!", "%%%", "***"])
    name = lambda: "".join(rng.choices("abcdefghilmnorstu", k=rng.randint(3, 9)))
    site = lambda: name() + rng.choice(["", "", "", f"-{name()}", f"-{d(1)}", d(2)])
    host = lambda: rng.choice(["", "", f"{site()}."]) + f"{site()}{rng.choice(['.', ' (dot) ', '[dot]', ' [dot] '])}{rng.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'edu', 'io'])}"
    part = lambda: str(rng.randint(0, rng.choice([9, 99, 255, 255])))
    group = lambda: rng.choice(["{:x}", "{:04x}"]).format(rng.randint(0, 65535))
    land = lambda: f"0{rng.choice('123456789')}{d(rng.choice([1, 2, 2, 3]))}"
    key = lambda: rng.choice(["token", "secret", "api_key", "apikey", "password", "passwd", "access_key", "auth_token", "private key", "client-secret", "TOKEN", "API_KEY"])
    sets = lambda: rng.choice([" = ", "=", ": ", ":", " := ", " is "]) + rng.choice(['"', '"', "'", ""])

    def card(valid: bool) -> str:
        body = rng.choice("3456") + d(14)
        weights = [int(c) * 2 if i % 2 == 0 else int(c) for i, c in enumerate(body)]
        check = -sum(w - 9 if w > 9 else w for w in weights) % 10
        number = body + str(check if valid else (check + rng.randint(1, 9)) % 10)
        return rng.choice(["{}.{}.{}.{}", "{}/{}/{}/{}", "{}_{}_{}_{}", "{}  {}  {}  {}"]).format(*(number[i : i + 4] for i in range(0, 16, 4)))

    good = {
        "email": [lambda: f"{name()} (at) {host()}", lambda: f"mail {name()}.{name()}[at]{host()}", lambda: f"contact: {name()}{d(2)} [at] {host()}", lambda: f"{name()}_{name()}(AT){host()}", lambda: f"{name()}{d(2)}(at){host()}"],
        "ip": [lambda: f"{name()} {rng.choice(['[.]', '(.)']).join(part() for _ in range(4))}", lambda: f"{name()} {':'.join(group() for _ in range(8))}", lambda: f"from {'[.]'.join(part() for _ in range(4))}", lambda: f"host {'(.)'.join(part() for _ in range(4))}", lambda: ":".join(group() for _ in range(8)), lambda: f"ip {group()}:{group()}::{group()}:{group()}", lambda: f"address 2001:db8:{group()}::{group()}:{group()}"],
        "card": [lambda: f"card {card(True)}", lambda: f"visa: {card(True)}", lambda: card(True)],
        "phone": [lambda: f"tel {land()} {d(rng.choice([7, 8]))}", lambda: f"phone: {land()}/{d(7)}", lambda: f"call {land()} {d(rng.choice([6, 7, 8]))}", lambda: f"mobile {land()}{d(7)}", lambda: f"fax {land()}-{d(7)}", lambda: f"call ({d(3)}) {d(3)}-{d(4)}", lambda: f"tel. {d(3)}-{d(3)}-{d(4)}", lambda: f"phone: 0{d(2)} {d(3)} {d(4)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"mobile 0{d(3)} {d(5)} {d(3)}", lambda: f"fax {d(3)}.{d(3)}.{d(4)}"],
        "secret": [lambda: f"{key()}{sets()}{h(rng.choice([32, 40, 64]))}", lambda: f"{key()}{sets()}{any_(rng.randint(18, 48))}", lambda: f"Bearer {any_(40)}", lambda: f"AKIA{any_(16).upper()}", lambda: f"{rng.choice(['ghp_', 'sk-', 'xoxb-'])}{any_(36)}", lambda: f"{key()}{sets()}{h(40).upper()}", lambda: f"{key()}{sets()}{long_()}"],
    }
    bad = {
        "email": [lambda: f"{name()} (at) {name()}.{d(2)}", lambda: f"we met {name()} (at) 7.30", lambda: f"score {d(2)} [at] {d(1)}.{d(1)}", lambda: f"{d(2)} (at) {d(2)}.{d(2)}"],
        "ip": [lambda: f"at {rng.randint(10, 23)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}", lambda: f"mac {':'.join(h(2) for _ in range(6))}", lambda: f"{rng.randint(1, 9)}:{rng.randint(10, 59)}:{rng.randint(10, 59)}", lambda: f"code {'[.]'.join(str(rng.randint(256, 999)) for _ in range(4))}", lambda: f"std::{h(3)}::{h(2)}", lambda: f"ratio {d(1)}:{d(1)}:{d(1)}"],
        "card": [lambda: card(False), lambda: f"ref {card(False)}", lambda: f"{d(4)} {d(4)} {d(4)}", lambda: f"isbn 9780-{d(4)}-{d(4)}-{d(3)}", lambda: f"{d(4)}.{d(4)}.{d(4)}", lambda: f"card {card(False)}"],
        "phone": [lambda: f"20{d(2)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", lambda: f"on {rng.randint(10, 28)}/{rng.randint(10, 12)}/20{d(2)}", lambda: f"version {d(2)}.{d(2)}.{d(3)}", lambda: f"{d(3)} {d(3)}", lambda: f"order {d(4)}-{d(4)}", lambda: f"{d(2)} {d(2)} {d(2)}", lambda: f"id {d(5)}-{d(5)}-{d(5)}", lambda: f"{d(3)} {d(4)} {d(5)} {d(3)}", lambda: f"{d(3)}.{d(2)}", lambda: f"order {land()} {d(8)}", lambda: f"{land()} {d(7)}", lambda: f"id {land()}{d(7)}", lambda: f"{land()}{d(7)}", lambda: f"ref {land()}/{d(7)}", lambda: f"isbn 978-{d(1)}{d(1)}-{d(4)}-{d(4)}", lambda: f"{d(4)}.{d(4)}", lambda: f"{d(2)}.{d(2)} {d(2)}.{d(2)}"],
        "secret": [lambda: d(16), lambda: d(rng.randint(17, 30)), lambda: f"commit {h(40)}", lambda: f"sha1 {h(40)}", lambda: f"md5 {h(32)}", lambda: f"id {h(8)}-{h(4)}-{h(4)}-{h(4)}-{h(12)}", lambda: f"file img_20{d(6)}_{d(6)}_{name()}", lambda: f"20{d(2)}-{d(2)}-{d(2)}T{d(2)}-{d(2)}-{d(2)}", lambda: f"{name()}{name()}{name()}{name()}{d(1)}", lambda: f"{name()}/{name()}/{name()}/{d(4)}", lambda: f"ref {any_(8).upper()}-{d(4)}-{d(4)}-{d(2)}", lambda: f"key {d(16)}", lambda: f"{name()}-{name()}-{name()}-{d(2)}-{name()}"],
    }
    made: dict[str, int] = {}
    for label, makers in ((1, good[kind]), (0, bad[kind])):
        for i in range(n // 2):
            lead, tail = " ".join(word() for _ in range(rng.randint(0, 5))), " ".join(word() for _ in range(rng.randint(0, 4)))
            made[f"{lead} {makers[i % len(makers)]()} {tail}".strip()] = label
    return sorted(made.items())


def _fit_kind(spark: SparkSession, kind: str) -> KindModel:
    snippets = spark.range(1, numPartitions=1).select(F.inline(F.from_json(F.lit(json.dumps([{"t": t, "y": y} for t, y in _snippets(kind)])), "array<struct<t:string,y:int>>")))
    found = snippets.select("t", "y", F.explode(F.expr(_matches("t", CANDIDATES[kind], CANDIDATE_NEEDS[kind], True))).alias("m"))
    rated = found.selectExpr("t", "y", f"{_features('m', kind)} AS f").select("t", "y", "f.*")
    names, rows_ = rated.columns[2:], sorted(tuple(r) for r in rated.collect())
    data, y = np.array([r[2:] for r in rows_], float), np.array([r[1] for r in rows_], float)
    fitted = np.arange(len(y)) % 3 != 0  # the rest calibrates
    cuts, bins = rulefit.binned(data)
    bias = float(np.log(y[fitted].mean() / (1 - y[fitted].mean())))
    score, trees = np.full(len(y), bias), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        weight = fitted.astype(float)
        _, leaves, out = rulefit.grow(data, bins, cuts, (y - p) * weight, p * (1 - p) * weight, DEPTH)
        score = score + RATE * out
        trees.append(tuple((tuple((names[j], above, float(cuts[j][k])) for j, above, k in path), float(RATE * v)) for path, v in leaves))
    p, truth = 1 / (1 + np.exp(-score[~fitted])), y[~fitted]
    good = [t for t in np.unique(p) if truth[p >= t].mean() >= PRECISION]
    if not good:
        return KindModel(bias, tuple(trees), 2.0)
    least = max(float(min(good)), 0.5)
    return KindModel(bias, tuple(trees), least, float(truth[p >= least].mean()), float((p >= least)[truth == 1].mean()))


_models: dict[str, KindModel] = {}


def models(spark: SparkSession) -> dict[str, KindModel]:
    """The fitted models, one per kind that has a generator; fitted once per driver."""
    for kind in CANDIDATES:
        if kind not in _models:
            _models[kind] = _fit_kind(spark, kind)
    return dict(_models)


#: The type of spans.
SPANS = "array<struct<start:bigint,end:bigint,kind:string>>"


def _clear(found: str, taken: str) -> str:
    """Those of ``found`` that overlap none of ``taken``: no end before them reaches into them, and the next start lies behind them."""
    mark = lambda spans, new, rank, score: f"transform({spans}, s -> named_struct('start', s.start, 'new', {new}, 'end', s.end, 'kind', s.kind, 'rank', {rank}, 'score', {score}))"
    ends, starts = _running_max(f"transform(o, s -> IF(s.new = 1, s.end, {LEAST}L))"), _running_max(f"transform(reverse(o), s -> IF(s.new = 1, -s.start, {LEAST}L))")
    keeps = "s.new = 2 AND get(m.ends, i) <= s.start AND -get(m.starts, size(o) - 1 - i) >= s.end"
    free = f"transform(filter(o, (s, i) -> {keeps}), s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind, 'rank', s.rank, 'score', s.score))"
    both = _bound(f"named_struct('ends', {ends}, 'starts', {starts})", "m", free)
    return f"IF(size({found}) > 0 AND size({taken}) > 0, {_bound(f'sort_array(concat({mark(taken, 1, 0, "0D")}, {mark(found, 2, "s.rank", "s.score")}))', 'o', both)}, {found})"


def _best(found: str) -> str:
    """Of spans that overlap each other the best scored, then the next that overlaps none taken. Only spans of one run of overlaps, which are few, are held against each other."""
    heads = f"array_compact(transform(s, (x, i) -> IF(i = 0 OR x.start >= get(e, i - 1), i, CAST(NULL AS INT))))"
    ordered = "sort_array(transform(g, x -> named_struct('below', -x.score, 'rank', x.rank, 'start', x.start, 'end', x.end, 'kind', x.kind)))"
    none = "CAST(array() AS ARRAY<STRUCT<below: DOUBLE, rank: INT, start: BIGINT, end: BIGINT, kind: STRING>>)"
    greedy = f"IF(size(g) = 1, {ordered}, aggregate({ordered}, {none}, (a, x) -> IF(exists(a, y -> y.start < x.end AND x.start < y.end), a, concat(a, array(x)))))"
    groups = f"flatten(transform(h, (x, j) -> {_bound('slice(s, x + 1, coalesce(get(h, j + 1), size(s)) - x)', 'g', greedy)}))"
    taken = _bound(_running_max("transform(s, x -> x.end)"), "e", _bound(heads, "h", groups))
    return _bound(f"sort_array({found})", "s", f"transform({taken}, x -> named_struct('start', x.start, 'end', x.end, 'kind', x.kind))")


def _order(spans: Column) -> Column:
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in ALL_KINDS]), s["kind"])
    keyed = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.transform(keyed, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))


def listed(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as in ``ALL_KINDS``, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def with_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Columns ``row`` (the document), ``text``, ``base`` and ``spans``: base spans, and base and added spans, in order."""
    fitted = models(docs.sparkSession)
    held = docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("some", F.col("text").rlike(ANY))
    none = F.array().cast(SPANS)
    # A text without digit or mark of an address is done after one short scan.
    base = F.when(F.col("some"), _order(F.concat(*[base_spans("text", k) for k in KINDS]))).otherwise(none)
    candidates = [f"IF(some, {_matches('text', CANDIDATES[kind], CANDIDATE_NEEDS[kind], True)}, NULL) AS found_{kind}" for kind in TURNS]
    out = held.withColumn("base", base).selectExpr("row", "text", "base", *candidates)
    score = {kind: _bound(_features("m", kind), "f", fitted[kind].sql("f")) for kind in TURNS}
    rated = [f"filter(transform(found_{kind}, m -> named_struct('start', m.start, 'end', m.end, 'kind', '{kind}', 'rank', {i}, 'score', {score[kind]})), c -> c.score >= {fitted[kind].threshold!r}D) AS found_{kind}" for i, kind in enumerate(TURNS)]
    out = out.selectExpr("row", "text", "base", *rated)
    empty = "CAST(array() AS ARRAY<STRUCT<start: BIGINT, end: BIGINT, kind: STRING, rank: INT, score: DOUBLE>>)"
    out = out.selectExpr("row", "text", "base", f"concat({', '.join(f'coalesce(found_{kind}, {empty})' for kind in TURNS)}) AS found")
    out = out.withColumn("found", F.expr(_clear("found", "base")))
    out = out.withColumn("spans", F.expr(f"IF(size(found) > 0, concat(base, {_best('found')}), base)"))
    return out.select("row", "text", "base", F.when(F.size("spans") > F.size("base"), _order(F.col("spans"))).otherwise(F.col("base")).alias("spans"))


def detect(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document the id, ``base`` and ``spans`` (arrays of ``start, end, kind``)."""
    return with_spans(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))).select(F.col("row.id").alias(id_col), "base", "spans")


def _merged(spans: str) -> Column:
    """Spans that overlap become one, from the first's start to the greatest end, of the first's kind."""

    def joined(x: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(x["ends"], F.greatest(i - 1, F.lit(0)))).otherwise(F.lit(LEAST))
        heads = F.filter(F.transform(x["s"], lambda s, i: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), i.alias("i"), (s["start"] >= before(i)).alias("new"))), lambda s: s["new"])
        last = lambda h, j: F.coalesce(F.get(h, j + 1)["i"], F.size(x["s"])) - 1
        return let(heads, lambda h: F.transform(h, lambda s, j: F.struct(s["start"].alias("start"), F.get(x["ends"], last(h, j)).alias("end"), s["kind"].alias("kind"))))

    return let(F.struct(F.col(spans).alias("s"), F.expr(_running_max(f"transform({spans}, s -> s.end)")).alias("ends")), joined)


def _rebuilt(text: Column, spans: Column) -> Column:
    """The text with each span replaced. Spans are taken in blocks, so that a piece is cut from its block's part of the text, not from the whole."""

    def of(s: Column) -> Column:
        end_of = lambda i: F.when(i >= 0, F.get(s, F.greatest(i, F.lit(0)))["end"]).otherwise(F.lit(0).cast("long"))
        blocks = F.sequence(F.lit(0), F.floor((F.size(s) - 1) / F.lit(BLOCK)).cast("int"))

        def block(b: Column) -> Column:
            held = F.slice(s, b * BLOCK + 1, BLOCK)
            origin = end_of(b * BLOCK - 1)
            upto = F.element_at(held, -1)["end"]
            parts = F.struct(held.alias("h"), origin.alias("o"), F.substr(text, (origin + 1).cast("int"), (upto - origin).cast("int")).alias("t"))

            def pieces(x: Column) -> Column:
                start = lambda i: F.when(i > 0, F.get(x["h"], F.greatest(i - 1, F.lit(0)))["end"]).otherwise(x["o"])
                piece = lambda v, i: F.substr(x["t"], (start(i) - x["o"] + 1).cast("int"), (v["start"] - start(i)).cast("int"))
                return F.array_join(F.transform(x["h"], lambda v, i: F.concat(piece(v, i), F.lit("["), F.upper(v["kind"]), F.lit("]"))), "")

            return let(parts, pieces)

        tail = F.substr(text, (F.element_at(s, -1)["end"] + 1).cast("int"), F.length(text))
        return F.concat(F.array_join(F.transform(blocks, block), ""), tail)

    return let(spans, of)


def redact(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one, named by the first.

    Null stays null. ``n_chars``, where ``docs`` has it, is the new length of a changed text.
    """
    found = with_spans(docs, text)
    clean = found.select("row", (F.size("spans") > 0).alias("changed"), F.when(F.size("spans") > 0, _rebuilt(F.col("text"), _merged("spans"))).alias("clean"))
    out = []
    for c in docs.columns:
        old = F.col("row")[c]
        new = F.col("clean") if c == text else F.length("clean").cast(docs.schema[c].dataType) if c == n_chars else None
        out.append((old if new is None else F.when(F.col("changed"), new).otherwise(old)).alias(c))
    return clean.select(*out)
