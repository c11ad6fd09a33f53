"""Licence scans by sentence rules, in native expressions only.

A text is cut into sentences at blank lines (lines without a letter a-z or digit, so a line of comment marks alone is blank) and
at full stops and question marks that white space and then anything but a small letter or digit follows: ``v. 2.0`` is not cut.
A sentence may be wrapped, commented, or follow a line that has no stop; so not the sentence alone is looked up, but from the first word of each of its
lines on the longest known sentence that ends where a line ends, over any number of lines. What may be known there is found by the first
``HEAD`` words. Lines are normalised first (markup tags and lines without a word dropped, A-Z lowered, every run of other
characters than a-z, 0-9, ``.`` and ``+`` made one space, which also takes comment marks and quotes) and runs are trimmed of spaces and
stops. Known ones become identifiers, in text order. A line of a machine-readable tag becomes an identifier for each licence in its
expression (``OR``, ``AND``, ``WITH``, brackets, ``+`` and the older short names are read). A rule is an ordered list of identifiers with a licence; it matches if its
identifiers occur in this order, with others in between or not. A rule whose identifiers are part of those of a longer one that
matches, too, yields to it.
Work is done row by row; no step shuffles, and the tables of sentences and rules are constants of the plan.

Null and empty texts have no sentences and no licences, and an empty table gives an empty one. Rows are treated one by one, repeated
ones alike; texts are taken whole, in time in proportion to their length. Other columns are not read.
"""

from __future__ import annotations

import itertools
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Normalised sentences of public licences and notices, by identifier.
NOTICES = {
    "apache-licensed": "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license",
    "apache-software": "licensed under the apache license version 2.0 the license you may not use this software except in compliance with the license",
    "apache-asf": "the asf licenses this file to you under the apache license version 2.0 the license you may not use this file except in compliance with the license",
    "apache-obtain": "you may obtain a copy of the license at",
    "apache-unless": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mit-0-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-advertising": "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd-neither": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-as-is": "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "mpl-subject": "this source code form is subject to the terms of the mozilla public license v. 2.0",
    "epl-available": "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0 which is available at https www.eclipse.org legal epl 2.0",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-liable": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "boost-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "cc0-dedicated": "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "wtfpl-copy": "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
}
#: Names in one-line statements, by licence.
NAMES = {
    "0BSD": ["zero clause bsd license"],
    "AGPL-3.0": ["gnu affero general public license version 3", "gnu affero general public license v3.0", "agplv3"],
    "Apache-2.0": ["apache license version 2.0", "apache license 2.0", "apache 2.0 license"],
    "BSD-2-Clause": ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license"],
    "BSD-3-Clause": ["bsd 3 clause license", "3 clause bsd license", "new bsd license"],
    "BSL-1.0": ["boost software license version 1.0", "boost software license 1.0"],
    "EPL-2.0": ["eclipse public license 2.0", "eclipse public license v2.0"],
    "GPL-2.0": ["gnu general public license version 2", "gnu general public license v2.0", "gplv2"],
    "GPL-3.0": ["gnu general public license version 3", "gnu general public license v3.0", "gplv3"],
    "ISC": ["isc license"],
    "LGPL-2.1": ["gnu lesser general public license version 2.1", "lgplv2.1"],
    "LGPL-3.0": ["gnu lesser general public license version 3", "gnu lesser general public license v3.0", "lgplv3"],
    "MIT": ["mit license", "mit licence"],
    "MPL-2.0": ["mozilla public license 2.0", "mozilla public license version 2.0"],
    "Unlicense": ["unlicense"],
    "Zlib": ["zlib license"],
}
#: How one-line statements begin.
STATEMENTS = ("licensed under the", "released under the", "distributed under the", "available under the", "this work is licensed under the", "this project is licensed under the", "this software is licensed under the", "this program is licensed under the", "this work is released under the")
#: Families with headers of one wording, as (licence, name, versions).
GNU = (("GPL", "gnu general public license", ("1", "2", "3")), ("LGPL", "gnu lesser general public license", ("2.1", "3")), ("AGPL", "gnu affero general public license", ("3",)))
#: Terms of one family of licences and their full names.
CREATIVE = {"by": "attribution", "by sa": "attribution sharealike", "by nc": "attribution noncommercial", "by nd": "attribution noderivatives", "by nc sa": "attribution noncommercial sharealike", "by nc nd": "attribution noncommercial noderivatives"}
#: Identifiers and exceptions of machine-readable tags.
TAGS = (
    "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC0-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 CDDL-1.0 EPL-1.0 EPL-2.0 EUPL-1.2 "
    "GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1 MPL-2.0 MS-PL NCSA PostgreSQL Unlicense WTFPL Zlib"
).split()
#: Short names that came before those with ``only`` and ``or-later``, by family.
OLD = {"AGPL": ["3.0"], "GPL": ["2.0", "3.0"], "LGPL": ["2.1", "3.0"]}
EXCEPTIONS = {"Apache-2.0": ["LLVM-exception"], "GPL-2.0-only": ["Classpath-exception-2.0", "Linux-syscall-note"], "GPL-2.0-or-later": ["Classpath-exception-2.0", "Autoconf-exception-2.0"], "GPL-3.0-or-later": ["GCC-exception-3.1", "Autoconf-exception-3.0", "Bison-exception-2.2"]}


def _tag_id(tag: str) -> str:
    return f"spdx-{tag.lower().replace(' ', '-')}"


def _tags() -> dict[str, str]:
    """Identifiers by what a part of an expression is after normalising, with ``or later`` taken as ``+``."""
    plain = lambda t: t.lower().replace("-", " ").replace(" or later", "+")
    found = {plain(t): _tag_id(t) for t in TAGS} | {plain(f"{t} WITH {e}"): _tag_id(f"{t} WITH {e}") for t, es in EXCEPTIONS.items() for e in es}
    for family, versions in OLD.items():
        for v in versions:
            named = {f"{family} {v}": f"{family}-{v}-only", f"{family} {v}+": f"{family}-{v}-or-later"}
            found |= {k.lower(): _tag_id(t) for k, t in named.items()}
            found |= {f"{k.lower()} with {e.lower().replace('-', ' ')}": _tag_id(f"{t} WITH {e}") for k, t in named.items() for e in EXCEPTIONS.get(t, [])}
    return found


def _tables() -> tuple[dict[str, str], list[tuple[str, tuple[str, ...]]]]:
    """Identifiers by sentence, and rules."""
    known = {s: i for i, s in NOTICES.items()}
    rules: list[tuple[str, tuple[str, ...]]] = [
        ("Apache-2.0", ("apache-licensed", "apache-unless")), ("Apache-2.0", ("apache-software", "apache-unless")), ("Apache-2.0", ("apache-asf", "apache-unless")),
        ("MIT", ("mit-grant", "mit-notice")), ("MIT-0", ("mit-0-grant", "mit-as-is")), ("BSD-2-Clause", ("bsd-redistribution", "bsd-as-is")), ("BSD-3-Clause", ("bsd-redistribution", "bsd-neither", "bsd-as-is")),
        ("BSD-4-Clause", ("bsd-redistribution", "bsd-advertising", "bsd-neither", "bsd-as-is")), ("ISC", ("isc-grant", "isc-as-is")), ("0BSD", ("0bsd-grant", "isc-as-is")), ("MPL-2.0", ("mpl-subject",)),
        ("EPL-2.0", ("epl-available",)), ("Zlib", ("zlib-as-is", "zlib-liable", "zlib-grant")), ("BSL-1.0", ("boost-grant",)), ("Unlicense", ("unlicense-free",)), ("CC0-1.0", ("cc0-dedicated",)), ("WTFPL", ("wtfpl-copy",)),
    ]

    for scheme in ("http", "https"):  # the address belongs to the sentence before it, and has no stop of its own
        obtain = f"{NOTICES['apache-obtain']} {scheme} www.apache.org licenses license 2.0"
        known |= {obtain: "apache-obtain", f"{obtain} {NOTICES['apache-unless']}": "apache-unless"}

    def one(sentence: str, identifier: str, licence: str) -> None:
        known[sentence] = identifier
        if (licence, (identifier,)) not in rules:
            rules.append((licence, (identifier,)))

    for licence, names in NAMES.items():
        for start, name in itertools.product(STATEMENTS, names):
            one(f"{start} {name}", f"line-{licence.lower()}", licence)
    for short, name, versions in GNU:
        for subject in ("program", "library", "file"):
            known[f"this {subject} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"] = "gnu-hope"
            for v in versions:
                said, full = (f"{v}.0" if "." not in v else v), f"this {subject} is free software you can redistribute it and or modify it under the terms of the {name} as published by the free software foundation"
                later, only = f"gnu-{short.lower()}-{said}-or-later", f"gnu-{short.lower()}-{said}-only"
                known |= {f"{full} either version {v} of the license or at your option any later version": later, f"{full} version {v} of the license": only, f"{full} version {v}": only}
                rules += [r for r in ((f"{short}-{said}-or-later", (later, "gnu-hope")), (f"{short}-{said}-only", (only, "gnu-hope"))) if r not in rules]
    for (short, name), version in itertools.product(CREATIVE.items(), ("3.0", "4.0")):
        licence, place = f"CC-{short.upper().replace(' ', '-')}-{version}", "international" if version == "4.0" else "unported"
        for article, tail in itertools.product(("a", "the"), ("license", "licence")):
            one(f"this work is licensed under {article} creative commons {name} {version} {place} {tail}", f"work-{licence.lower()}", licence)
        for start in ("licensed under", "released under", "this work is licensed under"):
            one(f"{start} cc {short} {version}", f"line-{licence.lower()}", licence)
    for licence, names in NAMES.items():
        plain = licence.lower().replace("-", " ")
        for start, name in itertools.product(STATEMENTS, names):  # the short name in brackets behind the long one
            one(f"{start} {name} {plain}", f"line-{licence.lower()}", licence)
        for subject in ("project", "work", "software", "program"):
            one(f"this {subject} is {plain} licensed", f"line-{licence.lower()}", licence)
    for tag in [*TAGS, *(f"{t} WITH {e}" for t, es in EXCEPTIONS.items() for e in es)]:
        rules.append((tag, (_tag_id(tag),)))
    return known, rules


SENTENCES, RULES = _tables()
TAG_PARTS = _tags()
#: Words by which a sentence that may begin here is looked up; how a line of a tag begins.
HEAD, TAG_LINE = 3, "spdx license identifier "
MARKUP = r"</?[A-Za-z][^<>\n]*>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A stop, what may stand between it and white space, and the first character of the next sentence; the mark that is put between them; where sentences end.
STOP, MARK = r"([.?][^A-Za-z0-9 \t\n\r]*)[ \t\n\r]+([^a-z0-9 \t\n\r])", "\x1e"
CUT = MARK + r"|\n(?:[^A-Za-z0-9\n]*\n)+"
ODD = "[^a-z0-9.+]+"
#: A sentence without one of these is not known.
HINT = r"(?i)licen|permi|redistribut|copyright|warrant|software|hope|gpl|\bcc\b"


def _by_head() -> dict[str, list[dict]]:
    """Known sentences by their first words, the longest first."""
    out: dict[str, list[dict]] = {}
    for sentence, identifier in sorted(SENTENCES.items(), key=lambda x: (-len(x[0].split()), x[0])):
        words = sentence.split()
        out.setdefault(" ".join(words[:HEAD]), []).append({"s": sentence, "n": len(words), "id": identifier})
    return out


def _line(line: str) -> str:
    """SQL of a line as its words, joined by spaces."""
    return f"trim(regexp_replace(translate({line}, '{UPPER}', '{LOWER}'), '{ODD}', ' '))"


def identifiers(text: str) -> Column:
    """The identifiers of the known sentences of the column ``text``, in order."""
    heads = f"from_json('{json.dumps(_by_head())}', 'map<string,array<struct<s:string,n:int,id:string>>>')"
    tags = f"from_json('{json.dumps(TAG_PARTS)}', 'map<string,string>')"
    # Words of all lines, each with whether it begins or ends one; words of stops alone count as none.
    words = "filter(split(l, ' '), w -> w RLIKE '[^.]')"
    marked = f"flatten(transform(lines, l -> element_at(transform(array({words}), x -> transform(x, (w, j) -> named_struct('w', w, 'first', j = 0, 'last', j = size(x) - 1))), 1)))"
    run = "trim(BOTH ' .' FROM array_join(transform(slice(v, i + 1, {}), y -> y.w), ' '))"
    fits = f"coalesce(get(v, i + k.n - 1).last, false) AND {run.format('k.n')} = k.s"
    longest = f"get(filter(coalesce(try_element_at({heads}, {run.format(HEAD)}), array()), k -> {fits}), 0).id"
    # A tag stands in one line: its parts are its words up to there.
    rest = "substr(array_join(transform(slice(v, i + 1, CAST(array_position(transform(slice(v, i + 1, size(v)), y -> y.last), true) AS INT)), y -> y.w), ' '), 25)"
    parts = f"array_compact(transform(split(replace({rest}, ' or later', '+'), ' (?:or|and) '), p -> try_element_at({tags}, trim(BOTH ' .' FROM p))))"
    is_tag = f"concat({run.format(HEAD)}, ' ') = '{TAG_LINE}'"
    found = f"element_at(transform(array({marked}), v -> flatten(transform(v, (x, i) -> IF(NOT x.first, CAST(array() AS ARRAY<STRING>), IF({is_tag}, {parts}, array_compact(array({longest}))))))), 1)"
    lines = f"filter(transform(split(s, '\n'), l -> {_line('l')}), l -> l RLIKE '[^. ]')"
    sentences = f"filter(split(regexp_replace(regexp_replace({text}, r'{MARKUP}', ' '), r'{STOP}', '$1{MARK}$2'), r'{CUT}'), s -> s RLIKE r'{HINT}')"
    return F.expr(f"IF({text} RLIKE r'{HINT}', flatten(transform({sentences}, s -> element_at(transform(array({lines}), lines -> {found}), 1))), CAST(array() AS ARRAY<STRING>))")


def _pattern(ids: tuple[str, ...]) -> str:
    """Matches the identifiers in this order among others, each between its own pair of bars, so that nothing matches across two."""
    return "%" + "%".join(f"|{i}|" for i in ids) + "%"


def _part_of(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """Whether ``b`` holds ``a`` in order, and more."""
    rest = iter(b)
    return len(a) < len(b) and all(i in rest for i in a)


def _hits(j: str) -> list[str]:
    """Per rule an SQL expression: its licence if it matches the joined identifiers ``j`` and no longer rule does."""
    out = []
    for licence, ids in RULES:
        longer = [f"{j} NOT LIKE '{_pattern(more)}'" for other, more in RULES if other != licence and _part_of(ids, more)]
        out.append(f"CASE WHEN {' AND '.join([f"{j} LIKE '{_pattern(ids)}'", *longer])} THEN '{licence}' END")
    return out


def licences(ids: str) -> Column:
    """Licences of the rules that match the column ``ids``, sorted and without repeats."""
    found = f"sort_array(array_distinct(array_compact(array({', '.join(_hits('j'))}))))"
    return F.expr(f"IF(size({ids}) > 0, element_at(transform(array(concat('|', array_join({ids}, '||'), '|')), j -> {found}), 1), CAST(array() AS ARRAY<STRING>))")


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document its id, ``sentences`` (identifiers) and ``licences``."""
    held = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    found = held.select("id", identifiers("t").alias("sentences"))
    return found.select(F.col("id").alias(id_col), "sentences", licences("sentences").alias("licences"))


def oracle() -> str:
    """The same in DuckDB's SQL, with the query's columns."""
    known = ", ".join(f"('{s}', {len(s.split())}, '{i}')" for s, i in SENTENCES.items())
    tags = ", ".join(f"('{p}', '{i}')" for p, i in TAG_PARTS.items())
    hits = ", ".join(_hits("j"))
    body = f"string_split_regex(regexp_replace(regexp_replace(coalesce(text, ''), '{MARKUP}', ' ', 'g'), '{STOP}', '\\1' || chr(30) || '\\2', 'g'), chr(30) || '|\\n(?:[^A-Za-z0-9\\n]*\\n)+')"
    line = f"trim(regexp_replace(translate(l, '{UPPER}', '{LOWER}'), '{ODD}', ' ', 'g'), ' ')"
    return f"""
WITH known(s, m, id) AS (VALUES {known}), tags(part, id) AS (VALUES {tags}),
cut AS (SELECT r, unnest({body}) AS s, generate_subscripts({body}, 1) AS n FROM (SELECT text, row_number() OVER () AS r FROM documents) d),
lines AS (SELECT r, n, unnest(list_transform(string_split(s, chr(10)), lambda l: list_filter(string_split({line}, ' '), lambda w: regexp_matches(w, '[^.]')))) AS l FROM cut WHERE regexp_matches(s, '{HINT}')),
placed AS (SELECT r, n, l, CAST(sum(len(l)) OVER (PARTITION BY r, n ROWS UNBOUNDED PRECEDING) AS BIGINT) AS ends FROM lines WHERE len(l) > 0),
whole AS (SELECT r, n, flatten(list(l ORDER BY ends)) AS v, list(ends ORDER BY ends) AS ends FROM placed GROUP BY r, n),
starts AS (SELECT p.r, p.n, p.l, p.ends - len(p.l) AS i, v, w.ends FROM placed p JOIN whole w ON p.r = w.r AND p.n = w.n),
sentences AS (SELECT r, n, i, 0 AS k, arg_max(id, m) AS id FROM starts JOIN known ON trim(array_to_string(v[i + 1 : i + {HEAD}], ' '), ' .') = array_to_string(string_split(s, ' ')[1 : {HEAD}], ' ') AND list_contains(ends, i + m) AND trim(array_to_string(v[i + 1 : i + m], ' '), ' .') = s GROUP BY r, n, i),
expressions AS (SELECT r, n, i, string_split_regex(replace(substr(array_to_string(l, ' '), {len(TAG_LINE) + 1}), ' or later', '+'), ' (?:or|and) ') AS parts FROM starts WHERE starts_with(array_to_string(l, ' ') || ' ', '{TAG_LINE}')),
tagged AS (SELECT r, n, i, k, id FROM (SELECT r, n, i, trim(unnest(parts), ' .') AS part, generate_subscripts(parts, 1) AS k FROM expressions) JOIN tags USING (part)),
found AS (SELECT * FROM sentences UNION ALL SELECT * FROM tagged),
per AS (SELECT r, list(id ORDER BY n, i, k) AS ids FROM found GROUP BY r),
hit AS (SELECT doc_id, coalesce(ids, []) AS ids, '|' || coalesce(array_to_string(ids, '||'), '') || '|' AS j FROM (SELECT doc_id, row_number() OVER () AS rowid_ FROM documents) d LEFT JOIN per ON r = rowid_)
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentences,
  coalesce(array_to_string(list_sort(list_distinct(list_filter([{hits}], lambda x: x IS NOT NULL))), ','), '') AS licences
FROM hit"""
