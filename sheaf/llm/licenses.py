"""Licence recognition by rules over sentences.

A text is normalised to lower-case letters and digits with single spaces and bounds, which
are line ends and stops (full stop, question or exclamation mark, colon, semicolon) before
white space. A known licence sentence is found where its words run from a bound to a bound;
bounds between its words do not matter, so it may be wrapped over lines, but a line without
letters and digits ends it. Where several begin at one bound the longest is found, and
before it the one that is just its first line. A rule is an ordered list of sentence
identifiers; it matches where a text's identifiers hold them in this order with at most
``gap`` other known sentences between two of them.

Runs on built-in expressions over one row at a time: the known sentences are a small fixed
map in the plan, so nothing is shuffled, however the table is skewed.

Defined cases: a null or empty text has no sentences and no licences; a sentence or rule
that occurs several times counts once for the licence list and every time for the
sentence list; repeated rows and null ids each come back; an empty table gives no rows;
other columns pass through when asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.runtime import quoted

_GNU = "under the terms of the gnu {kind} public license as published by the free software foundation either version {version} of the license or at your option any later version"
_HOPE = "is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"

# Normalised licence sentences by identifier.
SENTENCES = {
    "agpl3-free": "this program is free software you can redistribute it and or modify it " + _GNU.format(kind="affero general", version="3"),
    "agpl-see": "see the gnu affero general public license for more details",
    "apache2-licensed": "licensed under the apache license version 2 0",
    "apache2-the-license": "licensed under the apache license version 2 0 the license",
    "apache2-not-use": "you may not use this file except in compliance with the license",
    "apache2-copy-at": "you may obtain a copy of the license at",
    "apache2-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache2-see": "see the license for the specific language governing permissions and limitations under the license",
    "bsd-redistribution": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsl-grant": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "cc-by-nc4": "licensed under cc by nc 4 0",
    "cc-by4": "licensed under cc by 4 0",
    "cc-by-sa4": "licensed under cc by sa 4 0",
    "cc0": "released under cc0 1 0 universal",
    "epl2": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at",
    "epl2-v": "this program and the accompanying materials are made available under the terms of the eclipse public license v2 0 which accompanies this distribution and is available at",
    "gpl2-work": "this work is licensed under the gnu general public license version 2",
    "gpl2-free": "this program is free software you can redistribute it and or modify it " + _GNU.format(kind="general", version="2"),
    "gpl3-work": "this work is licensed under the gnu general public license version 3",
    "gpl-free": "this program is free software you can redistribute it and or modify it " + _GNU.format(kind="general", version="3"),
    "gpl-hope": "this program " + _HOPE,
    "gpl-see": "see the gnu general public license for more details",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "isc-as-is": "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    "isc-liable": "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "lgpl21-free": "this library is free software you can redistribute it and or modify it " + _GNU.format(kind="lesser general", version="2 1"),
    "lgpl3-free": "this program is free software you can redistribute it and or modify it " + _GNU.format(kind="lesser general", version="3"),
    "lgpl3-library": "this library is free software you can redistribute it and or modify it " + _GNU.format(kind="lesser general", version="3"),
    "lgpl-hope": "this library " + _HOPE,
    "lgpl-see": "see the gnu lesser general public license for more details",
    "mit-released": "released under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "mpl2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl2-copy": "if a copy of the mpl was not distributed with this file you can obtain one at",
    "rights-reserved": "all rights reserved",
    "unlicense-free": "this is free and unencumbered software released into the public domain",
    "unlicense-anyone": "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "zero-bsd-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-liable": "in no event will the authors be held liable for any damages arising from the use of this software",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
}

# Rules as a licence and its sentences in order.
RULES = [
    ("0bsd", ["zero-bsd-grant", "isc-as-is"]),
    ("agpl-3.0-or-later", ["agpl3-free"]),
    ("apache-2.0", ["apache2-licensed"]),
    ("apache-2.0", ["apache2-the-license", "apache2-not-use", "apache2-copy-at"]),
    ("apache-2.0", ["apache2-not-use", "apache2-as-is", "apache2-see"]),
    ("bsd-2-clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("bsd-3-clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-names"]),
    ("bsl-1.0", ["bsl-grant"]),
    ("cc-by-nc-4.0", ["cc-by-nc4"]),
    ("cc-by-4.0", ["cc-by4"]),
    ("cc-by-sa-4.0", ["cc-by-sa4"]),
    ("cc0-1.0", ["cc0"]),
    ("epl-2.0", ["epl2"]),
    ("epl-2.0", ["epl2-v"]),
    ("gpl-2.0", ["gpl2-work"]),
    ("gpl-2.0-or-later", ["gpl2-free", "gpl-hope"]),
    ("gpl-3.0", ["gpl3-work"]),
    ("gpl-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-see"]),
    ("isc", ["isc-grant"]),
    ("lgpl-2.1-or-later", ["lgpl21-free"]),
    ("lgpl-3.0-or-later", ["lgpl3-free"]),
    ("lgpl-3.0-or-later", ["lgpl3-library"]),
    ("mit", ["mit-released"]),
    ("mit", ["mit-grant", "mit-notice"]),
    ("mpl-2.0", ["mpl2"]),
    ("proprietary", ["rights-reserved"]),
    ("unlicense", ["unlicense-free", "unlicense-anyone"]),
    ("zlib", ["zlib-as-is", "zlib-liable", "zlib-grant"]),
]

# Short identifiers that stand after "SPDX-License-Identifier:".
SHORT = ["0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0-only",
         "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib"]


def normalized(sentence: str) -> str:
    """What the expressions make of a sentence; for sentences given by callers."""
    import re

    return re.sub(r"[^a-z0-9]+", " ", sentence.lower()).strip()


SENTENCES |= {f"spdx-{x.lower()}": normalized(f"SPDX-License-Identifier: {x}") for x in SHORT}
RULES += [(x.lower(), [f"spdx-{x.lower()}"]) for x in SHORT]


def bounded(text: Column) -> Column:
    """The normalised text between bounds, each a ``|``; a line without letters gives two in a row."""
    cut = F.regexp_replace(F.coalesce(text, F.lit("")), r"[.!?:;][ \t\r\f]++(?!\n)", "\n")
    clean = F.regexp_replace(F.lower(F.concat(F.lit("\n"), cut, F.lit("\n"))), r"[^a-z0-9\n]+", " ")
    return F.regexp_replace(clean, r" ?\n ?", "|")


def sentence_ids(text: Column, known: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for name, s in known.items() for x in (s, name)])
    longest = sorted((s for s in known.values() if s), key=len, reverse=True)
    pattern = r"\|(?=(" + "|".join(s.replace(" ", "[ |]") for s in longest) + r")\|)"
    runs = F.regexp_extract_all(bounded(text), F.lit(pattern), F.lit(1))
    line = lambda run: F.substring_index(run, "|", 1)
    names = F.transform(runs, lambda run: F.array(
        F.when(run.contains("|"), F.try_element_at(table, line(run))), F.try_element_at(table, F.translate(run, "|", " "))))
    return F.filter(F.flatten(names), lambda x: x.isNotNull())


def rule_pattern(names: list[str], gap: int) -> str:
    return " " + f" (?:[^ ]+ ){{0,{gap}}}".join(names) + " "


def licenses(ids: Column, rules: list[tuple[str, list[str]]], gap: int) -> Column:
    """Sorted names of the licences whose rules the identifiers match."""
    line = F.concat(F.lit(" "), F.array_join(ids, " "), F.lit(" "))
    hits = [F.when(line.rlike(rule_pattern(names, gap)), F.lit(licence)) for licence, names in rules]
    return F.when(F.size(ids) == 0, F.array().cast("array<string>")).otherwise(
        F.array_sort(F.array_distinct(F.filter(F.array(*hits), lambda x: x.isNotNull())))
    )


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", known: dict[str, str] | None = None,
         rules: list[tuple[str, list[str]]] | None = None, gap: int = 2, keep: list[str] | None = None) -> DataFrame:
    """``id_col`` (and the columns ``keep``), ``sentence_ids`` and ``licenses``, arrays of strings."""
    known = SENTENCES if known is None else {k: normalized(v) for k, v in known.items()}
    rules = RULES if rules is None else rules
    if any(n not in known for _, names in rules for n in names):
        raise ValueError("a rule names an unknown sentence")
    kept = [F.col(quoted(c)) for c in [id_col, *(keep or [])]]
    found = docs.select(*kept, F.inline(F.array(F.struct(sentence_ids(F.col(quoted(text_col)), known).alias("sentence_ids")))))
    return found.withColumn("licenses", licenses(F.col("sentence_ids"), rules, gap))


def oracle() -> str:
    """The default scan as DuckDB SQL."""
    table = ", ".join(f"('{s}', '{name}')" for name, s in SENTENCES.items())
    rules = ", ".join(f"('{licence}', '{rule_pattern(names, 2)}')" for licence, names in RULES)
    return f"""
WITH known(s, name) AS (VALUES {table}), rules(licence, pattern) AS (VALUES {rules}),
s AS (
  SELECT doc_id, unnest(list_transform(string_split(regexp_replace(text, '([.!?])[ \\t\\r\\f]+', '\\1' || chr(10), 'g'), chr(10)),
    lambda x: trim(regexp_replace(lower(x), '[^a-z0-9]+', ' ', 'g')))) AS s, generate_subscripts(string_split(regexp_replace(text, '([.!?])[ \\t\\r\\f]+', '\\1' || chr(10), 'g'), chr(10)), 1) AS pos
  FROM documents
), ids AS (
  SELECT doc_id, string_agg(name, ' ' ORDER BY pos) AS line, count(*) AS n FROM s JOIN known USING (s) GROUP BY doc_id
), hit AS (
  SELECT doc_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licenses FROM ids JOIN rules ON regexp_matches(' ' || line || ' ', pattern) GROUP BY doc_id
)
SELECT d.doc_id, coalesce(ids.line, '') AS sentence_ids, coalesce(hit.licenses, '') AS licenses, CAST(coalesce(ids.n, 0) AS BIGINT) AS n_sentences
FROM documents d LEFT JOIN ids USING (doc_id) LEFT JOIN hit USING (doc_id)
"""
