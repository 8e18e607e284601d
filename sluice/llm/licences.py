"""License scans by sentence rules, in DataFrame functions only.

A text is cut into sentences and each is normalised. Known sentences become identifiers; the row of identifiers is
matched against ordered rules. Everything happens inside a row: no explode, no shuffle, no Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

# Sentences of public licences and of their usual notices, without the end mark (an abbreviation's
# mark before a space ends one too).
SENTENCES = [
    ("mit-notice", "Released under the MIT License"),
    ("mit-notice", "Licensed under the MIT License"),
    ("mit-notice", "This project is licensed under the terms of the MIT license"),
    ("mit-title", "The MIT License (MIT)"),
    ("mit-title", "MIT License"),
    ("mit-grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software'),
    ("mit-grant-head", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("mit-keep", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit-warranty", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT'),
    ("mit-liability", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"),
    ("apache-notice", "Licensed under the Apache License, Version 2.0"),
    ("apache-notice-long", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License'),
    ("apache-copy", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-copy", "You may obtain a copy of the License at"),
    ("apache-basis", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'),
    ("gpl3-notice", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl3-notice", "Licensed under the GNU General Public License, version 3"),
    ("gpl-redistribute-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl-redistribute-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("lgpl-redistribute-3", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version"),
    ("agpl-redistribute-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("cc-by-nc-notice", "Licensed under CC BY-NC 4.0"),
    ("cc-by-notice", "Licensed under CC BY 4.0"),
    ("cc-by-sa-notice", "Licensed under CC BY-SA 4.0"),
    ("cc-by-notice", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-notice", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-notice", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("mpl-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v"),
    ("bsd-head", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("bsd-source", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd-binary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd-names", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc-grant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("apache-title", "Apache License"),
    ("apache-date", "Version 2.0, January 2004"),
    ("gpl-title", "GNU GENERAL PUBLIC LICENSE"),
    ("lgpl-title", "GNU LESSER GENERAL PUBLIC LICENSE"),
    ("agpl-title", "GNU AFFERO GENERAL PUBLIC LICENSE"),
    ("version-3-date", "Version 3, 29 June 2007"),
    ("version-3-date", "Version 3, 19 November 2007"),
    ("version-2-date", "Version 2, June 1991"),
    ("version-2.1-date", "Version 2.1, February 1999"),
    ("zlib-warranty", "This software is provided 'as-is', without any express or implied warranty"),
    ("zlib-grant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:"),
    ("boost-grant", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:'),
]

# SPDX identifiers of public licences and the names by which notices call them.
NAMES = [
    ("0BSD", ["Zero-Clause BSD License", "BSD Zero Clause License"]),
    ("AFL-3.0", ["Academic Free License, version 3.0", "Academic Free License v3.0"]),
    ("AGPL-3.0-only", ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "AGPLv3", "AGPL-3.0"]),
    ("Apache-1.1", ["Apache License, Version 1.1", "Apache Software License, Version 1.1"]),
    ("Apache-2.0", ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache 2.0", "Apache License v2.0"]),
    ("Artistic-2.0", ["Artistic License 2.0", "Artistic License, version 2.0"]),
    ("BSD-2-Clause", ["BSD 2-Clause License", "Simplified BSD License", "FreeBSD License", "2-Clause BSD License"]),
    ("BSD-3-Clause", ["BSD 3-Clause License", "New BSD License", "Revised BSD License", "3-Clause BSD License"]),
    ("BSL-1.0", ["Boost Software License, Version 1.0", "Boost Software License 1.0"]),
    ("CC-BY-3.0", ["Creative Commons Attribution 3.0 Unported License", "CC BY 3.0"]),
    ("CC-BY-4.0", ["Creative Commons Attribution 4.0 International License", "CC BY 4.0", "CC-BY 4.0"]),
    ("CC-BY-NC-4.0", ["Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0"]),
    ("CC-BY-NC-ND-4.0", ["Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "CC BY-NC-ND 4.0"]),
    ("CC-BY-NC-SA-4.0", ["Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC BY-NC-SA 4.0"]),
    ("CC-BY-ND-4.0", ["Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0"]),
    ("CC-BY-SA-3.0", ["Creative Commons Attribution-ShareAlike 3.0 Unported License", "CC BY-SA 3.0"]),
    ("CC-BY-SA-4.0", ["Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0"]),
    ("CC0-1.0", ["CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal", "CC0 1.0"]),
    ("CDDL-1.0", ["Common Development and Distribution License, Version 1.0", "Common Development and Distribution License (CDDL) Version 1.0"]),
    ("CPL-1.0", ["Common Public License, Version 1.0", "Common Public License Version 1.0"]),
    ("ECL-2.0", ["Educational Community License, Version 2.0"]),
    ("EPL-1.0", ["Eclipse Public License, Version 1.0", "Eclipse Public License v1.0", "Eclipse Public License - v 1.0"]),
    ("EPL-2.0", ["Eclipse Public License, Version 2.0", "Eclipse Public License v2.0", "Eclipse Public License - v 2.0"]),
    ("EUPL-1.2", ["European Union Public Licence, Version 1.2", "European Union Public Licence v. 1.2"]),
    ("GFDL-1.3-only", ["GNU Free Documentation License, Version 1.3"]),
    ("GPL-2.0-only", ["GNU General Public License, version 2", "GNU General Public License v2.0", "GPLv2", "GPL-2.0"]),
    ("GPL-3.0-only", ["GNU General Public License, version 3", "GNU General Public License v3.0", "GPLv3", "GPL-3.0"]),
    ("ISC", ["ISC License"]),
    ("LGPL-2.1-only", ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "LGPLv2.1", "LGPL-2.1"]),
    ("LGPL-3.0-only", ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "LGPLv3", "LGPL-3.0"]),
    ("LPPL-1.3c", ["LaTeX Project Public License, Version 1.3c"]),
    ("MIT", ["MIT License", "MIT license", "Expat License"]),
    ("MIT-0", ["MIT No Attribution License"]),
    ("MPL-1.1", ["Mozilla Public License, version 1.1", "Mozilla Public License Version 1.1"]),
    ("MPL-2.0", ["Mozilla Public License, version 2.0", "Mozilla Public License Version 2.0", "MPL 2.0"]),
    ("MS-PL", ["Microsoft Public License", "Microsoft Public License (Ms-PL)"]),
    ("NCSA", ["University of Illinois/NCSA Open Source License"]),
    ("ODbL-1.0", ["Open Database License (ODbL) v1.0", "Open Data Commons Open Database License v1.0"]),
    ("OFL-1.1", ["SIL Open Font License, Version 1.1", "SIL Open Font License 1.1"]),
    ("PostgreSQL", ["PostgreSQL License"]),
    ("Python-2.0", ["Python Software Foundation License Version 2", "PSF License"]),
    ("UPL-1.0", ["Universal Permissive License v 1.0", "Universal Permissive License (UPL), Version 1.0"]),
    ("Unlicense", ["Unlicense"]),
    ("WTFPL", ["Do What The Fuck You Want To Public License"]),
    ("Zlib", ["zlib License", "zlib/libpng License"]),
]
#: What notices say about a licence, by its name; a name of several words also stands alone, as a title.
FORMS = ["Licensed under {}", "Licensed under the {}", "Released under {}", "Released under the {}", "Distributed under the {}",
         "This project is licensed under the {}", "This project is licensed under the terms of the {}",
         "This software is licensed under the {}", "This software is released under the {}", "This work is licensed under a {}"]


def notices() -> list[tuple[str, str]]:
    """Identifiers and sentences that follow from ``NAMES`` and ``FORMS``."""
    out = []
    for licence, names in NAMES:
        out.append((f"notice {licence}", f"SPDX-License-Identifier: {licence}"))
        for name in names:
            out += [(f"notice {licence}", form.format(name)) for form in FORMS]
            if name.count(" ") > 1:
                out.append((f"notice {licence}", name))
    return out


#: Rules: licence and the identifiers that must follow one another. Longer rules come first and use up what they match.
RULES = [
    ("MIT", ["mit-title", "mit-grant", "mit-warranty", "mit-liability"]),
    ("MIT", ["mit-title", "mit-grant-head", "mit-keep", "mit-warranty", "mit-liability"]),
    ("MIT", ["mit-grant-head", "mit-keep", "mit-warranty"]),
    ("MIT", ["mit-grant", "mit-warranty"]),
    ("Apache-2.0", ["apache-notice-long", "apache-copy", "apache-basis"]),
    ("Apache-2.0", ["apache-notice-long", "apache-copy"]),
    ("BSD-3-Clause", ["bsd-head", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-head", "bsd-source", "bsd-binary"]),
    ("BSD-3-Clause", ["bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["apache-notice-long"]),
    ("Apache-2.0", ["apache-notice"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-title"]),
    ("GPL-3.0-only", ["gpl3-notice"]),
    ("GPL-3.0-or-later", ["gpl-redistribute-3"]),
    ("GPL-2.0-or-later", ["gpl-redistribute-2"]),
    ("LGPL-3.0-or-later", ["lgpl-redistribute-3"]),
    ("AGPL-3.0-or-later", ["agpl-redistribute-3"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-notice"]),
    ("CC-BY-4.0", ["cc-by-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-notice"]),
    ("MPL-2.0", ["mpl-notice"]),
    ("ISC", ["isc-grant"]),
    ("Unlicense", ["unlicense"]),
    ("Apache-2.0", ["apache-title", "apache-date"]),
    ("GPL-3.0-only", ["gpl-title", "version-3-date"]),
    ("GPL-2.0-only", ["gpl-title", "version-2-date"]),
    ("LGPL-3.0-only", ["lgpl-title", "version-3-date"]),
    ("LGPL-2.1-only", ["lgpl-title", "version-2.1-date"]),
    ("AGPL-3.0-only", ["agpl-title", "version-3-date"]),
    ("Zlib", ["zlib-warranty", "zlib-grant"]),
    ("BSL-1.0", ["boost-grant"]),
] + [(licence, [f"notice {licence}"]) for licence, _ in NAMES]

#: Known sentences follow one another if at most so many other sentences (a copyright line, a list number) are between.
GAP = 3

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_END = r"[.!?]+([ \t\r\f\x0B\x01]+|\z)"
_BLANK_LINE = r"\n[ \t\r]*\n"
_NOT_PLAIN = r"[^0-9a-z\x01]+"


def normal(sentence: str) -> str:
    """How a catalogue sentence looks after normalisation (one sentence, wherever its own marks would cut it)."""
    return re.sub("[^0-9a-z]+", " ", sentence.lower()).strip()


def sentences() -> list[tuple[str, str]]:
    """All known sentences; those given whole come last and count where both kinds know one."""
    return notices() + SENTENCES


def codes() -> dict[str, str]:
    """A code of one width for each identifier."""
    return {name: f"{i:03d}," for i, name in enumerate(dict.fromkeys(n for n, _ in sentences()))}


def sentence_codes() -> dict[str, str]:
    code = codes()
    return {normal(text): code[name] for name, text in sentences()}


def rule_codes() -> list[tuple[str, str]]:
    """(licence, its codes in a row), rules with more sentences first."""
    code = codes()
    return [(licence, "".join(code[n] for n in names)) for licence, names in sorted(RULES, key=lambda r: -len(r[1]))]


def _sentences(marked: Column) -> Column:
    return F.filter(F.transform(F.split(marked, "\x01"), lambda s: F.trim(s)), lambda s: s != "")


def _is_known(sentence: str) -> str:
    """SQL text, since a Column for each of many literals takes seconds to build. Normalised sentences hold no quotes."""
    return f"{sentence} in ({', '.join(repr(k) for k in sentence_codes())})"


def _identifiers(sentences: str) -> Column:
    """The codes of the known sentences of a column in order, with a bar where more than ``GAP`` others are between."""
    known = sentence_codes()
    placed = F.expr(f"filter(transform(`{sentences}`, (s, i) -> struct(i as at, s as s)), x -> {_is_known('x.s')})")
    table = F.map_from_arrays(F.split(F.lit("|".join(known)), "[|]"), F.split(F.lit("|".join(known.values())), "[|]"))
    first = F.struct(F.lit("").alias("row"), F.lit(None).cast("int").alias("at"))
    step = lambda acc, x: F.struct(F.concat(acc["row"], F.when(x["at"] - acc["at"] > GAP + 1, F.lit("|")).otherwise(F.lit("")),
                                            F.element_at(table, x["s"])).alias("row"), x["at"].alias("at"))
    return F.aggregate(placed, first, step, lambda acc: acc["row"])


def scan_licences(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with licences (names found, sorted, joined by commas; empty if none), n_rules and n_sentences.

    Blank lines cut a text into blocks. Sentences end at ``.``, ``!`` or ``?`` before white space and at the end of a
    block; a block is read twice, with lines as ends of sentences and as wrapped, and the reading that knows more
    sentences counts (lines on ties). So a list of notices and a wrapped licence in one text are both read.
    n_sentences are the known sentences, n_rules the rules matched, and licences the names of these rules. Whole texts
    are read. Case, marks and spacing do not count; letters beyond ASCII are taken as marks. Null and empty texts
    have none. Columns of ``docs`` named like the new ones are replaced.
    """
    plain = F.translate(F.coalesce(docs[text].cast("string"), F.lit("")), _UPPER, _LOWER)

    def read(block: Column) -> Column:
        marked = [F.regexp_replace(F.regexp_replace(F.replace(block, F.lit("\n"), F.lit(end)), _END, "\x01"), _NOT_PLAIN, " ") for end in ("\x01", " ")]
        return F.struct(_sentences(marked[0]).alias("lines"), _sentences(marked[1]).alias("wrapped"))

    longest = max(map(len, docs.columns))
    row, found = "r" * (longest + 1), "f" * (longest + 1)
    count = lambda some: f"size(filter({some}, s -> {_is_known('s')}))"
    better = F.expr(f"flatten(transform(`{row}`, x -> if({count('x.wrapped')} > {count('x.lines')}, x.wrapped, x.lines)))")
    rows = docs.withColumn(row, F.transform(F.split(plain, _BLANK_LINE), read)).withColumn(row, better)
    rows = rows.withColumn(row, _identifiers(row)).withColumn(found, _matched(F.col(row)))
    return rows.withColumns({
        "licences": F.array_join(F.array_sort(F.array_distinct(F.col(found)["names"])), ","), "n_rules": F.col(found)["n"],
        "n_sentences": F.length(F.regexp_replace(F.col(row), "[^,]", "")).cast("long")}).drop(row, found)


def _matched(row: Column) -> Column:
    """names of matched rules and n, how many matched, in a row of codes."""
    rules = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(pattern).alias("pattern")) for name, pattern in rule_codes()))
    start = lambda row: F.struct(row.alias("row"), F.array().cast("array<string>").alias("names"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, rule: Column) -> Column:
        left = F.replace(acc["row"], rule["pattern"], F.lit("#"))
        times = ((F.length(acc["row"]) - F.length(left)) / (F.length(rule["pattern"]) - 1)).cast("long")
        return F.struct(left.alias("row"), F.when(times > 0, F.concat(acc["names"], F.array(rule["name"]))).otherwise(acc["names"]).alias("names"),
                        (acc["n"] + times).alias("n"))

    return F.when(row == "", start(F.lit(""))).otherwise(F.aggregate(rules, start(row), step))


def oracle_sql() -> str:
    """DuckDB SQL for doc_id, licences, n_rules, n_sentences over ``documents``."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = sentence_codes()
    keys = "[" + ", ".join(map(quote, known)) + "]"
    vals = "[" + ", ".join(map(quote, known.values())) + "]"
    space = "[ \\t\\r\\f\\x0B\\x01]+"
    mark = lambda t: f"regexp_replace(regexp_replace({t}, '[.!?]+({space}|\\z)', chr(1), 'g'), '[^0-9a-z\\x01]+', ' ', 'g')"
    read = lambda end: f"list_filter(list_transform(string_split({mark(f'replace(b, chr(10), {end})')}, chr(1)), lambda s: trim(s)), lambda s: s <> '')"
    count = lambda some: f"len(list_filter({some}, lambda s: list_contains({keys}, s)))"
    bar = f"case when i > 1 and x.at - p[greatest(i - 1, 1)].at > {GAP + 1} then '|' else '' end"
    sql = f"""
    with blocks as (select doc_id, list_transform(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '\\n[ \\t\\r]*\\n'),
            lambda b: {{'l': {read('chr(1)')}, 'w': {read("' '")}}}) as b from documents),
    told as (select doc_id, flatten(list_transform(b, lambda x: case when {count('x.w')} > {count('x.l')} then x.w else x.l end)) as s from blocks),
    placed as (select doc_id, list_filter(list_transform(s, lambda x, i: {{'at': i, 'code': list_position({keys}, x)}}), lambda x: x.code is not null) as p from told),
    rows as (select doc_id, coalesce(array_to_string(list_transform(p, lambda x, i: {bar} || {vals}[x.code]), ''), '') as r0 from placed),
    step0 as (select doc_id, r0, (length(r0) - length(replace(r0, ',', '')))::bigint as n_sentences, 0::bigint as n, []::varchar[] as l from rows)"""
    for k, (name, pattern) in enumerate(rule_codes()):
        times = f"((length(r{k}) - length(replace(r{k}, {quote(pattern)}, '#'))) // {len(pattern) - 1})::bigint"
        sql += f""",
    step{k + 1} as (select doc_id, replace(r{k}, {quote(pattern)}, '#') as r{k + 1}, n_sentences, n + {times} as n,
        case when {times} > 0 then list_append(l, {quote(name)}) else l end as l from step{k})"""
    return f"""{sql}
    select doc_id, coalesce(array_to_string(list_sort(list_distinct(l)), ','), '') as licences, n as n_rules, n_sentences from step{len(rule_codes())}"""
