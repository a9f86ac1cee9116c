"""Licence scan by sentence rules, in DataFrame functions only.

A text is normalised (lower case, runs of anything but a-z and 0-9 to one blank) and cut into sentences at blank lines
and at ``. ! ? ;`` before white space. Known licence sentences are looked for from the start of a line or sentence to the
end of one: a single line end is white space, so that hard-wrapped notices and headings on their own line are both found. Of known
sentences that start at one place the longest counts. A known sentence that a cut divides needs all its parts, and an address may stand in a paragraph of its own.
The identifiers found, in order, make the document's sequence. Rules are tried in their order; a rule
matches where its identifiers follow each other in the sequence, and what it matched is used up, so
that a full notice is not reported again as the short one it contains.

One projection over the scan: no shuffle and no Python. The table and the rules are literals, some hundreds
of entries each, most of them built from the list of licences: a declaration of the SPDX kind (of one identifier, not of an expression) and short statements.

Defined results: a null or empty text has no sentences, an empty sequence and no licence; an empty table gives no
rows. Rows are judged one by one, repeated ids and rows as well; columns other than the id and the text are not read, so
extra ones may have any name. Of rules that fit the same identifiers the earlier one counts. Long texts are scanned whole.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality_rules import let

#: Known sentences by identifier (fixed values: the wording of public licence notices).
SENTENCES = {
    "apache-short": "Licensed under the Apache License, Version 2.0",
    "apache-long": 'Licensed under the Apache License, Version 2.0 (the "License")',
    "apache-comply": "you may not use this file except in compliance with the License",
    "apache-obtain": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-asis": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "mit-short": "Released under the MIT License",
    "mit-licensed": "Licensed under the MIT License",
    "mit-name": "MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "gpl3-short": "This work is licensed under the GNU General Public License, version 3",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2-free": "This program is free software",
    "gpl2-redistribute": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "bsd-redistribute": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd-holder": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-university": "Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-author": "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "gpl2-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl2-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "gpl3-later": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version",
    "lgpl21-later": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl3-later": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl-program": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl3-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "epl2-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "epl1-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html",
    "mpl-obtain": "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    "mpl11-terms": 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License")',
    "cddl-terms": "The contents of this file are subject to the terms of the Common Development and Distribution License",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "zlib-asis": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "boost-name": "Boost Software License - Version 1.0 - August 17th, 2003",
    "boost-grant": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:',
    "mit0-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so',
    "wtfpl-copies": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed",
    "cc-by-nc-short": "Licensed under CC BY-NC 4.0",
    "cc-by-short": "Licensed under CC BY 4.0",
    "cc-by-sa-short": "Licensed under CC BY-SA 4.0",
    "cc0-short": "Licensed under CC0 1.0",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-nc-long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "mpl-short": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "reserved": "All rights reserved",
}

#: Licences by identifier, with the names that short statements call them by (fixed values).
NAMES = {
    "0BSD": ("BSD Zero Clause License",),
    "AFL-3.0": ("Academic Free License 3.0",),
    "AGPL-3.0-only": ("GNU Affero General Public License v3.0", "GNU Affero General Public License, version 3"),
    "AGPL-3.0-or-later": (),
    "Apache-1.1": ("Apache Software License, Version 1.1",),
    "Apache-2.0": ("Apache License 2.0", "Apache License, Version 2.0", "Apache 2.0 License"),
    "Artistic-2.0": ("Artistic License 2.0",),
    "BSD-2-Clause": ("BSD 2-Clause License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "New BSD License"),
    "BSD-4-Clause": ("BSD 4-Clause License",),
    "BSL-1.0": ("Boost Software License 1.0", "Boost Software License, Version 1.0"),
    "CC-BY-3.0": ("Creative Commons Attribution 3.0 Unported License",),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International License",),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International License",),
    "CC-BY-NC-ND-4.0": ("Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",),
    "CC-BY-NC-SA-4.0": ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",),
    "CC-BY-ND-4.0": ("Creative Commons Attribution-NoDerivatives 4.0 International License",),
    "CC-BY-SA-3.0": ("Creative Commons Attribution-ShareAlike 3.0 Unported License",),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International License",),
    "CC0-1.0": ("Creative Commons Zero v1.0 Universal License",),
    "CDDL-1.0": ("Common Development and Distribution License 1.0",),
    "CDDL-1.1": ("Common Development and Distribution License 1.1",),
    "CECILL-2.1": ("CeCILL Free Software License Agreement v2.1",),
    "ECL-2.0": ("Educational Community License, Version 2.0",),
    "EPL-1.0": ("Eclipse Public License 1.0", "Eclipse Public License v1.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v2.0"),
    "EUPL-1.2": ("European Union Public Licence 1.2",),
    "GPL-2.0-only": ("GNU General Public License v2.0", "GNU General Public License, version 2"),
    "GPL-2.0-or-later": (),
    "GPL-3.0-only": ("GNU General Public License v3.0", "GNU General Public License, version 3"),
    "GPL-3.0-or-later": (),
    "ISC": ("ISC License",),
    "LGPL-2.1-only": ("GNU Lesser General Public License v2.1", "GNU Lesser General Public License, version 2.1"),
    "LGPL-2.1-or-later": (),
    "LGPL-3.0-only": ("GNU Lesser General Public License v3.0", "GNU Lesser General Public License, version 3"),
    "LGPL-3.0-or-later": (),
    "MIT": ("MIT License",),
    "MIT-0": ("MIT No Attribution License",),
    "MPL-1.1": ("Mozilla Public License 1.1",),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, version 2.0"),
    "MS-PL": ("Microsoft Public License",),
    "NCSA": ("University of Illinois/NCSA Open Source License",),
    "OFL-1.1": ("SIL Open Font License, Version 1.1",),
    "OSL-3.0": ("Open Software License 3.0",),
    "PostgreSQL": ("PostgreSQL License",),
    "Python-2.0": ("Python License 2.0",),
    "Unlicense": ("Unlicense",),
    "UPL-1.0": ("Universal Permissive License v1.0",),
    "WTFPL": (),
    "Zlib": ("zlib License",),
}
STATEMENTS = ("Licensed under the %s", "Released under the %s", "Distributed under the %s", "This project is licensed under the %s", "This software is licensed under the %s", "This work is licensed under a %s", "This work is licensed under the %s")
for _id, _names in NAMES.items():
    SENTENCES[f"spdx-{_id}"] = f"SPDX-License-Identifier: {_id}"
    for _k, _name in enumerate(_names):
        for _n, _statement in enumerate(STATEMENTS):
            SENTENCES[f"stated-{_id}-{_k}-{_n}"] = _statement % _name

_BSD = ("bsd-redistribute", "bsd-source", "bsd-binary")
_THIRD = ("bsd-holder", "bsd-university", "bsd-author")
#: Licence by sequence of identifiers, tried in this order; sequences of one come last.
RULES = (
    ("Apache-2.0", ("apache-long", "apache-comply", "apache-obtain", "apache-asis")),
    ("Apache-2.0", ("apache-long", "apache-comply")),
    ("MIT", ("mit-name", "mit-grant", "mit-notice")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("AGPL-3.0-or-later", ("agpl3-later", "gpl-hope")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl2-redistribute")),
    *(("BSD-4-Clause", ("bsd-redistribute", "bsd-source", "bsd-binary", "bsd-advertising", third)) for third in _THIRD),
    *(("BSD-3-Clause", (*_BSD, third)) for third in _THIRD),
    ("BSD-2-Clause", _BSD),
    ("Zlib", ("zlib-asis", "zlib-grant")),
    ("BSL-1.0", ("boost-name", "boost-grant")),
    ("MPL-2.0", ("mpl-short", "mpl-obtain")),
    ("Apache-2.0", ("apache-short",)),
    ("Apache-2.0", ("apache-long",)),
    ("MIT", ("mit-short",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-grant",)),
    ("MIT-0", ("mit0-grant",)),
    ("GPL-3.0-only", ("gpl3-short",)),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("GPL-3.0-or-later", ("gpl3-later",)),
    ("GPL-2.0-or-later", ("gpl2-later",)),
    ("GPL-2.0-only", ("gpl2-only",)),
    ("LGPL-2.1-or-later", ("lgpl21-later",)),
    ("LGPL-3.0-or-later", ("lgpl3-later",)),
    ("LGPL-3.0-or-later", ("lgpl-program",)),
    ("AGPL-3.0-or-later", ("agpl3-later",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-short",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-long",)),
    ("CC-BY-4.0", ("cc-by-short",)),
    ("CC-BY-4.0", ("cc-by-long",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-short",)),
    ("CC0-1.0", ("cc0-short",)),
    ("MPL-2.0", ("mpl-short",)),
    ("MPL-1.1", ("mpl11-terms",)),
    ("CDDL-1.0", ("cddl-terms",)),
    ("EPL-2.0", ("epl2-terms",)),
    ("EPL-1.0", ("epl1-terms",)),
    ("ISC", ("isc-grant",)),
    ("0BSD", ("0bsd-grant",)),
    ("Unlicense", ("unlicense",)),
    ("Zlib", ("zlib-grant",)),
    ("BSL-1.0", ("boost-name",)),
    ("BSL-1.0", ("boost-grant",)),
    ("WTFPL", ("wtfpl-copies",)),
    *((name, (f"spdx-{name}",)) for name in NAMES),
    *((name, (f"stated-{name}-{k}-{n}",)) for name, called in NAMES.items() for k in range(len(called)) for n in range(len(STATEMENTS))),
)

#: White space as both engines' patterns write it, and where a sentence ends.
SPACE = "[ \\t\\n\\x0B\\f\\r]"
STOP = f"[.!?;]+(?:{SPACE}|\\z)"
#: Stands for a cut in a normalised text.
MARK = "\x01"


#: What a text is brought to, step by step: pattern and replacement.
STEPS = ((STOP, MARK), (f"[^a-z0-9\n{MARK}]+", " "), (" ?\n ?", "\n"), ("\n{2,}", MARK))


def normalise(sentence: str) -> str:
    """What ``license_scan`` does to a sentence, for the table's keys (and for tests)."""
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip()


def known_keys(sentences: dict[str, str]) -> dict[str, str]:
    """Identifier by normalised sentence, its parts joined by cuts; of equal sentences the first counts."""
    keys: dict[str, str] = {}
    for name, sentence in sentences.items():
        parts = [normalise(part) for part in re.split(r"[.!?;]+(?:\s|$)|\n", sentence)]
        if any(parts):
            keys.setdefault(MARK.join(p for p in parts if p), name)
    return keys


def pattern_of(keys) -> str:
    """Any key between line or sentence ends, the longest first. Keys of one first word share it, so a line costs its first word in most cases."""
    spaced = lambda k: re.sub(" (?=https? )", f"[ \n{MARK}]", k).replace(" ", "[ \n]").replace("[[ \n]\n", "[ \n")
    by_word: dict[str, list[str]] = {}
    for key in sorted(keys, key=len, reverse=True):
        word = re.match("[a-z0-9]+", key)[0]
        by_word.setdefault(word, []).append(spaced(key)[len(word):])
    return "|".join(f"{word}(?:{'|'.join(rests)})" for word, rests in by_word.items())


def license_scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", sentences=None, rules=RULES) -> DataFrame:
    """doc_id, n_known, sentence_ids (array), licenses (array, in rule order) and license (the first, or null)."""
    keys = known_keys(sentences or SENTENCES)
    table = F.create_map(*[F.lit(x) for pair in keys.items() for x in pair])
    wanted = f"[\n{MARK}]({pattern_of(keys)})(?=[\n{MARK}])"
    # each identifier has blanks of its own, so that notices that follow each other are all used up
    tried = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(" " + "  ".join(ids) + " ").alias("ids")) for name, ids in rules])

    def known(plain):
        return F.filter(F.transform(F.regexp_extract_all(plain, F.lit(wanted), F.lit(1)), lambda x: F.try_element_at(table, F.regexp_replace(F.translate(x, "\n", " "), f"{MARK}(https? )", " $1"))), lambda x: x.isNotNull())

    def matched(ids):
        start = F.struct(F.concat(F.lit(" "), F.array_join(ids, "  "), F.lit(" ")).alias("rest"), F.array().cast("array<string>").alias("names"))

        def step(acc, rule):
            hit = F.contains(acc["rest"], rule["ids"])
            return F.struct(F.when(hit, F.replace(acc["rest"], rule["ids"], F.lit(" | "))).otherwise(acc["rest"]).alias("rest"), F.when(hit, F.concat(acc["names"], F.array(rule["name"]))).otherwise(acc["names"]).alias("names"))

        return F.when(F.size(ids) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(F.aggregate(tried, start, step, lambda acc: acc["names"])))

    plain = F.translate(F.lower(F.coalesce(F.col(text), F.lit(""))), MARK, "\x02")
    for pattern, to in STEPS:
        plain = F.regexp_replace(plain, pattern, to)
    plain = F.regexp_replace(F.concat(F.lit(MARK), plain, F.lit(MARK)), f"[ \n{MARK}]*{MARK}[ \n{MARK}]*", MARK)
    ids = let(plain, known)
    out = docs.select(F.col(doc_id).alias("doc_id"), let(ids, lambda i: F.struct(i.alias("ids"), matched(i).alias("names"))).alias("r"))
    return out.select("doc_id", F.size("r.ids").cast("bigint").alias("n_known"), F.col("r.ids").alias("sentence_ids"), F.col("r.names").alias("licenses"), F.get("r.names", F.lit(0)).alias("license"))


def oracle(sentences=None, rules=RULES) -> str:
    """DuckDB SQL of the query's rows, with the arrays joined by blanks.

    Segments between line and sentence ends are joined with known sentences by their first word and compared from there on; of those that
    start at one segment the longest stays, and a text's are then taken from left to right without overlap.
    """
    keys = known_keys(sentences or SENTENCES)
    quoted = lambda s: "'" + s.replace(MARK, "' || chr(1) || '") + "'"
    table = ", ".join(f"({quoted(k)}, '{v}')" for k, v in keys.items())
    plain = "replace(lower(coalesce(text, '')), chr(1), chr(2))"
    sql = lambda s: quoted(s.replace("\n", "\\n"))
    for pattern, to in STEPS:
        plain = f"regexp_replace({plain}, {sql(pattern)}, {'chr(10)' if to == chr(10) else quoted(to)}, 'g')"
    mark, any_ = "chr(1)", "'[ \\n' || chr(1) || ']*'"
    plain = f"regexp_replace({mark} || {plain} || {mark}, {any_} || {mark} || {any_}, {mark}, 'g')"
    several = [(name, ids) for name, ids in rules if len(ids) > 1]
    single = rules[len(several):]
    if any(len(ids) > 1 for _, ids in single):
        raise ValueError("sequences of one identifier come last")
    steps, last = [], "seq"
    for k, (name, ids) in enumerate(several):
        pattern = " " + "  ".join(ids) + " "
        steps.append(f"s{k} AS (SELECT *, contains({last}, '{pattern}') AS h{k}, replace({last}, '{pattern}', ' | ') AS q{k} FROM {'t' if not k else f's{k - 1}'})")
        last = f"q{k}"
    names = ", ".join(f"CASE WHEN h{k} THEN '{name}' END" for k, (name, _) in enumerate(several))
    one = ", ".join(f"({k}, '{ids[0]}', '{name}')" for k, (name, ids) in enumerate(single))
    return f"""
WITH RECURSIVE k(s, id) AS (VALUES {table}),
w AS (SELECT s, id, regexp_extract(s, '^[a-z0-9]+') AS word FROM k),
d AS (SELECT row_number() OVER () AS r, doc_id, {plain} AS p FROM documents),
l AS (SELECT r, p, string_split_regex(p, '[\\n' || chr(1) || ']') AS segments FROM d),
u AS (SELECT r, p, unnest(segments) AS g, unnest(range(len(segments))) AS i FROM l),
o AS (SELECT r, p, g, 1 + coalesce(sum(length(g) + 1) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM u),
f AS (SELECT o.r, o.pos, max(struct_pack(n := length(w.s), id := w.id)) AS m FROM o JOIN w ON split_part(o.g, ' ', 1) = w.word
      WHERE o.pos > 1 AND substr(o.p, o.pos + length(w.s), 1) IN (chr(10), chr(1))
        AND regexp_replace(replace(substr(o.p, o.pos, length(w.s)), chr(10), ' '), chr(1) || '(https? )', ' \\1', 'g') = w.s GROUP BY o.r, o.pos),
walk AS (SELECT r, min(struct_pack(pos := pos, upto := pos + m.n, id := m.id)) AS x FROM f GROUP BY r
      UNION ALL SELECT f.r, min(struct_pack(pos := f.pos, upto := f.pos + f.m.n, id := f.m.id)) FROM walk JOIN f ON f.r = walk.r AND f.pos > walk.x.upto GROUP BY f.r),
n AS (SELECT r, list(x.id ORDER BY x.pos) AS ids FROM walk GROUP BY r),
t AS (SELECT d.r, d.doc_id, coalesce(n.ids, []) AS ids, ' ' || coalesce(array_to_string(n.ids, '  '), '') || ' ' AS seq FROM d LEFT JOIN n USING (r)),
{", ".join(steps)},
one(i, id, name) AS (VALUES {one}),
rest AS (SELECT r, unnest(string_split({last}, ' ')) AS id FROM s{len(several) - 1} WHERE len(ids) > 0),
tail AS (SELECT rest.r, list(one.name ORDER BY one.i) AS names FROM rest JOIN one USING (id) GROUP BY rest.r),
e AS (SELECT doc_id, ids, list_concat(list_filter([{names}], lambda x: x IS NOT NULL), coalesce(tail.names, [])) AS names FROM s{len(several) - 1} LEFT JOIN tail USING (r)),
g AS (SELECT doc_id, ids, list_filter(names, lambda x, i: list_position(names, x) = i) AS names FROM e)
SELECT doc_id, len(ids)::BIGINT AS n_known, array_to_string(ids, ' ') AS sentence_ids, array_to_string(names, ' ') AS licenses, names[1] AS license FROM g"""
