"""Licence scans by sentence rules, in DataFrame functions only.

A text is cut into sentences where white space follows ``.``, ``!`` or ``?``
(not after "v."); a line's end cuts nothing, since licence texts are wrapped. A
sentence is normalised (lower case, runs of anything but ASCII letters and
digits to one space, with a sign where a line ends or a clause is set off), and
known licence sentences are found in it from sign to sign, the longest first;
signs inside of one don't count. The identifiers of the sentences recognised, in text order,
are matched against rules, which are ordered sequences of identifiers. A rule
matches where its sequence stands without another licence sentence in between;
sentences that aren't known don't break it.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known licence sentences, already normalised, by identifier.
SENTENCES = {
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www apache org licenses license 2 0",
    "mit-notice": "released under the mit license",
    "mit-notice-2": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "mit-keep": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl3-notice-2": "licensed under the gnu general public license version 3",
    "gpl2-notice": "this work is licensed under the gnu general public license version 2",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty",
    "gpl-copy": "you should have received a copy of the gnu general public license along with this program",
    "lgpl3-notice": "licensed under the gnu lesser general public license version 3",
    "agpl3-notice": "licensed under the gnu affero general public license version 3",
    "mpl2-notice": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-notice": "licensed under the bsd license",
    "cc0-notice": "this work is dedicated to the public domain",
    "cc-by-notice": "licensed under cc by 4 0",
    "cc-by-sa-notice": "licensed under cc by sa 4 0",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "cc-by-nd-notice": "licensed under cc by nd 4 0",
    "cc-by-nc-sa-notice": "licensed under cc by nc sa 4 0",
    "reserved": "all rights reserved",
    "unlicense": "this is free and unencumbered software released into the public domain",
} | {f"spdx-{x.lower()}": f"spdx license identifier {x.lower().replace('-', ' ').replace('.', ' ')}" for x in ("MIT", "Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-3.0-only", "AGPL-3.0-only", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "Unlicense")}

# Rules, each an ordered sequence of sentence identifiers, and the licence they stand for.
RULES = [
    (("apache-notice",), "Apache-2.0"),
    (("apache-use", "apache-copy"), "Apache-2.0"),
    (("mit-notice",), "MIT"),
    (("mit-notice-2",), "MIT"),
    (("mit-grant", "mit-keep"), "MIT"),
    (("gpl3-notice",), "GPL-3.0-only"),
    (("gpl3-notice-2",), "GPL-3.0-only"),
    (("gpl2-notice",), "GPL-2.0-only"),
    (("gpl-free", "gpl-hope", "gpl-copy"), "GPL-unversioned"),
    (("lgpl3-notice",), "LGPL-3.0-only"),
    (("agpl3-notice",), "AGPL-3.0-only"),
    (("mpl2-notice",), "MPL-2.0"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-names"), "BSD-3-Clause"),
    (("bsd-grant", "bsd-source", "bsd-binary"), "BSD-2-Clause"),
    (("bsd-notice",), "BSD-unversioned"),
    (("cc0-notice",), "CC0-1.0"),
    (("cc-by-notice",), "CC-BY-4.0"),
    (("cc-by-sa-notice",), "CC-BY-SA-4.0"),
    (("cc-by-nc-notice",), "CC-BY-NC-4.0"),
    (("cc-by-nd-notice",), "CC-BY-ND-4.0"),
    (("cc-by-nc-sa-notice",), "CC-BY-NC-SA-4.0"),
    (("unlicense",), "Unlicense"),
    (("reserved",), "all-rights-reserved"),
    *(((f"spdx-{x.lower()}",), x) for x in ("MIT", "Apache-2.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-3.0-only", "AGPL-3.0-only", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "Unlicense")),
]

# Further sentences of licence texts and notices as they are published; these and LATER are beyond the SQL.
VARIANTS = {
    "you may obtain a copy of the license at https www apache org licenses license 2 0": "apache-copy",
    "you may obtain a copy of the license at http www apache org licenses license 2 0 txt": "apache-copy",
    "you may obtain a copy of the license at https www apache org licenses license 2 0 txt": "apache-copy",
    "apache license version 2 0 january 2004": "apache-title",
    "either version 2 of the license": "gpl-v2",
    "either version 2 1 of the license": "lgpl-v2.1",
    "either version 3 of the license": "gpl-v3",
    "or at your option any later version": "gpl-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "gpl2-free",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation": "gpl3-free",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl-free",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl-free",
    "this library is distributed in the hope that it will be useful but without any warranty": "gpl-hope",
    "you should have received a copy of the gnu lesser general public license along with this library": "lgpl-copy",
    "you should have received a copy of the gnu lesser general public license along with this program": "lgpl-copy",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation": "agpl-free",
    "you should have received a copy of the gnu affero general public license along with this program": "agpl-copy",
    "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-advert",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted": "isc-grant",
    "provided that the above copyright notice and this permission notice appear in all copies": "isc-keep",
    "this software is provided as is without any express or implied warranty": "zlib-as-is",
    "permission is granted to anyone to use this software for any purpose": "zlib-grant",
    "the origin of this software must not be misrepresented": "zlib-origin",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license": "bsl-grant",
    "distributed under the boost software license version 1 0": "bsl-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal with the software without restriction": "ncsa-grant",
    "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted": "postgresql-grant",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0": "epl1-notice",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution": "epl1-notice",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0": "epl2-notice",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0": "epl2-notice",
    "this program and the accompanying materials are made available under the terms of the eclipse public license v2 0": "epl2-notice",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl2-notice",
    "the contents of this file are subject to the terms of the common development and distribution license": "cddl-notice",
    "the contents of this file are subject to the mozilla public license version 1 1": "mpl1.1-notice",
    "this library is free software you can redistribute it and or modify it under the terms of the artistic license 2 0": "artistic2-notice",
    "this font software is licensed under the sil open font license version 1 1": "ofl-notice",
    "you just do what the fuck you want to": "wtfpl",
    "this license governs use of the accompanying software": "ms-pl",
    "this license agreement is between the python software foundation": "psf",
    "licensed under the eupl version 1 2": "eupl1.2-notice",
    "licensed under the eupl version 1 2 or later": "eupl1.2-notice",
    "licensed under a creative commons attribution 4 0 international license": "cc-by-text",
    "licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-text",
    "licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-text",
    "licensed under a creative commons attribution noderivatives 4 0 international license": "cc-by-nd-text",
    "licensed under a creative commons attribution noncommercial sharealike 4 0 international license": "cc-by-nc-sa-text",
    "licensed under a creative commons attribution noncommercial noderivatives 4 0 international license": "cc-by-nc-nd-text",
}
LATER = [
    (("apache-title",), "Apache-2.0"),
    (("gpl-free", "gpl-v2", "gpl-later", "gpl-hope", "gpl-copy"), "GPL-2.0-or-later"),
    (("gpl-free", "gpl-v3", "gpl-later", "gpl-hope", "gpl-copy"), "GPL-3.0-or-later"),
    (("gpl2-free",), "GPL-2.0-only"),
    (("gpl3-free",), "GPL-3.0-only"),
    (("lgpl-free", "lgpl-v2.1", "gpl-later", "gpl-hope", "lgpl-copy"), "LGPL-2.1-or-later"),
    (("lgpl-free", "gpl-v3", "gpl-later", "gpl-hope", "lgpl-copy"), "LGPL-3.0-or-later"),
    (("agpl-free", "gpl-v3", "gpl-later", "gpl-hope", "agpl-copy"), "AGPL-3.0-or-later"),
    (("mit-grant", "as-is"), "MIT-0"),
    (("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert"), "BSD-4-Clause"),
    (("isc-grant",), "0BSD"),
    (("isc-grant", "isc-keep"), "ISC"),
    (("zlib-as-is", "zlib-grant", "zlib-origin"), "Zlib"),
    (("bsl-grant",), "BSL-1.0"),
    (("bsl-notice",), "BSL-1.0"),
    (("ncsa-grant",), "NCSA"),
    (("postgresql-grant",), "PostgreSQL"),
    (("epl1-notice",), "EPL-1.0"),
    (("epl2-notice",), "EPL-2.0"),
    (("cddl-notice",), "CDDL-unversioned"),
    (("mpl1.1-notice",), "MPL-1.1"),
    (("artistic2-notice",), "Artistic-2.0"),
    (("ofl-notice",), "OFL-1.1"),
    (("wtfpl",), "WTFPL"),
    (("ms-pl",), "MS-PL"),
    (("psf",), "Python-2.0"),
    (("eupl1.2-notice",), "EUPL-1.2"),
    (("cc-by-text",), "CC-BY-4.0"),
    (("cc-by-sa-text",), "CC-BY-SA-4.0"),
    (("cc-by-nc-text",), "CC-BY-NC-4.0"),
    (("cc-by-nd-text",), "CC-BY-ND-4.0"),
    (("cc-by-nc-sa-text",), "CC-BY-NC-SA-4.0"),
    (("cc-by-nc-nd-text",), "CC-BY-NC-ND-4.0"),
]

#: Every known sentence holds one of these; most sentences of a corpus hold none and are left at that.
STEMS = "licen|permi|warrant|right|publi|softw|redistrib|endorse|identif|option|just do"

#: A sentence ends at white space after `.`, `!` or `?`, but not after "v.".
SENTENCE_END = r"(?<=[.!?])(?<!\b[vV]\.)[\x20\t\x0B\f\r\n]+"
#: What an element is called before "is licensed under".
_LEAD = r"\b((?:this|the) (?:code|software|project|program|file|package|library|module|repository|source code|document|work) is) (?=(?:; )*(?:licensed|released) under )"


def known_sentences(text: Column) -> Column:
    """Identifiers of the licence sentences of a text, in order."""
    known = {s: i for i, s in SENTENCES.items()} | VARIANTS
    some = F.filter(F.split(text, SENTENCE_END), lambda s: F.lower(s).rlike(STEMS))

    def signs(s: Column) -> Column:
        s = F.regexp_replace(F.lower(s), "[^a-z0-9\\n;:,()\"\u201c\u201d]+", " ")
        s = F.concat(F.lit("; "), F.trim(F.regexp_replace(s, "(?: ?[\\n;:,()\"\u201c\u201d])+ ?", " ; ")), F.lit(" ;"))
        s = F.regexp_replace(s, _LEAD, "$1 ; ")
        return F.regexp_replace(s, "neither the (?:; )?name (?:; )?of (?:[a-z0-9]+ |; ){1,20}?nor (?:; )?the (?:; )?names (?:; )?of (?:; )?its ", "neither the name of the copyright holder nor the names of its ")

    forms = "|".join(x.replace(" ", " (?:; )?") for x in sorted(known, key=lambda x: (-len(x), x)))
    found = F.flatten(F.transform(some, lambda s: F.regexp_extract_all(signs(s), F.lit(f"(?<=; )(?:{forms})(?= ;)"), F.lit(0))))
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    return F.transform(found, lambda s: F.element_at(names, F.replace(s, F.lit("; "), F.lit(""))))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, sentences, n_known, licenses`` for every row: known sentence identifiers in order, their number, and the licences found, sorted.

    Where a longer rule matches, a rule that it begins with doesn't match as well,
    but may elsewhere in the text. Null
    and empty texts have no sentences. Repeated rows and null identifiers are
    scanned like others; other columns are ignored; an empty table gives no rows.
    """
    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), known_sentences(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("sentences"))
    path = F.concat(F.lit(","), F.array_join("sentences", ","), F.lit(","))
    found = found.withColumn("path", path)

    def times(rule: tuple[str, ...]) -> Column:
        return F.regexp_count("path", F.lit(f",{re.escape(','.join(rule))}(?=,)"))

    hits = []
    for rule, name in RULES + LATER:
        longer = [r for r, _ in RULES + LATER if len(r) > len(rule) and r[: len(rule)] == rule]
        if longer:
            hit = times(rule) > reduce(Column.__add__, map(times, longer))
        else:
            hit = F.contains("path", F.lit(f",{','.join(rule)},"))
        hits.append(F.when(hit, F.lit(name)))
    licenses = F.array_sort(F.array_distinct(F.array_compact(F.array(*hits))))
    return found.select("doc_id", "sentences", F.size("sentences").cast("long").alias("n_known"), licenses.alias("licenses"))


def oracle() -> str:
    """DuckDB SQL of the query on ``documents``."""
    ids = ", ".join(f"('{s}', '{i}')" for i, s in SENTENCES.items())
    cases = []
    for rule, name in RULES:
        longer = [r for r, _ in RULES if len(r) > len(rule) and r[: len(rule)] == rule]
        test = " AND ".join([f"contains(path, ',{','.join(rule)},')", *(f"NOT contains(path, ',{','.join(r)},')" for r in longer)])
        cases.append(f"CASE WHEN {test} THEN '{name}' END")
    return rf"""
        WITH known(plain, id) AS (VALUES {ids}),
        s AS (
          SELECT doc_id, unnest(x) AS said, generate_subscripts(x, 1) AS place
          FROM (SELECT doc_id, regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?])[\x20\t\x0B\f\r]+', '\1' || chr(10), 'g'), '\n') AS x FROM documents)
        ), k AS (
          SELECT doc_id, place, id FROM s JOIN known ON trim(regexp_replace(lower(said), '[^a-z0-9]+', ' ', 'g')) = plain
        ), p AS (
          SELECT d.doc_id, coalesce(g.ids, '') AS sentences, coalesce(g.n, 0) AS n_known, ',' || coalesce(g.ids, '') || ',' AS path
          FROM documents d LEFT JOIN (SELECT doc_id, string_agg(id, ',' ORDER BY place) AS ids, count(*) AS n FROM k GROUP BY doc_id) g USING (doc_id)
        )
        SELECT doc_id, sentences, n_known,
          array_to_string(list_sort(list_distinct(list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL))), ',') AS licenses
        FROM p
    """
