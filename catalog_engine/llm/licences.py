"""Licence scan by sentence rules: known licence sentences become identifiers, and runs of identifiers match ordered rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNDER = r"(this (software|work|project|file|code|program|library) is )?(released|(dual )?licensed|distributed|available|provided) under (either )?(of )?(a |the )?(terms of )?(the )?"
# Sentences of public licences and of the usual notices, as patterns over normalised text (lower case, words
# separated by single spaces, no other signs). Each matches from the start of a line or sentence to the end of one; a space also
# stands for a line end inside the sentence, `` .*`` at the end for a rest of the line or nothing, and ``.*`` inside for some words.
SENTENCES = (
    (1, UNDER + r"(mit|expat)( licen[sc]e)?"),
    (2, r"permission is hereby granted free of charge to any person obtaining a copy of this software .*"),
    (3, r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    (4, r"the software is provided as is without warranty of any kind .*"),
    (5, UNDER + r"apache( licen[sc]e)?( version| v)? ?v?2( 0)?( licen[sc]e)?( the licen[sc]e)?"),
    (6, r"you may not use this file except in compliance with the licen[sc]e"),
    (7, r"you may obtain a copy of the licen[sc]e at .*"),
    (8, r"unless required by applicable law or agreed to in writing software distributed under the licen[sc]e is distributed on an as is basis .*"),
    (9, UNDER + r"(gnu )?(gpl|general public licen[sc]e)( gpl)?( as published by the free software foundation)?( either)?( version)? ?v? ?3( of the licen[sc]e)?( 0)?( or at your option any later version)?"),
    (10, UNDER + r"(gnu )?(gpl|general public licen[sc]e)( gpl)?( as published by the free software foundation)?( either)?( version)? ?v? ?2( of the licen[sc]e)?( 0)?( or at your option any later version)?"),
    (11, r"this (program|library|software|file) is free software you can redistribute it and or modify it under the terms of (the )?gnu general public licen[sc]e as published by the free software foundation( either)? version 3( of the licen[sc]e)?( or at your option any later version)?"),
    (12, r"this (program|library|software|file) is free software you can redistribute it and or modify it under the terms of (the )?gnu general public licen[sc]e as published by the free software foundation( either)? version 2( of the licen[sc]e)?( or at your option any later version)?"),
    (13, r"this (program|library|software|file) is distributed in the hope that it will be useful but without any warranty .*"),
    (14, UNDER + r"(creative commons|cc) (by nc|attribution noncommercial)( (4|4 0|3|3 0))?( international)?( licen[sc]e)?"),
    (15, UNDER + r"(creative commons|cc) (by sa|attribution sharealike)( (4|4 0|3|3 0))?( international)?( licen[sc]e)?"),
    (16, UNDER + r"(creative commons|cc) (by|attribution)( (4|4 0|3|3 0))?( international)?( licen[sc]e)?"),
    (17, r"redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    (18, r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer .*"),
    (19, r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer .*"),
    (20, r"neither the names? of .* may be used to endorse or promote products derived from this software without specific prior written permission .*"),
    (21, r"this software is provided by .* as is and any express or implied warranties .*"),
    (22, r"spdx licen[sc]e identifier mit"),
    (23, r"spdx licen[sc]e identifier apache 2 0"),
    (24, r"spdx licen[sc]e identifier gpl 3 0( only| or later)?"),
    (25, r"spdx licen[sc]e identifier gpl 2 0( only| or later)?"),
    (26, r"this (program|library|software|file) is free software you can redistribute it and or modify it under the terms of (the )?gnu (lesser|library) general public licen[sc]e as published by the free software foundation( either)? version (2 1|3)( of the licen[sc]e)?( or at your option any later version)?"),
    (27, r"this (program|library|software|file) is free software you can redistribute it and or modify it under the terms of (the )?gnu affero general public licen[sc]e as published by the free software foundation( either)? version 3( of the licen[sc]e)?( or at your option any later version)?"),
    (28, UNDER + r"(gnu )?(lgpl|lesser general public licen[sc]e)( lgpl)?( version)?( v)?( ?(2 1|3)( 0)?)?( of the licen[sc]e)?( or at your option any later version)?"),
    (29, UNDER + r"(gnu )?(agpl|affero general public licen[sc]e)( agpl)?( version)?( v)?( ?3( 0)?)?( of the licen[sc]e)?( or at your option any later version)?"),
    (30, r"this source code form is subject to the terms of the mozilla public licen[sc]e( version| v)? 2 0"),
    (31, UNDER + r"(mpl|mozilla public licen[sc]e)( version| v)? 2( 0)?"),
    (32, r"permission to use copy modify and (or )?distribute this software for any purpose with or without fee is hereby granted .*"),
    (33, UNDER + r"isc licen[sc]e"),
    (34, r"this is free and unencumbered software released into the public domain"),
    (35, UNDER + r"(cc0|creative commons zero)( 1 0)?( universal)?( licen[sc]e)?"),
    (36, UNDER + r"boost software licen[sc]e( version)? 1 0"),
    (37, UNDER + r"((3 clause|new|modified|revised) bsd|bsd 3 clause)( licen[sc]e)?"),
    (38, UNDER + r"((2 clause|simplified|freebsd) bsd|bsd 2 clause)( licen[sc]e)?"),
    (39, UNDER + r"(creative commons|cc) (by nc sa|attribution noncommercial sharealike)( (4|4 0|3|3 0))?( international)?( licen[sc]e)?"),
    (40, UNDER + r"(creative commons|cc) (by nc nd|attribution noncommercial noderiv(ative)?s)( (4|4 0|3|3 0))?( international)?( licen[sc]e)?"),
    (41, UNDER + r"(creative commons|cc) (by nd|attribution noderiv(ative)?s)( (4|4 0|3|3 0))?( international)?( licen[sc]e)?"),
    (42, r"spdx licen[sc]e identifier lgpl (2 1|3 0)( only| or later)?"),
    (43, r"spdx licen[sc]e identifier agpl 3 0( only| or later)?"),
    (44, r"spdx licen[sc]e identifier mpl 2 0"),
    (45, r"spdx licen[sc]e identifier isc"),
    (46, r"spdx licen[sc]e identifier unlicense"),
    (47, r"spdx licen[sc]e identifier cc0 1 0"),
    (48, r"spdx licen[sc]e identifier bsl 1 0"),
    (49, r"spdx licen[sc]e identifier bsd 3 clause"),
    (50, r"spdx licen[sc]e identifier bsd 2 clause"),
    (51, UNDER + r"(epl|eclipse public licen[sc]e)( epl)?( version| v)? ?v?(1|2)( 0)?"),
    (52, r"spdx licen[sc]e identifier epl (1|2) 0"),
    (53, UNDER + r"(zlib|zlib libpng)( licen[sc]e)?"),
    (54, r"this software is provided as is without any express or implied warranty"),
    (55, r"spdx licen[sc]e identifier zlib"),
    (56, UNDER + r"artistic licen[sc]e( version| v)? ?v?2( 0)?"),
    (57, r"spdx licen[sc]e identifier artistic 2 0"),
)
# Ordered rules (licence, identifiers). Sentences that are no licence sentences may stand between them. At one
# place the first rule that fits wins, so longer rules come first.
RULES = (
    ("MIT", (2, 3, 4)),
    ("MIT", (1,)),
    ("MIT", (2,)),
    ("MIT", (22,)),
    ("Apache-2.0", (5, 6, 7, 8)),
    ("Apache-2.0", (5,)),
    ("Apache-2.0", (23,)),
    ("GPL-3.0", (11, 13)),
    ("GPL-3.0", (11,)),
    ("GPL-3.0", (9,)),
    ("GPL-3.0", (24,)),
    ("GPL-2.0", (12, 13)),
    ("GPL-2.0", (12,)),
    ("GPL-2.0", (10,)),
    ("GPL-2.0", (25,)),
    ("CC-BY-NC", (14,)),
    ("CC-BY-SA", (15,)),
    ("CC-BY", (16,)),
    ("BSD-3-Clause", (17, 18, 19, 20)),
    ("BSD-2-Clause", (17, 18, 19)),
    ("LGPL", (26, 13)),
    ("AGPL-3.0", (27, 13)),
    *((name, (n,)) for name, ids in (
        ("LGPL", (26, 28, 42)), ("AGPL-3.0", (27, 29, 43)), ("MPL-2.0", (30, 31, 44)), ("ISC", (32, 33, 45)), ("Unlicense", (34, 46)), ("CC0-1.0", (35, 47)),
        ("BSL-1.0", (36, 48)), ("BSD-3-Clause", (37, 49)), ("BSD-2-Clause", (38, 50)), ("CC-BY-NC-SA", (39,)), ("CC-BY-NC-ND", (40,)), ("CC-BY-ND", (41,)),
        ("EPL", (51, 52)), ("Zlib", (53, 54, 55)), ("Artistic-2.0", (56, 57)),
    ) for n in ids),
)
#: every sentence above holds one of these; a sentence without them needs no closer look
CUE = r"(?i)licen|permission|copyright|warrant|redistribut|endorse|compliance|spdx|unencumbered|redistribute|cc0|\bcc\W+by|creative commons|gpl|\bmpl\b|bsd|under\W[\W\w]{0,30}?\b(?:mit|expat|zlib|apache|epl|artistic)\b"


# How the names of licences begin, after which "and" or "or" may bring another one.
NAMES = r"(?:mit|expat|apache|gnu|[al]?gpl|bsd|mpl|mozilla|epl|eclipse|isc|zlib|boost|artistic|cc0|cc by|creative commons|lesser general|general public|affero)\b"
#: what splits one sentence about several licences into one for each, and cuts the exceptions of SPDX expressions
SPLITS = (
    (r"\n\n+", "\f"),  # no sentence goes on behind one of these
    (r" with (?<=\bspdx licen[sc]e identifier[ \n][a-z0-9 ]{1,200} with )[a-z0-9 ]+?(?= (?:or|and) |[\n\f]|$)", ""),
    (r" (?:or(?! later\b)|and) (?<=\bspdx licen[sc]e identifier[ \n][a-z0-9 ]{1,200} (?:or|and) )", "\nspdx license identifier "),
    (
        r"[ \n](?:and|or)(?=(?: at your option)?(?: under)?(?: the)?[ \n]" + NAMES + r")(?<=\b(?:released|licensed|distributed|available|provided) under [a-z0-9 \n]{1,120}[ \n](?:and|or))(?: at your option)?(?: under)?(?: the)?[ \n]",
        "\nlicensed under ",
    ),
    (r"\f", "\n\n"),
)


def _pattern(sentence: str) -> str:
    """The pattern of a sentence over ``normalised`` text."""
    some = "[^\\n]*(?:\\n[^\\n]+){0,4}?"
    start, rest = (sentence[:-3], "(?:[ \\n][^\\n]*)?") if sentence.endswith(" .*") else (sentence, "")
    return start.replace(" ", "[ \\n]").replace(".*", some) + rest


def normalised(text: Column) -> Column:
    """Lower case; every run of anything but letters and digits becomes one space, the end of a line one line end.

    ``.``, ``!`` and ``?`` before white space and blank lines end a sentence and leave an empty line; ``:`` and ``;`` before white
    space count as the end of a line. Marks of comments and lists at the ends of lines go. A sentence about two licences, or an SPDX
    expression, becomes one line for each of them.
    """
    out = F.regexp_replace(F.lower(text), r"\r\n?", "\n")
    for old, new in ((r"\bv\.\s+(?=\d)", "v "), (r"""[.!?]["')\]]*\s+""", "\n\n"), (r"[:;]\s+", "\n"), (r"[^\p{L}\p{N}\n]+", " "), (r" ?\n ?", "\n")):
        out = F.regexp_replace(out, old, new)
    for old, new in SPLITS:
        out = F.regexp_replace(out, "(?m)" + old, new)
    return F.trim(out)


def sentence_ids(text: Column) -> Column:
    """Identifiers of the known sentences of a text, in order. Before a sentence there may be a number as in lists."""
    known = F.lit(None).cast("int")
    for number, pattern in reversed(SENTENCES):
        known = (lambda p, n, rest: lambda s: F.when(s.rlike(f"^(?:\\d{{1,2}} )?(?:{p})$"), F.lit(n)).otherwise(rest(s) if callable(rest) else rest))(_pattern(pattern), number, known)
    every = "(?m)^(?:\\d{1,2} )?(?:" + "|".join(_pattern(p) for _, p in SENTENCES) + ")$"
    found = F.transform(F.regexp_extract_all(normalised(text), F.lit(every), F.lit(0)), known)
    return F.when(text.rlike(CUE), found).otherwise(F.array().cast("array<int>"))


def _longest_first() -> str:
    """All rules as one pattern over identifiers written as ``,n``; a longer rule stands before its beginnings."""
    return "|".join("".join(f",{n}" for n in ids) + r"(?!\d)" for _, ids in sorted(RULES, key=lambda rule: -len(rule[1])))


def scan_licences(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, sentence_ids, licences (one per rule that matched, in order of appearance) and n_licences.

    Matches do not overlap. A text without known sentences, or a null text, has empty arrays.
    """
    names = F.create_map(*[F.lit(x) for name, ids in RULES for x in ("".join(f",{n}" for n in ids), name)])
    found = docs.select(F.col(key).alias(key), sentence_ids(F.col(text)).alias("sentence_ids"))
    line = F.concat_ws("", F.transform("sentence_ids", lambda n: F.concat(F.lit(","), n.cast("string"))))
    licences = F.transform(F.regexp_extract_all(line, F.lit(_longest_first()), F.lit(0)), lambda run: F.try_element_at(names, run))
    return found.withColumn("licences", licences).withColumn("n_licences", F.size("licences").cast("long"))
