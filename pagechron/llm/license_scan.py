"""Licence recognition: sentences to identifiers, identifier runs to ordered rules.

All of it is expressions over one row: no shuffle, no Python on the executors.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised licence sentences and their identifiers.
SENTENCES = {
    "released under the mit license": "mit-ref",
    "licensed under the mit license": "mit-ref",
    "this project is licensed under the mit license": "mit-ref",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "licensed under the apache license version 2 0": "apache2-ref",
    "licensed under the apache license version 2 0 the license": "apache2-ref",
    "you may not use this file except in compliance with the license": "apache2-comply",
    "you may obtain a copy of the license at": "apache2-copy",
    "http www apache org licenses license 2 0": "apache2-url",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-warranty",
    "see the license for the specific language governing permissions and limitations under the license": "apache2-see",
    "this work is licensed under the gnu general public license version 3": "gpl3-ref",
    "licensed under the gnu general public license version 3": "gpl3-ref",
    "licensed under the gnu general public license version 2": "gpl2-ref",
    "this program is free software": "gpl-free",
    "this library is free software": "gpl-free",
    "this file is free software": "gpl-free",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-terms",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl-terms-3-later",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl-terms-2-later",
    "you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "gpl-terms-2",
    "you can redistribute it and or modify it under the terms of the gnu general public license version 3 as published by the free software foundation": "gpl-terms-3",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl-terms",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl-terms-3-later",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl-terms-21-later",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation": "agpl-terms",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl-terms-3-later",
    "either version 2 1 of the license or at your option any later version": "gpl-21-later",
    "see the gnu lesser general public license for more details": "lgpl-see",
    "see the gnu affero general public license for more details": "agpl-see",
    "either version 3 of the license or at your option any later version": "gpl-3-later",
    "either version 2 of the license or at your option any later version": "gpl-2-later",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl-hope",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-implied",
    "see the gnu general public license for more details": "gpl-see",
    "licensed under the gnu lesser general public license version 3": "lgpl3-ref",
    "licensed under the gnu affero general public license version 3": "agpl3-ref",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "neither the name of the nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-warranty",
    "licensed under the bsd 3 clause license": "bsd3-ref",
    "licensed under the bsd 2 clause license": "bsd2-ref",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "licensed under the isc license": "isc-ref",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-terms",
    "licensed under the mozilla public license version 2 0": "mpl2-ref",
    "licensed under cc by 4 0": "cc-by-ref",
    "licensed under cc by sa 4 0": "cc-by-sa-ref",
    "licensed under cc by nc 4 0": "cc-by-nc-ref",
    "licensed under cc by nd 4 0": "cc-by-nd-ref",
    "licensed under cc by nc sa 4 0": "cc-by-nc-sa-ref",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-ref",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-ref",
    "this is free and unencumbered software released into the public domain": "unlicense-ref",
    "to the extent possible under law the author has waived all copyright and related rights to this work": "cc0-waiver",
    "all rights reserved": "rights-reserved",
    "licensed to the apache software foundation asf under one or more contributor license agreements": "asf-licensed",
    "see the notice file distributed with this work for additional information regarding copyright ownership": "asf-notice",
    "the asf licenses this file to you under the apache license version 2 0 the license": "apache2-ref",
    "the asf licenses this file to you under the apache license version 2 0": "apache2-ref",
    "gnu general public license version 3 29 june 2007": "gpl3-title",
    "gnu general public license version 2 june 1991": "gpl2-title",
    "gnu lesser general public license version 3 29 june 2007": "lgpl3-title",
    "gnu lesser general public license version 2 1 february 1999": "lgpl21-title",
    "gnu affero general public license version 3 19 november 2007": "agpl3-title",
    "this software is provided as is without any express or implied warranty": "zlib-warranty",
    "in no event will the authors be held liable for any damages arising from the use of this software": "zlib-liability",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "licensed under the zlib license": "zlib-ref",
    "boost software license version 1 0 august 17th 2003": "boost-title",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "boost-grant",
    "licensed under the boost software license version 1 0": "boost-ref",
}
# Creative Commons licences in words.
CREATIVE_COMMONS = {
    "CC-BY-4.0": "attribution", "CC-BY-SA-4.0": "attribution sharealike", "CC-BY-NC-4.0": "attribution noncommercial", "CC-BY-ND-4.0": "attribution noderivatives",
    "CC-BY-NC-SA-4.0": "attribution noncommercial sharealike", "CC-BY-NC-ND-4.0": "attribution noncommercial noderivatives",
}
# What stands where a sentence has a free place, as patterns of normalised sentences and what is looked up for them.
SLOTS = [
    ("^neither the names? of .* nor the names of (?:its|his|her|their|any) contributors ", "neither the name of the nor the names of its contributors "),
    ("^this software is provided by .* as is and any express ", "this software is provided by the copyright holders and contributors as is and any express "),
    ("^(?:(?:this|the) (?:[a-z]+ ){0,2}[a-z]+ (?:is|are) )?(?:released|licensed|distributed|available|published) under (?:the terms of )?", "licensed under "),
    ("^licensed under (?:a|the) creative commons ", "licensed under a creative commons "),
    ("^licensed under mit$", "licensed under the mit license"),
]
# Identifier runs, the more specific first; a matched run is used up.
RULES = [
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("Apache-2.0", ("apache2-ref", "apache2-comply", "apache2-copy", "apache2-url", "apache2-warranty", "apache2-see")),
    ("Apache-2.0", ("apache2-ref", "apache2-comply")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-terms", "gpl-3-later")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl-terms", "gpl-2-later")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-terms-3-later")),
    ("GPL-2.0-or-later", ("gpl-free", "gpl-terms-2-later")),
    ("GPL-2.0-only", ("gpl-free", "gpl-terms-2")),
    ("GPL-3.0-only", ("gpl-free", "gpl-terms-3")),
    ("LGPL-3.0-or-later", ("gpl-free", "lgpl-terms", "gpl-3-later")),
    ("LGPL-3.0-or-later", ("gpl-free", "lgpl-terms-3-later")),
    ("LGPL-2.1-or-later", ("gpl-free", "lgpl-terms", "gpl-21-later")),
    ("LGPL-2.1-or-later", ("gpl-free", "lgpl-terms-21-later")),
    ("AGPL-3.0-or-later", ("gpl-free", "agpl-terms", "gpl-3-later")),
    ("AGPL-3.0-or-later", ("gpl-free", "agpl-terms-3-later")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant",)),
    ("MPL-2.0", ("mpl2-terms",)),
    ("CC0-1.0", ("cc0-waiver",)),
    ("MIT", ("mit-ref",)),
    ("Apache-2.0", ("apache2-ref",)),
    ("GPL-3.0-only", ("gpl3-ref",)),
    ("GPL-2.0-only", ("gpl2-ref",)),
    ("LGPL-3.0-only", ("lgpl3-ref",)),
    ("AGPL-3.0-only", ("agpl3-ref",)),
    ("BSD-3-Clause", ("bsd3-ref",)),
    ("BSD-2-Clause", ("bsd2-ref",)),
    ("ISC", ("isc-ref",)),
    ("MPL-2.0", ("mpl2-ref",)),
    ("CC-BY-4.0", ("cc-by-ref",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-ref",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-ref",)),
    ("CC-BY-ND-4.0", ("cc-by-nd-ref",)),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-ref",)),
    ("Unlicense", ("unlicense-ref",)),
    ("GPL-3.0-only", ("gpl3-title",)),
    ("GPL-2.0-only", ("gpl2-title",)),
    ("LGPL-3.0-only", ("lgpl3-title",)),
    ("LGPL-2.1-only", ("lgpl21-title",)),
    ("AGPL-3.0-only", ("agpl3-title",)),
    ("Zlib", ("zlib-grant",)),
    ("Zlib", ("zlib-ref",)),
    ("BSL-1.0", ("boost-title",)),
    ("BSL-1.0", ("boost-grant",)),
    ("BSL-1.0", ("boost-ref",)),
    ("proprietary", ("rights-reserved",)),
]
#: The licence that a notice beside any other doesn't mean: "all rights reserved" is part of many.
LAST = "proprietary"
#: What a tag for machines becomes, so that a licence's short name after it is a sentence too.
TAG, TAGGED = "SPDX-License-Identifier:[ \t]*", "spdx license identifier "
TAG_OR = "(spdx license identifier [^\n]*?)[ \t)]+(?:AND|OR|WITH)[ \t(]+"


def _normal(name: str) -> str:
    return re.sub("[^a-z0-9]+", " ", name.lower()).strip()


#: Identifiers that hold a licence's name are rules by themselves.
NAMED = "name-"
for _name, _words in CREATIVE_COMMONS.items():
    SENTENCES[f"licensed under a creative commons {_words} 4 0 international license"] = NAMED + _name
for _name in dict.fromkeys([*(name for name, _ in RULES if name != LAST), *CREATIVE_COMMONS]):
    SENTENCES[TAGGED + _normal(_name)] = NAMED + _name
#: Every known sentence holds one of these, whatever stands between its words, so other texts need no lookup.
CUES = "licen|copyright|warrant|permission|redistribut|public[^a-z0-9]+domain|free[^a-z0-9]+software|all[^a-z0-9]+rights[^a-z0-9]+reserved|merchantab|liable|option[^a-z0-9]+any[^a-z0-9]+later"
#: A line with this that is no known sentence counts as an unknown licence sentence.
UNKNOWN_CUE = "licen[sc]ed under|license"
# What comment lines begin with; a version's "v." before its number; ends of paragraphs and sentences.
LEADER = r"(^|\n)[ \t]*(?:/\*+|//+|\*+/|\*+|#+|--+|;+|%+)[ \t]*"
VERSION = r"\b([vV])\.[ \t]+([0-9])"
PARAGRAPH = r"\n[ \t\r]*\n"
SENTENCE_END = r"([.;:!?])[ \t\r\n]+"
#: Stands for the end of a sentence once found.
END = "\x02"


def _plain(s: Column) -> Column:
    return F.trim(F.lower(F.regexp_replace(s, "[^A-Za-z0-9]+", " ")))


def _slotted(s: Column) -> Column:
    out = _plain(s)
    for pattern, sentence in SLOTS:
        out = F.regexp_replace(out, pattern, sentence)
    return out


def _ids(text: Column) -> Column:
    """Identifiers of the licence sentences of a text, in order.

    A sentence may go over several lines; where it isn't known as a whole, each
    of its lines is looked up by itself.
    """
    cut = F.regexp_replace(F.coalesce(text, F.lit("")), LEADER, "$1")
    cut = F.regexp_replace(cut, TAG, TAGGED)
    for _ in range(2):  # three names at most of one tag
        cut = F.regexp_replace(cut, TAG_OR, "$1\n" + TAGGED)
    cut = F.regexp_replace(F.regexp_replace(cut, VERSION, "$1 $2"), PARAGRAPH, END)
    sentences = F.split(F.regexp_replace(cut, SENTENCE_END, "$1" + END), END)
    table = F.create_map(*(F.lit(x) for kv in SENTENCES.items() for x in kv))
    known = lambda s: F.coalesce(F.try_element_at(table, _plain(s)), F.try_element_at(table, _slotted(s)))
    unknown = lambda s: F.when(_plain(s).rlike(UNKNOWN_CUE), F.lit("unknown"))

    def named(s: Column) -> Column:
        lines = F.transform(F.split(s, "\n"), lambda line: F.coalesce(known(line), unknown(line)))
        return F.coalesce(F.when(known(s).isNotNull(), F.array(known(s))), lines)

    cued = F.filter(sentences, lambda s: F.lower(s).rlike(CUES))
    return F.when(F.lower(text).rlike(CUES), F.array_compact(F.flatten(F.transform(cued, named)))).otherwise(F.array().cast("array<string>"))


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its licence sentences' identifiers and its licences.

    Comment leaders go; the text is cut into sentences at blank lines and after
    . ; : ! ? before white space (not within "v. 2"); a sentence is lower-cased
    and everything but letters and digits, line ends included, becomes one space.
    Known sentences, or else known lines, become identifiers, those with a free place
    (a holder's name, what is licensed) by SLOTS; the rules of RULES are tried in
    order on the run of identifiers, and what a rule matches is used up. Names after
    SPDX tags are sentences too. "All rights reserved" tells only where nothing else does.
    Columns: doc_id, n_sentences, sentence_ids ("a b c"), licenses (those found,
    in rule order, then those that a sentence names, joined by a space; "" if none), unknown_sentences (those that
    speak of a licence but aren't known).

    Null and empty texts give empty results; repeated rows give repeated rows;
    other columns of ``docs`` are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), _ids(F.col(text_col)).alias("ids"))
    rows = rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_sentences"),
        F.array_join("ids", " ").alias("sentence_ids"),
        F.size(F.filter("ids", lambda s: s == "unknown")).cast("long").alias("unknown_sentences"),
        F.array_join(F.transform("ids", lambda s: F.concat(F.lit("<"), s, F.lit(">"))), "").alias("run"),
        "ids",
    )
    # few rows have licence sentences at all: the rules are tried on those alone
    left, found = F.col("run"), F.array().cast("array<string>")
    for name, ids in RULES:
        pattern = "".join(f"<{i}>" for i in ids)
        left, found = (
            F.replace(left, F.lit(pattern), F.lit("|")),
            F.concat(found, F.when(F.contains(left, F.lit(pattern)), F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))),
        )
    named = F.transform(F.filter("ids", lambda s: s.startswith(NAMED)), lambda s: F.substring(s, len(NAMED) + 1, 99))
    each = F.array_distinct(F.concat(found, named))
    each = F.when(F.size(each) > 1, F.array_remove(each, LAST)).otherwise(each)
    licenses = F.when(F.col("run") == "", F.lit("")).otherwise(F.array_join(each, " "))
    return rows.select("doc_id", "n_sentences", "sentence_ids", licenses.alias("licenses"), "unknown_sentences")


def scan_sql(table: str = "documents") -> str:
    """The same in DuckDB's SQL."""
    names = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SENTENCES.items())
    found, left = [], "run"
    for name, ids in RULES:
        pattern = "".join(f"<{i}>" for i in ids)
        found.append(f"CASE WHEN contains({left}, '{pattern}') THEN ['{name}'] ELSE []::VARCHAR[] END")
        left = f"replace({left}, '{pattern}', '|')"
    found.append(f"list_transform(list_filter(ids, lambda s: starts_with(s, '{NAMED}')), lambda s: substr(s, {len(NAMED) + 1}))")
    distinct = "list_reduce(list_prepend([]::VARCHAR[], list_transform(flatten([" + ", ".join(found) + "]), lambda x: [x])), lambda a, b: CASE WHEN list_contains(a, b[1]) THEN a ELSE a || b END)"
    plain = lambda x: f"trim(lower(regexp_replace({x}, '[^A-Za-z0-9]+', ' ', 'g')))"

    def known(x: str) -> str:
        slotted = plain(x)
        for pattern, sentence in SLOTS:
            slotted = f"regexp_replace({slotted}, '{pattern}', '{sentence}')"
        return f"coalesce(CASE {plain(x)} {names} END, CASE {slotted} {names} END)"

    text = f"regexp_replace(coalesce(text, ''), '{LEADER}', '\\1', 'g')"
    text = f"regexp_replace({text}, '{TAG}', '{TAGGED}', 'g')"
    for _ in range(2):
        text = f"regexp_replace({text}, '{TAG_OR}', '\\1' || chr(10) || '{TAGGED}', 'g')"
    text = f"regexp_replace(regexp_replace({text}, '{VERSION}', '\\1 \\2', 'g'), '{PARAGRAPH}', chr(2), 'g')"
    return f"""
WITH l AS (
  SELECT doc_id, list_filter(string_split(regexp_replace({text}, '{SENTENCE_END}', '\\1' || chr(2), 'g'), chr(2)), lambda s: regexp_matches(lower(s), '{CUES}')) AS sentences FROM {table}
), p AS (
  SELECT doc_id, list_transform(sentences, lambda s: CASE WHEN {known('s')} IS NOT NULL THEN [{known('s')}]
    ELSE list_transform(string_split(s, chr(10)), lambda q: coalesce({known('q')}, CASE WHEN regexp_matches(trim(lower(regexp_replace(q, '[^A-Za-z0-9]+', ' ', 'g'))), '{UNKNOWN_CUE}') THEN 'unknown' END)) END) AS named FROM l
), i AS (
  SELECT doc_id, list_filter(flatten(named), lambda s: s IS NOT NULL) AS ids FROM p
), r AS (
  SELECT doc_id, ids, coalesce(array_to_string(list_transform(ids, lambda s: '<' || s || '>'), ''), '') AS run FROM i
)
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, coalesce(array_to_string(ids, ' '), '') AS sentence_ids,
  CASE WHEN run = '' THEN '' ELSE array_to_string(CASE WHEN len(each) > 1 THEN list_filter(each, lambda x: x <> '{LAST}') ELSE each END, ' ') END AS licenses,
  CAST(len(list_filter(ids, lambda s: s = 'unknown')) AS BIGINT) AS unknown_sentences
FROM (SELECT *, {distinct} AS each FROM r)"""
