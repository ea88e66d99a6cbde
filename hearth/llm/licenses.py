"""Licence scans by sentence rules.

A text is cut into sentences (at line ends, and after ``.``, ``!`` or ``?``
before white space), every sentence is normalised (lower case, runs of anything
but letters and digits become one space) and looked up in a table of known
licence sentences; a known sentence may run over several such pieces (wrapped
lines, with or without comment marks) unless a line without words lies between,
and the longest one is taken. The identifiers found, in text order, are matched against
ordered rules: a rule is a sequence of identifiers that has to occur without
another known sentence between; at each place the first rule in order that
matches wins, and matching goes on after it.

One pass over the whole texts without a shuffle; tables are fixed and small.

Defined cases: a null, empty or licence-free text has no sentences known, an
empty list and a null ``license``. A known sentence that no rule takes is
counted but names no licence. Repeated rows are scanned each.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

#: Known licence sentences, normalised (fixed values): identifier, sentence.
SENTENCES = (
    ("apache-short", "licensed under the apache license version 2 0"),
    ("apache-header", "licensed under the apache license version 2 0 the license"),
    ("apache-may-not", "you may not use this file except in compliance with the license"),
    ("apache-obtain", "you may obtain a copy of the license at"),
    ("apache-url", "http www apache org licenses license 2 0"),
    ("gpl3-short", "this work is licensed under the gnu general public license version 3"),
    ("gpl-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu"
                 " general public license as published by the free software foundation either version 3 of the license"
                 " or at your option any later version"),
    ("gpl-hope", "this program is distributed in the hope that it will be useful but without any warranty without even"
                 " the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl-received", "you should have received a copy of the gnu general public license along with this program"),
    ("mit-short", "released under the mit license"),
    ("mit-licensed", "licensed under the mit license"),
    ("mit-title", "mit license"),
    ("mit-granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and"
                    " associated documentation files the software to deal in the software without restriction"),
    ("mit-notice", "the above copyright notice and this permission notice shall be included in all copies or"
                   " substantial portions of the software"),
    ("as-is", "the software is provided as is without warranty of any kind express or implied"),
    ("bsd-redistribution", "redistribution and use in source and binary forms with or without modification are"
                           " permitted provided that the following conditions are met"),
    ("bsd-endorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse"
                    " or promote products derived from this software without specific prior written permission"),
    ("isc-granted", "permission to use copy modify and or distribute this software for any purpose with or without fee"
                    " is hereby granted"),
    ("mpl-subject", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-short", "licensed under cc by 4 0"),
    ("cc-by-sa-short", "licensed under cc by sa 4 0"),
    ("cc-by-nc-short", "licensed under cc by nc 4 0"),
    ("cc0-short", "released under cc0 1 0"),
    ("all-rights", "all rights reserved"),
    ("gpl2-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu"
                  " general public license as published by the free software foundation either version 2 of the license"
                  " or at your option any later version"),
    ("gpl2-only", "this program is free software you can redistribute it and or modify it under the terms of the gnu"
                  " general public license version 2 as published by the free software foundation"),
    ("lgpl21-free", "this library is free software you can redistribute it and or modify it under the terms of the gnu"
                    " lesser general public license as published by the free software foundation either version 2 1 of"
                    " the license or at your option any later version"),
    ("lgpl3-free", "this library is free software you can redistribute it and or modify it under the terms of the gnu"
                   " lesser general public license as published by the free software foundation either version 3 of"
                   " the license or at your option any later version"),
    ("lgpl-hope", "this library is distributed in the hope that it will be useful but without any warranty without even"
                  " the implied warranty of merchantability or fitness for a particular purpose"),
    ("agpl3-free", "this program is free software you can redistribute it and or modify it under the terms of the gnu"
                   " affero general public license as published by the free software foundation either version 3 of the"
                   " license or at your option any later version"),
    ("unlicense-free", "this is free and unencumbered software released into the public domain"),
    ("zlib-as-is", "this software is provided as is without any express or implied warranty"),
    ("zlib-granted", "permission is granted to anyone to use this software for any purpose including commercial"
                     " applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("epl2-terms", "this program and the accompanying materials are made available under the terms of the eclipse public"
                   " license 2 0 which is available at https www eclipse org legal epl 2 0"),
    ("bsl-short", "distributed under the boost software license version 1 0"),
)

#: Licences that a line ``SPDX-License-Identifier:`` names (fixed values).
SPDX = ("MIT", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only",
        "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only",
        "AGPL-3.0-or-later", "MPL-2.0", "EPL-2.0", "BSL-1.0", "Zlib", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0")

#: Sentences that name a holder of their own between a fixed beginning and end (fixed values).
FRAMED_SENTENCES = (
    ("bsd-endorse", "neither the name of", "may be used to endorse or promote products derived from this software without"
                                           " specific prior written permission"),
    ("bsd-endorse", "the name of the author may not be used to endorse or promote products derived from this software",
     "without specific prior written permission"),
    ("bsd4-advertising", "all advertising materials mentioning features or use of this software must display the following"
                         " acknowledgement", ""),
)

#: Ordered rules (fixed values): licence, identifiers in sequence. Longer rules stand first.
RULES = (
    ("BSD-4-Clause", ("bsd-redistribution", "bsd4-advertising", "bsd-endorse")),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope", "gpl-received")),
    ("GPL-2.0-or-later", ("gpl2-free", "gpl-hope")),
    ("GPL-2.0-only", ("gpl2-only", "gpl-hope", "gpl-received")),
    ("GPL-2.0-only", ("gpl2-only", "gpl-hope")),
    ("LGPL-2.1-or-later", ("lgpl21-free", "lgpl-hope")),
    ("LGPL-3.0-or-later", ("lgpl3-free", "lgpl-hope")),
    ("AGPL-3.0-or-later", ("agpl3-free", "gpl-hope")),
    ("Zlib", ("zlib-as-is", "zlib-granted")),
    ("EPL-2.0", ("epl2-terms", "spdx-epl-2-0")),
    ("Apache-2.0", ("apache-header", "apache-may-not", "apache-obtain", "apache-url")),
    ("Apache-2.0", ("apache-header", "apache-may-not")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope", "gpl-received")),
    ("GPL-3.0-or-later", ("gpl-free", "gpl-hope")),
    ("MIT", ("mit-title", "mit-granted", "mit-notice", "as-is")),
    ("MIT", ("mit-granted", "mit-notice", "as-is")),
    ("MIT", ("mit-granted", "mit-notice")),
    ("BSD-3-Clause", ("bsd-redistribution", "bsd-endorse")),
    ("ISC", ("isc-granted", "as-is")),
    ("Proprietary", ("all-rights",)),
    ("Apache-2.0", ("apache-short",)),
    ("Apache-2.0", ("apache-header",)),
    ("GPL-3.0-only", ("gpl3-short",)),
    ("GPL-3.0-or-later", ("gpl-free",)),
    ("MIT", ("mit-short",)),
    ("MIT", ("mit-licensed",)),
    ("MIT", ("mit-granted",)),
    ("BSD-2-Clause", ("bsd-redistribution",)),
    ("ISC", ("isc-granted",)),
    ("MPL-2.0", ("mpl-subject",)),
    ("CC-BY-4.0", ("cc-by-short",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-short",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-short",)),
    ("CC0-1.0", ("cc0-short",)),
    ("GPL-2.0-or-later", ("gpl2-free",)),
    ("GPL-2.0-only", ("gpl2-only",)),
    ("LGPL-2.1-or-later", ("lgpl21-free",)),
    ("LGPL-3.0-or-later", ("lgpl3-free",)),
    ("AGPL-3.0-or-later", ("agpl3-free",)),
    ("Unlicense", ("unlicense-free",)),
    ("Zlib", ("zlib-granted",)),
    ("EPL-2.0", ("epl2-terms",)),
    ("BSL-1.0", ("bsl-short",)),
)

#: Whole sentences of the licences' own texts (fixed values) where :data:`SENTENCES` has their beginning.
WHOLE_SENTENCES = (
    ("mit-granted", "permission is hereby granted free of charge to any person obtaining a copy of this software and"
                    " associated documentation files the software to deal in the software without restriction including"
                    " without limitation the rights to use copy modify merge publish distribute sublicense and or sell"
                    " copies of the software and to permit persons to whom the software is furnished to do so subject to"
                    " the following conditions"),
    ("as-is", "the software is provided as is without warranty of any kind express or implied including but not limited"
              " to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("isc-granted", "permission to use copy modify and or distribute this software for any purpose with or without fee"
                    " is hereby granted provided that the above copyright notice and this permission notice appear in"
                    " all copies"),
    ("as-is", "the software is provided as is and the author disclaims all warranties with regard to this software"
              " including all implied warranties of merchantability and fitness"),
)

#: Rules before :data:`RULES`: the line of rights that heads a BSD notice belongs to it.
HEADED_RULES = (
    ("BSD-3-Clause", ("all-rights", "bsd-redistribution", "bsd-endorse")),
    ("BSD-4-Clause", ("all-rights", "bsd-redistribution", "bsd4-advertising", "bsd-endorse")),
    ("BSD-2-Clause", ("all-rights", "bsd-redistribution")),
)

_END = re.compile(r"(?<=[.!?])[\x20\x09-\x0d]+|\n")
_MARKS = re.compile(r"[^0-9a-z]+")
SCAN = StructType([StructField("sentences", ArrayType(StringType()), False),
                   StructField("licenses", ArrayType(StringType()), False),
                   StructField("starts", ArrayType(IntegerType()), False)])


def sentences(text: str) -> list[tuple[int, str]]:
    """Start and text of every sentence."""
    out, start = [], 0
    for m in _END.finditer(text):
        out.append((start, text[start:m.start()]))
        start = m.end()
    return [*out, (start, text[start:])]


def normalise(sentence: str) -> str:
    return _MARKS.sub(" ", sentence.lower()).strip()


#: The sentence and the rule of every licence in :data:`SPDX`.
SPDX_SENTENCES = tuple((normalise(f"spdx {x}").replace(" ", "-"), normalise(f"SPDX-License-Identifier: {x}")) for x in SPDX)
SPDX_RULES = tuple((x, (i,)) for x, (i, _) in zip(SPDX, SPDX_SENTENCES, strict=True))


class Scanner:
    """Sentence table and rules, the rules grouped by their first identifier."""

    def __init__(self, known=SENTENCES + SPDX_SENTENCES + WHOLE_SENTENCES, rules=HEADED_RULES + RULES + SPDX_RULES,
                 framed=FRAMED_SENTENCES):
        self.known = {s: i for i, s in known}
        self.framed = framed
        words = [s.split() for s in [*self.known, *(head for _, head, _ in framed)]]
        self.beginnings = {" ".join(w[:i]) for w in words for i in range(1, len(w) + 1)}
        self.heads = tuple(head for _, head, _ in framed)
        self.longest = 30 + max((len(f"{head} {tail}".split()) for _, head, tail in framed), default=0)  # words
        self.hints = re.compile("|".join(sorted({re.escape(max(" ".join(w).split(), key=len)) for w in words})))
        self.rules: dict[str, list] = {}
        for rank, (name, ids) in enumerate(rules):
            self.rules.setdefault(ids[0], []).append((rank, name, ids))

    def identifier(self, sentence: str) -> str | None:
        """The identifier of a normalised sentence."""
        if sentence in self.known:
            return self.known[sentence]
        return next((i for i, head, tail in self.framed if sentence.startswith(head) and sentence.endswith(tail)), None)

    def goes_on(self, sentence: str) -> bool:
        """Whether a known sentence may begin with this one."""
        return sentence in self.beginnings or (sentence.startswith(self.heads) and sentence.count(" ") < self.longest)

    def scan(self, text: str | None) -> tuple[list[str], list[str], list[int]]:
        """Identifiers of the known sentences, licences by rule, and where those start."""
        found = []
        if text and self.hints.search(text.lower()):  # every known sentence holds one of the hints
            pieces = [(start, normalise(s)) for start, s in sentences(text)]
            at = 0
            while at < len(pieces):
                start, s = pieces[at]
                end, here = at + 1, None
                while self.goes_on(s):
                    if here_id := self.identifier(s):
                        here = (end, here_id)
                        if s not in self.beginnings:
                            break
                    if end == len(pieces) or not pieces[end][1]:
                        break
                    s, end = f"{s} {pieces[end][1]}", end + 1
                if here:
                    found.append((start, here[1]))
                at = here[0] if here else at + 1
        ids = [i for _, i in found]
        names, starts, at = [], [], 0
        while at < len(ids):
            for _, name, rule in self.rules.get(ids[at], ()):
                if tuple(ids[at:at + len(rule)]) == rule:
                    names.append(name)
                    starts.append(found[at][0])
                    at += len(rule)
                    break
            else:
                at += 1
        return ids, names, starts


def scan_of(text: Column, scanner: Scanner | None = None) -> Column:
    """Struct of :data:`SCAN` for a text column."""
    own = scanner or Scanner()

    @F.pandas_udf(SCAN)
    def scan(column: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([own.scan(t) for t in column], columns=SCAN.names)

    return scan(text)


def scan_licenses(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """Every row of ``docs(doc_id, text)``: ``doc_id``, the known ``sentences``, all
    ``licenses`` in text order with their ``starts``, and ``license``, the first."""
    out = docs.select("doc_id", scan_of(F.col("text"), scanner).alias("_s"))
    return out.select("doc_id", F.col("_s.sentences").alias("sentences"), F.col("_s.licenses").alias("licenses"),
                      F.col("_s.starts").alias("starts"), F.try_element_at("_s.licenses", F.lit(1)).alias("license"))
