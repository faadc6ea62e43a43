"""License scans by sentence rules; DataFrame functions only.

A text is normalised to lower-case words (lower(), then runs of anything but letters and digits become one space), so line
wraps, comment marks and punctuation do not matter. Known sentences are looked up in maps: the first OPENING words of a place say
which lengths a sentence may have there, and the words of that length, longest first, say which sentence it is. Places are
read from left to right, and a sentence's words are not read again; that gives each document its sequence of sentence
identifiers, in order. The work grows with the words of a text and not with the number of sentences; texts that hold none of a
few words, of which each sentence has one, are not looked at.

A rule is an ordered list of identifiers that must follow each other with no other known sentence between. Rules are
tried in order, and a rule that is part of an earlier rule that matched at the same place does not count again: matches are
taken out as they are found. A rule may stand for a choice of licences. `proprietary` is said only of texts without another licence, as
"all rights reserved" heads many free ones. Sentences are also known with "not" before them, which no rule names, and as tags of the
form SPDX-License-Identifier.

One pass without a shuffle, one row per row of docs. Null and empty texts have no licences; a null doc_id is kept.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardgrid.llm.common import let

#: Normalised licence sentences, by identifier.
SENTENCES: dict[int, str] = {
    1: "released under the mit license",
    2: "permission is hereby granted free of charge to any person obtaining a copy of this software",
    3: "the above copyright notice and this permission notice shall be included in all copies",
    4: "the software is provided as is without warranty of any kind",
    5: "licensed under the mit license",
    6: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    7: "the above copyright notice and this permission notice appear in all copies",
    8: "the software is provided as is and the author disclaims all warranties",
    9: "licensed under the isc license",
    10: "licensed under the apache license version 2 0",
    11: "you may not use this file except in compliance with the license",
    12: "you may obtain a copy of the license at",
    13: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis",
    14: "licensed under the apache license 2 0",
    20: "this work is licensed under the gnu general public license version 3",
    21: "this program is free software you can redistribute it and or modify it",
    22: "this program is distributed in the hope that it will be useful but without any warranty",
    23: "you should have received a copy of the gnu general public license along with this program",
    24: "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    25: "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    26: "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    27: "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    28: "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    29: "you should have received a copy of the gnu lesser general public license along with this",
    30: "licensed under cc by nc 4 0",
    31: "licensed under cc by 4 0",
    32: "licensed under cc by sa 4 0",
    33: "licensed under a creative commons attribution 4 0 international license",
    34: "licensed under a creative commons attribution sharealike 4 0 international license",
    35: "licensed under a creative commons attribution noncommercial 4 0 international license",
    36: "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    37: "cc0 1 0 universal",
    38: "you should have received a copy of the gnu affero general public license along with this program",
    39: "licensed under the gnu general public license version 2",
    40: "redistribution and use in source and binary forms with or without modification are permitted",
    41: "redistributions of source code must retain the above copyright notice",
    42: "redistributions in binary form must reproduce the above copyright notice",
    43: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products",
    44: "licensed under the bsd 3 clause license",
    45: "licensed under the bsd 2 clause license",
    50: "this source code form is subject to the terms of the mozilla public license v 2 0",
    51: "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
    52: "boost software license version 1 0",
    53: "this is free and unencumbered software released into the public domain",
    54: "anyone is free to copy modify publish use compile sell or distribute this software",
    55: "this software is provided as is without any express or implied warranty",
    56: "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely",
    57: "altered source versions must be plainly marked as such and must not be misrepresented as being the original software",
    60: "all rights reserved",
}
#: Choices between two licences.
CHOICES: dict[int, tuple[str, str]] = {
    70: ("licensed under either of apache license version 2 0 or mit license at your option", "Apache-2.0,MIT"),
    71: ("dual licensed under the mit and gpl licenses", "GPL-2.0,MIT"),
    72: ("licensed under the mit license or the apache license version 2 0", "Apache-2.0,MIT"),
}
#: What tags may be called beside the names of licences.
ALIASES = {"GPL-2.0-only": "GPL-2.0", "GPL-2.0-or-later": "GPL-2.0", "GPL-3.0-only": "GPL-3.0", "GPL-3.0-or-later": "GPL-3.0", "LGPL-2.1-only": "LGPL-2.1", "LGPL-2.1-or-later": "LGPL-2.1", "LGPL-3.0-only": "LGPL-3.0", "LGPL-3.0-or-later": "LGPL-3.0", "AGPL-3.0-only": "AGPL-3.0", "AGPL-3.0-or-later": "AGPL-3.0"}
LAST_RESORT = "proprietary"
OPENING = 3  # words of a sentence by which its places are found
TAGS_FROM, NOT_FROM = 100, 1000  # identifiers of tags, and what is added to those of sentences that follow "not"
#: Licence rules in the order in which they are tried.
RULES: list[tuple[str, list[int]]] = [
    ("MIT", [2, 3, 4]),
    ("Apache-2.0", [10, 11, 12, 13]),
    ("LGPL-3.0", [26, 29]),
    ("LGPL-2.1", [27, 29]),
    ("AGPL-3.0", [21, 28, 22, 38]),
    ("GPL-3.0", [21, 24, 22, 23]),
    ("GPL-2.0", [21, 25, 22, 23]),
    ("GPL-3.0", [21, 22, 23]),
    ("BSD-3-Clause", [40, 41, 42, 43]),
    ("BSD-2-Clause", [40, 41, 42]),
    ("ISC", [6, 7, 8]),
    ("Zlib", [55, 56, 57]),
    ("Unlicense", [53, 54]),
    ("MIT", [1]),
    ("MIT", [5]),
    ("MIT", [2]),
    ("ISC", [6]),
    ("ISC", [9]),
    ("Apache-2.0", [10]),
    ("Apache-2.0", [14]),
    ("Apache-2.0", [11, 12, 13]),
    ("LGPL-3.0", [26]),
    ("LGPL-2.1", [27]),
    ("AGPL-3.0", [28]),
    ("AGPL-3.0", [38]),
    ("GPL-3.0", [24]),
    ("GPL-2.0", [25]),
    ("GPL-2.0", [39]),
    ("GPL-3.0", [20]),
    ("GPL-3.0", [23]),
    ("BSD-3-Clause", [44]),
    ("BSD-2-Clause", [45]),
    ("CC-BY-NC-4.0", [30]),
    ("CC-BY-4.0", [31]),
    ("CC-BY-SA-4.0", [32]),
    ("CC-BY-4.0", [33]),
    ("CC-BY-SA-4.0", [34]),
    ("CC-BY-NC-4.0", [35]),
    ("CC0-1.0", [36]),
    ("CC0-1.0", [37]),
    ("MPL-2.0", [50]),
    ("EPL-2.0", [51]),
    ("BSL-1.0", [52]),
    ("Unlicense", [53]),
    ("Zlib", [56]),
    (LAST_RESORT, [60]),
]


def _words(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", name.lower()).strip()


def everything() -> tuple[dict[int, str], list[tuple[str, list[int]]]]:
    """All sentences and rules: those above, choices, tags of every licence that a rule names, and sentences after "not"."""
    sentences, rules = dict(SENTENCES), [(names, [i]) for i, (_, names) in CHOICES.items()] + RULES
    sentences |= {i: text for i, (text, _) in CHOICES.items()}
    licenses = {name: name for name, _ in RULES if name != LAST_RESORT} | ALIASES
    for i, (tag, name) in enumerate(licenses.items(), TAGS_FROM):
        sentences[i] = f"spdx license identifier {_words(tag)}"
        rules = [*rules[:-1], (name, [i]), rules[-1]]
    denied = {NOT_FROM + i: f"not {text}" for i, text in sentences.items() if text.startswith(("licensed ", "released ", "dual "))}
    return sentences | denied, rules


def pattern(sentences: dict[int, str]) -> str:
    """Matches a known sentence with two blanks about each word: it takes one blank on either side and leaves the other, so
    neighbours are found too. Longer sentences come first. The other way to find sentences, for the SQL."""
    spaced = [s.replace(" ", "  ") for s in sorted(sentences.values(), key=lambda s: (-len(s), s))]
    return " (" + "|".join(spaced) + ") "


def anchors(sentences: dict[int, str]) -> list[str]:
    """A few words of which each sentence holds one; texts without any of them need no closer look."""
    left, out = [set(s.split()) for s in sentences.values()], []
    while left:
        common = max({w for s in left for w in s}, key=lambda w: (len(w) >= 7, sum(w in s for s in left), len(w), w))
        out.append(common)
        left = [s for s in left if common not in s]
    return out


def sentence_ids(text: Column, sentences: dict[int, str]) -> Column:
    """The identifiers, as text, of the sentences in a text, in order."""
    openers: dict[str, set[int]] = {}
    for sentence in sentences.values():
        words = sentence.split()
        openers.setdefault(" ".join(words[:OPENING]), set()).add(len(words))
    lengths = F.create_map(*[x for key, sizes in openers.items() for x in (F.lit(key), F.array(*[F.lit(n) for n in sorted(sizes, reverse=True)]))])
    number = F.create_map(*[F.lit(x) for i, sentence in sentences.items() for x in (sentence, str(i))])
    words = F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")

    def read(w: Column) -> Column:
        """Known sentences of the words, from left to right."""
        place = F.transform(w, lambda x, i: F.struct(i.alias("at"), F.try_element_at(lengths, F.array_join(F.slice(w, i + 1, OPENING), " ")).alias("sizes")))
        open_ = F.filter(place, lambda p: p["sizes"].isNotNull())

        def step(state: Column, p: Column) -> Column:
            said = F.transform(p["sizes"], lambda n: F.struct(n.alias("n"), F.try_element_at(number, F.array_join(F.slice(w, p["at"] + 1, n), " ")).alias("id")))
            first = F.get(F.filter(said, lambda x: x["id"].isNotNull()), F.lit(0))
            new = (p["at"] >= state["free"]) & first["id"].isNotNull()
            return F.struct(F.when(new, p["at"] + first["n"]).otherwise(state["free"]).alias("free"), F.when(new, F.array_append(state["ids"], first["id"])).otherwise(state["ids"]).alias("ids"))

        return F.aggregate(open_, F.struct(F.lit(0).alias("free"), F.array().cast("array<string>").alias("ids")), step, lambda state: state["ids"])

    return let(words, read)


def match_rules(docs: DataFrame, rules: list[tuple[str, list[int]]]) -> DataFrame:
    """Adds licenses, the sorted names of the rules that match the text `ids` (',1,,2,'), and n_matches."""

    each = F.array(*[F.struct(F.lit(name).alias("name"), F.lit("," + ",,".join(map(str, sequence)) + ",").alias("key")) for name, sequence in rules])

    def step(state: Column, rule: Column) -> Column:
        rest, key = state["rest"], rule["key"]
        hits = ((F.length(rest) - F.length(F.replace(rest, key, F.lit("")))) / F.length(key)).cast("int")
        return F.struct(F.replace(rest, key, F.lit(",!,")).alias("rest"), F.when(hits > 0, F.array_append(state["names"], rule["name"])).otherwise(state["names"]).alias("names"), (state["n"] + hits).alias("n"))

    start = F.struct(F.col("ids").alias("rest"), F.array().cast("array<string>").alias("names"), F.lit(0).alias("n"))
    told = docs.withColumn("_told", F.when(F.col("n_sentences") > 0, F.aggregate(each, start, step)).otherwise(start))
    names = F.array_sort(F.array_distinct(F.flatten(F.transform("_told.names", lambda x: F.split(x, ",")))))
    others = F.filter(names, lambda x: x != LAST_RESORT)
    return told.select(*docs.columns, F.array_join(F.when(F.size(others) > 0, others).otherwise(names), ",").alias("licenses"), F.col("_told.n").alias("n_matches"))


def scan_licenses(docs: DataFrame, sentences: dict[int, str] | None = None, rules: list[tuple[str, list[int]]] | None = None) -> DataFrame:
    """(doc_id, licenses, n_sentences, n_matches), one row per row of docs."""
    all_sentences, all_rules = everything()
    known = sentences or all_sentences
    text = F.coalesce(F.col("text"), F.lit(""))
    likely = F.lower(text).rlike("|".join(anchors(known)))
    ids = docs.select("doc_id", F.when(likely, sentence_ids(text, known)).otherwise(F.array().cast("array<string>")).alias("found"))
    ids = ids.select("doc_id", F.size("found").alias("n_sentences"), F.concat(F.lit(","), F.array_join("found", ",,"), F.lit(",")).alias("ids"))
    return match_rules(ids, rules or all_rules).select("doc_id", "licenses", "n_sentences", "n_matches")
