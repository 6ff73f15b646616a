"""License scan with a positional rare-token index (native DataFrame operations only).

Exact phrases give base labels. For the method, all documents are counted first: how many hold each word of the templates. Of
each template the words that stand in some document are ranked by inverse document frequency; the rarer half, and all that at
most ``RARE`` of all documents hold, are its index words. Every file's words are looked up in the index; a template that has
two of its index words in a file or more takes the ``top_k`` of them with the highest inverse document frequency, intersects
their places in the file with its postings, and is a candidate where ``min_votes`` of them agree on one relative position.
Last, its mandatory key phrases are verified: each must stand where that position puts it, give or take ``slack`` words, so
"version 3" in another sentence makes no third version of a notice of the second. Each template has votes of its own, so the notices of one file don't take words from each other.

Defined results: null or empty text has no words, no labels and score 0; repeated rows are scanned one by one; an empty
table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, spans

# Phrases and labels of the base scan.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Label, licence text or notice, mandatory key phrases in normalised words.
TEMPLATES = [
    ("mit", "Released under the MIT License.", ["mit license"]),
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice
        and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS
        PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
        MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT
        HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE,
        ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
        ["permission is hereby granted free of charge", "without restriction"],
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS
        PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
        OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
        CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF
        CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS
        SOFTWARE.""",
        ["with or without fee is hereby granted"],
    ),
    (
        "apache-2",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License.""",
        ["apache license version 2"],
    ),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3.", ["gnu general public license", "version 3"]),
    (
        "gpl-3",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details.""",
        ["gnu general public license", "version 3"],
    ),
    (
        "gpl-2",
        """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more
        details.""",
        ["gnu general public license", "version 2"],
    ),
    (
        "lgpl",
        """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
        Public License as published by the Free Software Foundation. This library is distributed in the hope that it will be
        useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
        PURPOSE. See the GNU Lesser General Public License for more details.""",
        ["gnu lesser general public license"],
    ),
    (
        "agpl-3",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
        Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any
        later version.""",
        ["gnu affero general public license"],
    ),
    (
        "bsd",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this
        list of conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
        promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY
        THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
        THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
        ["redistribution and use in source and binary forms"],
    ),
    (
        "mpl-2",
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
        ["mozilla public license"],
    ),
    (
        "zlib",
        """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
        any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original
        software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original
        software. This notice may not be removed or altered from any source distribution.""",
        ["the origin of this software must not be misrepresented"],
    ),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", ["cc by nc"]),
    (
        "cc-by-nc",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        ["creative commons attribution noncommercial"],
    ),
    (
        "cc-by-sa",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        ["creative commons attribution sharealike"],
    ),
    (
        "cc-by",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        ["creative commons attribution 4 0"],
    ),
    (
        "cc0",
        """To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to
        this software to the public domain worldwide. This software is distributed without any warranty. You should have
        received a copy of the CC0 Public Domain Dedication along with this software.""",
        ["cc0"],
    ),
    (
        "unlicense",
        """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors
        of this software dedicate any and all copyright interest in the software to the public domain.""",
        ["unencumbered software"],
    ),
]

#: Words that at most this share of all documents hold are index words of their templates.
RARE = 0.05


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())


def places_of(whole: str, phrase: str) -> list[int]:
    """Where a phrase stands in a template, in words."""
    words, wanted = words_of(whole), phrase.split()
    return [i for i in range(len(words)) if words[i : i + len(wanted)] == wanted]


def vocabulary() -> list[str]:
    return sorted({w for _, text, _ in TEMPLATES for w in words_of(text)})


def normalised(text: Column) -> Column:
    """' w0 w1 ... ' of the lower-cased words; ' ' if there are none."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = F.regexp_replace(F.translate(text, upper, lower), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return F.regexp_replace(F.concat(F.lit(" "), words, F.lit(" ")), " +", " ")


def n_spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, " ", ""))


def word_spans(joined: Column, phrases: list[str]) -> Column:
    """array<struct<w,m>>: first word's number and matched phrase, for phrases that may stand anywhere among the words."""
    pattern = "(?<= )(?:" + "|".join(sorted(phrases, key=len, reverse=True)) + ")(?= )"
    return F.transform(
        spans(joined, pattern, n_spaces), lambda x: F.struct((x["s"] - 1).cast("long").alias("w"), x["m"].alias("m"))
    )


def literals(words: list[str]) -> Column:
    return F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")


def document_frequency(docs: DataFrame, text: str) -> tuple[int, dict[str, int]]:
    """The number of documents, and for each word of the templates how many hold it: as many rows as the templates have words."""
    found = docs.select(F.array_intersect(F.split(normalised(F.coalesce(F.col(text), F.lit(""))), " "), literals(vocabulary())).alias("w"))
    counts = found.select(F.explode(F.array_append("w", F.lit(""))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    df = {r["w"]: r["n"] for r in counts}
    return df.pop("", 0), df


def index_words(n: int, df: dict[str, int]) -> list[list[str]]:
    """The index words of each template, by falling inverse document frequency."""
    out = []
    for _, text, _ in TEMPLATES:
        ranked = sorted(set(words_of(text)) & set(df), key=lambda w: (df[w], w))
        out.append([w for i, w in enumerate(ranked) if 2 * i <= len(ranked) or df[w] <= RARE * n])
    return out


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", top_k: int = 8, min_votes: int = 2, slack: int = 2) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score. score is 1 where a base phrase stands,
    else the largest share of an accepted template's looked-up words that agree on one relative position."""
    index = index_words(*document_frequency(docs, text))
    every = sorted({w for words in index for w in words})
    postings: dict[str, list[tuple[int, int]]] = {w: [] for w in every}
    for t, (_, whole, _) in enumerate(TEMPLATES):
        for p, w in enumerate(words_of(whole)):
            if w in index[t]:
                postings[w].append((t, p))
    place = lambda t, p: F.struct(F.lit(t).alias("t"), F.lit(p).cast("long").alias("p"))
    posting_map = F.create_map(*[x for w in every or [""] for x in (F.lit(w), F.array(*[place(t, p) for t, p in postings.get(w, [(0, 0)])]))])
    template_words = F.array(*[literals(words) for words in index])
    j = F.col("j")

    def has(phrase: str) -> Column:
        return j.contains(f" {phrase} ")

    def votes(hits: Column, present: Column) -> Column:
        """Sorted (template, relative position), once for each agreeing hit of a template's own rarest words."""

        def own(t: Column) -> Column:
            """Of a template, in the order of its index words: the rarest first."""
            return F.slice(F.array_intersect(F.get(template_words, t), present), 1, top_k)

        def of(t: Column, chosen: Column) -> Column:
            agreeing = F.filter(hits, lambda h: F.array_contains(chosen, h["m"]))
            at = lambda h: F.filter(F.element_at(posting_map, h["m"]), lambda x: x["t"] == t)
            return F.flatten(F.transform(agreeing, lambda h: F.transform(at(h), lambda x: F.struct(x["t"].alias("t"), (h["w"] - x["p"]).alias("d")))))

        possible = F.filter(F.transform(F.lit(list(range(len(TEMPLATES)))), lambda t: F.struct(t.alias("t"), own(t).alias("c"))), lambda x: F.size(x["c"]) >= min_votes)
        return F.sort_array(F.flatten(F.transform(possible, lambda x: of(x["t"], x["c"]))))

    def verified(words: Column, t: Column, d: Column) -> Column:
        """Whether each key phrase of the template stands in the file where the run puts it, give or take some words."""

        def stands(phrase: str, at: int) -> Column:
            wanted = phrase.split()
            near = F.sequence(F.greatest(d + at - slack, F.lit(0)), F.greatest(d + at + slack, F.lit(0)))
            return F.exists(near, lambda w: F.slice(words, (w + 2).cast("int"), len(wanted)) == literals(wanted))

        out = F.lit(False)
        for i, (_, whole, phrases) in reversed(list(enumerate(TEMPLATES))):
            each = [has(p) & reduce(or_, [stands(p, at) for at in places_of(whole, p)]) for p in phrases]
            out = F.when(t == i, reduce(and_, each)).otherwise(out)
        return out

    def accepted(words: Column, v: Column) -> Column:
        """(template, votes) of each run of equal pairs that is long enough, for templates with all their key phrases."""
        starts = F.filter(
            F.transform(v, lambda x, i: F.struct(x["t"].alias("t"), x["d"].alias("d"), i.alias("i"))),
            lambda x: F.coalesce((F.get(v, x["i"] - 1)["t"] != x["t"]) | (F.get(v, x["i"] - 1)["d"] != x["d"]), F.lit(True)),
        )
        runs = let(
            starts,
            lambda s: F.transform(s, lambda x, k: F.struct(x["t"].alias("t"), x["d"].alias("d"), (F.coalesce(F.get(s, k + 1)["i"], F.size(v)) - x["i"]).alias("n"))),
        )
        # A run has one vote for each word of its own: a template's word stands at one relative position once.
        return F.filter(runs, lambda x: (x["n"] >= min_votes) & verified(words, x["t"], x["d"]))

    none = F.array().cast("array<struct<w:bigint,m:string>>")
    base = F.concat(*[F.when(has(p), word_spans(j, [p])).otherwise(none) for p in PHRASES])  # none can overlap itself, but it could another
    d = docs.select(F.col(doc_id).alias("doc_id"), normalised(F.coalesce(F.col(text), F.lit(""))).alias("j"))

    def found(words: Column) -> Column:
        def hits(present: Column) -> Column:
            numbered = F.transform(words, lambda w, i: F.struct((i - 1).cast("long").alias("w"), w.alias("m")))
            return F.filter(numbered, lambda x: F.array_contains(present, x["m"]))

        return let(
            F.array_intersect(words, literals(every)),
            lambda present: F.when(F.size(present) >= min_votes, let(hits(present), lambda h: let(votes(h, present), lambda v: accepted(words, v)))),
        )

    d = d.select("doc_id", (n_spaces(j) - 1).cast("long").alias("n_words"), base.alias("base"), let(F.split(j, " "), found).alias("found"))
    label = F.array(*[F.lit(name) for name, _, _ in TEMPLATES])
    most = F.array(*[F.lit(min(top_k, len(words))) for words in index])
    phrase_label = F.create_map(*[F.lit(x) for kv in PHRASES.items() for x in kv])
    named = F.transform("base", lambda b: F.element_at(phrase_label, b["m"]))
    own = F.coalesce(F.transform("found", lambda x: F.get(label, x["t"])), F.array().cast("array<string>"))
    places = F.transform("base", lambda b: b["w"])
    share = F.array_max(F.transform("found", lambda x: F.least(F.lit(1.0), x["n"] / F.get(most, x["t"]))))
    return d.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(named)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(named, own))), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce(share, F.lit(0.0))).alias("score"),
    )
