"""Licence scans by a positional index of rare words.

Inverse document frequencies of the templates' words are counted over the whole
corpus. The index has the positions of each template's words in at most one
file of ``FILES`` (and of its ``ANCHORS`` rarest words, however common). A
file's rare words are looked up there: templates of which it holds too little
weight go no further, the postings of the others agree on an alignment where
file position less template position is (nearly) the same. An alignment is
scored by the weight of its distinct words, and counts only if the template's
mandatory key phrases stand in the file near it; the best of those that count
gives the template's score.

Texts are cut into words once, inside the JVM; only words of the templates go
on from there, and only files that hold most of a template's rare words are
shuffled, so what is shuffled follows the licence text in the corpus, not its
size. The vocabulary and the postings have the size of the templates,
which is fixed, and are broadcast.

Edge cases: a null text counts as empty (no words, no labels, score 0); equal
rows are told apart and get equal results; an empty table gives no rows; ties
between alignments do not arise, as all are tested; extra columns are not read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadlake.llm.common import let, written

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Notices as their licences word them, each with the phrases it cannot do without.
TEMPLATES = {
    "mit": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction", ("permission is hereby granted", "without restriction")),
    "mit-notice": ("Released under the MIT License", ("mit license",)),
    "apache-2.0": ("Licensed under the Apache License, Version 2.0", ("apache license", "2 0")),
    "gpl-2.0": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", ("gnu general public license", "version 2")),
    "gpl-3.0": ("This work is licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    "lgpl": ("under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ("gnu lesser general public license",)),
    "agpl-3.0": ("under the terms of the GNU Affero General Public License as published by the Free Software Foundation", ("gnu affero general public license",)),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "conditions are met")),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("for any purpose with or without fee",)),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license",)),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution",)),
    "cc-by-nc": ("Licensed under CC BY-NC 4.0", ("cc by nc",)),
    "unlicense": ("This is free and unencumbered software released into the public domain", ("unencumbered software released into the public domain",)),
    "mit-full": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        ("permission is hereby granted", "sublicense and or sell copies", "shall be included in all copies or substantial portions"),
    ),
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        ("apache license version 2 0", "except in compliance with the license", "without warranties or conditions of any kind"),
    ),
    "gpl-3.0-or-later": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
        ("gnu general public license", "version 3 of the license", "any later version"),
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        ("redistributions of source code must retain", "redistributions in binary form must reproduce", "materials provided with the distribution"),
    ),
    "bsd-3-clause": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        ("neither the name of", "endorse or promote products derived from this software", "specific prior written permission"),
    ),
    "isc-full": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        ("for any purpose with or without fee", "permission notice appear in all copies"),
    ),
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        ("mozilla public license v 2 0", "if a copy of the mpl was not distributed with this file"),
    ),
    "epl-2.0": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
        ("accompanying materials are made available under", "eclipse public license 2 0"),
    ),
    "zlib": (
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. The origin of this software must not be misrepresented; "
        "you must not claim that you wrote the original software. Altered source versions must be plainly marked as such. This notice may not be removed or altered from any source distribution.",
        ("the origin of this software must not be misrepresented", "altered source versions must be plainly marked as such"),
    ),
    "bsl-1.0": ("Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt", ("boost software license version 1 0",)),
    "cc0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work, CC0 1.0 Universal Public Domain Dedication", ("waived all copyright and related or neighboring rights",)),
    "cc-by-sa": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", ("creative commons attribution sharealike",)),
    "artistic-2.0": ("This program is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0", ("artistic license 2 0",)),
    "wtfpl": ("DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE. Everyone is permitted to copy and distribute verbatim or modified copies of this license document", ("do what the fuck you want to public license",)),
}
#: A word is rare if it stands in at most one file of so many; a template has so many rare words at least; the slack in positions of one alignment.
FILES, ANCHORS, SLACK = 8, 4, 3
#: The part of a template's rare weight that an alignment must hold.
LEAST = 0.6


def words_of(text: str) -> list[str]:
    """The words of a template, as the scan cuts them."""
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(UPPER, LOWER))) if w]


def _vocabulary() -> list[str]:
    texts = [*PHRASES, *(t for t, _ in TEMPLATES.values()), *(p for _, ps in TEMPLATES.values() for p in ps)]
    return sorted({w for t in texts for w in words_of(t)})


def words(text: Column) -> Column:
    """A text's words, in order."""
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), SEPARATOR, -1), "")


def hits(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, n_words, hits): positions (from 0) of the templates' words, written once.

    ``rid`` tells equal rows apart.
    """
    known = _vocabulary()
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("ws"))
    placed = lambda ws: F.filter(F.transform(ws, lambda w, i: F.struct(i.alias("at"), w.alias("w"))), lambda x: x["w"].isin(known))
    anything = F.arrays_overlap("ws", F.lit(known))
    none = F.array().cast("array<struct<at:int,w:string>>")
    return written(cut.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.size("ws").cast("long").alias("n_words"), F.when(anything, placed(F.col("ws"))).otherwise(none).alias("hits")), "licence-hits")


def _starts(hits_: Column, phrase: str) -> Column:
    """The positions at which a phrase's words stand one after the other."""
    parts = words_of(phrase)

    def whole(x: Column, k: Column) -> Column:
        ok = x["w"] == parts[0]
        for d, w in enumerate(parts[1:], 1):
            then = F.get(hits_, k + d)
            ok = ok & (then["w"] == w) & (then["at"] == x["at"] + d)
        return F.coalesce(ok, F.lit(False))

    return F.transform(F.filter(hits_, whole), lambda x: x["at"])


def index(found: DataFrame) -> list[tuple[str, str, int, float]]:
    """(template, word, position, weight) of each template's rare words, by document frequency over all files.

    At most a row for each word of a template: the driver holds no more than the templates' size.
    """
    n = max(1, found.count())
    counts = found.select(F.explode(F.array_distinct(F.transform("hits", lambda x: x["w"]))).alias("w")).groupBy("w").count()
    df = {r["w"]: r["count"] for r in counts.collect()}  # no more rows than the vocabulary
    idf = {w: math.log((1 + n) / (1 + df.get(w, 0))) for w in _vocabulary()}
    out = []
    for name, (text, _) in TEMPLATES.items():
        ws = words_of(text)
        by_rarity = sorted(set(ws), key=lambda w: (-idf[w], w))
        kept = {w for k, w in enumerate(by_rarity) if k < ANCHORS or idf[w] >= math.log(FILES)}
        out += [(name, w, k, max(idf[w], 1e-9)) for k, w in enumerate(ws) if w in kept]
    return out


def candidates(found: DataFrame, rows: list[tuple[str, str, int, float]], least: float = LEAST) -> DataFrame:
    """(rid, hits, templates) of the files that hold ``least`` of the weight of some template's rare words, in any order."""
    weights = {name: {w: x for t, w, _, x in rows if t == name} for name in TEMPLATES}
    rare = sorted({w for _, w, _, _ in rows})
    there = F.array_intersect(F.transform("hits", lambda x: x["w"]), F.lit(rare))
    known = F.array(*(F.struct(F.lit(t).alias("t"), F.lit(least * sum(ws.values()) - 1e-9).alias("least"), F.array(*(F.struct(F.lit(w).alias("w"), F.lit(x).alias("x")) for w, x in ws.items())).alias("ws")) for t, ws in weights.items()))

    def held(words: Column) -> Column:
        fits = F.filter(known, lambda t: F.aggregate(t["ws"], F.lit(0.0), lambda a, w: a + F.when(F.array_contains(words, w["w"]), w["x"]).otherwise(0.0)) >= t["least"])
        return F.when(F.size(words) > 0, F.transform(fits, lambda t: t["t"])).otherwise(F.array().cast("array<string>"))

    return found.select("rid", "hits", let(there, held).alias("templates")).filter(F.size("templates") > 0)


def alignments(found: DataFrame, postings: DataFrame, slack: int = SLACK) -> DataFrame:
    """(rid, template, anchor, share): every alignment of each template proposed for a file, at most two for a posting met.

    ``share`` is the part of the template's rare weight that the alignment holds.
    """
    total = postings.groupBy("template", "w").agg(F.max("weight").alias("weight")).groupBy("template").agg(F.sum("weight").alias("total"))
    placed = found.select("rid", "hits", F.explode("templates").alias("template")).select("rid", "template", F.explode("hits").alias("h")).select("rid", "template", F.col("h.w").alias("w"), F.col("h.at").alias("at"))
    joined = placed.join(F.broadcast(postings), ["template", "w"]).withColumn("shift", F.col("at") - F.col("position"))
    # A band of shifts and the next overlap, so words moved by up to `slack` still meet.
    bands = F.array(F.floor(F.col("shift") / slack), F.floor(F.col("shift") / slack) + 1)
    banded = joined.select("rid", "template", F.explode(bands).alias("band"), "w", "weight", "at")
    once = banded.groupBy("rid", "template", "band", "w").agg(F.max("weight").alias("weight"), F.min("at").alias("at"))
    scored = once.groupBy("rid", "template", "band").agg(F.sum("weight").alias("got"), F.min("at").alias("anchor"))
    return scored.join(F.broadcast(total), "template").select("rid", "template", "anchor", (F.col("got") / F.col("total")).alias("share"))


def labelled(found: DataFrame, least: float = LEAST) -> DataFrame:
    """(rid, labels, score): templates with an alignment that holds ``least`` of the weight and has the key phrases near it."""
    rows = index(found)
    postings = found.sparkSession.createDataFrame(rows, "template string, w string, position int, weight double")
    proposed = written(candidates(found, rows, least), "licence-candidates")
    held = alignments(proposed, postings).filter(F.col("share") >= least)
    # A file's alignments travel together, so its words are joined once however many notices it holds.
    near = held.groupBy("rid", "template").agg(F.collect_set(F.struct("share", "anchor")).alias("held")).join(proposed.select("rid", "hits"), "rid")
    verified = F.lit(None).cast("double")
    for name, (text, phrases) in TEMPLATES.items():
        reach = len(words_of(text)) + 8
        verified = F.when(F.col("template") == name, _best([_starts(F.col("hits"), p) for p in phrases], reach)).otherwise(verified)
    return near.withColumn("share", verified).filter("share is not null").groupBy("rid").agg(F.collect_set("template").alias("labels"), F.max("share").alias("score"))


def _best(phrases: list[Column], reach: int) -> Column:
    """The largest share of an alignment with a start of every phrase within ``reach``; null if there is none."""

    def tested(starts: Column) -> Column:
        def better(most: Column, x: Column) -> Column:
            ok = most.isNull()
            for k in range(len(phrases)):
                ok = ok & F.exists(F.get(starts, k), lambda at: F.abs(at - x["anchor"]) <= reach)
            return F.when(ok, x["share"]).otherwise(most)

        # From the largest share down; once one counts, no other is tested.
        return F.aggregate(F.sort_array("held", asc=False), F.lit(None).cast("double"), better)

    return let(F.array(*phrases), tested)


def scan(docs: DataFrame) -> DataFrame:
    """A row per file: words, base phrases and their places, base labels, all labels, score."""
    found = hits(docs)
    by_phrase = {p: _starts(F.col("hits"), p) for p in PHRASES}
    base = found.select("rid", "doc_id", "n_words", *(s.alias(f"s{k}") for k, s in enumerate(by_phrase.values())))
    places = F.concat(*(F.col(f"s{k}") for k in range(len(PHRASES))))
    names = F.array_compact(F.array(*(F.when(F.size(f"s{k}") > 0, F.lit(label)) for k, label in enumerate(PHRASES.values()))))
    joined = base.join(labelled(found), "rid", "left")
    text = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return joined.select(
        "doc_id",
        "n_words",
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"),
        F.array_max(places).cast("long").alias("last_word"),
        text(names).alias("base_labels"),
        text(F.concat(names, F.coalesce("labels", F.array().cast("array<string>")))).alias("labels"),
        F.least(F.lit(1.0), F.coalesce("score", F.when(F.size(places) > 0, 0.5), F.lit(0.0))).alias("score"),
    )
