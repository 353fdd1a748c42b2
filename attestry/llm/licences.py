"""Licence scans: sparse TF-IDF cosine of licence passages to templates, then inheritance from the nearest directory above.

A passage is as many words of a text as a template has, whatever line breaks and comment marks stand between them. Templates are
short notices, file headers and passages of the full texts. Where a passage may begin is found by an inverted index of the templates' own
words: of each template the rarest words of the corpus, until those left weigh so little that no passage of them alone could reach the
bound (prefix filtering). Each place of such a word gives one passage, laid so that the word stands where the template has it. Passages repeat without
end, so each distinct one is scored once: its words meet the template's weights in a join, and products add up to the cosine. A file's
licence is that of its best passage. Licence files hand theirs to their directory; a file without one takes that of the nearest
directory above it, by a join of every directory's ancestors with the directories that have one.

Word weights are tf * (ln((n + 1) / (d + 1)) + 1) over all n texts, d of which hold the word; words of no template count as words that occur
nowhere. Only counts of the templates' words, so a bounded number, come to the driver.

Defined cases: null or empty texts have no passage; at either end of a text a passage is cut short, and each word that it lacks counts as one of no template; a null path has no directory and inherits
nothing; ties go to the licence that sorts first (so a passage that fits two versions alike); rows that repeat get the same answer; an empty table gives no rows.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.llm.common import let, stored

# Licence names with short notices, file headers and passages of the full texts.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD 3-Clause License"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("CC-BY-4.0", "Licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("GPL-2.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0"),
    ("LGPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
)
WORD = r"[\p{L}\p{N}]+"


def _split(template: str) -> list[str]:
    return re.findall(r"[^\W_]+", template.lower())


@dataclass(frozen=True)
class Index:
    """Word weights and, for each rare word of a template, (template, its place there)."""

    idf: dict[str, float]
    other: float
    words: tuple[tuple[str, ...], ...]
    places: dict[str, tuple[tuple[int, int], ...]]


def index(n: int, counts: dict[str, int], least: float) -> Index:
    """The inverted index over the templates for a corpus of ``n`` texts, ``counts`` of which hold each word."""
    words = tuple(tuple(_split(t)) for _, t in TEMPLATES)
    weight = lambda d: math.log((n + 1) / (d + 1)) + 1
    idf = {w: weight(counts.get(w, 0)) for t in words for w in t}
    places: dict[str, list[tuple[int, int]]] = {}
    for t, own in enumerate(words):
        square = {w: (k * idf[w]) ** 2 for w, k in Counter(own).items()}
        left = total = sum(square.values())
        for w in sorted(square, key=lambda w: (-square[w], w)):
            if left < 0.999 * least * least * total:
                break
            places.setdefault(w, []).extend((t, i) for i, x in enumerate(own) if x == w)
            left -= square[w]
    return Index(idf, weight(0), words, {w: tuple(p) for w, p in places.items()})


def _words(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def counted(texts: DataFrame, text: str) -> tuple[int, dict[str, int]]:
    """The number of texts, and in how many of them each word of a template stands."""
    vocabulary = F.array(*[F.lit(w) for w in sorted({w for _, t in TEMPLATES for w in _split(t)})])
    held = texts.select(F.explode_outer(F.concat(F.array(F.lit("")), F.array_intersect(_words(F.col(text)), vocabulary))).alias("word"))
    counts = {r["word"]: r["d"] for r in held.groupBy("word").agg(F.count("*").alias("d")).collect()}  # at most one row a word of the templates
    return counts.pop("", 0), counts


def passages(text: Column, ix: Index) -> Column:
    """The distinct passages of a text to be scored, each as the number of its template and its words, joined by spaces."""
    rare = sorted(ix.places)
    # a place is one number: the template, then where the passage begins, moved up so that it is never below 0
    up, wide = max(map(len, ix.words)), 1 << 40
    spots = F.from_json(F.lit(json.dumps({w: [t * wide + up - i for t, i in ix.places[w]] for w in rare})), "map<string, array<bigint>>")
    lengths = F.array(*[F.lit(len(w)) for w in ix.words])

    def cut(words: Column, spot: Column) -> Column:
        template = F.shiftright(spot, 40).cast("int")
        begin = (spot.bitwiseAND(F.lit(wide - 1)) - up).cast("int")
        size = F.get(lengths, template) + F.least(begin, F.lit(0))
        return F.concat_ws(" ", template.cast("string"), F.slice(words, F.greatest(begin, F.lit(0)) + 1, size))

    def found(words: Column) -> Column:
        hits = F.array_compact(F.transform(words, lambda w, i: F.when(w.isin(*rare), i)))
        starts = F.flatten(F.transform(hits, lambda i: F.transform(F.try_element_at(spots, F.get(words, i)), lambda s: s + i)))
        return F.array_distinct(F.transform(F.array_distinct(starts), lambda s: cut(words, s)))

    # texts without any of these words are not taken apart
    some = F.lower(text).rlike(r"(?<![\p{L}\p{N}])(?:" + "|".join(rare) + r")(?![\p{L}\p{N}])")
    return F.when(some, let(_words(text), found)).otherwise(F.array().cast("array<string>"))


def _weights(spark: SparkSession, ix: Index) -> tuple[DataFrame, DataFrame]:
    """(word, idf) of the templates' words and (t, licence, tnorm, word, tw) of the templates."""
    def rows(items: list, schema: str) -> DataFrame:
        return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(items)), f"array<struct<{schema}>>")))

    templates = []
    for t, own in enumerate(ix.words):
        weighted = {w: k * ix.idf[w] for w, k in Counter(own).items()}
        norm = math.sqrt(sum(x * x for x in weighted.values()))
        templates += [{"t": t, "licence": TEMPLATES[t][0], "word": w, "tw": x / norm} for w, x in weighted.items()]
    return rows([{"word": w, "idf": x} for w, x in ix.idf.items()], "word: string, idf: double"), rows(templates, "t: int, licence: string, word: string, tw: double")


def scores(lines: DataFrame, ix: Index, least: float) -> DataFrame:
    """(line, licence, cosine) of the distinct passages that reach ``least`` with their template. One shuffle: all else stays with the line."""
    idf, templates = _weights(lines.sparkSession, ix)
    parts = lines.select("line").distinct().select("line", F.split("line", " ").alias("w"))
    words = parts.select("line", F.get("w", F.lit(0)).cast("int").alias("t"), F.explode(F.slice("w", F.lit(2), F.size("w"))).alias("word"))
    tf = words.groupBy("line", "t", "word").agg(F.count("*").alias("tf"))
    # both sides that are broadcast are as long as the templates, whatever the input
    weighted = tf.join(F.broadcast(idf), "word", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(ix.other)))
    met = weighted.join(F.broadcast(templates), ["t", "word"], "left")
    missing = F.get(F.array(*[F.lit(len(w)) for w in ix.words]), F.max("t")) - F.sum("tf")
    cosine = F.sum(F.col("w") * F.coalesce("tw", F.lit(0.0))) / F.sqrt(F.sum(F.col("w") * F.col("w")) + missing * ix.other**2)
    return met.groupBy("line").agg(F.max("licence").alias("licence"), F.round(cosine, 9).alias("cosine")).filter(F.col("cosine") >= least)


def parent(path: Column) -> Column:
    """The directory of a path, null at the root."""
    return F.nullif(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), F.lit(""))


def ancestors(directory: Column) -> Column:
    """A directory and all above it."""
    parts = F.split(directory, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def licensed(files: DataFrame, least: float = 0.75, licence_file: str = r"(?i)/(licen[sc]e|copying)(\.\w+)?$") -> DataFrame:
    """doc_id, path, licence, cosine, origin (own, inherited or none) and the directory it comes from."""
    texts = files.select("doc_id", F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    ix = index(*counted(texts, "text"), least)
    rows = stored(texts.select("doc_id", "path", passages(F.col("text"), ix).alias("lines")), "licence-passages")
    each = rows.select("doc_id", "path", F.explode("lines").alias("line")).distinct()
    scored = each.join(scores(each, ix, least), "line")
    own = scored.groupBy("doc_id", "path").agg(F.min(F.struct((-F.col("cosine")).alias("far"), "licence")).alias("b")).select("doc_id", "path", "b.licence", (-F.col("b.far")).alias("cosine"))
    held = own.filter(F.col("path").rlike(licence_file)).select(parent(F.col("path")).alias("above"), "licence", "cosine").filter("above is not null")
    held = held.groupBy("above").agg(F.min(F.struct((-F.col("cosine")).alias("far"), "licence"))["licence"].alias("given"))
    dirs = rows.select(parent(F.col("path")).alias("dir")).filter("dir is not null").distinct()
    up = dirs.select("dir", F.explode(ancestors(F.col("dir"))).alias("above")).join(held, "above")
    nearest = up.groupBy("dir").agg(F.max(F.struct(F.length("above").alias("n"), "above", "given")).alias("b")).select("dir", F.col("b.above").alias("above"), F.col("b.given").alias("given"))
    mine = own.select(F.col("doc_id").alias("_id"), F.col("path").alias("_path"), "licence", "cosine")
    joined = rows.select("doc_id", "path", parent(F.col("path")).alias("dir")).join(mine, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("path").eqNullSafe(F.col("_path")), "left").join(nearest, "dir", "left")
    origin = F.when(F.col("licence").isNotNull(), "own").when(F.col("given").isNotNull(), "inherited").otherwise("none")
    return joined.select("doc_id", "path", F.coalesce("licence", "given").alias("licence"), "cosine", origin.alias("origin"), F.when(origin == "inherited", F.col("above")).alias("inherited_from"))
