"""Licence scans, in column expressions and joins only.

Lines and paragraphs of every file, and their sentences, are compared with licence templates by the cosine of sparse TF-IDF
vectors (a token counts once a text). Document frequencies of all tokens come from all files; weights have a ceiling, so that they depend on
the share of files that hold a token and not on the number of files. A part that shares none of a template's heaviest
tokens (anchors) cannot reach the least cosine, so most parts are passed over by one regex.

A file whose name is that of a licence file, or whose whole text is a template, licenses its directory. Files without a header of their own
inherit from the nearest directory above them, by equi-joins of distinct directories with their ancestors.

Null texts count as empty, null paths as the root directory. Repeated rows are judged one by one. Equal cosines go to the first licence by name.
Columns of the input stay; those named like a result are replaced.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ostinato.llm.common import keeps_columns, text_or_empty
from ostinato.session import cut

#: Published notices and first sentences of licences.
TEMPLATES = {
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3.",
                 "Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
                   "SPDX-License-Identifier: Apache-2.0"],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", "SPDX-License-Identifier: BSD-2-Clause"],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "GPL-2.0": ["Licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "ISC": ["Released under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0"],
    "MIT": ["Released under the MIT License.", "SPDX-License-Identifier: MIT",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
LICENCE_FILE = r"(?i)(?:^|/)(?:licen[cs]e|copying|unlicense)(?:[.-][^/]*)?$"
TOKEN = "[a-z0-9]+"
#: Tokens in fewer than one of so many files weigh most.
RARE = 1024


def template_tokens(text: str) -> list[str]:
    return sorted(set(re.findall(TOKEN, text.lower())))


class Weights:
    """Idf of template tokens from document counts; ``most`` is the weight of all other tokens."""

    def __init__(self, files: int, counts: dict[str, int], templates: dict[str, list[str]]):
        self.rows = [(name, template_tokens(t)) for name, texts in sorted(templates.items()) for t in texts]
        self.vocabulary = sorted({t for _, tokens in self.rows for t in tokens})
        self.files = files
        self.most = math.log(min(files + 1, RARE)) + 1
        self.idf = {t: min(math.log((files + 1) / (counts.get(t, 0) + 1)) + 1, self.most) for t in self.vocabulary}

    def norm(self, tokens: list[str]) -> float:
        return math.sqrt(sum(self.idf[t] ** 2 for t in tokens))

    def anchors(self, least: float) -> list[str]:
        """Tokens of which a part must hold one to reach a cosine of ``least`` with any template."""
        found = set()
        for _, tokens in self.rows:
            rest, norm = self.norm(tokens) ** 2, self.norm(tokens)
            for t in sorted(tokens, key=lambda t: (-self.idf[t], t)):
                if math.sqrt(max(rest, 0.0)) < least * norm:
                    break
                found.add(t)
                rest -= self.idf[t] ** 2
        return sorted(found)


def tokens_of(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)))


def weigh(files: DataFrame, text: str = "text", templates: dict[str, list[str]] | None = None) -> Weights:
    """Document frequencies of template tokens over all files; a table as long as the templates' vocabulary comes to the driver."""
    templates = templates or TEMPLATES
    vocabulary = Weights(0, {}, templates).vocabulary
    held = F.array_intersect(F.split(F.lower(text_or_empty(text)), "[^a-z0-9]+"), F.array(*[F.lit(t) for t in vocabulary]))
    marked = files.select(F.explode(F.concat(held, F.array(F.lit("")))).alias("t"))
    counts = {r[0]: r[1] for r in marked.groupBy("t").count().collect()}
    return Weights(counts.get("", 0), counts, templates)


def cosines(part: Column, w: Weights, others: Column | None = None) -> Column:
    """The best template of a part of text: struct (score, license), null without tokens.

    ``others`` is the sum of squared weights of the tokens outside the templates; without it they weigh most.
    """
    idf2 = F.create_map(*[x for t in w.vocabulary for x in (F.lit(t), F.lit(w.idf[t] ** 2))])
    rows = F.array(*[F.struct(F.lit(name).alias("license"), F.lit(w.norm(tokens)).alias("norm"), F.array(*[F.lit(t) for t in tokens]).alias("tokens"))
                     for name, tokens in w.rows])

    def mass(tokens: Column) -> Column:
        return F.aggregate(tokens, F.lit(0.0), lambda acc, t: acc + F.element_at(idf2, t))

    known = F.array_intersect(part, F.array(*[F.lit(t) for t in w.vocabulary]))
    one = F.struct(known.alias("known"), ((F.size(part) - F.size(known)) * F.lit(w.most ** 2) if others is None else others).alias("others"))

    def scored(p: Column) -> Column:
        norm = F.sqrt(mass(p["known"]) + p["others"])
        return F.transform(rows, lambda t: F.struct(
            (-F.round(mass(F.array_intersect(p["known"], t["tokens"])) / (norm * t["norm"]), 6)).alias("minus"), t["license"].alias("license")))

    best = F.array_min(F.flatten(F.transform(F.array(one), scored)))
    return F.when(F.size(part) > 0, F.struct((-best["minus"]).alias("score"), best["license"].alias("license")))


def parts_of(text: Column, w: Weights, least: float) -> Column:
    """Token sets of the lines, paragraphs and sentences that hold an anchor and may reach ``least``; empty for most texts.

    The shared squared weight is at most that of a part's template tokens, and other tokens weigh 1 at least: this bounds the cosine.
    """
    anchor = rf"(?i)(?<![a-z0-9])(?:{'|'.join(w.anchors(least))})(?![a-z0-9])"
    blocks = F.concat(F.split(text, "\n"), F.filter(F.split(text, r"\n[ \t]*\n"), lambda p: p.contains("\n")))
    blocks = F.filter(blocks, lambda p: p.rlike(anchor))
    sentences = F.filter(F.flatten(F.transform(blocks, lambda p: F.split(p, r"(?<=[.;!?])\s+"))), lambda p: p.rlike(anchor))
    parts = F.transform(F.array_distinct(F.concat(blocks, sentences)), tokens_of)
    idf2 = F.create_map(*[x for t in w.vocabulary for x in (F.lit(t), F.lit(w.idf[t] ** 2))])
    smallest = min(w.norm(tokens) ** 2 for _, tokens in w.rows if tokens)

    def possible(p: Column) -> Column:
        known = F.array_intersect(p, F.array(*[F.lit(t) for t in w.vocabulary]))
        mass = F.aggregate(known, F.lit(1e-6), lambda acc, t: acc + F.element_at(idf2, t))
        return mass >= F.greatest(F.lit(smallest), mass + F.size(p) - F.size(known)) * F.lit(least ** 2)

    return F.when(text.rlike(anchor), F.array_distinct(F.filter(parts, possible))).otherwise(F.array().cast("array<array<string>>"))


def judged(parts: DataFrame, files: DataFrame, w: Weights, text: str, least: float) -> DataFrame:
    """``part, best`` of the different parts that reach ``least``; tokens outside the templates weigh by their counts over all files.

    A part is known by a stored number where its tokens are apart. Tokens that weigh less than the most are in one file of ``RARE`` at least;
    they are stored first, so that the planner knows how few they are.
    """
    vocabulary = F.array(*[F.lit(t) for t in w.vocabulary])
    words = files.select(F.explode(F.array_distinct(F.split(F.lower(text_or_empty(text)), "[^a-z0-9]+"))).alias("t"))
    common = cut(words.groupBy("t").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") + 1) * RARE > F.lit(w.files + 1)), "common")
    numbered = cut(parts.withColumn("p", F.monotonically_increasing_id()), "different")
    weight = F.coalesce(F.log(F.lit(float(w.files + 1)) / (F.col("n") + 1)) + 1, F.lit(w.most))
    others = numbered.select("p", F.explode(F.array_except("part", vocabulary)).alias("t")).join(common, "t", "left")
    others = others.groupBy("p").agg(F.sum(F.least(weight, F.lit(w.most)) ** 2).alias("others"))
    best = numbered.join(others, "p", "left").select("part", ranked(cosines(F.col("part"), w, F.coalesce("others", F.lit(0.0)))).alias("best"))
    return cut(best.where(F.col("best.score") >= least), "judged")


def headers(files: DataFrame, w: Weights, text: str = "text", least: float = 0.6, keep_text: bool = True) -> DataFrame:
    """Adds ``_header`` (score, license; null below ``least``) and ``_whole``, the same for the whole text."""
    t = text_or_empty(text)
    found = files.withColumn("_row", F.monotonically_increasing_id()).withColumn("_parts", parts_of(t, w, least))
    # beyond a cosine of 0.98 the other tokens, of a weight of 1 at least, sum to less than 0.0413 of a template's squared norm
    longest = max(len(tokens) + int(0.0413 * w.norm(tokens) ** 2) + 1 for _, tokens in w.rows)
    whole = F.when(F.size("_parts") > 0, tokens_of(t))
    found = found.withColumn("_all", F.filter(F.array(whole), lambda a: a.isNotNull() & (F.size(a) <= longest)))
    if not keep_text:
        found = found.drop(text)
    found = cut(found, "parts")
    parts = found.where(F.size("_parts") > 0).select(F.explode(F.concat("_parts", "_all")).alias("part")).distinct()
    best = judged(parts, files, w, text, least)
    own = found.select("_row", F.explode("_parts").alias("part")).join(best, "part").groupBy("_row").agg(F.max("best").alias("_header"))
    whole = found.select("_row", F.explode("_all").alias("part")).join(best, "part").where(F.col("best.score") >= 0.98).select("_row", F.col("best").alias("_whole"))
    return found.drop("_parts", "_all").join(own, "_row", "left").join(whole, "_row", "left").drop("_row")


def ranked(best: Column) -> Column:
    """Best first by score; among equal scores the first licence by name is the greatest."""
    name = F.translate(best["license"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ZYXWVUTSRQPONMLKJIHGFEDCBA")
    return F.when(best.isNotNull(), F.struct(best["score"].alias("score"), name.alias("name"), best["license"].alias("license")))


def parent(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_extract(path, "^(.*)/[^/]*$", 1)).otherwise("")


def ancestors(folder: Column) -> Column:
    """The folder and all above it with their depths; the root is the empty string at depth 0."""
    names = F.filter(F.split(folder, "/"), lambda x: x != "")
    return F.transform(F.sequence(F.lit(0), F.size(names)), lambda n: F.struct(
        n.alias("depth"), F.array_join(F.slice(names, F.lit(1), n), "/").alias("folder")))


@keeps_columns
def scan(files: DataFrame, path: str = "path", text: str = "text", least: float = 0.6, keep_text: bool = True, templates: dict | None = None) -> DataFrame:
    """The files with ``license``, ``basis`` ('file', 'header', 'inherited' or null), ``license_score`` and ``license_folder``."""
    w = weigh(files, text, templates)
    found = headers(files, w, text, least, keep_text)
    clean = F.array_join(F.filter(F.split(F.coalesce(F.col(path), F.lit("")), "/"), lambda x: x != ""), "/")
    found = found.withColumn("_clean", clean)
    found = cut(found.withColumn("_folder", parent(F.col("_clean"))), "headers")
    licence_file = F.col("_header").isNotNull() & (F.col("_clean").rlike(LICENCE_FILE) | F.col("_whole").isNotNull())
    folders = found.where(licence_file).groupBy(F.col("_folder").alias("above")).agg(F.max("_header").alias("given"))
    all_folders = found.where("_header IS NULL").select("_folder").distinct()
    up = all_folders.select("_folder", F.explode(ancestors(F.col("_folder"))).alias("a")).select("_folder", F.col("a.depth").alias("depth"), F.col("a.folder").alias("above"))
    nearest = up.join(folders, "above").groupBy("_folder").agg(F.max(F.struct("depth", "above", "given")).alias("near"))
    joined = found.join(nearest, "_folder", "left")
    own, near = F.col("_header"), F.when(F.col("_header").isNull(), F.col("near"))
    made = {
        "license": F.coalesce(own["license"], near["given"]["license"]),
        "basis": F.when(licence_file, "file").when(own.isNotNull(), "header").when(near.isNotNull(), "inherited"),
        "license_score": F.coalesce(own["score"], near["given"]["score"]),
        "license_folder": F.when(licence_file, F.col("_folder")).when(own.isNull(), near["above"]),
    }
    keep = [c for c in found.columns if c not in ("_header", "_whole", "_clean", "_folder") and c.lower() not in made]
    return joined.select(*[F.col(f"`{c}`") for c in keep], *[v.alias(k) for k, v in made.items()])
