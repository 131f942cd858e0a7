"""License scan: sparse TF-IDF cosine to templates, then directory inheritance.

Templates are the passages by which licences are told: statements, standard
headers, the telling paragraphs of full texts, and SPDX lines. Every line and
every paragraph (lines without letters or digits part them, so comment signs
don't matter) of every file is compared with every template by the cosine of
TF-IDF vectors. Document frequencies are counted over all files, for the words
of the templates; other words have the weight of a word seen in no file. A
passage can reach the cosine threshold only if it has one of the few heaviest
words of a template (the words without which the rest of the template's norm
is under the threshold) and enough of its words, so only such passages are
expanded to words: the filter loses nothing. A file without a licence of its own takes that of its
nearest ancestor directory: a directory's licence is the one its licence files
declare. A licence file is told by its name, or by a passage that makes up much
of it. All of it is DataFrame code.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.vector import let
from textloom.llm._util import Workspace
from textloom.operators.sized import sized_broadcast

#: Passages by which files name a licence; the SPDX line of each is added by rule.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/",
        "2. Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "The MIT License (MIT)",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Creative Commons Attribution 4.0 International Public License",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Creative Commons Attribution-NonCommercial 4.0 International Public License",
    ],
    "BSD-3-Clause": [
        "Licensed under the BSD 3-Clause License.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    ],
    "MPL-2.0": [
        "This file is subject to the terms of the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Mozilla Public License Version 2.0",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

#: Names of files that hold a licence, without regard to case.
LICENCE_NAME = r"(?i)(^|/)(licen[cs]es?|copying|copyright|unlicen[cs]e)([.-][^/]*)?$"


def passages_of(templates: Mapping[str, Sequence[str]]) -> dict[tuple[str, int], str]:
    """(licence, number): passage, the SPDX line of each licence included."""
    return {(name, i): text for name, texts in templates.items() for i, text in enumerate([*texts, f"SPDX-License-Identifier: {name}"])}


WORDS = r"[a-z0-9]+(?:\.[0-9]+)?"


def words_of(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(WORDS), F.lit(0))


def template_words(templates: Mapping[str, Sequence[str]]) -> dict[tuple[str, int], dict[str, int]]:
    import re

    out: dict[tuple[str, int], dict[str, int]] = {}
    for name, text in passages_of(templates).items():
        counts: dict[str, int] = {}
        for w in re.findall(WORDS, text.lower()):
            counts[w] = counts.get(w, 0) + 1
        out[name] = counts
    return out


def needs(vec: Mapping[str, float], threshold: float) -> tuple[list[str], int]:
    """Words of which any passage at the threshold has at least one, and how many of the template's words it has at least.

    A passage cannot come nearer to a template than the root of the share of
    the template's squared norm that their common words make up.
    """
    heaviest = sorted(vec.items(), key=lambda p: (-p[1], p[0]))
    norm2 = sum(x * x for x in vec.values())
    least = (threshold * threshold - 1e-9) * norm2
    seeds, rest = [], norm2
    for w, x in heaviest:
        if rest < least:
            break
        seeds.append(w)
        rest -= x * x
    held, count = 0.0, 0
    while held < least and count < len(heaviest):
        held += heaviest[count][1] ** 2
        count += 1
    return seeds, max(1, count)


def units(text: Column) -> Column:
    """Lines and, where they have several lines, paragraphs."""
    # Lines without letters or digits are blank.
    paragraphs = F.split(F.regexp_replace(text, r"(?m)^[^\p{L}\p{N}\n]+$", ""), r"\n{2,}", -1)
    return F.concat(F.split(text, "\n", -1), F.filter(paragraphs, lambda p: F.contains(F.btrim(p, F.lit("\n")), F.lit("\n"))))


def best_passages(
    files: DataFrame, templates: Mapping[str, Sequence[str]], threshold: float, ws: Workspace
) -> DataFrame:
    """path, licence, score, share: the nearest template of each file that has one, and the share of the file's words in that passage."""
    vocab = template_words(templates)
    terms = sorted({w for v in vocab.values() for w in v})
    all_terms = F.array(*[F.lit(w) for w in terms])
    # Files that share a path are told apart by their texts.
    files = files.withColumn("fid", F.xxhash64("text"))
    held = ws.put(files.select(F.array_intersect(words_of(F.col("text")), all_terms).alias("hits")).filter(F.size("hits") > 0))
    seen = held.select(F.explode("hits").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    n = files.count()
    # At most one row for each word of the templates.
    df = {r["word"]: r["df"] for r in seen.collect()}
    idf = {w: 1.0 + math.log((1 + n) / (1 + df.get(w, 0))) for w in terms}
    unseen = 1.0 + math.log(1.0 + n)
    vectors = {name: {w: c * idf[w] for w, c in v.items()} for name, v in vocab.items()}
    norms = {name: math.sqrt(sum(x * x for x in v.values())) for name, v in vectors.items()}
    listed = lambda ws: F.array(*[F.lit(w) for w in ws])
    wanted = {name: needs(v, threshold) for name, v in vectors.items()}
    seeds = listed(sorted({w for ws, _ in wanted.values() for w in ws}))
    reach = lambda held: reduce(
        lambda a, b: a | b, [F.arrays_overlap(held, listed(ws)) & (F.size(F.array_intersect(held, listed(sorted(vectors[name])))) >= n) for name, (ws, n) in wanted.items()]
    )
    weights = files.sparkSession.createDataFrame(
        [(w, idf[w], name[0], name[1], x / norms[name]) for name, v in vectors.items() for w, x in v.items()],
        "word string, idf double, licence string, nth int, unit double",
    )
    idfs = files.sparkSession.createDataFrame([(w, idf[w]) for w in terms], "word string, idf double")
    # Bound to a name, so that words are cut once for all templates; texts are not moved.
    near = lambda words: let(F.array_intersect(words, all_terms), lambda h: F.arrays_overlap(h, seeds) & reach(h))
    passages = F.transform(units(F.col("text")), lambda u, i: F.struct(i.alias("line"), words_of(u).alias("words")))
    lines = (
        files.filter(near(words_of(F.col("text"))))
        .select("path", "fid", F.size(words_of(F.col("text"))).alias("n_words"), F.explode(F.filter(passages, lambda p: near(p["words"]))).alias("p"))
        .select("path", "fid", "n_words", "p.line", "p.words")
    )
    tf = (
        lines.select("path", "fid", "line", (F.size("words") / F.col("n_words")).alias("share"), F.explode("words").alias("word"))
        .groupBy("path", "fid", "line", "word")
        .agg(F.count(F.lit(1)).alias("tf"), F.max("share").alias("share"))
    )
    tf = ws.put(tf)
    norm = (
        tf.join(F.broadcast(idfs), "word", "left")
        .groupBy("path", "fid", "line")
        .agg(F.sqrt(F.sum(F.pow(F.col("tf") * F.coalesce("idf", F.lit(unseen)), 2))).alias("norm"), F.max("share").alias("share"))
    )
    dots = (
        tf.join(F.broadcast(weights), "word")
        .groupBy("path", "fid", "line", "licence", "nth")
        .agg(F.sum(F.col("tf") * F.col("idf") * F.col("unit")).alias("dot"))
    )
    scored = dots.join(norm, ["path", "fid", "line"]).select("path", "licence", "share", F.round(F.col("dot") / F.col("norm"), 9).alias("score"))
    # Of equal scores the larger passage counts, then the smaller name.
    best = scored.filter(F.col("score") >= threshold).groupBy("path").agg(F.min(F.struct(-F.col("score"), -F.col("share"), "licence")).alias("b"))
    return best.select("path", F.col("b.licence").alias("licence"), (-F.col("b.col1")).alias("score"), (-F.col("b.col2")).alias("share"))


def ancestors(path: Column) -> Column:
    """Directories above a path with their depth, the root ('') included."""
    parts = F.slice(F.split(path, "/", -1), 1, F.size(F.split(path, "/", -1)) - 1)
    return F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("dir")),
    )


def parent(path: Column) -> Column:
    return F.element_at(ancestors(path), -1)["dir"]


def scan_licences(
    files: DataFrame, templates: Mapping[str, Sequence[str]] = TEMPLATES, threshold: float = 0.8, least_share: float = 0.2
) -> DataFrame:
    """path, declared, score, licence, from_dir for every file.

    ``files`` needs path and text; other columns are ignored. ``declared`` is
    the licence of the file's nearest passage, ties to the larger passage, then
    the smaller name. A directory's licence is declared by its licence files
    (those named so, or with a passage of at least ``least_share`` of their
    words): the highest score, then the smallest path. Files without a
    declaration take the deepest ancestor directory's; ``from_dir`` names it.
    Null and empty texts declare nothing; files with one path declare together
    what the nearest passage of any of them is; a null path has no directory
    and declares nothing. An empty table gives an empty result.
    """
    ws = Workspace(files.sparkSession, "licences")
    files = files.select("path", "text")
    found = ws.put(best_passages(files.filter("path is not null"), templates, threshold, ws))
    rows = files.select("path").join(found, "path", "left")
    is_licence_file = F.col("path").rlike(LICENCE_NAME) | (F.col("share") >= least_share)
    rows = ws.put(rows.withColumn("is_licence_file", F.coalesce(is_licence_file, F.lit(False))))
    of_dir = (
        rows.filter(F.col("is_licence_file") & F.col("licence").isNotNull())
        .groupBy(parent(F.col("path")).alias("dir"))
        .agg(F.min(F.struct(-F.col("score"), "path", "licence")).alias("b"))
        .select("dir", F.col("b.licence").alias("dir_licence"))
    )
    # Files meet directories, not each other: one row for each level of a path.
    dirs = rows.filter("licence is null and path is not null").select(parent(F.col("path")).alias("own")).distinct()
    near = (
        dirs.select("own", F.explode(ancestors(F.concat(F.col("own"), F.lit("/")))).alias("a"))
        .select("own", "a.depth", "a.dir")
        .join(of_dir, "dir")
        .groupBy("own")
        .agg(F.max(F.struct("depth", "dir", "dir_licence")).alias("n"))
        .select("own", F.col("n.dir").alias("from_dir"), F.col("n.dir_licence").alias("dir_licence"))
    )
    # A directory may hold most files; its one row is shipped to them where all rows are few, else skewed partitions are split.
    near = ws.put(near)
    near = sized_broadcast(near, near.count())
    out = rows.withColumn("own", F.when(F.col("licence").isNull(), parent(F.col("path")))).join(near, "own", "left")
    return out.select(
        "path", F.col("licence").alias("declared"), "score",
        F.coalesce("licence", "dir_licence").alias("licence"), "from_dir",
    )
