"""License scans: TF-IDF cosine of headers and licence files to templates, inherited along directories.

Templates are whole licence texts, notices, usual sentences and titles. A file is compared with a
template over every run of its terms that begins at one of the template's terms and is as long as
the template, less the foreign terms at its end; so neither surrounding words nor line ends dilute
a match, in a header or in a whole licence file. Terms are weighted by tf * idf, with document
frequencies counted over all files; terms outside of the templates weigh like terms that no file
has. Numbers of a template (versions) must all be there. Of the templates at ``least`` or above the
one with the most matched weight (squared score times norm) names the file's own licence; an SPDX
tag names it outright, with score 1. A file without one inherits from the nearest ancestor directory
with a declaring file (its licence file: the column ``declares``, least path first).

Column expressions only, over all files, in two scans. What is left out cannot reach ``least``: a
cosine is at most the root of the template's squared weights that are there (Cauchy-Schwarz), so a
file needs one of the template's heaviest terms, and a run is scored only if its sums allow it.
Inheritance is decided once per directory. Null paths and texts have no licence; repeated rows are
judged alike.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from declara.llm.common import broadcast_if_small
from declara.runtime import stage

# Licence texts, notices, sentences and titles, by SPDX name.
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution. "
)
_NO_ENDORSEMENT = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission. "
)
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
)


def _gnu(name: str, version: str, work: str = "program") -> tuple[str, ...]:
    return (
        f"This {work} is licensed under the {name}, version {version}.", f"Licensed under the {name}, version {version}.", f"{name} version {version}",
        f"This {work} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software "
        f"Foundation, either version {version} of the License, or (at your option) any later version.",
    )


TEMPLATES = {
    "MIT": (
        "Released under the MIT License.", "Licensed under the MIT License.", "The MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.", "Apache License Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "GPL-2.0": _gnu("GNU General Public License", "2"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", *_gnu("GNU General Public License", "3")),
    "LGPL-2.1": _gnu("GNU Lesser General Public License", "2.1", "library"),
    "LGPL-3.0": _gnu("GNU Lesser General Public License", "3", "library"),
    "AGPL-3.0": _gnu("GNU Affero General Public License", "3"),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at http://mozilla.org/MPL/2.0/.",
    ),
    "BSD-2-Clause": ("Released under the BSD 2-Clause License.", "BSD 2-Clause License", _BSD + _BSD_END),
    "BSD-3-Clause": ("Released under the BSD 3-Clause License.", "BSD 3-Clause License", _BSD + _NO_ENDORSEMENT + _BSD_END),
    "ISC": (
        "Released under the ISC License.", "The ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies.",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "CC0-1.0": ("Dedicated to the public domain under CC0 1.0.", "CC0 1.0 Universal"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "Creative Commons Attribution 4.0 International"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "Creative Commons Attribution-ShareAlike 4.0 International"),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International"),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "Creative Commons Attribution-NoDerivatives 4.0 International"),
    "LicenseRef-proprietary": ("All rights reserved.",),
}
_ID = "[(]*[A-Za-z0-9][A-Za-z0-9.+-]*[)]*"
TAG = f"SPDX-License-Identifier:[ \\t]*({_ID}(?:[ \\t]+(?:AND|OR|WITH)[ \\t]+{_ID})*)"


_TERM = re.compile(r"[^\W_]+")


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[\\p{L}\\p{N}]+"), 0)


def weighed_templates(templates: dict[str, str | tuple[str, ...]], idf: dict[str, float]) -> list[tuple[str, int, int, float, dict[str, float]]]:
    """(license, terms, numbers, norm, unit weights by term) of every template."""
    out = []
    for name, texts in templates.items():
        for text in [texts] if isinstance(texts, str) else texts:
            words = _TERM.findall(text.lower())
            w = {t: n * idf[t] for t, n in Counter(words).items()}
            norm = math.sqrt(sum(x * x for x in w.values()))
            out.append((name, len(words), sum(t.isdigit() for t in w), norm, {t: x / norm for t, x in w.items()}))
    return out


def heads(unit: dict[str, float], least: float) -> list[str]:
    """The heaviest terms of a template: without any of them no cosine reaches ``least``."""
    out, left = [], 1.0
    for t in sorted(unit, key=lambda t: (-unit[t], t)):
        if left < least * least - 1e-9:
            break
        out.append(t)
        left -= unit[t] ** 2
    return out


def own_licenses(files: DataFrame, templates: dict[str, str | tuple[str, ...]], least: float) -> DataFrame:
    """(path, license, score) of files with a licence statement of their own."""
    spark = files.sparkSession
    all_texts = [x for texts in templates.values() for x in ([texts] if isinstance(texts, str) else texts)]
    vocabulary = sorted({t for x in all_texts for t in _TERM.findall(x.lower())})
    words = terms(F.coalesce("text", F.lit("")))
    held = files.select(F.explode(F.array_intersect(words, F.array(*map(F.lit, vocabulary)))).alias("term"))
    n = files.count()
    df = {r.term: r.df for r in held.groupBy("term").agg(F.count("*").alias("df")).collect()}  # at most the vocabulary
    idf = {t: math.log((n + 1) / (df.get(t, 0) + 1)) + 1 for t in vocabulary}
    unseen = math.log(n + 1) + 1
    known = weighed_templates(templates, idf)
    weight = F.broadcast(spark.createDataFrame(list(idf.items()), "term string, idf double"))
    head = [(t, i) for i, x in enumerate(known) for t in heads(x[4], least)]
    target = F.broadcast(spark.createDataFrame([(i, t, w, t.isdigit()) for i, x in enumerate(known) for t, w in x[4].items()], "template int, term string, t double, number boolean"))
    about = F.broadcast(spark.createDataFrame([(i, *x[:4]) for i, x in enumerate(known)], "template int, license string, long int, numbers int, size double"))

    tag = F.regexp_extract("text", TAG, 1)
    heavy = F.array_distinct(F.array(*map(F.lit, sorted({t for t, _ in head}))))
    judged = files.select("path", F.when(tag != "", tag).alias("tag"), words.alias("terms")).withColumn("heavy", F.array_intersect("terms", heavy))
    judged = stage(judged.where("tag IS NOT NULL OR size(heavy) > 0").withColumn("file", F.monotonically_increasing_id()))
    pairs = judged.select("file", F.explode("heavy").alias("term")).join(
        F.broadcast(spark.createDataFrame(head, "term string, template int")), "term"
    ).groupBy("file").agg(F.collect_set("template").alias("templates"))
    places = judged.join(pairs, "file").select("file", "templates", F.posexplode("terms").alias("at", "term")).join(weight, "term")
    places = places.join(target, "term").where(F.array_contains("templates", F.col("template"))).join(about, "template")
    # sums over the template's terms in a frame of its length: places count in lengths, by whole 2^-20
    longest = max((x[1] for x in known), default=1)
    places = places.withColumn("scaled", F.floor(F.col("at").cast("long") * (1 << 20) / F.col("long")))
    frame = Window.partitionBy("file", "template").orderBy("scaled").rangeBetween(0, (1 << 20) - (1 << 19) // longest)
    runs = places.select(
        "file", "template", "at", F.max("at").over(frame).alias("last"), F.count("*").over(frame).alias("hits"),
        F.sum(F.col("idf") * F.col("t")).over(frame).alias("dot"), F.sum(F.col("idf") ** 2).over(frame).alias("square"),
    )
    # a repeated or a foreign term weighs at least 1 each, so the norm is bounded below
    runs = runs.where(F.col("dot") ** 2 >= least * least * (F.col("square") + F.col("last") - F.col("at") + 1 - F.col("hits")) - 1e-9)
    runs = runs.select("file", "template", "at", "last").join(judged.select("file", "terms"), "file")
    counted = runs.select("file", "template", "at", F.explode(F.slice("terms", F.col("at") + 1, F.col("last") - F.col("at") + 1)).alias("term"))
    counted = counted.groupBy("file", "template", "at", "term").agg(F.count("*").alias("tf"))
    scored = counted.join(weight, "term", "left").withColumn("w", F.col("tf") * F.coalesce("idf", F.lit(unseen))).join(target, ["template", "term"], "left")
    scored = scored.groupBy("file", "template", "at").agg(
        F.round(F.sum(F.col("w") * F.coalesce("t", F.lit(0.0))) / F.sqrt(F.sum(F.col("w") ** 2)), 9).alias("score"),
        F.count(F.when(F.col("number"), 1)).alias("found"),
    ).where(F.col("score") >= least)
    scored = scored.join(about, "template").where("found = numbers").withColumn("mass", F.round(F.col("score") ** 2 * F.col("size"), 9))
    best = scored.join(judged.select("file", "path"), "file").select("path", "mass", "score", "license").unionByName(
        judged.where("tag IS NOT NULL").select("path", F.lit(float("inf")).alias("mass"), F.lit(1.0).alias("score"), F.col("tag").alias("license"))
    )
    best = best.groupBy("path").agg(F.max(F.struct("mass", "score", "license")).alias("b"))
    return best.select("path", F.col("b")["license"].alias("license"), F.col("b")["score"].alias("score"))


def directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", ""))


def ancestors(folder: Column) -> Column:
    """The directory itself and all above it, as structs (depth, dir)."""
    parts = F.split(folder, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("dir")))


def scan(files: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = 0.75) -> DataFrame:
    """(path, own_license, own_score, license, inherited_from) of every row of ``files``
    (path, text, declares); paths use / and have no / at their ends."""
    own = stage(own_licenses(files, templates, least))
    slim = files.select("path", "declares")
    declared = (
        slim.where("declares").distinct().join(own, "path").select(directory(F.col("path")).alias("dir"), "path", "license")
        .where("dir IS NOT NULL").groupBy("dir").agg(F.min_by("license", "path").alias("license"))
    )
    folders = slim.select(directory(F.col("path")).alias("folder")).where("folder IS NOT NULL").distinct()
    near = (
        folders.select("folder", F.explode(ancestors(F.col("folder"))).alias("a")).select("folder", "a.depth", "a.dir")
        .join(broadcast_if_small(declared), "dir")
        .groupBy("folder").agg(F.max(F.struct("depth", "dir", "license")).alias("near"))
    )
    rows = slim.select("path", directory(F.col("path")).alias("folder")).join(broadcast_if_small(own), "path", "left").join(broadcast_if_small(near), "folder", "left")
    return rows.select(
        "path", F.col("license").alias("own_license"), F.col("score").alias("own_score"),
        F.coalesce("license", F.col("near")["license"]).alias("license"),
        F.when(F.col("license").isNull(), F.col("near")["dir"]).alias("inherited_from"),
    )


def document_path() -> Column:
    """A tree of documents: below the source one directory per digit of the id but the last two."""
    digits = F.abs("doc_id").cast("string")
    folders = F.regexp_replace(F.substring(digits, F.lit(1), F.greatest(F.length(digits) - 2, F.lit(0))), "(.)", "$1/")
    return F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), folders, F.col("doc_id").cast("string"))


def query(spark, sf_dir: str) -> DataFrame:
    """Every document is a file that may declare its directory's licence (the tables have no file names)."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    files = documents.select(document_path().alias("path"), "text", F.lit(True).alias("declares"))
    found = scan(files)
    return found.select(F.regexp_extract("path", "([^/]*)$", 1).cast("long").alias("doc_id"), *found.columns)
