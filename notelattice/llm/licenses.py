"""License scans with DataFrame functions only: windows, MinHash bands, and exact shingle containment.

Words are lower-cased runs of ASCII letters and digits; a shingle is three of them, hashed by xxhash64. Templates are
grouped by length into classes that double (4, 8, 16, ... shingles, as far as the longest template needs); a class with
templates of up to L shingles is looked for in windows of 2 * L shingles, one every L, so any passage of up to L shingles
lies whole in at least one window. A class has as many bands of one row as any of its templates needs (`bands_for`): a
window that holds `percent` of a template of t shingles, k of them, has a Jaccard similarity to it of at least
J = k / (2 * L + t - k), and with n bands the chance that no band collides is at most (1 - J) ** n, which is kept to `miss`.
Since t > L / 2 (or L = 4), no class needs more than 71 bands at 80 percent.

Windows are retrieved by their bands alone. A window without a template shingle has nothing in common with any template
and could not collide; such windows are left out before hashing, which changes no result: a text is looked at only if it
has one of the telling words (for each template shingle its longest word), and a window only if one of its shingles is in
the block's set. A collision is verified by exact containment: the share of the template's distinct shingles in the window.

Templates are taken in blocks of at most `block` shingles (one longer template makes a block of its own), each against all
texts, so what the plan and the broadcast hold is bounded however many there are: a block's bands are at most 71 numbers
for each of its templates. Texts never meet one another.

Defined cases: null, empty and shorter texts match nothing; a text may match several templates; repeated rows each match;
a template of fewer than three words has no shingle and is refused. Windows of one text that match the same template count
as one match with the best containment and, among equals, the earliest place. Texts and templates of any length are taken
whole; a null in a `keep` column stays; an empty table gives an empty result. Extra columns are ignored, whatever their names;
those in `keep` may not be named template, containment or position.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# License notices, by SPDX-like name.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-work": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC0-notice": "Dedicated to the public domain under CC0 1.0.",
    "BSD-3-notice": "Released under the BSD 3-Clause License.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL-3.0-program": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "BSD-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely",
    "MIT-warranty": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "all-rights-reserved": "All rights reserved. No part of this publication may be reproduced",
}
SHINGLE = 3
LEAST_CLASS = 4
BREAK = "[^a-z0-9]+"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), BREAK), lambda w: w != "")


def template_words(text: Column) -> Column:
    """The words of each shingle of a template, an array of arrays."""
    w = words(text)
    return F.transform(F.sequence(F.lit(1), F.size(w) - SHINGLE + 1), lambda i: F.slice(w, i, SHINGLE))


def shingles(text: Column) -> Column:
    """Hashes of the runs of three words; none for texts of fewer words."""
    w = words(text)
    return F.when(F.size(w) >= SHINGLE, F.zip_with(F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), F.slice(w, 3, F.greatest(F.size(w) - 2, F.lit(0))), lambda p, c: F.when(c.isNotNull(), F.xxhash64(p["a"], p["b"], c)))).otherwise(F.array().cast("array<bigint>"))


MISS = 1e-4  # the greatest probability that a window with enough of a template shares no band with it


def bands_for(size: int, longest: int, percent: int, miss: float = MISS) -> int:
    """The least number of bands that miss `percent` of a template of `size` shingles, in a window of its class, with at most this probability."""
    held = max(1, math.ceil(percent * size / 100))
    similarity = held / (2 * longest + size - held)
    return max(1, math.ceil(math.log(miss) / math.log(1 - similarity)))


def minhashes(column: Column, bands: Column) -> Column:
    """The least of each of `bands` rehashes of the shingles, an array."""
    return F.transform(F.sequence(F.lit(0), bands - 1), lambda k: F.array_min(F.transform(column, lambda x: F.xxhash64(x, k))))


def class_of(size: int) -> int:
    """The greatest number of shingles of the class of a template with this many."""
    return max(LEAST_CLASS, 1 << (size - 1).bit_length())


def blocks_of(spark: SparkSession, templates: dict[str, str], block: int) -> Iterator[list[tuple[str, list[int], list[str]]]]:
    """Templates with their distinct shingles and telling words, in blocks of at most `block` shingles."""
    rows = spark.createDataFrame(sorted(templates.items()), "template string, body string")
    # a text with a template shingle has each word of it, so also its longest
    longest = F.transform(template_words(F.col("body")), lambda w: F.element_at(F.array_sort(w, lambda a, b: F.length(a) - F.length(b)), -1))
    rows = rows.select("template", F.array_distinct(F.filter(shingles(F.col("body")), lambda x: x.isNotNull())).alias("t_shingles"), F.when(F.size(words(F.col("body"))) >= SHINGLE, F.array_distinct(longest)).alias("telling"))
    out, size = [], 0
    for r in rows.orderBy("template").toLocalIterator():
        if not r.t_shingles:
            raise ValueError(f"the template {r.template} has fewer than {SHINGLE} words")
        if out and size + len(r.t_shingles) > block:
            yield out
            out, size = [], 0
        out.append((r.template, r.t_shingles, r.telling))
        size += len(r.t_shingles)
    if out:
        yield out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, percent: int = 80, miss: float = MISS, keep: tuple[str, ...] = ("doc_id",), block: int = 20_000) -> DataFrame:
    """keep, template, containment (percent of the template's shingles, double) and position (of the window's first shingle)."""
    found = [_scan(docs, known, percent, miss, keep) for known in blocks_of(docs.sparkSession, TEMPLATES if templates is None else templates, block)]
    return reduce(DataFrame.unionByName, found) if found else docs.where("false").select(*keep, F.lit("").alias("template"), F.lit(0.0).alias("containment"), F.lit(0).cast("long").alias("position"))


def _scan(docs: DataFrame, held: list[tuple[str, list[int], list[str]]], percent: int, miss: float, keep: tuple[str, ...]) -> DataFrame:
    spark = docs.sparkSession
    known = spark.createDataFrame([(name, s, class_of(len(s))) for name, s, _ in held], "template string, t_shingles array<long>, class int")
    every = sorted({x for _, s, _ in held for x in s})
    needed: dict[int, int] = {}
    for _, s, _ in held:
        c = class_of(len(s))
        needed[c] = max(needed.get(c, 0), bands_for(len(s), c, percent, miss))
    classes = sorted(needed)
    bands = F.coalesce(*[F.when(F.col("class") == c, F.lit(n)) for c, n in needed.items()], F.lit(1))
    telling = F.array(*[F.lit(w) for w in sorted({w for _, _, x in held for w in x})])
    plausible = docs.where(F.arrays_overlap(F.split(F.lower("text"), BREAK), telling))
    listed = plausible.select(*keep, shingles(F.col("text")).alias("__s"))
    # places of template shingles: the look-up leaves out only texts, and then windows, that have none and can't collide
    hits = F.filter(F.transform("__s", lambda x, i: F.when(x.isin(every), i)), lambda i: i.isNotNull())
    listed = listed.withColumn("__hits", hits).where("size(__hits) > 0").withColumn("__doc", F.monotonically_increasing_id())
    # windows of a class start at multiples of c and hold 2 * c shingles: a place lies in those of its own step and the one before

    def around(i: Column) -> Column:
        steps = [(c, back) for c in classes for back in (0, 1)]
        return F.array(*[F.struct(F.lit(c).alias("class"), F.greatest(F.floor(i / c) - back, F.lit(0)).alias("n")) for c, back in steps])

    spots = listed.select(*keep, "__doc", "__s", F.explode(F.array_distinct(F.flatten(F.transform("__hits", around)))).alias("spot"))
    spots = spots.select(*keep, "__doc", "__s", F.col("spot.class").alias("class"), (F.col("spot.n") * F.col("spot.class")).alias("position"))
    windows = spots.select(*keep, "__doc", "position", "class", F.filter(F.slice("__s", (F.col("position") + 1).cast("int"), 2 * F.col("class")), lambda x: x.isNotNull()).alias("window")).where("size(window) > 0")
    sketched = windows.withColumn("bands", minhashes(F.col("window"), bands))
    t_bands = known.select("template", "class", F.posexplode(minhashes(F.col("t_shingles"), bands)).alias("band", "value"))
    # a window meets a template once, however many bands they share
    place = [*keep, "__doc", "position", "window", "class"]
    met = sketched.select(*place, F.posexplode("bands").alias("band", "value")).join(F.broadcast(t_bands), ["class", "band", "value"]).select(*place, "template").distinct()
    met = met.join(F.broadcast(known.select("template", "t_shingles")), "template")  # at most `block` numbers, or one template
    share = F.size(F.array_intersect("window", "t_shingles")) * 100.0 / F.size("t_shingles")
    found = met.select(*keep, "__doc", "position", "template", share.alias("containment")).where(F.col("containment") >= percent)
    best = found.groupBy("__doc", "template").agg(*[F.first(c).alias(c) for c in keep], F.min(F.struct((-F.col("containment")).alias("less"), F.col("position"))).alias("best"))
    return best.select(*keep, "template", (-F.col("best.less")).alias("containment"), F.col("best.position").alias("position"))
