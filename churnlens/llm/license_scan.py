"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

Texts and templates are lower-case words of letters and digits, and their shingles of five words. A
template of m shingles is looked for with windows of L shingles, L the power of two from m up, that
step by L / 4, so some window has a Jaccard similarity of 0.5 at least to an exact occurrence, and of
0.4 to one that keeps 0.8 of it. Each of the ``BANDS`` bands is one MinHash of the window; equality
in any band retrieves the template, at 0.4 with probability 1 - 0.6 ** 16 = 0.9997 (0.99998 at 0.5; 1 for one
or two shingles). A retrieved template matches if at least 0.8 of its distinct shingles are in the
window and a quarter of it on either side.

A window can share a MinHash with a template only if it holds a shingle of it. So windows are laid
only around such shingles, which loses nothing, and the many texts without any cost one pass of
shingle hashes. Only DataFrame functions; texts are read once a part. The template library is a parameter,
and the only thing that is broadcast or sent as a literal, ``MOST_TEMPLATES`` at a time: a larger one
is scanned for in parts, one after the other.

Defined results: null and short texts (under five words) have no match; a null id is carried on;
repeated rows get a row each; overlapping occurrences of one template that share their first and last
shingle count once; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Words of a shingle, bands (of one MinHash each), share of a template that must be there, templates of a part.
WORDS, BANDS, SHARE, MOST_TEMPLATES = 5, 16, 0.8, 2000

#: Notices of public licences, by SPDX-like names.
TEMPLATES = {
    "MIT-short": "Released under the MIT License",
    "Apache-2.0-short": "Licensed under the Apache License, Version 2.0",
    "CC-BY-NC-4.0-short": "Licensed under CC BY-NC 4.0",
    "GPL-3.0-short": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0-short": "This work is licensed under the GNU General Public License, version 2",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0-short": "Licensed under CC BY-SA 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so',
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
}

#: One constant per MinHash: shingle hashes are uniform, so the least of h XOR c is a random element of the set.
_CONSTANTS = [(0x9E3779B97F4A7C15 * (2 * i + 1)) % 2**64 - 2**63 for i in range(BANDS)]


def shingle_hashes(texts: DataFrame) -> DataFrame:
    """Adds h, the hashes of the shingles in order, to a table with ``text``; drops the text."""
    words = texts.withColumn("words", F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")).drop("text")
    at = ", ".join(f"words[i + {j}]" for j in range(WORDS))
    return words.withColumn("h", F.expr(f"if(size(words) < {WORDS}, cast(array() as array<bigint>), transform(sequence(0, size(words) - {WORDS}), i -> xxhash64({at})))")).drop("words")


def _least(shingles: Column, constant: int) -> Column:
    return F.array_min(F.transform(shingles, lambda x: x.bitwiseXOR(F.lit(constant))))


def _bands(shingles: Column) -> Column:
    """array<struct<band, value>> of a set of shingle hashes."""
    return F.array(*(F.struct(F.lit(i).alias("band"), _least(shingles, c).alias("value")) for i, c in enumerate(_CONSTANTS)))


def template_table(spark, templates: dict[str, str]) -> DataFrame:
    """(license, shingles, m, width): width is the number of shingles of its windows."""
    table = shingle_hashes(spark.createDataFrame(sorted(templates.items()), "license string, text string"))
    table = table.withColumn("shingles", F.array_distinct("h")).drop("h").withColumn("m", F.size("shingles")).where("m > 0")
    return table.withColumn("width", F.pow(F.lit(2.0), F.ceil(F.log2(F.col("m").cast("double")))).cast("int"))


def license_matches(docs: DataFrame, templates: dict[str, str] | None = None, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text", part: int = MOST_TEMPLATES) -> tuple[DataFrame, DataFrame]:
    """(rows, matches): every input row by number, and (row, license, first, last) word places of the matches."""
    every = sorted((TEMPLATES if templates is None else templates).items())
    texts = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    if len(every) > part:
        texts = stored(texts, "texts")  # row numbers must be the same in each part
    found = [_part_matches(texts, dict(every[at : at + part]), share) for at in range(0, max(1, len(every)), part)]
    matches = found[0][1]
    for _, more in found[1:]:
        matches = matches.unionByName(more)
    return found[0][0], matches


def _part_matches(docs: DataFrame, templates: dict[str, str], share: float) -> tuple[DataFrame, DataFrame]:
    spark = docs.sparkSession
    # Local rows: the library is small and its hashes must be known before the texts are read.
    library = template_table(spark, templates).collect()
    vocabulary = sorted({h for t in library for h in t["shingles"]})
    widths = sorted({t["width"] for t in library})
    known = spark.createDataFrame([(t["license"], t["shingles"], t["m"], t["width"]) for t in library], "license string, shingles array<bigint>, m int, width int")
    hashed = shingle_hashes(docs)
    anchors = hashed.withColumn("found", F.exists("h", lambda x: x.isin(vocabulary) if vocabulary else F.lit(False)))
    rows = stored(anchors.select("doc_id", "row", F.when(F.col("found"), F.col("h")).alias("h")), "shingles")
    held = rows.where(F.col("h").isNotNull()).withColumn("places", F.filter(F.transform("h", lambda x, i: F.when(x.isin(vocabulary), i)), lambda p: p.isNotNull()))
    layers = []
    for width in widths:
        step = max(1, width // 4)
        starts = F.array_distinct(F.flatten(F.transform("places", lambda p: F.transform(F.sequence(F.floor((p - width) / step) + 1, F.floor(p / step)), lambda s: s * step))))  # noqa: B023
        layers.append(held.select("row", "h", F.lit(width).alias("width"), F.explode(starts).alias("start")))
    if not layers:
        return rows, spark.createDataFrame([], "row long, license string, first long, last long")
    windows = layers[0]
    for layer in layers[1:]:
        windows = windows.unionByName(layer)
    step = F.greatest(F.lit(1), F.floor(F.col("width") / 4))
    cut = lambda low, high: F.slice("h", (F.greatest(low, F.lit(0)) + 1).cast("int"), F.greatest(F.lit(0), high - F.greatest(low, F.lit(0))).cast("int"))
    windows = windows.select(
        "row", "width", "start", F.greatest(F.col("start") - step, F.lit(0)).alias("low"),
        cut(F.col("start"), F.col("start") + F.col("width")).alias("inner"), cut(F.col("start") - step, F.col("start") + F.col("width") + step).alias("outer"),
    )
    keyed = windows.where(F.size("inner") > 0).select("row", "width", "start", "low", "outer", F.inline(_bands(F.col("inner"))))
    index = known.select("license", "shingles", "m", "width", F.inline(_bands(F.col("shingles"))))
    # The index has BANDS rows for each of at most MOST_TEMPLATES templates: bounded, whatever the corpus.
    candidates = keyed.join(F.broadcast(index), ["width", "band", "value"]).dropDuplicates(["row", "width", "start", "license"])
    inside = F.size(F.array_intersect("shingles", "outer"))
    spots = F.filter(F.transform("outer", lambda x, i: F.when(F.array_contains("shingles", x), i)), lambda p: p.isNotNull())
    matches = candidates.where(inside >= share * F.col("m")).withColumn("spots", spots)
    return rows, matches.select("row", "license", (F.col("low") + F.array_min("spots")).alias("first"), (F.col("low") + F.array_max("spots") + WORDS - 1).alias("last")).distinct()


def license_scan(docs: DataFrame, **options) -> DataFrame:
    """Per row: doc_id, n_licenses (distinct templates), licenses (sorted, comma-joined), spans (license:first word:last word, sorted)."""
    rows, matches = license_matches(docs, **options)
    span = F.concat_ws(":", "license", F.col("first").cast("string"), F.col("last").cast("string"))
    per = matches.groupBy("row").agg(F.array_sort(F.collect_set("license")).alias("l"), F.array_sort(F.collect_set(span)).alias("s"))
    out = rows.drop("h").join(per, "row", "left")
    return out.select("doc_id", F.coalesce(F.size("l"), F.lit(0)).cast("long").alias("n_licenses"), F.coalesce(F.array_join("l", ","), F.lit("")).alias("licenses"), F.coalesce(F.array_join("s", ","), F.lit("")).alias("spans"))
