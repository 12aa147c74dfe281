"""Licence scan: MinHash bands of overlapping windows find templates, exact containment verifies.

Texts and templates are taken as shingles of five lower-case words.  A template
with fewer than ``WINDOW`` shingles is looked up by each shingle, a window of its own,
so every text that holds one of them meets it.  A longer one has windows of
``WINDOW`` shingles at every place; a text has one every ``STEP`` shingles, its last
ones and that of a short text over what there is.
A window's band keys are its smallest shingles under ``BANDS`` hash functions.  Two
windows with a likeness of J share a key with chance 1 - (1 - J) ** BANDS: 0.9984
for 0.8, and a passage has several windows.  A band of one row keeps that chance
high; verification takes care of what meets by chance.

A pair that met is kept if the text holds at least ``CONTAINED`` of the template's
distinct shingles, compared by 64-bit hash.

Defined results: null and empty texts and texts of fewer than five words match
nothing; texts of any length are scanned whole; rows that repeat an id are one
document; null ids are one document too; no template or no row gives an empty
table; other columns don't matter.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import WORD, body
from .quality_rules import let, words_of

SHINGLE = 5
WINDOW = 24
STEP = 8
BANDS = 4
CONTAINED = 0.8
# Templates' keys up to this number are sent to all tasks, more are joined by key.
SENT_KEYS = 200_000

# Short notices of well-known licences.
NOTICES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on "
        'an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for '
        "the specific language governing permissions and limitations under the License."
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met:"
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
}


def shingle_hashes(words: Column) -> Column:
    """64-bit hashes of all five-word shingles."""
    at = F.sequence(F.lit(0), F.size(words) - SHINGLE)
    hashes = F.transform(at, lambda k: F.xxhash64(*[F.get(words, k + j) for j in range(SHINGLE)]))
    return F.when(F.size(words) < SHINGLE, F.array().cast("array<bigint>")).otherwise(hashes)


def _window_keys(hashes: Column, step: int) -> Column:
    """The smallest hash of every window, for each band; a short text is one window."""

    def band(k: int) -> Column:
        ranked = F.transform(hashes, lambda h: F.xxhash64(h, F.lit(k)))
        at = F.sequence(F.lit(0), F.greatest(F.size(hashes) - WINDOW + step - 1, F.lit(0)), F.lit(step))
        return let(ranked, lambda r: F.transform(at, lambda p: F.array_min(F.slice(r, p + 1, F.lit(WINDOW)))))

    keys = F.concat(*[band(k) for k in range(BANDS)])
    return F.when(F.size(hashes) > 0, keys).otherwise(F.array().cast("array<bigint>"))


def text_keys(text: Column) -> Column:
    """(keys, bands): shingle hashes and band keys of all windows of a text."""

    def keys(hashes: Column) -> Column:
        return F.struct(
            F.array_distinct(hashes).alias("shingles"), F.array_distinct(_window_keys(hashes, STEP)).alias("bands")
        )

    return let(words_of(F.lower(text)), lambda w: let(shingle_hashes(w), keys))


def template_frames(templates: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Keys (key, template, band) and sizes (template, shingles) of (template, text) rows; the number of keys."""

    def keys(h: Column) -> Column:
        return F.struct(h.alias("shingles"), F.when(F.size(h) < WINDOW, h).otherwise(_window_keys(h, 1)).alias("bands"))

    found = templates.select("template", let(words_of(F.lower("text")), lambda w: let(shingle_hashes(w), keys)).alias("k"))
    shingles = found.select("template", F.explode(F.array_distinct("k.shingles")).alias("key"), F.lit(False).alias("band"))
    bands = found.select("template", F.explode(F.array_distinct("k.bands")).alias("key"), F.lit(True).alias("band"))
    both = shingles.union(bands)
    sizes = shingles.groupBy("template").agg(F.count("*").alias("template_shingles"))
    return both, sizes, both.count()


def notice_templates(docs: DataFrame) -> DataFrame:
    rows = T.StructType([T.StructField("template", T.StringType()), T.StructField("text", T.StringType())])
    return docs.sparkSession.createDataFrame(list(NOTICES.items()), rows)


def scan(docs: DataFrame, templates: DataFrame, id_col: str = "doc_id", text: str = "text", contained: float = CONTAINED) -> DataFrame:
    """(id, template, shared, template_shingles, containment) of every document and template that match.

    templates: rows of template (a name) and text with at least five words.
    """
    short = templates.filter(F.regexp_count("text", F.lit(WORD)) < SHINGLE).limit(1).collect()
    if short:
        raise ValueError(f"template {short[0].template!r} has fewer than {SHINGLE} words")
    keys, sizes, n = template_frames(templates)
    met = docs.select(F.col(id_col).alias("id"), text_keys(body(text)).alias("k"))
    # Shingles come as they are; a band key stands for its window.
    met = met.select("id", F.explode(F.concat("k.shingles", "k.bands")).alias("key"))
    keys = F.broadcast(keys) if n <= SENT_KEYS else keys
    pairs = met.join(keys, "key").groupBy("id", "template").agg(
        F.count_distinct(F.when(~F.col("band"), F.col("key"))).alias("shared"), F.max("band").alias("retrieved")
    )
    return (
        pairs.filter("retrieved")
        .join(sizes, "template")
        .withColumn("containment", F.col("shared") / F.col("template_shingles"))
        .filter(F.col("containment") >= contained)
        .select(F.col("id").alias(id_col), "template", "shared", "template_shingles", "containment")
    )
