"""License scans: MinHash bands over overlapping windows find templates, shingle containment decides.

Shingles are three consecutive tokens. Every template belongs to the smallest window size that
holds it; windows overlap by half, so each occurrence of a template lies inside one window of at
most four times its shingles' number plus the overlap. `rows_per_band` = 1 and `bands` bands make
the chance to miss a window whose similarity with the template is s equal to (1 - s) ** bands;
`bands_for` picks the number of bands so that this is at most `miss` at the lowest similarity
that can occur.

Only windows with at least one template shingle get signatures: the others share nothing with any
template, so no band can match truly. The templates are a fixed table of this module or the
caller's; its size is checked before it is broadcast.

Defined results: null, empty and too short texts match nothing; repeated documents are scanned,
the result has one row per (doc_id, template) with the best window; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.text import let, masked_hash, seeds, tokens, whole

SHINGLE = 3
MASK = "1" * SHINGLE
CONTAINMENT = 0.8
MISS = 1e-4
MAX_TEMPLATE_CHARS = 4_000_000

# fixed values: public license notices, as their texts state them
TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "MIT-licensed": "This project is licensed under the MIT License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
           "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
           "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
           "copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0": "you may not use this file except in compliance with the License. You may obtain a copy of the "
                  "License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed "
                  "to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
                  "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
               "General Public License as published by the Free Software Foundation, either version 3 of the License, "
               "or (at your option) any later version.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
               "General Public License as published by the Free Software Foundation; either version 2 of the License, "
               "or (at your option) any later version.",
    "LGPL-3.0": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
                "Lesser General Public License as published by the Free Software Foundation; either version 3 of the "
                "License, or (at your option) any later version.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
           "that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
           "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-NC-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring "
               "rights to this work.",
    "Proprietary": "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted "
                   "in any form or by any means without the prior written permission of the publisher.",
}


def default_templates(spark: SparkSession) -> DataFrame:
    rows = [F.struct(F.lit(k).alias("template"), F.lit(v).alias("text")) for k, v in sorted(TEMPLATES.items())]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.*")


def bands_for(similarity: float, miss: float, rows_per_band: int = 1) -> int:
    """Bands needed so that a pair of this similarity shares no band with chance `miss` at most."""
    return math.ceil(math.log(miss) / math.log(1 - similarity**rows_per_band))


def _shingles(array: Column) -> Column:
    """Distinct shingle hashes of a token array."""
    return F.when(F.size(array) >= SHINGLE, F.array_distinct(F.transform(
        F.sequence(F.lit(0), F.size(array) - SHINGLE), lambda i: masked_hash(array, i, MASK)))).otherwise(
        F.array().cast("array<bigint>"))


def _bands(shingles: Column, bands: int, rows_per_band: int) -> Column:
    """One key per band: the hash of `rows_per_band` minima."""

    def minimum(number: int) -> Column:
        return F.array_min(F.transform(shingles, lambda s: F.xxhash64(F.lit(number), s)))

    return F.array(*[
        F.xxhash64(F.lit(b), *[minimum(b * rows_per_band + r) for r in range(rows_per_band)]) for b in range(bands)
    ])


def _template_table(templates: DataFrame) -> DataFrame:
    """template, its distinct shingles and the window size: the power of two that holds its tokens."""
    rows = templates.select("template", tokens(whole("text")).alias("tokens")).filter(
        F.col("template").isNotNull() & (F.size("tokens") >= SHINGLE))
    size = F.pow(F.lit(2.0), F.ceil(F.log2(F.size("tokens")))).cast("int")
    return rows.select("template", _shingles(F.col("tokens")).alias("shingles"), size.alias("size"))


def scan_licenses(
    docs: DataFrame, templates: DataFrame | None = None, *, id_col: str = "doc_id", text_col: str = "text",
    containment: float = CONTAINMENT, miss: float = MISS, rows_per_band: int = 1,
) -> DataFrame:
    """doc_id, template, share of the template's shingles found, first token of the best window.

    A window of size 2w at steps of w, for templates of more than w/2 and at most w tokens, holds
    every occurrence whole. An occurrence at containment c then has a similarity of at least
    c * t / (2w + t - c * t) with t template shingles, which fixes the number of bands.
    """
    spark = docs.sparkSession
    table = _template_table(default_templates(spark) if templates is None else templates)
    sizes = table.groupBy("size").agg(
        F.min(F.size("shingles")).alias("least"), F.count("*").alias("n"), F.sum(F.size("shingles")).alias("all")
    ).orderBy("size").collect()  # one row per power of two
    if sum(r["all"] for r in sizes) * 8 > MAX_TEMPLATE_CHARS:
        raise ValueError("the template table is too large to broadcast")
    rows = docs.select(F.col(id_col).alias("doc_id"), tokens(whole(text_col)).alias("tokens"))
    known = table.select(F.explode("shingles").alias("seed"), "size").distinct()
    positions = seeds(rows, "tokens", (MASK,), "at", "seed")
    # (document, window size, window) of every position whose shingle some template has; the window's
    # tokens are cut out while the array is still at hand
    step = F.col("size")
    number = F.floor(F.col("at") / step).cast("int")
    hit = positions.join(F.broadcast(known), "seed").select(
        "doc_id", "size", "at", F.xxhash64("tokens").alias("text_key"),
        F.explode(F.array(number, number - 1)).alias("window"), "tokens",
    ).filter(F.col("window") >= 0)
    windows = hit.select(
        "doc_id", "text_key", "size", "window",
        F.slice("tokens", F.col("window") * step + 1, 2 * step).alias("part"),
    ).dropDuplicates(["doc_id", "text_key", "size", "window"])
    windows = windows.withColumn("own", _shingles(F.col("part"))).drop("part")
    # one number of bands for all sizes, for the lowest similarity of any
    lowest = min((containment * r["least"] / (2 * r["size"] + r["least"] - containment * r["least"]) for r in sizes),
                 default=containment)
    bands = bands_for(lowest, miss, rows_per_band)
    keys = table.select("template", "shingles", "size", F.explode(_bands(F.col("shingles"), bands, rows_per_band)).alias("band"))
    met = windows.withColumn("band", F.explode(_bands(F.col("own"), bands, rows_per_band))).join(
        F.broadcast(keys), ["size", "band"])
    share = let(F.size(F.array_intersect("shingles", "own")), lambda n: n / F.size("shingles"))
    found = met.select(
        "doc_id", "template", share.alias("share"), (F.col("window") * step).cast("bigint").alias("first_token"))
    return found.filter(F.col("share") >= containment).groupBy("doc_id", "template").agg(
        F.max(F.struct("share", (-F.col("first_token")).alias("at"))).alias("best")
    ).select("doc_id", "template", F.col("best.share").alias("containment"), (-F.col("best.at")).alias("first_token"))
