"""Licence notices inside documents (operator 10). DataFrame functions only.

1. Texts are cut into overlapping windows. Templates of about the same length share a window size: a template of
   2**(c-1) < n <= 2**c shingles of five words is looked for in windows of 2**(c+1) shingles that start every 2**c, so
   every occurrence lies whole in some window.
2. Windows without any template shingle can't contain 80 % of one and are skipped; this loses nothing.
3. Each remaining window gets a MinHash signature. Bands retrieve the templates that share a band value. A window that
   holds 80 % of a template has Jaccard similarity of at least ``LEAST_JACCARD`` with it by step 1, and ``BANDS`` is the
   smallest count that then collides with probability ``COLLISION`` (bands of ``ROWS`` values).
4. Exact containment |template and window| / |template| of distinct shingles verifies; .8 or more matches.

The templates are a fixed list, so what is broadcast doesn't grow with the documents. Texts aren't shuffled: only
matches are, by (document, licence).

Words are lower-cased runs of letters, digits and non-ASCII characters. Defined results: a document and licence that
match give one row with the best window (first of equals); null, empty and short texts match nothing; repeated
documents of one id give one row; rows with a null id are reported together under null.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm.tables import let

SHINGLE = 5
CONTAINMENT = 0.8
ROWS = 1
COLLISION = 0.999
LEAST_JACCARD = CONTAINMENT / (4 + 2 * (1 - CONTAINMENT))  # window of up to 4n shingles (n > 2**(c-1)) and .2n outside it
BANDS = math.ceil(math.log(1 - COLLISION) / math.log(1 - LEAST_JACCARD**ROWS))

# Short notices by which licences are declared (SPDX name, words of the notice).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "This project is licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("AGPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def shingle_hash(words: Column, at: Column) -> Column:
    """64-bit hash of the five words from 0-based position ``at``."""
    return F.xxhash64(*[F.get(words, at + j) for j in range(SHINGLE)])


def shingle_count(words: Column) -> Column:
    return F.greatest(F.size(words) - (SHINGLE - 1), F.lit(0))


def signature(shingles: Column) -> Column:
    """MinHash bands of a window: one value per band, so equal values at one place are a collision."""
    one = lambda p: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, p)))
    band = lambda b: F.xxhash64(*[one(b * ROWS + r) for r in range(ROWS)]) if ROWS > 1 else one(b)
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), band)


def template_table(spark: SparkSession) -> DataFrame:
    """template, license, size class, distinct shingles and bands of each template of five or more words."""
    rows = F.array(*[
        F.struct(F.lit(i).alias("template"), F.lit(name).alias("license"), F.lit(text).alias("text"))
        for i, (name, text) in enumerate(TEMPLATES)
    ])
    words = spark.range(1).select(F.inline(rows)).withColumn("w", words_of(F.col("text")))
    shingled = words.filter(shingle_count(F.col("w")) > 0).select(
        "template", "license",
        F.array_distinct(
            F.transform(F.sequence(F.lit(0), shingle_count(F.col("w")) - 1), lambda i: shingle_hash(F.col("w"), i))
        ).alias("shingles"),
    )
    return shingled.select(
        "*", F.ceil(F.log2(F.size("shingles").cast("double"))).cast("int").alias("octave"),
        signature(F.col("shingles")).alias("bands"),
    )


def _window_numbers(hits: Column, stride: int) -> Column:
    """The windows (two strides long, one every stride) that hold any of the hit positions."""
    both = F.transform(
        hits,
        lambda h: F.array(F.floor(h["at"] / stride).cast("int") - 1, F.floor(h["at"] / stride).cast("int")),
    )
    return F.filter(F.array_distinct(F.flatten(both)), lambda j: j >= 0)


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and licence found: containment, the window's first word, template (see the module text)."""
    spark = docs.sparkSession
    templates = template_table(spark)
    known = templates.select("octave", F.explode("shingles").alias("h")).distinct().collect()  # the fixed list
    by_octave = {o: sorted({r.h for r in known if r.octave == o}) for o in sorted({r.octave for r in known})}
    everything = sorted({r.h for r in known})

    def shingles_at(words: Column, first: Column, stop: Column) -> Column:
        return F.transform(F.sequence(first, stop - 1), lambda i: shingle_hash(words, i))

    def windows_of(octave: int, words: Column, hits: Column) -> Column:
        stride = 1 << octave
        mine = F.filter(hits, lambda h: h["hash"].isin(by_octave[octave]))
        return F.transform(
            _window_numbers(mine, stride),
            lambda j: F.struct(
                F.lit(octave).alias("octave"), (j * stride).alias("start"),
                F.array_distinct(
                    shingles_at(words, j * stride, F.least((j + 2) * stride, shingle_count(words)))
                ).alias("own"),
            ),
        )

    def hits_of(words: Column) -> Column:
        # shingles are made and looked up in one sweep; only the few that a template has are kept
        places = F.sequence(F.lit(0), shingle_count(words) - 1)
        kept = F.filter(places, lambda i: shingle_hash(words, i).isin(everything))
        found = F.transform(kept, lambda i: F.struct(i.alias("at"), shingle_hash(words, i).alias("hash")))
        return F.when(shingle_count(words) > 0, found)

    # One expression, each value bound once inside it: a filter above can't make Catalyst compute the words again.
    # The outer explode keeps Catalyst from adding such a filter below.
    all_windows = let(
        words_of(F.col(text)),
        lambda w: let(hits_of(w), lambda h: F.concat(*[windows_of(o, w, h) for o in by_octave])),
    )
    windows = (
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.explode_outer(all_windows).alias("window"))
        .filter("window is not null")
        .select("doc_id", "window.*")
    )
    signed = windows.select("*", signature(F.col("own")).alias("signature"))
    retrieved = signed.join(F.broadcast(templates), "octave").filter(
        reduce(lambda a, b: a | b, [F.get("signature", F.lit(b)) == F.get("bands", F.lit(b)) for b in range(BANDS)])
    )
    verified = retrieved.select(
        "doc_id", "license", "template", "start",
        (F.size(F.array_intersect("shingles", "own")) / F.size("shingles")).alias("containment"),
    ).filter(F.col("containment") >= CONTAINMENT)
    best = F.max_by(F.struct("containment", "start", "template"), F.struct("containment", -F.col("start"), -F.col("template")))
    return verified.groupBy("doc_id", "license").agg(best.alias("b"), F.count(F.lit(1)).alias("windows")).select(
        "doc_id", "license", F.col("b.containment").alias("containment"), F.col("b.start").alias("start_word"),
        F.col("b.template").alias("template"), "windows",
    )
