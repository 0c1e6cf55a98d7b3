"""Licence scans: MinHash bands retrieve templates for text windows, exact containment verifies.

Templates are short statements and notices. A document is looked at through overlapping windows of
each template's length, a quarter of it apart. A window's signature is ``BANDS`` x ``ROWS``
MinHash minima over its 3-word shingles; a band is a hash of ``ROWS`` minima. At Jaccard
similarity s a window and a template share a band with probability 1 - (1 - s^ROWS)^BANDS: 0.9999
at s = 0.57 and 0.998 at s = 0.48 with 24 bands of 2. The nearest window is off by an eighth of the
template at most, so a statement with the wanted share of its shingles is above that. Retrieved
templates are verified on the words themselves: the share of the template's shingles inside the
window and its margin must be ``CONTAINED``.

Only windows that hold a template shingle can share a minimum with a template, so windows are made
around those places (found by a join with the templates' shingles) and nothing is lost. Each row
carries a slice of words about the place, so its size is bounded by the longest template.

Built-in functions only. Templates are broadcast after a count. Defined results: null, empty and
very short texts match nothing; a null doc_id is a document of its own kind; rows that repeat a
doc_id are reported together. Without templates there are no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checkpoints import staged
from .common import bounded, let, words_of

SHINGLE, BANDS, ROWS, CONTAINED, BROADCAST = 3, 24, 2, 0.8, 100_000
#: Licence statements and notices as published by their authors (fixed values).
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "apache-2.0": ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    "mit": ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
            "(the \"Software\"), to deal in the Software without restriction"),
    "gpl-notice": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
                   "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "bsd": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    "mpl-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    "all-rights": "All rights reserved.",
}


def templates_of(spark: SparkSession, templates: dict[str, str] | None = None) -> DataFrame:
    rows = [(k, v) for k, v in (TEMPLATES if templates is None else templates).items()]
    words = spark.createDataFrame(rows, "license string, text string").select("license", words_of(F.col("text")).alias("words"))
    return words.where(F.size("words") >= SHINGLE)


def _hashes(words: Column) -> Column:
    """Distinct hashes of the words' shingles."""
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)])))


def _shingles(words: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - SHINGLE + 1), lambda i: F.array_join(F.slice(words, i, SHINGLE), " ")))


def _bands(words: Column) -> Column:
    """Band keys of the words' MinHash signature."""
    def keys(h: Column) -> Column:
        minimum = lambda j: F.array_min(F.transform(h, lambda x: F.xxhash64(x, F.lit(j))))
        least = [minimum(j) for j in range(BANDS * ROWS)]
        return F.array(*[F.xxhash64(F.lit(b), *least[b * ROWS:(b + 1) * ROWS]) for b in range(BANDS)])
    return let(_hashes(words), keys)


def _own_start(wide: Column, template: Column) -> Column:
    """The first place in ``wide`` from which as many words as the template has hold most of its shingles."""
    in_order = F.transform(F.sequence(F.lit(0), F.size(wide) - SHINGLE), lambda i: F.xxhash64(*[F.get(wide, i + k) for k in range(SHINGLE)]))
    each = F.struct(in_order.alias("seen"), _hashes(template).alias("own"), F.size(template).alias("n"), F.greatest(F.size(wide) - F.size(template), F.lit(0)).alias("last"))

    def best(x: Column) -> Column:
        held = lambda at: F.size(F.array_intersect(F.slice(x["seen"], at + 1, x["n"] - SHINGLE + 1), x["own"]))
        return -F.array_max(F.transform(F.sequence(F.lit(0), x["last"]), lambda at: F.struct(held(at).alias("held"), (-at).alias("at"))))["at"]
    return let(each, best)


def scan(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """(doc_id, license, containment, first_word): the best containment of each licence and the word it starts at."""
    known = staged(templates.select("license", "words"), "licences")
    sizes = [r[0] for r in known.select(F.size("words").alias("n")).distinct().orderBy("n").collect()]  # distinct lengths only
    if not sizes:
        return docs.select("doc_id", F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).alias("first_word")).limit(0)
    reach = max(sizes) + max(sizes) // 4 + 1
    wanted = known.select(F.explode(_hashes(F.col("words"))).alias("shingle")).distinct()
    worded = docs.select("doc_id", F.xxhash64("text").alias("text_id"), words_of(F.col("text")).alias("words")).where(F.size("words") >= SHINGLE)
    places = worded.select("*", F.posexplode("words").alias("at", "word")).withColumn("shingle", F.xxhash64(*[F.get("words", F.col("at") + k) for k in range(SHINGLE)]))
    low = F.greatest(F.col("at") - reach, F.lit(0))
    places = (places.where(F.col("at") + SHINGLE <= F.size("words")).join(bounded(wanted, BROADCAST), "shingle")
              .select("doc_id", "text_id", "at", low.alias("low"), F.size("words").alias("n"), F.slice("words", low + 1, F.lit(2 * reach + SHINGLE)).alias("near")))
    kinds = F.explode(F.array(*[F.struct(F.lit(n).alias("length"), F.lit(max(1, n // 4)).alias("step")) for n in sizes])).alias("kind")
    grid = places.select("*", kinds).select("*", "kind.length", "kind.step")
    first = F.ceil(F.greatest(F.col("at") + SHINGLE - F.col("length"), F.lit(0)) / F.col("step")).cast("int")
    starts = (grid.withColumn("k", F.explode(F.sequence(first, F.greatest(first, F.floor(F.col("at") / F.col("step")).cast("int")))))
              .withColumn("start", F.col("k") * F.col("step")).where("start <= at"))
    edge = F.greatest(F.col("start") - F.col("step"), F.lit(0))
    cut = starts.select("doc_id", "text_id", "length", "start", F.slice("near", F.col("start") - F.col("low") + 1, F.col("length")).alias("window"),
                        F.slice("near", F.greatest(edge, F.col("low")) - F.col("low") + 1, F.col("length") + 2 * F.col("step")).alias("wide"),
                        F.greatest(edge, F.col("low")).alias("wide_at"))
    windows = cut.groupBy("doc_id", "text_id", "length", "start").agg(F.max(F.struct("window", "wide", "wide_at")).alias("w")).where(F.size("w.window") >= SHINGLE)
    banded = windows.select("*", F.explode(_bands(F.col("w.window"))).alias("band"))
    shelf = known.select("license", F.explode(_bands(F.col("words"))).alias("band"), F.col("words").alias("template")).distinct()
    met = banded.join(bounded(shelf, BROADCAST), "band").select("doc_id", "text_id", "start", "license", F.col("w.wide").alias("wide"), F.col("w.wide_at").alias("wide_at"), "template").distinct()
    share = F.size(F.array_intersect(_shingles(F.col("template")), _shingles(F.col("wide")))) / F.size(_shingles(F.col("template")))
    sure = met.withColumn("containment", share).where(F.col("containment") >= CONTAINED)
    one = F.max_by(F.struct("wide", "wide_at", "template", "containment"), F.struct("containment", -F.col("start")))
    best = sure.groupBy("doc_id", "license").agg(one.alias("b"))
    return best.select("doc_id", "license", "b.containment", (F.col("b.wide_at") + _own_start(F.col("b.wide"), F.col("b.template"))).cast("int").alias("first_word"))
