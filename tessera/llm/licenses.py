"""License scans, with DataFrame functions alone.

Templates are found in overlapping windows of the text. A template of W words is looked for in windows of 2W words, each
overlapping half of the next, so it lies whole in one of them. Windows and templates have one MinHash value a band; a
window whose value equals a template's in any band retrieves it. A window has at most 2W - 4 shingles (five words; of a
shorter template, all its words are one), so of a template's n a share `least` in the window means a Jaccard similarity of
at least k / (2W - 4 + n - k), k = least n rounded up. Templates of one length get as many bands as make the chance that
none is met at most 10^-9 for each occurrence: 46 for long templates, 114 for those of five words. The share of a
template's shingles that are in the window is then computed exactly.

Before that, documents and windows that cannot hold any template are passed over, without loss: to hold the share of n
shingles they must hold one of any n - k + 1 of them, and so the longest word of one of these.

Defined cases: null, empty or wordless texts match nothing; a very long text has many windows, all scanned; a template
with fewer words than a shingle is one shingle of its own length, found anywhere; templates without words are ignored;
windows that tie count each, and the first gives first_token; rows with one doc_id, repeated or not, are scanned each and
reported together; a null doc_id is reported as such; extra columns, whatever their names, are ignored; an empty table
gives an empty one.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import let

SHINGLE = 5
WORDS = "[\\p{L}\\p{N}]+"

#: Short notices by which texts state their license: fixed values.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("Apache-2.0-header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("MIT-grant", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("GPL-3.0-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(0))


def words_of(template: str) -> list[str]:
    return re.findall(r"[^\W_]+", template.lower())


def shingles(words: Column, n: Column) -> Column:
    """Hashes of runs of n words; of fewer words, one of them all; of none, none."""

    def runs(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(w) - n + 1))
        return F.when(F.size(w) > 0, F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, n)))).otherwise(F.array().cast("array<long>"))

    return let(words, runs)


def minhashes(hashes: Column, bands: Column) -> Column:
    """The smallest of each band's rehashes."""
    return let(hashes, lambda held: F.transform(F.sequence(F.lit(1), bands), lambda s: F.array_min(F.transform(held, lambda h: F.xxhash64(h, s)))))


def shape(n_words: int, least: float, miss: float = 1e-9) -> tuple[int, int]:
    """Of templates of this length the words of a shingle, and the bands that leave a chance of at most miss to pass one over."""
    size = min(SHINGLE, n_words)
    n = n_words - size + 1
    # repeated shingles make a template's set smaller: the least similarity over all sizes it can have
    similarity = min((k := -(-m * round(least * 1000) // 1000)) / (2 * n_words - size + 1 + m - k) for m in range(1, n + 1))
    return size, math.ceil(math.log(miss) / math.log(1 - similarity)) if similarity < 1 else 1


def needles(templates: list[tuple[str, str]], least: float) -> list[str]:
    """Words of which a text must hold one to hold the share least of any template."""
    out = set()
    for _, text in templates:
        words = words_of(text)
        size = min(SHINGLE, len(words))
        runs = list(dict.fromkeys(tuple(words[i : i + size]) for i in range(len(words) - size + 1)))
        spare = len(runs) - -(-len(runs) * round(least * 1000) // 1000) + 1
        out.update(max(r, key=lambda w: (len(w), w)) for r in sorted(runs, key=lambda r: -max(map(len, r)))[:spare])
    return sorted(out)


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = 0.8) -> DataFrame:
    """doc_id, template, containment (the best window's), first_token (of the first window that matches), n_windows.

    A row for each document and template of which a window holds at least this share. Templates are a list in the
    program, not a table that grows with the data.
    """
    templates = [t for t in (TEMPLATES if templates is None else templates) if words_of(t[1])]
    out = "doc_id long, template string, containment double, first_token int, n_windows long"
    spark = docs.sparkSession
    if not templates:
        return spark.createDataFrame([], out)
    by_length: dict[int, list[tuple[str, str]]] = {}
    for t in templates:
        by_length.setdefault(len(words_of(t[1])), []).append(t)
    known = spark.createDataFrame([(i, t, n, *shape(n, least)) for n, own in by_length.items() for i, t in own], "template string, text string, length int, size int, bands int")
    known = known.select("template", "length", "bands", F.array_distinct(shingles(tokens(F.col("text")), F.col("size"))).alias("wanted"))
    bands = known.select("template", "length", "wanted", F.posexplode(minhashes(F.col("wanted"), F.col("bands"))).alias("band", "value"))
    lowered, every = F.lower("text"), needles(templates, least)
    may = F.lit(False)
    for w in every:
        if not any(o != w and o in w for o in every):
            may = may | F.contains(lowered, F.lit(w))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(may).select("doc_id", tokens(F.col("text")).alias("t")).where(F.size("t") > 0)

    def windows(n: int, own: list[tuple[str, str]]) -> Column:
        """Windows of 2n words that hold a needle of the templates of n words."""
        size, count = shape(n, least)
        wanted = F.array(*map(F.lit, needles(own, least)))
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("t") - 1 - n), F.lit(n))
        cut = F.transform(starts, lambda s: F.struct(F.lit(n).alias("length"), F.lit(size).alias("size"), F.lit(count).alias("bands"), s.alias("start"), F.slice("t", s + 1, F.lit(2 * n)).alias("words")))
        return F.filter(cut, lambda w: F.arrays_overlap(w["words"], wanted))

    cut = rows.select("doc_id", F.explode(F.concat(*(windows(n, own) for n, own in sorted(by_length.items())))).alias("w"))
    cut = cut.select("doc_id", "w.length", "w.start", "w.bands", F.array_distinct(shingles(F.col("w.words"), F.col("w.size"))).alias("held"))
    met = cut.select("doc_id", "length", "start", "held", F.posexplode(minhashes(F.col("held"), F.col("bands"))).alias("band", "value")).join(F.broadcast(bands), ["length", "band", "value"])
    share = F.size(F.array_intersect("held", "wanted")) / F.size("wanted")
    good = met.select("doc_id", "template", "start", share.alias("containment")).where(F.col("containment") >= least - 1e-9)
    return good.groupBy("doc_id", "template").agg(F.max("containment").alias("containment"), F.min("start").cast("int").alias("first_token"), F.count_distinct("start").alias("n_windows"))
