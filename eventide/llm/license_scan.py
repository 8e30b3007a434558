"""License scans: TF-IDF cosine to templates, then inheritance from the nearest directory."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from eventide.session import stage_table

#: Header lines of common licences (fixed values).
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "Subject to the terms of the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("proprietary", "All rights reserved."),
]
#: Names of licence files (fixed values).
LICENSE_FILE = r"(?i)^(licen[cs]e|copying|notice)([-._].*)?$"


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _parent(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def license_scan(
    files: DataFrame, templates: DataFrame | None = None, path: str = "path", text: str = "text", key: str = "doc_id",
    threshold: float = 0.6,
) -> DataFrame:
    """Licence of every file: its own line's, or else that of the nearest directory above.

    One row per file: ``key``, ``path``, own_license, score, license, inherited_from (directory; null
    if the licence is the file's own or there is none).

    Every line of the whole text that shares a telling word with a template is a sparse TF-IDF vector
    (frequencies over all files, of a template's words and of all others). A word is telling if the
    template's other words could not reach ``threshold`` without it or a rarer one. The line's cosine to each
    template is a join on words. The best line of ``threshold`` or more gives the file's licence. A
    licence file (LICENSE, COPYING, NOTICE) gives its own to its directory, from where it reaches all
    files below that have none, unless a nearer directory has another.

    Ties go to the greater cosine, then the first licence, then the first path. A null text has no
    lines; a file with a null path has no directory above it; repeated rows and keys give a row each. Empty tables give no
    rows. Other columns are ignored. DataFrame functions only.
    """
    spark = files.sparkSession
    if templates is None:
        templates = spark.createDataFrame(TEMPLATES, "license string, text string")
    rows = files.select(F.col(key).alias("id"), F.col(path).cast("string").alias("path"), F.col(text).cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("id", "path", "text"))
    own = templates.select("license", F.xxhash64("license", "text").alias("template"), F.explode(words(F.col("text"))).alias("w"))
    own = stage_table(own.groupBy("template", "license", "w").agg(F.count("*").alias("n")), "templates")
    vocabulary = [r.w for r in own.select("w").distinct().collect()]  # as large as the templates
    known = F.array(*map(F.lit, vocabulary)).cast("array<string>")

    # Files that hold each word, and all files.
    held = rows.select(F.explode(F.array_append(F.array_intersect(words(F.coalesce("text", F.lit(""))), known), F.lit("")).alias("w")))
    counts = {r.w: r.n for r in held.toDF("w").groupBy("w").agg(F.count("*").alias("n")).collect()}  # as large as the templates
    total = counts.get("", 0)
    weights = [(w, counts.get(w, 0)) for w in vocabulary]
    idf = spark.createDataFrame(weights, "w string, df long").select("w", F.log((F.lit(total) + 2) / (F.col("df") + 1)).alias("idf"))
    weighted = own.join(idf, "w").withColumn("x", F.col("n") * F.col("idf"))
    size = weighted.groupBy("template").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"))
    weighted = stage_table(weighted.join(size, "template").select("w", "template", "license", (F.col("x") / F.greatest("size", F.lit(1e-12))).alias("t")), "weights")

    # A cosine is at most the length of the template over the words met. Words are telling, rarest first,
    # until those left over are too short together to reach the threshold.
    telling = set()
    per_template: dict[int, list] = {}
    for r in weighted.collect():  # as large as the templates
        per_template.setdefault(r.template, []).append((counts.get(r.w, 0), r.w, r.t * r.t))
    for own_words in per_template.values():
        left = sum(x[2] for x in own_words)
        for _, w, part in sorted(own_words):
            if left < max(threshold - 1e-6, 0.0) ** 2:
                break
            telling.add(w)
            left -= part
    telling_words = F.array(*map(F.lit, sorted(telling))).cast("array<string>")
    lines = rows.where("text is not null").select("h", F.explode(F.split("text", "\n")).alias("line")).withColumn("ws", words(F.col("line")))
    lines = lines.where(F.arrays_overlap("ws", telling_words)).select("h", F.xxhash64("line").alias("l"), "ws")
    lines = stage_table(lines.dropDuplicates(["h", "l"]), "lines")
    # A line is scored once, however many files hold it.
    terms = lines.dropDuplicates(["l"]).select("l", F.explode("ws").alias("w"))
    known_idf = F.create_map(*(F.lit(x) for w, n in weights for x in (w, math.log((total + 2) / (n + 1)))))
    terms = terms.groupBy("l", "w").agg(F.count("*").alias("n"))
    terms = stage_table(terms.withColumn("idf", F.try_element_at(known_idf, F.col("w"))), "words")
    # The other words of these lines are counted over all files too.
    others = terms.where("idf is null").select("w").distinct()
    held = rows.select(F.explode(F.array_except(words(F.coalesce("text", F.lit(""))), known)).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    others = stage_table(held.join(others, "w", "left_semi").select("w", F.log((F.lit(total) + 2) / (F.col("df") + 1)).alias("other")), "others")
    terms = terms.join(others, "w", "left").select("l", "w", (F.col("n") * F.coalesce("idf", "other")).alias("x"))
    terms = stage_table(terms, "terms")
    size = terms.groupBy("l").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("size"))
    dots = terms.join(weighted, "w").groupBy("l", "template", "license").agg(F.sum(F.col("x") * F.col("t")).alias("dot"))
    scored = dots.join(size, "l").select("l", "license", F.round(F.col("dot") / F.greatest("size", F.lit(1e-12)), 9).alias("score"))
    scored = stage_table(scored.where(F.col("score") >= threshold), "scores")
    scored = lines.select("h", "l").join(scored, "l").groupBy("h", "license").agg(F.max("score").alias("score"))
    best = scored.groupBy("h").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("license"))).alias("b"))
    best = stage_table(best.select("h", F.col("b.license").alias("own_license"), (-F.col("b.s")).alias("score")), "own")

    names = rows.select("id", "path", "h", _parent(F.col("path")).alias("dir"))
    owned = names.join(best, "h", "left").select("id", "path", "dir", "own_license", "score")
    giving = owned.where(F.regexp_extract("path", "([^/]*)$", 1).rlike(LICENSE_FILE) & F.col("own_license").isNotNull())
    giving = giving.groupBy(F.col("dir").alias("at")).agg(F.min(F.struct((-F.col("score")).alias("s"), "own_license", "path")).alias("b"))
    giving = giving.select("at", F.col("b.own_license").alias("given"))
    dirs = names.where("dir is not null").select("dir").distinct()
    parts = F.split("dir", "/")
    above = dirs.select("dir", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("depth", "at"))
    root = dirs.where("dir <> ''").select("dir", F.lit(-1).alias("depth"), F.lit("").alias("at"))
    nearest = above.unionByName(root).join(giving, "at").groupBy("dir").agg(F.max(F.struct("depth", "at", "given")).alias("b"))
    nearest = nearest.select("dir", F.col("b.at").alias("at"), F.col("b.given").alias("given"))
    return owned.join(nearest, "dir", "left").select(
        F.col("id").alias(key), F.col("path").alias(path), "own_license", "score", F.coalesce("own_license", "given").alias("license"),
        F.when(F.col("own_license").isNull(), F.col("at")).alias("inherited_from"),
    )
