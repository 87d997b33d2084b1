"""Licence scans in DataFrame functions only.

Lines that speak of a licence are compared with templates by the cosine of sparse TF-IDF vectors, where the document
frequencies come from all files. A file without a licence of its own takes the one of the nearest directory above it
that a licence file declares, found by joining directories with their ancestors.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence names with header lines and opening words of licence files.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)
HINT = r"(?i)licen[cs]|permission|redistribut|copyright|spdx"
TERM = r"([\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*)"
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)([-._].*)?$"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(1))


def template_terms(spark) -> DataFrame:
    """(template, license, term, tf); the templates are fixed, so this is a small constant table."""
    rows = F.array(*[F.struct(F.lit(i).alias("template"), F.lit(n).alias("license"), F.lit(t).alias("line")) for i, (n, t) in enumerate(TEMPLATES)])
    named = spark.range(1).select(F.explode(rows).alias("t")).select("t.*")
    return (
        named.select("template", "license", F.explode(terms(F.col("line"))).alias("term"))
        .groupBy("template", "license", "term").agg(F.count("*").alias("tf"))
    )


def term_weights(files: DataFrame) -> DataFrame:
    """(term, idf, unseen) for each term of the templates over all files; `unseen` is the weight of any other term."""
    spark = files.sparkSession
    vocabulary = F.array_distinct(F.flatten(F.array(*[terms(F.lit(t)) for _, t in TEMPLATES])))
    seen = files.select(F.explode(F.array_intersect(terms(F.coalesce("text", F.lit(""))), vocabulary)).alias("term"))
    frequency = seen.groupBy("term").agg(F.count("*").alias("df"))
    size = files.agg(F.count("*").alias("files"))
    idf = F.log((1 + F.col("files")) / (1 + F.coalesce("df", F.lit(0)))) + 1
    words = template_terms(spark).select("term").distinct()
    return words.join(frequency, "term", "left").join(F.broadcast(size)).select(  # one row
        "term", idf.alias("idf"), (F.log(1 + F.col("files")) + 1).alias("unseen")
    )


def line_matches(files: DataFrame, least: float) -> DataFrame:
    """(path, line, license, cosine): the best template of each line of `files` (path, text) that reaches `least`."""
    weights = F.broadcast(term_weights(files))  # as many rows as the fixed templates have terms
    templates = (
        template_terms(files.sparkSession).join(weights, "term")
        .select("template", "license", "term", (F.col("tf") * F.col("idf")).alias("weight"), "unseen")
    )
    norms = templates.groupBy("template").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("norm"))
    templates = F.broadcast(templates.join(norms, "template"))
    lines = (
        files.filter(F.col("text").rlike(HINT))
        .select("path", F.posexplode(F.split("text", "\n", -1)).alias("line", "content"))
        .filter(F.col("content").rlike(HINT))
    )
    tf = (
        lines.select("path", "line", F.explode(terms(F.col("content"))).alias("term"))
        .groupBy("path", "line", "term").agg(F.count("*").alias("n"))
    )
    unseen = weights.agg(F.max("unseen").alias("most"))
    own = tf.join(weights.drop("unseen"), "term", "left").join(F.broadcast(unseen)).select(  # one row
        "path", "line", "term", (F.col("n") * F.coalesce("idf", "most")).alias("own")
    )
    # a line's terms meet once: with the templates' weights of each, and with its own norm
    sizes = own.groupBy("path", "line").agg(F.sqrt(F.sum(F.col("own") ** 2)).alias("size"))
    dots = (
        own.join(templates, "term")
        .groupBy("path", "line", "template", "license", "norm").agg(F.sum(F.col("own") * F.col("weight")).alias("dot"))
    )
    cosine = F.round(F.col("dot") / (F.col("size") * F.col("norm")), 6)
    scored = dots.join(sizes, ["path", "line"]).withColumn("cosine", cosine).filter(F.col("cosine") >= least)
    best = F.min(F.struct((-F.col("cosine")).alias("order"), "license", "cosine"))
    return scored.groupBy("path", "line").agg(best.alias("b")).select("path", "line", "b.license", "b.cosine")


def folder(path: Column) -> Column:
    """The path up to its last slash; the empty root for a bare name."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def nearest_declared(folders: DataFrame, declared: DataFrame) -> DataFrame:
    """(folder, inherited, origin): the licence of the nearest of a folder and those above it that `declared` (folder,
    license) holds; folders without one are left out."""
    parts = F.split("folder", "/")
    above = folders.select(
        "folder",
        F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))).alias("above"),
    ).distinct()
    named = declared.select(F.col("folder").alias("above"), "license")
    return (
        above.join(named, "above")
        .groupBy("folder")
        .agg(F.max_by(F.struct("license", "above"), F.length("above")).alias("b"))
        .select("folder", F.col("b.license").alias("inherited"), F.col("b.above").alias("origin"))
    )


def scan(files: DataFrame, least: float = 0.6) -> DataFrame:
    """path, license, cosine, source (own, inherited or none) and origin of every row of `files` (path, text).

    A file's own licence is that of its best line, of equal ones the first by name; rows that repeat a path share
    it. A folder's licence is that of its best licence file. Null and empty texts have none of their own and
    inherit; a null path inherits nothing; an empty table gives an empty result; other columns are ignored.
    """
    rows = files.select("path", F.col("text").cast("string").alias("text"))
    best = F.min(F.struct((-F.col("cosine")).alias("order"), "license", "cosine"))
    found = line_matches(rows, least).groupBy("path").agg(best.alias("b")).select("path", F.col("b.license").alias("own"), F.col("b.cosine").alias("cosine"))
    paths = rows.select("path")
    name = F.regexp_extract("path", "[^/]*$", 0)
    declared = (
        found.filter(name.rlike(LICENCE_FILE)).withColumn("folder", folder(F.col("path")))
        .groupBy("folder").agg(F.min(F.struct((-F.col("cosine")).alias("order"), F.col("own").alias("license"))).alias("b"))
        .select("folder", "b.license")
    )
    folders = paths.filter("path IS NOT NULL").select(folder(F.col("path")).alias("folder")).distinct()
    inherited = nearest_declared(folders, declared)
    told = paths.withColumn("folder", folder(F.col("path"))).join(found, "path", "left").join(inherited, "folder", "left")
    source = F.when(F.col("own").isNotNull(), "own").when(F.col("inherited").isNotNull(), "inherited").otherwise("none")
    return told.select(
        "path", F.coalesce("own", "inherited").alias("license"), "cosine", source.alias("source"),
        F.when(F.col("own").isNull(), F.col("origin")).alias("origin"),
    )
