"""License scan: sparse TF-IDF cosine of passages to templates, then inheritance from the nearest ancestor directory.

Every line and sentence of a text is a passage, its terms counting once. A term's document frequency is counted over all
documents, for the terms of the templates and for all others of the scored passages. For each template the heaviest terms are
its triggers: a passage without one of them cannot reach the threshold, so only passages with a trigger are scored, and
none is lost. A document's license is that of its best passage. Documents with a license file's name, or of few words,
are license files: the commonest license among those of a directory holds for all documents below that have none of their
own, the nearest directory winning. Column functions only; the scored terms are at most those of the templates.

Defined results: a null or empty text has no license of its own; a null path has no directory and inherits nothing; equal
scores go to the license first in order; repeated rows are scored once and listed each time; an empty table gives an empty
table; extra columns pass through, and those named like a result are replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from helixbag.session import checked_broadcast, materialize

# Notices of public licenses, as (license, text).
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "Copyright. All rights reserved."),
]
THRESHOLD = 0.75
# Most words of a license file without the name of one.
FILE_WORDS = 60
FILE_NAMES = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"
NOT_TERM = r"[^a-z0-9]+"


def terms(text: Column) -> Column:
    """Distinct terms: lower-case runs of letters and digits."""
    return F.array_distinct(F.array_remove(F.split(F.lower(text), NOT_TERM), ""))


def passages(text: Column) -> Column:
    """Lines, and sentences inside lines."""
    return F.array_union(F.split(text, "\n"), F.split(F.regexp_replace(text, r"([.!?])[ \t\r]+", "$1\n"), "\n"))


def _values(spark, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A small fixed table (the templates' terms)."""
    def shown(value) -> str:
        return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)

    listed = ", ".join("(" + ", ".join(map(shown, row)) + ")" for row in rows)
    return spark.sql(f"select * from values {listed} as t({schema})")


def _python_terms(text: str) -> list[str]:
    return sorted({t for t in re.split(NOT_TERM, text.lower()) if t})


def weights(docs: DataFrame, text: str, templates: Sequence[tuple[str, str]]) -> tuple[int, dict[str, float]]:
    """Number of documents, and the inverse document frequency of each term of the templates."""
    words = sorted({t for _, body in templates for t in _python_terms(body)})
    held = F.array_intersect(terms(F.col(text)), F.array(*[F.lit(w) for w in words]))
    n = docs.count()
    seen = {r[0]: r[1] for r in docs.select(F.explode(held).alias("term")).groupBy("term").count().collect()}
    return n, {w: math.log((1 + n) / (1 + seen.get(w, 0))) + 1 for w in words}


def triggers(idf: dict[str, float], templates: Sequence[tuple[str, str]], threshold: float) -> list[str]:
    """Terms without which no passage reaches the threshold: what is left of a template has too little weight."""
    found = set()
    for _, body in templates:
        own = sorted(_python_terms(body), key=lambda t: (idf[t], t))
        limit = threshold**2 * sum(idf[t] ** 2 for t in own)
        left = 0.0
        for term in own:
            left += idf[term] ** 2
            if left >= limit * (1 - 1e-9):
                found.add(term)
    return sorted(found)


def score(docs: DataFrame, text: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES,
          threshold: float = THRESHOLD) -> DataFrame:
    """(_text_hash, _size, license, score) of each distinct text whose best passage reaches the threshold."""
    n, idf = weights(docs, text, templates)
    needed = triggers(idf, templates, threshold)
    rows = []
    for i, (name, body) in enumerate(templates):
        own = _python_terms(body)
        norm = math.sqrt(sum(idf[t] ** 2 for t in own))
        rows += [(t, i, name, idf[t], idf[t] / norm) for t in own]
    known = _values(docs.sparkSession, sorted({(r[0], r[3]) for r in rows}), "term, idf")
    shares = _values(docs.sparkSession, [(r[0], r[1], r[2], r[4]) for r in rows], "term, template, license, share")
    triggered = F.array(*[F.lit(t) for t in needed])

    texts = docs.select(F.xxhash64(text).alias("_text_hash"), F.length(text).alias("_size"), F.col(text).alias("_text"))
    texts = texts.where(F.arrays_overlap(terms(F.col("_text")), triggered))
    cut = texts.select("_text_hash", "_size", F.explode(passages(F.col("_text"))).alias("_passage"))
    held = cut.select("_text_hash", "_size", F.xxhash64("_passage").alias("_passage"), terms(F.col("_passage")).alias("_terms"))
    held = materialize(held.where(F.arrays_overlap("_terms", triggered)).distinct(), "passages")
    each = held.select("_text_hash", "_size", "_passage", F.explode("_terms").alias("term"))
    outside = each.select("term").distinct().join(F.broadcast(known), "term", "left_anti")
    # Counted by term before the join, so a word of every document is one row.
    seen = docs.select(F.explode(terms(F.col(text))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("_df"))
    common = seen.join(outside, "term")
    others = checked_broadcast(common.select("term", (F.log((1 + F.lit(n)) / (1 + F.col("_df"))) + 1).alias("_other")))
    # All terms enter the norm, those of the templates also the products.
    weighed = each.join(F.broadcast(known), "term", "left").join(others, "term", "left")
    held_terms = F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("term", "idf"))).alias("_terms")
    norms = weighed.groupBy("_text_hash", "_size", "_passage").agg(
        F.sum(F.coalesce("idf", "_other") ** 2).alias("_square"), held_terms)
    length = F.sqrt("_square")
    dots = norms.withColumn("_length", length).select(
        "_text_hash", "_size", "_passage", "_length", F.inline("_terms")).join(F.broadcast(shares), "term").groupBy(
        "_text_hash", "_size", "_passage", "_length", "template", "license").agg(F.sum(F.col("idf") * F.col("share")).alias("_dot"))
    likeness = F.round(F.col("_dot") / F.col("_length"), 6)
    best = dots.select("_text_hash", "_size", "license", likeness.alias("score")).where(F.col("score") >= threshold)
    top = best.groupBy("_text_hash", "_size", "license").agg(F.max("score").alias("score"))
    return top.groupBy("_text_hash", "_size").agg(F.min(F.struct((-F.col("score")).alias("_s"), "license")).alias("_best")).select(
        "_text_hash", "_size", F.col("_best.license").alias("license"), (-F.col("_best._s")).alias("score"))


def ancestors(directory: Column) -> Column:
    """(directory, depth) of a directory and all above it; ``a/b`` is below ``a``."""
    parts = F.split(directory, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(
        F.array_join(F.slice(parts, 1, i), "/").alias("above"), i.alias("depth")))


def scan(docs: DataFrame, path: str = "path", text: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES,
         threshold: float = THRESHOLD) -> DataFrame:
    """Append license, license_score and license_from (``file``, ``text``, a directory that hands its license down, or null)."""
    results = ["license", "license_score", "license_from"]
    docs = docs.drop(*results)
    own = score(docs, text, templates, threshold)
    named = docs.withColumn("_hash", F.xxhash64(text)).withColumn("_length", F.length(text)).withColumn(
        "_directory", F.regexp_extract(F.col(path), r"^(.*)/[^/]*$", 1))
    joined = named.join(own, (F.col("_hash") == F.col("_text_hash")) & (F.col("_length") == F.col("_size")), "left")
    is_file = F.coalesce(F.col(path).rlike(FILE_NAMES), F.lit(False)) | (F.size(F.split(F.trim(F.col(text)), r"\s+")) <= FILE_WORDS)
    marked = joined.withColumn("_file", is_file & F.col("license").isNotNull())

    counted = marked.where("_file and _directory <> ''").groupBy("_directory", "license").agg(F.count(F.lit(1)).alias("_n"))
    # One row per license of a directory is compared: at most as many as there are templates.
    held = counted.groupBy("_directory").agg(F.min(F.struct((-F.col("_n")).alias("_n"), "license")).alias("_best")).select(
        F.col("_directory").alias("_above"), F.col("_best.license").alias("_given"))
    directories = named.where("_directory <> ''").select("_directory").distinct()
    up = directories.select("_directory", F.inline(ancestors(F.col("_directory"))))
    nearest = up.join(held, F.col("above") == F.col("_above")).groupBy("_directory").agg(
        F.max(F.struct("depth", F.col("_above").alias("above"), F.col("_given").alias("given"))).alias("_near")).select(
        F.col("_directory").alias("_d"), F.col("_near.above").alias("_from"), F.col("_near.given").alias("_inherited"))
    out = marked.join(nearest, F.col("_directory") == F.col("_d"), "left")
    source = F.when(F.col("_file"), "file").when(F.col("license").isNotNull(), "text").otherwise(F.col("_from"))
    return out.withColumn("license_from", source).withColumn("license", F.coalesce("license", "_inherited")).withColumnRenamed(
        "score", "license_score").select(*docs.columns, *results)
