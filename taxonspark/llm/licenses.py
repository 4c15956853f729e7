"""License scans: a paragraph classifier confirmed by template comparison.

Paragraphs are blocks between blank lines, cut where a line ends a sentence, so a notice wrapped over several lines is one
paragraph and a notice on a line of its own too. They become word n-grams (2 and 3), weighted down by how many documents
of the whole corpus hold them. A sparse (L1) multinomial logistic regression is trained on the templates (whole, with words missing,
and amid other words) against a bounded sample of the corpus' own paragraphs and a few everyday sentences as the unknown class; a
held-out part calibrates the probability that a paragraph is a licence at all. A predicted family is confirmed when
the paragraph holds enough of the word pairs of one of its templates.

Only n-grams of templates are features, and coefficients near zero are dropped, so a paragraph without any n-gram that speaks
for some family is unknown; such paragraphs are left out early by their words and word pairs, which changes no result.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import staged

#: Short notices by licence family.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("gpl", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("agpl", "Licensed under the GNU Affero General Public License, version 3."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Use of this source code is governed by a BSD-style license."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0 Universal."),
    ("public-domain", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission."),
]
#: ordinary sentences with words of licences, for the unknown class
ORDINARY = [
    "She renewed her driving license and left the office under heavy rain.",
    "The film was released under another title the following year.",
    "General elections are held under the supervision of the public authority.",
    "You may use the kitchen except in the evening.",
    "The work is free of charge for any person over sixty.",
    "He asked for permission to copy the files of the project.",
    "Researchers at MIT published version two of the source of the figures.",
    "The Apache crossed the river in 1870, as the documentation states.",
    "A commercial license costs more; terms and conditions follow.",
    "The right to vote is granted by law without modification.",
    "A fishing license is required by the state for any purpose.",
    "The common creative work of the children was on show.",
]
UNKNOWN = "unknown"


def paragraph_words(paragraph: Column) -> Column:
    return F.filter(F.split(F.lower(paragraph), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")


def ngrams(words: Column, n: int) -> Column:
    """All runs of ``n`` words. ``words`` stays out of the lambda, as an expression there would be computed for every element."""
    length = F.greatest(F.size(words) - (n - 1), F.lit(0))
    out = F.slice(words, F.lit(1), length)
    for k in range(2, n + 1):
        out = F.zip_with(out, F.slice(words, F.lit(k), length), lambda a, b: F.concat(a, F.lit(" "), b))
    return out


def grams(words: Column) -> Column:
    return F.array_distinct(F.concat(ngrams(words, 2), ngrams(words, 3)))


def paragraphs(text: Column) -> Column:
    """Lines of a text, those of a block joined until one ends a sentence; blank lines stay as blank paragraphs."""
    return F.split(F.regexp_replace(text, r"(?<=[^\s.:;!?])[ \t]*\r?\n[ \t]*(?=\S)", " "), r"\r?\n")


def _table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    """A small table out of one literal."""
    fields = [f.split()[0] for f in schema.split(", ")]
    data = json.dumps([dict(zip(fields, r, strict=True)) for r in rows])
    kind = ", ".join(f"{f.split(None, 1)[0]}: {f.split(None, 1)[1]}" for f in schema.split(", "))
    return spark.range(1).select(F.inline(F.from_json(F.lit(data), f"array<struct<{kind}>>")))


def _templates(spark: SparkSession) -> DataFrame:
    return _table(spark, [(f, i, t) for i, (f, t) in enumerate(TEMPLATES)], "family string, no int, t string").select(
        "family", "no", paragraph_words(F.col("t")).alias("w"))


def document_frequencies(docs: DataFrame, pairs: list[str]) -> dict[str, int]:
    """In how many of ``docs`` (_t) each of the word pairs and each of their words stands, over the whole corpus (summed in the
    tasks first)."""
    words = sorted({w for p in pairs for w in p.split(" ")})
    held = F.array_intersect(paragraph_words(F.col("_t")), F.array(*map(F.lit, words)))
    both = F.array_intersect(ngrams(paragraph_words(F.col("_t")), 2), F.array(*map(F.lit, pairs)))
    found = docs.select(F.explode(F.concat(held, F.when(F.size(held) > 0, both).otherwise(F.array().cast("array<string>")))).alias("g"))
    return {r.g: r["count"] for r in found.groupBy("g").count().collect()}


def training_rows(docs: DataFrame, max_sample: int) -> DataFrame:
    """(family, w, held, corpus): variants of the templates, ordinary sentences, and one paragraph each of about
    ``max_sample`` hashed documents (at most, in expectation) of which no template explains a part."""
    spark = docs.sparkSession
    known = _templates(spark).drop("no")
    pairs = [r.w for r in known.select(ngrams(F.col("w"), 2).alias("w")).collect()]
    n = docs.count()
    picked = docs.where(F.pmod(F.xxhash64("_t", F.lit(3)), F.lit(1 << 30)) < F.lit(int(min(1.0, max_sample / max(1, n)) * (1 << 30))))
    one = F.element_at("ps", (F.pmod(F.xxhash64("_t"), F.size("ps")) + 1).cast("int"))
    # staged between the steps, as a projection over another would compute its arrays once per use
    other = staged(picked.select("_t", F.filter(paragraphs(F.col("_t")), lambda x: F.btrim(x) != "").alias("ps")).where("size(ps) > 0"), "sample")
    other = staged(other.select(paragraph_words(one).alias("w")).where("size(w) > 0"), "sample")
    other = staged(other.select("w", ngrams(F.col("w"), 2).alias("two")), "sample")
    explained = F.greatest(*(F.size(F.array_intersect("two", F.array(*map(F.lit, p)))) / F.lit(float(len(p))) for p in pairs))
    other = other.where(explained < 0.25).select(F.lit(UNKNOWN).alias("family"), "w")
    plain = _table(spark, [(UNKNOWN, t) for t in ORDINARY], "family string, t string").select("family", paragraph_words(F.col("t")).alias("w"))
    plain = plain.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(5))))
    some = known.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(11))))
    noise = F.array(*(F.lit(x) for x in ("our", "house", "stands", "by", "a", "river")))
    # variant 0 is whole; 1 to 7 miss every eighth word; the others stand amid other words
    kept = F.filter("w", lambda w, i: (F.col("v") == 0) | (F.col("v") > 7) | (F.pmod(i + 1, F.lit(8)) != F.pmod(F.col("v"), F.lit(8))))
    some = some.withColumn("w", F.when(F.col("v") > 7, F.concat(F.slice(noise, F.lit(1), F.col("v") - 7), kept, noise)).otherwise(kept))
    rows = some.unionByName(plain).select("family", "w", (F.col("v") % 3 == 2).alias("held"), F.lit(False).alias("corpus"))
    return rows.unionByName(other.select("family", "w", (F.pmod(F.xxhash64("w"), F.lit(3)) == 2).alias("held"), F.lit(True).alias("corpus")))


class Model:
    """Margins of the families against unknown by n-gram, and the calibration of the best margin."""

    def __init__(self, families, bias, weights, scale, offset, often):
        self.families, self.bias, self.weights = families, bias, weights
        self.scale, self.offset = scale, offset
        #: n-grams that speak for some family; numbers alone, such as "2 0", don't
        self.telling = sorted(g for g, m in weights.items() if max(m) > 0 and re.search("[a-z]", g))
        #: the rarest word of each: a paragraph without any of them holds none
        self.keys = sorted({min(g.split(" "), key=lambda w: (often.get(w, 0), w)) for g in self.telling})

    def table(self, spark: SparkSession) -> DataFrame:
        return _table(spark, [(g, [float(x) for x in m]) for g, m in sorted(self.weights.items())], "gram string, m array<double>")

    def known(self, margin: Column) -> Column:
        return 1 / (1 + F.exp(-(F.lit(self.scale) * margin + F.lit(self.offset))))


def fit(docs: DataFrame, *, text: str = "text", max_sample: int = 2000, least: float = 0.05, floor: float = 0.25) -> Model:
    """Train on the templates and a sample of ``docs``. An n-gram's weight is its inverse document frequency over all of ``docs``, from 1 (in
    no document) down to ``floor``; that of three words follows the rarer of its pairs."""
    docs = docs.select(F.col(text).cast("string").alias("_t")).where("_t is not null")
    rows = staged(training_rows(docs, max_sample).withColumn("g", grams(F.col("w"))), "licenses")
    own = sorted({g for r in _templates(docs.sparkSession).select(grams(F.col("w")).alias("g")).collect() for g in r.g})
    often, n = document_frequencies(docs, [g for g in own if g.count(" ") == 1]), docs.count()

    def weight(g: str) -> float:
        w = g.split(" ")
        least_often = min(often.get(" ".join(w[i:i + 2]), 0) for i in range(len(w) - 1))
        return max(floor, 1 - math.log(least_often + 1) / math.log(n + 2))

    families = sorted({f for f, _ in TEMPLATES})
    label = F.array_position(F.array(*map(F.lit, [UNKNOWN, *families])), F.col("family")).cast("double") - 1
    x = CountVectorizerModel.from_vocabulary(own, "g", "seen").setBinary(True).transform(rows.withColumn("y", label))
    x = ElementwiseProduct(scalingVec=Vectors.dense([weight(g) for g in own]), inputCol="seen", outputCol="x").transform(x)
    lr = LogisticRegression(featuresCol="x", labelCol="y", family="multinomial", regParam=2e-4, elasticNetParam=0.9, maxIter=60, standardization=False)
    model = lr.fit(x.where("not held").coalesce(2))  # a few thousand rows at most
    coef, icept = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    margins, bias = coef[1:] - coef[0], [float(b - icept[0]) for b in icept[1:]]
    weights = {g: margins[:, k] * weight(g) for k, g in enumerate(own) if abs(margins[:, k]).max() > least}
    out = Model(families, bias, weights, 1.0, 0.0, often)
    held = rows.where("held").withColumn("_row", F.monotonically_increasing_id()).select("_row", "g", (F.col("family") != UNKNOWN).cast("double").alias("y"))
    scored = _margins(held.select("_row", "y", "g"), out, ["_row", "y"]).select("y", F.array_max("m").alias("best"))
    missing = held.count() - scored.count()  # rows without features: their margin is the bias
    if missing:
        scored = scored.unionByName(rows.sparkSession.range(missing).select(F.lit(0.0).alias("y"), F.lit(max(bias)).alias("best")))
    out.scale, out.offset = _calibrate(scored)
    if out.scale * max(bias) + out.offset >= 0:
        raise RuntimeError("a paragraph without features would not be unknown; widen the sample")
    return out


def _calibrate(scored: DataFrame) -> tuple[float, float]:
    """Logistic fit of (is a licence) on the best margin."""
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["best"], outputCol="b").transform(scored)
    m = LogisticRegression(featuresCol="b", labelCol="y", family="binomial", regParam=1e-3, maxIter=50).fit(rows)
    return float(m.coefficients[0]), float(m.intercept)


def _margins(rows: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """``rows`` (keys..., g) summed over the features that they hold: keys..., m (margin by family). The
    weights are bounded by the templates; the sums are grouped with map-side combining."""
    table = F.broadcast(model.table(rows.sparkSession))
    own = F.array(*map(F.lit, sorted(model.weights))).cast("array<string>")
    hit = rows.select(*keys, F.explode(F.array_intersect("g", own)).alias("gram")).join(table, "gram")
    sums = [F.sum(F.col("m")[i]).alias(f"m{i}") for i in range(len(model.families))]
    return hit.groupBy(*keys).agg(*sums).select(
        *keys, F.array(*(F.col(f"m{i}") + F.lit(b) for i, b in enumerate(model.bias))).alias("m"))


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", model: Model | None = None, confirm: float = 0.6) -> DataFrame:
    """One row per paragraph with an n-gram that speaks for some licence: doc_id, paragraph (0-based, see ``paragraphs``), family
    (``unknown`` if the calibrated probability is under one half), probability, template (number of the closest template of the
    family), containment, confirmed, words.

    Null and empty texts have no paragraphs; a very long line is one paragraph; repeated rows each report their
    paragraphs; ties between families or templates go to the first by name or number; an empty table
    gives no rows; other columns are not read."""
    spark = docs.sparkSession
    model = model or fit(docs, text=text)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("_t")).where("_t is not null")
    telling = F.array(*map(F.lit, model.telling)).cast("array<string>")
    keys = F.array(*map(F.lit, model.keys)).cast("array<string>")
    texts = rows.where(F.arrays_overlap(paragraph_words(F.col("_t")), keys))
    some = texts.select("doc_id", F.posexplode(paragraphs(F.col("_t"))).alias("paragraph", "line"))
    some = some.select("doc_id", "paragraph", paragraph_words(F.col("line")).alias("w")).where(F.arrays_overlap("w", keys))
    some = some.where(F.arrays_overlap(grams(F.col("w")), telling))
    some = staged(some.withColumn("_row", F.monotonically_increasing_id()), "paragraphs")
    scored = _margins(some.select("_row", grams(F.col("w")).alias("g")), model, ["_row"])
    names = F.array(*map(F.lit, model.families))
    scored = scored.withColumn("best", F.array_max("m")).select(
        "_row", F.round(model.known(F.col("best")), 6).alias("probability"),
        F.element_at(names, F.array_position("m", F.col("best")).cast("int")).alias("guess"))
    found = some.join(scored, "_row").withColumn("family", F.when(F.col("probability") >= 0.5, F.col("guess")).otherwise(UNKNOWN))
    pairs = _templates(spark).select(F.col("family").alias("f"), "no", ngrams(F.col("w"), 2).alias("tw"))
    per_family = F.broadcast(pairs.groupBy("f").agg(F.sort_array(F.collect_list(F.struct("no", "tw"))).alias("ts")))
    found = found.join(per_family, F.col("family") == F.col("f"), "left").withColumn("two", ngrams(F.col("w"), 2))
    shares = F.transform("ts", lambda t: F.struct(
        (F.size(F.array_intersect(t["tw"], F.col("two"))) / F.size(F.array_distinct(t["tw"]))).alias("share"), (-t["no"]).alias("no")))
    found = found.withColumn("top", F.array_max(shares))
    return found.select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), "family", "probability",
                        (-F.col("top.no")).cast("int").alias("template"), F.round(F.coalesce("top.share", F.lit(0.0)), 6).alias("containment"),
                        F.coalesce(F.col("top.share") >= confirm, F.lit(False)).alias("confirmed"), F.size("w").cast("long").alias("n_words"))
