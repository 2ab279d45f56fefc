"""Licence scan: a sparse word n-gram logistic regression names the licence family of a paragraph, a calibrated
threshold keeps what it doesn't know apart, and a comparison with the family's templates confirms the rest.
DataFrame functions and Spark ML only.

The classifier's features are the pairs of adjacent words of the templates that aren't both stop words.  It is
trained on the templates with words dropped by hash, and, as the unknown class, on all paragraphs of all documents
that share few of those features with any template: equal features are one row with their number of paragraphs, so
the rows are bounded by the vocabulary.  All unknown paragraphs together weigh as much as ``UNKNOWN_WEIGHT`` rows.
The threshold is the family probability that at most ``FALSE_RATE`` of all held-back unknown paragraphs reach.
A paragraph without any feature has the probabilities of the model's intercepts, which is to be unknown, so
it is passed over without being scored.

Defined cases: a null or empty text has no paragraph and no licence; repeated rows are scanned alike, and a
document whose id repeats is one document with all those paragraphs, as are all rows without an id; an empty table gives an empty result;
other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: The weight of all paragraphs of the unknown class together, in rows of templates' variants.
UNKNOWN_WEIGHT = 2_000.0
#: Variants of each template, share of unknown paragraphs let through, and overlap that confirms.
VARIANTS, FALSE_RATE, CONFIRMED = 24, 0.001, 0.6
UNKNOWN = "unknown"

#: Short public notices by family.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Distributed under the BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under the Creative Commons Attribution 4.0 International License.",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "cc0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released under CC0 1.0 Universal, dedicated to the public domain.",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "Licensed under the GNU General Public License, version 2.",
    ],
    "lgpl": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    ],
    "mpl-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ],
    "proprietary": [
        "All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.",
        "This software is proprietary and confidential. No license is granted.",
    ],
}
#: English words that make no feature of a pair by themselves.
STOP_WORDS = "a an and any are as at be by can for from has in is it of on or that the this to under use with you".split()


def words(text: F.Column) -> F.Column:
    """Lower-cased words; everything but letters and digits parts them."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def pairs(w: F.Column) -> F.Column:
    """Pairs of adjacent words that aren't both stop words."""
    stop = [F.lit(x) for x in STOP_WORDS]
    both = F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.when(a.isin(stop) & b.isin(stop), F.lit(None)).otherwise(F.concat_ws(" ", a, b)))
    return F.filter(both, lambda p: p.isNotNull())


def paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph) for every non-blank line."""
    return docs.select("doc_id", F.explode(F.split("text", r"\R")).alias("paragraph")).where(F.trim("paragraph") != "")


def templates(spark: SparkSession) -> DataFrame:
    rows = [(family, text) for family, texts in sorted(TEMPLATES.items()) for text in texts]
    return spark.createDataFrame(rows, "family string, template string").withColumn("pairs", F.array_distinct(pairs(words(F.col("template")))))


@dataclass(frozen=True)
class Model:
    vocabulary: list[str]
    counts: CountVectorizerModel
    classifier: LogisticRegressionModel
    families: list[str]
    threshold: float

    def probabilities(self, rows: DataFrame) -> DataFrame:
        """``rows`` with pairs (array) gain family and score: the likeliest known one and its probability."""
        known = [F.struct(vector_to_array("probability")[i].alias("score"), F.lit(f).alias("family")) for i, f in enumerate(self.families) if f != UNKNOWN]
        out = self.classifier.transform(self.counts.transform(rows)).withColumn("best", F.array_max(F.array(*known)))
        return out.withColumns({"family": F.col("best.family"), "score": F.col("best.score")}).drop("features", "rawPrediction", "probability", "prediction", "best")


def bound(value: F.Column, use: Callable[[F.Column], F.Column]) -> F.Column:
    """``use`` of a value that is evaluated once, however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def featured(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, held, pairs, width, n): the paragraphs of all documents by their features (``pairs`` of the vocabulary, in
    order), the number of their different pairs, and whether they are held back; those without any feature are counted
    together, whatever their document."""
    seen = sorted({w for pair in vocabulary for w in pair.split(" ")} - set(STOP_WORDS))
    none = F.array().cast("array<string>")

    def features(w: F.Column) -> F.Column:
        own = F.when(F.arrays_overlap(w, F.array(*map(F.lit, seen))), pairs(w)).otherwise(none)
        return bound(own, lambda p: F.struct(F.filter(p, lambda x: x.isin(vocabulary)).alias("pairs"), p.alias("all")))

    held = (F.pmod(F.xxhash64("paragraph"), F.lit(4)) == 0).alias("held")
    rows = paragraphs(docs).select("doc_id", held, bound(words(F.col("paragraph")), features).alias("x"))
    some = F.size("x.pairs") > 0
    keys = [F.when(some, F.col("doc_id")).alias("doc_id"), "held", F.col("x.pairs").alias("pairs"), F.when(some, F.size(F.array_distinct("x.all"))).otherwise(0).alias("width")]
    return rows.select(*keys).groupBy("doc_id", "held", "pairs", "width").agg(F.count("*").alias("n"))


def scanned(docs: DataFrame) -> DataFrame:
    """What :func:`featured` gives for the templates' vocabulary, written once, as the model and the scan both read it."""
    return common.cut(featured(docs, vocabulary(docs.sparkSession)))


def vocabulary(spark: SparkSession) -> list[str]:
    return [r[0] for r in templates(spark).select(F.explode("pairs").alias("p")).distinct().orderBy("p").collect()]  # of the templates above


def fit(docs: DataFrame, seen: DataFrame | None = None) -> Model:
    """``seen``: what :func:`scanned` gives for the documents."""
    spark = docs.sparkSession
    seen = scanned(docs) if seen is None else seen
    known, terms = templates(spark), vocabulary(spark)
    counts = CountVectorizerModel.from_vocabulary(terms, "pairs", "features")
    few = seen.where(F.size(F.array_distinct("pairs")) < 2).groupBy(F.array_sort("pairs").alias("pairs"), "held").agg(F.sum("n").cast("double").alias("n"))
    few = common.cut(few)  # at most one pair, and how often
    total = few.where(~F.col("held")).agg(F.sum("n")).first()[0] or 1.0
    unknown = few.where(~F.col("held")).select(F.lit(UNKNOWN).alias("family"), "pairs", (F.col("n") * (UNKNOWN_WEIGHT / total)).alias("weight"))
    dropped = F.filter(words(F.col("template")), lambda x, i: (F.col("v") == 0) | (F.pmod(F.xxhash64(x, i, "v"), F.lit(16)) != 0))
    positive = known.select("family", "template", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1))).alias("v")).select("family", dropped.alias("w"))
    # sentences that speak of licences without granting one, so that such words alone decide nothing
    talk = ["license", "a driving license is required", "the license was published", "public version", "software version 2", "copyright law", "free of charge", "source and binary", "read the terms", "without restriction on the work", ""]
    spoken = spark.createDataFrame([(t, v) for t in talk for v in range(6)], "t string, v int").select(F.lit(UNKNOWN).alias("family"), words(F.col("t")).alias("w"))
    rows = common.cut(positive.unionByName(spoken).select("family", pairs(F.col("w")).alias("pairs"), F.lit(1.0).alias("weight")).unionByName(unknown))
    families = sorted([*TEMPLATES, UNKNOWN])
    number = F.array_position(F.array(*map(F.lit, families)), F.col("family")).cast("double") - 1
    labelled = counts.transform(rows).withColumn("label", number)
    classifier = LogisticRegression(maxIter=60, regParam=2e-4, family="multinomial", weightCol="weight").fit(labelled)
    raw = Model(terms, counts, classifier, families, 0.5)
    return Model(terms, counts, classifier, families, min(0.95, max(0.5, exceeded(raw.probabilities(few.where("held").select("pairs", "n")).select("score", "n"), FALSE_RATE))))


def exceeded(scores: DataFrame, share: float) -> float:
    """The least of the scores (score, n) that at most ``share`` of them, each counted n times, are above; 0 without any."""
    each = scores.groupBy("score").agg(F.sum("n").alias("n"))  # as many as there are different features
    total = each.agg(F.sum("n")).first()[0] or 0.0
    above = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return each.withColumn("above", above).where(F.col("above") <= share * total).agg(F.min("score")).first()[0] or 0.0


def scan(docs: DataFrame, model: Model, seen: DataFrame | None = None) -> DataFrame:
    """Every doc_id once, with n_paragraphs of a confirmed licence, families (sorted, comma-joined; empty:
    none), and of the likeliest one family, score and overlap (null: none).  ``seen`` as for :func:`fit`."""
    spark = docs.sparkSession
    seen = featured(docs, model.vocabulary) if seen is None else seen
    rows = seen.where(F.size("pairs") > 0).select("doc_id", "pairs", "width", "n")
    likely = model.probabilities(rows).where(F.col("score") >= model.threshold)
    forms = templates(spark).groupBy("family").agg(F.collect_list("pairs").alias("forms"))  # as many rows as families
    own = F.array_distinct("pairs")
    overlap = F.array_max(F.transform("forms", lambda t: F.size(F.array_intersect(own, t)) / F.least(F.size(t), F.greatest(F.col("width"), F.lit(2)))))
    found = likely.join(F.broadcast(forms), "family").withColumn("overlap", overlap).where(F.col("overlap") >= CONFIRMED)
    per_doc = found.groupBy("doc_id").agg(
        F.sum("n").alias("n_paragraphs"), F.array_join(F.array_sort(F.collect_set("family")), ",").alias("families"), F.max(F.struct("score", "overlap", "family")).alias("best")
    )
    named = per_doc.withColumnRenamed("doc_id", "of")
    joined = docs.select("doc_id").distinct().join(named, F.col("doc_id").eqNullSafe(F.col("of")), "left")
    return joined.select("doc_id", F.coalesce("n_paragraphs", F.lit(0)).cast("long").alias("n_paragraphs"), F.coalesce("families", F.lit("")).alias("families"), F.col("best.family").alias("family"), F.col("best.score").alias("score"), F.col("best.overlap").alias("overlap"))
