"""Operator 4: licence scans by a trained paragraph classifier, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm.common import few_smallest
from panelkit.sources.io import materialize

# Notices by licence family, as projects print them.
TEMPLATES = {
    "all-rights-reserved": ["All rights reserved.", "Copyright. All rights reserved."],
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Released under the BSD License.",
    ],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License."],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License.",
    ],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 3."],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    ],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "public-domain": ["Dedicated to the public domain under CC0 1.0 Universal."],
}
#: Words of notices, put into paragraphs that teach the unknown class. They choose training rows only:
#: which paragraphs are scanned does not depend on them.
ANCHORS = (
    "license licensed licenses licence licenced copyright rights permission permitted redistribution "
    "redistribute apache gnu gpl lgpl mit bsd mpl mozilla creative commons cc cc0 domain"
).split()
ANCHOR = r"(?i)\b(?:" + "|".join(ANCHORS) + r")\b"
UNKNOWN = "unknown"
WORD = r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*"


@dataclass(frozen=True)
class Settings:
    #: Bounds on the rows that teach the unknown class: documents (smallest hash of their id) and
    #: paragraphs taken from them, of at most so many characters.
    docs: int = 400
    paragraphs: int = 3000
    chars: int = 4000
    #: Share of a template's word pairs that must occur in the paragraph to confirm a prediction.
    confirm: float = 0.5
    penalty: float = 0.0005


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _grams(words: Column) -> Column:
    """Words, pairs and triples, joined by blanks. ``words`` must be a column, not an expression:
    it is named once per run, and an expression would be evaluated for each of them."""
    n = F.size(words)

    def runs(k: int) -> Column:
        starts = F.when(n >= k, F.sequence(F.lit(1), n - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(words, i, k), " "))

    return F.array_distinct(F.concat(words, runs(2), runs(3)))


def _known_grams(words: Column, vocabulary: Sequence[str]) -> Column:
    """Those of ``_grams`` that are in a vocabulary. Only runs that begin like one of its own are joined, and
    looked up in a set; whole texts pass through here."""
    n = F.size(words)

    def runs(k: int) -> Column:
        held = [g for g in vocabulary if g.count(" ") == k - 1]
        first = sorted({g.split(" ")[0] for g in held})
        starts = F.when(n >= k, F.sequence(F.lit(1), n - (k - 1))).otherwise(F.array().cast("array<int>"))
        starts = F.filter(starts, lambda i: F.get(words, i - 1).isin(first))
        return F.filter(F.transform(starts, lambda i: F.array_join(F.slice(words, i, k), " ")), lambda g: g.isin(held))

    single = [g for g in vocabulary if " " not in g]
    return F.array_distinct(F.concat(F.filter(words, lambda w: w.isin(single)), runs(2), runs(3)))


def _template_frame(spark: SparkSession) -> DataFrame:
    rows = [(f, t) for f, ts in TEMPLATES.items() for t in ts]
    return spark.createDataFrame(rows, "family string, text string").withColumn("words", _words(F.col("text")))


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, paragraph, body): every line of every text, numbered from 0."""
    rows = docs.select(F.col(id_col).alias("key"), F.posexplode(F.split(text_col, "\n")).alias("paragraph", "body"))
    return rows.withColumn("paragraph", F.col("paragraph").cast("long"))


def training_rows(docs: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """(family, words, complete): every run of at least two thirds of a template's words, and, as unknown,
    paragraphs of the corpus without an anchor word, half of them with one put in."""
    spark = docs.sparkSession
    t = _template_frame(spark)
    n = F.size("words")
    least = F.ceil(n * 2 / 3).cast("int")
    lengths = t.select("family", "words", F.explode(F.sequence(least, n)).alias("k"))
    known = lengths.select("family", "words", "k", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("k") + 1)).alias("i"))
    cut = F.slice("words", F.col("i"), F.col("k"))
    known = known.select("family", cut.alias("words"), (F.col("k") == F.size("words")).alias("complete"))
    rows = docs.select(F.col(id_col).alias("key"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("place"))
    few = few_smallest(rows.filter("text is not null"), "place", s.docs).orderBy("place", "key", F.xxhash64("text")).limit(s.docs)
    lines = few.select(F.explode(F.split("text", "\n")).alias("body"))
    lines = lines.filter(~F.col("body").rlike(ANCHOR) & (F.length("body") <= s.chars))
    lines = lines.select(_words(F.col("body")).alias("words")).filter(F.size("words") > 0)
    lines = lines.orderBy(F.xxhash64("words")).limit(s.paragraphs).withColumn("h", F.xxhash64("words"))
    anchor = F.get(F.array(*map(F.lit, ANCHORS)), F.pmod(F.col("h"), F.lit(len(ANCHORS))).cast("int"))
    at = F.pmod(F.shiftright("h", 8), F.size("words").cast("long")).cast("int")
    mixed = F.concat(F.slice("words", F.lit(1), at), F.array(anchor), F.slice("words", at + 1, F.size("words")))
    unknown = lines.select(F.lit(UNKNOWN).alias("family"), F.when(F.col("h") % 2 == 0, mixed).otherwise(F.col("words")).alias("words"), F.lit(False).alias("complete"))
    return known.unionByName(unknown)


@dataclass(frozen=True)
class Model:
    vector: CountVectorizerModel
    families: tuple[str, ...]
    classifier: LogisticRegressionModel
    slope: float
    shift: float

    def scored(self, df: DataFrame) -> DataFrame:
        """Add ``family`` (the likeliest) and ``probability`` (calibrated, of being a notice)."""
        out = self.classifier.transform(self.vector.transform(df))
        p = vector_to_array("_p")
        known = F.slice(p, 2, len(self.families) - 1)
        best = F.array_max(known)
        names = F.array(*map(F.lit, self.families[1:]))
        margin = F.log(best + 1e-12) - F.log(F.get(p, F.lit(0)) + 1e-12)
        chance = 1 / (1 + F.exp(-(F.lit(self.slope) * margin + F.lit(self.shift))))
        family = F.element_at(names, F.array_position(known, best).cast("int"))
        return out.withColumns({"family": family, "margin": margin, "probability": chance}).drop("_v", "_p", "_raw", "_pred")


def fit(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Multinomial logistic regression with an L1 penalty over the templates' n-grams, fitted on
    whole templates and half of the other training rows, families weighing alike; the other half
    calibrates the chance that a paragraph is a notice."""
    spark = docs.sparkSession
    grams = _template_frame(spark).select(F.explode(_grams(F.col("words"))).alias("g")).distinct()
    vocabulary = sorted(r.g for r in grams.collect())  # the templates' own n-grams
    vector = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="_v").setBinary(True)
    families = (UNKNOWN, *sorted(TEMPLATES))
    label = F.array_position(F.array(*map(F.lit, families)), F.col("family")) - 1
    rows = training_rows(docs, s, id_col, text_col)
    rows = materialize(
        rows.select(label.cast("double").alias("label"), _grams(F.col("words")).alias("grams"), (F.col("complete") | (F.xxhash64("words") % 2 == 0)).alias("fits")).coalesce(4)
    )
    sizes = {r.label: r.n for r in rows.filter("fits").groupBy("label").agg(F.count("*").alias("n")).collect()}
    even = sum(sizes.values()) / len(sizes)
    weight = F.get(F.array(*[F.lit(even / sizes.get(float(i), 1)) for i in range(len(families))]), F.col("label").cast("int"))
    data = vector.transform(rows.withColumn("_w", weight))
    classifier = LogisticRegression(
        family="multinomial", featuresCol="_v", labelCol="label", probabilityCol="_p", rawPredictionCol="_raw",
        predictionCol="_pred", weightCol="_w", regParam=s.penalty, elasticNetParam=1.0, maxIter=60,
    ).fit(data.filter("fits"))
    raw = Model(vector, families, classifier, 1.0, 0.0)
    held = raw.scored(rows.filter("not fits")).select(
        (F.col("label") > 0).cast("double").alias("label"), array_to_vector(F.array("margin")).alias("_v")
    )
    both = held.groupBy("label").count().count()
    if both < 2:  # an empty corpus teaches no unknown class
        return raw
    platt = LogisticRegression(featuresCol="_v", labelCol="label", regParam=0.01, maxIter=30).fit(held)
    return Model(vector, families, classifier, float(platt.coefficients[0]), float(platt.intercept))


def scan(
    docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Licence notices: id, ``paragraph`` (line number from 0), ``family``, ``probability``,
    ``similarity`` and ``confirmed``, one row per paragraph that is likelier a notice than not.

    ``similarity`` is the largest share of the word pairs of a template of that family that the
    paragraph holds; a prediction with less than ``settings.confirm`` stays, unconfirmed. Every
    paragraph of every text is looked at, no row is shuffled and no Python runs on executors. Null
    and empty texts and empty tables give no rows; repeated rows give theirs each."""
    model = fit(docs, settings, id_col, text_col)
    lines = paragraphs(docs, id_col, text_col).withColumn("words", _words(F.col("body")))
    grams = _known_grams(F.col("words"), model.vector.vocabulary)
    # Written once each: what follows reads the n-grams, and then the scores, many times over.
    found = materialize(lines.select("key", "paragraph", grams.alias("grams")))
    found = materialize(model.scored(found).select("key", "paragraph", "grams", "family", "probability"))
    found = found.filter("probability >= 0.5")
    similarity = F.lit(0.0)
    for family, templates in TEMPLATES.items():
        for t in templates:
            words = [w.lower() for w in _plain_words(t)]
            pairs = F.array(*[F.lit(f"{a} {b}") for a, b in zip(words, words[1:])])
            share = F.size(F.array_intersect("grams", pairs)) / F.size(F.array_distinct(pairs))
            similarity = F.greatest(similarity, F.when(F.col("family") == family, share).otherwise(0.0))
    out = found.select(
        F.col("key").alias(id_col), "paragraph", "family", "probability", similarity.alias("similarity")
    )
    return out.withColumn("confirmed", F.col("similarity") >= settings.confirm)


def _plain_words(template: str) -> list[str]:
    """The words of a template, as ``_words`` finds them in a text."""
    import regex

    return regex.findall(WORD, template)
