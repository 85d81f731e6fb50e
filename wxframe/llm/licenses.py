"""Licence scan with a trained paragraph classifier, in DataFrame operations and Spark's own ML only.

Word one- and two-grams of a paragraph are hashed into a sparse binary vector; a multinomial
logistic regression names a licence family or ``unknown``.  It is trained on the templates below,
cut and thinned in many ways, against paragraphs of the corpus.  On held-out rows the margin between
the best family and ``unknown`` is calibrated, and paragraphs below a probability of one half are
unknown.  A family that remains is confirmed if the paragraph holds words that tell it from all others, or most of a
template's word pairs.  Every paragraph is scored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, forget

UNKNOWN = "unknown"

# fixed values: customary licence notices by family
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "This project is distributed under the Apache 2.0 license."],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "Released under the GNU GPL version 2 or later.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL": [
        "This library is licensed under the GNU Lesser General Public License.",
        "Released under the GNU LGPL version 2.1 or later."],
    "AGPL": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "Released under the GNU AGPL version 3."],
    "BSD": [
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met."],
    "MPL-2.0": [
        "Licensed under the Mozilla Public License, version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "ISC": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "CC-BY": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": [
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0": [
        "Released under CC0 1.0.",
        "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Released under the Unlicense."],
    "proprietary": [
        "All rights reserved.",
        "Copyright, all rights reserved. No part of this publication may be reproduced without prior written permission."],
}
# further wordings and SPDX names, with which the classifier is trained as well
WORDINGS = {
    "MIT": ["The MIT License (MIT)", "MIT License", "SPDX-License-Identifier: MIT", "Available under the MIT licence.", "This code is MIT licensed."],
    "Apache-2.0": ["Apache-2.0", "Apache License 2.0", "SPDX-License-Identifier: Apache-2.0", "Available under the Apache License 2.0.",
                   "Apache License, Version 2.0, January 2004", "Apache licensed, see the file LICENSE."],
    "GPL": ["GPL-3.0-or-later", "GPL-2.0-only", "SPDX-License-Identifier: GPL-3.0", "GNU General Public License v3", "GPLv3", "GPLv2 or later",
            "Available under the GPL, version 3.", "Distributed under the terms of the GNU GPL."],
    "LGPL": ["LGPL-2.1-or-later", "LGPL-3.0", "SPDX-License-Identifier: LGPL-2.1", "GNU Lesser General Public License v3", "LGPLv3",
             "Distributed under the terms of the LGPL."],
    "AGPL": ["AGPL-3.0-or-later", "AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0", "GNU Affero General Public License v3", "AGPLv3",
             "Distributed under the terms of the AGPL."],
    "BSD": ["BSD-3-Clause", "BSD-2-Clause", "SPDX-License-Identifier: BSD-3-Clause", "The 3-Clause BSD License", "New BSD License",
            "Available under a BSD-style license."],
    "MPL-2.0": ["MPL-2.0", "SPDX-License-Identifier: MPL-2.0", "Mozilla Public License 2.0", "Available under the MPL 2.0."],
    "ISC": ["ISC License", "SPDX-License-Identifier: ISC", "Available under the ISC licence."],
    "CC-BY": ["CC-BY-4.0", "CC BY 3.0", "Creative Commons Attribution 4.0 International", "Creative Commons Attribution License",
              "Available under the Creative Commons Attribution licence.", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA": ["CC-BY-SA-4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0 International",
                 "Text is available under the Creative Commons Attribution-ShareAlike License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC-BY-NC": ["CC-BY-NC-4.0", "CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial 4.0 International",
                 "Available under the Creative Commons Attribution-NonCommercial licence.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "CC0": ["CC0-1.0", "CC0", "Creative Commons Zero", "SPDX-License-Identifier: CC0-1.0", "Dedicated to the public domain under CC0."],
    "Unlicense": ["The Unlicense", "SPDX-License-Identifier: Unlicense", "Dedicated to the public domain with the Unlicense."],
    "proprietary": ["All rights are reserved.", "Proprietary and confidential.", "Unauthorized copying of this file is strictly prohibited."],
}
# words in a row that tell a family from all others: either confirms it
MARKS = {
    "MIT": ["mit license", "mit licence", "mit licensed", "identifier mit"],
    "Apache-2.0": ["apache license", "apache licence", "apache licensed", "apache 2 0", "apache version 2"],
    "GPL": ["gnu general public", "gnu gpl", "the gpl", "gpl version", "gpl 2", "gpl 3", "gplv2", "gplv3", "gpl license", "gpl v2", "gpl v3"],
    "LGPL": ["lesser general public", "library general public", "lgpl", "lgplv2", "lgplv3"],
    "AGPL": ["affero general public", "agpl", "agplv3"],
    "BSD": ["bsd license", "bsd licence", "bsd licensed", "bsd style", "bsd 2", "bsd 3", "clause bsd"],
    "MPL-2.0": ["mozilla public", "mpl 2", "mpl 2 0", "mpl version"],
    "ISC": ["isc license", "isc licence", "isc licensed", "identifier isc"],
    "CC-BY": ["cc by", "commons attribution"],
    "CC-BY-SA": ["by sa", "attribution sharealike", "attribution share alike"],
    "CC-BY-NC": ["by nc", "attribution noncommercial", "attribution non commercial"],
    "CC0": ["cc0", "commons zero"],
    "Unlicense": ["the unlicense", "identifier unlicense"],
    "proprietary": ["all rights reserved", "all rights are reserved", "proprietary and confidential", "unauthorized copying"],
}
# paragraphs that speak of licences without granting one
OTHER = [
    "You need a driving license to rent a car.", "The licence fee was raised again this year.",
    "The city released a license plate register.", "Her rights were violated by the new law.", "Human rights must be respected by all.",
    "He asked for permission to leave the room.", "A version of this story was released under another title.",
    "The software comes with a warranty of two years.", "Tables can be reserved by phone until noon.",
    "All of the free seats were reserved for members of the public.",
    "Students of MIT built a robot.", "The Apache people live in the south.", "The apache helicopter has two engines.",
    "The creative team met in the commons of the college.", "Version 2.0 of the game is out.", "The attribution of the painting is doubtful."]
# a paragraph with one of these speaks of rights and is counted; every template has one
ANCHORS = ["licen[cs]e", "licensed", "unlicense", "rights", "permission", "permitted", "public domain", "[al]?gpl", "cc0"]


@dataclass(frozen=True)
class Settings:
    features: int = 1 << 15
    sample_docs: int = 400        # documents whose paragraphs serve as examples of unknown
    negatives: int = 2000         # at most so many of them
    held_out: int = 4             # one training row in so many is for calibration
    similarity: float = 0.7       # share of a template's word pairs that confirms its family
    steps: int = 60


def words(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def pairs(w: Column) -> Column:
    """Distinct neighbouring word pairs; the word itself if there is one only."""
    n = F.size(w)
    two = F.zip_with(F.slice(w, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(w, F.lit(2), F.greatest(n - 1, F.lit(0))),
                     lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.when(n == 1, w).otherwise(two))


def paragraphs(text: Column) -> Column:
    """Pieces between blank lines, and after lines that end a sentence (a wrapped line goes on)."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\n[ \t\r]*\n|(?<=[.!?:;])[ \t\r]*\n"), lambda p: F.trim(p) != "")


def anchored(text: Column) -> Column:
    return text.rlike(r"(?i)\b(?:" + "|".join(ANCHORS) + ")")


def _table(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """(family, w) of fixed texts."""
    given = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(t).alias("text")) for f, t in rows])
    return spark.range(1).select(F.inline(given)).select("family", words(F.col("text")).alias("w"))


def _thinned(rows: DataFrame) -> DataFrame:
    """Each text whole, and eleven times with about one word in eight left out."""
    many = rows.select("family", "w", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("k"))
    return many.select("family", F.filter("w", lambda x, i: (F.col("k") == 0) | (
        F.pmod(F.xxhash64(x, i, "k"), F.lit(8)) != 0)).alias("w"))


def _training(spark: SparkSession, docs: DataFrame, s: Settings, id_col: str, text_col: str) -> DataFrame:
    """(family, w) rows: templates, each with words left out and within other words, and paragraphs of the corpus."""
    chosen = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")) \
        .orderBy(F.xxhash64("id", "text")).limit(s.sample_docs)
    plain = chosen.select(F.explode(paragraphs(F.col("text"))).alias("p")).where(~anchored(F.col("p"))) \
        .select(F.slice(words(F.col("p")), 1, 60).alias("w")).where(F.size("w") > 2).distinct().orderBy(F.xxhash64("w")).limit(s.negatives)
    thin = _thinned(_table(spark, [(f, t) for part in (TEMPLATES, WORDINGS) for f, ts in part.items() for t in ts]))
    fill = F.array(*[F.lit(x) for x in "the report was about new plans of a small town and its people".split()])
    around = thin.select("family", F.concat(fill, "w", F.reverse(fill)).alias("w"))
    hard = _thinned(_table(spark, [(UNKNOWN, t) for t in OTHER]))
    anchor = F.array(*[F.lit(x) for x in ("license", "licensed", "rights", "permission", "permitted", "public", "released", "under", "version")])
    pick = F.pmod(F.xxhash64("w"), F.lit(9)).cast("int")
    mixed = plain.select(F.lit(UNKNOWN).alias("family"), F.concat(F.slice("w", 1, 5), F.array(F.get(anchor, pick)), F.slice("w", 6, 60)).alias("w"))
    return thin.union(around).union(hard).union(mixed).union(plain.select(F.lit(UNKNOWN), "w"))


def _vector(df: DataFrame, s: Settings) -> DataFrame:
    grams = df.withColumn("grams", F.concat(F.array_distinct("w"), F.when(F.size("w") > 1, pairs(F.col("w"))).otherwise(F.array())))
    return HashingTF(numFeatures=s.features, binary=True, inputCol="grams", outputCol="features").transform(grams)


@dataclass
class Model:
    families: list[str]
    classifier: LogisticRegressionModel
    slope: float
    offset: float
    settings: Settings


def _margin(raw: Column, families: list[str]) -> tuple[Column, Column]:
    """(best family, its score above that of ``unknown``)."""
    score = vector_to_array(raw)
    known = F.slice(score, 2, len(families) - 1)
    best = F.array_max(known)
    name = F.get(F.array(*[F.lit(f) for f in families[1:]]), (F.array_position(known, best) - 1).cast("int"))
    return name, best - F.get(score, F.lit(0))


def train(spark: SparkSession, docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit the classifier and its calibration. ``docs`` only give examples of unknown; it may be empty."""
    s, families = settings, [UNKNOWN, *TEMPLATES]
    # a few thousand short rows, bounded by the settings: one reliable copy in one partition, so a step of the fit is one task
    # and shuffles no gradients (features x families doubles from each task otherwise)
    rows = _vector(checkpoint(_training(spark, docs, s, id_col, text_col).repartition(1)), s)
    label = F.array_position(F.array(*[F.lit(f) for f in families]), F.col("family")) - 1
    rows = rows.select("family", label.cast("double").alias("label"), "features",
                       (F.pmod(F.xxhash64("w", "family"), F.lit(s.held_out)) == 0).alias("hold")).cache()
    fit = LogisticRegression(family="multinomial", regParam=0.002, maxIter=s.steps, standardization=False)
    model = fit.fit(rows.where("not hold"))
    forget(spark)      # the fit's vectors, as large as a gradient, made the driver's heap grow: it shrinks before documents are scanned
    name, margin = _margin(F.col("rawPrediction"), families)
    held = model.transform(rows.where("hold").select("family", "features")) \
        .select(margin.alias("m"), (name == F.col("family")).cast("double").alias("label"))
    one = VectorAssembler(inputCols=["m"], outputCol="features").transform(held)
    platt = LogisticRegression(regParam=0.001, maxIter=50).fit(one.select("features", "label"))
    rows.unpersist()
    return Model(families, model, float(platt.coefficients[0]), float(platt.intercept), s)


def scan(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per paragraph: id, paragraph (number from 0), text, family (``unknown`` below one half), probability,
    similarity (best share of a template's pairs; null for ``unknown``), confirmed.

    Null and empty texts have no paragraphs.  Repeated rows give repeated paragraphs.  Other columns are not read.
    """
    s = model.settings
    cut = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    units = cut.select("id", F.posexplode(paragraphs(F.col("text"))).alias("paragraph", "text"))
    scored = model.classifier.transform(_vector(units.withColumn("w", words(F.col("text"))), s))
    name, margin = _margin(F.col("rawPrediction"), model.families)
    p = 1 / (1 + F.exp(-(model.slope * margin + model.offset)))
    named = scored.select("id", "paragraph", "text", "w", name.alias("best"), p.alias("probability"))
    known = F.col("probability") >= 0.5
    each = lambda t: F.size(F.array_intersect(pairs(F.col("w")), t)) / F.size(t)
    wanted = F.create_map(*[c for f, ts in TEMPLATES.items() for c in (
        F.lit(f), F.array(*[F.array(*[F.lit(x) for x in _pairs_of(t)]) for t in ts]))])
    similarity = F.when(known, F.array_max(F.transform(F.element_at(wanted, F.col("best")), each)))
    told = F.element_at(F.create_map(*[c for f, ms in MARKS.items() for c in (F.lit(f), F.array(*[F.lit(f" {m} ") for m in ms]))]), F.col("best"))
    line = F.concat(F.lit(" "), F.array_join("w", " "), F.lit(" "))
    marked = F.when(known, F.exists(told, lambda m: F.contains(line, m))).otherwise(False)
    return named.withColumn("similarity", similarity).select(
        "id", "paragraph", "text", F.when(known, F.col("best")).otherwise(UNKNOWN).alias("family"), "probability", "similarity",
        (known & (marked | (F.col("similarity") >= s.similarity))).alias("confirmed")).withColumnRenamed("id", id_col)


def _pairs_of(text: str) -> list[str]:
    """The pairs of a template, as :func:`pairs` makes them."""
    w = re.sub("[^a-z0-9]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))) or w


def families(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_paragraphs (that speak of rights or are confirmed), families (confirmed, sorted). Rows of one id share
    what is found in any of them."""
    # counted, not filtered: a filter would be pushed below the scan's columns and work each of them out again
    told = scan(docs, model, id_col, text_col).select(
        F.col(id_col).alias("found_id"), (F.col("confirmed") | anchored(F.col("text"))).alias("counts"),
        F.when(F.col("confirmed"), F.col("family")).alias("family"))
    found = told.groupBy("found_id").agg(F.count_if("counts").alias("n"), F.array_sort(F.collect_set("family")).alias("families"))
    rows = docs.select(F.col(id_col))
    return rows.join(found, F.col(id_col).eqNullSafe(F.col("found_id")), "left").select(
        id_col, F.coalesce("n", F.lit(0)).cast("long").alias("n_paragraphs"),
        F.coalesce("families", F.array().cast("array<string>")).alias("families"))
