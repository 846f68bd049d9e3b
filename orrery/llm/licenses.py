"""License scans by a trained paragraph classifier, in DataFrame operations throughout.

A line that holds a cue (a word that licenses use) starts candidates: the line, and where it is short enough to be one
of a wrapped text (``WRAPPED`` characters) also the paragraphs of two, four and eight lines from it or from the line
before it, joined, without comment marks. A candidate's words and word pairs go through a sparse multinomial logistic
regression over licence families and an unknown class. Its probabilities are calibrated by a logistic curve fitted to
held-out paragraphs of both kinds, and a family must be more probable than not, and more than all but a set share of
held-out unknown ones are. A family so found is confirmed if the paragraph holds enough of the word pairs of one of its templates
(``CONFIRM`` of them, ``EXACT`` of those of a short one, which others resemble by chance) and doesn't deny it (``DENIED``).

The model is fitted on the templates below, varied by lost and added words, and on unknown lines: made-up
ones that use the cues otherwise, and the last lines, ``CHARS`` characters of each and ``NOISE`` words of all, of at
most ``SAMPLE`` documents, the first by a hash of their id. Every line of every whole text is searched for cues; a
notice none of whose lines holds a cue isn't found.

Defined cases: null and empty texts have no licence; a document with several licences gets the confirmed
one that is closest to its template, ties by probability, then name, and lists them all; candidates that no template confirms give ``unknown``;
rows that share an id, and rows without one, get what their own texts hold; repeated rows give one row each; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, NGram, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UNKNOWN, SAMPLE, CHARS, NOISE, CONFIRM, WRAPPED = "unknown", 300, 400, 5000, 0.6, 120
#: A template of at most BRIEF word pairs is confirmed by this share of them. Word pairs that deny a licence.
BRIEF, EXACT = 10, 0.85
DENIED = ("not released", "not licensed", "not available", "never released", "never licensed", "not distributed", "no longer")
#: Phrases of public licences and of their usual notices.
TEMPLATES = {
    "Apache-2.0": ("Apache License Version 2.0, January 2004", "Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0"),
    "BSD": ("BSD 3-Clause License", "BSD 2-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "Released under the BSD License.", "SPDX-License-Identifier: BSD-3-Clause"),
    "AGPL-3.0": ("GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only"),
    "CC-BY": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"),
    "CC-BY-NC": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    "CC-BY-SA": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    "CC0": ("This work is dedicated to the public domain under CC0 1.0 Universal.", "SPDX-License-Identifier: CC0-1.0"),
    "GPL-2.0": ("GNU GENERAL PUBLIC LICENSE Version 2, June 1991", "This work is licensed under the GNU General Public License, version 2.", "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "SPDX-License-Identifier: GPL-2.0-only"),
    "GPL-3.0": ("GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "This work is licensed under the GNU General Public License, version 3.", "you can redistribute it and/or modify it under the terms of the GNU General Public License version 3 as published by the Free Software Foundation", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "SPDX-License-Identifier: ISC"),
    "LGPL": ("GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007", "Licensed under the GNU Lesser General Public License, version 2.1 or later.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    "MIT": ("The MIT License (MIT)", "Licensed under the MIT License.", "Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "SPDX-License-Identifier: MIT"),
    "MPL-2.0": ("Mozilla Public License Version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", "SPDX-License-Identifier: Unlicense"),
    "proprietary": ("Copyright. All rights reserved.", "All rights reserved. No part of this publication may be reproduced without the prior written permission of the publisher."),
}
#: Words that make a line a candidate, and lines that use them otherwise.
CUES = ("licen", "copyright", "permission", "redistribut", "public domain", "creative commons", "all rights reserved", "cc by", "cc0", "gnu ", "is free to copy")
OTHERWISE = (
    "You need a driving licence to rent the car.", "The licence plate was stolen last night.", "He lost his fishing license in the river.", "A licensed physician must sign the form.",
    "The restaurant got its liquor license last year.", "They asked for permission to leave the room.", "The house was licensed for weddings under a new law.", "Version 2.0 of the report was released under pressure.",
    "The public domain of the square is open at night.", "Copyright law was debated in parliament for years.", "The bank redistributed the profits among its members.", "The general public was not allowed in, the council said.",
)


def _has_cue(text: Column) -> Column:
    low = F.lower(text)
    out = low.contains(CUES[0])
    for c in CUES[1:]:
        out |= low.contains(c)
    return out


def candidates(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, at, n_lines, paragraph): lines with a cue, and the paragraphs about them where they are lines of wrapped text."""
    docs = df.where(_has_cue(F.col(text))).select(key, F.split(text, "\n", -1).alias("lines"))
    places = F.filter(F.transform("lines", lambda x, i: F.when(_has_cue(x), i)), lambda i: i.isNotNull())
    bare = lambda x: F.regexp_replace(x, r"^[\s#*/;>-]*", "")

    def unit(i: Column, before: int, n: int) -> Column:
        joined = F.array_join(F.transform(F.slice("lines", F.greatest(i + 1 - before, F.lit(1)), F.lit(n)), bare), " ") if n > 1 else F.get("lines", i)
        return F.struct(i.alias("at"), F.lit(n).alias("n_lines"), joined.alias("paragraph"))

    several = ((0, 2), (0, 4), (0, 8), (1, 4), (1, 8))
    units = lambda i: F.concat(F.array(unit(i, 0, 1)), F.when(F.length(F.get("lines", i)) <= WRAPPED, F.array(*(unit(i, b, n) for b, n in several))).otherwise(F.array().cast("array<struct<at:int,n_lines:int,paragraph:string>>")))
    return docs.withColumn("u", F.explode(F.flatten(F.transform(places, units)))).select(key, "u.*")


def _tokenized() -> list:
    """Lower-case words and numbers, with their pairs; words are kept whole at dots and hyphens (2.0, by-nc)."""
    words = RegexTokenizer(inputCol="paragraph", outputCol="words", pattern=r"[^\p{L}\p{N}.\-]+|[.\-]+(?=\s|$)", toLowercase=True)
    pairs = NGram(n=2, inputCol="words", outputCol="pairs")
    both = SQLTransformer(statement="SELECT *, concat(words, pairs) AS grams FROM __THIS__")
    return [words, pairs, both]


def _varied(words: list[str], seed: int = 1) -> list[tuple[str, str]]:
    """(paragraph, family) for training."""
    r = random.Random(seed)
    noise = lambda n: [r.choice(words) for _ in range(n)]
    out = []
    for family, texts in TEMPLATES.items():
        for text in texts:
            own = text.split()
            out.append((text, family))
            for k in range(10):
                kept = [w for w in own if r.random() > (0.08 if len(own) > 8 else 0)]
                some = 20 if k > 6 else 6  # a paragraph of several lines holds more besides
                out.append((" ".join(noise(r.randint(0, some) if k % 2 else 0) + kept + noise(r.randint(0, some) if k % 3 else 0)), family))
    for text in OTHERWISE:
        for _ in range(6):
            out.append((" ".join(noise(r.randint(0, 5)) + text.split() + noise(r.randint(0, 5))), UNKNOWN))
    # cue words alone, among others
    loose = sorted({w for texts in TEMPLATES.values() for t in texts for w in t.split()})
    for _ in range(200):
        mixed = noise(r.randint(4, 12)) + r.sample(loose, r.randint(1, 3))
        r.shuffle(mixed)
        out.append((" ".join(mixed), UNKNOWN))
    return out


@dataclass
class Model:
    pipeline: PipelineModel
    families: list[str]
    threshold: float
    slope: float = 1.0
    offset: float = 0.0


def train(documents: DataFrame, key: str = "doc_id", text: str = "text", sample: int = SAMPLE, false_rate: float = 0.01) -> Model:
    """The classifier and its calibrated threshold."""
    spark: SparkSession = documents.sparkSession
    some = documents.select(F.split_part(text, F.lit("\n"), F.lit(-1)).alias("line"), F.xxhash64(key).alias("h"), F.xxhash64(text).alias("t"))
    lines = [r[0][:CHARS] for r in some.orderBy("h", "t").limit(sample).collect() if r[0] and not any(c in r[0].lower() for c in CUES)]
    words = [w for x in lines for w in x.split()][:NOISE] or ["some", "other", "words"]
    rows = _varied(words) + [(x, UNKNOWN) for x in lines[::2]]
    families = sorted({f for _, f in rows})
    labelled = spark.createDataFrame([(p, float(families.index(f))) for p, f in rows], "paragraph string, label double").repartition(1).cache()
    stages, now = _tokenized(), labelled
    for stage in stages:
        now = stage.transform(now)
    vectors = CountVectorizer(inputCol="grams", outputCol="features", minDF=2.0, binary=True).fit(now)
    fitted = LogisticRegression(maxIter=40, regParam=0.002, elasticNetParam=0.0, family="multinomial").fit(vectors.transform(now))
    labelled.unpersist()
    model = Model(PipelineModel([*stages, vectors, fitted]), families, 0.5)
    # lines that training didn't see, with stray licence words set in
    r = random.Random(2)
    loose = sorted({w for texts in TEMPLATES.values() for t in texts for w in t.split()})
    unseen = [" ".join(x.split()[:12] + r.sample(loose, 2)) for x in lines[1::2]] + [" ".join(r.sample(words, min(6, len(words))) + t.split()) for t in OTHERWISE]
    held = [(u, UNKNOWN) for u in unseen] + [v for v in _varied(words, seed=3) if v[1] != UNKNOWN]
    own = spark.createDataFrame(held, "paragraph string, truth string")
    rows = _scored(own, model).select("paragraph", "family", "probability").join(own.dropDuplicates(["paragraph"]), "paragraph").select("truth", "family", "probability").collect()
    logit = lambda p: math.log(max(p, 1e-9) / max(1 - p, 1e-9))
    right = [(float(r["truth"] == r["family"]), Vectors.dense(logit(r["probability"]))) for r in rows]
    if len({y for y, _ in right}) == 2:
        curve = LogisticRegression(maxIter=50).fit(spark.createDataFrame(right, ["label", "features"]))
        model.slope, model.offset = float(curve.coefficients[0]), float(curve.intercept)
    calibrated = lambda p: 1 / (1 + math.exp(-model.slope * logit(p) - model.offset))
    wrong = sorted((calibrated(r["probability"]) for r in rows if r["truth"] == UNKNOWN), reverse=True)
    model.threshold = max(0.5, wrong[int(len(wrong) * false_rate)] + 1e-6) if wrong else 0.5
    return model


def _scored(paragraphs: DataFrame, model: Model) -> DataFrame:
    """paragraphs with the most probable family and its probability."""
    out = model.pipeline.transform(paragraphs.drop("probability", "rawPrediction", "prediction"))
    p = vector_to_array("probability")
    known = F.array(*(F.struct(p[k].alias("p"), F.lit(f).alias("family")) for k, f in enumerate(model.families) if f != UNKNOWN))
    best = F.array_max(known)
    q = F.greatest(F.least(F.col("best.p"), F.lit(1 - 1e-9)), F.lit(1e-9))
    p = F.when(F.lit(model.slope == 1 and model.offset == 0), q).otherwise(1 / (1 + F.exp(-model.slope * F.log(q / (1 - q)) - model.offset)))
    return out.withColumn("best", best).select(*paragraphs.columns, "pairs", "words", F.col("best.family").alias("family"), p.alias("probability"))


def find(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, at, n_lines, paragraph, family, probability, similarity, confirmed) for each candidate."""
    spark = df.sparkSession
    known = spark.createDataFrame([(f, t) for f, ts in TEMPLATES.items() for t in ts], "family string, paragraph string")
    for stage in _tokenized():
        known = stage.transform(known)
    grams = lambda: F.array_distinct(F.when(F.size("pairs") > 0, F.col("pairs")).otherwise(F.col("words")))
    templates = known.select("family", grams().alias("t")).groupBy("family").agg(F.collect_list("t").alias("templates"))
    scored = _scored(candidates(df, key, text), model).withColumn("own", grams())
    found = scored.join(F.broadcast(templates), "family")  # as many rows as there are families
    each = F.transform("templates", lambda t: F.struct((F.size(F.array_intersect(t, F.col("own"))) / F.size(t)).alias("share"), F.when(F.size(t) <= BRIEF, EXACT).otherwise(CONFIRM).alias("least")))
    found = found.withColumn("shares", each).withColumn("similarity", F.array_max("shares.share"))
    fits = F.exists("shares", lambda s: s["share"] >= s["least"]) & ~F.arrays_overlap("pairs", F.array(*map(F.lit, DENIED)))
    return found.select(key, "at", "n_lines", "paragraph", "family", "probability", "similarity", ((F.col("probability") >= model.threshold) & fits).alias("confirmed"))


def scan(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, license, probability, similarity, licenses, n_candidates) for each row; license is null where no line has a cue."""
    digest = "text digest"  # what a text holds depends on nothing else, so rows find it by this, whatever their ids
    found = find(df.select(F.md5(text).alias(digest), F.col(text)), model, digest, text)
    sure = F.when(F.col("confirmed"), F.struct(F.col("similarity").alias("s"), F.col("probability").alias("p"), F.col("family").alias("family")))
    by = found.groupBy(digest).agg(F.max(sure).alias("best"), F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))).alias("licenses"), F.count_distinct(F.when(F.col("n_lines") == 1, F.col("at"))).alias("n_candidates"))
    out = df.select(key, F.md5(text).alias(digest)).join(by, digest, "left")
    license = F.when(F.col("best").isNotNull(), F.col("best.family")).when(F.col("n_candidates") > 0, F.lit(UNKNOWN))
    return out.select(key, license.alias("license"), F.col("best.p").alias("probability"), F.col("best.s").alias("similarity"), F.coalesce("licenses", F.array().cast("array<string>")).alias("licenses"), F.coalesce("n_candidates", F.lit(0)).cast("long").alias("n_candidates"))
