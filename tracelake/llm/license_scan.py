"""Licence scans: which paragraphs of whole documents state a licence, and of which family.

Method, in DataFrame functions and Spark's own logistic regression (no Python runs on executors): each line is scored
alone, and so is each paragraph: a run of lines that all hold words of the templates, with the word pairs that cross
line ends, since notices are often wrapped. Comment marks are no words, so they neither part nor hide a notice; a line
without words parts paragraphs. Features are word bigrams and trigrams, of which only those of the known templates
carry weight, so the classifier is sparse. Templates are notices, titles and SPDX identifiers. It is trained on variants
of the templates (words left out of those of over three words, text of the corpus around them) against lines of the corpus without a cue, at most NEGATIVES of them, chosen by hash of the text
whatever the input's size, and against lines that have a cue but state no licence. Notices of further licences are
trained as the class "unknown", so a licence of no known family is still reported. A temperature fitted on variants held
out of training calibrates the probabilities; what is likely a licence but whose family's calibrated probability is
under MIN_PROBABILITY, or whose words do not hold enough of any template of the family, is "unknown" too. Every line of
every document is scored.

In the scan, each word position is looked up once by its bigram; only where that is one of the templates' are more
columns made, so the work after the lookup follows the number of matches and not of words.
"""

from __future__ import annotations

import json

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracelake.llm.common import stored

# Notices of public licences.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "Licensed under the MIT license. See LICENSE file in the project root for license information."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("LGPL", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL", "Licensed under the GNU Affero General Public License, version 3."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA", "Text is available under the Creative Commons Attribution-ShareAlike License"),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal Public Domain Dedication"),
    ("All-rights-reserved", "All rights reserved."),
    ("All-rights-reserved", "Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission"),
]

# Titles of the families' texts.
TITLES = [
    ("MIT", "MIT License"), ("MIT", "The MIT License"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004"), ("Apache-2.0", "Apache License 2.0"),
    ("GPL", "GNU General Public License Version 2, June 1991"), ("GPL", "GNU General Public License Version 3, 29 June 2007"),
    ("LGPL", "GNU Lesser General Public License Version 2.1, February 1999"), ("LGPL", "GNU Lesser General Public License Version 3, 29 June 2007"),
    ("AGPL", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("BSD", "BSD 2-Clause License"), ("BSD", "BSD 3-Clause License"), ("BSD", "Licensed under the BSD license."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC-BY", "Creative Commons Attribution 4.0 International"), ("CC-BY-SA", "Creative Commons Attribution-ShareAlike 4.0 International"),
    ("CC-BY-NC", "Creative Commons Attribution-NonCommercial 4.0 International"), ("CC0", "CC0 1.0 Universal"),
]

# SPDX identifiers of each family, and of some of no family.
SPDX = {
    "MIT": ["MIT"], "Apache-2.0": ["Apache-2.0"], "GPL": ["GPL-2.0", "GPL-3.0", "GPL-2.0-or-later", "GPL-3.0-only"], "LGPL": ["LGPL-2.1", "LGPL-3.0"], "AGPL": ["AGPL-3.0"],
    "BSD": ["BSD-2-Clause", "BSD-3-Clause"], "MPL-2.0": ["MPL-2.0"], "CC-BY": ["CC-BY-4.0"], "CC-BY-SA": ["CC-BY-SA-4.0"], "CC-BY-NC": ["CC-BY-NC-4.0"], "CC0": ["CC0-1.0"],
    "unknown": ["ISC", "Zlib", "EPL-2.0", "BSL-1.0", "Unlicense", "OFL-1.1"],
}

NONE, UNKNOWN = "none", "unknown"

# Notices of public licences outside the families above, trained as the unknown class.
OTHERS = [
    "Licensed under the ISC License.",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0",
    "This is free and unencumbered software released into the public domain.",
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
    "Distributed under the Boost Software License, Version 1.0.",
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "Licensed under the European Union Public Licence, version 1.2.",
    "Licensed under the Artistic License 2.0.",
    "This file is licensed under the terms of a licence that accompanies it.",
    "zlib License",
    "Common Development and Distribution License (CDDL) Version 1.0",
    "Microsoft Public License (Ms-PL)",
    "Eclipse Public License version 1.0",
    "Licensed under the Open Software License 3.0.",
]

#: Lines with a cue that state no licence.
CUES = [
    "The driver was asked for a license and the papers of the car.",
    "Anyone may obtain a copy of the report from the office, free of charge.",
    "The club lost its license to serve drinks under the new law of the town.",
    "No part of this journey was without trouble, and all rights were argued over.",
    "Public interest in the general election is high, and the public is asked to vote.",
    "The foundation was published by the free press in this work of the last year.",
    "Use of this road is governed by the law of the land.",
    "A license fee is due to the extent of the use of the hall.",
    "The source of the river is in the hills and the form of the valley is subject to the rain.",
    "Under these conditions the following steps are met with or without help.",
    "The library is free to all; you can read it in any room.",
    "The authors have waived the fee and the creative commons room is open.",
    "A driving license of version 2 was issued on 29 June 2007.",
    "Version 2 of the plan was ready in June 1991, or later.",
    "The general public was asked in January 2004 to license the hall.",
    "An identifier is set for each license plate of the town.",
    "The public license office of the town is open, and its 3 rooms are free.",
    "The clause of the contract and its 2 versions are old.",
]

FAMILIES = [NONE, *sorted({f for f, _ in TEMPLATES}), UNKNOWN]
NEGATIVES = 1500
VARIANTS = 24
MIN_PROBABILITY = 0.6
MIN_SIMILARITY = 0.5
WORDS = r"[\p{L}\p{N}]+(?:\.[0-9]+)*"


def _words(text):
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORDS), F.lit(0))


def _grams(words: str):
    """Distinct bigrams and trigrams of an array of words, as text."""
    n = F.size(words)
    part = lambda at, less: F.slice(words, F.lit(at), F.greatest(n - less, F.lit(0)))
    two = F.transform(F.arrays_zip(part(1, 1).alias("a"), part(2, 1).alias("b")), lambda w: F.concat_ws(" ", w["a"], w["b"]))
    three = F.transform(F.arrays_zip(part(1, 2).alias("a"), part(2, 2).alias("b"), part(3, 2).alias("c")), lambda w: F.concat_ws(" ", w["a"], w["b"], w["c"]))
    return F.array_distinct(F.concat(two, three))


def _local(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table of fixed rows, as one literal."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def templates(spark: SparkSession) -> DataFrame:
    """(id, family, label, words, grams) of the known templates."""
    known = TEMPLATES + TITLES + [(f, f"SPDX-License-Identifier: {i}") for f, ids in SPDX.items() for i in ids] + [(UNKNOWN, t) for t in OTHERS]
    rows = [{"id": i, "family": f, "label": FAMILIES.index(f), "text": t} for i, (f, t) in enumerate(known)]
    df = _local(spark, rows, "id:int,family:string,label:double,text:string").withColumn("words", _words(F.col("text")))
    return df.withColumn("grams", _grams("words")).drop("text")


def _lines(docs: DataFrame) -> DataFrame:
    """(row, doc_id, line, text, next): the lines of docs, counted from 0, each with the line that follows. row tells rows of docs apart."""
    docs = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.split("text", "\n").alias("all"))
    both = F.arrays_zip(F.col("all").alias("text"), F.slice("all", F.lit(2), F.size("all")).alias("next"))
    return docs.select("row", "doc_id", F.posexplode(both).alias("line", "both")).select("row", "doc_id", "line", "both.text", "both.next")


def _examples(docs: DataFrame, known: DataFrame) -> DataFrame:
    """(label, grams, part): variants of the templates and paragraphs of the corpus; part 0 trains, part 1 calibrates."""
    cue = r"(?i)licen[cs]e|rights reserved|creative commons|\bcc by"
    lines = _lines(docs).where((F.length("text") > 0) & ~F.col("text").rlike(cue)).select("text")
    some = lines.orderBy(F.xxhash64("text"), "text").limit(NEGATIVES)
    some = stored(some.select(_words(F.col("text")).alias("around"), F.monotonically_increasing_id().alias("at")))
    number = max(1, some.count())
    v = F.col("variant")
    left = F.filter("words", lambda w, i: (v % 3 == 0) | (F.size("words") <= 3) | (F.pmod(F.xxhash64(v, i, F.col("id")), F.lit(10)) > 0))
    variants = known.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1)))).withColumn("left", left)
    variants = variants.withColumn("at", F.pmod(F.xxhash64("id", "variant"), F.lit(number)))
    around = F.coalesce("around", F.array().cast("array<string>"))
    words = F.when(v % 2 == 0, F.col("left")).otherwise(F.concat(F.slice(around, 1, 12), "left"))
    good = variants.join(some, "at", "left").select("label", words.alias("words"), (F.floor(v / 2) % 3 == 2).cast("int").alias("part"))
    bad = some.select(F.lit(0.0).alias("label"), F.col("around").alias("words"), (F.col("at") % 3 == 2).cast("int").alias("part"))
    cues = _local(docs.sparkSession, [{"id": i, "text": t} for i, t in enumerate(CUES)], "id:int,text:string").withColumn("words", _words(F.col("text")))
    cues = cues.withColumn("variant", F.explode(F.sequence(F.lit(0), F.lit(VARIANTS - 1)))).withColumn("words", left)
    cues = cues.select(F.lit(0.0).alias("label"), "words", (F.floor(v / 2) % 3 == 2).cast("int").alias("part"))
    return good.union(bad).union(cues).select("label", "part", _grams("words").alias("grams"))


def fit(docs: DataFrame) -> tuple[list[str], list[list[float]], list[float]]:
    """Vocabulary, and per family the calibrated weights and intercept."""
    spark = docs.sparkSession
    known = stored(templates(spark))
    vocabulary = [r["gram"] for r in known.select(F.explode("grams").alias("gram")).distinct().orderBy("gram").collect()]
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features").setBinary(True)
    rows = stored(vectors.transform(_examples(docs, known)).select("label", "part", "grams", "features"))
    model = LogisticRegression(family="multinomial", maxIter=60, regParam=0.002, elasticNetParam=0.2).fit(rows.where("part = 0").select("label", "features"))
    weights = model.coefficientMatrix.toArray().tolist()
    intercepts = model.interceptVector.toArray().tolist()
    missing = len(FAMILIES) - len(weights)  # without any paragraph the corpus may give fewer labels
    weights += [[0.0] * len(vocabulary)] * missing
    intercepts += [-20.0] * missing
    # Temperature of least log loss on the part held out.
    heads = model.transform(rows.where("part = 1")).select("label", F.expr("from_json(to_json(struct(rawPrediction)), 'rawPrediction struct<values: array<double>>').rawPrediction.values").alias("raw"))
    grid = [0.5, 0.75, 1.0, 1.5, 2.0, 3.0]
    loss = lambda t: F.avg(F.log(F.aggregate("raw", F.lit(0.0), lambda s, x: s + F.exp(x / t))) - F.element_at("raw", (F.col("label") + 1).cast("int")) / t)
    got = heads.agg(*(loss(t).alias(str(k)) for k, t in enumerate(grid))).first()
    losses = [x if x is not None else 0.0 for x in got]
    t = grid[losses.index(min(losses))] if any(x is not None for x in got) else 1.0
    return vocabulary, [[w / t for w in row] for row in weights], [b / t for b in intercepts]


def _scored(grams: DataFrame, keys: list[str], intercepts: list[float], known: DataFrame) -> DataFrame:
    """(keys, family, probability, similarity, is_confirmed) of the units of grams (keys, gram, w) that look like a licence."""
    one = grams.groupBy(*keys, "gram").agg(F.first("w").alias("w"))  # equal grams have equal weights
    sums = [F.sum(F.col("w")[k]).alias(f"s{k}") for k in range(len(FAMILIES))]
    rows = one.groupBy(*keys).agg(F.collect_set("gram").alias("grams"), *sums)  # at most the vocabulary
    top = F.array_max("z")
    rows = rows.withColumn("z", F.array(*(F.col(f"s{k}") + F.lit(float(b)) for k, b in enumerate(intercepts)))).withColumn("e", F.transform("z", lambda x: F.exp(x - top)))
    rows = rows.withColumn("total", F.aggregate("e", F.lit(0.0), lambda s, x: s + x))
    names = F.array(*map(F.lit, FAMILIES[1:]))
    own = F.slice("e", 2, len(FAMILIES) - 1)
    rows = rows.withColumns({"best": F.array_max(own) / F.col("total"), "guess": F.element_at(names, F.array_position(own, F.array_max(own)).cast("int")), "probability": 1 - F.element_at("e", 1) / F.col("total")})
    rows = rows.where("probability >= 0.5").join(known, "guess")
    rows = rows.withColumn("similarity", F.array_max(F.transform("known", lambda t: F.size(F.array_intersect(t, F.col("grams"))) / F.size(t))))
    sure = (F.col("guess") != UNKNOWN) & (F.col("best") >= MIN_PROBABILITY) & (F.col("similarity") >= MIN_SIMILARITY)
    return rows.select(*keys, F.when(sure, F.col("guess")).otherwise(UNKNOWN).alias("family"), "probability", "similarity", sure.alias("is_confirmed"))


def license_scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, line, n_lines, family, probability, similarity, is_confirmed: a row for each line or paragraph that looks like a licence.

    A paragraph of several lines (or whose last words stand on the next line) has a row if it states a family that none
    of its lines states alone; it then stands for its lines that state none. line is its first line, counted from 0.
    probability: calibrated, of any licence. similarity: the share of a template's bigrams and trigrams that is held, the
    best of the family's templates. family is "unknown" where no family is sure or no template confirms it (is_confirmed
    false). Null and empty texts have no line. Rows that repeat a doc_id give their lines each; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    vocabulary, weights, intercepts = fit(docs)
    table = [{"gram": g, "w": [row[k] for row in weights]} for k, g in enumerate(vocabulary)]
    grams = stored(_local(spark, table, "gram:string,w:array<double>").withColumn("words", F.split("gram", " ")))
    # The vocabulary is that of the fixed templates: some hundred rows.
    two = F.broadcast(grams.where("size(words) = 2").select(F.xxhash64(F.col("words")[0], F.col("words")[1]).alias("two"), F.col("gram").alias("gram2"), F.col("w").alias("w2")))
    three = F.broadcast(grams.where("size(words) = 3").select(F.col("gram").alias("gram3"), F.col("w").alias("w3")))
    known = F.broadcast(templates(spark).groupBy("family").agg(F.collect_list("grams").alias("known")).withColumnRenamed("family", "guess"))

    # Word positions of a line, and behind it the first two words of the next line.
    rows = _lines(docs).where("text <> ''").select("row", "doc_id", "line", _words(F.col("text")).alias("own"), F.slice(_words(F.col("next")), 1, 2).alias("more"))
    rows = rows.select("row", "doc_id", "line", F.size("own").alias("n"), F.concat("own", "more").alias("words")).where("n > 0")
    rest = lambda at: F.slice("words", F.lit(at), F.col("n"))
    places = rows.select("row", "doc_id", "line", "n", F.posexplode(F.arrays_zip(rest(1).alias("a"), rest(2).alias("b"), rest(3).alias("c"))).alias("i", "p"))
    places = places.select("row", "doc_id", "line", (F.col("n") - F.col("i")).alias("left"), F.col("p.a").alias("a"), F.col("p.b").alias("b"), F.col("p.c").alias("c"), F.xxhash64("p.a", "p.b").alias("two"))
    hits = places.join(two, "two").where(F.col("gram2") == F.concat_ws(" ", "a", "b"))
    hits = hits.withColumn("gram3", F.concat_ws(" ", "a", "b", "c")).join(three, "gram3", "left")
    both = F.array(
        F.struct(F.col("gram2").alias("gram"), F.col("w2").alias("w"), (F.col("left") >= 2).alias("inside")),
        F.struct(F.when(F.col("w3").isNotNull(), F.col("gram3")).alias("gram"), F.col("w3").alias("w"), (F.col("left") >= 3).alias("inside")),
    )
    hits = stored(hits.select("row", "doc_id", "line", F.explode(both).alias("g")).where("g.gram is not null").select("row", "doc_id", "line", "g.*"))

    keys = ["row", "doc_id", "line"]
    lines = stored(_scored(hits.where("inside").drop("inside"), keys, intercepts, known))
    # A paragraph is a run of lines with hits; within one document, of which a task holds the whole text anyway.
    order = Window.partitionBy("row").orderBy("line")
    runs = hits.groupBy(*keys).agg(F.bool_or(~F.col("inside")).alias("crosses"))
    runs = runs.withColumn("first", F.col("line") - F.row_number().over(order)).withColumn("first_line", F.min("line").over(Window.partitionBy("row", "first")))
    size = Window.partitionBy("row", "first_line")
    runs = runs.select(*keys, "first_line", F.count("*").over(size).alias("n_lines"), F.bool_or("crosses").over(size).alias("crosses"))
    runs = stored(runs.where("n_lines > 1 or crosses"))
    whole = hits.join(runs.select("row", "line", "first_line", "n_lines"), ["row", "line"]).select("row", "doc_id", F.col("first_line").alias("line"), "n_lines", "gram", "w")
    whole = _scored(whole, [*keys, "n_lines"], intercepts, known)
    place = runs.select("row", "line", "first_line")
    said = lines.join(place, ["row", "line"]).where("is_confirmed").select("row", F.col("first_line").alias("line"), "family").distinct()
    alone = lines.join(place.select("row", "line").distinct(), ["row", "line"], "left_semi").select("row", "line")
    known_line = place.join(alone, ["row", "line"]).select("row", F.col("first_line").alias("line")).distinct()
    # A paragraph that confirms no family is told of only where none of its lines is reported.
    whole = whole.join(said, ["row", "line", "family"], "left_anti")
    whole = stored(whole.where("is_confirmed").unionByName(whole.where("not is_confirmed").join(known_line, ["row", "line"], "left_anti")))
    covered = place.join(whole.where("is_confirmed").select("row", F.col("line").alias("first_line")).distinct(), ["row", "first_line"], "left_semi").select("row", "line")
    kept = lines.where("is_confirmed").unionByName(lines.where("not is_confirmed").join(covered, ["row", "line"], "left_anti"))
    kept = kept.withColumn("n_lines", F.lit(1).cast("long")).unionByName(whole)
    return kept.select("doc_id", F.col("line").cast("long").alias("line"), "n_lines", "family", "probability", "similarity", "is_confirmed")
