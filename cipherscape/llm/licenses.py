"""Licence scan: a trained paragraph classifier, in DataFrame and SQL functions only.

Each line of a text is classified, and each paragraph of several lines, joined: a
run of lines with words, up to a line without any (an empty line, a bare comment
sign).  So a notice wrapped over several lines is seen whole.  Where a line confirms
the paragraph's family, the lines are reported; otherwise the paragraph is, at its
first line.  A line that is unconfirmed, or of another family, and has no n-gram of its
family's templates beyond those of the family its paragraph confirms is a piece of that
notice ('version 3' may stand on the next line) and not reported.

Words (lower case, letters and digits) form n-grams of one to three words; n-grams of function words alone are left out.
A multinomial logistic regression with an L1 penalty, fitted by Spark ML on a
fixed, bounded set of licence wordings, of ordinary sentences and of legal prose, gives each
n-gram a weight for each family.  A temperature and a threshold turn scores into
probabilities and send the uncertain to the class 'unknown'.  Both are chosen on scores
that each wording, and each sentence of the unknown class, gets from a fit that has not seen
it: the wordings lie in three folds.  A family counts as confirmed when enough of the
n-grams of one of its templates stand in the paragraph.

Scanning is a join with the model, whose size is fixed.  The intercept of 'unknown'
is the largest, so a paragraph can be something else only if it has an n-gram that
weighs more for a family than for 'unknown'.  Lines and paragraphs without a word of
such n-grams are left out before n-grams are formed, and n-grams with a word that
neither the model nor a template has are not formed; that changes no result.

Edge cases: null and empty texts and empty lines have no licence and no row;
repeated rows give repeated findings; null ids stay null; a very long text, line or
paragraph is one like others; equal probabilities go to the family last in name; an empty
table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import itertools
import json
import random
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cipherscape.llm.common import small_table, stage

UNKNOWN = "unknown"

# Wordings by which licences are declared, and passages of their full texts.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License",
        "Licensed under the MIT License",
        "The MIT License (MIT)",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, "
        "to deal in the Software without restriction",
        "SPDX-License-Identifier: MIT",
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "This project is licensed under the terms of the MIT license",
        "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Apache License Version 2.0, January 2004",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements",
        "Released under the Apache 2.0 license",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
        "Released under the GNU GPL v3",
        "Licensed under GPLv3 or later",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2",
        "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License",
        "SPDX-License-Identifier: GPL-2.0-only",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
        "Released under the GNU GPL v2",
        "Licensed under GPLv2 only",
    ),
    "LGPL": (
        "Licensed under the GNU Lesser General Public License, version 2.1",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
        "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
        "Released under the GNU LGPL",
        "You should have received a copy of the GNU Lesser General Public License along with this library",
    ),
    "BSD": (
        "Licensed under the BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
        "Released under the BSD license",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License, Version 2.0",
        "SPDX-License-Identifier: MPL-2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at mozilla.org/MPL/2.0",
        "Released under the MPL 2.0",
        "Mozilla Public License Version 2.0",
    ),
    "CC-BY": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "Licensed under CC BY 4.0",
        "SPDX-License-Identifier: CC-BY-4.0",
        "This article is distributed under the terms of the Creative Commons Attribution License, which permits unrestricted use, provided the original author is credited",
        "To view a copy of this license, visit creativecommons.org/licenses/by/4.0",
        "Released under CC BY 4.0",
    ),
    "CC-BY-SA": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "Licensed under CC BY-SA 4.0",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
        "Text is available under the Creative Commons Attribution-ShareAlike License",
        "To view a copy of this license, visit creativecommons.org/licenses/by-sa/4.0",
        "Released under CC BY-SA 4.0",
    ),
    "CC-BY-NC": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "Licensed under CC BY-NC 4.0",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
        "Text is available under the Creative Commons Attribution-NonCommercial License",
        "To view a copy of this license, visit creativecommons.org/licenses/by-nc/4.0",
        "Released under CC BY-NC 4.0",
    ),
    "CC0": (
        "To the extent possible under law, the author has waived all copyright and related rights to this work",
        "Dedicated to the public domain under CC0 1.0 Universal",
        "SPDX-License-Identifier: CC0-1.0",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law",
        "Released under CC0 1.0",
        "Creative Commons Zero public domain dedication",
    ),
    "Proprietary": (
        "All rights reserved",
        "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited",
        "This software is the confidential and proprietary information of the company",
        "No part of this publication may be reproduced, distributed or transmitted in any form without the prior written permission of the publisher",
        "All rights reserved. Unauthorised use, copying or distribution is prohibited",
    ),
}
#: Sentences that use the same words, for the unknown class: ordinary ones, and the prose of contracts, policies and councils.
ORDINARY = (
    "The driver showed a licence and the officer wrote down the version of the form",
    "She was granted a license to practise medicine in the general hospital",
    "Public works on the road are subject to the terms of the council",
    "The free concert is open to any person with a copy of the programme",
    "An apache helicopter landed near the river under heavy rain",
    "Students at MIT published a paper on source code and binary forms",
    "The foundation published the second version of its annual report",
    "Creative people in the commons share attribution for common works",
    "The following conditions are met by most software in use",
    "The rights of the people are not reserved to the state",
    "He reserved all seats in the right wing of the theatre",
    "The work is under review and the author has not waived the fee",
    "Version 3 of the general plan was modified by the public",
    "Copy the file and redistribute the leaflets to the public",
    "All the rooms in the hotel were reserved",
    "The gnu and the zebra share the general area near the lake",
    "This agreement is governed by the law of the state in which the seller is established",
    "The tenant may not sublet the premises without the written permission of the landlord",
    "We use the information that you provide in accordance with our privacy policy and applicable law",
    "The seller warrants that the goods are free from defects and fit for their particular purpose",
    "Each party shall keep the terms of this contract confidential after it ends",
    "A copy of the notice must be posted at the entrance for fourteen days",
    "Permission to build was granted by the council subject to the following conditions",
    "The licensee of a public house shall display the licence in a place where any person can read it",
    "The author sold the rights to the film and kept those to the text",
    "The company may modify these terms of service at any time by written notice",
    "Dividends are distributed without limitation to all holders of common stock",
    "The contributor sends the article and the publisher prints it under his name",
    "A general warranty of merchantability is implied by the law of sales",
    "Documentation and other materials are provided with the machine in a sealed bag",
    "Redistribution of land was permitted by an act of the third parliament",
    "The university released version 2 of its free course in June",
)
#: Words that carry no licence on their own.
FUNCTION_WORDS = tuple(
    "a an and any are as at be by either for from has have if in into is it its may no not of on or the this that to under was were with without you your".split()
)


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def ngrams(tokens: Column) -> Column:
    """Distinct n-grams of one to three words, without those of function words alone."""

    def of(n: int) -> Column:
        at = F.when(F.size(tokens) >= n, F.sequence(F.lit(1), F.size(tokens) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda k: F.slice(tokens, k, n))

    telling = F.filter(F.concat(of(1), of(2), of(3)), lambda g: F.exists(g, lambda w: ~w.isin(*FUNCTION_WORDS)))
    return F.array_distinct(F.transform(telling, lambda g: F.array_join(g, " ")))


def known_ngrams(tokens: Column, known: list[str]) -> Column:
    """Of the n-grams of one to three words, those whose words are all in ``known``, each once."""

    def of(one: Column) -> Column:  # null stands for other words, and for what lies past the end
        after = lambda k: F.slice(one, k + 1, F.size(one))
        two = F.zip_with(one, after(1), lambda a, b: F.concat(a, F.lit(" "), b))
        three = F.zip_with(two, after(2), lambda a, b: F.concat(a, F.lit(" "), b))
        return F.array_distinct(F.array_compact(F.concat(one, two, three)))

    return _let(F.transform(tokens, lambda w: F.when(w.isin(*known), w)), of)


def _let(value: Column, use) -> Column:  # noqa: ANN001
    """``use(value)`` with value computed once."""
    return F.transform(F.array(value), use)[0]


def units(text: Column, known: list[str], telling: list[str] | None) -> Column:
    """Structs (start, line, n, paragraph, ngrams): the lines with words, and the paragraphs of n > 1 such lines.

    start is the first line of the paragraph.  Without a telling word a line or paragraph is left out.
    """

    def tells(tokens: Column) -> Column:
        return F.lit(True) if telling is None else F.exists(tokens, lambda w: w.isin(*telling))

    def unit(start: Column, line: Column, n: Column, paragraph: Column, tokens: Column) -> Column:
        return F.struct(start.alias("start"), line.alias("line"), n.alias("n"), paragraph.alias("paragraph"), known_ngrams(tokens, known).alias("ngrams"))

    def of(run: Column) -> Column:
        lines, start = run["lines"], run["start"]
        placed = F.transform(lines, lambda x, k: F.struct(x["text"].alias("text"), x["tokens"].alias("tokens"), (start + k).alias("line")))
        single = F.transform(F.filter(placed, lambda x: tells(x["tokens"])), lambda x: unit(start, x["line"], F.lit(1), x["text"], x["tokens"]))
        # made only where it is wanted
        wanted = F.filter(F.array(lines), lambda x: (F.size(x) > 1) & F.exists(x, lambda y: tells(y["tokens"])))
        return F.concat(single, F.transform(wanted, lambda x: unit(start, start, F.size(x), F.array_join(x["text"], " "), F.flatten(x["tokens"]))))

    def runs(lines: Column) -> Column:
        breaks = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda k: F.size(F.get(lines, k)["tokens"]) == 0)
        cut = _let(breaks, lambda b: F.zip_with(
            F.concat(F.array(F.lit(-1)), b), F.concat(b, F.array(F.size(lines))),
            lambda s, e: F.struct((s + 1).alias("start"), F.slice(lines, s + 2, e - s - 1).alias("lines")),
        ))
        return F.flatten(F.transform(F.filter(cut, lambda r: F.size(r["lines"]) > 0), of))

    return _let(F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("text"), words(x).alias("tokens"))), runs)


#: Parts of the labelled paragraphs, by wording: what a part is scored with was never fitted on its wordings.
FOLDS = 3


def labelled_paragraphs(seed: int = 5, ordinary: int = 360) -> list[dict]:
    """(text, family, fold): the templates in several settings, and paragraphs of the unknown class; a bounded number.

    All paragraphs of one wording are in one fold, of the unknown class those of one set of sentences.
    """
    r = random.Random(seed)
    before = ("", "", "This file is ", "Note: ", "Copyright 2019 the authors. ", "(c) 2021 Example Ltd. ", "The code in this project: ", "Unless stated otherwise: ")
    after = ("", "", ".", ".", ". See LICENSE for details.", ". All files are covered.", " (see the file COPYING).")
    out = []
    for family, texts in TEMPLATES.items():
        for (k, text), a, b in itertools.product(enumerate(texts), before, after):
            if (not a and not b) or r.random() < 0.2:
                out.append({"text": a + text + b, "family": family, "fold": k % FOLDS})
    for k in range(ordinary):
        own = ORDINARY[k % FOLDS :: FOLDS]
        pool = " ".join(own).lower().split()
        text = r.choice(own) if k % 4 < 2 else " ".join(r.choices(pool, k=r.randint(4, 40)))
        out.append({"text": text.capitalize() + r.choice([".", "!", ""]), "family": UNKNOWN, "fold": k % FOLDS})
    return out


@dataclass
class Fit:
    """Weights by (n-gram, family) and intercepts by family; of the size of the labelled paragraphs."""

    weights: dict[tuple[str, str], float]
    bias: dict[str, float]

    def frames(self, spark: SparkSession) -> tuple[DataFrame, DataFrame]:
        weights = small_table(spark, [{"ngram": g, "family": f, "w": w} for (g, f), w in self.weights.items()], "ngram:string,family:string,w:double")
        return stage(weights, "weights"), small_table(spark, [{"family": f, "bias": b} for f, b in self.bias.items()], "family:string,bias:double")


@dataclass
class Model:
    fit: Fit
    temperature: float
    threshold: float
    #: Of the paragraphs scored by fits without their wordings: precision and recall of the families, share of the unknown class kept unknown.
    precision: float
    recall: float
    unknown_kept: float


def _fitted(rows: DataFrame, vectors: CountVectorizerModel) -> Fit:
    families = [*sorted(TEMPLATES), UNKNOWN]
    number = F.array_position(F.array(*map(F.lit, families)), F.col("family")) - 1
    regression = LogisticRegression(featuresCol="features", labelCol="y", family="multinomial", maxIter=60, regParam=0.001, elasticNetParam=0.5, standardization=False)
    model = regression.fit(vectors.transform(rows).withColumn("y", number.cast("double")))
    matrix = model.coefficientMatrix.toArray()
    weights = {(g, f): float(matrix[j, i]) for i, g in enumerate(vectors.vocabulary) for j, f in enumerate(families) if matrix[j, i] != 0.0}
    return Fit(weights, {f: float(b) for f, b in zip(families, model.interceptVector.toArray(), strict=True)})


def trained(spark: SparkSession, precision: float = 0.98) -> Model:
    """The model: fitted on all labelled paragraphs, calibrated on scores of wordings that the scoring fit had not seen.

    The temperature is the likeliest, the threshold the least that reaches ``precision``.
    """
    rows = small_table(spark, labelled_paragraphs(), "text:string,family:string,fold:int").withColumn("tokens", words(F.col("text")))
    rows = stage(rows.withColumn("key", F.monotonically_increasing_id()), "paragraphs")
    rows = stage(rows.withColumn("ngrams", ngrams(F.col("tokens"))), "paragraphs")
    vectors = CountVectorizer(inputCol="ngrams", outputCol="features", minDF=2, binary=True).fit(rows)
    scores = []
    for fold in range(FOLDS):
        weights, bias = _fitted(rows.filter(F.col("fold") != fold), vectors).frames(spark)
        scores.append(scored(rows.filter(F.col("fold") == fold), ["key", "family"], weights, bias))
    scores = stage(reduce(DataFrame.union, scores), "scores")
    temperatures = (0.5, 0.7, 1.0, 1.4, 2.0, 3.0)
    losses = scores.select(
        *[F.avg(-F.log(F.greatest(F.lit(1e-12), F.element_at(probabilities(F.col("scores"), t), F.col("family"))))).alias(str(k)) for k, t in enumerate(temperatures)]
    ).first()
    temperature = temperatures[min(range(len(temperatures)), key=lambda k: losses[k])]
    best = scores.select("family", best_family(probabilities(F.col("scores"), temperature)).alias("b")).select("family", F.col("b.family").alias("said"), F.col("b.p").alias("p"))
    found = [(r["family"], r["said"], r["p"]) for r in best.filter(F.col("said") != UNKNOWN).collect()]  # of the labelled paragraphs, a bounded number
    count = {r["known"]: r["count"] for r in rows.groupBy((F.col("family") != UNKNOWN).alias("known")).count().collect()}
    for threshold in (k / 100 for k in range(50, 100)):
        said = [(f, s) for f, s, p in found if p >= threshold]
        right = sum(f == s for f, s in said)
        if right >= precision * len(said):
            break
    wrong = sum(f == UNKNOWN for f, _ in said)
    return Model(_fitted(rows, vectors), temperature, threshold, right / max(1, len(said)), right / count[True], 1 - wrong / count[False])


def telling_words(fit: Fit) -> list[str] | None:
    """Words of the n-grams that weigh more for some family than for 'unknown'; None if the intercepts alone can decide."""
    if max(fit.bias.values()) > fit.bias[UNKNOWN]:
        return None
    own = {}
    for (gram, family), w in fit.weights.items():
        if family != UNKNOWN:
            own[gram] = max(own.get(gram, 0.0), w)
    telling = {w for (gram, _) in fit.weights if own.get(gram, 0.0) > fit.weights.get((gram, UNKNOWN), 0.0) for w in gram.split(" ")}
    return sorted(telling.difference(FUNCTION_WORDS))


def scored(paragraphs: DataFrame, keys: list[str], weights: DataFrame, bias: DataFrame) -> DataFrame:
    """keys and scores, a map of family to score; weights and bias are small by construction."""
    sums = (
        paragraphs.select(*keys, F.explode("ngrams").alias("ngram"))
        .join(F.broadcast(weights.withColumnRenamed("family", "of")), "ngram")
        .groupBy(*keys, "of").agg(F.sum("w").alias("w"))
        .groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("of", "w"))).alias("w"))
    )
    start = bias.agg(F.map_from_entries(F.collect_list(F.struct("family", "bias"))).alias("bias")).first()["bias"]
    literal = F.from_json(F.lit(json.dumps(start)), "map<string,double>")
    return sums.select(*keys, F.transform_values(literal, lambda f, b: b + F.coalesce(F.element_at(F.col("w"), f), F.lit(0.0))).alias("scores"))


def probabilities(scores: Column, temperature: float) -> Column:
    top = F.array_max(F.map_values(scores))
    powers = F.transform_values(scores, lambda f, s: F.exp((s - top) / temperature))
    return F.transform_values(powers, lambda f, e: e / F.aggregate(F.map_values(powers), F.lit(0.0), lambda a, x: a + x))


def best_family(p: Column) -> Column:
    """(family, p) of the largest probability; ties go to the last name."""
    best = F.array_max(F.transform(F.map_entries(p), lambda e: F.struct(e["value"].alias("p"), e["key"].alias("family"))))
    return F.struct(best["family"].alias("family"), best["p"].alias("p"))


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text", confirm: float = 0.6, model: Model | None = None) -> DataFrame:
    """(id, line, family, probability, similarity, confirmed, paragraph): every line or paragraph that declares a licence."""
    spark = docs.sparkSession
    model = model or trained(spark)
    weights, bias = model.fit.frames(spark)
    temperature, threshold, telling = model.temperature, model.threshold, telling_words(model.fit)
    templates = small_table(spark, [{"family": f, "t": t} for f, ts in TEMPLATES.items() for t in ts], "family:string,t:string")
    templates = stage(templates.withColumn("t", words(F.col("t"))), "templates")
    templates = stage(templates.withColumn("t", ngrams(F.col("t"))), "templates")
    grams = {g for g, _ in model.fit.weights}.union(*(r["t"] for r in templates.collect()))  # of a fixed size, as the model
    known = sorted({w for g in grams for w in g.split(" ")})

    key = ["row", "line", "n"]
    row = F.monotonically_increasing_id()
    read = docs.filter(F.col(text).isNotNull()).select(row.alias("row"), F.col(id), F.col(text).alias("text"))
    # numbered before lines come apart, as they share their text's number
    read = stage(read.select("row", id, F.inline(units(F.col("text"), known, telling))), "lines")
    found = scored(read, key, weights, bias)
    found = found.withColumn("best", best_family(probabilities(F.col("scores"), temperature)))
    found = found.filter((F.col("best.family") != UNKNOWN) & (F.col("best.p") >= threshold)).select(*key, "best")
    found = read.join(found, key).join(F.broadcast(templates.groupBy("family").agg(F.collect_list("t").alias("templates"))), F.col("best.family") == F.col("family"))
    found = found.withColumn("similarity", F.array_max(F.transform("templates", lambda t: F.size(F.array_intersect(t, F.col("ngrams"))) / F.size(t))))
    found = found.withColumn("confirmed", F.col("similarity") >= confirm).withColumn("says", F.array_intersect(F.flatten("templates"), F.col("ngrams")))
    # a paragraph and its lines: windows of one paragraph
    whole, own, same = F.col("n") > 1, Window.partitionBy("row", "start"), Window.partitionBy("row", "start", "family")
    notice = F.struct(F.flatten("templates").alias("ngrams"), F.col("family").alias("of"))
    found = found.withColumn("notice", F.max(F.when(whole & F.col("confirmed"), notice)).over(own))
    found = found.withColumn("by_line", F.max(F.when(~whole, F.col("confirmed").cast("int"))).over(same))
    piece = (~F.col("confirmed") | (F.col("family") != F.col("notice.of"))) & (F.size(F.array_except("says", "notice.ngrams")) == 0)
    doubled = F.col("by_line").isNotNull() & ((F.col("by_line") == 1) | ~F.col("confirmed"))
    found = found.filter(F.when(whole, ~doubled).otherwise(F.col("notice").isNull() | ~piece))
    return found.select(id, F.col("line").cast("int").alias("line"), "family", F.col("best.p").alias("probability"), "similarity", "confirmed", "paragraph")
