"""Licence scans: a trained paragraph classifier on sparse word n-grams.

A multinomial logistic regression over word 1- and 2-grams, with an L1 penalty that
keeps it sparse, is trained on the notices and sentences listed below, each in several
framings. Its classes are licence families, `unknown`, which notices of licences outside
the families teach, and `none`, which prose with the words of licences teaches. The last
notice of every family, and every fourth sentence and other licence, are held out: on them
a temperature is fitted that calibrates the probabilities. A paragraph is a run of lines up
to a blank line or to a line that ends a sentence, so that a wrapped notice is one
paragraph. The predicted family is confirmed by comparison with its templates: the share of
2-grams in common, of the shorter side, which must be whole, and the probability higher, below four 2-grams.

Paragraphs are found by one regular expression, which loses none: it looks for grams that
speak more for some licence than for `none`, and no bias is above that of `none`, so that a
paragraph without any such gram is `none` by the classifier too. Everyday words are no
features on their own, nor are two function words beside each other.

The scan itself is built-in columns; only the model, whose size is fixed by the lists
below, is made on the driver and broadcast.

Defined cases: null and empty texts have no paragraph and family `none`. Repeated paragraphs
of a text count as often as they stand. Ties go to the family first by name, `none` and `unknown` last. Rows that repeat a
doc_id are reported together, each row with the same result; a text that repeats with it counts once. Very long texts are read
whole. An empty table gives an empty one; further columns are not read.
"""

from __future__ import annotations

import functools
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN, NONE = "unknown", "none"
#: Probability and template share that a family needs.
LEAST_P, LEAST_SHARE = 0.6, 0.6
#: Probability, of all licences together, that makes a paragraph without a confirmed family `unknown`.
LEAST_LICENCE = 0.9
#: Number of 2-grams below which a paragraph or template must be met whole, with LEAST_LICENCE in place of LEAST_P.
SHORT = 4
#: Ends a paragraph: a blank line, or the end of a line after the end of a sentence.
PARAGRAPH = r"(?<=[.!?:;])[ \t\r\f]*\n|\n[ \t\r\f]*\n"

# Notices and sentences of public licences, by family; the last of each is held out of training.
TEMPLATES = {
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "AGPL-3.0-or-later",
        "Use of this software is governed by the GNU Affero General Public License version 3 or later.",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
        "This project is under the Apache 2.0 license.",
        "Released under the Apache License 2.0.",
    ),
    "artistic": ("This package is free software; you may redistribute it under the terms of the Artistic License 2.0.", "Licensed under the Artistic License."),
    "boost": ("Distributed under the Boost Software License, Version 1.0.", "Use, modification and distribution are subject to the Boost Software License."),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Licensed under the 3-clause BSD license.",
        "Released under the BSD License.",
    ),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Available under CC BY 4.0.", "The text may be used under the Creative Commons Attribution License (CC BY 4.0)."),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Available under CC BY-NC 4.0.",
        "You may not use the material for commercial purposes (CC BY-NC 4.0).",
        "The text may be used under the Creative Commons Attribution-NonCommercial License (CC BY-NC 4.0).",
    ),
    "cc-by-sa": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Available under CC BY-SA 4.0.", "The text may be used under the Creative Commons Attribution-ShareAlike License (CC BY-SA 4.0)."),
    "cc0": ("To the extent possible under law, the author has waived all copyright and related rights to this work under CC0 1.0 Universal.", "Dedicated to the public domain under CC0 1.0.", "The data is in the public domain under CC0 1.0."),
    "epl": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.", "Licensed under the Eclipse Public License 2.0.", "Distributed under the Eclipse Public License v1.0."),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Licensed under the GNU General Public License, version 2 or later.",
        "GPL-3.0-or-later",
        "You should have received a copy of the GNU General Public License along with this program.",
        "This module may be used under the GNU General Public License version 3.",
    ),
    "isc": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "Licensed under the ISC license.", "This project uses the ISC License."),
    "lgpl": (
        "This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is covered by the GNU Lesser General Public License version 3.",
    ),
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "This project is licensed under the MIT License.",
        "MIT licensed",
        "Distributed under the terms of the MIT license.",
        "Released under MIT",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License 2.0.",
        "Covered by the Mozilla Public License, version 1.1.",
    ),
    "proprietary": (
        "Copyright. All rights reserved. No part of this publication may be reproduced without written permission of the publisher.",
        "Copyright, all rights reserved.",
        "Confidential and proprietary. Unauthorized copying of this file is strictly prohibited.",
        "All rights reserved.",
        "All rights reserved by the authors.",
    ),
    "unlicense": ("This is free and unencumbered software released into the public domain.", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", "For more information, please refer to http://unlicense.org/", "Released into the public domain under the Unlicense."),
    "zlib": ("This software is provided as-is, without any express or implied warranty.", "Licensed under the zlib license.", "Distributed under the zlib/libpng license."),
}
NEGATIVES = (
    "She passed her driving test and got her license last week.",
    "The city council issued a fishing license to every applicant.",
    "The museum gave permission to photograph the hall.",
    "They visited the institute in Massachusetts and met students of MIT.",
    "The general public was invited to the free concert in the park.",
    "Copyright law differs from one country to another.",
    "The Apache helicopter landed near the village.",
    "Human rights groups asked the court for a review.",
    "All of the seats in the restaurant were reserved.",
    "The software works without any change on both systems.",
    "This work is about the history of the region.",
    "The new version was released under great pressure.",
    "A creative group of people runs the commons in our town.",
    "He wrote a source of income into the form.",
    "The warranty of the car ended after two years.",
    "It is free of charge for any person under ten.",
    "The bar has been licensed under the new law since May.",
    "No part of the bridge was reproduced in the model.",
    "You can obtain a copy of the report at the library.",
    "The program is made available under the terms of the contract with the city.",
    "The foundation published a general review of public software.",
    "An eclipse of the moon was visible to the public.",
    "The artistic director left the theatre with a license to teach.",
    "Permission was granted to any person with a ticket.",
    "The material may not leave the building for commercial purposes.",
    "All copyright questions go to the committee, which reserved its decision.",
    "Redistribution of the land was permitted under the conditions of the treaty.",
    "The domain of the function is public knowledge.",
    "Under the agreement all rights reserved to the crown were kept.",
    "The rights reserved for members are listed in the statute.",
    "He explained that all rights reserved to the states by the constitution stay with them.",
    "The seats and all rights reserved to the heirs by the will were sold.",
    "The court held that all rights reserved to the people were untouched.",
    "All rights reserved for the buyers by the contract passed to their children.",
    "The treaty lists all rights reserved to the islands and the fishing grounds.",
    "Her licence to practise medicine was renewed in spring.",
    "The code is on the desk beside the door.",
    "The version of the story in this file is older than the source.",
    "The software was distributed to schools under a contract.",
    "An identifier is printed on the back of each card.",
    "Version 2.0 of the plan was released to the public in May.",
)
# Identifiers of the families, beyond the notices above.
IDENTIFIERS = {
    "agpl": ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"),
    "apache-2.0": ("Apache-2.0",),
    "artistic": ("Artistic-2.0", "Artistic-1.0"),
    "boost": ("BSL-1.0",),
    "bsd": ("BSD-2-Clause", "BSD-3-Clause"),
    "cc-by": ("CC-BY-4.0", "CC-BY-3.0"),
    "cc-by-nc": ("CC-BY-NC-4.0",),
    "cc-by-sa": ("CC-BY-SA-4.0", "CC-BY-SA-3.0"),
    "cc0": ("CC0-1.0",),
    "epl": ("EPL-2.0", "EPL-1.0"),
    "gpl": ("GPL-2.0", "GPL-3.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later"),
    "isc": ("ISC",),
    "lgpl": ("LGPL-2.1", "LGPL-3.0", "LGPL-2.1-or-later", "LGPL-3.0-or-later"),
    "mit": ("MIT",),
    "mpl": ("MPL-2.0", "MPL-1.1"),
    "unlicense": ("Unlicense",),
    "zlib": ("Zlib",),
}
# Names of the families.
NAMES = {
    "agpl": "GNU Affero General Public License",
    "apache-2.0": "Apache License 2.0",
    "artistic": "Artistic License",
    "boost": "Boost Software License",
    "bsd": "BSD License",
    "cc-by": "Creative Commons Attribution License",
    "cc-by-nc": "Creative Commons Attribution-NonCommercial License",
    "cc-by-sa": "Creative Commons Attribution-ShareAlike License",
    "cc0": "CC0 1.0 Universal",
    "epl": "Eclipse Public License",
    "gpl": "GNU General Public License",
    "isc": "ISC License",
    "lgpl": "GNU Lesser General Public License",
    "mit": "MIT License",
    "mpl": "Mozilla Public License 2.0",
    "unlicense": "Unlicense",
    "zlib": "zlib License",
}
# Licences outside the families, as (identifier, name); the first four are made up.
OTHERS = (
    ("Example-1.2", "Example Community License 1.2"),
    ("Northwind-4", "Northwind Source License, version 4"),
    ("Harbour-1.0", "Harbour Shared Code License"),
    ("Meadow-2.0", "Meadow Open Terms 2.0"),
    ("EUPL", "EUPL 1.1"),
    ("AFL", "AFL 2.1"),
    ("OSL", "OSL 2.1"),
    ("CDDL", "CDDL 1.1"),
    ("CDDL-1.0", "Common Development and Distribution License"),
    ("MS-PL", "Microsoft Public License"),
    ("OSL-3.0", "Open Software License 3.0"),
    ("SSPL-1.0", "Server Side Public License"),
    ("Python-2.0", "Python Software Foundation License"),
    ("QPL-1.0", "Q Public License"),
    ("EUPL-1.2", "European Union Public Licence 1.2"),
    ("PostgreSQL", "PostgreSQL License"),
    ("NCSA", "University of Illinois Open Source License"),
    ("OFL-1.1", "SIL Open Font License 1.1"),
    ("WTFPL", "Do What The Fuck You Want To Public License"),
    ("ECL-2.0", "Educational Community License 2.0"),
    ("AFL-3.0", "Academic Free License 3.0"),
    ("BUSL-1.1", "Business Source License 1.1"),
    ("Elastic-2.0", "Elastic License 2.0"),
    ("CeCILL-2.1", "CeCILL Free Software License Agreement"),
)
_OF_IDENTIFIER = ("SPDX-License-Identifier: {}", "This code is {}.", "License: {}", "Available under {}", "Published under the {}-Lizenz", "Unter der {}-Lizenz.")
_OF_NAME = ("Licensed under the {}.", "This file is covered by the {}.", "Released under the terms of the {}.")
_OF_OTHER = ("SPDX-License-Identifier: {}", "License: {}", "Available under {}")
# What may stand beside a notice or sentence.
_BESIDE = ("", "See LICENSE.", "Note", "Thank you for reading.", "Copyright 2021.", "(c) the authors.")
# Everyday words (in any of several languages) that are no evidence on their own.
_COMMON = frozenset(
    "above academic accompanying all along and any anyone are associated author authors available be binary boost business by charge code commercial common "
    "commons community compliance conditions copies copy covered creative data deal der development distribute distributed distribution do documentation "
    "does domain eclipse either elastic european example express extent fee file files following font for form forms found foundation free fuck general "
    "governed granted harbour http illinois implied in included information international into is kind later law library list made material materials may "
    "met microsoft mit modify module more must northwind notice obtain obtaining of on only open or package part permission person please possible program "
    "project provided public publication publish published publisher purpose purposes python q received redistributed refer related released reserved "
    "restriction retain rights sell server shall shared side sil software source strictly style subject terms text that the this to under union universal "
    "university unter use used uses v version want what who with without work written you".split()
)
# Function words, which are no evidence beside each other either.
_FUNCTION = frozenset("a all an and any are as at be been by can for from has have if in is it its may no not of on one or other should that the there this to under used was were will with without you".split())
_WORD = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"


def _grams(text: str) -> set[str]:
    words = re.findall(_WORD, text.lower())
    return set(words) | {f"{a} {b}" for a, b in zip(words, words[1:], strict=False)}


def _feature(gram: str) -> bool:
    return not set(gram.split()) <= _FUNCTION if " " in gram else gram not in _COMMON | _FUNCTION and not gram.replace(".", "").isdigit()


def notices(family: str) -> list[str]:
    """All templates of a family: those of its identifiers and its name, then its notices."""
    named = [form.format(NAMES[family]) for form in _OF_NAME] if family in NAMES else []
    made = [form.format(i) for i in IDENTIFIERS.get(family, ()) for form in _OF_IDENTIFIER] + named
    return [t for t in made if t != TEMPLATES[family][-1]] + list(TEMPLATES[family])


class Model:
    """classes, weights (gram -> one number for each class), bias, temperature, evidence grams."""

    def __init__(self, classes, weights, bias, temperature, evidence):
        self.classes, self.weights, self.bias, self.temperature, self.evidence = classes, weights, bias, temperature, evidence


def examples() -> list[tuple[str, str, bool]]:
    """(text, class, held out) of every notice and sentence."""
    out = [(t, name, t == own[-1]) for name, own in TEMPLATES.items() for t in notices(name)]
    for k, (identifier, name) in enumerate(OTHERS):
        out += [(t, UNKNOWN, k % 4 == 3) for t in [form.format(identifier) for form in _OF_OTHER] + [form.format(name) for form in _OF_NAME]]
    return out + [(t, NONE, k % 4 == 3) for k, t in enumerate(NEGATIVES)]


@functools.cache
def train(rounds: int = 300, penalty: float = 1e-4, rate: float = 0.5) -> Model:
    classes = [*sorted(TEMPLATES), NONE, UNKNOWN]
    none = classes.index(NONE)
    fit, held = [], []
    for t, c, out in examples():
        words = t.split()
        parts = [t] if out or len(words) < 16 else [t, " ".join(words[: len(words) // 2]), " ".join(words[len(words) // 2 :])]
        (held if out else fit).extend((_grams(part) | _grams(beside), classes.index(c)) for part in parts for beside in _BESIDE)
    names = sorted({g for grams, _ in fit for g in grams if _feature(g)})
    at = {g: k for k, g in enumerate(names)}

    def matrix(some):
        x = np.zeros((len(some), len(names)))
        for i, (grams, _) in enumerate(some):
            x[i, [at[g] for g in grams if g in at]] = 1
        return x, np.eye(len(classes))[[c for _, c in some]]

    def softmax(z):
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    x, y = matrix(fit)
    share = (1 / (len(classes) * y.sum(axis=0)))[y.argmax(axis=1)][:, None]  # classes weigh alike
    w, b = np.zeros((len(names), len(classes))), np.zeros(len(classes))
    ahead_w, ahead_b = w, b
    for k in range(rounds):  # accelerated proximal steps
        error = (softmax(x @ ahead_w + ahead_b) - y) * share
        new_w = ahead_w - rate * (x.T @ error)
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - rate * penalty, 0)
        new_b = ahead_b - rate * error.sum(axis=0)
        new_b[none] = new_b.max()  # a paragraph that nothing speaks for is none
        ahead_w, ahead_b = new_w + k / (k + 3) * (new_w - w), new_b + k / (k + 3) * (new_b - b)
        w, b = new_w, new_b
    hx, hy = matrix(held)
    z = hx @ w + b
    loss = {t: -np.log((softmax(z / t) * hy).sum(axis=1) + 1e-12).mean() for t in (0.25, 0.35, 0.5, 0.6, 0.7, 0.85, 1.0, 1.2, 1.4, 2.0)}
    temperature = min(loss, key=loss.get)
    w = w.round(4)
    weights = {g: w[k].tolist() for g, k in at.items() if np.abs(w[k]).max() > 0}
    evidence = {g for g, v in weights.items() if max(v) > v[none]}
    evidence = sorted(g for g in evidence if " " not in g or not evidence & set(g.split()))
    return Model(classes, weights, b.round(4).tolist(), temperature, evidence)


def _evidence_regex(grams: list[str]) -> str:
    """Finds any of the grams as whole words; alternatives are grouped by first letter and first word."""
    tree: dict[str, dict[str, list[str]]] = {}
    for g in grams:
        first, _, second = g.partition(" ")
        tree.setdefault(first[0], {}).setdefault(first[1:], []).append(second)
    parts = []
    for c, firsts in tree.items():
        ends = [re.escape(rest) + ("(?![a-z0-9])" if "" in own else f"[^a-z0-9]+(?:{'|'.join(map(re.escape, own))})(?![a-z0-9])") for rest, own in firsts.items()]
        parts.append(f"{re.escape(c)}(?:{'|'.join(ends)})")
    return f"(?<![a-z0-9])(?=[{''.join(map(re.escape, tree))}])(?:{'|'.join(parts)})"


def scan_paragraphs(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, th, line_no, family, p, licence, share, confirmed of every paragraph with evidence.

    licence: the probability of all classes but `none`.
    """
    model = model or train()
    spark = docs.sparkSession
    known = [(name, sorted(g for g in _grams(t) if " " in g)) for name in TEMPLATES for t in notices(name)]
    evidence = _evidence_regex(model.evidence)
    d = docs.filter(F.lower("text").rlike(evidence))
    lines = d.select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split(F.lower("text"), PARAGRAPH)).alias("line_no", "line")).filter(F.col("line").rlike(evidence))
    lines = lines.dropDuplicates(["doc_id", "th", "line_no"])
    words = F.regexp_extract_all("line", F.lit(_WORD), F.lit(0))
    lines = lines.withColumn("words", words)
    pairs = F.when(F.size("words") > 1, F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.concat_ws(" ", F.element_at("words", i), F.element_at("words", i + 1)))).otherwise(F.array().cast("array<string>"))
    lines = lines.select("doc_id", "th", "line_no", "words", F.array_distinct(pairs).alias("pairs")).withColumn("grams", F.array_distinct(F.concat("words", "pairs")))
    k = len(model.classes)
    table = spark.createDataFrame([(g, *v) for g, v in sorted(model.weights.items())], ", ".join(["g string", *(f"w{i} double" for i in range(k))]))
    key = ["doc_id", "th", "line_no"]
    hits = lines.select(*key, "pairs", F.explode("grams").alias("gram")).join(F.broadcast(table), F.col("gram") == F.col("g"))  # one row for each weight of the model
    z = [((F.sum(f"w{i}") + model.bias[i]) / model.temperature).alias(f"z{i}") for i in range(k)]
    scored = hits.groupBy(*key).agg(F.first("pairs").alias("pairs"), *z)
    top = F.greatest(*[F.col(f"z{i}") for i in range(k)])
    total = sum((F.exp(F.col(f"z{i}") - F.col("top")) for i in range(1, k)), F.exp(F.col("z0") - F.col("top")))
    family = F.coalesce(*[F.when(F.col(f"z{i}") == F.col("top"), F.lit(c)) for i, c in enumerate(model.classes)])
    none = F.exp(F.col(f"z{model.classes.index(NONE)}") - F.col("top"))
    scored = scored.withColumn("top", top).select(*key, "pairs", family.alias("family"), (1 / total).alias("p"), (1 - none / total).alias("licence"))
    templates = spark.createDataFrame(known, "name string, grams array<string>")
    shorter = F.least(F.size("pairs"), F.size("grams"))
    common = F.size(F.array_intersect("pairs", "grams")) / F.greatest(F.lit(1), shorter)
    common = F.when((shorter >= SHORT) | ((common == 1) & (F.col("p") >= LEAST_LICENCE)), common).otherwise(F.lit(0.0))
    compared = scored.join(F.broadcast(templates), F.col("family") == F.col("name"), "left").groupBy(*key, "family", "p", "licence").agg(F.coalesce(F.max(common), F.lit(0.0)).alias("share"))
    confirmed = ~F.col("family").isin(UNKNOWN, NONE) & (F.col("p") >= LEAST_P) & (F.col("share") >= LEAST_SHARE)
    return compared.withColumn("confirmed", confirmed)


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, family, p, families, n_scanned, n_confirmed of every row.

    family: of the confirmed paragraph with the highest p; `unknown` where a
    paragraph is some licence's but none is confirmed; `none` elsewhere.
    """
    found = scan_paragraphs(docs.select("doc_id", "text"))
    licensed = found.filter(F.col("confirmed") | (F.col("licence") >= LEAST_LICENCE))
    best = F.min(F.when(F.col("confirmed"), F.struct((-F.col("p")).alias("p"), F.col("family"))))
    own = licensed.groupBy(F.col("doc_id").alias("d_")).agg(
        F.coalesce(best["family"], F.lit(UNKNOWN)).alias("family"),
        F.coalesce(-best["p"], F.lit(0.0)).alias("p"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("confirmed"), F.col("family")))), ",").alias("families"),
        F.count("*").alias("n_scanned"),
        F.count_if("confirmed").alias("n_confirmed"),
    )
    out = docs.select("doc_id").join(own, F.col("doc_id").eqNullSafe(F.col("d_")), "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", F.coalesce("family", F.lit(NONE)).alias("family"), F.coalesce("p", F.lit(0.0)).alias("p"), F.coalesce("families", F.lit("")).alias("families"), F.coalesce("n_scanned", zero).alias("n_scanned"), F.coalesce("n_confirmed", zero).alias("n_confirmed"))
