"""Licence notices, found by a trained paragraph classifier.

A paragraph is what stands between blank lines or line ends that close a sentence, so a notice that is wrapped over lines is one
paragraph, and a line that is a sentence of its own is one too. White space is folded, case ignored. Its features are its word n-grams
of one to three words that hold an anchor, a stem such as `licen` or `apache`. A sparse multinomial logistic regression gives each
family a probability, and the unknown class one. It is trained on notices composed from the families' names and usual phrases; for the
unknown class on the same phrases with the names of other licences, on sentences that mention licences and grant none, and on
paragraphs of the corpus that hold an anchor but name no family. The unknown class is calibrated on folds that the weights have not
seen: forms of notices, and whole licences of the others. A prediction counts as confirmed if the paragraph holds enough of the
n-grams of one of the family's templates or names; what is not confirmed is given as unknown.

A paragraph without an anchor has no feature, so its scores are the biases, of which the unknown class has the largest: fit() makes
sure of it. Texts without any anchor are therefore left before they are cut, which loses nothing. Scoring is SQL only.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NGRAMS = 3
#: Bound of the fit: documents of the corpus whose paragraphs may train the unknown class.
FIT_DOCS = 3000
#: Where a paragraph ends: at blank lines, and at a line end after a sentence.
BREAK = r"\n[ \t\r]*\n\s*|(?<=[.!?])[ \t\r]*\n"
WORD = r"[a-z0-9.]*[a-z0-9]"

# Stems that a licence notice holds, the licences' names and identifiers, and their publishers' recommended notices.
ANCHORS = ["licen", "copyright", "waive", "permission", "redistribut", "apache", "gnu", "gpl", "bsd", "mozilla", "mpl", "commons", "cc0", "cc by", "cc-by", "spdx", "expat"]
NAMES: dict[str, list[str]] = {
    "MIT": ["MIT", "Expat"],
    "Apache-2.0": ["Apache-2.0", "Apache 2.0", "Apache License, Version 2.0", "Apache License 2.0"],
    "GPL-3.0": ["GPL-3.0", "GPL v3", "GPL v3+", "GPL-3.0-only", "GPL-3.0-or-later", "GPLv3", "GPL version 3", "GPL, version 3 or later", "GNU GPL v3", "GNU General Public License, version 3", "GNU General Public License v3.0"],
    "GPL-2.0": ["GPL-2.0", "GPL v2", "GPL v2+", "GPL-2.0-only", "GPL-2.0-or-later", "GPLv2", "GPL version 2", "GPL, version 2 or later", "GNU GPL v2", "GNU General Public License, version 2", "GNU General Public License v2.0"],
    "LGPL": ["LGPL-2.1-only", "LGPL-3.0-or-later", "LGPLv2.1", "LGPLv3", "LGPL, version 2.1", "GNU LGPL", "GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License"],
    "BSD": ["BSD-3-Clause", "BSD-2-Clause", "BSD", "BSD 3-Clause", "BSD 2-Clause", "New BSD", "Simplified BSD"],
    "MPL-2.0": ["MPL-2.0", "MPL 2.0", "MPL 2", "MPL v2", "Mozilla Public License, Version 2.0", "Mozilla Public License 2.0"],
    "CC-BY": ["CC-BY-4.0", "CC BY 4.0", "CC BY 3.0", "Creative Commons Attribution", "Creative Commons Attribution 4.0 International"],
    "CC-BY-SA": ["CC-BY-SA-4.0", "CC BY-SA 4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike", "Creative Commons Attribution-ShareAlike 4.0 International"],
    "CC-BY-NC": ["CC-BY-NC-4.0", "CC BY-NC 4.0", "CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial", "Creative Commons Attribution-NonCommercial 4.0 International"],
    "CC0": ["CC0-1.0", "CC0", "CC0 1.0 Universal", "Creative Commons Zero v1.0"],
    "ISC": ["ISC"],
}
TEMPLATES: dict[str, list[str]] = {
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."],
    "GPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "GPL-2.0": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "Dedicated to the public domain under CC0.", "Public domain (CC0)."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
}
#: Names of licences outside the families.
FOREIGN = [
    "Eclipse Public License 2.0", "EPL-2.0", "European Union Public Licence 1.2", "EUPL-1.2", "Boost Software License 1.0", "BSL-1.0", "GNU Affero General Public License, version 3", "AGPL-3.0", "Artistic License 2.0",
    "zlib License", "Unlicense", "WTFPL", "CDDL-1.0", "Common Development and Distribution License", "SIL Open Font License 1.1", "OFL-1.1", "PostgreSQL License", "Open Database License", "ODbL-1.0", "Python Software Foundation License",
    "Business Source License 1.1", "Server Side Public License", "SSPL-1.0", "Elastic License 2.0", "Microsoft Public License", "MS-PL", "proprietary license", "commercial licence of the vendor", "end user license agreement", "GNU Free Documentation License",
]
# End of fixed values.

#: How notices are worded: {0} is a name, {1} a work.
FORMS = [
    "Released under the {0} License.", "Licensed under the {0} License.", "Licensed under {0}.", "Released under {0}.", "Available under the {0}.", "{0} License", "{0} licence", "License: {0}",
    "SPDX-License-Identifier: {0}", "This {1} is licensed under the {0}.", "This {1} is licensed under the terms of the {0} license.", "This {1} is distributed under the terms of the {0} licence.",
    "This {1} is made available under the {0} licence.", "The {1} is released under the terms of the {0}.", "The {1} is covered by the {0} License.", "See the {0} license for details.",
    "Distributed under the {0} license.", "You may use this {1} under the {0}.", "{0} licensed.", "Dual licensed under {0} and a commercial license.",
    "{1} is {0} licensed.", "{0} applies.", "License text: {0}", "Use of this {1} is governed by the {0}.",
]
WORKS = ["code", "project", "software", "library", "work", "file", "document", "package"]
#: Sentences near to notices that are none: who does what to which thing.
SUBJECTS = ["You need", "He lost", "She renewed", "They revoked", "The court suspended", "Ask for", "Nobody showed", "The shop applied for", "We waited for"]
THINGS = ["a licence to drive this car", "the fishing license", "a license for the bar", "written permission from the school", "permission to enter", "the copyright of the song", "copyright law", "the house of commons", "a driving licence, version 2.0", "the redistribution of wealth", "a licensed plumber", "the terms of the license"]
MENTIONS = [f"{a} {b}." for a, b in product(SUBJECTS, THINGS)] + [
    text.format(name) for text in ("{} is an operating system.", "He works for {}.", "The {} conference was held in May.", "She studied at {} before she got her license.", "{} has a long history.", "{} is older than the web.") for name in ("BSD", "MIT", "Apache", "GNU", "ISC", "Mozilla", "The GPL committee")
] + [
    "All rights reserved.", "Copyright 2020 the authors. All rights reserved.", "A gnu stood by the river.", "The Apache helicopter landed.", "The Apache lived in the south west.", "The general public may attend, version 3 follows.",
    "No part of this book may be reproduced without permission of the publisher.", "The license was revoked.", "See the license for the terms of use.", "The commons voted on the bill.", "Our license server is down, try version 2.0 of the client.",
    "Licensed to the ASF under one or more contributor license agreements.", "See the NOTICE file distributed with this work for information regarding copyright ownership.", "Contributors sign a license agreement first.", "Licensed premises.",
    "The MIT campus is in Cambridge; parking needs a permission.", "A member of the public asked for a license.",
]


def _words(text: str) -> list[str]:
    return re.findall(WORD, text.lower())


def _all_grams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in range(1, NGRAMS + 1) for i in range(len(words) - n + 1)}


def anchored(gram: str) -> bool:
    return any(a in gram for a in (*ANCHORS, "cc 0")) or bool(re.search(r"\bcc\b", gram))


def _features(text: str) -> set[str]:
    """None for a text without an anchor; else its n-grams that hold one."""
    return {g for g in _all_grams(_words(text)) if anchored(g)} if any(a in text.lower() for a in ANCHORS) else set()


@dataclass
class Model:
    families: list[str]
    weights: dict[str, list[float]]
    bias: list[float]

    def gap(self, text: str) -> tuple[str, float]:
        """The likeliest family, and how far its logit stands above that of the unknown class."""
        z = np.array(self.bias) + sum((np.array(self.weights[g]) for g in _features(text) if g in self.weights), np.zeros(len(self.bias)))
        k = int(z[:-1].argmax())
        return self.families[k], float(z[k] - z[-1])


def notices() -> list[tuple[str, int, int]]:
    """(text, family, group): composed and recommended notices. Groups are what folds are made of: one form in all its names."""
    out = []
    for k, family in enumerate(NAMES):
        for i, name in enumerate(NAMES[family]):
            for j, form in enumerate(FORMS):
                text = re.sub(r"(?i)(licen[sc]e[^.]*?) licen[sc]e\b", r"\1", form.format(name, WORKS[(i + j + k) % len(WORKS)]))
                out += [(text, k, j), (text.replace("icense", "icence") if "icense" in text else text.replace("icence", "icense"), k, j)]
        for j, text in enumerate(TEMPLATES[family]):
            words = text.split()
            out += [(text, k, len(FORMS) + j)] * 4
            out += [(" ".join(words[: len(words) // 2]), k, len(FORMS) + j), (" ".join(words[: 2 * len(words) // 3]), k, len(FORMS) + j)]
    return [x for x in out if _features(x[0])]


def foreign_notices() -> list[tuple[str, int, int]]:
    """(text, class, group): the same forms with the names of other licences, all of the unknown class. A group is a licence, so the
    folds that calibrate the class have not seen it in any form."""
    out = [(re.sub(r"(?i)(licen[sc]e[^.]*?) licen[sc]e\b", r"\1", form.format(name, WORKS[(i + j) % len(WORKS)])), len(NAMES), i) for i, name in enumerate(FOREIGN) for j, form in enumerate(FORMS)]
    return [x for x in out if _features(x[0])]


def _regress(x: np.ndarray, y: np.ndarray, l1: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by proximal gradient steps with momentum; classes count the same."""
    share = 1 / np.maximum(y.sum(0), 1)[y.argmax(1)]
    share /= share.sum()
    x, y, share = x.astype(np.float32), y.astype(np.float32), share.astype(np.float32)
    turned = np.ascontiguousarray(x.T)
    w, b = np.zeros((x.shape[1], y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    at, bt, t = w, b, np.float32(1.0)
    rate = np.float32(4.0 / max(1.0, float((x.sum(1) * share).sum())))
    l1 = np.float32(l1)
    for _ in range(steps):
        z = x @ at + bt
        p = np.exp(z - z.max(1, keepdims=True))
        d = (p / p.sum(1, keepdims=True) - y) * share[:, None]
        new = at - rate * (turned @ d)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
        bias = bt - rate * d.sum(0)
        nt = np.float32((1 + (1 + 4 * t * t) ** 0.5) / 2)
        at, bt, t = new + (t - 1) / nt * (new - w), bias + (t - 1) / nt * (bias - b), nt
        w, b = new, bias
    return w.astype(float), b.astype(float)


def fit(lines: list[str], l1: float = 2e-5, steps: int = 400, folds: int = 4) -> Model:
    """lines: paragraphs of the corpus that stand for the unknown class, beside MENTIONS. They may be none."""
    names = list(NAMES)
    texts = notices() + foreign_notices() + [(t, len(names), k) for k, t in enumerate([*MENTIONS, *lines])]
    held = [_features(t) for t, *_ in texts]
    often: dict[str, int] = {}
    for h, (_, k, _) in zip(held, texts):
        for g in h:
            often[g] = often.get(g, 0) + 1
    place = {g: i for i, g in enumerate(sorted(g for g, n in often.items() if n > 1))}
    x = np.zeros((len(texts), len(place)))
    for r, h in enumerate(held):
        x[r, [place[g] for g in h if g in place]] = 1
    kind, group = np.array([k for _, k, _ in texts]), np.array([j for *_, j in texts])
    y = np.eye(len(names) + 1)[kind]
    known, gap = kind < len(names), np.zeros(len(texts))
    for f in range(folds):
        own = group % folds == f
        w, b = _regress(x[~own], y[~own], l1, steps)
        z = x[own] @ w + b
        gap[own] = z[:, :-1].max(1) - z[:, -1]
    # where the fewest of the texts that the fold had not seen fall on the wrong side, classes counting the same
    cuts = np.unique(gap)
    middle = np.r_[cuts[0] - 1, (cuts[1:] + cuts[:-1]) / 2, cuts[-1] + 1]
    wrong = [(gap[known] < c).mean() + (gap[~known] >= c).mean() for c in middle]
    w, b = _regress(x, y, l1, steps)
    b[-1] += float(np.median(middle[np.flatnonzero(np.array(wrong) <= min(wrong) + 1e-12)]))
    b[-1] = max(b[-1], b[:-1].max() + 1.0)  # no feature: unknown
    return Model(names, {g: w[i].round(4).tolist() for g, i in place.items() if np.abs(w[i]).max() > 0.01}, b.round(4).tolist())


def _has_anchor(lowered: Column) -> Column:
    found = F.lit(False)
    for a in ANCHORS:
        found = found | lowered.contains(a)
    return found


def _paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, paragraph, line): the paragraphs, in lower case, that hold an anchor, of the texts that do."""
    t = docs.select(F.col(id_col), F.lower(F.col(text_col).cast("string")).alias("t")).where(_has_anchor(F.col("t")))
    return t.select(id_col, F.posexplode(F.split("t", BREAK)).alias("paragraph", "line")).where(_has_anchor(F.col("line")))


def train(docs: DataFrame, most: int = FIT_DOCS) -> Model:
    """A model whose unknown class has seen the corpus: of the documents first in hashed order, `most` at most, one paragraph each that
    holds an anchor, but no name of a family and no three words of a template. Null ids, null texts and empty tables give none; a
    document that is there twice counts once. Of a document's paragraphs the first in the alphabet is taken, and only those of up to
    400 characters are looked at: longer ones do not stand for the unknown class. scan() has no such bound. Repeated lines count
    each; ties do not matter, as lines are sorted."""
    h = F.xxhash64("doc_id")
    ids = docs.where(F.col("doc_id").isNotNull()).select("doc_id").orderBy(h, "doc_id").limit(most).distinct().collect()
    chosen = docs.select("doc_id", "text").join(F.broadcast(docs.sparkSession.createDataFrame(ids, docs.select("doc_id").schema)), "doc_id", "left_semi")
    got = _paragraphs(chosen, "doc_id", "text").where("length(line) <= 400").groupBy("doc_id").agg(F.min("line").alias("line")).collect()  # `most` at most
    named = {w for names in NAMES.values() for n in names for w in _words(n) if anchored(w) or len(w) <= 3 and w.isalpha()} | {"mit", "isc"}
    phrases = {g for texts in TEMPLATES.values() for t in texts for g in _all_grams(_words(t)) if g.count(" ") == 2}
    lines = sorted(r["line"] for r in got)
    return fit([x for x in lines if not named & set(_words(x)) - {"license", "licence", "the"} and not phrases & _all_grams(_words(x))])


def _grams_of(w: Column, n: int) -> Column:
    long = F.transform(F.slice(w, 1, F.greatest(F.size(w) - (n - 1), F.lit(0))), lambda x, i: F.concat_ws(" ", *(F.get(w, i + k) for k in range(n))))
    return F.when(F.size(w) >= n, long).otherwise(F.array().cast("array<string>"))


def _literal(value: object, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def scan(docs: DataFrame, model: Model, sure: float = 0.5, alike: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, paragraph, family, predicted, probability, similarity, confirmed) of each paragraph that is taken for a notice. family is the
    predicted one if it is confirmed, else `unknown`.

    Paragraphs of the whole text are numbered from 0. similarity: the largest share of a template's or of a composed notice's
    n-grams that the paragraph holds, over the family's own; confirmed: it is at least `alike`. Null and empty texts have no
    notice; repeated rows and null ids give rows of their own; of families of equal probability the first in the model's order is
    taken. Only the two named columns are read, so others may have any name. No shuffle.
    """
    at = _paragraphs(docs, id_col, text_col)
    at = at.select(id_col, "paragraph", F.regexp_extract_all("line", F.lit(WORD), F.lit(0)).alias("w"))
    grams = F.concat(*(_grams_of(F.col("w"), n) for n in range(1, NGRAMS + 1)))
    at = at.select(id_col, "paragraph", F.explode(F.array(F.array_distinct(grams))).alias("all"))
    vocabulary = _literal(sorted(model.weights), "array<string>")
    at = at.select(id_col, "paragraph", "all", F.explode(F.array(F.array_intersect("all", vocabulary))).alias("g")).where(F.size("g") > 0)
    weights = _literal(model.weights, "map<string,array<double>>")
    start = _literal(model.bias, "array<double>")
    at = at.select(id_col, "paragraph", "all", F.explode(F.array(F.aggregate("g", start, lambda s, g: F.zip_with(s, F.element_at(weights, g), lambda a, b: a + b)))).alias("z"))
    top = F.array_max("z")
    at = at.select(id_col, "paragraph", "all", F.explode(F.array(F.transform("z", lambda z: F.exp(z - top)))).alias("e"))
    at = at.select(id_col, "paragraph", "all", (F.array_position("e", 1.0) - 1).cast("int").alias("best"), (F.lit(1.0) / F.aggregate("e", F.lit(0.0), lambda s, e: s + e)).alias("probability"))
    at = at.where((F.col("best") < len(model.families)) & (F.col("probability") >= sure))
    own = F.get(_literal([_examples(f) for f in model.families], "array<array<array<string>>>"), F.col("best"))
    similar = F.array_max(F.transform(own, lambda t: F.size(F.array_intersect("all", t)) / F.size(t)))
    at = at.select(id_col, "paragraph", F.get(_literal(model.families, "array<string>"), F.col("best")).alias("predicted"), "probability", similar.alias("similarity"))
    family = F.when(F.col("similarity") >= alike, F.col("predicted")).otherwise("unknown").alias("family")
    return at.select(id_col, "paragraph", family, "predicted", "probability", "similarity", (F.col("similarity") >= alike).alias("confirmed"))


def _examples(family: str) -> list[list[str]]:
    """The n-grams of what a prediction is compared with: the family's templates, and its names in a few wordings."""
    short = [form.format(name) for name in NAMES[family] for form in ("licensed under the {0} license", "licensed under {0}", "SPDX-License-Identifier: {0}", "{0} license")]
    short += [name for name in NAMES[family] if len(_words(name)) > 1]
    return [sorted(_all_grams(_words(t))) for t in [*TEMPLATES[family], *short]]


def op7_paragraph_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan(docs, train(docs)).withColumn("probability", F.round("probability", 6)).withColumn("similarity", F.round("similarity", 6))
