"""Licence scan: a trained paragraph classifier, in DataFrame functions.

Lines, each by itself and, since notices are often wrapped, along with the
words before and behind it up to a line without any (as many as the longest
notice has), are turned into their distinct 1- to 3-word n-grams, joined with
the weights of a sparse multinomial logistic regression and summed; a softmax
gives the family's probability. A family below the calibrated probability is
`unknown`. The prediction is confirmed where the family's closest template has
enough of its word pairs in the paragraph.

Which lines are looked at follows from the weights: the gate is a set of words
such that all n-grams without one of them, taken together, can't lift any
family above `none`. So a line without a gate word is one that the classifier
would pass over, and nothing is lost by not scoring it alone.

The model is fit on the driver from the templates below, cut and mixed with
ordinary words, against a bounded sample of ordinary paragraphs; the scan of
the documents has no Python in it. Weights and templates have a size fixed by
the template list, which is what is broadcast.
"""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

# Licence notices by family.
TEMPLATES: list[tuple[str, str]] = [
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT license, see the LICENSE file."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "This project is released under the Apache 2.0 license."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("gpl", "Licensed under the GPL version 2 or any later version."),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License, version 2.1."),
    ("lgpl", "Released under the LGPL."),
    ("agpl", "This program is licensed under the GNU Affero General Public License, version 3."),
    ("agpl", "Released under the AGPL version 3."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("bsd", "Released under the 3-clause BSD License."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("mpl-2.0", "Licensed under the Mozilla Public License 2.0 (MPL)."),
    ("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted."),
    ("isc", "Released under the ISC License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0."),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0."),
    ("cc0", "Released into the public domain under CC0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Copyright by the author. All rights reserved. No part of this publication may be reproduced without prior written permission."),
    ("proprietary", "Proprietary and confidential. Unauthorized copying of this file is strictly prohibited."),
]
# Sentences with a notice's words that are no notices.
OTHERS = [
    "He lost his driver license on the way home.", "The licensed premises close at midnight.", "Copyright law is a difficult subject.", "She asked for permission to leave the room.",
    "The public domain is a topic of the course.", "A license fee of five euros is due each year.", "Which license should I choose for my project?", "The rights of citizens are reserved to the people.",
    "The warranty ends after two years.", "Redistribution of wealth was the subject of the debate.", "The council licenses street musicians.", "Without prior notice the shop was closed.",
]
NONE = "none"


def tokens(text: str) -> list[str]:
    return [w for w in re.sub(r"[^a-z0-9.]+", " ", text.lower()).replace(". ", " ").rstrip(".").split(" ") if w]


def grams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def pairs_of(words: list[str]) -> set[str]:
    """Word pairs; the words themselves where there is one only."""
    return {" ".join(words[k : k + 2]) for k in range(len(words) - 1)} or set(words)


def like_a_notice(words: list[str], share: float = 0.3) -> bool:
    own = pairs_of(words) | set(words)
    return any(len(t & own) >= share * len(t) for t in map(pairs_of, (tokens(t) for _, t in TEMPLATES)))


def any_word(words: list[str]) -> str:
    """A pattern of these words, letter by letter."""
    by: dict[str, list[str]] = {}
    for w in words:
        by.setdefault(w[:1], []).append(w[1:])
    each = [re.escape(c) + any_word(rest) if c else "" for c, rest in sorted(by.items(), reverse=True)]
    return each[0] if len(each) == 1 else "(?:" + "|".join(each) + ")"


class LicenceModel:
    """Weights of the regression, the probability from which a family is named, and the gate."""

    def __init__(self, ordinary: list[str], *, copies: int = 24, ridge: float = 3e-4, wrong: float = 0.01, paragraph_words: int = 200, seed: int = 5):
        """Ordinary paragraphs that have a good part of a notice's word pairs are left out; ``paragraph_words`` of the others are learned from."""
        rng = random.Random(seed)
        plain = [w[:paragraph_words] for p in ordinary if not like_a_notice(w := tokens(p))] or [["text"]]
        filler = [w for p in plain for w in p] or ["text"]
        known = {g for _, t in TEMPLATES for g in grams(tokens(t))} | {g for t in OTHERS for g in grams(tokens(t))}
        self.families = [NONE, *sorted({f for f, _ in TEMPLATES})]
        rows: list[tuple[set[str], int]] = []
        for k in range(copies):
            for family, t in [*TEMPLATES, *((NONE, t) for t in OTHERS)]:
                own = tokens(t)
                if k and len(own) > 6:  # lose some words at either end
                    own = own[rng.randrange(max(1, len(own) // 6)) :][: rng.randint(max(5, 2 * len(own) // 3), len(own))]
                if k:
                    own = [*rng.choices(filler, k=rng.choice((0, 0, 3, 12))), *own, *rng.choices(filler, k=rng.choice((0, 0, 3, 12)))]
                rows.append((grams(own), self.families.index(family)))
        rows += [(grams(p), 0) for p in plain]
        rng.shuffle(rows)
        self.features = sorted(known)
        at = {g: i for i, g in enumerate(self.features)}
        x = np.zeros((len(rows), len(at) + 1), np.float32)
        y = np.array([f for _, f in rows])
        for r, (own, _) in enumerate(rows):
            x[r, [at[g] for g in own if g in at]] = 1
            x[r, -1] = 1
        fit, held = np.arange(len(rows)) % 4 > 0, np.arange(len(rows)) % 4 == 0
        self.weights = self._fit(x[fit], y[fit], ridge)
        p = self._softmax(x[held] @ self.weights)
        named = p[:, 1:].max(1)
        right = p.argmax(1) == y[held]
        # the least probability above which no more than `wrong` of the held-out notices are given a wrong family
        order = np.argsort(-named)
        bad = np.cumsum(~right[order] & (p.argmax(1)[order] > 0)) / np.arange(1, len(order) + 1)
        fine = np.flatnonzero(bad <= wrong)
        self.least = float(max(0.5, min(0.95, named[order][fine[-1]] if len(fine) else 0.95)))

        self.gate = self._gate(Counter(filler))

    def _gate(self, common: Counter) -> list[str]:
        margin = self.weights[:-1, 1:] - self.weights[:-1, :1]
        gap = self.weights[-1, 0] - self.weights[-1, 1:]
        lifting = [(set(self.features[i].split(" ")), np.maximum(margin[i], 0)) for i in np.flatnonzero(margin.max(1) > 0)]
        gate = {min(words, key=lambda w: (common[w], -len(w), w)) for words, _ in lifting}
        for w in sorted(gate, key=lambda w: (-common[w], w)):  # the commonest go, as long as what is then unseen can't do it alone
            unseen = sum((m for words, m in lifting if not words & (gate - {w})), np.zeros(len(gap)))
            if common[w] and (unseen < gap - 1e-6).all():
                gate.discard(w)
        return sorted(gate) if (gap > 1e-6).all() else []

    def pattern(self) -> str:
        """Of lower-cased lines that may be notices; of all where nothing is certain."""
        return f"(?<![a-z0-9.]){any_word(self.gate)}(?![a-z0-9])" if self.gate else ""

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def _fit(self, x: np.ndarray, y: np.ndarray, ridge: float, rounds: int = 400, rate: float = 2.0) -> np.ndarray:
        goal = np.eye(len(self.families), dtype=np.float32)[y]
        w = np.zeros((x.shape[1], goal.shape[1]), np.float32)
        speed = np.zeros_like(w)
        for _ in range(rounds):
            g = x.T @ (self._softmax(x @ w) - goal) / len(x) + ridge * w
            speed = 0.9 * speed - rate * g
            w += speed * 0.3
        w[abs(w) < 0.01] = 0
        return w

    def probabilities(self, text: str) -> np.ndarray:
        """As the scan has them, in Python; for tests."""
        own = grams(tokens(text))
        z = self.weights[-1] + sum((self.weights[i] for i, g in enumerate(self.features) if g in own), np.zeros(len(self.families)))
        return self._softmax(z[None])[0]


def learn(docs: DataFrame, *, sample_docs: int = 200, sample_chars: int = 4000, sample_paragraphs: int = 1500, id_col: str = "doc_id", text_col: str = "text") -> LicenceModel:
    """Fit with ordinary paragraphs from the first ``sample_chars`` characters of ``sample_docs`` documents, those with the least hashes."""
    own = docs.where(F.col(text_col).isNotNull()).select(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    chosen = own.select("h").orderBy("h").limit(sample_docs).distinct()
    rows = own.join(F.broadcast(chosen), "h").groupBy("h").agg(F.min(F.substring("text", 1, sample_chars)).alias("text")).collect()
    return LicenceModel([p for r in sorted(rows) for p in r["text"].split("\n") if p.strip()][:sample_paragraphs])


def _words(paragraph: Column) -> Column:
    text = F.regexp_replace(F.lower(paragraph), r"[^a-z0-9.]+", " ")
    text = F.rtrim(F.replace(text, F.lit(". "), F.lit(" ")))
    return F.filter(F.split(F.regexp_replace(text, r"\.+$", ""), " "), lambda w: w != "")


def _grams(words: Column, n: int) -> Column:
    count = F.size(words) - (n - 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def scan_licences(docs: DataFrame, model: LicenceModel, *, confirm: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence notices: ``id_col``, paragraph (from 0), family, probability, template, similarity, confirmed.

    A row for each line that the model takes for a notice, and for each notice
    that only a line and its neighbours confirm: it stands at its first line
    with a word of the gate, in place of what its lines give alone, and once for
    equal notices in reach of one another.
    ``family`` is `unknown` below the calibrated probability; ``template`` is
    the closest notice of the most probable family, ``similarity`` the share of
    its word pairs (words, if it has one only) that the line has.

    Null and empty texts have no rows. Equal rows (id, place and text) are
    reported once; rows with null ids are kept. A line of any length is one
    paragraph. Empty tables give an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    n = len(model.families)
    reach = max(len(tokens(t)) for _, t in TEMPLATES)  # a line has a word or ends the notice, so so many lines suffice
    gate = model.pattern()
    split = docs.where(F.lower(F.col(text_col)).rlike(gate)).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.split(F.col(text_col), "\n").alias("lines"))
    at = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: F.lower(F.get("lines", i)).rlike(gate))
    before = lambda i: F.array_join(F.slice("lines", F.greatest(F.lit(1), i + 1 - reach), F.least(i, F.lit(reach))), "\n")
    own = F.transform(at, lambda i: F.struct(i.alias("paragraph"), F.get("lines", i).alias("line"), before(i).alias("before"), F.array_join(F.slice("lines", i + 2, F.lit(reach)), "\n").alias("after")))
    lines = split.select("id", "h", F.explode(own).alias("l")).select("id", "h", "l.*")
    blank, closed = "\n[^A-Za-z0-9\n]*\n", lambda c: F.concat(F.lit("\n"), c, F.lit("\n"))
    lines = lines.withColumn("before", F.element_at(F.split(closed(F.col("before")), blank), -1)).withColumn("after", F.split(closed(F.col("after")), blank)[0])
    count = lambda c: F.size(F.filter(F.split(c, "\n"), lambda x: x != ""))
    lines = lines.select("id", "paragraph", "h", (F.col("paragraph") - count("before")).alias("from"), (F.col("paragraph") + count("after")).alias("to"), _words(F.col("line")).alias("words"), _words(F.col("before")).alias("b"), _words(F.col("after")).alias("a"))
    lines = checkpointed(lines.dropDuplicates(["id", "paragraph", "h"]))  # few lines have a gate word; the texts are read once
    around = F.concat(F.slice("b", F.greatest(F.lit(1), F.size("b") - reach + 1), F.lit(reach)), "words", F.slice("a", 1, reach))
    words = lines.select("id", "paragraph", "h", F.lit(False).alias("wide"), "words").unionByName(lines.where("from < to").select("id", "paragraph", "h", F.lit(True).alias("wide"), around.alias("words")))
    weights = spark.createDataFrame([(g, *map(float, model.weights[i])) for i, g in enumerate(model.features) if model.weights[i].any()], "gram string, " + ", ".join(f"w{k} double" for k in range(n)))
    each = words.select("id", "paragraph", "h", "wide", F.explode(F.array_distinct(F.concat(*(_grams(F.col("words"), k) for k in (1, 2, 3))))).alias("gram"))
    # a notice has known n-grams: a line without any falls to the constants, where `none` leads
    sums = each.join(F.broadcast(weights), "gram").groupBy("id", "paragraph", "h", "wide").agg(*(F.sum(f"w{k}").alias(f"s{k}") for k in range(n)))
    scores = [F.col(f"s{k}") + F.lit(float(model.weights[-1][k])) for k in range(n)]
    top = F.greatest(*scores)
    named = F.greatest(*scores[1:])
    family = F.coalesce(*(F.when(scores[k] == named, F.lit(model.families[k])) for k in range(1, n)))
    probability = F.exp(named - top) / sum((F.exp(s - top) for s in scores[1:]), F.exp(scores[0] - top))
    found = sums.where(named > scores[0]).select("id", "paragraph", "h", "wide", family.alias("likely"), probability.alias("probability"))

    templates = []
    for i, (f, t) in enumerate(TEMPLATES):
        own = tokens(t)
        templates.append((f, i, t, sorted(pairs_of(own))))
    templates = spark.createDataFrame(templates, "likely string, no int, template string, pairs array<string>")
    pairs = words.select("id", "paragraph", "h", "wide", F.array_distinct(F.concat(_grams(F.col("words"), 1), _grams(F.col("words"), 2))).alias("own"))
    same = found["id"].eqNullSafe(pairs["id"]) & (found["paragraph"] == pairs["paragraph"]) & (found["h"] == pairs["h"]) & (found["wide"] == pairs["wide"])
    held = found.join(pairs, same).select(found["id"], found["paragraph"], found["h"], found["wide"], "likely", "probability", "own").join(F.broadcast(templates), "likely")
    share = F.size(F.array_intersect("own", "pairs")) / F.size("pairs")
    best = F.max(F.struct(share.alias("similarity"), (-F.col("no")).alias("no"), "template")).alias("best")
    held = held.groupBy("id", "paragraph", "h", "wide", "likely", "probability").agg(best)
    unknown = F.col("probability") < F.lit(model.least)
    held = checkpointed(held.withColumn("confirmed", (F.col("best.similarity") >= confirm) & ~unknown).withColumn("t", F.col("best.no")))

    def without(some: DataFrame, others: DataFrame, *more: Column) -> DataFrame:
        own = F.col("s.id").eqNullSafe(F.col("o.id")) & (F.col("s.h") == F.col("o.h"))
        for m in more:
            own = own & m
        return some.alias("s").join(others.alias("o"), own, "left_anti")

    alone, same = held.where("NOT wide"), F.col("s.t") == F.col("o.t")
    wide = held.where("wide AND confirmed").alias("w").join(lines.alias("l"), F.col("w.id").eqNullSafe(F.col("l.id")) & (F.col("w.h") == F.col("l.h")) & (F.col("w.paragraph") == F.col("l.paragraph"))).select("w.*", "from", "to")
    # a line's neighbours aren't its own notice where one of them is confirmed as that, nor is its own notice theirs
    wide = checkpointed(without(wide, alone.where("confirmed"), same, F.col("o.paragraph").between(F.col("s.from"), F.col("s.to"))))
    alone = without(alone, wide, F.col("s.paragraph") == F.col("o.paragraph"), ~F.col("s.confirmed"))
    first = without(wide, wide, same, F.col("o.paragraph") >= F.col("s.from"), F.col("o.paragraph") < F.col("s.paragraph"))
    held = alone.unionByName(first.select(*alone.columns))
    out = held.select(F.col("id").alias(id_col), "paragraph", F.when(unknown, F.lit("unknown")).otherwise(F.col("likely")).alias("family"), "probability", F.col("best.template").alias("template"), F.col("best.similarity").alias("similarity"), "confirmed")
    return out.distinct()
