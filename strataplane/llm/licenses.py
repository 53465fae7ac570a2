"""Licence scans: a sparse n-gram logistic regression over paragraphs, confirmed by templates.

The model is fitted on a labelled table of notices and ordinary sentences with
an L1 penalty, so few n-grams have a weight.  Paragraphs are scored as a join
of their n-grams with the weights, each distinct paragraph once; a calibrated
class stands for notices of no known family, and a predicted family must also
hold much of one of its templates.

Which paragraphs need scoring follows from the weights: one without any of the
n-grams of ``Model.needed`` can't outscore class ``none`` (see ``needed_grams``).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataplane.llm.common import BROADCAST_BYTES, Scratch, let

NONE, UNKNOWN = "none", "unknown"

#: The labelled table: ways to say that a licence holds, names of licences by family, and whole sentences by family.
SAYINGS = (
    "Licensed under {}", "Released under {}", "Distributed under {}", "This work is licensed under {}", "This project is licensed under the terms of {}", "This software is made available under {}",
    "Text is available under {}", "Shared under {}", "You may use this file under {}", "See the LICENSE file, {}", "The code is under {} and the docs too", "License: {}",
)
NAMES = {
    "MIT": ("the MIT License", "the MIT license", "the terms of the MIT/X11 License", "SPDX-License-Identifier: MIT"),
    "Apache-2.0": ("the Apache License, Version 2.0", "the Apache License 2.0", "Apache 2.0", "SPDX-License-Identifier: Apache-2.0"),
    "GPL": ("the GNU General Public License, version 3", "the GNU General Public License version 2 or later", "the GNU GPL", "the GPLv3", "the GPLv2", "the GPL", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "LGPL": ("the GNU Lesser General Public License, version 3", "the GNU LGPL", "the LGPL 2.1", "the LGPLv3", "SPDX-License-Identifier: LGPL-2.1-only"),
    "AGPL": ("the GNU Affero General Public License, version 3", "the GNU AGPL", "the AGPLv3", "SPDX-License-Identifier: AGPL-3.0-only"),
    "BSD": ("the BSD License", "the 3-Clause BSD License", "the 2-clause BSD license", "a BSD-style license", "SPDX-License-Identifier: BSD-3-Clause"),
    "MPL-2.0": ("the Mozilla Public License, v. 2.0", "the Mozilla Public License 2.0", "the MPL 2.0", "SPDX-License-Identifier: MPL-2.0"),
    "CC-BY-NC": ("CC BY-NC 4.0", "CC BY-NC-SA 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License", "the Creative Commons Attribution-NonCommercial-ShareAlike License"),
    "CC-BY": ("CC BY 4.0", "CC BY-SA 4.0", "CC-BY 3.0", "a Creative Commons Attribution 4.0 International License", "the Creative Commons Attribution-ShareAlike License"),
    "CC0": ("CC0 1.0", "the CC0 public domain dedication", "the Unlicense"),
    UNKNOWN: ("the Foo Community License, version 7", "the Example Research License", "the terms of the accompanying agreement", "the Acme Open License", "a license of its own", "the house license", "the Bar Public License", "a custom license", "the Qux Source License 1.0", "the Delta Public License", "the Kappa General License, v1.1"),
}
SENTENCES = {
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "The software is provided as is, without warranty of any kind, express or implied, including the warranties of merchantability",
    ),
    "Apache-2.0": (
        "you may not use this file except in compliance with the License",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "software distributed under the License is distributed on an AS IS BASIS, without warranties or conditions of any kind",
    ),
    "GPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
        "You should have received a copy of the GNU General Public License along with this program",
    ),
    "LGPL": ("This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License", "You should have received a copy of the GNU Lesser General Public License along with this library"),
    "AGPL": ("You should have received a copy of the GNU Affero General Public License along with this program", "free software under the terms of the GNU Affero General Public License"),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "If a copy of the MPL was not distributed with this file, You can obtain one at mozilla.org"),
    "CC-BY-NC": ("You may share and adapt this work for noncommercial purposes with attribution under Creative Commons",),
    "CC-BY": ("You are free to share and adapt this work under CC BY-SA 4.0", "You are free to share this work if you give attribution under Creative Commons Attribution"),
    "CC0": (
        "To the extent possible under law, the author has waived all copyright and related rights to this work",
        "This is free and unencumbered software released into the public domain",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software",
        "This work is in the public domain",
    ),
    "Proprietary": (
        "All rights reserved",
        "Copyright 2020 Example Inc. All rights reserved",
        "This document is confidential and proprietary and may not be copied or distributed without written permission",
        "No part of this publication may be reproduced without the prior written permission of the publisher",
        "Unauthorized copying of this file is strictly prohibited",
    ),
    UNKNOWN: ("See the license file for details", "Use is subject to license terms", "License terms apply", "Licensed to the company under one or more contributor agreements", "Released under a license"),
    NONE: (
        "The driver's license was issued in the spring of last year",
        "She reserved a table for the rights group and left",
        "His licensed practice opened under a new version of the rules",
        "The general public was free to visit the library and the source of the river",
        "The team released a new version of the program to the public",
        "A copy of the letter was found in the file under the desk",
        "He was granted permission to use the software for any purpose at work",
        "Artistic license lets a writer change the order of events",
        "The bar lost its liquor license after the inspection",
        "All seats are reserved and all guests have been told",
        "They work under pressure and without any warranty of success",
        "The attribution of the painting is not certain",
        "Apache helicopters flew over the public square",
        "Students at MIT released the results of their work",
        "You are free to go, and the work is done for the day",
        "The software runs on any computer and the file is saved in the folder",
        "This notice was included in all copies of the paper, and the conditions were met",
        "The author of the book may not use the house, and nobody is permitted to sell it",
        "The commons voted, the creative arts were funded, and the domain of the king grew",
        "Version 2.0 of the form is subject to change and you can obtain one at the office",
        "The following list of conditions was read to the person on the first of May",
        "It was distributed to the members in source and in print along with the program",
        "The licence plate of the car was public and the licensed driver was not at home",
        "A fishing license costs ten dollars a year at the town hall",
        "The license of the pilot was lost in the fire",
        "Poetic license let her bend the rules of grammar",
        "A dog license, a marriage license and a hunting license were on the desk",
        "In no event was the holder of the cup liable for damages to the copyright office",
    ),
}
#: The texts that predictions are compared with, by family: what a notice of the family says, whole.
TEMPLATES = {
    "MIT": ("MIT License", "MIT X11 License", "Identifier MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy", "The above copyright notice and this permission notice shall be included in all copies", "The software is provided as is, without warranty of any kind"),
    "Apache-2.0": ("Apache License", "Apache 2.0", "You may not use this file except in compliance with the License", "obtain a copy of the License at http://www.apache.org/licenses", "distributed on an AS IS BASIS, without warranties or conditions"),
    "GPL": ("GNU General Public License", "GNU GPL", "the GPLv3", "the GPLv2", "the GPL", "Identifier GPL"),
    "LGPL": ("GNU Lesser General Public License", "GNU LGPL", "LGPL 2.1", "the LGPLv3", "the LGPL", "Identifier LGPL"),
    "AGPL": ("GNU Affero General Public License", "GNU AGPL", "the AGPLv3", "the AGPL", "Identifier AGPL"),
    "BSD": ("BSD License", "BSD style", "Clause BSD", "BSD 3", "BSD 2", "Redistribution and use in source and binary forms, with or without modification", "Redistributions of source code must retain the above copyright notice", "Redistributions in binary form must reproduce the above copyright notice"),
    "MPL-2.0": ("Mozilla Public License", "MPL 2.0", "copy of the MPL"),
    "CC-BY-NC": ("BY-NC", "Attribution NonCommercial", "noncommercial purposes"),
    "CC-BY": ("CC BY", "Commons Attribution"),
    "CC0": ("CC0 1.0", "the CC0", "the Unlicense", "public domain", "waived all copyright and related rights", "free and unencumbered software", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    "Proprietary": ("All rights reserved", "confidential and proprietary", "No part of this publication may be reproduced", "without the prior written permission", "copying of this file is strictly prohibited"),
}
FAMILIES = (*TEMPLATES, UNKNOWN, NONE)
#: Words that are no n-gram alone, nor in pairs with each other; nor is a single letter or digit.
COMMON = frozenset("a all an and any are as at be been by can do for from he if in is it its may must no not of on one or out shall she so subject that the their them they this to under use used using was we were will with without you your".split())
#: Rows without any known n-gram, of class none: they set how much evidence the other classes need.
EMPTY_ROWS = 20
#: Least probability of a family, and least share of a template's word pairs that the paragraph holds.
CERTAIN, CONFIRM = 0.5, 0.5
#: A line goes on in the next one unless it is blank or ends a sentence, or the next one is blank; the joining newline becomes a space.
JOINED, JOINED_BY = r"([^ \t\r\n.!?:;])([ \t\r]*+)\n(?=[ \t\r]*+[^ \t\r\n])", "$1$2 "


def labelled() -> list[tuple[str, str]]:
    """(notice, class) of the labelled table."""
    rows = [(say.format(name), f) for f, names in NAMES.items() for name in names for say in SAYINGS]
    for f, lines in SENTENCES.items():
        for line in lines:
            w = line.split()
            # halves stand for notices that are broken off
            rows += [(" ".join(part), f) for part in ((w, w[: len(w) // 2], w[len(w) // 2 :]) if len(w) >= 10 else (w,))]
    return rows


def grams_of(text: str) -> list[str]:
    """The distinct words and word pairs of a text, as the columns of ``classify`` have them."""
    w = [x for x in re.split(r"[^a-z0-9]+", text.lower()) if x]
    alone = (x for x in w if len(x) > 1 and x not in COMMON)
    return sorted({*alone, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False) if not {a, b} <= COMMON)})


@dataclass(frozen=True)
class Model:
    weights: tuple[tuple[str, str, float], ...]  # n-gram, class, weight
    bias: dict[str, float]
    templates: tuple[tuple[str, tuple[str, ...]], ...]  # family, word pairs
    needed: tuple[str, ...]


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _fit(x: np.ndarray, y: np.ndarray, share: np.ndarray, rounds: int = 500, l1: float = 2e-4) -> np.ndarray:
    """Multinomial logistic regression with an L1 penalty, by proximal gradient steps with momentum; the last row is the bias."""
    x = np.column_stack([x, np.ones(len(x))])
    want = np.eye(len(FAMILIES))[y]
    step = 4.0 / np.max((x * x).sum(axis=1))
    w = ahead = np.zeros((x.shape[1], len(FAMILIES)))
    t = 1.0
    for _ in range(rounds):
        new = ahead - step * (x.T @ (share[:, None] * (_softmax(x @ ahead) - want)))
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * l1, 0)
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead = new + (before - 1) / t * (new - w)
        w = new
    return w


def needed_grams(names: list[str], w: np.ndarray) -> list[str]:
    """N-grams of which a paragraph needs at least one to be of another class than ``none``.

    For class f, a paragraph's lead over none is bias_f - bias_none plus the
    leads of its n-grams.  N-grams are left out while the positive leads of all
    those left out together stay below bias_none - bias_f, for every f: a
    paragraph that holds only left out ones has no class ahead of none.
    """
    none = FAMILIES.index(NONE)
    lead = np.maximum(w[:-1] - w[:-1, [none]], 0)
    gap = w[-1, none] - np.delete(w[-1], none)
    if gap.min() <= 0:
        raise ValueError("a paragraph without known n-grams would not be of class none")
    spare = np.delete(lead, none, axis=1) / gap  # shares of each class's gap
    used = np.zeros(spare.shape[1])
    out = []
    for i in np.argsort(spare.max(axis=1), kind="stable"):
        if (used + spare[i]).max() < 0.999:
            used += spare[i]
        else:
            out.append(names[i])
    return sorted(out)


@lru_cache(maxsize=1)
def train() -> Model:
    """Fits the model; its temperature is chosen on rows left out of three folds, all sayings of a name in one fold."""
    rows = labelled()
    y = np.array([FAMILIES.index(f) for _, f in rows] + [FAMILIES.index(NONE)] * EMPTY_ROWS)
    share = 1.0 / np.bincount(y, minlength=len(FAMILIES))[y]  # classes weigh the same
    names = sorted({g for line, _ in rows for g in grams_of(line)})
    at = {g: i for i, g in enumerate(names)}
    x = np.zeros((len(y), len(names)))
    for r, (line, _) in enumerate(rows):
        x[r, [at[g] for g in grams_of(line)]] = 1.0
    weight = share / share.sum()
    held = np.zeros((len(y), len(FAMILIES)))
    fold = np.arange(len(y)) // len(SAYINGS) % 3
    for f in range(3):
        w = _fit(x[fold != f], y[fold != f], weight[fold != f] / weight[fold != f].sum(), 150)
        held[fold == f] = np.column_stack([x[fold == f], np.ones((fold == f).sum())]) @ w
    losses = {t: -(weight * np.log(_softmax(held * t)[np.arange(len(y)), y])).sum() for t in (0.5, 0.75, 1.0, 1.5, 2.0, 3.0)}
    w = _fit(x, y, weight) * min(losses, key=losses.get)
    kept = tuple((names[i], FAMILIES[k], float(w[i, k])) for i, k in np.argwhere(w[:-1] != 0).tolist())
    pairs = [(f, tuple(g for g in grams_of(line) if " " in g)) for f, lines in TEMPLATES.items() for line in lines]
    return Model(kept, {f: float(w[-1, k]) for k, f in enumerate(FAMILIES)}, tuple(pairs), tuple(needed_grams(names, w)))


def _tokens(c):
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")


def classify(spark: SparkSession, paragraphs: DataFrame, model: Model) -> DataFrame:
    """(p, family, probability) of each distinct paragraph ``p``: a family, ``unknown`` or ``none``."""
    weights = spark.createDataFrame(list(model.weights), "gram string, class string, weight double")
    bias = spark.createDataFrame(list(model.bias.items()), "class string, bias double")
    templates = spark.createDataFrame([(f, list(g)) for f, g in model.templates], "family string, pairs array<string>").groupBy("family").agg(F.collect_list("pairs").alias("templates"))
    words = paragraphs.select("p").distinct().withColumn("w", _tokens(F.col("p")))
    n = F.greatest(F.size("w") - 1, F.lit(0))
    pairs = F.array_distinct(F.zip_with(F.slice("w", 1, n), F.slice("w", 2, n), lambda a, b: F.concat(a, F.lit(" "), b)))
    grams = words.select("p", pairs.alias("pairs"), F.array_union(F.array_distinct("w"), pairs).alias("g"))
    hits = grams.select("p", F.explode("g").alias("gram")).join(F.broadcast(weights), "gram").groupBy("p", "class").agg(F.sum("weight").alias("z"))
    # every class has its bias, also where no n-gram has a weight for it
    logits = hits.groupBy("p").agg(F.map_from_entries(F.collect_list(F.struct("class", "z"))).alias("z"))
    one = bias.agg(F.sort_array(F.collect_list(F.struct(F.col("class").alias("c"), F.col("bias").alias("b")))).alias("biases"))
    scored = grams.join(logits, "p", "left").join(F.broadcast(one))  # one row
    each = F.transform("biases", lambda x: F.struct((x["b"] + F.coalesce(F.try_element_at("z", x["c"]), F.lit(0.0))).alias("s"), x["c"].alias("c")))
    best = scored.select("p", "pairs", each.alias("e")).withColumn("top", F.array_max("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + F.exp(x["s"] - F.col("top.s")))
    got = best.select("p", "pairs", F.col("top.c").alias("family"), (1 / total).alias("probability")).join(F.broadcast(templates), "family", "left")
    like = F.exists("templates", lambda t: F.size(F.array_intersect(t, F.col("pairs"))) >= CONFIRM * F.size(t))
    sure = (F.col("probability") >= CERTAIN) & F.coalesce(like, F.lit(False))
    family = F.when(F.col("family") == NONE, F.lit(NONE)).when(sure, F.col("family")).otherwise(F.lit(UNKNOWN))
    return got.select("p", family.alias("family"), F.round("probability", 6).alias("probability"))


def holds_needed(text, model: Model):
    """Whether a text holds a needed n-gram: the pattern finds whole words in lower case with anything but letters and digits between."""
    words = sorted({tuple(g.split(" ")) for g in model.needed})
    alone = {w[0] for w in words if len(w) == 1}
    words = [w for w in words if len(w) == 1 or not alone & set(w)]
    by_letter: dict[str, list[str]] = {}
    for w in words:
        by_letter.setdefault(w[0][0], []).append("[^a-z0-9]++".join(w)[1:])
    heads = "|".join(f"{a}(?:{'|'.join(rest)})" for a, rest in by_letter.items())
    return F.lower(text).rlike(rf"(?<![a-z0-9])(?:{heads})(?![a-z0-9])")


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, paragraph, start, family, probability): the licence paragraphs of each row of ``docs``.

    A run of lines goes up to a blank line or one that ends a sentence, whatever its lines' lengths.  It is first judged whole, joined by spaces, so a
    notice is one paragraph however it is broken over lines.  A run of class none or unknown, in which a notice may
    be one line among others, is then judged line by line: its lines of a family (for class none, of unknown as well) are paragraphs of their own,
    and if it has none, an unknown run stays one paragraph.  ``start`` is the number of the paragraph's first line in the text, from 0.  Paragraphs
    of class none and null or empty texts give no rows; equal paragraphs get
    equal classes.  Repeated rows repeat.  Other columns are ignored.
    """
    spark = docs.sparkSession
    model = train()
    scratch = Scratch(spark, "licenses")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = texts.withColumn("flow", F.regexp_replace("text", JOINED, JOINED_BY))
    # a paragraph's place is where it starts in code points; only texts that hold a needed n-gram are cut
    cut = joined.where(holds_needed(F.col("flow"), model)).select("doc_id", "text", F.split("flow", "\n").alias("ps"))
    runs = scratch.save(cut.select("doc_id", F.explode(_placed(F.col("ps"), F.col("text"), model)).alias("x")).select("doc_id", "x.p", "x.start", "x.lines"))
    # ``run`` tells equal rows apart, so that repeated documents keep their own lines
    judged = scratch.save(_classes(runs, scratch.save(classify(spark, runs, model))).withColumn("run", F.monotonically_increasing_id()))
    whole = judged.where(~F.col("family").isin(NONE, UNKNOWN))
    rest = judged.where(F.col("family").isin(NONE, UNKNOWN))
    lines = rest.where(F.size("lines") > 1).select("run", "doc_id", "start", F.col("family").alias("of"), F.posexplode("lines").alias("i", "p")).where(holds_needed(F.col("p"), model))
    lines = scratch.save(lines.select("run", "doc_id", (F.col("start") + F.col("i")).alias("start"), "of", "p"))
    named = _classes(lines, scratch.save(classify(spark, lines, model))).where((F.col("family") != NONE) & ((F.col("of") == NONE) | (F.col("family") != UNKNOWN)))
    named = scratch.save(named)
    kept = rest.where(F.col("family") == UNKNOWN).join(named.where(F.col("of") == UNKNOWN).select("run").distinct(), "run", "left_anti")
    out = ("doc_id", F.col("p").alias("paragraph"), "start", "family", "probability")
    return whole.select(*out).unionByName(named.select(*out)).unionByName(kept.select(*out))


def _classes(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``rows`` with the family and probability of their paragraph; classes other than none are few, and sent to all tasks where they are small."""
    some = classes.where(F.col("family") != NONE)
    size = some.agg(F.coalesce(F.sum(F.octet_length("p") + 64), F.lit(0))).first()[0]
    return rows.join(F.broadcast(some) if size <= BROADCAST_BYTES else some, "p", "left").fillna({"family": NONE})


def _placed(paragraphs, text, model: Model):
    """Structs (p, start, lines) of the paragraphs that hold a needed n-gram; start counts the newlines of ``text`` before, lines are those it is joined from."""
    ends = F.transform(paragraphs, lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    some = F.filter(ends, lambda x: holds_needed(x["p"], model))

    def one(x):
        before = F.aggregate(F.slice(paragraphs, 1, x["i"]), F.lit(0), lambda a, p: a + F.length(p) + 1)
        head = F.substring(text, F.lit(1), before)
        own = F.split(F.substring(text, before + 1, F.length(x["p"])), "\n")
        return F.struct(x["p"].alias("p"), (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))).cast("long").alias("start"), own.alias("lines"))

    return F.transform(some, one)
