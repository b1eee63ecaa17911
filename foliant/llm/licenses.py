"""Licence scans with a trained paragraph classifier.

A sparse softmax regression over word one- and two-grams names the licence family of a paragraph. It is fitted on the
driver to the templates below (notices and paragraphs of licences, and the short ways to name one, made by a rule), to cut and thinned
copies of them, and to sentences that use the same words for other things; the last are a class of their own, ``unknown``. A
temperature fitted on copies kept apart calibrates the probabilities; a family counts if its probability is at least
``least_p``. It is confirmed by comparison with the family's single templates: of one of them the paragraph must have ``least_cover`` of the
telling word pairs, or else all but 1 - ``least_cover`` of its own telling pairs must stand in one.

A paragraph ends at a blank line, or at a line that ends a sentence, so a notice that is wrapped over lines is seen whole. Each line of a
paragraph of several is judged by itself too, as lists of notices are often lines. All are cut into grams; those whose grams together can't lift any
family to ``least_p`` against ``unknown``, by the model's own weights, go no further, which changes no result. Texts are read once, and not shuffled: a written
table holds a numbered row for each document, with the grams of what is left. They are joined to the model (a table as large as the templates, the same for any
corpus) and summed by paragraph.

Everything on the documents is DataFrame expressions. Null and empty texts have no paragraphs. Rows that repeat an id each get a row with
their own paragraphs; null ids are kept. An empty table gives an empty result; extra columns, whatever their names, aren't read by
``document_licences``.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import text_of, written
from foliant.session import spread

UNKNOWN = "unknown"
#: Paragraphs of licences and notices as licensors ask to place them, by family.
TEXTS: dict[str, tuple[str, ...]] = {
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display, publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form.",
        "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements. See the NOTICE file distributed with this work for additional information regarding copyright ownership.",
    ),
    "gpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "The GNU General Public License is a free, copyleft license for software and other kinds of works.",
        "This work is licensed under the GNU General Public License, version 3.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
        "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation.",
    ),
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "The contents of this file are subject to the Mozilla Public License Version 1.1; you may not use this file except in compliance with the License.",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    "boost": ("Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software.",),
    "epl": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution.",),
    "cc-by": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "You are free to share and adapt the material for any purpose, even commercially, under the terms of the Creative Commons Attribution license."),
    "cc-by-sa": ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply."),
    "cc-by-nc": ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",),
    "cc-by-nd": ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law.",
        "This work has been dedicated to the public domain.",
    ),
    "proprietary": (
        "Copyright. All rights reserved.",
        "Proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "This software is proprietary and may only be used under a separate license agreement with the copyright owner.",
    ),
}
#: The names that families go by.
NAMES: dict[str, tuple[str, ...]] = {
    "mit": ("MIT License", "MIT", "Expat License"),
    "apache": ("Apache License", "Apache License, Version 2.0", "Apache-2.0", "Apache License 2.0", "Apache 2"),
    "gpl": ("GNU General Public License", "GNU General Public License, version 3", "GNU GPL", "GPL", "GPLv2", "GPLv3", "GPL-3.0-or-later", "GPL-2.0-only"),
    "lgpl": ("GNU Lesser General Public License", "LGPL", "LGPLv3", "LGPL-2.1-or-later", "GNU Library General Public License"),
    "agpl": ("GNU Affero General Public License", "AGPL", "AGPLv3", "AGPL-3.0-only"),
    "bsd": ("BSD License", "BSD 3-Clause License", "BSD 2-Clause License", "BSD-3-Clause", "BSD-2-Clause", "New BSD License", "simplified BSD license"),
    "mpl": ("Mozilla Public License", "Mozilla Public License, version 2.0", "MPL", "MPL-2.0"),
    "isc": ("ISC License", "ISC"),
    "zlib": ("zlib License", "zlib/libpng license"),
    "unlicense": ("Unlicense",),
    "boost": ("Boost Software License", "Boost Software License, Version 1.0", "BSL-1.0"),
    "epl": ("Eclipse Public License", "Eclipse Public License 2.0", "EPL-2.0"),
    "cc-by": ("CC BY 4.0", "CC BY", "CC-BY-4.0", "CC BY 3.0", "Creative Commons Attribution license"),
    "cc-by-sa": ("CC BY-SA 4.0", "CC BY-SA", "CC-BY-SA-4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike license"),
    "cc-by-nc": ("CC BY-NC 4.0", "CC BY-NC", "CC-BY-NC-4.0", "CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial license"),
    "cc-by-nd": ("CC BY-ND 4.0", "CC BY-ND", "CC-BY-ND-4.0", "Creative Commons Attribution-NoDerivatives license"),
    "cc0": ("CC0", "CC0 1.0 Universal", "CC0-1.0", "Creative Commons Zero"),
}
#: How notices bring a name in.
PHRASES = (
    "Licensed under the {}.",
    "Released under the {}.",
    "This project is licensed under the terms of the {}.",
    "Distributed under {}",
    "available under the {}",
    "License: {}",
    "SPDX-License-Identifier: {}"
)
TEMPLATES: dict[str, tuple[str, ...]] = {f: (*TEXTS[f], *(p.format(n) for n in NAMES.get(f, ()) for p in PHRASES)) for f in TEXTS}
#: Sentences with the same words that grant nothing.
OTHERS = (
    "The driver lost his license after the second offence.", "He applied for a fishing license and a permit in the public office.", "The software was released in version 2.0 last week.",
    "The apache helicopter landed at the base.", "She studied at MIT before she joined the foundation.", "A creative team works in common rooms under one roof.",
    "The work is subject to delays and the terms were modified.", "You may obtain a copy of the report at the front desk.", "All rights of the accused were respected by the general.",
    "Use the source file and the binary forms in the folder.", "The mozilla browser and the gnu project were compared.", "The library is free for any person without restriction.",
    "The public license board met to discuss conditions and compliance.", "Permission was granted by the publisher to print the article.", "This file has no copyright line and the author is not known.",
    "The clause in the contract is governed by state law.", "Attribution of the painting to the master is in doubt.", "The documentation of the program is confidential until Monday.",
    "The court ruled that the copyright of the song had expired.", "A warranty of two years comes with every washing machine.", "The bar lost its liquor license and was closed.", "Doctors must renew their license each year.",
    "The domain name was sold to a public company.", "Reserved seats are marked in red.", "The permission slip must be signed by a parent.", "Which license should I choose for my project?",
    "We compared the MIT, BSD and GPL licenses in class.", "MIT researchers published a paper on batteries.", "The Boost was cancelled after the eclipse.", "The commons in the old town was redistributed among farmers.",
    "The redistribution of wealth is a matter of debate.", "The company was liable for damages in the accident.", "The dedicated staff worked through the night.", "An apache tribe lived on the land.",
    "GNU make and BSD tar behave in different ways.", "His driving licence was suspended for a year.", "Copyright law differs from country to country.", "The software license cost the city two million.",
    "Her rights were waived in the settlement.", "The proprietary recipe is kept in a safe.", "Confidential talks were held in Geneva.", "The warranty does not cover water damage.",
    "A licensed plumber must do the work.", "The gun was licensed to his brother.", "The terms of the agreement were not released.", "Unauthorized entry is prohibited.", "The museum has a public domain collection of maps.", "The band released an album under a new name.",
)
#: Words that tell nothing alone.
PLAIN = frozenset("the of to and a in is it you that he was for on are with as his they at be this from i have or by one had not but what all were when we there can an your which their if do will each about how up out them then she some her would other into has more two see could no make than been its who did get come made may part over new after also back any good give most very just form long line small so such him my own under used work use file found first last week second public free person persons possible extent law related prior version later without these those where while during before only same 1 2 3 4 2.0 3.0 4.0 1.0 1.1 2.1 0".split())
_TOKEN = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
_TOKEN_SQL = r"[a-z0-9]+(?:[.-][a-z0-9]+)*"
#: Paragraphs end at blank lines and at lines that end a sentence.
PARAGRAPH_END = r"(?<=[.!?:])[ \t]*\r?\n|\r?\n[ \t]*\r?\n"


def words_of(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def pairs_of(words: list[str], telling: frozenset[str]) -> set[str]:
    """Pairs of neighbours with a telling word."""
    return {f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if a in telling or b in telling}


def grams_of(words: list[str], telling: frozenset[str]) -> set[str]:
    """Telling words, and pairs with one."""
    return {w for w in words if w in telling} | pairs_of(words, telling)


@dataclass(frozen=True)
class Classifier:
    families: tuple[str, ...]
    telling: frozenset[str]
    grams: tuple[str, ...]
    weights: np.ndarray  # grams x (families + unknown)
    bias: np.ndarray
    temperature: float

    def judged(self, words: list[str]) -> tuple[str, float]:
        """The likeliest class and its probability, as ``paragraph_licences`` gives them."""
        number = {g: i for i, g in enumerate(self.grams)}
        own = [number[g] for g in sorted(grams_of(words, self.telling)) if g in number]
        p = _softmax((self.weights[own].sum(0, keepdims=True) + self.bias) / self.temperature)[0]
        return (*self.families, UNKNOWN)[int(p.argmax())], float(p.max())


def _copies(rng: random.Random, words: list[str], n: int) -> list[list[str]]:
    """Copies with words left out, cut at an end, or with other words around."""
    out = []
    for _ in range(n):
        cut = words[: max(3, rng.randint(len(words) // 2, len(words)))] if rng.random() < 0.3 else words
        out.append([f"x{rng.randint(0, 9)}" for _ in range(rng.choice((0, 0, 2, 5)))] + [w for w in cut if rng.random() > 0.1])
    return out


@lru_cache(maxsize=1)
def trained(copies: int = 5, l2: float = 1e-4, rounds: int = 300) -> Classifier:
    """The classifier; the same on each call and for each corpus."""
    rng, families = random.Random(7), tuple(TEMPLATES)
    telling = frozenset(w for ts in TEMPLATES.values() for t in ts for w in words_of(t)) - PLAIN
    rows: list[tuple[list[str], int, bool]] = []
    for k, texts in enumerate([*TEMPLATES.values(), OTHERS]):
        for text in texts:
            rows += [(words_of(text), k, False)] + [(c, k, i == 0) for i, c in enumerate(_copies(rng, words_of(text), copies))]
    sets = [grams_of(w, telling) for w, _, _ in rows]
    grams = tuple(sorted(set().union(*sets)))
    number = {g: i for i, g in enumerate(grams)}
    classes = np.array([k for _, k, _ in rows])
    apart = np.array([h for _, _, h in rows])
    y = np.eye(len(families) + 1)[classes]
    # Families of many names weigh no more than others.
    share = (~apart / np.bincount(classes[~apart])[classes])[:, None] / y.shape[1]
    row = np.repeat(np.arange(len(rows)), [len(own) for own in sets])
    col = np.array([number[g] for own in sets for g in sorted(own)], np.int64)
    order = np.argsort(col, kind="stable")
    w, b = np.zeros((len(grams), y.shape[1])), np.zeros(y.shape[1])
    b[-1] = 2.0  # a paragraph without features is unknown

    def logits() -> np.ndarray:
        return _summed(w[col], row, len(rows)) + b

    for _ in range(rounds):
        e = (_softmax(logits()) - y) * share
        w -= 20.0 * (_summed(e[row[order]], col[order], len(grams)) + l2 * w)
        w[np.abs(w) < 1e-4] = 0  # sparse
    held = logits()[apart]
    temperature = min(np.linspace(0.5, 3, 26), key=lambda t: -np.log((_softmax(held / t) * y[apart]).sum(1) + 1e-12).sum())
    keep = np.abs(w).sum(1) > 0
    return Classifier(
        families, telling, tuple(g for g, k in zip(grams, keep, strict=True) if k), np.round(w[keep], 6), b, float(temperature)
    )


def _summed(values: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` by ``group``, which ascends."""
    out = np.zeros((n, values.shape[1]))
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    out[group[starts]] = np.add.reduceat(values, starts, axis=0)
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def compared(words: list[str], family: str, telling: frozenset[str]) -> tuple[float, float]:
    """For a family the best share of one template's telling pairs that ``words`` has, and of its own that one template has."""
    own = pairs_of(words, telling)
    shared = [(len(own & t), len(t)) for t in (pairs_of(words_of(x), telling) for x in TEMPLATES[family])]
    return max((n / size for n, size in shared if size), default=0.0), max((n for n, _ in shared), default=0) / max(1, len(own))


def _words(line: Column) -> Column:
    return F.regexp_extract_all(F.lower(line), F.lit(_TOKEN_SQL), F.lit(0))


def _model_grams(c: Classifier) -> dict[str, list[float]]:
    """Weights by gram. Pairs of templates without a weight are there too, to be compared."""
    weighted = {g: [float(x) for x in w] for g, w in zip(c.grams, c.weights, strict=True)}
    rest = set().union(*(pairs_of(words_of(t), c.telling) for ts in TEMPLATES.values() for t in ts)) - weighted.keys()
    return weighted | {g: [0.0] * (len(c.families) + 1) for g in sorted(rest)}


def _model_table(spark: SparkSession, c: Classifier) -> DataFrame:
    return spark.createDataFrame(list(_model_grams(c).items()), "gram string, w array<double>")


def _template_table(spark: SparkSession, c: Classifier) -> DataFrame:
    """A row a pair and family: the family's templates that have it, as (number, pairs of the template)."""
    rows: dict[tuple[str, int], list[tuple[int, int]]] = {}
    for k, f in enumerate(c.families):
        for i, t in enumerate(TEMPLATES[f]):
            own = pairs_of(words_of(t), c.telling)
            for pair in own:
                rows.setdefault((pair, k), []).append((i, len(own)))
    return spark.createDataFrame(
        [(g, k, found) for (g, k), found in sorted(rows.items())],
        "gram string, best int, templates array<struct<t: int, size: int>>"
    )


def _with(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``x``, which is computed once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _margin_levels(c: Classifier, steps: int = 16) -> tuple[float, list[list[str]]]:
    """A step, and the grams whose weight for a family is above the one for ``unknown`` by at most 1, 2, ... steps. (Those that speak for no family are in none.)"""
    margin = c.weights[:, :-1].max(1) - c.weights[:, -1]
    step = float(margin.max()) / steps
    level = np.clip(np.ceil(margin / step).astype(int), 0, steps)
    return step, [[c.grams[i] for i in np.flatnonzero(level == k)] for k in range(1, steps + 1)]


def _least_margin(c: Classifier, least_p: float) -> float:
    """How far the grams of a text must speak for a family against ``unknown``, at the least, for a probability of ``least_p`` (to six places): ``unknown`` has what is
    left or less of it."""
    p = min(max(least_p - 1e-6, 0.0), 1 - 1e-9)
    return -math.inf if p <= 0 else c.temperature * math.log(p / (1 - p)) + float(c.bias[-1] - c.bias[:-1].max()) - 1e-6


def _features(text: Column, c: Classifier, known: list[str], least: float) -> Column:
    """(``n_pairs``, ``grams``: those that the model has) of a text; null if it has none, or if the sum of what its grams can say for any family at all, each by its best
    one and rounded up, is below ``least``. So a text is passed over only where the classifier would not name it."""
    step, levels = _margin_levels(c)
    telling = sorted(c.telling)

    def says(gram: Column) -> Column:
        out = F.lit(0)
        for k, names in enumerate(levels, 1):
            if names:
                out = F.when(gram.isin(names), F.lit(k)).otherwise(out)
        return out

    def judged(own: Column, pairs: Column) -> Column:
        found = F.filter(F.concat(own, pairs), lambda g: g.isin(known))

        def kept(grams: Column) -> Column:
            enough = F.lit(True) if least == -math.inf else F.aggregate(grams, F.lit(0), lambda a, g: a + says(g)) * F.lit(step) >= least
            return F.when((F.size(grams) > 0) & enough, F.struct(F.size(pairs).alias("n_pairs"), grams.alias("grams")))

        return _with(found, kept)

    def pairs_in(words: Column) -> Column:
        n = F.size(words)
        both = F.zip_with(
            F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))),
            F.slice(words, F.lit(2), n),
            lambda a, b: F.when(a.isin(telling) | b.isin(telling), F.concat_ws(" ", a, b))
        )
        return F.array_distinct(F.array_compact(both))

    def of_words(words: Column) -> Column:
        own = F.array_distinct(F.filter(words, lambda w: w.isin(telling)))
        return _with(own, lambda o: F.when(F.size(o) > 0, _with(pairs_in(words), lambda pairs: judged(o, pairs))))

    return _with(_words(text), of_words)


def _numbered(docs: DataFrame, text: str, least_p: float | None) -> DataFrame:
    """A written row a row: ``row``, its other columns as ``doc``, ``n_paragraphs``, and ``units``: the grams of paragraphs and lines that may reach ``least_p`` (None:
    of all that have any)."""
    c = trained()
    known, least = sorted(_model_grams(c)), -math.inf if least_p is None else _least_margin(c, least_p)
    kept = [F.col(f"`{x}`") for x in docs.columns if x != text]
    paragraphs = F.filter(F.split(text_of(f"`{text}`"), PARAGRAPH_END), lambda x: x.rlike(r"\S"))

    def units(x: Column, i: Column) -> Column:
        # The whole first, then each line of several.
        own = F.split(x, "\n")
        texts = F.when(F.size(own) > 1, F.concat(F.array(x), own)).otherwise(F.array(x))
        return F.filter(
            F.transform(texts, lambda t, j: F.struct(i.alias("paragraph"), j.alias("line"), _features(t, c, known, least).alias("f"))),
            lambda u: u["f"].isNotNull()
        )

    rows = spread(docs).select(
        F.monotonically_increasing_id().alias("row"),
        F.struct(*kept, F.lit(None).cast("int").alias("__none")).alias("doc"),
        paragraphs.alias("paragraphs")
    )
    return written(
        rows.select(
            "row", "doc", F.size("paragraphs").cast("long").alias("n_paragraphs"), F.flatten(F.transform("paragraphs", units)).alias("units")
        ),
        "paragraphs"
    )


def _judged(numbered: DataFrame, least_p: float, least_cover: float) -> DataFrame:
    c = trained()
    spark, k = numbered.sparkSession, len(c.families)
    unit = ["row", "paragraph", "line"]
    grams = numbered.select("row", F.explode("units").alias("u")).select(
        "row", "u.paragraph", "u.line", "u.f.n_pairs", F.explode("u.f.grams").alias("gram")
    )
    sums = [F.round(F.sum(F.get("w", F.lit(i))), 9).alias(f"z{i}") for i in range(k + 1)]
    scored = grams.join(F.broadcast(_model_table(spark, c)), "gram").groupBy(*unit).agg(
        F.first("n_pairs").alias("n_pairs"), F.collect_list("gram").alias("grams"), *sums
    )
    logits = F.array(*((F.col(f"z{i}") + float(c.bias[i])) / c.temperature for i in range(k + 1)))
    top = scored.withColumn("logits", logits).withColumn("top", F.array_max("logits"))
    p = 1 / F.aggregate("logits", F.lit(0.0), lambda a, z: a + F.exp(z - F.col("top")))
    named = top.select(
        *unit,
        "n_pairs",
        "grams",
        (F.array_position("logits", F.col("top")).cast("int") - 1).alias("best"),
        F.round(p, 6).alias("p")
    )
    sure = (F.col("best") < k) & (F.col("p") >= least_p)
    family = F.when(sure, F.get(F.array(*map(F.lit, c.families)), F.col("best"))).otherwise(UNKNOWN)
    shared = named.where(sure).select(
        *unit, "n_pairs", "best", F.explode("grams").alias("gram")
    ).join(F.broadcast(_template_table(spark, c)), ["gram", "best"])
    each = shared.select(*unit, "n_pairs", F.explode("templates").alias("t")).groupBy(*unit, "t").agg(
        F.count("*").alias("n"), F.first("n_pairs").alias("n_pairs")
    )
    best = each.groupBy(*unit).agg(F.max(F.col("n") / F.col("t.size")).alias("cover"), F.max(F.col("n") / F.col("n_pairs")).alias("inside"))
    joined = named.select(*unit, family.alias("family"), "p").join(best, unit, "left")
    cover, inside = F.coalesce("cover", F.lit(0.0)), F.coalesce("inside", F.lit(0.0))
    return joined.select(
        *unit,
        "family",
        "p",
        F.round(cover, 6).alias("cover"),
        F.round(inside, 6).alias("inside"),
        ((cover >= least_cover) | (inside >= least_cover)).alias("confirmed")
    )


def paragraph_licences(docs: DataFrame, least_p: float = 0.6, least_cover: float = 0.6, text: str = "text") -> DataFrame:
    """For each paragraph of ``docs`` with a gram of the model: the row's other columns as ``doc``, ``row``, ``paragraph``, ``line`` (0 for the
    whole, else that line of a paragraph of several), ``family`` (``unknown`` below ``least_p``), ``p``, ``cover`` and ``inside`` (the best shares of one
    template's telling pairs, and of its own) and ``confirmed``."""
    numbered = _numbered(docs, text, None)
    return _judged(numbered, least_p, least_cover).join(
        numbered.select("row", F.col("doc").dropFields("__none").alias("doc") if len(docs.columns) > 1 else F.col("doc")), "row"
    )


def document_licences(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least_p: float = 0.6, least_cover: float = 0.6
) -> DataFrame:
    """Per row: ``key``, ``n_paragraphs`` (with text), ``n_licences`` (paragraphs and families confirmed in them), ``licences`` (those families, sorted,
    joined by commas) and ``best_p`` (null without any)."""
    numbered = _numbered(docs.select(F.col(key), F.col(text)), text, least_p)
    confirmed = _judged(numbered, least_p, least_cover).where("confirmed")
    found = confirmed.groupBy("row").agg(
        F.size(F.collect_set(F.struct("paragraph", "family"))).cast("long").alias("n_licences"),
        F.array_join(F.sort_array(F.collect_set("family")), ",").alias("licences"),
        F.max("p").alias("best_p")
    )
    base = numbered.select("row", F.col("doc")[key].alias(key), "n_paragraphs")
    return base.join(found, "row", "left").select(
        key,
        "n_paragraphs",
        F.coalesce("n_licences", F.lit(0).cast("long")).alias("n_licences"),
        F.coalesce("licences", F.lit("")).alias("licences"),
        "best_p"
    )
