"""License scans: a trained classifier of paragraphs, with an unknown class and template comparison.

A multinomial logistic regression on the presence of word n-grams (1 and 2 words) tells licence
families from each other and from other text. It is fitted on the driver from a small fixed table:
phrases that name a licence, notices in words of our own (``NOTICES``) whole and in pieces, and ordinary sentences.
The licences' own wording (``TEMPLATES``) is not learned from; it serves the comparison, with the licences' names,
which stand in both, as a licence has one name. All n-grams of the licence texts are features. Those that ordinary sentences have too may speak against all
families alike, never for one; so a paragraph without any other (``Model.anchors``) gets "none" at least as
surely as an empty one, and is passed over early without a loss. Held-out phrases set a temperature,
and with phrases of licences of no family (``OTHER``) the probability under which a family becomes ``unknown``;
``HELD_FRAMES``, ``HELD_OTHER`` and ``HELD_ORDINARY`` are used by no step and measure the result. A
prediction is confirmed if enough of the paragraph's word pairs that are anchors or hold a cue (a
licence word that no ordinary sentence has) stand in the family's templates.

Scanning uses built-in functions only, in one narrow pass: no join, no shuffle, no Python.

A paragraph is a line, or a run of wrapped lines: a line break is a wrap if neither line is blank and
the first does not end a sentence before a capital letter. A run is reported if it is a hit and shares
more pairs with its family's templates than each of its lines that is a hit; it then stands for those
of its lines that are of its family or unknown. All other lines that are hits are reported.

Defined cases: a run has its first line's number and the text of all its lines; null and empty texts give no row; repeated rows are each
reported; a null doc_id stays null; other columns are dropped; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE, UNKNOWN = "none", "unknown"
_WORD = r"[a-z0-9]+"

#: names of each family (public knowledge)
NAMES: dict[str, list[str]] = {
    "Apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache Software License"],
    "MIT": ["MIT License", "MIT licence", "The MIT License (MIT)", "MIT/X11 License"],
    "GPL": ["GNU General Public License, version 3", "GNU General Public License v2.0", "GPL-3.0", "GPLv2", "GNU GPL version 3"],
    "LGPL": ["GNU Lesser General Public License, version 3", "LGPL-2.1", "GNU LGPL", "GNU Library General Public License"],
    "AGPL": ["GNU Affero General Public License, version 3", "AGPL-3.0", "AGPLv3"],
    "BSD": ["BSD License", "BSD-3-Clause", "2-clause BSD license", "Simplified BSD License", "New BSD License"],
    "MPL": ["Mozilla Public License, version 2.0", "MPL-2.0", "MPL 2.0", "Mozilla Public License"],
    "ISC": ["ISC License", "ISC licence"],
    "Unlicense": ["The Unlicense", "Unlicense"],
    "CC0": ["CC0 1.0 Universal", "CC0-1.0", "Creative Commons Zero"],
    "CC-BY": ["CC BY 4.0", "CC-BY-4.0", "Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA": ["CC BY-SA 4.0", "CC-BY-SA-3.0", "Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC": ["CC BY-NC 4.0", "CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "Proprietary": ["proprietary license", "commercial licence agreement", "end user license agreement"],
}
#: where names stand
FRAMES = ["Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "Released under {}.", "This work is licensed under the {}.", "This work is licensed under {}.", "Distributed under the terms of the {}.", "This software is available under the {}.", "The code is covered by the {}.", "License: {}", "SPDX-License-Identifier: {}", "{}"]
#: what notices say, in words of our own, to learn from
NOTICES: dict[str, list[str]] = {
    "Apache": ["This file comes under the Apache License, Version 2.0; use of this file is only in compliance with the Apache License.", "A copy of the License: http://www.apache.org/licenses/", "you may not use this file except as the License says", "may obtain a copy of the License at"],
    "MIT": ["Permission is hereby granted, free of charge, to anybody with a copy of this software", "granted, free of charge, to any person", "any person obtaining a copy of this software", "this software and associated documentation files", "to deal in the Software without restriction or limit"],
    "GPL": ["This program is free software and you can redistribute it under the GNU General Public License of the Free Software Foundation.", "free software: you can redistribute it and/or modify it", "General Public License as published by the Free Software Foundation", "you may redistribute the program under the terms of the GNU General Public License"],
    "LGPL": ["This library is free software under the GNU Lesser General Public License.", "redistribute this library and/or modify it under the GNU Lesser General Public License", "the library under the terms of the GNU Lesser General Public License"],
    "AGPL": ["This program is free software under the GNU Affero General Public License.", "redistribute it under the terms of the GNU Affero General Public License as published"],
    "BSD": ["Redistribution in source and binary forms is permitted provided that these conditions are met.", "Redistribution and use in source or binary form with or without modification", "source and binary forms, with or without modification, are permitted", "permitted provided that the following conditions", "Redistributions of source code must retain this list of conditions"],
    "MPL": ["This Source Code Form is under the Mozilla Public License, v. 2.0.", "Source Code Form is subject to the Mozilla Public License"],
    "ISC": ["Permission to use, copy, modify or distribute this software is hereby granted for any purpose", "Permission to use, copy, modify, and/or distribute", "software for any purpose with or without fee", "distribute this software for any purpose"],
    "Unlicense": ["This software is free and unencumbered and in the public domain.", "unencumbered software in the public domain", "free and unencumbered software released into the public"],
    "CC0": ["The author has waived copyright and related or neighboring rights under CC0.", "waived all copyright and related rights to this work", "neighboring rights to this work under CC0", "To the extent possible under law the author waived all rights"],
    "CC-BY": ["This text is licensed under a Creative Commons Attribution License, 4.0 International.", "Creative Commons Attribution 4.0"],
    "CC-BY-SA": ["This text is licensed under a Creative Commons Attribution-ShareAlike License.", "Creative Commons Attribution-ShareAlike 4.0"],
    "CC-BY-NC": ["This text is licensed under a Creative Commons Attribution-NonCommercial License.", "Creative Commons Attribution-NonCommercial 4.0"],
    "Proprietary": ["All rights reserved.", "All rights reserved by the owner.", "Unauthorized copying of this file is prohibited.", "Unauthorized copying, via any medium, is strictly prohibited", "Proprietary and confidential", "Copyright 2020 Some Corporation, all rights reserved", "copying of this file is strictly prohibited"],
}
#: opening and characteristic sentences of the licences themselves (public knowledge), to compare with
TEMPLATES: dict[str, list[str]] = {
    "Apache": ["Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."],
    "GPL": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."],
    "LGPL": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License."],
    "AGPL": ["This program is free software: you can redistribute it under the terms of the GNU Affero General Public License."],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0."],
    "CC-BY": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "Proprietary": ["All rights reserved. Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.", "Copyright Example Corporation. All rights reserved."],
}
#: ordinary sentences: their words and pairs are no evidence of a licence
ORDINARY = """The work of this group is free and open to the public. You may use the file as you like, under one condition. A person can modify the terms with notice.
In the software library the source code is published for any purpose. With or without a fee, all of it is related to the law. This program was released at a fair in May.
The author has the right to copy a part and to distribute it. He was granted a free lunch, and all the conditions are met. It is available from the site at 4 pm, version 3, clause 2, part 1 0.
Permission was given by the mother. You must not park here by law. The code for the door is 2 1 4 5 6 7 8 9. The international zero line. A new, simplified form for the general user is possible. Public domain of values.
By and by the people met at the end of the agreement. Attribution of the painting is unclear. The foundation of the house. Apache people lived there. The lesser evil. A commercial airline; a universal joint. Example http www com org net.
le la les de des un une et est sur pour dans que qui avec par du en au aux ce ne pas plus son sa ses il elle on nous vous
der die das und ist mit von zu auf für nicht ein eine einer den dem des im am als auch bei nach aus wie sich es er sie wir ihr
el los las una unos y es por con para como más su sus lo al del se no si ya muy sin sobre entre cuando sa
We looked into that via the following link. A charge was provided for, except by one deal. The forms and files are subject to some extent to the medium. The box was covered with the documentation of an associated corporation. Visitors are permitted and leaflets distributed.
The identifier of a binary star. In compliance with the plan, she is copying a confidential letter. They obtain, and were obtaining, a modification. Smoking is strictly prohibited. Human rights matter. We reserved a table. I hereby resign. A neighboring town has a restriction. Figure v is new.
It is in the house, to the left of the door, at the end, by the sea, from the hill, with the dog, for the boy, on the way and in the end. You can see it or not. Any of this is a part of that, and this is for you to the extent that it is to be seen. He is under the table, under a tree. That is under this roof. You may not go. This file is a copy of the file. This work is new. This software is old. The software is in a box. The work is to use it.
Read version 2.0, version 3.0, version 4.0, version 1.0, v2.0, v 2, 2.1, 3.0, 4.0 and 2.0, version 3 or version 2. The terms of the house. Of the work. The code is here. It was available under pressure. In source and in form. To any person or to any of us. In any medium or form. To use and to copy. This library is open. And use it for any purpose with or without it. May use. Use this. The author has. The following conditions hold. Free of it. Free of charge. Related to this work. In the public interest. Public library. A general rule""".split("\n")
#: licences of no family to learn from, in frames, and phrases that many families share: they speak for all families alike
SHARED = ["Eclipse Public License 2.0", "Common Public License 1.0", "Sun Public License", "Public License", "Boost Software License 1.0", "zlib License", "PostgreSQL License", "Academic Free License", "Sample Public Licence", "license of its authors", "license in that file", "license", "Sample Free Licence 1.1"]
COMMON = ["Permission is hereby granted.", "Read the license.", "The license has details.", "The licence is here.", "This is licensed."]
#: used by no step of the training: frames, licences of no family, and sentences with words of licences
HELD_FRAMES = ["This project uses the {}.", "See the file COPYING for the {}.", "It is published under the {} by its authors.", "The sources fall under the {}; see there.", "(c) 2019 the authors, {}"]
HELD_OTHER = ["Licensed under the Eiffel Forum License.", "Released under the Ruby License.", "Licensed under the Vim License.", "This work is licensed under the Q Public License.", "Released under the Academic Free Licence 3.0.", "Distributed under the terms of the CeCILL licence.", "Licensed under the Open Font License.", "Released under the Beerware licence.", "This software is available under the Python Software Foundation License.", "Licensed under the Microsoft Reciprocal License."]
HELD_ORDINARY = ["Her driving licence was renewed in March.", "The pub lost its license to sell beer.", "They have the right to use the road.", "He took poetic license with the story.", "Please copy the file to the other disk.", "The public library is free on Sundays.", "Apache helicopters flew over the town.", "The school grants permission to leave early.", "MIT researchers met in Boston.", "The general public was not amused.", "Redistribution of wealth was the topic.", "Mozilla opened a new office.", "A fishing license costs ten dollars.", "The source of the river is in the hills.", "All the seats were reserved for members."]
#: licences of no family, to set the bar for unknown
OTHER = ["Licensed under the Example Public License 1.1.", "Released under the Open Gaming License.", "Licensed under the European Union Public Licence.", "Distributed under the Artistic License.", "This work is licensed under the Zope License.", "Licensed under a license that we wrote.", "See the license for details."]


def words(text: str) -> list[str]:
    return re.findall(_WORD, text.lower())


def grams(found: list[str]) -> set[str]:
    return {*found, *(f"{a} {b}" for a, b in zip(found[:-1], found[1:], strict=True))}


def pieces(text: str, size: int = 8) -> list[str]:
    """Windows of a notice's words, half overlapping."""
    found = words(text)
    return [" ".join(found[i : i + size]) for i in range(0, max(1, len(found) - size // 2), size // 2)]


@dataclass
class Model:
    classes: list[str]  # the last is NONE
    weights: dict[str, list[float]]
    bias: list[float]
    cues: list[str]  # words of licences that no ordinary sentence has
    anchors: list[str]  # the n-grams that speak for a family; without one a paragraph is NONE
    temperature: float
    least: float  # a family's probability below this is unknown
    templates: dict[str, list[str]]  # pairs of words, by family

    def predict(self, paragraph: str) -> tuple[str, float]:
        """Class and probability, as the scan gives them."""
        p = _softmax(np.array([self.logits(paragraph)]), self.temperature)[0]
        if p[-1] >= 0.5:
            return NONE, float(p[-1])
        i = int(p[:-1].argmax())
        return (self.classes[i] if p[i] >= self.least else UNKNOWN), float(p[i])

    def logits(self, paragraph: str) -> np.ndarray:
        return sum((np.array(self.weights[g]) for g in sorted(grams(words(paragraph))) if g in self.weights), np.array(self.bias))


def _softmax(z: np.ndarray, temperature: float) -> np.ndarray:
    e = np.exp((z - z.max(1, keepdims=True)) / temperature)
    return e / e.sum(1, keepdims=True)


def train(steps: int = 300, rate: float = 2.0, l2: float = 2e-4, small: float = 0.02) -> Model:
    """From the tables above only: always the same model."""
    rows = [(f.format(n), k) for k, ns in NAMES.items() for n in ns for f in FRAMES]
    held = [r for i, r in enumerate(rows) if i % 5 == 3]
    ordinary = [s for line in ORDINARY for s in re.split(r"[.;] ", line)]
    rows = [r for i, r in enumerate(rows) if i % 5 != 3] + [(t, k) for k, ts in NOTICES.items() for t in ts] * 2
    rows += [(piece, k) for k, ts in NOTICES.items() for t in ts for piece in pieces(t)]
    rows += [(f.format(n), UNKNOWN) for n in SHARED for f in FRAMES] + [(t, UNKNOWN) for t in COMMON] * 6
    classes = [*NAMES, NONE]
    plain = {g for t in [*ORDINARY, *ordinary] for g in grams(words(t))}
    names = sorted({g for t, _ in rows for g in grams(words(t))})
    cues = {g for g in names if " " not in g} - plain
    rows = [(t, k) for t, k in rows if not grams(words(t)) <= plain] + [(t, NONE) for t in [*ORDINARY, *ordinary]] * 3
    held += [(t, NONE) for t in ordinary]
    at = {g: i for i, g in enumerate(names)}
    weak = np.array([g in plain for g in names])

    def matrix(texts: list[str]) -> np.ndarray:
        x = np.zeros((len(texts), len(names)))
        for i, t in enumerate(texts):
            x[i, [at[g] for g in grams(words(t)) if g in at]] = 1
        return x

    share = dict(zip(classes, np.eye(len(classes)), strict=True)) | {UNKNOWN: np.append(np.full(len(NAMES), 1 / len(NAMES)), 0)}
    x, y = matrix([t for t, _ in rows]), np.array([share[k] for _, k in rows])
    w, b = np.zeros((len(names), len(classes))), np.zeros(len(classes))
    b[-1] = 2.0
    for _ in range(steps):
        g = (_softmax(x @ w + b, 1.0) - y) / len(x)
        w -= rate * (x.T @ g * 3 + l2 * w)
        b -= rate * g.sum(0)
        w[weak, :-1] = np.minimum(w[weak, :-1].mean(1, keepdims=True), w[weak, -1:])
    w[np.abs(w) < small] = 0
    w, b = w.round(6), b.round(6)
    z, k = matrix([t for t, _ in held]) @ w + b, np.array([classes.index(c) for _, c in held])
    loss = {t: -np.log(_softmax(z, t)[np.arange(len(k)), k] + 1e-12).mean() for t in np.linspace(0.2, 3, 29)}
    temperature = float(min(loss, key=loss.get))
    known = _softmax(z, temperature)[:, :-1][k < len(classes) - 1].max(1)
    other = _softmax(matrix(OTHER) @ w + b, temperature)[:, :-1].max(1)
    least = float(max(np.linspace(0.3, 0.95, 66), key=lambda t: (known >= t).mean() + (other < t).mean()))
    if np.exp((b[:-1] - b[-1]) / temperature).sum() > 1:
        raise ValueError("an empty paragraph is not told from a licence")
    anchors = [g for g, i in at.items() if w[i, :-1].max() > w[i, -1]]
    templates = {c: sorted({g for t in TEMPLATES[c] + [f"under the {n}" for n in NAMES[c]] + [f"under {n}" for n in NAMES[c]] for g in grams(words(t)) if " " in g}) for c in NAMES}
    return Model(classes, {g: w[i].tolist() for g, i in at.items() if w[i].any()}, b.tolist(), sorted(cues), anchors, temperature, least, templates)


def _literal(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value)), kind)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is computed once however often body has it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _pairs(w: Column) -> Column:
    pairs = F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_distinct(F.when(F.size(w) > 1, pairs).otherwise(F.array().cast("array<string>")))


def _any_of(texts: list[str]) -> str:
    """A pattern for any of the n-grams, with common beginnings shared and any signs between words."""
    heads: dict[str, list[str]] = {}
    for t in sorted(texts):
        heads.setdefault(t[:1], []).append(t[1:])
    parts = [(h.replace(" ", "[^a-z0-9]+") + (rest[0].replace(" ", "[^a-z0-9]+") if len(rest) == 1 else _any_of(rest))) if h else "" for h, rest in sorted(heads.items(), reverse=True)]
    return f"(?:{'|'.join(parts)})"


#: the end of a line that ends a sentence, and the beginning of one that begins with a capital letter
_ENDS, _OPENS = r"[.!?:;][^\p{L}\p{N}.!?:;]*$", r"^[^\p{L}\p{N}]*\p{Lu}"


def _runs(lines: Column) -> Column:
    """start (number of the first line, from 0) and lines of each run of wrapped lines."""
    blank = lambda x: ~x.rlike(r"\S")
    starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.when(i == 0, True).otherwise(_let(F.slice(lines, i, 2), lambda x: blank(x[0]) | blank(x[1]) | (x[0].rlike(_ENDS) & x[1].rlike(_OPENS)))))
    return _let(starts, lambda at: F.zip_with(at, F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.size(lines))), lambda a, b: F.struct(a.alias("start"), F.slice(lines, a + 1, b - a).alias("lines"))))


def scan(docs: DataFrame, model: Model | None = None, agree: float = 0.5) -> DataFrame:
    """doc_id, paragraph (number of its first line, from 0), family, probability, similarity, confirmed
    and text of the lines and runs of wrapped lines of ``docs`` (doc_id, text) that speak of a licence."""
    model = model or train()
    cues, anchors, features = F.lit(model.cues), F.lit(model.anchors), F.lit(sorted(model.weights))
    weight, n = _literal(model.weights, "map<string, array<double>>"), len(model.classes)
    templates = _literal(model.templates, "map<string, array<string>>")
    pattern = rf"(?<![a-z0-9]){_any_of(model.anchors)}(?![a-z0-9])"

    def speaks(text: Column) -> Column:
        return F.lower(text).rlike(pattern)

    def logits(w: Column, pairs: Column) -> Column:
        return F.aggregate(F.array_sort(F.array_intersect(F.array_union(pairs, w), features)), F.lit(model.bias), lambda acc, g: F.zip_with(acc, F.element_at(weight, g), lambda a, b: a + b))

    def chances(z: Column) -> Column:
        e = _let(F.array_max(z), lambda top: F.transform(z, lambda x: F.exp((x - top) / F.lit(model.temperature))))
        return _let(e, lambda e: _let(F.aggregate(e, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(e, lambda x: x / total)))

    def telling(pairs: Column) -> Column:
        return F.filter(pairs, lambda g: F.array_contains(anchors, g) | F.array_contains(cues, F.substring_index(g, " ", 1)) | F.array_contains(cues, F.substring_index(g, " ", -1)))

    def hit(text: Column, at: Column, pairs: Column, families: Column) -> Column:
        probability = F.array_max(families)
        best = F.element_at(F.lit(model.classes), F.array_position(families, probability).cast("int"))
        family = F.when(probability >= model.least, best).otherwise(F.lit(UNKNOWN))
        shared = lambda told: F.size(F.array_intersect(told, F.element_at(templates, best)))
        return _let(telling(pairs), lambda told: F.struct(at.cast("long").alias("paragraph"), family.alias("family"), probability.alias("probability"), F.when(F.size(told) > 0, shared(told) / F.size(told)).otherwise(F.lit(0.0)).alias("similarity"), shared(told).alias("shared"), text.alias("text")))

    def judged(text: Column, at: Column) -> Column:
        """The hit, or null."""
        found = F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))
        return _let(found, lambda w: _let(_pairs(w), lambda pairs: _let(chances(logits(w, pairs)), lambda p: F.when(F.element_at(p, n) < 0.5, hit(text, at, pairs, F.slice(p, 1, n - 1))))))

    def of_run(run: Column) -> Column:
        lines = F.filter(F.transform(run["lines"], lambda x, i: F.struct(x.alias("x"), (run["start"] + i).alias("at"))), lambda s: speaks(s["x"]))
        alone = F.array_compact(F.transform(lines, lambda s: judged(s["x"], s["at"])))
        whole = F.when(F.size(run["lines"]) > 1, judged(F.array_join(run["lines"], "\n"), run["start"]))
        return _let(alone, lambda alone: _let(whole, lambda whole: F.when(whole.isNull() | F.exists(alone, lambda h: h["shared"] >= whole["shared"]), alone).otherwise(F.concat(F.array(whole), F.filter(alone, lambda h: (h["family"] != whole["family"]) & (h["family"] != UNKNOWN))))))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(speaks(F.col("text")))
    runs = _let(F.split("text", "\n"), lambda lines: F.filter(_runs(lines), lambda run: speaks(F.array_join(run["lines"], "\n"))))
    found = rows.select("doc_id", F.explode(F.flatten(F.transform(runs, of_run))).alias("hit")).select("doc_id", "hit.*")
    return found.select("doc_id", "paragraph", "family", "probability", "similarity", ((F.col("family") != UNKNOWN) & (F.col("similarity") >= agree)).alias("confirmed"), "text")
