"""License scans: sparse TF-IDF cosine to templates, then inheritance down the directories.

DataFrame functions only.  Every line of a file, and the whole text of a file
that is named like a licence file, is a unit.  A unit's words are weighted by
term frequency and the inverse document frequency of the template collection
(words that no template has get the largest weight, so foreign words lower a
cosine), and compared with each template.  A file's own licence is that of its
best unit with a cosine of at least ``LEAST``.

One-line notices (``TEMPLATES``) are one collection.  The usual file headers
and titles and the full licence texts (``licence_texts/``) are a second one,
``FORMS``, with document frequencies of its own: its units are the whole text
of licence files and the blocks of every file, that is its sentences, which
may run over several lines and stand inside one; lines without letters or
digits and copyright lines end a block.  SPDX tags are read by name, as
neighbouring versions differ in a single digit; of several the first by name.

Scoring is one expression over path and text, without any shuffle.  Only
units that can reach ``LEAST`` are compared: a unit that has none of a
template's chosen words has a cosine of at most the length of the
template's remaining vector (Cauchy-Schwarz), so the words are chosen such
that this is below ``LEAST`` and lines without any of them are exactly out.

A licence file gives its licence to its directory.  A file without a licence
of its own takes the one of the nearest directory above it that has one, found
by joining the ancestors of the different directories, not of the files.

Defined cases: null and empty texts have no units; a null path has no
directory and inherits nothing; ties go to the larger cosine, then the
licence that sorts first, for a directory then the path that sorts first;
rows that repeat are judged alike, each for itself; an empty table gives an
empty result; other columns are carried along.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Callable
from functools import lru_cache
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import check_columns, col, fresh, text_of

LEAST = 0.75
#: Short licence notices as authors write them.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license",
    "CC-BY-4.0": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MPL-2.0": "Subject to the terms of the Mozilla Public License, version 2.0",
    "Proprietary": "All rights reserved",
}
#: Headers and titles as the licences' stewards give them.
_GNU = ("This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} "
        "as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version.")
_GNU_ONLY = ("This {what} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} "
             "version {v} as published by the Free Software Foundation.")
_CC = ("By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this "
       "Creative Commons {name} 4.0 International Public License (\"Public License\").")
_CC_WORK = "This work is licensed under a Creative Commons {name} 4.0 International License."
HEADERS = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
                   "Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.",
                   "The ASF licenses this file to You under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                   "except in compliance with the License.",
                   "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"],
    "Artistic-1.0": ["The name of the Copyright Holder may not be used to endorse or promote products derived from this software without "
                     "specific prior written permission."],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
                     "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
                     "derived from this software without specific prior written permission."],
    "CC-BY-4.0": [_CC.format(name="Attribution"), _CC_WORK.format(name="Attribution")],
    "CC-BY-NC-4.0": [_CC.format(name="Attribution-NonCommercial"), _CC_WORK.format(name="Attribution-NonCommercial")],
    # Other members of the family, so that they are not taken for the two above.
    "CC-BY-SA-4.0": [_CC.format(name="Attribution-ShareAlike"), _CC_WORK.format(name="Attribution-ShareAlike")],
    "CC-BY-ND-4.0": [_CC.format(name="Attribution-NoDerivatives"), _CC_WORK.format(name="Attribution-NoDerivatives")],
    "CC-BY-NC-SA-4.0": [_CC.format(name="Attribution-NonCommercial-ShareAlike"), _CC_WORK.format(name="Attribution-NonCommercial-ShareAlike")],
    "CC-BY-NC-ND-4.0": [_CC.format(name="Attribution-NonCommercial-NoDerivatives"), _CC_WORK.format(name="Attribution-NonCommercial-NoDerivatives")],
    "CC0-1.0": ["To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this "
                "software to the public domain worldwide."],
    "MIT": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
            "is furnished to do so, subject to the following conditions:",
            "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
                "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."],
} | {f"{short}-{v}": [form.format(what=what, name=name, v=w) for form in (_GNU, _GNU_ONLY) for what in ("program", "library")
                      for w in {v, v.removesuffix(".0")}] + [f"GNU {name} Version {v.removesuffix('.0')}, {date}"]
     for short, name, v, date in (("GPL", "General Public License", "1.0", "February 1989"), ("GPL", "General Public License", "2.0", "June 1991"), ("GPL", "General Public License", "3.0", "29 June 2007"),
                                  ("LGPL", "Library General Public License", "2.0", "June 1991"),
                                  ("LGPL", "Lesser General Public License", "2.1", "February 1999"),
                                  ("LGPL", "Lesser General Public License", "3.0", "29 June 2007"),
                                  ("AGPL", "Affero General Public License", "3.0", "19 November 2007"))}
FULL_TEXTS = ("Apache-2.0", "Artistic-1.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.0",
              "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-1.1", "MPL-2.0")
#: Words that a block filter takes last, as most prose has some.
PLAIN = frozenset("a all and any as at be by can either except file files for found from have if in is it later may more no not of on one or "
                  "person persons subject terms that the this to under use used version was which with without you your".split())
#: Ends of a block: a sentence's end, a line without letters or digits, a copyright line.
BLOCK_END = (r"(?im)(?<=[.!?])\s+|\n[^A-Za-z0-9\n]*\n"
             r"|^[^A-Za-z0-9\n]*(?:copyright\b|\(c\)|\u00a9)[^\n]*(?:\n|\z)")
SPDX = r"(?i)\bSPDX-License-Identifier:[ \t]*([^\n]*)"
LOOKUP = 8192
#: Least document frequency weight among the forms: full texts are mostly words that every text has.
FORM_IDF = 0.1
LICENCE_NAME = r"(?i)(?:^|/)(?:licen[cs]e|copying|notice)[^/]*$"
WORD = re.compile("[A-Za-z0-9]+")


def words(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


def template_weights(templates: dict[str, str], least_idf: float = 1.0) -> tuple[dict[str, float], float, dict[str, dict[str, float]]]:
    """(idf by word, idf of any other word, unit vectors by template)."""
    n = len(templates)
    seen = Counter(w for t in templates.values() for w in set(words(t)))
    idf = {w: math.log((1 + n) / (1 + k)) + least_idf for w, k in seen.items()}
    vectors = {}
    for name, text in templates.items():
        raw = {w: k * idf[w] for w, k in Counter(words(text)).items()}
        size = math.sqrt(sum(v * v for v in raw.values()))
        vectors[name] = {w: v / size for w, v in raw.items()}
    return idf, math.log(1 + n) + least_idf, vectors


def full_text(licence: str) -> str:
    return resources.files(__package__).joinpath("licence_texts", f"{licence}.txt").read_text("utf-8")


@lru_cache(maxsize=1)
def licence_forms() -> tuple[tuple[str, bool, str], ...]:
    """(licence, whether it is a full text, text) of all forms."""
    return (*[(n, False, t) for n, forms in HEADERS.items() for t in dict.fromkeys(forms)],
            *[(n, True, full_text(n)) for n in FULL_TEXTS])


@lru_cache(maxsize=1)
def form_weights() -> tuple[dict[str, float], float, dict[str, dict[str, float]]]:
    return template_weights({str(i): t for i, (_, _, t) in enumerate(licence_forms())}, FORM_IDF)


def needed_words(vectors: dict[str, dict[str, float]], least: float, last: frozenset[str] = frozenset()) -> list[str]:
    """Words of which a unit must have one to reach ``least`` with any template."""
    out = set()
    for vector in vectors.values():
        # Heavy words first, short ones last: any choice is exact, long words leave fewer units over.
        rest = sorted(vector.items(), key=lambda x: (x[0] in last or x[0].isdigit() if last else len(x[0]) < 5, -x[1], -len(x[0]), x[0]))
        while math.sqrt(sum(v * v for _, v in rest)) >= least - 1e-9:
            out.add(rest.pop(0)[0])
    return sorted(out)


def template_lookup(templates: dict[str, str]) -> tuple[Callable[[Column], Column], float, int]:
    """(word -> struct (idf, v) or null, idf of any other word, number of templates), for few words: a literal map."""
    idf, other, vectors = template_weights(templates)
    table = F.create_map(*[x for w, v in idf.items() for x in (F.lit(w), F.struct(
        F.lit(v).alias("idf"), F.array(*[F.lit(vec.get(w, 0.0)) for vec in vectors.values()]).alias("v")))])
    return lambda word: F.try_element_at(table, word), other, len(vectors)


@lru_cache(maxsize=2)
def _form_table(full: bool) -> str:
    """JSON of an array by CRC-32 of arrays of (word, idf, weights in the forms; null in none of them)."""
    idf, _, vectors = form_weights()
    own = [vectors[str(i)] for i, f in enumerate(licence_forms()) if f[1] == full]
    cells: list[list] = [[] for _ in range(LOOKUP)]
    for w, v in idf.items():
        weights = [vec.get(w, 0.0) for vec in own]
        cells[zlib.crc32(w.encode()) % LOOKUP].append({"word": w, "idf": v, "v": weights if any(weights) else None})
    return json.dumps(cells, separators=(",", ":"))


def form_lookup(full: bool) -> tuple[Callable[[Column], Column], float, int]:
    """As ``template_lookup`` for the full texts or the headers among the forms, in constant time for a word."""
    table = F.from_json(F.lit(_form_table(full)), "array<array<struct<word:string,idf:double,v:array<double>>>>")  # folded once

    def known(word: Column) -> Column:
        cell = F.get(table, F.pmod(F.crc32(word), F.lit(LOOKUP)).cast("int"))
        return F.get(F.filter(cell, lambda x: x["word"] == word), F.lit(0))

    return known, form_weights()[1], sum(f[1] == full for f in licence_forms())


def unit_cosines(unit: Column, lookup: tuple[Callable[[Column], Column], float, int]) -> Column:
    """Cosines of a unit with all templates, an array in their order.

    The unit's words are sorted, and one pass over them sums squares and dot
    products at the end of each run of equal words: nothing is exploded or
    shuffled, and the time is that of sorting the unit's words.
    """
    find, other, n = lookup
    terms = F.transform(F.filter(F.split(unit, "[^A-Za-z0-9]+"), lambda w: w != ""), F.lower)
    start = F.struct(F.lit("").alias("word"), F.lit(0.0).alias("run"), F.lit(0.0).alias("square"),
                     F.array(*[F.lit(0.0)] * n).alias("dots"))

    def step(acc, word):
        def ended_with(known):
            x = acc["run"] * F.coalesce(known["idf"], F.lit(other))
            return F.struct(word.alias("word"), F.lit(1.0).alias("run"), (acc["square"] + x * x).alias("square"),
                            F.when(known["v"].isNull(), acc["dots"]).otherwise(
                                F.zip_with(acc["dots"], known["v"], lambda d, v: d + x * v)).alias("dots"))

        ended = F.get(F.transform(F.array(find(acc["word"])), ended_with), F.lit(0))  # the table stands once in the plan
        longer = F.struct(acc["word"].alias("word"), (acc["run"] + 1).alias("run"), acc["square"].alias("square"), acc["dots"].alias("dots"))
        return F.when(word == acc["word"], longer).otherwise(ended)

    return F.aggregate(F.concat(F.array_sort(terms), F.array(F.lit(""))), start, step, lambda acc: F.transform(
        acc["dots"], lambda d: F.when(acc["square"] > 0, F.round(d / F.sqrt(acc["square"]), 6)).otherwise(F.lit(0.0))))


def any_word(needed: list[str]) -> Column:
    return F.lit(r"(?i)(?<![A-Za-z0-9])(?:" + "|".join(needed) + r")(?![A-Za-z0-9])")


def best_unit(units: Column, lookup: tuple[Callable[[Column], Column], float, int], names: list[str]) -> Column:
    """STRUCT(less, licence) of the best unit and template, null without units."""
    literal = F.array(*[F.lit(n) for n in names])
    return F.array_min(F.transform(F.array_distinct(units), lambda u: F.array_min(F.zip_with(
        unit_cosines(u, lookup), literal, lambda c, n: F.struct((-c).alias("less"), n.alias("licence"))))))


def spdx_licence(text: Column) -> Column:
    """STRUCT(less, licence) of the first known name in the text's SPDX tags, null without one."""
    names = sorted({*HEADERS, *FULL_TEXTS})
    table = F.create_map(*[x for n in names for x in (F.lit(n.lower()), F.lit(n))])
    ids = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(SPDX), 1), lambda x: F.regexp_extract_all(x, F.lit("[A-Za-z0-9.+-]+"), 0)))
    known = F.transform(ids, lambda x: F.try_element_at(table, F.regexp_replace(F.lower(x), r"(?:-only|-or-later|\+)$", "")))
    best = F.array_min(known)
    return F.when(F.regexp_like(text, F.lit(SPDX)) & best.isNotNull(), F.struct(F.lit(-1.0).alias("less"), best.alias("licence")))


def form_licence(path: Column, text: Column, least: float) -> Column:
    """STRUCT(less, licence) of the best block, full text or SPDX tag, null without units."""
    forms, vectors = licence_forms(), form_weights()[2]
    headers = {str(i): vectors[str(i)] for i, f in enumerate(forms) if not f[1]}
    some = any_word(needed_words(headers, least, PLAIN))
    blocks = F.filter(F.split(text, BLOCK_END), lambda x: F.regexp_like(x, some))
    block = F.when(F.regexp_like(text, some), best_unit(blocks, form_lookup(False), [f[0] for f in forms if not f[1]]))
    whole = F.when(F.regexp_like(path, F.lit(LICENCE_NAME)), best_unit(F.array(text), form_lookup(True), [f[0] for f in forms if f[1]]))
    return F.array_min(F.array(block, whole, spdx_licence(text)))


def own_licence(path: Column, text: Column, templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> Column:
    """STRUCT(less, licence) of a file's best unit, less being the cosine's negative; null below ``least``."""
    vectors = template_weights(templates)[2]
    some = any_word(needed_words(vectors, least))
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, some))
    whole = F.when(F.regexp_like(path, F.lit(LICENCE_NAME)), F.array(text)).otherwise(F.array().cast("array<string>"))
    notice = F.when(F.regexp_like(text, some), best_unit(F.concat(lines, whole), template_lookup(templates), list(vectors)))
    best = F.array_min(F.array(notice, form_licence(path, text, least)))
    return F.when(best["less"] <= -least, best)


def scan_licences(files: DataFrame, path_col: str = "path", text_col: str = "text",
                  templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """``files`` with licence, cosine, licence_origin (file, header, inherited) and licence_dir."""
    check_columns(files, path_col, text_col)
    p, d, own, near = fresh(files, "p", "d", "own", "near")
    keyed = files.select("*", F.coalesce(col(path_col).cast("string"), F.lit("")).alias(p),
                         F.when(col(path_col).isNotNull(), F.regexp_extract(col(path_col).cast("string"), "(?s)^(.*)/[^/]*$", 1)).alias(d))
    keyed = keyed.select("*", own_licence(col(p), text_of(text_col), templates, least).alias(own))
    is_file = F.regexp_like(col(p), F.lit(LICENCE_NAME))
    given = (keyed.where(is_file & col(d).isNotNull()).where(col(own).isNotNull()).groupBy(col(d).alias("above"))
             .agg(F.min(F.struct(col(own)["less"].alias("less"), col(own)["licence"].alias("licence"), col(p).alias("path"))).alias("best"))
             .select("above", F.col("best.licence").alias("dir_licence")))
    depth = F.size(F.split(col(d), "/"))
    places = (keyed.where(col(d).isNotNull()).select(d).distinct()
              .select(d, F.explode(F.array_distinct(F.concat(F.array(F.lit("")), F.transform(
                  F.sequence(F.lit(1), depth), lambda k: F.array_join(F.slice(F.split(col(d), "/"), F.lit(1), k), "/"))))).alias("above")))
    nearest = (places.join(given, "above").groupBy(d)
               .agg(F.max_by(F.struct("above", "dir_licence"), F.length("above")).alias(near)))
    full = keyed.join(nearest, d, "left")
    taken = {c.lower() for c in files.columns}
    out = {"licence": F.coalesce(col(own)["licence"], col(near)["dir_licence"]), "cosine": -col(own)["less"],
           "licence_origin": F.when(col(own).isNotNull(), F.when(is_file, "file").otherwise("header"))
           .when(col(near).isNotNull(), "inherited"),
           "licence_dir": F.when(col(own).isNull(), col(near)["above"])}
    return full.select(*[col(c) for c in files.columns], *[v.alias(k if k not in taken else f"_{k}") for k, v in out.items()])
