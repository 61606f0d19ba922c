import math
import random
import re
from collections import Counter, defaultdict

import pytest

from kappaflow.llm import licences as L


def brute_own(path, text):
    """Best (cosine, licence) over all lines and, for licence files, the whole text; no prefilter."""
    idf, other, vectors = L.template_weights(L.TEMPLATES)
    units = (text or "").split("\n") + ([text or ""] if re.search(L.LICENCE_NAME, path or "") else [])
    best = None
    for unit in units:
        raw = {w: k * idf.get(w, other) for w, k in Counter(L.words(unit)).items()}
        size = math.sqrt(sum(v * v for v in raw.values()))
        for name, vec in vectors.items():
            if size:
                value = round(sum(v * vec.get(w, 0) for w, v in raw.items()) / size, 6)
                if value >= L.LEAST and (best is None or (-value, name) < (-best[0], best[1])):
                    best = value, name
    return best


def brute(rows):
    own = [brute_own(p, t) for p, t in rows]
    given = defaultdict(list)
    for (p, _), o in zip(rows, own):
        if o and re.search(L.LICENCE_NAME, p or ""):
            given[p.rpartition("/")[0]].append((-o[0], o[1], p))
    out = []
    for (p, t), o in zip(rows, own):
        if o:
            out.append((p, t, o[1], o[0], "file" if re.search(L.LICENCE_NAME, p or "") else "header", None))
            continue
        d = p.rpartition("/")[0] if p is not None else None
        while d is not None and d not in given:
            d = d.rpartition("/")[0] if d else None
        out.append((p, t, min(given[d])[1] if d is not None else None, None, "inherited" if d is not None else None, d))
    return Counter(out)


MIT, ALL = "Released under the MIT License.", "All rights reserved."
ROWS = [("LICENSE", MIT), ("a/x.py", "# " + ALL + "\ncode"), ("a/y.py", "code"), ("a/b/COPYING", "words\n" + ALL), ("a/b/c/z.py", None), ("a/b/c/z.py", ""),
        ("a/b/LICENSE.txt", "Licensed under the Apache License, Version 2.0"), ("a/bb/q.py", "RELEASED under the mit LICENSE"), (None, MIT), (None, "x"),
        ("d/e", "licensed"), ("d/e", "licensed"), ("d/f/NOTICE", "nothing of the kind"), ("d/f/g/h", "mit"), ("a/b/n.py", MIT + " " + ALL),
        ("a/b/w.py", "all " * 5000 + "rights reserved"), ("lone", "x")]


def got(df):
    return Counter((r["path"], r["text"], r["licence"], r["cosine"], r["licence_origin"], r["licence_dir"]) for r in df.collect())


def test_tree(spark):
    df = spark.createDataFrame(ROWS, "path string, text string")
    assert got(L.scan_licences(df)) == brute(ROWS)
    assert got(L.scan_licences(df.where("path != 'LICENSE'"))) == brute([r for r in ROWS if r[0] not in (None, "LICENSE")])


def test_clashing_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(p, t, "mine", 1.0, "x") for p, t in ROWS], "path string, text string, licence string, above double, _mark string")
    out = L.scan_licences(df)
    assert out.schema.names == ["path", "text", "licence", "above", "_mark", "_licence", "cosine", "licence_origin", "licence_dir"]
    assert Counter((r["path"], r["text"], r["_licence"], r["cosine"], r["licence_origin"], r["licence_dir"]) for r in out.collect()) == brute(ROWS)
    assert L.scan_licences(df.where("false")).count() == 0


@pytest.mark.parametrize("least", [0.3, 0.6, 0.75, 0.95])
def test_prefilter_is_lossless(least):
    """Without its needed words a template's best possible cosine stays below the threshold."""
    vectors = L.template_weights(L.TEMPLATES)[2]
    needed = set(L.needed_words(vectors, least))
    for vec in vectors.values():
        assert math.sqrt(sum(v * v for w, v in vec.items() if w not in needed)) < least


MIT_TEXT = L.full_text("MIT").replace("<year> <copyright holders>", "2021 Jane Doe and others")
APACHE_HEAD = L.full_text("Apache-2.0")[:1500]
GPL_HEADER = """# {0}
# Copyright (C) 2020 Some Body <some@body.org>
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version {1} of the License, or
# (at your option) any later version.
import os
"""
MPL_HEADER = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at http://mozilla.org/MPL/2.0/. */
int x;"""
APACHE_LINE = ("first words. Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
               "with the License. You may obtain a copy of it. and more words")
FORM_FILES = [("m/LICENSE", MIT_TEXT, "MIT", "file"), ("m/x.py", "code", "MIT", "inherited"), ("a/LICENSE", APACHE_HEAD, "Apache-2.0", "file"),
              *[(f"t/{n}/COPYING", L.full_text(n), n, "file") for n in L.FULL_TEXTS],
              ("g/x.py", GPL_HEADER.format("tool", 3), "GPL-3.0", "header"), ("g/y.py", GPL_HEADER.format("tool", 2), "GPL-2.0", "header"),
              ("p/x.c", MPL_HEADER, "MPL-2.0", "header"), ("l/x.txt", APACHE_LINE, "Apache-2.0", "header"),
              ("i/x.py", "# " + MIT_TEXT.replace("\n", "\n# ") + "\nimport os", "MIT", "header"),
              ("s/a.c", "// SPDX-License-Identifier: MIT\nint x;", "MIT", "header"),
              ("s/b.c", "# SPDX-License-Identifier: GPL-3.0-or-later WITH x", "GPL-3.0", "header"),
              ("s/c.c", "/* SPDX-License-Identifier: GPL-2.0 */", "GPL-2.0", "header"), ("s/d.c", "SPDX-License-Identifier: Unknown-1.0", None, None),
              ("n/NOTICE", "The library opens at nine. It is free for all persons, without any terms of use.", None, None)]


def test_full_texts_headers_and_tags(spark):
    df = spark.createDataFrame([r[:2] for r in FORM_FILES], "path string, text string")
    out = {r["path"]: (r["licence"], r["licence_origin"]) for r in L.scan_licences(df).collect()}
    assert out == {p: (lic, origin) for p, _, lic, origin in FORM_FILES}


@pytest.mark.parametrize("least", [0.6, 0.75])
def test_block_filter_is_lossless(least):
    vectors = L.form_weights()[2]
    headers = [vectors[str(i)] for i, f in enumerate(L.licence_forms()) if not f[1]]
    needed = set(L.needed_words(dict(enumerate(headers)), least, L.PLAIN))
    for vec in headers:
        assert math.sqrt(sum(v * v for w, v in vec.items() if w not in needed)) < least


def brute_forms(path, text):
    """(best cosine, licences that reach it) over notices, forms and tags: every unit against every template, no filter."""
    text, licence_file = text or "", re.search(L.LICENCE_NAME, path or "")
    blocks = re.split(L.BLOCK_END.replace(r"\z", r"\Z").replace("(?im)", "(?aim)"), text)
    forms = L.licence_forms()
    idf, other, vectors = L.form_weights()
    found = [(-value, name) for value, name in [brute_own(path, text) or (0, "")] if name]

    def compare(unit, full):
        raw = {w: k * idf.get(w, other) for w, k in Counter(L.words(unit)).items()}
        size = math.sqrt(sum(v * v for v in raw.values()))
        for i, (name, is_full, _) in enumerate(forms):
            if size and is_full == full:
                found.append((-sum(v * vectors[str(i)].get(w, 0) for w, v in raw.items()) / size, name))

    for block in blocks:
        compare(block, False)
    if licence_file:
        compare(text, True)
    known = {n.lower(): n for n in (*L.HEADERS, *L.FULL_TEXTS)}
    for tag in re.findall(r"(?i)\bSPDX-License-Identifier:[ \t]*([^\n]*)", text):
        names = [re.sub(r"(-only|-or-later|\+)$", "", x.lower()) for x in re.findall("[A-Za-z0-9.+-]+", tag)]
        found += [(-1.0, known[n]) for n in names if n in known]
    best = min(found, default=(0, ""))[0]
    return -best, {n for v, n in found if v <= best + 2e-6}


def random_files(seed, number):
    """Files of pieces of every form: whole, cut, with words changed, in comments, between prose, tags and copyright lines."""
    rng = random.Random(seed)
    prose = "the work of a reader is free and may be used under any terms that a person has in mind when the software is copied".split()

    def piece():
        kind = rng.randrange(8)
        if kind == 0:
            return " ".join(rng.choices(prose, k=rng.randint(3, 25))) + rng.choice((".", "", "!"))
        if kind == 1:
            return rng.choice(("Copyright (C) 2020 Some Body", "(c) all of us", "", "---"))
        if kind == 2:
            names = [*L.HEADERS, *L.FULL_TEXTS, "Unknown-2.0"]
            return rng.choice(("", "// ", "x")) + "SPDX-License-Identifier: " + " OR ".join(rng.choice(names) + rng.choice(("", "-only", "+")) for _ in range(rng.randint(1, 2)))
        if kind == 3:
            return rng.choice(list(L.TEMPLATES.values())) + rng.choice((".", " and more"))
        words = rng.choice(L.licence_forms())[2].split(" ")
        if kind < 6 and len(words) > 60:
            at = rng.randrange(len(words) - 50)
            words = words[at:at + rng.randint(10, 50)]
        share = rng.choice((0, 0, 0.1, 0.3, 0.5))
        return " ".join(rng.choice(prose) if rng.random() < share else w for w in words)

    names = ("LICENSE", "COPYING.txt", "x.py", "y.c", "notice.md")
    return [(f"r/{i}/{rng.choice(names)}", rng.choice(("\n", "\n# ", " ", "\n\n")).join(piece() for _ in range(rng.randint(1, 5)))) for i in range(number)]


def test_every_form_against_brute_force(spark):
    rows = random_files(3, 250)
    out = {r["path"]: r for r in L.scan_licences(spark.createDataFrame(rows, "path string, text string").repartition(8)).collect()}
    wrong, kept, licences = [], Counter(), set()
    for path, text in rows:
        value, names = brute_forms(path, text)
        if abs(value - L.LEAST) < 2e-6:
            continue
        got = out[path]["licence"] if out[path]["licence_origin"] in ("file", "header") else None
        kept[got is not None] += 1
        licences.add(got)
        if (value >= L.LEAST) != (got is not None) or got and (got not in names or abs(out[path]["cosine"] - value) > 2e-6):
            wrong.append((path, value, names, got))
    assert not wrong and min(kept.values()) > 20 and len(licences) > 15
