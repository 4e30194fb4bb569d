import math
import re
from collections import Counter

from loomspark.llm import licenses as L


def cosine(text, k):
    _, idf, other = L.template_weights(L.TEMPLATES)
    vec = lambda s: {t: f * idf.get(t, other) for t, f in Counter(re.findall(L.TERM, s.lower())).items()}
    a, b = vec(text), vec(L.TEMPLATES[k][1])
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    return sum(a[t] * b.get(t, 0) for t in a) / (norm(a) * norm(b)) if a else 0.0


def same_kind(text, k):
    """The version and the telling words of template k are all in the text, and no other modifier."""
    spell = lambda t: t.removeprefix("v").removesuffix(".0") if re.fullmatch(r"v?\d+(\.\d+)?", t) else t
    words, own = {spell(t) for t in L._terms(text)}, L._terms(L.TEMPLATES[k][1])
    versions = {spell(t) for i, t in enumerate(own) if re.fullmatch(r"\d+(\.\d+)?", t) and ("." in t or (i and own[i - 1] in ("version", "v")))}
    telling = set(own) & {*L.FAMILIES, *L.MODIFIERS}
    return versions | telling <= words and words & set(L.MODIFIERS) <= telling


ROWS = [
    (1, "Released under the MIT License.\nfile", "src/LICENSE"),
    (2, "code\nLicensed under CC BY-NC 4.0.\ncode", "src/a/x.py"),
    (3, "plain", "src/a/b/y.py"),
    (4, "Licensed under the Apache License, Version 2.0.", "src/a/b/COPYING"),
    (5, "plain", "src/a/b/c/z.py"),
    (6, "plain", "other/z.py"),
    (7, None, "src/a/n.py"),
    (8, "", None),
    (None, "All rights reserved.", "null/f"),
    (9, "in the null", "null/g"),
    (10, "plain", "src/a/b/y.py"),
    (10, "plain", "src/a/b/y.py"),
]


def test_inheritance(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, path string").withColumnRenamed("path", "p").selectExpr("*", "1 AS score", "'x' AS dir")
    got = {(r.doc_id, r.license, r.origin, r.license_dir, r.license_id) for r in L.scan_licenses(df, "p").collect()}
    assert got == {
        (1, "MIT", "own", "src", 1),
        (2, "CC-BY-NC-4.0", "own", "src/a", 2),
        (3, "Apache-2.0", "inherited", "src/a/b", 4),
        (4, "Apache-2.0", "own", "src/a/b", 4),
        (5, "Apache-2.0", "inherited", "src/a/b", 4),
        (6, None, "none", None, None),
        (7, "CC-BY-NC-4.0", "inherited", "src/a", 2),  # row 2 is short: its whole text reaches the threshold
        (8, None, "none", None, None),
        (None, "proprietary", "own", "null", None),
        (9, "proprietary", "inherited", "null", None),
        (10, "Apache-2.0", "inherited", "src/a/b", 4),
    }


def test_anchors_lose_nothing():
    """Whatever reaches the threshold holds an anchor: texts made of a template's most common terms stay under it."""
    weights, _, _ = L.template_weights(L.TEMPLATES)
    found = set(L.anchors(weights, 0.75))
    for k, (_, text) in enumerate(L.TEMPLATES):
        rest = [t for t in re.findall(L.TERM, text.lower()) if t not in found]
        assert cosine(" ".join(rest), k) < 0.75
        assert found & set(re.findall(L.TERM, text.lower()))


def test_scores_match_brute_force(spark):
    lines = ["This work is licensed under the GNU General Public License, version 2", "the mit license", "licensed under cc by-nc-sa 4.0", "GNU General Public License v3.0", "GNU General Public License version 4", "GNU General Public License", "Mozilla Public License, Version 1.1", "the apache license", "GNU Affero General Public License version 2"]
    df = spark.createDataFrame([(i, t, f"d{i}/x") for i, t in enumerate(lines)], "doc_id long, text string, path string")
    got = {r.doc_id: (r.license, r.score) for r in L.scan_licenses(df, "path").collect()}
    for i, t in enumerate(lines):
        best = max(((round(cosine(t, k), 6), -k) for k in range(len(L.TEMPLATES)) if same_kind(t, k)), default=(0.0, 0))
        want = (L.TEMPLATES[-best[1]][0], best[0]) if best[0] >= 0.75 else (None, None)
        assert got[i] == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, path string")
    assert L.scan_licenses(df, "path").count() == 0


MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
CLAUSES = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
THIRD = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
AS_IS = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED.
"""
HOLDER = "Copyright (c) 2024, Acme\nAll rights reserved.\n\n"
FILES = [
    ("MIT", "MIT License\n\nCopyright (c) 2024 Acme\n\n" + MIT_GRANT),
    ("MIT", "Copyright (c) 2024 Acme\n\n" + MIT_GRANT),
    ("BSD-2-Clause", HOLDER + CLAUSES + AS_IS),
    ("BSD-3-Clause", HOLDER + CLAUSES + THIRD + AS_IS),
    ("GPL-3.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc."),
    ("LGPL-3.0", "                   GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc."),
    ("Apache-2.0", "\n                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n"),
    ("MPL-2.0", "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n"),
    ("ISC", "Copyright (c) 2024, Acme\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public\nLicense\n\nBy exercising the Licensed Rights\n"),
]
CODE = "import os\n\ndef run(path):\n    return os.listdir(path)\n" + "\n".join(f"x{k} = y{k} + z{k}" for k in range(60)) + "\n"
HEADERS = [
    ("MIT", "# SPDX-License-Identifier: MIT\n" + CODE),
    ("GPL-2.0", CODE + "// SPDX-License-Identifier: GPL-2.0-or-later\n"),
    ("proprietary", CODE + "// Copyright 2024 Acme. All rights reserved.\n"),
    ("GPL-3.0", CODE + " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n"),
    ("Apache-2.0", CODE + "# Licensed under the Apache License, Version 2.0 (the \"License\");\n# you may not use this file except in compliance with the License.\n"),
]
WRAPPED = [
    ("MIT", CODE + "Released under the\nMIT License.\n" + CODE),
    ("BSD-3-Clause", CODE + CLAUSES[:145] + CODE),
    ("Apache-2.0", CODE + "Licensed under the Apache\nLicense, Version 2.0.\n" + CODE),
    ("LGPL-3.0", CODE + "This work is licensed under the GNU Lesser\nGeneral Public License, version 3.\n" + CODE),
    ("MIT", CODE + "Foo is released under the MIT license, see the LICENSE file for all that it says.\n" + CODE),
]
NEITHER = ["mit", "from\nmit", "The MIT has a library of books", "Er kam mit der Bahn\nund ging mit\nmit", "The licence fee rose in all versions of the plan", "SPDX-License-Identifier: Foo-1.0"]


def scan(spark, texts):
    df = spark.createDataFrame([(i, t, f"d{i}/x") for i, t in enumerate(texts)] + [(1000 + i, "plain", f"d{i}/sub/y") for i in range(len(texts))], "doc_id long, text string, path string")
    got = {r.doc_id: (r.license, r.origin) for r in L.scan_licenses(df, "path").collect()}
    return [got[i] for i in range(len(texts))], [got[1000 + i] for i in range(len(texts))]


def test_license_files_pass_on(spark):
    own, below = scan(spark, [t for _, t in FILES])
    assert own == [(n, "own") for n, _ in FILES]
    assert below == [(n, "inherited") for n, _ in FILES]


def test_headers(spark):
    own, below = scan(spark, [t for _, t in HEADERS] + NEITHER)
    assert own == [(n, "own") for n, _ in HEADERS] + [(None, "none")] * len(NEITHER)
    assert below[1:] == [(None, "none")] * (len(own) - 1)  # only the tag at the very start counts as a file


def test_wrapped_and_embedded_notices(spark):
    own, _ = scan(spark, [t for _, t in WRAPPED])
    assert own == [(n, "own") for n, _ in WRAPPED]


OTHERS = [
    ("GPL-1.0", "                    GNU GENERAL PUBLIC LICENSE\n                     Version 1, February 1989\n\n Copyright (C) 1989 Free Software Foundation, Inc."),
    ("LGPL-2.0", "                  GNU LIBRARY GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1991 Free Software Foundation, Inc."),
    ("LGPL-2.1", "                  GNU LESSER GENERAL PUBLIC LICENSE\n                       Version 2.1, February 1999\n"),
    ("GFDL-1.2", "                GNU Free Documentation License\n                  Version 1.2, November 2002\n"),
    ("GFDL-1.3", "                GNU Free Documentation License\n                 Version 1.3, 3 November 2008\n"),
    ("MPL-1.1", "                          MOZILLA PUBLIC LICENSE\n                                Version 1.1\n\n1. Definitions.\n"),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License\nVersion 1.1 (the \"License\"); you may not use this file except in\ncompliance with the License. You may obtain a copy of the License at\nhttp://www.mozilla.org/MPL/\n"),
    ("Artistic-1.0", "\t\t\t The \"Artistic License\"\n\n\t\t\t\tPreamble\n\nThe intent of this document is to state the conditions under which a\nPackage may be copied\n"),
    ("PSF-2.0", "PYTHON SOFTWARE FOUNDATION LICENSE VERSION 2\n--------------------------------------------\n"),
    ("HPND", "Copyright 1993 Acme\n\nPermission to use, copy, modify, distribute, and sell this software and its\ndocumentation for any purpose is hereby granted without fee, provided that\nthe above copyright notice appear in all copies and that both that\ncopyright notice and this permission notice appear in supporting\ndocumentation.\n"),
]


def test_versions_and_families(spark):
    own, below = scan(spark, [t for _, t in OTHERS] + [t.replace("\n", "\r\n") for _, t in OTHERS])
    assert own == [(n, "own") for n, _ in OTHERS] * 2
    assert below == [(n, "inherited") for n, _ in OTHERS] * 2


def test_one_idf_rule():
    """Wordings of a licence that is there change no idf, another licence does, and no list is treated otherwise."""
    _, idf, other = L.template_weights(L.TEMPLATES)
    known = L.TEMPLATES[2]
    assert L.template_weights([*L.TEMPLATES, known])[1:] == (idf, other)
    assert L.template_weights([*L.TEMPLATES, ("Acme-1.0", known[1])])[1]["apache"] < idf["apache"]
    names = {n for n, _ in L.TEMPLATES}
    for t in ("license", "mozilla", "2.0"):
        held = {n for n, text in L.TEMPLATES if t in L._terms(text)}
        assert math.isclose(idf[t], math.log((1 + len(names)) / (1 + len(held))) + 1)


def test_unknown_licence_files_keep_others_from_inheriting(spark):
    strange = "You may look at this program on Sundays.\n"
    rows = [
        (1, "Released under the MIT License.", "LICENSE"),
        (2, strange, "a/LICENSE.txt"),
        (3, "plain", "a/b/x.py"),
        (4, strange, "c/COPYING"),
        (5, "Released under the MIT License.", "c/LICENSE-MIT"),
        (6, "plain", "c/x.py"),
        (7, " \n", "d/LICENSE"),
        (8, None, "d/COPYING"),
        (9, "plain", "d/x.py"),
        (10, "def check(): pass", "a/license.py"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, path string")
    got = {r.doc_id: (r.license, r.score is None, r.origin, r.license_id) for r in L.scan_licenses(df, "path").collect()}
    mit = ("MIT", False, "inherited", 1)
    assert got == {1: ("MIT", False, "own", 1), 2: ("unknown", True, "own", 2), 3: ("unknown", True, "inherited", 2), 4: ("unknown", True, "own", 4), 5: ("MIT", False, "own", 5), 6: ("MIT", False, "inherited", 5), 7: mit, 8: mit, 9: mit, 10: ("unknown", True, "inherited", 2)}


def test_hard_rows(spark):
    """Very long text, null path and text, columns that clash, one id in two places, repeated rows."""
    long = " ".join(f"w{k % 5003}" for k in range(200_000))
    rows = [(1, long + "\nReleased under the MIT License.\n" + long, "x/y"), (2, None, None), (3, "All rights reserved.", None), (4, "plain", "p/a"), (4, "plain", "x/q/b"), (5, "plain", "r/s"), (5, "plain", "r/s"), (6, "Licensed under CC BY 4.0.", "r/t")]
    df = spark.createDataFrame([(*r, 1, 2, "z") for r in rows], "doc_id long, text string, path string, unit int, template int, dir string")
    got = sorted((r.doc_id, r.license, r.origin, r.license_id) for r in L.scan_licenses(df, "path").collect())
    assert got == [
        (1, "MIT", "own", 1),
        (2, "proprietary", "inherited", 3),
        (3, "proprietary", "own", 3),
        (4, "proprietary", "inherited", 3),
        (4, "proprietary", "inherited", 3),
        (5, "CC-BY-4.0", "inherited", 6),
        (5, "CC-BY-4.0", "inherited", 6),
        (6, "CC-BY-4.0", "own", 6),
    ]
