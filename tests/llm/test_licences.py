import math
import re
from collections import Counter

from pyspark.sql import functions as F

from tidemark.llm.licences import TEMPLATES, document_paths, licence_scan

SPEAKS = re.compile(r"(?i)licen[cs]|copyright|spdx|public domain|all rights reserved|permission is hereby granted|redistribut")
TERM = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def cosine(text, least=0.6):
    bags = [Counter(TERM.findall(t.lower())) for _, t in TEMPLATES]
    seen = Counter(w for b in bags for w in b)
    idf = lambda w: math.log((1 + len(bags)) / (1 + seen[w])) + 1 if w in seen else math.log(1 + len(bags)) + 1
    mine = Counter(TERM.findall(text.lower()))
    norm = lambda b: math.sqrt(sum((n * idf(w)) ** 2 for w, n in b.items()))
    best = (0.0, "")
    for (name, _), b in zip(TEMPLATES, bags, strict=True):
        c = sum(n * idf(w) * b[w] * idf(w) for w, n in mine.items()) / (norm(mine) * norm(b) or 1)
        best = max(best, (round(c, 9), name))
    return best if best[0] >= least else None


ROWS = [
    (1, "a/b/c/code.py", "print(1) and so on\n# Licensed under the Apache License, Version 2.0.\nmore"),
    (2, "a/LICENSE", "Released under the MIT License."),
    (3, "a/b/x.py", "nothing"),
    (4, "a/b/COPYING", "This work is licensed under the GNU General Public License, version 3.\n" + "word " * 30),
    (5, "a/b/c/d/e/deep.txt", None),
    (6, "z/y.txt", "a licence to kill is not a licence at all says the agent"),
    (7, None, "Licensed under CC BY-NC 4.0."),
    (8, None, ""),
    (9, "a//b2/q.txt", "x " * 5000 + "\nlicensed under cc by-nc 4.0"),
    (10, "top.txt", "plain"),
    (11, "a/b2/r.txt", "plain"),
    (11, "a/b2/r.txt", "plain"),
    (None, "a/LICENSE", "Licensed under CC BY 4.0."),
]


def test_against_brute_force(spark):
    df = spark.createDataFrame([(*r, "x", 1.0) for r in ROWS], "doc_id long, path string, text string, licence string, similarity double")
    got = {r.doc_id: r for r in licence_scan(df).collect()}
    assert licence_scan(df).count() == len(ROWS) - 1
    for d, _, text in ROWS:
        if d is None:
            continue
        hits = [c for line in (text or "").split("\n") if SPEAKS.search(line) and (c := cosine(line))]
        if hits:
            score, name = max(hits)
            assert (got[d].licence, got[d].found in ("header", "file")) == (name, True) and abs(got[d].similarity - score) < 1e-5
    assert {d: r.found for d, r in got.items()} == {1: "header", 2: "file", 3: "inherited", 4: "file", 5: "inherited", 6: "none", 7: "file", 8: "none", 9: "header", 10: "none", 11: "inherited"}
    assert (got[3].licence, got[3].from_folder, got[5].licence, got[11].licence) == ("GPL-3.0", "/a/b", "GPL-3.0", "MIT")


def test_empty_and_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert licence_scan(document_paths(docs)).collect() == []
    docs = spark.createDataFrame([(4, "Released under the MIT License.", None, "s"), (5, "t", None, "s")], docs.schema)
    assert {r.doc_id: (r.licence, r.found) for r in licence_scan(document_paths(docs)).collect()} == {4: ("MIT", "file"), 5: ("MIT", "inherited")}


MPL = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */"
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
GPL = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."


def test_wrapped_headers(spark):
    import textwrap

    code = "\nint main() { return run(argc, argv); }" * 30
    rows, want = [(1, "p/mpl.c", MPL + code), (2, "q/LICENSE", "This Source Code Form is subject to the terms of the Mozilla\nPublic Use\n" + "x\n" * 3)], {1: "MPL-2.0", 2: "MPL-2.0"}
    for text, name in ((MIT, "MIT"), (BSD, "BSD-3-Clause"), (GPL, "GPL-3.0")):
        for width in (12, 24, 40, 72):
            n = len(rows) + 1
            rows.append((n, f"{n}/x.c", "head words\n\n" + "\n".join("// " + x for x in textwrap.wrap(text, width)) + code))
            want[n] = name
    rows += [(90, "n/1.txt", "Mit.\nVersion mit\nby 4.0\nBy\nmit the\nthis work is in the"), (91, "m/only.txt", MPL)]
    got = {r.doc_id: r for r in licence_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert {n: got[n].licence for n in want} == want
    assert (got[1].found, got[90].found, got[91].licence, got[91].found) == ("header", "none", "MPL-2.0", "header")
    assert got[1].similarity > 0.9 and min(got[n].similarity for n in want if n > 2) > 0.8


def test_identifiers_texts_and_usual_headers(spark):
    from tidemark.llm.licences import TEXTS

    code = "\nint main() { return run(argc, argv); }" * 30
    rows = [
        (1, "a/x.go", "// Copyright 2009 The Go Authors. All rights reserved.\n// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file." + code),
        (2, "b/x.c", "// SPDX-License-Identifier: GPL-2.0-or-later" + code), (3, "c/x.c", "/* SPDX-License-Identifier: (MIT OR Apache-2.0) */" + code),
        (4, "d/x.c", "# This file is licensed under the GNU General Public License." + code), (5, "e/LICENSE", "Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/\n" + "1. Definitions and so on, words of the terms. " * 200),
        (6, "f/COPYING", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n" + "Everyone is permitted to copy this document. " * 200),
    ]
    want = {1: "BSD-3-Clause", 2: "GPL-2.0-or-later", 3: "(MIT OR Apache-2.0)", 4: "GPL", 5: "Apache-2.0", 6: "GPL-3.0"}
    for i, (name, text) in enumerate(TEXTS):
        rows.append((100 + i, f"t{i}/LICENSE.txt", text.replace(". ", ".\n").replace("Copyright ", "Copyright (c) 2020 Some Body and others\n\n", 1)))
        rows.append((200 + i, f"t{i}/src/deep/x.py", "import os"))
        want |= {100 + i: name, 200 + i: name}
    got = {r.doc_id: r for r in licence_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert {n: got[n].licence for n in want} == want
    assert got[2].similarity == 1.0 and got[5].found == "file" and got[200].from_folder == "/t0"


def test_very_long_texts_and_clashing_columns(spark):
    rows = [(1, "a/x.txt", "word " * 400_000 + "\nReleased under the MIT License.\n" + "x\n" * 100_000, "n", 0.5, True, "f", "l"), (1, "a/x.txt", "word " * 400_000, "n", 0.5, True, "f", "l"), (2, None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string, licence string, similarity double, is_file boolean, folder string, line string")
    got = sorted((r.doc_id, r.licence, r.found) for r in licence_scan(df).collect())
    assert got == [(1, "MIT", "header"), (1, "MIT", "header"), (2, None, "none")]


def test_a_text_of_very_many_lines(spark):
    """500,000 lines (25 MB), with a header on three lines in the midst of them."""
    line, header = "some words of a long file without any notice at all\n", "# Licensed under the\n# Apache License,\n# Version 2.0\n"
    df = spark.createDataFrame([(1, "a/x.txt", "s")], "doc_id long, path string, text string").withColumn("text", F.concat(F.repeat(F.lit(line), 300_000), F.lit(header), F.repeat(F.lit(line), 200_000)))
    assert [(r.licence, r.found) for r in licence_scan(df).collect()] == [("Apache-2.0", "header")]


def test_blocks_over_the_border_of_a_stretch(spark, monkeypatch):
    from tidemark.llm import licences

    rows = [(i, f"d{i}/x.txt", "Filler line here\n" * i + "# Licensed under the\n# Apache License,\n# Version 2.0\n" + "More words follow\n" * 7) for i in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    want = sorted(map(tuple, licence_scan(df).collect()))
    monkeypatch.setattr(licences, "STRETCH", 4)
    assert sorted(map(tuple, licence_scan(df).collect())) == want and {r[2] for r in want} == {"Apache-2.0"}
