"""Licence scan by sparse TF-IDF cosine with templates, and inheritance from the nearest directory above.

Everything is built-in DataFrame functions. Lines, and blocks of adjacent lines over which a header may be wrapped, are a
file's headers if they share a telling term with a template; a file that says little else, or that is named like a licence
file, is a licence file, and its whole text is compared too. All are compared with short templates: terms are weighted
by their count and by the inverse document frequency among the templates, and a term of no template counts in the length
of a vector at the highest weight, so unrelated words push the cosine down. A licence file speaks for its directory, and
a file without a header takes the licence of the nearest directory on its path that has one.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Identifier and wording of each template.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met. Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "Copyright. All rights reserved."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License"),
    ("GPL", "This work is licensed under the GNU General Public License."),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("EPL-2.0", "Eclipse Public License - v 2.0"),
    ("EUPL-1.2", "Licensed under the European Union Public Licence, version 1.2."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Artistic-2.0", "Licensed under the Artistic License 2.0."),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004"),
]
_MIT_END = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
_BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
#: Fixed value: texts of short licences, which the whole of a licence file is compared with; long ones are known by their titles.
TEXTS = [
    ("MIT", "MIT License Copyright Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _MIT_END + " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", f"Copyright {_BSD_START} {_BSD_END}"),
    ("BSD-3-Clause", f"Copyright {_BSD_START} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. {_BSD_END}"),
    ("ISC", f"ISC License Copyright Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_END}"),
    ("0BSD", f"Copyright Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_ISC_END}"),
    ("Zlib", "Copyright This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003 Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. " + _MIT_END),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _MIT_END),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE Version 2, December 2004 Copyright Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."),
]
#: An identifier of the software package data exchange, or several with operators between them.
SPDX = r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+()-]+(?:[ \t]+(?:OR|AND|WITH|or|and|with)[ \t]+[A-Za-z0-9.+()-]+)*)"
#: Lines that count for a licence file by its share of them, names of licence files, and terms.
SPEAKS = r"(?i)licen[cs]|copyright|spdx|public domain|all rights reserved|permission is hereby granted|redistribut"
NAMED = r"(?i)(^|/)(licen[cs]e|copying|unlicense)([.-][^/]*)?$"
TERM = r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"
#: Least cosine, and the share of a file's words in such lines that makes it a licence file.
LEAST, FILE_SHARE = 0.6, 0.8
#: Lines of a text whose blocks are made in one row.
STRETCH = 256
#: Terms of the templates that prose has too: alone, or with numbers, they name no licence ("by", "mit", "by 4.0").
FUNCTION = frozenset(
    "a above accompanying all and any are as associated at attribution be binary by can charge code compliance conditions copies copy deal dedicated do documentation either except"
    " fee file files following for form forms found free general http https in international into is it library may met mit not notice obtaining of or or person program provided public"
    " published purpose restriction see source subject terms that the this to txt under union universal use v version want what with without work you your"
    " january february june november december".split()
)


def weigh(templates: list[tuple[str, str]]) -> tuple[list[tuple[int, str, str, float]], float]:
    """Template number, licence, term and unit weight of each template's terms, and the weight of a term of none."""
    term = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")
    bags = [Counter(term.findall(text.lower())) for _, text in templates]
    seen = Counter(t for b in bags for t in b)
    idf = {t: math.log((1 + len(bags)) / (1 + n)) + 1 for t, n in seen.items()}
    rows = []
    for i, ((name, _), bag) in enumerate(zip(templates, bags, strict=True)):
        size = math.sqrt(sum((n * idf[t]) ** 2 for t, n in bag.items()))
        rows += [(i, name, t, n * idf[t] / size) for t, n in bag.items()]
    return rows, math.log(1 + len(bags)) + 1


def telling(term: str) -> bool:
    return term not in FUNCTION and not re.fullmatch(r"[\d.]+", term)


def block_terms(templates: list[tuple[str, str]], least: float) -> int:
    """Terms of a block of lines, at most: with more words of no template around it, no template reaches the least cosine."""
    rows, unknown = weigh(templates)
    most = 0
    for i, (_, said) in enumerate(templates):
        units = {t: u for n, _, t, u in rows if n == i}
        bag = Counter(re.findall(r"[^\W_]+(?:[.-][^\W_]+)*", said.lower()))
        idf = {t: math.log((1 + len(templates)) / (1 + sum(x[2] == t for x in rows))) + 1 for t in units}
        mass = sum((n * idf[t]) ** 2 for t, n in bag.items())
        most = max(most, sum(bag.values()) + math.ceil(mass * (1 / least**2 - 1) / unknown**2))
    return most


def match(parts: DataFrame, templates: list[tuple[str, str]], least: float) -> DataFrame:
    """Best licence and cosine of each part (part_id, text): part_id, licence, similarity; parts below `least` are left out.

    A part shares a telling term with its licence's template.
    """
    spark = parts.sparkSession
    rows, unknown = weigh(templates)
    # as many rows as the templates have terms
    known = F.broadcast(spark.createDataFrame([(*r, telling(r[2])) for r in rows], "template int, licence string, term string, unit double, tells boolean"))
    docs = Counter(t for _, _, t, _ in rows)
    idf = {t: math.log((1 + len(templates)) / (1 + n)) + 1 for t, n in docs.items()}
    weights = F.broadcast(spark.createDataFrame(list(idf.items()), "term string, idf double"))
    terms = parts.select("part_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"({TERM})"))).alias("term")).groupBy("part_id", "term").count()
    terms = terms.join(weights, "term", "left").withColumn("weight", F.col("count") * F.coalesce("idf", F.lit(unknown)))
    norms = terms.groupBy("part_id").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    dots = terms.where(F.col("idf").isNotNull()).join(known, "term").groupBy("part_id", "template", "licence").agg(F.sum(F.col("weight") * F.col("unit")).alias("dot"), F.max("tells").alias("tells")).where("tells")
    scored = dots.join(norms, "part_id").withColumn("similarity", F.round(F.col("dot") / F.col("norm"), 9)).where(F.col("similarity") >= least)
    best = F.max(F.struct("similarity", (-F.col("template")).alias("t"), "licence")).alias("b")
    return scored.groupBy("part_id").agg(best).select("part_id", F.col("b.licence").alias("licence"), F.col("b.similarity").alias("similarity"))


def _folders(path: Column) -> Column:
    """Directories above a path, the deepest first; the root is the empty string."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def licence_scan(files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST, file_share: float = FILE_SHARE) -> DataFrame:
    """One row per file (doc_id, path, text): doc_id, path, licence (null: none), similarity, found ("header", "file", "inherited" or "none"), from_folder.

    Of several headers the most similar counts, and of equal ones the last licence by name; likewise of several licence
    files in a directory. An SPDX identifier is taken as it stands, with a similarity of 1. The whole of a file that is
    named like a licence file is also compared with TEXTS. A header may be one line of any length, or be wrapped over lines that hold block_terms() terms
    together; lines without a term (empty ones, comment marks) do not part it.
    Nulls: a null text is empty; a file with a null path has no directory and inherits nothing; a row with a null doc_id
    is left out. Rows that repeat a doc_id are one file with the headers of all. An empty table gives no rows. Texts of any
    length are read whole. Other columns of files are not read, whatever their names.
    """
    path = F.regexp_replace(F.concat(F.lit("/"), F.col("path").cast("string")), "/+", "/")
    d = files.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), path.alias("path"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    own_terms = {t for _, _, t, _ in weigh(templates)[0]}
    strong = sorted(filter(telling, own_terms))
    # a file with a telling term has a piece of it that is no function word and no number
    pieces = sorted({x for t in strong for x in re.split(r"[.-]", t) if telling(x)})
    has = lambda c, these: F.arrays_overlap(c, F.array(*map(F.lit, these)))
    words = lambda c: F.regexp_count(c, F.lit(r"\S+"))
    spdx = F.regexp_extract_all("text", F.lit(SPDX), F.lit(1))
    named = F.coalesce(F.col("path").rlike(NAMED), F.lit(False))
    heard = d.where(named | has(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), pieces))
    said = F.filter(F.split("text", "\n"), lambda x: x.rlike(SPEAKS))
    terms = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("text"), F.regexp_extract_all(F.lower(x), F.lit(f"({TERM})")).alias("t")))
    lines = F.transform(F.filter(terms, lambda x: F.size(x["t"]) > 0), lambda x: F.struct(x["text"].alias("text"), F.size(x["t"]).alias("n"), has(x["t"], sorted(own_terms)).alias("known"), has(x["t"], strong).alias("tells")))
    is_file = named | (words(F.array_join(said, "\n")) >= file_share * words(F.col("text")))
    heard = cut(heard.select("doc_id", "path", is_file.alias("is_file"), words(F.col("text")).alias("words"), lines.alias("lines"), spdx.alias("spdx"), F.when(named, F.col("text")).alias("file_text"), F.when(is_file, F.array(F.array_join(said, " "), F.when(named, F.col("text")).otherwise(F.lit("")))).alias("whole")), "licence-lines")
    # blocks begin and end in lines with a term of a template: without other lines at its borders, a block is more similar
    most = block_terms(templates, least)
    # a text of many lines is taken in stretches, each with the lines that a block which begins in it may go on to
    stretches = F.transform(F.sequence(F.lit(0), F.floor((F.size("lines") - 1) / STRETCH).cast("int")), lambda i: F.slice("lines", i * STRETCH + 1, STRETCH + most - 1))
    stretch = heard.where(F.size("lines") > 0).select("doc_id", "path", "is_file", "words", F.explode(stretches).alias("s")).where(F.exists("s", lambda x: x["tells"]))
    starts = F.filter(F.transform(F.sequence(F.lit(1), F.least(F.size("s"), F.lit(STRETCH))), lambda i: F.slice("s", i, most)), lambda w: w[0]["known"] & F.exists(w, lambda x: x["tells"]))
    block = stretch.select("doc_id", "path", "is_file", "words", F.explode(starts).alias("w"))
    first = lambda n: F.slice("w", F.lit(1), n)
    fits = lambda n: (n == 1) | (F.aggregate(first(n), F.lit(0), lambda s, x: s + x["n"]) <= most)
    ends = F.filter(F.sequence(F.lit(1), F.size("w")), lambda n: F.get("w", n - 1)["known"] & fits(n) & F.exists(first(n), lambda x: x["tells"]))
    block = block.select("doc_id", "path", "is_file", "words", "w", F.explode(ends).alias("n"))
    block = block.select("doc_id", "path", "is_file", "words", F.array_join(F.transform(F.slice("w", F.lit(1), F.col("n")), lambda x: x["text"]), " ").alias("line"))
    whole = heard.where("is_file").select("doc_id", "path", "is_file", "words", F.explode("whole").alias("line")).where("line != ''")
    part = block.unionByName(whole)
    part = cut(part.select("doc_id", "path", (F.col("is_file") | (words(F.col("line")) >= file_share * F.col("words"))).alias("is_file"), "line"), "licence-parts")
    # one line or block is often said by many files, and is compared once
    distinct = part.select("line").distinct().select(F.sha2("line", 256).alias("part_id"), F.col("line").alias("text"))
    found = cut(match(distinct.select("part_id", "text"), templates, least), "licence-matches")
    own = part.select("doc_id", "path", "is_file", F.sha2("line", 256).alias("part_id")).join(found, "part_id").drop("part_id")
    told = heard.select("doc_id", "path", "is_file", F.explode("spdx").alias("licence"), F.lit(1.0).alias("similarity"))
    copies = heard.where("file_text IS NOT NULL").select("doc_id", "path", F.lit(True).alias("is_file"), F.sha2("file_text", 256).alias("part_id"), "file_text")
    texts = match(copies.select("part_id", F.col("file_text").alias("text")).dropDuplicates(["part_id"]), TEXTS, least)
    own = own.unionByName(told).unionByName(copies.drop("file_text").join(texts, "part_id").drop("part_id"))
    best = F.max(F.struct("similarity", "licence", "is_file")).alias("x")
    own = cut(own.groupBy("doc_id").agg(best, F.min("path").alias("own_path")), "licence-own")
    own = own.select("doc_id", F.col("x.is_file").alias("is_file"), "own_path", F.col("x.licence").alias("licence"), F.col("x.similarity").alias("similarity"))
    folder = F.get(_folders(F.col("own_path")), F.lit(0))
    speaks = own.where(F.col("is_file") & F.col("own_path").isNotNull()).groupBy(folder.alias("above")).agg(F.max(F.struct("similarity", "licence")).alias("y"))
    # directories, of which there are far fewer than files: the nearest one above each that has a licence
    here = F.get(_folders(F.col("path")), F.lit(0))
    folders = d.where(F.col("path").isNotNull()).select(here.alias("folder"), F.col("path")).groupBy("folder").agg(F.min("path").alias("path"))
    up = folders.select("folder", F.posexplode(_folders(F.col("path"))).alias("distance", "above")).join(speaks, "above")
    nearest = up.groupBy("folder").agg(F.min(F.struct("distance", "above", "y")).alias("n"))
    nearest = cut(nearest.select("folder", F.col("n.above").alias("above"), F.col("n.y.licence").alias("up_licence"), F.col("n.y.similarity").alias("up_similarity")), "licence-folders")
    out = d.select("doc_id", "path", here.alias("folder")).join(own.drop("own_path"), "doc_id", "left").join(nearest, "folder", "left")
    mine = F.col("licence").isNotNull()
    kind = F.when(mine & F.col("is_file"), "file").when(mine, "header").when(F.col("up_licence").isNotNull(), "inherited").otherwise("none")
    return out.select("doc_id", "path", F.coalesce("licence", "up_licence").alias("licence"), F.round(F.coalesce("similarity", "up_similarity"), 6).alias("similarity"), kind.alias("found"), F.when(kind == "inherited", F.col("above")).alias("from_folder"))


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: the source is a top directory, the language one below it, and a hundred of ids one below that; a third of the files lies in each."""
    top, mid = F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown"))
    turn, low = F.col("doc_id") % 3, F.floor(F.col("doc_id") / 100).cast("string")
    folder = F.when(turn == 0, top).when(turn == 1, F.concat_ws("/", top, mid)).otherwise(F.concat_ws("/", top, mid, low))
    return docs.select("doc_id", F.concat_ws("/", folder, F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "text")
