"""License scans by MinHash bands over overlapping text windows (operator 9), DataFrame operations only.

A template of n words is looked for in windows of n + stride - 1 words that start every
``stride`` (a quarter of n) words, so each occurrence of the template lies whole in some
window.  Of a window that holds a template of ten words or more to 0.8, the similarity with it is 0.5 or more:
(0.8 (n - 4)) / (n + stride - 5 + 0.2 (n - 4)), for the shortest templates 0.36 or more.  Bands of
one value, BANDS of them, retrieve it with probability 1 - 0.5**BANDS (0.64**BANDS) or more.  Retrieved windows are then tested exactly: the
part of the template's five-word shingles that they hold.

A window can share a band value only if it holds a shingle of the template, so documents and
windows without any are left out before hashing; nothing else is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_key, materialize, scratch, text_of

SHINGLE, BANDS, PERCENT = 5, 24, 80
DOC = ["_k1", "_k2"]

#: Notices by which licenses are commonly declared.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "MIT": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-opening": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC-opening": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense-opening": "This is free and unencumbered software released into the public domain.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "EPL-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty.",
}

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_MIT_END = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_BSD_1 = "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_2 = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD = TEMPLATES["BSD-opening"] + ":"

# The whole texts of licenses that are short enough to be copied whole, without their copyright lines.
TEMPLATES |= {
    "MIT": "Released under the MIT License.",
    "MIT-full": TEMPLATES["MIT-text"] + ", and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _MIT_END,
    "ISC-full": TEMPLATES["ISC-opening"] + ", provided that the above copyright notice and this permission notice appear in all copies. " + _AS_IS,
    "0BSD-full": TEMPLATES["ISC-opening"] + ". " + _AS_IS,
    "BSD-2-Clause-full": " ".join([_BSD, "1.", _BSD_1, "2.", _BSD_2, _BSD_END]),
    "BSD-3-Clause-full": " ".join([_BSD, "1.", _BSD_1, "2.", _BSD_2, "3.", _BSD_3, _BSD_END]),
    "Unlicense-full": TEMPLATES["Unlicense-opening"] + " Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. " + _MIT_END,
    "Zlib-full": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(hashes: str) -> Column:
    """Hashes of all five-word shingles in order, from a column of word hashes; none of shorter texts.

    Shifted copies are zipped, so the column is read a fixed number of times, not once a shingle.
    """
    n = F.size(hashes) - SHINGLE + 1
    out = F.slice(hashes, 1, F.greatest(n, F.lit(0)))
    for k in range(1, SHINGLE):
        out = F.zip_with(out, F.slice(hashes, k + 1, F.greatest(n, F.lit(0))), lambda a, b: F.xxhash64(a, b))
    return out


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def minima(hashes: Column) -> Column:
    """The least value of each of BANDS hash functions over a set of shingles, with the band's number."""

    def least(band: int) -> Column:
        return F.array_min(F.transform(hashes, lambda x: F.xxhash64(F.lit(band), x)))

    return F.array(*(F.struct(F.lit(b).alias("band"), least(b).alias("low")) for b in range(BANDS)))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(license, size, stride, set): one row a template; templates of fewer than five words are refused."""
    rows = spark.createDataFrame(list(templates.items()), "license string, text string")
    t = rows.select("license", word_hashes(F.col("text")).alias("w")).select("license", F.size("w").alias("size"), F.ceil(F.size("w") / 4).cast("int").alias("stride"), F.array_distinct(shingles("w")).alias("set"))
    short = [r["license"] for r in t.filter(F.size("set") == 0).collect()]
    if short:
        raise ValueError(f"templates need {SHINGLE} words: {short}")
    return t


def scan(df: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each input row: id, n_licenses, licenses, best_percent, best_license.

    ``licenses`` are the names of the templates of which some window of the whole text holds 80
    percent of the shingles or more, sorted and joined by commas; ``best_percent`` the highest of
    those parts (0 if none).  ``best_license`` is the template of which most shingles are held, the first
    by name of equals: where templates share an opening, it is the one that the whole text fits (null if none).  Null, empty and very short texts have none.  Rows that agree in id
    and text get the same result.  The templates are a dictionary, so what is broadcast of them
    is bounded by the caller.  An empty table gives no rows.  Other columns are not read.
    """
    with scratch(df.sparkSession):
        return _scan(df, templates, id_col, text)


def _scan(df: DataFrame, templates: dict[str, str], id_col: str, text: str) -> DataFrame:
    spark = df.sparkSession
    table = materialize(template_table(spark, templates), "templates")
    wanted = [r["h"] for r in table.select(F.explode("set").alias("h")).distinct().collect()]  # bounded by the templates
    keyed = df.select(F.col(id_col).alias("_id"), *doc_key(id_col, text), text_of(text).alias("_text"))
    hashed = keyed.select(*DOC, word_hashes(F.col("_text")).alias("w")).select(*DOC, shingles("w").alias("sh"))
    # explode() of null drops a row as a filter would, but isn't pushed below the hashing and so doesn't repeat it
    holding = F.explode(F.when(F.arrays_overlap("sh", F.lit(wanted)), F.array("sh")))
    some = materialize(hashed.select(*DOC, holding.alias("sh")), "shingled").dropDuplicates(DOC)

    kinds = table.select("size", "stride", F.explode("set").alias("h")).distinct()
    width = F.col("size") + F.col("stride") - 1  # words of a window
    hits = some.select(*DOC, F.posexplode("sh").alias("pos", "h")).join(F.broadcast(kinds), "h")
    # windows that hold the shingle's five words
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") + SHINGLE - width) / F.col("stride"))).cast("int")
    windows = hits.select(*DOC, "size", "stride", F.explode(F.sequence(first, F.floor(F.col("pos") / F.col("stride")).cast("int"))).alias("at")).distinct()
    per_doc = windows.groupBy(*DOC).agg(F.collect_list(F.struct("size", "stride", "at")).alias("ws"))  # bounded by the document
    cut = F.transform("ws", lambda w: F.struct(w["size"].alias("size"), w["at"].alias("at"), F.array_distinct(F.slice("sh", w["at"] * w["stride"] + 1, w["size"] + w["stride"] - SHINGLE)).alias("held")))
    held = materialize(some.join(per_doc, DOC).select(*DOC, F.explode(cut).alias("x")).select(*DOC, "x.*"), "license-windows")
    bands = table.select("license", "size", "set", F.explode(minima(F.col("set"))).alias("b")).select("license", "size", "set", "b.*")
    found = held.withColumn("b", F.explode(minima(F.col("held")))).select(*DOC, "size", "at", "held", "b.*")
    retrieved = found.join(F.broadcast(bands), ["size", "band", "low"]).select(*DOC, "at", "held", "license", "set").dropDuplicates([*DOC, "at", "license"])
    part = retrieved.withColumn("percent", F.size(F.array_intersect("held", "set")) * 100.0 / F.size("set")).filter(F.col("percent") >= PERCENT)
    best = part.groupBy(*DOC, "license").agg(F.max("percent").alias("percent"), F.max(F.size(F.array_intersect("held", "set"))).alias("shared"))
    most = F.min(F.struct(-F.col("shared"), "license"))
    result = best.groupBy(*DOC).agg(F.sort_array(F.collect_list("license")).alias("names"), F.max("percent").alias("best"), most["license"].alias("name"))  # as many as templates
    out = keyed.select("_id", *DOC).join(materialize(result, "licensed", keep=True), DOC, "left")
    return out.select(
        F.col("_id").alias(id_col), F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("n_licenses"), F.coalesce(F.array_join("names", ","), F.lit("")).alias("licenses"), F.coalesce(F.round("best", 4), F.lit(0.0)).alias("best_percent"), F.col("name").alias("best_license")
    )
