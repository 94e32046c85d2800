"""License scans: which licenses' notices and texts a document holds, wherever they stand in it.

Words are runs of letters and digits in lower case. Shingles are five words, three in
templates of fewer than ``SHORT`` words (the whole template below that). Templates fall into
classes by shingle and length, and each class has text windows of two to four times the
templates' length that overlap by half, so any occurrence lies whole in one window. A window
and a template are compared by MinHash with ``BANDS`` bands of one row: a template in a window
makes a Jaccard similarity of a quarter at least (a fifth, about, where only
``MIN_CONTAINMENT`` of it is there), which collides in some band with probability 0.9999
(0.998). Candidates from the join on bands are verified by the exact share of the template's
shingles in the window.

One pass over the texts without a shuffle makes the windows. A template's minimum in a band
belongs to one of its shingles, so a window can only collide in that band if it holds that
shingle: windows without any such shingle, at most ``BANDS`` for each template, are left out
before their own minima are taken, and no collision is lost. Templates are a parameter, for
tens to hundreds of them, and these shingles are constants of the plan. The join's other side
has ``BANDS`` rows for each template.

Licenses of one family have much of their texts in common: of those found in the same place
only the ones with the best share stay.

Everything is DataFrame functions. Defined results: null and empty texts hold nothing; rows
with equal ids are one document; a null id is an id; of equal shares the earliest place is
reported, and licenses of a family with equal shares all stay; no templates, or an empty
table, give an empty table; columns other than the two named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import let

SHINGLE, SHORT_SHINGLE = 5, 3
#: A template with fewer words has short shingles.
SHORT = 20
BANDS = 32
MIN_CONTAINMENT = 0.8

# Texts and notices of well-known licenses, as they are written in files.
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in"
    " the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of"
    " the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this"
    " permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND,"
    " EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE"
    " AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN"
    " CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD_TERMS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    " 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or"
    " other materials provided with the distribution."
)
_BSD_NAMES = (
    " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without"
    " specific prior written permission."
)
_BSD_END = (
    " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED"
    " WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT,"
    " INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA,"
    " OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR"
    " OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice"
    " and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING"
    " ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY"
    " DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN"
    " CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_APACHE = (
    "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the"
    " License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is"
    " distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing"
    " permissions and limitations under the License."
)
_MPL = (
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"
    " http://mozilla.org/MPL/2.0/."
)
_UNLICENSE = (
    "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,"
    " either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
)
_CC0 = (
    "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This"
    " software is distributed without any warranty."
)
_ZLIB = (
    "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this"
    " software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely,"
    " subject to the following restrictions"
)
_BOOST = (
    "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"
    " (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit"
    " third-parties to whom the Software is furnished to do so, all subject to the following"
)
_GNU = (
    "This {of} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version"
    " {version} of the License, or (at your option) any later version. This {of} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even"
    " the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
)
_GNU_NAMES = [
    ("GPL", "General Public License", "program", ("2", "3")), ("LGPL", "Lesser General Public License", "library", ("2.1", "3")),
    ("AGPL", "Affero General Public License", "program", ("3",)),
]
_CC_NAMES = [
    ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
    ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
]


def _templates() -> list[tuple[str, str, str]]:
    """(family, license, text)."""
    found = [
        ("MIT", "MIT", _MIT), ("MIT", "MIT", "Released under the MIT License."), ("MIT", "MIT", "Licensed under the MIT License."), ("MIT", "MIT", "This project is licensed under the MIT License"),
        ("BSD", "BSD-2-Clause", _BSD_TERMS + _BSD_END), ("BSD", "BSD-3-Clause", _BSD_TERMS + _BSD_NAMES + _BSD_END), ("ISC", "ISC", _ISC), ("Apache", "Apache-2.0", _APACHE),
        ("Apache", "Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("MPL", "MPL-2.0", _MPL), ("Unlicense", "Unlicense", _UNLICENSE), ("CC0", "CC0-1.0", _CC0),
        ("Zlib", "Zlib", _ZLIB), ("BSL", "BSL-1.0", _BOOST), ("reserved", "proprietary", "All rights reserved."),
    ]
    for code, name, of, versions in _GNU_NAMES:
        for version in versions:
            full = f"{code}-{version}" if "." in version else f"{code}-{version}.0"
            found += [("GNU", full, _GNU.format(of=x, name=name, version=version)) for x in dict.fromkeys(("program", of))]
            found.append(("GNU", full, f"This work is licensed under the GNU {name}, version {version}."))
    for code, name in _CC_NAMES:
        found += [("CC", f"CC-{code}-4.0", f"This work is licensed under a Creative Commons {name} 4.0 International License."), ("CC", f"CC-{code}-4.0", f"Licensed under CC {code} 4.0.")]
    return found


TEMPLATES = _templates()


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(words: Column, k: int | Column) -> Column:
    """Hashes of the runs of ``k`` words, in order."""
    k = F.lit(k) if isinstance(k, int) else k
    starts = F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(F.slice(words, i + 1, k)))


def _band(h: Column, b: int) -> Column:
    return F.xxhash64(h, F.lit(b))


def _minima(hashes: Column) -> Column:
    """The least hash of a set in each of ``BANDS`` orders."""
    return F.array(*[F.array_min(F.transform(hashes, lambda h: _band(h, b))) for b in range(BANDS)])  # noqa: B023


def _bearers(hashes: Column) -> Column:
    """The shingles that have the least hash in some order."""
    return F.array_distinct(F.array(*[F.array_min(F.transform(hashes, lambda h: F.struct(_band(h, b).alias("v"), h.alias("h"))))["h"] for b in range(BANDS)]))  # noqa: B023


def prepared(like: DataFrame, templates: list[tuple[str, str, str]]) -> DataFrame:
    """The templates with their shingles: ``template, family, license, k, half, own array<long>, bearers array<long>``."""
    rows = like.sparkSession.createDataFrame([(i, *x) for i, x in enumerate(templates)], "template int, family string, license string, text string")
    size = F.size("w")
    k = F.when(size >= SHORT, SHINGLE).otherwise(F.least(F.lit(SHORT_SHINGLE), size))
    rows = rows.withColumn("w", _words(F.col("text"))).where("size(w) > 0").withColumn("k", k)
    rows = rows.withColumn("own", _shingles(F.col("w"), F.col("k")))
    half = F.pow(F.lit(2), F.ceil(F.log2(F.size("own").cast("double")))).cast("int")
    rows = rows.select("template", "family", "license", "k", half.alias("half"), F.array_distinct("own").alias("own"))
    return rows.withColumn("bearers", _bearers(F.col("own")))


def candidates(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs of windows and templates that collide in a band, as often as they do: ``doc_id, start, hashes`` and the columns of ``known``."""
    groups: dict[tuple[int, int], set[int]] = {}
    for r in known.select("k", "half", "bearers").collect():  # a parameter's size
        groups.setdefault((r["k"], r["half"]), set()).update(r["bearers"])

    def windows(words: Column, k: int) -> Column:
        none = F.array().cast("array<struct<k:int,half:int,start:int,hashes:array<bigint>>>")
        listed = lambda xs: F.array(*[F.lit(h) for h in sorted(xs)])
        halves = sorted(half for size, half in groups if size == k)

        def of(hashes: Column, half: int) -> Column:
            wanted = listed(groups[k, half])
            starts = F.sequence(F.lit(0), F.size(hashes) - 1, F.lit(half))
            cut = F.transform(starts, lambda i: F.struct(F.lit(k).alias("k"), F.lit(half).alias("half"), i.alias("start"), F.slice(hashes, i + 1, F.lit(2 * half)).alias("hashes")))
            return F.when(F.arrays_overlap(hashes, wanted), F.filter(cut, lambda x: F.arrays_overlap(x["hashes"], wanted))).otherwise(none)

        some = listed(set().union(*(groups[k, half] for half in halves)))
        every = lambda hashes: F.when((F.size(hashes) > 0) & F.arrays_overlap(hashes, some), F.flatten(F.array(*[of(hashes, half) for half in halves]))).otherwise(none)
        return let(_shingles(words, k), every)

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("__text"))
    sizes = sorted({k for k, _ in groups})
    every = let(_words(F.col("__text")), lambda words: F.flatten(F.array(*[windows(words, k) for k in sizes])))
    found = rows.select("doc_id", F.explode(every).alias("x")).select("doc_id", "x.k", "x.half", "x.start", "x.hashes")
    ours = found.select("doc_id", "k", "half", "start", "hashes", F.posexplode(_minima(F.col("hashes"))).alias("band", "value"))
    theirs = known.select("template", "family", "license", "k", "half", "own", F.posexplode(_minima(F.col("own"))).alias("band", "value"))
    return ours.join(theirs, ["k", "half", "band", "value"]).drop("band", "value")


def scan(docs: DataFrame, templates: list[tuple[str, str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, license, containment, position``: for each license of a document the best share of a
    template's shingles in a window, and the word at which these begin."""
    known = prepared(docs, templates)
    if known.isEmpty():
        return docs.where("false").select(docs[id_col].alias("doc_id"), F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).cast("long").alias("position"))
    share = F.size(F.array_intersect("hashes", "own")) / F.size("own")
    matches = candidates(docs, known, id_col, text_col).withColumn("containment", share).where(F.col("containment") >= MIN_CONTAINMENT)
    first = F.array_min(F.filter(F.transform("hashes", lambda h, i: F.when(F.array_contains("own", h), i)), lambda i: i.isNotNull()))
    matches = matches.withColumn("position", (F.col("start") + first).cast("long"))
    best = matches.groupBy("doc_id", "family", "license").agg(F.min(F.struct((-F.col("containment")).alias("less"), "position", "half")).alias("best"))
    # At most a family's licenses for each document.
    family = best.groupBy("doc_id", "family").agg(F.collect_list(F.struct("license", "best")).alias("all"))
    near = lambda x, y: F.abs(x["best"]["position"] - y["best"]["position"]) < 2 * x["best"]["half"]
    better = F.filter("all", lambda x: ~F.exists("all", lambda y: (y["best"]["less"] < x["best"]["less"]) & near(x, y)))
    kept = family.select("doc_id", F.explode(better).alias("x"))
    return kept.select("doc_id", "x.license", (-F.col("x.best.less")).alias("containment"), "x.best.position")
