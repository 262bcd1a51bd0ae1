"""License scan: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies; native.

Words are runs of letters and digits in lower case; shingles are SHINGLE words (a shorter template is one shingle). Long texts
are cut into parts of PART words that overlap by a window, so that no row holds more than some windows of a part. A template
of n words is looked for in windows of n + n // 4 words (one more for short ones) that begin at every multiple of the
difference, so that any n words of a document lie within a window as a whole. A window holds a template if it has at least
CONTAINED of the template's distinct shingles. Such a window has a Jaccard similarity of a half or more with the template, so
of BANDS bands of one MinHash value each, one agrees but with a chance of 2**-32.

Only windows with one of the template's anchor words are made. Anchors are chosen so that shingles without any are fewer than
CONTAINED of the template; a window without anchors can't hold it, so this loses nothing.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE, CONTAINED, BANDS, PART = 5, 0.8, 32, 4096
#: Templates are broadcast; more are refused.
MAX_TEMPLATES = 2000

#: Public notices: (license, text).
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("MIT-text", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("BSD-text", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("Apache-2.0-text", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-text", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MIT-conditions", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("BSD-2-Clause-conditions", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause-endorsement", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0-disclaimer", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("LGPL-text", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("AGPL-text", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("CC0-1.0", "The person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    *((f"SPDX-{x}", f"SPDX-License-Identifier: {x}") for x in ("MIT", "ISC", "Zlib", "Unlicense", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "BSL-1.0", "CC0-1.0", "CC-BY-4.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-3.0-only", "AGPL-3.0-only")),
)


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def _shingles(words: list[str]) -> list[str]:
    return list(dict.fromkeys(" ".join(words[k : k + SHINGLE]) for k in range(max(1, len(words) - SHINGLE + 1))))


def anchors_of(words: list[str]) -> list[str]:
    """Few long words such that less than CONTAINED of the shingles have none of them."""
    left, total, out = _shingles(words), len(_shingles(words)), []
    while len(left) >= CONTAINED * total:
        best = max(dict.fromkeys(words), key=lambda w: (w not in out, len(w) >= 7, sum(w in s.split() for s in left), len(w)))
        out.append(best)
        left = [s for s in left if best not in s.split()]
    return out


def _shape(n: int) -> tuple[int, int]:
    """Words of a window and the step between windows, for templates of n words."""
    step = max(1, n // 4)
    return n + step, step


def _mins(shingles) -> list:
    hashes = F.transform(shingles, lambda s: F.xxhash64(s))
    seeded = [lambda h, seed=F.lit(b): F.xxhash64(h, seed) for b in range(BANDS)]
    return [F.array_min(F.transform(hashes, lambda h: f(h))) for f in seeded]  # noqa: B023  called at once


def _windows(size: int, step: int):
    """The windows around the places of anchors, of size words each, that begin in the part, at multiples of step of the text."""
    starts = F.transform("at", lambda p: F.sequence(F.greatest(F.lit(0), F.ceil((F.col("base") + p - (size - 1)) / step).cast("int")), F.floor((F.col("base") + p) / step).cast("int")))
    own = F.filter(F.array_distinct(F.flatten(starts)), lambda k: (k * step >= F.col("base")) & (k * step < F.col("base") + PART))
    return F.transform(own, lambda k: F.struct(F.lit(size).alias("size"), (k * step).alias("start"), F.slice("w", k * step - F.col("base") + 1, size).alias("window")))


def _window_shingles(window, size):
    """size is over that of a template, so that the shingles of short templates are found."""
    n, long = F.size(window), F.least(F.lit(SHINGLE), size - 1)
    some = F.transform(F.sequence(F.lit(1), n - (long - 1)), lambda i: F.array_join(F.slice(window, i, long), " "))
    return F.when(n < long, F.array(F.array_join(window, " "))).otherwise(F.array_distinct(some))


def scan(docs: DataFrame, templates: tuple = TEMPLATES) -> DataFrame:
    """doc_id, license, start (word of the first best window), containment of each license that a document holds.

    Null and empty texts hold none; templates need a word. A notice that a document repeats counts once; repeated rows of one
    doc_id count as one document. Of windows that tie the first counts. Texts of any length are read whole. An empty table gives
    no rows. Other columns than doc_id and text don't matter. More than MAX_TEMPLATES templates are refused, as they are broadcast.
    """
    spark = docs.sparkSession
    known = [(name, _words(text)) for name, text in templates]
    if len(known) > MAX_TEMPLATES or not all(w for _, w in known):
        raise ValueError(f"templates need words and may be {MAX_TEMPLATES} at most")
    anchors = sorted({a for _, w in known for a in anchors_of(w)})
    shapes = sorted({_shape(len(w)) for _, w in known})
    table = spark.createDataFrame([(name, _shape(len(w))[0], _shingles(w)) for name, w in known], "license string, size int, wanted array<string>")
    table = table.select("license", "size", "wanted", F.posexplode(F.array(*_mins(F.col("wanted")))).alias("band", "value"))
    # The anchors' filter comes first and reads whole texts; few documents go on.
    some = docs.select("doc_id", F.lower("text").alias("low")).filter(F.col("low").rlike("|".join(map(re.escape, anchors))))
    words = some.select("doc_id", F.split(F.trim(F.regexp_replace("low", r"[^\p{L}\p{N}]+", " ")), " ").alias("w"))
    most = max(size for size, _ in shapes)
    part = F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 1, F.lit(PART)), lambda p: F.struct(p.alias("base"), F.slice("w", p + 1, PART + most).alias("w"))))
    parts = words.select("doc_id", part.alias("part")).select("doc_id", "part.base", "part.w")
    places = parts.withColumn("at", F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.array_contains(F.array(*map(F.lit, anchors)), F.get("w", i))))
    each = places.select("doc_id", "base", F.explode(F.concat(*(_windows(*x) for x in shapes))).alias("x")).select("doc_id", "x.size", "x.start", _window_shingles(F.col("x.window"), F.col("x.size")).alias("has"))
    banded = each.select("doc_id", "size", "start", "has", F.posexplode(F.array(*_mins(F.col("has")))).alias("band", "value"))
    found = banded.join(F.broadcast(table), ["size", "band", "value"])
    held = (F.size(F.array_intersect("has", "wanted")) / F.size("wanted")).alias("containment")
    found = found.select("doc_id", "license", "start", held).filter(F.col("containment") >= CONTAINED)
    best = found.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.min(F.struct((-F.col("containment")).alias("c"), "start")).alias("first"))
    return best.select("doc_id", "license", F.col("first.start").cast("long").alias("start"), "containment")
