"""Licence scan: MinHash bands over overlapping text windows, then exact shingle
containment (native)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelforge.llm.common import documents, stored
from labelforge.llm.shingles import SHINGLE_WORDS, hashes, once, texts, words

#: Bands of one row each.  A template of n shingles is looked up in windows of
#: more than 2n and fewer than 4n shingles that overlap by half, so one window holds a
#: whole copy; at containment 0.8 the Jaccard similarity there is at least 0.19,
#: and 1 - (1 - 0.19) ** 40 > 0.9997 of such windows collide in some band.
BANDS = 40
CONTAINMENT = 0.8

#: Public licence statements, notices, and passages that the whole
#: texts hold.  A statement that names a version has at most eight words (four
#: shingles): one other word leaves a containment of 0.75 at most, so the version
#: is part of the match.  Longer ones hold no version that another one could have.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        "(the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": (
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0"),
    "GPL-3.0": "GNU General Public License, version 3",
    "GPL-notice": "under the terms of the GNU General Public License as published by the Free Software Foundation",
    "BSD-notice": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    # whole texts and notices, by a passage that no other licence holds
    "MIT-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY",
    "ISC-notice": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "Zlib-notice": "The origin of this software must not be misrepresented; you must not claim that you wrote the original software",
    "BSL-1.0-notice": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license",
    "BSD-3-Clause-text": "nor the names of its contributors may be",
    "BSD-4-Clause-text": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "Apache-2.0-text": "Apache License Version 2.0, January 2004",
    "GPL-2.0-text": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "GPL-3.0-text": "GNU GENERAL PUBLIC LICENSE Version 3, 29",
    "LGPL-notice": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "LGPL-2.0-notice": "under the terms of the GNU Library General Public License as published by the Free Software Foundation",
    "AGPL-notice": "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "GNU-version-2": "Software Foundation; either version 2 of the License",
    "GNU-version-2.1": "Software Foundation; either version 2.1 of the",
    "GNU-version-3": "Software Foundation, either version 3 of the License",
    "GFDL-notice": "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License",
    "MPL-2.0-text": "Mozilla Public License Version 2.0",
    "MPL-1.1-text": "Mozilla Public License Version 1.1",
    "EPL-2.0": "Eclipse Public License v 2.0",
    "EPL-1.0": "Eclipse Public License v 1.0",
    "Artistic-2.0": "The Artistic License 2.0",
    "WTFPL": "Do What The Fuck You Want To Public License",
    "CC0-1.0-text": "Legal Code CC0 1.0 Universal",
    "CC0-1.0-line": "CC0 1.0 Universal (CC0 1.0)",
    "CC0-1.0-url": "creativecommons.org/publicdomain/zero/1.0",
    # usual one-line wordings
    "GPL-2.0": "GNU General Public License, version 2",
    "GPL-2.0-v": "GNU General Public License v2.0",
    "GPL-2.0-v2": "GNU General Public License v2",
    "GPL-3.0-v": "GNU General Public License v3.0",
    "GPL-3.0-v3": "GNU General Public License v3",
    "LGPL-2.1": "GNU Lesser General Public License, version 2.1",
    "LGPL-3.0": "GNU Lesser General Public License, version 3",
    "LGPL-2.1-v": "GNU Lesser General Public License v2.1",
    "LGPL-3.0-v": "GNU Lesser General Public License v3",
    "AGPL-3.0": "GNU Affero General Public License, version 3",
    "AGPL-3.0-v": "GNU Affero General Public License v3",
    "Apache-2.0-line": "the Apache License 2.0",
    "Apache-2.0-version": "Apache License, Version 2.0",
}
#: "licensed under the MIT License" and the like; one shingle each.  "Released ..." is above.
TEMPLATES |= {f"MIT-{verb}": f"{verb} under the MIT License" for verb in ("licensed", "distributed", "available", "published", "provided", "covered")}
TEMPLATES |= {"MIT-terms": "terms of the MIT License", "MIT-title": "The MIT License (MIT)  Copyright"}
TEMPLATES |= {f"{name}-{verb}": f"{verb} under the {words_}" for verb in ("licensed", "released", "distributed")
              for name, words_ in (("BSD-2-Clause", "BSD 2-Clause"), ("BSD-3-Clause", "BSD 3-Clause"), ("ISC", "ISC License"), ("GPLv2", "GNU GPLv2"), ("GPLv3", "GNU GPLv3"),
                                   ("GPL-version-2", "GPL version 2"), ("GPL-version-3", "GPL version 3"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"))}
TEMPLATES |= {f"{name}-spdx": f"SPDX-License-Identifier: {name}" for name in (
    "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "EPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0")}
#: Creative Commons by kind and version: name, address and short forms.
_CC = {"BY": "", "BY-SA": "ShareAlike", "BY-NC": "NonCommercial", "BY-ND": "NoDerivatives", "BY-NC-SA": "NonCommercial-ShareAlike", "BY-NC-ND": "NonCommercial-NoDerivatives"}
for _version in ("2.0", "2.5", "3.0", "4.0"):
    for _kind, _name in _CC.items():
        TEMPLATES[f"CC-{_kind}-{_version}-name"] = f"Creative Commons Attribution {_name} {_version}"
        TEMPLATES[f"CC-{_kind}-{_version}-url"] = f"creativecommons.org/licenses/{_kind.lower()}/{_version}"
        for _before in ("under", "a", "the") if _kind == "BY" else ("",):  # five words are needed
            TEMPLATES[f"CC-{_kind}-{_version}-short" + f"-{_before}" * bool(_before)] = f"{_before} CC {_kind} {_version}"


def template_table(spark: SparkSession, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """``license, shingles, n, size, hashes`` of each template; ``size`` is its window length in shingles."""
    if not templates:
        raise ValueError("no licence template")
    rows = (spark.createDataFrame(list(templates.items()), "license string, text string").select("license", words(F.col("text")).alias("w"))
            .select("license", F.array_distinct(texts("w")).alias("shingles"), F.array_distinct(hashes("w")).alias("hashes"))
            .withColumn("n", F.size("shingles")))
    return rows.withColumn("size", (2 * F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n"))))).cast("int"))


def signature(name: str, bands: int) -> str:
    """SQL of the MinHash values of an array of shingle hashes, by band."""
    return f"transform(sequence(1, {bands}), k -> array_min(transform({name}, x -> xxhash64(x, k))))"


def scan(spark: SparkSession, docs: DataFrame, templates: dict[str, str] = TEMPLATES, bands: int = BANDS, containment: float = CONTAINMENT) -> DataFrame:
    """``row, doc_id, license, containment, first_word`` for each licence found in
    each row: the best containment of the template's distinct five-word shingles
    in a window, and where the first window that reaches it starts.

    A window that collides in a band holds the template's least shingle of that
    band, so only documents and windows with such a shingle are hashed.  The
    templates are a parameter held in memory; each needs five words.  NULL,
    empty and short texts match nothing; repeated rows give repeated results;
    an empty table gives an empty result.
    """
    table = template_table(spark, templates).cache()
    known = table.withColumn("mins", F.expr(f"transform(sequence(1, {bands}), k -> array_min(transform(hashes, x -> struct(xxhash64(x, k) as v, x as h))))")).collect()
    if any(r.n == 0 for r in known):
        raise ValueError(f"a template needs {SHINGLE_WORDS} words")
    signs = F.array(*(F.lit(h) for h in sorted({m.h for r in known for m in r.mins})))
    sizes = F.array(*(F.lit(s) for s in sorted({r["size"] for r in known})))

    found = once(once(documents(docs, "doc_id", "text"), "w", words(F.col("text"))), "h", hashes("w")).where(F.arrays_overlap("h", signs))
    found = stored(spark, found.select("row", "doc_id", "w", "h"), "licence-documents")
    places = F.filter(F.sequence(F.lit(0), F.size("h") - 1), lambda i: F.array_contains(signs, F.col("h")[i]))
    windows = (found.withColumn("place", F.explode(places)).withColumn("size", F.explode(sizes))
               .withColumn("start", F.explode(F.expr("array(place div (size div 2), place div (size div 2) - 1)")))
               .where("start >= 0").select("row", "size", (F.col("start") * F.expr("size div 2")).cast("int").alias("start")).distinct())
    cut = (once(windows.join(found, "row"), "piece", F.expr("slice(h, start + 1, size)")).where("size(piece) > 0")
           .select("row", "doc_id", "size", "start", F.expr(f"slice(w, start + 1, size + {SHINGLE_WORDS - 1})").alias("part"),
                   F.expr(signature("piece", bands)).alias("mins")))
    banded = cut.select("row", "doc_id", "size", "start", "part", F.posexplode("mins").alias("band", "value"))
    keys = table.select("license", "size", "shingles", "n", F.posexplode(F.expr(signature("hashes", bands))).alias("band", "value"))
    candidates = (banded.join(F.broadcast(keys), ["size", "band", "value"])
                  .groupBy("row", "doc_id", "license", "size", "start").agg(F.first("part").alias("part"), F.first("shingles").alias("shingles")))
    verified = candidates.withColumn("containment", F.size(F.array_intersect(F.array_distinct(texts("part")), "shingles")) / F.size("shingles"))
    return (verified.where(F.col("containment") >= containment).groupBy("row", "doc_id", "license")
            .agg(F.min(F.struct((-F.col("containment")).alias("less"), "start")).alias("best"))
            .select("row", "doc_id", "license", (-F.col("best.less")).alias("containment"), F.col("best.start").alias("first_word")))
