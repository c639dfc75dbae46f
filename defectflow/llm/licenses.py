"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

Texts and templates are lower-cased and cut to words of letters and digits; shingles are five words. For each number s of template shingles, windows of 2.5 s
shingles start every s/2 shingles, so every place of up to 2 s shingles, such as an edited template with words put in, lies whole in a window. A template that keeps 0.8 of its shingles in such a window
has a similarity of at least 0.8 / 2.7 there, a whole one 0.4; ``BANDS`` = 32 bands of ``ROWS`` = 1 MinHash value retrieve them with probability 1 - 0.704^32 > 0.99998 and more. A retrieved template is
verified by the exact share of its shingles in the window, 0.8 or more. Windows in which less than 0.8 s shingles are of templates of size s can't be verified and aren't hashed.

Templates are a fixed list: notices, the whole texts of ``license_texts`` and their parts (numbered sections or paragraphs of ``PART`` words or more; ``NAME/part-N``), so that a text that holds only the conditions or
the warranty is found too. Their shingles and bands are literals and a table of bounded size. Built-in columns only.

Defined results: a null or empty text has no window; texts under five words are one shorter shingle and match nothing; repeated rows each get their rows; an empty table gives an
empty result; further columns don't matter.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from defectflow.llm.common import let, materialize

BANDS, ROWS, SHINGLE, CONTAINED, PART = 32, 1, 5, 0.8, 25

#: Wording of public license notices.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "GPL-2.0-notice": "GNU General Public License, version 2.",
    "GPL-2.0-or-later-notice": "either version 2 of the License, or (at your option) any later version",
    "GPL-3.0-or-later-notice": "either version 3 of the License, or (at your option) any later version",
    "LGPL-notice": "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "LGPL-short-notice": "Licensed under the GNU Lesser General Public License",
    "AGPL-notice": "under the terms of the GNU Affero General Public License as published by",
    "AGPL-short-notice": "Licensed under the GNU Affero General Public License",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "EPL-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MIT-file-notice": "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file.",
    "BSD-4-Clause-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by",
    "BSL-1.0-notice": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC-BY-SA-3.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.",
    "CC-BY-3.0-notice": "This work is licensed under a Creative Commons Attribution 3.0 Unported License.",
    "CC-BY-NC-4.0-long-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-ND-4.0-notice": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "CC-BY-NC-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC-BY-NC-ND-4.0-notice": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.",
    "CC-BY-short-notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-short-notice": "Licensed under CC BY-SA 4.0.",
}


def template_words(text: str) -> list[str]:
    return re.findall(r"[\w]+", text.lower())


def whole_texts() -> dict[str, str]:
    """The whole texts and their parts; paragraphs that a numbered section continues belong to it."""
    out = {}
    for path in sorted((Path(__file__).parent / "license_texts").glob("*.txt")):
        text = path.read_text(encoding="utf-8")
        out[f"{path.stem}-text"] = text
        numbered = re.split(r"\n(?=[ \t]*(?:Section )?\d+(?:\.\d+)*\.[ \t])", text)
        short = len(template_words(text)) < 600
        parts = [p for p in (re.split(r"\n[ \t]*\n", text) if short or len(numbered) < 5 else numbered) if len(template_words(p)) >= PART]
        if len(parts) > 1:
            out |= {f"{path.stem}/part-{i}": part for i, part in enumerate(parts, 1)}
    return out


TEMPLATES |= whole_texts()


def _tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)[^\w]+", " "), " "), "")


def _shingles(w: Column) -> Column:
    hashed = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(SHINGLE))))
    return F.when(F.size(w) >= SHINGLE, hashed).otherwise(F.array().cast("array<bigint>"))


def _bands(shingles: Column) -> Column:
    """(band, MinHash values of the band hashed together)."""
    low = lambda i: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, F.lit(i))))
    return F.array(*(F.struct(F.lit(b).alias("band"), F.xxhash64(*(low(b * ROWS + r) for r in range(ROWS))).alias("value")) for b in range(BANDS)))


def templates(spark: SparkSession, texts: dict[str, str] | None = None) -> DataFrame:
    """(license, size, grams): a row for each template of five words or more."""
    rows = [(name, template_words(t)) for name, t in (texts or TEMPLATES).items()]
    listed = spark.createDataFrame([r for r in rows if len(r[1]) >= SHINGLE], "license string, w array<string>")
    return listed.select("license", F.array_distinct(_shingles(F.col("w"))).alias("grams")).withColumn("size", F.size("grams"))


def scan_licenses(docs: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """``doc_id, license, containment, n_places``: a row for each row of ``docs`` and template found; ``n_places``: windows that verify it."""
    texts = texts or TEMPLATES
    spark = docs.sparkSession
    known = templates(spark, texts)
    grams = [r["g"] for r in known.select(F.explode("grams").alias("g")).distinct().collect()]  # of the fixed templates
    # A generator computes its row once; a filter would repeat the columns. ``mark``: 1 where a shingle is of a template.
    shingled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), let(_tokens(F.col("text")), _shingles).alias("s"))
    marks = F.expr(f"transform(s, h -> if(h IN ({', '.join(f'{g}L' if g != -(1 << 63) else 'bigint(-9223372036854775808)' for g in grams)}), 1, 0))")
    both = F.filter(F.array(F.struct(F.col("s").alias("all"), marks.alias("mark"))), lambda x: F.exists(x["mark"], lambda m: m == 1))
    hashed = shingled.select("doc_id", F.inline_outer(both)).where(F.col("all").isNotNull())
    hashed = materialize(hashed.withColumn("row", F.monotonically_increasing_id()), "shingles")
    # Each shingle of a template votes for the about five windows around it, of the sizes of its templates only: the work is linear in a text's words.
    least = lambda s: s * CONTAINED - 1e-6
    step, length = F.greatest(F.lit(1), F.floor(F.col("size") / 2).cast("int")), F.ceil(F.col("size") * 2.5).cast("int")
    sizes = known.select(F.explode("grams").alias("gram"), "size").distinct().groupBy("gram").agg(F.collect_list("size").alias("sizes"))
    placed = hashed.select("row", F.explode(F.filter(F.transform("all", lambda h, i: F.struct(i.alias("at"), h.alias("gram"))), lambda x: F.get("mark", x["at"]) == 1)).alias("x"))
    sized = placed.select("row", "x.*").join(F.broadcast(sizes), "gram").select("row", "at", F.explode("sizes").alias("size"))
    first = F.greatest(F.lit(0), F.ceil((F.col("at") - length + 1) / step).cast("int"))
    votes = sized.select("row", "size", F.explode(F.transform(F.sequence(first, F.floor(F.col("at") / step).cast("int")), lambda k: k * step)).alias("at"))
    starts = votes.groupBy("row", "size", "at").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least(F.col("size")))
    listed = starts.groupBy("row").agg(F.collect_list(F.struct("size", "at")).alias("starts"))  # a text's own windows
    cut = lambda x: F.struct(x["at"].alias("at"), x["size"].alias("size"), F.slice(F.col("all"), x["at"] + 1, F.ceil(x["size"] * 2.5).cast("int")).alias("window"))
    every = hashed.join(listed.hint("merge"), "row").select("row", "doc_id", F.inline(F.transform("starts", cut)))
    asked = every.withColumn("found", F.explode(_bands(F.col("window")))).select("row", "doc_id", "at", "size", "window", "found.band", "found.value")
    offered = known.withColumn("offer", F.explode(_bands(F.col("grams")))).select("license", "size", "offer.band", "offer.value")
    met = asked.join(F.broadcast(offered), ["size", "band", "value"])  # offered: BANDS rows for each fixed template
    met = met.join(F.broadcast(known.select("license", "grams")), "license")
    share = F.size(F.array_intersect("grams", "window")) / F.size("grams")
    verified = met.withColumn("containment", share).where(F.col("containment") >= CONTAINED)
    places = verified.groupBy("row", "doc_id", "license", "at").agg(F.max("containment").alias("containment"))
    return places.groupBy("row", "doc_id", "license").agg(F.max("containment").alias("containment"), F.count(F.lit(1)).alias("n_places")).drop("row")


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
