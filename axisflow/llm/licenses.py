"""License notices in texts: MinHash bands over overlapping windows find templates, exact containment verifies them.

Everything is DataFrame and SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import columns_of, run_hashes

SHINGLE = 5     # words
CONTAINED = 0.8  # share of a template's shingles that a window must hold
BANDS = 24      # bands of one MinHash value each
REACHES = (8, 16, 32, 64, 128, 256)  # greatest lengths of the template classes, in words

# Notices of common licenses, as published; texts of five words or more.
TEMPLATES = {
    "apache-2.0-short": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "mit-short": "Released under the MIT License.",
    "mit-short-2": "Licensed under the MIT License.",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software
without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom
the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.""",
    "mit-disclaimer": """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this
permission notice appear in all copies.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code
must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions
and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    "bsd-3-endorsement": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific
prior written permission.""",
    "gpl-2-or-later": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation;
either version 2 of the License, or (at your option) any later version.""",
    "gpl-3-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation,
either version 3 of the License, or (at your option) any later version.""",
    "gpl-2-short": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3-short": "This work is licensed under the GNU General Public License, version 3.",
    "lgpl": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation;
either version 2.1 of the License, or (at your option) any later version.""",
    "agpl-3": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation,
either version 3 of the License, or (at your option) any later version.""",
    "mpl-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
http://mozilla.org/MPL/2.0/.""",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-short": "Licensed under CC BY 4.0.",
    "cc-by-sa-short": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-short": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd-short": "Licensed under CC BY-ND 4.0.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "all-rights-reserved": "All rights reserved. No part of this publication may be reproduced without prior written permission.",
}


def license_words(text: Column) -> Column:
    """Runs of letters and digits, lower-cased."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def _bands(shingles: Column) -> Column:
    """(band, value) of a shingle array; hash functions are the shingle hash under seeds, a band has one."""
    def band(number: int) -> Column:
        return F.struct(F.lit(number).alias("band"), F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, F.lit(number)))).alias("value"))
    return F.array(*[band(b) for b in range(BANDS)])


def miss_probability(similarity: float, bands: int = BANDS) -> float:
    """Chance that no band of two sets of this Jaccard similarity agrees."""
    return (1 - similarity) ** bands


def template_table(spark: SparkSession, templates: dict[str, str] | None = None) -> DataFrame:
    """(license, reach, shingles): a template's distinct shingles and the greatest length of its class."""
    rows = sorted((TEMPLATES if templates is None else templates).items())
    table = spark.createDataFrame(rows, "license string, body string").withColumn("w", license_words(F.col("body"))).withColumn("n", F.size("w")).where(F.col("n") >= SHINGLE)
    steps = F.lit(None).cast("int")
    for r in reversed(REACHES):
        steps = F.when(F.col("n") <= r, F.lit(r)).otherwise(steps)
    return table.select("license", F.coalesce(steps, F.col("n")).alias("reach"), F.array_distinct(run_hashes(F.col("w"), SHINGLE)).alias("shingles"))


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, contained: float = CONTAINED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, containment, first_word) of the license notices in texts.

    A class of templates of at most R words is looked for in windows of 5R/4 words that start every R/8 words, so every run
    of R words lies in a window and a contained template has a Jaccard similarity of 0.3 or more with it. 24 bands of one
    MinHash value miss that with a chance below 0.0002, and a whole template (0.4 or more) below 0.000005. A window that shares
    a band with a template is verified: at least ``contained`` of the template's shingles are in it. Windows are made of
    texts that share a shingle with some template; others can hold none.

    ``containment`` is the best of the windows, ``first_word`` where the first of those begins. A window does not count for
    a template if at least half of the words it matched there are matched by another template of the class with a higher
    containment; notices beside each other are all returned. Null and empty texts and
    those below five words have no notice. Rows equal in id and text give one row per license; other columns are not read;
    an empty table gives an empty table.
    """
    spark = docs.sparkSession
    known = cut_lineage(template_table(spark, templates))
    source = columns_of(docs, id_col, text_col).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("mark"))
    source = source.withColumn("s", run_hashes(license_words(F.col("text")), SHINGLE))
    # templates are a parameter: their shingles are few and known before the scan
    every = [r[0] for r in known.select(F.explode("shingles")).distinct().collect()]
    if not every:
        return source.select("doc_id", F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).cast("long").alias("first_word")).where("false")
    literal = F.array(*[F.lit(x) for x in sorted(every)])
    near = source.where(F.arrays_overlap("s", literal)).select("doc_id", "mark", "s")
    near = cut_lineage(near)

    reaches = [r.reach for r in known.select("reach").distinct().orderBy("reach").collect()]
    parts = None
    for reach in reaches:
        step, width = max(1, reach // 8), reach + reach // 4 - SHINGLE + 1
        made = near.select("doc_id", "mark", F.lit(reach).alias("reach"), "s", F.explode(F.expr(f"sequence(0, greatest(size(s) - {reach - SHINGLE + 1}, 0) + {step - 1}, {step})")).alias("at"))
        made = made.select("doc_id", "mark", "reach", "at", F.slice("s", F.col("at") + 1, width).alias("window")).where(F.size("window") > 0)
        parts = made if parts is None else parts.union(made)
    parts = parts.where(F.arrays_overlap("window", literal))
    keyed = parts.withColumn("key", F.explode(_bands(F.col("window")))).select("doc_id", "mark", "reach", "at", "window", "key.band", "key.value")
    bands = known.withColumn("key", F.explode(_bands(F.col("shingles")))).select("license", "reach", "shingles", "key.band", "key.value")
    found = keyed.join(F.broadcast(bands), ["reach", "band", "value"])  # templates times bands: a parameter
    share = F.size(F.array_intersect("window", "shingles")) / F.size("shingles")
    places = F.expr("filter(transform(window, (v, i) -> IF(array_contains(shingles, v), at + i, NULL)), v -> v IS NOT NULL)")
    found = found.withColumn("containment", share).where(F.col("containment") >= contained).select("doc_id", "mark", "license", "reach", "at", "containment", places.alias("places"))
    found = found.groupBy("doc_id", "mark", "license", "reach", "at").agg(F.max("containment").alias("c"), F.max("places").alias("places"))  # once, however many bands agree
    # of templates that match the same words, such as two versions of a notice, only the best stay
    group = found.groupBy("doc_id", "mark", "reach").agg(F.collect_list(F.struct("license", "c", "at", "places")).alias("g"))
    better = """filter(g, x -> NOT exists(g, y -> y.c > x.c AND y.license <> x.license AND abs(y.at - x.at) <= 2 * reach
        AND 2 * size(array_intersect(x.places, y.places)) >= size(x.places)))"""
    left = group.select("doc_id", "mark", F.explode(F.expr(better)).alias("x"))
    best = left.groupBy("doc_id", "mark", "x.license").agg(F.max(F.struct("x.c", (-F.col("x.at")).alias("at"))).alias("b"))
    return best.select("doc_id", "license", F.col("b.c").alias("containment"), (-F.col("b.at")).cast("long").alias("first_word"))
