"""License scans: MinHash bands over overlapping windows retrieve templates, shingle containment verifies.

All in DataFrame functions. Texts are lower-cased (A-Z) and cut into words of letters, digits and inner dots. A
template is the words of a licence notice; its set holds its distinct shingles of `words` words. A text holds a
template if, within a window, at least `percent` in 100 of the template's shingles occur.

Windows of a text are as long as a template (for each template length that occurs) and half of it more, and start
every half length, so a notice lies whole in one of them. Only places near an anchor are looked at. Anchors are
words chosen from the templates such that the shingles without any anchor make up less than `percent` of each
template: a text that holds a template so has an anchor, and others are passed over without loss.

MinHash compares a window's shingles with a template's: `BANDS` bands of one value each, over the shingles that any
template has (others are in no template's set). A window that holds 75 in 100 of a template's n shingles, and at most
one and a half times the template's words in all, has a Jaccard similarity of at least .75 n / (1.75 n + 3), or .28 for
the shortest templates: 64 bands miss it with a probability of (1 - .28) ** 64, below one in a thousand million. Windows
and templates meet by equality of (length, band, value), and exact containment of those that met decides.

A place is the shortest run of words in a window that has all the shingles held there. Every place counts: of places
of one licence that share half of the shorter one the fullest stays, and a place is dropped if half of it lies in a
fuller place, itself kept, of another licence.

Defined results: a null or empty text holds nothing; rows without a licence are returned with an empty list;
repeated rows each get a row; a null doc_id is carried through; an empty table gives no rows. Columns besides
doc_id and text are not looked at.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwake.llm.common import materialize, text_or_empty

#: Notices by which texts and files state their licence, by SPDX identifier (fixed values, from the licences' own
#: recommended notices).
TEMPLATES = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    "GPL-2.0": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "This work is licensed under the GNU General Public License, version 2."),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Licensed under the BSD 3-Clause License."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
}
WORDS, PERCENT, BANDS = 3, 75, 64
_WORD = r"[a-z0-9]+(?:[.'][a-z0-9]+)*"


def words_of(text: str) -> list[str]:
    return re.findall(_WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text))


def shingles_of(words: list[str], n: int = WORDS) -> list[str]:
    return list(dict.fromkeys(" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))) if words else []


def anchors(templates: list[list[str]], n: int = WORDS, percent: int = PERCENT) -> list[str]:
    """Words such that, in every template, shingles without any of them make up less than `percent` in 100.

    Words of six or more characters come first where there are any, since common words are short; among them those
    that most templates share, and long ones before short ones.
    """
    chosen: list[str] = []
    sets = [shingles_of(t, n) for t in templates]
    bare = lambda s: [x for x in s if not set(x.split()) & set(chosen)]
    while open_ := [b for s in sets if 100 * len(b := bare(s)) >= percent * len(s)]:
        words = sorted({w for b in open_ for x in b for w in x.split()}, key=lambda w: (len(w) < 6, -sum(any(w in x.split() for x in b) for b in open_), -len(w), w))
        chosen.append(words[0])
    return chosen


def _values(shingle: Column) -> list[Column]:
    return [F.xxhash64(shingle, F.lit(b)) for b in range(BANDS)]


def templates_table(spark: SparkSession, templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """template, license, size (shingles), span (words) and shingles of each notice."""
    rows, number = [], 0
    for license_, notices in (templates or TEMPLATES).items():
        for notice in notices:
            words = words_of(notice)
            if words:
                rows.append((number, license_, len(shingles_of(words)), len(words), shingles_of(words)))
                number += 1
    return spark.createDataFrame(rows, "template int, license string, size int, span int, shingles array<string>")


def _tightest() -> Column:
    """struct(first, last) of the shortest run of a window's hits that has all its distinct shingles, the first of them."""
    before = lambda e: F.array_max(F.transform(F.filter("hits", lambda y: (y["shingle"] == e["shingle"]) & (y["at"] < e["at"])), lambda y: y["at"]))
    hits = F.transform("hits", lambda e: F.struct(e["at"].alias("at"), F.coalesce(before(e), F.lit(-1)).alias("before")))
    runs = F.transform(F.array(hits), lambda h: F.transform(h, lambda a: F.struct(a["at"].alias("first"), F.transform(F.filter(h, lambda e: (e["at"] >= a["at"]) & (e["before"] < a["at"])), lambda e: e["at"]).alias("own"))))[0]
    whole = F.filter(runs, lambda r: F.size(r["own"]) == F.col("held"))
    x = F.array_min(F.transform(whole, lambda r: F.struct((F.array_max(r["own"]) - r["first"]).alias("width"), r["first"].alias("first"), F.array_max(r["own"]).alias("last"))))
    return F.struct(x["first"].alias("first"), x["last"].alias("last"))


def _resolved(places: str) -> Column:
    """The places that stay, most whole first: one per notice of a licence, none that lies by half in a fuller other one."""

    def beaten(x: Column, y: Column) -> Column:
        both = F.least(x["stop"], y["stop"]) - F.greatest(x["first"], y["first"])
        own, other = x["stop"] - x["first"], y["stop"] - y["first"]
        same = (x["license"] == y["license"]) & (2 * both >= F.least(own, other))
        return (both > 0) & (same | ((x["license"] != y["license"]) & (y["less"] < x["less"]) & (2 * both >= own)))

    none = F.filter(F.col(places), lambda x: F.lit(False))
    return F.aggregate(F.sort_array(places), none, lambda kept, x: F.when(F.exists(kept, lambda y: beaten(x, y)), kept).otherwise(F.concat(kept, F.array(x))))


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """doc_id, licenses (sorted), spans (license:first word:end word:percent) of every row of docs."""
    spark = docs.sparkSession
    notices = [words_of(x) for xs in (templates or TEMPLATES).values() for x in xs]
    notices = [x for x in notices if x]
    known = templates_table(spark, templates)
    some = "|".join(map(re.escape, anchors(notices)))
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    # Shingles that any template has; their number is bounded by the templates.
    ours = spark.createDataFrame([(x,) for x in sorted({x for n in notices for x in shingles_of(n)})], "shingle string")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lower, F.lit(_WORD), F.lit(0))
    anchored = rows.where(F.col("text").rlike(rf"(?i)(?:{some})")).select(F.sha2("text", 256).alias("text_key"), words.alias("words")).dropDuplicates(["text_key"])
    shingle = lambda i: F.array_join(F.slice("words", i, WORDS), " ")
    last = F.greatest(F.size("words") - WORDS + 1, F.lit(1))
    placed = F.posexplode(F.transform(F.sequence(F.lit(1), last), shingle)).alias("at", "shingle")
    hits = anchored.where(F.size("words") > 0).select("text_key", placed).join(F.broadcast(ours), "shingle").select("text_key", "at", "shingle")
    hits = materialize(hits, "license-hits")
    # Windows of one and a half lengths, one each half length: a shingle lies in three of each length.
    spans = sorted({len(x) for x in notices})
    halves = F.explode(F.array(*[F.struct(F.lit(n).alias("span"), F.lit(math.ceil(n / 2)).alias("half")) for n in spans]))
    windows = hits.select("*", halves.alias("w")).select("text_key", "at", "shingle", F.col("w.span").alias("span"), F.col("w.half").alias("half"))
    number = F.floor(F.col("at") / F.col("half"))
    windows = windows.withColumn("window", F.explode(F.array(number, number - 1, number - 2))).where("window >= 0 or at < half")
    own = known.select("template", "license", "size", "span", F.explode("shingles").alias("shingle"))
    # Sketches of windows meet those of templates; what a window holds of a template is counted where they met.
    at = ["text_key", "span", "window"]
    bands = lambda rows, *by: rows.groupBy(*by).agg(*[F.min(v).alias(f"b{k}") for k, v in enumerate(_values(F.col("shingle")))]).select(*by, F.posexplode(F.array(*[f"b{k}" for k in range(BANDS)])).alias("band", "value"))
    own = known.select("template", "license", "size", "span", F.explode("shingles").alias("shingle"))
    met = bands(windows, *at).join(F.broadcast(bands(own, "template", "span")), ["span", "band", "value"]).select(*at, "template").distinct()
    # A window costs far more in memory than its hits do in a file, so by the file's size Spark would broadcast all windows.
    cut = windows.hint("merge").join(met, at).join(F.broadcast(own.drop("span")), ["template", "shingle"])
    key = ["text_key", "template", "license", "size", "window"]
    met = cut.groupBy(*key).agg(F.min("at").alias("first"), F.max("at").alias("last"), F.collect_list(F.struct("at", "shingle")).alias("hits")).withColumn("held", F.size(F.array_distinct(F.transform("hits", lambda x: x["shingle"]))))
    good = met.where(F.col("held") * 100 >= F.col("size") * PERCENT)
    tight = F.when(F.size("hits") == F.col("held"), F.struct(F.col("first"), F.col("last"))).otherwise(_tightest())
    place = good.select("text_key", "license", F.floor(F.col("held") * 100 / F.col("size")).cast("int").alias("percent"), tight.alias("x"))
    place = place.select("text_key", "license", F.col("x.first").cast("int").alias("first"), (F.col("x.last") + WORDS).cast("int").alias("stop"), "percent").distinct()
    # Places that overlap, directly or through others, are resolved together.
    order = Window.partitionBy("text_key").orderBy("first", "stop", "license", "percent")
    reach = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    place = place.withColumn("new", F.when(F.col("first") < reach, 0).otherwise(1))
    place = place.withColumn("group", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    kept = place.groupBy("text_key", "group").agg(F.collect_list(F.struct((-F.col("percent")).alias("less"), "first", "stop", "license")).alias("places")).select("text_key", F.explode(_resolved("places")).alias("x"))
    found = kept.groupBy("text_key").agg(F.sort_array(F.collect_list(F.struct("x.license", "x.first", "x.stop", (-F.col("x.less")).alias("percent")))).alias("found"))
    found = materialize(found, "licenses")
    keyed = rows.select("doc_id", F.when(F.col("text").rlike(rf"(?i)(?:{some})"), F.sha2("text", 256)).alias("text_key"))
    # Most texts hold no anchor; a join would send them all to one task.
    none = F.array().cast(found.schema["found"].dataType)
    some = keyed.where(F.col("text_key").isNotNull()).join(found.hint("merge"), "text_key", "left").withColumn("found", F.coalesce("found", none))
    told = keyed.where(F.col("text_key").isNull()).withColumn("found", none).unionByName(some)
    told = told.select("doc_id", F.array_distinct(F.transform("found", lambda x: x["license"])).alias("licenses"), F.transform("found", lambda x: F.concat_ws(":", x["license"], x["first"].cast("string"), x["stop"].cast("string"), x["percent"].cast("string"))).alias("spans"))
    return told.withColumn("n_licenses", F.size("licenses"))
