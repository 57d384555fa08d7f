"""License scan in DataFrame expressions: MinHash bands over text windows, then exact containment.

Words are runs of letters and digits of the lower-cased text. A template of L words has shingles of
n = min(5, L) words and s = L - n + 1 of them; templates with equal (n, s) form a class. Windows of s
shingles start at multiples of max(1, s // 4), so some window overlaps any occurrence in at least 7/8
of its shingles. A window's signature holds the minima of HASHES hash functions over its shingles;
each minimum is one band. A window at Jaccard similarity J to a template shares no band with
probability (1 - J)**HASHES: below 1e-6 at J = 0.5, which an occurrence with containment 0.8 reaches.

A window can share band k with a template only if it holds the template's k-th minimal shingle, so
the whole corpus is first searched for those shingles (a set lookup per shingle inside the scan) and
windows are laid only around the hits. Retrieved templates are confirmed by exact containment: the
distinct template shingles within the window widened by half a window on both sides, at least
CONTAINED of all.

The shipped table holds notices and their variants, and whole license texts (``license_texts``) cut into
sections of SECTION words, ids ``<license>-text-<n>``: any section that stands in a document is found,
also with a changed word, and all sections share one class. Short notices need every word, so each
wording is a template of its own.
"""

from __future__ import annotations

import re
from functools import cache
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveil.session import stored

HASHES = 20
CONTAINED = 0.8
MAX_TEMPLATES = 5_000    # the template table is broadcast; larger ones are refused
SECTION = 64             # words of a section of a license text
WORD = "[\\p{L}\\p{N}]+"

# fixed values: notices of common licenses and the opening sentences of license texts
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files, to deal in the Software without restriction",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
               "Public License as published by the Free Software Foundation",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
           "following conditions are met",
    "all-rights-reserved": "All rights reserved.",
}

# further wordings; none of them stands in a notice above
VARIANTS = {
    "mit-notice-2": "Released under MIT License", "mit-notice-3": "Licensed under the MIT License", "mit-notice-4": "This project is MIT licensed",
    "mit-notice-5": "Distributed under the MIT License", "mit-notice-6": "Licensed under MIT License",
    "apache-2.0-notice-2": "Licensed under the Apache License 2.0", "apache-2.0-notice-3": "Released under the Apache License, Version 2.0",
    "apache-2.0-notice-4": "Released under the Apache License 2.0", "apache-2.0-notice-5": "Licensed under Apache 2.0",
    "gpl-2.0-notice": "GNU General Public License, version 2", "gpl-2.0-notice-2": "Licensed under the GPL v2", "gpl-2.0-notice-3": "Licensed under the GPLv2",
    "gpl-3.0-notice-2": "Licensed under the GPL v3", "gpl-3.0-notice-3": "Licensed under the GPLv3", "gpl-3.0-notice-4": "GNU General Public License v3.0",
    "lgpl-notice": "GNU Lesser General Public License", "agpl-notice": "GNU Affero General Public License",
    "mpl-2.0-notice": "Mozilla Public License, Version 2.0", "mpl-2.0-notice-2": "Mozilla Public License, v. 2.0",
    "bsd-notice": "Licensed under the BSD License", "bsd-notice-2": "Released under the BSD License", "isc-notice": "Licensed under the ISC License",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
           "provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc0-notice": "CC0 1.0 Universal", "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.", "cc-by-nc-sa-4.0-notice": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-4.0-notice-2": "Creative Commons Attribution 4.0", "cc-by-sa-4.0-notice-2": "Creative Commons Attribution-ShareAlike 4.0",
    "cc-by-nc-4.0-notice-2": "Creative Commons Attribution-NonCommercial 4.0", "copyright-notice": "Copyright (c)",
    **{f"spdx-{x.lower()}": f"SPDX-License-Identifier: {x}" for x in (
        "MIT", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "CC0-1.0",
        "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "Unlicense")},
}


@cache
def _sections() -> dict[str, str]:
    """Sections of the license texts; the last one of a text ends with it."""
    out = {}
    for f in sorted(resources.files("surveil.llm").joinpath("license_texts").iterdir(), key=lambda f: f.name):
        w = re.findall(r"[^\W_]+", f.read_text(encoding="utf-8"))
        for k, a in enumerate(range(0, len(w), SECTION)):
            a = max(0, min(a, len(w) - SECTION))
            out[f"{f.name.removesuffix('.txt')}-text-{k + 1:03d}"] = " ".join(w[a:a + SECTION])
    return out


def shipped() -> dict[str, str]:
    return TEMPLATES | VARIANTS | _sections()


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def shingles(w: Column, n: int) -> Column:
    """Hashes of the runs of n words, in order."""
    m = F.greatest(F.size(w) - (n - 1), F.lit(0))
    parts = [F.slice(w, j + 1, m).alias(f"w{j}") for j in range(n)]
    return F.transform(F.arrays_zip(*parts), lambda t: F.xxhash64(*[t[f"w{j}"] for j in range(n)]))


def _nth(k: int):
    return lambda x: F.xxhash64(x, F.lit(k))


def signature(window: Column) -> Column:
    """Minimum of each hash function over an array of shingle hashes."""
    return F.array(*[F.array_min(F.transform(window, _nth(k))) for k in range(HASHES)])


def _place(wanted: list[int]):
    return lambda v, i: F.when(v.isin(wanted), i)


def _minimal(sh: Column) -> Column:
    """The shingles that attain the minima of ``signature``."""
    def pair(k):
        return lambda x: F.struct(_nth(k)(x).alias("h"), x.alias("x"))
    return F.array(*[F.array_min(F.transform(sh, pair(k)))["x"] for k in range(HASHES)])


def template_table(spark: SparkSession, templates: dict[str, str] | None = None) -> DataFrame:
    """(license, text) of the given templates, or of all shipped ones; those without words are left out by ``scan``."""
    rows = list((shipped() if templates is None else templates).items())
    return spark.createDataFrame(rows, "license string, text string")


def _classes(templates: DataFrame) -> dict[tuple[int, int], dict]:
    """Per class (n, s): its templates' ids, shingles and signatures, and their minimal shingles."""
    if templates.limit(MAX_TEMPLATES + 1).count() > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    sized = templates.filter("license is not null").select("license", words(F.col("text")).alias("w")).filter("size(w) > 0")
    out: dict[tuple[int, int], dict] = {}
    for n in range(1, 6):
        mine = sized.filter(F.size("w") == n if n < 5 else F.size("w") >= 5).select("license", shingles(F.col("w"), n).alias("sh"))
        for r in mine.select("license", "sh", signature(F.col("sh")).alias("sig"), _minimal(F.col("sh")).alias("min")).collect():
            c = out.setdefault((n, len(r.sh)), {"rows": [], "min": set()})
            c["rows"].append((r.license, sorted(set(r.sh)), r.sig))
            c["min"] |= set(r.min)
    return out


def scan(docs: DataFrame, templates: DataFrame | None = None, contained: float = CONTAINED) -> DataFrame:
    """(doc_id, n_words, n_licenses, licenses, matches) for each row of ``docs``.

    licenses: ids found, sorted, comma-joined; matches: ``id:word:shared/all`` per license, where word
    is the first word of the best window (earliest on ties) and shared/all counts its distinct
    shingles. Reads doc_id and text only. Null or empty text: no words, nothing found. Repeated rows
    each get the result; a null doc_id is reported as null. An empty table gives an empty result; an
    empty template table finds nothing.
    """
    spark = docs.sparkSession
    classes = _classes(templates if templates is not None else template_table(spark))
    sizes = sorted({n for n, _ in classes})
    x = docs.select("doc_id", F.xxhash64("text").alias("h"), words(F.col("text")).alias("w"))
    x = x.select("doc_id", "h", F.size("w").alias("n_words"), *[shingles(F.col("w"), n).alias(f"sh{n}") for n in sizes])
    at = []
    for n in sizes:
        wanted = sorted(set().union(*[c["min"] for (m, _), c in classes.items() if m == n]))
        place = F.transform(F.col(f"sh{n}"), _place(wanted))
        at.append(F.filter(place, lambda i: i.isNotNull()).alias(f"at{n}"))
    x = x.select("*", *at)
    x = x.select("doc_id", "h", "n_words", *[F.col(f"at{n}") for n in sizes],
                 *[F.when(F.size(f"at{n}") > 0, F.col(f"sh{n}")).alias(f"sh{n}") for n in sizes])
    base = stored(x, "shingles")
    if not classes:
        return base.select("doc_id", "n_words", F.lit(0).alias("n_licenses"), F.lit("").alias("licenses"), F.lit("").alias("matches"))
    best = (_matches(base, classes, contained).groupBy("doc_id", "h", "license", "total")
            .agg(F.max(F.struct("shared", (-F.col("start")).alias("neg"))).alias("b")))
    per = best.groupBy("doc_id", "h").agg(F.array_sort(F.collect_list(F.struct(      # at most one row per template
        "license", F.format_string("%s:%d:%d/%d", "license", -F.col("b.neg"), F.col("b.shared"), F.col("total")).alias("m")))).alias("l"))
    per = per.select(F.col("doc_id").alias("d"), F.col("h").alias("g"), "l")
    return (base.select("doc_id", "h", "n_words").join(per, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
            .select("doc_id", "n_words", F.coalesce(F.size("l"), F.lit(0)).alias("n_licenses"),
                    F.coalesce(F.array_join("l.license", ","), F.lit("")).alias("licenses"),
                    F.coalesce(F.array_join("l.m", ","), F.lit("")).alias("matches")))


def _hits(n: int, widest: int):
    """Hit position -> (n, p, shingle there, first shingle of its surroundings, the surroundings)."""
    def one(p: Column) -> Column:
        low = F.greatest(p - 2 * widest, F.lit(0))
        return F.struct(F.lit(n).alias("n"), p.cast("int").alias("p"), F.get(f"sh{n}", p).alias("x"), low.cast("int").alias("low"),
                        F.slice(f"sh{n}", low + 1, F.lit(4 * widest + 1)).alias("near"))
    return F.transform(f"at{n}", one)


def _matches(base: DataFrame, classes: dict[tuple[int, int], dict], contained: float) -> DataFrame:
    """(doc_id, h, license, total, shared, start) of the confirmed windows of all classes, in one plan.

    The class is a column: a hit belongs to the classes that have its shingle among their minimal ones."""
    spark = base.sparkSession
    minimal, sigs, sets, t = [], [], [], 0
    for (n, s), c in sorted(classes.items()):
        minimal += [(n, x, s) for x in sorted(c["min"])]
        for lic, sh, sig in c["rows"]:
            sigs += [(n, s, k, v, t) for k, v in enumerate(sig)]
            sets.append((t, lic, sh))
            t += 1
    # these tables hold at most MAX_TEMPLATES x HASHES rows
    minimal = F.broadcast(spark.createDataFrame(minimal, "n int, x long, s int"))
    sigs = F.broadcast(spark.createDataFrame(sigs, "n int, s int, k int, v long, t int"))
    sets = F.broadcast(spark.createDataFrame(sets, "t int, license string, want array<long>"))
    widest = {n: max(s for m, s in classes if m == n) for n, _ in classes}
    hits = base.select("doc_id", "h", F.explode(F.flatten(F.array(*[F.coalesce(_hits(n, w), F.array()) for n, w in sorted(widest.items())]))).alias("e"))
    hits = hits.select("doc_id", "h", "e.*").join(minimal, ["n", "x"])
    s, step = F.col("s"), F.greatest(F.floor(F.col("s") / 4), F.lit(1)).cast("int")
    first = F.greatest(F.ceil((F.col("p") - (s - 1)) / step) * step, F.lit(0)).cast("int")
    wins = hits.select("doc_id", "h", "n", "s", "low", "near", F.explode(F.sequence(first, (F.floor(F.col("p") / step) * step).cast("int"), step)).alias("start"))
    half = F.floor(s / 2).cast("int")
    left = F.greatest(F.col("start") - half, F.lit(0))
    wins = wins.select("doc_id", "h", "n", "s", "start", F.slice("near", F.col("start") - F.col("low") + 1, s).alias("win"),
                       F.slice("near", left - F.col("low") + 1, F.col("start") + s + half - left).alias("wide")).dropDuplicates(["doc_id", "h", "n", "s", "start"])
    wins = wins.select("doc_id", "h", "n", "s", "start", "wide", F.posexplode(signature(F.col("win"))).alias("k", "v"))
    got = wins.join(sigs, ["n", "s", "k", "v"]).select("doc_id", "h", "start", "wide", "t").dropDuplicates(["doc_id", "h", "start", "t"])
    got = got.join(sets, "t").withColumn("shared", F.size(F.array_intersect("wide", "want"))).withColumn("total", F.size("want"))
    return got.filter(F.col("shared") >= F.ceil(F.col("total") * F.lit(contained) - F.lit(1e-9))).select("doc_id", "h", "license", "total", "shared", "start")
