"""License scans with DataFrame functions only.

Words are runs of letters or digits of the lower-cased text; a shingle is five
of them.  Texts and templates are cut in overlapping windows of eight words,
four apart, so every shingle lies in a window of four shingles.  A window's
signature is ``BANDS`` min-hashes of its shingles, each a band of its own: two
windows that share one shingle of four (Jaccard at least 1/7) meet in a band
with probability 1 - (6/7)^48 > 0.999, and a notice longer than one shingle has
several such windows.  Windows that meet a template's window in a band retrieve
that template; exact containment (share of the template's distinct shingles
found in the document, at least ``THRESHOLD``) then decides.

Before hashing, a document must hold one of the templates' anchors, fragments
such that every template with none of its anchored shingles is below the
threshold (checked when templates are built), or the one run of words that a
template of five words or fewer is: an exact gate, not a heuristic.  Texts are
lower-cased once for all of it.

A template under five words is one run of its own length, looked up by its hash
among the runs of that length of documents that pass for it: exact containment,
no windows.

``op5_licenses`` reports ``TEMPLATES``, whose rows its SQL fixes; ``notices``
reports ``SHORT_FORMS`` and the further licenses as well.  A notice that holds a
shorter one ("SPDX-License-Identifier: MIT-0" holds that of MIT) reports both.

Defined results: null and empty texts match nothing, nor does a text shorter
than the template; rows that
repeat a doc_id are matched on each of their texts and reported once per
template with the best containment, and so are the rows without one, as the
group of the null id; an empty table gives an empty result; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.llm import _common as C

WORDS = 5
WINDOW = 8
STRIDE = 4
BANDS = 48
THRESHOLD = 0.8

# Wording of public license notices, by SPDX identifier.
TEMPLATES = [
    ("MIT", "released under the MIT License"),
    ("MIT", "licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "licensed under the GNU General Public License, version 3"),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "licensed under CC BY-SA 4.0"),
]
ANCHORS = ["licens", "software", "redistribut", "binary", "permitted", "mozilla"]

# Identifiers of the SPDX list, and wording of short forms and of licenses absent above.
SPDX = "MIT Apache-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later AGPL-3.0-only AGPL-3.0-or-later BSD-2-Clause BSD-3-Clause ISC MPL-2.0 CC0-1.0 CC-BY-4.0 CC-BY-SA-4.0 CC-BY-NC-4.0 Unlicense GPL-2.0 GPL-3.0 LGPL-2.1 LGPL-3.0 AGPL-3.0".split()
SHORT_FORMS = [
    ("LicenseRef-All-Rights-Reserved", "All rights reserved"),
    *[(i, f"SPDX-License-Identifier: {i}") for i in SPDX],
    ("MIT", "MIT License"),
    ("MIT", "License: MIT"),
    ("Apache-2.0", "Apache License 2.0"),
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", "Apache-2.0"),
    ("GPL-2.0", "GPLv2"),
    ("GPL-2.0", "GPL v2"),
    ("GPL-2.0", "GPL-2.0"),
    ("GPL-3.0", "GPLv3"),
    ("GPL-3.0", "GPL v3"),
    ("GPL-3.0", "GPL-3.0"),
    ("LGPL-2.1", "LGPLv2.1"),
    ("LGPL-2.1", "LGPL-2.1"),
    ("LGPL-3.0", "LGPLv3"),
    ("LGPL-3.0", "LGPL-3.0"),
    ("LGPL", "GNU Lesser General Public License"),
    ("AGPL-3.0", "AGPLv3"),
    ("AGPL-3.0", "AGPL-3.0"),
    ("AGPL", "GNU Affero General Public License"),
    ("BSD-2-Clause", "BSD 2-Clause"),
    ("BSD-3-Clause", "BSD 3-Clause"),
    ("ISC", "ISC License"),
    ("ISC", "License: ISC"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("MPL-2.0", "MPL 2.0"),
    ("MPL-2.0", "Mozilla Public License 2.0"),
    ("CC0-1.0", "CC0"),
    ("CC-BY-4.0", "CC BY 4.0"),
    ("CC-BY-SA-4.0", "CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "CC BY-NC 4.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
]
SHORT_ANCHORS = ["copyright"]


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def check_anchors(templates, anchors) -> None:
    """Anchors are within one word. Every match at the threshold must contain an anchor; raises if a template lets one slip."""
    for name, text in templates:
        ws = _words(text)
        if not ws:
            raise ValueError(f"{name}: a template needs a word")
        size = min(WORDS, len(ws))
        shingles = {" ".join(ws[i : i + size]) for i in range(len(ws) - size + 1)}
        bare = sum(not any(a in s for a in anchors) for s in shingles)
        if bare >= THRESHOLD * len(shingles):
            raise ValueError(f"{name}: {bare} of {len(shingles)} shingles hold no anchor")


def holds(text: Column, anchors, runs) -> Column:
    """Whether a text, lower-cased, holds an anchor or one of the ``runs`` of words (templates).

    A run is looked for with a pattern only where its longest word is found.  The
    lower-cased text is bound as a lambda variable: a filter would make it anew
    for every fragment.
    """
    patterns: dict[str, set[str]] = {}
    for _, run in runs:
        ws = _words(run)
        patterns.setdefault(max(ws, key=len), set()).add(r"[^\p{L}\p{N}]+".join(ws))

    def found(low: Column) -> Column:
        out = F.lit(False)
        for a in anchors:
            out = out | F.contains(low, F.lit(a))
        for word, them in patterns.items():
            out = out | (F.contains(low, F.lit(word)) & F.rlike(low, F.lit(rf"(?<![\p{{L}}\p{{N}}])(?:{'|'.join(sorted(them))})(?![\p{{L}}\p{{N}}])")))
        return out

    return F.exists(F.array(F.lower(text)), found)


def shingle_hashes(text: Column, size: int = WORDS) -> Column:
    """Hashes of all runs of ``size`` words in order, as an array.

    The words are bound as a lambda variable: named inside a lambda, an
    expression would be evaluated again for every element.
    """
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")

    def shingles(ws: Column) -> Column:
        last = F.size(ws) - (size - 1)
        places = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.xxhash64(F.array_join(F.slice(ws, i, size), " ")))

    return F.element_at(F.transform(F.array(words), shingles), 1)


def bands(hashes: DataFrame, keep: list[str]) -> DataFrame:
    """Rows (keep..., band, value): min-hashes of every window of ``h``."""
    starts = F.sequence(F.lit(1), F.size("h"), F.lit(STRIDE))
    windows = hashes.where("size(h) > 0").select(*keep, F.explode(F.transform(starts, lambda s: F.slice("h", s, WINDOW - WORDS + 1))).alias("w"))
    minima = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.array_min(F.transform(F.col("w"), lambda x: F.xxhash64(x, k))))
    return windows.select(*keep, F.posexplode(minima).alias("band", "value"))


def template_table(spark: SparkSession, templates=TEMPLATES) -> DataFrame:
    """(template_id, license, th): th holds the template's distinct shingle hashes, h all of them."""
    rows = F.array(*[F.struct(F.lit(i).alias("template_id"), F.lit(name).alias("license"), F.lit(text).alias("t")) for i, (name, text) in enumerate(templates)])
    table = spark.range(1).select(F.inline(rows)).withColumn("h", shingle_hashes(F.col("t")))
    return table.select("template_id", "license", "h", F.array_distinct("h").alias("th"))


def short_matches(docs: DataFrame, templates) -> DataFrame:
    """Matches of the templates under five words in (doc_id, text), in the columns of ``scan``.  Ids are places in ``templates``."""
    found = None
    for size in sorted({n for _, t in templates if (n := len(_words(t))) < WORDS}):
        rows = F.array(*[F.struct(F.lit(i).alias("template_id"), F.lit(name).alias("license"), F.lit(text).alias("t")) for i, (name, text) in enumerate(templates) if len(_words(text)) == size])
        table = docs.sparkSession.range(1).select(F.inline(rows)).select("template_id", "license", F.element_at(shingle_hashes(F.col("t"), size), 1).alias("x"))
        runs = docs.select("doc_id", F.posexplode(shingle_hashes(F.col("text"), size)).alias("at", "x"))
        # as many rows as there are short templates
        hits = runs.join(F.broadcast(table), "x").groupBy("doc_id", "template_id", "license").agg((F.min("at") + 1).alias("first_word"))
        found = hits if found is None else found.union(hits)
    return found.select("doc_id", "template_id", "license", F.lit(1).alias("n_matched"), F.lit(1).alias("n_shingles"), F.lit(1.0).alias("containment"), F.col("first_word").cast("long").alias("first_word"))


def scan(docs: DataFrame, templates=TEMPLATES, anchors=ANCHORS) -> DataFrame:
    """Matches of (doc_id, text): doc_id, template_id, license, n_matched, n_shingles, containment, first_word."""
    check_anchors([t for t in templates if len(_words(t[1])) > WORDS], anchors)
    spark = docs.sparkSession
    whole = [t for t in templates if len(_words(t[1])) == WORDS]
    short = [t for t in templates if len(_words(t[1])) < WORDS]
    docs = docs.select("doc_id", "text")
    if short:  # several passes follow, over what this one leaves
        docs = C.materialize(docs.where(holds(F.col("text"), anchors, whole + short)), "license-gated")
    gated = docs.where(holds(F.col("text"), anchors, whole))
    shingled = C.materialize(gated.select("doc_id", shingle_hashes(F.col("text")).alias("h")).where("size(h) > 0").distinct(), "license-docs")
    table = C.materialize(template_table(spark, templates), "license-templates")
    signed = bands(table, ["template_id"]).distinct()  # templates x windows x bands rows
    wanted = signed.select("band", "value").distinct()
    hits = bands(shingled.select("doc_id", "h"), ["doc_id"]).join(wanted, ["band", "value"]).distinct()
    retrieved = hits.join(signed, ["band", "value"]).select("doc_id", "template_id").distinct()
    named = retrieved.withColumnRenamed("doc_id", "_id").join(table.select("template_id", "license", "th"), "template_id")
    checked = named.join(shingled, F.col("_id").eqNullSafe(F.col("doc_id"))).drop("_id")  # rows without an id are matched too
    found = F.array_intersect("th", "h")
    rows = checked.select("doc_id", "template_id", "license", F.size(found).alias("n_matched"), F.size("th").alias("n_shingles"), F.array_min(F.transform(found, lambda x: F.array_position("h", x))).alias("first_word"))
    rows = rows.withColumn("containment", F.col("n_matched") / F.col("n_shingles")).where(F.col("containment") >= THRESHOLD)
    best = F.max_by(F.struct("n_matched", "n_shingles", "containment", "first_word"), F.struct("n_matched", -F.col("first_word")))
    matches = rows.groupBy("doc_id", "template_id", "license").agg(best.alias("b")).select("doc_id", "template_id", "license", "b.*")
    if not short:
        return matches
    return matches.unionByName(short_matches(C.materialize(docs.where(holds(F.col("text"), [], short)), "license-short"), templates))


def notices(docs: DataFrame) -> DataFrame:
    """Matches of all templates, short forms included, in (doc_id, text)."""
    return scan(docs, TEMPLATES + SHORT_FORMS, ANCHORS + SHORT_ANCHORS)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(C.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "template_id", "license", "n_matched", "n_shingles", "containment", F.col("first_word").cast("long").alias("first_word"))


def licenses_sql(templates=TEMPLATES) -> str:
    """Exact containment of every template in every document, in DuckDB SQL."""
    values = ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(templates))
    words = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
    shingle = "unnest([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)]) as s, unnest(range(1, len(w) - 3)) as pos"
    return f"""
with tw as (select id, name, {words.format('t')} as w from (values {values}) v(id, name, t)),
     ts as (select distinct id, name, s from (select id, name, {shingle} from tw)),
     tn as (select id, count(*) as n from ts group by id),
     dw as (select doc_id, row_number() over () as r, {words.format('text')} as w from documents where text is not null),
     ds as (select doc_id, r, s, min(pos) as pos from (select doc_id, r, {shingle} from dw) group by all),
     m as (select doc_id, r, id, name, count(*) as n_matched, min(pos) as first_word from ds join ts using (s) group by all)
select doc_id, id::int as template_id, name as license, max(n_matched)::int as n_matched, n::int as n_shingles,
       max(n_matched)::double / n as containment, min(first_word)::bigint as first_word
from m join tn using (id) where n_matched >= {THRESHOLD} * n group by doc_id, id, name, n
"""


def license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notices(C.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "template_id", "license", "n_matched", "n_shingles", "containment", F.col("first_word").cast("long").alias("first_word"))


def notices_sql(templates=TEMPLATES + SHORT_FORMS) -> str:
    """The same for templates of any length: one under ``WORDS`` words is a run of its own length."""
    values = ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(templates))
    words = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
    runs = "unnest([array_to_string(w[i:i + k - 1], ' ') for i in range(1, len(w) - k + 2)]) as s, unnest(range(1, len(w) - k + 2)) as pos"
    return f"""
with tw as (select id, name, w, least({WORDS}, len(w)) as k from (select id, name, {words.format('t')} as w from (values {values}) v(id, name, t))),
     ts as (select distinct id, name, k, s from (select id, name, k, {runs} from tw)),
     tn as (select id, count(*) as n from ts group by id),
     dw as (select doc_id, r, k, w from (select doc_id, row_number() over () as r, {words.format('text')} as w from documents where text is not null) cross join (select distinct k from tw)),
     ds as (select doc_id, r, k, s, min(pos) as pos from (select doc_id, r, k, {runs} from dw where len(w) >= k) group by all),
     m as (select doc_id, r, id, name, count(*) as n_matched, min(pos) as first_word from ds join ts using (k, s) group by all)
select doc_id, id::int as template_id, name as license, max(n_matched)::int as n_matched, n::int as n_shingles,
       max(n_matched)::double / n as containment, min(first_word)::bigint as first_word
from m join tn using (id) where n_matched >= {THRESHOLD} * n group by doc_id, id, name, n
"""
