"""License scans: MinHash bands over overlapping text windows, verified by shingle containment.

Texts are sequences of shingles of five words, each with a 64-bit hash. Windows of 12 shingles begin
at every fourth; of each, band j keeps the least of the hashes xor a constant of its own over all 64
bits, so two windows agree in a band with about the probability of their Jaccard similarity. Longer
templates are cut into parts of 8 shingles at most, which always lie whole in some window: with BANDS
bands of one row, a part of n shingles is missed with a probability of at most (1 - n / 12) ** BANDS,
1.3 % at n = 5 and 0.015 % at n = 8 (most parts lie in two windows, so less is missed: the test
measures 0.2 % at n = 5). Templates of fewer than five shingles match only whole (one shingle less is
under 0.8), so their windows have their own length and begin everywhere, and one band finds them with
certainty. What the bands retrieve is verified on the words themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, hinted, small_enough
from .decontaminate import words

SHINGLE, CONTAINMENT = 5, 0.8
STEP, STEPS_A_WINDOW, PART, BANDS = 4, 3, 8, 8

#: Templates that op5 looks for: notices and opening paragraphs of public licenses. Fixed values.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-header": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
}


def _salt(kind: int) -> int:
    """A constant of each band or window length, spread over 64 bits, as a signed long."""
    x = (kind + 1) * 0x9E3779B97F4A7C15 % (1 << 64)
    x = (x ^ (x >> 31)) * 0xBF58476D1CE4E5B9 % (1 << 64)
    x ^= x >> 29
    return x - (1 << 64) if x >> 63 else x


def _hashed(rows: DataFrame) -> DataFrame:
    """rows with the hashes g of the shingles in place of the words w; null if there are too few."""
    rows = rows.withColumn("v", F.transform("w", lambda w: F.xxhash64(w))).drop("w")
    shingle = lambda x, i: F.xxhash64(x, *[F.get("v", i + j) for j in range(1, SHINGLE)])
    g = F.when(F.size("v") >= SHINGLE, F.slice(F.transform("v", shingle), F.lit(1), F.size("v") - (SHINGLE - 1)))
    return rows.withColumn("g", g).drop("v")


def _lit(value: int) -> str:
    return f"cast('{value}' as bigint)"


def _least(terms: list[str]) -> str:
    return f"least({', '.join(terms)})" if len(terms) > 1 else terms[0]


def _keys(rows: DataFrame, lengths: list[int], bands: bool) -> DataFrame:
    """rows with the words w instead have a row for each distinct band value of their windows, in
    key: of windows of the given lengths, and of the bands. Null if there is none."""
    rows = _hashed(rows)
    parts = []
    for n in lengths:
        whole = _least([f"get(g, i + {j})" for j in range(n)])
        parts.append(f"if(size(g) >= {n}, transform(sequence(0, size(g) - {n}), i -> {whole} ^ ({_lit(_salt(n))})), array())")
    if bands:
        least = {f"b{j}": F.expr(f"transform(sequence(0, (size(g) - 1) div {STEP}), k -> {_least([f'get(g, {STEP} * k + {i}) ^ ({_lit(_salt(100 + j))})' for i in range(STEP)])})") for j in range(BANDS)}
        rows = rows.withColumns(least)
        for j in range(BANDS):
            window = _least([f"get(b{j}, k + {i})" for i in range(STEPS_A_WINDOW)])
            parts.append(f"transform(sequence(0, size(b{j}) - 1), k -> {window} ^ ({_lit(_salt(500 + j))}))")
    own = [c for c in rows.columns if c != "g" and not (bands and c in least)]
    keys = F.expr(f"if(g is null, null, array_distinct(concat({', '.join(parts)})))") if parts else F.lit(None).cast("array<bigint>")
    return rows.select(*own, keys.alias("keys")).select(*own, F.explode_outer("keys").alias("key"))


def matches(docs: DataFrame, templates: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, h (hash of the text), license, containment: the templates (license, text) of whose
    distinct five-word shingles a document's text holds at least CONTAINMENT.

    Words are runs of letters, digits and characters beyond ASCII, in lower case. Null texts and
    those of fewer than five words match nothing, as do such templates. Rows equal in doc_id and
    text give one row. Other columns are not read; empty tables give empty results.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    kinds = templates.select("license", words(F.col("text")).alias("w")).filter(f"size(w) >= {SHINGLE}")
    kinds = checkpointed(kinds.withColumn("s", F.array_distinct(_strings())))
    lengths = sorted(r[0] for r in kinds.select(F.expr(f"size(w) - {SHINGLE - 1}").alias("n")).filter(f"n < {SHINGLE}").distinct().collect())  # four at most
    long = kinds.filter(f"size(w) - {SHINGLE - 1} >= {SHINGLE}")
    cuts = long.select("license", F.expr(f"explode(transform(sequence(0, greatest(0, (size(w) - {SHINGLE - 1} - {PART} + {STEP - 1}) div {STEP})), k -> slice(w, k * {STEP} + 1, {PART + SHINGLE - 1})))").alias("w"))
    bands = long.limit(1).count() > 0
    index = _keys(cuts, [], bands) if bands else None
    for n in lengths:
        own = _keys(kinds.filter(f"size(w) - {SHINGLE - 1} = {n}").select("license", "w"), [n], False)
        index = own if index is None else index.unionByName(own)
    if index is None:
        return rows.limit(0).select("doc_id", "h", F.lit("").alias("license"), F.lit(0.0).alias("containment"))
    index = checkpointed(index.filter("key is not null").distinct())
    found = _keys(rows.select("doc_id", "h", words(F.col("text")).alias("w")), lengths, bands)
    found = found.join(hinted(index, 60), "key").select("doc_id", "h", "license").distinct()
    found = checkpointed(found)
    # texts that have candidates are read once more; a text has no more of them than there are templates
    per = found.groupBy(F.col("doc_id").alias("d"), F.col("h").alias("g")).agg(F.collect_set("license").alias("licenses"))
    per = F.broadcast(per) if small_enough(found, 80) else per
    again = rows.join(per, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")))
    again = again.select("doc_id", "h", "licenses", words(F.col("text")).alias("w")).withColumn("here", F.array_distinct(_strings()))
    again = again.select("doc_id", "h", "here", F.explode("licenses").alias("license"))
    both = again.join(hinted(kinds.select("license", "s"), 4000), "license")
    both = both.select("doc_id", "h", "license", (F.size(F.array_intersect("here", "s")) / F.size("s")).alias("containment"))
    return both.dropDuplicates(["doc_id", "h", "license"]).filter(F.col("containment") >= CONTAINMENT)


def _strings() -> Column:
    parts = ", ".join(f"get(w, i + {j})" for j in range(SHINGLE))
    return F.expr(f"if(size(w) >= {SHINGLE}, transform(sequence(0, size(w) - {SHINGLE}), i -> concat_ws(' ', {parts})), array())")


def scan(docs: DataFrame, templates: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_licenses, licenses (sorted, comma-joined), containment (the
    best; null without any)."""
    found = matches(docs, templates, doc_id, text).groupBy(F.col("doc_id").alias("d"), F.col("h").alias("g"))
    found = found.agg(F.sort_array(F.collect_set("license")).alias("named"), F.max("containment").alias("containment"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("h"))
    out = rows.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left")
    count = F.coalesce(F.size("named"), F.lit(0)).cast("long")
    return out.select("doc_id", count.alias("n_licenses"), F.coalesce(F.array_join("named", ","), F.lit("")).alias("licenses"), F.round("containment", 6).alias("containment"))


_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in TEMPLATES.items())
_CUT = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = rf"""
with t(license, text) as (values {_VALUES}),
tw as (select license, {_CUT} as w from t),
ts as (select distinct license, array_to_string(w[p:p + 4], ' ') as s from (select license, w, unnest(range(1, len(w) - 3)) as p from tw)),
n as (select license, count(*) as n from ts group by license),
dw as (select doc_id, {_CUT} as w from documents),
ds as (select distinct doc_id, array_to_string(w[p:p + 4], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 3)) as p from dw)),
m as (select doc_id, ts.license as license, count(*) as m from ds join ts on ds.s = ts.s group by doc_id, ts.license),
c as (select doc_id, m.license as license, m / n as containment from m join n on m.license = n.license where m / n >= {CONTAINMENT}),
a as (select doc_id, count(*) as n_licenses, string_agg(license, ',' order by license) as licenses, max(containment) as containment from c group by doc_id)
select d.doc_id as doc_id, cast(coalesce(n_licenses, 0) as bigint) as n_licenses, coalesce(licenses, '') as licenses, round(containment, 6) as containment
from documents d left join a on d.doc_id = a.doc_id
"""
