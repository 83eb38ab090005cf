"""License scan with MinHash bands over overlapping text windows, in DataFrame functions alone.

Texts become arrays of hashed word shingles. For a template of n shingles, a window is n consecutive shingles of a text
(all of a shorter one); one starts at each shingle. A window that holds the asked share of the template has at least
Jaccard similarity j = t / (n + d - t) with it, of d distinct shingles, t of them asked for: 2/3 for long templates at 80
percent. Bands have one row, so that such a window misses all of b bands with probability (1 - j) ** b; each template has as many
bands as bring this to ``MISS`` or less. A template of up to four shingles must be whole (j = 1) and is never missed.

A band's value is the shingle of least hash, so the index holds one shingle for each template and band: texts without
any of them are left at once. In the others a window meets a band where a run of n shingles, none of lesser hash, holds
that shingle: one pass, whatever n. Retrieved templates are then verified by the exact containment of their
shingles, as text, in a stretch of their length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of a shingle, the least share of a template's shingles in percent, and how likely a window with just that share may be missed.
SHINGLE, PERCENT, MISS = 5, 80, 1e-4
#: Characters of all templates together: they are a literal of the plan. More are an error, not left out.
TEMPLATE_CHARACTERS = 1 << 24

#: Public license notices, by identifier.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0-file", "you may not use this file except in compliance with the License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-4.0", "Licensed under the Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-program", "you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MIT", "Released under the MIT License"),
    ("MIT-permission", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
]

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased runs of digits, letters and all beyond ASCII; none for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BREAK), "")


def _hashed() -> Column:
    """Hashes of the shingles of the column ``words``."""
    parts = ", ".join(f"element_at(words, i + {k})" for k in range(1, SHINGLE + 1))
    return F.expr(f"if(size(words) < {SHINGLE}, cast(array() as array<bigint>), transform(sequence(0, size(words) - {SHINGLE}), i -> xxhash64({parts})))")


def _shingled(words_: str) -> str:
    return f"transform(sequence(1, size({words_}) - {SHINGLE - 1}), j -> array_join(slice({words_}, j, {SHINGLE}), ' '))"


TEMPLATE = "array<struct<id: string, words: string, n: int, least: int, keys: array<bigint>>>"


def index(templates: DataFrame, percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """id, words (joined), n (shingles), least (distinct shingles asked for) and keys (a band's shingle of least hash) of each template (id, text) of a shingle or more."""
    t = templates.select(F.col("id").cast("string"), words(F.col("text").cast("string")).alias("words")).withColumn("h", _hashed()).filter("size(h) > 0 and id is not null")
    t = t.withColumn("n", F.size("h")).withColumn("d", F.size(F.array_distinct("h"))).withColumn("least", F.expr(f"cast(greatest(1, ({percent} * d + 99) div 100) as int)"))
    t = t.withColumn("bands", F.expr(f"if(least >= n, 1, cast(ceil(ln({miss!r}D) / ln(1 - least / (n + d - least))) as int))"))
    keys = "transform(sequence(1, bands), b -> array_min(transform(h, x -> struct(xxhash64(x, b) as g, x as x))).x)"
    return t.select("id", F.array_join("words", " ").alias("words"), "n", "least", F.expr(keys).alias("keys"))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | DataFrame = TEMPLATES, percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """``docs`` with licenses, the sorted ids of the templates found in its whole text, and n_licenses.

    A template is found where some stretch of as many consecutive shingles as it has holds ``percent`` of its distinct
    5-word shingles. Templates, (id, text) as a list or a table, are a parameter of bounded size (``TEMPLATE_CHARACTERS``,
    an error beyond); those of fewer than five words cannot be found, nor those without id or text; ids that repeat are
    one license with several texts. Null, empty and shorter texts hold none; repeated rows get equal results, an empty
    table stays empty; columns of these names are replaced.
    """
    spark = docs.sparkSession
    known = _bounded(index(templates if isinstance(templates, DataFrame) else spark.createDataFrame(templates, "id string, text string"), percent, miss))
    names = docs.drop("licenses", "n_licenses").columns
    rows = docs.select(F.struct(*names).alias("_row"), words(F.col("text").cast("string")).alias("words")).withColumn("h", _hashed())
    keys = F.array_distinct(F.flatten(F.transform(known, lambda t: t["keys"])))
    rows = rows.withColumn("met", F.array_intersect("h", keys))
    # only where a band's shingle occurs: shingles as text, for the exact check
    rows = rows.withColumn("shingles", F.expr(f"if(size(met) > 0, {_shingled('words')}, cast(array() as array<string>))"))

    def meets(t: Column, key: Column, band: Column) -> Column:
        """Some window of the template's length has this band's value."""
        own, long = F.xxhash64(key, band), F.least(t["n"], F.size("h"))
        start = F.struct(F.lit(0).alias("run"), F.lit(False).alias("has"), F.lit(False).alias("met"))

        def step(s: Column, x: Column) -> Column:
            g = F.xxhash64(x, band)
            run, has = F.when(g < own, 0).otherwise(s["run"] + 1), F.when(g < own, False).otherwise(s["has"] | (g == own))
            return F.struct(run.alias("run"), has.alias("has"), (s["met"] | (has & (run >= long))).alias("met"))

        return F.aggregate("h", start, step, lambda s: s["met"])

    def retrieved(t: Column) -> Column:
        bands = F.sequence(F.lit(1), F.size(t["keys"]))
        return F.arrays_overlap("met", t["keys"]) & F.exists(bands, lambda b: F.array_contains(F.col("met"), F.element_at(t["keys"], b)) & meets(t, F.element_at(t["keys"], b), b))

    def contained(t: Column) -> Column:
        parts = F.split(t["words"], " ")
        own = F.transform(F.sequence(F.lit(1), F.size(parts) - (SHINGLE - 1)), lambda j: F.array_join(F.slice(parts, j, SHINGLE), " "))
        stretch = lambda i, some: F.array_contains(some, F.element_at("shingles", i)) & (F.size(F.array_intersect(F.slice("shingles", i, t["n"]), some)) >= t["least"])
        anywhere = lambda some: (F.size(some) >= t["least"]) & F.exists(F.sequence(F.lit(1), F.size("shingles")), lambda i: stretch(i, some))
        return F.exists(F.array(F.array_intersect("shingles", own)), anywhere)  # what the text has of the template, evaluated once

    found = F.transform(F.filter(known, lambda t: retrieved(t) & contained(t)), lambda t: t["id"])
    hits = F.when(F.size("met") > 0, F.array_sort(F.array_distinct(found))).otherwise(F.array().cast("array<string>"))
    out = rows.select("_row", hits.alias("licenses"))
    return out.select("_row.*", "licenses", F.size("licenses").cast("long").alias("n_licenses"))


def _bounded(templates: DataFrame) -> Column:
    """The indexed templates as one literal; its size is checked before anything is collected."""
    size = templates.agg(F.coalesce(F.sum(F.length("words")), F.lit(0)).alias("x")).first().x
    if size > TEMPLATE_CHARACTERS:
        raise ValueError(f"templates of {size} characters, more than {TEMPLATE_CHARACTERS}")
    text = templates.agg(F.to_json(F.sort_array(F.collect_list(F.struct("id", "words", "n", "least", "keys")))).alias("x")).first().x
    return F.from_json(F.lit(text or "[]"), TEMPLATE)


def _sql() -> str:
    values = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in TEMPLATES)
    split = rf"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{BREAK}'), lambda x: x <> '')"
    shingled = f"CASE WHEN len(w) < {SHINGLE} THEN [] ELSE list_transform(range(1, len(w) - {SHINGLE - 2}), lambda i: array_to_string(w[i:i + {SHINGLE - 1}], ' ')) END"
    return f"""
WITH t AS (SELECT id, {shingled} AS s FROM (SELECT id, {split} AS w FROM (VALUES {values}) v(id, text))),
k AS (SELECT id, len(s) AS n, len(list_distinct(s)) AS distinct_n, unnest(list_distinct(s)) AS s FROM t),
l AS (SELECT doc_id, {shingled} AS s FROM (SELECT doc_id, {split} AS w FROM documents)),
d AS (SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) AS i FROM l),
m AS (SELECT doc_id, id, n, distinct_n, i, k.s FROM d JOIN k ON d.s = k.s),
f AS (SELECT DISTINCT doc_id, id FROM (
      SELECT a.doc_id, a.id, a.i FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.id = b.id AND b.i BETWEEN a.i AND a.i + a.n - 1
      GROUP BY a.doc_id, a.id, a.i, a.distinct_n HAVING 100 * count(DISTINCT b.s) >= {PERCENT} * a.distinct_n))
SELECT l.doc_id, coalesce(string_agg(f.id, ',' ORDER BY f.id), '') AS licenses, CAST(count(f.id) AS BIGINT) AS n_licenses
FROM l LEFT JOIN f USING (doc_id) GROUP BY l.doc_id
"""


#: The same without retrieval, in DuckDB SQL over ``documents``: all templates against all documents.
SQL = _sql()
