"""License scans (operator 5): MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies.

DataFrame functions only.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Notices looked for, as published. Fixed values.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}
SHINGLE, CONTAINMENT = 5, 0.8


@dataclass(frozen=True)
class Bands:
    """How a window size is searched: every `stride` shingles a window, `bands` bands of one minimum each.

    A template of m shingles is searched in windows of m shingles. Some window begins at most half a stride
    from the template's best place, so the similarity of a text that holds 80 % of the shingles is at least
    0.8 (m - s/2) / (m + s/2 + 0.2 m), and bands of one row all miss with (1 - that)^bands.
    """

    window: int
    stride: int
    bands: int

    @classmethod
    def of(cls, m: int, miss: float = 1e-4) -> Bands:
        stride = max(1, m // 4)
        shift = 0 if stride == 1 else stride / 2
        j = 1.0 if m < 5 else CONTAINMENT * (m - shift) / (m + shift + 0.2 * m)  # under five shingles, 80 % are all
        bands = 1
        while (1 - j) ** bands > miss:
            bands += 1
        return cls(m, stride, bands)


def shingle_hashes(words: Column) -> Column:
    """60-bit hashes of all runs of SHINGLE words in order; shorter texts have none."""
    n = F.size(words) - (SHINGLE - 1)
    hashed = lambda i: F.shiftrightunsigned(F.xxhash64(*(F.element_at(words, i + k) for k in range(SHINGLE))), 4)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), hashed)).otherwise(F.array().cast("array<bigint>"))


def hashed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and h, the shingle hashes in text order.

    Each array passes through a generator of one row: the optimizer then neither evaluates it anew inside a lambda nor for
    every later use.
    """
    words = F.split(F.trim(F.regexp_replace(F.lower(docs[f"`{text_col}`"]), r"[^\p{L}\p{N}]+", " ")), " ")
    split = docs.where(docs[f"`{text_col}`"].isNotNull()).select(docs[f"`{id_col}`"].alias("doc_id"), F.explode(F.array(words)).alias("words"))
    return split.select("doc_id", F.explode(F.array(shingle_hashes(F.col("words")))).alias("h"))


def template_rows(spark: SparkSession, templates: dict[str, str], bands: int) -> list:
    """name, h (distinct shingle hashes) and band_minima (minimum, its shingle) of each template; a handful of rows by definition."""
    rows = hashed_texts(spark.createDataFrame(list(templates.items()), "name string, text string"), "name", "text")
    minima = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.array_min(F.transform("h", lambda x: F.struct(F.xxhash64(x, b).alias("low"), x.alias("of")))))
    return rows.select(F.col("doc_id").alias("name"), F.array_distinct("h").alias("h"), minima.alias("band_minima")).orderBy("name").collect()


def _collides(bands: Bands, minima: list) -> Callable[[Column], Column]:
    """Whether some band of the window from a start on has the template's minimum."""

    def low_of(window: Column, band: int) -> Column:
        return F.array_min(F.transform(window, lambda x: F.xxhash64(x, F.lit(band))))

    def collides(start: Column) -> Column:
        window = F.slice("h", start, bands.window)
        return reduce(or_, (low_of(window, b) == F.lit(low) for b, (low, _) in enumerate(minima)))

    return collides


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: dict[str, str] | None = None) -> DataFrame:
    """doc_id, license, containment (of the template's distinct shingles in the text), windows (that a band retrieved).

    Per text the shingles are hashed once. A band of a window collides with a template only at the template's own minimum, so windows
    of texts that contain none of the templates' band minima are not formed: no band of theirs could collide. For the
    others all overlapping windows and bands are evaluated, and each retrieved template is verified by exact containment.
    No shuffle; the templates are literals. Null and empty texts and those under five words match nothing; templates under five words
    are refused; repeated rows give repeated results.
    """
    templates = TEMPLATES if templates is None else templates
    most = max((Bands.of(m).bands for m in range(1, 1 + max((len(t.split()) * 2 for t in templates.values()), default=1))), default=1)
    table = template_rows(docs.sparkSession, templates, most)
    if short := [t["name"] for t in table if not t["h"]]:
        raise ValueError(f"templates under {SHINGLE} words: {short}")
    array = lambda values: F.array(*(F.lit(int(v)) for v in values)).cast("array<bigint>")
    plans = []
    for t in table:
        bands = Bands.of(len(t["h"]))
        plans.append((t["name"], bands, list(t["h"]), [(r["low"], r["of"]) for r in t["band_minima"][: bands.bands]]))
    anchors = sorted({of for *_, minima in plans for _, of in minima})
    texts = hashed_texts(docs, id_col, text_col)
    n = F.size("h")
    found = texts.where(F.arrays_overlap("h", array(anchors))) if anchors else texts.where("false")
    entries = []
    for name, bands, hashes, minima in plans:
        windows = F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1)), F.lit(bands.stride)), _collides(bands, minima)))
        retrieved = F.when(F.arrays_overlap("h", array({of for _, of in minima})), windows).otherwise(0)
        inside = F.size(F.array_intersect("h", array(hashes))) / F.lit(float(len(hashes)))
        entries.append(F.struct(F.lit(name).alias("license"), inside.alias("containment"), retrieved.cast("long").alias("windows")))
    if not entries:
        return texts.where("false").select("doc_id", F.lit("").alias("license"), F.lit(0.0).alias("containment"), F.lit(0).cast("long").alias("windows"))
    return found.select("doc_id", F.explode(F.array(*entries)).alias("e")).select("doc_id", "e.*").where(f"windows > 0 and containment >= {CONTAINMENT}")


def oracle(templates: dict[str, str] | None = None) -> str:
    """Exact containment in SQL over all texts, for a table `documents`."""
    values = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in (TEMPLATES if templates is None else templates).items())
    words = r"list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '')"
    runs = "list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))"
    return f"""
WITH t AS (SELECT license, unnest({runs}) AS s FROM (SELECT license, {words} AS w FROM (VALUES {values}) v(license, text))),
m AS (SELECT license, count(*) AS m FROM t GROUP BY 1),
d AS (SELECT doc_id, unnest({runs}) AS s FROM (SELECT doc_id, {words} AS w FROM documents WHERE text IS NOT NULL))
SELECT doc_id, license, count(*) / any_value(m)::DOUBLE AS containment FROM d JOIN t USING (s) JOIN m USING (license) GROUP BY 1, 2
HAVING count(*) / any_value(m)::DOUBLE >= {CONTAINMENT}
"""
