"""License scan: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

Everything happens inside the row of a document, in built-in functions. A text can hold a template only if it has
one of the template's marker words: words so chosen that more than a fifth of the template's shingles have one, so
that no text without any of them reaches a containment of 0.8. Texts without a marker word are done.

Windows have 4, 16 or 64 shingles and overlap by half; a template is looked for in the smallest size that holds
it, longer ones window by window. With 24 bands of one MinHash, a text that holds at least 0.8 of a template's shingles
has, for every template in use, a window whose similarity to it is at least 0.2, so retrieval succeeds with a
probability of at least 1 - 0.8**24 = 0.995 per window, and far more for templates of several windows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from groundwork.functions.text import bind

SHINGLE = 5
LEAST = 0.8
SIZES = (4, 16, 64)
BANDS = 24


class Template(NamedTuple):
    name: str
    text: str


# Publicly known license notices. Fixed values.
TEMPLATES = (
    Template("MIT", "Released under the MIT License."),
    Template("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    Template("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    Template("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    Template("MIT-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
             "and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
             "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
             "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    Template("Apache-2.0-header", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this "
             "file except in compliance with the License. You may obtain a copy of the License at"),
    Template("BSD-conditions", "Redistribution and use in source and binary forms, with or without modification, are "
             "permitted provided that the following conditions are met"),
    Template("GPL-notice", "This program is free software: you can redistribute it and/or modify it under the terms of "
             "the GNU General Public License as published by the Free Software Foundation"),
    Template("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International "
             "License."),
)


def plain_words(text: str) -> list[str]:
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))


def plain_shingles(text: str) -> list[str]:
    """Distinct shingles of a template, in order; fewer words are one shingle."""
    words = plain_words(text)
    size = min(SHINGLE, len(words))
    return list(dict.fromkeys(" ".join(words[k : k + size]) for k in range(len(words) - size + 1 if size else 0)))


def marker_words(template: Template) -> set[str]:
    """Words of which every text that holds ``LEAST`` of the template's shingles has one; the longest first."""
    left, chosen, all_shingles = plain_shingles(template.text), set(), plain_shingles(template.text)
    while len(all_shingles) - len(left) <= (1 - LEAST) * len(all_shingles) + 1e-9 and left:
        shares = Counter(w for s in left for w in set(s.split()))
        word = max(shares, key=lambda w: (len(w) * math.sqrt(shares[w]), w))
        chosen.add(word)
        left = [s for s in left if word not in s.split()]
    return chosen


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


MASKS = [_signed(xxhash.xxh64_intdigest(str(k))) for k in range(BANDS)]


def window_size(shingles: int) -> int:
    return next((s for s in SIZES if shingles <= s), SIZES[-1])


def words_of(text: Column) -> Column:
    folded = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # Everything beyond ASCII belongs to words.
    return F.filter(F.split(folded, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def shingles_of(words: Column) -> Column:
    count = F.size(words)
    each = F.transform(F.sequence(F.lit(1), F.greatest(count - (SHINGLE - 1), F.lit(1))),
                       lambda i: F.array_join(F.slice(words, i, F.lit(SHINGLE)), " "))
    return F.when(count == 0, F.array().cast("array<string>")).otherwise(each)


def _window_keys(hashes: Column, size: int) -> Column:
    """Keys (size, band, MinHash) of the windows of that many shingles, overlapping by half."""
    half = size // 2

    def of_band(mask: Column, band: Column) -> Column:
        blocks = F.sequence(F.lit(0), F.ceil(F.size(hashes) / half).cast("int") - 1)
        lows = F.transform(blocks, lambda b: F.array_min(F.transform(
            F.slice(hashes, b * half + 1, F.lit(half)), lambda h: h.bitwiseXOR(mask))))
        return bind(lows, lambda low: F.transform(
            low, lambda x, k: F.xxhash64(F.lit(size), band, F.least(x, F.get(low, k + 1)))))

    masks = F.array(*[F.lit(m) for m in MASKS])
    return F.array_distinct(F.flatten(F.transform(masks, of_band)))


def _keys(hashes: Column) -> Column:
    return F.when(F.size(hashes) == 0, F.array().cast("array<bigint>")).otherwise(
        F.array_union(F.array_union(*[_window_keys(hashes, s) for s in SIZES[:2]]), _window_keys(hashes, SIZES[2])))


def prepared(docs: DataFrame, templates: tuple[Template, ...]) -> DataFrame:
    """(name, keys, shingles) of each template, computed by the same expressions as those of the documents."""
    rows = [(t.name, plain_shingles(t.text), window_size(len(plain_shingles(t.text)))) for t in templates]
    table = docs.sparkSession.createDataFrame(rows, "name string, shingles array<string>, size int")
    hashes = F.transform("shingles", lambda s: F.xxhash64(s))
    keys = F.when(F.col("size") == SIZES[0], _window_keys(F.col("h"), SIZES[0])).when(
        F.col("size") == SIZES[1], _window_keys(F.col("h"), SIZES[1])).otherwise(_window_keys(F.col("h"), SIZES[2]))
    return table.withColumn("h", hashes).select("name", "shingles", keys.alias("keys"))


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def find_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """One row per row of ``docs``: id, n_licenses, licenses (names of the templates found, sorted, by commas).

    A template is found where the text holds at least 0.8 of its different five-word shingles; A-Z count as a-z and
    punctuation as a space. Null and empty texts hold none, nor does a template without words match. Repeated rows
    are judged each. The templates are a parameter of a few kilobytes, not a table.
    """
    templates = tuple(t for t in templates if plain_words(t.text))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("body"))
    none = F.array().cast("array<string>")
    if not templates:
        found = none
    else:
        known = sorted(prepared(docs, templates).collect(), key=lambda r: r["name"])
        markers = sorted({w for t in templates for w in marker_words(t)})
        worth = F.col("body").rlike("(?i)" + "|".join(re.escape(w) for w in markers))

        def named(shingles: Column, keys: Column) -> Column:
            hits = [F.when(F.arrays_overlap(keys, F.array(*[F.lit(k) for k in r["keys"]]))
                           & (F.size(F.array_intersect(shingles, _strings(r["shingles"])))
                              >= LEAST * len(r["shingles"]) - 1e-9), r["name"]) for r in known]
            return F.filter(F.array(*hits), lambda name: name.isNotNull())

        def judged(words: Column) -> Column:
            # Each array is bound, so that it is computed once and not for every element of the next.
            return bind(shingles_of(words), lambda shingles: bind(
                F.transform(shingles, lambda s: F.xxhash64(s)), lambda hashes: bind(
                    _keys(hashes), lambda keys: named(shingles, keys))))

        found = F.when(worth, bind(words_of(F.col("body")), judged)).otherwise(none)
    return rows.select(F.col("id").alias(id_col), found.alias("names")).select(
        id_col, F.size("names").cast("long").alias("n_licenses"), F.array_join("names", ",").alias("licenses"))
