"""License scans by a positional rare-token index.

The index has postings (template, position) for the rarest words of each licence template, by inverse document frequency over all files: one more
position than a match can have wrong, so that any match has one of them right. A file's words are looked up there; where one stands, its postings
say where templates would start. Such a start must have AGREE of the template's further rare words at their relative positions; then the
template is compared word by word and its key phrases are required within it. No match is missed, however many licences a file has, and
what a file costs follows its licence words, not the number of templates.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .words import words

# Phrases whose every place counts, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

# Label, opening or notice of a licence, and phrases that must stand in a match.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction", ["permission is hereby granted free of charge", "deal in the software without restriction"]),
    ("mit", "Released under the MIT License.", ["the mit license"]),
    ("mit", "Licensed under the MIT License. See the LICENSE file for details.", ["the mit license"]),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", ["apache license version 2"]),
    ("apache-2", "Licensed under the Apache License, Version 2.0.", ["apache license version 2"]),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ["gnu general public license", "version 3"]),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3.", ["gnu general public license", "version 3"]),
    ("gpl-2", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", ["gnu general public license", "version 2"]),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", ["gnu lesser general public license"]),
    ("agpl-3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", ["gnu affero general public license"]),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", ["mozilla public license"]),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ["for any purpose with or without fee is hereby granted"]),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0.", ["cc by nc"]),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ["creative commons attribution noncommercial"]),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License.", ["creative commons attribution 4"]),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["creative commons attribution sharealike"]),
]

#: Rare positions of a template that agree on a start in any match, where it has so many; the least share of a template's words at their
#: places.
AGREE, LEAST = 3, 0.7


@dataclass
class Template:
    label: str
    text: list[bytes]
    keys: list[bytes]
    rarest: list[tuple[int, bytes]]  # positions and words
    agree: int  # of the rarest, in any match


@dataclass
class Index:
    phrases: list[tuple[bytes, str]]
    templates: list[Template]
    postings: dict[bytes, list[tuple[int, int]]]  # by word: templates' numbers and positions


def spaced(text: str) -> bytes:
    return b" " + b" ".join(words(text)) + b" "


def build(phrases: dict[str, str], templates: list, frequency: dict[bytes, int], files: int) -> Index:
    made: list[Template] = []
    postings: dict[bytes, list[tuple[int, int]]] = {}
    for label, text, keys in templates:
        own = words(text)
        idf = [math.log((files + 1) / (frequency.get(w, 0) + 1)) for w in own]
        astray = len(own) - next((n for n in range(len(own) + 1) if own and n / len(own) >= LEAST), 0)
        order = sorted(range(len(own)), key=lambda p: (-idf[p], own[p], p))[: astray + AGREE]
        for p in order[: astray + 1]:
            postings.setdefault(own[p], []).append((len(made), p))
        made.append(Template(label, own, [spaced(k) for k in keys], [(p, own[p]) for p in order], len(order) - astray))
    return Index([(spaced(p), label) for p, label in phrases.items()], made, postings)


def template_matches(index: Index, own: list[bytes]) -> dict[str, float]:
    """Labels with the largest share of a template's words found at their places."""
    starts = {(t, at - p) for at, w in enumerate(own) if w in index.postings for t, p in index.postings[w]}
    out: dict[str, float] = {}
    for k, start in starts:
        t = index.templates[k]
        if sum(0 <= start + p < len(own) and own[start + p] == w for p, w in t.rarest) < t.agree:
            continue
        low, high = max(0, start), min(len(own), start + len(t.text))
        same = sum(a == b for a, b in zip(own[low:high], t.text[low - start :])) / len(t.text)
        if same >= LEAST and same > out.get(t.label, 0):
            window = b" " + b" ".join(own[low:high]) + b" "
            if all(k in window for k in t.keys):
                out[t.label] = same
    return out


def scan(index: Index, text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base labels, labels, score."""
    own = words(text)
    flat = b" " + b" ".join(own) + b" "
    found, labels = [], set()
    for phrase, label in index.phrases:
        at = flat.find(phrase)
        while at >= 0:
            found.append(at)
            labels.add(label)
            at = flat.find(phrase, at + 1)
    # A place's word number is the number of gaps before it.
    at_words = [flat.count(b" ", 0, at) for at in (min(found), max(found))] if found else [None, None]
    more = template_matches(index, own)
    score = 1.0 if labels else max(more.values(), default=0.0)
    return len(own), len(found), *at_words, sorted(labels), sorted(labels | more.keys()), round(score, 6)


def word_frequencies(df: DataFrame, vocabulary: set[bytes], text: str = "text") -> tuple[dict[bytes, int], int]:
    """In how many rows each word stands, and the number of rows: over all rows, summed where they are read."""
    common.ship(df.sparkSession)
    common.bound_batches(df.sparkSession)
    schema = T.StructType([T.StructField("word", T.BinaryType()), T.StructField("n", T.LongType())])

    def run(batches):
        counts: dict[bytes, int] = dict.fromkeys(vocabulary, 0)
        rows = 0
        for batch in batches:
            for part in common.slices(batch, ["text"]):
                for t in part.column("text").to_pylist():
                    rows += 1
                    for w in vocabulary.intersection(words(t)):
                        counts[w] += 1
        keys = [None, *counts]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([rows, *counts.values()], pa.int64())], names=["word", "n"])

    sums = df.select(F.col(text).alias("text")).mapInArrow(run, schema).groupBy("word").agg(F.sum("n").alias("n")).collect()  # one row a word
    got = {None if r["word"] is None else bytes(r["word"]): r["n"] for r in sums}
    return {w: n for w, n in got.items() if w is not None}, got.get(None, 0)


def find_licenses(df: DataFrame, text: str = "text", phrases: dict[str, str] = PHRASES, templates: list = TEMPLATES) -> DataFrame:
    """df with n_words, n_base, first_word, last_word, base_label_list, label_list and score.

    Base: every place where a phrase's words stand one after another. label_list has the labels of templates too; score
    is 1 with a base label, else the largest share of a template's words. Null texts count as empty: no words, no labels, score 0; an empty
    table gives an empty one. Whole texts are read, twice (once for the word frequencies over all rows). Rows are kept as they come;
    columns of df with the name of a new one are replaced.
    """
    vocabulary = {w for _, t, _ in templates for w in words(t)}
    index = build(phrases, templates, *word_frequencies(df, vocabulary, text))
    shared = df.sparkSession.sparkContext.broadcast(index)  # as large as the templates
    texts = T.ArrayType(T.StringType())
    added = [("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()), ("base_label_list", texts), ("label_list", texts), ("score", T.DoubleType())]
    (source,) = common.fresh(df, "_license_text")
    rows = df.withColumn(source, df[text]).drop(*(c for c in df.columns if c.lower() in {n for n, _ in added}))

    def make():
        def work(columns):
            return [list(c) for c in zip(*map(scan, repeat(shared.value), columns[0]))] if columns[0] else [[] for _ in added]

        return work

    return common.map_rows(rows, [source], added, make).drop(source)
