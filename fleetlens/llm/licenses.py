"""License scans: TF-IDF cosines of text segments to templates, then inheritance along paths.

Inverse document frequencies of all words are counted over all documents. Those of the templates'
words, a fixed list, are known to every task; a segment that could be near enough to a template,
whatever its other words weigh, then meets the frequencies of these in a join.
Segments of a document are its lines, its paragraphs (lines between blank ones) and the whole
text. A document that is a notice or a license text as a whole is a license file and speaks for its
folder; a document without a license of its own takes that of the nearest folder above it that has one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from importlib import resources

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.sources.scratch import materialize

#: A segment with this cosine or more carries the license.
SIMILARITY = 0.6
WORDS = re.compile(r"[a-z0-9]+(?:[.\-][0-9a-z]+)*")

#: Public notices of common licenses, several for one license where usual.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License. See LICENSE file in the project root for full license information.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files, to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software.",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0. "
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation; either version 2 of the License, "
        "or (at your option) any later version.",
    ],
    "LGPL-2.1": [
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "Lesser General Public License as published by the Free Software Foundation.",
    ],
    "BSD-3-Clause": [
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Released under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}

#: Whole license texts, which a whole document is held against beside the notices.
FULL_TEXTS = {
    name: resources.files("fleetlens.llm").joinpath("license_texts", f"{name}.txt").read_text("utf-8")
    for name in (
        "MIT", "Apache-2.0", "GPL-3.0", "GPL-2.0", "LGPL-2.1", "BSD-3-Clause", "MPL-2.0", "ISC", "CC0-1.0", "Unlicense",
    )
}

VOCABULARY = sorted({w for texts in [*TEMPLATES.values(), FULL_TEXTS.values()] for t in texts for w in WORDS.findall(t.lower())})
#: Different words a task counts before it passes them on.
HELD = 1 << 17


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[DataFrame, dict[str, int], int]:
    """(word, n), in how many documents each word is; that of the vocabulary; number of documents."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"]
            )

        for batch in batches:
            for text in batch.column(0).to_pylist():
                found[""] += 1
                found.update(set(WORDS.findall((text or "").lower())))
                if len(found) > HELD:
                    yield rows()
                    found.clear()
        yield rows()

    sums = docs.select(F.col(f"`{text_col}`")).mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = materialize(sums, "words")
    # One row for each word of the vocabulary and one for all documents.
    known = words.join(F.broadcast(docs.sparkSession.createDataFrame([(w,) for w in ["", *VOCABULARY]], "word string")), "word")
    counts = {r["word"]: r["n"] for r in known.collect()}
    n = counts.pop("", 0)
    return words, counts, n


class Matcher:
    """Segments that can be near enough to a template, with all that the templates say of them."""

    def __init__(self, frequencies: dict[str, int], n: int, similarity: float) -> None:
        self.similarity = similarity
        self.idf = {w: math.log((1 + n) / (1 + frequencies.get(w, 0))) + 1 for w in VOCABULARY}
        notices = [(name, text) for name, texts in TEMPLATES.items() for text in texts]
        self.notices, self.all = self.weighed(notices), self.weighed([*notices, *FULL_TEXTS.items()])

    def weighed(self, templates: list[tuple[str, str]]) -> tuple[list[str], dict[str, list[tuple[int, float]]], dict[str, float]]:
        """Names of templates, (template, share of its norm) of each word, the largest of these."""
        by_word: dict[str, list[tuple[int, float]]] = {}
        for i, (_, text) in enumerate(templates):
            weights = {w: c * self.idf[w] for w, c in Counter(WORDS.findall(text.lower())).items()}
            norm = math.sqrt(sum(x * x for x in weights.values()))
            for w, x in weights.items():
                by_word.setdefault(w, []).append((i, x / norm))
        return [name for name, _ in templates], by_word, {w: max(x for _, x in own) for w, own in by_word.items()}

    def near(self, counts: Counter, whole: bool = False) -> tuple[str, float, float, str] | None:
        """(license, product, square of the known words' norm, other words with their counts).

        The license is that of the nearest template, ties by name; full texts are templates of
        whole texts alone. None if even with other words of the least weight, 1, no template is
        near enough.
        """
        names, by_word, most = self.all if whole else self.notices
        inside = peak = 0.0
        outside = 0
        for w, c in counts.items():
            idf = self.idf.get(w)
            if idf is None:
                outside += c * c
            else:
                inside += (c * idf) ** 2
                peak += c * idf * most.get(w, 0.0)
        least = self.similarity * math.sqrt(inside + outside) * (1 - 1e-9)
        if not inside or peak < least:
            return None
        dots = [0.0] * len(names)
        for w, c in counts.items():
            for i, x in by_word.get(w, ()):
                dots[i] += c * self.idf[w] * x
        top = min((-d, names[i]) for i, d in enumerate(dots))
        if -top[0] < least:
            return None
        others = " ".join(f"{w}:{c}" for w, c in sorted(counts.items()) if w not in self.idf)
        return top[1], -top[0], inside, others

    def scan(self, text: str) -> list[tuple[bool, str, float, float, str]]:
        """(whole text?, and what `near` says) of each different segment that can be near enough."""
        whole: Counter = Counter()
        block: Counter = Counter()
        found: set[tuple[bool, str, float, float, str]] = set()
        lines = 0
        for line in [*text.lower().split("\n"), ""]:
            words = WORDS.findall(line)
            if words:
                counts = Counter(words)
                if hit := self.near(counts):
                    found.add((False, *hit))
                block.update(counts)
                lines += 1
            elif lines:
                if lines > 1 and (hit := self.near(block)):
                    found.add((False, *hit))
                whole.update(block)
                block, lines = Counter(), 0
        if hit := self.near(whole, True):
            found.add((True, *hit))
        return sorted(found)


_SEGMENT = pa.struct([("whole", pa.bool_()), ("license", pa.string()), ("dot", pa.float64()), ("inside", pa.float64()), ("others", pa.string())])


def nearest(scanned: DataFrame, words: DataFrame, n: int, similarity: float) -> DataFrame:
    """(_row, license, similarity, whole) of each row of `scanned` (_row, found) that has a license.

    A whole text goes before its parts; then the highest cosine, then the first license.
    """
    segments = scanned.select("_row", F.explode("found").alias("_segment")).select("_row", "_segment.*")
    # Each different list of other words once. Written, so that a word or list of many rows can be split.
    lists = materialize(
        segments.where("others <> ''").select("others").distinct()
        .withColumn("_word", F.explode(F.split("others", " ")))
        .select("others", F.split("_word", ":")[0].alias("word"), F.split("_word", ":")[1].cast("long").alias("_c")),
        "lists",
    )
    idf = F.log(F.lit(1.0 + n) / (1 + F.col("n"))) + 1
    norms = materialize(
        lists.join(words, "word").groupBy("others").agg(F.sum(F.pow(F.col("_c") * idf, F.lit(2.0))).alias("outside")), "norms"
    )
    cosine = F.col("dot") / F.sqrt(F.col("inside") + F.coalesce("outside", F.lit(0.0)))
    near = segments.join(norms, "others", "left").withColumn("similarity", cosine).where(F.col("similarity") >= similarity)
    order = F.struct(~F.col("whole"), -F.col("similarity"), F.col("license"))
    return near.groupBy("_row").agg(F.min_by(F.struct("license", F.least("similarity", F.lit(1.0)).alias("similarity"), "whole"), order).alias("_best")).select("_row", "_best.*")


def scan_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, path, license, similarity, origin, folder) of every document.

    `path` names the column that holds a document's path; its folders are what stands before each
    slash. origin is `file` (the whole text is a license), `header` (a part of it is), `inherited`
    (from `folder`, the nearest with a license file; of several files there the one of highest
    cosine, then the first by license) or null. A null or empty text has no license of its own, a
    null path nothing to inherit. Repeated rows are scanned each; an empty table gives no rows.
    """
    own = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{path}`").cast("string").alias("path"),
        F.col(f"`{text_col}`").alias("text"),
    )
    words, frequencies, n = document_frequencies(own, "text")

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(frequencies, n, similarity)
        names = _SEGMENT.names
        for batch in batches:
            found = [[dict(zip(names, s, strict=True)) for s in matcher.scan(t)] if t else [] for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found, pa.list_(_SEGMENT))], names=["doc_id", "path", "found"]
            )

    kind = own.schema["doc_id"].dataType.simpleString()
    segment = "array<struct<whole:boolean,license:string,dot:double,inside:double,others:string>>"
    # Written, so that the rows' numbers stay as they are.
    rows = materialize(
        own.mapInArrow(scanned, f"doc_id {kind}, path string, found {segment}").withColumn("_row", F.monotonically_increasing_id()),
        "segments",
    )
    origin = F.when(F.col("whole"), "file").when(~F.col("whole"), "header").alias("origin")
    found = rows.join(nearest(rows, words, n, similarity), "_row", "left")
    return inherit(materialize(found.select("doc_id", "path", "license", "similarity", origin), "licenses"))


def inherit(found: DataFrame) -> DataFrame:
    """`found` (doc_id, path, license, similarity, origin) with inherited licenses and their folder."""
    parent = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit(""))
    placed = found.withColumn("_parent", F.when(F.col("path").isNotNull(), parent))
    nearest = Window.partitionBy("folder").orderBy(F.desc("similarity"), "license")
    spoken = (
        placed.where("origin = 'file' and _parent is not null")
        .groupBy(F.col("_parent").alias("folder"), "license")
        .agg(F.max("similarity").alias("similarity"))
        .withColumn("_rank", F.row_number().over(nearest))
        .where("_rank = 1")
        .select("folder", F.col("license").alias("_license"), F.col("similarity").alias("_similarity"))
    )
    # Every folder looks at itself and all above it, once, however many documents it holds.
    parts = F.split("_parent", "/")
    above = F.transform(
        F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/")
    )
    folders = placed.where("license is null and _parent is not null").select("_parent").distinct()
    # Written, so that documents of one folder can be split over tasks in the last join.
    heirs = materialize(
        folders.withColumn("folder", F.explode(F.array_distinct(above)))
        .join(spoken, "folder")
        .groupBy("_parent")
        .agg(F.max_by(F.struct("folder", "_license", "_similarity"), F.length("folder")).alias("_from")),
        "heirs",
    )
    taken = F.col("license").isNull() & F.col("_from").isNotNull()
    return placed.join(heirs, "_parent", "left").select(
        "doc_id",
        "path",
        F.when(taken, F.col("_from._license")).otherwise(F.col("license")).alias("license"),
        F.when(taken, F.col("_from._similarity")).otherwise(F.col("similarity")).alias("similarity"),
        F.when(taken, F.lit("inherited")).otherwise(F.col("origin")).alias("origin"),
        F.when(taken, F.col("_from.folder")).alias("folder"),
    )
