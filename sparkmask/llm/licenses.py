"""License scans: sparse TF-IDF cosine of headers and licence files to templates, then directory inheritance.

Terms weigh 1 + ln((1 + D) / (1 + df)), with df counted over all D documents for every term of a template
(other terms have df 0); function words weigh nothing. Each line of a text that shares a term with a template,
and each run of such lines, is compared with every template by the cosine of their weighted term counts; the
best template at `least` or more is the text's own licence. Vectors are sparse: a line meets only templates that
share a term with it, through an inverted index. A text whose licence lines make up `file_share` of its words
is a licence file.

A licence file speaks for its directory: a document without a licence of its own inherits that of the nearest
ancestor directory that has a licence file. Ancestors are the directory's path prefixes, joined with the
directories of licence files; that join runs over distinct directories, so a directory with a third of all
documents is one row of it.

Defined cases: a null text has no licence; a null path has no directory and inherits nothing; of equal
cosines the first licence in alphabetical order wins; of several licence files in a directory the most
similar one speaks, of equals the first in alphabetical order; repeated rows are each returned; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, bounded, table

TERM = re.compile(r"[a-z0-9]+(?:[.][0-9]+)*")
FUNCTION_WORDS = frozenset("a an and any are as at be by for from have if in is it its not of on or shall that the their this to was were which will with you your".split())

#: Header and grant sentences of common licences, as their texts publish them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Licensed under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-2.0", "This program is licensed under the GNU General Public License, version 2"),
    ("GPL-2.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: redistributions of source code must retain the above copyright notice"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("All-Rights-Reserved", "All rights reserved"),
]


def terms(text: str) -> list[str]:
    return [t for t in TERM.findall(text) if t not in FUNCTION_WORDS]


def frequencies(vocabulary: frozenset[str]):
    """text -> (term, n): in how many of a task's documents each vocabulary term is; '' counts documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            counts[""] += batch.num_rows
            for text in batch.column("text").to_pylist():
                if text:
                    counts.update(vocabulary.intersection(TERM.findall(text.lower())))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    return run


class Scanner:
    def __init__(self, templates: list[tuple[str, str]], df: dict[str, int], n: int, least: float):
        self.least = least
        self.rare = 1 + math.log(1 + n)
        self.idf = {t: 1 + math.log((1 + n) / (1 + df.get(t, 0))) for _, text in templates for t in terms(text.lower())}
        self.names = [name for name, _ in templates]
        self.index: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for i, (_, text) in enumerate(templates):
            vector = {t: c * self.idf[t] for t, c in Counter(terms(text.lower())).items()}
            norm = math.sqrt(sum(w * w for w in vector.values()))
            for t, w in vector.items():
                self.index[t].append((i, w / norm))
        self.vocabulary = frozenset(self.index)

    def best(self, words: list[str]) -> tuple[float, str]:
        """(cosine, licence) of the template nearest to a list of terms."""
        dots: dict[int, float] = defaultdict(float)
        norm = 0.0
        for t, c in Counter(words).items():
            w = c * self.idf.get(t, self.rare)
            norm += w * w
            for i, x in self.index.get(t, ()):
                dots[i] += w * x
        top = max(((d, i) for i, d in dots.items()), key=lambda x: (round(x[0], 9), -x[1]), default=None)
        if top is None:
            return 0.0, ""
        value = top[0] / math.sqrt(norm)
        names = [self.names[i] for i, d in dots.items() if abs(d - top[0]) < 1e-9]
        return min(1.0, value), min(names)

    def scan(self, text: str | None) -> tuple[str | None, float, float]:
        """(licence or None, cosine, share of the words in licence lines)."""
        low = (text or "").lower()
        if not low or self.vocabulary.isdisjoint(TERM.findall(low)):
            return None, 0.0, 0.0
        best, total, held = (0.0, ""), 0, 0
        run: list[str] = []
        lines_in_run = 0

        def look(words: list[str], size: int) -> None:
            nonlocal best, held
            found = self.best(words)
            if found[0] >= self.least:
                held += size
            if found[0] >= self.least and (found[0] > best[0] + 1e-9 or (abs(found[0] - best[0]) <= 1e-9 and found[1] < best[1])):
                best = found

        for line in [*low.split("\n"), ""]:
            words = terms(line)
            total += len(words)
            if not self.vocabulary.isdisjoint(words):
                look(words, len(words))
                run += words
                lines_in_run += 1
                continue
            if lines_in_run > 1:
                before = held
                look(run, 0)
                held = before
            run, lines_in_run = [], 0
        return (best[1], best[0], held / total) if best[1] else (None, 0.0, 0.0)


def scanned(scanner: Scanner):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scanner.scan(t) for t in batch.column("text").to_pylist()]
            name, value, share = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("path"), pa.array(name, pa.string()), pa.array(value, pa.float64()), pa.array(share, pa.float64())], ["doc_id", "path", "own", "similarity", "share"])

    return run


def directory(path: str):
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def license_scan(files: DataFrame, least: float = 0.7, file_share: float = 0.5, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, path, license, similarity, evidence (own, directory or none) and license_directory of files (doc_id, path, text, ...)."""
    scratch = Scratch(files.sparkSession, "licenses")
    templates = templates or TEMPLATES
    vocabulary = frozenset(t for _, text in templates for t in terms(text.lower()))
    files = files.select("doc_id", F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    df = {r["term"]: r["n"] for r in files.select("text").mapInArrow(frequencies(vocabulary), "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}  # the templates' terms
    scanner = Scanner(templates, df, df.pop("", 0), least)
    own = scratch.write(files.select("doc_id", "path", "text").mapInArrow(scanned(scanner), f"doc_id {dict(files.dtypes)['doc_id']}, path string, own string, similarity double, share double").withColumn("dir", directory("path")), "own")
    spoken = own.where((F.col("share") >= file_share) & F.col("dir").isNotNull()).groupBy("dir").agg(F.min(F.struct((-F.round("similarity", 9)).alias("s"), "own")).alias("m")).select(F.col("dir").alias("license_directory"), F.col("m.own").alias("inherited"))
    dirs = own.where(F.col("own").isNull() & F.col("dir").isNotNull()).select("dir").distinct()
    steps = dirs.withColumn("parts", F.split("dir", "/")).select("dir", F.explode(F.expr("transform(sequence(0, size(parts)), i -> array_join(slice(parts, 1, i), '/'))")).alias("license_directory"))
    near = steps.join(bounded(spoken, 100_000), "license_directory").groupBy("dir").agg(F.max_by(F.struct("license_directory", "inherited"), F.length("license_directory")).alias("x")).select(F.col("dir").alias("_dir"), "x.*")
    out = own.join(bounded(near, 100_000), (F.col("dir") == F.col("_dir")) & F.col("own").isNull(), "left")
    evidence = F.when(F.col("own").isNotNull(), "own").when(F.col("inherited").isNotNull(), "directory").otherwise("none")
    return out.select("doc_id", "path", F.coalesce("own", "inherited").alias("license"), "similarity", "share", evidence.alias("evidence"), "license_directory")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: source/lang is the directory, the doc_id the file's name."""
    d = table(spark, sf_dir, "documents")
    return license_scan(d.select("doc_id", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), "text"))
