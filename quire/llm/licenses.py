"""License scans by diagonal voting.

Every rolling k-gram hash of a document's words is joined with the positions of the
license templates that carry the same k-gram.  A hit at word p of the document and
word q of template t votes for the diagonal p - q; votes are aggregated per document,
template and band of diagonals, so copied text piles up on one diagonal and small
insertions on neighbouring ones, which are merged.  Each merged span is verified: its
votes must carry enough of the template's words.

The template side is a fixed table of a few thousand rows (its size is bound by the
template list, not by the data), so it is broadcast and documents aren't shuffled by
k-gram; only hits are shuffled, by document.

Null and empty texts have no words and no labels.  Repeated rows with one doc_id are
scanned each by itself.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import map_batches
from quire.llm.text import ALNUM, LOWER, buffers, gram_hashes, prefix_hashes, span_hashes, words

#: Phrases whose exact occurrences are the base.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Passages that mark a license, each matched as a whole; (label, text).
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "Released under the MIT License."),
    ("mit", "This project is licensed under the terms of the MIT license."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _tokens(text: str) -> np.ndarray:
    body, offsets = buffers(pa.array([text]))
    body = LOWER[body]
    starts, ends, _ = words(body, offsets, ALNUM)
    return span_hashes(prefix_hashes(body), starts, ends)


def templates(k: int, passages: tuple[tuple[str, str], ...] = TEMPLATES) -> list[tuple[int, int, int, int, str]]:
    """(gram, template, position, number of grams, label) of each template position."""
    out = []
    for t, (label, text) in enumerate(passages):
        grams = gram_hashes(_tokens(text), k).view(np.int64)
        out += [(int(g), t, p, len(grams), label) for p, g in enumerate(grams)]
    return out


SCANNED = "uid long, doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, grams array<long>"


def scan_words(docs: DataFrame, k: int, phrases: tuple[tuple[str, str], ...] = PHRASES) -> DataFrame:
    """Per document: word count, base places and the hash of every k-gram in order."""
    wanted = [(_tokens(p), label) for p, label in phrases]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        body, offsets = buffers(batch.column(2))
        body, n = LOWER[body], batch.num_rows
        starts, ends, rows = words(body, offsets, ALNUM)
        tokens = span_hashes(prefix_hashes(body), starts, ends)
        counts = np.bincount(rows, minlength=n)
        first = np.cumsum(counts) - counts
        places, labels = [], [set() for _ in range(n)]
        for phrase, label in wanted:
            m = max(len(tokens) - len(phrase) + 1, 0)
            hit = rows[:m] == rows[len(phrase) - 1 : len(phrase) - 1 + m]
            for j, h in enumerate(phrase):
                hit = hit & (tokens[j : j + m] == h)
            hit = np.flatnonzero(hit)
            places.append(hit)
            for r in np.unique(rows[hit]).tolist():
                labels[r].add(label)
        places = np.concatenate(places) if places else np.zeros(0, np.int64)
        owner, local = rows[places], places - first[rows[places]]
        low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        np.minimum.at(low, owner, local)
        np.maximum.at(high, owner, local)
        none = high < 0
        grams = gram_hashes(tokens, k)
        whole = rows[: len(grams)] == rows[len(rows) - len(grams) :]
        ends_ = np.concatenate([[0], np.cumsum(np.maximum(counts - k + 1, 0))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends_), pa.array(grams[whole].view(np.int64)))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1).cast(pa.int64()), pa.array(counts.astype(np.int64)), pa.array(np.bincount(owner, minlength=n).astype(np.int64)), pa.array(low, mask=none), pa.array(high.astype(np.int64), mask=none), pa.array([sorted(x) for x in labels], pa.list_(pa.string())), lists],
            names=["uid", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "grams"],
        )

    return map_batches(docs, run, SCANNED)


def scan_licenses(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = 3, band: int = 8, cover: float = 0.7, phrases: tuple[tuple[str, str], ...] = PHRASES, passages: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    """One row per document: word count, base places, labels and a score from 0 to 1.

    `k`: words of a gram; `band`: diagonals that are merged; `cover`: least share of a
    template's words that the grams of a verified span carry.  `spans` has the verified spans as
    (label, first word, last word, share).  The score is the largest verified share, 1
    with a base place, else 0.
    """
    spark = docs.sparkSession
    rows = templates(k, passages)
    side = F.broadcast(spark.createDataFrame(rows, "gram long, template int, position int, size int, label string"))
    scanned = scan_words(docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), k, phrases)
    head = ["uid", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"]
    # Votes are kept beside their document: one pass, no self-join of the scan.  The join is an
    # outer one from a marker row (position -1), so documents without a hit survive.
    grams = scanned.select(*head, F.posexplode(F.concat(F.array(F.lit(None).cast("long")), "grams")).alias("at", "gram"))
    hits = grams.join(side, "gram", "left").where("at = 0 OR template IS NOT NULL").withColumn("at", F.col("at") - 1)
    votes = hits.withColumn("diagonal", F.col("at") - F.col("position"))
    own = [F.first(c, ignorenulls=True).alias(c) for c in head[1:]]
    # Neighbouring diagonals: bands of `band`, each vote also in the band before, so that any
    # two diagonals less than `band` apart meet in one of them.
    banded = votes.withColumn("band", F.explode(F.when(F.col("template").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.array(F.floor(F.col("diagonal") / band), F.floor(F.col("diagonal") / band) - 1))))
    spans = banded.groupBy("uid", "template", "band").agg(
        *[F.first(F.when(F.col("template").isNull(), F.col(c)), ignorenulls=True).alias(c) for c in head[1:]],
        F.first("label", ignorenulls=True).alias("label"),
        F.first("size", ignorenulls=True).alias("size"),
        F.min("at").alias("begin"),
        F.max("at").alias("end"),
        F.collect_set("position").alias("positions"),
    )
    carried = F.size(F.array_distinct(F.flatten(F.transform("positions", lambda p: F.sequence(p, p + (k - 1))))))
    share = carried / (F.col("size") + (k - 1))
    verified = F.when((share >= cover) & F.col("template").isNotNull(), F.struct("label", F.col("begin").cast("long").alias("first_word"), (F.col("end") + (k - 1)).cast("long").alias("last_word"), F.least(share, F.lit(1.0)).alias("share")))
    docs_ = spans.withColumn("span", verified).groupBy("uid").agg(*own, F.array_sort(F.collect_set("span")).alias("spans"))
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.transform("spans", lambda s: s["label"]))))
    return docs_.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0))).alias("score"),
        "spans",
    )
