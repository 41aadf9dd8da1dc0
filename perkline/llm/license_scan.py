"""License scans by diagonal voting.

Every template (short phrases and longer notices) is cut into word k-grams: k = 2 for phrases, k = 4 for notices. All
rolling k-grams of every whole text are hashed; a k-gram whose low hash bits no template has is left out at once, as a
runtime filter of the join would do. The rest is joined by Spark to the template positions. Each match votes for its
diagonal (place in the document less place in the template), if the words behind the two hashes are the same, which
verifies every place that a span will claim; votes are counted by (document, template, diagonal),
diagonals closer than the template's slack are merged into one span, so that a few inserted or dropped words do not
split a notice, and a span is verified by the share of distinct template positions it covers. Phrases have no slack
and need every position: their spans are exactly the places where the phrase stands.

Defined results: null text is empty, with no words; ties and repeated rows are scored row by row; an empty table gives
no rows; other columns are ignored. score: 1 for a document with a phrase, else the best coverage of a verified span,
else 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from perkline.llm.common import WordHashes, gram_hashes, lean, slices, stash

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
# Phrases and their labels.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
# Notices of public licenses, and their labels.
NOTICES = (
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "mit"),
    ("Licensed under the Apache License, Version 2.0", "apache-2.0"),
    ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied", "apache-2.0"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "gpl-3.0"),
    ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE", "gpl"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mpl-2.0"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by-4.0"),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
)
PHRASE_K, NOTICE_K = 2, 4
#: Share of a notice's k-grams that a verified span covers, and how far diagonals of one span may lie apart.
COVER, SLACK = 0.6, 4
FILTER_BITS = 16


def license_words(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def template_grams(phrases=PHRASES, notices=NOTICES) -> list[tuple[int, str, bool, int, int, int, str]]:
    """(template, label, phrase?, k-gram hash, place, number of k-grams, words) for every k-gram of every template."""
    h, out = WordHashes(), []
    for n, (text, label, exact) in enumerate([(*p, True) for p in phrases] + [(*p, False) for p in notices]):
        words, k = license_words(text), PHRASE_K if exact else NOTICE_K
        grams = gram_hashes(h.of(words), k).astype(np.int64)
        out += [(n, label, exact, int(g), place, len(grams), b" ".join(words[place : place + k]).decode()) for place, g in enumerate(grams)]
    return out


def _rolling(bits: dict[int, np.ndarray]):
    kind = pa.list_(pa.struct([("gram", pa.int64()), ("at", pa.int64()), ("words", pa.string())]))
    low = np.uint64((1 << FILTER_BITS) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in slices(batches, text=1):
            sizes, grams, places, read, ends = [], [], [], [], [0]
            for text in b.column(1).to_pylist():
                spelled = license_words(text)
                words = hashes.of(spelled)
                sizes.append(len(words))
                n = ends[-1]
                for k, known in bits.items():
                    g = gram_hashes(words, k)
                    hit = np.flatnonzero(known[g & low])
                    if len(hit):
                        grams.append(g[hit])
                        places.append(hit)
                        read += [b" ".join(spelled[i : i + k]) for i in hit]
                        n += len(hit)
                ends.append(n)
            values = pa.StructArray.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *grams]).astype(np.int64)), pa.array(np.concatenate([np.empty(0, np.int64), *places]).astype(np.int64)), pa.array(read, pa.binary()).cast(pa.string())], ["gram", "at", "words"])
            hits = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), hits.cast(kind)], ["doc_id", "n_words", "hits"])

    return run


def license_spans(docs: DataFrame, doc: str = "doc_id", text: str = "text", phrases=PHRASES, notices=NOTICES) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows has one row per document (row, doc_id, n_words); spans has the verified spans
    (row, template, label, exact, start, n_words_covered, cover)."""
    spark = docs.sparkSession
    grams = template_grams(phrases, notices)
    bits = {}
    for k, exact in ((PHRASE_K, True), (NOTICE_K, False)):
        bits[k] = np.zeros(1 << FILTER_BITS, bool)
        bits[k][[g[3] & ((1 << FILTER_BITS) - 1) for g in grams if g[2] == exact]] = True
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = stash(rows.mapInArrow(lean(_rolling(bits)), "doc_id long, n_words long, hits array<struct<gram:long,at:long,words:string>>").withColumn("row", F.monotonically_increasing_id()))
    templates = spark.createDataFrame(grams, "template int, label string, exact boolean, gram long, place int, grams int, spelled string")
    # the templates are the fixed texts above, a few hundred rows
    votes = rows.select("row", F.explode("hits").alias("h")).select("row", "h.*").join(F.broadcast(templates), "gram").where("words = spelled")
    votes = votes.withColumn("diagonal", F.col("at") - F.col("place"))
    by = ["row", "template", "label", "exact", "grams"]
    lines = votes.groupBy(*by, "diagonal").agg(F.collect_set("place").alias("places"), F.min("at").alias("lo"), F.max("at").alias("hi"))
    # merge: a new span starts where the next diagonal lies further than the slack
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(along)
    lines = lines.withColumn("new", F.when(gap.isNull() | F.col("exact") | (gap > SLACK), 1).otherwise(0))
    lines = lines.withColumn("span", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    merged = lines.groupBy(*by, "span").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("covered"), F.min("lo").alias("start"), F.max("hi").alias("last"))
    merged = merged.withColumn("cover", F.col("covered") / F.col("grams"))
    good = merged.where(F.when(F.col("exact"), F.col("covered") == F.col("grams")).otherwise(F.col("cover") >= COVER))
    return rows.drop("hits"), good.select("row", "template", "label", "exact", "start", "last", "cover")


def scan_licenses(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score: one row per document."""
    rows, spans = license_spans(docs, **how)
    base = F.col("exact")
    told = spans.groupBy("row").agg(
        F.sum(F.when(base, 1).otherwise(0)).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"), F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max(F.when(base, F.lit(1.0)).otherwise(F.col("cover"))).alias("score"),
    )
    out = rows.join(told, "row", "left")
    fill = lambda c, v: F.coalesce(F.col(c), F.lit(v))
    return out.select("doc_id", "n_words", fill("n_base", 0).cast("long").alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"), fill("base_labels", "").alias("base_labels"), fill("labels", "").alias("labels"), fill("score", 0.0).alias("score"))
