"""License scans by diagonal voting.

Templates are license names, as words, and the wording of notices. Spark joins the rolling
k-gram hashes of every text to the templates' positions: grams of two words for names, which are as
short as that, and of six words for notices. Each match votes for a diagonal, its
position in the text less its position in the template, which is where the template would begin. Diagonals
that are at most DRIFT apart (some words more or less in between) merge into one span, which is verified word by word: a name has to stand there
as it is, of a notice SHARE of the words in their order.

The gram hashes of a text leave the worker as one list; Spark explodes and joins all of them, except
that two-word grams go along only if their second word is one of the second words that some name has,
which rules out no match.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orbitlake.llm.common import WordHashes, arrow_in_small_batches, cut, mix64, ragged, table

# The phrases of the contract and the labels they give.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Other names, and the wording of well-known notices.
NAMES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "2 clause bsd": "bsd",
    "3 clause bsd": "bsd",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "public domain dedication": "cc0",
    "all rights reserved": "all-rights-reserved",
}
NOTICES = {
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.": "mit",
    "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
    "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.": "apache",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
    "either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
    "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.": "gpl",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.": "bsd",
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.": "mpl",
    "This work is licensed under a Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/": "cc-by",
}
WORD_BYTES = np.zeros(256, bool)
WORD_BYTES[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Words of a gram by kind; diagonals so many words apart merge; a notice counts from this share of its words.
SHORT, LONG, DRIFT, SHARE = 2, 6, 4, 0.4


def words(text: str | None) -> list[bytes]:
    """Words in lower case (A-Z); the excluded characters are all ASCII, so bytes do."""
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


def templates() -> list[tuple[int, list[bytes], str, str]]:
    """(id, words, label, kind)"""
    kinds = ((BASE, "base"), (NAMES, "name"), (NOTICES, "notice"))
    return [(i, words(t), label, kind) for i, (t, label, kind) in enumerate((t, x, kind) for table_, kind in kinds for t, x in table_.items())]


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words."""
    s = np.full(max(0, len(h) - k + 1), np.uint64(k))
    for i in range(k):
        s = mix64(s + h[i : i + len(s)] * np.uint64(2 * i + 0x9E3779B97F4A7C15))
    return s


def _template_hashes() -> list[np.ndarray]:
    """For each template its words' hashes."""
    read = WordHashes(lower=True, word=WORD_BYTES)
    h, at = read(pa.array([b" ".join(w) for _, w, _, _ in templates()], pa.binary()))
    return [h[a:b] for a, b in zip(at[:-1], at[1:])]


def template_grams() -> list[tuple[int, int, int, int, str, str]]:
    """(h, template, at, grams of the template, label, kind), a fixed list."""
    rows = []
    for (i, _, label, kind), h in zip(templates(), _template_hashes(), strict=True):
        g = grams(h, LONG if kind == "notice" else SHORT).view(np.int64).tolist()
        rows += [(x, i, at, len(g), label, kind) for at, x in enumerate(g)]
    return rows


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Grams and their places: all of LONG words, and those of SHORT words whose second word some name has as a second word."""
    read = WordHashes(lower=True, word=WORD_BYTES)
    ends = np.unique(np.concatenate([h[1:] for (_, _, _, kind), h in zip(templates(), _template_hashes(), strict=True) if kind != "notice"]))
    step = ends[0:0].dtype.type(0xFFFF)
    maybe = np.zeros(1 << 16, bool)
    maybe[(ends & step).astype(np.int64)] = True
    for batch in batches:
        h, at = read(batch.column(1))
        stop = np.repeat(at[1:], np.diff(at))
        short = np.flatnonzero(maybe[(h[1:] & step).astype(np.int64)]) if len(h) else np.zeros(0, np.int64)
        short = short[short + SHORT <= stop[short]]
        long = np.flatnonzero(np.arange(len(h) - LONG + 1) + LONG <= stop[: max(0, len(h) - LONG + 1)]) if len(h) >= LONG else np.zeros(0, np.int64)
        lists = []
        for k, starts in ((SHORT, short), (LONG, long)):
            cuts = np.searchsorted(starts, at)
            text = np.repeat(np.arange(len(at) - 1), np.diff(cuts))
            lists += [ragged(grams(h, k)[starts].view(np.int64), cuts), ragged((starts - at[text]).astype(np.int32), cuts)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(at), pa.int64()), batch.column(2), *lists], names=["doc_id", "n_words", "text_id", "short", "short_at", "long", "long_at"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each span (template, start, end) of a text the number of the template's words found there in order, each after the one before."""
    known = {i: w for i, w, _, _ in templates()}
    for batch in batches:
        found = []
        for text, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            w = words(text)
            row = []
            for s in spans:
                wanted, at, n = known[s["template"]], s["first"], 0
                for x in w[s["start"] : s["end"]]:  # a word is looked for a little ahead in the template
                    ahead = wanted[at : at + DRIFT + 1]
                    if x in ahead:
                        at += ahead.index(x) + 1
                        n += 1
                row.append({**s, "found": n, "words": len(wanted)})
            found.append(row)
        kind = pa.list_(pa.struct([("template", pa.int32()), ("label", pa.string()), ("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("first", pa.int32()), ("found", pa.int32()), ("words", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, kind)], names=["doc_id", "text_id", "spans"])


SPAN = "template:int,label:string,kind:string,start:long,end:long,first:int,found:int,words:int"


def spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(read, found): read has (doc_id, n_words, text_id) for every row of ``docs``, found the verified spans of each text.

    found has (doc_id, text_id, template, label, kind, start, end, found, words): start and end in words of the text.
    """
    spark = docs.sparkSession
    arrow_in_small_batches(spark)
    docs = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_id"))
    plan = spark.createDataFrame(template_grams(), "h long, template int, at int, grams int, label string, kind string")  # a fixed list of a few hundred rows
    hashed = docs.mapInArrow(_grams, "doc_id long, n_words long, text_id long, short array<long>, short_at array<int>, long array<long>, long_at array<int>")
    both = F.concat(F.arrays_zip(F.col("short").alias("h"), F.col("short_at").alias("pos")), F.arrays_zip(F.col("long").alias("h"), F.col("long_at").alias("pos")))
    # the row itself comes along once, so that texts without any match keep their number of words
    every = hashed.select("doc_id", "n_words", "text_id", F.explode(F.concat(F.array(F.struct(F.lit(None).cast("long").alias("h"), F.lit(-1).alias("pos"))), both)).alias("g"))
    met = cut(every.select("doc_id", "n_words", "text_id", "g.h", "g.pos").join(F.broadcast(plan), "h", "left").where("pos < 0 or template is not null"))
    read = met.where("pos < 0").select("doc_id", "n_words", "text_id")
    who = ["doc_id", "text_id"]
    what = ["template", "label", "kind", "grams"]
    met = met.where("pos >= 0").select(*who, *what, "at", "pos").distinct()
    diagonals = met.groupBy(*who, *what, (F.col("pos") - F.col("at")).alias("start")).agg(F.count_distinct("at").alias("votes"), F.min("pos").alias("lo"), F.max("pos").alias("hi"), F.min("at").alias("first"))
    names = diagonals.where("kind <> 'notice' and votes = grams").select(*who, "template", "label", "kind", F.col("start").cast("long").alias("start"), (F.col("hi") + SHORT).cast("long").alias("end"), F.lit(0).alias("first"))
    order = Window.partitionBy(*who, "template").orderBy("start", "lo")
    near = F.col("start") - F.lag("start").over(order) <= DRIFT
    span = F.sum(1 - F.coalesce(near.cast("int"), F.lit(0))).over(order)
    notices = diagonals.where("kind = 'notice'").withColumn("span", span).groupBy(*who, *what, "span").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("first").alias("first"), F.sum("votes").alias("votes"))
    notices = notices.where(F.col("votes") >= SHARE / 2 * F.col("grams")).select(*who, "template", "label", "kind", F.col("lo").cast("long").alias("start"), (F.col("hi") + LONG).cast("long").alias("end"), "first")
    asked = names.union(notices).groupBy(*who).agg(F.collect_list(F.struct("template", "label", "kind", "start", "end", "first")).alias("spans"))  # of one text
    keyed = [F.col(c).alias(f"_{c}") for c in who]
    same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_id") == F.col("_text_id"))
    texts = docs.join(asked.select(*keyed, "spans"), same).dropDuplicates(who)
    checked = texts.select("doc_id", "text_id", "text", "spans").mapInArrow(_verify, f"doc_id long, text_id long, spans array<struct<{SPAN}>>")
    found = checked.select(*who, F.explode("spans").alias("s")).select(*who, "s.*")
    return read, found.where(F.when(F.col("kind") == "notice", F.col("found") >= SHARE * F.col("words")).otherwise(F.col("found") == F.col("words")))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of ``docs``.

    Null texts are empty: no words, no labels, score 0. Rows of one doc_id and text share their
    spans. score is the largest share of a template's words that was found. Other columns of ``docs`` are ignored.
    """
    read, found = spans(docs)
    base = F.col("kind") == "base"
    summary = found.groupBy("doc_id", "text_id").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max(F.least(F.lit(1.0), F.col("found") / F.col("words"))).alias("score"),
    )
    out = read.join(summary.withColumnsRenamed({"doc_id": "d2", "text_id": "t2"}), F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("text_id") == F.col("t2")), "left")
    none = F.lit("")
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and labels of every document."""
    return scan(table(spark, sf_dir, "documents"))
