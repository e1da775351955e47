"""License notices by an exact set-similarity join of text blocks with templates (op11)."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kadastra.llm.common import checkpoint, table

#: A block holds a template if it has this share of the template's different words.
CONTAINMENT = 0.8
#: Different words of all templates together; they and their prefixes are sent to every task.
MOST_WORDS = 100_000
#: Texts are cut into words in pieces of so many bytes.
PIECE = 1 << 20
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_NOT_WORD = re.compile(rb"[^0-9a-z\x80-\xff]")


@dataclass(frozen=True)
class Template:
    """A text to look for. `exact`: its words must stand consecutively, else their share in a block decides."""

    label: str
    text: str
    exact: bool = False


#: The phrases whose places are counted.
PHRASES = [
    Template("gpl", "gnu general public license", True),
    Template("apache", "apache license", True),
    Template("cc-by", "cc by", True),
    Template("mit", "mit license", True),
]
#: Sentences by which well-known licenses are given, as their publishers word them.
NOTICES = [
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    Template("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    Template("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    Template("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    Template("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    Template("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    Template("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    Template("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    Template("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    Template("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License"),
    Template("unlicense", "This is free and unencumbered software released into the public domain"),
    Template("zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    Template("bsl", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software"),
    Template("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    Template("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
]


def words_of(text: str) -> list[str]:
    """Runs of digits, letters a to z (A to Z lower-cased) and all signs beyond ASCII."""
    return [w.decode() for w in _WORD.findall(text.encode().lower())]


def _pieces(data: bytes) -> Iterator[bytes]:
    """`data` in pieces that end where no word goes on."""
    at = 0
    while at < len(data):
        end = at + PIECE
        if end < len(data):
            m = _NOT_WORD.search(data, end)
            end = m.start() if m else len(data)
        yield data[at:end]
        at = end


def numbered(text: str | None, number: dict[bytes, int]) -> np.ndarray:
    """The number of each word of a whole text, -1 for words without one."""
    found = [np.fromiter(map(number.get, words := _WORD.findall(piece), repeat(-1)), np.int32, len(words)) for piece in _pieces((text or "").encode().lower())]
    return np.concatenate(found) if found else np.zeros(0, np.int32)


def word_counts(docs: DataFrame, words: list[str], *, text: str = "text") -> DataFrame:
    """(word, n): how often each of `words` (a bounded list) stands in all texts; one row for each word and task is shuffled."""
    number = {w.encode(): i for i, w in enumerate(words)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(words) + 1, np.int64)
        for batch in batches:
            for v in batch.column(0):
                n += np.bincount(numbered(v.as_py(), number) + 1, minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n[1:])], names=["word", "n"])

    return docs.select(text).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def half_width(n_words: int) -> int:
    """Blocks for a template of n words start at every so many words (a power of two) and are twice as long, so each stretch of n words lies in one block."""
    return 1 << max(0, n_words - 1).bit_length()


def _describe(templates: list[Template], rank: dict[str, int], containment: float) -> list[tuple]:
    """(template, label, exact, half, phrase, tokens, need): tokens in global order, the rarest first."""
    out = []
    for i, t in enumerate(templates):
        phrase = [rank[w] for w in words_of(t.text)]
        tokens = sorted(set(phrase))
        if tokens:
            need = len(tokens) if t.exact else math.ceil(containment * len(tokens) - 1e-9)
            out.append((i, t.label, t.exact, half_width(len(phrase)), phrase, tokens, max(1, need)))
    return out


def cut_blocks(docs: DataFrame, rank: dict[str, int], prefixes: dict[int, set[int]], *, row_id: str, text: str) -> DataFrame:
    """(_row, _id, n_words, blocks) of each row: those blocks of each width that hold a word of a prefix of that width.

    A block is (half, start, words, tokens): the words' numbers in their order (-1 for words of no template), and the different ones, the
    globally rarest first. Texts are read whole; a block's size is bounded by its width.
    """
    number = {w.encode(): i for w, i in rank.items()}
    in_prefix = {half: np.isin(np.arange(len(rank) + 1), sorted(some)) for half, some in prefixes.items()}
    block = pa.struct([("half", pa.int32()), ("start", pa.int64()), ("words", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))])

    def blocks_of(ranks: np.ndarray) -> list[dict]:
        out = []
        for half, wanted in in_prefix.items():
            at = np.flatnonzero(wanted[ranks]) // half
            for b in np.union1d(at, np.maximum(at - 1, 0)).tolist():
                words = ranks[b * half : (b + 2) * half]
                tokens = np.unique(words)
                out.append({"half": half, "start": b * half, "words": words, "tokens": tokens[tokens >= 0]})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, found = [], []
            for v in batch.column(2):
                ranks = numbered(v.as_py(), number)
                n.append(len(ranks))
                found.append(blocks_of(ranks))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(found, pa.list_(block))], names=["_row", "_id", "n_words", "blocks"])

    kind = docs.schema[row_id].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(row_id).alias("_id"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, f"_row long, _id {kind}, n_words long, blocks array<struct<half:int,start:long,words:array<int>,tokens:array<int>>>")


def matching_blocks(blocks: DataFrame, templates: DataFrame) -> DataFrame:
    """(_row, half, start, template, overlap): every block that has as many of a template's words as it needs.

    `blocks` is (_row, half, start, tokens), `templates` (template, half, tokens, need), tokens in one global order. If a block and a
    template share `need` words, the first one in that order lies among the template's first size - need + 1 and among the block's: only
    these prefixes are joined, blocks shorter than `need` not at all. Where k words of the prefixes
    meet and the last stands at p and q, no more than k + min(what follows p, what follows q) can be shared; pairs below `need` are
    passed over, the others counted in full.
    """
    prefix = templates.select("template", "half", "need", F.size("tokens").alias("n"), F.posexplode("tokens").alias("p", "token")).where("p <= n - need")
    words = blocks.select("_row", "half", "start", F.size("tokens").alias("size"), F.posexplode("tokens").alias("q", "token"))
    met = words.join(prefix, ["half", "token"]).where("size >= need and q <= size - need")
    pairs = met.groupBy("_row", "half", "start", "template").agg(F.count("*").alias("k"), F.max("p").alias("p"), F.max("q").alias("q"), F.first("n").alias("n"), F.first("size").alias("size"), F.first("need").alias("need"))
    pairs = pairs.where("k + least(n - p, size - q) - 1 >= need").select("_row", "half", "start", "template", "need")
    full = pairs.join(blocks.withColumnRenamed("tokens", "_have"), ["_row", "half", "start"]).join(templates.select("template", "tokens"), "template")
    return full.withColumn("overlap", F.size(F.array_intersect("_have", "tokens"))).where("overlap >= need").select("_row", "half", "start", "template", "overlap")


def find_licenses(docs: DataFrame, *, templates: list[Template] | None = None, containment: float = CONTAINMENT, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of `docs`.

    All words of the templates are counted over the whole corpus and ordered by frequency, the rarest first (ties by the word). Texts are
    cut into overlapping blocks as wide as the templates ask for, those with a prefix's word meet the templates
    by `matching_blocks`, and what it finds is looked at once more: an exact template's words must stand consecutively, and each
    place counts once however many blocks hold it. Base labels are those of exact templates, labels those of all; the score is the greatest share of a template's words in a found
    block (1 for exact ones, 0 without any).

    Null texts count as empty; rows are told apart even when ids repeat; other columns are not used, whatever their names. An
    empty table gives an empty result. The templates are a parameter: at most 100,000 different words, which is checked.
    """
    templates = PHRASES + NOTICES if templates is None else templates
    vocabulary = sorted({w for t in templates for w in words_of(t.text)})
    if len(vocabulary) > MOST_WORDS:
        raise ValueError(f"templates of {len(vocabulary)} different words; at most {MOST_WORDS} can be sent to every task")
    spark = docs.sparkSession
    counts = {r["word"]: r["n"] for r in word_counts(docs, vocabulary, text=text).collect()}
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    described = _describe(templates, rank, containment)
    prefixes: dict[int, set[int]] = {}
    for _, _, _, half, _, tokens, need in described:
        prefixes.setdefault(half, set()).update(tokens[: len(tokens) - need + 1])
    known = F.broadcast(spark.createDataFrame(described, "template int, label string, exact boolean, half int, phrase array<int>, tokens array<int>, need int"))  # bounded by MOST_WORDS
    rows = checkpoint(cut_blocks(docs, rank, prefixes, row_id=row_id, text=text))
    blocks = rows.where(F.size("blocks") > 0).select("_row", F.explode("blocks").alias("b")).select("_row", "b.*")
    found = matching_blocks(blocks.select("_row", "half", "start", "tokens"), known)
    found = found.join(blocks.select("_row", "half", "start", "words"), ["_row", "half", "start"]).join(known.select("template", "label", "exact", "phrase", F.size("tokens").alias("n")), "template")
    stands = F.filter(F.sequence(F.lit(0), F.size("words") - F.size("phrase")), lambda i: F.slice("words", i + 1, F.size("phrase")) == F.col("phrase"))
    places = found.where(F.col("exact") & (F.size("words") >= F.size("phrase"))).select("_row", "template", "label", F.explode(F.transform(stands, lambda i: i + F.col("start"))).alias("place"), F.lit(1.0).alias("share")).distinct()
    shares = found.where("not exact").groupBy("_row", "template", "label").agg(F.max(F.col("overlap") / F.col("n")).alias("share")).withColumn("place", F.lit(None).cast("long"))
    base = F.col("place").isNotNull()
    told = places.unionByName(shares).groupBy("_row").agg(
        F.count("place").alias("n_base"), F.min("place").alias("first_word"), F.max("place").alias("last_word"),
        F.collect_set(F.when(base, F.col("label"))).alias("base_labels"), F.collect_set("label").alias("labels"), F.max("share").alias("score"),
    )
    listed = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit("")).alias(c)
    return rows.select("_row", F.col("_id").alias(row_id), "n_words").join(told, "_row", "left").select(
        row_id, "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", listed("base_labels"), listed("labels"), F.coalesce("score", F.lit(0.0)).alias("score")
    )


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of all documents."""
    return find_licenses(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """All blocks of all texts against all templates, without prefixes or filters."""
    told = []
    for t in PHRASES + NOTICES:
        words = words_of(t.text)
        listed = "[" + ", ".join(f"'{w}'" for w in words) + "]"
        told.append(f"('{t.label}', {str(t.exact).lower()}, {listed}, {len(set(words)) if t.exact else math.ceil(CONTAINMENT * len(set(words)) - 1e-9)}, {half_width(len(words))})")
    return f"""
with d as (
  select row_number() over () as rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') as ws from documents
), t(label, exact, phrase, need, half) as (values {', '.join(told)}
), p as (
  select rid, label, unnest(list_filter(range(0, len(ws) - len(phrase) + 1), lambda i: ws[i + 1] = phrase[1] and ws[i + 1:i + len(phrase)] = phrase)) as place from d, t where exact
), s as (
  select rid, label, max(list_max(list_transform(range(0, len(ws), half), lambda i: len(list_intersect(ws[i + 1:i + 2 * half], phrase)))) / len(list_distinct(phrase))) as share, bool_or(
    coalesce(list_max(list_transform(range(0, len(ws), half), lambda i: len(list_intersect(ws[i + 1:i + 2 * half], phrase)))) >= need, false)) as found
  from d, t where not exact group by 1, 2
), b as (
  select rid, count(*) as n_base, min(place) as first_word, max(place) as last_word, string_agg(distinct label, ',' order by label) as base_labels from p group by 1
), l as (
  select rid, string_agg(distinct label, ',' order by label) as labels, max(share) as score from (select rid, label, 1.0::double as share from p union all select rid, label, share from s where found) group by 1
)
select doc_id, len(ws)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0)::double as score
from d left join b using (rid) left join l using (rid)
"""


OP11_SQL = _sql()
