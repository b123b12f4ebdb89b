"""License scan: exact containment join of text blocks with license templates.

A text becomes blocks of words: for templates of up to L words (L a power of two) blocks of 2 L words that
begin at every L-th, so a passage as long as the template lies whole in one. A block matches a template when
it holds at least ``percent`` of the template's distinct words. Words are ordered by the number of documents
that hold them, rarest first; a block and a template that match must share a word among the first
``size - needed + 1`` of each (prefix filter), the block must be long enough (length filter), and the words from
the shared one on must suffice (position filter). What passes is decided on the whole sets.

Words that no template has cannot match, so blocks carry template words only. Null texts are empty. Rows are
judged one by one: repeated or null ids keep a result for each row. An empty table gives no rows; further
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from weekloom.config import stored_small
from weekloom.llm.common import release_memory, stored
from weekloom.llm.wordarrays import SPACE, WordArrays, chunks

# Phrases whose places are counted, and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

# Opening words of public license notices, and the family each belongs to.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    (
        "apache",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ),
    ("cc", "Licensed under CC BY 4.0"),
    ("cc", "Licensed under CC BY-NC 4.0"),
    ("cc", "Licensed under CC BY-SA 4.0"),
    ("cc", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies",
    ),
    ("mit", "Released under the MIT License"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

PERCENT = 90
CHUNK_BYTES = 8 << 20
LEAST_BAND = 8

#: Bytes outside words become spaces, A-Z becomes a-z.
_BYTES = np.full(256, SPACE, np.uint8)
for _lo, _hi in ((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)):
    _BYTES[_lo : _hi + 1] = np.arange(_lo, _hi + 1)
_BYTES[0x41:0x5B] = np.arange(0x61, 0x7B)


def words_of(text: str) -> list[str]:
    """Words of one text in order."""
    data = _BYTES[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)].tobytes()
    return [w.decode("utf-8", "replace") for w in data.split(b" ") if w]


def template_rows(templates: list[tuple[str, str]], percent: int) -> list[tuple]:
    """(template, label, band, needed, words) of each template; words are distinct and sorted."""
    out = []
    for k, (label, text) in enumerate(templates):
        words = words_of(text)
        own = sorted(set(words))
        band = max(LEAST_BAND, 1 << (len(words) - 1).bit_length())
        out.append((k, label, band, -(-percent * len(own) // 100), own))
    return out


def _scanner(templates: list[tuple], phrases: list[tuple[str, str]], id_type: pa.DataType):
    """For mapInArrow: a row for each text with its counts, its template words and the blocks that can match."""
    bands = {}
    for _, _, band, needed, own in templates:
        vocabulary, least = bands.get(band, (set(), needed))
        bands[band] = vocabulary | set(own), min(least, needed)
    known = sorted(set().union(*(v for v, _ in bands.values())))
    number = {w.encode(): i for i, w in enumerate(known)}
    parts = [([w.encode() for w in phrase.split(" ")], label) for phrase, label in phrases]

    def blocks(words: WordArrays, ids: np.ndarray, band: int, inside: np.ndarray, least: int):
        """(text, block, template words) of the blocks with ``least`` or more of them."""
        at = np.flatnonzero(inside[ids])
        text = words.text[at]
        block = (at - words.first[text]) // band
        early = block > 0
        keys = np.concatenate((text, text[early])), np.concatenate((block, block[early] - 1)), np.concatenate((ids[at], ids[at[early]]))
        rows = np.unique(np.stack(keys, 1), axis=0)
        new = np.flatnonzero(np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(1)))) if len(rows) else rows[:, 0]
        for lo, hi in zip(new.tolist(), [*new[1:].tolist(), len(rows)], strict=True):
            if hi - lo >= least:
                yield int(rows[lo, 0]), int(rows[lo, 1]), rows[lo:hi, 2]

    def run(batches):
        masks = {}
        for band, (vocabulary, least) in bands.items():
            masks[band] = np.array([*(w in vocabulary for w in known), False]), least
        for rows in chunks(batches, CHUNK_BYTES):
            words = WordArrays([r[1] for r in rows], _BYTES)
            of_word = {w: i for i, w in enumerate(words.dictionary.to_pylist())}
            own = np.array([number.get(w, -1) for w in of_word], np.int64)
            ids = own[words.ids] if len(own) else np.zeros(0, np.int64)
            places, labels = [], [set() for _ in rows]
            for phrase, label in parts:
                codes = [of_word.get(w, -1) for w in phrase]
                size = max(0, len(ids) - len(phrase) + 1)
                hit = np.ones(size, bool)
                for k, code in enumerate(codes):
                    hit &= words.ids[k : k + size] == code
                hit = np.flatnonzero(hit)
                hit = hit[words.text[hit] == words.text[hit + len(phrase) - 1]]
                places.append(hit)
                for t in np.unique(words.text[hit]).tolist():
                    labels[t].add(label)
            hit = np.sort(np.concatenate(places)) if places else np.zeros(0, np.int64)
            text = words.text[hit]
            n_base = np.bincount(text, minlength=len(rows))
            lo = np.searchsorted(text, np.arange(len(rows)))
            seen = np.unique(np.stack((words.text, ids), 1)[ids >= 0], axis=0)
            edges = np.searchsorted(seen[:, 0], np.arange(len(rows) + 1))
            found = [[] for _ in rows]
            for band, (inside, least) in masks.items():
                for t, block, own_ids in blocks(words, ids, band, inside, least):
                    found[t].append({"band": band, "block": block, "words": [known[i] for i in own_ids.tolist()]})
            out = []
            for t, row in enumerate(rows):
                n = int(n_base[t])
                first, last = (int(hit[k] - words.first[t]) for k in (lo[t], lo[t] + n - 1)) if n else (None, None)
                held = [known[i] for i in seen[edges[t] : edges[t + 1], 1].tolist()]
                out.append((row[0], int(words.size[t]), n, first, last, ",".join(sorted(labels[t])), held, found[t]))
            yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), types, strict=True)], names)
        release_memory()

    block_type = pa.list_(pa.struct([("band", pa.int32()), ("block", pa.int64()), ("words", pa.list_(pa.string()))]))
    types = [id_type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), block_type]
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "held", "blocks"]
    return run


SCANNED = (
    "doc_id {0}, n_words long, n_base long, first_word long, last_word long, base_labels string, held array<string>, "
    "blocks array<struct<band: int, block: bigint, words: array<string>>>"
)


def containment_join(blocks: DataFrame, templates: DataFrame, order: DataFrame) -> DataFrame:
    """(row, block columns, template, label, overlap, containment) of every block that holds enough of a template.

    ``blocks``: row, band, block, words (distinct); ``templates``: template, label, band, needed, words; ``order``: word,
    place (rarest first). Both sides are ordered the same way; words without a place come last.
    """
    def ordered(df: DataFrame, keys: list[str]) -> DataFrame:
        each = df.select(*keys, F.posexplode("words").alias("_", "word")).drop("_").join(order, "word", "left")
        place = F.struct(F.coalesce("place", F.lit(2**62)).alias("place"), "word")
        return each.groupBy(*keys).agg(F.array_sort(F.collect_list(place)).alias("w")).select(*keys, F.col("w.word").alias("words"))

    least = templates.groupBy("band").agg(F.min("needed").alias("least"))
    # One row a band: the powers of two up to the longest template.
    left = ordered(blocks.join(F.broadcast(least), "band").where(F.size("words") >= F.col("least")), ["row", "band", "block", "least"])
    left = left.select("row", "band", "block", F.col("words").alias("own"), F.posexplode(F.expr("slice(words, 1, size(words) - least + 1)")).alias("at", "word"))
    right = ordered(templates, ["template", "label", "band", "needed"])
    right = right.select(
        "template", "label", "band", "needed", "words", F.posexplode(F.expr("slice(words, 1, size(words) - needed + 1)")).alias("place", "word")
    )
    pairs = left.join(stored_small(right), ["band", "word"]).where(F.size("own") >= F.col("needed"))
    pairs = pairs.where(1 + F.least(F.size("own") - 1 - F.col("at"), F.size("words") - 1 - F.col("place")) >= F.col("needed"))
    # A pair comes once for each shared word of both prefixes; the first of them stands for it.
    pairs = pairs.where(F.expr("array_position(own, array_intersect(own, words)[0]) = at + 1"))
    judged = pairs.withColumn("overlap", F.size(F.array_intersect("own", "words"))).where(F.col("overlap") >= F.col("needed"))
    return judged.select("row", "band", "block", "template", "label", "overlap", (F.col("overlap") / F.size("words")).alias("containment"))


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None, percent: int = PERCENT
) -> tuple[DataFrame, DataFrame]:
    """Scanned rows with the places of the phrases, and the matches of their blocks; see the module docstring."""
    known = template_rows(templates or TEMPLATES, percent)
    id_type = docs.schema[id_col].dataType
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    scanned = texts.mapInArrow(_scanner(known, PHRASES, to_arrow_type(id_type)), SCANNED.format(id_type.simpleString()))
    scanned = stored(scanned.withColumn("row", F.monotonically_increasing_id()), "license-rows")
    # At most as many rows as the templates have words.
    counts = scanned.select(F.explode("held").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    order = stored_small(counts.select("word", F.row_number().over(Window.orderBy("n", "word")).alias("place")))
    blocks = scanned.select("row", F.explode("blocks").alias("b")).select("row", "b.band", "b.block", "b.words")
    table = docs.sparkSession.createDataFrame(known, "template int, label string, band int, needed int, words array<string>")
    return scanned.drop("held", "blocks"), containment_join(blocks, table, order)


def license_labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: counts and places of the phrases, labels of phrases and templates, and a score.

    ``score`` is 1 where a phrase stands, else the best containment among the matches, else 0.
    """
    rows, matches = scan(docs, id_col, text_col)
    found = matches.groupBy("row").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    both = rows.join(found, "row", "left")
    base = F.when(F.col("base_labels") == "", F.array().cast("array<string>")).otherwise(F.split("base_labels", ","))
    labels = F.array_sort(F.array_union(base, F.coalesce("more", F.array().cast("array<string>"))))
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
