"""License scans by diagonal voting of word k-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockloom.llm.arrays import LOWER, flat, grams, pieces, prefix, spans, text_batches, within, words
from stockloom.session import written

# Phrases and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Well-known notices, as their licences word them.
TEMPLATES = {
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files, to deal in the Software without restriction": "mit",
    "Released under the MIT License": "mit",
    "Licensed under the Apache License, Version 2.0": "apache-2",
    "you may not use this file except in compliance with the License. You may obtain a copy of the License at": "apache-2",
    "Licensed under CC BY-NC 4.0": "cc-by-nc",
    "This work is licensed under the GNU General Public License, version 3": "gpl-3",
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License": "gpl-3",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met": "bsd",
    "This Source Code Form is subject to the terms of the Mozilla Public License": "mpl-2",
}

K = 3
LEAST_COVER = 0.7
DRIFT = 3
MOST_TEMPLATE_ROWS = 1_000_000

# Word bytes: everything but [\x00-\x2F\x3A-\x60\x7B-\x7F], after A-Z are lower-cased.
IS_WORD = np.ones(256, bool)
for lo, hi in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    IS_WORD[lo : hi + 1] = False

_HEAD = np.uint64(0)  # marks the one row per document beside its k-grams


def gram_columns(column: pa.Array, k: int) -> tuple[np.ndarray, ...]:
    """All k-grams of the texts: text number, first word, two independent 64-bit hashes; and words per text."""
    raw, off = flat(column)
    data = LOWER[raw]
    starts, ends, first = words(data, off, IS_WORD)
    hashes = spans(prefix(data), starts, ends)
    ok = within(first, k)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    place = (np.arange(len(hashes)) - first[owner])[: len(ok)][ok]
    second = spans(prefix(data ^ 0x5A), starts, ends)
    return owner[: len(ok)][ok], place, grams(hashes, k)[ok], grams(second, k)[ok], np.diff(first)


def template_rows(texts: dict[str, str], base: int, k: int) -> list[tuple]:
    """``(template, kind, label, place, n_grams, n_words, h, check)`` per k-gram of each template."""
    out = []
    for t, (text, label) in enumerate(texts.items()):
        _, place, h, check, n = gram_columns(pa.array([text]), k)
        if len(place) == 0:
            raise ValueError(f"a template needs at least {k} words: {text!r}")
        out += [(base + t, label, int(p), len(place), int(n[0]), int(a), int(b)) for p, a, b in zip(place, h.view(np.int64), check.view(np.int64))]
    return out


def scan_licenses(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, k: int = K, cover: float = LEAST_COVER, drift: int = DRIFT) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans`` per document.

    Every rolling k-gram of every document, as a pair of independent 64-bit hashes, is joined in Spark to
    the k-grams of the templates. A hit votes for its diagonal (place in the text minus place in the
    template) at its template. A *phrase* stands where one diagonal has all of the phrase's k-grams, which
    are then all of its words in a row. A *template* may have words put in, left out or changed: its
    diagonals that are at most ``drift`` apart are merged into one span, and a span is verified by the
    share of the template's words that its k-grams cover; from ``cover`` on it is a match. A k-gram hit
    holds both hashes equal, so the covered words are equal words.

    ``spans`` lists the verified matches as (label, first word, last word, share). ``labels`` has the
    labels of matches and phrases; ``score`` is the largest share, 1 where a phrase stands, 0 without hits.
    Hits are few; one document's hits on one template are ordered in one task, and no group spans documents.
    The template rows are sent to all tasks only while there are at most ``MOST_TEMPLATE_ROWS``; more are
    joined by shuffle.

    Nulls: a null text is an empty one: no words, no places, score 0. Rows without id are scanned like any
    other. Repeated rows get equal results. Phrases and templates need ``k`` words at least. An empty table
    gives no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    rows = template_rows(phrases, 0, k) + template_rows(templates, len(phrases), k)
    n_phrases = len(phrases)
    table = spark.createDataFrame([*rows, (-1, None, 0, 0, 0, int(_HEAD), 0)], "template int, label string, t_place int, n_grams int, t_words int, h long, check long")
    if len(rows) <= MOST_TEMPLATE_ROWS:
        table = F.broadcast(table)

    def run(batches):
        for piece in pieces(batches):
            owner, place, h, check, n_words = gram_columns(piece.column("text"), k)
            n = len(n_words)
            h[h == _HEAD] = 1
            owner = np.concatenate((np.arange(n), owner))
            yield pa.RecordBatch.from_arrays(
                [
                    piece.column("doc_id").take(pa.array(owner)),
                    piece.column("text_key").take(pa.array(owner)),
                    pa.array(np.concatenate((n_words, place)).astype(np.int64)),
                    pa.array(np.concatenate((np.zeros(n, np.uint64), h)).view(np.int64)),
                    pa.array(np.concatenate((np.zeros(n, np.uint64), check)).view(np.int64)),
                ],
                names=["doc_id", "text_key", "place", "h", "check"],
            )

    kind = dict(docs.dtypes)["doc_id"]
    stream = text_batches(docs).select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text").mapInArrow(
        run, f"doc_id {kind}, text_key long, place long, h long, check long"
    )
    hits = written(stream.join(table, ["h", "check"]).select("doc_id", "text_key", "place", "template", "label", "t_place", "n_grams", "t_words"))
    heads = hits.where("template = -1").select("doc_id", "text_key", F.col("place").alias("n_words"))
    votes = hits.where("template >= 0").withColumn("diagonal", F.col("place") - F.col("t_place")).distinct()
    key = ["doc_id", "text_key"]

    full = votes.where(F.col("template") < n_phrases).groupBy(*key, "template", "label", "n_grams", "diagonal").agg(F.count(F.lit(1)).alias("n")).where("n = n_grams")
    base = full.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_base"), F.min("diagonal").alias("first_word"), F.max("diagonal").alias("last_word"), F.collect_set("label").alias("base_set")
    )

    line = Window.partitionBy(*key, "template").orderBy("diagonal", "t_place")
    far = (F.col("diagonal") - F.lag("diagonal").over(line) > drift).cast("int")
    runs = votes.where(F.col("template") >= n_phrases).withColumn("span", F.sum(F.coalesce(far, F.lit(0))).over(line))
    covered = F.flatten(F.collect_set(F.sequence(F.col("t_place"), F.col("t_place") + (k - 1))))
    spans_found = (
        runs.groupBy(*key, "template", "label", "t_words", "span")
        .agg(F.size(F.array_distinct(covered)).alias("n_covered"), F.min("place").alias("start"), (F.max("place") + (k - 1)).alias("end"))
        .select(*key, "label", "start", "end", (F.col("n_covered") / F.col("t_words")).alias("share"))
    )
    matches = F.col("share") >= cover
    other = spans_found.groupBy(*key).agg(
        F.max("share").alias("top_share"), F.collect_set(F.when(matches, F.col("label"))).alias("span_set"),
        F.sort_array(F.collect_set(F.when(matches, F.struct("label", "start", "end", "share")))).alias("spans"),
    )
    none = F.array().cast("array<string>")
    same = lambda a, b: F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_key") == F.col(f"{b}.text_key"))
    joined = heads.alias("d").join(base.alias("b"), same("d", "b"), "left").join(other.alias("o"), same("d", "o"), "left")
    base_set = F.coalesce("b.base_set", none)
    span_set = F.coalesce("o.span_set", none)
    return joined.select(
        F.col("d.doc_id").alias("doc_id"),
        F.col("d.n_words").alias("n_words"),
        F.coalesce("b.n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("b.first_word").alias("first_word"),
        F.col("b.last_word").alias("last_word"),
        F.array_join(F.array_sort(base_set), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_set, span_set)), ",").alias("labels"),
        F.when(F.col("b.n_base") > 0, 1.0).otherwise(F.coalesce("o.top_share", F.lit(0.0))).alias("score"),
        F.when(F.size("o.spans") > 0, F.col("o.spans")).alias("spans"),
    )
