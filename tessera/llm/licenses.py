"""License scan by diagonal voting.

Every rolling 2-word gram of a text is hashed; grams whose hash occurs in any
template leave the scan and are Spark-joined to the template positions, on the
hash and on the gram's own words.  A gram at word ``p`` that stands at ``t`` in
a template votes for diagonal ``p - t``.  Votes are counted per diagonal,
neighbouring diagonals (words put in or left out) are merged, and a merged span
is verified by its coverage of the template's words and by its length.  The
gram length is two because the shortest phrase has two words.

Phrases must match in full on one diagonal; notices may be damaged.

Defined results: a null or empty text has no words, no label and score 0;
repeated rows each get their own row; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textkernel as tk
from .support import arrow_text, doc_blocks

#: Phrases of the base contract and their labels (fixed values).
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Further phrases, matched in full.
PHRASES = {
    "the mit license": "mit",
    "apache license version 2 0": "apache-2.0",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "mozilla public license": "mpl",
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "creative commons attribution": "cc-by-named",
    "bsd 3 clause": "bsd",
    "bsd 2 clause": "bsd",
    "isc license": "isc",
    "public domain dedication": "public-domain",
}

#: Openings of license notices, matched by coverage.
NOTICES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "apache-2.0": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "unlicense": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
}

COVERAGE = 0.6
MAX_SHIFT = 3
MAX_STRETCH = 1.5
K = 2


def templates() -> list[tuple]:
    """(tid, label, kind, grams, tpos, gram) rows: a fixed table of a few hundred rows."""
    rows, tid = [], 0
    for kind, source in (
        ("base", BASE),
        ("phrase", PHRASES),
        ("notice", {text: label for label, text in NOTICES.items()}),
    ):
        for text, label in source.items():
            w = text.split()
            for t in range(len(w) - K + 1):
                rows.append((tid, label, kind, len(w) - K + 1, t, " ".join(w[t : t + K])))
            tid += 1
    return rows


def _gram_hash(h: np.ndarray) -> np.ndarray:
    return tk.mix(h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:])


def _known_hashes(grams: list[str]) -> np.ndarray:
    out = []
    for g in grams:
        raw = np.frombuffer(g.encode(), np.uint8)
        s, e, _ = tk.words(raw, np.array([0, len(raw)]), tk.ALNUM)
        out.append(_gram_hash(tk.hash_words(raw, s, e))[0])
    return np.array(out, np.uint64)


def _scan(known: np.ndarray):
    known = np.unique(known)

    def run(batches):
        for batch in batches:
            rid, doc = batch.column(0), batch.column(1)
            raw, bounds = arrow_text(batch.column(2))
            for i, j in doc_blocks(bounds):
                block = tk.lowered(raw[bounds[i] : bounds[j]])
                s, e, d = tk.words(block, bounds[i : j + 1] - bounds[i], tk.ALNUM)
                n = np.bincount(d, minlength=j - i) if len(d) else np.zeros(j - i, np.int64)
                first = np.cumsum(n) - n
                take = lambda col, idx: col.take(pa.array(idx + i))
                everyone = np.arange(j - i)
                yield pa.RecordBatch.from_arrays(
                    [
                        take(rid, everyone),
                        take(doc, everyone),
                        pa.array(n.astype(np.int64)),
                        pa.nulls(j - i, pa.int64()),
                        pa.nulls(j - i, pa.int64()),
                        pa.nulls(j - i, pa.string()),
                    ],
                    ["rid", "doc_id", "n_words", "pos", "h", "gram"],
                )
                if len(s) < K:
                    continue
                g = _gram_hash(tk.hash_words(block, s, e))
                at = np.searchsorted(known, g)
                hit = np.flatnonzero((known[np.minimum(at, len(known) - 1)] == g) & (d[:-1] == d[1:]))
                if not len(hit):
                    continue
                data = block.tobytes()
                grams = [
                    (data[s[x] : e[x]] + b" " + data[s[x + 1] : e[x + 1]]).decode("utf-8", "replace") for x in hit.tolist()
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        take(rid, d[hit]),
                        take(doc, d[hit]),
                        pa.nulls(len(hit), pa.int64()),
                        pa.array((hit - first[d[hit]]).astype(np.int64)),
                        pa.array(g[hit].view(np.int64)),
                        pa.array(grams, pa.string()),
                    ],
                    ["rid", "doc_id", "n_words", "pos", "h", "gram"],
                )

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: id, n_words, and ``spans``, an array of verified
    (label, kind, first_word, last_word, coverage)."""
    spark: SparkSession = docs.sparkSession
    rows = templates()
    hashes = _known_hashes([r[-1] for r in rows])
    table = spark.createDataFrame(
        [(*r, int(h)) for r, h in zip(rows, hashes.view(np.int64), strict=True)],
        "tid int, label string, kind string, grams int, tpos int, tgram string, th bigint",
    )
    src = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").alias("text")
    )
    found = src.mapInArrow(_scan(hashes), "rid bigint, doc_id bigint, n_words bigint, pos bigint, h bigint, gram string")
    # The template table is a constant of this module, so it is always small.
    votes = (
        found.join(F.broadcast(table), (F.col("h") == F.col("th")) & (F.col("gram") == F.col("tgram")), "left")
        .where(F.col("tid").isNotNull() | F.col("n_words").isNotNull())
        .repartition("rid")  # one row's votes meet once; all that follows stays there
    )
    diagonals = votes.groupBy("rid", "tid", (F.col("pos") - F.col("tpos")).alias("diag")).agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.first("label").alias("label"),
        F.first("kind").alias("kind"),
        F.first("grams").alias("grams"),
        F.collect_set("tpos").alias("tpos"),
        F.min("pos").alias("lo"),
        F.max("pos").alias("hi"),
    )
    by_diag = Window.partitionBy("rid", "tid").orderBy("diag")
    merge = F.when(F.col("kind") == "notice", F.lit(MAX_SHIFT)).otherwise(F.lit(0))
    islands = diagonals.withColumn(
        "cut", F.coalesce((F.col("diag") - F.lag("diag").over(by_diag) > merge).cast("int"), F.lit(0))
    ).withColumn("island", F.sum("cut").over(by_diag))
    spans = (
        islands.groupBy("rid", "tid", "island")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("n_words").alias("n_words"),
            F.first("label").alias("label"),
            F.first("kind").alias("kind"),
            F.first("grams").alias("grams"),
            F.size(F.array_distinct(F.flatten(F.collect_list("tpos")))).alias("matched"),
            F.min("lo").alias("first_word"),
            (F.max("hi") + K - 1).alias("last_word"),
        )
        .withColumn("coverage", F.col("matched") / F.col("grams"))
    )
    full = (F.col("kind") != "notice") & (F.col("matched") == F.col("grams"))
    partial = (
        (F.col("kind") == "notice")
        & (F.col("coverage") >= COVERAGE)
        & (F.col("last_word") - F.col("first_word") + 1 <= MAX_STRETCH * (F.col("grams") + K - 1))
    )
    span = F.when(full | partial, F.struct("label", "kind", "first_word", "last_word", "coverage"))
    return (
        spans.groupBy("rid")
        .agg(F.max("doc_id").alias(id_col), F.max("n_words").alias("n_words"), F.collect_list(span).alias("spans"))
        .drop("rid")
    )
