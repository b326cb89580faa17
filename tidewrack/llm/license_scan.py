"""License scan by diagonal voting.

All rolling word k-gram hashes of the texts are joined to the places of equal k-grams in
the templates.  A pair votes for the diagonal place-in-text minus place-in-template;
votes are summed by diagonal, neighbouring diagonals are merged, and a merged span is
verified by the share of its template's k-grams that it covers.  Diagonals that chance
votes chain to more than two lengths of the template are cut apart around the strongest
one.  A short phrase stands where its diagonal has a vote for each of its k-grams.

The template k-grams are a small fixed set, so the join begins as a semi-join in the text
kernel: texts send on only hashes that are among them; others would find nothing.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrow_text import ALNUM_WORDS, Texts, column, slices, windows
from .store import keep

K = 3
#: Diagonals this close are one span: words were put in or left out.
MERGE = 4
#: Least share of a template's k-grams in a span.
COVER = 0.5
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Phrase and the label it proves wherever it stands.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: Opening or grant paragraphs of public licenses.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution NonCommercial International License"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
]


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.translate({c: c + 32 for c in range(65, 91)}))


def grams(texts: list[str]) -> list[np.ndarray]:
    """The k-gram hashes of each text, as the scan makes them."""
    raw = [t.encode() for t in texts]
    t = Texts(np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw]))).lowered()
    starts, ends, rows = t.words(ALNUM_WORDS)
    h, at = windows(t.hashes(starts, ends), rows, K)
    return [h[rows[at] == k].view(np.int64) for k in range(t.n)]


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """key, n_words, n_base, first_word, last_word, base_labels, labels, score and spans.

    spans holds (label, first word, last word, share covered) of the verified templates.
    A null text counts as empty; each row keeps its own line, repeated rows and null keys
    too, as they are followed by a row number.  Texts are read whole, whatever their
    length.  Only ``key`` and ``text`` of the input are used, so other columns can't clash.
    An empty table gives an empty one; without phrases or templates nothing is found.
    Of diagonals with equally many votes, an over-wide chain is cut around the least one.
    """
    spark = df.sparkSession
    kind = df.schema[key].dataType.simpleString()
    named = [*((p, label, True) for p, label in phrases), *((t, label, False) for label, t in templates)]
    hashes = grams([t for t, _, _ in named])
    places = [(int(h), k, p) for k, own in enumerate(hashes) for p, h in enumerate(own.tolist())]
    known = np.unique(np.array([h for h, _, _ in places], np.int64))

    def roll(batches):
        for b in batches:
            keys = b.column(0)
            for i, j, t in slices(column(b, text)):
                t = t.lowered()
                starts, ends, rows = t.words(ALNUM_WORDS)
                h, at = windows(t.hashes(starts, ends), rows, K)
                h = h.view(np.int64)
                hit = known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)
                first = np.searchsorted(rows, np.arange(t.n))
                h, at = h[hit], at[hit]
                row = rows[at]
                off = pa.array(np.searchsorted(row, np.arange(t.n + 1)).astype(np.int32))
                pairs = pa.StructArray.from_arrays([pa.array((at - first[row]).astype(np.int64)), pa.array(h)], names=["pos", "h"])
                yield pa.RecordBatch.from_arrays([keys.slice(i, j - i), pa.array(np.bincount(rows, minlength=t.n)), pa.ListArray.from_arrays(off, pairs)], names=[key, "n_words", "hits"])

    rolled = df.select(key, text).mapInArrow(roll, f"`{key}` {kind}, n_words long, hits array<struct<pos: long, h: long>>")
    rolled = keep(rolled.withColumn("row", F.monotonically_increasing_id()), "license-grams")
    # as many rows as the templates have k-grams
    template = spark.createDataFrame(places, "h long, template int, tpos long")
    about = spark.createDataFrame([(k, label, base, len(hashes[k]), len(words_of(t))) for k, (t, label, base) in enumerate(named)], "template int, label string, base boolean, grams int, words int")
    votes = rolled.where(F.size("hits") > 0).select("row", F.explode("hits").alias("x")).select("row", "x.pos", "x.h").join(F.broadcast(template), "h")
    lines = votes.groupBy("row", "template", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(F.count("*").alias("votes"), F.min("pos").alias("lo"), F.max("pos").alias("hi")).join(F.broadcast(about), "template")
    base = lines.where(F.col("base") & (F.col("votes") == F.col("grams"))).select("row", "label", F.lit(True).alias("base"), F.col("diagonal").alias("at"), (F.col("diagonal") + F.col("words") - 1).alias("to"), F.lit(1.0).alias("share"))
    ordered = Window.partitionBy("row", "template").orderBy("diagonal")
    clustered = (
        lines.where(~F.col("base"))
        .withColumn("new", F.coalesce((F.col("diagonal") - F.lag("diagonal").over(ordered) > MERGE).cast("int"), F.lit(1)))
        .withColumn("cluster", F.sum("new").over(ordered))
    )
    own = Window.partitionBy("row", "template", "cluster")
    wide = F.max("hi").over(own) + K - F.min("lo").over(own) > 2 * F.col("words")
    peak = F.max_by("diagonal", F.struct("votes", -F.col("diagonal"))).over(own)
    merged = (
        clustered.withColumn("part", F.when(wide, F.floor((F.col("diagonal") - peak) / F.col("words") + 0.5)).otherwise(0))
        .groupBy("row", "template", "label", "grams", "words", "cluster", "part")
        .agg(F.sum("votes").alias("votes"), F.min("lo").alias("at"), (F.max("hi") + K - 1).alias("to"))
        .withColumn("share", F.least(F.lit(1.0), F.col("votes") / F.col("grams")))
        .where(F.col("share") >= COVER)
        .select("row", "label", F.lit(False).alias("base"), "at", "to", "share")
    )
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    is_base = F.col("base")
    found = base.unionByName(merged).groupBy("row").agg(
        F.sum(is_base.cast("long")).alias("n_base"), F.min(F.when(is_base, F.col("at"))).alias("first_word"), F.max(F.when(is_base, F.col("at"))).alias("last_word"),
        names(F.when(is_base, F.col("label"))).alias("base_labels"), names("label").alias("labels"), F.max("share").alias("score"),
        F.array_sort(F.collect_list(F.when(~is_base, F.struct("label", "at", "to", "share")))).alias("spans"),
    )
    return rolled.select("row", key, "n_words").join(found, "row", "left").select(
        key, "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), "spans"
    )
