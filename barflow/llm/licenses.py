"""License scans: word k-grams of all texts joined to template positions, votes by diagonal, spans verified."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barflow.llm import text as T
from barflow import session
from barflow.llm.decision_list import window_keys

# Fixed values of the contract.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
# Wording of public licenses and of their usual notices, by label.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files, to deal in the Software without restriction"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("apache-2", "licensed under the Apache License, Version 2.0"),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2", "distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "licensed under a Creative Commons Attribution NonCommercial 4.0 International License"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "dedicated to the public domain under the Creative Commons CC0 1.0 Universal"),
    ("gpl-3", "this work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-sa", "licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("agpl-3", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
     "provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
)
GRAM = 3
# Words of all templates, which go to every task.
MOST_TEMPLATE_WORDS = 100_000
# Diagonals of one span differ by no more than this many inserted or missing words, and no more than a share of the template.
DRIFT, DRIFT_SHARE = 6, 0.25
COVERED = 0.8


def _split(text: str) -> list[str]:
    return re.findall(T.PLAIN_WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text))


def scan(docs: DataFrame, templates=TEMPLATES, covered: float = COVERED) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, spans; one row per row of `docs`.

    `spans` has label, template, first and last word, and score, the share of the template's words found there in order.
    Every text's k-grams are looked up among those of the templates. Where there is one, the text's words go on: each k-gram
    joins the template positions it equals, votes are grouped by diagonal (place in the text minus place in the template),
    neighbouring diagonals merge to an island, and an island's votes are aligned in order (see in_order): a span counts if the
    template's words in it make up `covered` of the template. Repeated copies are spans of their own; words in another order
    are none. The templates are a bounded list of short texts, checked before it is broadcast.

    Null text is empty and has no word; texts without a license have no spans; rows equal in doc_id and text have equal
    results. Long texts stay one array of words each. An empty table gives no rows.
    """
    spark = docs.sparkSession
    df = docs.select("doc_id", T.ascii_lower(T.filled("text")).alias("_t"))
    df = df.select("doc_id", F.xxhash64("_t").alias("h"), T.words(F.col("_t"), T.PLAIN_WORD).alias("words"))
    df = df.withColumn("codes", F.transform("words", lambda w: F.xxhash64(w))).withColumn("joined", F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" ")))
    df = df.withColumn("keys", window_keys("codes", GRAM))

    lists = [(k, label, _split(text)) for k, (label, text) in enumerate(templates)]
    if sum(len(ws) for _, _, ws in lists) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"templates have more than {MOST_TEMPLATE_WORDS} words")
    grams = [(k, label, at, len(ws), ws[at : at + GRAM]) for k, label, ws in lists for at in range(len(ws) - GRAM + 1)]
    index = spark.createDataFrame(grams, "template int, label string, at int, size int, gram array<string>")
    index = index.withColumn("codes", F.transform("gram", lambda w: F.xxhash64(w))).withColumn("key", window_keys("codes", GRAM)[0])
    known = F.array(*(F.lit(r.key) for r in index.select("key").distinct().collect()))

    base = df.select(
        "doc_id", "h", F.size("words").cast("long").alias("n_words"),
        F.when(
            F.col("joined").rlike("|".join(f" {p} " for p in BASE)),
            F.flatten(F.array(*(_places(p, label) for p, label in BASE.items()))),
        ).alias("places"),
        F.when(F.arrays_overlap("keys", known), F.col("words")).alias("words"),
        F.when(F.arrays_overlap("keys", known), F.col("keys")).alias("keys"),
    )
    base = session.settle(base, "licenses")
    place = F.col("places")
    counted = base.select(
        "doc_id", "h", "n_words", F.coalesce(F.size(place), F.lit(0)).cast("long").alias("n_base"),
        F.array_min(F.transform(place, lambda x: x["at"])).cast("long").alias("first_word"),
        F.array_max(F.transform(place, lambda x: x["at"])).cast("long").alias("last_word"),
        F.coalesce(F.array_sort(F.array_distinct(F.transform(place, lambda x: x["label"]))), F.array().cast("array<string>")).alias("base_labels"),
    )

    hits = (
        base.filter("keys is not null").select("doc_id", "h", "words", F.posexplode("keys").alias("pos", "key"))
        .join(F.broadcast(index.select("template", "label", "at", "size", "gram", "key")), "key")
        .filter(F.slice("words", F.col("pos") + 1, GRAM) == F.col("gram"))
        .select("doc_id", "h", "template", "label", "size", "pos", "at", (F.col("pos") - F.col("at")).alias("diagonal"))
        .distinct()
    )
    one = ["doc_id", "h", "template"]
    by = W.partitionBy(*one)
    votes = hits.groupBy(*one, "label", "size", "diagonal").agg(F.collect_list(F.struct("pos", "at")).alias("votes"))
    near = by.orderBy("diagonal")
    drift = F.least(F.lit(DRIFT), F.floor(F.col("size") * DRIFT_SHARE))
    fresh = (F.col("diagonal") - F.lag("diagonal").over(near) > drift).cast("int")
    runs = votes.withColumn("island", F.sum(F.coalesce(fresh, F.lit(1))).over(near.rowsBetween(W.unboundedPreceding, W.currentRow)))
    islands = runs.groupBy(*one, "label", "size", "island").agg(F.array_sort(F.flatten(F.collect_list("votes"))).alias("votes"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    session.ship(spark)
    shape = f"doc_id {kind}, h bigint, first int, last int, label string, template int, score double"
    spans = islands.mapInPandas(_verified(covered), shape)
    spans = spans.groupBy("doc_id", "h").agg(
        F.sort_array(F.collect_list(F.struct("first", "last", "label", "template", "score"))).alias("spans")
    )
    keys = spans.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "spans").hint("merge")
    out = counted.join(keys, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    return out.drop("_id", "_h", "h")


def in_order(votes: list[tuple[int, int]], size: int, covered: float = COVERED) -> list[tuple[int, int, float]]:
    """First and last word and score of every span among (place in the text, place in the template) of equal k-grams.

    A span starts at a vote, and has the votes near that diagonal within a template's length; those that rise in both, as
    many as possible, are an alignment in order, and the words of the template in it are counted once. The next span starts behind it.
    """
    drift = min(DRIFT, int(size * DRIFT_SHARE))
    votes = sorted(set(votes))
    found, k = [], 0
    while k < len(votes):
        pos, at = votes[k]
        chains: list[tuple[int, int]] = []  # for each length, the vote a chain of it ends with at the earliest place of the template
        ends: list[int] = []
        before: dict[tuple[int, int], tuple[int, int] | None] = {}
        i = k
        while i < len(votes) and votes[i][0] <= pos - at + size - GRAM + drift:
            same = i
            while same < len(votes) and votes[same][0] == votes[i][0]:
                same += 1
            for vote in reversed(votes[i:same]):  # a word of the text takes one place only
                if abs((vote[0] - vote[1]) - (pos - at)) <= drift and vote >= votes[k]:
                    n = bisect_left(ends, vote[1])
                    before[vote] = chains[n - 1] if n else None
                    ends[n : n + 1], chains[n : n + 1] = [vote[1]], [vote]
            i = same
        path, vote = [], chains[-1] if chains else None
        while vote is not None:
            path.append(vote)
            vote = before[vote]
        score = len({a + j for _, a in path for j in range(GRAM)}) / size
        if score >= covered:
            last = path[0][0] + GRAM - 1
            found.append((path[-1][0], last, score))
            while k < len(votes) and votes[k][0] <= last:
                k += 1
        else:
            k += 1
    return found


def _verified(covered: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, h, label, template, size, votes in zip(*(batch[c] for c in ("doc_id", "h", "label", "template", "size", "votes")), strict=True):
                rows += [(doc_id, h, a, b, label, template, score) for a, b, score in in_order([(v["pos"], v["at"]) for v in votes], size, covered)]
            out = pd.DataFrame(rows, columns=["doc_id", "h", "first", "last", "label", "template", "score"])
            yield out.assign(doc_id=out["doc_id"].astype(batch["doc_id"].dtype))

    return run


def _places(phrase: str, label: str):
    """Places where the phrase's words stand consecutively, for a text that has one of the phrases."""
    ws = phrase.split()
    words = F.col("words")
    starts = F.filter(
        F.transform(words, lambda w, i: F.when(w == ws[0], i)),
        lambda i: i.isNotNull() & (F.slice(words, F.coalesce(i, F.lit(0)) + 1, len(ws)) == F.array(*map(F.lit, ws))),
    )
    return F.transform(starts, lambda i: F.struct(F.lit(label).alias("label"), i.alias("at")))


def labels(scanned: DataFrame) -> DataFrame:
    """scan()'s rows with labels (base and spans, distinct and sorted) and score: 1 with a base phrase, else the best span's."""
    found = F.coalesce("spans", F.array().cast(scanned.schema["spans"].dataType))
    every = F.array_sort(F.array_distinct(F.concat("base_labels", F.transform(found, lambda s: s["label"]))))
    best = F.array_max(F.transform(found, lambda s: s["score"]))
    return scanned.withColumn("labels", every).withColumn(
        "score", F.when(F.size("base_labels") > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0)))
    )
