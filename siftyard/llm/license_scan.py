"""License scans by diagonal voting.

Every text's words become codes of the templates' vocabulary (0: in no template); the hashes of all rolling k-grams are
joined in Spark to the template positions that have them, and the k codes beside a hash are compared one by one. A hit at
word p of the text and word t of the template votes for the diagonal p - t. Votes are gathered by diagonal; on one diagonal
each position of the template stands once, so such a row is no longer than the template however often the text repeats it.

Spans are verified with order and place: neighbouring diagonals of a template (words may be missing or added in between) are
merged by chains of hits in which both the place in the text and the position in the template rise and every step changes
the diagonal by `SLACK` at most. The share of template words that the best chain covers must reach `min_cover`. Base phrases
are looked for word by word beside this.

The template index is a constant of this module (or the caller's own list, whose number of positions is checked), so its
broadcast does not grow with the data. A k-gram's row carries its own k codes and nothing else of the text; k-grams with a
word that is in no template can hit nothing and are not made rows. What comes together for a text is its hits.

Edge cases: null and empty texts have no words; score 0, labels empty. Repeated rows give a row each. Other columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftyard.llm.common import item_words, read, utf8
from siftyard.llm.hashing import mix, signed

K, SLACK, MIN_COVER = 5, 3, 0.8
MAX_POSITIONS = 200_000
#: Phrases whose places are counted, and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
#: Well-known public notices, (label, text).
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
)

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


class Templates:
    def __init__(self, templates=TEMPLATES, k: int = K):
        self.k, self.labels, self.codes = k, [], []
        self.vocabulary: dict[bytes, int] = {}
        for label, text in templates:
            words = item_words(text.encode())
            if len(words) >= k:
                self.labels.append(label)
                self.codes.append([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words])
        if sum(map(len, self.codes)) > MAX_POSITIONS:
            raise ValueError(f"templates of more than {MAX_POSITIONS} words")

    def grams(self, codes: np.ndarray) -> np.ndarray:
        n = len(codes) - self.k + 1
        h = np.zeros(max(0, n), np.uint64)
        for i in range(self.k if n > 0 else 0):
            h = mix(h + codes[i : n + i].astype(np.uint64) + np.uint64(1))
        return signed(h)

    def index(self) -> list[tuple]:
        """(hash, template, position, codes) of every k-gram."""
        return [(int(h), t, i, own[i : i + self.k]) for t, own in enumerate(self.codes) for i, h in enumerate(self.grams(np.array(own)))]


def base_places(words: list[bytes], phrases) -> list[tuple[int, str]]:
    """(start, label) of every place of a phrase."""
    out = []
    for phrase, label in phrases:
        own = phrase.encode().split()
        i = -1
        try:
            while True:
                i = words.index(own[-1], i + 1)
                start = i - len(own) + 1
                if start >= 0 and words[start : i + 1] == own:
                    out.append((start, label))
        except ValueError:
            pass
    return out


def chained(diagonals: dict[int, list[int]], k: int, slack: int) -> int:
    """Words of a template that the best chain of hits covers; from the positions of the hits on each diagonal."""
    best, most = {}, 0
    for position, diagonal in sorted((t, d) for d, own in diagonals.items() for t in own):
        value = k
        for d in range(diagonal - slack, diagonal + slack + 1):
            for (t, covered) in best.get(d, ()):
                if t < position and t + d < position + diagonal:
                    value = max(value, covered + min(k, position - t))
        best.setdefault(diagonal, []).append((position, value))
        most = max(most, value)
    return most


def verified(hits: list, templates: Templates, slack: int = SLACK, min_cover: float = MIN_COVER) -> dict[str, float]:
    """Label -> best cover, from (template, diagonal, positions in the template)."""
    best: dict[str, float] = {}
    by_template: dict[int, dict[int, list[int]]] = {}
    for hit in hits:
        by_template.setdefault(hit["template"], {})[hit["diagonal"]] = hit["positions"]
    for t, own in by_template.items():
        near: dict[int, list[int]] = {}  # a run of diagonals, each within `slack` of the one before
        for d in [*sorted(own), None]:
            if near and (d is None or d - last > slack):
                cover = chained(near, templates.k, slack) / len(templates.codes[t])
                if cover >= min_cover:
                    best[templates.labels[t]] = max(best.get(templates.labels[t], 0.0), cover)
                near = {}
            if d is not None:
                near[d], last = own[d], d
    return best


_GRAMS = pa.list_(pa.struct([("place", pa.int32()), ("gram", pa.int64()), ("own", pa.list_(pa.int32()))]))


def _rolled(codes: list[np.ndarray], known: Templates) -> pa.Array:
    """Per text the k-grams of template words; before them one of place -1, which stands for the text itself."""
    k, place, gram, own, ends = known.k, [], [], [], [0]
    for c in codes:
        h = known.grams(c)
        outside = np.concatenate([[0], np.cumsum(c == 0)])
        at = np.flatnonzero(outside[k : k + len(h)] == outside[: len(h)])
        place += [np.array([-1]), at]
        gram += [np.array([0]), h[at]]
        own.append(np.zeros(k, np.int32))
        own.append(c[at[:, None] + np.arange(k)].ravel())
        ends.append(ends[-1] + 1 + len(at))
    if not codes:
        return pa.array([], _GRAMS)
    own = pa.ListArray.from_arrays(pa.array(np.arange(0, k * ends[-1] + 1, k), pa.int32()), pa.array(np.concatenate(own), pa.int32()))
    rows = pa.StructArray.from_arrays([pa.array(np.concatenate(place), pa.int32()), pa.array(np.concatenate(gram), pa.int64()), own], fields=list(_GRAMS.value_type))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)


def license_scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """Per document: words, base places and labels, all labels, score (1 for a base phrase, else the best cover)."""
    spark, known = docs.sparkSession, Templates(templates)

    def words(batches):
        get = known.vocabulary.get
        for batch in batches:
            n, base, codes = [], [], []
            for text in utf8(batch, "text"):
                own = item_words(text)
                at = base_places(own, phrases)
                n.append(len(own))
                base.append((len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))))
                codes.append(np.fromiter((get(w, 0) for w in own), np.int32, len(own)))
            b = list(zip(*base, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("uid"), pa.array(n, pa.int64()), *(pa.array(x, pa.int64()) for x in b[:3]), pa.array(b[3], pa.string()), _rolled(codes, known)],
                ["doc_id", "uid", "n_words", "n_base", "first_word", "last_word", "base_labels", "grams"],
            )

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("uid"), "text")
    schema = "doc_id long, uid long, n_words long, n_base long, first_word long, last_word long, base_labels string"
    told = source.mapInArrow(words, schema + ", grams array<struct<place:int,gram:long,own:array<int>>>")
    index = spark.createDataFrame(known.index(), "gram long, template int, position int, own array<int>")
    index = index.groupBy("gram").agg(F.collect_list(F.struct("template", "position", "own")).alias("at"))
    base = [x.split()[0] for x in schema.split(", ") if not x.startswith("uid")]
    rows = told.select("uid", F.struct(*base).alias("base"), F.explode("grams").alias("x")).select("uid", "base", "x.*")
    rows = rows.join(F.broadcast(index), "gram", "left").filter("place < 0 or at is not null")
    itself = F.col("place") < 0
    rows = rows.select("uid", "place", F.when(itself, F.col("base")).alias("base"), F.when(~itself, F.filter("at", lambda x: x["own"] == F.col("own"))).alias("at"))
    rows = rows.select("uid", "place", "base", F.explode_outer("at").alias("x")).filter("place < 0 or x is not null")
    rows = rows.select("uid", "base", F.col("x.template").alias("template"), F.col("x.position").alias("position"), (F.col("place") - F.col("x.position")).alias("diagonal"))
    votes = rows.groupBy("uid", "template", "diagonal").agg(F.first("base", ignorenulls=True).alias("base"), F.collect_set("position").alias("positions"))
    hit = F.when(F.col("template").isNotNull(), F.struct("template", "diagonal", "positions"))
    found = votes.groupBy("uid").agg(F.first("base", ignorenulls=True).alias("base"), F.collect_list(hit).alias("hits")).select("base.*", "hits")

    def finish(batches):
        for batch in batches:
            labels, score = [], []
            for base_labels, n_base, hits in zip(*(batch.column(x).to_pylist() for x in ("base_labels", "n_base", "hits")), strict=True):
                best = verified(hits, known) if hits else {}
                labels.append(",".join(sorted(best.keys() | set(filter(None, base_labels.split(","))))))
                score.append(1.0 if n_base else max(best.values(), default=0.0))
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in base), pa.array(labels, pa.string()), pa.array(score, pa.float64())], [*base, "labels", "score"])

    return found.mapInArrow(finish, SCHEMA)


def op3_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents"))
