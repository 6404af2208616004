"""Licence scans by a positional rare-token index, with DataFrame functions alone.

Every template keeps its ``RARE`` words of highest IDF, which is counted over all scanned
files, with their positions. A label needs ``AGREE`` of a template's distinct rare words on
one alignment, so the rarest of them (its anchors) can't all be missing: a file that holds
an anchor looks up all places of all rare words of that template. Postings with the same
relative position (place in the file less place in the template) support one alignment, and
the templates that reach ``AGREE`` are labels where their mandatory key phrase stands in the
file as well. Files without anchors are never scanned for templates. Base phrases are counted
besides.

Defined results: a null text is the empty text (no words, empty labels, score 0); a null
doc_id is kept; repeated rows give repeated results; letters beyond A-Z keep their case.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_az
from .store import Store

RARE, AGREE = 8, 0.5
#: The words' separators, the base phrases with their labels.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Label, mandatory key phrase, standard notice.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("mit", "under the mit license", "released under the mit license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl", "under the terms of the gnu general public license", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl-3.0", "gnu general public license version 3", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "gnu lesser general public license", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "gnu affero general public license", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("isc", "permission to use copy modify and or distribute this software", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "released into the public domain", "this is free and unencumbered software released into the public domain"),
    ("cc-by", "creative commons attribution", "this work is licensed under a creative commons attribution 4 0 international license"),
)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_az(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _places(words: str, phrase: str) -> Column:
    """Starts (from 0) where the phrase's words stand consecutively."""
    parts = phrase.split()
    starts = F.sequence(F.lit(0), F.size(words) - len(parts))

    def here(i):
        test = F.get(words, i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            test = test & (F.get(words, i + k) == p)
        return test

    possible = (F.size(words) >= len(parts)) & F.array_contains(words, parts[-1]) & F.array_contains(words, parts[0])
    return F.when(possible, F.filter(starts, here)).otherwise(F.array().cast("array<int>"))


def _labelled(places: Column, label: str) -> Column:
    return F.transform(places, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))


def _strings(values) -> Column:
    return F.array(*map(F.lit, values))


def scan_licenses(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every whole text."""
    store = Store(spark, "licenses")
    vocabulary = sorted({w for _, _, t in TEMPLATES for w in t.split()})  # a few hundred words, fixed
    words = docs.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words"))
    held = words.select(F.explode(F.array_intersect("words", _strings(vocabulary))).alias("word"))
    seen = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}  # a row for each template word at most
    total = docs.count()
    idf = {w: math.log((total + 1) / (seen.get(w, 0) + 1)) for w in vocabulary}
    postings, rare_words, anchors = [], [], []
    for t, (_, _, notice) in enumerate(TEMPLATES):
        parts = notice.split()
        rare = sorted(set(parts), key=lambda w: (-idf[w], w))[:RARE]
        postings += [(t, w, i, idf[w], len(rare)) for i, w in enumerate(parts) if w in rare]
        rare_words.append(rare)
        anchors.append(rare[: len(rare) - math.ceil(AGREE * len(rare)) + 1])
    index = spark.createDataFrame(postings, "template int, word string, at int, idf double, rare int")

    # look up: the templates with an anchor in the file, then all places of their rare words
    none = F.array().cast("array<string>")
    marked = words.withColumn("held", F.array_intersect("words", _strings(sorted({w for a in anchors for w in a}))))
    looked_up = [F.arrays_overlap("held", _strings(a)) for a in anchors]
    own = F.array_distinct(F.flatten(F.array(*(F.when(F.get("looked_up", F.lit(t)), _strings(w)).otherwise(none) for t, w in enumerate(rare_words)))))
    base = [(_places("words", p), label) for p, label in BASE.items()]
    marked = marked.withColumn("base", F.flatten(F.array(*(_labelled(places, label) for places, label in base))))
    marked = marked.withColumn("looked_up", F.when(F.size("held") > 0, F.array(*looked_up)))
    phrases = F.array(*(F.when(F.get("looked_up", F.lit(t)), F.size(_places("words", phrase)) > 0) for t, (_, phrase, _) in enumerate(TEMPLATES)))
    marked = marked.withColumn("own", F.when(F.col("looked_up").isNotNull(), own)).withColumn("phrases", F.when(F.col("looked_up").isNotNull(), phrases))
    keys = [F.xxhash64("words").alias("text_key")]  # rows that repeat a doc_id stay apart
    slim = marked.select(
        "id", F.size("words").cast("long").alias("n_words"), F.transform("base", lambda b: b["at"]).alias("starts"), F.array_sort(F.array_distinct(F.transform("base", lambda b: b["label"]))).alias("base_list"),
        F.when(F.size("own") > 0, F.filter(F.transform("words", lambda w, i: F.when(F.array_contains("own", w), F.struct(i.alias("place"), w.alias("word")))), lambda s: s.isNotNull())).alias("places"),
        "phrases", *keys,
    )
    slim = store.put(slim, "files")
    candidates = slim.where("places is not null").select("id", "text_key", "phrases", "places").dropDuplicates(["id", "text_key"])
    hits = candidates.select("id", "text_key", F.explode("places").alias("p")).select("id", "text_key", F.col("p.place").alias("place"), F.col("p.word").alias("word"))
    hits = hits.join(F.broadcast(index), "word")  # the index: RARE words of each template
    aligned = hits.groupBy("id", "text_key", "template", (F.col("place") - F.col("at")).alias("shift")).agg(F.count_distinct("word").alias("n"), F.max("rare").alias("rare"))
    agreed = aligned.groupBy("id", "text_key", "template").agg(F.max(F.col("n") / F.col("rare")).alias("share")).where(F.col("share") >= AGREE)
    # verify: the key phrases of the templates that agree
    of = candidates.select(F.col("id").alias("of"), F.col("text_key").alias("of_key"), "phrases")
    scored = agreed.join(of, F.col("id").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("of_key"))).where(F.get("phrases", F.col("template")))
    names = _strings(t[0] for t in TEMPLATES)
    found = scored.groupBy("id", "text_key").agg(F.collect_set(F.get(names, F.col("template"))).alias("found"), F.max("share").alias("share")).select(F.col("id").alias("hit"), F.col("text_key").alias("hit_key"), "found", "share")
    out = slim.join(found, F.col("id").eqNullSafe(F.col("hit")) & (F.col("text_key") == F.col("hit_key")), "left")
    labels = F.array_sort(F.array_union("base_list", F.coalesce("found", F.array().cast("array<string>"))))
    strength = F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.size("starts") > 0, 0.5).otherwise(0.0))
    return out.select(
        F.col("id").alias(id_col), "n_words", F.size("starts").cast("long").alias("n_base"), F.array_min("starts").cast("long").alias("first_word"), F.array_max("starts").cast("long").alias("last_word"),
        F.array_join("base_list", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), F.least(strength, F.lit(1.0)).alias("score"),
    )
