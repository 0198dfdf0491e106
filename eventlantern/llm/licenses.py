"""License scanning: an exact set-similarity join of text blocks with license templates.

A block is a line of at most LINE_WORDS words, or as many consecutive words as the template has, wherever
they stand, over line ends too. A template is found in a block if the block holds at least `threshold` of
the template's distinct words. Words are ranked by how many documents hold them, rarest first. Of a
template of n words that needs o matches, the n - o + 1 rarest are its prefix: a block without any of
them cannot qualify. So the prefixes make an inverted index, a row for each word and template, and the
places of texts where such a word stands are joined with it by that word. Pairs are held against the
bounds of length and position, then counted exactly.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
TEMPLATES = (
    ("agpl", "licensed under the gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("cc-by", "licensed under a creative commons attribution license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc0", "dedicated to the public domain under cc0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl", "subject to the terms of the mozilla public license"),
    ("reserved", "all rights reserved"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
     "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
     "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above "
     "copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
     "in the documentation and or other materials provided with the distribution"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
)
THRESHOLD = 0.9
LINE_WORDS = 64  # a longer line is read by its windows alone
BROADCAST_ROWS = 100_000  # of the index; one that is larger is joined by a shuffle


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text.cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(low: Column) -> Column:
    """Runs of WORD's characters, as what stands between runs of others: the far faster search of the two."""
    return F.array_remove(F.split(low, f"{NOT_WORD}+"), "")


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def document_frequencies(docs: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """How many documents hold each word of the vocabulary, over all of docs; as many rows as words."""
    held = F.array_intersect(words(lowered(F.col("text"))), strings(vocabulary))
    return {r[0]: r[1] for r in docs.select(F.explode(held).alias("w")).groupBy("w").count().collect()}


INDEX = "token string, label string, own array<string>, need int, n int, place int, aligned int"


def prefix_index(spark: SparkSession, templates, rank: dict[str, int], threshold: float) -> tuple[DataFrame, dict[str, int]]:
    """(INDEX's columns, the longest template of each prefix word): a row for each template and word of its prefix.

    own: the template's distinct words, rarest first. need: how many a block must hold. n: its words in
    all. place: where the word stands in own. aligned: where it stands first in the template.
    """
    rows, longest = [], {}
    for label, text in templates:
        w = text.split()
        own = sorted(set(w), key=rank.get)
        need = ceil(threshold * len(own) - 1e-9)
        for k, token in enumerate(own[: len(own) - need + 1]):
            rows.append(F.struct(F.lit(token), F.lit(label), strings(own), F.lit(need), F.lit(len(w)), F.lit(k), F.lit(w.index(token))))
            longest[token] = max(longest.get(token, 0), len(w))
    names = [c.split()[0] for c in INDEX.split(", ")]
    index = spark.range(1).select(F.inline(F.array(*rows)).alias(*names))
    return (F.broadcast(index) if len(rows) <= BROADCAST_ROWS else index), longest


def blocks(low: Column, w: Column, longest: dict[str, int]) -> Column:
    """array<struct<token, near, at>>: every place of a prefix word, with the words around it.

    at is the word's place in near; for a line, near is all of it and at is null.
    """
    tokens = sorted(longest)
    size = F.create_map(*[x for t in tokens for x in (F.lit(t), F.lit(longest[t]))])

    def opens(x: Column) -> Column:
        return x.isin(*tokens)

    def around(i: Column) -> Column:
        most = size[F.get(w, i)]
        start = F.greatest(i - most + 1, F.lit(0))
        return F.struct(F.get(w, i).alias("token"), F.slice(w, start + 1, i - start + most).alias("near"), (i - start).alias("at"))

    def line(x: Column) -> Column:
        return F.transform(F.array_distinct(F.filter(x, opens)), lambda t: F.struct(t.alias("token"), x.alias("near"), F.lit(None).cast("int").alias("at")))

    places = F.transform(F.filter(F.transform(w, lambda x, i: F.when(opens(x), i)), lambda i: i.isNotNull()), around)
    lines = F.filter(F.transform(F.split(low, "\n"), words), lambda x: (F.size(x) <= LINE_WORDS) & F.exists(x, opens))
    none = F.array().cast("array<struct<token:string,near:array<string>,at:int>>")
    return F.when(F.exists(w, opens), F.concat(places, F.flatten(F.transform(lines, line)))).otherwise(none)


def containment(order: list[str]) -> Column:
    """Of a block joined with INDEX's columns: the share of the template's words that it holds, null below the threshold.

    A window is the n words from some start that reach to the word at hand. The one that is aligned with
    the template is looked at first; the others only if they could hold more.
    """
    own, need, n, at, near = (F.col(c) for c in ("own", "need", "n", "at", "near"))
    here = F.when(at.isNull(), near).otherwise(F.slice(near, F.greatest(at - n + 1, F.lit(0)) + 1, F.least(at, n - 1) + n))
    ranked = F.array_intersect(strings(order), here)
    after = F.least(F.size(own) - F.col("place"), F.size(ranked) - F.array_position(ranked, F.col("token")).cast("int") + 1)
    most = F.size(F.array_intersect(own, here))

    def held(start: Column) -> Column:
        return F.size(F.array_intersect(F.slice(near, start + 1, n), own))

    straight = held(F.greatest(at - F.col("aligned"), F.lit(0)))
    every = F.array_max(F.transform(F.sequence(F.greatest(at - n + 1, F.lit(0)), at), held))
    shared = F.when(at.isNull() | (straight == most), most).otherwise(every)
    fits = (F.size(here) >= need) & (after >= need) & (most >= need)
    return F.when(fits, F.when(shared >= need, shared / F.size(own)))


def places(w: Column, phrase: str) -> Column:
    """Starts, in words, of every place where the words of the phrase stand consecutively."""
    parts = phrase.split()

    def here(i: Column) -> Column:
        test = F.get(w, i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            test = test & (F.get(w, i + k) == p)
        return F.coalesce(test, F.lit(False))

    return F.filter(F.sequence(F.lit(0), F.size(w) - 1), here)


def license_labels(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of docs(doc_id, text).

    Null or empty text has no word. score is 1 where a base phrase stands, else the largest containment
    among the templates found, else 0. Texts are read whole, however long; what is moved of them is the
    words around prefix words. Words of equal frequency are ranked by letter. Repeated rows each come back;
    an empty table gives an empty result. Columns other than doc_id and text are not looked at. templates:
    rows (label, words); a label may have several.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    seen = document_frequencies(docs, vocabulary)
    order = sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))
    index, longest = prefix_index(spark, templates, {w: k for k, w in enumerate(order)}, threshold)
    gap = rf"{NOT_WORD}+"
    maybe = "|".join(gap.join(p.split()) for p, _ in PHRASES)
    w = F.col("words")
    starts = F.when(F.col("low").rlike(maybe), F.array(*[places(w, p) for p, _ in PHRASES]))
    rows = docs.select("doc_id", lowered(F.col("text")).alias("low")).select("doc_id", "low", words(F.col("low")).alias("words"))
    rows = rows.select("doc_id", F.size(w).cast("long").alias("n_words"), starts.alias("starts"), blocks(F.col("low"), w, longest).alias("blocks"))
    flat = F.coalesce(F.flatten("starts"), F.array().cast("array<int>"))
    base = F.coalesce(F.filter(F.array(*[F.when(F.size(F.get("starts", F.lit(k))) > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES)]), lambda x: x.isNotNull()), strings([]))
    told = F.struct("doc_id", "n_words", F.size(flat).cast("long").alias("n_base"), F.array_min(flat).cast("long").alias("first_word"), F.array_max(flat).cast("long").alias("last_word"), F.array_distinct(base).alias("base"))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), told.alias("told"), "blocks").select("row", "told", F.explode_outer("blocks").alias("b"))
    pairs = rows.select("row", "told", "b.*").join(index, "token", "left").withColumn("share", containment(order))
    found = pairs.groupBy("row").agg(F.first("told").alias("told"), F.collect_set(F.when(F.col("share").isNotNull(), F.col("label"))).alias("found"), F.max("share").alias("share"))
    labels = F.array_sort(F.array_union("told.base", "found"))
    return found.select(
        "told.doc_id", "told.n_words", "told.n_base", "told.first_word", "told.last_word", F.array_join(F.array_sort("told.base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.when(F.col("told.n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
