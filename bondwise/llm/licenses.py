"""License scan by diagonal voting, in DataFrame operations only.

Every run of k consecutive words of a document is joined by its hash, and then by its words, to the places where a template has it. A
match votes for the diagonal (document place minus template place). Votes of one diagonal are one straight copy; neighbouring diagonals
of a template, at most ``GAP`` words apart, are merged into one span, which bridges inserted or missing words. A span counts when its
matches cover ``COVER`` of the template's words and ``DENSE`` of its own.

The base phrases are templates too: a place of a phrase is a diagonal on which all of its runs voted. k is ``K``, or a template's
number of words where that is smaller.

The broadcast side is the template list, whose words are checked against ``MAX_TEMPLATE_WORDS``.

Nulls and edges: a null or empty text has no words, no labels and score 0; rows repeated in full and rows with a null doc_id are scanned
one by one; a document of any length is scanned whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bondwise.llm.text import LOWER, UPPER, WORD, ascii_lower

K, GAP, COVER, DENSE = 3, 3, 0.8, 0.6
MAX_TEMPLATE_WORDS = 100_000

# fixed values: phrases whose every place is reported
PHRASES = [
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
]

# fixed values: wording of public licenses and of the notices that point to them
TEMPLATES = [
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]


def template_words(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def _grams(spark, templates: list[tuple[str, str, bool]], k: int) -> tuple[DataFrame, list[int]]:
    """One row per template run: (t_k, t_hash, t_gram, t_pos, template, label, base, t_words)."""
    rows, widths = [], set()
    for number, (label, text, base) in enumerate(templates):
        words = template_words(text)
        width = min(k, len(words))
        if width:
            widths.add(width)
            rows += [(width, " ".join(words[p : p + width]), p, number, label, base, len(words)) for p in range(len(words) - width + 1)]
    if len(rows) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates of more than {MAX_TEMPLATE_WORDS} words are not broadcast")
    kinds = "t_k int, t_gram string, t_pos int, template int, label string, base boolean, t_words int"
    return spark.createDataFrame(rows, kinds).withColumn("t_hash", F.xxhash64("t_gram")), sorted(widths)


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES, k: int = K) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) for every row of ``docs``."""
    grams, widths = _grams(docs.sparkSession, [(a, b, True) for a, b in phrases] + [(a, b, False) for a, b in templates], k)
    words = F.regexp_extract_all(ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), words.alias("w"))
    # place -1 carries the document itself through the join, whether or not anything matches
    at = own.select("row", "doc_id", "w", F.explode(F.sequence(F.lit(-1), F.size("w") - 1)).alias("pos"))
    gram = lambda width: F.concat_ws(" ", *[F.get("w", F.col("pos") + i) for i in range(width)])
    inside = lambda width: (F.col("pos") >= 0) & (F.col("pos") + width <= F.size("w"))
    runs = F.array(*[F.struct(F.lit(x).alias("k"), F.when(inside(x), gram(x)).alias("gram")) for x in widths])
    rows = at.select("row", "doc_id", "pos", F.size("w").alias("n"), F.explode(runs).alias("r")).select("row", "doc_id", "pos", "n", "r.k", "r.gram")
    same = (F.xxhash64("gram") == F.col("t_hash")) & (F.col("k") == F.col("t_k")) & (F.col("gram") == F.col("t_gram"))
    met = rows.join(F.broadcast(grams), same, "left")
    hits = met.filter(F.col("template").isNotNull() | ((F.col("pos") == -1) & (F.col("k") == widths[0])))
    return _voted(hits.select("row", "doc_id", "pos", "n", "k", "t_pos", "template", "label", "base", "t_words").repartition("row"))


def _voted(hits: DataFrame) -> DataFrame:
    """All steps keep a document's rows together, so they share the one exchange above."""
    diagonal = F.col("pos") - F.col("t_pos")
    votes = hits.groupBy("row", "doc_id", "template", "label", "base", "t_words", "k", diagonal.alias("diagonal")).agg(
        F.max("n").alias("n"), F.min("pos").alias("first"), F.max(F.col("pos") + F.col("k") - 1).alias("last"),
        F.collect_set("t_pos").alias("t_at"), F.collect_set("pos").alias("d_at"),
    )
    full = F.col("base") & (F.size("t_at") == F.col("t_words") - F.col("k") + 1)
    here = W.partitionBy("row", "template").orderBy("diagonal")
    steps = votes.withColumn("full", full).withColumn("step", F.coalesce(F.col("diagonal") - F.lag("diagonal").over(here) > GAP, F.lit(False)).cast("int"))
    steps = steps.withColumn("cluster", F.sum("step").over(here.rowsBetween(W.unboundedPreceding, 0)))
    merged = steps.groupBy("row", "doc_id", "template", "label", "base", "t_words", "k", "cluster").agg(
        F.max("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"),
        F.flatten(F.collect_list("t_at")).alias("t_at"), F.flatten(F.collect_list("d_at")).alias("d_at"),
        F.count_if("full").alias("places"), F.min(F.when(F.col("full"), F.col("diagonal"))).alias("low"), F.max(F.when(F.col("full"), F.col("diagonal"))).alias("high"),
    )
    spread = lambda c: F.size(F.array_distinct(F.flatten(F.transform(c, lambda p: F.sequence(p, p + F.col("k") - 1)))))
    known = merged.withColumn("cover", spread("t_at") / F.col("t_words")).withColumn("dense", spread("d_at") / (F.col("last") - F.col("first") + 1))
    counts = F.when(F.col("base"), F.col("places") > 0).otherwise((F.col("cover") >= COVER) & (F.col("dense") >= DENSE))
    judged = known.withColumn("counts", F.coalesce(F.col("template").isNotNull() & counts, F.lit(False)))
    joined = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("label")))), ",")
    return judged.groupBy("row", "doc_id").agg(
        F.max("n").cast("long").alias("n_words"), F.sum("places").cast("long").alias("n_base"), F.min("low").cast("long").alias("first_word"), F.max("high").cast("long").alias("last_word"),
        joined(F.col("base") & (F.col("places") > 0)).alias("base_labels"), joined(F.col("counts")).alias("labels"),
        F.coalesce(F.max(F.when(F.col("counts"), F.when(F.col("base"), F.lit(1.0)).otherwise(F.col("cover")))), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(F.col("counts"), F.struct("first", "last", "label", "cover")))).alias("spans"),
    ).drop("row")
