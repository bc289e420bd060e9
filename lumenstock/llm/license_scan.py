"""Licence notices by diagonal voting; DataFrame functions only.

Every word of every text opens a k-gram (k = 3); the hashes of all k-grams join the positions of the k-grams of
public notices, and the words themselves must be equal. A match at document word p and template word q votes for the
diagonal p - q. Votes are summed by diagonal; diagonals of one template not more than `gap` apart merge, which lets a
notice keep its votes over inserted or missing words. A merged span is verified by its share of the template's k-grams
and by its length. The template table is small and fixed by its parameter, so it is broadcast; only matches leave
the map side, and those of one document are the largest group.

Base labels are places where a phrase's words stand consecutively. Null texts are empty (no words). Rows without an id
are left out; rows that repeat an id give one row with the words of the longer and the places of both.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Public licence notices.
NOTICES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
]


def _words(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def license_scan(docs: DataFrame, notices: list[tuple[str, str]] = NOTICES, phrases: dict[str, str] = PHRASES, gap: int = 2, share: float = 0.6) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (label, first_word, last_word, share)."""
    spark = docs.sparkSession
    grams = []
    for t, (label, text) in enumerate(notices):
        w = _words(text)
        grams += [(t, label, q, len(w), *w[q:q + 3]) for q in range(len(w) - 2)]
    templates = spark.createDataFrame(grams, "template int, label string, q int, size int, t0 string, t1 string, t2 string")
    templates = F.broadcast(templates.withColumn("h", F.xxhash64("t0", "t1", "t2")))  # one row for each word of the notices

    words = documents(docs).select("doc_id", F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORD), F.lit(0)).alias("w"))
    shifted = F.arrays_zip(F.col("w").alias("w0"), F.slice("w", 2, 2**31 - 1).alias("w1"), F.slice("w", 3, 2**31 - 1).alias("w2"))
    rows = words.select("doc_id", F.size("w").cast("long").alias("n_words"), F.posexplode_outer(shifted).alias("p", "g")).select("doc_id", "n_words", "p", "g.*")
    base = F.lit(None).cast("string")
    for phrase, name in phrases.items():
        base = F.when(F.concat_ws(" ", *[F.col(f"w{i}") for i in range(len(phrase.split()))]) == phrase, F.lit(name)).otherwise(base)
    # Every phrase has two or three words, the last of them as its second or third.
    last = sorted({p.split()[-1] for p in phrases})
    base = F.when(F.col("w1").isin(last) | F.col("w2").isin(last), base)
    same = (F.xxhash64("w0", "w1", "w2") == F.col("h")) & (F.col("w0") == F.col("t0")) & (F.col("w1") == F.col("t1")) & (F.col("w2") == F.col("t2"))
    voted = rows.join(templates, same, "left").withColumn("base", base)
    # The first row of a document stands for it, whether it matches or not.
    opens = F.col("p").isNull() | (F.col("p") == 0)
    hits = stored(voted.where(opens | F.col("base").isNotNull() | F.col("template").isNotNull()).select("doc_id", "n_words", F.col("p").cast("long").alias("p"), "base", "template", "label", "q", "size"), "license-hits")

    # A word opens one phrase at most; rows of several templates repeat it.
    places = hits.select("doc_id", "n_words", "base", F.when(F.col("base").isNotNull(), F.col("p")).alias("at")).distinct()
    found = places.groupBy("doc_id").agg(
        F.max("n_words").alias("n_words"), F.count("at").alias("n_base"), F.min("at").alias("first_word"), F.max("at").alias("last_word"), F.collect_set("base").alias("base_set"))

    diagonals = hits.where("template IS NOT NULL").groupBy("doc_id", "template", "label", "size", (F.col("p") - F.col("q")).alias("d")).agg(F.countDistinct("p").alias("votes"), F.min("p").alias("low"), F.max("p").alias("high"))
    own = W.partitionBy("doc_id", "template").orderBy("d")
    # A second copy of the notice starts on a diagonal of its own, unless it overlaps the first.
    spans = diagonals.withColumn("starts", F.coalesce((F.col("d") - F.lag("d").over(own) > gap).cast("int"), F.lit(0))).withColumn("g", F.sum("starts").over(own)).drop("starts")
    spans = spans.groupBy("doc_id", "template", "label", "size", "g").agg(F.sum("votes").alias("votes"), F.min("low").alias("first_word"), (F.max("high") + 2).alias("last_word"))
    spans = spans.withColumn("share", F.least(F.lit(1.0), F.col("votes") / (F.col("size") - 2)))
    spans = spans.where((F.col("share") >= share) & (F.col("last_word") - F.col("first_word") < 2 * F.col("size")))
    named = spans.groupBy("doc_id").agg(F.max("share").alias("share"), F.collect_set("label").alias("label_set"), F.sort_array(F.collect_set(F.struct("first_word", "last_word", "label", "share"))).alias("spans"))
    joined = found.join(named, "doc_id", "left")
    none = F.array().cast("array<string>")
    labels = F.sort_array(F.array_union("base_set", F.coalesce("label_set", none)))
    score = F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.col("n_base") > 0, F.lit(0.5)).otherwise(F.lit(0.0)))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.sort_array("base_set"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"), "spans")
