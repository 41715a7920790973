"""License scan by a positional index of rare tokens.

The words of every template are weighed by how few documents of the corpus hold
them; each template is indexed under its rarest words, with their positions.
Of a file, every indexed word is looked up wherever it stands; postings that
place a template at the same relative position are intersected, and a template
counts if two or more agree and its mandatory phrase stands, word for word,
where that alignment puts it.  DataFrame functions only: the index is a few
dozen fixed rows, and words leave the scanning stage only if they hit it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import words_of

#: Phrases that always count, with their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

#: Label, words of the template, mandatory phrase within it.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    ("mit", "licensed under the mit license", "under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", "apache license version 2"),
    ("gpl", "this work is licensed under the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
)

INDEXED_WORDS = 6
LEAST_AGREEING = 2


def vocabulary() -> list[str]:
    return sorted({word for _, template, _ in TEMPLATES for word in template.split()})


def rarity(docs: DataFrame, text_col: str = "text") -> list[str]:
    """The licence words, rarest in the documents first; ties by the word.

    Words that no document holds come last: looking them up would find nothing.
    """
    words = F.array(*(F.lit(word) for word in vocabulary()))
    held = docs.select(F.explode(F.array_intersect(words, words_of(F.col(text_col)))).alias("word"))
    counts = {row["word"]: row["count"] for row in held.groupBy("word").count().collect()}
    return sorted(vocabulary(), key=lambda word: (word not in counts, counts.get(word, 0), word))


def postings(by_rarity: list[str]) -> list[tuple[str, int, int]]:
    """(word, template number, position) of each template's rarest words."""
    rank = {word: i for i, word in enumerate(by_rarity)}
    rows = []
    for number, (_, template, _) in enumerate(TEMPLATES):
        words = template.split()
        indexed = sorted(set(words), key=rank.__getitem__)[:INDEXED_WORDS]
        rows += [(word, number, i) for i, word in enumerate(words) if word in indexed]
    return rows


def _phrase_at(template: str, phrase: str) -> int:
    words, part = template.split(), phrase.split()
    return next(i for i in range(len(words)) if words[i : i + len(part)] == part)


def _stands(words: Column, at: Column, phrase: list[str]) -> Column:
    return reduce(Column.__and__, (F.get(words, at + i) == word for i, word in enumerate(phrase)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document.

    Columns: id, n_words, base_places, first_word, last_word (null without
    places), base_labels, labels (sorted arrays; the labels hold the base ones)
    and score: 1 with a base label, else the largest share of a verified
    template's words that stand at its alignment, else 0.  A null text counts
    as empty; repeated rows are scanned each; other columns are not read.
    """
    by_rarity = rarity(docs, text_col)
    spark = docs.sparkSession
    posted = postings(by_rarity)
    index = spark.createDataFrame(posted, "_token string, _template int, _place int")
    tokens = sorted({word for word, _, _ in posted})

    words, at = F.col("_words"), F.col("_pos")
    read = docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), words_of(F.col(text_col)).alias("_words")
    )
    exploded = read.select("*", F.posexplode_outer("_words").alias("_pos", "_word"))
    base = reduce(
        lambda rest, p: F.when((F.col("_word") == p[0].split()[0]) & _stands(words, at, p[0].split()), p[1]).otherwise(rest),
        PHRASES,
        F.lit(None).cast("string"),
    )
    looked_up = F.when(F.col("_word").isin(tokens), F.col("_word"))
    rows = (
        exploded.withColumn("_base", base)
        .withColumn("_look", looked_up)
        .where(F.coalesce(at, F.lit(0)).eqNullSafe(0) | F.col("_base").isNotNull() | F.col("_look").isNotNull())
        .join(F.broadcast(index), F.col("_look") == F.col("_token"), "left")
    )
    # a fixed handful of templates: each is verified where the posting would put it
    shift = at - F.col("_place")
    verified, share = F.lit(False), F.lit(0.0)
    for number, (_, template, phrase) in enumerate(TEMPLATES):
        this = F.col("_template") == number
        part, whole = phrase.split(), template.split()
        begin = shift + _phrase_at(template, phrase)
        verified = F.when(this, (begin >= 0) & F.coalesce(_stands(words, begin, part), F.lit(False))).otherwise(verified)
        # beyond the end of the text there is no word to agree
        agree = reduce(
            Column.__add__,
            (F.coalesce((F.get(words, shift + i) == word).cast("int"), F.lit(0)) for i, word in enumerate(whole)),
        )
        share = F.when(this, agree / F.lit(float(len(whole)))).otherwise(share)
    labels = F.array(*(F.lit(label) for label, _, _ in TEMPLATES))
    aligned = rows.select(
        "_row", "_id", F.size("_words").alias("_n"), "_pos", "_base", "_template", "_place",
        shift.alias("_shift"), verified.alias("_verified"), F.when(verified, share).alias("_share"),
    )
    # what is not verified gives no label: only the first word stands for its document
    aligned = aligned.where(F.coalesce("_pos", F.lit(0)).eqNullSafe(0) | F.col("_base").isNotNull() | F.col("_verified"))
    counted = aligned.groupBy("_row", "_template", "_shift").agg(
        F.first("_id").alias("_id"),
        F.first("_n").alias("_n"),
        F.size(F.collect_set("_place")).alias("_agree"),
        F.max("_verified").alias("_verified"),
        F.max("_share").alias("_share"),
        F.collect_set(F.when(F.col("_base").isNotNull(), F.struct(F.col("_pos").alias("p"), F.col("_base").alias("b")))).alias("_places"),
    )
    template = F.element_at(labels, F.col("_template") + 1)
    good = F.col("_verified") & (F.col("_agree") >= LEAST_AGREEING)
    by_doc = counted.groupBy("_row").agg(
        F.first("_id").alias(id_col),
        F.first("_n").cast("long").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_places")))).alias("_places"),
        F.collect_set(F.when(good, template)).alias("_labels"),
        F.coalesce(F.max(F.when(good, F.col("_share"))), F.lit(0.0)).alias("_share"),
    )
    places, base_labels = F.col("_places"), F.array_sort(F.array_distinct(F.col("_places.b")))
    return by_doc.select(
        id_col, "n_words", F.size(places).cast("long").alias("base_places"),
        F.get(places, F.lit(0))["p"].cast("long").alias("first_word"),
        F.get(places, F.size(places) - 1)["p"].cast("long").alias("last_word"),
        base_labels.alias("base_labels"),
        F.array_sort(F.array_union(base_labels, "_labels")).alias("labels"),
        F.when(F.size(places) > 0, 1.0).otherwise(F.col("_share")).alias("score"),
    )
