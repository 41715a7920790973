"""Benchmark decontamination by a broadcast set of normalised test n-grams.

Texts are lower-cased (A to Z) and cut into words.  A benchmark item gives all
its windows of ten words, a shorter item itself.  The windows, by their hash,
are a broadcast table; every position of every document is looked up in it and
a hit is verified on the words.  DataFrame functions only: positions stay
inside the stage that scans the texts, and what leaves it is one row per
document and one per hit.

The benchmark is broadcast only up to ``BROADCAST_WINDOWS`` windows; a larger
one is joined by a shuffle of the hashes, with the same result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import words_of

WINDOW = 10
BROADCAST_WINDOWS = 500_000
RESULTS = ("n_words", "hit_words", "items")


def _gram(words: Column, at: Column, length: int) -> list[Column]:
    return [F.get(words, at + i) for i in range(length)]


def windows_of(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(length, gram, items): each different window and the ids that hold it."""
    words = benchmark.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words_of(F.col(text_col)).alias("words")
    )
    sized = words.where(F.size("words") > 0).withColumn("length", F.least(F.size("words"), F.lit(window)))
    starts = F.explode(F.sequence(F.lit(1), F.size("words") - F.col("length") + 1))
    return (
        sized.withColumn("start", starts)
        .withColumn("gram", F.array_join(F.expr("slice(words, start, length)"), " "))
        .groupBy("length", "gram")
        .agg(F.collect_set("item").alias("items"))
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    broadcast_windows: int = BROADCAST_WINDOWS,
) -> DataFrame:
    """The documents with n_words, hit_words (sorted word numbers) and items.

    ``hit_words`` numbers the words, from 0, that lie in an occurrence of a
    window; ``items`` holds the ids, as strings, with an occurring window, sorted.
    A null text has no words; repeated rows are measured each; an empty
    benchmark hits nothing.  Repeated item ids count once, a null id is the
    empty string.  Input columns named like the three results are replaced.
    """
    docs = docs.drop(*RESULTS)
    kept = docs.columns
    windows = windows_of(benchmark, item_col, item_text_col, window)
    sizes = {row["length"]: row["count"] for row in windows.groupBy("length").count().collect()}
    small = sum(sizes.values()) <= broadcast_windows

    read = docs.select(
        F.monotonically_increasing_id().alias("_hit_row"),
        F.struct(*(F.col(c) for c in kept)).alias("_doc"),
        words_of(F.col(text_col)).alias("_words"),
    ).withColumn("_n", F.size("_words"))
    at = read.select("_hit_row", "_doc", "_words", "_n", F.posexplode_outer("_words").alias("_pos", "_word"))
    first = F.coalesce(F.col("_pos"), F.lit(0)) == 0
    lengths = sorted(sizes)
    rows = at.select(
        "_hit_row", "_pos", "_n",
        *(F.when(first, F.col("_doc")[c]).alias(f"_doc_{i}") for i, c in enumerate(kept)),
        *(
            column
            for length in lengths
            for grams in [_gram(F.col("_words"), F.col("_pos"), length)]
            for column in (
                F.when(F.col("_pos") + length <= F.col("_n"), F.xxhash64(*grams)).alias(f"_hash_{length}"),
                F.concat_ws(" ", *grams).alias(f"_gram_{length}"),
            )
        ),
    )
    for length in lengths:
        parts = F.split("gram", " ")
        own = windows.where(F.col("length") == length).select(
            F.xxhash64(*(F.get(parts, F.lit(i)) for i in range(length))).alias("_h"),
            F.col("gram").alias("_g"),
            F.col("items").alias(f"_items_{length}"),
        )
        same = (F.col(f"_hash_{length}") == F.col("_h")) & (F.col(f"_gram_{length}") == F.col("_g"))
        rows = rows.join(F.broadcast(own) if small else own, same, "left").drop("_h", "_g", f"_gram_{length}")

    found = [F.col(f"_items_{length}") for length in lengths]
    hit = reduce(Column.__or__, (c.isNotNull() for c in found), F.lit(False))
    start = [F.when(F.col(f"_items_{n}").isNotNull(), F.sequence(F.col("_pos"), F.col("_pos") + n - 1)) for n in lengths]
    no_numbers, no_items = F.array().cast("array<int>"), F.array().cast("array<string>")

    def gathered(columns: list[Column], none: Column) -> Column:
        sets = [F.flatten(F.collect_set(c)) for c in columns]
        return F.array_sort(F.array_distinct(F.concat(*sets))) if sets else F.first(none)

    return (
        rows.where(hit | F.coalesce(F.col("_pos") == 0, F.lit(True)))
        .groupBy("_hit_row")
        .agg(
            *(F.first(f"_doc_{i}", ignorenulls=True).alias(c) for i, c in enumerate(kept)),
            F.first("_n").alias("n_words"),
            gathered(start, no_numbers).alias("hit_words"),
            gathered(found, no_items).alias("items"),
        )
        .drop("_hit_row")
    )


def _put_aside(docs: DataFrame) -> DataFrame:
    """Own columns that are named like a result, under another name."""
    return docs.withColumnsRenamed({c: f"_own_{c}" for c in RESULTS if c in docs.columns})


def _put_back(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*(F.col(f"_own_{c}").alias(c) if c in RESULTS else F.col(c) for c in docs.columns))


def drop_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without any hit, with their own columns."""
    measured = contamination(_put_aside(docs), benchmark, **options)
    return _put_back(measured.where(F.size("hit_words") == 0), docs)


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """All documents, without the words that were hit and what stands before each of them."""
    measured = contamination(_put_aside(docs), benchmark, text_col=text_col, **options)
    text = F.coalesce(F.col(text_col), F.lit(""))
    chunk = r"[\x00-\x2F\x3A-\x60\x7B-\x7F&&[^A-Z]]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    chunks = F.regexp_extract_all(text, F.lit(chunk), F.lit(0))
    tail = F.regexp_extract(text, r"([\x00-\x2F\x3A-\x60\x7B-\x7F&&[^A-Z]]*)\z", 1)
    after = F.transform("hit_words", lambda i: i + 1)
    # kept stretches lie between the end of one run of hits and the start of the next; one is empty where the text
    # begins or ends with a hit
    starts = F.array_sort(F.array_union(F.array(F.lit(0)), F.array_except(after, "hit_words")))
    ends = F.array_sort(F.array_union(F.array_except("hit_words", after), F.array(F.col("n_words"))))
    stretches = F.transform(
        F.arrays_zip(starts.alias("s"), ends.alias("e")),
        lambda z: F.slice("_chunks", z["s"] + 1, z["e"] - z["s"]),
    )
    rebuilt = F.concat(F.array_join(F.flatten(stretches), ""), tail)
    cleaned = measured.withColumn("_chunks", chunks).withColumn(
        text_col, F.when(F.size("hit_words") > 0, rebuilt).otherwise(F.col(text_col))
    )
    return _put_back(cleaned, docs)
