"""Phrase collocation mining over count streams in prefix and suffix order.

Texts are cut into pieces at punctuation and line ends; an n-gram lies within a
piece.  Counts of each order are one stream (lang, phrase, f).  A phrase meets
its left parts in prefix order and its right parts in suffix order: both streams
are sorted by the shared n-1 words and read in lockstep (sort-merge joins, no
hash table, no broadcast), and the counts of shorter parts come along, so each
order needs two passes whatever its length:

    left counts  of w1..wn = left counts of w1..wn-1, then f(w1..wn-1)
    right counts of w1..wn = f(w2..wn), then right counts of w2..wn

The same two orders give the extension counts: the largest f of a phrase one
word longer on either side.  A longer phrase that contains this one contains
one of these, which is at least as frequent, so nothing longer needs a look.

Only phrases seen ``least`` times matter, and their parts are as frequent.  So
order n counts only where both parts of n-1 words may be frequent, as a bitmap
of fixed size says.  It may say yes too often, which costs time, never no.
Texts are counted in tasks before anything is shuffled; a hot word is one row a
block.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, UPPER, staged

LONGEST, LEAST, COVERED, TOP = 3, 10, 50, 2000
#: Bits of the bitmap of frequent phrases, and of the part of it that one task makes.
BITMAP_BITS, PART_BITS = 1 << 27, 1 << 19
#: Words that a task counts before it sends counts on, and rows that it sends at a time.
BLOCK_WORDS, SENT_ROWS = 800_000, 50_000
SCALE = 1_000_000

# Ends of pieces become a full stop, which then is no part of a word; a tab becomes a space.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(UPPER.encode() + _ENDS + b"\t", LOWER.encode() + b"." * len(_ENDS) + b" ")


#: The last word of a phrase lies in the low half of its number.
_WORD = 0xFFFFFFFF


def words_of(text: str) -> list[bytes]:
    """Lower-case words; a full stop stands where a piece ends."""
    return text.encode().translate(_TABLE).replace(b".", b" . ").split()


def _maybe(bitmap: np.ndarray, sums: list[int]) -> np.ndarray:
    """Which phrases may be frequent, by their checksums; the first, an empty one, is not."""
    at = np.array(sums, np.int64) & (8 * len(bitmap) - 1)
    found = (bitmap[at >> 3] >> (at & 7)) & 1 == 1
    found[0] = False
    return found


class _Block:
    """Words of one language as numbers, 0 at the ends of pieces."""

    def __init__(self):
        self.known: dict[bytes, int] = {b".": 0}
        self.texts: list[np.ndarray] = []

    def add(self, words: list[bytes]) -> None:
        known = self.known
        self.texts.append(np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words)))
        self.texts.append(np.zeros(1, np.int64))

    def count(self, lang: bytes, frequent: list[np.ndarray]) -> Iterator[tuple[list[bytes], np.ndarray]]:
        """Phrases and their counts, some at a time; ``frequent``: bitmaps of the orders below."""
        words, names = np.concatenate(self.texts), list(self.known)
        self.texts, self.known = [], {}
        grams, orders = words, []
        base = zlib.crc32(lang + b" ")
        sums = [zlib.crc32(name, base) for name in names]
        for n, bitmap in enumerate(frequent, 2):
            kept = _maybe(bitmap, sums)
            grams = np.where(kept[grams], grams, 0)
            both = (grams[:-1] > 0) & (grams[1:] > 0)
            keys = np.where(both, grams[:-1] << 32 | words[n - 1 :], 0)
            # a place without a phrase is there for certain, as texts end with a 0
            keys, grams = np.unique(np.append(keys, 0), return_inverse=True)
            grams = grams[:-1]
            orders.append(keys)
            if n <= len(frequent):
                sums = [zlib.crc32(b" " + names[k & _WORD], sums[k >> 32]) for k in keys.tolist()]

        def phrases(order: int, at: np.ndarray) -> list[bytes]:
            if order < 0:
                return [names[k] for k in at.tolist()]
            keys = orders[order][at]
            return [x + b" " + names[k] for x, k in zip(phrases(order - 1, keys >> 32), (keys & _WORD).tolist())]

        f = np.bincount(grams)
        f[0] = 0
        there = np.flatnonzero(f)
        for low in range(0, len(there), SENT_ROWS):
            some = there[low : low + SENT_ROWS]
            yield phrases(len(orders) - 1, some), f[some]


def _counter(frequent: list):
    """Count n-grams of one order in blocks of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[str, _Block] = {}
        size = 0
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1)):
                words = words_of(text.as_py() or "")
                if words:
                    blocks.setdefault(lang.as_py(), _Block()).add(words)
                    size += len(words)
                if size > BLOCK_WORDS:
                    yield from sent(blocks)
                    blocks, size = {}, 0
        yield from sent(blocks)

    def sent(blocks: dict[str, _Block]) -> Iterator[pa.RecordBatch]:
        for lang, block in blocks.items():
            for phrases, f in block.count(lang.encode(), [x.value for x in frequent]):
                texts = pa.array(phrases, pa.binary()).cast(pa.string())
                langs = pa.array([lang] * len(phrases), pa.string())
                yield pa.RecordBatch.from_arrays([langs, texts, pa.array(f)], names=["lang", "phrase", "f"])

    return run


def _or_bits(size: int):
    def run(table: pa.Table) -> pa.Table:
        bits = np.zeros(size, bool)
        bits[table.column("at").to_numpy() % size] = True
        packed = np.packbits(bits, bitorder="little").tobytes()
        return pa.table({"part": table.column("part")[:1], "bits": pa.array([packed], pa.binary())})

    return run


def bitmap_of(stream: DataFrame, bits: int = BITMAP_BITS) -> np.ndarray:
    """Bits of the phrases of a stream: a few megabytes, however long it is."""
    size = min(PART_BITS, bits)
    at = F.crc32(F.encode(F.concat("lang", F.lit(" "), "phrase"), "UTF-8")).bitwiseAND(F.lit(bits - 1))
    places = stream.select(at.alias("at")).distinct().select("at", F.floor(F.col("at") / size).alias("part"))
    parts = places.groupBy("part").applyInArrow(_or_bits(size), "part long, bits binary").toArrow()
    bitmap = np.zeros(bits // 8, np.uint8)
    for part, packed in zip(parts.column("part").to_pylist(), parts.column("bits").to_pylist()):
        bitmap[part * size // 8 : (part + 1) * size // 8] = np.frombuffer(packed, np.uint8)
    return bitmap


def count_stream(docs: DataFrame, frequent: list) -> DataFrame:
    """(lang, phrase, f) of an order; ``frequent``: broadcast bitmaps of all orders below."""
    counted = docs.mapInArrow(_counter(frequent), "lang string, phrase string, f long")
    return counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _but_last(order: int) -> Column:
    return F.substring_index("phrase", " ", order - 1)


def _but_first(order: int) -> Column:
    return F.substring_index("phrase", " ", 1 - order)


def with_parts(stream: DataFrame, shorter: DataFrame, order: int) -> DataFrame:
    """Add ``ls`` and ``rs``: counts of the first k words and of the rest, for k = 1 .. n-1."""
    left = shorter.select(
        "lang", F.col("phrase").alias("prefix"), F.concat("ls", F.array("f")).alias("ls")
    ).hint("merge")
    right = shorter.select(
        "lang", F.col("phrase").alias("suffix"), F.concat(F.array("f"), "rs").alias("rs")
    ).hint("merge")
    in_prefix_order = stream.withColumn("prefix", _but_last(order)).join(left, ["lang", "prefix"])
    in_suffix_order = in_prefix_order.withColumn("suffix", _but_first(order)).join(right, ["lang", "suffix"])
    return in_suffix_order.select("lang", "phrase", "f", "ls", "rs")


def with_extension(stream: DataFrame, longer: DataFrame, order: int) -> DataFrame:
    """Add ``ext``: the largest count of a phrase one word longer; 0 without one."""
    parts = [
        longer.groupBy("lang", part(order + 1).alias("phrase")).agg(F.max("f").alias(name)).hint("merge")
        for part, name in ((_but_last, "by_prefix"), (_but_first, "by_suffix"))
    ]
    both = stream.join(parts[0], ["lang", "phrase"], "left").join(parts[1], ["lang", "phrase"], "left")
    ext = F.greatest(F.coalesce("by_prefix", F.lit(0)), F.coalesce("by_suffix", F.lit(0)))
    return both.select(*stream.columns, ext.alias("ext"))


def scored(stream: DataFrame) -> DataFrame:
    """Add the cut that counts: the lowest score, then the fewest first words.

    ``floor(1000000 a a / (l r))`` in decimals of 38 digits, exact up to a = 10^15.
    """
    exact = "cast({0} AS decimal(15,0))"
    a, left, right = exact.format("f"), exact.format("ls[k]"), exact.format("rs[k]")
    cut = f"struct(({a} * {a} * {SCALE}) div ({left} * {right}) AS score, k, ls[k] AS l, rs[k] AS r)"
    return stream.withColumn("cut", F.expr(f"array_min(transform(sequence(0, size(ls) - 1), k -> {cut}))"))


def mine(
    docs: DataFrame,
    longest: int = LONGEST,
    least: int = LEAST,
    covered: int = COVERED,
    top: int = TOP,
    text_col: str = "text",
    lang_col: str = "lang",
    bitmap_bits: int = BITMAP_BITS,
) -> DataFrame:
    """The first ``top`` phrases of 2 to ``longest`` words of each language.

    Columns: lang, rank, phrase, a (its count), l and r (counts of the parts of
    the cut that counts), n (all words of the language), score.  Candidates occur
    ``least`` times or more; one goes if a phrase that contains it has ``covered``
    percent of its count.  Ranked by score, count, then phrase.  A null language
    is ``und``, a null text is empty, repeated rows count each, an empty table
    gives no rows; other columns, whatever their names, are not read.
    """
    if longest < 2:
        raise ValueError("phrases have two words at least")
    context = docs.sparkSession.sparkContext
    source = docs.select(F.coalesce(lang_col, F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    words = staged(count_stream(source, []))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    none = F.array().cast("array<bigint>")
    streams = [words.where(F.col("f") >= least).select("*", none.alias("ls"), none.alias("rs"))]
    frequent: list = []
    for order in range(2, longest + 1):
        frequent.append(context.broadcast(bitmap_of(streams[-1], bitmap_bits)))
        counted = count_stream(source, frequent).where(F.col("f") >= least)
        streams.append(staged(with_parts(counted, streams[-1], order)))
    kept = []
    for order, stream in enumerate(streams[1:], 2):
        last = order == longest
        kept.append(stream.withColumn("ext", F.lit(0)) if last else with_extension(stream, streams[order], order))
    candidates = kept[0]
    for stream in kept[1:]:
        candidates = candidates.unionByName(stream)
    left = candidates.where(100 * F.col("ext") < covered * F.col("f"))
    return _ranked(scored(left), totals, top)


def _ranked(found: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("f"), "phrase")
    first = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return first.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("f").alias("a"),
        "cut.l", "cut.r", "n", F.col("cut.score").alias("score"),
    )
