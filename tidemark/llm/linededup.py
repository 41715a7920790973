"""Line dedup by an exact set-similarity join.

A line is the set of its words (ASCII-lower-cased, split at white space); lines
without words are left alone.  A line is removed if an earlier one, by document
id and place in the text, is at least 0.8 similar (Jaccard), be that one removed
itself or not.

Equal sets are one class, known by 128 bits, whose first line stands for it.
Between classes: words are ordered by rarity, and two sets of the wanted
similarity share one of their rarest n - ceil(0.8 n) + 1.  These prefix words
are dealt by word, once, and each task pairs the sets that share one: length,
position of the shared word and a 64-bit parity signature (each a bound on the
overlap that never loses a pair) prune, words of one set send nothing on.
What is left is verified: first one pair of each class, with the likest set of no
later document, then all pairs of the classes that it did not settle; until then
these travel packed.  A pair is compared by 15-bit hashes of its words, which never make two sets look less
alike than they are; only what passes meets the words themselves.

A task walks the sets of a word by length, so a set meets only those within the
wanted ratio.  A word that more than ``MEET`` sets hold is not paired there: first
every set meets the earliest holder only, which settles large groups of near
copies with one comparison per word; only sets still without an earlier match
then meet all earlier ones.  A removed line so needs one match, and a group of g
near copies no square of pairs.

Rarity is a table of 2**BUCKET_BITS counts by word hash over all lines; words
that share a bucket only look more common.  It is the one thing of fixed size
that goes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import ascii_lower, drop_staged, give_back, kept, staged

#: Jaccard similarity as a fraction.
SIMILAR = (4, 5)
BUCKET_BITS = 22
#: Buckets of one row on their way to the sums.
SLICE_BITS = 16
#: Sets of one word that a task pairs by itself.
MEET = 1024
#: Joined without a shuffle of the other side up to so many rows of a few numbers.
BROADCAST_ROWS = 500_000
#: Removed lines that are broadcast; with more, they and the documents meet by a shuffle.
BROADCAST_LINES = 50_000
_REMEMBERED = 400_000
#: Documents and bytes of text whose words a task holds at once; one longer text is a part of its own.
PART_ROWS = 2_500
PART_BYTES = 4 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_FINAL = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
#: The first bytes of eight, by their number.
_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
_LONG = 64


class _Hashes(dict):
    """Hash of each word, computed once."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def word_hashes() -> _Hashes:
    """The hashes that this Python worker remembers, emptied when they are many."""
    hashes = kept("word hashes", _Hashes)
    if len(hashes) > _REMEMBERED:
        hashes.clear()
    return hashes


def text_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts of the batches, whose last column is the text, bounded in rows and bytes."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(batch.num_columns - 1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        low = 0
        while low < batch.num_rows:
            before = int(ends[low - 1]) if low else 0
            high = max(low + 1, int(np.searchsorted(ends, before + PART_BYTES, "right")))
            high = min(high, low + PART_ROWS)
            yield batch.slice(low, high - low)
            low = high
        give_back()


def _mixed(values: np.ndarray) -> np.ndarray:
    for odd in _FINAL:
        values = (values ^ (values >> np.uint64(33))) * odd
    return values ^ (values >> np.uint64(33))


def hashes_of(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words that begin and end there, eight bytes of all words at a time; eight bytes follow the last word."""
    eights = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    size = ends - starts
    found = _mixed((eights[starts] & _BYTES[np.minimum(size, 8)]) + size.astype(np.uint64) * _ODD)
    longer = np.flatnonzero(size > 8)
    for at in range(8, _LONG, 8):
        more = eights[starts[longer] + at] & _BYTES[np.minimum(size[longer] - at, 8)]
        found[longer] = _mixed(found[longer] * _ODD ^ more)
        longer = longer[size[longer] > at + 8]
    for i in longer.tolist():
        found[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]])
    return found


class _Lines:
    """Lines with words of some texts: owner, number, words in all, and the hashes of their words one line after the other.

    The words of a line stand by their level of rarity, if levels are given, and hash.
    """

    def __init__(self, texts: pa.Array, levels: np.ndarray | None = None):
        raw = [text or b"" for text in texts.cast(pa.binary()).to_pylist()]
        # a line feed before, between and behind the texts
        data = b"\n".join([b"", *raw, b""]).lower() + bytes(8)
        each = np.frombuffer(data, np.uint8)[:-8]
        space = _SPACE[each]
        change = np.flatnonzero(space[1:] != space[:-1]) + 1
        starts, ends = change[::2], change[1::2]
        feeds = np.flatnonzero(each == 10)
        words = np.diff(np.searchsorted(starts, feeds))
        begun = np.searchsorted(feeds, np.cumsum([0, *(len(text) + 1 for text in raw)])[:-1])
        there = np.flatnonzero(words)
        self.owner = np.searchsorted(begun, there, side="right") - 1
        self.number = there - begun[self.owner]
        line = np.repeat(np.arange(len(there)), words[there])
        word = hashes_of(data, starts, ends)
        level = np.zeros(len(word), np.int8) if levels is None else levels[(word >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)]
        order = _by_rarity(line, level, word)
        line, word = line[order], word[order]
        new = np.ones(len(word), bool)
        new[1:] = (line[1:] != line[:-1]) | (word[1:] != word[:-1])
        #: of each word its line, hash and level
        self.line, self.hashes, self.level = line[new], word[new], level[order][new]
        self.size = np.bincount(self.line, minlength=len(there))
        self.starts = np.cumsum(self.size) - self.size
        if not len(there):
            self.key = self.other = self.first = np.zeros(0, np.uint64)
            return
        self.key = np.add.reduceat(self.hashes, self.starts)
        mixed = (self.hashes ^ (self.hashes >> np.uint64(29))) * _ODD
        self.other = np.add.reduceat(mixed ^ (mixed >> np.uint64(32)), self.starts)
        #: True for the first line of each different set.
        self.first = np.zeros(len(there), bool)
        self.first[np.unique(self.key, return_index=True)[1]] = True


def prefix_length(words):
    """Of so many words, a number or an array."""
    num, den = SIMILAR
    return words + (-num * words // den) + 1


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def _read_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with the key of their set; at the end, how many sets hold a word of each bucket, by slices of buckets."""
    counts = np.zeros(1 << BUCKET_BITS, np.uint32)
    names = ["id", "row", "line", "key", "other", "slice", "held"]
    kind = None
    for part in text_parts(batches):
        kind = part.column(0).type
        lines = _Lines(part.column(2))
        n = len(lines.owner)
        if not n:
            continue
        take = pa.array(lines.owner)
        own = [part.column(0).take(take), part.column(1).take(take), pa.array(lines.number, pa.int32())]
        yield pa.RecordBatch.from_arrays(
            [*own, _signed(lines.key), _signed(lines.other), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names
        )
        words = lines.hashes[np.repeat(lines.first, lines.size)]
        np.add.at(counts, (words >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), np.uint32(1))
    if kind is None:
        return
    for number, part in enumerate(counts.reshape(-1, 1 << SLICE_BITS)):
        at = np.flatnonzero(part)
        if len(at):
            packed = at.astype("<u2").tobytes() + part[at].astype("<u4").tobytes()
            longs = pa.nulls(1, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, kind), longs, pa.nulls(1, pa.int32()), longs, longs, pa.array([number], pa.int32()), pa.array([packed])], names
            )


def _sum_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for number, held in zip(batch.column(0).to_pylist(), batch.column(1)):
            packed = held.as_py()
            n = len(packed) // 6
            into = sums.setdefault(number, np.zeros(1 << SLICE_BITS, np.int64))
            into[np.frombuffer(packed, "<u2", n)] += np.frombuffer(packed, "<u4", n, 2 * n)
    for number, held in sums.items():
        level = np.minimum(120, np.ceil(np.log2(np.maximum(held, 1)) * 4)).astype(np.int8)
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([level.tobytes()])], ["slice", "level"])


def rarity_levels(read: DataFrame) -> np.ndarray:
    """By bucket, 0 for a word of one set and more the more sets hold it."""
    slices = read.where("slice IS NOT NULL").select("slice", "held").repartition("slice")
    found = slices.mapInArrow(_sum_slices, "slice int, level binary").toArrow()
    levels = np.zeros((1 << (BUCKET_BITS - SLICE_BITS), 1 << SLICE_BITS), np.int8)
    for number, level in zip(found["slice"].to_pylist(), found["level"].to_pylist()):
        levels[number] = np.frombuffer(level, np.int8)
    return levels.reshape(-1)


def _by_rarity(line: np.ndarray, level: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Order by line, level and hash: of one number with the first bits of the hash, where these tell different words apart."""
    if len(line) and line[-1] < 1 << 18:
        value = ((line * 128 + level).astype(np.uint64) << np.uint64(39)) + (word >> np.uint64(25))
        order = np.argsort(value)
        value, again = value[order], word[order]
        if ((value[1:] != value[:-1]) | (again[1:] == again[:-1])).all():
            return order
    return np.lexsort((word, line * 128 + level))


def prefixes(lines: _Lines) -> tuple[np.ndarray, ...]:
    """Of the first line of each set: line, place in the order and hash of the prefix words that other sets may hold."""
    at = np.arange(len(lines.line)) - lines.starts[lines.line]
    sent = lines.first[lines.line] & (at < prefix_length(lines.size)[lines.line]) & (lines.level > 0)
    return lines.line[sent], at[sent], lines.hashes[sent]


def _order(source: DataFrame) -> Column:
    """A number that never falls as the id rises, null ids first; one number for all ids of types that have none."""
    kind = source.schema["id"].dataType
    if isinstance(kind, T.IntegralType):
        number = F.col("id").cast("long")
    elif kind == T.StringType():
        number = F.conv(F.rpad(F.hex(F.substring(F.encode("id", "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long")
    else:
        return F.lit(0).cast("long")
    return F.coalesce(number, F.lit(-(1 << 63)).cast("long"))


def _least(key: np.ndarray, number: np.ndarray) -> np.ndarray:
    """For each row the least number of the rows of its key."""
    order = np.lexsort((number, key))
    own = key[order]
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    least = np.empty_like(number)
    least[order] = number[order][new][np.cumsum(new) - 1]
    return least


def _postings(source: DataFrame, levels: np.ndarray) -> DataFrame:
    """Prefix words of each different set: word, key, n and place in the order as one number, parity, order of the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_parts(batches):
            lines = _Lines(part.column(1), levels)
            if not len(lines.owner):
                continue
            line, at, word = prefixes(lines)
            # the first document of each set, as that of its class must not be taken for a later one
            document = _least(lines.key, part.column(0).to_numpy()[lines.owner])
            parity = np.bitwise_xor.reduceat(np.uint64(1) << (lines.hashes & np.uint64(63)), lines.starts)
            n_at = (lines.size[line] << 32) + at
            yield pa.RecordBatch.from_arrays(
                [_signed(word), _signed(lines.key[line]), pa.array(n_at), _signed(parity[line]), pa.array(document[line])],
                ["word", "key", "n_at", "parity", "document"],
            )

    return source.select(_order(source).alias("document"), "text").mapInArrow(
        run, "word long, key long, n_at long, parity long, document long"
    )


def _may_match(n1, at1, parity1, n2, at2, parity2, least, greatest, differing):
    """Length, position and signature allow the similarity; of columns or of arrays.

    The first word that two similar sets share is one of their join keys, and
    all that they share stands from there on, so both must have enough left.
    """
    num, den = SIMILAR
    # the overlap o of similar sets has (num + den) o >= num (n1 + n2)
    return (
        (den * least(n1, n2) >= num * greatest(n1, n2))
        & ((num + den) * least(n1 - at1, n2 - at2) >= num * (n1 + n2))
        & ((num + den) * differing(parity1, parity2) <= (den - num) * (n1 + n2))
    )


def _columns_match(a: str, b: str) -> Column:
    own = [
        (F.shiftright(f"{x}.n_at", 32), F.col(f"{x}.n_at").bitwiseAND(0xFFFFFFFF), F.col(f"{x}.parity")) for x in (a, b)
    ]
    return _may_match(*own[0], *own[1], F.least, F.greatest, lambda p, q: F.bit_count(p.bitwiseXOR(q)))


def _candidates(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two places and the differing bits of the parities for each pair that may match, of rows sorted by word and length."""
    word, n, at, parity = rows[0], rows[2] >> 32, rows[2] & 0xFFFFFFFF, rows[3]
    found = [np.zeros((3, 0), np.int64)]
    low = np.arange(len(word))
    num, den = SIMILAR

    def differing(p, q):
        return np.bitwise_count((p ^ q).view(np.uint64)).astype(np.int64)

    for step in range(1, len(word)):
        low = low[low + step < len(word)]
        low = low[(word[low] == word[low + step]) & (num * n[low + step] <= den * n[low])]
        if not len(low):
            break
        high = low + step
        fits = _may_match(
            n[low], at[low], parity[low], n[high], at[high], parity[high], np.minimum, np.maximum, differing
        )
        one, two = low[fits], high[fits]
        found.append(np.stack([one, two, differing(parity[one], parity[two])]))
    return tuple(np.concatenate(found, axis=1))


def _pair_sets(rows: np.ndarray) -> np.ndarray:
    """Pairs of keys, and how many words each shares, among rows sorted by word and length, no word with many rows."""
    key = rows[1]
    low, high, _ = _candidates(rows)
    pairs = np.stack([np.minimum(key[low], key[high]), np.maximum(key[low], key[high])])
    pairs = pairs[:, np.lexsort(pairs)]
    new = np.ones(pairs.shape[1], bool)
    new[1:] = (pairs[:, 1:] != pairs[:, :-1]).any(0)
    at = np.flatnonzero(new)
    return np.concatenate([pairs[:, at], np.diff(np.append(at, len(new)))[None]])


def _trials(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows with the order of their documents: (key, other set not after it, differing bits), the likest one of each
    key, and (key, other set) of all its pairs.  Sets of one document are paired both ways."""
    key, document = rows[1], rows[4]
    low, high, apart = _candidates(rows)
    after = document[high] >= document[low]
    late, early = np.where(after, high, low), np.where(after, low, high)
    tied = np.flatnonzero(document[low] == document[high])
    late, early, apart = np.append(late, low[tied]), np.append(early, high[tied]), np.append(apart, apart[tied])
    # of equally like ones the first in the order of documents, so that a group meets few
    order = np.lexsort((key[early], document[early], apart, key[late]))
    pairs = np.stack([key[late[order]], key[early[order]], apart[order]])
    trial = np.ones(pairs.shape[1], bool)
    trial[1:] = pairs[0, 1:] != pairs[0, :-1]
    # a pair that shares several words stands there several times in a row
    again = np.zeros(pairs.shape[1], bool)
    again[1:] = (pairs[:2, 1:] == pairs[:2, :-1]).all(0)
    return pairs[:, trial], pairs[:2, ~again]


def _meet(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Of postings sorted by word: the pairs of sets that may match, and the postings of frequent words as they are.

    Pairs are rows with the words they share as n_at; of postings with the order of their documents, only the likest
    pair of a set is a row, with the differing bits as n_at, and all pairs travel packed, many in a row.
    Holds one batch and the rows of its last word, at most ``most`` of them.
    """
    names = ["word", "key", "n_at", "parity", "with", "rest"]

    def pairs(rows: np.ndarray) -> pa.RecordBatch:
        (x, y, number), rest = (_pair_sets(rows), None) if len(rows) == 4 else _trials(rows)
        none = pa.nulls(len(x), pa.int64())
        packed = [None] * len(x)
        if rest is not None and rest.size:
            packed[0] = rest.tobytes()
        return pa.RecordBatch.from_arrays(
            [none, pa.array(x), pa.array(number), none, pa.array(y), pa.array(packed, pa.binary())], names
        )

    def large(rows: np.ndarray) -> pa.RecordBatch:
        n = rows.shape[1]
        return pa.RecordBatch.from_arrays([*map(pa.array, rows[:4]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names)

    waiting, frequent = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([c.to_numpy() for c in batch.columns])
        rows = rows if waiting is None else np.concatenate([waiting, rows], axis=1)
        # of equal sets the one of the first document
        rows = rows[:, np.lexsort((*rows[4:], rows[1], rows[2], rows[0]))]
        new = np.ones(rows.shape[1], bool)
        new[1:] = (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])
        rows = rows[:, new]
        # equal sets of two batches of a frequent word can stay twice; they are made different later
        change = np.flatnonzero(np.concatenate([[True], rows[0, 1:] != rows[0, :-1]]))
        size = np.diff(np.append(change, rows.shape[1]))
        many = size > most
        many[0] |= frequent is not None and rows[0, 0] == frequent
        frequent = rows[0, -1] if many[-1] else None
        each = np.repeat(many, size)
        if each.any():
            yield large(rows[:, each])
        last = 0 if many[-1] else int(size[-1])
        waiting = rows[:, rows.shape[1] - last :].copy()
        each[rows.shape[1] - last :] = True
        if not each.all():
            yield pairs(rows[:, ~each])
    if waiting is not None and waiting.size:
        yield pairs(waiting)


def _unpacked(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """The packed pairs of the wanted keys, as keys x and y."""
    few = wanted.limit(BROADCAST_ROWS + 1).toArrow()["key"].to_numpy()
    few = np.sort(few) if len(few) <= BROADCAST_ROWS else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0):
                pairs = np.frombuffer(packed.as_py(), np.int64).reshape(2, -1)
                if few is not None:
                    at = np.minimum(np.searchsorted(few, pairs[0]), len(few) - 1)
                    pairs = pairs[:, few[at] == pairs[0]] if len(few) else pairs[:, :0]
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["key", "early"])

    pairs = found.where("rest IS NOT NULL").select("rest").mapInArrow(run, "key long, early long")
    pairs = pairs if few is not None else pairs.join(wanted, "key", "left_semi")
    return pairs.select(F.least("key", "early").alias("x"), F.greatest("key", "early").alias("y"))


def _pairs(joined: DataFrame) -> DataFrame:
    return joined.select(F.least("a.key", "b.key").alias("x"), F.greatest("a.key", "b.key").alias("y"))


def _small(df: DataFrame) -> DataFrame:
    """Broadcast if it has few rows; as it is otherwise."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _later(source: DataFrame, first: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, other) of the classes that have an earlier verified match among the pairs; the keys of the pairs' other classes."""
    pairs = staged(pairs.distinct())
    named = pairs.select(F.explode(F.array("x", "y")).alias("key")).distinct()
    wanted = staged(first.join(_small(named), "key"))
    line = F.struct("first.line", "key", "other", "first")
    by_row = wanted.groupBy("first.row").agg(F.collect_list(line).alias("wanted"))
    # its lists are as long in all as the table of classes, whose rows are what must be few
    by_row = F.broadcast(by_row) if wanted.count() <= BROADCAST_ROWS else by_row
    # rows that repeat a document give the same line again
    lines = source.join(by_row, "row").select(F.split("text", "\n").alias("parts"), "wanted")
    found = lines.select(F.explode(F.transform("wanted", lambda w: F.struct(w.alias("w"), F.get("parts", w["line"]).alias("line")))).alias("l"))
    key, other, place, line = (F.col(f"l.{c}").alias(c.rpartition(".")[2]) for c in ("w.key", "w.other", "w.first", "line"))
    texts = found.groupBy(key, other).agg(F.first(place).alias("first"), F.first(line).alias("line"))
    words = F.array_distinct(F.filter(F.split(ascii_lower(F.col("line")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    texts = texts.select("key", "other", "first", words.alias("words"))
    sketch = F.array_distinct(F.transform("words", lambda w: F.xxhash64(w).bitwiseAND(0x7FFF).cast("short")))
    # words travel as one string, which takes a third of the bytes of an array
    texts = staged(texts.select("key", "other", "first", F.size("words").alias("n"), sketch.alias("sketch"), F.array_join("words", " ").alias("words")))
    classes = wanted.select("key", "other", "first")
    sides = [classes.select(F.col("key").alias(k), F.struct("first", "key", "other").alias(f"of_{k}")) for k in "xy"]
    placed = pairs.join(sides[0], "x").join(sides[1], "y")
    late, early = F.greatest("of_x", "of_y"), F.least("of_x", "of_y")
    placed = placed.select(late["key"].alias("key"), late["other"].alias("other"), early["key"].alias("early"))
    later = _similar(placed, texts)
    others = staged(classes.join(_small(later), ["key", "other"], "left_anti").select("key").distinct())
    for done in (pairs, wanted, texts):
        drop_staged(done)
    return later, others


def _similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(key, other) of the pairs' classes that are similar to the earlier class of the pair; written."""
    num, den = SIMILAR
    pairs = staged(pairs)

    def both(pairs: DataFrame, *columns) -> DataFrame:
        """The pairs with these columns of their classes, read for the classes of the pairs alone."""
        named = pairs.select(F.explode(F.array("key", "early")).alias("key")).distinct()
        own = texts.join(_small(named), "key", "left_semi").select("key", "other", "first", *columns)
        early = own.drop("other").withColumnsRenamed({c: f"early_{c}" for c in own.columns if c != "key"})
        found = pairs.join(early.withColumnRenamed("key", "early"), "early").join(own, ["key", "other"])
        return found.where(F.col("early_first") < F.col("first"))

    near = both(pairs, "n", "sketch")
    apart = F.size("sketch") + F.size("early_sketch") - 2 * F.size(F.array_intersect("sketch", "early_sketch"))
    near = staged(near.where((num + den) * apart <= (den - num) * (F.col("n") + F.col("early_n"))).select("key", "other", "early"))
    shared = F.size(F.array_intersect(F.split("words", " "), F.split("early_words", " ")))
    matched = both(near, "n", "words").where((num + den) * shared >= num * (F.col("n") + F.col("early_n")))
    found = staged(matched.select("key", "other").distinct())
    for done in (pairs, near):
        drop_staged(done)
    return found


def _matched(source: DataFrame, first: DataFrame, postings: DataFrame) -> DataFrame:
    """(key, other) of the classes with an earlier similar one."""
    most = MEET
    found = staged(postings.repartition("word").sortWithinPartitions("word").mapInArrow(
        lambda batches: _meet(batches, most), "word long, key long, n_at long, parity long, with long, rest binary"
    ))
    # one trial of each class, of the likest set that any of its words has met
    trial = found.where("word IS NULL").groupBy("key").agg(F.min(F.struct("n_at", "with"))["with"].alias("with"))
    trial = trial.select(F.least("key", "with").alias("x"), F.greatest("key", "with").alias("y"))
    # dealt by key for the join, too
    large = found.where("word IS NOT NULL").drop("with", "rest").repartition("key").dropDuplicates(["word", "key"])
    large = large.join(first.select("key", F.col("first").alias("place")), "key")
    large = staged(large)
    earliest = F.min(F.struct("place", "key", "n_at", "parity"))
    pivots = staged(large.groupBy("word").agg(earliest.alias("p")).select("word", "p.*"))
    a, b = _small(pivots).alias("a"), large.alias("b")
    word, apart = F.col("a.word") == F.col("b.word"), F.col("a.key") != F.col("b.key")
    settled, others = _later(source, first, trial.union(_pairs(a.join(b, word & apart & _columns_match("a", "b")))))

    marked = large.join(_small(settled.select("key", F.lit(True).alias("done")).distinct()), "key", "left")
    a, b = marked.alias("a"), marked.alias("b")
    # "done" is asked in a term of both sides, so that both read one exchange
    order = (F.col("a.place") <= F.col("b.place")) & (F.col("b.done").isNull() | (F.col("a.done") & (F.col("a.n_at") < 0)))
    more, left = _later(source, first, _unpacked(found, others).union(_pairs(a.join(b, word & apart & order & _columns_match("a", "b")))))
    matched = staged(settled.union(more).distinct())
    for done in (found, large, pivots, settled, others, more, left):
        drop_staged(done)
    return matched


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without repeated lines, with n_lines and removed_lines.

    ``removed_lines`` holds the numbers, from 0, of the lines that went; the text
    keeps the others.  Rows that are equal in id and text count as one document
    and do not take each other's lines.  The id is of any type with an order;
    null ids come first, and rows of one id are ordered by a hash of the text.
    A null text stays null and has no lines.  Input columns named like the two
    results are replaced, all others stay.
    """
    docs = docs.drop("n_lines", "removed_lines")
    row = F.xxhash64(F.col(id_col), F.col(text_col))
    source = docs.select(F.col(id_col).alias("id"), row.alias("row"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    read = staged(source.mapInArrow(_read_lines, f"id {kind}, row long, line int, key long, other long, slice int, held binary"))
    lines = read.where("key IS NOT NULL").select("key", "other", F.struct("id", "row", "line").alias("place"))
    first = staged(lines.groupBy("key", "other").agg(F.min("place").alias("first")))
    matched = _matched(source, first, _postings(source, rarity_levels(read)))

    # the other lines of a class that has an earlier one go, and so does the first of a matched class
    judged = lines.join(first.join(matched.withColumn("done", F.lit(True)), ["key", "other"], "left"), ["key", "other"])
    gone = judged.where(F.col("done") | ((F.col("place") > F.col("first"))))
    removed = staged(gone.groupBy("place.row").agg(F.array_sort(F.collect_set("place.line")).alias("removed_lines")))
    for done in (read, first, matched):
        drop_staged(done)

    own = F.struct(*(F.col(c) for c in docs.columns)).alias("own")
    n_removed = removed.agg(F.sum(F.size("removed_lines"))).first()[0] or 0
    found = docs.select(own, row.alias("row")).join(F.broadcast(removed) if n_removed <= BROADCAST_LINES else removed, "row", "left")
    # split once: within a transform, it would be split for each line
    found = found.withColumn("parts", F.split(F.col("own").getField(text_col), "\n"))
    text, parts = F.col("own").getField(text_col), F.col("parts")
    kept_lines = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), "removed_lines")
    left = F.when(
        F.size("removed_lines") > 0, F.array_join(F.transform(kept_lines, lambda i: F.get(parts, i)), "\n")
    ).otherwise(text)
    columns = [(left if c == text_col else F.col("own").getField(c)).alias(c) for c in docs.columns]
    n_lines = F.when(text.isNull(), 0).otherwise(F.size(parts))
    return found.select(*columns, F.coalesce("removed_lines", F.array().cast("array<int>")).alias("removed_lines"), n_lines.alias("n_lines"))
