"""Near-dedup of documents by an exact set-similarity join of word shingles.

A document is the set of its runs of five words (ASCII-lower-cased, split at
white space); a shorter text is one run, a text without words the empty run.
Documents of Jaccard 0.8 or more are linked, and linked ones form a group.  No
fingerprint of 64 bits can promise that: such pairs differ in up to a dozen bits.

Equal sets are one class.  Between classes, shingles are ordered by rarity, and
two sets of the wanted similarity share one of their rarest n - ceil(0.8 n) + 1.
These prefix shingles are the join key; those that one class holds alone are
dropped as soon as they are met.  Length and position prune inside the join, and
what is left is verified on whole sets.  A shingle is known by 64 bits.

Of a prefix shingle that more than ``STAR_FROM`` classes hold, first every class
meets one holder only; then only classes that are not of one group yet meet.

Rarity comes from every ``RARITY_OF``-th document.  It sets the order of the
shingles, which must only be the same everywhere: no result depends on it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import drop_staged, staged
from tidemark.llm.components import components
from tidemark.llm.linededup import SIMILAR, _Hashes, _small, prefix_length, text_parts, word_hashes

SHINGLE = 5
BUCKET_BITS = 20
STAR_FROM = 32
RARITY_OF = 8
#: A frame of columns row and text to one of (row, component_id): groups found by another method.
Groups = Callable[[DataFrame], DataFrame]
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def shingles(text: str | None, hashes: _Hashes) -> np.ndarray:
    """The different shingles of a text, ascending."""
    words = (text or "").encode().lower().split()
    own = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    mixed = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        mixed = mixed * _ODD[0] + own[i : len(words) - size + 1 + i]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _ODD[1]
    return np.unique(mixed ^ (mixed >> np.uint64(32)))


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Parts of the batches, whose last column is the text, with the sets of their rows."""
    for batch in text_parts(batches):
        hashes = word_hashes()
        yield batch, [shingles(text.as_py(), hashes) for text in batch.column(batch.num_columns - 1)]


def _key(own: np.ndarray) -> np.uint64:
    return own.sum(dtype=np.uint64)


def _bucket(own: np.ndarray) -> np.ndarray:
    return (own >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _longs(values: np.ndarray | list) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key of each document's set, and how many sets hold a shingle of each bucket."""
    names = ["id", "row", "key", "bucket", "sets"]
    for batch, sets in _sets(batches):
        keys = [_key(own) for own in sets]
        n = len(sets)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], _longs(keys), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], names)
        chosen = {key: own for key, own in zip(keys, sets) if int(key) % RARITY_OF == 0}
        if chosen:
            buckets, counts = np.unique(_bucket(np.concatenate(list(chosen.values()))), return_counts=True)
            n = len(buckets)
            empty = [pa.nulls(n, batch.column(0).type), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())]
            yield pa.RecordBatch.from_arrays([*empty, pa.array(buckets.astype(np.int32)), pa.array(counts)], names)


def _levels(read: DataFrame) -> np.ndarray:
    sums = read.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("sets").alias("n")).where("n > 1")
    found = sums.select("bucket", F.least(F.lit(120), F.ceil(F.log2("n") * 4)).cast("tinyint").alias("level")).toArrow()
    levels = np.zeros(1 << BUCKET_BITS, np.int8)
    levels[found["bucket"].to_numpy()] = found["level"].to_numpy()
    return levels


def _postings(source: DataFrame, levels: np.ndarray) -> DataFrame:
    """Prefix shingles that several classes hold: word, key, n and place in the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _sets(batches):
            word, key, n_at = [], [], []
            for own_key, own in {_key(own): own for own in sets}.items():
                prefix = np.lexsort((own, levels[_bucket(own)]))[: prefix_length(len(own))]
                word.append(own[prefix])
                key.append(np.full(len(prefix), own_key))
                n_at.append((np.uint64(len(own)) << np.uint64(32)) + np.arange(len(prefix), dtype=np.uint64))
            if word:
                yield pa.RecordBatch.from_arrays([_longs(np.concatenate(c)) for c in (word, key, n_at)], ["word", "key", "n_at"])

    found = source.select("text").mapInArrow(run, "word long, key long, n_at long")
    # dealt by the word, all of this is one exchange
    once = found.repartition("word").groupBy("word", "key").agg(F.first("n_at").alias("n_at"))
    shared = once.withColumn("holders", F.count("*").over(Window.partitionBy("word"))).where("holders > 1")
    n, at = F.shiftright("n_at", 32), F.col("n_at").bitwiseAND(0xFFFFFFFF)
    return shared.select("word", "key", n.alias("n"), at.alias("at"), "holders")


def _may_match() -> Column:
    """Length and position allow the similarity: all that two sets share stands from the first shared shingle on."""
    num, den = SIMILAR
    n1, n2, at1, at2 = (F.col(f"{x}.{c}") for c in ("n", "at") for x in "ab")
    needed = F.ceil((n1 + n2) * num / F.lit(num + den))
    return (
        (F.col("a.word") == F.col("b.word"))
        & (den * F.least(n1, n2) >= num * F.greatest(n1, n2))
        & (F.least(n1 - at1, n2 - at2) >= needed)
    )


def _verified(source: DataFrame, classes: DataFrame, joined: DataFrame) -> DataFrame:
    """(a, b): the different pairs of joined keys whose sets are similar."""
    num, den = SIMILAR
    pairs = staged(joined.select(F.least("a.key", "b.key").alias("a"), F.greatest("a.key", "b.key").alias("b")).distinct())
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(classes.select("key", "row"), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _sets(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.view(np.int64) for own in sets], pa.list_(pa.int64()))], ["key", "own"])

    texts = source.join(_small(staged(wanted)), "row").select("key", "text")
    own = staged(texts.mapInArrow(run, "key long, own array<long>").groupBy("key").agg(F.first("own").alias("own")))
    sides = [own.select(F.col("key").alias(x), F.col("own").alias(f"own_{x}")) for x in "ab"]
    shared = F.size(F.array_intersect("own_a", "own_b"))
    similar = den * shared >= num * (F.size("own_a") + F.size("own_b") - shared)
    edges = staged(pairs.join(sides[0], "a").join(sides[1], "b").where(similar).select("a", "b"))
    for done in (pairs, own):
        drop_staged(done)
    return edges


def _grouped(own: DataFrame, groups: DataFrame) -> DataFrame:
    """(a, b): edges that connect the keys of each group, from its smallest key to the others."""
    keys = own.select("row", "key").join(groups.select("row", "component_id"), "row").select("component_id", "key").distinct()
    least = keys.groupBy("component_id").agg(F.min("key").alias("a"))
    return keys.join(least, "component_id").where("a < key").select("a", F.col("key").alias("b"))


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: Groups | None = None
) -> DataFrame:
    """One row per document: id and component_id, the smallest id that can be reached over similar documents.

    ``also`` gives further groups, whose documents are linked, too.  A null text
    counts as empty.  Repeated rows are returned each.  A null id is never a
    component's name unless all its members are null.  An empty table gives no
    rows; other columns are not read.
    """
    row = F.xxhash64(F.col(id_col), F.col(text_col))
    source = docs.select(F.col(id_col).alias("id"), row.alias("row"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    read = staged(source.mapInArrow(_read, f"id {kind}, row long, key long, bucket int, sets long"))
    own = read.where("key IS NOT NULL").select("id", "row", "key")
    classes = staged(own.groupBy("key").agg(F.min("id").alias("least"), F.min("row").alias("row")))
    postings = staged(_postings(source, _levels(read)))

    pivots = postings.where(F.col("holders") > STAR_FROM).groupBy("word").agg(F.min(F.struct("key", "n", "at")).alias("p"))
    a, b = _small(staged(pivots.select("word", "p.*"))).alias("a"), postings.alias("b")
    star = _verified(source, classes, a.join(b, _may_match() & (F.col("a.key") != F.col("b.key"))))
    roots = components(star)

    known = postings.join(_small(roots.withColumnRenamed("node", "key")), "key", "left")
    known = staged(known.withColumn("root", F.coalesce("root", "key")))
    a, b = known.alias("a"), known.alias("b")
    apart = (F.col("a.root") != F.col("b.root")) & (F.col("a.key") < F.col("b.key"))
    edges = star.unionByName(_verified(source, classes, a.join(b, apart & _may_match())))
    if also is not None:
        edges = edges.unionByName(_grouped(own, also(source.select("row", "text"))))

    named = classes.join(components(edges), classes["key"] == F.col("node"), "left").select(
        "key", "least", F.coalesce("root", "key").alias("root")
    )
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    found = own.join(named.join(names, "root").select("key", "component_id"), "key")
    return found.select(F.col("id").alias(id_col), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: Groups | None = None) -> DataFrame:
    """The documents, one of each group: that with the smallest id.

    Rows that repeat an id count as one document.  Of a group without any id one
    row stays.  ``also`` is that of ``near_groups``.
    """
    groups = near_groups(docs, id_col, text_col, also)
    stays = groups.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("stays")).distinct()
    kept = docs.join(stays, docs[id_col].eqNullSafe(stays["stays"]), "left_semi")
    return kept.dropDuplicates([id_col])
