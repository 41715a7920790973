"""SimHash near-dedup with the pigeonring filter.

A document's 64-bit fingerprint is the bitwise majority of the hashes of its
word shingles.  Documents of one fingerprint form a class, and only classes are
compared.

Pigeonring: cut the 64 bits into a ring of m segments.  If two fingerprints
differ in at most t bits, then from some segment on every chain of l = 1..m
consecutive segments differs in at most floor(l * t / m) bits.  While that
budget is zero the segments are equal, so these leading segments are the join
key; the longer chains prune a pair before its whole distance is taken.

A key shared by more than ``HOT_KEY`` fingerprints would give a square of
pairs.  Its fingerprints meet elsewhere instead: two of them differ in at most
two bits exactly if one value is within one bit of both, and such a value has
at most 65 of them near it.  So each names its 65 values and is linked to the
smallest that names the same: exact, linear, and never more than 65 in a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import staged
from tidemark.llm.components import components

BITS = 64
SHINGLE = 3
SEED = 42
DISTANCE = 2
SEGMENTS = 5
HOT_KEY = 32
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the shingles' XXH64; zero without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    total = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), np.uint64, total)
    ones = np.zeros(BITS, np.int64)
    for low in range(0, total, _CHUNK):
        part = hashes[low : low + _CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): fp holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(text.as_py(), shingle) for text in batch.column(1)]
            bits = pa.array(np.array(found, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), bits], names=["id", "fp"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, fp long")


def _signed(bits: int) -> int:
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def segment_masks(segments: int) -> list[int]:
    cuts = [i * BITS // segments for i in range(segments + 1)]
    return [(1 << high) - (1 << low) for low, high in zip(cuts, cuts[1:])]


def chains(segments: int, distance: int) -> list[list[tuple[int, int]]]:
    """For each start, (mask of a chain, bits it may differ in) by growing length."""
    masks = segment_masks(segments)
    out = []
    for start in range(segments):
        mask, own = 0, []
        for length in range(1, segments + 1):
            mask |= masks[(start + length - 1) % segments]
            own.append((mask, length * distance // segments))
        out.append(own)
    return out


def links(fps: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS) -> DataFrame:
    """(a, b): edges that connect just the distinct fingerprints within the distance."""
    if distance != 2 or segments <= distance:
        raise ValueError("built for two bits and more than two segments")
    rings = chains(segments, distance)
    keys = [[mask for mask, budget in ring if not budget][-1] for ring in rings]
    entry = F.array(
        *(F.struct(F.lit(i).alias("start"), F.col("fp").bitwiseAND(_signed(m)).alias("key")) for i, m in enumerate(keys))
    )
    entries = fps.select("fp", F.explode(entry).alias("e")).select("fp", "e.start", "e.key")
    sizes = entries.groupBy("start", "key").count().where("count > 1")
    shared = staged(entries.join(sizes, ["start", "key"]))

    a, b = (shared.where(F.col("count") <= HOT_KEY).alias(x) for x in "ab")
    differ = F.col("a.fp").bitwiseXOR(F.col("b.fp"))
    within = reduce(
        lambda rest, i: F.when(F.col("a.start") == i, _within(differ, rings[i])).otherwise(rest),
        range(segments),
        F.lit(False),
    )
    same = (F.col("a.start") == F.col("b.start")) & (F.col("a.key") == F.col("b.key"))
    near = a.join(b, same & (F.col("a.fp") < F.col("b.fp")) & within).select(
        F.col("a.fp").alias("a"), F.col("b.fp").alias("b")
    )

    hot = shared.where(F.col("count") > HOT_KEY).select("fp").distinct()
    flips = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(_signed(1 << i)) for i in range(BITS)))
    met = (
        hot.select("fp", F.explode(flips).alias("value"))
        .groupBy("value")
        .agg(F.collect_list("fp").alias("fps"))
        .where(F.size("fps") > 1)
        .select(F.array_min("fps").alias("a"), F.explode("fps").alias("b"))
        .where("a < b")
    )
    return near.unionByName(met).distinct()


def _within(differ: Column, ring: list[tuple[int, int]]) -> Column:
    checks = [F.bit_count(differ.bitwiseAND(_signed(m))) <= budget for m, budget in ring if budget]
    return reduce(Column.__and__, checks)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE
) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id.

    The component is the smallest id that can be reached over fingerprints
    within two bits, the document's own included.  A null text counts as empty;
    texts without words share fingerprint zero and are linked like any other.
    Repeated rows are returned each.  A null id is never a component's name
    unless all its members are null.  An empty table gives no rows; other
    columns are not read.
    """
    own = staged(fingerprints(docs, id_col, text_col, shingle))
    classes = staged(own.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(classes))
    named = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    found = own.join(named.join(names, "root").select("fp", "component_id"), "fp")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select(F.col("id").alias(id_col), digits.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The documents, one of each component: that with the smallest id.

    Rows that repeat an id count as one document.  Of a component without any
    id one row stays.
    """
    groups = near_duplicates(docs, id_col, text_col, shingle)
    stays = groups.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("stays")).distinct()
    kept = docs.join(stays, docs[id_col].eqNullSafe(stays["stays"]), "left_semi")
    return kept.dropDuplicates([id_col])
