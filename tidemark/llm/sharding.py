"""Sharding by histogram sort: near-equal bytes, one exchange.

Rows are ordered by a 63-bit key: 40 bits of the text's hash, so that equal
texts lie side by side, then 23 bits of a hash of the row.  Each round counts,
in every partition, the exact bytes below a set of probe keys; the sums tell
between which probes each wanted boundary lies, and the next probes go there.
Boundaries that meet the tolerance, or that no further key can improve, become
splitters.  Probes lie between texts while that is possible, so equal texts
are separated only if they outweigh the tolerance.

Every shard is cut further into ranges of about ``range_bytes``, which are the
units of the exchange: rows move once, and a range is one sort however many
copies a text has.  The driver and each task hold a few numbers per range, so
there are at most ``MAX_RANGES``; beyond half a terabyte ranges get larger
instead, at 100 TB 1.5 GB.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import staged

ROW_BITS = 23
KEYS = 1 << 63
TOLERANCE = 0.001
RANGE_BYTES = 8 << 20
MAX_RANGES = 1 << 16
MAX_PROBES = 1 << 16

_COUNTS = "bucket int, bytes long, rows long, first long, last long"


@dataclass
class Wanted:
    """A boundary that is looked for: keys below it should weigh ``target``."""

    target: float
    tolerance: float
    low: int = 0
    high: int = KEYS
    below_low: int = 0
    below_high: int = 0
    splitter: int | None = None

    def settle(self) -> None:
        """Take an end of the interval if it is good enough or nothing lies between."""
        ends = [(abs(self.below_low - self.target), self.low), (abs(self.below_high - self.target), self.high)]
        good = [end for end in ends if end[0] <= self.tolerance]
        between_texts = [end for end in good if end[1] % (1 << ROW_BITS) == 0]
        if good or self.high - self.low <= 1:
            self.splitter = min(between_texts or good or ends)[1]


def histogram(keyed: DataFrame, probes: list[int]) -> dict[int, tuple[int, int, int, int]]:
    """Bytes, rows, first and last key of each bucket between probes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, parts = np.array(probes, np.uint64), []
        for batch in batches:
            key = batch.column(0).to_numpy().astype(np.uint64)
            frame = pd.DataFrame({"bucket": np.searchsorted(cuts, key, "right"), "key": key.astype(np.int64)})
            frame["bytes"] = batch.column(1).to_numpy()
            parts.append(_summed(frame.assign(rows=1, first=frame["key"], last=frame["key"])))
        if parts:
            yield pa.RecordBatch.from_pandas(
                _summed(pd.concat(parts)), schema=pa.schema([("bucket", pa.int32()), *((n, pa.int64()) for n in ("bytes", "rows", "first", "last"))])
            )

    found = (
        keyed.select("_key", "_size")
        .mapInArrow(count, _COUNTS)
        .groupBy("bucket")
        .agg(F.sum("bytes"), F.sum("rows"), F.min("first"), F.max("last"))
        .collect()
    )
    return {row[0]: tuple(row)[1:] for row in found}


def _summed(frame: pd.DataFrame) -> pd.DataFrame:
    rules = {"bytes": "sum", "rows": "sum", "first": "min", "last": "max"}
    return frame.groupby("bucket", as_index=False).agg(rules)


def probes_in(low: int, high: int, count: int) -> list[int]:
    """Up to count keys inside (low, high), between texts where there are such keys."""
    step = 1 << ROW_BITS
    first, last = low // step + 1, (high - 1) // step
    if last < first:
        step, first, last = 1, low + 1, high - 1
    total = last - first + 1
    if total <= count:
        return [step * x for x in range(first, last + 1)]
    return [step * (first + total * (2 * i + 1) // (2 * count)) for i in range(count)]


def range_count(total: int, shards: int, range_bytes: int) -> int:
    """How many ranges all shards have, the same number each."""
    most = max(1, MAX_RANGES // shards)
    return shards * min(most, max(1, -(-total // (shards * range_bytes))))


def find_splitters(keyed: DataFrame, total: int, shards: int, ranges: int, tolerance: float) -> list[int]:
    """Keys that part the rows into ranges; every (ranges / shards)-th ends a shard."""
    per_shard = ranges // shards
    wanted = [
        Wanted(total * i / ranges, (tolerance if i % per_shard == 0 else 0.1 / per_shard) * total / shards, below_high=total)
        for i in range(1, ranges)
    ]
    while open_ones := [w for w in wanted if w.splitter is None]:
        each = max(4, min(MAX_PROBES // len(open_ones), 64))
        spans: dict[tuple[int, int], int] = {}
        for w in open_ones:
            spans[w.low, w.high] = spans.get((w.low, w.high), 0) + each
        probes = sorted({p for (low, high), n in spans.items() for p in (low, *probes_in(low, high, n), high)})
        counted = histogram(keyed, probes)
        sums = np.cumsum([counted.get(i, (0,))[0] for i in range(len(probes) + 1)])
        for w in open_ones:
            # probes[i] has sums[i] below it; the target lies in the bucket i
            i = int(np.searchsorted(sums, w.target, "left"))
            low = (probes[i - 1], int(sums[i - 1])) if i else (0, 0)
            high = (probes[i], int(sums[i])) if i < len(probes) else (KEYS, total)
            _, _, first, last = counted[i]
            w.low, w.below_low, w.high, w.below_high = *low, *high
            w.settle()
            if w.splitter is None:
                # nothing lies before the first and after the last key there
                w.low, w.high = max(w.low, first), min(w.high, last + 1)
                w.settle()
    return sorted(w.splitter for w in wanted)


def shard(
    docs: DataFrame,
    shards: int = 8,
    tolerance: float = TOLERANCE,
    range_bytes: int = RANGE_BYTES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows with size (UTF-8 bytes plus 1), shard and slot (from 0, gapless).

    Shards weigh the same but for the tolerance (a share of a shard) or for one
    row.  A null text weighs 1, like an empty one.  Repeated rows are rows of
    their own.  An empty table gives no rows.  Input columns named size, shard
    or slot are replaced; _row, _size and _key are not kept.
    """
    text = F.col(text_col)
    row = F.monotonically_increasing_id()
    kept = docs.drop("size", "shard", "slot", "_row", "_size", "_key")
    rows = kept.withColumn("_row", row).withColumn("_size", F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1)
    text_bits = F.shiftrightunsigned(F.xxhash64(text), 24)
    row_bits = F.shiftrightunsigned(F.xxhash64(id_col, "_row"), 64 - ROW_BITS)
    # written once, so that the row numbers stay what they are
    keyed = staged(rows.withColumn("_key", F.shiftleft(text_bits, ROW_BITS).bitwiseOR(row_bits)))

    total = keyed.agg(F.sum("_size")).first()[0] or 0
    ranges = range_count(total, shards, range_bytes)
    splitters = find_splitters(keyed, total, shards, ranges, tolerance) if total else []
    counted = histogram(keyed, splitters) if total else {}
    per_shard = ranges // shards
    rows_in = np.array([counted.get(i, (0, 0))[1] for i in range(ranges)]).reshape(shards, per_shard)
    before = (np.cumsum(rows_in, axis=1) - rows_in).ravel()

    @F.pandas_udf("range int, before long")
    def placed(key: pd.Series) -> pd.DataFrame:
        index = np.searchsorted(np.array(splitters, np.uint64), key.to_numpy().astype(np.uint64), "right")
        return pd.DataFrame({"range": index.astype(np.int32), "before": before[index]})

    in_range = Window.partitionBy("_at.range").orderBy("_key", "_row")
    return (
        keyed.withColumn("_at", placed("_key"))
        .withColumn("slot", F.col("_at.before") + F.row_number().over(in_range) - 1)
        .withColumn("shard", F.floor(F.col("_at.range") / per_shard).cast("int"))
        .withColumnRenamed("_size", "size")
        .drop("_row", "_key", "_at")
    )
