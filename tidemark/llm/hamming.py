"""Exact top-k search on binary codes by incremental multi-index hashing.

A vector's code holds the signs of its 64 numbers.  Codes are cut into m
segments, each indexed by its value.  A query looks up, segment by segment, all
values within radius 0 of its own, then 1, 2, ...; what it meets is verified by
the whole Hamming distance.  After segment a at radius r every code within
m * r + a bits has been met, so a query stops as soon as its k-th distance is
within that bound: the answer is exact.

Rows of one code are one entry with its k + 1 smallest ids, which is all that a
query can ever need of them, so a vector that a third of all rows share is one
entry.  Entries are dealt into blocks by hash, queries into blocks of their own,
and each pair of blocks is one bounded task with an index of its own; the best
of all blocks are merged per query.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import drop_staged, staged

BITS = 64
K = 10
BLOCK_CODES = 1 << 16
BLOCK_QUERIES = 1 << 13
_CHUNK = 128


def codes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, code) of the vectors of 64 numbers; others, null ones too, have no code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            signs = np.packbits(numbers.reshape(-1, BITS) > 0, axis=1, bitorder="little")
            code = np.ascontiguousarray(signs).view("<i8").ravel()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(code)], ["id", "code"])

    whole = vectors.where(F.col(id_col).isNotNull() & (F.size(vector_col) == BITS))
    source = whole.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return source.mapInArrow(run, "id long, code long")


class Index:
    """Segment tables of a block of codes; weights: how many ids an entry answers for."""

    def __init__(self, block: np.ndarray, weights: np.ndarray):
        self.codes, self.weights = block, weights
        segments = max(2, round(BITS / max(8.0, np.log2(max(2, len(block))))))
        ends = [i * BITS // segments for i in range(segments + 1)]
        self.cuts = list(zip(ends, ends[1:]))
        self.tables = []
        for low, high in self.cuts:
            values = self._segment(block, low, high)
            counts = np.bincount(values, minlength=1 << (high - low))
            self.tables.append((np.argsort(values, kind="stable"), np.concatenate([[0], np.cumsum(counts)])))

    @staticmethod
    def _segment(values: np.ndarray, low: int, high: int) -> np.ndarray:
        return ((values >> np.uint64(low)) & np.uint64((1 << (high - low)) - 1)).astype(np.int64)

    def search(self, queries: np.ndarray, wanted: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, entry, distance): all entries up to the distance that covers the wanted number of ids."""
        for low in range(0, len(queries), _CHUNK):
            part = queries[low : low + _CHUNK]
            q, entry, distance = self._search(part, wanted)
            yield q + low, entry, distance

    def _search(self, queries: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m = len(self.cuts)
        seen = np.zeros((len(queries), len(self.codes)), bool)
        held = np.zeros((len(queries), BITS + 1), np.int64)
        met: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        active = np.arange(len(queries))
        for radius in range(max(high - low for low, high in self.cuts) + 1):
            for a, (low, high) in enumerate(self.cuts):
                order, offsets = self.tables[a]
                flips = [sum(1 << bit for bit in bits) for bits in combinations(range(high - low), radius)]
                if flips:
                    values = self._segment(queries[active], low, high)[:, None] ^ np.array(flips, np.int64)
                    first, sizes = offsets[values], offsets[values + 1] - offsets[values]
                    sizes_flat = sizes.ravel()
                    who = np.repeat(np.repeat(active, len(flips)), sizes_flat)
                    start = np.repeat(first.ravel() - (np.cumsum(sizes_flat) - sizes_flat), sizes_flat)
                    entry = order[start + np.arange(len(who))]
                    new = ~seen[who, entry]
                    who, entry = who[new], entry[new]
                    seen[who, entry] = True
                    distance = np.bitwise_count(queries[who] ^ self.codes[entry]).astype(np.int64)
                    np.add.at(held, (who, distance), self.weights[entry])
                    met.append((who, entry, distance))
                covered = m * radius + a
                within = held[active, : covered + 1].sum(axis=1)
                active = active[within < wanted]
                if not len(active):
                    break
            if not len(active):
                break
        who, entry, distance = (np.concatenate(parts) for parts in zip(*met))
        enough = np.cumsum(held, axis=1) >= wanted
        limit = np.where(enough.any(axis=1), enough.argmax(axis=1), BITS)
        keep = distance <= limit[who]
        return who[keep], entry[keep], distance[keep]


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = K,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block_codes: int = BLOCK_CODES,
    block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """(query_id, rank, neighbor_id, distance): the k nearest other rows of each query.

    Ranks run from 1 by Hamming distance and then id.  A query's own id is no
    answer to it, wherever it stands.  Rows that repeat an id and code count
    once; null ids and vectors of another length than 64, null ones too, are
    neither queries nor answers; NaN counts as not positive.  Fewer rows than k
    give fewer answers.
    """
    spark = vectors.sparkSession
    own = staged(codes(vectors, id_col, vector_col).distinct())
    asked = staged(codes(queries, id_col, vector_col).distinct())
    smallest = Window.partitionBy("code").orderBy("id")
    entries = staged(
        own.withColumn("n", F.row_number().over(smallest))
        .where(F.col("n") <= k + 1)
        .groupBy("code")
        .agg(F.array_sort(F.collect_list("id")).alias("ids"))
    )
    looked_up = asked.select("code").distinct()
    n_entries, n_queries = entries.count(), looked_up.count()
    tasks = min(spark.sparkContext.defaultParallelism, -(-n_entries // 4096))
    blocks = max(1, -(-n_entries // block_codes), tasks)
    query_blocks = max(1, -(-n_queries // block_queries))

    def dealt(frame: DataFrame, own_block: str, n: int, other: str, m: int) -> DataFrame:
        block = F.pmod(F.xxhash64("code"), F.lit(n)).alias(own_block)
        return frame.select("*", block, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long"))).alias(other))

    def search(asked_codes: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        columns = ["code", "distance", "id"]
        if asked_codes.empty or block.empty:
            return pd.DataFrame({c: pd.Series(dtype=np.int64) for c in columns})
        mine = asked_codes["code"].to_numpy(np.int64)
        ids = block["ids"].tolist()
        weights = np.array([len(x) for x in ids])
        index = Index(block["code"].to_numpy(np.int64).view(np.uint64), weights)
        flat = np.concatenate(ids)
        begins = np.cumsum(weights) - weights
        found = []
        for q, entry, distance in index.search(mine.view(np.uint64), k + 1):
            times = weights[entry]
            at = np.repeat(begins[entry] - (np.cumsum(times) - times), times) + np.arange(times.sum())
            frame = pd.DataFrame({"q": np.repeat(q, times), "distance": np.repeat(distance, times), "id": flat[at]})
            found.append(frame.sort_values(["q", "distance", "id"]).groupby("q").head(k + 1))
        best = pd.concat(found)
        return best.assign(code=mine[best["q"]])[columns]

    keys = ["query_block", "block"]
    left = dealt(looked_up, "query_block", query_blocks, "block", blocks).groupBy(*keys)
    right = dealt(entries, "block", blocks, "query_block", query_blocks).groupBy(*keys)
    local = left.cogroup(right).applyInPandas(search, "code long, distance long, id long")
    nearest = Window.partitionBy("code").orderBy("distance", "id")
    merged = staged(
        local.withColumn("n", F.row_number().over(nearest))
        .where(F.col("n") <= k + 1)
        .groupBy("code")
        .agg(F.array_sort(F.collect_list(F.struct("distance", "id"))).alias("all"))
    )
    for done in (own, entries):
        drop_staged(done)
    others = F.slice(F.filter("all", lambda x: x["id"] != F.col("query_id")), 1, k)
    answers = asked.withColumnRenamed("id", "query_id").join(merged, "code").select("query_id", F.posexplode(others))
    return answers.select(
        "query_id", (F.col("pos") + 1).cast("long").alias("rank"),
        F.col("col.id").alias("neighbor_id"), F.col("col.distance").alias("distance"),
    )
