"""State as append-only lines with checkpoints.

A log is a folder of epochs.  An epoch begins with a checkpoint, one file that
holds the compacted state, and goes on with one file per append.  After
``TAIL_FILES`` appends the next one compacts what is there, adds its lines and
begins a new epoch.  So a reader opens a bounded number of files, however often
the state has changed, and reads only lines that still count.

A file appears at once, so a reader sees all lines of an append or none, and a
writer that dies before leaves the log as it was.  One writer per log at a time
is assumed.  The epoch before the newest is kept for readers that have listed it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources import files

TAIL_FILES = 32
_EPOCH = "epoch="


def _as_is(lines: DataFrame) -> DataFrame:
    return lines


@dataclass(frozen=True)
class StateLog:
    """``compact`` keeps the lines that still count; it must not change what readers make of them."""

    path: str
    schema: str
    compact: Callable[[DataFrame], DataFrame] = _as_is

    def read(self, spark: SparkSession) -> DataFrame:
        epoch, _ = self._newest(spark)
        if epoch is None:
            return spark.createDataFrame([], self.schema)
        return spark.read.schema(self.schema).parquet(self._folder(epoch))

    def append(self, spark: SparkSession, lines: list[dict]) -> None:
        names = [field.split()[0] for field in self.schema.split(", ")]
        new = spark.createDataFrame([tuple(line.get(name) for name in names) for line in lines], self.schema)
        epoch, n_files = self._newest(spark)
        if epoch is not None and n_files <= TAIL_FILES:
            new.coalesce(1).write.mode("append").parquet(self._folder(epoch))
            return
        if epoch is not None:
            new = self.compact(self.read(spark)).unionByName(new)
        after = -1 if epoch is None else epoch
        new.coalesce(1).write.mode("overwrite").parquet(self._folder(after + 1))
        for old in self._epochs(spark):
            if old < after:
                files.delete(spark, self._folder(old))

    def _folder(self, epoch: int) -> str:
        return f"{self.path}/{_EPOCH}{epoch:08d}"

    def _epochs(self, spark: SparkSession) -> list[int]:
        names = files.children(spark, self.path)
        return sorted(int(name.removeprefix(_EPOCH)) for name in names if name.startswith(_EPOCH))

    def _newest(self, spark: SparkSession) -> tuple[int | None, int]:
        """The last epoch that has its checkpoint, and its number of files."""
        for epoch in reversed(self._epochs(spark)):
            n_files = sum(name.endswith(".parquet") for name in files.children(spark, self._folder(epoch)))
            if n_files:
                return epoch, n_files
        return None, 0
