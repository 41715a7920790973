"""Published tables on plain Parquet.

A table may be cut into slices (months of a fact, say).  Writing a slice never
touches files that a reader or the running plan may use: it goes to a new
version directory, and a line appended to the ledger makes it current.  All
slices of one publish share one ledger file, so they switch together, and a
run that dies before that leaves the old version in place.  The ledger also has
the rows of every slice, so counting a table opens none of its files.

A table without a natural slice is cut by a hash of its keys.  The function is
part of the ledger and holds until the whole table is written again, so a change
finds the slices of its keys and leaves the others alone.

One writer per table at a time is assumed, as in any pipeline run.
"""

from __future__ import annotations

import atexit
import json
import re
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources import files
from tidemark.sources.statelog import StateLog

# A publish adds one line for each slice that it switches, and one without a slice for the table.
_LEDGER = "slice string, version string, rows long, schema string, slicing string, seq long"
_TABLE = ""
_SLICE = "_slice"
_HASHED = "_hash_slice"
_WHOLE = "all"
_PLAIN_NAME = re.compile(r"[A-Za-z0-9_.-]+")


class EmptyTableError(ValueError):
    """A load that must bring rows brought none."""


@dataclass(frozen=True)
class Slicing:
    """Slices by a hash of key columns: a fixed function of their values and the number of slices."""

    keys: tuple[str, ...]
    slices: int

    def of_row(self) -> Column:
        """Name of the slice that a row belongs to."""
        return F.concat(F.lit("h"), F.pmod(F.xxhash64(*self.keys), F.lit(self.slices)).cast("string"))

    def to_text(self) -> str:
        return json.dumps({"function": "xxhash64", "keys": self.keys, "slices": self.slices})

    @staticmethod
    def from_text(text: str) -> Slicing:
        stored = json.loads(text)
        if stored["function"] != "xxhash64":
            raise ValueError(f"unknown slice function {stored['function']}")
        return Slicing(tuple(stored["keys"]), stored["slices"])


@dataclass(frozen=True)
class Current:
    """What the ledger says about a table: its columns, its slices and their rows."""

    schema: StructType
    versions: dict[str, str]
    rows: dict[str, int]
    seq: int
    slicing: Slicing | None = None

    @property
    def n_rows(self) -> int:
        return sum(self.rows.values())


def _compacted(lines: DataFrame) -> DataFrame:
    """The last line of each slice that is still there, and of the table."""
    last = Window.partitionBy("slice").orderBy(F.desc("seq"))
    kept = lines.withColumn("_nth", F.row_number().over(last)).where("_nth = 1").drop("_nth")
    return kept.where((F.col("version") != "") | (F.col("slice") == _TABLE))


def _ledger_log(base: str, table: str) -> StateLog:
    return StateLog(f"{base}/_ledger/{table}", _LEDGER, _compacted)


def current(spark: SparkSession, base: str, table: str) -> Current | None:
    """Current slices of a table; one line per slice reaches the driver."""
    rows = _compacted(_ledger_log(base, table).read(spark)).collect()
    newest = next((row for row in rows if row["slice"] == _TABLE), None)
    if newest is None:
        return None
    slices = [row for row in rows if row["slice"] != _TABLE]
    return Current(
        StructType.fromJson(json.loads(newest["schema"])),
        {row["slice"]: row["version"] for row in slices},
        {row["slice"]: row["rows"] for row in slices},
        newest["seq"],
        Slicing.from_text(newest["slicing"]) if newest["slicing"] else None,
    )


def exists(spark: SparkSession, base: str, table: str) -> bool:
    return current(spark, base, table) is not None


def read_table(
    spark: SparkSession, base: str, table: str, slices: list[str] | None = None
) -> DataFrame:
    """Current content, or only the listed slices of it.

    The schema is that of the last publish: columns added later are NULL in
    older slices, and columns dropped since are not read.
    """
    found = current(spark, base, table)
    if found is None:
        raise LookupError(f"table {table} has not been published")
    wanted = found.versions
    if slices is not None:
        wanted = {name: wanted[name] for name in slices if name in wanted}
    if not wanted:
        return spark.createDataFrame([], found.schema)
    root = _root(base, table)
    return _read(spark, found.schema, root, [_path(root, v, name) for name, v in wanted.items()])


def publish(df: DataFrame, base: str, table: str, allow_empty: bool = True) -> DataFrame:
    """Replace a table and return its new content.

    An unwanted empty load raises before the switch.
    """
    spark, root, version = df.sparkSession, _root(base, table), uuid.uuid4().hex
    path = _path(root, version, _WHOLE)
    df.write.option("compression", "snappy").parquet(path)
    written = _read(spark, df.schema, root, [path])
    if not allow_empty and written.isEmpty():
        raise EmptyTableError(f"{table}: no rows loaded, the old version stays")
    old = current(spark, base, table)
    ended = dict.fromkeys(old.versions, "") if old else {}
    _switch(df, base, table, old, {**ended, _WHOLE: version}, {_WHOLE: written.count()})
    return written


def publish_hashed(df: DataFrame, base: str, table: str, slicing: Slicing) -> None:
    """Replace a table, cut by a hash of its keys."""
    publish_slices(df.withColumn(_HASHED, slicing.of_row()), base, table, _HASHED, slicing=slicing)


def touched_slices(df: DataFrame, slicing: Slicing) -> list[str]:
    """Names of the slices that hold, or would hold, the keys of ``df``; as many as there are slices at most."""
    return sorted(row[0] for row in df.select(slicing.of_row()).distinct().collect())


def replace_touched(df: DataFrame, base: str, table: str, slicing: Slicing, touched: list[str]) -> None:
    """Replace the named hash slices by the rows of ``df``; all others keep their files."""
    rows = df.withColumn(_HASHED, slicing.of_row())
    publish_slices(rows, base, table, _HASHED, replaced=touched, slicing=slicing)


def publish_slices(
    df: DataFrame,
    base: str,
    table: str,
    slice_by: str,
    replaced: list[str] | None = None,
    slicing: Slicing | None = None,
) -> None:
    """Replace slices of a table; ``slice_by`` is a column of ``df``, not stored.

    ``replaced`` names the slices whose old content ends (None: all of them).
    Other slices that are not in ``df`` stay as they are; writing one that
    exists without naming it raises, as its old rows would be lost.  Names are
    letters, digits, ``_``, ``.`` and ``-``, which no file system escapes.
    """
    spark, root, version = df.sparkSession, _root(base, table), uuid.uuid4().hex
    path = f"{root}/version={version}"
    sliced = balanced(df.withColumnRenamed(slice_by, _SLICE), _SLICE)
    sliced.write.partitionBy(_SLICE).option("compression", "snappy").parquet(path)
    # Directory names and the row counts of file footers: no column of the files is read.
    written = spark.read.schema(f"{_SLICE} string").option("basePath", root).parquet(path)
    counts = {row[0]: row[1] for row in written.groupBy(_SLICE).count().collect()}
    names = list(counts)
    old = current(spark, base, table)
    if replaced is None:
        replaced = list(old.versions) if old else []
    odd = [name for name in names if not _PLAIN_NAME.fullmatch(str(name))]
    if odd:
        raise ValueError(f"{table}: slice names {odd[:3]} have other characters than A-Z, a-z, 0-9, _, . and -")
    kept = set(old.versions) - set(replaced) if old else set()
    if lost := kept & set(names):
        raise ValueError(f"{table}: slices {sorted(lost)[:3]} exist and are not to be replaced")
    slices = {**dict.fromkeys(replaced, ""), **dict.fromkeys(names, version)}
    _switch(df.drop(slice_by), base, table, old, slices, counts, slicing)


def drop_old_versions(spark: SparkSession, base: str, table: str) -> int:
    """Delete versions that no slice uses any more; returns how many.

    To be called when no reader of an older version is left.
    """
    found, root = current(spark, base, table), _root(base, table)
    used = {f"version={v}" for v in found.versions.values()} if found else set()
    old = [name for name in files.children(spark, root) if name not in used]
    for name in old:
        files.delete(spark, f"{root}/{name}")
    return len(old)


def balanced(df: DataFrame, column: str) -> DataFrame:
    """Rows of one value together, few files each; a large value is split over tasks."""
    return df.hint("rebalance", F.col(column))


_staged_paths: dict[str, SparkSession] = {}


def stage(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write a frame that several plans read, and read it back.

    Goes to the folder of ``spark.checkpoint.dir``, which executors share, so
    nothing is recomputed or lost when one of them goes away.
    """
    path = path or staging_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staging_path(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted when the process ends at the latest."""
    path = f"{checkpoint_folder(spark)}/staged-{uuid.uuid4().hex}"
    _staged_paths[path] = spark
    return path


def unstage(spark: SparkSession, path: str) -> None:
    """Delete a staged frame after its last use."""
    _staged_paths.pop(path, None)
    files.delete(spark, path)


@atexit.register
def unstage_all() -> None:
    """Delete whatever is still staged; called when the process ends, too."""
    for path, spark in list(_staged_paths.items()):
        if spark.sparkContext._jsc is not None:
            unstage(spark, path)


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's shared folder; a temporary one only in local mode."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
    return context.getCheckpointDir()


def _switch(
    df: DataFrame,
    base: str,
    table: str,
    old: Current | None,
    slices: dict[str, str],
    rows: dict[str, int],
    slicing: Slicing | None = None,
) -> None:
    """Make versions current; an empty version ends a slice."""
    seq = (old.seq if old else 0) + 1
    text = slicing.to_text() if slicing else None
    lines = [{"slice": _TABLE, "version": "", "schema": df.schema.json(), "slicing": text, "seq": seq}]
    lines += [{"slice": name, "version": v, "rows": rows.get(name, 0), "seq": seq} for name, v in slices.items()]
    _ledger_log(base, table).append(df.sparkSession, lines)


def _read(spark: SparkSession, schema: StructType, root: str, paths: list[str]) -> DataFrame:
    files = spark.read.schema(schema).option("basePath", root).parquet(*paths)
    return files.select(*schema.fieldNames())


def _path(root: str, version: str, name: str) -> str:
    return f"{root}/version={version}/{_SLICE}={name}"


def _root(base: str, table: str) -> str:
    return f"{base}/tables/{table}"
