"""The stages of a run, in order: ingest, clean, load, snapshot, build, test.

Each stage reads published tables and publishes its own, so a lost executor
costs the running job only and a failed stage can be run again.  The first
error ends the run; no later stage executes.  Tables of one stage do not depend
on each other, so their jobs run side by side.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import partial, reduce
from hashlib import md5

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.columns import month_key
from tidemark.operators.dedup import require_unique
from tidemark.operators.history import NTZ, VALID_TO, open_versions, scd2_start, scd2_step
from tidemark.operators.upsert import increment, upsert
from tidemark.plans import checks, models
from tidemark.plans.cleaning import SPECS, rejected, silver, silver_refresh, valid
from tidemark.plans.warehouse import to_raw
from tidemark.schemas import TABLES
from tidemark.sources import store
from tidemark.sources.bronze import read_batch, read_bronze
from tidemark.sources.concurrent import together
from tidemark.sources.ingest import SOURCES, Ingested, extract
from tidemark.sources.marks import last_build, log_build, log_cleaned, logged_batches, waiting

HISTORY = "customers_snapshot"
#: Slices of a Silver table by the hash of its keys; many for a large table, so that a batch touches few bytes.
SILVER_SLICES = 16
_OPEN = "open"


@dataclass(frozen=True)
class CleanCounts:
    """Row counts of a cleaning run, taken from what was written."""

    bronze: int
    valid: int
    duplicates: int
    rejected: int
    silver: int


class FailedChecks(AssertionError):
    """Checks with severity error found failing rows."""


def ingest(
    sources: dict[str, DataFrame],
    base: str,
    system: str,
    ingested_at: str | None = None,
    full: bool = False,
    max_rows_per_file: int = 0,
) -> dict[str, Ingested]:
    """Extract every given source; keys are names of ``SOURCES``.

    ``full`` reads whole sources, whatever their mark: late rows come with it.
    """
    options = {"ingested_at": ingested_at, "full": full, "max_rows_per_file": max_rows_per_file}
    return together(
        {name: partial(extract, df, SOURCES[name], base, system, **options) for name, df in sources.items()}
    )


def clean(spark: SparkSession, base: str, table: str, run_ts: str, slices: int = SILVER_SLICES) -> CleanCounts:
    """Rebuild Silver and rejects of a table from its whole Bronze history.

    Bronze is scanned twice, once per output: rejects need no shuffle, and a
    stored copy of the classified history would cost more than a second scan.
    The counts come from Parquet footers of what was written, so task retries
    cannot distort them.  Silver is cut into ``slices`` by the hash of its keys;
    batches cleaned later keep to that cut.
    """
    spec = SPECS[table]
    pending = waiting(spark, base, table)
    bronze = read_bronze(spark, base, table)
    if bronze is None:
        raise LookupError(f"{table}: no Bronze data")
    # a batch that failed its count check is not logged and is no part of the history
    bronze = bronze.join(logged_batches(spark, base, table), "_batch_id", "left_semi")
    n_bronze = bronze.count()
    bad = store.publish(rejected(bronze, spec, run_ts), base, f"rejected_{table}").count()
    store.publish_hashed(silver(bronze, spec, run_ts), base, f"silver_{table}", store.Slicing(spec.keys, slices))
    good = store.current(spark, base, f"silver_{table}").n_rows
    log_cleaned(spark, base, table, pending)
    n_valid = n_bronze - bad
    return CleanCounts(n_bronze, n_valid, n_valid - good, bad, good)


def clean_pending(spark: SparkSession, base: str, table: str, run_ts: str) -> CleanCounts:
    """Fold the Bronze batches that Silver has not seen into Silver and rejects.

    Reads those batches and the Silver slices that their keys belong to, and
    writes these slices only, with the same result as ``clean`` but for the
    processing time of rows that did not change.  A batch left over by a failed
    run is picked up by the next one; folding a batch twice changes nothing.
    However many batches wait, a slice is read and written once.  Rejects of a
    batch are a slice named by a hash of its id, which may hold any characters.
    """
    spec, name = SPECS[table], f"silver_{table}"
    pending = waiting(spark, base, table)
    before = store.current(spark, base, name)
    if not pending:
        return CleanCounts(0, 0, 0, 0, before.n_rows)
    batches = [read_batch(spark, base, table, row["batch_id"], row["ingested_at"]) for row in pending]
    rows = reduce(DataFrame.unionByName, batches)
    parts = [f"batch-{md5(row['batch_id'].encode()).hexdigest()}" for row in pending]
    bad = rejected(rows, spec, run_ts).withColumn("_part", F.concat(F.lit("batch-"), F.md5("_batch_id")))
    store.publish_slices(bad, base, f"rejected_{table}", "_part", replaced=parts)
    touched = store.touched_slices(valid(rows, spec), before.slicing)
    if touched:
        old = store.read_table(spark, base, name, touched)
        store.replace_touched(silver_refresh(old, rows, spec, run_ts), base, name, before.slicing, touched)
    log_cleaned(spark, base, table, pending)
    known = [row["rows"] for row in pending]
    n_rows = sum(known) if None not in known else rows.count()
    after, rejects = (store.current(spark, base, t) for t in (name, f"rejected_{table}"))
    n_bad = sum(rejects.rows.get(part, 0) for part in parts)
    n_valid = n_rows - n_bad
    return CleanCounts(n_rows, n_valid, n_valid + before.n_rows - after.n_rows, n_bad, after.n_rows)


def refresh_silver(
    spark: SparkSession, base: str, table: str, run_ts: str, rebuild: bool, slices: int = SILVER_SLICES
) -> CleanCounts:
    """Batchwise once there is a Silver table, from all of Bronze otherwise."""
    if rebuild or not store.exists(spark, base, f"silver_{table}"):
        return clean(spark, base, table, run_ts, slices)
    return clean_pending(spark, base, table, run_ts)


def load(spark: SparkSession, base: str, table: str) -> None:
    """Typed reload of RAW; an empty load fails and leaves RAW as it was."""
    raw = to_raw(store.read_table(spark, base, f"silver_{table}"), table)
    store.publish(raw, base, f"raw_{table}", allow_empty=False)


def staging(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """Staging views over published RAW tables."""
    raw = _read_all(spark, base, [f"raw_{t}" for t in TABLES])
    return {f"stg_{t}": models.staged(raw[f"raw_{t}"], t) for t in TABLES}


def snapshot(spark: SparkSession, base: str, customers: DataFrame, run_ts: str) -> None:
    """Next customer snapshot.

    Open versions are one slice, versions closed by a run are a slice of their
    own that no later run reads or rewrites: its name holds a random part, as a
    repeated run has the same run time.
    """
    current = models.snapshot_source(customers)
    require_unique(current, ["customer_id"], HISTORY)
    ts = F.lit(run_ts).cast(NTZ)
    if store.exists(spark, base, HISTORY):
        opened = open_versions(store.read_table(spark, base, HISTORY, [_OPEN]))
        rows = scd2_step(opened, current, "customer_id", models.TRACKED, ts)
    else:
        rows = scd2_start(current, ts)
    closed = F.concat(F.date_format(VALID_TO, "'closed-'yyyyMMdd'T'HHmmss"), F.lit(f"-{uuid.uuid4().hex}"))
    part = F.coalesce(closed, F.lit(_OPEN))
    store.publish_slices(rows.withColumn("_part", part), base, HISTORY, "_part", replaced=[_OPEN])


def refresh_fact_orders(
    spark: SparkSession,
    base: str,
    orders: DataFrame,
    items: DataFrame,
    full: bool = False,
    increment_by: str = "purchase",
) -> None:
    """Build the order fact, or merge an increment of orders into it.

    ``increment_by="purchase"``: orders at or after the fact's last purchase.
    ``"arrival"``: orders that arrived, or of which an item arrived, since the
    last build, so late orders and later items need no full build; those whose
    row is the same as before are left out.

    The fact is sliced by purchase month.  A merge finds the last purchase in
    the newest month alone, aggregates the items of the increment only and
    rewrites only months that gain, change or lose an order.
    """
    table = "fact_orders"
    by_month = {"_month": month_key(F.col("order_purchase_timestamp"))}
    stored, seen = store.current(spark, base, table), last_build(spark, base, table)
    upto = (_newest(orders), _newest(items))
    if increment_by not in ("purchase", "arrival"):
        raise ValueError(f"increment_by is {increment_by!r}, not purchase or arrival")
    if full or stored is None or not stored.versions or (increment_by == "arrival" and seen is None):
        fact = models.fact_orders(orders, models.item_totals(items)).withColumns(by_month)
        store.publish_slices(fact, base, table, "_month")
        log_build(spark, base, table, *upto)
        return

    target = store.read_table(spark, base, table).withColumns(by_month)
    if increment_by == "arrival":
        new = models.arrived_orders(orders, items, *seen)
    else:
        newest = store.read_table(spark, base, table, [max(stored.versions, key=int)])
        new = increment(orders, newest, "order_purchase_timestamp")
    new_items = items.join(new.select("order_id"), "order_id", "left_semi")
    fact = models.fact_orders(new, models.item_totals(new_items)).withColumns(by_month)
    if increment_by == "arrival":
        fact = models.changed_rows(fact, target, "order_id")
    path = store.staging_path(spark)
    try:
        incoming = store.stage(fact, path)
        require_unique(incoming, ["order_id"], table)
        replaced = target.join(incoming.select("order_id"), "order_id", "left_semi")
        # Months of the calendar: a small list however many orders there are.
        touched = incoming.select("_month").unionByName(replaced.select("_month")).distinct()
        months = [str(row[0]) for row in touched.collect()]
        if months:
            old = store.read_table(spark, base, table, months).withColumns(by_month)
            merged = upsert(old, incoming, ["order_id"])
            store.publish_slices(merged, base, table, "_month", months)
        if increment_by == "arrival":
            log_build(spark, base, table, *upto)
    finally:
        store.unstage(spark, path)


def _newest(df: DataFrame) -> str | None:
    """Last ingest time of a frame, as text; None without one."""
    if "_ingested_at" not in df.columns:
        return None
    return df.agg(F.max("_ingested_at").cast("string")).first()[0]


def build(
    spark: SparkSession,
    base: str,
    full: bool = False,
    calendar: tuple[str, int] = (models.CALENDAR_START, models.CALENDAR_DAYS),
    increment_by: str = "purchase",
) -> None:
    """Dimensions and facts from staging and the customer history.

    ``calendar`` is the first day and the number of days of the date dimension.
    """
    stg = staging(spark, base)
    history = store.read_table(spark, base, HISTORY, [_OPEN])
    orders = stg["stg_orders"]
    tables = {
        "dim_customers": models.dim_customers(history),
        "dim_products": models.dim_products(stg["stg_products"]),
        "dim_date": models.dim_date(spark, *calendar),
        "fact_payments": models.fact_payments(stg["stg_order_payments"], orders),
    }
    calls = {name: partial(store.publish, df, base, name) for name, df in tables.items()}
    items = stg["stg_order_items"]
    calls["fact_orders"] = partial(refresh_fact_orders, spark, base, orders, items, full, increment_by)
    together(calls)


def all_models(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """Every model by name, as the checks expect them."""
    marts = ("dim_customers", "dim_products", "dim_date", "fact_orders", "fact_payments")
    frames = _read_all(spark, base, [*[f"raw_{t}" for t in TABLES], *marts])
    frames |= {f"stg_{t}": models.staged(frames[f"raw_{t}"], t) for t in TABLES}
    frames["int_order_items_aggregated"] = models.item_totals(frames["stg_order_items"])
    return frames


def _read_all(spark: SparkSession, base: str, names: list[str]) -> dict[str, DataFrame]:
    return together({name: partial(store.read_table, spark, base, name) for name in names})


def report(spark: SparkSession, base: str) -> DataFrame:
    """All checks over published models, 57 lines."""
    return checks.report(all_models(spark, base), views=True)


def test(spark: SparkSession, base: str) -> list:
    """Run all checks; raise if one with severity error fails.

    Returns the lines of the report.
    """
    lines = report(spark, base).collect()
    errors = [row for row in lines if row["status"] == "error"]
    if errors:
        raise FailedChecks("; ".join(f"{r.kind} {r.model} {r.column_name}: {r.failures}" for r in errors))
    return lines


def run(
    spark: SparkSession,
    base: str,
    sources: dict[str, DataFrame],
    system: str,
    run_ts: str,
    full: bool = False,
    max_rows_per_file: int = 0,
    calendar: tuple[str, int] = (models.CALENDAR_START, models.CALENDAR_DAYS),
    silver_slices: int = SILVER_SLICES,
    increment_by: str = "purchase",
) -> list:
    """One complete run over the given sources.

    ``full`` reads whole sources, rebuilds Silver from all of Bronze and the
    order fact from all orders; otherwise each takes up what is new.
    """
    require_utc(spark)
    ingest(sources, base, system, run_ts, full, max_rows_per_file)
    together({t: partial(refresh_silver, spark, base, t, run_ts, full, silver_slices) for t in TABLES})
    together({t: partial(load, spark, base, t) for t in TABLES})
    snapshot(spark, base, staging(spark, base)["stg_customers"], run_ts)
    build(spark, base, full, calendar, increment_by)
    return test(spark, base)


def require_utc(spark: SparkSession) -> None:
    """Zoned source times become wall-clock times in the session zone."""
    zone = spark.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "Z", "GMT"):
        raise RuntimeError(f"session time zone is {zone}, set spark.sql.session.timeZone=UTC")
