"""Bronze to Silver for the five tables: one template, five specifications."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import rules as r
from tidemark.functions.columns import lowered, replaced, tolerant, trimmed, uppered
from tidemark.operators.dedup import latest_per_key
from tidemark.operators.quarantine import cleaning_metrics, rejected_rows, valid_rows
from tidemark.schemas import (
    BATCH_COLUMNS,
    KEYS,
    ORDER_TIMES,
    PROCESSED_AT,
    PRODUCT_COUNTS,
    PRODUCT_SIZES,
    REASON,
    SILVER,
)

NEWEST = ("_ingested_at", "_batch_id")

# Spellings and reasons that downstream users rely on.
ORDER_STATUSES = (
    "delivered",
    "shipped",
    "canceled",
    "cancelled",
    "invoiced",
    "processing",
    "approved",
    "unavailable",
    "created",
)
PAYMENT_TYPES = ("credit_card", "boleto", "voucher", "debit_card", "not_defined")
STATUS_SPELLINGS = {"cancelled": "canceled"}


@dataclass(frozen=True)
class CleanSpec:
    """How one table is cleaned.

    ``text`` maps string columns to their normaliser; every other column is
    cast tolerantly to its Silver type.  ``optional`` columns may be absent
    from Bronze; ``spellings`` are other Bronze names of a column.  ``rules``
    is a function because columns need a running session.
    """

    table: str
    rules: Callable[[], list[r.Rule]]
    text: dict[str, Callable[[Column], Column]]
    optional: tuple[str, ...] = ()
    spellings: dict[str, str] = field(default_factory=dict)

    @property
    def keys(self) -> tuple[str, ...]:
        return KEYS[self.table]


SPECS = {
    spec.table: spec
    for spec in (
        CleanSpec(
            table="customers",
            text={
                "customer_id": trimmed,
                "customer_unique_id": trimmed,
                "customer_city": lowered,
                "customer_state": uppered,
            },
            rules=lambda: [
                ("customer_id_null", r.known("customer_id")),
                ("customer_id_empty", r.filled("customer_id")),
                ("customer_unique_id_null", r.known("customer_unique_id")),
                ("customer_unique_id_empty", r.filled("customer_unique_id")),
            ],
        ),
        CleanSpec(
            table="orders",
            text={
                "order_id": trimmed,
                "customer_id": trimmed,
                "order_status": lambda c: replaced(lowered(c), STATUS_SPELLINGS),
            },
            optional=ORDER_TIMES,
            rules=lambda: [
                ("invalid_order_id", r.filled("order_id")),
                ("invalid_customer_id", r.filled("customer_id")),
                ("invalid_order_status", r.one_of("order_status", ORDER_STATUSES)),
            ],
        ),
        CleanSpec(
            table="order_items",
            text={"order_id": trimmed, "product_id": trimmed, "seller_id": trimmed},
            optional=("shipping_limit_date",),
            rules=lambda: [
                ("invalid_order_id", r.filled("order_id")),
                ("invalid_product_id", r.filled("product_id")),
                ("invalid_seller_id", r.filled("seller_id")),
                ("invalid_order_item_id", r.positive("order_item_id")),
                ("invalid_price", r.non_negative("price")),
                ("invalid_freight_value", r.non_negative("freight_value")),
            ],
        ),
        CleanSpec(
            table="order_payments",
            text={"order_id": trimmed, "payment_type": lowered},
            rules=lambda: [
                ("invalid_order_id", r.filled("order_id")),
                ("invalid_payment_sequential", r.positive("payment_sequential")),
                ("invalid_payment_installments", r.non_negative("payment_installments")),
                ("invalid_payment_value", r.non_negative("payment_value")),
                ("invalid_payment_type", r.one_of("payment_type", PAYMENT_TYPES)),
            ],
        ),
        CleanSpec(
            table="products",
            text={"product_id": trimmed, "product_category_name": lowered},
            optional=("product_category_name", *PRODUCT_COUNTS, *PRODUCT_SIZES),
            spellings={
                "product_name_lenght": "product_name_length",
                "product_description_lenght": "product_description_length",
            },
            rules=lambda: [
                ("invalid_product_id", r.filled("product_id")),
                ("negative_product_dimension", r.none_negative(PRODUCT_SIZES)),
            ],
        ),
    )
}


def _source_column(bronze: DataFrame, spec: CleanSpec, name: str) -> Column:
    spelled = [name] + [old for old, new in spec.spellings.items() if new == name]
    found = [F.col(c) for c in spelled if c in bronze.columns]
    if found:
        return F.coalesce(*found) if len(found) > 1 else found[0]
    if name in spec.optional:
        return F.lit(None)
    raise ValueError(f"{spec.table}: Bronze has no column {name}")


def normalise(bronze: DataFrame, spec: CleanSpec) -> DataFrame:
    """Bronze rows in the Silver schema, before any row is dropped.

    Projects to declared columns, so partition columns of Bronze end here.
    """
    business = []
    for name, kind in SILVER[spec.table].items():
        column = _source_column(bronze, spec, name)
        if name in spec.text:
            column = spec.text[name](column.cast("string"))
        else:
            column = tolerant(column, kind)
        business.append(column.alias(name))
    batch = [F.col(name).cast(kind).alias(name) for name, kind in BATCH_COLUMNS.items()]
    return bronze.select(*business, *batch)


def valid(bronze: DataFrame, spec: CleanSpec) -> DataFrame:
    """Normalised rows that meet every rule, all versions."""
    return valid_rows(normalise(bronze, spec), spec.rules())


def latest(rows: DataFrame, spec: CleanSpec) -> DataFrame:
    return latest_per_key(rows, spec.keys, NEWEST)


def silver(bronze: DataFrame, spec: CleanSpec, run_ts) -> DataFrame:
    """Latest valid row of every key over the whole Bronze history."""
    return stamp(latest(valid(bronze, spec), spec), run_ts)


def silver_refresh(current: DataFrame, batch: DataFrame, spec: CleanSpec, run_ts) -> DataFrame:
    """Silver after one more Bronze batch, without reading older batches.

    "Latest row per key" can be taken in steps because the order of the rows
    is total: the winner of winners is the overall winner.
    """
    new = stamp(valid(batch, spec), run_ts)
    return latest(current.select(*new.columns).unionByName(new), spec)


def rejected(bronze: DataFrame, spec: CleanSpec, run_ts) -> DataFrame:
    """Rows that fail a rule, with the reason; never reduced by key."""
    rows = rejected_rows(normalise(bronze, spec), spec.rules())
    return stamp(rows, run_ts).select(*_silver_columns(spec), PROCESSED_AT, REASON)


def metrics(bronze: DataFrame, spec: CleanSpec) -> DataFrame:
    counts = cleaning_metrics(normalise(bronze, spec), spec.rules(), spec.keys)
    return counts.select(F.lit(spec.table).alias("table_name"), *counts.columns)


def stamp(df: DataFrame, run_ts) -> DataFrame:
    return df.withColumn(PROCESSED_AT, F.lit(run_ts).cast("timestamp_ntz"))


def _silver_columns(spec: CleanSpec) -> list[str]:
    return [*SILVER[spec.table], *BATCH_COLUMNS]
