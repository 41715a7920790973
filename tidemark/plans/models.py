"""Staging views, the item aggregate, dimensions and facts.

A model is a function of the frames it depends on; the call graph is the DAG.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.calendar import calendar_columns
from tidemark.functions.columns import date_key, lowered, trimmed, uppered
from tidemark.operators.history import VALID_FROM, VALID_TO, open_versions
from tidemark.schemas import BATCH_COLUMNS, ORDER_TIMES, PROCESSED_AT, RAW

CALENDAR_START = "2016-01-01"
CALENDAR_DAYS = 3653

LINEAGE = ("_ingested_at", "_batch_id", "_source_system", PROCESSED_AT)
TRACKED = (
    "customer_unique_id",
    "customer_zip_code_prefix",
    "customer_city",
    "customer_state",
)

FACT_SUMS = ("total_items", "total_item_value", "total_freight_value", "total_order_value")

_STAGED_TEXT = {
    "customers": {"customer_city": trimmed, "customer_state": uppered},
    "orders": {"order_status": lowered},
    "order_items": {},
    "order_payments": {"payment_type": lowered},
    "products": {"product_category_name": lowered},
}


def staged(raw: DataFrame, table: str) -> DataFrame:
    """Staging projection of one RAW table, text normalised once more."""
    text = _STAGED_TEXT[table]
    columns = [
        text[name](F.col(name)).alias(name) if name in text else F.col(name) for name in RAW[table]
    ]
    return raw.select(*columns, *BATCH_COLUMNS, PROCESSED_AT)


def staged_columns(table: str) -> dict[str, Column]:
    """The columns that staging changes, over RAW; all others are as they are there."""
    return {name: change(F.col(name)) for name, change in _STAGED_TEXT[table].items()}


def item_totals(items: DataFrame, dealt: bool = False) -> DataFrame:
    """Order items reduced to one row per order, so later joins do not fan out.

    The two exact distinct counts cost an Expand; readers that do not use them
    get a plan without it, as Catalyst prunes unused aggregates.  ``dealt``: items
    are dealt by their order first, in one exchange, and both counts are sizes of
    an order's sets; no item becomes three rows in a hash table.
    """
    count_distinct = F.count_distinct
    if dealt:
        items = items.repartition("order_id")

        def count_distinct(name: str) -> Column:
            return F.size(F.collect_set(name)).cast("long")

    price, freight, shipped = F.col("price"), F.col("freight_value"), F.col("shipping_limit_date")
    return items.groupBy("order_id").agg(
        F.count("*").alias("total_items"),
        count_distinct("product_id").alias("distinct_products"),
        count_distinct("seller_id").alias("distinct_sellers"),
        F.sum(price).alias("total_item_value"),
        F.sum(freight).alias("total_freight_value"),
        F.sum(price + freight).alias("total_order_value"),
        F.min(price).alias("minimum_item_price"),
        F.max(price).alias("maximum_item_price"),
        F.avg(price).alias("average_item_price"),
        F.min(shipped).alias("first_shipping_limit_date"),
        F.max(shipped).alias("last_shipping_limit_date"),
    )


def dim_date(spark: SparkSession, start: str = CALENDAR_START, days: int = CALENDAR_DAYS) -> DataFrame:
    """Calendar of ``days`` consecutive days."""
    first = spark.range(1).select(F.lit(start).cast("date").alias("start"))
    return calendar_from(first, days)


def calendar_from(first: DataFrame, days: int = CALENDAR_DAYS) -> DataFrame:
    """Calendar that begins at the single date in ``first``."""
    start = F.col("start")
    spine = first.select(F.explode(F.sequence(start, F.date_add(start, days - 1))).alias("day"))
    return spine.select(*[c.alias(name) for name, c in calendar_columns(F.col("day")).items()])


def dim_products(products: DataFrame) -> DataFrame:
    return products.select(*RAW["products"], *LINEAGE)


def dim_customers(history: DataFrame) -> DataFrame:
    """Current version of every customer."""
    return open_versions(history).select(*RAW["customers"], VALID_FROM, VALID_TO, *LINEAGE)


def snapshot_source(customers: DataFrame) -> DataFrame:
    """What the customer history records: business columns and lineage."""
    return customers.select(*RAW["customers"], *LINEAGE)


def fact_orders(orders: DataFrame, totals: DataFrame) -> DataFrame:
    """One row per order; orders without items count zero.

    Both sides are unique on ``order_id``, so no partition can be skewed.
    """
    joined = orders.join(totals.select("order_id", *FACT_SUMS), "order_id", "left")
    return joined.select(
        "order_id",
        "customer_id",
        date_key(F.col("order_purchase_timestamp")).alias("order_date_key"),
        "order_status",
        *ORDER_TIMES,
        *[_or_zero(name).alias(name) for name in FACT_SUMS],
    )


def arrived_orders(orders: DataFrame, items: DataFrame, orders_upto: str, items_upto: str) -> DataFrame:
    """Orders that arrived, or an item of which arrived, after the given ingest times.

    Whatever their purchase time: late orders and later items are among them.
    """

    def later(df: DataFrame, upto: str) -> DataFrame:
        return df.where(F.col("_ingested_at") > F.lit(upto).cast("timestamp_ntz")).select("order_id")

    ids = later(orders, orders_upto).unionByName(later(items, items_upto))
    return orders.join(ids, "order_id", "left_semi")


def changed_rows(incoming: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows of ``incoming`` that are not in ``stored`` as they are; a column that is not stored is a change."""
    if set(incoming.columns) - set(stored.columns):
        return incoming
    old = stored.select(F.col(key).alias("_key"), F.struct(*incoming.columns).alias("_row"))
    same = (F.col(key) == F.col("_key")) & F.struct(*incoming.columns).eqNullSafe(F.col("_row"))
    return incoming.join(old, same, "left_anti")


def with_delivery(fact: DataFrame) -> DataFrame:
    """Days from purchase to delivery and the on-time flag; NULL if not delivered."""
    delivered = F.col("order_delivered_customer_date")
    return fact.withColumns(
        {
            "delivery_days": F.datediff(delivered, F.col("order_purchase_timestamp")),
            "delivered_on_time": delivered <= F.col("order_estimated_delivery_date"),
        }
    )


def fact_payments(payments: DataFrame, orders: DataFrame) -> DataFrame:
    """One row per payment of a known order; an order may have many payments.

    Orders are unique, so an order with a large share of all payments is one
    row on that side, and adaptive execution splits it on the other.
    """
    dated = orders.select(
        "order_id",
        "customer_id",
        date_key(F.col("order_purchase_timestamp")).alias("order_date_key"),
    )
    wanted = (
        "order_id",
        "payment_sequential",
        "payment_type",
        "payment_installments",
        "payment_value",
        *LINEAGE,
    )
    joined = payments.select(*wanted).join(dated, "order_id")
    return joined.select(
        "order_id",
        "payment_sequential",
        "customer_id",
        "order_date_key",
        "payment_type",
        "payment_installments",
        "payment_value",
        *LINEAGE,
    )


def _or_zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))
