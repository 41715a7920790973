"""Bronze inputs derived from the test tables, with planted defects.

The rules are those of FIXTURES.md, part 3.  Whole tables are read; the
remainders below only decide which rows get which defect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.bronze import stamp_batch

SYSTEM = "shop"
RUN_TS = "2024-01-04 00:00:00"
BATCH_TIMES = {
    "b0": "2024-01-01 00:00:00",
    "b1": "2024-01-01 00:00:00",
    "b2": "2024-01-02 00:00:00",
    "b3": "2024-01-03 00:00:00",
}
FIRST_BUILD_BEFORE = "2000-01-01 00:00:00"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mod(k: Column, divisor: int, rest: int) -> Column:
    return k % divisor == rest


def in_batch(df: DataFrame, table: str, batch: str) -> DataFrame:
    return stamp_batch(df, SYSTEM, table, batch, BATCH_TIMES[batch])


def _days(n: Column) -> Column:
    return F.make_dt_interval(days=n)


def source_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source table as first delivered, defects included."""
    orders = _read(spark, sf_dir, "orders")
    k, bought = F.col("o_orderkey"), F.col("o_orderdate")
    name = F.concat(F.lit("o"), k)
    order_id = (
        F.when(_mod(k, 211, 7), F.lit(None))
        .when(_mod(k, 223, 5), F.lit("   "))
        .when(_mod(k, 11, 0), F.concat(F.lit("  "), name, F.lit(" ")))
        .otherwise(name)
    )
    customer_id = F.when(~_mod(k, 227, 3), F.concat(F.lit("c"), F.col("o_custkey")))
    status = (
        F.when(_mod(k, 229, 11), F.lit("bogus"))
        .when(_mod(k, 233, 13), F.lit(None))
        .when(F.col("o_orderstatus") == "F", F.lit(" Delivered "))
        .when(F.col("o_orderstatus") == "O", F.lit("shipped"))
        .when((F.col("o_orderstatus") == "P") & _mod(k, 5, 0), F.lit("Cancelled"))
        .otherwise(F.lit("processing"))
    )
    delivered = F.when(
        F.col("o_orderstatus") == "F", bought + _days((k % 19 - 1).cast("int"))
    )
    return orders.select(
        order_id.alias("order_id"),
        customer_id.alias("customer_id"),
        status.alias("order_status"),
        bought.alias("order_purchase_timestamp"),
        (bought + F.expr("INTERVAL 5 MINUTES")).alias("order_approved_at"),
        (bought + _days(F.lit(1))).alias("order_delivered_carrier_date"),
        delivered.alias("order_delivered_customer_date"),
        (bought + _days(F.lit(10))).alias("order_estimated_delivery_date"),
    )


def redelivered_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second delivery: every fourth order, clean and delivered."""
    k, bought = F.col("o_orderkey"), F.col("o_orderdate")
    return (
        _read(spark, sf_dir, "orders")
        .filter(_mod(k, 4, 0))
        .select(
            F.concat(F.lit("o"), k).alias("order_id"),
            F.concat(F.lit("c"), F.col("o_custkey")).alias("customer_id"),
            F.lit("delivered").alias("order_status"),
            bought.alias("order_purchase_timestamp"),
            (bought + F.expr("INTERVAL 5 MINUTES")).alias("order_approved_at"),
            (bought + _days(F.lit(1))).alias("order_delivered_carrier_date"),
            (bought + _days(F.lit(3))).alias("order_delivered_customer_date"),
            (bought + _days(F.lit(10))).alias("order_estimated_delivery_date"),
        )
    )


def bronze_orders(spark: SparkSession, sf_dir: str, batches: tuple[str, ...] = ("b1", "b2")) -> DataFrame:
    delivered = {"b1": source_orders, "b2": redelivered_orders}
    frames = [in_batch(delivered[b](spark, sf_dir), "orders", b) for b in batches]
    return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])


def source_customers(spark: SparkSession, sf_dir: str, batch: str = "b1") -> DataFrame:
    """The customer table on the day of a batch; some customers move."""
    k = F.col("c_custkey")
    moved = {"b1": F.lit(False), "b2": _mod(k, 10, 0), "b3": _mod(k, 20, 10)}[batch]
    home = F.col("c_nationkey")
    nation = F.when(moved, (home + 1) % 25).otherwise(home)
    customers = _read(spark, sf_dir, "customer").withColumn("n_nationkey", nation)
    places = _read(spark, sf_dir, "nation").join(
        _read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    unique_id = F.when(_mod(k, 173, 9), F.lit("  ")).otherwise(F.concat(F.lit("u"), k % 1000))
    return customers.join(places, "n_nationkey").select(
        F.concat(F.lit("c"), k).alias("customer_id"),
        unique_id.alias("customer_unique_id"),
        (k + 10000).cast("int").alias("customer_zip_code_prefix"),
        F.concat(F.lit(" "), "n_name", F.lit(" ")).alias("customer_city"),
        F.lower("r_name").alias("customer_state"),
    )


def bronze_customers(
    spark: SparkSession, sf_dir: str, batches: tuple[str, ...] = ("b1", "b2", "b3")
) -> DataFrame:
    frames = [in_batch(source_customers(spark, sf_dir, b), "customers", b) for b in batches]
    df = frames[0]
    for other in frames[1:]:
        df = df.unionByName(other)
    return df


def _money_text(c: Column) -> Column:
    return c.cast("decimal(18,2)").cast("string")


def source_order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_partkey")
    price = F.col("l_extendedprice")
    price_text = (
        F.when(_mod(k, 311, 9), F.lit("n/a"))
        .when(_mod(k, 313, 4), _money_text(-price))
        .otherwise(_money_text(price))
    )
    product = F.concat(F.when(_mod(k, 97, 1), F.lit(" ")).otherwise(F.lit("")), F.lit("p"), k)
    return _read(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("o"), "l_orderkey").alias("order_id"),
        F.when(~_mod(k, 307, 5), F.col("l_linenumber")).alias("order_item_id"),
        product.alias("product_id"),
        F.concat(F.lit("s"), "l_suppkey").alias("seller_id"),
        F.col("l_shipdate").alias("shipping_limit_date"),
        price_text.alias("price"),
        F.col("l_quantity").alias("freight_value"),
        k.alias("_k"),
    )


def bronze_order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches that arrived at the same time, so that times tie."""
    items = in_batch(source_order_items(spark, sf_dir), "order_items", "b1")
    return items.withColumn("_batch_id", F.concat(F.lit("b"), F.col("_k") % 3)).drop("_k")


def source_order_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, event = F.col("event_id"), F.col("event_type")
    kind = (
        F.when(event == "purchase", F.lit("Credit_Card "))
        .when(event == "click", F.lit("boleto"))
        .when(event == "view", F.lit("voucher"))
        .when(event == "signup", F.lit("debit_card"))
        .when((event == "error") & _mod(k, 2, 0), F.lit("not_defined"))
        .otherwise(F.lit("crypto"))
    )
    value = (
        F.when(_mod(k, 103, 1), F.lit(None))
        .when(_mod(k, 101, 3), -F.col("value"))
        .otherwise(F.col("value"))
    )
    sequence = F.when(_mod(k, 109, 2), F.lit(0)).otherwise(F.floor(k / 1000) + 1)
    installments = F.when(_mod(k, 107, 0), F.lit("n/a")).otherwise((k % 13 - 1).cast("string"))
    return _read(spark, sf_dir, "events").select(
        F.concat(F.lit("o"), k % 1000).alias("order_id"),
        sequence.cast("int").alias("payment_sequential"),
        kind.alias("payment_type"),
        installments.alias("payment_installments"),
        value.alias("payment_value"),
    )


def bronze_order_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_batch(source_order_payments(spark, sf_dir), "order_payments", "b1")


def source_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    weight = (
        F.when(_mod(k, 53, 0), F.lit(None))
        .when(_mod(k, 59, 1), F.lit(-1))
        .otherwise(size * 100)
    )
    return _read(spark, sf_dir, "part").select(
        F.when(~_mod(k, 197, 6), F.concat(F.lit("p"), k)).alias("product_id"),
        F.concat(F.lit(" "), "p_type", F.lit(" ")).alias("product_category_name"),
        F.length("p_name").alias("product_name_lenght"),
        (F.length("p_name") * 10).alias("product_description_lenght"),
        (size % 6).alias("product_photos_qty"),
        weight.alias("product_weight_g"),
        size.alias("product_length_cm"),
        (size + 1).alias("product_height_cm"),
        (size + 2).alias("product_width_cm"),
    )


def bronze_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_batch(source_products(spark, sf_dir), "products", "b1")


BRONZE = {
    "customers": bronze_customers,
    "orders": bronze_orders,
    "order_items": bronze_order_items,
    "order_payments": bronze_order_payments,
    "products": bronze_products,
}
