"""Physical plans: what must reach the scan, shrink before a shuffle, or be absent."""

import re

import pytest
from pyspark.sql import functions as F

from tidemark import queries
from tidemark.operators import joins
from tidemark.plans import models
from tidemark.sources.store import balanced

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("table", ["customers", "orders", "order_items", "order_payments", "products"])
def test_copies_are_dropped_before_the_shuffle(spark, table):
    text = plan(queries.silver(spark, SF, table))
    above, below = text.split("Exchange hashpartitioning")[:2]
    assert "WindowGroupLimit" in above and "Final" in above
    assert "Partial" in below


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_no_cross_join_and_no_python(spark, name):
    text = plan(queries.QUERIES[name](spark, SF))
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert node not in text


def test_fact_does_not_pay_for_distinct_counts(spark):
    assert "Expand" in plan(queries.int_order_items_aggregated(spark, SF))
    assert "Expand" not in plan(queries.fact_orders(spark, SF))


def test_dealt_totals_expand_no_item(spark, frame):
    rows = [("o1", "p1", "s1", 3), ("o1", "p1", "s2", 5), ("o1", None, "s2", None), ("o2", None, None, 7), (None, "p2", "s1", 1), (None, "p3", "s1", 2)]
    items = frame(rows, "order_id string, product_id string, seller_id string, n int").select(
        "order_id", "product_id", "seller_id", F.col("n").cast("decimal(18,2)").alias("price"),
        (F.col("n") / 2).cast("decimal(18,2)").alias("freight_value"), F.lit("2024-01-01").cast("timestamp_ntz").alias("shipping_limit_date"),
    )
    plain, dealt = models.item_totals(items), models.item_totals(items, dealt=True)
    assert "Expand" not in plan(dealt) and plan(dealt).count("Exchange") == 1
    assert dealt.schema == plain.schema and sorted(map(str, dealt.collect())) == sorted(map(str, plain.collect()))


def test_written_totals_are_dealt(spark, monkeypatch):
    seen = []
    totals = models.item_totals
    monkeypatch.setattr(models, "item_totals", lambda items, **how: seen.append(how) or totals(items, **how))
    queries.published(spark, SF)["int_order_items_aggregated"].count()
    assert seen == [{"dealt": True}]


def test_fact_join_adds_no_shuffle(spark, base):
    """Window by order and aggregate by order already place both sides."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(queries.fact_orders(spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 3


def test_scan_reads_needed_columns_only(spark, base):
    queries.raw(spark, SF, "orders").write.parquet(f"{base}/orders")
    stored = models.staged(spark.read.parquet(f"{base}/orders"), "orders")
    text = plan(joins.key_counts(stored, "customer_id"))
    assert "ReadSchema: struct<customer_id:string>" in text
    text = plan(stored.filter(F.col("order_id") == "o1"))
    assert "EqualTo(order_id,o1)" in text


def test_key_filter_goes_below_the_history_windows(spark):
    text = plan(queries.customer_history_lookup(spark, SF))
    assert text.count("= c20") >= 3  # in each of the three batches


def test_sliced_writes_are_rebalanced(spark):
    assert "REBALANCE_PARTITIONS_BY_COL" in plan(balanced(spark.range(9), "id"))


def test_hot_order_of_payments_is_split(spark, base):
    """Adaptive execution deals a hot key of the plain join out to several tasks."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    ids = spark.range(90_000).repartition(16)
    payments = ids.selectExpr(
        "IF(id % 3 = 0, 'hot', 'o' || id) AS order_id", "1 AS payment_sequential", "'voucher' AS payment_type",
        "1 AS payment_installments", "CAST(id AS decimal(18,2)) AS payment_value", "current_timestamp() AS _ingested_at",
        "'b' || id AS _batch_id", "'s' AS _source_system", "current_timestamp() AS _silver_processed_at",
    )
    orders = ids.selectExpr(
        "IF(id = 0, 'hot', 'o' || id) AS order_id", "'c' AS customer_id",
        "timestamp_ntz'2020-01-01 00:00:00' AS order_purchase_timestamp",
    )
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        fact = models.fact_payments(payments, orders)
        assert len(fact.collect()) == 90_000
        assert "skew=true" in plan(fact)
    finally:
        for name in settings:
            spark.conf.unset(name)
