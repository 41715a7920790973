"""Every kind of check on models with planted failures."""

import pytest
from pyspark.sql import functions as F

from tidemark.plans import checks
from tidemark.plans.models import dim_date


@pytest.fixture
def models(spark, frame):
    """Small models; each defect below is planted once."""
    customers = frame([("c1", "u1"), ("c2", None)], "customer_id string, customer_unique_id string")
    orders = frame(
        [("o1", "c1", "shipped"), ("o2", "c9", "lost"), ("o2", None, None)],
        "order_id string, customer_id string, order_status string",
    )
    items = frame(
        [("o1", 1, "p1"), ("o1", 2, "p8"), ("o7", 1, "p8")],
        "order_id string, order_item_id int, product_id string",
    )
    payments = frame([("o1", 1), ("o1", 1), ("o2", 1)], "order_id string, payment_sequential int")
    products = frame([("p1",), (None,)], "product_id string")
    time = lambda text: F.lit(text).cast("timestamp_ntz")
    fact_orders = frame(
        [("o1", "c1", 20160101, 2, 3.0, 1.0, 4.0), ("o2", "c9", 20150101, -1, -3.0, 1.0, 4.0)],
        "order_id string, customer_id string, order_date_key int, total_items int,"
        " total_item_value double, total_freight_value double, total_order_value double",
    ).withColumns(
        {
            "order_purchase_timestamp": time("2016-01-02"),
            "order_delivered_customer_date": F.when(F.col("order_id") == "o1", time("2016-01-01")),
        }
    )
    fact_payments = payments.withColumns(
        {
            "customer_id": F.lit(None).cast("string"),
            "order_date_key": F.lit(20160101),
            "payment_value": F.col("payment_sequential") - F.when(F.col("order_id") == "o2", 2).otherwise(0),
        }
    )
    totals = frame([("o1", 2)], "order_id string, total_items int")
    stored = {
        "customers": customers,
        "orders": orders,
        "order_items": items,
        "order_payments": payments,
        "products": products,
    }
    return {
        **{f"raw_{name}": df for name, df in stored.items()},
        **{f"stg_{name}": df for name, df in stored.items()},
        "int_order_items_aggregated": totals,
        "dim_customers": customers,
        "dim_products": products,
        "dim_date": dim_date(spark),
        "fact_orders": fact_orders,
        "fact_payments": fact_payments,
    }


def test_report(models):
    lines = checks.report(models).collect()
    kinds = {}
    for line in lines:
        kinds[line.kind] = kinds.get(line.kind, 0) + 1
    assert kinds == {
        "not_null": 33,
        "unique": 9,
        "accepted_values": 1,
        "relationships": 9,
        "singular": 5,
    }
    failed = {(r.kind, r.model, r.column_name): (r.failures, r.status) for r in lines if r.failures}
    assert failed == {
        ("not_null", "raw_customers", "customer_unique_id"): (1, "error"),
        ("not_null", "stg_customers", "customer_unique_id"): (1, "error"),
        ("not_null", "dim_customers", "customer_unique_id"): (1, "error"),
        ("not_null", "raw_orders", "customer_id"): (1, "error"),
        ("not_null", "stg_orders", "customer_id"): (1, "error"),
        ("not_null", "stg_orders", "order_status"): (1, "error"),
        ("not_null", "raw_products", "product_id"): (1, "error"),
        ("not_null", "stg_products", "product_id"): (1, "error"),
        ("not_null", "dim_products", "product_id"): (1, "error"),
        ("unique", "stg_orders", "order_id"): (1, "error"),
        ("accepted_values", "stg_orders", "order_status"): (1, "error"),
        ("relationships", "stg_orders", "customer_id -> stg_customers"): (1, "error"),
        ("relationships", "stg_order_items", "order_id -> stg_orders"): (1, "error"),
        ("relationships", "stg_order_items", "product_id -> stg_products"): (2, "warn"),
        ("relationships", "fact_orders", "customer_id -> dim_customers"): (1, "error"),
        ("relationships", "fact_orders", "order_date_key -> dim_date"): (1, "error"),
        ("singular", "fact_payments_unique", ""): (1, "error"),
        ("singular", "fact_payments_positive_value", ""): (1, "error"),
        ("singular", "fact_orders_non_negative_amounts", ""): (1, "error"),
        ("singular", "fact_orders_item_count", ""): (1, "error"),
        ("singular", "fact_orders_delivery_logic", ""): (1, "error"),
    }


def test_failing_keys_are_named(models):
    found = {(r.child, r.key_value): r.n_rows for r in checks.relationships(models).collect()}
    assert found[("stg_order_items", "p8")] == 2
    twice = checks.unique(models).collect()
    assert [(r.model, r.key_value, r.record_count) for r in twice] == [("stg_orders", "o2", 2)]
    assert [r.value for r in checks.accepted_values(models).collect()] == ["lost"]
