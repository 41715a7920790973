"""Counts of FIXTURES.md, part 4, at sf0.01."""

from pyspark.sql import functions as F

from __spark_entry__ import queries

SF = "/root/testdata/sf0.01"
Q = queries()


def counts(df, column):
    return {r[0]: r[1] for r in df.groupBy(column).count().collect()}


def test_metrics(spark):
    rows = {r["table_name"]: r for r in Q["silver_metrics"](spark, SF).collect()}
    assert (rows["orders"].bronze_rows, rows["orders"].silver_rows) == (18750, 14747)
    assert (rows["order_items"].bronze_rows, rows["order_items"].silver_rows) == (60000, 45461)
    assert (rows["products"].rejected_rows, rows["products"].valid_rows) == (45, 1955)
    for row in rows.values():
        assert row.bronze_rows == row.valid_rows + row.rejected_rows
        assert row.silver_rows == row.valid_rows - row.duplicates_removed


def test_rejections(spark):
    assert counts(Q["rejected_orders"](spark, SF), "_rejection_reason") == {
        "invalid_order_id": 140,
        "invalid_customer_id": 66,
        "invalid_order_status": 131,
    }
    assert counts(Q["rejected_order_items"](spark, SF), "_rejection_reason") == {
        "invalid_order_item_id": 206,
        "invalid_price": 441,
    }
    assert counts(Q["rejected_order_payments"](spark, SF), "_rejection_reason") == {
        "invalid_payment_installments": 849,
        "invalid_payment_sequential": 92,
        "invalid_payment_type": 888,
        "invalid_payment_value": 178,
    }


def test_models(spark):
    fact = Q["fact_orders"](spark, SF)
    assert fact.count() == 14747
    assert fact.filter("total_items = 0").count() == 263
    assert Q["int_order_items_aggregated"](spark, SF).count() == 14731
    assert Q["fact_payments"](spark, SF).count() == 7843
    assert Q["dq_fact_orders_delivery"](spark, SF).count() == 192


def test_history(spark):
    history = Q["customers_scd2"](spark, SF).cache()
    assert history.count() == 1714
    assert history.filter("valid_to IS NULL").count() == 1491
    per_key = history.groupBy("customer_id").agg(F.count("*").alias("n"))
    assert counts(per_key, "n") == {1: 1342, 2: 75, 3: 74}


def test_incremental_fact(spark):
    assert Q["fact_orders_incremental"](spark, SF).count() == 14688
