import pytest
from pyspark.sql import functions as F

from tidemark.plans.cleaning import SPECS, metrics, normalise, rejected, silver, silver_refresh, valid
from tidemark.plans.warehouse import to_raw
from tidemark.schemas import BATCH_COLUMNS, SILVER

TS = "2024-02-01 00:00:00"


def bronze(frame, table, rows, *, batch="b1", at="2024-01-01", types=None):
    """Rows of dicts; columns that a row leaves out are NULL strings."""
    names = list(dict.fromkeys(n for row in rows for n in row))
    kinds = types or {}
    schema = ", ".join(f"{n} {kinds.get(n, 'string')}" for n in names)
    df = frame([tuple(row.get(n) for n in names) for row in rows], schema)
    return df.withColumns(
        {
            "_ingested_at": F.lit(at).cast("timestamp_ntz"),
            "_batch_id": F.lit(batch),
            "_source_system": F.lit("shop"),
            "_source_table": F.lit(table),
        }
    )


ITEM = {
    "order_id": "o1",
    "order_item_id": "1",
    "product_id": "p1",
    "seller_id": "s1",
    "shipping_limit_date": "2020-01-01 00:00:00",
    "price": "10.5",
    "freight_value": "1",
}
PAYMENT = {
    "order_id": "o1",
    "payment_sequential": "1",
    "payment_type": "voucher",
    "payment_installments": "0",
    "payment_value": "3",
}
ORDER = {"order_id": "o1", "customer_id": "c1", "order_status": "shipped"}
PRODUCT = {"product_id": "p1", "product_weight_g": "1"}
CUSTOMER = {
    "customer_id": "c1",
    "customer_unique_id": "u1",
    "customer_zip_code_prefix": "01234",
    "customer_city": " Rio ",
    "customer_state": " rj",
}


@pytest.mark.parametrize(
    "table, good, change, reason",
    [
        ("order_items", ITEM, {"order_id": " "}, "invalid_order_id"),
        ("order_items", ITEM, {"product_id": None}, "invalid_product_id"),
        ("order_items", ITEM, {"seller_id": ""}, "invalid_seller_id"),
        ("order_items", ITEM, {"order_item_id": "0"}, "invalid_order_item_id"),
        ("order_items", ITEM, {"order_item_id": "x"}, "invalid_order_item_id"),
        ("order_items", ITEM, {"price": "12x"}, "invalid_price"),
        ("order_items", ITEM, {"price": "NaN"}, "invalid_price"),
        ("order_items", ITEM, {"price": "Infinity"}, "invalid_price"),
        ("order_items", ITEM, {"freight_value": "-0.01"}, "invalid_freight_value"),
        ("order_items", ITEM, {"price": "-1", "seller_id": None}, "invalid_seller_id"),
        ("order_items", ITEM, {"price": "0"}, None),
        ("order_items", ITEM, {"shipping_limit_date": "never"}, None),
        ("order_payments", PAYMENT, {"order_id": None}, "invalid_order_id"),
        ("order_payments", PAYMENT, {"payment_sequential": "-1"}, "invalid_payment_sequential"),
        ("order_payments", PAYMENT, {"payment_installments": "n/a"}, "invalid_payment_installments"),
        ("order_payments", PAYMENT, {"payment_value": None}, "invalid_payment_value"),
        ("order_payments", PAYMENT, {"payment_type": "crypto"}, "invalid_payment_type"),
        ("order_payments", PAYMENT, {"payment_type": None}, "invalid_payment_type"),
        ("order_payments", PAYMENT, {"payment_type": " Credit_Card "}, None),
        ("orders", ORDER, {"order_id": None}, "invalid_order_id"),
        ("orders", ORDER, {"customer_id": "  "}, "invalid_customer_id"),
        ("orders", ORDER, {"order_status": None}, "invalid_order_status"),
        ("orders", ORDER, {"order_status": " CANCELLED "}, None),
        ("customers", CUSTOMER, {"customer_id": None}, "customer_id_null"),
        ("customers", CUSTOMER, {"customer_id": " "}, "customer_id_empty"),
        ("customers", CUSTOMER, {"customer_unique_id": None}, "customer_unique_id_null"),
        ("customers", CUSTOMER, {"customer_unique_id": " "}, "customer_unique_id_empty"),
        ("products", PRODUCT, {"product_id": None}, "invalid_product_id"),
        ("products", PRODUCT, {"product_weight_g": "-1"}, "negative_product_dimension"),
        ("products", PRODUCT, {"product_weight_g": None}, None),
        ("products", PRODUCT, {"product_weight_g": "heavy"}, None),
    ],
)
def test_reason(frame, table, good, change, reason):
    df = bronze(frame, table, [{**good, **change}])
    spec = SPECS[table]
    found = [r["_rejection_reason"] for r in rejected(df, spec, TS).collect()]
    assert found == ([reason] if reason else [])
    assert valid(df, spec).count() == (0 if reason else 1)


def test_no_product_is_lost_to_null_sizes(frame):
    rows = [
        {"product_id": "a", "product_weight_g": None, "product_length_cm": None},
        {"product_id": "b", "product_weight_g": None, "product_length_cm": "-1"},
        {"product_id": None, "product_weight_g": None, "product_length_cm": None},
    ]
    row = metrics(bronze(frame, "products", rows), SPECS["products"]).first()
    assert (row.bronze_rows, row.valid_rows, row.rejected_rows) == (3, 1, 2)


def test_text_is_normalised(frame):
    row = silver(bronze(frame, "customers", [CUSTOMER]), SPECS["customers"], TS).first()
    assert (row.customer_city, row.customer_state, row.customer_zip_code_prefix) == ("rio", "RJ", "01234")
    row = silver(
        bronze(frame, "orders", [{**ORDER, "order_status": "Cancelled "}]), SPECS["orders"], TS
    ).first()
    assert row.order_status == "canceled"
    assert row.order_purchase_timestamp is None  # optional column that Bronze lacks


def test_tab_is_not_trimmed(frame):
    row = valid(bronze(frame, "orders", [{**ORDER, "order_id": "\to1 "}]), SPECS["orders"]).first()
    assert row.order_id == "\to1"


def test_both_spellings_of_lengths(frame):
    old = bronze(frame, "products", [{"product_id": "a", "product_name_lenght": "7"}])
    new = bronze(frame, "products", [{"product_id": "a", "product_name_length": "7"}])
    both = bronze(
        frame, "products", [{"product_id": "a", "product_name_length": None, "product_name_lenght": "7"}]
    )
    for df in (old, new, both):
        assert normalise(df, SPECS["products"]).first().product_name_length == 7.0


def test_required_column_must_exist(frame):
    df = bronze(frame, "orders", [ORDER]).drop("customer_id")
    with pytest.raises(ValueError, match="customer_id"):
        normalise(df, SPECS["orders"])


def test_partition_columns_do_not_reach_silver(frame):
    df = bronze(frame, "orders", [ORDER]).withColumn("year", F.lit(2024))
    columns = silver(df, SPECS["orders"], TS).columns
    assert columns == [*SILVER["orders"], *BATCH_COLUMNS, "_silver_processed_at"]


def test_latest_version_wins(frame):
    old = bronze(frame, "orders", [ORDER], batch="b9", at="2024-01-01")
    new = bronze(frame, "orders", [{**ORDER, "order_status": "delivered"}], batch="b1", at="2024-01-02")
    row = silver(old.unionByName(new), SPECS["orders"], TS).collect()
    assert [r.order_status for r in row] == ["delivered"]
    same_time = bronze(frame, "orders", [{**ORDER, "order_status": "created"}], batch="b2", at="2024-01-02")
    row = silver(new.unionByName(same_time), SPECS["orders"], TS).collect()
    assert [r.order_status for r in row] == ["created"]


def test_ties_within_a_batch_do_not_depend_on_order(frame):
    rows = [{**ORDER, "order_status": s} for s in ("shipped", "created", "approved")]
    for shuffled in (rows, rows[::-1], rows[1:] + rows[:1]):
        df = bronze(frame, "orders", shuffled).repartition(3)
        assert silver(df, SPECS["orders"], TS).first().order_status == "approved"


def test_empty_bronze(frame):
    df = bronze(frame, "orders", [ORDER]).limit(0)
    assert silver(df, SPECS["orders"], TS).count() == 0
    row = metrics(df, SPECS["orders"]).first()
    assert tuple(row)[1:] == (0, 0, 0, 0, 0)


def test_refresh_equals_rebuild(frame):
    first = [{**ORDER, "order_id": f"o{i}"} for i in range(20)]
    second = [{**ORDER, "order_id": f"o{i}", "order_status": "delivered"} for i in range(10, 30)]
    b1 = bronze(frame, "orders", first)
    b2 = bronze(frame, "orders", second, batch="b2", at="2024-01-02")
    spec = SPECS["orders"]
    steps = silver_refresh(silver(b1, spec, TS), b2, spec, TS)
    whole = silver(b1.unionByName(b2), spec, TS)
    assert sorted(steps.collect()) == sorted(whole.collect())


def test_raw_types_are_exact(frame):
    df = bronze(frame, "order_items", [{**ITEM, "price": "2.675", "freight_value": "0.1"}])
    raw = to_raw(silver(df, SPECS["order_items"], TS), "order_items")
    row = raw.first()
    assert (str(row.price), str(row.freight_value)) == ("2.68", "0.10")
    assert dict(raw.dtypes)["price"] == "decimal(18,2)"


def test_raw_load_rounds_and_refuses(frame):
    df = bronze(frame, "products", [{"product_id": "a", "product_photos_qty": "2.5"}])
    assert to_raw(silver(df, SPECS["products"], TS), "products").first().product_photos_qty == 3
    # what no decimal can hold counts as missing and is rejected before the load
    df = bronze(frame, "order_items", [{**ITEM, "price": "1e30"}])
    assert silver(df, SPECS["order_items"], TS).collect() == []
    assert [r._rejection_reason for r in rejected(df, SPECS["order_items"], TS).collect()] == ["invalid_price"]
