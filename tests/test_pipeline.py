"""Whole runs on written tables, with the two manual scenarios automated."""

from collections import Counter
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark import fixtures
from tidemark.operators.upsert import conditional_update
from tidemark.plans import stages
from tidemark.plans.models import TRACKED, staged
from tidemark.sources import store
from tidemark.sources.bronze import stamp_batch, write_bronze
from tidemark.sources.ingest import SOURCES, extract
from tidemark.sources.marks import log_batch, pending_batches

CUSTOMERS = [(f"c{i}", f"u{i}", f"{10000 + i}", " Quayside ", "qs") for i in range(4)]
CUSTOMER_SCHEMA = (
    "customer_id string, customer_unique_id string, customer_zip_code_prefix string,"
    " customer_city string, customer_state string"
)
ORDER_SCHEMA = "order_id string, customer_id string, order_status string, bought string"


def orders(frame, rows):
    df = frame(rows, ORDER_SCHEMA)
    bought = F.col("bought").cast("timestamp_ntz")
    return df.select(
        "order_id",
        "customer_id",
        "order_status",
        bought.alias("order_purchase_timestamp"),
        (bought + F.expr("INTERVAL 5 MINUTES")).alias("order_approved_at"),
        (bought + F.expr("INTERVAL 1 DAY")).alias("order_delivered_carrier_date"),
        (bought + F.expr("INTERVAL 3 DAYS")).alias("order_delivered_customer_date"),
        (bought + F.expr("INTERVAL 9 DAYS")).alias("order_estimated_delivery_date"),
    )


def sources(frame):
    return {
        "customers": frame(CUSTOMERS, CUSTOMER_SCHEMA),
        "orders": orders(
            frame,
            [
                ("o1", "c0", "delivered", "2018-10-01 10:00:00"),
                ("o2", "c1", "shipped", "2018-09-01 10:00:00"),
                ("o3", "c2", "Cancelled", "2018-10-18 10:00:00"),
                (" ", "c2", "shipped", "2018-10-17 10:00:00"),
            ],
        ),
        "order_items": frame(
            [
                ("o1", 1, "p1", "s1", "2018-10-05 00:00:00", "10.10", "1.00"),
                ("o1", 2, "p2", "s1", "2018-10-06 00:00:00", "20.20", "2.00"),
                ("o2", 1, "p9", "s2", "2018-09-05 00:00:00", "5", "0"),
            ],
            "order_id string, order_item_id int, product_id string, seller_id string,"
            " shipping_limit_date string, price string, freight_value string",
        ),
        "payments": frame(
            [("o1", 1, "voucher", 1, "30.30"), ("o1", 2, "boleto", 1, "3.00"), ("o2", 1, "boleto", 1, "5")],
            "order_id string, payment_sequential int, payment_type string,"
            " payment_installments int, payment_value string",
        ),
        "products": frame(
            [("p1", " Toys ", 10, None), ("p2", "books", 20, 5)],
            "product_id string, product_category_name string, product_weight_g int, product_length_cm int",
        ),
    }


def run(spark, base, given, day, **options):
    return stages.run(spark, base, given, "shop", f"2024-01-{day:02d} 00:00:00", **options)


def table(spark, base, name):
    return store.read_table(spark, base, name)


def content(spark, base, name, *without):
    return Counter(map(repr, table(spark, base, name).drop(*without).collect()))


@pytest.fixture(scope="module")
def site(spark, tmp_path_factory):
    """One base folder, run for the first time."""
    base = str(tmp_path_factory.mktemp("site"))
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    given = sources(make)
    return base, given, make, run(spark, base, given, 1)


def test_scenarios(spark, site):
    base, given, make, report = site

    # First run: one reject, zero-item order, orphan product is a warning only.
    assert len(report) == 57
    failed = {(r.model, r.column_name): r for r in report if r.status != "pass"}
    assert list(failed) == [("stg_order_items", "product_id -> stg_products")]
    assert failed[("stg_order_items", "product_id -> stg_products")].status == "warn"
    assert [r._rejection_reason for r in table(spark, base, "rejected_orders").collect()] == ["invalid_order_id"]
    fact = {r.order_id: r for r in table(spark, base, "fact_orders").collect()}
    assert {k: (r.total_items, str(r.total_order_value)) for k, r in fact.items()} == {
        "o1": (2, "33.30"),
        "o2": (1, "5.00"),
        "o3": (0, "0.00"),
    }
    assert fact["o3"].order_status == "canceled" and fact["o1"].order_date_key == 20181001
    assert table(spark, base, "fact_payments").count() == 3
    assert table(spark, base, "dim_products").count() == 2

    # Second run, nothing new: same content, no new order batch.
    names = ("fact_orders", "dim_products", "customers_snapshot", "dim_customers")
    stamps = ("_silver_processed_at", "_ingested_at", "_batch_id")
    before = {n: content(spark, base, n, *stamps) for n in names}
    run(spark, base, given, 2)
    assert {n: content(spark, base, n, *stamps) for n in names} == before

    # Scenario 1: a customer moves and moves back.
    moved = conditional_update(
        given["customers"],
        F.col("customer_id") == "c0",
        {"customer_city": F.lit("harbour"), "customer_state": F.lit("HB")},
    )
    run(spark, base, {**given, "customers": moved}, 3)
    run(spark, base, given, 4)
    history = table(spark, base, "customers_snapshot").filter("customer_id = 'c0'").orderBy("valid_from")
    assert [(r.customer_city, r.customer_state, r.valid_from.day, r.valid_to and r.valid_to.day) for r in history.collect()] == [
        ("quayside", "QS", 1, 3),
        ("harbour", "HB", 3, 4),
        ("quayside", "QS", 4, None),
    ]
    assert table(spark, base, "dim_customers").count() == 4

    # Scenario 2: one order after the last purchase, one late order.
    more = given["orders"].unionByName(
        orders(
            make,
            [
                ("new", "c3", "delivered", "2018-11-19 10:00:00"),
                ("late", "c3", "delivered", "2018-08-01 10:00:00"),
            ],
        )
    )
    september = slice_version(spark, base, "201809")
    run(spark, base, {**given, "orders": more}, 5)
    ids = {r.order_id for r in table(spark, base, "fact_orders").collect()}
    assert ids == {"o1", "o2", "o3", "new"}
    # Months without a changed order keep their files.
    assert slice_version(spark, base, "201809") == september
    # The late order was never extracted; a full load and a full build bring it.
    extract(more, SOURCES["orders"], base, "shop", full=True, ingested_at="2024-01-06 00:00:00")
    stages.clean(spark, base, "orders", "2024-01-06 00:00:00")
    stages.load(spark, base, "orders")
    stages.build(spark, base)
    assert table(spark, base, "fact_orders").count() == 4
    stages.build(spark, base, full=True)
    assert table(spark, base, "fact_orders").count() == 5


def slice_version(spark, base, name):
    return store.current(spark, base, "fact_orders").versions[name]


def test_order_that_changes_month_leaves_the_old_one(spark, frame, base):
    def fact(rows):
        stages.refresh_fact_orders(spark, base, orders(frame, rows), items)

    items = frame([], "order_id string, product_id string, seller_id string, price decimal(18,2),"
                  " freight_value decimal(18,2), shipping_limit_date timestamp_ntz")
    fact([("a", "c", "shipped", "2020-01-05"), ("b", "c", "shipped", "2020-02-05")])
    fact([("a", "c", "shipped", "2020-03-05"), ("b", "c", "shipped", "2020-02-05")])
    rows = table(spark, base, "fact_orders").orderBy("order_id").collect()
    assert [(r.order_id, r.order_date_key) for r in rows] == [("a", 20200305), ("b", 20200205)]
    assert set(store.current(spark, base, "fact_orders").versions) == {"202002", "202003"}


def test_duplicate_keys_stop_the_merge(spark, frame, base):
    items = frame([], "order_id string, product_id string, seller_id string, price decimal(18,2),"
                  " freight_value decimal(18,2), shipping_limit_date timestamp_ntz")
    one = [("a", "c", "shipped", "2020-01-05")]
    stages.refresh_fact_orders(spark, base, orders(frame, one), items)
    with pytest.raises(ValueError, match="not unique"):
        stages.refresh_fact_orders(spark, base, orders(frame, one + one), items)


def test_batchwise_cleaning_equals_rebuild(spark, base):
    sf = "/root/testdata/sf0.001"
    ts = "2024-02-01 00:00:00"
    for day, batch in ((1, "b1"), (2, "b2"), (3, "b3")):
        source = fixtures.source_customers(spark, sf, batch)
        extract(source, SOURCES["customers"], base, "shop", batch_id=batch,
                ingested_at=f"2024-01-{day:02d} 00:00:00")
        if day == 1:
            counts = stages.clean(spark, base, "customers", ts)
            assert counts.bronze == counts.valid + counts.rejected
            assert counts.silver == counts.valid - counts.duplicates
    # The second batch was left over, as after a failed run: both are taken up.
    stages.refresh_silver(spark, base, "customers", ts, rebuild=False)
    assert pending_batches(spark, base, "customers") == []
    names = ("silver_customers", "rejected_customers")
    steps = {n: content(spark, base, n) for n in names}
    # Folding a batch again changes nothing.
    log_batch(spark, base, "customers", "again", "2024-01-03 00:00:00")
    stages.clean_pending(spark, base, "customers", ts)
    assert {n: content(spark, base, n) for n in names} == steps
    stages.refresh_silver(spark, base, "customers", ts, rebuild=True)
    assert {n: content(spark, base, n) for n in names} == steps


def test_repeated_run_keeps_history_and_newest(spark, base, frame):
    """Runs of one run time: no closed version is lost, the later batch wins."""

    def customers(*cities):
        rows = [(f"c{i}", f"u{i}", "1", city, "qs") for i, city in enumerate(cities, 1)]
        return {"customers": frame(rows, CUSTOMER_SCHEMA)}

    def step(ts, *cities):
        stages.ingest(customers(*cities), base, "shop", ts)
        stages.refresh_silver(spark, base, "customers", ts, rebuild=False)
        stages.load(spark, base, "customers")
        raw = store.read_table(spark, base, "raw_customers")
        stages.snapshot(spark, base, staged(raw, "customers"), ts)

    step("2024-01-01 00:00:00", "old", "old")
    step("2024-01-02 00:00:00.2", "new", "old")
    step("2024-01-02 00:00:00.2", "new", "newer")
    step("2024-01-02 00:00:00.8", "newest", "newer")
    history = table(spark, base, "customers_snapshot")
    found = sorted((r.customer_id, r.customer_city, r.valid_to is None) for r in history.collect())
    assert found == [
        ("c1", "new", False), ("c1", "newest", True), ("c1", "old", False),
        ("c2", "newer", True), ("c2", "old", False),
    ]


def test_odd_batch_ids_and_failed_batches(spark, base, frame):
    """Any batch id names a slice; an unlogged batch counts for neither way of cleaning."""
    ts = "2024-01-01 00:00:00"
    good, bad = ("c1", "u1", "1", "a", "qs"), (None, "u2", "1", "a", "qs")
    for batch in ("first", "a:b/c d=%e"):
        extract(frame([good, bad], CUSTOMER_SCHEMA), SOURCES["customers"], base, "shop", batch_id=batch, ingested_at=ts)
        counts = stages.refresh_silver(spark, base, "customers", ts, rebuild=False)
        assert (counts.bronze, counts.rejected, counts.silver) == (2, 1, 1)
    failed = stamp_batch(frame([bad], CUSTOMER_SCHEMA), "shop", "customers", "failed", ts)
    write_bronze(failed, base, "customers", ts)
    for rebuild in (False, True):
        stages.refresh_silver(spark, base, "customers", ts, rebuild)
        assert table(spark, base, "rejected_customers").count() == 2


def test_slices_are_not_lost(spark, base):
    rows = spark.range(2).selectExpr("id", "'a' AS part")
    store.publish_slices(rows, base, "t", "part")
    with pytest.raises(ValueError, match="not to be replaced"):
        store.publish_slices(rows, base, "t", "part", replaced=[])
    with pytest.raises(ValueError, match="slice names"):
        store.publish_slices(rows.selectExpr("id", "'a:b' AS part"), base, "t", "part")


def test_failed_check_stops_the_run(spark, site, tmp_path):
    _, given, make, _ = site
    orphan = given["orders"].unionByName(orders(make, [("o9", "nobody", "shipped", "2018-10-02 00:00:00")]))
    with pytest.raises(stages.FailedChecks, match="customer_id -> stg_customers: 1"):
        run(spark, str(tmp_path), {**given, "orders": orphan}, 1)


def test_missing_stage_input(spark, base):
    with pytest.raises(LookupError):
        stages.clean(spark, base, "orders", "2024-01-01")


def test_session_zone_must_be_utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        with pytest.raises(RuntimeError, match="UTC"):
            stages.require_utc(spark)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_tracked_columns():
    assert TRACKED == ("customer_unique_id", "customer_zip_code_prefix", "customer_city", "customer_state")


def test_a_batch_rewrites_only_its_slices(spark, base, frame):
    """One customer of 200 comes again: one Silver slice is read and written."""
    rows = [(f"c{i}", f"u{i}", "1", "a", "qs") for i in range(200)]
    ts = "2024-02-01 00:00:00"
    extract(frame(rows, CUSTOMER_SCHEMA), SOURCES["customers"], base, "shop", ingested_at="2024-01-01 00:00:00")
    stages.clean(spark, base, "customers", ts, slices=20)
    before = store.current(spark, base, "silver_customers")
    assert len(before.versions) == 20 and before.slicing.keys == ("customer_id",)
    moved = [("c7", "u7", "1", "b", "qs"), (None, "u8", "1", "b", "qs")]
    extract(frame(moved, CUSTOMER_SCHEMA), SOURCES["customers"], base, "shop", ingested_at="2024-01-02 00:00:00")
    counts = stages.clean_pending(spark, base, "customers", ts)
    assert (counts.bronze, counts.valid, counts.duplicates, counts.rejected, counts.silver) == (2, 1, 1, 1, 200)
    after = store.current(spark, base, "silver_customers")
    changed = [name for name, version in after.versions.items() if version != before.versions[name]]
    assert len(changed) == 1 and after.n_rows == 200
    steps = content(spark, base, "silver_customers")
    stages.clean(spark, base, "customers", ts, slices=7)
    assert content(spark, base, "silver_customers") == steps
    assert len(store.current(spark, base, "silver_customers").versions) == 7
    # a batch without a valid row touches none
    extract(frame(moved[1:], CUSTOMER_SCHEMA), SOURCES["customers"], base, "shop", ingested_at="2024-01-03 00:00:00")
    seq = store.current(spark, base, "silver_customers").seq
    assert stages.clean_pending(spark, base, "customers", ts).rejected == 1
    assert store.current(spark, base, "silver_customers").seq == seq


def test_checks_read_each_stored_model_once(spark, site):
    base, given, _, _ = site
    plan = stages.report(spark, base)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 11  # 5 RAW tables, 5 marts, the items once more for their totals


def test_arrival_brings_late_orders_and_later_items(spark, frame, base):
    """Only months with a changed row are rewritten; rows that come again unchanged are not."""
    item_schema = ("order_id string, product_id string, seller_id string, price decimal(18,2),"
                   " freight_value decimal(18,2), shipping_limit_date timestamp_ntz")  # fmt: skip

    def at(df, day):
        return df.withColumn("_ingested_at", F.lit(f"2024-01-{day:02d} 00:00:00").cast("timestamp_ntz"))

    def item(order):
        return (order, "p", "s", Decimal("2.00"), Decimal("1.00"), None)

    def build(o, i):
        stages.refresh_fact_orders(spark, base, o, i, increment_by="arrival")
        return {r.order_id: r.total_items for r in table(spark, base, "fact_orders").collect()}

    old = at(orders(frame, [("a", "c", "shipped", "2020-01-05"), ("b", "c", "shipped", "2020-02-05")]), 1)
    items = at(frame([item("a")], item_schema), 1)
    assert build(old, items) == {"a": 1, "b": 0}
    first = store.current(spark, base, "fact_orders").versions
    # all orders come again, one of them late; order b gets its first item
    again = at(orders(frame, [("a", "c", "shipped", "2020-01-05"), ("b", "c", "shipped", "2020-02-05"), ("z", "c", "shipped", "2019-05-05")]), 2)
    later = items.unionByName(at(frame([item("b")], item_schema), 2))
    assert build(again, later) == {"a": 1, "b": 1, "z": 0}
    second = store.current(spark, base, "fact_orders").versions
    assert second["202001"] == first["202001"] and second["202002"] != first["202002"] and "201905" in second
    # nothing new: nothing is written
    assert build(again, later) == {"a": 1, "b": 1, "z": 0}
    assert store.current(spark, base, "fact_orders").versions == second
    with pytest.raises(ValueError, match="increment_by"):
        stages.refresh_fact_orders(spark, base, again, later, increment_by="size")
