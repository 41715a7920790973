import pytest
from pyspark.sql import functions as F

from tidemark.plans.cleaning import SPECS, normalise
from tidemark.sources import ingest, marks
from tidemark.sources.bronze import read_bronze, write_bronze
from tidemark.sources.ingest import SOURCES, RowCountError, Source, extract
from tidemark.sources.marks import load_mark, log_batch, pending_batches, save_mark
from tidemark.sources.readers import (
    hash_predicates,
    jdbc_options,
    mark_bound,
    max_mark,
    quoted,
    read_between,
    read_increment,
    read_jdbc,
)

ORDERS = SOURCES["orders"]


def orders(frame, *rows):
    df = frame([tuple(r) for r in rows], "order_id string, order_purchase_timestamp string")
    return df.withColumn(
        "order_purchase_timestamp", F.col("order_purchase_timestamp").cast("timestamp_ntz")
    )


def test_full_load_appends_with_metadata(spark, frame, base):
    df = frame([("c1",), ("c2",)], "customer_id string")
    for _ in range(2):
        done = extract(df, SOURCES["customers"], base, "shop", ingested_at="2024-03-05 06:07:08")
    bronze = read_bronze(spark, base, "customers")
    assert bronze.count() == 4 and done.rows == 2 and done.mark is None
    row = bronze.filter(F.col("_batch_id") == done.batch_id).first()
    assert (row.year, row.month, row.day) == (2024, 3, 5)
    # the second batch of one time comes a microsecond later
    assert str(row._ingested_at) == "2024-03-05 06:07:08.000001"
    assert (row._source_system, row._source_table) == ("shop", "customers")
    assert bronze.select("_batch_id").distinct().count() == 2


def test_increment_moves_the_mark(spark, frame, base):
    first = orders(frame, ("o1", "2020-01-01"), ("o2", "2020-01-02"), ("o3", None))
    done = extract(first, ORDERS, base, "shop", ingested_at="2024-01-01 00:00:00")
    assert (done.rows, done.mark) == (3, "2020-01-02 00:00:00")
    again = extract(first, ORDERS, base, "shop")
    assert (again.batch_id, again.rows) == (None, 0)
    assert read_bronze(spark, base, "orders").count() == 3
    # A tie with the mark, an unknown time and an older order stay behind.
    more = first.unionByName(
        orders(frame, ("o4", "2020-01-02"), ("o5", "2019-01-01"), ("o6", "2020-01-03 10:00:00.5"))
    )
    done = extract(more, ORDERS, base, "shop", ingested_at="2024-01-02 00:00:00")
    assert (done.rows, done.mark) == (1, "2020-01-03 10:00:00.5")
    assert load_mark(spark, base, "orders") == done.mark
    # A full load reads everything and sets the mark again.
    assert extract(more, ORDERS, base, "shop", full=True).rows == 6


def test_mark_comes_from_the_batch(frame):
    df = orders(frame, ("o1", "2020-01-01"), ("o2", None))
    assert max_mark(df, "order_purchase_timestamp").first()[0] == "2020-01-01 00:00:00"
    assert max_mark(df.limit(0), "order_purchase_timestamp").first()[0] is None


def test_batches_are_pending_until_cleaned(spark, frame, base):
    assert pending_batches(spark, base, "customers") == []
    df = frame([("c1",)], "customer_id string")
    for batch, at in (("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:00:00")):
        extract(df, SOURCES["customers"], base, "shop", batch_id=batch, ingested_at=at)
    assert [b for b, _ in pending_batches(spark, base, "customers")] == ["a", "b"]
    log_batch(spark, base, "customers", "a", "2024-01-01 00:00:00", cleaned=True)
    assert [b for b, _ in pending_batches(spark, base, "customers")] == ["b"]


def test_marks_are_kept_per_table(spark, base):
    assert load_mark(spark, base, "orders") is None
    save_mark(spark, base, "orders", "2020-01-01 00:00:00", "b1")
    save_mark(spark, base, "other", "2021-01-01 00:00:00", "b2")
    save_mark(spark, base, "orders", "2019-01-01 00:00:00", "b3")
    assert load_mark(spark, base, "orders") == "2019-01-01 00:00:00"
    assert load_mark(spark, base, "other") == "2021-01-01 00:00:00"


def test_lost_rows_raise_and_leave_the_mark(spark, frame, base, monkeypatch):
    def lossy(df, *args):
        write_bronze(df.limit(1), *args)

    monkeypatch.setattr(ingest, "write_bronze", lossy)
    df = orders(frame, ("o1", "2020-01-01"), ("o2", "2020-01-02"))
    with pytest.raises(RowCountError, match="2 rows, Bronze got 1"):
        extract(df, ORDERS, base, "shop")
    assert load_mark(spark, base, "orders") is None


def test_rows_per_file(spark, base):
    df = spark.range(100).coalesce(1).withColumnRenamed("id", "customer_id")
    extract(df, SOURCES["customers"], base, "shop", max_rows_per_file=30)
    assert len(read_bronze(spark, base, "customers").inputFiles()) == 4


def test_no_bronze_yet(spark, base):
    assert read_bronze(spark, base, "orders") is None


def test_load_types():
    assert [SOURCES[n].load_type for n in ("orders", "payments")] == ["incremental", "full"]
    assert SOURCES["payments"] == Source("order_payments")


def test_every_row_is_in_one_hash_split():
    first, *others = hash_predicates("order_id", 3)
    part = 'mod(cast(hashtext(cast("order_id" as text)) as bigint) + 2147483648, 3)'
    assert first == f'"order_id" is null or {part} = 0' and others == [f"{part} = 1", f"{part} = 2"]


def test_splits_need_a_way_to_split(spark):
    for options in ({}, {"split_by": "id", "bounds": ("0", "9"), "hash_of": "id"}):
        with pytest.raises(ValueError, match="either"):
            read_jdbc(spark, "jdbc:x", "orders", splits=4, **options)


def test_jdbc_options():
    assert quoted('public.or"ders') == '"public"."or""ders"'
    options = jdbc_options("jdbc:x", "orders", {"user": "u"}, 500, "id", ("0", "9"), 3)
    assert options == {
        "user": "u",
        "url": "jdbc:x",
        "dbtable": '"orders"',
        "fetchsize": "500",
        "preferTimestampNTZ": "true",
        "partitionColumn": "id",
        "lowerBound": "0",
        "upperBound": "9",
        "numPartitions": "3",
    }
    with pytest.raises(ValueError):
        jdbc_options("jdbc:x", "orders", split_by="id")


def test_increment_filter_reaches_the_scan(spark, frame, base):
    path = f"{base}/source"
    orders(frame, ("o1", "2020-01-01")).write.parquet(path)
    df = read_increment(spark.read.parquet(path), "order_purchase_timestamp", "2019-01-01 00:00:00")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(order_purchase_timestamp,2019-01-01T00:00)" in plan


def test_columns_of_some_batches_are_kept(spark, frame, base):
    old = frame([("p1", "7")], "product_id string, product_name_lenght string")
    new = frame([("p2", "8")], "product_id string, product_name_length string")
    for df in (old, new):
        extract(df, SOURCES["products"], base, "shop")
    rows = normalise(read_bronze(spark, base, "products"), SPECS["products"]).collect()
    assert {r.product_id: r.product_name_length for r in rows} == {"p1": 7.0, "p2": 8.0}


def test_source_is_read_once(spark, base):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.range(50).selectExpr("cast(id AS string) AS customer_id").mapInArrow(seen, "customer_id string")
    done = extract(df, SOURCES["customers"], base, "shop")
    assert done.rows == 50 and read.value == 50


def test_rows_that_come_in_between_wait(frame, base, monkeypatch):
    df = orders(frame, ("o1", "2020-01-01"), ("o2", "2020-01-02"), ("o3", None))
    # o2 was not there yet when the end of the increment was fixed
    monkeypatch.setattr(ingest, "mark_bound", lambda *_: "2020-01-01 00:00:00")
    done = extract(df, ORDERS, base, "shop", batch_id="a")
    assert (done.rows, done.mark) == (2, "2020-01-01 00:00:00")
    monkeypatch.undo()
    done = extract(df, ORDERS, base, "shop", batch_id="b")
    assert (done.rows, done.mark) == (1, "2020-01-02 00:00:00")
    # a full load without any time
    timeless = extract(df.where("order_id = 'o3'"), ORDERS, base, "shop", full=True)
    assert (timeless.rows, timeless.mark) == (1, None)


def test_bounds(frame):
    df = orders(frame, ("o1", "2020-01-01"), ("o2", "2020-01-02 00:00:00.123456"), ("o3", None))
    column = "order_purchase_timestamp"
    assert mark_bound(df, column, None) == "2020-01-02 00:00:00.123456"
    assert mark_bound(df, column, "2021-01-01 00:00:00") is None
    ids = lambda *limits: sorted(r.order_id for r in read_between(df, column, *limits).collect())
    assert ids(None, "2020-01-02 00:00:00.123456") == ["o1", "o2", "o3"]
    assert ids("2020-01-01 00:00:00", "2020-01-02 00:00:00.123456") == ["o2"]
    assert ids(None, None) == ["o3"]


def test_nothing_to_take(spark, frame, base):
    done = extract(frame([], "customer_id string"), SOURCES["customers"], base, "shop")
    assert (done.batch_id, done.rows) == (None, 0)
    assert pending_batches(spark, base, "customers") == []


def test_schema_conflicts_are_named_before_the_write(spark, frame, base):
    extract(frame([("p1", 1)], "product_id string, size int"), SOURCES["products"], base, "shop")
    with pytest.raises(marks.SchemaConflict, match="products: column size has come as int and string"):
        extract(frame([("p2", "x")], "product_id string, size string"), SOURCES["products"], base, "shop")
    assert read_bronze(spark, base, "products").count() == 1
    extract(frame([("p3", "red")], "product_id string, colour string"), SOURCES["products"], base, "shop")
    history = read_bronze(spark, base, "products")
    assert {(r.product_id, r["size"], r.colour) for r in history.collect()} == {("p1", 1, None), ("p3", None, "red")}
    assert history.count() == 2 and len(marks._schema_lines(spark, base, "products")) == 2
