"""Registered queries: the whole pipeline over the given tables.

Each is a function of (session, folder of the tables).  Results carry doubles
for money and timestamps for dates, so that two engines show them alike; the
library itself keeps exact decimals and dates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType

from tidemark import fixtures
from tidemark.operators import history, joins, recon, upsert
from tidemark.plans import checks, cleaning, models, stages
from tidemark.plans.warehouse import to_raw
from tidemark.schemas import SILVER, TABLES
from tidemark.sources import ingest, marks, store
from tidemark.sources.bronze import files_of, read_batch, read_bronze, write_bronze
from tidemark.sources.concurrent import together
from tidemark.sources.readers import max_mark, read_increment
from tidemark.sources.store import stage, staging_path

Query = Callable[[SparkSession, str], DataFrame]

FIRST_MARK = "1998-06-01 00:00:00"
PROBE_CUSTOMER = "c20"
#: The calendar that checks read; orders before it have no date there.
CHECKED_FROM = "1995-01-01"


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles, dates as timestamps; everything else untouched."""
    columns = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, DateType):
            column = column.cast("timestamp_ntz")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def as_double(df: DataFrame, *names: str) -> DataFrame:
    """Whole numbers and flags that may be NULL, as doubles for the same reason."""
    return df.withColumns({name: F.col(name).cast("int").cast("double") for name in names})


# ---- layers -----------------------------------------------------------------


def bronze(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return fixtures.BRONZE[table](spark, sf_dir)


def silver(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return cleaning.silver(bronze(spark, sf_dir, table), cleaning.SPECS[table], fixtures.RUN_TS)


def rejected(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    rows = cleaning.rejected(bronze(spark, sf_dir, table), cleaning.SPECS[table], fixtures.RUN_TS)
    return as_double(rows, *[name for name, kind in SILVER[table].items() if kind == "int"])


def raw(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return to_raw(silver(spark, sf_dir, table), table)


def staging(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return models.staged(raw(spark, sf_dir, table), table)


def silver_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = [cleaning.metrics(bronze(spark, sf_dir, t), cleaning.SPECS[t]) for t in TABLES]
    result = lines[0]
    for line in lines[1:]:
        result = result.unionByName(line)
    return result


def silver_orders_refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver orders after the first batch, then the second batch folded in."""
    spec, ts = cleaning.SPECS["orders"], fixtures.RUN_TS
    first = cleaning.silver(fixtures.bronze_orders(spark, sf_dir, ("b1",)), spec, ts)
    second = fixtures.bronze_orders(spark, sf_dir, ("b2",))
    return cleaning.silver_refresh(first, second, spec, ts)


# ---- ingestion --------------------------------------------------------------


def _first_batch(df: DataFrame, table: str) -> DataFrame:
    return fixtures.in_batch(df, table, "b1")


def ingest_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = _first_batch(fixtures.source_products(spark, sf_dir), "products")
    return as_double(batch, "product_weight_g")


def ingest_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = fixtures.source_orders(spark, sf_dir)
    new = read_increment(source, "order_purchase_timestamp", FIRST_MARK)
    return _first_batch(new, "orders")


def ingest_new_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return max_mark(ingest_incremental(spark, sf_dir), "order_purchase_timestamp")


def ingest_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Announced rows against rows written and read back.

    One full load, one increment, and one increment that loses rows on its way.
    """
    source = fixtures.source_orders(spark, sf_dir)
    announced = source.filter(
        F.col("order_purchase_timestamp") > F.lit(FIRST_MARK).cast("timestamp_ntz")
    )
    full = ingest.validation(
        "products",
        ingest.SOURCES["products"].load_type,
        fixtures.source_products(spark, sf_dir),
        _landed(spark, ingest_full(spark, sf_dir), "products"),
    )
    partial_load = ingest.validation(
        "orders",
        ingest.SOURCES["orders"].load_type,
        announced,
        _landed(spark, ingest_incremental(spark, sf_dir), "orders"),
    )
    some = ingest_incremental(spark, sf_dir).filter(F.col("order_id").endswith("7"))
    lossy = ingest.validation("orders", "lossy", announced, _landed(spark, some, "orders"))
    return full.unionByName(partial_load).unionByName(lossy)


def _landed(spark: SparkSession, batch: DataFrame, table: str) -> DataFrame:
    """A stamped batch, appended to a Bronze of its own and read back."""
    base, at = staging_path(spark), fixtures.BATCH_TIMES["b1"]
    write_bronze(batch, base, table, at)
    return read_batch(spark, base, table, "b1", at)


def ingest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of five extractions into a Bronze of its own.

    All products; orders from a given mark; orders again, which brings nothing;
    orders again with the second delivery, whose times are not after the mark;
    all orders with it.
    """
    base = staging_path(spark)
    orders, products = fixtures.source_orders(spark, sf_dir), fixtures.source_products(spark, sf_dir)
    more = orders.unionByName(fixtures.redelivered_orders(spark, sf_dir))
    marks.save_mark(spark, base, "orders", FIRST_MARK, "before")
    steps = [("products", products, False), ("orders", orders, False), ("orders", orders, False)]
    steps += [("orders", more, False), ("orders", more, True)]
    lines = []
    for step, (table, source, full) in enumerate(steps, 1):
        done = ingest.extract(source, ingest.SOURCES[table], base, fixtures.SYSTEM, batch_id=f"b{step}", full=full)
        stored = read_bronze(spark, base, table).where(F.col("_batch_id") == f"b{step}").count()
        mark = marks.load_mark(spark, base, table)
        lines.append((step, table, done.batch_id is not None, done.rows, stored, mark))
    return spark.createDataFrame(
        lines, "step int, table_name string, has_batch boolean, announced_rows long, bronze_rows long, watermark string"
    )


def _in_layers(spark: SparkSession, sf_dir: str, base: str, table: str, batch: DataFrame, batch_id: str) -> None:
    """A stamped batch arrives in Bronze, as after an extraction."""
    at = fixtures.BATCH_TIMES[batch_id]
    write_bronze(batch, base, table, at)
    marks.log_batch(spark, base, table, batch_id, at)


def silver_orders_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver orders as stored: built from the first batch, then the second folded into its slices."""
    base = staging_path(spark)
    for batch in ("b1", "b2"):
        _in_layers(spark, sf_dir, base, "orders", fixtures.bronze_orders(spark, sf_dir, (batch,)), batch)
        stages.refresh_silver(spark, base, "orders", fixtures.RUN_TS, rebuild=False)
    return store.read_table(spark, base, "silver_orders")


def rejected_orders_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejects as stored by the same two runs, with the lines of the batch log that they leave."""
    base = staging_path(spark)
    for batch in ("b1", "b2"):
        _in_layers(spark, sf_dir, base, "orders", fixtures.bronze_orders(spark, sf_dir, (batch,)), batch)
        stages.refresh_silver(spark, base, "orders", fixtures.RUN_TS, rebuild=False)
    waiting = len(marks.waiting(spark, base, "orders"))
    stored = store.read_table(spark, base, "rejected_orders")
    return stored.groupBy("_rejection_reason", "_batch_id").agg(F.count("*").alias("n_rows")).withColumn(
        "waiting_batches", F.lit(waiting)
    )


def bronze_of_two_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of products with different columns, read as one history.

    The second lacks the weight and has a colour, which the first does not know.
    """
    base, first = staging_path(spark), fixtures.bronze_products(spark, sf_dir)
    second = first.drop("product_weight_g").withColumns(
        {"colour": F.lit("red"), "_batch_id": F.lit("b2"), "_ingested_at": F.lit(fixtures.BATCH_TIMES["b2"]).cast("timestamp_ntz")}
    )
    _in_layers(spark, sf_dir, base, "products", first, "b1")
    _in_layers(spark, sf_dir, base, "products", second, "b2")
    history = read_bronze(spark, base, "products")
    return history.groupBy("_batch_id", "_ingested_at").agg(
        F.count("*").alias("n_rows"), F.count("product_weight_g").alias("n_weights"), F.count("colour").alias("n_colours")
    )


def bronze_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of stored files, summed by batch, and whether every file has rows of one batch only."""
    base = staging_path(spark)
    for batch in ("b1", "b2"):
        _in_layers(spark, sf_dir, base, "orders", fixtures.bronze_orders(spark, sf_dir, (batch,)), batch)
    files = stage(files_of(read_bronze(spark, base, "orders")))
    shared = files.groupBy("file_path").agg(F.count("*").alias("batches"), F.first("_batch_id").alias("_batch_id"))
    return (
        files.join(shared.drop("_batch_id"), "file_path")
        .groupBy("_batch_id")
        .agg(F.sum("n_rows").alias("n_rows"), (F.max("batches") == 1).alias("own_files"))
    )


def load_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RAW products after a load, and after an empty one, which is refused and leaves them."""
    base = staging_path(spark)
    _in_layers(spark, sf_dir, base, "products", fixtures.bronze_products(spark, sf_dir), "b1")
    stages.clean(spark, base, "products", fixtures.RUN_TS)
    stages.load(spark, base, "products")
    empty = store.read_table(spark, base, "silver_products").limit(0)
    store.publish(empty, base, "silver_products")
    refused = False
    try:
        stages.load(spark, base, "products")
    except store.EmptyTableError:
        refused = True
    stored = store.read_table(spark, base, "raw_products")
    return stored.agg(F.count("*").alias("n_rows")).withColumn("refused", F.lit(refused))


def silver_products_without_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silver products from a Bronze that lacks all optional columns: they are NULL, and no rule breaks on them."""
    spec = cleaning.SPECS["products"]
    given = bronze(spark, sf_dir, "products")
    absent = [c for c in given.columns if c in spec.optional or c in spec.spellings]
    rows = cleaning.silver(given.drop(*absent), spec, fixtures.RUN_TS)
    counts = [F.count(name).alias(f"n_{name}") for name in ("product_category_name", "product_weight_g")]
    return rows.agg(F.count("*").alias("n_rows"), *counts)


def fact_columns_follow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A merge whose increment has a new column and lacks an old one."""
    orders = staging(spark, sf_dir, "orders").select("order_id", "order_status", "customer_id")
    old = orders.where(~F.col("order_status").isin("delivered"))
    new = orders.where(F.col("order_status").isin("delivered", "shipped")).select(
        "order_id", "order_status", F.length("customer_id").alias("id_length")
    )
    merged = upsert.upsert(old, new, ["order_id"])
    return as_double(merged, "id_length")


# ---- history ----------------------------------------------------------------


def _customer_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid customers of every batch, through RAW and staging."""
    spec = cleaning.SPECS["customers"]
    rows = cleaning.valid(bronze(spark, sf_dir, "customers"), spec)
    stamped = cleaning.stamp(rows, fixtures.RUN_TS)
    return models.staged(to_raw(stamped, "customers"), "customers")


def customers_scd2(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = models.snapshot_source(_customer_batches(spark, sf_dir))
    return history.scd2_replay(
        batches, "customer_id", models.TRACKED, "_ingested_at", ["_batch_id"]
    )


def customers_scd2_stepwise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same history, one snapshot after each batch."""
    result = None
    for batch in ("b1", "b2", "b3"):
        rows = fixtures.bronze_customers(spark, sf_dir, (batch,))
        clean = cleaning.silver(rows, cleaning.SPECS["customers"], fixtures.RUN_TS)
        current = models.snapshot_source(
            models.staged(to_raw(clean, "customers"), "customers")
        )
        ts = F.lit(fixtures.BATCH_TIMES[batch])
        if result is None:
            result = history.scd2_start(current, ts)
        else:
            result = history.scd2_apply(
                stage(result), current, "customer_id", models.TRACKED, ts
            )
    return result


def customers_scd2_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same history through the published snapshot; the last batch comes twice."""
    base = staging_path(spark)
    spec = cleaning.SPECS["customers"]
    for batch in ("b1", "b2", "b3", "b3"):
        clean = cleaning.silver(fixtures.bronze_customers(spark, sf_dir, (batch,)), spec, fixtures.RUN_TS)
        current = models.staged(to_raw(clean, "customers"), "customers")
        stages.snapshot(spark, base, current, fixtures.BATCH_TIMES[batch])
    return store.read_table(spark, base, stages.HISTORY)


def customer_history_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of one customer; the key filter reaches the scan side of the windows."""
    versions = history.versions_of(customers_scd2(spark, sf_dir), "customer_id", PROBE_CUSTOMER)
    return versions.select(
        "customer_id", "customer_city", "customer_state", history.VALID_FROM, history.VALID_TO
    )


# ---- models -----------------------------------------------------------------


def int_order_items_aggregated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.item_totals(staging(spark, sf_dir, "order_items"))


def dim_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar from 1 January of the year of the first order."""
    orders = bronze(spark, sf_dir, "orders")
    first = orders.agg(F.min("order_purchase_timestamp").alias("first"))
    return models.calendar_from(first.select(F.trunc("first", "year").alias("start")))


def dim_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.dim_products(staging(spark, sf_dir, "products"))


def dim_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.dim_customers(customers_scd2(spark, sf_dir))


def fact_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.fact_orders(
        staging(spark, sf_dir, "orders"), int_order_items_aggregated(spark, sf_dir)
    )


def fact_orders_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = models.with_delivery(fact_orders(spark, sf_dir))
    return as_double(fact, "delivery_days", "delivered_on_time")


def fact_orders_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First build from early orders of the first batch, then one merge of all.

    Item totals, first build and increment are read by two plans each and are
    written, as a run would.
    """
    items = int_order_items_aggregated(spark, sf_dir)
    totals = stage(items.select("order_id", *models.FACT_SUMS))
    spec = cleaning.SPECS["orders"]
    early = fixtures.bronze_orders(spark, sf_dir, ("b1",)).filter(
        F.col("order_purchase_timestamp") < F.lit(fixtures.FIRST_BUILD_BEFORE).cast("timestamp_ntz")
    )
    early = to_raw(cleaning.silver(early, spec, fixtures.RUN_TS), "orders")
    target = stage(models.fact_orders(models.staged(early, "orders"), totals))
    new = upsert.increment(staging(spark, sf_dir, "orders"), target, "order_purchase_timestamp")
    return upsert.upsert(target, stage(models.fact_orders(new, totals)), ["order_id"])


def fact_orders_by_arrival(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored fact after a build from the first batch and a merge of what the second brought.

    The second batch holds orders of all times, so the rule of the last purchase
    would miss nearly all of them; by arrival the fact is that of a full build.
    """
    base = staging_path(spark)
    items = stage(staging(spark, sf_dir, "order_items"))
    for batches in (("b1",), ("b1", "b2")):
        rows = fixtures.bronze_orders(spark, sf_dir, batches)
        clean = cleaning.silver(rows, cleaning.SPECS["orders"], fixtures.RUN_TS)
        orders = stage(models.staged(to_raw(clean, "orders"), "orders"))
        stages.refresh_fact_orders(spark, base, orders, items, increment_by="arrival")
    return store.read_table(spark, base, "fact_orders")


def fact_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.fact_payments(
        staging(spark, sf_dir, "order_payments"), staging(spark, sf_dir, "orders")
    )


class Published(dict):
    """Models by name, each built when first asked for; RAW and marts are written once.

    A check that names two models so pays for these two only.  ``prepare`` builds
    many, those that do not depend on each other at the same time.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self._spark, self._sf_dir = spark, sf_dir

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self._build(name)
        return self[name]

    def prepare(self, names: Iterable[str]) -> Published:
        wanted = {x for name in names for x in self._needs(name)}
        for level in (TABLES_AND_HISTORY, ("int_order_items_aggregated", "fact_payments"), ("fact_orders",)):
            together({name: partial(self.__getitem__, name) for name in level if name in wanted})
        return self

    def _needs(self, name: str) -> list[str]:
        layer, _, table = name.partition("_")
        parts = {
            "stg": [f"raw_{table}"],
            "int": ["raw_order_items"],
            "fact": ["raw_orders", "raw_order_payments" if table == "payments" else "int_order_items_aggregated"],
        }.get(layer, ["raw_products"] if name == "dim_products" else [])
        return [name, *(x for part in parts for x in self._needs(part))]

    def _build(self, name: str) -> DataFrame:
        spark, sf_dir = self._spark, self._sf_dir
        layer, _, table = name.partition("_")
        if layer == "raw":
            return stage(raw(spark, sf_dir, table))
        if layer == "stg":
            return models.staged(self[f"raw_{table}"], table)
        if name == "int_order_items_aggregated":
            return stage(models.item_totals(self["stg_order_items"], dealt=True))
        if name == "fact_orders":
            return stage(models.fact_orders(self["stg_orders"], self["int_order_items_aggregated"]))
        if name == "fact_payments":
            return stage(models.fact_payments(self["stg_order_payments"], self["stg_orders"]))
        if name == "dim_customers":
            return stage(dim_customers(spark, sf_dir))
        if name == "dim_products":
            return models.dim_products(self["stg_products"])
        if name == "dim_date":
            return models.dim_date(spark, CHECKED_FROM)
        raise KeyError(name)


#: Written models that depend on no other one.
TABLES_AND_HISTORY = (*(f"raw_{t}" for t in TABLES), "dim_customers")


def published(spark: SparkSession, sf_dir: str) -> Published:
    """All models over written RAW tables and facts, as checks read them in a run."""
    return Published(spark, sf_dir)


# ---- checks -----------------------------------------------------------------


def checked(
    check: Callable[[dict[str, DataFrame]], DataFrame], names: Iterable[str], spark: SparkSession, sf_dir: str
) -> DataFrame:
    """A check that reads several models, over written ones."""
    return check(published(spark, sf_dir).prepare(names))


def dq_accepted_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared statuses in staging, and the same test on Bronze text as it came."""
    staged = {"stg_orders": staging(spark, sf_dir, "orders")}
    arrived = {"stg_orders": bronze(spark, sf_dir, "orders")}
    clean = checks.accepted_values(staged).withColumn("layer", F.lit("staging"))
    return clean.unionByName(checks.accepted_values(arrived).withColumn("layer", F.lit("bronze")))


def on_payments(check, spark: SparkSession, sf_dir: str) -> DataFrame:
    return check({"fact_payments": fact_payments(spark, sf_dir)})


def on_orders(check, spark: SparkSession, sf_dir: str) -> DataFrame:
    return check({"fact_orders": fact_orders(spark, sf_dir)})


# ---- reconciliation ---------------------------------------------------------


def recon_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    marts = ("dim_customers", "dim_products", "fact_orders", "fact_payments")
    frames = published(spark, sf_dir).prepare([*(f"raw_{t}" for t in TABLES), *marts])
    layers = {("bronze", t): bronze(spark, sf_dir, t) for t in TABLES}
    layers |= {("raw", t): frames[f"raw_{t}"] for t in TABLES}
    layers |= {("staging", f"stg_{t}"): frames[f"stg_{t}"] for t in TABLES}
    layers |= {("analytics", name): frames[name] for name in marts}
    return recon.row_counts(layers)


def recon_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that find their customer by id, and by the wrong id."""
    orders = staging(spark, sf_dir, "orders")
    customers = staging(spark, sf_dir, "customers")
    by_id = joins.match_count(orders, customers, "customer_id", "customer_id")
    by_unique_id = joins.match_count(orders, customers, "customer_id", "customer_unique_id")
    return by_id.withColumn("probe", F.lit("customer_id")).unionByName(
        by_unique_id.withColumn("probe", F.lit("customer_unique_id"))
    )


def recon_orders_without_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = staging(spark, sf_dir, "orders")
    customers = staging(spark, sf_dir, "customers")
    found = joins.first_orphans(orders, "customer_id", customers, "customer_id", "order_id", 10)
    return found.withColumnRenamed("customer_id", "order_customer_id")


def recon_max_purchase_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = F.max("order_purchase_timestamp").alias("max_purchase_timestamp")
    return fact_orders(spark, sf_dir).agg(latest)


# ---- writes -----------------------------------------------------------------


def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order in process is inserted twice: as it is, and as a new order.

    The copy under its own id is ignored; the new id is added once, although
    it comes in two versions.
    """
    orders = stage(staging(spark, sf_dir, "orders"))
    active = orders.filter(F.col("order_status") == "processing")
    later = F.col("order_purchase_timestamp") + F.expr("INTERVAL 1 DAY")
    again = active.withColumn("order_id", F.concat("order_id", F.lit("-again")))
    new = active.unionByName(again).unionByName(again.withColumn("order_purchase_timestamp", later))
    keys = ["order_id"]
    return upsert.merge(orders, upsert.first_new(new, keys), keys, [upsert.Clause("new")])


def conditional_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = {"customer_city": F.lit("harbour"), "customer_state": F.lit("HB")}
    return upsert.conditional_update(
        staging(spark, sf_dir, "customers"), F.col("customer_id") == PROBE_CUSTOMER, moved
    )


def _queries() -> dict[str, Query]:
    found: dict[str, Query] = {}
    per_table = {"silver": silver, "rejected": rejected, "raw": raw, "stg": staging}
    for prefix, layer in per_table.items():
        for table in TABLES:
            found[f"{prefix}_{table}"] = partial(_of_table, layer, table)
    for query in (
        silver_metrics,
        silver_orders_refreshed,
        ingest_full,
        ingest_incremental,
        ingest_new_watermark,
        ingest_validation,
        ingest_runs,
        silver_orders_sliced,
        rejected_orders_sliced,
        bronze_of_two_schemas,
        bronze_lineage,
        load_guard,
        silver_products_without_sizes,
        fact_columns_follow,
        customers_scd2,
        customers_scd2_stepwise,
        customers_scd2_published,
        customer_history_lookup,
        int_order_items_aggregated,
        dim_date,
        dim_products,
        dim_customers,
        fact_orders,
        fact_orders_delivery,
        fact_orders_incremental,
        fact_orders_by_arrival,
        fact_payments,
        dq_accepted_values,
        recon_row_counts,
        recon_match_counts,
        recon_orders_without_customer,
        recon_max_purchase_ts,
        insert_if_absent,
        conditional_update,
    ):
        found[query.__name__] = query
    found |= {
        "dq_not_null": partial(checked, checks.not_null, checks.NOT_NULL),
        "dq_unique": partial(checked, checks.unique, [model for model, _ in checks.UNIQUE]),
        "dq_relationships": partial(
            checked, checks.relationships, [x for child, _, parent, *_ in checks.RELATIONSHIPS for x in (child, parent)]
        ),
        "dq_report": partial(checked, partial(checks.report, views=True), checks.NOT_NULL),
        "dq_fact_payments_unique": partial(on_payments, checks.fact_payments_unique),
        "dq_fact_payments_value": partial(on_payments, checks.fact_payments_value),
        "dq_fact_orders_amounts": partial(on_orders, checks.fact_orders_amounts),
        "dq_fact_orders_items": partial(on_orders, checks.fact_orders_items),
        "dq_fact_orders_delivery": partial(on_orders, checks.fact_orders_delivery),
    }
    return found


def _of_table(layer, table: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return layer(spark, sf_dir, table)


def _plain(query: Query, spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(query(spark, sf_dir))


QUERIES: dict[str, Query] = {name: partial(_plain, query) for name, query in _queries().items()}
