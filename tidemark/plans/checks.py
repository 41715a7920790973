"""The declared data checks: 52 on columns, 5 business rules.

``models`` maps a model name to its frame.  RAW tables are ``raw_<table>``.
Checks of one kind come back as one frame, so a report needs few jobs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.dedup import duplicate_keys
from tidemark.operators.joins import orphan_keys
from tidemark.operators.quality import failing, null_counts, unexpected_values, verdict
from tidemark.plans.models import staged_columns

Models = dict[str, DataFrame]

NOT_NULL = {
    "raw_customers": ("customer_id", "customer_unique_id"),
    "raw_orders": ("order_id", "customer_id"),
    "raw_order_items": ("order_id", "order_item_id", "product_id"),
    "raw_order_payments": ("order_id", "payment_sequential"),
    "raw_products": ("product_id",),
    "stg_customers": ("customer_id", "customer_unique_id"),
    "stg_orders": ("order_id", "customer_id", "order_status"),
    "stg_order_items": ("order_id", "order_item_id", "product_id"),
    "stg_order_payments": ("order_id", "payment_sequential"),
    "stg_products": ("product_id",),
    "int_order_items_aggregated": ("order_id", "total_items"),
    "dim_customers": ("customer_id", "customer_unique_id"),
    "dim_products": ("product_id",),
    "dim_date": ("date_key", "date_day"),
    "fact_orders": ("order_id", "customer_id", "order_date_key"),
    "fact_payments": ("order_id", "payment_sequential"),
}

UNIQUE = (
    ("stg_customers", "customer_id"),
    ("stg_orders", "order_id"),
    ("stg_products", "product_id"),
    ("int_order_items_aggregated", "order_id"),
    ("dim_customers", "customer_id"),
    ("dim_products", "product_id"),
    ("dim_date", "date_key"),
    ("dim_date", "date_day"),
    ("fact_orders", "order_id"),
)

# The order statuses a model may show.
ACCEPTED = {
    ("stg_orders", "order_status"): (
        "approved",
        "canceled",
        "created",
        "delivered",
        "invoiced",
        "processing",
        "shipped",
        "unavailable",
    )
}

# child, column, parent, parent column, severity
RELATIONSHIPS = (
    ("stg_orders", "customer_id", "stg_customers", "customer_id", "error"),
    ("stg_order_items", "order_id", "stg_orders", "order_id", "error"),
    ("stg_order_items", "product_id", "stg_products", "product_id", "warn"),
    ("stg_order_payments", "order_id", "stg_orders", "order_id", "error"),
    ("fact_orders", "customer_id", "dim_customers", "customer_id", "error"),
    ("fact_orders", "order_date_key", "dim_date", "date_key", "error"),
    ("fact_payments", "order_id", "fact_orders", "order_id", "error"),
    ("fact_payments", "customer_id", "dim_customers", "customer_id", "error"),
    ("fact_payments", "order_date_key", "dim_date", "date_key", "error"),
)


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def not_null(models: Models) -> DataFrame:
    """NULLs per declared column: one aggregate per model."""
    return _union(
        [
            null_counts(models[model], columns).select(
                F.lit(model).alias("model"), "column_name", "failures"
            )
            for model, columns in NOT_NULL.items()
        ]
    )


def unique(models: Models) -> DataFrame:
    """Keys that occur more than once, over all declared unique columns."""
    return _union(
        [
            duplicate_keys(models[model].filter(F.col(column).isNotNull()), [column]).select(
                F.lit(model).alias("model"),
                F.lit(column).alias("column_name"),
                F.col(column).cast("string").alias("key_value"),
                "record_count",
            )
            for model, column in UNIQUE
        ]
    )


def accepted_values(models: Models) -> DataFrame:
    return _union(
        [
            unexpected_values(models[model], column, allowed).select(
                F.lit(model).alias("model"),
                F.lit(column).alias("column_name"),
                F.col(column).alias("value"),
                "n_rows",
            )
            for (model, column), allowed in ACCEPTED.items()
        ]
    )


def relationships(models: Models) -> DataFrame:
    """Orphan keys of every declared relation, with their rows and severity."""
    return _union(
        [
            orphan_keys(models[child], column, models[parent], parent_column).select(
                F.lit(child).alias("child"),
                F.lit(column).alias("column_name"),
                F.lit(parent).alias("parent"),
                F.lit(severity).alias("severity"),
                F.col(column).cast("string").alias("key_value"),
                "n_rows",
            )
            for child, column, parent, parent_column, severity in RELATIONSHIPS
        ]
    )


def fact_payments_unique(models: Models) -> DataFrame:
    return duplicate_keys(models["fact_payments"], ["order_id", "payment_sequential"])


def _negative(*names: str) -> Column:
    return reduce(Column.__or__, (F.col(name) < 0 for name in names))


def fact_payments_value(models: Models) -> DataFrame:
    return failing(models["fact_payments"], _negative("payment_value"))


def fact_orders_amounts(models: Models) -> DataFrame:
    amounts = ("total_item_value", "total_freight_value", "total_order_value")
    return failing(models["fact_orders"], _negative(*amounts))


def fact_orders_items(models: Models) -> DataFrame:
    return failing(models["fact_orders"], _negative("total_items"))


def fact_orders_delivery(models: Models) -> DataFrame:
    """Orders delivered before they were bought; NULL times cannot fail."""
    late = F.col("order_delivered_customer_date") < F.col("order_purchase_timestamp")
    return failing(models["fact_orders"], late)


SINGULAR = {
    "fact_payments_unique": fact_payments_unique,
    "fact_payments_positive_value": fact_payments_value,
    "fact_orders_non_negative_amounts": fact_orders_amounts,
    "fact_orders_item_count": fact_orders_items,
    "fact_orders_delivery_logic": fact_orders_delivery,
}


#: Row checks of single models: rows that fail.
ROW_CHECKS = {
    "fact_payments_positive_value": ("fact_payments", lambda: _negative("payment_value")),
    "fact_orders_non_negative_amounts": (
        "fact_orders", lambda: _negative("total_item_value", "total_freight_value", "total_order_value"),
    ),
    "fact_orders_item_count": ("fact_orders", lambda: _negative("total_items")),
    "fact_orders_delivery_logic": (
        "fact_orders", lambda: F.col("order_delivered_customer_date") < F.col("order_purchase_timestamp"),
    ),
}
#: Checks on several columns together: keys that occur more than once.
COMPOSITE_KEYS = {"fact_payments_unique": ("fact_payments", ("order_id", "payment_sequential"))}


def declared() -> list[tuple[str, str, str, str]]:
    """(kind, model, column, severity) of all checks; the place in the list is the check's number."""
    found = [("not_null", model, column, "error") for model, cs in NOT_NULL.items() for column in cs]
    found += [("unique", model, column, "error") for model, column in UNIQUE]
    found += [("accepted_values", model, column, "error") for model, column in ACCEPTED]
    found += [
        ("relationships", child, f"{column} -> {parent}", severity)
        for child, column, parent, _, severity in RELATIONSHIPS
    ]
    return found + [("singular", name, "", "error") for name in SINGULAR]


def _findings(model: str, column: Callable[[str], Column]) -> list[Column]:
    """What a row of a model has to say to its checks: (check, key, whether it is a parent's key).

    NULL where it has nothing to say.
    """
    number = {(kind, of, name): i for i, (kind, of, name, _) in enumerate(declared())}

    def said(check: tuple[str, str, str], key: Column | None, when: Column, parent: bool = False) -> Column:
        text = (F.lit(None) if key is None else key).cast("string")
        finding = F.struct(F.lit(number[check]).alias("check"), text.alias("key"), F.lit(parent).alias("parent"))
        return F.when(when, finding)

    found = [said(("not_null", model, c), None, column(c).isNull()) for c in NOT_NULL.get(model, ())]
    found += [said(("unique", model, c), column(c), column(c).isNotNull()) for of, c in UNIQUE if of == model]
    for (of, c), allowed in ACCEPTED.items():
        if of == model:
            found.append(said(("accepted_values", model, c), column(c), column(c).isNotNull() & ~column(c).isin(*allowed)))
    for child, c, parent, parent_c, _ in RELATIONSHIPS:
        check = ("relationships", child, f"{c} -> {parent}")
        if child == model:
            found.append(said(check, column(c), column(c).isNotNull()))
        if parent == model:
            found.append(said(check, column(parent_c), column(parent_c).isNotNull(), parent=True))
    found += [said(("singular", name, ""), None, fails()) for name, (of, fails) in ROW_CHECKS.items() if of == model]
    for name, (of, keys) in COMPOSITE_KEYS.items():
        if of == model:
            found.append(said(("singular", name, ""), F.to_json(F.struct(*map(column, keys))), F.lit(True)))
    return found


def findings(models: Models, views: bool = False) -> DataFrame:
    """The findings of all models, with each model read once.

    ``views``: staging models are views over their RAW tables, so a RAW table
    and its view are judged in the same read.
    """
    named = [*dict.fromkeys([*NOT_NULL, *(of for of, _ in UNIQUE)])]
    groups: list[tuple[DataFrame, list[Column]]] = []
    for model in named:
        layer, _, table = model.partition("_")
        if views and layer == "stg":
            continue
        frame, plain = models[model], _findings(model, F.col)
        if views and layer == "raw":
            changed = {name: f"_stg_{name}" for name in staged_columns(table)}
            frame = frame.withColumns({changed[name]: c for name, c in staged_columns(table).items()})
            plain += _findings(f"stg_{table}", lambda name, changed=changed: F.col(changed.get(name, name)))
        groups.append((frame, plain))
    parts = [
        frame.select(F.explode(F.filter(F.array(*said), lambda x: x.isNotNull())).alias("f")).select("f.*")
        for frame, said in groups
    ]
    return _union(parts)


def report(models: Models, views: bool = False) -> DataFrame:
    """All 57 checks, one line each: failures, severity and status.

    Failures are rows for not_null and relationships, keys for unique, values
    for accepted_values.  One grouping serves all checks: a key meets its copies
    and its parents there, after each task has counted its own, so a frequent
    key is one row per task.  Every stored model is read once.
    """
    lines = [(i, *line) for i, line in enumerate(declared())]
    spark = models["fact_orders"].sparkSession
    schema = "check int, kind string, model string, column_name string, severity string"
    known = F.max("parent").alias("known")
    keys = findings(models, views).groupBy("check", "key").agg(F.count_if(~F.col("parent")).alias("n"), known)
    repeated = [i for i, kind, model, *_ in lines if kind == "unique" or model in COMPOSITE_KEYS]
    values = [i for i, kind, *_ in lines if kind == "accepted_values"]
    failures = (
        F.when(F.col("check").isin(*repeated), (F.col("n") > 1).cast("long"))
        .when(F.col("check").isin(*values), F.lit(1).cast("long"))
        .otherwise(F.when(F.col("known"), 0).otherwise(F.col("n")))
    )
    failed = keys.groupBy("check").agg(F.sum(failures).alias("failures"))
    joined = spark.createDataFrame(lines, schema).join(failed, "check", "left")
    counted = joined.withColumn("failures", F.coalesce(F.col("failures"), F.lit(0).cast("long")))
    return counted.withColumn("status", verdict("failures", "severity")).select(
        "kind", "model", "column_name", "severity", "failures", "status"
    )
