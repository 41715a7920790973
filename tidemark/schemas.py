"""Declared columns of the five tables, layer by layer.

Types are Spark SQL type names.  Money and product sizes are doubles in
Silver and exact decimals from RAW onward.
"""

from __future__ import annotations

MONEY = "decimal(18,2)"

BATCH_COLUMNS = {
    "_ingested_at": "timestamp_ntz",
    "_batch_id": "string",
    "_source_system": "string",
    "_source_table": "string",
}
PROCESSED_AT = "_silver_processed_at"
REASON = "_rejection_reason"

ORDER_TIMES = (
    "order_purchase_timestamp",
    "order_approved_at",
    "order_delivered_carrier_date",
    "order_delivered_customer_date",
    "order_estimated_delivery_date",
)
PRODUCT_COUNTS = (
    "product_name_length",
    "product_description_length",
    "product_photos_qty",
)
PRODUCT_SIZES = (
    "product_weight_g",
    "product_length_cm",
    "product_height_cm",
    "product_width_cm",
)

# Business columns as the warehouse types them.
RAW = {
    "customers": {
        "customer_id": "string",
        "customer_unique_id": "string",
        "customer_zip_code_prefix": "string",
        "customer_city": "string",
        "customer_state": "string",
    },
    "orders": {
        "order_id": "string",
        "customer_id": "string",
        "order_status": "string",
        **{name: "timestamp_ntz" for name in ORDER_TIMES},
    },
    "order_items": {
        "order_id": "string",
        "order_item_id": "int",
        "product_id": "string",
        "seller_id": "string",
        "shipping_limit_date": "timestamp_ntz",
        "price": MONEY,
        "freight_value": MONEY,
    },
    "order_payments": {
        "order_id": "string",
        "payment_sequential": "int",
        "payment_type": "string",
        "payment_installments": "int",
        "payment_value": MONEY,
    },
    "products": {
        "product_id": "string",
        "product_category_name": "string",
        **{name: "int" for name in PRODUCT_COUNTS},
        **{name: MONEY for name in PRODUCT_SIZES},
    },
}

TABLES = tuple(RAW)

KEYS = {
    "customers": ("customer_id",),
    "orders": ("order_id",),
    "order_items": ("order_id", "order_item_id"),
    "order_payments": ("order_id", "payment_sequential"),
    "products": ("product_id",),
}


def _silver_type(name: str, raw_type: str) -> str:
    return "double" if raw_type == MONEY or name in PRODUCT_COUNTS else raw_type


SILVER = {
    table: {name: _silver_type(name, kind) for name, kind in columns.items()}
    for table, columns in RAW.items()
}


def ddl(columns: dict[str, str]) -> str:
    """Schema string for ``spark.read.schema`` and ``createDataFrame``."""
    return ", ".join(f"`{name}` {kind}" for name, kind in columns.items())
