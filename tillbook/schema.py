"""Column order, types and defaults of the retail tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

_DDL = {
    "customers": (
        "customer_id long, first_name string, last_name string, email string, phone string, "
        "address string, city string, state string, zip_code string, country string, "
        "created_at timestamp, updated_at timestamp, loyalty_points long, customer_type string"
    ),
    "products": (
        "product_id long, product_name string, category string, subcategory string, "
        "description string, price decimal(10,2), cost decimal(10,2), weight decimal(10,3), "
        "dimensions string, manufacturer string, sku string, created_at timestamp, is_active int"
    ),
    "inventory": (
        "inventory_id long, product_id long, warehouse_location string, quantity_available long, "
        "quantity_reserved long, reorder_level long, last_restock_date timestamp, updated_at timestamp"
    ),
    "orders": (
        "order_id long, customer_id long, order_date timestamp, status string, "
        "total_amount decimal(12,2), tax_amount decimal(10,2), shipping_cost decimal(8,2), "
        "payment_method string, shipping_address string, tracking_number string, "
        "created_at timestamp, updated_at timestamp"
    ),
    "order_items": (
        "order_item_id long, order_id long, product_id long, quantity long, "
        "unit_price decimal(10,2), discount decimal(12,2), subtotal decimal(12,2)"
    ),
    "transactions": (
        "transaction_id long, order_id long, transaction_type string, amount decimal(12,2), "
        "currency string, payment_gateway string, gateway_transaction_id string, status string, "
        "processed_at timestamp, error_message string"
    ),
    "audit_log": (
        "audit_id long, table_name string, operation string, record_id long, old_value string, "
        "new_value string, changed_by string, changed_at timestamp"
    ),
    "session_data": (
        "session_id string, customer_id long, login_time timestamp, last_activity timestamp, "
        "ip_address string, user_agent string, session_data string, is_active int"
    ),
    "sales_summary": (
        "summary_id long, summary_date date, total_orders long, total_revenue decimal(15,2), "
        "total_customers long, avg_order_value decimal(10,2), created_at timestamp"
    ),
    "customer_analytics": (
        "analytics_id long, customer_id long, total_orders long, total_spent decimal(12,2), "
        "avg_order_value decimal(10,2), last_order_date timestamp, customer_segment string, "
        "calculated_at timestamp"
    ),
    "product_performance": (
        "performance_id long, product_id long, period_start date, period_end date, units_sold long, "
        "revenue decimal(12,2), profit decimal(12,2), return_count long, calculated_at timestamp"
    ),
    "product_recommendation": "product_id long, recommendation_score long, last_analyzed timestamp",
}


def table_schema(name: str) -> T.StructType:
    schema = T.StructType()
    for column in _DDL[name].split(", "):
        field, kind = column.split(" ")
        schema = schema.add(field, _TYPES.get(kind) or T.DecimalType(*_digits(kind)))
    return schema


_TYPES = {
    "long": T.LongType(),
    "int": T.IntegerType(),
    "string": T.StringType(),
    "date": T.DateType(),
    "timestamp": T.TimestampType(),
}


def _digits(kind: str) -> tuple[int, int]:
    precision, scale = kind.removeprefix("decimal(").removesuffix(")").split(",")
    return int(precision), int(scale)


def table_names() -> list[str]:
    return list(_DDL)


# Statuses of an order that count as settled, paid or dead.
SETTLED = ("COMPLETED", "SHIPPED", "DELIVERED")
FINISHED = ("COMPLETED", "DELIVERED")
EARNED = ("COMPLETED", "SHIPPED")
DEAD = ("CANCELLED", "PAYMENT_FAILED")


def conform(df: DataFrame, name: str, **defaults: Column) -> DataFrame:
    """Give ``df`` the column order and types of a table; absent columns take a
    default from ``defaults`` or NULL."""
    extra = {column: value for column, value in defaults.items() if column not in df.columns}
    if extra:
        df = df.withColumns(extra)
    present = set(df.columns)
    return df.selectExpr(
        *(
            f"cast({f.name if f.name in present else 'null'} as {f.dataType.simpleString()}) as {f.name}"
            for f in table_schema(name).fields
        )
    )
