"""Creating, pricing and moving orders on, and the audit trail."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.functions.dates import stamp
from tillbook.functions.numbers import money_sum, share_of
from tillbook.operators.shaping import of_orders
from tillbook.operators.versions import next_id, one_per_key, updated, with_next_ids
from tillbook.plans.upkeep import payments, stock
from tillbook.schema import conform

# Tax rate, and the price of a product nobody knows.
TAX_RATE = "0.08"
UNKNOWN_PRICE = Decimal("29.99")


@dataclass(frozen=True)
class NewOrders:
    """Rows to append to orders, items, audit and transactions, and the next version
    of the stock."""

    orders: DataFrame
    items: DataFrame
    audit: DataFrame
    transactions: DataFrame | None = None
    inventory: DataFrame | None = None


def create_orders(
    requests: DataFrame,
    products: DataFrame,
    orders: DataFrame,
    items: DataFrame,
    audit: DataFrame,
    as_of: datetime,
    unknown_price: Decimal | None = UNKNOWN_PRICE,
) -> NewOrders:
    """Orders, priced lines and audit rows from requested lines.

    ``requests``: request_id (one per order, not negative), customer_id,
    payment_method, product_id, quantity. Order ids follow from the request id,
    so the three frames agree however often they are computed. A line with an
    unknown product is priced at ``unknown_price``, or left out if that is None;
    an order left without lines keeps a NULL total.
    """
    first_id = next_id(orders, "order_id", F.lit(0))
    asked = requests.withColumn("order_id", first_id + F.col("request_id"))
    prices = products.select("product_id", "price")
    if unknown_price is None:
        priced = asked.join(prices, "product_id")
    else:
        priced = asked.join(prices, "product_id", "left").withColumn(
            "price", F.coalesce("price", F.lit(unknown_price))
        )
    amount = (F.col("price") * F.col("quantity").cast("decimal(12,0)")).cast("decimal(12,2)")
    new_items = priced.select(
        "order_id", "product_id", "quantity", F.col("price").alias("unit_price"), amount.alias("subtotal")
    )
    totals = new_items.groupBy("order_id").agg(money_sum(F.col("subtotal")).alias("total_amount"))
    buyers = one_per_key(asked.select("order_id", "customer_id", "payment_method"), ["order_id"])
    heads = buyers.join(totals, "order_id", "left")
    now = stamp(as_of)
    new_orders = heads.withColumns(
        {
            "status": F.lit("PENDING"),
            "tax_amount": share_of(F.col("total_amount"), TAX_RATE),
            "order_date": now,
            "created_at": now,
            "updated_at": now,
        }
    )
    changes = heads.select(
        F.lit("ORDERS").alias("table_name"),
        F.lit("INSERT" if unknown_price is not None else "CREATE").alias("operation"),
        F.col("order_id").alias("record_id"),
        F.lit("STORED_PROC" if unknown_price is not None else "SYSTEM").alias("changed_by"),
    )
    return NewOrders(
        orders=conform(new_orders, "orders"),
        items=conform(with_next_ids(new_items, items, "order_item_id"), "order_items", discount=F.lit(0)),
        audit=audit_rows(audit, changes, as_of),
    )


def place_orders(
    requests: DataFrame,
    products: DataFrame,
    orders: DataFrame,
    items: DataFrame,
    audit: DataFrame,
    transactions: DataFrame,
    inventory: DataFrame,
    as_of: datetime,
    gateway: Column,
) -> NewOrders:
    """The service's whole order event: besides the new rows of ``create_orders``, a
    pending payment per order, by the ``gateway`` of its order id, and the stock with
    all units of the new lines reserved."""
    made = create_orders(requests, products, orders, items, audit, as_of, None)
    asked = made.orders.select("order_id", F.lit("PAYMENT").alias("transaction_type"), gateway.alias("payment_gateway"))
    paid = payments.create_transactions(asked, made.orders, transactions, as_of)
    held = stock.reserve(inventory, made.items, made.orders.select("order_id"), as_of)
    return replace(made, transactions=paid, inventory=held)


def order_totals(orders: DataFrame, items: DataFrame, keys: DataFrame, as_of: datetime) -> DataFrame:
    """Recalculate total and tax of the listed orders; NULL where there are no lines."""
    listed = keys.select("order_id").distinct()
    # Lines of other orders are dropped before they are summed.
    sums = of_orders(items, listed).groupBy("order_id").agg(money_sum(F.col("subtotal")).alias("sum"))
    changes = listed.join(sums, "order_id", "left")
    values = {
        "total_amount": F.col("sum"),
        "tax_amount": share_of(F.col("sum"), TAX_RATE),
        "updated_at": stamp(as_of),
    }
    return updated(orders, changes, "order_id", values)


def update_status(orders: DataFrame, changes: DataFrame, as_of: datetime) -> DataFrame:
    """Set the status per order; ``changes``: order_id, status and, where an order may
    occur twice, request_no: the last request counts."""
    renamed = one_per_key(changes, ["order_id"]).select("order_id", F.col("status").alias("new_status"))
    return updated(orders, renamed, "order_id", {"status": F.col("new_status"), "updated_at": stamp(as_of)})


def audit_rows(audit: DataFrame, changes: DataFrame, as_of: datetime) -> DataFrame:
    """Audit rows for changes (table_name, operation, record_id, changed_by)."""
    return conform(with_next_ids(changes, audit, "audit_id"), "audit_log", changed_at=stamp(as_of))


def append_audit_log(audit: DataFrame, changes: DataFrame, as_of: datetime) -> DataFrame:
    return audit.unionByName(audit_rows(audit, changes, as_of))


def customer_access(customer_keys: DataFrame) -> DataFrame:
    """Audit changes for customers whose record was read."""
    return customer_keys.select(
        F.lit("CUSTOMERS").alias("table_name"),
        F.lit("ACCESS").alias("operation"),
        F.col("customer_id").alias("record_id"),
        F.lit("SYSTEM").alias("changed_by"),
    )
