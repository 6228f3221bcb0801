"""Stock: restocking, reserving, adjusting and moving."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.functions.dates import stamp
from tillbook.functions.numbers import at_least
from tillbook.operators.versions import one_per_key, updated, updated_where


def _per_product(requests: DataFrame, amount: str) -> DataFrame:
    return requests.groupBy("product_id").agg(F.sum(amount).alias("amount"))


def _restocked(amount: Column, as_of: datetime) -> dict[str, Column]:
    return {
        "quantity_available": F.col("quantity_available") + amount,
        "last_restock_date": stamp(as_of),
        "updated_at": stamp(as_of),
    }


def is_low() -> Column:
    return F.col("quantity_available") < F.col("reorder_level")


def restock_low(inventory: DataFrame, as_of: datetime, quantity: int = 500) -> DataFrame:
    """Add ``quantity`` to every row below its reorder level."""
    return updated_where(inventory, is_low(), _restocked(F.lit(quantity), as_of))


def restock_low_count(inventory: DataFrame) -> DataFrame:
    return inventory.agg(F.count_if(is_low()).alias("items_restocked"))


def auto_restock(inventory: DataFrame, as_of: datetime, quantity: int, threshold: int = 100) -> DataFrame:
    """Add ``quantity`` to all rows of products with less than ``threshold`` free
    units in total; an unknown total counts as none."""
    free = F.sum(F.col("quantity_available") - F.col("quantity_reserved"))
    short = (
        inventory.groupBy("product_id")
        .agg(F.coalesce(free, F.lit(0)).alias("free"))
        .filter(F.col("free") < threshold)
        .select("product_id")
    )
    return updated(inventory, short, "product_id", _restocked(F.lit(quantity), as_of))


def restock(inventory: DataFrame, requests: DataFrame, as_of: datetime) -> DataFrame:
    """Add the requested ``quantity`` per product to each of its rows."""
    changes = _per_product(requests, "quantity")
    return updated(inventory, changes, "product_id", _restocked(F.col("amount"), as_of))


def relocate(inventory: DataFrame, targets: DataFrame, as_of: datetime) -> DataFrame:
    """Move products; ``targets``: product_id, warehouse_location and, where a product
    may occur twice, request_no: the last request counts."""
    changes = one_per_key(targets, ["product_id"]).select("product_id", F.col("warehouse_location").alias("moved_to"))
    values = {"warehouse_location": F.col("moved_to"), "updated_at": stamp(as_of)}
    return updated(inventory, changes, "product_id", values)


def _ordered_units(items: DataFrame, order_keys: DataFrame) -> DataFrame:
    wanted = items.join(order_keys.select("order_id").distinct(), "order_id", "left_semi")
    return _per_product(wanted, "quantity")


def reserve(inventory: DataFrame, items: DataFrame, order_keys: DataFrame, as_of: datetime) -> DataFrame:
    """Add the units of the listed orders to the reserved stock."""
    reserved = F.col("quantity_reserved") + F.col("amount")
    values = {"quantity_reserved": reserved, "updated_at": stamp(as_of)}
    return updated(inventory, _ordered_units(items, order_keys), "product_id", values)


def release(inventory: DataFrame, items: DataFrame, order_keys: DataFrame, as_of: datetime) -> DataFrame:
    """Take the units of the listed orders off the reserved stock, not below zero."""
    reserved = at_least(0, F.col("quantity_reserved") - F.col("amount"))
    values = {"quantity_reserved": reserved, "updated_at": stamp(as_of)}
    return updated(inventory, _ordered_units(items, order_keys), "product_id", values)


def adjust(inventory: DataFrame, requests: DataFrame, as_of: datetime) -> DataFrame:
    """Add the ``adjustment`` per product, not below zero."""
    available = at_least(0, F.col("quantity_available") + F.col("amount"))
    values = {"quantity_available": available, "updated_at": stamp(as_of)}
    return updated(inventory, _per_product(requests, "adjustment"), "product_id", values)


def bulk_adjust(inventory: DataFrame, requests: DataFrame, as_of: datetime) -> DataFrame:
    """Add the ``adjustment`` per product without a floor."""
    values = {"quantity_available": F.col("quantity_available") + F.col("amount"), "updated_at": stamp(as_of)}
    return updated(inventory, _per_product(requests, "adjustment"), "product_id", values)
