"""Small shared shapes: order lines collapsed per key, top-k, bounded broadcast."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.functions.dates import stamp

# A frame cut to at most this many rows may be broadcast by hint.
BROADCAST_ROWS = 100_000


def since(df: DataFrame, column: str, start: datetime) -> DataFrame:
    """Rows on or after ``start``; no upper border."""
    return df.filter(F.col(column) >= stamp(start))


def lines_per_order(items: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    """One row per order: ``lines`` and ``units``; only of ``orders`` if given."""
    per_order = items.groupBy("order_id").agg(F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("units"))
    return per_order if orders is None else of_orders(per_order, orders)


def of_orders(per_order: DataFrame, orders: DataFrame) -> DataFrame:
    """Rows of an aggregate per order that belong to ``orders``.

    Where the keys are small enough to broadcast, Spark moves this semi join below
    the aggregate, so that other orders' rows are dropped in the scan; where they
    are not, the aggregate still goes first and collapses hot orders.
    """
    return per_order.join(orders.select("order_id"), "order_id", "left_semi")


def top(df: DataFrame, limit: int, *order: Column) -> DataFrame:
    """First ``limit`` rows, planned as a top-k on every task and a merge."""
    return df.orderBy(*order).limit(limit)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast for a frame already cut to ``rows`` rows, if that is few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def full_name() -> Column:
    blank = F.lit("")
    return F.concat(F.coalesce("first_name", blank), F.lit(" "), F.coalesce("last_name", blank))
