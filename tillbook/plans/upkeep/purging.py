"""Deleting old or dead orders with everything that hangs on them."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.functions.dates import days_before, stamp
from tillbook.operators.versions import count_of, without, without_where
from tillbook.schema import DEAD, FINISHED
from tillbook.sources.parquet_store import ParquetStore


@dataclass(frozen=True)
class Purge:
    """Next versions, and one row with the number of deleted rows per table."""

    orders: DataFrame
    items: DataFrame
    transactions: DataFrame
    counts: DataFrame


def _purged(orders: DataFrame, items: DataFrame, transactions: DataFrame, doomed: Column) -> Purge:
    keys = orders.filter(doomed).select("order_id")
    counts = keys.agg(F.count(F.lit(1)).alias("orders_deleted")).withColumns(
        {
            "items_deleted": count_of(items.join(keys, "order_id", "left_semi")),
            "transactions_deleted": count_of(transactions.join(keys, "order_id", "left_semi")),
        }
    )
    return Purge(
        orders=without_where(orders, doomed),
        items=without(items, keys, "order_id"),
        transactions=without(transactions, keys, "order_id"),
        counts=counts,
    )


def _older(column: str, as_of: datetime, days: int) -> Column:
    return F.col(column) < stamp(days_before(as_of, days))


def is_old(as_of: datetime, days_to_keep: int = 30) -> Column:
    """Completed and delivered orders past their keeping time."""
    return F.col("status").isin(*FINISHED) & past_keeping(as_of, days_to_keep)


def is_dead() -> Column:
    """Cancelled orders and those whose payment failed."""
    return F.col("status").isin(*DEAD)


def past_keeping(as_of: datetime, days_to_keep: int = 30) -> Column:
    """Orders past their keeping time, whatever their status."""
    return _older("order_date", as_of, days_to_keep)


def old_orders(
    orders: DataFrame, items: DataFrame, transactions: DataFrame, as_of: datetime, days_to_keep: int = 30
) -> Purge:
    return _purged(orders, items, transactions, is_old(as_of, days_to_keep))


def dead_orders(orders: DataFrame, items: DataFrame, transactions: DataFrame) -> Purge:
    return _purged(orders, items, transactions, is_dead())


def orders_by_age(
    orders: DataFrame, items: DataFrame, transactions: DataFrame, as_of: datetime, days_to_keep: int = 30
) -> Purge:
    return _purged(orders, items, transactions, past_keeping(as_of, days_to_keep))


def erase(store: ParquetStore, doomed: Column) -> int:
    """Purge the orders of a store with their lines and transactions, in one commit.

    The numbers of the doomed orders are all that is written; the three tables are
    neither written nor, but for the columns of ``doomed``, read.
    """
    keys = store.read("orders").filter(doomed).select("order_id")
    return store.erase(keys, "order_id", ["orders", "order_items", "transactions"])


def audit_log(audit: DataFrame, as_of: datetime, days_to_keep: int = 30) -> DataFrame:
    return without_where(audit, _older("changed_at", as_of, days_to_keep))


def audit_log_count(audit: DataFrame, as_of: datetime, days_to_keep: int = 30) -> DataFrame:
    return audit.agg(F.count_if(_older("changed_at", as_of, days_to_keep)).alias("logs_deleted"))
