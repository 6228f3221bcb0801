"""Counts and lookups. Those the service runs for one key serve many keys here."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.functions.numbers import money_sum
from tillbook.operators.shaping import top
from tillbook.sources.parquet_store import ParquetStore


def row_count(table: DataFrame, name: str) -> DataFrame:
    return table.agg(F.count(F.lit(1)).alias(name))


def order_count(orders: DataFrame) -> DataFrame:
    return row_count(orders, "order_count")


def order_max_id(orders: DataFrame) -> DataFrame:
    return orders.agg(F.coalesce(F.max("order_id"), F.lit(0)).alias("max_order_id"))


def customer_count(customers: DataFrame) -> DataFrame:
    return row_count(customers, "customer_count")


def customer_email_lookup(customers: DataFrame, wanted: DataFrame) -> DataFrame:
    """Email per wanted id, NULL for an unknown one."""
    return wanted.select("customer_id").join(customers.select("customer_id", "email"), "customer_id", "left")


def emails_of(store: ParquetStore, customer_ids: list[int]) -> DataFrame:
    """:func:`customer_email_lookup` of a few customers as a point read; unknown ids have no row."""
    return store.find("customers", "customer_id", customer_ids).select("customer_id", "email")


def details_of(store: ParquetStore, product_ids: list[int]) -> DataFrame:
    """:func:`product_details` of a few products as a point read."""
    return product_details(store.find("products", "product_id", product_ids))


def product_details(products: DataFrame) -> DataFrame:
    price = F.col("price").cast("decimal(10,2)").cast("string")
    text = F.format_string("%s (%s) - $%s [%s]", F.col("product_name"), F.col("category"), price, F.col("sku"))
    return products.select("product_id", text.alias("details"))


def product_search_by_category(products: DataFrame, category: str, limit: int = 20) -> DataFrame:
    """Active products of a category, dearest first."""
    found = products.filter((F.col("category") == category) & (F.col("is_active") == 1))
    return top(
        found.select("product_id", "product_name", "price"), limit, F.desc_nulls_first("price"), F.asc("product_id")
    )


def active_product_count(products: DataFrame) -> DataFrame:
    return row_count(products.filter("is_active = 1"), "product_count")


def active_session_count(sessions: DataFrame) -> DataFrame:
    return row_count(sessions.filter("is_active = 1"), "session_count")


def session_count_by_customer(sessions: DataFrame) -> DataFrame:
    return sessions.filter("is_active = 1").groupBy("customer_id").agg(F.count(F.lit(1)).alias("session_count"))


def customer_transaction_total(orders: DataFrame, transactions: DataFrame) -> DataFrame:
    """Sum of completed amounts per customer with a completed transaction."""
    completed = (
        transactions.filter("status = 'COMPLETED'").groupBy("order_id").agg(money_sum(F.col("amount")).alias("amount"))
    )
    return (
        orders.select("order_id", "customer_id")
        .join(completed, "order_id")
        .groupBy("customer_id")
        .agg(money_sum(F.col("amount")).alias("total"))
    )


def failed_transaction_count(transactions: DataFrame) -> DataFrame:
    return row_count(transactions.filter("status = 'FAILED'"), "failed_count")


def inventory_availability(inventory: DataFrame) -> DataFrame:
    free = F.col("quantity_available") - F.col("quantity_reserved")
    return inventory.groupBy("product_id").agg(F.sum(free).alias("available"))


def table_row_counts(**tables: DataFrame) -> DataFrame:
    counts = (
        row_count(table, "row_count").select(F.lit(name).alias("table_name"), "row_count")
        for name, table in tables.items()
    )
    return reduce(DataFrame.unionByName, counts)
