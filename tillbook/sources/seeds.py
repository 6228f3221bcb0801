"""Generated starting rows: one customer, product or stock row per number ``i``."""

from __future__ import annotations

from datetime import datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook.functions.dates import stamp
from tillbook.schema import conform, table_names, table_schema

# Default row counts, price and cost of product 0 and their steps.
CUSTOMERS, PRODUCTS = 1000, 500
PRICE, PRICE_STEP = Decimal("19.99"), Decimal("1.50")
COST, COST_STEP = Decimal("10.00"), Decimal("0.75")

OPERATIONAL = [
    "customers", "products", "inventory", "orders", "order_items", "transactions", "audit_log", "session_data",
]


def numbers(spark: SparkSession, count: int) -> DataFrame:
    return spark.range(1, count + 1).withColumnRenamed("id", "i")


def _label(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(prefix), value.cast("string"))


def _line(base: Decimal, step: Decimal, i: Column) -> Column:
    return i.cast("decimal(12,0)") * F.lit(step) + F.lit(base)


def seed_customers(keys: DataFrame, as_of: datetime) -> DataFrame:
    i = F.col("i")
    rows = keys.select(
        i.alias("customer_id"),
        _label("FirstName", i).alias("first_name"),
        _label("LastName", i).alias("last_name"),
        F.concat(_label("customer", i), F.lit("@example.com")).alias("email"),
        F.concat(F.lit("555-"), F.lpad(i.cast("string"), 7, "0")).alias("phone"),
        _label("City", i % 50).alias("city"),
        _label("State", i % 50).alias("state"),
        F.lit("USA").alias("country"),
        F.when(i % 10 == 0, "PREMIUM").otherwise("REGULAR").alias("customer_type"),
        ((i * 100) % 10000).alias("loyalty_points"),
    )
    return conform(rows, "customers", created_at=stamp(as_of), updated_at=stamp(as_of))


def seed_products(keys: DataFrame, as_of: datetime) -> DataFrame:
    i = F.col("i")
    rows = keys.select(
        i.alias("product_id"),
        _label("Product ", i).alias("product_name"),
        _label("Category", i % 10).alias("category"),
        _label("SubCat", i % 20).alias("subcategory"),
        _line(PRICE, PRICE_STEP, i).alias("price"),
        _line(COST, COST_STEP, i).alias("cost"),
        F.concat(F.lit("SKU-"), F.lpad(i.cast("string"), 8, "0")).alias("sku"),
    )
    return conform(rows, "products", created_at=stamp(as_of), is_active=F.lit(1))


def seed_inventory(keys: DataFrame, as_of: datetime) -> DataFrame:
    i = F.col("i")
    rows = keys.select(
        i.alias("inventory_id"),
        i.alias("product_id"),
        _label("WH-", i % 5).alias("warehouse_location"),
        (1000 + (i * 137) % 5000).alias("quantity_available"),
        F.lit(100).alias("reorder_level"),
    )
    return conform(rows, "inventory", quantity_reserved=F.lit(0), updated_at=stamp(as_of))


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    if name not in table_names():
        raise KeyError(name)
    return spark.createDataFrame([], table_schema(name))


def truncate_and_reseed(
    spark: SparkSession, as_of: datetime, customers: int = CUSTOMERS, products: int = PRODUCTS
) -> dict[str, DataFrame]:
    """Next version of all operational tables: three seeded, the others empty."""
    tables = {name: empty_table(spark, name) for name in OPERATIONAL}
    product_numbers = numbers(spark, products)
    tables["customers"] = seed_customers(numbers(spark, customers), as_of)
    tables["products"] = seed_products(product_numbers, as_of)
    tables["inventory"] = seed_inventory(product_numbers, as_of)
    return tables
