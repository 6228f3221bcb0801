"""Figures the stored procedures return, as one-row frames."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.functions.dates import days_before, days_since, midnight, shift_months, stamp
from tillbook.functions.numbers import money_sum, ratio, zero_if_null
from tillbook.operators.copurchase import partners_per_product
from tillbook.operators.shaping import since
from tillbook.schema import EARNED


def sales_trend(orders: DataFrame, as_of: datetime, days_back: int = 30) -> DataFrame:
    """Total and mean daily revenue and order count of completed and shipped orders."""
    daily = (
        since(orders, "order_date", days_before(midnight(as_of), days_back))
        .filter(F.col("status").isin(*EARNED))
        .groupBy(F.to_date("order_date").alias("day"))
        .agg(F.sum("total_amount").alias("total"), F.count(F.lit(1)).alias("orders"))
    )
    return daily.agg(
        zero_if_null(F.sum("total")).alias("total_revenue"),
        F.coalesce(ratio(F.sum("total"), F.count("total"), 6), F.lit(0)).alias("avg_daily_revenue"),
        F.coalesce(F.sum("orders"), F.lit(0)).alias("order_count"),
    )


def customer_cohort(customers: DataFrame, orders: DataFrame, as_of: datetime, months_back: int = 6) -> DataFrame:
    """Active, churned and new customers.

    Whether a customer bought at all and bought lately both follow from the latest order.
    Orders and customers are brought together by one aggregate per customer, collapsed on
    the map side, which stands in for both existence tests and for a join.
    """
    cutoff = stamp(shift_months(midnight(as_of), -months_back))
    joined = stamp(shift_months(midnight(as_of), -1))
    placed = orders.select("customer_id", F.col("order_date").alias("latest"), F.lit(1).alias("bought"))
    registered = customers.select("customer_id", F.lit(1).alias("registered"), (F.col("created_at") >= joined).cast("int").alias("new"))
    known = (
        placed.unionByName(registered, allowMissingColumns=True)
        .groupBy("customer_id")
        .agg(*(F.max(c).alias(c) for c in ("latest", "bought", "registered")), F.sum("new").alias("new"))
    )
    active = F.coalesce(F.col("latest") >= cutoff, F.lit(False))
    churned = ~active & F.col("bought").isNotNull() & F.col("registered").isNotNull() & F.col("customer_id").isNotNull()
    return known.agg(
        F.count_if(active).alias("active_customers"),
        F.count_if(churned).alias("churned_customers"),
        F.coalesce(F.sum("new"), F.lit(0)).alias("new_customers"),
    )


def product_recommendation(items: DataFrame, product_id: int | None = None) -> DataFrame:
    """Number of distinct products bought together with each product.

    For a single product only the orders that contain it are paired, and a
    product never sold yields 0.
    """
    if product_id is None:
        return partners_per_product(items)
    own = items.filter(F.col("product_id") == product_id).select("order_id").distinct()
    return (
        items.filter(F.col("product_id") != product_id)
        .join(own, "order_id", "left_semi")
        .agg(F.count_distinct("product_id").alias("recommendations"))
        .select(F.lit(product_id).cast("long").alias("product_id"), "recommendations")
    )


def inventory_forecast(
    inventory: DataFrame, items: DataFrame, orders: DataFrame, as_of: datetime, days_horizon: int = 14
) -> DataFrame:
    """Stock rows checked, and those that run out within the horizon at the sales
    rate of the last 30 days."""
    recent = since(orders, "order_date", days_before(as_of, 30)).select("order_id", "order_date")
    sales = (
        items.join(recent, "order_id")
        .groupBy("product_id")
        .agg(F.sum("quantity").alias("units"), F.min("order_date").alias("first_sale"))
    )
    elapsed = F.greatest(F.lit(1.0), days_since(as_of, F.col("first_sale")))
    daily = F.coalesce(F.col("units").cast("double") / elapsed, F.lit(0.0))
    return (
        inventory.select("product_id", "quantity_available")
        .join(sales, "product_id", "left")
        .agg(
            F.count(F.lit(1)).alias("total_items_checked"),
            F.count_if(F.col("quantity_available") < daily * days_horizon).alias("items_at_risk"),
        )
    )


def revenue_reconciliation(
    orders: DataFrame, transactions: DataFrame, as_of: datetime, days_back: int = 7
) -> DataFrame:
    """Order total, completed transaction total and their difference."""
    start = days_before(midnight(as_of), days_back)
    earned = since(orders, "order_date", start).filter(F.col("status").isin(*EARNED))
    settled = since(transactions, "processed_at", start).filter("status = 'COMPLETED'")
    return (
        earned.agg(zero_if_null(money_sum(F.col("total_amount"))).alias("order_total"))
        .withColumn("transaction_total", settled.agg(zero_if_null(money_sum(F.col("amount")))).scalar())
        .withColumn("discrepancy", F.col("order_total") - F.col("transaction_total"))
    )
