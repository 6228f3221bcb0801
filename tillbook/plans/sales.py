"""Sales reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.functions.dates import days_before, month_key, shift_months
from tillbook.functions.numbers import known, money_sum, ratio, weighted
from tillbook.operators.shaping import lines_per_order, of_orders, since, top


def daily_summary(orders: DataFrame, items: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Per day: orders and buyers, and line-level revenue, average and units."""
    recent = since(orders, "order_date", days_before(as_of, days)).select(
        "order_id", "customer_id", "total_amount", F.to_date("order_date").alias("order_day")
    )
    revenue = F.sum(weighted(F.col("total_amount"), F.col("lines")))
    priced_lines = F.sum(known(F.col("total_amount"), F.col("lines")))
    return (
        recent.join(lines_per_order(items, recent), "order_id")
        .groupBy("order_day")
        .agg(
            F.count("order_id").alias("total_orders"),
            F.count_distinct("customer_id").alias("unique_customers"),
            revenue.alias("revenue"),
            ratio(revenue, priced_lines, 6).alias("avg_order_value"),
            F.sum("units").alias("total_items_sold"),
        )
        .orderBy(F.desc("order_day"))
    )


def monthly_trend(orders: DataFrame, as_of: datetime, months: int = 12) -> DataFrame:
    recent = since(orders, "order_date", shift_months(as_of, -months))
    revenue, buyers = F.sum("total_amount"), F.count_distinct("customer_id")
    return (
        recent.groupBy(month_key(F.col("order_date")).alias("month"))
        .agg(
            F.count("order_id").alias("total_orders"),
            revenue.alias("revenue"),
            ratio(revenue, F.count("total_amount"), 6).alias("avg_order_value"),
            buyers.alias("unique_customers"),
            ratio(revenue, buyers, 6).alias("revenue_per_customer"),
        )
        .orderBy(F.desc("month"))
    )


def by_category(
    items: DataFrame, products: DataFrame, orders: DataFrame, as_of: datetime, days: int = 30
) -> DataFrame:
    recent = since(orders, "order_date", days_before(as_of, days)).select("order_id")
    cost = F.sum(weighted(F.col("cost"), F.col("quantity")))
    return (
        items.join(recent, "order_id")
        .join(products.select("product_id", "category", "cost"), "product_id")
        .groupBy("category")
        .agg(
            F.count_distinct("order_id").alias("orders"),
            F.sum("quantity").alias("units_sold"),
            money_sum(F.col("subtotal")).alias("revenue"),
            ratio(F.sum("unit_price"), F.count("unit_price"), 6).alias("avg_price"),
            (F.sum("subtotal") - cost).alias("profit"),
        )
        .orderBy(F.desc_nulls_first("revenue"), F.asc_nulls_last("category"))
    )


def top_products(
    products: DataFrame, items: DataFrame, orders: DataFrame, as_of: datetime, limit: int = 20, days: int = 90
) -> DataFrame:
    """Best sellers by units, cancelled orders left out."""
    recent = since(orders, "order_date", days_before(as_of, days)).filter(F.col("status") != "CANCELLED")
    sold = (
        items.join(recent.select("order_id"), "order_id")
        .groupBy("product_id")
        .agg(
            F.count_distinct("order_id").alias("order_count"),
            F.sum("quantity").alias("total_quantity_sold"),
            money_sum(F.col("subtotal")).alias("total_revenue"),
            ratio(F.sum("unit_price"), F.count("unit_price"), 6).alias("avg_selling_price"),
        )
    )
    profit = F.col("total_revenue") - weighted(F.col("cost"), F.col("total_quantity_sold"))
    ranked = sold.join(products.select("product_id", "product_name", "category", "cost"), "product_id").select(
        "product_id",
        "product_name",
        "category",
        "order_count",
        "total_quantity_sold",
        "total_revenue",
        "avg_selling_price",
        profit.alias("profit"),
        ratio(profit, F.col("total_revenue"), 2, 100).alias("profit_margin_pct"),
    )
    return top(ranked, limit, F.desc_nulls_first("total_quantity_sold"), F.asc("product_id"))


def by_payment_method(orders: DataFrame, transactions: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Counts (order, transaction) pairs; an order without a transaction is one pair."""
    recent = since(orders, "order_date", days_before(as_of, days)).select(
        "order_id", "payment_method", "total_amount"
    )
    status = F.col("status")
    attempts = transactions.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count_if(status == "COMPLETED").alias("ok"),
        F.count_if(status == "FAILED").alias("failed"),
    )
    pairs = F.coalesce("pairs", F.lit(1))
    revenue = F.sum(weighted(F.col("total_amount"), pairs))
    ok = F.sum(F.coalesce("ok", F.lit(0)))
    return (
        recent.join(of_orders(attempts, recent), "order_id", "left")
        .groupBy("payment_method")
        .agg(
            F.sum(pairs).alias("transaction_count"),
            revenue.alias("total_revenue"),
            ratio(revenue, F.sum(known(F.col("total_amount"), pairs)), 6).alias("avg_transaction_value"),
            ok.alias("successful_transactions"),
            F.sum(F.coalesce("failed", F.lit(0))).alias("failed_transactions"),
            ratio(ok, F.sum(pairs), 2, 100).alias("success_rate"),
        )
        .orderBy(F.desc_nulls_first("total_revenue"), F.asc_nulls_last("payment_method"))
    )


def by_hour(orders: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    recent = since(orders, "order_date", days_before(as_of, days))
    return (
        recent.groupBy(F.hour("order_date").cast("long").alias("hour_of_day"))
        .agg(
            F.count("order_id").alias("order_count"),
            F.sum("total_amount").alias("revenue"),
            ratio(F.sum("total_amount"), F.count("total_amount"), 6).alias("avg_order_value"),
        )
        .orderBy("hour_of_day")
    )
