"""Upkeep of the summary tables."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.functions.dates import day_literal, days_before, midnight, month_end, month_start, stamp
from tillbook.functions.numbers import money_sum, ratio, weighted, zero_if_null
from tillbook.operators.shaping import since
from tillbook.operators.versions import merged, next_id, without_where
from tillbook.plans.customers import segment_of
from tillbook.plans.procedures import product_recommendation, sales_trend
from tillbook.plans.products import sales_per_product
from tillbook.schema import DEAD, SETTLED

_DAY_TOTALS = ("total_orders", "total_revenue", "total_customers", "avg_order_value")


def _day_number(day: Column) -> Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long")


def _with_id(rows: DataFrame, table: DataFrame, column: str, offset: Column) -> DataFrame:
    return rows.withColumn(column, next_id(table, column, offset))


def daily_totals(orders: DataFrame) -> DataFrame:
    """Totals of settled orders per day."""
    return (
        orders.filter(F.col("status").isin(*SETTLED))
        .groupBy(F.to_date("order_date").alias("summary_date"))
        .agg(
            F.count("order_id").alias("total_orders"),
            money_sum(F.col("total_amount")).alias("total_revenue"),
            F.count_distinct("customer_id").alias("total_customers"),
            ratio(F.sum("total_amount"), F.count("total_amount"), 2).alias("avg_order_value"),
        )
    )


def merge_daily_totals(summary: DataFrame, totals: DataFrame, as_of: datetime) -> DataFrame:
    source = _with_id(totals, summary, "summary_id", _day_number(F.col("summary_date")))
    source = source.withColumn("created_at", stamp(as_of))
    return merged(summary, source, ["summary_date"], [*_DAY_TOTALS, "created_at"])


def merge_sales_summary(summary: DataFrame, orders: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """Put the settled totals of the last days into the daily summary."""
    recent = since(orders, "order_date", days_before(midnight(as_of), days))
    return merge_daily_totals(summary, daily_totals(recent), as_of)


def merge_customer_analytics(
    analytics: DataFrame, customers: DataFrame, orders: DataFrame, as_of: datetime
) -> DataFrame:
    """Put every customer's settled totals and segment into the analytics table."""
    stats = (
        orders.filter(F.col("status").isin(*SETTLED))
        .groupBy("customer_id")
        .agg(
            F.count("order_id").alias("orders"),
            money_sum(F.col("total_amount")).alias("spent"),
            ratio(F.sum("total_amount"), F.count("total_amount"), 2).alias("mean"),
            F.max("order_date").alias("last_order_date"),
        )
    )
    orders_made = F.coalesce("orders", F.lit(0))
    source = (
        customers.select("customer_id")
        .join(stats, "customer_id", "left")
        .select(
            "customer_id",
            orders_made.alias("total_orders"),
            zero_if_null(F.col("spent")).alias("total_spent"),
            zero_if_null(F.col("mean")).alias("avg_order_value"),
            "last_order_date",
            segment_of(orders_made, F.col("spent")).alias("customer_segment"),
            stamp(as_of).alias("calculated_at"),
        )
    )
    update = [c for c in source.columns if c != "customer_id"]
    source = _with_id(source, analytics, "analytics_id", F.col("customer_id"))
    return merged(analytics, source, ["customer_id"], update)


def merge_product_performance(
    performance: DataFrame, products: DataFrame, items: DataFrame, as_of: datetime
) -> DataFrame:
    """Put every active product's sales into its row for the current month.

    The figures are those of all time: the job's date and status tests sit on
    the order, whose columns it never reads.
    """
    revenue = F.col("revenue")
    profit = revenue - weighted(F.col("cost"), F.col("units"))
    source = (
        products.filter("is_active = 1")
        .select("product_id", "cost")
        .join(sales_per_product(items), "product_id", "left")
        .select(
            "product_id",
            day_literal(month_start(as_of)).alias("period_start"),
            day_literal(month_end(as_of)).alias("period_end"),
            F.coalesce("units", F.lit(0)).alias("units_sold"),
            zero_if_null(profit).alias("profit"),
            zero_if_null(revenue).alias("revenue"),
            F.lit(0).alias("return_count"),
            stamp(as_of).alias("calculated_at"),
        )
    )
    source = _with_id(source, performance, "performance_id", F.col("product_id"))
    return merged(
        performance, source, ["product_id", "period_start"], ["units_sold", "revenue", "profit", "calculated_at"]
    )


def upsert_sales_trend(summary: DataFrame, orders: DataFrame, as_of: datetime, days_back: int = 30) -> DataFrame:
    """Write the totals of the whole window to today's row; an existing row keeps
    its customer count and creation time."""
    mean = F.coalesce(ratio(F.max("total_revenue"), F.max("order_count"), 2), F.lit(0))
    # The aggregate over the single row keeps the day a column; as a literal it
    # would turn the merge into a join without a key.
    source = sales_trend(orders, as_of, days_back).agg(
        F.max(day_literal(as_of)).alias("summary_date"),
        F.max("order_count").alias("total_orders"),
        F.max("total_revenue").alias("total_revenue"),
        F.max(F.lit(0)).alias("total_customers"),
        mean.alias("avg_order_value"),
        F.max(stamp(as_of)).alias("created_at"),
    )
    source = _with_id(source, summary, "summary_id", _day_number(F.col("summary_date")))
    return merged(summary, source, ["summary_date"], ["total_orders", "total_revenue", "avg_order_value"])


def upsert_recommendation(recommendations: DataFrame, items: DataFrame, as_of: datetime) -> DataFrame:
    """Store how many products each product is bought with."""
    source = product_recommendation(items).select(
        "product_id",
        F.col("recommendations").alias("recommendation_score"),
        stamp(as_of).alias("last_analyzed"),
    )
    return merged(recommendations, source, ["product_id"], ["recommendation_score", "last_analyzed"])


def replace_daily_sales_summary(summary: DataFrame, orders: DataFrame, day: date, as_of: datetime) -> DataFrame:
    """Replace one day's row; a day without orders gets a row of zeros."""
    live = orders.filter((F.to_date("order_date") == day_literal(day)) & ~F.col("status").isin(*DEAD))
    revenue = zero_if_null(money_sum(F.col("total_amount")))
    fresh = live.agg(
        F.count(F.lit(1)).alias("total_orders"),
        revenue.alias("total_revenue"),
        F.count_distinct("customer_id").alias("total_customers"),
        F.coalesce(ratio(revenue, F.count(F.lit(1)), 2), F.lit(0)).alias("avg_order_value"),
    ).select(day_literal(day).alias("summary_date"), *_DAY_TOTALS, stamp(as_of).alias("created_at"))
    fresh = _with_id(fresh, summary, "summary_id", _day_number(F.col("summary_date")))
    types = {f.name: f.dataType for f in summary.schema.fields}
    kept = without_where(summary, F.col("summary_date") == day_literal(day))
    return kept.unionByName(fresh.select(*(F.col(c).cast(types[c]).alias(c) for c in summary.columns)))
