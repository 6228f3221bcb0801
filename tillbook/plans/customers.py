"""Customer reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.functions.dates import day_literal, month_key, month_start, months_since, shift_months
from tillbook.functions.numbers import known, ratio, rounded, weighted, zero_if_null
from tillbook.operators.shaping import full_name, lines_per_order, since, top
from tillbook.schema import SETTLED

# Months of one word of a buyer's bitmap; its last bit is the next word's first month.
WORD_MONTHS = 62


def _per_customer(orders: DataFrame) -> DataFrame:
    return orders.groupBy("customer_id").agg(
        F.count("order_id").alias("order_count"), F.sum("total_amount").alias("spent")
    )


def segment_of(order_count: Column, spent: Column) -> Column:
    """Customer segment by orders and spend; unknown spend fails both spend tests."""
    return (
        F.when((order_count >= 10) & (spent >= 1000), "VIP")
        .when((order_count >= 5) & (spent >= 500), "Loyal")
        .when(order_count >= 2, "Regular")
        .otherwise("New")
    )


def segmentation(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Size and revenue of each segment; customers without orders are included."""
    stats = (
        customers.select("customer_id")
        .join(_per_customer(orders), "customer_id", "left")
        .select(
            F.coalesce("order_count", F.lit(0)).alias("order_count"),
            zero_if_null(F.col("spent")).alias("total_spent"),
        )
    )
    revenue = F.sum("total_spent")
    return (
        stats.groupBy(segment_of(F.col("order_count"), F.col("total_spent")).alias("customer_segment"))
        .agg(
            F.count(F.lit(1)).alias("customer_count"),
            ratio(revenue, F.count(F.lit(1)), 6).alias("avg_lifetime_value"),
            ratio(F.sum("order_count"), F.count(F.lit(1)), 6).alias("avg_order_count"),
            revenue.alias("segment_revenue"),
        )
        .orderBy(F.desc("segment_revenue"), F.asc("customer_segment"))
    )


def lifetime_value(customers: DataFrame, orders: DataFrame, as_of: datetime, limit: int = 100) -> DataFrame:
    """Top spenders over settled orders, with tenure and spend per month."""
    spent = (
        orders.filter(F.col("status").isin(*SETTLED))
        .groupBy("customer_id")
        .agg(
            F.count("order_id").alias("total_orders"),
            F.sum("total_amount").alias("lifetime_value"),
            ratio(F.sum("total_amount"), F.count("total_amount"), 6).alias("avg_order_value"),
            F.max("order_date").alias("last_order_date"),
        )
    )
    tenure = months_since(as_of, F.col("created_at"))
    ranked = customers.join(spent, "customer_id").select(
        "customer_id",
        full_name().alias("customer_name"),
        "customer_type",
        "loyalty_points",
        "total_orders",
        "lifetime_value",
        "avg_order_value",
        "last_order_date",
        rounded(tenure, 1).alias("customer_tenure_months"),
        ratio(F.col("lifetime_value"), tenure, 2).alias("monthly_value"),
    )
    return top(ranked, limit, F.desc_nulls_last("lifetime_value"), F.asc("customer_id"))


def retention(orders: DataFrame, as_of: datetime, months: int = 12) -> DataFrame:
    """Per month: buyers, and how many of them bought in the next month too.

    A buyer's months are bits of a word, or-ed on the map side, so that one row per buyer
    is shuffled; shifted by one, the word tells who came back.
    """
    first = shift_months(as_of, -months)
    recent = since(orders, "order_date", first)
    month = (F.year("order_date") - first.year) * 12 + F.month("order_date") - first.month
    # Words overlap by one month, so that the next one is always at hand.
    word = F.floor(F.col("month") / WORD_MONTHS)
    words = F.when((F.col("month") > 0) & (F.col("month") % WORD_MONTHS == 0), F.array(word, word - 1)).otherwise(F.array(word))
    bit = F.expr(f"shiftleft(1L, cast(month - word * {WORD_MONTHS} as int))")
    active = (
        recent.select("customer_id", month.alias("month"))
        .select("customer_id", "month", F.explode(words).alias("word"))
        .groupBy("customer_id", "word")
        .agg(F.bit_or(bit).alias("bits"))
    )
    held, next_held = (F.expr(f"shiftright(bits, place + {n}) & 1L").alias(name) for n, name in ((0, "held"), (1, "next_held")))
    places = active.withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(WORD_MONTHS - 1))))
    bought = places.select("customer_id", "word", "place", held, next_held).filter("held = 1")
    start = F.add_months(day_literal(month_start(first)), (F.col("word") * WORD_MONTHS + F.col("place")).cast("int"))
    buyers, returned = F.count("customer_id"), F.sum("next_held")
    return (
        bought.groupBy("word", "place")
        .agg(
            buyers.alias("customers_this_month"),
            returned.alias("customers_next_month"),
            ratio(returned, buyers, 2, 100).alias("retention_rate"),
        )
        .select(month_key(start).alias("month"), "customers_this_month", "customers_next_month", "retention_rate")
        .orderBy(F.desc("month"))
    )


def high_value(customers: DataFrame, orders: DataFrame, items: DataFrame, limit: int = 50) -> DataFrame:
    """Top spenders counted at line level; unknown spend sorts first."""
    settled = orders.filter(F.col("status").isin(*SETTLED)).select(
        "order_id", "customer_id", "order_date", "total_amount"
    )
    spent = F.sum(weighted(F.col("total_amount"), F.col("lines")))
    stats = (
        settled.join(lines_per_order(items), "order_id")
        .groupBy("customer_id")
        .agg(
            F.sum("lines").alias("order_count"),
            spent.alias("total_spent"),
            ratio(spent, F.sum(known(F.col("total_amount"), F.col("lines"))), 6).alias("avg_order_value"),
            F.max("order_date").alias("last_order_date"),
            F.count_distinct(F.date_trunc("month", "order_date")).alias("active_months"),
            F.sum("units").alias("total_items_purchased"),
        )
    )
    ranked = customers.select("customer_id", "email", "customer_type").join(stats, "customer_id")
    return top(ranked, limit, F.desc_nulls_first("total_spent"), F.asc("customer_id"))


def purchase_frequency(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Customers per order-count bucket; none at all falls into ``1 order``."""
    count = F.coalesce("order_count", F.lit(0))
    rank = F.when(count >= 20, 1).when(count >= 10, 2).when(count >= 5, 3).when(count >= 2, 4).otherwise(5)
    names = F.array(*map(F.lit, ("20+ orders", "10-19 orders", "5-9 orders", "2-4 orders", "1 order")))
    stats = (
        customers.select("customer_id")
        .join(_per_customer(orders), "customer_id", "left")
        .select(count.alias("order_count"), "spent", rank.alias("bucket"))
    )
    return (
        stats.groupBy("bucket")
        .agg(
            F.count(F.lit(1)).alias("customer_count"),
            ratio(F.sum("order_count"), F.count(F.lit(1)), 6).alias("avg_orders"),
            ratio(F.sum("spent"), F.count("spent"), 6).alias("avg_revenue"),
        )
        .orderBy("bucket")
        .select(
            F.element_at(names, F.col("bucket")).alias("purchase_frequency_bucket"),
            "customer_count",
            "avg_orders",
            "avg_revenue",
        )
    )
