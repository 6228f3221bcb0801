"""Management reports."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillbook.functions.dates import day_literal, days_before, midnight, month_start, stamp
from tillbook.functions.numbers import known, money_sum, ratio, weighted, zero_if_null
from tillbook.operators.shaping import lines_per_order, since
from tillbook.plans.products import sales_per_product
from tillbook.schema import SETTLED


def executive_dashboard(orders: DataFrame, customers: DataFrame, as_of: datetime) -> DataFrame:
    """Four figures for today, yesterday and the month to date.

    One conditional aggregate per table gives all twelve figures; ``stack``
    turns the single row into four.
    """
    yesterday = as_of - timedelta(days=1)

    def periods(column: str) -> dict[str, Column]:
        day = F.to_date(column)
        return {
            "today": day == day_literal(as_of),
            "yesterday": day == day_literal(yesterday),
            "month": F.col(column) >= stamp(month_start(as_of)),
        }

    start = min(midnight(yesterday), month_start(as_of))
    amount = F.col("total_amount")
    figures = []
    for name, inside in periods("order_date").items():
        total, count = money_sum(F.when(inside, amount)), F.count(F.when(inside, amount))
        figures += [
            F.count_if(inside).alias(f"orders_{name}"),
            F.round(total, 0).alias(f"revenue_{name}"),
            ratio(total, count, 2).alias(f"value_{name}"),
        ]
    order_figures = since(orders, "order_date", start).agg(*figures)
    customer_figures = since(customers, "created_at", start).agg(
        *(F.count_if(inside).alias(f"customers_{name}") for name, inside in periods("created_at").items())
    )
    metrics = {
        "Orders": "orders",
        "Revenue": "revenue",
        "New Customers": "customers",
        "Avg Order Value": "value",
    }
    rows = ", ".join(
        f"'{label}', " + ", ".join(f"cast({prefix}_{p} as decimal(28,2))" for p in ("today", "yesterday", "month"))
        for label, prefix in metrics.items()
    )
    new_customers = customer_figures.select(F.struct("*")).scalar()
    return (
        order_figures.withColumn("new", new_customers)
        .select("*", "new.*")
        .select(F.expr(f"stack({len(metrics)}, {rows}) as (metric, today_count, yesterday_count, month_to_date)"))
    )


def sales_report(orders: DataFrame, items: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Per day and status; order amounts count once per line, or once without lines."""
    recent = since(orders, "order_date", days_before(as_of, days)).select(
        "order_id",
        "customer_id",
        "status",
        "total_amount",
        "tax_amount",
        "shipping_cost",
        F.date_format("order_date", "yyyy-MM-dd").alias("order_date"),
    )
    lines = F.coalesce("lines", F.lit(1))

    def total(value: Column) -> Column:
        return F.sum(weighted(value, lines))

    amount, tax = F.col("total_amount"), F.col("tax_amount")
    net = amount - tax - zero_if_null(F.col("shipping_cost"))
    figures = (
        recent.join(lines_per_order(items, recent), "order_id", "left")
        .groupBy("order_date", "status")
        .agg(
            F.count("order_id").alias("order_count"),
            F.count_distinct("customer_id").alias("unique_customers"),
            F.round(total(amount), 2).alias("gross_revenue"),
            F.round(total(tax), 2).alias("tax_collected"),
            F.round(total(F.col("shipping_cost")), 2).alias("shipping_revenue"),
            F.round(total(net), 2).alias("net_revenue"),
            ratio(total(amount), F.sum(known(amount, lines)), 2).alias("avg_order_value"),
            F.coalesce(F.sum("units"), F.lit(0)).alias("total_items_sold"),
        )
    )
    kinds = (
        items.select("order_id", "product_id")
        .join(recent.select("order_id", "order_date", "status"), "order_id")
        .groupBy("order_date", "status")
        .agg(F.count_distinct("product_id").alias("kinds"))
    )
    return (
        figures.join(kinds, ["order_date", "status"], "left")
        .withColumn("unique_products_sold", F.coalesce("kinds", F.lit(0)))
        .drop("kinds")
        .orderBy(F.desc("order_date"), F.asc("status"))
    )


def inventory_report(
    products: DataFrame, inventory: DataFrame, items: DataFrame, orders: DataFrame, as_of: datetime, days: int = 30
) -> DataFrame:
    available, reserved = F.col("quantity_available"), F.col("quantity_reserved")
    stock = inventory.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("places"),
        F.count("quantity_available").alias("counted"),
        F.sum(available).alias("available"),
        F.sum(reserved).alias("reserved"),
        F.sum(available + reserved).alias("held"),
        F.count_if(available < F.col("reorder_level")).alias("low"),
        F.count_if(available == 0).alias("empty"),
    )
    recent = since(orders, "order_date", days_before(as_of, days)).select("order_id")
    sold = sales_per_product(items.join(recent, "order_id")).select("product_id", "units")
    return (
        products.filter("is_active = 1")
        .select("product_id", "category", "subcategory", "cost", "price")
        .join(stock, "product_id")
        .join(sold, "product_id", "left")
        .groupBy("category", "subcategory")
        .agg(
            F.count("product_id").alias("product_count"),
            F.sum("available").alias("total_available"),
            F.sum("reserved").alias("total_reserved"),
            F.sum("held").alias("total_inventory"),
            F.sum(weighted(F.col("cost"), F.col("held"))).alias("inventory_value_cost"),
            F.sum(weighted(F.col("price"), F.col("held"))).alias("inventory_value_retail"),
            ratio(F.sum("available"), F.sum("counted"), 0).alias("avg_available_per_product"),
            F.sum("low").alias("products_below_reorder"),
            F.sum("empty").alias("out_of_stock_count"),
            F.coalesce(F.sum(F.col("units") * F.col("places")), F.lit(0)).alias("units_sold_30days"),
        )
        .orderBy(
            F.desc_nulls_first("inventory_value_cost"), F.asc_nulls_last("category"), F.asc_nulls_last("subcategory")
        )
    )


def customer_report(customers: DataFrame, orders: DataFrame, as_of: datetime) -> DataFrame:
    stats = (
        orders.filter(F.col("status").isin(*SETTLED))
        .groupBy("customer_id")
        .agg(
            F.count("order_id").alias("order_count"),
            money_sum(F.col("total_amount")).alias("order_value"),
            ratio(F.sum("total_amount"), F.count("total_amount"), 8).alias("avg_value"),
            F.max("order_date").alias("last_order"),
        )
    )
    last = F.col("last_order")

    def mean(column: str) -> Column:
        return F.coalesce(ratio(F.sum(column), F.count(column), 2), F.lit(0))

    return (
        customers.select("customer_id", "customer_type", "loyalty_points")
        .join(stats, "customer_id", "left")
        .groupBy("customer_type")
        .agg(
            F.count("customer_id").alias("customer_count"),
            ratio(F.sum("loyalty_points"), F.count("loyalty_points"), 0).alias("avg_loyalty_points"),
            F.coalesce(F.sum("order_count"), F.lit(0)).alias("total_orders"),
            zero_if_null(F.sum("order_value")).alias("total_revenue"),
            mean("order_count").alias("avg_orders_per_customer"),
            mean("order_value").alias("avg_revenue_per_customer"),
            mean("avg_value").alias("avg_order_value"),
            F.count_if(last >= stamp(days_before(as_of, 30))).alias("active_last_30_days"),
            F.count_if(last >= stamp(days_before(as_of, 90))).alias("active_last_90_days"),
            F.count_if((last < stamp(days_before(as_of, 90))) | last.isNull()).alias("inactive"),
        )
        .orderBy(F.desc("total_revenue"), F.asc_nulls_last("customer_type"))
    )


def transaction_report(transactions: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Per gateway, type and status, with each row's share of its gateway."""
    of_gateway = Window.partitionBy("payment_gateway")
    amount = F.col("amount")
    return (
        since(transactions, "processed_at", days_before(as_of, days))
        .groupBy("payment_gateway", "transaction_type", "status")
        .agg(
            F.count("transaction_id").alias("transaction_count"),
            F.sum(amount).alias("total_amount"),
            ratio(F.sum(amount), F.count(amount), 6).alias("avg_amount"),
            F.min(amount).alias("min_amount"),
            F.max(amount).alias("max_amount"),
        )
        .withColumn(
            "pct_of_gateway_total",
            ratio(F.col("transaction_count"), F.sum("transaction_count").over(of_gateway), 2, 100),
        )
        .orderBy(
            F.asc_nulls_last("payment_gateway"),
            F.desc_nulls_first("total_amount"),
            F.asc_nulls_last("transaction_type"),
            F.asc_nulls_last("status"),
        )
    )
