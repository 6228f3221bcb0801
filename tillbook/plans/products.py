"""Product reports.

Stock and sales hang on the product side by side, so the reports multiply each
side's sums by the other side's row count. Both sides are aggregated per
product first and the counts multiplied in, which gives the same figures
without building the product of the two.

Three of these reports name a sales window in their columns but count sales of
all time: their date test sits on the order, whose columns they never read.
The order join is left out, since it neither drops nor repeats a line.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillbook.functions.dates import days_before, month_key, shift_months
from tillbook.functions.numbers import money_sum, ratio, rounded, weighted, zero_if_null
from tillbook.operators.copurchase import pairs_bought_together
from tillbook.operators.shaping import since, top
from tillbook.schema import SETTLED


def sales_per_product(items: DataFrame, *extra: Column) -> DataFrame:
    return items.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("lines"),
        F.sum("quantity").alias("units"),
        F.sum("subtotal").alias("revenue"),
        *extra,
    )


def stock_per_product(inventory: DataFrame) -> DataFrame:
    both = F.col("quantity_available") + F.col("quantity_reserved")
    return inventory.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("places"),
        F.sum("quantity_available").alias("available"),
        F.sum("quantity_reserved").alias("reserved"),
        F.sum(both).alias("held"),
    )


def _or(column: str, value: int) -> Column:
    return F.coalesce(F.col(column), F.lit(value))


def performance(products: DataFrame, items: DataFrame, inventory: DataFrame) -> DataFrame:
    sales = sales_per_product(items, F.count_distinct("order_id").alias("order_count"))
    places, lines = _or("places", 1), _or("lines", 1)
    revenue = weighted(F.col("revenue"), places)
    cost = weighted(F.col("cost"), F.col("units") * places)
    return (
        products.filter("is_active = 1")
        .join(sales, "product_id", "left")
        .join(stock_per_product(inventory), "product_id", "left")
        .select(
            "product_id",
            "product_name",
            "category",
            F.col("price").alias("current_price"),
            (_or("units", 0) * places).alias("total_units_sold"),
            zero_if_null(revenue).alias("total_revenue"),
            zero_if_null(cost).alias("total_cost"),
            zero_if_null(revenue - cost).alias("total_profit"),
            F.coalesce(ratio(revenue - cost, revenue, 2, 100), F.lit(0)).alias("profit_margin_pct"),
            (_or("available", 0) * lines).alias("current_inventory"),
            (_or("reserved", 0) * lines).alias("reserved_inventory"),
            _or("order_count", 0).alias("order_count"),
        )
        .orderBy(F.desc("total_revenue"), F.asc("product_id"))
    )


def inventory_turnover(products: DataFrame, inventory: DataFrame, items: DataFrame) -> DataFrame:
    held = F.col("held") * _or("lines", 1)
    units = F.col("units") * F.col("places")
    rate = F.coalesce(F.try_divide(units.cast("double"), held.cast("double")), F.lit(0.0))
    return (
        products.filter("is_active = 1")
        .join(stock_per_product(inventory), "product_id")
        .join(sales_per_product(items), "product_id", "left")
        .select(
            "product_id",
            "product_name",
            "category",
            held.alias("avg_inventory"),
            F.coalesce(units, F.lit(0)).alias("units_sold_90days"),
            rounded(rate, 2).alias("turnover_rate"),
            rounded(F.try_divide(F.lit(90.0), rate), 1).alias("days_to_turnover"),
        )
        .orderBy(F.desc_nulls_last("turnover_rate"), F.asc("product_id"))
    )


def slow_moving(products: DataFrame, inventory: DataFrame, items: DataFrame) -> DataFrame:
    """Well-stocked products with fewer than ten units sold."""
    stock = stock_per_product(inventory.filter("quantity_available > 100"))
    units = F.coalesce(F.col("units") * F.col("places"), F.lit(0))
    on_hand = F.col("available") * _or("lines", 1)
    return (
        products.filter("is_active = 1")
        .join(stock, "product_id")
        .join(sales_per_product(items), "product_id", "left")
        .filter(units < 10)
        .select(
            "product_id",
            "product_name",
            "category",
            "price",
            on_hand.alias("inventory_on_hand"),
            units.alias("units_sold_60days"),
            weighted(F.col("cost"), on_hand).alias("inventory_value"),
            ratio(F.lit(60), units, 1).alias("days_per_sale"),
        )
        .orderBy(F.desc_nulls_first("inventory_value"), F.asc("product_id"))
    )


def margin_by_category(
    products: DataFrame, items: DataFrame, orders: DataFrame, as_of: datetime, days: int = 90
) -> DataFrame:
    settled = since(orders, "order_date", days_before(as_of, days)).filter(F.col("status").isin(*SETTLED))
    """Profit per category of settled orders. Lines are summed per product before they
    meet its price, and orders are counted apart from that, so that no line is expanded."""
    lines = items.select("order_id", "product_id", "quantity", "subtotal").join(settled.select("order_id"), "order_id")
    goods = products.select("product_id", "category", "cost", "price")
    sold = lines.groupBy("product_id").agg(
        F.sum("quantity").alias("units"), money_sum(F.col("subtotal")).alias("sales"), F.count(F.lit(1)).alias("lines")
    )
    revenue, cost, kinds = F.sum("sales"), F.sum(weighted(F.col("cost"), F.col("units"))), F.count(F.lit(1))
    priced = F.when(F.col("price").isNotNull(), F.col("lines"))
    totals = (
        sold.join(goods, "product_id")
        .groupBy("category")
        .agg(
            kinds.alias("product_count"),
            F.sum("units").alias("total_units_sold"),
            revenue.alias("total_revenue"),
            cost.alias("total_cost"),
            (revenue - cost).alias("total_profit"),
            ratio(revenue - cost, revenue, 2, 100).alias("profit_margin_pct"),
            ratio(F.sum(weighted(F.col("price"), F.col("lines"))), F.sum(priced), 2).alias("avg_price"),
            ratio(revenue - cost, kinds, 2).alias("profit_per_product"),
        )
    )
    held = lines.join(goods.select("product_id", "category"), "product_id").select("category", "order_id").distinct()
    counts = held.groupBy(F.col("category").alias("of")).agg(F.count(F.lit(1)).alias("order_count"))
    return (
        totals.join(counts, F.col("category").eqNullSafe(F.col("of")))
        .select("category", "product_count", "order_count", *totals.columns[2:])
        .orderBy(F.desc_nulls_first("total_profit"), F.asc_nulls_last("category"))
    )


def affinity(
    items: DataFrame,
    products: DataFrame,
    orders: DataFrame,
    as_of: datetime,
    days: int = 60,
    min_count: int = 3,
    limit: int = 50,
) -> DataFrame:
    """Pairs of product names most often in one order."""
    recent = since(orders, "order_date", days_before(as_of, days)).select("order_id")
    lines = items.select("order_id", "product_id", "subtotal").join(recent, "order_id")
    pairs = pairs_bought_together(lines, products.select("product_id", "product_name"), min_count).select(
        "product_1",
        "product_2",
        F.col("orders").alias("times_bought_together"),
        ratio(F.col("combined"), F.col("priced_pairs"), 2).alias("avg_combined_value"),
    )
    return top(
        pairs,
        limit,
        F.desc("times_bought_together"),
        F.asc_nulls_last("product_1"),
        F.asc_nulls_last("product_2"),
    )


def revenue_growth(
    products: DataFrame, items: DataFrame, orders: DataFrame, as_of: datetime, months: int = 6, limit: int = 30
) -> DataFrame:
    """Month-over-month growth per product; a month without sales breaks the chain.

    The divisor is NULL when last month's revenue is exactly 1, as the report
    defines it; a zero divisor gives NULL as well.
    """
    recent = since(orders, "order_date", shift_months(as_of, -months)).select(
        "order_id", F.to_date(F.date_trunc("month", "order_date")).alias("start")
    )
    monthly = (
        items.join(recent, "order_id").groupBy("product_id", "start").agg(money_sum(F.col("subtotal")).alias("now"))
    )
    # At most months + 1 rows per product, so the window stays small.
    by_month = Window.partitionBy("product_id").orderBy("start")
    adjacent = F.lag("start").over(by_month) == F.add_months("start", -1)
    before = F.when(adjacent, F.lag("now").over(by_month))
    growth = F.col("now") - zero_if_null(F.col("before"))
    divisor = F.nullif(F.col("before"), F.lit(1).cast("decimal(28,2)"))
    ranked = (
        monthly.withColumn("before", before)
        .filter("now > 100")
        .join(products.select("product_id", "product_name"), "product_id")
        .select(
            "product_id",
            "product_name",
            month_key(F.col("start")).alias("current_month"),
            F.col("now").alias("current_revenue"),
            F.col("before").alias("previous_revenue"),
            ratio(growth, divisor, 2, 100).alias("growth_pct"),
        )
    )
    return top(
        ranked, limit, F.desc_nulls_last("growth_pct"), F.asc("product_id"), F.asc("current_month")
    ).drop("product_id")
