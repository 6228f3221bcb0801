"""Wide joins over the operational tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillbook.functions.dates import days_before, months_since, padded_weekday, shift_months
from tillbook.functions.numbers import COUNT, known, ratio, rounded, weighted
from tillbook.operators.placing import falling, newest_first, with_slots
from tillbook.operators.shaping import bounded, full_name, lines_per_order, of_orders, since, top
from tillbook.operators.staging import staged


def newest_orders(customers: DataFrame, orders: DataFrame, items: DataFrame, limit: int = 1000) -> DataFrame:
    """Newest orders with buyer and number of lines; lines are counted only for
    the orders shown."""
    buyers = customers.select("customer_id", "first_name", "last_name", "email")
    columns = ("order_id", "customer_id", "order_date", "status", "total_amount")
    newest = (F.desc_nulls_first("order_date"), F.asc("order_id"))
    shown = top(orders.select(*columns).join(buyers, "customer_id"), limit, *newest)
    # Read twice below, and joined once.
    shown = staged(shown, "newest-orders")
    counts = (
        items.select("order_id")
        .join(bounded(shown.select("order_id"), limit), "order_id", "left_semi")
        .groupBy("order_id")
        .agg(F.count(F.lit(1)).alias("item_count"))
    )
    return (
        shown.join(counts, "order_id", "left")
        .select(*columns, "first_name", "last_name", "email", F.coalesce("item_count", F.lit(0)).alias("item_count"))
        .orderBy(*newest)
    )


def customer_activity(
    customers: DataFrame,
    orders: DataFrame,
    items: DataFrame,
    transactions: DataFrame,
    products: DataFrame,
    inventory: DataFrame,
    as_of: datetime,
    days: int = 90,
    limit: int = 100,
) -> DataFrame:
    """Top customers of the window across six tables.

    The report counts every (line, transaction, stock row) combination of an
    order. Transactions are counted per order and stock rows per product, and
    both counts are multiplied in, so the combinations are never built; grouping
    first by (customer, product) and then by (customer, category) replaces the
    distinct counts.
    """
    window = since(orders, "order_date", days_before(as_of, days)).select("order_id", "customer_id")
    paid = transactions.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("status") == "COMPLETED").alias("ok")
    )
    recent = window.join(of_orders(paid, window), "order_id", "left").select(
        "order_id",
        "customer_id",
        F.coalesce("attempts", F.lit(0)).alias("attempts"),
        F.greatest("attempts", F.lit(1)).alias("copies"),
        F.coalesce("ok", F.lit(0)).alias("ok"),
    )
    # Orders without lines still count their completed transactions.
    idle = F.sum(F.when(F.col("lines").isNull(), F.col("ok")).otherwise(0))
    per_buyer = (
        recent.join(lines_per_order(items, window), "order_id", "left")
        .groupBy("customer_id")
        .agg(F.count("order_id").alias("order_count"), F.sum("attempts").alias("transaction_count"), idle.alias("idle_ok"))
    )
    bought = (
        items.select("order_id", "product_id", "quantity", "subtotal")
        .join(recent, "order_id")
        .groupBy("customer_id", "product_id")
        .agg(
            F.sum("copies").alias("rows"),
            F.sum(F.col("quantity") * F.col("copies")).alias("units"),
            F.sum(weighted(F.col("subtotal"), F.col("copies"))).alias("spent"),
            F.sum("ok").alias("ok"),
        )
    )
    stock = inventory.groupBy("product_id").agg(
        F.count(F.lit(1)).alias("places"),
        F.count("quantity_available").alias("stocked"),
        F.sum("quantity_available").alias("available"),
    )
    offered = products.select("product_id", "category").join(stock, "product_id", "left")
    places = F.coalesce("places", F.lit(1))
    per_category = (
        bought.join(offered, "product_id", "left")
        .groupBy("customer_id", "category")
        .agg(
            F.count("product_id").alias("kinds"),
            F.sum(F.col("units") * places).alias("units"),
            F.sum(F.col("spent") * places.cast(COUNT)).cast("decimal(32,2)").alias("spent"),
            F.sum(F.col("ok") * places).alias("ok"),
            F.sum(F.col("available") * F.col("rows")).alias("available"),
            F.sum(F.col("stocked") * F.col("rows")).alias("stocked"),
        )
    )
    spending = per_category.groupBy("customer_id").agg(
        F.sum("kinds").alias("unique_products"),
        F.sum("units").alias("total_items"),
        F.sum("spent").cast("decimal(38,2)").alias("total_spent"),
        F.sum("ok").alias("line_ok"),
        F.count("category").alias("categories_purchased"),
        ratio(F.sum("available"), F.sum("stocked"), 6).alias("avg_inventory_level"),
    )
    ranked = (
        per_buyer.join(spending, "customer_id", "left")
        .join(customers.select("customer_id", full_name().alias("customer_name"), "customer_type"), "customer_id")
        .select(
            "customer_id",
            "customer_name",
            "customer_type",
            "order_count",
            F.coalesce("unique_products", F.lit(0)).alias("unique_products"),
            "total_items",
            "total_spent",
            "transaction_count",
            (F.coalesce("line_ok", F.lit(0)) + F.col("idle_ok")).alias("successful_transactions"),
            F.coalesce("categories_purchased", F.lit(0)).alias("categories_purchased"),
            "avg_inventory_level",
        )
    )
    return top(ranked, limit, F.desc_nulls_first("total_spent"), F.asc("customer_id"))


_CUSTOMER = (
    "customer_id", "customer_name", "email", "phone", "city", "state", "zip_code", "country",
    "customer_type", "loyalty_points",
)
_ORDER = (
    "order_id", "order_date", "total_amount", "order_status", "payment_method", "shipping_cost",
    "tax_amount", "tracking_number",
)
_ITEM = ("order_item_id", "quantity", "unit_price", "discount", "subtotal")
_PRODUCT = (
    "product_id", "product_name", "description", "category", "subcategory", "manufacturer", "sku",
    "current_price", "cost", "weight", "dimensions", "is_active",
)
_STOCK = ("inventory_id", "quantity_available", "quantity_reserved", "reorder_level", "warehouse_location")
_PAYMENT = (
    "transaction_id", "payment_gateway", "transaction_type", "transaction_amount",
    "transaction_status", "processed_at",
)


def customer_data(
    customers: DataFrame,
    orders: DataFrame,
    items: DataFrame,
    products: DataFrame,
    inventory: DataFrame,
    transactions: DataFrame,
    as_of: datetime,
    months: int = 24,
    limit: int = 500,
) -> DataFrame:
    """First rows of the six-table detail, with totals and ranks over all of it.

    One row per order line is staged with the number of detail rows it stands
    for (stock rows times transactions), and read three times: for the lines to
    show, for all totals and for all ranks. Totals weigh the lines by that number,
    ranks count the lines ahead of the shown ones, and only the shown lines are
    widened to full detail.
    """
    lines = staged(_weighed_lines(customers, orders, items, products, inventory, transactions, as_of, months), "lines")
    line_order = (
        F.asc("customer_id"), F.desc_nulls_first("order_date"), F.desc_nulls_first("subtotal"),
        F.asc("order_id"), F.asc("order_item_id"),
    )
    # Every line stands for at least one detail row, so the first lines suffice.
    picked = staged(_seated(top(lines, limit, *line_order)), "picked")
    detail_order = (*line_order, F.asc_nulls_last("inventory_id"), F.asc_nulls_last("transaction_id"))
    detail = _detail(bounded(picked, limit), customers, orders, products, inventory, transactions)
    seats = bounded(_seats(picked), limit)
    shown = top(detail, limit, *detail_order)
    for facts in (_totals(lines, picked, seats, limit), _ranks(lines, picked, seats, limit)):
        shown = shown.join(bounded(facts, limit), "order_item_id")
    return _derived(shown, as_of).orderBy(*detail_order).drop("created_at")


def _weighed_lines(customers, orders, items, products, inventory, transactions, as_of, months) -> DataFrame:
    placed = since(orders, "order_date", shift_months(as_of, -months)).select(
        "order_id", "customer_id", "order_date", "total_amount"
    )
    attempts = transactions.groupBy("order_id").agg(F.count(F.lit(1)).alias("attempts"))
    stocked = (
        products.select("product_id", "category", "manufacturer")
        .join(inventory.groupBy("product_id").agg(F.count(F.lit(1)).alias("places")), "product_id", "left")
    )
    copies = F.coalesce("attempts", F.lit(1)) * F.coalesce("places", F.lit(1))
    return (
        items.select(*_ITEM, "order_id", "product_id")
        .join(placed, "order_id")
        .join(of_orders(attempts, placed), "order_id", "left")
        .join(stocked, "product_id")
        .join(customers.select("customer_id", "state"), "customer_id")
        .withColumn("weight", copies)
        .drop("attempts", "places")
    )


def _detail(picked, customers, orders, products, inventory, transactions) -> DataFrame:
    """Picked lines with every column of their order, buyer, product, stock and payment."""
    line = picked.select(*_ITEM, "order_id", "product_id", "customer_id")
    stock = inventory.select("product_id", *_STOCK).join(line.select("product_id"), "product_id", "left_semi")
    payment = transactions.select(
        "order_id",
        "transaction_id",
        "payment_gateway",
        "transaction_type",
        F.col("amount").alias("transaction_amount"),
        F.col("status").alias("transaction_status"),
        "processed_at",
    ).join(line.select("order_id"), "order_id", "left_semi")
    buyer = customers.select(*(c for c in _CUSTOMER if c != "customer_name"), full_name().alias("customer_name"), "created_at")
    order = orders.withColumnRenamed("status", "order_status").select(*_ORDER)
    product = products.withColumnRenamed("price", "current_price").select(*_PRODUCT)
    return (
        line.join(order, "order_id")
        .join(buyer, "customer_id")
        .join(product, "product_id")
        .join(stock, "product_id", "left")
        .join(payment, "order_id", "left")
        .select(*_CUSTOMER, *_ORDER, *_ITEM, *_PRODUCT, *_STOCK, *_PAYMENT, "created_at")
    )


# Groups over which the report totals; in the first three, and among the order values of all
# lines, it ranks as well. A group is known by its first shown line.
_GROUPS = ("customer_id", "category", "state", "manufacturer")
_RANKED = _GROUPS[:3]


def _rank_keys() -> dict[str, Column]:
    return {
        "customer_id": -F.unix_micros("order_date"),
        "category": falling(F.col("subtotal")),
        "state": newest_first(F.col("order_date"), F.col("order_id"), F.col("order_item_id")),
        "value": falling(F.col("total_amount")),
    }


def _seated(picked: DataFrame) -> DataFrame:
    """The shown lines with the first line of each of their groups, the sorted keys of all shown
    lines of ranked groups and their own place among those; windows over shown lines only."""
    added = {}
    for name in _GROUPS:
        group = Window.partitionBy(name)
        added[f"{name}_first"] = F.min("order_item_id").over(group)
        if name in _RANKED:
            key = _rank_keys()[name]
            added[f"{name}_marks"] = F.array_sort(F.collect_set(key).over(group))
            added[f"{name}_seat"] = F.dense_rank().over(group.orderBy(key))
    return picked.withColumns(added)


def _grouped(rows: DataFrame, picked: DataFrame, names: tuple[str, ...], limit: int, *carried: str) -> DataFrame:
    """``rows`` with what is known of the groups of shown lines that they belong to."""
    for name in names:
        some = picked.filter(F.col("order_item_id") == F.col(f"{name}_first"))
        some = some.select(F.col(name).alias("of"), f"{name}_first", *(f"{name}_{c}" for c in carried))
        same = F.col(name) == F.col("of") if name == "customer_id" else F.col(name).eqNullSafe(F.col("of"))
        rows = rows.join(bounded(some, limit), same, "left").drop("of")
    return rows


def _value_marks(picked: DataFrame) -> Column:
    return picked.agg(F.array_sort(F.collect_set(_rank_keys()["value"]))).scalar()


def _seats(picked: DataFrame) -> DataFrame:
    """``order_item_id, kind, first, seat``: the groups of each shown line and its place there."""
    rows = picked.withColumn("value_first", F.lit(0).cast("long")).withColumn("manufacturer_seat", F.lit(0))
    rows = rows.withColumn("value_seat", F.array_position(_value_marks(picked), _rank_keys()["value"]).cast("int"))
    kinds = [_kind(name, F.col(f"{name}_first")).withField("seat", F.col(f"{name}_seat")) for name in (*_GROUPS, "value")]
    return rows.select("order_item_id", F.inline(F.array(*kinds)))


def _kind(name: str, first: Column) -> Column:
    return F.struct(F.lit(name).alias("kind"), first.alias("first"))


def _totals(lines: DataFrame, picked: DataFrame, seats: DataFrame, limit: int) -> DataFrame:
    """Totals of the customer, category, state and manufacturer of each shown line.

    One scan adds lines up per cell, that is category, state, manufacturer and shown
    customer, if it is one; the totals then add up cells.
    """
    weight = F.col("weight")

    def total(column: str) -> Column:
        return F.sum(weighted(F.col(column), weight))

    cells = _grouped(lines, picked, _GROUPS[:1], limit).groupBy("category", "state", "manufacturer", "customer_id_first").agg(
        F.sum(weight).alias("copies"),
        total("subtotal").alias("revenue"),
        total("unit_price").alias("prices"),
        F.sum(known(F.col("unit_price"), weight)).alias("priced"),
        total("total_amount").alias("values"),
        F.sum(known(F.col("total_amount"), weight)).alias("valued"),
        F.sum(F.col("quantity") * weight).alias("units"),
        F.max("order_date").alias("newest"),
    )
    sums = ("copies", "revenue", "prices", "priced", "values", "valued", "units")
    kinds = [_kind(name, F.col(f"{name}_first")) for name in _GROUPS]
    sorts = _grouped(cells, picked, _GROUPS[1:], limit).select(*sums, "newest", F.inline(F.array(*kinds))).filter("first is not null")
    totals = sorts.groupBy("kind", "first").agg(*(F.sum(c).alias(c) for c in sums), F.max("newest").alias("newest"))
    held = totals.join(seats, ["kind", "first"])

    def of(kind: str, value):
        return F.max(F.when(F.col("kind") == kind, value))

    return held.groupBy("order_item_id").agg(
        of("customer_id", F.col("copies")).alias("customer_total_orders"),
        of("customer_id", F.col("values")).alias("customer_lifetime_value"),
        of("customer_id", ratio(F.col("values"), F.col("valued"), 6)).alias("customer_avg_order"),
        of("customer_id", F.col("newest")).alias("customer_last_order_date"),
        of("category", F.col("copies")).alias("category_order_count"),
        of("category", F.col("revenue")).alias("category_revenue"),
        of("category", ratio(F.col("prices"), F.col("priced"), 6)).alias("category_avg_price"),
        of("state", F.col("copies")).alias("state_order_count"),
        of("state", F.col("values")).alias("state_total_revenue"),
        of("manufacturer", F.col("copies")).alias("manufacturer_order_count"),
        of("manufacturer", F.col("units")).alias("manufacturer_units_sold"),
    )


def _ranks(lines: DataFrame, picked: DataFrame, seats: DataFrame, limit: int) -> DataFrame:
    """Ranks of each shown line: one more than what lies ahead of it.

    One scan finds the place of every line among the shown ones of each of its groups, and
    adds up by place; the order values, of which each counts once, go along.
    """
    keys = _rank_keys()
    rows = lines.select(*_RANKED, "order_date", "subtotal", "order_id", "order_item_id", "total_amount", "weight")
    rows = _grouped(rows, picked, _RANKED, limit, "marks").withColumn("value_marks", _value_marks(picked))
    rows = rows.withColumns({f"{name}_key": key for name, key in keys.items()})
    rows = with_slots(rows, {f"{name}_slot": (f"{name}_marks", f"{name}_key") for name in keys}, limit)

    def place(name: str, first: Column, value: Column) -> Column:
        inside = F.col(f"{name}_slot") < F.size(f"{name}_marks")
        return F.struct(
            F.lit(name).alias("kind"), F.when(inside, first).alias("first"), F.col(f"{name}_slot").alias("slot"), value.alias("value")
        )

    once, no_value = F.lit(0).cast("long"), F.lit(None).cast(lines.schema["total_amount"].dataType)
    places = [place(name, F.col(f"{name}_first"), no_value) for name in _RANKED] + [place("value", once, F.col("total_amount"))]
    by_value = rows.select("weight", F.inline(F.array(*places))).filter("first is not null").groupBy("kind", "first", "slot", "value")
    ahead = by_value.agg(F.sum("weight").alias("weight")).groupBy("kind", "first", "slot")
    ahead = ahead.agg(F.sum(F.when(F.col("kind") == "value", F.lit(1)).otherwise(F.col("weight"))).alias("weight"))
    # Lines with as many marks behind them as a shown line's place, counted from 1, are not ahead.
    counted = seats.join(ahead, (seats["kind"] == ahead["kind"]) & (seats["first"] == ahead["first"]) & (ahead["slot"] < seats["seat"]), "left")

    def rank(kind: str):
        return F.coalesce(F.sum(F.when(seats["kind"] == kind, F.col("weight"))), F.lit(0)) + 1

    return counted.groupBy("order_item_id").agg(
        rank("customer_id").alias("customer_order_rank"),
        rank("category").alias("category_revenue_rank"),
        rank("state").alias("state_order_sequence"),
        rank("value").alias("overall_order_value_rank"),
    )


def _derived(shown: DataFrame, as_of: datetime) -> DataFrame:
    total, stock, reorder = F.col("total_amount"), F.col("quantity_available"), F.col("reorder_level")
    placed = F.col("order_date")
    profit = F.col("subtotal") - weighted(F.col("cost"), F.col("quantity"))
    # Detail rows of one line follow each other, so the position within the line
    # can be taken after the cut.
    within = Window.partitionBy("order_item_id").orderBy(
        F.asc_nulls_last("inventory_id"), F.asc_nulls_last("transaction_id")
    )
    return shown.withColumns(
        {
            "state_order_sequence": F.col("state_order_sequence") + F.row_number().over(within) - 1,
            "months_since_order": rounded(months_since(as_of, placed), 2),
            "customer_age_months": rounded(months_since(as_of, F.col("created_at")), 2),
            "order_value_category": F.when(total > 1000, "High Value")
            .when(total > 500, "Medium Value")
            .otherwise("Low Value"),
            "inventory_status": F.when(stock < reorder, "Critical")
            .when(stock < reorder * 2, "Low")
            .when(stock < reorder * 5, "Medium")
            .otherwise("High"),
            "item_profit": profit,
            "item_profit_margin": ratio(profit, F.col("subtotal"), 2, 100),
            "inventory_value_at_cost": weighted(F.col("cost"), stock),
            "inventory_value_at_retail": weighted(F.col("current_price"), stock),
            "order_year": F.year(placed).cast("long"),
            "order_month": F.month(placed).cast("long"),
            "order_day": F.dayofmonth(placed).cast("long"),
            "order_day_name": padded_weekday(placed),
            "order_time": F.date_format(placed, "HH:mm:ss"),
            "order_date_only": F.to_date(placed),
        }
    )
