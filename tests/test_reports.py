"""Hand-worked cases for the reports: borders, fan-out, nulls, ties, gaps."""

import random
from collections import defaultdict
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import only, rows
from tillbook.plans import customers, lookups, procedures, products, reports, sales, warehouse
from checks.testbed import AS_OF as TESTBED_AS_OF
from checks.testbed import Testbed

AS_OF = datetime(2001, 7, 31, 12)


def _order(order_id, customer_id=1, at="2001-07-30 10:00:00", status="COMPLETED", total="100.00", **more):
    return {
        "order_id": order_id, "customer_id": customer_id, "order_date": at, "status": status,
        "total_amount": total, "payment_method": "PAYPAL", **more,
    }


def _item(order_id, product_id=1, quantity=1, subtotal="10.00", unit_price="10.00", item_id=None):
    return {
        "order_item_id": item_id or order_id * 1000 + product_id, "order_id": order_id, "product_id": product_id,
        "quantity": quantity, "unit_price": unit_price, "subtotal": subtotal,
    }


def _product(product_id, name=None, category="toys", price="10.00", cost="4.00", is_active=1, **more):
    return {
        "product_id": product_id, "product_name": name or f"p{product_id}", "category": category,
        "subcategory": "s", "price": price, "cost": cost, "is_active": is_active, **more,
    }


def _stock(inventory_id, product_id, available=200, reserved=10, reorder_level=100):
    return {
        "inventory_id": inventory_id, "product_id": product_id, "quantity_available": available,
        "quantity_reserved": reserved, "reorder_level": reorder_level,
    }


def _customer(customer_id, kind="REGULAR", created="2001-01-31 12:00:00", **more):
    return {
        "customer_id": customer_id, "first_name": f"F{customer_id}", "last_name": "L", "customer_type": kind,
        "created_at": created, "loyalty_points": 10, **more,
    }


def _payment(transaction_id, order_id, status="COMPLETED", amount="100.00", at="2001-07-30 11:00:00", gateway="Stripe"):
    return {
        "transaction_id": transaction_id, "order_id": order_id, "transaction_type": "PAYMENT", "amount": amount,
        "payment_gateway": gateway, "status": status, "processed_at": at,
    }


def test_window_includes_its_border_and_has_no_upper_end(table):
    orders = table(
        "orders",
        [
            _order(1, at="2001-07-01 12:00:00"),
            _order(2, at="2001-07-01 11:59:59"),
            _order(3, at="2001-08-02 00:00:00"),
        ],
    )
    items = table("order_items", [_item(1), _item(2), _item(3)])
    days = [str(r["order_day"]) for r in rows(sales.daily_summary(orders, items, AS_OF))]
    assert days == ["2001-08-02", "2001-07-01"]


def test_order_total_counts_once_per_line(table):
    orders = table("orders", [_order(1), _order(2, customer_id=2, total=None), _order(3, total="50.00")])
    items = table("order_items", [_item(1, 1, 2), _item(1, 2, 3), _item(2, 1, 1)])
    row = only(sales.daily_summary(orders, items, AS_OF))
    assert (row["total_orders"], row["unique_customers"], row["total_items_sold"]) == (2, 2, 6)
    assert (row["revenue"], row["avg_order_value"]) == (Decimal(200), Decimal(100))


def test_payments_are_counted_as_pairs(table):
    orders = table("orders", [_order(1), _order(2, total="40.00")])
    paid = table("transactions", [_payment(1, 1, "FAILED"), _payment(2, 1)])
    row = only(sales.by_payment_method(orders, paid, AS_OF))
    assert (row["transaction_count"], row["total_revenue"]) == (3, Decimal(240))
    assert (row["successful_transactions"], row["failed_transactions"]) == (1, 1)
    assert (row["avg_transaction_value"], row["success_rate"]) == (Decimal(80), Decimal("33.33"))


def test_top_products_break_ties_by_key_and_leave_out_cancelled(table):
    orders = table("orders", [_order(1), _order(2, status="CANCELLED")])
    items = table("order_items", [_item(1, p, 5) for p in (3, 1, 2)] + [_item(2, 9, 50)])
    got = sales.top_products(table("products", [_product(p) for p in (1, 2, 3, 9)]), items, orders, AS_OF, limit=2)
    assert [r["product_id"] for r in rows(got)] == [1, 2]


def test_customers_without_orders_are_segmented_and_bucketed(table):
    people = table("customers", [_customer(1), _customer(2), _customer(3)])
    orders = table("orders", [_order(i, 1, total="200.00") for i in range(5)] + [_order(9, 2, total=None)])
    segments = {r["customer_segment"]: r for r in rows(customers.segmentation(people, orders))}
    assert segments["Loyal"]["segment_revenue"] == 1000
    assert (segments["New"]["customer_count"], segments["New"]["segment_revenue"]) == (2, 0)
    buckets = {r["purchase_frequency_bucket"]: r for r in rows(customers.purchase_frequency(people, orders))}
    assert list(buckets) == ["5-9 orders", "1 order"]
    assert (buckets["1 order"]["customer_count"], buckets["1 order"]["avg_orders"]) == (2, Decimal("0.5"))
    assert buckets["1 order"]["avg_revenue"] is None


def test_unknown_spend_sorts_first_among_high_value(table):
    people = table("customers", [_customer(1), _customer(2)])
    orders = table("orders", [_order(1, 1), _order(2, 2, total=None), _order(3, 2, total=None, at="2001-06-01 00:00:00")])
    items = table("order_items", [_item(1), _item(2), _item(3)])
    got = rows(customers.high_value(people, orders, items, limit=1))
    assert [(r["customer_id"], r["total_spent"], r["active_months"]) for r in got] == [(2, None, 2)]


def test_lifetime_value_needs_a_settled_order_and_puts_unknown_last(table):
    people = table("customers", [_customer(1), _customer(2), _customer(3), _customer(4, created="2001-07-31 12:00:00")])
    orders = table(
        "orders",
        [_order(1, 1), _order(2, 2, total=None), _order(3, 3, status="PENDING"), _order(4, 4, total="30.00")],
    )
    got = rows(customers.lifetime_value(people, orders, AS_OF))
    assert [r["customer_id"] for r in got] == [1, 4, 2]
    assert (got[0]["customer_tenure_months"], got[0]["monthly_value"]) == (6, Decimal("16.67"))
    assert got[1]["monthly_value"] is None  # no tenure yet


def test_retention_looks_at_the_next_month_only(table):
    orders = table(
        "orders",
        [
            _order(1, 1, at="2001-03-05 00:00:00"),
            _order(2, 1, at="2001-04-05 00:00:00"),
            _order(3, 1, at="2001-04-06 00:00:00"),
            _order(4, 2, at="2001-03-09 00:00:00"),
            _order(5, 2, at="2001-05-09 00:00:00"),
        ],
    )
    got = {r["month"]: (r["customers_this_month"], r["customers_next_month"], r["retention_rate"]) for r in rows(customers.retention(orders, AS_OF))}
    assert got == {"2001-05": (1, 0, 0), "2001-04": (1, 0, 0), "2001-03": (2, 1, Decimal(50))}


def _fan_out(table):
    """A product with two stock rows and three sales, one sold long ago, one never sold."""
    catalogue = table("products", [_product(1), _product(2), _product(3), _product(4, is_active=0)])
    stock = table("inventory", [_stock(1, 1, 200, 10), _stock(2, 1, 300, 20), _stock(3, 2, 150, 0), _stock(4, 4)])
    items = table(
        "order_items",
        [_item(1, 1, 2, "20.00"), _item(2, 1, 3, "30.00"), _item(3, 1, 1, "10.00"), _item(4, 2, 4, "40.00"), _item(4, 4)],
    )
    return catalogue, stock, items


def test_stock_and_sales_multiply_each_other(table):
    catalogue, stock, items = _fan_out(table)
    got = {r["product_id"]: r for r in rows(products.performance(catalogue, items, stock))}
    assert set(got) == {1, 2, 3}
    assert (got[1]["total_units_sold"], got[1]["current_inventory"], got[1]["reserved_inventory"]) == (12, 1500, 90)
    assert (got[1]["total_revenue"], got[1]["total_cost"], got[1]["total_profit"]) == (120, 48, 72)
    assert (got[1]["order_count"], got[1]["profit_margin_pct"]) == (3, 60)
    assert (got[3]["total_units_sold"], got[3]["total_revenue"], got[3]["profit_margin_pct"]) == (0, 0, 0)


def test_collapsed_form_equals_the_plain_join(table):
    catalogue, stock, items = _fan_out(table)
    joined = (
        catalogue.filter("is_active = 1")
        .join(items, "product_id", "left")
        .join(stock, "product_id", "left")
        .groupBy("product_id")
        .agg(
            F.coalesce(F.sum("quantity"), F.lit(0)).alias("units"),
            F.coalesce(F.sum("quantity_available"), F.lit(0)).alias("available"),
        )
    )
    want = {r["product_id"]: (r["units"], r["available"]) for r in rows(joined)}
    got = rows(products.performance(catalogue, items, stock))
    assert {r["product_id"]: (r["total_units_sold"], r["current_inventory"]) for r in got} == want


def test_turnover_of_unsold_products_is_zero_and_needs_stock(table):
    catalogue, stock, items = _fan_out(table)
    got = {r["product_id"]: r for r in rows(products.inventory_turnover(catalogue, stock, items))}
    assert set(got) == {1, 2}
    assert (got[1]["avg_inventory"], got[1]["units_sold_90days"]) == (1590, 12)
    assert (got[1]["turnover_rate"], got[1]["days_to_turnover"]) == (Decimal("0.01"), Decimal("11925.0"))


def test_slow_movers_count_sales_of_all_time(table):
    catalogue, stock, items = _fan_out(table)
    got = rows(products.slow_moving(catalogue, stock, items))
    assert [(r["product_id"], r["units_sold_60days"], r["inventory_value"], r["days_per_sale"]) for r in got] == [
        (2, 4, Decimal(600), 15)
    ]


def test_affinity_merges_products_of_one_name(table):
    catalogue = table("products", [_product(1, "a"), _product(2, "b"), _product(3, "a")])
    orders = table("orders", [_order(i) for i in range(4)])
    items = table(
        "order_items",
        [_item(0, 1), _item(0, 2), _item(1, 1), _item(1, 2), _item(2, 2), _item(2, 3), _item(3, 1), _item(3, 2, subtotal="30.00")],
    )
    got = rows(products.affinity(items, catalogue, orders, AS_OF))
    assert [(r["product_1"], r["product_2"], r["times_bought_together"]) for r in got] == [("a", "b", 3)]
    assert got[0]["avg_combined_value"] == Decimal("26.67")


def test_growth_skips_no_month_and_survives_zero_and_one(table):
    catalogue = table("products", [_product(1), _product(2), _product(3)])
    months = {1: ("2001-03", "500.00"), 2: ("2001-05", "200.00"), 3: ("2001-06", "300.00"), 4: ("2001-05", "0.00"),
              5: ("2001-06", "150.00"), 6: ("2001-05", "1.00"), 7: ("2001-06", "150.00")}
    orders = table("orders", [_order(i, at=f"{m}-10 00:00:00") for i, (m, _) in months.items()])
    owner = {1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 6: 3, 7: 3}
    items = table("order_items", [_item(i, owner[i], subtotal=v) for i, (_, v) in months.items()])
    got = {(r["product_name"], r["current_month"]): r for r in rows(products.revenue_growth(catalogue, items, orders, AS_OF))}
    assert got[("p1", "2001-05")]["previous_revenue"] is None
    assert got[("p1", "2001-05")]["growth_pct"] is None
    assert got[("p1", "2001-06")]["growth_pct"] == 50
    assert got[("p2", "2001-06")]["growth_pct"] is None  # zero before
    assert got[("p3", "2001-06")]["growth_pct"] is None  # exactly one before
    assert ("p2", "2001-05") not in got


def test_dashboard_periods(table):
    orders = table(
        "orders",
        [
            _order(1, at="2001-07-31 23:00:00", total="10.40"),
            _order(2, at="2001-07-30 00:00:00", total="20.10"),
            _order(3, at="2001-07-01 00:00:00", total=None),
            _order(4, at="2001-06-30 23:59:59"),
            _order(5, at="2001-08-01 00:00:00", total="1.00"),
        ],
    )
    people = table("customers", [_customer(1, created="2001-07-30 05:00:00"), _customer(2)])
    got = {r["metric"]: (r["today_count"], r["yesterday_count"], r["month_to_date"]) for r in rows(reports.executive_dashboard(orders, people, AS_OF))}
    assert got["Orders"] == (1, 1, 4)
    assert got["Revenue"] == (10, 20, 32)
    assert got["New Customers"] == (0, 1, 1)
    assert got["Avg Order Value"] == (Decimal("10.40"), Decimal("20.10"), Decimal("10.50"))


def test_dashboard_on_the_first_of_a_month(table):
    orders = table("orders", [_order(1, at="2001-07-31 08:00:00"), _order(2, at="2001-08-01 01:00:00")])
    people = table("customers", [_customer(1)])
    got = rows(reports.executive_dashboard(orders, people, datetime(2001, 8, 1, 9)))
    assert (got[0]["today_count"], got[0]["yesterday_count"], got[0]["month_to_date"]) == (1, 1, 1)


def test_sales_report_keeps_orders_without_lines(table):
    orders = table(
        "orders",
        [_order(1, tax_amount="8.00", shipping_cost=None), _order(2, customer_id=2, total="50.00", tax_amount="4.00", shipping_cost="5.00")],
    )
    items = table("order_items", [_item(1, 1, 2), _item(1, 2, 1)])
    row = only(reports.sales_report(orders, items, AS_OF))
    assert (row["order_count"], row["unique_customers"], row["unique_products_sold"]) == (2, 2, 2)
    assert (row["gross_revenue"], row["shipping_revenue"], row["net_revenue"]) == (250, 5, Decimal(225))
    assert (row["avg_order_value"], row["total_items_sold"]) == (Decimal("83.33"), 3)


def test_inventory_report_counts_recent_units_per_stock_row(table):
    catalogue, stock, items = _fan_out(table)
    orders = table("orders", [_order(1), _order(2), _order(3, at="2001-01-01 00:00:00"), _order(4)])
    row = only(reports.inventory_report(catalogue, stock, items, orders, AS_OF))
    assert (row["product_count"], row["total_available"], row["total_inventory"]) == (2, 650, 680)
    assert (row["units_sold_30days"], row["inventory_value_cost"]) == (14, Decimal(2720))
    assert row["avg_available_per_product"] == 217


def test_customer_report_counts_the_inactive(table):
    people = table("customers", [_customer(1), _customer(2), _customer(3), _customer(4, "PREMIUM")])
    orders = table("orders", [_order(1, 1), _order(2, 2, at="2001-01-05 00:00:00"), _order(3, 3, status="PENDING")])
    got = {r["customer_type"]: r for r in rows(reports.customer_report(people, orders, AS_OF))}
    regular = got["REGULAR"]
    assert (regular["active_last_30_days"], regular["active_last_90_days"], regular["inactive"]) == (1, 1, 2)
    assert (regular["total_orders"], regular["avg_revenue_per_customer"]) == (2, 100)
    assert (got["PREMIUM"]["total_revenue"], got["PREMIUM"]["avg_order_value"]) == (0, 0)


def test_transaction_report_shares_add_up_per_gateway(table):
    paid = table(
        "transactions",
        [_payment(1, 1), _payment(2, 2), _payment(3, 3, "FAILED"), _payment(4, 4, gateway="PayPal"), _payment(5, 5, at="2001-06-01 00:00:00")],
    )
    got = {(r["payment_gateway"], r["status"]): r["pct_of_gateway_total"] for r in rows(reports.transaction_report(paid, AS_OF))}
    assert got == {("PayPal", "COMPLETED"): 100, ("Stripe", "COMPLETED"): Decimal("66.67"), ("Stripe", "FAILED"): Decimal("33.33")}


def test_newest_orders_show_zero_lines(table):
    people = table("customers", [_customer(1)])
    orders = table("orders", [_order(1), _order(2, at="2001-07-31 00:00:00"), _order(3, at="2001-07-29 00:00:00")])
    got = rows(warehouse.newest_orders(people, orders, table("order_items", [_item(1, 1), _item(1, 2)]), limit=2))
    assert [(r["order_id"], r["item_count"]) for r in got] == [(2, 0), (1, 2)]


def test_trend_of_nothing_is_one_zero_row(table):
    assert only(procedures.sales_trend(table("orders", []), AS_OF)) == {
        "total_revenue": 0, "avg_daily_revenue": 0, "order_count": 0,
    }


def test_trend_averages_over_days(table):
    orders = table("orders", [_order(1), _order(2), _order(3, at="2001-07-29 00:00:00", status="SHIPPED"), _order(4, status="DELIVERED")])
    assert only(procedures.sales_trend(orders, AS_OF)) == {
        "total_revenue": 300, "avg_daily_revenue": 150, "order_count": 3,
    }


def test_cohort(table):
    people = table("customers", [_customer(1), _customer(2), _customer(3, created="2001-07-15 00:00:00")])
    orders = table("orders", [_order(1, 1), _order(2, 2, at="2000-12-31 00:00:00"), _order(3, 8), _order(4, 9, at="2000-01-01 00:00:00")])
    assert only(procedures.customer_cohort(people, orders, AS_OF)) == {
        "active_customers": 2, "churned_customers": 1, "new_customers": 1,
    }


def test_recommendation_counts_a_repeated_product_once(table):
    items = table("order_items", [_item(1, 1), _item(1, 2), _item(1, 2, item_id=7), _item(2, 1), _item(2, 3), _item(3, 4)])
    got = {r["product_id"]: r["recommendations"] for r in rows(procedures.product_recommendation(items))}
    assert got == {1: 2, 2: 1, 3: 1, 4: 0}
    for product, partners in [*got.items(), (99, 0)]:
        assert only(procedures.product_recommendation(items, product)) == {"product_id": product, "recommendations": partners}


def test_forecast_uses_at_least_one_day(table):
    orders = table("orders", [_order(1, at="2001-07-31 11:00:00"), _order(2, at="2001-07-21 12:00:00")])
    items = table("order_items", [_item(1, 1, 10), _item(2, 2, 10)])
    stock = table("inventory", [_stock(1, 1, 139), _stock(2, 1, 140), _stock(3, 2, 13), _stock(4, 2, 14), _stock(5, 3, 0)])
    assert only(procedures.inventory_forecast(stock, items, orders, AS_OF)) == {"total_items_checked": 5, "items_at_risk": 2}


def test_reconciliation_of_nothing(table):
    assert only(procedures.revenue_reconciliation(table("orders", []), table("transactions", []), AS_OF)) == {
        "order_total": 0, "transaction_total": 0, "discrepancy": 0,
    }


def test_product_details_text(table):
    got = rows(lookups.product_details(table("products", [_product(1, "Ball", price="9.90", sku="SKU-1")])))
    assert got == [{"product_id": 1, "details": "Ball (toys) - $9.90 [SKU-1]"}]


@pytest.mark.parametrize("limit", [1, 40, 700])
def test_detail_equals_plain_windows(spark, limit):
    """Totals and ranks by counting equal window functions over the whole join."""
    t = Testbed(spark, "/root/testdata/sf0.001")
    frames = (t.customers(), t.orders(), t.order_items(True), t.products(), t.inventory(), t.transactions())
    got = warehouse.customer_data(*frames, TESTBED_AS_OF, limit=limit)
    people, orders, items, catalogue, stock, paid = frames
    recent = orders.filter("order_date >= timestamp'1999-07-31 12:00:00'").withColumnRenamed("status", "order_status")
    joined = (
        people.select("customer_id", "state")
        .join(recent, "customer_id")
        .join(items, "order_id")
        .join(catalogue.select("product_id", "category", "manufacturer"), "product_id")
        .join(stock.select("product_id", "inventory_id"), "product_id", "left")
        .join(paid.select("order_id", "transaction_id"), "order_id", "left")
    )
    nulls_last = (F.asc_nulls_last("inventory_id"), F.asc_nulls_last("transaction_id"))
    ranked = joined.select(
        "order_item_id",
        "inventory_id",
        "transaction_id",
        F.count("*").over(Window.partitionBy("customer_id")).alias("customer_total_orders"),
        F.sum("quantity").over(Window.partitionBy("manufacturer")).alias("manufacturer_units_sold"),
        F.rank().over(Window.partitionBy("customer_id").orderBy(F.desc("order_date"))).alias("customer_order_rank"),
        F.rank().over(Window.partitionBy("category").orderBy(F.desc("subtotal"))).alias("category_revenue_rank"),
        F.dense_rank().over(Window.orderBy(F.desc_nulls_first("total_amount"))).alias("overall_order_value_rank"),
        F.row_number()
        .over(Window.partitionBy("state").orderBy(F.desc("order_date"), "order_id", "order_item_id", *nulls_last))
        .alias("state_order_sequence"),
        F.row_number()
        .over(Window.orderBy("customer_id", F.desc("order_date"), F.desc("subtotal"), "order_id", "order_item_id", *nulls_last))
        .alias("n"),
    ).filter(F.col("n") <= limit).drop("n")
    want = sorted(map(tuple, ranked.collect()), key=repr)
    assert sorted(map(tuple, got.select(*ranked.columns).collect()), key=repr) == want


def test_retention_over_more_months_than_a_word_holds(spark):
    """Buyers by month over twelve years, against sets of months."""
    rng, as_of = random.Random(4), datetime(2001, 7, 31, 12)
    seen = {(rng.randint(1, 25), rng.randrange(150)) for _ in range(1200)}
    moments = [(c, datetime(1989 + (m + 7) // 12, (m + 7) % 12 + 1, rng.randint(2, 27), 13)) for c, m in seen]
    orders = spark.createDataFrame([(i, c, at) for i, (c, at) in enumerate(moments * 2)], "order_id long, customer_id long, order_date timestamp")
    got = {r["month"]: (r["customers_this_month"], r["customers_next_month"]) for r in rows(customers.retention(orders, as_of, 144))}
    held = defaultdict(set)
    for c, at in moments:
        held[at.year * 12 + at.month - 1].add(c)
    border = 1989 * 12 + 6
    want = {f"{m // 12}-{m % 12 + 1:02d}": (len(some), len(some & held.get(m + 1, set()))) for m, some in held.items() if m >= border}
    assert got == want and len(got) > 140


def test_cohort_of_unregistered_and_unknown_customers(spark, table):
    orders = table("orders", [_order(1, 1, "2001-07-01"), _order(2, 2, "1999-07-01"), _order(3, 9, "1999-07-01"), _order(4, 8, "2001-07-01")])
    buyers = table("customers", [{"customer_id": c, "created_at": at} for c, at in ((1, "2001-07-20"), (2, "1999-01-01"), (3, "2001-07-30"))])
    found = only(procedures.customer_cohort(buyers, orders, datetime(2001, 7, 31, 12)))
    assert found == {"active_customers": 2, "churned_customers": 1, "new_customers": 2}
