"""Write jobs: next versions, repeated runs, untouched rows."""

from datetime import date, datetime
from decimal import Decimal

import pytest

from conftest import only, rows
from tillbook.plans.upkeep import accounts, ordering, payments, purging, stock, summaries
from test_reports import _customer, _item, _order, _payment, _product, _stock

AS_OF = datetime(2001, 7, 31, 12)


def _by(df, key, *columns):
    return {r[key]: tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in rows(df)}


def _summary(day, **more):
    return {"summary_id": 5, "summary_date": day, "total_orders": 1, "total_revenue": "1.00", "total_customers": 7,
            "avg_order_value": "1.00", "created_at": "2001-01-01 00:00:00", **more}


def test_merge_overwrites_inserts_and_keeps(table):
    summary = table("sales_summary", [_summary("2001-07-30"), _summary("2001-06-01", summary_id=9)])
    orders = table(
        "orders",
        [_order(1, 1), _order(2, 2, total=None), _order(3, 2, at="2001-07-29 01:00:00"), _order(4, status="PENDING"), _order(5, at="2001-07-23 23:59:59")],
    )
    merged = summaries.merge_sales_summary(summary, orders, AS_OF)
    got = _by(merged, "summary_date", "total_orders", "total_revenue", "total_customers", "avg_order_value", "created_at")
    assert got == {
        date(2001, 7, 30): (2, 100, 2, 100, AS_OF),
        date(2001, 7, 29): (1, 100, 1, 100, AS_OF),
        date(2001, 6, 1): (1, 1, 7, 1, datetime(2001, 1, 1)),
    }
    ids = [r["summary_id"] for r in rows(merged)]
    assert len(set(ids)) == 3 and min(ids) == 5
    again = summaries.merge_sales_summary(merged, orders, AS_OF)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, merged.collect()))


def test_trend_row_keeps_customers_and_creation_time(table):
    orders = table("orders", [_order(1), _order(2, total="50.00")])
    old = table("sales_summary", [_summary("2001-07-31")])
    kept = only(summaries.upsert_sales_trend(old, orders, AS_OF))
    assert (kept["total_orders"], kept["total_revenue"], kept["avg_order_value"]) == (2, 150, 75)
    assert (kept["total_customers"], kept["created_at"]) == (7, datetime(2001, 1, 1))
    fresh = only(summaries.upsert_sales_trend(table("sales_summary", []), orders, AS_OF))
    assert (fresh["total_customers"], fresh["created_at"], fresh["summary_date"]) == (0, AS_OF, date(2001, 7, 31))


def test_replaced_day_without_orders_is_a_zero_row(table):
    old = table("sales_summary", [_summary("2001-07-30"), _summary("2001-07-29", summary_id=6)])
    orders = table("orders", [_order(1, at="2001-07-30 01:00:00", status="CANCELLED")])
    once = summaries.replace_daily_sales_summary(old, orders, date(2001, 7, 30), AS_OF)
    got = _by(once, "summary_date", "total_orders", "total_revenue", "total_customers", "avg_order_value")
    assert got == {date(2001, 7, 29): (1, 1, 7, 1), date(2001, 7, 30): (0, 0, 0, 0)}
    twice = summaries.replace_daily_sales_summary(once, orders, date(2001, 7, 30), AS_OF)
    assert _by(twice, "summary_date", "total_orders", "total_revenue", "total_customers", "avg_order_value") == got


def test_customer_analytics_segment_uses_raw_spend(table):
    people = table("customers", [_customer(1), _customer(2)])
    orders = table("orders", [_order(i, 1, total=None) for i in range(12)])
    got = _by(
        summaries.merge_customer_analytics(table("customer_analytics", []), people, orders, AS_OF),
        "customer_id", "total_orders", "total_spent", "customer_segment",
    )
    assert got == {1: (12, 0, "Regular"), 2: (0, 0, "New")}


def test_product_performance_keeps_other_periods(table):
    old = table(
        "product_performance",
        [
            {"performance_id": 1, "product_id": 1, "period_start": "2001-06-01", "units_sold": 5, "return_count": 2},
            {"performance_id": 2, "product_id": 1, "period_start": "2001-07-01", "units_sold": 5, "return_count": 3},
        ],
    )
    items = table("order_items", [_item(1, 1, 2, "20.00"), _item(2, 1, 1, "10.00")])
    got = summaries.merge_product_performance(old, table("products", [_product(1), _product(2)]), items, AS_OF)
    assert {(r["product_id"], r["period_start"], r["units_sold"], r["profit"], r["return_count"]) for r in rows(got)} == {
        (1, date(2001, 6, 1), 5, None, 2),
        (1, date(2001, 7, 1), 3, Decimal(18), 3),
        (2, date(2001, 7, 1), 0, Decimal(0), 0),
    }


@pytest.mark.parametrize("job", ["old", "dead", "age"])
def test_purge_takes_lines_and_payments_along(table, job):
    old = "2001-06-01 00:00:00"
    orders = table(
        "orders",
        [_order(1, at=old), _order(2, at=old, status="PENDING"), _order(3), _order(4, status="CANCELLED"), _order(5, at=None)],
    )
    items = table("order_items", [_item(o, p) for o in (1, 2, 3, 4, 5) for p in (1, 2)])
    paid = table("transactions", [_payment(o, o) for o in (1, 2, 3, 4)])
    run = {
        "old": lambda o, i, t: purging.old_orders(o, i, t, AS_OF),
        "dead": purging.dead_orders,
        "age": lambda o, i, t: purging.orders_by_age(o, i, t, AS_OF),
    }[job]
    gone = {"old": {1}, "dead": {4}, "age": {1, 2}}[job]
    purge = run(orders, items, paid)
    assert only(purge.counts) == {"orders_deleted": len(gone), "items_deleted": 2 * len(gone), "transactions_deleted": len(gone)}
    kept = {1, 2, 3, 4, 5} - gone
    assert {r["order_id"] for r in rows(purge.orders)} == kept
    assert {r["order_id"] for r in rows(purge.items)} == kept
    assert {r["order_id"] for r in rows(purge.transactions)} == kept - {5}
    again = run(purge.orders, purge.items, purge.transactions)
    assert only(again.counts) == {"orders_deleted": 0, "items_deleted": 0, "transactions_deleted": 0}


def test_audit_purge_keeps_unknown_dates(table):
    audit = table("audit_log", [{"audit_id": 1, "changed_at": "2001-07-01 11:59:59"}, {"audit_id": 2, "changed_at": "2001-07-01 12:00:00"}, {"audit_id": 3}])
    assert {r["audit_id"] for r in rows(purging.audit_log(audit, AS_OF))} == {2, 3}
    assert only(purging.audit_log_count(audit, AS_OF)) == {"logs_deleted": 1}


def test_restocking(table, spark):
    shelf = table("inventory", [_stock(1, 1, 99), _stock(2, 1, 100), _stock(3, 2, 50, 0), _stock(4, 2, 40, 0), _stock(5, 3, 50, 0), _stock(6, 3, 50, 0)])
    low = _by(stock.restock_low(shelf, AS_OF, 500), "inventory_id", "quantity_available")
    assert low == {1: 599, 2: 100, 3: 550, 4: 540, 5: 550, 6: 550}
    assert only(stock.restock_low_count(shelf)) == {"items_restocked": 5}
    auto = _by(stock.auto_restock(shelf, AS_OF, 300), "inventory_id", "quantity_available", "last_restock_date")
    assert {i for i, (_, at) in auto.items() if at == AS_OF} == {3, 4}
    requests = spark.createDataFrame([(1, 5), (1, 6), (9, 1)], "product_id long, quantity long")
    assert _by(stock.restock(shelf, requests, AS_OF), "inventory_id", "quantity_available")[1] == 110


def test_reserving_and_releasing(table, spark):
    shelf = table("inventory", [_stock(1, 1, 9, 5), _stock(2, 1, 9, 1), _stock(3, 2, 9, None), _stock(4, 3, 9, 4)])
    items = table("order_items", [_item(1, 1, 2), _item(1, 1, 1, item_id=8), _item(2, 2, 4), _item(3, 3, 4)])
    keys = spark.createDataFrame([(1,), (2,), (2,)], "order_id long")
    assert _by(stock.reserve(shelf, items, keys, AS_OF), "inventory_id", "quantity_reserved") == {1: 8, 2: 4, 3: None, 4: 4}
    assert _by(stock.release(shelf, items, keys, AS_OF), "inventory_id", "quantity_reserved") == {1: 2, 2: 0, 3: None, 4: 4}


def test_adjusting_clamps_and_bulk_does_not(table, spark):
    shelf = table("inventory", [_stock(1, 1, 9), _stock(2, 2, 9), _stock(3, 3, 9)])
    requests = spark.createDataFrame([(1, -20), (1, 5), (2, 3)], "product_id long, adjustment long")
    assert _by(stock.adjust(shelf, requests, AS_OF), "inventory_id", "quantity_available") == {1: 0, 2: 12, 3: 9}
    assert _by(stock.bulk_adjust(shelf, requests, AS_OF), "inventory_id", "quantity_available") == {1: -6, 2: 12, 3: 9}


def test_relocating(table, spark):
    shelf = table("inventory", [_stock(1, 1), _stock(2, 2)])
    moves = spark.createDataFrame([(2, "WH-4")], "product_id long, warehouse_location string")
    got = _by(stock.relocate(shelf, moves, AS_OF), "inventory_id", "warehouse_location", "updated_at")
    assert got == {1: (None, None), 2: ("WH-4", AS_OF)}


@pytest.mark.parametrize(
    ("total", "points", "tier"),
    [
        ("494.99", 4999, "BRONZE"),
        ("495.00", 5000, "SILVER"),
        ("1994.99", 19999, "SILVER"),
        ("1995.00", 20000, "GOLD"),
        ("4995.00", 50000, "PLATINUM"),
        (None, 50, "BRONZE"),
    ],
)
def test_loyalty_tiers(table, total, points, tier):
    people = table("customers", [_customer(1), _customer(2)])
    orders = table("orders", [_order(1, 1, total=total), _order(2, 1, status="SHIPPED")])
    got = _by(accounts.calculate_loyalty(people, orders, AS_OF), "customer_id", "loyalty_points", "customer_type", "updated_at")
    assert got == {1: (points, tier, AS_OF), 2: (0, "BRONZE", AS_OF)}


def test_points_and_upgrades(table, spark):
    people = table("customers", [_customer(1), _customer(2, "GOLD"), _customer(3)])
    requests = spark.createDataFrame([(1, 5), (1, -2)], "customer_id long, points long")
    assert _by(accounts.add_loyalty_points(people, requests, AS_OF), "customer_id", "loyalty_points") == {1: 13, 2: 10, 3: 10}
    keys = spark.createDataFrame([(1,), (1,), (2,)], "customer_id long")
    upgraded = _by(accounts.upgrade_customers(people, keys, AS_OF), "customer_id", "customer_type", "updated_at")
    assert upgraded == {1: ("PREMIUM", AS_OF), 2: ("GOLD", None), 3: ("REGULAR", None)}


def test_repricing_rounds_to_cents(table, spark):
    goods = table("products", [_product(1, price="10.10"), _product(2, price="3.33"), _product(3)])
    requests = spark.createDataFrame([(1, Decimal("-5.00")), (2, Decimal("4.50"))], "product_id long, pct decimal(6,2)")
    got = _by(accounts.reprice_products(goods, requests), "product_id", "price")
    assert got == {1: Decimal("9.60"), 2: Decimal("3.48"), 3: Decimal("10.00")}
    gone = accounts.deactivate_products(goods, spark.createDataFrame([(3,)], "product_id long"))
    assert _by(gone, "product_id", "is_active") == {1: 1, 2: 1, 3: 0}


def _requested(spark):
    lines = [(0, 7, "PAYPAL", 1, 2), (0, 7, "PAYPAL", 1, 1), (0, 7, "PAYPAL", 99, 3), (4, 8, "CASH", 99, 1)]
    return spark.createDataFrame(
        lines, "request_id long, customer_id long, payment_method string, product_id long, quantity long"
    )


def test_created_orders_price_unknown_products(table, spark):
    frames = (table("products", [_product(1)]), table("orders", [_order(41)]), table("order_items", [_item(41)]), table("audit_log", []))
    new = ordering.create_orders(_requested(spark), *frames, AS_OF)
    assert _by(new.orders, "order_id", "customer_id", "status", "total_amount", "tax_amount") == {
        42: (7, "PENDING", Decimal("119.97"), Decimal("9.60")),
        46: (8, "PENDING", Decimal("29.99"), Decimal("2.40")),
    }
    lines = rows(new.items)
    assert len({r["order_item_id"] for r in lines}) == 4 and min(r["order_item_id"] for r in lines) > 41001
    assert sorted((r["order_id"], r["subtotal"], r["discount"]) for r in lines) == [
        (42, Decimal("10.00"), 0), (42, Decimal("20.00"), 0), (42, Decimal("89.97"), 0), (46, Decimal("29.99"), 0),
    ]
    assert {(r["record_id"], r["operation"], r["changed_by"]) for r in rows(new.audit)} == {
        (42, "INSERT", "STORED_PROC"), (46, "INSERT", "STORED_PROC"),
    }


def test_created_orders_may_skip_unknown_products(table, spark):
    frames = (table("products", [_product(1)]), table("orders", []), table("order_items", []), table("audit_log", []))
    new = ordering.create_orders(_requested(spark), *frames, AS_OF, unknown_price=None)
    assert _by(new.orders, "order_id", "total_amount", "tax_amount") == {1: (Decimal(30), Decimal("2.40")), 5: (None, None)}
    assert {r["operation"] for r in rows(new.audit)} == {"CREATE"}


def test_order_totals_and_status(table, spark):
    orders = table("orders", [_order(1), _order(2), _order(3)])
    items = table("order_items", [_item(1, 1, subtotal="10.05"), _item(1, 2, subtotal="5.00"), _item(3)])
    keys = spark.createDataFrame([(1,), (2,)], "order_id long")
    got = _by(ordering.order_totals(orders, items, keys, AS_OF), "order_id", "total_amount", "tax_amount")
    assert got == {1: (Decimal("15.05"), Decimal("1.20")), 2: (None, None), 3: (Decimal(100), None)}
    moved = ordering.update_status(orders, spark.createDataFrame([(2, "SHIPPED")], "order_id long, status string"), AS_OF)
    assert _by(moved, "order_id", "status") == {1: "COMPLETED", 2: "SHIPPED", 3: "COMPLETED"}


def test_payments(table, spark):
    orders = table("orders", [_order(1, status="PENDING"), _order(2, status="PENDING"), _order(3, status="PENDING"), _order(4)])
    paid = table("transactions", [_payment(1, 1, "PENDING"), _payment(2, 1), _payment(3, 2, "PENDING"), _payment(4, 4, "PENDING")])
    outcomes = spark.createDataFrame([(1, True), (2, False), (3, True)], "order_id long, success boolean")
    transactions, moved = payments.process_payments(paid, orders, outcomes, AS_OF)
    assert _by(transactions, "transaction_id", "status", "error_message") == {
        1: ("COMPLETED", None), 2: ("COMPLETED", None), 3: ("FAILED", payments.DECLINED), 4: ("PENDING", None),
    }
    assert _by(moved, "order_id", "status") == {1: "COMPLETED", 2: "PAYMENT_FAILED", 3: "COMPLETED", 4: "COMPLETED"}
    asked = spark.createDataFrame([(1, "PAYMENT", "Stripe"), (77, "PAYMENT", "Square")], "order_id long, transaction_type string, payment_gateway string")
    opened = rows(payments.create_transactions(asked, orders, paid, AS_OF))
    assert {(r["order_id"], r["amount"], r["status"]) for r in opened} == {(1, Decimal(100), "PENDING"), (77, None, "PENDING")}
    assert len({r["transaction_id"] for r in opened}) == 2 and min(r["transaction_id"] for r in opened) > 4
    refund = only(payments.refund_transactions(paid, spark.createDataFrame([(2,), (2,)], "transaction_id long"), AS_OF))
    assert (refund["amount"], refund["transaction_type"], refund["status"], refund["order_id"]) == (-100, "REFUND", "COMPLETED", 1)


def test_sessions(table, spark):
    now = datetime(2001, 7, 31, 12)
    live = table(
        "session_data",
        [
            {"session_id": "a", "last_activity": "2001-07-31 11:00:00", "is_active": 1},
            {"session_id": "b", "last_activity": "2001-07-31 10:59:59", "is_active": 1},
            {"session_id": "c", "last_activity": "2001-07-31 11:59:59", "is_active": 0},
            {"session_id": "d", "last_activity": None, "is_active": 1},
            {"session_id": "e", "last_activity": "2001-07-31 09:59:59", "is_active": 1},
        ],
    )
    assert _by(accounts.expire_idle_sessions(live, now), "session_id", "is_active") == {"a": 1, "b": 0, "c": 0, "d": 1, "e": 0}
    assert only(accounts.expire_idle_sessions_count(live, now)) == {"sessions_expired": 2}
    assert {r["session_id"] for r in rows(accounts.delete_expired_sessions(live, now))} == {"a", "b", "d"}
    assert only(accounts.delete_expired_sessions_count(live, now)) == {"sessions_deleted": 2}
    touches = spark.createDataFrame([("a", now), ("a", datetime(2001, 7, 1))], "session_id string, touched_at timestamp")
    assert _by(accounts.touch_sessions(live, touches), "session_id", "last_activity")["a"] == now
    assert _by(accounts.expire_sessions(live, touches), "session_id", "is_active")["a"] == 0
    logins = spark.createDataFrame([(1, 5, now), (2, 5, now)], "login_id long, customer_id long, login_time timestamp")
    first, second = (sorted(r["session_id"] for r in rows(accounts.create_sessions(logins))) for _ in range(2))
    assert first == second and len(set(first)) == 2
