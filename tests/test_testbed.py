"""Sizes and totals of the mapped tables, as listed in FIXTURES.md for sf0.001."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from checks.registry import QUERIES
from conftest import only, rows
from checks.testbed import Testbed

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def t(spark):
    return Testbed(spark, FOLDER)


def test_table_sizes(t):
    sizes = [df.count() for df in (t.customers(), t.products(), t.inventory(), t.orders(), t.order_items(), t.transactions(), t.session_data())]
    assert sizes == [150, 200, 267, 1465, 5688, 1402, 397]


def test_the_cases_that_matter_occur(t):
    orders, items = t.orders(), t.order_items()
    assert t.customers().join(orders, "customer_id", "left_anti").count() == 3
    assert orders.join(items, "order_id", "left_anti").count() == 31
    assert orders.filter("total_amount is null").count() == 29
    assert orders.filter("order_date > timestamp'2001-07-31 12:00:00'").count() == 1


def test_item_ids_are_unique(t):
    assert t.order_items().groupBy("order_item_id").count().filter("count > 1").isEmpty()


def test_lines_of_recent_orders_keep_their_ids(t):
    start = t.orders().agg(F.max("order_date")).first()[0].replace(month=1)
    recent = t.order_items(since=start)
    whole = t.order_items().join(recent.select("order_item_id"), "order_item_id", "left_semi")
    assert recent.exceptAll(whole).isEmpty() and whole.count() == recent.count() > 0


@pytest.mark.parametrize(
    ("name", "check", "value"),
    [
        ("slow_moving_products", len, 4),
        ("product_affinity", len, 2),
        ("transaction_report", lambda r: (len(r), sum(x["transaction_count"] for x in r)), (10, 27)),
        ("customer_segmentation", lambda r: {x["customer_segment"]: x["customer_count"] for x in r},
         {"VIP": 79, "Loyal": 64, "Regular": 4, "New": 3}),
        ("executive_dashboard", lambda r: [(x["today_count"], x["yesterday_count"], x["month_to_date"]) for x in r if x["metric"] in ("Orders", "New Customers")],
         [(1, 1, 29), (1, 1, 31)]),
        ("restock_low_inventory_count", lambda r: r[0]["items_restocked"], 35),
        ("inventory_forecast", lambda r: r[0]["items_at_risk"], 5),
        ("purge_old_orders", lambda r: r[0]["orders_deleted"], 549),
        ("delete_cancelled_orders", lambda r: r[0]["orders_deleted"], 233),
        ("expire_idle_sessions_count", lambda r: r[0]["sessions_expired"], 355),
        ("delete_expired_sessions_count", lambda r: r[0]["sessions_deleted"], 387),
        ("sales_by_hour", lambda r: (len(r), sum(x["order_count"] for x in r)), (9, 11)),
    ],
)
def test_listed_figures(t, name, check, value):
    assert check(rows(QUERIES[name](t))) == value


def test_reconciliation_totals(t):
    row = only(QUERIES["revenue_reconciliation"](t))
    assert (row["order_total"], row["transaction_total"]) == (Decimal("1652682.03"), Decimal("1977679.36"))
