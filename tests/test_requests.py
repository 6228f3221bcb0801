"""Repeated requests never multiply rows, and new ids do not depend on partitions."""

from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import dec, only, planned, rows
from tillbook.operators.versions import merged, one_per_key, with_next_ids
from tillbook.plans import products as product_plans
from tillbook.plans.upkeep import accounts, ordering, payments, stock

AS_OF = datetime(2001, 7, 31, 12)


@pytest.fixture
def shop(table):
    return {
        "orders": table("orders", [{"order_id": i, "customer_id": 1, "status": "PENDING", "total_amount": "10.00"} for i in (1, 2)]),
        "transactions": table("transactions", [{"transaction_id": i, "order_id": i, "status": "PENDING", "amount": "10.00"} for i in (1, 2)]),
        "inventory": table("inventory", [{"inventory_id": i, "product_id": i, "warehouse_location": "W0", "quantity_available": 9, "quantity_reserved": 0} for i in (1, 2)]),
        "products": table("products", [{"product_id": i, "price": "100.00", "is_active": 1} for i in (1, 2)]),
    }


CALLERS = {
    "update_status": (lambda s, r: ordering.update_status(s["orders"], r, AS_OF), "order_id long, status string", ("SHIPPED", "DELIVERED"), ("order_id", "status")),
    "payments": (lambda s, r: payments.process_payments(s["transactions"], s["orders"], r, AS_OF)[0], "order_id long, success boolean", (True, False), ("order_id", "status")),
    "payment_orders": (lambda s, r: payments.process_payments(s["transactions"], s["orders"], r, AS_OF)[1], "order_id long, success boolean", (True, False), ("order_id", "status")),
    "relocate": (lambda s, r: stock.relocate(s["inventory"], r, AS_OF), "product_id long, warehouse_location string", ("W1", "W2"), ("product_id", "warehouse_location")),
    "reprice": (lambda s, r: accounts.reprice_products(s["products"], r), "product_id long, pct int", (10, 50), ("product_id", "price")),
}
AFTER = {"update_status": "DELIVERED", "payments": "FAILED", "payment_orders": "PAYMENT_FAILED", "relocate": "W2", "reprice": dec("150.00")}


@pytest.mark.parametrize("name", CALLERS)
def test_the_last_request_counts(spark, shop, name):
    job, schema, (early, late), (key, column) = CALLERS[name]
    requests = spark.createDataFrame([(1, late, 2), (1, early, 1)], f"{schema}, request_no int")
    found = {r[key]: r[column] for r in rows(job(shop, requests))}
    assert len(rows(job(shop, requests))) == 2 and found[1] == AFTER[name] and found[2] != AFTER[name]


@pytest.mark.parametrize("name", CALLERS)
def test_requests_that_contradict_each_other_fail(spark, shop, name):
    job, schema, (early, late), _ = CALLERS[name]
    with pytest.raises(PySparkException, match="different requests for one (order|product)_id: 1"):
        job(shop, spark.createDataFrame([(1, late), (1, early)], schema)).collect()
    assert len(rows(job(shop, spark.createDataFrame([(1, late), (1, late), (None, late)], schema)))) == 2


def test_merge_rejects_repeated_keys(spark):
    target = spark.createDataFrame([(1, "a")], "k long, v string")
    twice = spark.createDataFrame([(2, "b"), (2, "c")], "k long, v string")
    with pytest.raises(PySparkException, match="different requests for one k: 2"):
        merged(target, twice, ["k"], ["v"]).collect()
    assert sorted(r["v"] for r in rows(merged(target, twice.limit(1).union(twice.limit(1)), ["k"], ["v"])))[0] == "a"


def test_only_keys(spark):
    assert len(rows(one_per_key(spark.createDataFrame([(1,), (1,)], "k long"), ["k"]))) == 1


def test_one_buyer_per_request(spark, table, shop):
    lines = spark.createDataFrame([(0, 1, "PAYPAL", 1, 1), (0, 2, "PAYPAL", 2, 1)], "request_id long, customer_id long, payment_method string, product_id long, quantity long")
    made = ordering.create_orders(lines, shop["products"], shop["orders"], table("order_items", []), table("audit_log", []), AS_OF)
    with pytest.raises(PySparkException, match="different requests for one order_id"):
        made.orders.collect()


def test_dense_ids_repeat_with_other_partitions(spark):
    old = spark.createDataFrame([(41,)], "id long")
    new = spark.createDataFrame([(i % 50, f"t{i % 7}") for i in range(300)], "a long, b string")
    found = []
    for n, buckets in ((1, 8), (5, 8), (8, 8)):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        found.append(sorted(map(tuple, with_next_ids(new.repartition(n + 2), old, "id", buckets).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert found[0] == found[1] == found[2]
    assert sorted(r[2] for r in found[0]) == list(range(42, 342))


def test_whole_order_event(spark, table, shop):
    lines = spark.createDataFrame(
        [(0, 5, "PAYPAL", 1, 2), (0, 5, "PAYPAL", 2, 1), (1, 6, "PAYPAL", 1, 3), (1, 6, "PAYPAL", 99, 1)],
        "request_id long, customer_id long, payment_method string, product_id long, quantity long",
    )
    made = ordering.place_orders(lines, shop["products"], shop["orders"], table("order_items", []), table("audit_log", []), shop["transactions"], shop["inventory"], AS_OF, F.lit("Stripe"))
    assert {(r["order_id"], r["amount"], r["status"], r["transaction_type"], r["payment_gateway"]) for r in rows(made.transactions)} == {
        (3, dec("300.00"), "PENDING", "PAYMENT", "Stripe"), (4, dec("300.00"), "PENDING", "PAYMENT", "Stripe")
    }
    assert sorted(r["transaction_id"] for r in rows(made.transactions)) == [3, 4]
    assert {r["product_id"]: r["quantity_reserved"] for r in rows(made.inventory)} == {1: 5, 2: 1}
    assert len(rows(made.items)) == 3 and len(rows(made.audit)) == 2


def test_totals_drop_other_orders_lines_first(table, shop, spark):
    items = table("order_items", [{"order_item_id": i, "order_id": i, "product_id": 1, "subtotal": "2.00"} for i in (1, 2)])
    plan = planned(ordering.order_totals(shop["orders"], items, spark.createDataFrame([(1,)], "order_id long"), AS_OF))
    assert "LeftSemi" in plan


def test_margin_expands_no_lines(table, shop):
    items = table("order_items", [{"order_item_id": 1, "order_id": 1, "product_id": 1, "quantity": 1, "subtotal": "2.00"}])
    assert "Expand" not in planned(product_plans.margin_by_category(shop["products"], items, shop["orders"], AS_OF))


def test_loyalty_reads_customers_once(table, shop):
    people = table("customers", [{"customer_id": 1, "loyalty_points": 0}])
    plan = planned(accounts.calculate_loyalty(people, shop["orders"], AS_OF))
    assert plan.count("Join") == 1
    assert only(accounts.calculate_loyalty(people, shop["orders"], AS_OF))["loyalty_points"] == 0
