"""Seeds, versions on disk and JDBC options."""

from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from conftest import planned, rows
from tillbook.plans import lookups
from tillbook.plans.upkeep import ordering, purging
from tillbook.schema import conform, table_names, table_schema
from tillbook.sources import jdbc, seeds
from tillbook.sources.parquet_store import PAGE_ROWS, Months, ParquetStore, Sorted

AS_OF = datetime(2001, 7, 31, 12)


def test_seed_rows(spark):
    people = rows(seeds.seed_customers(seeds.numbers(spark, 1000), AS_OF))
    assert len(people) == 1000
    tenth = people[9]
    assert (tenth["email"], tenth["phone"], tenth["customer_type"]) == ("customer10@example.com", "555-0000010", "PREMIUM")
    assert (tenth["loyalty_points"], people[149]["city"], people[99]["loyalty_points"]) == (1000, "City0", 0)
    goods = rows(seeds.seed_products(seeds.numbers(spark, 500), AS_OF))
    assert (goods[0]["price"], goods[0]["cost"], goods[0]["sku"]) == (Decimal("21.49"), Decimal("10.75"), "SKU-00000001")
    assert goods[499]["price"] == Decimal("769.99")
    shelf = rows(seeds.seed_inventory(seeds.numbers(spark, 500), AS_OF))
    assert (shelf[39]["quantity_available"], shelf[39]["warehouse_location"], shelf[39]["quantity_reserved"]) == (1480, "WH-0", 0)


def test_reseed_empties_the_rest(spark):
    tables = seeds.truncate_and_reseed(spark, AS_OF)
    assert {name: df.count() for name, df in tables.items()} == {
        "customers": 1000, "products": 500, "inventory": 500, "orders": 0, "order_items": 0,
        "transactions": 0, "audit_log": 0, "session_data": 0,
    }


def test_every_schema_builds():
    assert len(table_names()) == 12
    assert table_schema("orders")["total_amount"].dataType.simpleString() == "decimal(12,2)"


def test_versions_on_disk(spark, table, tmp_path):
    store = ParquetStore(spark, str(tmp_path))
    assert not store.exists("inventory")
    first = table("inventory", [{"inventory_id": 1, "product_id": 1, "quantity_available": 5}])
    assert store.write(first, "inventory") == 0
    # The next version may read the one it replaces.
    assert store.write(store.read("inventory").selectExpr(*[c if c != "quantity_available" else "quantity_available + 1 as quantity_available" for c in first.columns]), "inventory") == 1
    assert [r["quantity_available"] for r in rows(store.read("inventory"))] == [6]
    assert [r["quantity_available"] for r in rows(store.read("inventory", 0))] == [5]
    assert store.versions("inventory") == [0, 1]
    with pytest.raises(FileExistsError):
        store.write(first, "inventory", version=1)
    assert [r["quantity_available"] for r in rows(store.read("inventory"))] == [6]


def test_two_writers_cannot_both_win(spark, table, tmp_path):
    store = ParquetStore(spark, str(tmp_path))
    row = table("inventory", [{"inventory_id": 1, "product_id": 1, "quantity_available": 5}])

    def attempt(_):
        try:
            return store.write(row, "inventory", version=7)
        except FileExistsError:
            return None

    with ThreadPoolExecutor(4) as pool:
        assert sorted(pool.map(attempt, range(4)), key=str) == [7, None, None, None]


def _orders(table):
    return table("orders", [{"order_id": i, "status": "PENDING", "order_date": f"2001-0{1 + i % 3}-05 10:00:00"} for i in range(9)] + [{"order_id": 99}])


def test_untouched_months_are_not_written_again(spark, table, tmp_path):
    store = ParquetStore(spark, str(tmp_path))
    store.commit({"orders": Months(_orders(table), "order_date")})
    before = store._state(None)["orders"]
    requests = spark.createDataFrame([(1, "SHIPPED"), (4, "SHIPPED")], "order_id long, status string")
    store.update("orders", "order_date", requests, "order_id", lambda part: ordering.update_status(part, requests, AS_OF))
    after = store._state(None)["orders"]
    assert set(before) == set(after) == {"2001-01", "2001-02", "2001-03", "none"}
    assert {m for m in after if after[m] != before[m]} == {"2001-02"}
    assert {r["order_id"]: r["status"] for r in rows(store.read("orders"))} == {**{i: "PENDING" for i in range(9)}, 1: "SHIPPED", 4: "SHIPPED", 99: None}
    assert len(rows(store.read("orders", months=["2001-02"]))) == 3
    assert {r["status"] for r in rows(store.read("orders", 0))} == {"PENDING", None}


def test_rows_of_other_months_are_refused(spark, table, tmp_path):
    store = ParquetStore(spark, str(tmp_path))
    store.commit({"orders": Months(_orders(table), "order_date")})
    with pytest.raises(ValueError, match="untouched months"):
        store.commit({"orders": Months(_orders(table), "order_date", ["2001-01"])})
    assert store.commits() == [0]


def test_tables_change_together(spark, table, tmp_path):
    store = ParquetStore(spark, str(tmp_path))
    lines = table("order_items", [{"order_item_id": 1, "order_id": 1, "product_id": 1}])
    assert store.commit({"orders": Months(_orders(table), "order_date"), "order_items": lines}) == 0
    broken = lines.withColumn("quantity", F.raise_error(F.lit("broken")).cast("long"))
    with pytest.raises(PySparkException):
        store.commit({"orders": _orders(table).limit(1), "order_items": broken})
    assert store.commits() == [0] and store.read("orders").count() == 10


def _kept_by_month(spark, table, store):
    """200 orders over three months with two lines and a payment each."""
    orders = table("orders", [{"order_id": i, "status": "COMPLETED" if i % 100 == 7 else "PENDING", "order_date": f"2001-0{1 + i % 3}-05 10:00:00"} for i in range(200)])
    lines = table("order_items", [{"order_item_id": i, "order_id": i // 2, "product_id": 1} for i in range(400)] + [{"order_item_id": 999}])
    payments = table("transactions", [{"transaction_id": i, "order_id": i} for i in range(200)])
    store.commit({"orders": Months(orders, "order_date"), "order_items": lines, "transactions": payments})


def _rows_on_disk(spark, tmp_path) -> int:
    return sum(spark.read.parquet(str(f)).count() for f in tmp_path.rglob("*.parquet"))


def test_a_purge_by_keys_writes_the_keys_only(spark, table, tmp_path):
    store = ParquetStore(spark, str(tmp_path))
    _kept_by_month(spark, table, store)
    before, purged = _rows_on_disk(spark, tmp_path), purging.old_orders(*(store.read(n, 0) for n in ("orders", "order_items", "transactions")), AS_OF)
    assert purging.erase(store, purging.is_old(AS_OF)) == 1
    assert _rows_on_disk(spark, tmp_path) - before == 2  # 1 % of the orders
    for name, want in (("orders", purged.orders), ("order_items", purged.items), ("transactions", purged.transactions)):
        assert sorted(map(repr, store.read(name).collect())) == sorted(map(repr, want.collect()))
        assert store.versions(name) == [0, 1]
    assert store.read("orders", 0).count() == 200 and store.read("orders").count() == 198


def test_an_erased_key_may_come_back(spark, table, tmp_path):
    store = ParquetStore(spark, str(tmp_path))
    _kept_by_month(spark, table, store)
    purging.erase(store, purging.is_old(AS_OF))
    again = table("orders", [{"order_id": 7, "status": "PENDING", "order_date": "2001-02-06 10:00:00"}])
    store.commit({"orders": Months(store.read("orders", months=["2001-02"]).unionByName(again), "order_date", ["2001-02"])})
    assert store.read("orders").filter("order_id = 7").count() == 1 and store.read("orders").count() == 199
    store.erase(spark.createDataFrame([(7,), (8,), (None,)], "order_id long"), "order_id", ["orders"])
    assert store.read("orders").count() == 197 and store.read("order_items").filter("order_id is null").count() == 1


def test_folding_writes_parts_with_erased_keys_anew(spark, table, tmp_path):
    store = ParquetStore(spark, str(tmp_path))
    _kept_by_month(spark, table, store)
    store.erase(spark.createDataFrame([(1,)], "order_id long"), "order_id", ["orders", "order_items"])
    left = {name: sorted(map(repr, store.read(name).collect())) for name in ("orders", "order_items")}
    added = table("orders", [{"order_id": 300, "order_date": "2001-03-06 10:00:00"}])
    store.commit({"orders": Months(store.read("orders", months=["2001-03"]).unionByName(added), "order_date", ["2001-03"])})
    march = store._state(None)["orders"]["2001-03"]
    store.fold("orders", "order_date")
    store.fold("order_items")
    state = store._state(None)
    assert all(isinstance(part, str) for name in left for part in state[name].values()) and state["orders"]["2001-03"] == march
    assert sorted(map(repr, store.read("orders").filter("order_id < 300").collect())) == left["orders"]
    assert sorted(map(repr, store.read("order_items").collect())) == left["order_items"]
    assert "LeftAnti" not in planned(store.read("orders"))


def _scanned(df) -> int:
    """Rows that the scans of a query handed on."""
    df.collect()
    found, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif name.startswith("Scan parquet"):
            found += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


@pytest.mark.parametrize("n", [1, 10, 25])
def test_point_reads_take_pages_not_tables(spark, tmp_path, n):
    store = ParquetStore(spark, str(tmp_path))
    customers = spark.range(100_000).selectExpr("id * 7919 % 100003 as customer_id", "concat('c', id, '@example.com') as email")
    products = spark.range(50_000).selectExpr("id * 31 % 50021 as product_id", "concat('p', id) as product_name", "'toys' as category", "cast(9.5 as decimal(10,2)) as price", "concat('s', id) as sku")
    tables = {"customers": conform(customers, "customers"), "products": conform(products, "products")}
    store.commit({"customers": Sorted(tables["customers"], "customer_id"), "products": Sorted(tables["products"], "product_id")})
    for read, plain, name, key, step in (
        (lookups.emails_of, tables["customers"].select("customer_id", "email"), "customers", "customer_id", 3989),
        (lookups.details_of, lookups.product_details(tables["products"]), "products", "product_id", 1999),
    ):
        ids = [i * step for i in range(n)]
        assert sorted(map(tuple, read(store, ids).collect())) == sorted(map(tuple, plain.filter(F.col(key).isin(ids)).collect()))
        assert 0 < _scanned(read(store, ids)) <= n * PAGE_ROWS
        assert _scanned(store.read(name)) == tables[name].count()
    assert lookups.emails_of(store, []).collect() == [] and lookups.emails_of(store, [-5]).collect() == []


def test_jdbc_options():
    db = jdbc.Database("jdbc:somewhere", "some.Driver", "reader")
    plain = jdbc.read_options(db, "ORDERS")
    assert plain == {
        "url": "jdbc:somewhere", "driver": "some.Driver", "user": "reader", "dbtable": "ORDERS",
        "queryTimeout": "180", "fetchsize": "100",
    }
    split = jdbc.read_options(db, "ORDERS", jdbc.KeyRange("ORDER_ID", 1, 1001, 16))
    assert split.items() >= {"partitionColumn": "ORDER_ID", "lowerBound": "1", "upperBound": "1001", "numPartitions": "16"}.items()
    assert jdbc.write_options(db, "ORDERS")["batchsize"] == "1000"


@pytest.mark.parametrize("name", table_names())
def test_empty_tables_conform(spark, name):
    assert seeds.empty_table(spark, name).schema.fieldNames() == table_schema(name).fieldNames()
