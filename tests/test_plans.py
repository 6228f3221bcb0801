"""Shapes of the physical plans: what is scanned, shuffled and pushed down."""

import re

import pytest

from checks.registry import LOOKUPS, REPORTS, UPKEEP
from conftest import planned
from tillbook.plans import sales
from tillbook.plans.procedures import product_recommendation
from tillbook.session import tune
from checks.testbed import AS_OF, Testbed

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plans(spark):
    """Plan of every query without broadcasts by size, as on large tables."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    t = Testbed(spark, FOLDER)
    built = {name: planned(plan(t)) for name, plan in {**REPORTS, **LOOKUPS, **UPKEEP}.items()}
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    return built


def test_no_cartesian_products(plans):
    assert [name for name, plan in plans.items() if "CartesianProduct" in plan or "NestedLoopJoin" in plan] == []


def test_only_shown_rows_and_bitmaps_of_fixed_size_are_broadcast(plans):
    """The affinity report broadcasts the bitmap of its pair buckets, whatever the input holds."""
    assert {name for name, plan in plans.items() if "BroadcastHashJoin" in plan} <= {"customer_data", "full_table_scan", "product_affinity"}
    assert plans["product_affinity"].count("BroadcastHashJoin") == 1


def _below_single_partition(plan: str) -> list[str]:
    """Operators that feed an exchange into one partition."""
    lines = plan.splitlines()
    return [lines[i + 1] for i, line in enumerate(lines[:-1]) if "SinglePartition" in line]


def test_one_partition_only_ever_gets_aggregated_rows(plans):
    feeding = {name: _below_single_partition(plan) for name, plan in plans.items()}
    bad = {n: [f for f in found if "Aggregate" not in f] for n, found in feeding.items()}
    assert {n: f for n, f in bad.items() if f} == {}


def test_top_k_is_not_a_full_sort(plans):
    for name in ("sales_top_products", "customer_high_value", "customer_lifetime_value", "product_affinity",
                 "product_revenue_growth", "complex_join", "product_search_by_category"):
        assert "TakeOrderedAndProject" in plans[name], name


def test_dashboard_reads_each_table_once(plans):
    scans = re.findall(r"FileScan parquet .*?/(\w+)\.parquet", plans["executive_dashboard"])
    assert sorted(scans) == ["customer", "orders"]


def test_scans_read_only_needed_columns(plans):
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plans["sales_by_hour"]).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"}


def test_window_borders_reach_the_scan(plans):
    for name in ("sales_daily_summary", "sales_report", "customer_retention", "complex_join", "transaction_report"):
        assert "GreaterThanOrEqual(o_orderdate" in plans[name], name


def test_line_ids_are_not_numbered_when_unused(plans):
    for name in ("sales_daily_summary", "product_performance", "complex_join", "product_affinity", "sales_report"):
        assert "row_number" not in plans[name], name


def test_detail_reads_its_lines_once_for_totals_and_once_for_ranks(plans):
    """A third scan, for the lines to show, precedes the plan; they are the only other staged table."""
    scans = re.findall(r"FileScan parquet .*?/(lines|picked)-", plans["customer_data"])
    assert scans.count("lines") == 2 and set(scans) == {"lines", "picked"}


def test_growth_and_retention_do_without_self_joins(plans):
    assert plans["customer_retention"].count("Join") == 0 and "Window" not in plans["customer_retention"]
    assert plans["product_revenue_growth"].count("Join") == 2  # orders and product names


def test_buyers_are_shuffled_once(plans):
    """One row per buyer; whatever else is shuffled has been added up per month or altogether."""
    for name in ("customer_retention", "customer_cohort"):
        keys = re.findall(r"Exchange (\w+)(?:\((\w+))?", plans[name])
        assert sum(kind == "hashpartitioning" and key == "customer_id" for kind, key in keys) == 1, name
        assert "SortMergeJoin" not in plans[name]
    assert plans["customer_cohort"].count("Exchange") == 2


def test_no_python_in_any_plan(plans):
    assert [name for name, plan in plans.items() if "Python" in plan or "ArrowEval" in plan] == []


@pytest.fixture
def small_skew(spark):
    """Thresholds that make a few thousand rows a skewed partition."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


def test_hot_order_is_split(spark, small_skew):
    """One order holds a third of all lines; its join partition is split."""
    orders = spark.range(3000).selectExpr(
        "id as order_id", "id % 50 as customer_id", "timestamp'2001-07-30 00:00:00' as order_date", "'COMPLETED' as status"
    )
    items = spark.range(0, 60000, 1, 6).selectExpr(
        "if(id % 3 = 0, 7, id % 3000) as order_id", "id % 400 as product_id", "1L as quantity",
        "cast(2 as decimal(12,2)) as subtotal", "cast(2 as decimal(10,2)) as unit_price",
    )
    products = spark.range(400).selectExpr(
        "id as product_id", "concat('p', id) as product_name", "concat('c', id % 4) as category", "cast(1 as decimal(10,2)) as cost"
    )
    df = sales.top_products(products, items, orders, AS_OF)
    result = df.collect()
    assert "skew=true" in planned(df)
    assert [r["total_quantity_sold"] for r in result] == [150] * 20


def test_partitions_put_together_stay_small(spark):
    """Of a shuffle's partitions, a task reads 16 MB together at most, a quarter of what Spark puts together."""
    assert tune(spark).conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"


@pytest.mark.parametrize("set_by_cluster, started", [("8", 200), ("300", 300)])
def test_shuffles_start_with_enough_partitions(spark, set_by_cluster, started):
    """However few partitions a cluster sets, the words of product_recommendation's bitmaps lie in so many, and never in fewer than it sets."""
    initial = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = {key: spark.conf.get(key, None) for key in ("spark.sql.shuffle.partitions", initial)}
    spark.conf.unset(initial)
    spark.conf.set("spark.sql.shuffle.partitions", set_by_cluster)
    try:
        items = tune(spark).range(3_000).selectExpr("id div 3 as order_id", "id % 700 as product_id")
        words = re.findall(r"Exchange hashpartitioning\(product_id#\d+L, _groupingexpression#\d+L, (\d+)\)", planned(product_recommendation(items)))
        assert words and {int(n) for n in words} == {started}
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_upsert_starts_with_as_many_partitions(spark):
    """The upsert's tasks grow no faster than those of the report it stores: every keyed shuffle starts with 200 partitions."""
    initial = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = {key: spark.conf.get(key, None) for key in ("spark.sql.shuffle.partitions", initial)}
    spark.conf.unset(initial)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        plan = planned(UPKEEP["upsert_recommendation"](Testbed(tune(spark), FOLDER)))
        dealt = re.findall(r"Exchange hashpartitioning\(.*?, (\d+)\)", plan)
        assert len(dealt) > 3 and {int(n) for n in dealt} == {200}
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
