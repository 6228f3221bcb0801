"""Pair counting gives the same however orders are cut, and large orders cost no detour."""

import random
import time
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import plan_of, rows
from tillbook.operators import copurchase
from tillbook.operators.copurchase import pairs_bought_together, partners_per_product


def _lines(seed: int, orders: int = 40, products: int = 14):
    """Random lines; order 0 and 1 hold every product, some twice."""
    rng = random.Random(seed)
    lines = []
    for order in range(orders):
        picks = list(range(products)) * 2 if order < 2 else [rng.randrange(products) for _ in range(rng.randint(1, 5))]
        lines += [(order, p, None if rng.random() < 0.1 else Decimal(rng.randint(100, 9999)) / 100) for p in picks]
    return lines


def _names(products: int = 14):
    return [(p, f"name{p % 9}") for p in range(products)]  # some names belong to two products


def _expected_pairs(lines, names, min_count):
    name = dict(names)
    by_order = defaultdict(list)
    for order, product, value in lines:
        by_order[order].append((product, value))
    found, total, count = defaultdict(set), defaultdict(Decimal), defaultdict(int)
    for order, members in by_order.items():
        for p, v in members:
            for q, w in members:
                if p < q:
                    key = (name[p], name[q])
                    found[key].add(order)
                    if v is not None and w is not None:
                        total[key] += v + w
                        count[key] += 1
    return {k: (len(s), total[k], count[k]) for k, s in found.items() if len(s) >= min_count}


@pytest.mark.parametrize("piece", [1_000, 5, 2])
@pytest.mark.parametrize("min_count", [2, 3, 5])
def test_pairs_match_brute_force(spark, piece, min_count):
    lines, names = _lines(min_count), _names()
    got = pairs_bought_together(
        spark.createDataFrame(lines, "order_id long, product_id long, subtotal decimal(12,2)"),
        spark.createDataFrame(names, "product_id long, product_name string"),
        min_count,
        piece,
    )
    found = {
        (r["product_1"], r["product_2"]): (r["orders"], r["combined"] or 0, r["priced_pairs"] or 0) for r in rows(got)
    }
    assert found == _expected_pairs(lines, names, min_count)


@pytest.mark.parametrize("piece", [1_000, 4, 1])
def test_partners_match_brute_force(spark, piece):
    # Ids are far apart, and one product is always alone.
    lines = [(order, product * 9_001, value) for order, product, value in _lines(9)] + [(999, 5, None)]
    by_order = defaultdict(set)
    for order, product, _ in lines:
        by_order[order].add(product)
    partners = defaultdict(set)
    for members in by_order.values():
        for p in members:
            partners[p] |= members - {p}
    items = spark.createDataFrame([(o, p) for o, p, _ in lines], "order_id long, product_id long")
    got = {r["product_id"]: r["recommendations"] for r in rows(partners_per_product(items, piece))}
    assert got == {p: len(s) for p, s in partners.items()}
    assert got[5] == 0


def _seconds(run) -> float:
    run()
    began = time.perf_counter()
    run()
    return time.perf_counter() - began


@pytest.mark.parametrize("step", [1, 40_000])
def test_large_orders_cost_as_many_pairs_in_small_ones(spark, step):
    """Six orders of 1,500 products against 600 orders of 150: as many pairs each."""
    schema = "order_id long, product_id long, subtotal decimal(12,2)"
    amount = F.lit("1.00").cast("decimal(12,2)").alias("subtotal")
    large = spark.range(6 * 1500).select(F.expr("id div 1500").alias("order_id"), (F.expr("id % 1500") * step).alias("product_id"), amount)
    small = spark.range(600 * 150).select(F.expr("id div 150").alias("order_id"), (F.expr("(id div 150) % 10 * 150 + id % 150") * step).alias("product_id"), amount)
    names = spark.range(1500).select((F.col("id") * step).alias("product_id"), F.concat(F.lit("p"), "id").alias("product_name"))
    assert large.dtypes == spark.createDataFrame([], schema).dtypes
    for count in (lambda lines: pairs_bought_together(lines, names, 3), partners_per_product):
        spent = {name: _seconds(lambda lines=lines: count(lines).write.format("noop").mode("overwrite").save()) for name, lines in (("large", large), ("small", small))}
        assert spent["large"] <= 2 * spent["small"] + 1, spent
    assert pairs_bought_together(large, names, 3).count() == 1500 * 1499 // 2


def test_no_job_runs_while_a_plan_is_made(spark):
    lines = spark.createDataFrame([(1, 2, None)], "order_id long, product_id long, subtotal decimal(12,2)")
    broken = lines.withColumn("product_id", F.raise_error(F.lit("read")).cast("long"))
    names = spark.createDataFrame([(2, "n")], "product_id long, product_name string")
    pairs_bought_together(broken, names, 2)
    partners_per_product(broken)


def _orders(spark, seed: int, orders: int, products: int, size: int, step: int = 1):
    rng = random.Random(seed)
    lines = [(o, p * step, Decimal("1.00")) for o in range(orders) for p in rng.sample(range(products), size)]
    return spark.createDataFrame(lines, "order_id long, product_id long, subtotal decimal(12,2)").repartition(4)


@pytest.mark.parametrize("buckets", [1 << 20, 1 << 10, 64, 1])
def test_counts_do_not_depend_on_the_buckets(spark, buckets):
    lines, names = _lines(4), _names()
    got = pairs_bought_together(
        spark.createDataFrame(lines, "order_id long, product_id long, subtotal decimal(12,2)"),
        spark.createDataFrame(names, "product_id long, product_name string"), 4, 5, buckets,
    )
    found = {(r["product_1"], r["product_2"]): (r["orders"], r["combined"] or 0, r["priced_pairs"] or 0) for r in rows(got)}
    assert found == _expected_pairs(lines, names, 4) and found


def test_rare_pairs_are_not_shuffled(spark):
    """Of some 60,000 pairs, nearly all of them in one order, those of two names in many orders are left."""
    rare = _orders(spark, 1, 1_000, 50_000, 11)
    often = spark.range(50).selectExpr("10000 + id as order_id", "explode(array(3L, 8L)) as product_id", "cast(1 as decimal(12,2)) as subtotal")
    lines = rare.unionByName(often)
    names = lines.select("product_id").distinct().withColumn("product_name", F.concat(F.lit("p"), "product_id"))
    pairs = copurchase._pairs(copurchase._units(copurchase._baskets(lines, names), 256))
    made, kept = pairs.count(), copurchase.frequent_pairs(pairs, 3).count()
    assert made >= 55_000 and 50 <= kept <= 0.01 * made


def test_units_are_shuffled_once_for_both_passes(spark):
    lines = _orders(spark, 2, 200, 40, 4)
    names = lines.select("product_id").distinct().withColumn("product_name", F.concat(F.lit("p"), "product_id"))
    assert "ReusedExchange" in plan_of(pairs_bought_together(lines, names, 3))


@pytest.mark.parametrize("step", [1, 1_000_003])
def test_partners_are_words_of_bitmaps(spark, step):
    """Whatever the raw ids and however often pairs recur, a product has one row per range of numbers."""
    items = _orders(spark, 3, 600, 256, 30, step)
    numbers = items.select("product_id").distinct().coalesce(1).sortWithinPartitions("product_id")
    numbers = numbers.select("product_id", F.monotonically_increasing_id().alias("number"))
    units = copurchase._units(items.select("order_id", "product_id").join(numbers, "product_id"), 256)
    words = copurchase.partner_words(units)
    assert words.count() <= 256 * 256 // copurchase.WORD
    assert words.agg(F.sum(F.bit_count("bits"))).first()[0] == sum(r["recommendations"] for r in rows(partners_per_product(items)))


def test_orders_and_products_that_are_null(spark):
    items = spark.createDataFrame([(None, 1), (None, 2), (1, None), (1, 3), (1, 4)], "order_id long, product_id long")
    assert {r["product_id"]: r["recommendations"] for r in rows(partners_per_product(items))} == {None: 0, 1: 0, 2: 0, 3: 1, 4: 1}
