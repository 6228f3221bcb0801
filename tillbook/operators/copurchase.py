"""Products bought in the same order.

Pairing the products of an order squares it. Orders are packed to units of bounded size, so
that pairs are made within a row and no pair is shuffled that cannot reach the wanted count:
a first pass adds up pairs by hash bucket, whose number is fixed, and a second one, over the
same shuffle of units, keeps those of buckets that hold enough. An order with many products is cut: its products are
dealt out to pieces, and each two pieces are a unit of their own, so that no task holds a
whole large order squared. One plan serves orders of every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Products of a piece of an order.
PIECE = 256
# Buckets of pairs; the bitmap of those that hold enough has a 64th of the rows.
BUCKETS = 1 << 20
# Numbers of products in one word of a bitmap.
WORD = 64
# What a product is in a unit: on both sides of its pairs, or on one.
BOTH, FIRST, SECOND = 0, 1, 2


def pairs_bought_together(
    lines: DataFrame, names: DataFrame, min_count: int, piece: int = PIECE, buckets: int = BUCKETS
) -> DataFrame:
    """Name pairs found in at least ``min_count`` orders.

    ``lines``: order_id, product_id, subtotal. ``names``: product_id, product_name.
    Within an order a pair runs from the smaller product id to the larger one;
    equal names are merged afterwards. Returns product_1, product_2, ``orders``,
    ``combined`` (sum of both subtotals over all line pairs) and ``priced_pairs``
    (how many line pairs that sum covers).
    """
    pairs = _pairs(_units(_baskets(lines, names), piece))
    both = _combined(F.col("a.priced"), F.col("a.value"), F.col("b.priced"), F.col("b.value"))
    return (
        frequent_pairs(pairs, min_count, buckets)
        .groupBy("product_1", "product_2")
        .agg(
            F.count_if("once").alias("orders"),
            F.sum(both).cast("decimal(34,2)").alias("combined"),
            F.sum(F.col("a.priced") * F.col("b.priced")).alias("priced_pairs"),
        )
        .filter(F.col("orders") >= min_count)
    )


def _combined(priced_1: Column, value_1: Column, priced_2: Column, value_2: Column) -> Column:
    return value_1 * priced_2.cast("decimal(12,0)") + value_2 * priced_1.cast("decimal(12,0)")


def _baskets(lines: DataFrame, names: DataFrame) -> DataFrame:
    """One row per product of an order, with the least and the greatest product of its name
    there: a name pair occurs in the order if the least of one lies before the greatest of
    the other, and that product pair stands for it."""
    name = Window.partitionBy("order_id", "product_name")
    value = F.coalesce(F.sum("subtotal"), F.lit(0)).cast("decimal(24,2)")
    return (
        lines.groupBy("order_id", "product_id")
        .agg(F.count("subtotal").alias("priced"), value.alias("value"))
        .join(names.select("product_id", "product_name"), "product_id")
        .withColumns({"least": F.min("product_id").over(name), "greatest": F.max("product_id").over(name)})
    )


def _units(baskets: DataFrame, piece: int) -> DataFrame:
    """``items``: arrays of products with their ``side``, at most two pieces of an order in each.

    An order of n products has n / ``piece`` pieces, and every pair of them is a unit.
    """
    baskets = baskets.filter("order_id is not null")
    large = baskets.groupBy("order_id").agg(F.ceil(F.count(F.lit(1)) / piece).cast("int").alias("pieces")).filter("pieces > 1")
    own = F.pmod(F.xxhash64("product_id"), F.col("pieces")).cast("int")
    dealt = baskets.join(large, "order_id", "left").withColumn("own", F.coalesce(own, F.lit(-1)))
    others = F.sequence(F.lit(0), F.col("pieces") - 1)

    def place(row: Column, column: Column, side: int) -> Column:
        return F.struct(row.alias("row"), column.alias("column"), F.lit(side).alias("side"))

    many = F.concat(
        F.transform(others, lambda other: place(F.col("own"), other, FIRST)),
        F.transform(others, lambda other: place(other, F.col("own"), SECOND)),
    )
    places = F.when(F.col("own") < 0, F.array(place(F.lit(0), F.lit(0), BOTH))).otherwise(many)
    item = F.struct("at.side", *(c for c in baskets.columns if c != "order_id"))
    return dealt.withColumn("at", F.explode(places)).groupBy("order_id", "at.row", "at.column").agg(F.collect_list(item).alias("items"))


def _pairs(units: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of a unit's products, smaller id first. ``once`` holds for one pair per
    order and two names."""
    first = F.filter("items", lambda item: item["side"] != SECOND)
    second = F.filter("items", lambda item: item["side"] != FIRST)
    return (
        units.select(first.alias("first"), second.alias("second"))
        .select(F.explode("first").alias("a"), "second")
        .select("a", F.explode("second").alias("b"))
        .filter("a.product_id < b.product_id")
        .select(
            "a",
            "b",
            F.col("a.product_name").alias("product_1"),
            F.col("b.product_name").alias("product_2"),
            ((F.col("a.product_id") == F.col("a.least")) & (F.col("b.product_id") == F.col("b.greatest"))).alias("once"),
        )
    )


def frequent_pairs(pairs: DataFrame, min_count: int, buckets: int = BUCKETS) -> DataFrame:
    """``pairs`` without those whose names cannot occur in ``min_count`` orders together.

    Name pairs are counted by hash bucket; a pair is in no more orders than its bucket
    counts. The buckets with enough are a bitmap, which is broadcast: its size depends on
    ``buckets`` alone. With far more frequent pairs than buckets none is dropped, and the
    counts are the same.
    """
    bucket = F.pmod(F.xxhash64("product_1", "product_2"), F.lit(buckets))
    enough = pairs.filter("once").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)
    bits = enough.groupBy(F.shiftright("bucket", 6).alias("number")).agg(F.expr("bit_or(shiftleft(1L, cast(bucket % 64 as int)))").alias("bits"))
    held = pairs.withColumn("bucket", bucket).withColumn("number", F.shiftright("bucket", 6)).join(F.broadcast(bits), "number")
    return held.filter("getbit(bits, cast(bucket % 64 as int)) = 1").drop("bucket", "number", "bits")


def partners_per_product(items: DataFrame, piece: int = PIECE) -> DataFrame:
    """Number of distinct other products each product shares an order with.

    Products are numbered, and a product's partners are a bitmap: one word for each range
    of WORD numbers in which it has any. Words are or-ed on the map side, so that at most
    one row per product and range leaves a task, however often and in however many orders
    its pairs occur; no pair is shuffled.
    """
    products = items.select("product_id").distinct()
    # Sorted, the numbers repeat if a task does. They go up by one within a partition.
    numbers = products.filter("product_id is not null").sortWithinPartitions("product_id").select(
        "product_id", F.monotonically_increasing_id().alias("number")
    )
    baskets = items.select("order_id", "product_id").distinct().join(numbers, "product_id")
    counted = partner_words(_units(baskets, piece)).groupBy("product_id").agg(F.sum(F.bit_count("bits")).alias("partners"))
    return products.join(counted, "product_id", "left").select(
        "product_id", F.coalesce("partners", F.lit(0)).alias("recommendations")
    )


def partner_words(units: DataFrame) -> DataFrame:
    """``product_id, word, bits``: the partners of each product whose number has that word."""
    first = F.filter("items", lambda item: item["side"] != SECOND)
    second = F.filter("items", lambda item: item["side"] != FIRST)
    ordered = (
        units.select(F.transform(first, lambda item: item["product_id"]).alias("first"), second.alias("second"))
        .select(F.explode("first").alias("product_id"), "second")
        .select("product_id", F.explode("second").alias("other"))
        .filter("product_id <> other.product_id")
    )
    word = F.expr(f"other.number div {WORD}").alias("word")
    return ordered.groupBy("product_id", word).agg(F.expr(f"bit_or(shiftleft(1L, cast(other.number % {WORD} as int)))").alias("bits"))
