"""Ranks of a few rows within a large table, without sorting the table.

A report that shows the first rows of a join together with their rank over the
whole join needs that rank for the shown rows only. The rank is one more than
the rows ahead, so it is enough to count, per group, how many rows fall before
each shown key: one scan with a binary search per row and a map-side sum, with
no group collected or sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillbook.operators.shaping import bounded


def descending(value: Column) -> Column:
    """Sort key of a number or timestamp in descending order, NULL first."""
    return F.struct(-value)


def falling(value: Column) -> Column:
    """Sort key of money in descending order, NULL first, as a whole number of cents."""
    return F.coalesce(-(value * 100).cast("long"), F.lit(-(2**63)))


def newest_first(ts: Column, *ties: Column) -> Column:
    return F.struct((-F.unix_micros(ts)).alias("newest"), *ties)


def rows_ahead(rows: DataFrame, shown: DataFrame, limit: int) -> DataFrame:
    """Weight of ``rows`` that sort before each shown key of the same group.

    ``rows``: group, key, weight. ``shown``: group, key, at most ``limit`` rows.
    Keys are structs that sort ascending; NULL is a group of its own. Returns
    group, key, ahead for every distinct shown key.
    """
    marks = shown.groupBy("group").agg(F.array_sort(F.collect_set("key")).alias("marks"))
    marks = bounded(marks.withColumnRenamed("group", "of"), limit)
    counted = _counted(rows.join(marks, F.col("group").eqNullSafe(F.col("of"))), limit, "group")
    slots = marks.select(F.col("of").alias("group"), F.posexplode("marks").alias("slot", "key"))
    return _running(slots, counted, "group").select("group", "key", "ahead")


def rows_ahead_overall(rows: DataFrame, shown: DataFrame, limit: int) -> DataFrame:
    """:func:`rows_ahead` over one group that holds everything."""
    marks = shown.agg(F.array_sort(F.collect_set("key")).alias("marks"))
    counted = _counted(rows.withColumn("marks", marks.scalar()), limit)
    slots = marks.select(F.posexplode("marks").alias("slot", "key"))
    return _running(slots, counted).select("key", "ahead")


def _counted(rows: DataFrame, limit: int, *group: str) -> DataFrame:
    """Weight per group and number of marks not after the row's key."""
    inside = rows.filter(F.col("key") < F.element_at("marks", -1))
    return _searched(inside, limit).groupBy(*group, "slot").agg(F.sum("weight").alias("weight"))


def _searched(rows: DataFrame, limit: int) -> DataFrame:
    """Add ``slot``, the number of sorted ``marks`` not after ``key``."""
    return with_slots(rows, {"slot": ("marks", "key")}, limit)


def with_slots(rows: DataFrame, slots: dict[str, tuple[str, str]], limit: int) -> DataFrame:
    """Add for each name of ``slots`` the number of its sorted marks, at most ``limit``, that
    are not after its key: binary searches by halving strides. Written as a fold over the
    strides, since spelt out, several searches make more code than the JVM compiles. Rows
    whose marks are NULL get 0."""
    strides = F.array(*(F.lit(1 << bit) for bit in reversed(range(max(limit, 1).bit_length()))))

    def search(marks: str, key: str) -> Column:
        def step(slot: Column, stride: Column) -> Column:
            return F.when(F.get(marks, slot + stride - 1) <= F.col(key), slot + stride).otherwise(slot)

        return F.aggregate(strides, F.lit(0), step)

    return rows.withColumns({slot: search(marks, key) for slot, (marks, key) in slots.items()})


def _running(slots: DataFrame, counted: DataFrame, *group: str) -> DataFrame:
    """Sum of the weights up to each mark; the window sees at most two rows per mark."""
    window = Window.partitionBy(*group).orderBy("slot").rangeBetween(Window.unboundedPreceding, 0)
    return (
        slots.withColumn("weight", F.lit(0).cast("long"))
        .unionByName(counted, allowMissingColumns=True)
        .withColumn("ahead", F.sum("weight").over(window))
        .filter(F.col("key").isNotNull())
    )
