"""Counting rows ahead gives the window functions' ranks."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import rows
from tillbook.operators.placing import descending, newest_first, rows_ahead, rows_ahead_overall


def _table(spark, seed=1, count=400):
    rng = random.Random(seed)
    data = [
        (
            i,
            rng.choice([None, "a", "b", "b", "b", "c"]),
            None if rng.random() < 0.1 else rng.randint(1, 40),
            rng.randint(1, 3),
        )
        for i in range(count)
    ]
    return spark.createDataFrame(data, "id long, grp string, v long, weight long").repartition(5)


@pytest.mark.parametrize("limit", [1, 2, 7, 64])
def test_rank_with_weights_and_nulls(spark, limit):
    df = _table(spark)
    shown = df.orderBy("id").limit(limit)
    copies = df.withColumn("copy", F.explode(F.sequence(F.lit(1), "weight")))
    ranked = copies.withColumn("r", F.rank().over(Window.partitionBy("grp").orderBy(F.desc_nulls_first("v"))))
    want = {r["id"]: r["r"] for r in rows(ranked.filter(F.col("id") < limit))}
    key = descending(F.col("v")).alias("key")
    ahead = rows_ahead(df.select(F.col("grp").alias("group"), key, "weight"), shown.select(F.col("grp").alias("group"), key), limit)
    got = {}
    places = {(r["group"], r["key"][0]): r["ahead"] + 1 for r in rows(ahead)}
    for r in rows(shown):
        got[r["id"]] = places[(r["grp"], None if r["v"] is None else -r["v"])]
    assert got == want


def test_dense_rank_over_everything(spark):
    df = _table(spark, seed=3)
    limit = 30
    shown = df.orderBy("id").limit(limit)
    ranked = df.withColumn("r", F.dense_rank().over(Window.orderBy(F.desc_nulls_first("v"))))
    want = {r["id"]: r["r"] for r in rows(ranked.filter(F.col("id") < limit))}
    key = descending(F.col("v")).alias("key")
    values = df.select(key).distinct().withColumn("weight", F.lit(1).cast("long"))
    places = {r["key"][0]: r["ahead"] + 1 for r in rows(rows_ahead_overall(values, shown.select(key), limit))}
    assert {r["id"]: places[None if r["v"] is None else -r["v"]] for r in rows(shown)} == want


def test_row_number_with_ties_broken_by_keys(spark):
    rng = random.Random(5)
    data = [(i, rng.choice("xy"), rng.randint(0, 9)) for i in range(200)]
    df = spark.createDataFrame(data, "id long, grp string, day int").withColumn(
        "at", F.expr("timestamp'2001-01-01 00:00:00' + make_dt_interval(day)")
    )
    ranked = df.withColumn("r", F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("at"), "id")))
    want = {r["id"]: r["r"] for r in rows(ranked.filter("id < 25"))}
    key = newest_first(F.col("at"), F.col("id")).alias("key")
    base = df.select(F.col("grp").alias("group"), key, F.lit(1).cast("long").alias("weight"))
    ahead = rows_ahead(base, df.filter("id < 25").select(F.col("grp").alias("group"), key), 25)
    assert {r["key"]["id"]: r["ahead"] + 1 for r in rows(ahead)} == want
