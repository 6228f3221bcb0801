import pytest
from pyspark.sql import functions as F

from tillbook.llm import common


@pytest.mark.parametrize("bits", [common.KEY_BITS, common.BITMAP_BITS])
def test_keys_are_found_whatever_the_bitmap_holds(spark, monkeypatch, bits):
    monkeypatch.setattr(common, "KEY_BITS", bits)
    rows = spark.range(60_000).select(F.col("id").cast("string").alias("id"), F.xxhash64("id").alias("fp"), F.lit("x").alias("text"))
    keys = rows.filter("cast(id as int) % 7 = 0").select("id", "fp")
    maybe = common.marked(rows, keys).filter("maybe")
    assert maybe.join(keys, ["id", "fp"]).count() == keys.count() <= maybe.count() < 60_000 if bits > 60_000 else True
    assert common.without(rows, keys).count() == 60_000 - keys.count()
    assert common.without(rows, keys).columns == rows.columns
    assert common.among(rows, keys.withColumn("more", F.lit(1))).columns == ["id", "fp", "text", "more"]
    assert common.among(rows, keys).count() == keys.count()
    assert common.among(rows, keys.limit(0)).count() == 0 and common.without(rows, keys.limit(0)).count() == 60_000


def test_few_keys_let_few_rows_through(spark):
    rows = spark.range(100_000).select(F.col("id").cast("string").alias("id"), F.lit(0).cast("long").alias("fp"))
    assert common.marked(rows, rows.limit(1000)).filter("maybe").count() < 1100


def test_words():
    assert common.letter_words("Ab-c É1\x00d".encode()) == [b"ab", b"c", "É1".encode(), b"d"]
    assert common.letter_words(None) == common.letter_words(b" ") == []
