"""Row keys and helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook.operators.staging import staged
from tillbook.session import pin

# Words of the plain kind: anything between ASCII white space.
PLAIN_WORD = r"[^\x20\x09-\x0D]+"

# Byte table for words of digits, letters and non-ASCII bytes, A-Z in lower case:
# every other byte becomes a space, so that bytes.split() yields the words.
LETTER_TABLE = bytes(
    code if 0x30 <= code <= 0x39 or 0x61 <= code <= 0x7A or code >= 0x80 else code + 32 if 0x41 <= code <= 0x5A else 32
    for code in range(256)
)


def letter_words(text: bytes | None) -> list[bytes]:
    return text.translate(LETTER_TABLE).split() if text else []


def ready(spark: SparkSession) -> SparkSession:
    """Session settings of the library, and Arrow batches that stay small with long texts."""
    pin(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame) -> DataFrame:
    """The whole row as ``row`` beside its key: ``id`` (never NULL) and ``fp``.

    Rows with equal keys have equal ids and texts, so that every decision that
    depends on the text alone may be joined back by the key. Packing the row keeps
    its columns apart from those an operator adds, whatever their names.
    """
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        row_id(docs).alias("id"),
        F.xxhash64(docs["text"]).alias("fp"),
    )


def row_id(docs: DataFrame) -> Column:
    return F.coalesce(docs["doc_id"].cast("string"), F.lit(""))


# Bits of the bitmap by which rows are held against keys before they are shuffled.
KEY_BITS = 1 << 24
BITMAP_BITS = 1 << 15  # of one value of Spark's bitmap functions


def marked(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` with ``maybe``: false only where the row's key is surely not among ``keys``.

    The keys set bits of a bitmap of KEY_BITS, two megabytes whatever their number, which
    is broadcast. So texts that a join by key has nothing to do with are not shuffled for
    it; with far more keys than bits all are, and results are the same.
    """
    spot = F.pmod(F.xxhash64("id", "fp"), F.lit(KEY_BITS))
    part, bit = F.floor(spot / BITMAP_BITS).cast("int"), (spot % BITMAP_BITS).cast("int")
    bitmaps = keys.select(part.alias("part"), bit.alias("bit")).groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    bitmaps = staged(bitmaps, "key-bits").withColumnRenamed("part", "of")
    byte = F.conv(F.hex(F.substring("bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(F.getbit(byte.cast("long"), bit % 8) == 1, F.lit(False))
    found = rows.join(F.broadcast(bitmaps), part == F.col("of"), "left")
    return found.withColumn("maybe", held).drop("of", "bits")


def among(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` (with ``id, fp``) joined with ``keys``, by key."""
    return marked(rows, keys.select("id", "fp")).filter("maybe").drop("maybe").join(keys, ["id", "fp"])


def without(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` (with ``id, fp``) whose key is not among ``keys``."""
    found = marked(rows, keys)
    rest = found.filter("maybe").join(keys.select("id", "fp"), ["id", "fp"], "left_anti").select(found.columns)
    return found.filter("not maybe").unionByName(rest).drop("maybe")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, though lambdas inside read it often."""
    return F.element_at(F.transform(F.array(value), body), 1)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
