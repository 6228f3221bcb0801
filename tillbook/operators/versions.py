"""Table versions: merge, update and delete as DataFrame to DataFrame.

Parquet tables have no in-place writes, so every change yields the next version
of the whole table. Rows with one key never multiply: changes are brought to one
row per key first, or the job fails.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merged(target: DataFrame, source: DataFrame, keys: list[str], update: Iterable[str]) -> DataFrame:
    """Overwrite the ``update`` columns of matching rows, insert the other source rows.

    Columns the source lacks are NULL in inserted rows. A repeated source key fails
    the job.
    """
    update = set(update)
    source = one_per_key(source, keys)
    old = target.withColumn("_old", F.lit(True)).alias("old")
    new = source.withColumn("_new", F.lit(True)).alias("new")
    on = [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys]
    had, got = F.col("_old").isNotNull(), F.col("_new").isNotNull()

    def value(name: str) -> Column:
        kept = F.col(f"old.{name}")
        given = F.col(f"new.{name}") if name in source.columns else F.lit(None)
        if name in update:
            return F.when(got, given).otherwise(kept)
        return F.when(had, kept).otherwise(given)

    types = dict((f.name, f.dataType) for f in target.schema.fields)
    return old.join(new, on, "full_outer").select(*(value(c).cast(types[c]).alias(c) for c in target.columns))


def one_per_key(changes: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: with a column ``request_no`` the last request, of which
    nothing is left afterwards, else the only one. Without that column a key with
    two different rows fails the job; equal rows count once.
    """
    rest = [c for c in changes.columns if c not in (*keys, "request_no")]
    if not rest:
        return changes.select(*keys).distinct()
    row = F.struct(*rest)
    if "request_no" in changes.columns:
        # A tie goes to the greater row, so that a rerun repeats it.
        last = changes.groupBy(*keys).agg(F.max(F.struct("request_no", *rest)).alias("row"))
    else:
        found = changes.groupBy(*keys).agg(F.min(row).alias("row"), F.max(row).alias("other"))
        unlike = F.concat(F.lit(f"different requests for one {' and '.join(keys)}: "), *_texts(keys))
        last = found.withColumn("row", F.when(F.col("row").eqNullSafe(F.col("other")), F.col("row")).otherwise(F.raise_error(unlike)))
    return last.select(*keys, *(F.col(f"row.{c}").alias(c) for c in rest))


def _texts(keys: list[str]) -> list[Column]:
    return [F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in keys]


def updated(target: DataFrame, changes: DataFrame, key: str, values: Mapping[str, Column]) -> DataFrame:
    """Set ``values`` in the rows whose key occurs in ``changes``, of which there is
    at most one row per key (see ``one_per_key``).

    The values may use the columns of both frames; apart from the key their
    names must differ.
    """
    joined = target.join(changes.withColumn("_hit", F.lit(True)), key, "left")
    hit = F.col("_hit").isNotNull()
    types = dict((f.name, f.dataType) for f in target.schema.fields)
    return joined.select(
        *(
            F.when(hit, values[c].cast(types[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
            for c in target.columns
        )
    )


def updated_where(target: DataFrame, condition: Column, values: Mapping[str, Column]) -> DataFrame:
    types = dict((f.name, f.dataType) for f in target.schema.fields)
    return target.select(
        *(
            F.when(condition, values[c].cast(types[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c)
            for c in target.columns
        )
    )


def without(target: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not listed."""
    return target.join(keys.select(key), key, "left_anti").select(*target.columns)


def without_where(target: DataFrame, condition: Column) -> DataFrame:
    """A row goes only where the condition is true; unknown keeps it."""
    return target.filter(~F.coalesce(condition, F.lit(False)))


def count_of(rows: DataFrame) -> Column:
    """Row count as a scalar, to put several counts into one row."""
    return rows.agg(F.count(F.lit(1))).scalar()


def next_id(table: DataFrame, column: str, offset: Column) -> Column:
    """Id after the highest one in use. ``offset`` is a non-negative number that
    is unique among the new rows; gaps are fine."""
    return table.agg(F.coalesce(F.max(column), F.lit(0)) + 1).scalar() + offset


def with_next_ids(rows: DataFrame, table: DataFrame, column: str, buckets: int = 1024) -> DataFrame:
    """Number new rows through from the highest id in use, without gaps.

    The order is that of a hash of the whole row, so a rerun gives equal ids however
    its tasks are cut. Rows are counted and numbered within ``buckets`` ranges of the
    hash; only the ranges' counts meet in one task.
    """
    hashed = rows.withColumn("_hash", F.xxhash64(*rows.columns))
    hashed = hashed.withColumn("_bucket", F.pmod("_hash", F.lit(buckets)))
    sizes = hashed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy("_hash", *rows.columns))
    numbered = hashed.withColumn("_number", within).join(starts, "_bucket")
    return numbered.select(*rows.columns, next_id(table, column, F.col("_start") + F.col("_number") - 1).alias(column))
