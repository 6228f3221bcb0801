"""Reading from and writing to the retail database over JDBC."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows per fetch and seconds before a query is given up.
FETCH_SIZE = 100
READ_TIMEOUT, WRITE_TIMEOUT = 180, 60


@dataclass(frozen=True)
class Database:
    """Where the tables live; credentials are passed on to the driver as given."""

    url: str
    driver: str
    user: str | None = None
    password: str | None = None

    def options(self, table: str, timeout: int) -> dict[str, str]:
        given = {"user": self.user, "password": self.password}
        return {
            "url": self.url,
            "driver": self.driver,
            "dbtable": table,
            "queryTimeout": str(timeout),
            **{k: v for k, v in given.items() if v is not None},
        }


@dataclass(frozen=True)
class KeyRange:
    """Numeric key to split a read by. Rows outside the bounds are read too, by
    the first and last partition."""

    column: str
    lower: int
    upper: int
    partitions: int

    def options(self) -> dict[str, str]:
        return {
            "partitionColumn": self.column,
            "lowerBound": str(self.lower),
            "upperBound": str(self.upper),
            "numPartitions": str(self.partitions),
        }


def read_options(db: Database, table: str, split: KeyRange | None = None, fetch_size: int = FETCH_SIZE) -> dict:
    options = {**db.options(table, READ_TIMEOUT), "fetchsize": str(fetch_size)}
    return {**options, **split.options()} if split else options


def write_options(db: Database, table: str, batch_size: int = 1000) -> dict:
    return {**db.options(table, WRITE_TIMEOUT), "batchsize": str(batch_size)}


def read_table(spark: SparkSession, db: Database, table: str, split: KeyRange | None = None) -> DataFrame:
    """Table as a DataFrame with lower-case columns; one connection per partition
    of ``split``, a single one without it. Filters and columns are pushed down."""
    rows = spark.read.format("jdbc").options(**read_options(db, table, split)).load()
    return rows.select(*(F.col(c).alias(c.lower()) for c in rows.columns))


def key_range(spark: SparkSession, db: Database, table: str, column: str, partitions: int) -> KeyRange | None:
    """Bounds of a key, asked of the database; None for an empty table."""
    query = f"(SELECT MIN({column}) AS low, MAX({column}) AS high FROM {table}) bounds"
    low, high = spark.read.format("jdbc").options(**read_options(db, query)).load().first()
    return None if low is None else KeyRange(column, int(low), int(high) + 1, partitions)


def append_rows(rows: DataFrame, db: Database, table: str) -> None:
    rows.write.format("jdbc").options(**write_options(db, table)).mode("append").save()
