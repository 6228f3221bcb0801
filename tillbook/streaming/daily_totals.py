"""Daily sales totals kept up to date from a stream of orders and their changes."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tillbook.functions.dates import days_before, midnight, stamp
from tillbook.plans.upkeep.summaries import daily_totals, merge_daily_totals
from tillbook.schema import table_schema
from tillbook.sources.parquet_store import ParquetStore
from tillbook.sources.seeds import empty_table

_READ = ("order_id", "customer_id", "order_date", "status", "total_amount", "updated_at")


class DailyTotals:
    """Summary that follows a stream of orders, in which an order may come again.

    Distinct buyers and averages cannot be added up over batches, so the latest state
    of every order is logged under its day, and every day a batch touches is totalled
    again. An order that moves to another day leaves a removal in the old one, so each
    day's log says by itself which orders it holds. Of two states of an order the one
    updated last counts, of equal ones the one that came last. The window of ``days``
    moves with ``as_of``, a time or a clock asked once per batch. Every ``compact``
    batches the log is written anew without what is outdated; segments before the
    last but one such base are deleted. All is stored under the batch number: a
    batch that died halfway is written over, one that was committed is skipped.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        as_of: datetime | Callable[[], datetime],
        summary: DataFrame | None = None,
        days: int = 7,
        compact: int = 20,
    ):
        self.spark = spark
        self.folder = folder.rstrip("/")
        self.now = as_of if callable(as_of) else lambda: as_of
        self.days, self.compact = days, compact
        self.store = ParquetStore(spark, self.folder)
        self._first = summary if summary is not None else empty_table(spark, "sales_summary")

    def start(self, orders: DataFrame) -> StreamingQuery:
        """Consume what the stream holds now, batch by batch."""
        return (
            orders.select(*_READ)
            .writeStream.foreachBatch(self.absorb)
            .option("checkpointLocation", f"{self.folder}/progress")
            .trigger(availableNow=True)
            .start()
        )

    def absorb(self, batch: DataFrame, number: int) -> None:
        if number in self.store.commits():
            return  # a replay of a batch that was done
        as_of = self.now()
        first_day = F.to_date(stamp(days_before(midnight(as_of), self.days)))
        arrived = batch.select(*_READ).withColumn("order_day", F.to_date("order_date"))
        fresh = arrived.groupBy("order_id").agg(F.max(_state(arrived)).alias("fresh"))
        known = _current(self._log(number - 1).join(fresh.select("order_id"), "order_id", "left_semi"))
        known = known.select("order_id", F.struct("updated_at", "order_day").alias("known"))
        both = fresh.join(known, "order_id", "left")
        newer = F.col("known").isNull() | (_time("fresh.updated_at") >= _time("known.updated_at"))
        moved = F.col("known").isNotNull() & ~F.col("known.order_day").eqNullSafe(F.col("fresh.order_day"))
        # The state itself and, where the order was in another day, its removal there.
        states = F.array(
            F.struct(F.lit(False).alias("removed"), F.col("fresh.order_day").alias("order_day")),
            F.when(moved, F.struct(F.lit(True).alias("removed"), F.col("known.order_day").alias("order_day"))),
        )
        rows = both.filter(newer).select("order_id", "fresh", F.explode(F.filter(states, lambda s: s.isNotNull())).alias("s"))
        rows = rows.select("order_id", *(f"fresh.{c}" for c in _READ[1:]), "s.removed", "s.order_day").filter(F.col("order_day") >= first_day)
        rows.write.mode("overwrite").partitionBy("order_day").parquet(f"{self.folder}/orders/batch={number}")

        log = self._log(number)
        touched = log.filter(F.col("batch") == number).select("order_day").distinct()
        # The day is a partition column, so only touched days are read.
        totals = daily_totals(_current(log.join(touched, "order_day", "left_semi")))
        before = self._before(number)
        emptied = touched.join(totals, F.col("order_day") == F.col("summary_date"), "left_anti")
        before = before.join(emptied, F.col("summary_date") == F.col("order_day"), "left_anti")
        self.store.write(merge_daily_totals(before, totals, as_of), "sales_summary", number)
        if (number + 1) % self.compact == 0:
            self._compacted(number, first_day)

    def _log(self, number: int) -> DataFrame:
        """All segments up to a batch: the last base and what came after it."""
        base = max((n for n in self._segments("base") if n <= number), default=None)
        found = [f"{self.folder}/orders/batch={n}" for n in self._segments("batch") if (base is None or n > base) and n <= number]
        found += [] if base is None else [f"{self.folder}/orders/base={base}"]
        fields = [f for f in table_schema("orders").fields if f.name in _READ]
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
        schema = f"{kinds}, removed boolean, order_day date"
        if not found:
            return self.spark.createDataFrame([], f"{schema}, batch long")
        numbered = None
        for path in found:
            rows = self.spark.read.schema(schema).parquet(path).withColumn("batch", F.lit(int(path.rsplit("=", 1)[1])).cast("long"))
            numbered = rows if numbered is None else numbered.unionByName(rows)
        return numbered

    def _compacted(self, number: int, first_day) -> None:
        before = max((n for n in self._segments("base") if n < number), default=None)
        held = _current(self._log(number)).filter(F.col("order_day") >= first_day)
        held.drop("batch").write.mode("overwrite").partitionBy("order_day").parquet(f"{self.folder}/orders/base={number}")
        for kind in ("base", "batch") if before is not None else ():
            for n in self._segments(kind):
                if n < before or kind == "batch" and n == before:
                    self.store.delete(f"orders/{kind}={n}")

    def _segments(self, kind: str) -> list[int]:
        return self.store.numbers(f"orders/{kind}=*")

    def _before(self, number: int) -> DataFrame:
        earlier = [v for v in self.store.versions("sales_summary") if v < number]
        return self.store.read("sales_summary", earlier[-1]) if earlier else self._first

    def summary(self) -> DataFrame:
        return self.store.read("sales_summary") if self.store.exists("sales_summary") else self._first


def _time(column: str):
    """A state without a time is older than all others."""
    return F.coalesce(F.col(column), F.lit("0001-01-01").cast("timestamp"))


def _state(rows: DataFrame):
    """A row as a struct that sorts by time; a tie goes to the greater row, so that a
    replay repeats it."""
    rest = [c for c in rows.columns if c not in ("order_id", "updated_at")]
    return F.struct("updated_at", *rest)


def _current(log: DataFrame) -> DataFrame:
    """The orders that each day holds, in their last state."""
    rest = [c for c in log.columns if c not in ("order_id", "order_day", "updated_at", "batch", "removed")]
    last = F.max(F.struct(_time("updated_at").alias("at"), "batch", "removed", "updated_at", *rest)).alias("s")
    found = log.groupBy("order_day", "order_id").agg(last).filter("not s.removed")
    return found.select(*(f"s.{c}" if c not in ("order_day", "order_id") else c for c in log.columns))
