"""Streams give what the batch jobs give on the same rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tillbook.plans.upkeep import summaries
from tillbook.schema import table_schema
from tillbook.sources.seeds import empty_table
from tillbook.streaming import activity
from tillbook.streaming.daily_totals import DailyTotals
from test_reports import _order

AS_OF = datetime(2001, 7, 31, 12)


def _days(df):
    return sorted(tuple(r[c] for c in df.columns if c != "summary_id") for r in df.collect())


@pytest.fixture
def order_files(table, tmp_path):
    """Orders in three files; every day and some buyers occur in several of them."""
    batches = [
        [_order(i * 100 + n, customer_id=n % 4, at=f"2001-07-{25 + n % 5} 0{n}:00:00", total=str(n + i)) for n in range(8)]
        for i in range(3)
    ]
    for batch in batches:
        table("orders", batch).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return str(tmp_path / "in")


def test_daily_totals_over_batches(spark, order_files, tmp_path):
    stream = spark.readStream.schema(table_schema("orders")).option("maxFilesPerTrigger", 1).parquet(order_files)
    job = DailyTotals(spark, str(tmp_path / "job"), AS_OF)
    job.start(stream).awaitTermination()
    assert len(job.store.versions("sales_summary")) == 3
    everything = spark.read.schema(table_schema("orders")).parquet(order_files)
    want = summaries.merge_sales_summary(empty_table(spark, "sales_summary"), everything, AS_OF)
    assert _days(job.summary()) == _days(want)


def test_replayed_batch_changes_nothing(spark, order_files, tmp_path):
    job = DailyTotals(spark, str(tmp_path / "job"), AS_OF)
    read = spark.read.schema(table_schema("orders")).parquet(order_files)
    halves = [read.filter(F.col("order_id") % 2 == half).select("order_id", "customer_id", "order_date", "status", "total_amount", "updated_at") for half in (0, 1)]
    for number, half in enumerate(halves):
        job.absorb(half, number)
    before = job.summary().collect()
    job.absorb(halves[1], 1)
    assert sorted(job.summary().collect()) == sorted(before)
    assert job.store.versions("sales_summary") == [0, 1]


def _batches(table, spark, folder, batches, **options):
    """Absorb lists of orders and return the job and all states in order of time."""
    job = DailyTotals(spark, str(folder), AS_OF, **options)
    last = {}
    for number, batch in enumerate(batches):
        job.absorb(table("orders", batch), number)
        for order in batch:
            if order["order_id"] not in last or order["updated_at"] >= last[order["order_id"]]["updated_at"]:
                last[order["order_id"]] = order
    want = summaries.merge_sales_summary(empty_table(spark, "sales_summary"), table("orders", list(last.values())), AS_OF)
    return job, want


def _seen(order_id, at, day="2001-07-30", **more):
    return _order(order_id, at=f"{day} 10:00:00", **more) | {"updated_at": f"2001-07-31 {at:02d}:00:00"}


@pytest.mark.parametrize(
    "batches",
    [
        [[_seen(1, 1, status="COMPLETED", total="10.00")], [_seen(1, 2, status="SHIPPED", total="10.00")]],
        [[_seen(1, 1), _seen(2, 1)], [_seen(1, 1), _seen(1, 1)]],
        [[_seen(1, 1), _seen(2, 1)], [_seen(1, 2, day="2001-07-28")], [_seen(3, 3)], [_seen(1, 4)]],
        [[_seen(1, 5, total="5.00")], [_seen(1, 2, total="2.00")], [_seen(1, 3, day="2001-07-29")]],
        [[_seen(1, 1), _seen(2, 1)], [_seen(2, 2, status="CANCELLED")], [_seen(1, 3, status="CANCELLED")]],
        [[_seen(1, 1), _seen(2, 1)], [_seen(1, 2, day="2001-07-02")]],
    ],
    ids=["moved on", "repeated", "other day", "late state", "cancelled", "out of the window"],
)
@pytest.mark.parametrize("compact", [1, 2, 20])
def test_only_the_last_state_of_an_order_counts(spark, table, tmp_path, batches, compact):
    job, want = _batches(table, spark, tmp_path, batches, compact=compact)
    assert _days(job.summary()) == _days(want)


def test_history_is_compacted(spark, table, tmp_path):
    batches = [[_seen(i, i % 24, total=str(i)), _seen(1, i % 24)] for i in range(9)]
    job, want = _batches(table, spark, tmp_path, batches, compact=2)
    assert job._segments("base") == [5, 7] and job._segments("batch") == [6, 7, 8]
    assert _days(job.summary()) == _days(want)


def test_the_window_moves(spark, table, tmp_path):
    clock = iter([datetime(2001, 7, 31, 12), datetime(2001, 8, 20, 12)])
    job = DailyTotals(spark, str(tmp_path), lambda: next(clock))
    job.absorb(table("orders", [_seen(1, 1)]), 0)
    job.absorb(table("orders", [_seen(2, 1), _seen(3, 1, day="2001-08-15")]), 1)
    found = {str(r["summary_date"]): r["total_orders"] for r in rows(job.summary())}
    assert found == {"2001-07-30": 1, "2001-08-15": 1}


def _events(spark, moments, user=1):
    return spark.createDataFrame([(user, m) for m in moments], "user_id long, ts timestamp")


T0 = datetime(2024, 1, 1, 10)
HOUR = timedelta(hours=1)


@pytest.mark.parametrize(("gap", "sessions"), [(HOUR, 1), (HOUR + timedelta(seconds=1), 2)])
def test_session_border(spark, gap, sessions):
    got = rows(activity.sessions(_events(spark, [T0, T0 + gap])))
    assert len(got) == sessions


def test_streamed_sessions_equal_batch_and_late_events_are_dropped(spark, tmp_path):
    source = tmp_path / "events"

    def arrive(moments):
        _events(spark, moments).coalesce(1).write.mode("append").parquet(str(source))

    def run():
        stream = spark.readStream.schema("user_id long, ts timestamp").parquet(str(source))
        activity.start(stream, str(tmp_path / "out")).awaitTermination()

    on_time = [T0, T0 + HOUR, T0 + 3 * HOUR, T0 + 12 * HOUR]
    arrive(on_time)
    run()
    arrive([T0 + timedelta(minutes=30), T0 + 20 * HOUR])  # the first is eleven hours late
    run()
    want = activity.sessions(_events(spark, [*on_time, T0 + 20 * HOUR])).filter(
        F.col("last_activity") <= F.lit(T0 + 18 * HOUR)
    )
    got = spark.read.parquet(str(tmp_path / "out" / "sessions"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_finished_and_open_sessions_equal_batch_after_every_run(spark, tmp_path):
    """Users come and go over several runs; a session that goes on is open, then finished, never both."""
    source, out = tmp_path / "events", str(tmp_path / "out")
    rng, seen, states = random.Random(3), [], []
    for run in range(4):
        fresh = [(rng.randint(1, 9), T0 + run * 6 * HOUR + timedelta(minutes=rng.randint(0, 360))) for _ in range(60)]
        fresh.append((1, T0 + run * 6 * HOUR + timedelta(minutes=360)))
        seen += fresh
        spark.createDataFrame(fresh, "user_id long, ts timestamp").coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema("user_id long, ts timestamp").parquet(str(source))
        activity.start(stream, out).awaitTermination()
        found = activity.all_sessions(spark, out)
        want = activity.sessions(spark.createDataFrame(seen, "user_id long, ts timestamp"))
        border = max(ts for _, ts in seen) - HOUR
        expected = [(*r, int(r.last_activity + HOUR > border)) for r in want.collect()]
        assert sorted(map(tuple, found.collect())) == sorted(expected)
        states.append(sum(active for *_, active in expected))
    assert all(states) and max(states) < 15
