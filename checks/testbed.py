"""Retail tables derived from the driver's Parquet tables (rules: FIXTURES.md, part C).

The rules are plain projections, so column pruning reaches the scan. Dates are
shifted by a time of day, which hides them from Parquet's filters; ``since``
therefore also filters the raw date one day earlier, before the exact filter
in the plan.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook.functions.dates import midnight
from tillbook.schema import conform

AS_OF = datetime(2001, 7, 31, 12)
SESSIONS_AS_OF = datetime(2024, 1, 30, 12)

# Declared payment methods and gateways, in declared order.
PAYMENT_METHODS = ("CREDIT_CARD", "DEBIT_CARD", "PAYPAL", "BANK_TRANSFER")
GATEWAYS = ("Stripe", "PayPal", "Square", "Authorize.Net", "Braintree")

UNKNOWN_PRODUCT_OFFSET = 1_000_000_000


# Column types of the files, so that no job has to read their footers first.
RAW = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
        "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
        "l_shipdate timestamp_ntz"
    ),
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
}


def _one_of(values: tuple[str, ...], key: str) -> str:
    """SQL for the value at ``key`` modulo their number."""
    listed = ", ".join(f"'{value}'" for value in values)
    return f"element_at(array({listed}), cast({key} % {len(values)} + 1 as int))"


_METHOD = _one_of(PAYMENT_METHODS, "o_orderkey")
_PLACED = "cast(o_orderdate as timestamp) + make_dt_interval(0, 0, 0, cast(o_orderkey * 7919 % 86400 as decimal(18,6)))"
_TOTAL = "if(o_orderkey % 50 = 3, null, cast(o_totalprice as decimal(12,2)))"
_STATUS = f"""case o_orderstatus
    when 'F' then {_one_of(("COMPLETED", "SHIPPED", "DELIVERED"), "o_orderkey")}
    when 'O' then {_one_of(("PENDING", "PROCESSING"), "o_orderkey")}
    else {_one_of(("CANCELLED", "PAYMENT_FAILED", "COMPLETED", "COMPLETED"), "o_orderkey")} end"""
_SESSION_ID = "concat(user_id, '-', date_format(ts, 'yyyyMMdd'))"


class Testbed:
    """Retail tables over one scale-factor folder."""

    __test__ = False

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.schema(RAW[name]).parquet(f"{self.folder}/{name}.parquet")

    # -- operational tables -------------------------------------------------

    def customers(self) -> DataFrame:
        joined = "timestamp'2001-07-31 06:00:00' - make_dt_interval(cast(c_custkey % 2405 as int))"
        rows = self.raw("customer").selectExpr(
            "c_custkey as customer_id",
            "concat('FirstName', c_custkey) as first_name",
            "concat('LastName', c_custkey) as last_name",
            "concat('customer', c_custkey, '@example.com') as email",
            "concat('555-', lpad(c_custkey, 7, '0')) as phone",
            "concat('City', c_custkey % 50) as city",
            "concat('State', c_custkey % 50) as state",
            "c_custkey % 1000 as zip_code",
            "'USA' as country",
            f"{joined} as created_at",
            f"{joined} as updated_at",
            "c_custkey * 100 % 10000 as loyalty_points",
            "if(c_custkey % 10 = 0, 'PREMIUM', 'REGULAR') as customer_type",
        )
        return conform(rows, "customers")

    def products(self) -> DataFrame:
        rows = self.raw("part").selectExpr(
            "p_partkey as product_id",
            "p_name as product_name",
            "p_type as category",
            "p_brand as subcategory",
            "cast(p_retailprice as decimal(10,2)) as price",
            "round(cast(p_retailprice as decimal(10,2)) * 0.5, 2) as cost",
            "concat('Manufacturer#', p_partkey % 5) as manufacturer",
            "concat('SKU-', lpad(p_partkey, 8, '0')) as sku",
            "if(p_partkey % 25 = 0, 0, 1) as is_active",
        )
        return conform(rows, "products")

    def inventory(self) -> DataFrame:
        """One stock row per product, two for every third."""
        rows = (
            self.raw("part")
            .selectExpr("p_partkey as k", "explode(if(p_partkey % 3 = 0, array(0, 1), array(0))) as w")
            .selectExpr(
                "k * 2 + w as inventory_id",
                "k as product_id",
                "concat('WH-', (k + w) % 5) as warehouse_location",
                "if(k % 7 = 0, k % 120, 1000 + k * 137 % 5000) as quantity_available",
                "k * 3 % 50 as quantity_reserved",
                "100 as reorder_level",
            )
        )
        return conform(rows, "inventory")

    def orders(self, since: datetime | None = None) -> DataFrame:
        return self._as_orders(self._kept(since))

    def order_stream(self, files_per_batch: int = 1) -> DataFrame:
        """The orders as a stream over the table's files."""
        return self._as_orders(self._stream("orders", files_per_batch).filter("o_custkey % 50 != 7"))

    def event_stream(self, files_per_batch: int = 1) -> DataFrame:
        return self._stream("events", files_per_batch).selectExpr("event_id", "user_id", "cast(ts as timestamp) as ts")

    def _stream(self, name: str, files_per_batch: int) -> DataFrame:
        return (
            self.spark.readStream.schema(RAW[name])
            .option("maxFilesPerTrigger", files_per_batch)
            .option("pathGlobFilter", f"{name}*.parquet")
            .parquet(self.folder)
        )

    def _kept(self, since: datetime | None) -> DataFrame:
        kept = self.raw("orders").filter("o_custkey % 50 != 7")
        if since is None:
            return kept
        early = midnight(since - timedelta(days=1))
        return kept.filter(f"o_orderdate >= timestamp_ntz'{early.isoformat(sep=' ')}'")

    def _as_orders(self, kept: DataFrame) -> DataFrame:
        rows = kept.selectExpr(
            "o_orderkey as order_id",
            "o_custkey as customer_id",
            f"{_PLACED} as order_date",
            f"{_STATUS} as status",
            f"{_TOTAL} as total_amount",
            f"round({_TOTAL} * 0.08, 2) as tax_amount",
            "if(o_orderkey % 4 = 0, null, cast(o_orderkey % 2000 as decimal(8,0)) * 0.01) as shipping_cost",
            f"{_METHOD} as payment_method",
            f"{_PLACED} as created_at",
            f"{_PLACED} as updated_at",
        )
        return conform(rows, "orders")

    def order_items(self, any_order: bool = False, since: datetime | None = None) -> DataFrame:
        """Lines of kept orders. ``any_order`` leaves out the check against the
        orders, for plans that join the orders themselves; ``since`` leaves out
        the lines of older orders before the lines are numbered."""
        lines = self.raw("lineitem").filter("l_partkey % 40 != 1")
        if since is not None:
            recent = self._kept(since).selectExpr("o_orderkey as l_orderkey")
            lines = lines.join(recent, "l_orderkey", "left_semi")
        elif not any_order:
            dropped = self.raw("orders").filter("o_custkey % 50 = 7").selectExpr("o_orderkey as l_orderkey")
            lines = lines.join(dropped, "l_orderkey", "left_anti")
        # The id is a hash of the whole line: no order is gathered or sorted for it.
        hundredths = ", ".join(f"cast(round({c} * 100) as bigint)" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
        line = f"""concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, {hundredths},
            l_returnflag, l_linestatus, datediff(l_shipdate, date'1970-01-01'))"""
        line_id = f"cast(conv(substr(md5({line}), 1, 15), 16, 10) as bigint)"
        cents, units = "cast(round(l_extendedprice * 100) as bigint)", "cast(l_quantity as bigint)"
        subtotal = "cast(l_extendedprice as decimal(12,2))"
        rows = lines.selectExpr(
            f"{line_id} as order_item_id",
            "l_orderkey as order_id",
            "l_partkey as product_id",
            f"{units} as quantity",
            f"cast((2 * {cents} + {units}) div (2 * {units}) as decimal(18,0)) * 0.01 as unit_price",
            f"round({subtotal} * cast(l_discount as decimal(4,2)), 2) as discount",
            f"{subtotal} as subtotal",
        )
        return conform(rows, "order_items")

    def transactions(self, since: datetime | None = None) -> DataFrame:
        """A payment for most orders and a refund for some, both from one scan."""
        started = since - timedelta(days=2) if since is not None else None
        kinds = "array_compact(array(if(order_id % 10 = 9, null, 0), if(order_id % 17 = 0, 1, null)))"
        payment = "kind = 0"
        rows = (
            self.orders(started)
            .selectExpr("order_id", "order_date", "total_amount", f"explode({kinds}) as kind")
            .selectExpr(
                "order_id * 2 + kind as transaction_id",
                "order_id",
                f"if({payment}, 'PAYMENT', 'REFUND') as transaction_type",
                f"if({payment}, total_amount, -total_amount) as amount",
                "'USD' as currency",
                f"{_one_of(GATEWAYS, 'order_id')} as payment_gateway",
                f"case when {payment} and order_id % 20 = 0 then 'FAILED' "
                f"when {payment} and order_id % 7 = 0 then 'PENDING' else 'COMPLETED' end as status",
                f"order_date + if({payment}, interval '1' hour, interval '48' hour) as processed_at",
            )
        )
        return conform(rows, "transactions")

    def session_data(self) -> DataFrame:
        """One session per user and calendar day of events."""
        daily = (
            self.raw("events")
            .groupBy("user_id", F.to_date("ts").alias("day"))
            .agg(
                F.min("ts").alias("login_time"),
                F.max("ts").alias("last_activity"),
                F.bool_or(F.col("event_type") == "error").alias("failed"),
            )
        )
        rows = daily.selectExpr(
            "concat(user_id, '-', date_format(day, 'yyyyMMdd')) as session_id",
            "user_id as customer_id",
            "login_time",
            "last_activity",
            "if(user_id % 5 = 0 and failed, 0, 1) as is_active",
        )
        return conform(rows, "session_data")

    def audit_log(self) -> DataFrame:
        rows = self.orders().selectExpr(
            "order_id as audit_id",
            "'ORDERS' as table_name",
            "'INSERT' as operation",
            "order_id as record_id",
            "'SYSTEM' as changed_by",
            "order_date as changed_at",
        )
        return conform(rows, "audit_log")

    # -- earlier versions of the summary tables -------------------------------

    def sales_summary(self) -> DataFrame:
        """Zeroed rows for the days from ten to three days before ``AS_OF`` that
        have orders."""
        first, last = AS_OF.date() - timedelta(days=10), AS_OF.date() - timedelta(days=3)
        days = (
            self.orders(since=midnight(AS_OF) - timedelta(days=10))
            .selectExpr("to_date(order_date) as summary_date")
            .filter(f"summary_date between date'{first}' and date'{last}'")
            .distinct()
        )
        rows = days.selectExpr(
            f"datediff(summary_date, date'{first}') as summary_id",
            "summary_date",
            "0 as total_orders",
            "0 as total_revenue",
            "0 as total_customers",
            "0 as avg_order_value",
            "cast(summary_date as timestamp) as created_at",
        )
        return conform(rows, "sales_summary")

    def customer_analytics(self) -> DataFrame:
        rows = (
            self.customers()
            .filter("customer_id % 2 = 0")
            .selectExpr(
                "customer_id + 1 as analytics_id",
                "customer_id",
                "0 as total_orders",
                "0 as total_spent",
                "0 as avg_order_value",
                "'New' as customer_segment",
                "created_at as calculated_at",
            )
        )
        return conform(rows, "customer_analytics")

    def product_performance(self) -> DataFrame:
        """July rows for every third product, June rows for every fifth."""
        starts = """array_compact(array(if(product_id % 3 = 0, date'2001-07-01', null),
                                        if(product_id % 5 = 0, date'2001-06-01', null)))"""
        rows = (
            self.products()
            .selectExpr("product_id", f"explode({starts}) as period_start")
            .selectExpr(
                "product_id * 2 + if(month(period_start) = 6, 1, 0) as performance_id",
                "product_id",
                "period_start",
                "last_day(period_start) as period_end",
                "0 as units_sold",
                "0 as revenue",
                "0 as profit",
                "0 as return_count",
                "cast(period_start as timestamp) as calculated_at",
            )
        )
        return conform(rows, "product_performance")

    def product_recommendation(self) -> DataFrame:
        rows = self.products().filter("product_id % 3 = 0")
        return conform(
            rows.selectExpr(
                "product_id", "0 as recommendation_score", "timestamp'2001-07-01 00:00:00' as last_analyzed"
            ),
            "product_recommendation",
        )

    # -- request tables for the write jobs ------------------------------------

    def _requests(self, table: DataFrame, key: str, amount: str) -> DataFrame:
        """One request for keys divisible by 11, a second one for those divisible by 22."""
        turns = f"explode(if({key} % 22 = 0, array(1, 2), array(1))) as turn"
        return table.filter(f"{key} % 11 = 0").selectExpr(key, turns).selectExpr(key, amount)

    def restock_requests(self) -> DataFrame:
        return self._requests(self.products(), "product_id", "product_id % 90 + turn * 10 as quantity")

    def adjustment_requests(self) -> DataFrame:
        amount = "if(product_id % 33 = 0, product_id % 200 - 5000, product_id % 100 - 50) + turn as adjustment"
        return self._requests(self.products(), "product_id", amount)

    def point_requests(self) -> DataFrame:
        return self._requests(self.customers(), "customer_id", "customer_id % 70 + turn * 5 as points")

    def reprice_requests(self) -> DataFrame:
        pct = "cast(cast(product_id * 37 % 1000 - 500 as decimal(6,0)) * 0.01 as decimal(6,2)) as pct"
        return self.product_keys().selectExpr("product_id", pct)

    def relocation_requests(self) -> DataFrame:
        return self.product_keys().selectExpr(
            "product_id", "concat('WH-', (product_id + 2) % 5) as warehouse_location"
        )

    def customer_keys(self) -> DataFrame:
        return self.customers().filter("customer_id % 11 = 0").select("customer_id")

    def product_keys(self) -> DataFrame:
        return self.products().filter("product_id % 11 = 0").select("product_id")

    def order_keys(self) -> DataFrame:
        return self.orders().filter("order_id % 7 = 0").select("order_id")

    def status_requests(self) -> DataFrame:
        return self.order_keys().selectExpr("order_id", "'SHIPPED' as status")

    def payment_outcomes(self) -> DataFrame:
        return self.order_keys().selectExpr("order_id", "order_id % 3 != 0 as success")

    def payment_requests(self) -> DataFrame:
        """Payments to open: known orders, and as many orders that do not exist."""
        known = self.order_keys()
        return known.union(known.selectExpr("-order_id - 1")).selectExpr(
            "order_id", "'PAYMENT' as transaction_type", f"{_one_of(GATEWAYS, 'abs(order_id)')} as payment_gateway"
        )

    def refund_keys(self) -> DataFrame:
        return self.transactions().filter("transaction_id % 7 = 0").select("transaction_id")

    def login_requests(self) -> DataFrame:
        signups = self.raw("events").filter("event_type = 'signup'")
        return signups.selectExpr("event_id as login_id", "user_id as customer_id", "cast(ts as timestamp) as login_time")

    def session_touches(self) -> DataFrame:
        """A touch 5 minutes after each click, on the day's session."""
        clicks = self.raw("events").filter("event_type = 'click'")
        touched = "cast(ts as timestamp) + interval '5' minute as touched_at"
        return clicks.selectExpr(f"{_SESSION_ID} as session_id", touched)

    def session_keys(self) -> DataFrame:
        return self.raw("events").filter("event_type = 'error'").selectExpr(f"{_SESSION_ID} as session_id")

    def order_requests(self) -> DataFrame:
        """Order lines to create: those of orders divisible by 100. Line number 7
        asks for a product nobody knows."""
        lines = self.raw("lineitem").filter("l_orderkey % 100 = 0")
        buyers = self.raw("orders").select("o_orderkey", "o_custkey")
        return lines.join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(
            "l_orderkey as request_id",
            "o_custkey as customer_id",
            f"{_METHOD} as payment_method",
            f"l_partkey + if(l_linenumber = 7, {UNKNOWN_PRODUCT_OFFSET}, 0) as product_id",
            "cast(l_quantity as bigint) as quantity",
        )
