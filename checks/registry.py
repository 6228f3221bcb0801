"""Every query by name, bound to the test tables and the fixed ``as_of``.

``any_order`` skips the adapter's own check of lines against orders where the
plan joins the orders anyway; a start passed to ``orders`` or ``transactions``
lets the scan skip older files and row groups.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.functions.dates import days_before, midnight, month_start, shift_months
from tillbook.plans import customers, lookups, procedures, products, reports, sales, warehouse
from tillbook.plans.upkeep import accounts, ordering, payments, purging, stock, summaries
from tillbook.session import shared_folder
from tillbook.sources.parquet_store import ParquetStore
from checks.testbed import AS_OF, GATEWAYS, SESSIONS_AS_OF, Testbed
from tillbook.streaming import activity
from tillbook.streaming.daily_totals import DailyTotals

Plan = Callable[[Testbed], DataFrame]

TODAY = midnight(AS_OF)
RESTOCK_QUANTITY = 300


def _days(count: int) -> datetime:
    return days_before(AS_OF, count)


def _months(count: int) -> datetime:
    return shift_months(AS_OF, -count)


def _job_folder(t: Testbed, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


def _stream_sales_summary(t: Testbed) -> DataFrame:
    job = DailyTotals(t.spark, _job_folder(t, "daily-totals"), AS_OF, t.sales_summary())
    job.start(t.order_stream()).awaitTermination()
    return job.summary().drop("summary_id")


def _stream_session_activity(t: Testbed) -> DataFrame:
    folder = _job_folder(t, "activity")
    activity.start(t.event_stream(), folder).awaitTermination()
    return activity.all_sessions(t.spark, folder)


def _written(t: Testbed) -> DataFrame:
    """Stock after a restock, written as the second version and read back."""
    store = ParquetStore(t.spark, _job_folder(t, "store"))
    store.write(t.inventory(), "inventory")
    store.write(stock.restock_low(store.read("inventory"), AS_OF), "inventory")
    return store.read("inventory")


def _erased(t: Testbed, doomed: Column, table: str) -> DataFrame:
    """A table of a store after a purge by key sets."""
    store = ParquetStore(t.spark, _job_folder(t, "store"))
    store.commit({"orders": t.orders(), "order_items": t.order_items(), "transactions": t.transactions()})
    purging.erase(store, doomed)
    return store.read(table)


REPORTS: dict[str, Plan] = {
    "sales_daily_summary": lambda t: sales.daily_summary(t.orders(_days(30)), t.order_items(True), AS_OF),
    "sales_monthly_trend": lambda t: sales.monthly_trend(t.orders(_months(12)), AS_OF),
    "sales_by_category": lambda t: sales.by_category(
        t.order_items(True), t.products(), t.orders(_days(30)), AS_OF
    ),
    "sales_top_products": lambda t: sales.top_products(
        t.products(), t.order_items(True), t.orders(_days(90)), AS_OF
    ),
    "sales_by_payment_method": lambda t: sales.by_payment_method(
        t.orders(_days(30)), t.transactions(_days(30)), AS_OF
    ),
    "sales_by_hour": lambda t: sales.by_hour(t.orders(_days(7)), AS_OF),
    "customer_segmentation": lambda t: customers.segmentation(t.customers(), t.orders()),
    "customer_lifetime_value": lambda t: customers.lifetime_value(t.customers(), t.orders(), AS_OF),
    "customer_retention": lambda t: customers.retention(t.orders(_months(12)), AS_OF),
    "customer_high_value": lambda t: customers.high_value(t.customers(), t.orders(), t.order_items(True)),
    "customer_purchase_frequency": lambda t: customers.purchase_frequency(t.customers(), t.orders()),
    "product_performance": lambda t: products.performance(t.products(), t.order_items(), t.inventory()),
    "inventory_turnover": lambda t: products.inventory_turnover(t.products(), t.inventory(), t.order_items()),
    "slow_moving_products": lambda t: products.slow_moving(t.products(), t.inventory(), t.order_items()),
    "profit_margin_by_category": lambda t: products.margin_by_category(
        t.products(), t.order_items(True), t.orders(_days(90)), AS_OF
    ),
    "product_affinity": lambda t: products.affinity(
        t.order_items(True), t.products(), t.orders(_days(60)), AS_OF
    ),
    "product_revenue_growth": lambda t: products.revenue_growth(
        t.products(), t.order_items(True), t.orders(_months(6)), AS_OF
    ),
    "executive_dashboard": lambda t: reports.executive_dashboard(
        t.orders(month_start(AS_OF)), t.customers(), AS_OF
    ),
    "sales_report": lambda t: reports.sales_report(t.orders(_days(30)), t.order_items(True), AS_OF),
    "inventory_report": lambda t: reports.inventory_report(
        t.products(), t.inventory(), t.order_items(True), t.orders(_days(30)), AS_OF
    ),
    "customer_report": lambda t: reports.customer_report(t.customers(), t.orders(), AS_OF),
    "transaction_report": lambda t: reports.transaction_report(t.transactions(_days(30)), AS_OF),
    "full_table_scan": lambda t: warehouse.newest_orders(t.customers(), t.orders(), t.order_items(True)),
    "complex_join": lambda t: warehouse.customer_activity(
        t.customers(),
        t.orders(_days(90)),
        t.order_items(True),
        t.transactions(_days(90)),
        t.products(),
        t.inventory(),
        AS_OF,
    ),
    "customer_data": lambda t: warehouse.customer_data(
        t.customers(),
        t.orders(_months(24)),
        t.order_items(since=_months(24)),
        t.products(),
        t.inventory(),
        t.transactions(_months(24)),
        AS_OF,
    ),
    "sales_trend": lambda t: procedures.sales_trend(t.orders(days_before(TODAY, 30)), AS_OF),
    "customer_cohort": lambda t: procedures.customer_cohort(t.customers(), t.orders(), AS_OF),
    "product_recommendation": lambda t: procedures.product_recommendation(t.order_items()),
    "product_recommendation_one": lambda t: procedures.product_recommendation(t.order_items(), 77),
    "inventory_forecast": lambda t: procedures.inventory_forecast(
        t.inventory(), t.order_items(True), t.orders(_days(30)), AS_OF
    ),
    "revenue_reconciliation": lambda t: procedures.revenue_reconciliation(
        t.orders(days_before(TODAY, 7)), t.transactions(days_before(TODAY, 7)), AS_OF
    ),
}

LOOKUPS: dict[str, Plan] = {
    "order_count": lambda t: lookups.order_count(t.orders()),
    "order_max_id": lambda t: lookups.order_max_id(t.orders()),
    "customer_count": lambda t: lookups.customer_count(t.customers()),
    "customer_email_lookup": lambda t: lookups.customer_email_lookup(
        t.customers(), t.orders().select("customer_id").distinct()
    ),
    "product_details": lambda t: lookups.product_details(t.products()),
    "product_search_by_category": lambda t: lookups.product_search_by_category(t.products(), "ECONOMY"),
    "active_product_count": lambda t: lookups.active_product_count(t.products()),
    "active_session_count": lambda t: lookups.active_session_count(t.session_data()),
    "session_count_by_customer": lambda t: lookups.session_count_by_customer(t.session_data()),
    "customer_transaction_total": lambda t: lookups.customer_transaction_total(t.orders(), t.transactions()),
    "failed_transaction_count": lambda t: lookups.failed_transaction_count(t.transactions()),
    "inventory_availability": lambda t: lookups.inventory_availability(t.inventory()),
    "table_row_counts": lambda t: lookups.table_row_counts(
        customers=t.customers(), products=t.products(), orders=t.orders(), order_items=t.order_items()
    ),
}


def _purge(t: Testbed, job: str) -> purging.Purge:
    tables = (t.orders(), t.order_items(), t.transactions())
    if job == "dead":
        return purging.dead_orders(*tables)
    return {"old": purging.old_orders, "age": purging.orders_by_age}[job](*tables, AS_OF)


def _purge_queries(name: str, job: str) -> dict[str, Plan]:
    return {
        name: lambda t: _purge(t, job).counts,
        f"{name}_orders": lambda t: _purge(t, job).orders,
        f"{name}_items": lambda t: _purge(t, job).items,
        f"{name}_transactions": lambda t: _purge(t, job).transactions,
    }


def _created(t: Testbed, service: bool) -> ordering.NewOrders:
    price = None if service else ordering.UNKNOWN_PRICE
    return ordering.create_orders(
        t.order_requests(), t.products(), t.orders(), t.order_items(), t.audit_log(), AS_OF, price
    )


def _placed(t: Testbed) -> ordering.NewOrders:
    gateway = F.get(F.array(*[F.lit(g) for g in GATEWAYS]), F.pmod("order_id", F.lit(len(GATEWAYS))).cast("int"))
    return ordering.place_orders(
        t.order_requests(), t.products(), t.orders(), t.order_items(), t.audit_log(), t.transactions(), t.inventory(), AS_OF, gateway
    )


def _create_queries(name: str, service: bool) -> dict[str, Plan]:
    return {
        name: lambda t: _created(t, service).orders,
        f"{name}_items": lambda t: _created(t, service).items.drop("order_item_id"),
        f"{name}_audit": lambda t: _created(t, service).audit.drop("audit_id"),
    }


def _paid(t: Testbed) -> tuple[DataFrame, DataFrame]:
    return payments.process_payments(t.transactions(), t.orders(), t.payment_outcomes(), AS_OF)


UPKEEP: dict[str, Plan] = {
    "merge_sales_summary": lambda t: summaries.merge_sales_summary(
        t.sales_summary(), t.orders(days_before(TODAY, 7)), AS_OF
    ).drop("summary_id"),
    "merge_customer_analytics": lambda t: summaries.merge_customer_analytics(
        t.customer_analytics(), t.customers(), t.orders(), AS_OF
    ).drop("analytics_id"),
    "merge_product_performance": lambda t: summaries.merge_product_performance(
        t.product_performance(), t.products(), t.order_items(), AS_OF
    ).drop("performance_id"),
    "upsert_sales_trend": lambda t: summaries.upsert_sales_trend(
        t.sales_summary(), t.orders(days_before(TODAY, 30)), AS_OF
    ).drop("summary_id"),
    "upsert_recommendation": lambda t: summaries.upsert_recommendation(
        t.product_recommendation(), t.order_items(), AS_OF
    ),
    "replace_daily_sales_summary": lambda t: summaries.replace_daily_sales_summary(
        t.sales_summary(), t.orders(_days(11)), days_before(AS_OF, 5).date(), AS_OF
    ).drop("summary_id"),
    **_purge_queries("purge_old_orders", "old"),
    **_purge_queries("delete_cancelled_orders", "dead"),
    **_purge_queries("purge_orders_by_age", "age"),
    "purge_audit_log": lambda t: purging.audit_log(t.audit_log(), AS_OF),
    "purge_audit_log_count": lambda t: purging.audit_log_count(t.audit_log(), AS_OF),
    "restock_low_inventory": lambda t: stock.restock_low(t.inventory(), AS_OF),
    "restock_low_inventory_count": lambda t: stock.restock_low_count(t.inventory()),
    "auto_restock": lambda t: stock.auto_restock(t.inventory(), AS_OF, RESTOCK_QUANTITY),
    "restock_products": lambda t: stock.restock(t.inventory(), t.restock_requests(), AS_OF),
    "relocate_inventory": lambda t: stock.relocate(t.inventory(), t.relocation_requests(), AS_OF),
    "reserve_inventory": lambda t: stock.reserve(t.inventory(), t.order_items(), t.order_keys(), AS_OF),
    "release_inventory": lambda t: stock.release(t.inventory(), t.order_items(), t.order_keys(), AS_OF),
    "adjust_inventory": lambda t: stock.adjust(t.inventory(), t.adjustment_requests(), AS_OF),
    "bulk_update_inventory": lambda t: stock.bulk_adjust(t.inventory(), t.adjustment_requests(), AS_OF),
    "calculate_loyalty": lambda t: accounts.calculate_loyalty(t.customers(), t.orders(), AS_OF),
    "add_loyalty_points": lambda t: accounts.add_loyalty_points(t.customers(), t.point_requests(), AS_OF),
    "upgrade_customers": lambda t: accounts.upgrade_customers(t.customers(), t.customer_keys(), AS_OF),
    **_create_queries("create_orders", service=False),
    **_create_queries("create_orders_service", service=True),
    "place_orders_transactions": lambda t: _placed(t).transactions.drop("transaction_id", "gateway_transaction_id"),
    "place_orders_inventory": lambda t: _placed(t).inventory,
    "order_totals": lambda t: ordering.order_totals(t.orders(), t.order_items(), t.order_keys(), AS_OF),
    "update_order_status": lambda t: ordering.update_status(t.orders(), t.status_requests(), AS_OF),
    "create_transactions": lambda t: payments.create_transactions(
        t.payment_requests(), t.orders(), t.transactions(), AS_OF
    ).drop("transaction_id", "gateway_transaction_id"),
    "process_payments": lambda t: _paid(t)[0],
    "process_payments_orders": lambda t: _paid(t)[1],
    "refund_transactions": lambda t: payments.refund_transactions(t.transactions(), t.refund_keys(), AS_OF).drop(
        "transaction_id", "gateway_transaction_id"
    ),
    "create_sessions": lambda t: accounts.create_sessions(t.login_requests()).drop("session_id"),
    "touch_sessions": lambda t: accounts.touch_sessions(t.session_data(), t.session_touches()),
    "expire_sessions": lambda t: accounts.expire_sessions(t.session_data(), t.session_keys()),
    "expire_idle_sessions": lambda t: accounts.expire_idle_sessions(t.session_data(), SESSIONS_AS_OF),
    "expire_idle_sessions_count": lambda t: accounts.expire_idle_sessions_count(t.session_data(), SESSIONS_AS_OF),
    "delete_expired_sessions": lambda t: accounts.delete_expired_sessions(t.session_data(), SESSIONS_AS_OF),
    "delete_expired_sessions_count": lambda t: accounts.delete_expired_sessions_count(
        t.session_data(), SESSIONS_AS_OF
    ),
    "reprice_products": lambda t: accounts.reprice_products(t.products(), t.reprice_requests()),
    "deactivate_products": lambda t: accounts.deactivate_products(t.products(), t.product_keys()),
    "append_audit_log": lambda t: ordering.append_audit_log(
        t.audit_log(), ordering.customer_access(t.customer_keys()), AS_OF
    ).drop("audit_id"),
}

SOURCES: dict[str, Plan] = {
    "src_parquet": lambda t: t.order_items(),
    "sink_parquet": _written,
    "erase_old_orders": lambda t: _erased(t, purging.is_old(AS_OF), "orders"),
    "erase_cancelled_orders": lambda t: _erased(t, purging.is_dead(), "order_items"),
    "erase_orders_by_age": lambda t: _erased(t, purging.past_keeping(AS_OF), "transactions"),
    "stream_sales_summary": _stream_sales_summary,
    "stream_session_activity": _stream_session_activity,
}

QUERIES: dict[str, Plan] = {**REPORTS, **LOOKUPS, **UPKEEP, **SOURCES}
