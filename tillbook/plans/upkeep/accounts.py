"""Customers, products and sessions."""

from __future__ import annotations

from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.functions.dates import stamp
from tillbook.operators.versions import one_per_key, updated, updated_where, without_where
from tillbook.schema import FINISHED, conform


def calculate_loyalty(customers: DataFrame, orders: DataFrame, as_of: datetime) -> DataFrame:
    """Points and tier of every customer from completed and delivered orders:
    ten points per unit of money, cut to whole points, and fifty per order."""
    stats = (
        orders.filter(F.col("status").isin(*FINISHED))
        .groupBy("customer_id")
        .agg(F.sum("total_amount").alias("spent"), F.count(F.lit(1)).alias("orders_made"))
    )
    earned = F.coalesce((F.col("spent") * 10).cast("long"), F.lit(0)) + F.coalesce("orders_made", F.lit(0)) * 50
    points = F.col("earned")
    tier = (
        F.when(points >= 50000, "PLATINUM").when(points >= 20000, "GOLD").when(points >= 5000, "SILVER").otherwise("BRONZE")
    )
    scored = customers.join(stats, "customer_id", "left").withColumn("earned", earned)
    # Every customer changes, so the totals are joined once and nothing is looked up.
    values = {"loyalty_points": points, "customer_type": tier, "updated_at": stamp(as_of)}
    return updated_where(scored, F.lit(True), values).select(*customers.columns)


def add_loyalty_points(customers: DataFrame, requests: DataFrame, as_of: datetime) -> DataFrame:
    changes = requests.groupBy("customer_id").agg(F.sum("points").alias("added"))
    values = {"loyalty_points": F.col("loyalty_points") + F.col("added"), "updated_at": stamp(as_of)}
    return updated(customers, changes, "customer_id", values)


def upgrade_customers(customers: DataFrame, keys: DataFrame, as_of: datetime) -> DataFrame:
    """Listed customers of type REGULAR become PREMIUM."""
    regular = F.col("customer_type") == "REGULAR"
    values = {
        "customer_type": F.when(regular, "PREMIUM").otherwise(F.col("customer_type")),
        "updated_at": F.when(regular, stamp(as_of)).otherwise(F.col("updated_at")),
    }
    return updated(customers, keys.select("customer_id").distinct(), "customer_id", values)


def reprice_products(products: DataFrame, requests: DataFrame) -> DataFrame:
    """Change prices by ``pct`` percent, rounded to cents; ``requests``: product_id, pct
    and, where a product may occur twice, request_no: the last request counts."""
    requests = one_per_key(requests, ["product_id"])
    factor = F.col("pct") * F.lit(Decimal("0.01")) + 1
    return updated(products, requests, "product_id", {"price": F.round(F.col("price") * factor, 2)})


def deactivate_products(products: DataFrame, keys: DataFrame) -> DataFrame:
    return updated(products, keys.select("product_id").distinct(), "product_id", {"is_active": F.lit(0)})


def create_sessions(logins: DataFrame) -> DataFrame:
    """New active sessions; ``logins``: login_id, customer_id, login_time. The
    session id is a hash of the login, so a rerun repeats it."""
    key = F.concat_ws("|", F.col("login_id").cast("string"), F.col("customer_id").cast("string"))
    rows = logins.select(
        F.sha2(key, 256).alias("session_id"),
        "customer_id",
        "login_time",
        F.col("login_time").alias("last_activity"),
        F.lit(1).alias("is_active"),
    )
    return conform(rows, "session_data")


def touch_sessions(sessions: DataFrame, touches: DataFrame) -> DataFrame:
    """Set the last activity of touched sessions to their latest touch."""
    changes = touches.groupBy("session_id").agg(F.max("touched_at").alias("touched_at"))
    return updated(sessions, changes, "session_id", {"last_activity": F.col("touched_at")})


def expire_sessions(sessions: DataFrame, keys: DataFrame) -> DataFrame:
    return updated(sessions, keys.select("session_id").distinct(), "session_id", {"is_active": F.lit(0)})


def _idle(as_of: datetime, hours: int) -> Column:
    return F.col("last_activity") < stamp(as_of - timedelta(hours=hours))


def _idle_and_active(as_of: datetime) -> Column:
    return (F.col("is_active") == 1) & _idle(as_of, 1)


def expire_idle_sessions(sessions: DataFrame, as_of: datetime) -> DataFrame:
    """Active sessions idle for more than an hour become inactive."""
    return updated_where(sessions, _idle_and_active(as_of), {"is_active": F.lit(0)})


def expire_idle_sessions_count(sessions: DataFrame, as_of: datetime) -> DataFrame:
    return sessions.agg(F.count_if(_idle_and_active(as_of)).alias("sessions_expired"))


def _expired(as_of: datetime) -> Column:
    return (F.col("is_active") == 0) | _idle(as_of, 2)


def delete_expired_sessions(sessions: DataFrame, as_of: datetime) -> DataFrame:
    """Drop sessions that are inactive or idle for more than two hours."""
    return without_where(sessions, _expired(as_of))


def delete_expired_sessions_count(sessions: DataFrame, as_of: datetime) -> DataFrame:
    return sessions.agg(F.count_if(_expired(as_of)).alias("sessions_deleted"))
