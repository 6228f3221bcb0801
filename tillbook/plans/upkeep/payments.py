"""Payments: opening, settling and refunding transactions."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.functions.dates import stamp
from tillbook.operators.versions import one_per_key, updated, with_next_ids
from tillbook.plans.upkeep import ordering
from tillbook.schema import conform

# Fixed value: message of a declined payment.
DECLINED = "Payment declined - insufficient funds"


def _reference(as_of: datetime, *parts: str) -> Column:
    """Gateway reference derived from the request, so that a rerun repeats it."""
    return F.sha2(F.concat_ws("|", F.lit(as_of.isoformat()), *(F.col(p).cast("string") for p in parts)), 256)


def create_transactions(
    requests: DataFrame, orders: DataFrame, transactions: DataFrame, as_of: datetime
) -> DataFrame:
    """Pending transactions to append; ``requests``: order_id, transaction_type,
    payment_gateway. The amount is the order's total, NULL for an unknown order."""
    totals = orders.select("order_id", F.col("total_amount").alias("amount"))
    rows = requests.join(totals, "order_id", "left").withColumns(
        {
            "gateway_transaction_id": _reference(as_of, "order_id", "transaction_type", "payment_gateway"),
            "status": F.lit("PENDING"),
            "currency": F.lit("USD"),
            "processed_at": stamp(as_of),
        }
    )
    return conform(with_next_ids(rows, transactions, "transaction_id"), "transactions")


def process_payments(
    transactions: DataFrame, orders: DataFrame, outcomes: DataFrame, as_of: datetime
) -> tuple[DataFrame, DataFrame]:
    """Settle the pending transactions of the listed orders and move every listed
    order on, even one without a pending transaction.

    ``outcomes``: order_id, success and, where an order may occur twice, request_no:
    the last outcome counts. Returns the next versions of transactions and orders.
    """
    outcomes = one_per_key(outcomes, ["order_id"])
    pending = F.col("status") == "PENDING"
    paid = F.col("success")

    def settled(column: str, value: Column) -> Column:
        return F.when(pending, value).otherwise(F.col(column))

    values = {
        "status": settled("status", F.when(paid, "COMPLETED").otherwise("FAILED")),
        "error_message": settled("error_message", F.when(~paid, DECLINED)),
        "processed_at": settled("processed_at", stamp(as_of)),
    }
    moved = outcomes.select("order_id", F.when(paid, "COMPLETED").otherwise("PAYMENT_FAILED").alias("status"))
    return updated(transactions, outcomes, "order_id", values), ordering.update_status(orders, moved, as_of)


def refund_transactions(transactions: DataFrame, keys: DataFrame, as_of: datetime) -> DataFrame:
    """Completed refunds to append, one per listed transaction."""
    listed = transactions.join(keys.select("transaction_id").distinct(), "transaction_id", "left_semi")
    rows = listed.select(
        "order_id",
        F.lit("REFUND").alias("transaction_type"),
        (-F.col("amount")).alias("amount"),
        "currency",
        "payment_gateway",
        F.concat(F.lit("REFUND-"), _reference(as_of, "transaction_id")).alias("gateway_transaction_id"),
        F.lit("COMPLETED").alias("status"),
        stamp(as_of).alias("processed_at"),
    )
    return conform(with_next_ids(rows, transactions, "transaction_id"), "transactions")
