"""Quick looks at what the order table covers."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from tidemark.functions import since
from tidemark.operators.ordergrain import payment_totals
from tidemark.schemas import CANCELED


def date_extent(orders: DataFrame) -> DataFrame:
    """First and last purchase timestamp; one row."""
    return orders.agg(F.min("purchase_ts").alias("min_date"),
                      F.max("purchase_ts").alias("max_date"))


def recent_distribution(orders: DataFrame, payments: DataFrame, asof: date,
                        days: int = 7) -> DataFrame:
    """Payment rows (an unpaid order counts one) and revenue per day, newest first."""
    recent = orders.filter(since("purchase_ts", asof, days)).select("order_id", "purchase_ts")
    totals = payment_totals(payments, recent)
    return (recent.join(totals, "order_id", "left")
            .groupBy(F.to_date("purchase_ts").alias("day"))
            .agg(F.sum(F.coalesce("n_payments", F.lit(1))).alias("row_count"),
                 F.sum("paid").alias("revenue"))
            .orderBy(F.desc("day")))


def recent_history(orders: DataFrame, payments: DataFrame, asof: date,
                   days: int = 14) -> DataFrame:
    """Per-day revenue and order count of orders that were not canceled, newest first.

    Revenue is NULL on a day whose orders have no payment.
    """
    recent = (orders.filter(since("purchase_ts", asof, days))
              .filter(F.col("order_status") != CANCELED)
              .select("order_id", F.to_date("purchase_ts").alias("day")))
    totals = payment_totals(payments, recent)
    return (recent.join(totals, "order_id", "left")
            .groupBy("order_id", "day").agg(F.sum("paid").alias("paid"))
            .groupBy("day").agg(F.sum("paid").alias("revenue"),
                                F.count(F.lit(1)).alias("order_volume"))
            .orderBy(F.desc("day")))
