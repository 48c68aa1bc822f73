"""Bringing child tables to order grain before they meet the orders.

Children are summed per order first: map-side combining shrinks an order that owns a large
share of the rows to one row per task, and the join that follows cannot fan out. Row-weighted
results (an average over payment rows, say) are kept exact by carrying counts along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def scoped(per_order: DataFrame, orders: DataFrame | None) -> DataFrame:
    """Rows of a per-order table whose order is among ``orders``; all of them without it.

    Meant for a table already grouped by order. While the ids are small enough to broadcast,
    by Spark's own measure, the semi join is moved below the grouping and thins the scan;
    beyond that the grouping combines first and a Bloom filter of bounded size thins the scan.
    """
    if orders is None:
        return per_order
    return per_order.join(orders.select("order_id"), "order_id", "left_semi")


def payment_totals(payments: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    totals = payments.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_payments"),
        F.count("payment_value").alias("n_values"),
        F.sum("payment_value").alias("paid"),
        F.max("payment_type").alias("payment_type"))
    return scoped(totals, orders)


def review_totals(reviews: DataFrame, orders: DataFrame | None = None) -> DataFrame:
    totals = reviews.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("n_reviews"),
        F.count("review_score").alias("n_scores"),
        F.sum("review_score").alias("score_sum"))
    return scoped(totals, orders)


def fan_out(count: str) -> Column:
    """Rows a left join would have produced for an order with ``count`` children."""
    return F.greatest(F.coalesce(F.col(count), F.lit(0)), F.lit(1))


def with_segments(df: DataFrame, column: str | None) -> DataFrame:
    """One copy of each row for the total and one for its own segment, if it has one.

    An in-place generator, so a partitioning by order or customer survives.
    """
    if column is None:
        return df.withColumn("segment", F.lit("ALL"))
    labels = F.when(F.col(column).isNull(), F.array(F.lit("ALL"))).otherwise(
        F.array(F.lit("ALL"), F.col(column)))
    return df.withColumn("segment", F.explode(labels))
