"""Reporting views and extracts."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from tidemark.functions import (
    days_between, elapsed_micros, in_days, mean_of, percent, round_to, since)
from tidemark.operators.ordergrain import fan_out, payment_totals, review_totals


def cents_mean(total, count):
    """Mean of a money total rounded to cents, from whole cents so that ties stay exact."""
    return F.floor(mean_of(total * 100, count) + 0.5) / 100.0


def order_fact(orders: DataFrame, customers: DataFrame, payments: DataFrame,
               reviews: DataFrame, part: bool = False) -> DataFrame:
    """One flat row per order. An order without review scores 0 in ``csat_review_score`` and
    NULL in ``csat_score_known``. ``part`` says that ``orders`` is a part of the table, to
    which the children are then limited.

    Customers join first: the exchange by order that follows is needed anyway, so a customer
    owning a large share of the orders can be split there freely.
    """
    on_time = F.col("delivered_ts") <= F.col("estimated_ts")
    csat = mean_of(F.col("score_sum"), F.col("n_scores"))
    scope = orders if part else None
    return (orders.join(customers.select("customer_id", "customer_city", "customer_state"),
                        "customer_id", "left")
            .join(payment_totals(payments, scope).drop("n_payments", "n_values"), "order_id",
                  "left")
            .join(review_totals(reviews, scope), "order_id", "left")
            .select("order_id", "customer_id", "customer_city", "customer_state",
                    "order_status", "purchase_ts",
                    F.to_date("purchase_ts").alias("order_date"),
                    F.date_format("purchase_ts", "yyyy-MM").alias("order_year_month"),
                    F.date_format("purchase_ts", "HH").alias("order_hour"),
                    "delivered_ts", "estimated_ts",
                    round_to(days_between(F.col("delivered_ts"), F.col("purchase_ts")), 1)
                    .alias("delivery_days"),
                    F.when(on_time, 1).when(~on_time, 0).alias("is_on_time"),
                    F.coalesce("paid", F.lit(0).cast("decimal(28,2)")).alias("order_revenue"),
                    F.coalesce("payment_type", F.lit("unspecified")).alias("payment_method"),
                    F.coalesce(csat, F.lit(0.0)).alias("csat_review_score"),
                    csat.alias("csat_score_known")))


def recent_orders(fact: DataFrame, asof: date, days: int = 90) -> DataFrame:
    return (fact.filter(since("purchase_ts", asof, days))
            .orderBy(F.desc("purchase_ts"), "order_id"))


def recent_order_fact(orders, customers, payments, reviews, asof: date,
                      days: int = 90) -> DataFrame:
    """``recent_orders`` with the date limit applied before the children are read."""
    o = orders.filter(since("purchase_ts", asof, days))
    fact = order_fact(o, customers, payments, reviews, part=True)
    return fact.orderBy(F.desc("purchase_ts"), "order_id")


def daily_summary(orders: DataFrame, payments: DataFrame, part: bool = False) -> DataFrame:
    """Daily totals; averages and rates weigh payment rows, an unpaid order weighing one.

    ``part`` says that ``orders`` is a part of the table, to which payments are then limited.
    """
    weight = fan_out("n_payments").cast("decimal(18,0)")
    delivered, bought = F.col("delivered_ts"), F.col("purchase_ts")
    micros = elapsed_micros(delivered, bought).cast("decimal(20,0)")
    per_order = (
        orders.filter(bought.isNotNull())
        .join(payment_totals(payments, orders if part else None), "order_id", "left")
        .groupBy(F.to_date("purchase_ts").alias("report_date"), "order_id")
        .agg(F.max(F.when(F.col("order_status") == "delivered", 1).otherwise(0))
             .alias("delivered"),
             F.sum("paid").alias("paid"), F.sum("n_values").alias("n_values"),
             F.sum(micros * weight).alias("micros"),
             F.sum(F.when(delivered.isNotNull(), weight)).alias("w_delivered"),
             F.sum(F.when(delivered <= F.col("estimated_ts"), weight)).alias("w_on_time")))
    w = F.sum("w_delivered")
    return per_order.groupBy("report_date").agg(
        F.count("order_id").alias("total_orders"),
        F.sum("delivered").alias("delivered_orders"),
        F.sum("paid").alias("daily_revenue"),
        cents_mean(F.sum("paid"), F.sum("n_values")).alias("average_order_value"),
        round_to(in_days(F.sum("micros")) / w.cast("double"), 1)
        .alias("avg_delivery_time_days"),
        round_to(F.when(w > 0, percent(F.coalesce(F.sum("w_on_time"), F.lit(0)), w)), 1)
        .alias("on_time_delivery_rate_pct"))


def daily_extract(orders: DataFrame, payments: DataFrame) -> DataFrame:
    return daily_summary(orders, payments).orderBy(F.desc("report_date"))


def regional_summary(orders: DataFrame, customers: DataFrame, payments: DataFrame,
                     reviews: DataFrame, asof: date, days: int = 90, min_orders: int = 3,
                     grain: str = "joined") -> DataFrame:
    """Orders, revenue, mean payment and mean review score per (state, city).

    ``grain='joined'`` gives what joining orders with payments and reviews yields, where
    each payment counts once per review of its order and each review once per payment;
    ``grain='order'`` counts each payment and review once. Neither builds the product: the
    counts of the other side serve as weights.
    """
    o = orders.filter(since("purchase_ts", asof, days))
    joined = (o.join(customers.select("customer_id", "customer_state", "customer_city"),
                     "customer_id")
              .join(payment_totals(payments, o), "order_id", "left")
              .join(review_totals(reviews, o), "order_id", "left"))
    if grain == "joined":
        by_review, by_payment = fan_out("n_reviews"), fan_out("n_payments")
    else:
        by_review = by_payment = F.lit(1)
    per_order = joined.groupBy("customer_state", "customer_city", "order_id").agg(
        F.sum(F.col("paid") * by_review.cast("decimal(9,0)")).alias("paid"),
        F.sum(F.col("n_values") * by_review).alias("n_values"),
        F.sum(F.col("score_sum") * by_payment).alias("score_sum"),
        F.sum(F.col("n_scores") * by_payment).alias("n_scores"))
    return (per_order.groupBy("customer_state", "customer_city")
            .agg(F.count("order_id").alias("total_orders"),
                 F.sum("paid").alias("state_revenue"),
                 cents_mean(F.sum("paid"), F.sum("n_values")).alias("state_aov"),
                 round_to(mean_of(F.sum("score_sum"), F.sum("n_scores")), 2)
                 .alias("avg_csat"))
            .filter(F.col("total_orders") >= min_orders)
            .orderBy(F.desc("state_revenue"), "customer_state", "customer_city"))


def register_views(fact: DataFrame, daily: DataFrame) -> None:
    """Name the two reporting views for SQL users."""
    fact.createOrReplaceTempView("vw_operational_orders")
    daily.createOrReplaceTempView("vw_daily_kpis")
