"""Business measures over the flat order fact, in total, per day, or per any attribute."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.functions import mean_of, percent
from tidemark.operators.rollup import calendar_window


def _order_flags(fact: DataFrame, by: list[str]) -> DataFrame:
    """One row per order within ``by``: every distinct count becomes a sum of flags."""
    def flag(test: Column) -> Column:
        return F.max(F.when(test, 1).otherwise(0))
    csat = F.col("csat_review_score")
    return fact.groupBy(*by, "order_id").agg(
        F.sum("order_revenue").alias("revenue"),
        flag(F.col("order_status") == "delivered").alias("delivered"),
        flag(F.col("is_on_time") == 1).alias("on_time"),
        flag(F.col("is_on_time") == 0).alias("breach"),
        flag(csat == 5).alias("promoter"),
        flag(csat.isin(1.0, 2.0)).alias("detractor"),
        F.sum(F.col("delivery_days").cast("decimal(20,1)")).alias("days_sum"),
        F.count("delivery_days").alias("days_n"),
        F.sum(csat.cast("decimal(20,6)")).alias("csat_sum"),
        F.count(csat).alias("csat_n"))


def measures(fact: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Revenue, order, punctuality and satisfaction measures per ``by`` (all rows if empty).

    On-time orders are counted whatever their status, so their rate over delivered orders
    can exceed 100.
    """
    by = by or []
    m = _order_flags(fact, by).groupBy(*by).agg(
        F.sum("revenue").alias("total_revenue"),
        F.count("order_id").alias("total_orders"),
        F.sum("delivered").alias("delivered_orders"),
        F.sum("on_time").alias("on_time_orders"),
        F.sum("breach").alias("sla_breaches"),
        F.sum("promoter").alias("promoters"),
        F.sum("detractor").alias("detractors"),
        mean_of(F.sum("days_sum"), F.sum("days_n")).alias("avg_delivery_days"),
        mean_of(F.sum("csat_sum"), F.sum("csat_n")).alias("avg_csat"))
    return (m.withColumn("aov", F.coalesce(mean_of(F.col("total_revenue"),
                                                   F.col("total_orders")), F.lit(0.0)))
            .withColumn("on_time_rate_pct",
                        percent(F.col("on_time_orders"), F.col("delivered_orders")))
            .withColumn("net_csat_pct", percent(F.col("promoters") - F.col("detractors"),
                                                F.col("total_orders"))))


def daily_average_revenue(fact: DataFrame) -> DataFrame:
    """Mean over distinct days of the day's revenue."""
    days = fact.groupBy("order_date").agg(F.sum("order_revenue").alias("revenue"))
    return days.agg(mean_of(F.sum("revenue"), F.count("revenue"))
                    .alias("daily_average_revenue"))


def daily_measures(fact: DataFrame, by: str | None = None) -> DataFrame:
    """Day-by-day measures with period comparisons, control limits and the anomaly flag.

    Comparisons look at calendar days: a missing day has no prior revenue rather than
    borrowing that of the nearest one.
    """
    keys = [by] if by else []
    daily = measures(fact, [*keys, "order_date"])

    def frame(first, last):
        return calendar_window(keys, first, last, "order_date")

    def on_day(offset):
        return F.sum("total_revenue").over(frame(-offset, -offset))

    revenue = F.col("total_revenue").cast("double")
    fortnight = frame(-13, 0)
    prior = F.col("prior_day").cast("double")
    growth = F.when(prior.isNull() | (prior == 0), 0.0).otherwise(
        (revenue - prior) / prior * 100.0)
    return (daily.withColumn("prior_period_revenue", on_day(7))
            .withColumn("prior_day", on_day(1))
            .withColumn("rolling_mean_14d", mean_of(F.sum("total_revenue").over(fortnight),
                                                    F.count("total_revenue").over(fortnight)))
            .withColumn("rolling_std_14d", F.stddev_pop(revenue).over(fortnight))
            .withColumn("dod_growth_pct", growth)
            .withColumn("ucl", F.col("rolling_mean_14d") + 2.0 * F.col("rolling_std_14d"))
            .withColumn("lcl", F.greatest(F.lit(0.0), F.col("rolling_mean_14d")
                                          - 2.0 * F.col("rolling_std_14d")))
            .withColumn("anomaly", F.when((F.col("dod_growth_pct") < -15.0)
                                          | (F.col("on_time_rate_pct") < 85.0),
                                          "CRITICAL ALERT").otherwise("HEALTHY"))
            .drop("prior_day"))


def integrity_score(log: DataFrame) -> DataFrame:
    """Mean score over the rows of an audit log."""
    return log.agg(F.avg("score").alias("dq_integrity_score_pct"))
