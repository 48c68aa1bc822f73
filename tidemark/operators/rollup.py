"""Daily operational rollup: the shared intermediate of the series operators."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window, functions as F

from tidemark.functions import elapsed_micros, in_days, mean_of, since
from tidemark.operators.ordergrain import fan_out, payment_totals, with_segments
from tidemark.schemas import DELIVERED, VALUE


def daily_rollup(orders: DataFrame, payments: DataFrame, asof: date | None = None,
                 lookback: int | None = None, segment: str | None = None) -> DataFrame:
    """Volume, revenue, average payment and delivery days per (segment, purchase day).

    Orders of every status count. The delivery average is weighted by payment rows, an
    unpaid order weighing one. ``segment`` names an order column to break down by, in
    addition to the total ``ALL``; ``lookback`` keeps days from ``asof - lookback`` on.
    """
    o = orders.filter(F.col("purchase_ts").isNotNull())
    if lookback is not None:
        o = o.filter(since("purchase_ts", asof, lookback))
    totals = payment_totals(payments, o if lookback is not None else None)
    weight = fan_out("n_payments").cast("decimal(18,0)")
    arrived = ((F.col("order_status") == DELIVERED) & F.col("delivered_ts").isNotNull())
    micros = elapsed_micros(F.col("delivered_ts"), F.col("purchase_ts")).cast("decimal(20,0)")
    per_order = (
        with_segments(o.join(totals, "order_id", "left"), segment)
        .groupBy("segment", F.to_date("purchase_ts").alias("day"), "order_id")
        .agg(F.sum("paid").alias("paid"),
             F.sum("n_values").alias("n_values"),
             F.sum(F.when(arrived, micros * weight)).alias("micros"),
             F.sum(F.when(arrived, weight)).alias("weight")))
    return (per_order.groupBy("segment", "day")
            .agg(F.count("order_id").alias("order_volume"),
                 F.coalesce(F.sum("paid"), F.lit(0).cast("decimal(28,2)")).alias("revenue"),
                 F.coalesce(mean_of(F.sum("paid"), F.sum("n_values")), F.lit(0.0))
                 .alias("avg_payment"),
                 F.coalesce(in_days(F.sum("micros")) / F.sum("weight").cast("double"),
                            F.lit(0.0)).alias("delivery_days")))


def to_series(rollup: DataFrame) -> DataFrame:
    """Long form: one (segment, metric, day, value) row per rollup measure."""
    return rollup.select(
        "segment", "day",
        F.expr(f"stack(4, 'revenue', cast(revenue as {VALUE}), "
               f"'volume', cast(order_volume as {VALUE}), "
               f"'aov', cast(avg_payment as {VALUE}), "
               f"'delivery', cast(delivery_days as {VALUE})) as (metric, value)"))


def calendar(segments: DataFrame, first: date, last: date) -> DataFrame:
    """Every day from ``first`` to ``last`` for every row of ``segments``."""
    days = F.sequence(F.lit(first), F.lit(last))
    return segments.withColumn("day", F.explode(days))


def densify(series: DataFrame, first: date, last: date) -> DataFrame:
    """Zero-fill the days a series skips."""
    keys = series.select("segment", "metric").distinct()
    return (calendar(keys, first, last).join(series, ["segment", "metric", "day"], "left")
            .withColumn("value", F.coalesce("value", F.lit(0).cast(VALUE))))


def day_number(day: str = "day"):
    return F.unix_date(day)


def calendar_window(keys: list[str], first: int, last: int, day: str = "day"):
    """Frame in calendar days, so gaps in the series do not stretch it."""
    return Window.partitionBy(*keys).orderBy(day_number(day)).rangeBetween(first, last)
