"""What-if projection of a 30-day baseline under price, churn and delay changes."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, functions as F

from tidemark.functions import mean_of, round_to, since
from tidemark.operators.ordergrain import payment_totals, with_segments

# Volume change in percent per unit of each input.
PRICE_ELASTICITY, CHURN_EFFECT, DELAY_EFFECT = -1.25, 0.45, 1.8


def baseline(orders: DataFrame, payments: DataFrame, asof: date, days: int = 30,
             segment: str | None = None) -> DataFrame:
    """Orders, revenue and mean payment of the last ``days`` in total and per segment.

    Empty figures take the documented stand-ins 100, 10000 and 100.
    """
    o = orders.filter(since("purchase_ts", asof, days))
    per_order = (with_segments(o.join(payment_totals(payments, o), "order_id", "left"),
                               segment)
                 .groupBy("segment", "order_id")
                 .agg(F.sum("paid").alias("paid"), F.sum("n_values").alias("n_values")))

    def standin(c, value):
        return F.coalesce(F.nullif(c, F.lit(0.0)), F.lit(value))

    return (per_order.groupBy("segment")
            .agg(F.count("order_id").cast("double").alias("n"), F.sum("paid").alias("paid"),
                 F.sum("n_values").alias("n_values"))
            .select("segment", standin(F.col("n"), 100.0).alias("base_orders"),
                    standin(F.col("paid").cast("double"), 10000.0).alias("base_revenue"),
                    standin(mean_of(F.col("paid"), F.col("n_values")), 100.0)
                    .alias("base_aov")))


def project(base: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Every scenario applied to every baseline row.

    ``scenarios`` is a hand-written grid of a few rows; pairing it with each segment is the
    purpose of the operator.
    """
    rows = base.crossJoin(F.broadcast(scenarios))
    price = F.col("price_change_pct")
    volume = (price * PRICE_ELASTICITY + -(F.col("churn_change_pct") * CHURN_EFFECT)
              + -(F.col("delivery_delay_days") * DELAY_EFFECT))
    rows = (rows.withColumn("volume_change_pct", volume)
            .withColumn("sim_orders", F.greatest(F.lit(0.0), F.rint(
                F.col("base_orders") * (1 + F.col("volume_change_pct") / 100.0))))
            .withColumn("aov", F.col("base_aov") * (1 + price / 100.0))
            .withColumn("revenue", F.col("sim_orders") * F.col("aov"))
            .withColumn("diff", F.col("revenue") - F.col("base_revenue"))
            .withColumn("diff_pct", F.col("diff")
                        / F.greatest(F.lit(1.0), F.col("base_revenue")) * 100.0))
    diff, pct = F.col("diff"), F.col("diff_pct")
    text = F.format_string(
        "Net Revenue Impact: %s%s (%s%s%%). %s.",
        F.when(diff >= 0, "+$").otherwise("-$"),
        F.format_number(round_to(F.abs(diff), 2), 2), F.when(diff >= 0, "+").otherwise(""),
        F.format_string("%.1f", round_to(pct, 1)),
        F.when(diff > 0, "Favorable margin expansion")
        .otherwise("Adverse revenue pressure from demand degradation"))
    return rows.select(
        "segment", "price_change_pct", "churn_change_pct", "delivery_delay_days",
        "base_orders", round_to(F.col("base_revenue"), 2).alias("base_revenue"),
        round_to(F.col("base_aov"), 2).alias("base_aov"), "volume_change_pct", "sim_orders",
        round_to(F.col("revenue"), 2).alias("sim_revenue"),
        round_to(F.col("aov"), 2).alias("sim_aov"),
        round_to(diff, 2).alias("revenue_delta"), round_to(pct, 1).alias("revenue_delta_pct"),
        (F.col("sim_orders") - F.col("base_orders")).alias("orders_delta"),
        text.alias("assessment"))
