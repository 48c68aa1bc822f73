"""Reporting tables by period that follow changes of the orders and payments under them.

A refresh finds the periods (days, or months where days are small) that changed orders were or are
bought in, computes these from the tables as they are now, and replaces their partitions. Other
periods are not read.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.operators import views
from tidemark.sources.parts import read_parts, replace_parts, write_parts

PERIOD = "period"


def period_of(day: Column | str, width: str) -> Column:
    return F.date_trunc(width, day).cast("date")


def stored_by_period(orders: DataFrame, width: str = "day") -> DataFrame:
    """Orders with their period, as a table that a refresh prunes is partitioned by."""
    return orders.withColumn(PERIOD, period_of("purchase_ts", width))


def _period(orders: DataFrame, width: str) -> Column:
    return F.col(PERIOD) if PERIOD in orders.columns else period_of("purchase_ts", width)


def touched_periods(changed: DataFrame, *versions: DataFrame, width: str = "day") -> list[date]:
    """Periods of the ``changed`` order ids in any version (before, after) of the orders.

    The ids are those of orders that came, changed or went, and of payments that did. The result
    is a list of dates of the calendar.
    """
    found = None
    for orders in versions:
        here = (orders.join(changed.select("order_id"), "order_id", "left_semi")
                .select(_period(orders, width).alias(PERIOD)))
        found = here if found is None else found.unionByName(here)
    return sorted(r[PERIOD] for r in found.filter(F.col(PERIOD).isNotNull()).distinct().collect())


def of_periods(orders: DataFrame, periods: list[date], width: str = "day") -> DataFrame:
    """The orders of the given periods; partitions or row groups of others are skipped."""
    if not periods:
        return orders.limit(0)
    rows = orders.filter(_period(orders, width).isin(periods))
    # Bounds on the bare timestamp reach the scan of a table that isn't stored by period.
    kind = orders.schema["purchase_ts"].dataType
    first, last = (F.lit(d).cast("timestamp").cast(kind) for d in (min(periods), max(periods)))
    return rows.filter((F.col("purchase_ts") >= first) & (
        F.col("purchase_ts") < last + F.expr(f"interval 1 {width}"))).drop(PERIOD)


def _dealt(rows: DataFrame, day: str, width: str) -> DataFrame:
    return rows.withColumn(PERIOD, period_of(day, width)).hint("rebalance", PERIOD)


def build_daily(orders: DataFrame, payments: DataFrame, path: str, width: str = "day") -> None:
    """Write the daily summary of everything."""
    write_parts(_dealt(views.daily_summary(orders, payments), "report_date", width), path, PERIOD)


def refresh_daily(before: DataFrame, orders: DataFrame, payments: DataFrame, changed: DataFrame,
                  path: str, width: str = "day") -> list[date]:
    """Bring the daily summary in line with ``orders`` and ``payments``; returns the periods.

    ``before`` has the orders as they were when the summary was last brought in line.
    """
    periods = touched_periods(changed, before, orders, width=width)
    rows = views.daily_summary(of_periods(orders, periods, width), payments, part=True)
    replace_parts(_dealt(rows, "report_date", width), path, PERIOD, periods)
    return periods


def build_facts(orders: DataFrame, customers: DataFrame, payments: DataFrame, reviews: DataFrame,
                path: str, width: str = "day") -> None:
    """Write the order table of everything; orders without a time are left out."""
    rows = views.order_fact(orders, customers, payments, reviews).filter("order_date IS NOT NULL")
    write_parts(_dealt(rows, "order_date", width), path, PERIOD)


def refresh_facts(before: DataFrame, orders: DataFrame, customers: DataFrame, payments: DataFrame,
                  reviews: DataFrame, changed: DataFrame, path: str,
                  width: str = "day") -> list[date]:
    """Bring the order table in line as ``refresh_daily`` does; reviews may have changed, too."""
    periods = touched_periods(changed, before, orders, width=width)
    rows = views.order_fact(of_periods(orders, periods, width), customers, payments, reviews,
                            part=True)
    replace_parts(_dealt(rows, "order_date", width), path, PERIOD, periods)
    return periods


def read(spark: SparkSession, path: str) -> DataFrame:
    return read_parts(spark, path).drop(PERIOD)
