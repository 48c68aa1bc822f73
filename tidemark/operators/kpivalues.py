"""The nine configured metrics for every day and segment at once.

Output rows are ``(kpi, segment, day, value)``. Three order-level passes feed them:

* day metrics (revenue, payment average, volume, conversion, approval) aggregate to
  order grain and then to the day;
* delivery metrics aggregate per delivery day and roll over a trailing week;
* customer metrics (churn, repeat) are interval counts: a purchase changes its customer's
  state on a known later day, so each purchase day emits a few ``+1/-1`` changes and a
  running sum over the calendar gives every day's count, without pairing customers and days.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import elapsed_micros, in_days, mean_of, percent
from tidemark.operators.ordergrain import payment_totals, with_segments
from tidemark.operators.rollup import calendar, calendar_window
from tidemark.schemas import APPROVED_STATES, CANCELED, DELIVERED, VALUE

DAY_KPIS = ["daily_revenue", "average_order_value", "daily_order_volume",
            "conversion_rate", "payment_approval_rate"]
DELIVERY_KPIS = ["average_delivery_time", "on_time_delivery_rate"]
CUSTOMER_KPIS = ["customer_churn_rate", "repeat_customer_rate"]

CHURN_PRIOR = (60, 30)   # bought within [day-60, day-30) ...
REPEAT_DAYS = 30         # ... and repeat buyers within the last 30 days
DELIVERY_DAYS = 7


def _long(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    pairs = [F.struct(F.lit(k).alias("kpi"), v.cast(VALUE).alias("value"))
             for k, v in values.items()]
    return (df.select("segment", "day", F.explode(F.array(*pairs)).alias("kv"))
            .select("kv.kpi", "segment", "day", "kv.value")
            .filter(F.col("value").isNotNull()))


def segment_list(orders: DataFrame, segment: str | None) -> DataFrame:
    """The total and each segment that occurs; the output size is the number of segments."""
    if segment is None:
        return orders.sparkSession.range(1).select(F.lit("ALL").alias("segment"))
    return with_segments(orders.select(segment), segment).select("segment").distinct()


def day_kpis(orders: DataFrame, payments: DataFrame, asof: date, first_day: date,
             segment: str | None = None, segments: DataFrame | None = None,
             whole: bool = False) -> DataFrame:
    """Metrics of a single purchase day, for days having rows; ``asof`` is always present.

    ``orders`` carries the ``segment`` column. ``whole`` says that the range covers the table, so children need no thinning.
    """
    o = orders.filter((F.col("purchase_ts") >= F.lit(first_day))
                      & (F.col("purchase_ts") < F.lit(asof + timedelta(days=1))))
    active = F.col("order_status") != CANCELED
    totals = payment_totals(payments, None if whole else o)
    joined = o.join(totals, "order_id", "left")
    per_order = (
        with_segments(joined, segment)
        .groupBy("segment", F.to_date("purchase_ts").alias("day"), "order_id")
        .agg(F.sum(F.when(active, F.col("paid"))).alias("paid"),
             F.sum(F.when(active, F.col("n_values"))).alias("n_values"),
             F.sum(F.when(active, F.col("n_payments"))).alias("n_payments"),
             F.max(F.when(active, 1).otherwise(0)).alias("active"),
             F.count(F.lit(1)).alias("n"),
             F.count_if(F.col("order_status") == DELIVERED).alias("delivered"),
             F.count_if(F.col("order_status").isin(APPROVED_STATES)).alias("approved")))
    measures = ["paid", "n_values", "n_payments", "active", "n", "delivered", "approved"]
    if segments is None:
        segments = segment_list(orders, segment)
    # The anchor day may have no rows at all; then every metric reads zero.
    today = segments.withColumn("day", F.lit(asof))
    daily = (per_order.drop("order_id").unionByName(today, allowMissingColumns=True)
             .groupBy("segment", "day").agg(
                 *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in measures]))
    anchor = F.col("day") == F.lit(asof)
    has_paid = (F.col("n_payments") > 0) | anchor
    has_rows = (F.col("n") > 0) | anchor
    return _long(daily, {
        "daily_revenue": F.when(has_paid, F.col("paid")),
        "average_order_value": F.when(
            has_paid, F.coalesce(mean_of(F.col("paid"), F.col("n_values")), F.lit(0.0))),
        "daily_order_volume": F.when((F.col("active") > 0) | anchor, F.col("active")),
        "conversion_rate": F.when(has_rows, percent(F.col("delivered"), F.col("n"))),
        "payment_approval_rate": F.when(has_rows, percent(F.col("approved"), F.col("n"))),
    })


def delivery_kpis(orders: DataFrame, customers: DataFrame, asof: date, first_day: date,
                  segment: str | None = None, segments: DataFrame | None = None) -> DataFrame:
    """Delivery time and punctuality of orders delivered in the trailing week of each day.

    At the anchor day there is no upper bound on the delivery date; earlier days see only
    what had been delivered by then. Deliveries shrink to one row per customer and day before
    they meet the customer table.
    """
    done = orders.filter(
        (F.col("order_status") == DELIVERED)
        & (F.col("delivered_ts") >= F.lit(first_day - timedelta(days=DELIVERY_DAYS))))
    day = F.least(F.to_date("delivered_ts"), F.lit(asof))
    micros = elapsed_micros(F.col("delivered_ts"), F.col("purchase_ts"))
    counts = ["micros", "n_timed", "n", "on_time"]
    keys = ["customer_id"] if segment else []
    daily = done.groupBy(*keys, day.alias("day")).agg(
        F.sum(micros.cast("decimal(20,0)")).alias("micros"),
        F.count(micros).alias("n_timed"), F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("delivered_ts") <= F.col("estimated_ts")).alias("on_time"))
    if segment:
        daily = daily.join(customers.select("customer_id", segment), "customer_id", "left")
    daily = with_segments(daily, segment).groupBy("segment", "day").agg(
        *[F.sum(c).alias(c) for c in counts])
    if segments is None:
        segments = segment_list(customers, segment)
    spine = calendar(segments, first_day - timedelta(days=DELIVERY_DAYS), asof)
    week = calendar_window(["segment"], -DELIVERY_DAYS, 0)
    rolled = (spine.join(daily, ["segment", "day"], "left")
              .select("segment", "day", *[F.sum(c).over(week).alias(c) for c in counts])
              .filter(F.col("day") >= F.lit(first_day)))
    mean_days = in_days(F.col("micros")) / F.col("n_timed").cast("double")
    return _long(rolled, {
        "average_delivery_time": F.when(F.col("n_timed") > 0, mean_days).otherwise(F.lit(0.0)),
        "on_time_delivery_rate": percent(F.coalesce("on_time", F.lit(0)),
                                         F.coalesce("n", F.lit(0))),
    })


def customer_kpis(orders: DataFrame, customers: DataFrame, asof: date, first_day: date,
                  segment: str | None = None, segments: DataFrame | None = None) -> DataFrame:
    """Churn and repeat rate for every day, from purchase-to-purchase gaps.

    With ``p`` a purchase day and ``next``/``prev`` its neighbours for the same customer, the
    customer is churned on ``[p+31, min(p+60, next-1)]``, in the churn base on
    ``[p+31, min(p+60, next+30)]``, active on ``[p, min(p+30, next-1)]`` and a repeat buyer on
    that interval if ``p`` had several orders, else up to ``prev+30``. Intervals of one
    customer never overlap, so counting intervals counts distinct customers.

    Churn counts only customers that are in ``customers``, its base counts all. A customer
    shrinks to one row per purchase day before the join and the window, so a customer owning
    a large share of the orders is at most as many rows as there are days.
    """
    prior_from, prior_to = CHURN_PRIOR
    o = orders.filter(F.col("customer_id").isNotNull()
                      & (F.col("purchase_ts") >= F.lit(first_day - timedelta(days=prior_from)))
                      & (F.col("purchase_ts") < F.lit(asof + timedelta(days=1))))
    keep = [segment] if segment else []
    visits = o.groupBy("customer_id", F.to_date("purchase_ts").alias("day")).agg(
        F.count(F.lit(1)).alias("n_orders"))
    known = customers.select("customer_id", *keep, F.lit(True).alias("known"))
    by_customer = Window.partitionBy("customer_id").orderBy("day")
    gaps = (visits.join(known, "customer_id", "left")
            .withColumn("next", F.lead("day").over(by_customer))
            .withColumn("prev", F.lag("day").over(by_customer)))
    # least() skips NULL, so a last purchase has no successor to cut its intervals short.
    lapse, until_next = f"date_add(day, {prior_to + 1})", "date_sub(next, 1)"
    active_end = f"least(date_add(day, {REPEAT_DAYS}), {until_next})"
    intervals = {
        "base": (lapse, f"least(date_add(day, {prior_from}), date_add(next, {prior_to}))"),
        "churned": (lapse, f"if(known, least(date_add(day, {prior_from}), {until_next}), null)"),
        "active": ("day", active_end),
        "repeat": ("day", f"case when n_orders > 1 then {active_end} when prev is not null "
                          f"then least(date_add(prev, {REPEAT_DAYS}), {until_next}) end"),
    }
    listed = ", ".join(f"named_struct('count', '{c}', 'first', {first}, 'last', {last})"
                       for c, (first, last) in intervals.items())
    spans = gaps.selectExpr(*keep, f"inline(filter(array({listed}), i -> i.first <= i.last))")
    steps = spans.selectExpr(*keep, "count", "inline(array(struct(first as day, 1 as step), "
                                             "struct(date_add(last, 1) as day, -1 as step)))")
    # Changes before the calendar starts fold into its first day.
    flat = (with_segments(steps, segment)
            .withColumn("day", F.greatest("day", F.lit(first_day)))
            .filter(F.col("day") <= F.lit(asof)))
    counts = ["base", "churned", "active", "repeat"]
    daily = flat.groupBy("segment", "day").agg(
        *[F.sum(F.when(F.col("count") == c, F.col("step"))).alias(c) for c in counts])
    if segments is None:
        segments = segment_list(customers, segment)
    upto = (Window.partitionBy("segment").orderBy("day")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    running = (calendar(segments, first_day, asof).join(daily, ["segment", "day"], "left")
               .select("segment", "day",
                       *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(c) for c in counts]))
    return _long(running, {
        "customer_churn_rate": percent(F.col("churned"), F.col("base")),
        "repeat_customer_rate": percent(F.col("repeat"), F.col("active")),
    })


def kpi_values(orders: DataFrame, payments: DataFrame, customers: DataFrame, asof: date,
               first_day: date, segment: str | None = None, whole: bool = False) -> DataFrame:
    """All nine metrics from ``first_day`` to ``asof``; ``segment`` is a customer column."""
    segments = segment_list(customers, segment)
    args = dict(asof=asof, first_day=first_day, segment=segment, segments=segments)
    placed = orders
    if segment is not None:
        placed = orders.join(customers.select("customer_id", segment), "customer_id", "left")
    return (day_kpis(placed, payments, whole=whole, **args)
            .unionByName(delivery_kpis(orders, customers, **args))
            .unionByName(customer_kpis(orders, customers, **args)))


def churn_prior_cohort(orders: DataFrame, customers: DataFrame, asof: date) -> DataFrame:
    """Churn of the cohort one month earlier: bought in [asof-90, asof-60), not since asof-60."""
    return _cohort_churn(orders, customers, asof, 90, 60)


def churn_rate(orders: DataFrame, customers: DataFrame, asof: date) -> DataFrame:
    return _cohort_churn(orders, customers, asof, *CHURN_PRIOR)


def _cohort_churn(orders, customers, asof, start, end) -> DataFrame:
    o = orders.filter((F.col("purchase_ts") >= F.lit(asof - timedelta(days=start)))
                      & F.col("customer_id").isNotNull())
    edge = F.lit(asof - timedelta(days=end))
    per_customer = o.groupBy("customer_id").agg(
        F.max(F.col("purchase_ts") < edge).alias("before"),
        F.max(F.col("purchase_ts") >= edge).alias("after"))
    known = customers.select("customer_id", F.lit(True).alias("known"))
    return (per_customer.filter("before").join(known, "customer_id", "left")
            .agg(percent(F.count_if(F.col("known") & ~F.col("after")),
                         F.count(F.lit(1))).alias("value")))
