"""Every registered query: a name and a function of (session, data folder)."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.functions import round_to, settle, since
from tidemark.operators import (
    evaluate as ev, extent, forecast, incidents, kpivalues as kv, liveviews, measures as ms,
    quality as dq, rollup, rootcause as rc, scenario, seriesstats as ss, sketches as sk,
    tablechange as tc, views)
from tidemark.operators.ordergrain import payment_totals
from tidemark.plans import small_tasks, work_dir
from tidemark.plans.registry import spec_frame
from tidemark.schemas import SCENARIO
from tidemark.sources import csvtables, databases, feed, parts, sinks
from tidemark.sources.conformed import Mart
from tidemark.sources.starschema import StarSchema
from tidemark.streaming import metrics as sm, runtime as rt, state as st

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

STATE = "customer_state"


def plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and timestamps without zone, for comparison with other engines."""
    def cast(f):
        if isinstance(f.dataType, T.DecimalType):
            return F.col(f.name).cast("double").alias(f.name)
        if isinstance(f.dataType, T.TimestampType):
            return F.col(f.name).cast("timestamp_ntz").alias(f.name)
        return F.col(f.name)
    return df.select(*[cast(f) for f in df.schema.fields])


def query(fn: Callable[[Mart], DataFrame]) -> Callable[[Mart], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, folder: plain(fn(Mart(spark, folder)))
    return fn


def placed(m: Mart) -> DataFrame:
    """Orders with their customer's state and city."""
    return m.orders.join(m.customers, "customer_id", "left")


# --- ingest ------------------------------------------------------------------------------

@query
def ingest_csv_orders(m: Mart) -> DataFrame:
    folder = work_dir(m.spark, "csv")
    as_table = m.orders.select(
        F.col("order_id").cast("string"), F.col("customer_id").cast("string"), "order_status",
        F.col("purchase_ts").alias("order_purchase_timestamp"),
        F.lit(None).cast("timestamp").alias("order_approved_at"),
        F.lit(None).cast("timestamp").alias("order_delivered_carrier_date"),
        F.col("delivered_ts").alias("order_delivered_customer_date"),
        F.col("estimated_ts").alias("order_estimated_delivery_date"))
    (as_table.write.option("header", True)
     .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
     .csv(f"{folder}/orders.csv"))
    return csvtables.load_tables(m.spark, folder)["orders"]


@query
def clean_text(m: Mart) -> DataFrame:
    """Padded names and null tokens in the customer table."""
    segment = (F.when(F.col("c_nationkey") < 4, " nan ").when(F.col("c_nationkey") < 8, "None")
               .when(F.col("c_nationkey") < 12, "   ")
               .otherwise(F.concat(F.lit("\t"), "c_mktsegment", F.lit("  "))))
    dirty = m.table("customer").select(
        "c_custkey", F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("name"),
        segment.alias("segment"))
    return csvtables.clean_strings(dirty)


LINE_KEY = ["l_orderkey", "l_linenumber"]
LINE_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]


@query
def upsert_latest(m: Mart) -> DataFrame:
    """Lines flagged R and A, then those flagged N upserted over them."""
    lines = m.table("lineitem")
    cols = [*LINE_KEY, *LINE_ORDER]
    old = tc.latest_per_key(lines.filter("l_returnflag <> 'N'").select(*cols), LINE_KEY,
                            LINE_ORDER)
    return tc.upsert(old, lines.filter("l_returnflag = 'N'").select(*cols), LINE_KEY,
                     LINE_ORDER)


@query
def insert_if_absent(m: Mart) -> DataFrame:
    lines = m.table("lineitem")
    cols = [*LINE_KEY, *LINE_ORDER]
    old = tc.first_per_key(lines.filter("l_returnflag <> 'N'").select(*cols), LINE_KEY,
                           LINE_ORDER)
    return tc.insert_absent(old, lines.filter("l_returnflag = 'N'").select(*cols), LINE_KEY,
                            LINE_ORDER)


@query
def table_row_counts(m: Mart) -> DataFrame:
    return csvtables.row_counts({
        "customers": m.customers, "order_items": m.items, "order_payments": m.payments,
        "order_reviews": m.reviews, "orders": m.orders, "products": m.products,
        "category_translation": m.translation})


@query
def parameterised_sql(m: Mart) -> DataFrame:
    m.orders.createOrReplaceTempView("tm_orders")
    return databases.run_query(
        m.spark, "SELECT customer_id, count(*) AS n_orders, max(purchase_ts) AS last_purchase "
                 "FROM tm_orders WHERE order_status = :status GROUP BY customer_id",
        {"status": "delivered"})


@query
def audit_log_append(m: Mart) -> DataFrame:
    """Two audit runs appended to one table and read back."""
    path = work_dir(m.spark, "audit")
    results = dq.audit(m.orders, m.payments, m.reviews)
    for day in (m.asof - timedelta(days=1), m.asof):
        sinks.append_audit(dq.audit_log(results, datetime.combine(day, datetime.min.time())),
                           path)
    return (m.spark.read.parquet(path).drop("audit_id", "details")
            .withColumn("run_date", F.col("run_date").cast("date")))


FEED_ORDER = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def flat_feed(m: Mart) -> DataFrame:
    """A flat text feed with one row per line item.

    Orders meet their customers before their lines do, so lines move by part and by order only, and
    lines of an order end side by side, where they combine best. What three columns of a line say
    moves as one number.
    """
    returned = (F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.05)
    says = (F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 2)
            .otherwise(0)
            + F.when(returned, 4).otherwise(0)
            + F.when(F.col("l_linestatus") == "O", 8).otherwise(0))
    lines = (m.table("lineitem").withColumn("says", says)
             .join(m.table("part"), F.col("l_partkey") == F.col("p_partkey")))
    bought = (m.table("orders")
              .join(m.table("customer"), F.col("o_custkey") == F.col("c_custkey")))
    rows = lines.join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
    said = F.col("says").bitwiseAND
    status = (F.when(F.col("o_orderstatus") == "F", "Delivered")
              .when(F.col("o_orderstatus") == "O", "Shipped")
              .when(said(8) > 0, "Pending")
              .when(F.col("l_linenumber") > 4, "Processing").otherwise("Lost"))
    clock = F.when(F.col("l_linenumber") < 7, F.format_string(
        "%02d:%02d.5", F.col("l_linenumber") + 8, F.col("l_quantity").cast("int")))
    method = (F.when(said(3) == 1, "Credit Card").when(said(3) == 2, "Debit Card")
              .otherwise("Gift Card"))
    money = F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    return rows.select(
        *FEED_ORDER, F.col("l_orderkey").cast("string").alias("order_id"),
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("l_partkey").cast("string").alias("product_id"),
        F.col("c_mktsegment").alias("city"), F.col("p_type").alias("category"),
        status.alias("delivery_status"),
        F.when(said(4) > 0, "Yes").otherwise("no").alias("is_returned"),
        F.coalesce(clock, F.lit("n/a")).alias("order_timestamp"),
        money.alias("order_value"), method.alias("payment_method"),
        (F.col("l_quantity").cast("int") - 10).cast("string").alias("quantity"),
        money.alias("price"))


def _feed_tables(m: Mart) -> dict[str, DataFrame]:
    return feed.normalise(flat_feed(m), m.asof, FEED_ORDER)


@query
def feed_customers(m: Mart) -> DataFrame:
    return _feed_tables(m)["customers"]


@query
def feed_products(m: Mart) -> DataFrame:
    return _feed_tables(m)["products"]


@query
def feed_orders(m: Mart) -> DataFrame:
    return _feed_tables(m)["orders"]


@query
def feed_payments(m: Mart) -> DataFrame:
    return _feed_tables(m)["payments"]


@query
def feed_sellers(m: Mart) -> DataFrame:
    return _feed_tables(m)["sellers"]


@query
def feed_items(m: Mart) -> DataFrame:
    return _feed_tables(m)["items"]


@query
def feed_regional_summary(m: Mart) -> DataFrame:
    """The regional summary over a star schema that one read of the feed gave."""
    folder = work_dir(m.spark, "feed")
    # Deciding rows are four to a line and are sorted before they combine: some 800 bytes a line.
    with small_tasks(m.spark, m.table("lineitem").count(), 500_000, "24m"):
        feed.store(flat_feed(m), m.asof, FEED_ORDER, folder)
    star = StarSchema(feed.stored_tables(m.spark, folder), m.asof)
    items = star.items.groupBy("order_id").agg(F.count(F.lit(1)).alias("n"))
    sold = (star.orders.join(star.customers, "customer_id").join(items, "order_id")
            .groupBy("customer_city").agg(F.sum("n").alias("items")))
    return views.regional_summary(star.orders, star.customers, star.payments, star.reviews,
                                  star.asof).join(sold, "customer_city", "left")


def _sql_kpi_status(m: Mart) -> DataFrame:
    """A good metric, one that doesn't analyse and one that fails when it runs."""
    m.orders.createOrReplaceTempView("kpi_orders")
    specs = [
        {"name": "orders_of_day", "sql_query":
            "SELECT count(*) AS value FROM kpi_orders WHERE to_date(purchase_ts) = :asof",
         "history_query":
            "SELECT to_date(purchase_ts) AS day, count(*) AS value FROM kpi_orders "
            "WHERE to_date(purchase_ts) BETWEEN date_sub(:asof, 7) AND date_sub(:asof, 1) "
            "GROUP BY to_date(purchase_ts)"},
        {"name": "no_such_column", "sql_query": "SELECT sum(missing) AS value FROM kpi_orders"},
        {"name": "division_by_zero", "sql_query":
            "SELECT count(*) / (count(*) - count(1)) AS value FROM kpi_orders"},
    ]
    return ev.evaluate_sql(m.spark, specs, spec_frame(m.spark, specs), m.asof)


@query
def sql_kpi_errors(m: Mart) -> DataFrame:
    return _sql_kpi_status(m).select(
        "kpi", F.when(F.col("status") == "error", "error").otherwise("judged").alias("outcome"),
        "current_value")


@query
def sql_kpi_summary(m: Mart) -> DataFrame:
    return ev.run_summary(_sql_kpi_status(m)).select("total", "errors", "run_status")


@query
def rebase_dates(m: Mart) -> DataFrame:
    """Order dates moved so that the newest purchase falls on the newest delivery."""
    newest = m.table("lineitem").agg(F.max("l_shipdate").alias("d")).first()["d"].date()
    days = tc.shift_days(m.table("orders").select("o_orderdate"), newest)
    return tc.rebase(m.orders, ["purchase_ts", "delivered_ts", "estimated_ts"], days)


@query
def purge_recent_window(m: Mart) -> DataFrame:
    kept = tc.purge_recent(m.orders, {"payments": m.payments, "items": m.items}, m.asof, 700)
    return csvtables.row_counts(kept)


@query
def remediate_tables(m: Mart) -> DataFrame:
    """Rows kept and removed per table; payments are charged back below zero for large lots."""
    payments = m.table("lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("seq"),
        (F.col("l_extendedprice") - F.col("l_quantity") * 1000).cast("decimal(18,2)")
        .alias("payment_value"))
    orders = m.orders.withColumn("order_status", F.when(
        F.col("order_status") != "shipped", F.col("order_status")))
    parts = dq.remediate(orders, payments, m.items, "12_4%")
    return csvtables.row_counts({f"{name}_{side}": df for name, pair in parts.items()
                                 for side, df in zip(("kept", "removed"), pair)})


@query
def export_manifest(m: Mart) -> DataFrame:
    folder = work_dir(m.spark, "export")
    log = dq.audit_log(dq.audit(m.orders, m.payments, m.reviews),
                       datetime.combine(m.asof, datetime.min.time()))
    return sinks.export_csv({
        "orders": views.recent_order_fact(m.orders, m.customers, m.payments, m.reviews,
                                          m.asof),
        "daily_kpis": views.daily_extract(m.orders, m.payments),
        "data_quality": dq.newest_audits(log),
        "regional": views.regional_summary(m.orders, m.customers, m.payments, m.reviews,
                                           m.asof)}, folder).drop("path")


@query
def date_extent(m: Mart) -> DataFrame:
    return extent.date_extent(m.orders)


@query
def recent_distribution(m: Mart) -> DataFrame:
    return extent.recent_distribution(m.orders, m.payments, m.asof)


@query
def recent_history(m: Mart) -> DataFrame:
    return extent.recent_history(m.orders, m.payments, m.asof)


# --- metric values and verdicts ------------------------------------------------------------

def _kpi_group(m: Mart, group: list[str]) -> DataFrame:
    args = dict(asof=m.asof, first_day=m.first_day, segment=STATE,
                segments=kv.segment_list(m.customers, STATE))
    if group is kv.DAY_KPIS:
        return kv.day_kpis(placed(m), m.payments, whole=True, **args)
    if group is kv.DELIVERY_KPIS:
        return kv.delivery_kpis(m.orders, m.customers, **args)
    return kv.customer_kpis(m.orders, m.customers, **args)


def _register_kpi(name: str, group: list[str]) -> None:
    def values(m: Mart) -> DataFrame:
        return _kpi_group(m, group).filter(F.col("kpi") == name)
    values.__name__ = f"kpi_{name}"
    query(values)


for _group in (kv.DAY_KPIS, kv.DELIVERY_KPIS, kv.CUSTOMER_KPIS):
    for _name in _group:
        _register_kpi(_name, _group)


@query
def churn_now(m: Mart) -> DataFrame:
    return kv.churn_rate(m.orders, m.customers, m.asof)


@query
def churn_prior_cohort(m: Mart) -> DataFrame:
    return kv.churn_prior_cohort(m.orders, m.customers, m.asof)


def _recent_values(m: Mart, segment: str | None = None) -> DataFrame:
    first = m.asof - timedelta(days=ev.MONTH_DAYS)
    return kv.kpi_values(m.orders, m.payments, m.customers, m.asof, first, segment)


def _status(m: Mart, segment: str | None = None) -> DataFrame:
    return ev.evaluate(_recent_values(m, segment), spec_frame(m.spark), m.asof)


def _shown(status: DataFrame) -> DataFrame:
    """Verdict columns rounded for comparison."""
    return status.select(
        "kpi", "segment", "day", "current_value", round_to(F.col("baseline"), 4)
        .alias("baseline"), settle(F.col("historical_std"), 4).alias("historical_std"),
        "historical_count", round_to(F.col("change_percent"), 4).alias("change_percent"),
        "threshold_type", "threshold_value",
        round_to(F.col("breach_amount"), 4).alias("breach_amount"), "status", "reason",
        "alert_enabled", "alert_priority")


@query
def kpi_status(m: Mart) -> DataFrame:
    return _shown(_status(m))


@query
def kpi_status_by_state(m: Mart) -> DataFrame:
    return _shown(_status(m, STATE))


@query
def kpi_status_backtest(m: Mart) -> DataFrame:
    """Every metric judged on every day of the history."""
    values = kv.kpi_values(m.orders, m.payments, m.customers, m.asof, m.first_day, whole=True)
    return _shown(ev.evaluate(values, spec_frame(m.spark)))


@query
def kpi_history_values(m: Mart) -> DataFrame:
    """The last seven history values behind each verdict, oldest first."""
    return _status(m, STATE).select(
        "kpi", "segment", F.posexplode("historical_values").alias("position", "value"))


THRESHOLDS = [("percentage_drop", 10.0), ("percentage_spike", 10.0), ("absolute_drop", 1e6),
              ("absolute_spike", 1e6), ("statistical", 1.5), ("unheard_of", 1.0)]


@query
def kpi_threshold_types(m: Mart) -> DataFrame:
    """Daily revenue of every state judged by each threshold rule on every day."""
    revenue = kv.day_kpis(placed(m), m.payments, m.asof, m.first_day, STATE,
                          kv.segment_list(m.customers, STATE), whole=True)
    names = F.explode(F.array(*[F.lit(t) for t, _ in THRESHOLDS]))
    values = (revenue.filter("kpi = 'daily_revenue'").select("segment", "day", "value",
                                                             names.alias("kpi")))
    specs = [dict(name=t, threshold_type=t, threshold_value=v,
                  comparison_period="previous_month") for t, v in THRESHOLDS]
    out = ev.evaluate(values, spec_frame(m.spark, specs))
    return (out.groupBy("kpi", "segment").agg(
        F.count(F.lit(1)).alias("days"), F.count_if(F.col("status") == "alert")
        .alias("alerts"), round_to(F.max("breach_amount"), 2).alias("worst_breach")))


SQL_SPECS = [
    dict(name="revenue_sql", sql_query="SELECT sum(payment_value) AS value FROM tm_payments"),
    dict(name="orders_since", sql_query="SELECT count(*) AS value FROM tm_orders "
                                        "WHERE purchase_ts >= :asof - INTERVAL 30 DAYS"),
    dict(name="no_query"),
    dict(name="bad_query", sql_query="SELECT value FROM tm_absent"),
    dict(name="no_rows", sql_query="SELECT order_id AS value FROM tm_orders "
                                   "WHERE order_status = 'none'"),
    dict(name="null_value", sql_query="SELECT max(delivered_ts) AS value FROM tm_orders "
                                      "WHERE order_status = 'shipped'"),
    dict(name="text_value", sql_query="SELECT max(order_status) AS value FROM tm_orders"),
]


@query
def kpi_sql_errors(m: Mart) -> DataFrame:
    """SQL-defined metrics, good and failing, with the class of each failure."""
    m.orders.createOrReplaceTempView("tm_orders")
    m.payments.createOrReplaceTempView("tm_payments")
    out = ev.sql_kpi_values(m.spark, SQL_SPECS, m.asof)
    return out.withColumn("error", F.split("error", ":")[0])


@query
def run_summary(m: Mart) -> DataFrame:
    return ev.run_summary(_status(m, STATE), ["segment"])


@query
def alert_rows(m: Mart) -> DataFrame:
    return ev.alerts(_status(m, STATE)).select(
        "kpi", "segment", "alert_priority", "colour", "direction")


@query
def change_bands(m: Mart) -> DataFrame:
    return ev.change_band(_status(m, STATE)).select("kpi", "segment", "band")


@query
def top_kpis(m: Mart) -> DataFrame:
    return ev.top_kpis(_status(m, STATE))


@query
def board_rows(m: Mart) -> DataFrame:
    return ev.display_rows(_status(m, STATE)).withColumn(
        "baseline", round_to(F.col("baseline"), 4))


# --- data quality ---------------------------------------------------------------------------

@query
def dq_audit(m: Mart) -> DataFrame:
    return dq.audit(m.orders, m.payments, m.reviews, m.items).drop("description")


def spoiled(m: Mart) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables with every kind of defect: NULL status and customer, repeated and missing
    orders, negative and NULL payments, scores out of range."""
    o = m.table("orders")
    low = F.col("o_orderpriority") == "5-LOW"
    base = m.orders.join(o.select(F.col("o_orderkey").alias("order_id"), low.alias("low")),
                         "order_id")
    orders = (base.filter("order_status <> 'canceled'")
              .withColumn("order_status", F.when(~F.col("low"), F.col("order_status")))
              .unionByName(base.filter("low and order_status = 'delivered'"))
              .drop("low"))
    payments = m.table("lineitem").select(
        F.when(F.col("l_discount") < 0.09, F.col("l_orderkey")).alias("order_id"),
        F.col("l_linenumber").alias("payment_sequential"),
        F.when(F.col("l_quantity") < 45, F.col("l_returnflag")).alias("payment_type"),
        (F.col("l_extendedprice") - F.col("l_quantity") * 1000).cast("decimal(18,2)")
        .alias("payment_value"))
    reviews = o.select(F.col("o_orderkey").alias("order_id"), F.when(
        F.col("o_orderstatus") != "P", F.substring("o_orderpriority", 1, 1).cast("int") * 2)
        .alias("review_score"))
    return orders, payments, reviews


@query
def dq_audit_spoiled(m: Mart) -> DataFrame:
    return dq.audit(*spoiled(m), items=m.items).drop("description")


@query
def dq_health(m: Mart) -> DataFrame:
    return dq.health(dq.audit(m.orders, m.payments, m.reviews), m.orders)


@query
def dq_orphans(m: Mart) -> DataFrame:
    """Payments without a spoiled order; NULL keys are not judged."""
    orders, payments, _ = spoiled(m)
    return dq.orphans(payments, orders, "orphan_payments")


# --- series ------------------------------------------------------------------------------

def _rollup(m: Mart, lookback: int | None = 60) -> DataFrame:
    return rollup.daily_rollup(placed(m), m.payments, m.asof, lookback, STATE)


def _series(m: Mart, lookback: int | None = 60) -> DataFrame:
    return rollup.to_series(_rollup(m, lookback))


@query
def daily_rollup(m: Mart) -> DataFrame:
    return _rollup(m, None)


@query
def series_dense(m: Mart) -> DataFrame:
    first = m.asof - timedelta(days=60)
    return rollup.densify(_series(m), first, m.asof)


@query
def series_stats(m: Mart) -> DataFrame:
    return ss.series_stats(_series(m))


@query
def series_anomalies(m: Mart) -> DataFrame:
    series = _series(m)
    return ss.anomalies(series, ss.series_stats(series))


@query
def series_anomalies_backtest(m: Mart) -> DataFrame:
    """The verdicts of every third day of two years."""
    anchors = [m.asof - timedelta(days=3 * k) for k in range(243)]
    return ss.anomalies_at(_series(m, 3 * 242 + 60), anchors)


@query
def series_timeline(m: Mart) -> DataFrame:
    t = ss.timeline(_series(m))
    pairs = F.arrays_zip("days", "values")
    return t.select("segment", "metric", F.posexplode(pairs).alias("position", "pair")).select(
        "segment", "metric", "position", F.col("pair.days").alias("day"),
        F.col("pair.values").alias("value"))


@query
def series_outliers(m: Mart) -> DataFrame:
    series = _series(m)
    return ss.outliers(series, ss.series_stats(series))


@query
def moving_average_cross(m: Mart) -> DataFrame:
    """Revenue and volume over the whole history, per state."""
    series = _series(m, None).filter("metric in ('revenue', 'volume')")
    return ss.moving_average_cross(series).select(
        "segment", "metric", "day", round_to(F.col("sma_short"), 4).alias("sma_short"),
        round_to(F.col("sma_long"), 4).alias("sma_long"), "cross")


@query
def series_stats_or_empty(m: Mart) -> DataFrame:
    """Stats of the last two days; states that sold nothing read zero."""
    wanted = kv.segment_list(m.customers, STATE).withColumn("metric", F.lit("revenue"))
    return ss.stats_or_empty(_series(m, 1), wanted)


# --- views and measures ------------------------------------------------------------------

def _fact(m: Mart) -> DataFrame:
    return views.order_fact(m.orders, m.customers, m.payments, m.reviews)


@query
def order_fact(m: Mart) -> DataFrame:
    return _fact(m)


@query
def daily_summary(m: Mart) -> DataFrame:
    return views.daily_summary(m.orders, m.payments)


def _earlier(m: Mart) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(orders, payments) as they were, and the ids of what has changed since in the last weeks.

    Of the orders of the newest 20 days, those divisible by 5 had not come yet, those with
    remainder 1 were a day earlier, those with remainder 2 had other payments, and copies of those
    with remainder 3 were there that have gone.
    """
    kind = F.when(since("purchase_ts", m.asof, 20), F.col("order_id") % 5)
    moved = m.orders.filter(kind.isNull() | (kind != 0)).withColumn("purchase_ts", F.when(
        kind == 1, F.col("purchase_ts") - F.expr("interval 1 day"))
        .otherwise(F.col("purchase_ts")))
    copies = m.orders.filter(kind == 3).withColumn("order_id", -F.col("order_id"))
    other = m.orders.filter(kind == 2).select("order_id", F.lit(1).alias("more"))
    money = m.payments.schema["payment_value"].dataType
    paid = m.payments.join(other, "order_id", "left").withColumn("payment_value", (
        F.col("payment_value") + F.coalesce("more", F.lit(0))).cast(money)).drop("more")
    ids = m.orders.filter(kind < 4).select("order_id")
    return moved.unionByName(copies), paid, ids.unionByName(copies.select("order_id"))


@query
def daily_summary_refreshed(m: Mart) -> DataFrame:
    """The daily summary built over earlier tables, then brought in line day by day."""
    folder = work_dir(m.spark, "live-daily")
    orders, payments, changed = _earlier(m)
    liveviews.build_daily(orders, payments, folder, "month")
    liveviews.refresh_daily(orders, m.orders, m.payments, changed, folder, "month")
    return liveviews.read(m.spark, folder)


@query
def order_fact_refreshed(m: Mart) -> DataFrame:
    folder = work_dir(m.spark, "live-facts")
    orders, _, changed = _earlier(m)
    liveviews.build_facts(orders, m.customers, m.payments, m.reviews, folder, "month")
    liveviews.refresh_facts(orders, m.orders, m.customers, m.payments, m.reviews, changed, folder,
                            "month")
    return liveviews.read(m.spark, folder)


@query
def change_by_buckets(m: Mart) -> DataFrame:
    """Customers with some rows put in and some taken out, by rewriting their buckets."""
    folder = work_dir(m.spark, "buckets")
    table = m.table("customer").select("c_custkey", "c_name", "c_acctbal")
    parts.write_buckets(table.filter("c_custkey % 40 <> 7"), folder, ["c_custkey"], 64)
    new = table.filter("c_custkey % 40 = 7").unionByName(
        table.filter("c_custkey % 40 = 8").withColumn("c_name", F.lit("renamed")))
    parts.change_buckets(m.spark, folder, ["c_custkey"], ["c_name"], new,
                         table.filter("c_custkey % 40 = 9"), 64)
    parts.remove_rows(m.spark, folder, F.col("c_acctbal") < -900)
    return parts.read_parts(m.spark, folder).drop("bucket")


@query
def daily_extract(m: Mart) -> DataFrame:
    return views.daily_extract(m.orders, m.payments)


@query
def recent_orders(m: Mart) -> DataFrame:
    return views.recent_order_fact(m.orders, m.customers, m.payments, m.reviews, m.asof)


@query
def audit_extract(m: Mart) -> DataFrame:
    log = dq.audit_log(dq.audit(m.orders, m.payments, m.reviews),
                       datetime.combine(m.asof, datetime.min.time()))
    return dq.newest_audits(log).drop("audit_id", "details")


@query
def regional_summary(m: Mart) -> DataFrame:
    return views.regional_summary(m.orders, m.customers, m.payments, m.reviews, m.asof)


@query
def regional_summary_order_grain(m: Mart) -> DataFrame:
    return views.regional_summary(m.orders, m.customers, m.payments, m.reviews, m.asof,
                                  grain="order")


@query
def measures_total(m: Mart) -> DataFrame:
    return ms.measures(_fact(m))


@query
def measures_by_city(m: Mart) -> DataFrame:
    return ms.measures(_fact(m), [STATE, "customer_city"])


@query
def measures_daily(m: Mart) -> DataFrame:
    d = ms.daily_measures(_fact(m))
    return d.select(*[settle(F.col(c), 4).alias(c)
                      if c in ("rolling_std_14d", "ucl", "lcl") else F.col(c)
                      for c in d.columns])


@query
def daily_average_revenue(m: Mart) -> DataFrame:
    return ms.daily_average_revenue(_fact(m))


@query
def dq_integrity_score(m: Mart) -> DataFrame:
    log = dq.audit_log(dq.audit(m.orders, m.payments, m.reviews),
                       datetime.combine(m.asof, datetime.min.time()))
    return ms.integrity_score(log)


# --- drivers ---------------------------------------------------------------------------------

def _shift(m: Mart) -> DataFrame:
    return rc.state_shift(m.orders, m.customers, m.payments, m.asof)


@query
def regional_breakdown(m: Mart) -> DataFrame:
    return rc.regional_breakdown(_shift(m))


@query
def category_performance(m: Mart) -> DataFrame:
    return rc.category_performance(m.items, m.orders, m.products, m.translation, m.asof)


@query
def payment_diagnostics(m: Mart) -> DataFrame:
    return rc.payment_diagnostics(m.payments, m.orders, m.asof)


@query
def logistics_delays(m: Mart) -> DataFrame:
    return rc.logistics_delays(m.orders, m.customers, m.asof)


@query
def top_driver(m: Mart) -> DataFrame:
    return rc.top_driver(_shift(m))


@query
def top_driver_of_leaders(m: Mart) -> DataFrame:
    return rc.top_driver(_shift(m), among=8)


@query
def recommendations(m: Mart) -> DataFrame:
    return rc.recommendations(rc.top_driver(_shift(m)),
                              rc.payment_diagnostics(m.payments, m.orders, m.asof),
                              rc.logistics_delays(m.orders, m.customers, m.asof, days=90))


DRIVERS = [STATE, "customer_city", "order_status", "payment_type"]


def _driver_rows(m: Mart) -> DataFrame:
    o = placed(m).filter(F.col("purchase_ts") >= F.lit(m.asof - timedelta(days=14)))
    return (o.join(payment_totals(m.payments), "order_id", "left")
            .select(*DRIVERS, "purchase_ts", "paid"))


@query
def driver_ranking(m: Mart) -> DataFrame:
    """State, city, status and payment method ranked by their change in revenue."""
    return rc.rank_drivers(_driver_rows(m), DRIVERS, "purchase_ts", "paid", m.asof)


@query
def driver_combinations(m: Mart) -> DataFrame:
    """The twenty combinations of up to three of these that lost most revenue."""
    return rc.combination_drivers(_driver_rows(m), DRIVERS, "purchase_ts", "paid", m.asof)[0]


@query
def geography_rollup(m: Mart) -> DataFrame:
    return rc.geography_rollup(
        placed(m).join(payment_totals(m.payments), "order_id", "left"), "paid")


# --- forecast and scenarios -----------------------------------------------------------------

def _forecast_series(m: Mart, lookback: int = 45) -> DataFrame:
    return _series(m, lookback).filter("metric in ('revenue', 'volume')")


def _fits(m: Mart, lookback: int = 45) -> DataFrame:
    return forecast.fit(_forecast_series(m, lookback))


@query
def holt_fit(m: Mart) -> DataFrame:
    return _fits(m).select("segment", "metric", "level", "trend",
                           settle(F.col("std_err"), 4).alias("std_err"), "recent_mean",
                           "last_day", "points")


@query
def forecast_bands(m: Mart) -> DataFrame:
    return forecast.project(_fits(m), 14)


@query
def forecast_intervals(m: Mart) -> DataFrame:
    """Bands from a rolling back-test of each state's revenue and volume."""
    return forecast.intervals(_fits(m), forecast.backtest(_forecast_series(m), 10), 10)


@query
def forecast_too_short(m: Mart) -> DataFrame:
    return forecast.too_short(_fits(m, 10))


@query
def trend_direction(m: Mart) -> DataFrame:
    return forecast.trend_direction(_fits(m))


@query
def early_warnings(m: Mart) -> DataFrame:
    return forecast.early_warnings(_fits(m), 7)


GRID = [(p, c, d) for p in (-10.0, 0.0, 5.0) for c in (0.0, 3.0) for d in (0.0, 2.0)]


@query
def scenario_grid(m: Mart) -> DataFrame:
    base = scenario.baseline(placed(m), m.payments, m.asof, 30, STATE)
    return scenario.project(base, m.spark.createDataFrame(GRID, SCENARIO))


# --- incidents ------------------------------------------------------------------------------

def incident_log(events: DataFrame) -> DataFrame:
    """Errors alert on their user, signups acknowledge, purchases resolve."""
    kind = (F.when(F.col("event_type") == "error", "alert")
            .when(F.col("event_type") == "signup", "ack")
            .when(F.col("event_type") == "purchase", "resolve"))
    return events.withColumn("kind", kind).filter(F.col("kind").isNotNull()).select(
        F.concat(F.lit("user_"), F.col("user_id")).alias("kpi_name"), "ts",
        F.col("event_id").alias("seq"), "kind",
        F.when(F.col("value") > 100, "HIGH").otherwise("LOW").alias("severity"),
        "value", F.lit(100.0).alias("threshold"), F.col("props").alias("description"),
        F.concat(F.lit("user_"), F.col("user_id")).alias("actor"),
        F.concat(F.lit("event "), F.col("event_id")).alias("notes"))


@query
def incident_fold(m: Mart) -> DataFrame:
    return incidents.fold(incident_log(m.table("events"))).drop("incident_id")


@query
def incidents_newest(m: Mart) -> DataFrame:
    table = incidents.fold(incident_log(m.table("events")))
    return incidents.newest(table).select("created_at", "kpi_name", "severity", "status",
                                          "trigger_value")


@query
def incidents_from_alerts(m: Mart) -> DataFrame:
    """Open incidents of the alerts found by back-testing every day."""
    values = kv.kpi_values(m.orders, m.payments, m.customers, m.asof, m.first_day, whole=True)
    alerts = ev.alerts(ev.evaluate(values, spec_frame(m.spark)))
    table = incidents.fold(incidents.alert_events(alerts), bucket="month")
    return table.select("kpi_name", "created_at", "status", "severity", "trigger_value",
                        "threshold_value")


# --- streams -----------------------------------------------------------------------------------

def _stream(m: Mart) -> DataFrame:
    return rt.parquet_stream(m.spark, m.folder, "events")


def _unordered(m: Mart) -> DataFrame:
    """The events as six micro-batches that each hold rows of all times."""
    folder = work_dir(m.spark, "stream-input")
    m.table("events").repartition(6, F.xxhash64("event_id")).write.parquet(
        f"{folder}/events.parquet")
    return rt.parquet_stream(m.spark, folder, "events", files_per_trigger=1)


@query
def stream_upsert(m: Mart) -> DataFrame:
    folder = work_dir(m.spark, "stream-upsert")
    st.upsert_stream(_unordered(m), folder, ["user_id"], ["ts", "event_id"])
    st.compact(m.spark, folder, ["user_id"], ["ts", "event_id"])
    return st.current(m.spark, folder, ["user_id"], ["ts", "event_id"])


def _redelivered(m: Mart) -> DataFrame:
    """The events in five micro-batches of six days, some delivered again.

    Events divisible by 7 come twice in their batch; those with remainder 1 again a minute later;
    those divisible by 13 again, as they were, three batches later, behind the watermark; those
    divisible by 11 again with a time 18 days later, when their first delivery is forgotten.
    """
    folder = work_dir(m.spark, "stream-repeats")
    events = m.table("events").withColumn("ts", F.col("ts").cast("timestamp")).select(
        "event_id", "ts", "user_id")
    start = events.agg(F.date_trunc("day", F.min("ts"))).first()[0]
    batch = F.least(F.floor(F.datediff("ts", F.lit(start)) / 6), F.lit(4))
    plain_, late = events.withColumn("batch", batch), F.expr("interval 18 days")
    rows = (plain_.unionByName(plain_.filter("event_id % 7 = 0"))
            .unionByName(plain_.filter("event_id % 7 = 1").withColumn(
                "ts", F.col("ts") + F.expr("interval 1 minute")).withColumn("batch", batch))
            .unionByName(plain_.filter("event_id % 13 = 0 AND batch < 2").withColumn(
                "batch", F.col("batch") + 3))
            .unionByName(plain_.filter("event_id % 11 = 0 AND batch < 2").withColumn(
                "ts", F.col("ts") + late).withColumn("batch", F.col("batch") + 3))).persist()
    files = rt.write_batches(rows, "batch", range(5), f"{folder}/events.parquet")
    rows.unpersist()
    return rt.parquet_stream(m.spark, folder, "events", files_per_trigger=files)


@query
def stream_deduped(m: Mart) -> DataFrame:
    """How often each event survives the removal of repeats in front of an upsert."""
    folder = work_dir(m.spark, "stream-deduped")
    st.upsert_stream(_redelivered(m), folder, ["event_id", "ts"], ["ts"], ids=["event_id"])
    return (st.current(m.spark, folder, ["event_id", "ts"], ["ts"])
            .groupBy("event_id").agg(F.count(F.lit(1)).alias("kept")))


@query
def stream_daily_users(m: Mart) -> DataFrame:
    return rt.collect_append(sm.daily_users(_stream(m)), work_dir(m.spark, "stream-users"))


@query
def stream_weekly_users(m: Mart) -> DataFrame:
    """Users of a week from the merged sketches of its days, held against the exact number."""
    folder = work_dir(m.spark, "stream-sketches")
    st.user_stream(_unordered(m), folder)
    week = F.date_trunc("week", "day").cast("date").alias("week")
    merged = sk.users_between(st.daily_user_sketches(m.spark, folder), by=[week])
    exact = (m.table("events").withColumn("day", F.to_date("ts")).groupBy(week)
             .agg(F.count_distinct("user_id").alias("exact_users")))
    return merged.join(exact, "week").select(
        "week", "exact_users", (F.abs(F.col("users") - F.col("exact_users"))
                                <= 0.03 * F.col("exact_users")).alias("within_3_percent"))


@query
def quantiles_of_ranges(m: Mart) -> DataFrame:
    """Quartiles of the first ten and of all days from daily sketches, held against all values."""
    values = m.table("events").select(F.col("event_type").alias("segment"),
                                      F.to_date("ts").alias("day"), "value")
    first = values.agg(F.min("day")).first()[0]
    sketches = sk.value_sketches(values)
    rows = None
    for days in (10, 365):
        last = first + timedelta(days=days - 1)
        found = sk.quantiles_between(sketches, first=first, last=last)
        placed_ = values.filter(F.col("day") <= F.lit(last)).join(F.broadcast(found), "segment")
        ranks = [F.avg((test(F.col("value"), F.col("quantiles")[i])).cast("double"))
                 for i in range(3) for test in (lambda v, q: v < q, lambda v, q: v <= q)]
        checked = placed_.groupBy("segment", "n").agg(F.array(*ranks).alias("r")).select(
            "segment", F.lit(days).alias("days"), "n", F.forall(F.array(*(
                F.struct(F.lit(p).alias("p"), F.col("r")[2 * i].alias("lo"),
                         F.col("r")[2 * i + 1].alias("hi")) for i, p in enumerate((.25, .5, .75)))),
                lambda x: (x["lo"] <= x["p"] + 0.02) & (x["hi"] >= x["p"] - 0.02))
            .alias("ranks_within_2_percent"))
        rows = checked if rows is None else rows.unionByName(checked)
    return rows


@query
def stream_daily_metrics(m: Mart) -> DataFrame:
    return rt.collect_complete(sm.daily_metrics(_stream(m)),
                               work_dir(m.spark, "stream-daily")).drop("approx_users")


@query
def stream_daily_metrics_closed(m: Mart) -> DataFrame:
    """Only the days the watermark has passed."""
    return rt.collect_append(sm.daily_metrics(_stream(m)),
                             work_dir(m.spark, "stream-closed")).drop("approx_users")


@query
def stream_control_bands(m: Mart) -> DataFrame:
    bands = rt.collect_complete(sm.control_bands(_stream(m)), work_dir(m.spark, "stream-bands"))
    return bands.select(*[round_to(F.col(c), 4).alias(c) if c in ("mean", "std", "ucl", "lcl")
                          else F.col(c) for c in bands.columns])


def event_orders(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Purchases as orders; purchases and errors as payments, errors having no order."""
    bought = events.filter("event_type = 'purchase'")
    orders = bought.select(
        F.col("event_id").alias("order_id"), F.col("user_id").alias("customer_id"),
        F.lit("delivered").alias("order_status"), F.col("ts").alias("purchase_ts"),
        F.lit(None).cast("timestamp").alias("delivered_ts"))
    payments = events.filter("event_type in ('purchase', 'error')").select(
        F.col("event_id").alias("order_id"), F.lit(1).alias("payment_sequential"),
        F.col("event_type").alias("payment_type"), F.col("value").alias("payment_value"))
    return orders, payments


@query
def stream_audit(m: Mart) -> DataFrame:
    folder = work_dir(m.spark, "stream-audit")
    st.audit_stream(_unordered(m), folder, event_orders, settle_every=4)
    return st.audits(m.spark, folder).select("rule_name", "category", "severity", "failed_count")


@query
def stream_incidents(m: Mart) -> DataFrame:
    folder = work_dir(m.spark, "stream-incidents")
    st.incident_stream(incident_log(_unordered(m)), folder, "week", settle_every=4,
                       few_files=False)
    return st.incident_table(m.spark, folder).drop("incident_id")


@query
def stream_sessions(m: Mart) -> DataFrame:
    return rt.collect_append(sm.sessions(_stream(m)), work_dir(m.spark, "stream-sessions"))


@query
def stream_counters(m: Mart) -> DataFrame:
    return rt.collect_complete(sm.counters(_stream(m).filter("event_type = 'purchase'")),
                               work_dir(m.spark, "stream-counters"))
