"""Plan shape: what reaches the scan, where rows shrink, and what happens to hot keys."""

import re
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import incidents, kpivalues as kv, quality, rollup, rootcause as rc, views
from tidemark.plans import configure
from tidemark.sources.conformed import Mart

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def settings(spark):
    """Change settings for one test."""
    changed = {}

    def change(**kv_):
        for key, value in kv_.items():
            key = key.replace("__", ".")
            changed.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)
    yield change
    for key, value in changed.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    configure(spark)


@pytest.fixture
def no_broadcast(settings):
    """Plans as they are when nothing is small."""
    settings(spark__sql__autoBroadcastJoinThreshold="-1",
             spark__sql__adaptive__autoBroadcastJoinThreshold="-1")
    return settings


@pytest.fixture(scope="module")
def mart(spark):
    return Mart(spark, SF)


def test_date_windows_reach_the_scan(mart):
    text = plan(rc.state_shift(mart.orders, mart.customers, mart.payments, mart.asof))
    edge = (mart.asof - timedelta(days=14)).isoformat()
    assert f"GreaterThanOrEqual(o_orderdate,{edge}T00:00)" in text


def test_only_needed_columns_are_read(mart):
    text = plan(rollup.daily_rollup(mart.orders, mart.payments))
    schemas = set(re.findall(r"ReadSchema: struct<([^>]*)>", text))
    read = {c.split(":")[0] for s in schemas for c in s.split(",")}
    assert read == {"o_orderkey", "o_orderstatus", "o_orderdate", "l_orderkey", "l_shipdate",
                    "l_extendedprice"}


def test_children_combine_before_their_exchange(mart, no_broadcast):
    text = plan(views.daily_summary(mart.orders, mart.payments))
    below = text[text.rindex("hashpartitioning(order_id"):]
    assert "HashAggregate" in below.split("FileScan")[0]


def test_order_join_and_order_aggregate_share_one_partitioning(mart, no_broadcast):
    text = plan(rollup.daily_rollup(mart.orders, mart.payments))
    # one exchange for each side of the order joins, one for the final days
    assert text.count("Exchange hashpartitioning") == 4
    assert not re.search(r"hashpartitioning\(\w*segment\w*#\d+, \w*#\d+, order_id", text)


def test_bloom_filter_thins_the_child_scan(mart, no_broadcast):
    no_broadcast(spark__sql__optimizer__runtime__bloomFilter__applicationSideScanSizeThreshold="0")
    for df in (rc.state_shift(mart.orders, mart.customers, mart.payments, mart.asof),
               rc.category_performance(mart.items, mart.orders, mart.products, mart.translation,
                                       mart.asof)):
        assert "might_contain" in plan(df)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_customer_is_split(spark, make, no_broadcast, tmp_path):
    no_broadcast(spark__sql__adaptive__advisoryPartitionSizeInBytes="4KB",
                 spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="6KB",
                 spark__sql__adaptive__skewJoin__skewedPartitionFactor="1.2")
    n = 30_000
    orders = spark.range(0, n, 1, 8).select(
        F.col("id").cast("string").alias("order_id"),
        F.when(F.col("id") < n // 3, "hot").otherwise(F.concat(F.lit("c"), "id"))
        .alias("customer_id"), F.lit("delivered").alias("order_status"),
        F.lit(datetime(2024, 6, 1)).alias("purchase_ts"),
        F.lit(datetime(2024, 6, 3)).alias("delivered_ts"),
        F.lit(datetime(2024, 6, 9)).alias("estimated_ts"))
    orders.select("customer_id").distinct().select(
        "customer_id", F.lit("N").alias("customer_state"), F.lit("x").alias("customer_city")
    ).write.parquet(str(tmp_path / "customers"))
    customers = spark.read.parquet(str(tmp_path / "customers"))
    payments = orders.select("order_id", F.lit(1).alias("payment_sequential"),
                             F.lit("boleto").alias("payment_type"),
                             F.lit(2).cast("decimal(18,2)").alias("payment_value"))
    placed = orders.join(customers, "customer_id", "left")
    df = kv.day_kpis(placed, payments, date(2024, 6, 1), date(2024, 6, 1), "customer_state",
                     kv.segment_list(customers, "customer_state"), whole=True)
    text = final_plan(df)
    assert "skew=true" in text
    got = {(r["kpi"], r["segment"]): float(r["value"]) for r in df.collect()}
    assert got["daily_revenue", "N"] == 2 * n and got["daily_order_volume", "ALL"] == n


def test_hot_order_with_a_third_of_all_payments(spark, make):
    n = 60_000
    payments = spark.range(0, n, 1, 8).select(
        F.when(F.col("id") < n // 3, "hot").otherwise(F.concat(F.lit("o"), F.col("id") % 500))
        .alias("order_id"), F.col("id").cast("int").alias("payment_sequential"),
        F.lit("boleto").alias("payment_type"),
        F.lit("1.25").cast("decimal(18,2)").alias("payment_value"))
    orders = make("orders", [("hot", "c", "delivered", "2024-06-01T00:00:00",
                              "2024-06-03T00:00:00", "2024-06-09T00:00:00")]
                  + [(f"o{i}", "c", "delivered", "2024-06-01T00:00:00") for i in range(500)])
    row = rollup.daily_rollup(orders, payments).first()
    assert float(row["revenue"]) == n * 1.25 and row["order_volume"] == 501
    # weighted by payment rows, only the hot order was delivered
    assert row["delivery_days"] == 2.0
    lost = quality.orphans(payments, orders.filter("order_id <> 'hot'"), "r").first()
    assert lost["failed_count"] == n // 3


def test_audit_reads_each_table_once(spark, make, no_broadcast, tmp_path):
    rows = {"orders": [("o", "c", "delivered", "2024-06-01T00:00:00")],
            "payments": [("o", 1, "boleto", 10), ("o", 1, "boleto", 10), ("gone", 1, "boleto", -1),
                         (None, 1, "boleto", 1)],
            "items": [("o", 1), ("gone", 1), ("gone", 2)]}
    for name, given in rows.items():
        make(name, given).write.parquet(str(tmp_path / name))
    tables = {name: spark.read.parquet(str(tmp_path / name)) for name in rows}
    results = quality.audit(tables["orders"], tables["payments"], items=tables["items"])
    text = plan(results)
    assert text.count("FileScan") == 3 and text.count("Exchange hashpartitioning") == 2
    found = {r["rule_name"]: r["failed_count"] for r in results.collect()}
    assert found == {
        "Orders Primary Fields Completeness": 0, "Payment Records Completeness": 1,
        "Order ID Uniqueness": 0, "Payment Sequence Uniqueness": 1,
        "Payment Value Domain Validity": 1, "Chronological Delivery Logic": 0,
        "Orphan Payments Check": 1, "Orphan Line Items Check": 2}


def test_hot_metric_is_spread_over_its_time_buckets(spark):
    n = 20_000
    log = spark.range(0, n, 1, 8).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("m"), F.col("id") % 50))
        .alias("kpi_name"),
        (F.lit(datetime(2024, 1, 1)) + F.make_dt_interval(F.lit(0), F.lit(0), F.col("id").cast(
            "int"))).alias("ts"), F.col("id").alias("seq"),
        F.when(F.col("id") % 7 == 0, "resolve").otherwise("alert").alias("kind"),
        F.lit("LOW").alias("severity"), F.lit(1.0).alias("value"), F.lit(0.0).alias("threshold"),
        F.lit("").alias("description"), F.lit("a").alias("actor"), F.lit("n").alias("notes"))
    numbered = incidents.running_before(log, "kpi_name", F.col("kind") == "resolve", "no")
    hot = numbered.filter("kpi_name = 'hot'")
    assert hot.agg(F.max("no")).first()[0] == len([i for i in range(0, n, 21)]) - 1 or \
        hot.agg(F.max("no")).first()[0] == len([i for i in range(0, n, 21)])
    windows = re.findall(r"Window .*?\[([^\]]*)\], \[ts", plan(numbered).replace("\n", " "))
    assert windows and all("_bucket" in w for w in windows)
