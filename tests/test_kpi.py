import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluate as ev, kpivalues as kv
from tidemark.plans.registry import spec_frame

ASOF = date(2024, 6, 30)


def day(n):
    return (ASOF - timedelta(days=n)).isoformat()


def judge(spark, make, values, kind, threshold, period="previous_week"):
    rows = [("m", "ALL", day(n), v) for n, v in values]
    specs = [dict(name="m", threshold_type=kind, threshold_value=threshold,
                  comparison_period=period, alert_enabled=True)]
    return ev.evaluate(make("values", rows), spec_frame(spark, specs), ASOF).first()


@pytest.mark.parametrize("kind, history, cases", [
    ("percentage_drop", [100, 100], [(91, "normal"), (90, "normal"), (89, "alert")]),
    ("percentage_spike", [100, 100], [(109, "normal"), (110, "normal"), (111, "alert")]),
    ("absolute_drop", [100, 100], [(91, "normal"), (90, "normal"), (89, "alert")]),
    ("absolute_spike", [100, 100], [(109, "normal"), (110, "normal"), (111, "alert")]),
    ("statistical", [99, 101], [(109, "normal"), (110, "normal"), (111, "alert"),
                                (89, "alert")]),
    ("unheard_of", [100, 100], [(0, "normal"), (1000, "normal")]),
])
def test_thresholds_are_strict(spark, make, kind, history, cases):
    past = [(i + 1, v) for i, v in enumerate(history)]
    for current, status in cases:
        row = judge(spark, make, [*past, (0, current)], kind, 10.0)
        assert row["status"] == status, (kind, current)


def test_breach_amounts(spark, make):
    row = judge(spark, make, [(1, 100), (2, 100), (0, 75)], "percentage_drop", 10.0)
    assert (row["change_percent"], row["breach_amount"]) == (-25.0, 15.0)
    row = judge(spark, make, [(1, 99), (2, 101), (0, 115)], "statistical", 10.0)
    assert (row["z_score"], row["breach_amount"]) == (15.0, 5.0)


def test_baseline_edges(spark, make):
    none = judge(spark, make, [(0, 5)], "percentage_drop", 10.0)
    assert (none["status"], none["reason"]) == ("normal", ev.NO_HISTORY)
    zero = judge(spark, make, [(1, 0), (0, 5)], "percentage_spike", 10.0)
    assert (zero["status"], zero["reason"], zero["change_percent"]) == (
        "normal", ev.ZERO_BASELINE, 100.0)
    both = judge(spark, make, [(1, 0), (0, 0)], "percentage_drop", 10.0)
    assert (both["status"], both["reason"], both["change_percent"]) == (
        "normal", ev.BOTH_ZERO, None)
    flat = judge(spark, make, [(1, 5), (2, 5), (0, 9)], "statistical", 1.0)
    assert flat["status"] == "normal" and flat["z_score"] is None


def test_lone_history_day_counts_five_and_follows_its_rule(spark, make):
    row = judge(spark, make, [(3, 100), (0, 50)], "percentage_drop", 10.0)
    assert (row["historical_count"], row["historical_std"], row["status"]) == (5, 0.0, "alert")


def test_history_window_excludes_today_and_older_days(spark, make):
    week = judge(spark, make, [(8, 1e6), (7, 10), (1, 20), (0, 15)], "percentage_drop", 10.0)
    assert week["baseline"] == 15.0 and week["historical_values"] == [10.0, 20.0]
    month = judge(spark, make, [(31, 1e6), (30, 10), (8, 40), (0, 15)], "percentage_drop", 10.0,
                  "previous_month")
    assert month["baseline"] == 25.0


def test_negative_baseline_flips_the_sign(spark, make):
    row = judge(spark, make, [(1, -10), (2, -10), (0, -5)], "percentage_drop", 10.0)
    assert (row["change_percent"], row["status"]) == (-50.0, "alert")


def test_last_seven_history_values_in_day_order(spark, make):
    rows = [(n, 100 - n) for n in range(20, -1, -1)]
    row = judge(spark, make, rows, "percentage_drop", 10.0, "previous_month")
    assert row["historical_values"] == [float(100 - n) for n in range(7, 0, -1)]


def churn_cohort(make):
    orders = [(f"c{i}", f"churn{i}", "delivered", day(45)) for i in range(800)]
    for i in range(200):
        orders += [(f"r{i}", f"kept{i}", "delivered", day(50)),
                   (f"s{i}", f"kept{i}", "delivered", day(10))]
    orders += [(f"n{i}", f"new{i}", "delivered", day(5)) for i in range(500)]
    customers = {(c, "XX", "Test City") for _, c, *_ in orders}
    return make("orders", orders), make("customers", list(customers))


def test_churn_cohort_is_80(make):
    orders, customers = churn_cohort(make)
    assert kv.churn_rate(orders, customers, ASOF).first()["value"] == 80.0
    swept = kv.customer_kpis(orders, customers, ASOF, ASOF - timedelta(days=5)).filter(
        (F.col("day") == F.lit(ASOF)) & (F.col("kpi") == "customer_churn_rate"))
    assert float(swept.first()["value"]) == 80.0


def test_churn_counts_only_known_customers(make):
    orders = make("orders", [("1", "a", "delivered", day(45)), ("2", "b", "delivered", day(45)),
                             ("3", None, "delivered", day(45))])
    customers = make("customers", [("a", "X", "x")])
    assert kv.churn_rate(orders, customers, ASOF).first()["value"] == 50.0
    swept = kv.customer_kpis(orders, customers, ASOF, ASOF).filter(
        "kpi = 'customer_churn_rate'").first()
    assert float(swept["value"]) == 50.0


def test_customer_metrics_equal_brute_force(make):
    rng = random.Random(7)
    rows = [(str(i), f"c{min(rng.randrange(60), rng.randrange(60))}", "delivered",
             day(rng.randrange(150))) for i in range(400)]
    # one customer with a third of all orders
    rows += [(f"h{i}", "hot", "delivered", day(rng.randrange(20, 150))) for i in range(200)]
    state = {c: ("N" if hash(c) % 2 else "S") for _, c, *_ in rows}
    customers = make("customers", [(c, s, "x") for c, s in state.items()])
    got = {(r["kpi"], r["segment"], r["day"]): float(r["value"]) for r in kv.customer_kpis(
        make("orders", rows), customers, ASOF, ASOF - timedelta(days=80), "customer_state"
    ).collect()}
    bought = [(c, date.fromisoformat(d)) for _, c, _, d in rows]
    for back in range(81):
        d = ASOF - timedelta(days=back)
        for seg in ("ALL", "N", "S"):
            mine = [(c, p) for c, p in bought if seg == "ALL" or state[c] == seg]
            prior = {c for c, p in mine if 30 < (d - p).days <= 60}
            active = [c for c, p in mine if 0 <= (d - p).days <= 30]
            lost = prior - set(active)
            again = {c for c in active if active.count(c) > 1}
            churn = 100 * len(lost) / len(prior) if prior else 0.0
            repeat = 100 * len(again) / len(set(active)) if active else 0.0
            assert got["customer_churn_rate", seg, d] == pytest.approx(churn, abs=1e-6)
            assert got["repeat_customer_rate", seg, d] == pytest.approx(repeat, abs=1e-6)


def test_day_metrics(make):
    orders = make("orders", [
        ("1", "a", "delivered", day(0)), ("2", "b", "canceled", day(0)),
        ("3", "a", "invoiced", day(0)), ("4", "a", None, day(0)), ("5", "a", "shipped", day(1))])
    payments = make("payments", [("1", 1, "x", 10), ("1", 2, "x", 20), ("2", 1, "x", 99),
                                 ("3", 1, "x", None), ("4", 1, "x", 7)])
    rows = kv.day_kpis(orders, payments, ASOF, ASOF - timedelta(days=3)).collect()
    got = {(r["kpi"], r["day"]): float(r["value"]) for r in rows}
    assert got["daily_revenue", ASOF] == 30.0
    assert got["average_order_value", ASOF] == 15.0       # payment rows, not orders
    assert got["daily_order_volume", ASOF] == 2.0         # canceled and NULL status excluded
    assert got["conversion_rate", ASOF] == 25.0           # but kept in the denominator
    assert got["payment_approval_rate", ASOF] == 25.0
    yesterday = ASOF - timedelta(days=1)
    assert ("daily_revenue", yesterday) not in got        # no payment row that day
    assert got["daily_order_volume", yesterday] == 1.0


def test_empty_anchor_day_reads_zero(make):
    orders = make("orders", [("1", "a", "delivered", day(3))])
    rows = kv.day_kpis(orders, make("payments", []), ASOF, ASOF - timedelta(days=7)).filter(
        F.col("day") == F.lit(ASOF)).collect()
    assert {float(r["value"]) for r in rows} == {0.0} and len(rows) == 5


def test_delivery_window_is_open_ended_only_at_the_anchor(make):
    orders = make("orders", [
        ("1", "a", "delivered", day(20), day(8), day(0)),
        ("2", "a", "delivered", day(20), day(7), day(9)),
        ("3", "a", "delivered", day(20), day(-30), day(-60)),
        ("4", "a", "shipped", day(20), day(1), day(0))])
    rows = kv.delivery_kpis(orders, make("customers", []), ASOF,
                            ASOF - timedelta(days=1)).collect()
    got = {(r["kpi"], r["day"]): float(r["value"]) for r in rows}
    assert got["average_delivery_time", ASOF] == (13 + 50) / 2
    assert got["on_time_delivery_rate", ASOF] == 50.0
    assert got["average_delivery_time", ASOF - timedelta(days=1)] == 12.5
    assert got["on_time_delivery_rate", ASOF - timedelta(days=1)] == 50.0


def test_segments_add_up_to_the_total(make):
    orders, customers = churn_cohort(make)
    placed = orders.join(customers, "customer_id", "left")
    rows = kv.day_kpis(placed, make("payments", []), ASOF, ASOF - timedelta(days=60),
                       "customer_state").filter("kpi = 'daily_order_volume'")
    sums = {r["segment"]: r["s"] for r in rows.groupBy("segment").agg(
        F.sum("value").alias("s")).collect()}
    assert sums["ALL"] == sums["XX"] == 1700


def test_sql_metrics_with_history_and_errors(spark, make):
    make("orders", [(str(i), "a", "delivered", day(i % 9)) for i in range(90)]
         ).createOrReplaceTempView("t_orders")
    specs = [dict(name="per_day", threshold_type="percentage_drop", threshold_value=10,
                  sql_query="SELECT count(*) AS value FROM t_orders "
                            "WHERE to_date(purchase_ts) = :asof"),
             dict(name="with_history", threshold_type="absolute_drop", threshold_value=1,
                  sql_query="SELECT 1 AS value",
                  history_query="SELECT date_sub(:asof, 1) AS day, 4 AS value"),
             dict(name="broken", sql_query="SELEC 1")]
    rows = {r["kpi"]: r for r in ev.evaluate_sql(spark, specs, spec_frame(spark, specs),
                                                 ASOF).collect()}
    assert rows["per_day"]["baseline"] == 10.0 and rows["per_day"]["historical_count"] == 7
    assert rows["with_history"]["status"] == "alert"
    assert rows["broken"]["status"] == "error"
    assert rows["broken"]["reason"].startswith("Query execution failed")


def test_runtime_error_is_isolated(spark):
    specs = [dict(name="bad", sql_query="SELECT 1 / (id - id) AS value FROM range(1)"),
             dict(name="good", sql_query="SELECT 7 AS value")]
    rows = {r["kpi"]: r for r in ev.sql_kpi_values(spark, specs, ASOF, isolate=True).collect()}
    assert rows["good"]["value"] == 7.0 and rows["bad"]["error"].startswith("Query execution")


def test_run_status(spark):
    def status(*states):
        df = spark.createDataFrame([(s,) for s in states], "status string")
        return ev.run_summary(df).first()
    assert status("normal", "normal")["run_status"] == 0
    assert status("normal", "alert")["run_status"] == 2
    row = status("error", "alert")
    assert row["run_status"] == 1 and row["alert_rate_pct"] == 50.0


def test_change_band_limits(spark):
    df = spark.createDataFrame([(v,) for v in (-10.5, -10.0, -0.1, 0.0, 10.0, 10.1, None)],
                               "change_percent double")
    assert [r["band"] for r in ev.change_band(df).collect()] == [
        "below -10", "below 0", "below 0", "none", "none", "above 10", "N/A"]
