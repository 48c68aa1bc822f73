from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.monitor import Monitor
from tidemark.operators import measures as ms, rootcause as rc, scenario, views
from tidemark.schemas import SCENARIO

ASOF = date(2024, 6, 30)


def day(n, hour=0):
    return f"{(ASOF - timedelta(days=n)).isoformat()}T{hour:02d}:00:00"


@pytest.fixture(scope="module")
def tables(make):
    orders = make("orders", [
        ("o1", "c1", "delivered", day(3, 14), day(1, 2), day(0)),
        ("o2", "c1", "canceled", day(3), None, day(0)),
        ("o3", "c2", "delivered", day(10), day(1), day(5)),
        ("o4", None, "shipped", day(10), None, day(5)),
        ("o5", "c2", "delivered", day(2), day(2), day(2))])
    payments = make("payments", [("o1", 1, "boleto", 10), ("o1", 2, "voucher", 20),
                                 ("o2", 1, "credit_card", 5), ("o3", 1, "credit_card", 100),
                                 ("o5", 1, None, 7.5)])
    reviews = make("reviews", [("o1", 5), ("o1", 4), ("o3", 1), ("o5", 5), ("o5", 5)])
    customers = make("customers", [("c1", "N", "x"), ("c2", "S", "y")])
    return orders, customers, payments, reviews


def test_order_fact(tables):
    rows = {r["order_id"]: r for r in views.order_fact(*tables).collect()}
    assert len(rows) == 5
    o1 = rows["o1"]
    assert (float(o1["order_revenue"]), o1["payment_method"], o1["csat_review_score"],
            o1["delivery_days"], o1["is_on_time"], o1["order_hour"]) == (
        30.0, "voucher", 4.5, 1.5, 1, "14")
    o4 = rows["o4"]
    assert (float(o4["order_revenue"]), o4["payment_method"], o4["csat_review_score"],
            o4["csat_score_known"], o4["is_on_time"], o4["customer_state"]) == (
        0.0, "unspecified", 0.0, None, None, None)
    assert rows["o3"]["is_on_time"] == 0


def test_daily_summary_weighs_payment_rows(tables):
    orders, _, payments, _ = tables
    rows = {r["report_date"]: r for r in views.daily_summary(orders, payments).collect()}
    d3 = rows[ASOF - timedelta(days=3)]
    assert (d3["total_orders"], d3["delivered_orders"], float(d3["daily_revenue"]),
            d3["average_order_value"], d3["on_time_delivery_rate_pct"]) == (
        2, 1, 35.0, 11.67, 100.0)
    d10 = rows[ASOF - timedelta(days=10)]
    assert (d10["avg_delivery_time_days"], d10["on_time_delivery_rate_pct"]) == (9.0, 0.0)


def test_regional_grains(tables):
    orders, customers, payments, reviews = tables
    def first(grain):
        rows = views.regional_summary(orders, customers, payments, reviews, ASOF,
                                      min_orders=2, grain=grain).collect()
        return {r["customer_state"]: r for r in rows}
    joined, order = first("joined"), first("order")
    assert float(joined["N"]["state_revenue"]) == 65.0      # o1 counts once per review
    assert float(order["N"]["state_revenue"]) == 35.0
    assert joined["S"]["avg_csat"] == order["S"]["avg_csat"] == 3.67


def test_measures(tables):
    row = ms.measures(views.order_fact(*tables)).first()
    assert (row["total_orders"], row["delivered_orders"], row["on_time_orders"],
            row["sla_breaches"], row["promoters"], row["detractors"]) == (5, 3, 2, 1, 1, 1)
    assert row["aov"] == pytest.approx(142.5 / 5) and row["net_csat_pct"] == 0.0


def test_daily_measures_do_not_bridge_gaps(tables):
    rows = {r["order_date"]: r for r in ms.daily_measures(views.order_fact(*tables)).collect()}
    d3, d2 = rows[ASOF - timedelta(days=3)], rows[ASOF - timedelta(days=2)]
    assert d3["dod_growth_pct"] == 0.0                      # no row the day before
    assert float(d3["prior_period_revenue"]) == 100.0       # seven days earlier
    assert d2["dod_growth_pct"] == pytest.approx((7.5 - 35) / 35 * 100)
    assert d2["anomaly"] == "CRITICAL ALERT" and d2["prior_period_revenue"] is None
    assert d2["rolling_mean_14d"] == pytest.approx(142.5 / 3)


def test_driver_outside_the_leaders(make):
    orders, payments = [], []
    for i in range(9):
        orders.append((f"r{i}", f"c{i}", "shipped", day(1)))
        payments.append((f"r{i}", 1, "boleto", 100 + i))
        orders.append((f"p{i}", f"c{i}", "shipped", day(9)))
        payments.append((f"p{i}", 1, "boleto", 900 if i == 0 else 105 + i))
    customers = make("customers", [(f"c{i}", f"S{i}", "x") for i in range(9)])
    shift = rc.state_shift(make("orders", orders), customers, make("payments", payments), ASOF)
    assert rc.top_driver(shift).first()["top_variance_driver"] == "S0"
    assert rc.top_driver(shift, among=8).first()["top_variance_driver"] == "S1"
    rising = shift.withColumn("rev_prior", F.lit(0))
    row = rc.top_driver(rising).first()
    assert (row["top_variance_driver"], row["max_drop"]) == ("No state lost revenue", None)


def test_recommendations(spark):
    driver = spark.createDataFrame([("S1", 1234.5)],
                                   "top_variance_driver string, max_drop double")
    pay = "payment_type string, cancellation_rate_pct double"
    slow = "customer_state string, avg_delivery_days double, late_deliveries long"
    def advice(card, days):
        return [r["advice"] for r in rc.recommendations(
            driver, spark.createDataFrame([("credit_card", card), ("boleto", 99.0)], pay),
            spark.createDataFrame([("S2", days, 3)], slow)).orderBy("position").collect()]
    bad = advice(10.5, 8.1)
    assert "(-$1,234.50)" in bad[0] and "10.5% of the credit card" in bad[1]
    assert "'S2' took 8.1 days on average, 3 of them late" in bad[2]
    good = advice(10.0, 8.0)
    assert len(good) == 2 and good[1].startswith("Payments: no method")


def test_rank_drivers(spark):
    rows = spark.createDataFrame(
        [("a", "x", ASOF, 10), ("a", "y", ASOF - timedelta(days=8), 40),
         ("b", "x", ASOF - timedelta(days=8), 5), (None, "x", ASOF, 5)],
        "p string, q string, day date, v int")
    got = {(r["dimension"], r["member"]): r for r in rc.rank_drivers(
        rows, ["p", "q"], "day", "v", ASOF).collect()}
    assert got["p", "a"]["delta"] == -30 and got["p", "a"]["rank"] == 1
    assert got["p", "unknown"]["delta"] == 5
    assert sum(r["share"] for k, r in got.items() if k[0] == "p") == pytest.approx(1.0)
    best = rc.rank_drivers(rows, ["p", "q"], "day", "v", ASOF, n=1).collect()
    assert {r["rank"] for r in best} == {1} and len(best) == 2


def test_scenarios(spark, make):
    orders = make("orders", [(f"o{i}", "c", "shipped", day(5)) for i in range(50)])
    payments = make("payments", [(f"o{i}", 1, "x", 20) for i in range(50)])
    grid = spark.createDataFrame([(0.0, 0.0, 0.0), (10.0, 0.0, 0.0), (0.0, 0.0, 100.0),
                                  (0.0, 2.0, 0.0)], SCENARIO)
    rows = {(r["price_change_pct"], r["churn_change_pct"], r["delivery_delay_days"]): r
            for r in scenario.project(scenario.baseline(orders, payments, ASOF), grid).collect()}
    same = rows[0, 0, 0]
    assert (same["sim_orders"], same["revenue_delta"]) == (50.0, 0.0)
    assert same["assessment"].startswith("Net Revenue Impact: +$0.00 (+0.0%). Adverse")
    dearer = rows[10, 0, 0]
    assert dearer["volume_change_pct"] == -12.5 and dearer["sim_orders"] == 44.0  # half to even
    assert rows[0, 0, 100]["sim_orders"] == 0.0
    assert rows[0, 2, 0]["sim_orders"] == 50.0


def test_scenario_standins(make, spark):
    orders = make("orders", [("o", "c", "shipped", day(1))])
    row = scenario.baseline(orders, make("payments", []), ASOF).first()
    assert (row["base_orders"], row["base_revenue"], row["base_aov"]) == (1.0, 10000.0, 100.0)


class Source:
    def __init__(self, make, tables):
        self.orders, self.customers, self.payments, self.reviews = tables
        self.items = make("items", [("o1", 1, "p1", 10), ("o3", 1, "p2", 30),
                                    ("o5", 1, "p9", 1)])
        self.products = make("products", [("p1", "casa"), ("p2", None)])
        self.translation = make("translation", [("casa", "home")])
        self.asof = ASOF


def test_monitor_answers_every_question(make, tables, tmp_path):
    m = Monitor(Source(make, tables))
    assert m.kpis().count() == 9
    assert m.board().count() == 9 and m.summary().first()["total"] == 9
    assert m.kpis("customer_state").count() == 27
    assert m.audit().count() == 8 and m.health().first()["total_orders_audited"] == 5
    assert m.clean()["orders"][0].count() == 5
    assert m.trends()["stats"].count() == 4
    assert m.forecast()["errors"].count() == 2
    assert m.what_if(price=5).count() == 1
    found = m.diagnose()
    assert {r["category"] for r in found["categories"].collect()} == {"home", "Other"}
    assert m.measures(["customer_state"]).count() == 3
    manifest = {r["extract"]: r["rows"] for r in m.export(str(tmp_path / "out")).collect()}
    assert manifest["orders"] == 5 and manifest["daily_kpis"] == 3


def test_monitor_with_own_sql_metric(make, tables):
    specs = [dict(name="open_orders", sql_query="SELECT count(*) AS value FROM orders "
                                                "WHERE order_status = 'shipped'"),
             dict(name="daily_revenue", threshold_type="percentage_drop", threshold_value=10)]
    rows = {r["kpi"]: r for r in Monitor(Source(make, tables), specs).kpis().collect()}
    assert rows["open_orders"]["current_value"] == 1.0 and "daily_revenue" in rows


def test_combinations_equal_a_full_cube_and_count_less(spark):
    import random
    from datetime import date, timedelta
    from itertools import combinations

    from tidemark.operators import rootcause as rc

    rng = random.Random(1)
    dims, asof = ["a", "b", "c", "d"], date(2024, 6, 30)
    rows = []
    for _ in range(3000):
        cell = tuple(rng.choice([f"{x}{i}" for i in range(8)] + [None]) for x in "abcd")
        old = rng.random() < 0.5
        value = rng.randrange(1, 40) + (400 if old and cell[:2] == ("a1", "b2") else 0)
        rows.append((*cell, asof - timedelta(days=rng.randrange(8, 14) if old else rng.randrange(6)),
                     value))
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, day date, v long")
    sums = {}
    for *cell, day, v in rows:
        for k in (1, 2, 3):
            for chosen in combinations(range(4), k):
                name = ", ".join(f"{dims[i]}={cell[i] or 'unknown'}" for i in chosen)
                sums[name] = sums.get(name, 0) + (v if day >= asof - timedelta(days=7) else -v)
    want = sorted((d, name) for name, d in sums.items())[:5]
    top, counted = rc.combination_drivers(df, dims, "day", "v", asof, n=5)
    assert [(r.delta, r.combination) for r in top.orderBy("rank").collect()] == want
    assert counted[0] == 36 and sum(counted) < len(sums)
    none, _ = rc.combination_drivers(df.limit(0), dims, "day", "v", asof)
    assert none.count() == 0
