from datetime import datetime

from tidemark.operators import quality as dq
from tidemark.sources import sinks

GOOD = ("o1", "c1", "delivered", "2024-01-01T00:00:00", "2024-01-03T00:00:00",
        "2024-01-09T00:00:00")


def failed(results):
    return {r["rule_name"]: r["failed_count"] for r in results.collect()}


def defects(make):
    orders = make("orders", [
        GOOD, ("dq_err_1", "test_cst", None, "2024-01-01T00:00:00"),
        ("dq_err_2", "test_cst", "delivered", "2024-01-01T00:00:00"),
        ("dq_err_3", "test_cst", "delivered", "2024-01-05T00:00:00", "2024-01-03T00:00:00")])
    payments = make("payments", [("o1", 1, "boleto", 10), ("dq_err_2", 1, "boleto", -95.5),
                                 ("dq_err_orphan", 1, "boleto", 150)])
    return orders, payments, make("reviews", [("o1", 5)])


def test_injected_defects_are_each_found_once(make):
    results = dq.audit(*defects(make))
    assert failed(results) == {
        "Orders Primary Fields Completeness": 1, "Payment Records Completeness": 0,
        "Order ID Uniqueness": 0, "Payment Sequence Uniqueness": 0,
        "Payment Value Domain Validity": 1, "Chronological Delivery Logic": 1,
        "Orphan Payments Check": 1, "Customer Review Score Bounds": 0}
    health = dq.health(results, defects(make)[0]).first()
    assert (health["overall_score"], health["status"], health["total_orders_audited"]) == (
        50.0, "CRITICAL", 4)


def test_seven_of_eight_is_87_5(spark):
    rows = spark.createDataFrame([("PASS",)] * 7 + [("FAIL",)], "status string")
    row = dq.score(rows).first()
    assert (row["overall_score"], row["status"]) == (87.5, "DEGRADED")


def test_health_limits(spark):
    def health(passed, total):
        rows = [("PASS",)] * passed + [("FAIL",)] * (total - passed)
        return dq.score(spark.createDataFrame(rows, "status string")).first()["status"]
    assert [health(9, 10), health(8, 10), health(7, 10), health(6, 10)] == [
        "HEALTHY", "DEGRADED", "DEGRADED", "CRITICAL"]


def test_duplicates_count_keys_and_null_keys_group(make):
    orders = make("orders", [GOOD, GOOD, GOOD, ("o2",) + GOOD[1:], (None,) + GOOD[1:],
                             (None,) + GOOD[1:]])
    assert dq.duplicate_keys(orders, ["order_id"], "r").first()["failed_count"] == 2


def test_null_keys_are_not_orphans(make):
    orders = make("orders", [GOOD, (None,) + GOOD[1:]])
    payments = make("payments", [(None, 1, "x", 1), ("o1", 1, "x", 1), ("gone", 1, "x", 1),
                                 ("gone", 2, "x", 1)])
    assert dq.orphans(payments, orders, "r").first()["failed_count"] == 2


def test_review_bounds_pass_null(make):
    reviews = make("reviews", [("a", 0), ("b", 1), ("c", 5), ("d", 6), ("e", None)])
    assert dq.review_rules(reviews).first()["failed_count"] == 2


def test_remediation_splits_without_cascade(make):
    orders, payments, _ = defects(make)
    orders = orders.unionByName(make("orders", [("DQ_ERR_9", "x", "shipped"),
                                                ("o7", "x", None), (None, "x", "shipped")]))
    payments = payments.unionByName(make("payments", [("o7", 1, "x", 3), ("o1", 2, "x", -1)]))
    out = dq.remediate(orders, payments, make("items", [("dqxerr_1", 1), ("o1", 1)]))
    kept = {n: sorted(str(r["order_id"]) for r in k.collect()) for n, (k, _) in out.items()}
    assert kept == {"orders": ["None", "o1"], "payments": ["o1", "o7"], "items": ["o1"]}
    for name, (keep, drop) in out.items():
        total = {"orders": orders, "payments": payments}.get(name)
        if total is not None:
            assert keep.count() + drop.count() == total.count()


def test_audit_log_appends_runs(spark, make, tmp_path):
    results = dq.audit(*defects(make))
    for d in (1, 2):
        sinks.append_audit(dq.audit_log(results, datetime(2024, 1, d)), str(tmp_path / "log"))
    log = spark.read.parquet(str(tmp_path / "log"))
    assert log.count() == 16 and log.select("audit_id").distinct().count() == 16
    assert {r["score"] for r in log.collect()} == {50.0}
    newest = dq.newest_audits(log, 8).collect()
    assert {r["run_timestamp"] for r in newest} == {datetime(2024, 1, 2)}
