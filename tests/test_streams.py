import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.catalog.queries import event_orders, incident_log
from tidemark.operators import incidents
from tidemark.plans import work_dir
from tidemark.streaming import metrics as sm, runtime as rt, state as st

T0 = datetime(2024, 1, 1)
KINDS = ["error", "signup", "purchase", "view"]


def build(spark, n=600, seed=5):
    rng = random.Random(seed)
    rows = [(i, T0 + timedelta(minutes=20 * i, seconds=rng.randrange(60)),
             0 if rng.random() < 0.34 else rng.randrange(1, 9), rng.choice(KINDS),
             round(rng.uniform(0, 200), 2), "{}") for i in range(n)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, "
                                       "event_type string, value double, props string")


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """The events as four files in time order, read one per micro-batch."""
    folder = tmp_path_factory.mktemp("stream")
    events = build(spark)
    for k in range(4):
        part = events.filter(f"event_id >= {k * 150} and event_id < {(k + 1) * 150}")
        part.coalesce(1).write.mode("append").parquet(str(folder / "events.parquet"))
    return str(folder), events


def stream(spark, files):
    return rt.parquet_stream(spark, files[0], "events", files_per_trigger=1)


def same(a, b):
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    return sorted(map(str, a.select(cols).collect())) == sorted(map(str, b.select(cols).collect()))


def test_complete_mode_equals_batch(spark, files):
    got = rt.collect_complete(sm.daily_metrics(stream(spark, files)), work_dir(spark, "t"))
    want = files[1].groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.sum(F.col("value").cast("decimal(18,2)")).alias("total")).select(
        F.col("w.start").alias("day_start"), "event_type", "n_events", "total")
    assert same(got.drop("approx_users"), want)


def test_append_mode_withholds_open_days(spark, files):
    got = rt.collect_append(sm.daily_metrics(stream(spark, files)), work_dir(spark, "t"))
    newest = files[1].agg(F.max("ts")).first()[0]
    assert got.count() > 0
    assert got.agg(F.max("day_start")).first()[0] + timedelta(days=1) <= newest


def test_counters_and_bands(spark, files):
    row = rt.collect_complete(sm.counters(stream(spark, files)), work_dir(spark, "t")).first()
    want = files[1].agg(F.count(F.lit(1)), F.max("ts")).first()
    assert (row["orders"], row["last_event_at"]) == (want[0], want[1])
    bands = rt.collect_complete(sm.control_bands(stream(spark, files)), work_dir(spark, "t"))
    assert bands.filter("lcl < 0 or ucl < mean").count() == 0


def test_sessions_close_after_the_gap(spark, files):
    got = rt.collect_append(sm.sessions(stream(spark, files)), work_dir(spark, "t"))
    assert got.agg(F.sum("n_events")).first()[0] <= files[1].count()
    assert got.filter("session_end < session_start + interval 30 minutes").count() == 0


def test_upsert_over_batches_keeps_the_last_write(spark, files):
    folder = work_dir(spark, "t")
    st.upsert_stream(stream(spark, files), folder, ["user_id"], ["ts", "event_id"])
    got = {r["user_id"]: r["event_id"]
           for r in st.current(spark, folder, ["user_id"], ["ts", "event_id"]).collect()}
    want = {r["user_id"]: r["e"] for r in files[1].groupBy("user_id").agg(
        F.max_by("event_id", "ts").alias("e")).collect()}
    assert got == want


def test_duplicate_deliveries_are_dropped(spark, tmp_path):
    events = build(spark, 50)
    events.union(events).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    folder = work_dir(spark, "t")
    deduped = rt.parquet_stream(spark, str(tmp_path), "events").withWatermark(
        "ts", "1 hour").dropDuplicatesWithinWatermark(["event_id"])
    assert rt.collect_append(deduped, folder).count() == 50


def test_replayed_batch_replaces_its_output(spark, files, tmp_path):
    rt.write_batch(files[1], str(tmp_path / "log"), 3)
    rt.write_batch(files[1].limit(5), str(tmp_path / "log"), 3)
    assert rt.read_all(spark, str(tmp_path / "log")).count() == 5


@pytest.fixture(scope="module")
def mixed(spark, tmp_path_factory):
    """The same events in six files that each hold rows of all times."""
    folder = tmp_path_factory.mktemp("mixed")
    events = build(spark)
    events.repartition(6, F.xxhash64("event_id")).write.parquet(str(folder / "events.parquet"))
    return str(folder), events


def test_upsert_takes_rows_of_any_lateness(spark, mixed):
    folder, keys, order = work_dir(spark, "t"), ["user_id"], ["ts", "event_id"]
    st.upsert_stream(stream(spark, mixed), folder, keys, order)
    want = {r["user_id"]: r["e"] for r in mixed[1].groupBy("user_id").agg(
        F.max_by("event_id", "ts").alias("e")).collect()}
    for _ in range(2):
        got = st.current(spark, folder, keys, order)
        assert {r["user_id"]: r["event_id"] for r in got.collect()} == want
        assert st.compact(spark, folder, keys, order) == 5


def test_audit_does_not_depend_on_batches(spark, files, mixed):
    want = None
    for source in (files, mixed):
        folder = work_dir(spark, "t")
        st.audit_stream(stream(spark, source), folder, event_orders)
        got = {r["rule_name"]: r["failed_count"] for r in st.audits(spark, folder).collect()}
        assert got["Orphan Payments Check"] == files[1].filter("event_type = 'error'").count()
        assert want in (None, got)
        want = got


def test_payment_may_come_a_batch_after_its_order(spark, tmp_path):
    rows = [(1, T0, "order"), (1, T0, "payment"), (1, T0, "payment"), (2, T0, "payment")]
    events = spark.createDataFrame(rows, "id long, ts timestamp, kind string")
    for k in range(4):
        spark.createDataFrame(rows[k:k + 1], events.schema).coalesce(1).write.mode(
            "append").parquet(str(tmp_path / "events.parquet"))

    def split(df):
        orders = df.filter("kind = 'order'").select(
            F.col("id").alias("order_id"), F.col("id").alias("customer_id"),
            F.lit("delivered").alias("order_status"), F.col("ts").alias("purchase_ts"),
            F.lit(None).cast("timestamp").alias("delivered_ts"))
        return orders, df.filter("kind = 'payment'").select(
            F.col("id").alias("order_id"), F.lit(1).alias("payment_sequential"),
            F.lit("credit_card").alias("payment_type"), F.lit(5.0).alias("payment_value"))

    folder = work_dir(spark, "t")
    st.audit_stream(rt.parquet_stream(spark, str(tmp_path), "events", 1), folder, split)
    got = {r["rule_name"]: r["failed_count"] for r in st.audits(spark, folder).collect()}
    assert got["Orphan Payments Check"] == 1


def test_stream_incidents_equal_the_batch_fold(spark, files, mixed):
    for source in (files, mixed):
        folder = work_dir(spark, "t")
        st.incident_stream(incident_log(stream(spark, source)), folder)
        assert same(st.incident_table(spark, folder), incidents.fold(incident_log(source[1])))


EVENT = ("kpi_name string, ts timestamp, seq long, kind string, severity string, value double, "
         "threshold double, description string, actor string, notes string")


def test_rejects_and_calls_by_id(spark):
    def event(name, hour, kind):
        return (name, None if hour is None else T0 + timedelta(hours=hour), 0, kind, "HIGH", 1.0,
                2.0, "d", None, None)

    log = spark.createDataFrame([event("a", 1, "alert"), event("b", 2, "alert"),
                                 event(None, 3, "alert"), event("a", None, "alert")], EVENT)
    state = incidents.fold(log)
    ids = {r["kpi_name"]: r["incident_id"] for r in state.collect()}
    assert set(ids) == {"a", "b"} and incidents.rejects(log).count() == 2
    calls = spark.createDataFrame(
        [(ids["a"], T0 + timedelta(hours=5), "me"), ("inc_unknown", T0, "me")],
        "incident_id string, ts timestamp, actor string")
    log = log.unionByName(incidents.acknowledge(state, calls))
    state = incidents.fold(log)
    assert {r["kpi_name"]: r["status"] for r in state.collect()} == {
        "a": "ACKNOWLEDGED", "b": "OPEN"}
    assert incidents.acknowledge(state, calls).count() == 0
    log = log.unionByName(incidents.resolve(state, calls.withColumnRenamed("actor", "notes")))
    state = incidents.fold(log)
    assert {r["kpi_name"]: r["status"] for r in state.collect()} == {"a": "RESOLVED", "b": "OPEN"}
    assert incidents.resolve(state, calls.withColumnRenamed("actor", "notes")).count() == 0


def replay(events):
    """Row-by-row reference of the lifecycle."""
    open_, done = {}, []
    for e in events:
        k = e["kpi_name"]
        if e["kind"] == "alert":
            inc = open_.setdefault(k, dict(kpi=k, created=e["ts"], status="OPEN", by=None))
            inc.update(severity=e["severity"], value=e["value"])
        elif e["kind"] == "ack" and k in open_:
            open_[k].update(status="ACKNOWLEDGED", by=e["actor"])
        elif e["kind"] == "resolve" and k in open_:
            done.append({**open_.pop(k), "status": "RESOLVED"})
    return done + list(open_.values())


@pytest.mark.parametrize("bucket", ["minute", "hour", "day", "month"])
def test_fold_equals_row_by_row_replay(spark, bucket):
    log = incident_log(build(spark, 500, 11))
    got = {(r["kpi_name"], r["created_at"], r["status"], r["severity"], r["trigger_value"],
            r["acknowledged_by"]) for r in incidents.fold(log, bucket).collect()}
    want = {(i["kpi"], i["created"], i["status"], i["severity"], i["value"], i["by"])
            for i in replay(log.orderBy("ts", "seq").collect())}
    assert got == want and len(got) > 20


def test_idle_events_do_nothing(spark):
    log = incident_log(build(spark, 40)).filter("kind <> 'alert'")
    assert incidents.fold(log).count() == 0 and incidents.compact(log).count() == 0


def test_compacted_log_folds_the_same(spark):
    log = incident_log(build(spark, 400, 2)).persist()
    cut = "seq < 200"
    early, late = log.filter(cut), log.filter(f"not ({cut})")
    carried = incidents.compact(early)
    assert carried.count() <= 3 * early.select("kpi_name").distinct().count()
    rest = incidents.fold(carried.unionByName(late.select(*incidents.EVENT_COLUMNS)))
    closed_before = incidents.fold(early).filter("status = 'RESOLVED'")
    assert same(incidents.fold(log), closed_before.unionByName(rest))
