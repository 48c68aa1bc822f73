"""State that micro-batches change: incidents by slot, audit counters, repeats, sketches."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.catalog.queries import event_orders, incident_log
from tidemark.operators import incidents, quality, sketches
from tidemark.plans import work_dir
from tidemark.streaming import metrics as sm, runtime as rt, state as st

from test_streams import T0, build, same

SCHEMA = ("event_id long, ts timestamp, user_id long, event_type string, value double, "
          "props string")


def batches_of(spark, folder, parts):
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")


@pytest.mark.parametrize("width", ["hour", "day", "month"])
def test_pieces_of_any_width_assemble_to_the_fold(spark, width):
    log = incident_log(build(spark, 500, 11)).withColumn("slot", incidents.slot(width))
    assert same(incidents.assemble(incidents.pieces(log)), incidents.fold(log.drop("slot")))


def test_a_batch_reads_only_the_slots_it_touches(spark, tmp_path):
    """One day a batch: what is read stays the same however many days came before."""
    events = build(spark, 600)                     # about eight days
    days = [events.filter(F.to_date("ts") == F.lit(T0.date() + timedelta(days=d)))
            for d in range(6)]
    folder, read, whole = work_dir(spark, "t"), [], None
    for d, day in enumerate(days):
        batches_of(spark, tmp_path, [day])
        st.incident_stream(incident_log(rt.parquet_stream(spark, str(tmp_path), "events", 1)),
                           folder)
        touched, again = st.touched_events(spark, folder, d - 1)
        read.append(again.count())
        plan = again._jdf.queryExecution().executedPlan().toString()
        assert d == 0 or f"[t2024-01-0{d + 1}-00]" in plan.split("PartitionFilters: ")[1] or (
            f"= t2024-01-0{d + 1}-00" in plan)
        whole = day if whole is None else whole.unionByName(day)
        assert st.settle_incidents(spark, folder) == d
        assert same(st.incident_table(spark, folder), incidents.fold(incident_log(whole)))
    assert max(read) <= 72 and sum(read) <= incident_log(whole).count()
    assert st.compact_incidents(spark, folder) == 5
    assert same(st.incident_table(spark, folder), incidents.fold(incident_log(whole)))


def test_late_and_replayed_events(spark, tmp_path):
    events = build(spark, 400, 21)
    parts = [events.filter(f"event_id % 3 = {k}") for k in (2, 0, 1)]
    batches_of(spark, tmp_path, parts)
    folder = work_dir(spark, "t")
    st.incident_stream(incident_log(rt.parquet_stream(spark, str(tmp_path), "events", 1)), folder,
                       settle_every=2)
    want = incidents.fold(incident_log(events))
    assert same(st.incident_table(spark, folder), want)
    # The last batch again, as after a failure before its commit.
    (incident_log(parts[2]).select(*incidents.EVENT_COLUMNS)
     .withColumn("slot", incidents.slot()).write.mode("overwrite").partitionBy("slot")
     .parquet(f"{folder}/events/batch=2"))
    assert same(st.incident_table(spark, folder), want)


def test_events_without_place_are_rejects(spark, tmp_path):
    rows = [(1, None, 3, "error", 1.0, "{}"), (2, T0, None, "error", 1.0, "{}"),
            (3, T0, 3, "error", 1.0, "{}")]
    batches_of(spark, tmp_path, [spark.createDataFrame(rows, SCHEMA)])
    folder = work_dir(spark, "t")
    st.incident_stream(incident_log(rt.parquet_stream(spark, str(tmp_path), "events")), folder)
    assert st.incident_rejects(spark, folder).count() == 2
    assert st.incident_table(spark, folder).count() == 1


def deliveries(seed):
    """Orders and payments with null and repeated keys, orphans, in any order."""
    rng = random.Random(seed)
    rows = []
    for i in range(160):
        kind = rng.choice(["order", "payment", "payment"])
        key = rng.choice([None, *range(30)])
        rows.append((i, kind, key, rng.choice([1, 2, None]) if kind == "payment" else None,
                     rng.choice([None, -1.0, 5.0, 9.0]), rng.choice([None, "card", "x"]),
                     T0 + timedelta(hours=rng.randrange(9)), T0 + timedelta(hours=rng.randrange(9))))
    return rows


def split(df):
    orders = df.filter("kind = 'order'").select(
        F.col("key").alias("order_id"), F.col("text").alias("customer_id"),
        F.lit("x").alias("order_status"), F.col("a").alias("purchase_ts"),
        F.col("b").alias("delivered_ts"))
    payments = df.filter("kind = 'payment'").select(
        F.col("key").alias("order_id"), F.col("seq").alias("payment_sequential"),
        F.col("text").alias("payment_type"), F.col("value").alias("payment_value"))
    return orders, payments


def failures(df):
    return {r["rule_name"]: r["failed_count"] for r in df.collect()}


@pytest.mark.parametrize("settle_every", [None, 1, 3])
def test_audit_after_every_batch_equals_the_audit_of_all(spark, tmp_path, settle_every):
    whole = spark.createDataFrame(deliveries(7), (
        "id long, kind string, key long, seq int, value double, text string, a timestamp, "
        "b timestamp")).cache()
    folder = work_dir(spark, "t")
    for k in range(4):
        batches_of(spark, tmp_path, [whole.filter(f"id % 4 = {k}")])
        st.audit_stream(rt.parquet_stream(spark, str(tmp_path), "events", 1), folder, split,
                        settle_every)
        want = quality.audit(*split(whole.filter(f"id % 4 <= {k}")))
        assert failures(st.audits(spark, folder)) == failures(want)
    # No rows are kept: one counter row a key and batch, without the payments' values.
    kept = spark.read.parquet(f"{folder}/counters")
    assert set(kept.columns) == {"source", "order_id", "payment_sequential", "n", "incomplete",
                                 "invalid", "batch"}
    assert kept.count() < whole.count()


def test_totals_survive_a_replayed_batch(spark, files_of_events):
    folder = work_dir(spark, "t")
    stream, events = files_of_events
    st.audit_stream(stream, folder, event_orders, settle_every=2)
    want = failures(st.audits(spark, folder))
    last = spark.read.parquet(f"{folder}/counters").filter("batch = 2").drop("batch")
    last.cache().count()
    rt.write_batch(last, f"{folder}/counters", 2)
    assert failures(st.audits(spark, folder)) == want == failures(
        quality.audit(*event_orders(events)))


@pytest.fixture
def files_of_events(spark, tmp_path):
    events = build(spark, 300, 4)
    batches_of(spark, tmp_path, [events.filter(f"event_id % 3 = {k}") for k in range(3)])
    return rt.parquet_stream(spark, str(tmp_path), "events", 1), events


def test_repeats_never_reach_the_log(spark, tmp_path):
    events = build(spark, 120)
    batches_of(spark, tmp_path, [events.union(events.limit(40)), events.filter("event_id > 100")])
    folder = work_dir(spark, "t")
    st.upsert_stream(rt.parquet_stream(spark, str(tmp_path), "events", 1), folder,
                     ["event_id"], ["ts"], ids=["event_id"], delay="2 days")
    assert spark.read.parquet(f"{folder}/log").count() == 120


def test_daily_users_and_merged_sketches(spark, files_of_events):
    stream, events = files_of_events
    exact = {r[0]: r[1] for r in events.groupBy(F.date_trunc("day", "ts")).agg(
        F.count_distinct("user_id")).collect()}
    got = rt.collect_append(sm.daily_users(stream.filter("event_id IS NOT NULL"), "30 days"),
                            work_dir(spark, "t"))
    assert {r.day_start: r.users for r in got.collect()}.items() <= exact.items()
    folder = work_dir(spark, "t")
    st.user_stream(stream, folder)
    kept = st.daily_user_sketches(spark, folder)
    first, last = date(2024, 1, 2), date(2024, 1, 4)
    want = events.filter(F.to_date("ts").between(first, last)).agg(
        F.count_distinct("user_id")).first()[0]
    assert sketches.users_between(kept, first, last).first()["users"] == want    # exact when small
    assert sketches.users_between(kept, by=["day"]).count() == len(exact)


def test_merged_quantiles_have_small_rank_errors(spark):
    values = spark.range(40_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise("b").alias("segment"),
        F.date_add(F.lit(date(2024, 1, 1)), (F.col("id") % 40).cast("int")).alias("day"),
        (F.xxhash64("id") % 100_000).cast("double").alias("value"))
    kept = sketches.value_sketches(values)
    found = sketches.quantiles_between(kept, (0.1, 0.5, 0.99), date(2024, 1, 5), date(2024, 2, 1))
    rows = {r.segment: r for r in found.collect()}
    for r in values.filter(F.col("day").between(date(2024, 1, 5), date(2024, 2, 1))).groupBy(
            "segment").agg(F.collect_list("value").alias("v")).collect():
        assert rows[r.segment].n == len(r.v)
        for p, q in zip((0.1, 0.5, 0.99), rows[r.segment].quantiles):
            assert abs(sum(v <= q for v in r.v) / len(r.v) - p) < 0.015
    small = values.limit(100).withColumn("day", F.lit(date(2024, 1, 1)))
    exact = sorted(r.value for r in small.filter("segment = 'b'").collect())
    fence = {r.segment: r for r in sketches.fences(sketches.quantiles_between(
        sketches.value_sketches(small))).collect()}
    assert fence["b"].median in exact


def test_large_batches_are_several_files_each_and_still_read_in_turn(spark, tmp_path):
    rows = spark.range(0, 3000, 1, 4).select("id", (F.col("id") % 3).alias("batch")).persist()
    path = str(tmp_path / "events.parquet")
    files = rt.write_batches(rows, "batch", range(3), path, rows_per_file=300)
    assert files == 4
    seen = []
    rt.run_batches(rt.parquet_stream(spark, str(tmp_path), "events", files), str(tmp_path / "run"),
                   lambda df, b: seen.append(sorted(r.id for r in df.collect())))
    assert seen == [list(range(b, 3000, 3)) for b in range(3)]
    few = rows.filter("batch < 2 OR id < 9")     # the last batch can't fill four files
    assert rt.write_batches(few, "batch", range(3), str(tmp_path / "few.parquet"), 300) == 1
