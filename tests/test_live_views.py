"""Tables of which only the touched partitions are rewritten, and views that follow changes."""

import glob
import os
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.operators import liveviews, views
from tidemark.plans import work_dir
from tidemark.sources import parts


def files(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/**/*.parquet", recursive=True)}


def keyed(spark, rows):
    return spark.createDataFrame(rows, "k long, seq long, text string")


def content(spark, path):
    return {(r.k, r.text) for r in parts.read_parts(spark, path).collect()}


def test_changes_rewrite_only_their_buckets(spark):
    path = work_dir(spark, "t")
    old = {k: (k, 0, f"old{k}") for k in range(60)}
    parts.write_buckets(keyed(spark, list(old.values())), path, ["k"], 16)
    before = files(path)
    new = keyed(spark, [(3, 1, "a"), (3, 2, "b"), (100, 1, "c"), (4, 1, "gone")])
    touched = parts.change_buckets(spark, path, ["k"], ["seq"], new, keyed(spark, [
        (4, 0, ""), (5, 0, ""), (777, 0, "")]), 16)
    want = {(k, v[2]) for k, v in old.items() if k not in (3, 4, 5)} | {(3, "b"), (100, "c")}
    assert content(spark, path) == want
    kept = {f for f in before if not any(f"/bucket={b}/" in f for b in touched)}
    after = files(path)
    assert kept and all(after.get(f) == before[f] for f in kept) and len(touched) <= 6


def test_a_bucket_may_lose_all_rows(spark):
    path = work_dir(spark, "t")
    parts.write_buckets(keyed(spark, [(1, 0, "x"), (2, 0, None)]), path, ["k"], 4)
    parts.remove_rows(spark, path, F.col("text") == "x")
    assert content(spark, path) == {(2, None)}
    parts.change_buckets(spark, path, ["k"], ["seq"], gone=keyed(spark, [(2, 0, "")]), buckets=4)
    assert content(spark, path) == set()
    parts.change_buckets(spark, path, ["k"], ["seq"], keyed(spark, [(9, 0, "y")]), buckets=4)
    assert content(spark, path) == {(9, "y")}
    assert parts.change_buckets(spark, path, ["k"], ["seq"], buckets=4) == []


def test_a_failed_write_leaves_the_old_table(spark):
    path = work_dir(spark, "t")
    parts.write_buckets(keyed(spark, [(k, 0, f"v{k}") for k in range(50)]), path, ["k"], 8)
    before = content(spark, path)
    broken = keyed(spark, [(k, 1, "new") for k in range(40)]).withColumn("text", F.when(
        F.col("k") == 33, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        parts.change_buckets(spark, path, ["k"], ["seq"], broken, buckets=8)
    assert content(spark, path) == before


def tables(make, changed):
    orders = [(f"o{i}", f"c{i % 3}", "delivered", f"2024-01-{1 + i % 9:02d}T10:00:00",
               f"2024-01-{3 + i % 9:02d}T10:00:00", "2024-01-20T00:00:00") for i in range(40)]
    payments = [(f"o{i}", s, "card", 10 + i + s) for i in range(40) for s in range(i % 3)]
    if changed:
        orders = [r for r in orders if r[0] != "o4"]                          # one goes
        orders = [("o5", "c1", "canceled", "2024-01-02T10:00:00") if r[0] == "o5" else r
                  for r in orders]                                            # one moves
        orders.append(("o99", "c0", "delivered", "2024-02-01T08:00:00"))      # one comes
        payments = [r if r[0] != "o13" else (*r[:3], 500) for r in payments]  # one is paid anew
    return make("orders", orders), make("payments", payments)


CHANGED = [("o4",), ("o5",), ("o99",), ("o13",)]


def rows(df):
    return sorted(str(r) for r in df.select(sorted(df.columns)).collect())


@pytest.mark.parametrize("width", ["day", "month"])
def test_refreshed_views_equal_full_builds(spark, make, width):
    before, old_payments = tables(make, False)
    now, payments = tables(make, True)
    changed = spark.createDataFrame(CHANGED, "order_id string")
    customers = make("customers", [(f"c{i}", "S", "C") for i in range(3)])
    reviews = make("reviews", [("o1", 5), ("o5", 1)])
    daily, facts = work_dir(spark, "t"), work_dir(spark, "t")
    liveviews.build_daily(before, old_payments, daily, width)
    liveviews.build_facts(before, customers, old_payments, reviews, facts, width)
    kept = files(daily)
    got = liveviews.refresh_daily(before, now, payments, changed, daily, width)
    assert rows(liveviews.read(spark, daily)) == rows(views.daily_summary(now, payments))
    assert got == liveviews.refresh_facts(before, now, customers, payments, reviews, changed,
                                          facts, width)
    assert rows(liveviews.read(spark, facts)) == rows(
        views.order_fact(now, customers, payments, reviews))
    if width == "day":     # o4 and o13 on the 5th, o5 from the 6th to the 2nd, o99 on a new day
        assert got == [date(2024, 1, 2), date(2024, 1, 5), date(2024, 1, 6), date(2024, 2, 1)]
        same = [f for f in kept if not any(f"period={d}" in f for d in got)]
        assert same and all(files(daily).get(f) == kept[f] for f in same)


def test_untouched_periods_are_not_read(spark, make):
    before, payments = tables(make, False)
    path = work_dir(spark, "t")
    liveviews.stored_by_period(before).write.partitionBy("period").parquet(path)
    days = [date(2024, 1, 5)]
    plan = liveviews.of_periods(spark.read.parquet(path), days)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(period" in text and "2024-01-05" in text
    assert plan.count() == before.filter("to_date(purchase_ts) = '2024-01-05'").count()
    assert liveviews.of_periods(before, []).count() == 0


def test_a_day_may_lose_all_orders(spark, make):
    before, payments = tables(make, False)
    path = work_dir(spark, "t")
    liveviews.build_daily(before, payments, path)
    now = before.filter("to_date(purchase_ts) <> '2024-01-05'")
    gone = before.filter("to_date(purchase_ts) = '2024-01-05'").select("order_id")
    liveviews.refresh_daily(before, now, payments, gone, path)
    assert rows(liveviews.read(spark, path)) == rows(views.daily_summary(now, payments))
