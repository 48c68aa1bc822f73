"""Keyed tables, audits and incidents kept up to date by micro-batches.

Each batch writes its own folder, so replaying a batch after a lost executor or driver
replaces its output and nothing is counted twice.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import incidents, quality, sketches
from tidemark.operators.tablechange import latest_per_key
from tidemark.streaming.metrics import without_repeats
from tidemark.streaming.runtime import read_all, run_batches, write_batch


def upsert_stream(stream: DataFrame, folder: str, keys: list[str], sequence: list[str],
                  ids: list[str] | None = None, delay: str = "1 hour",
                  time: str = "ts") -> None:
    """Maintain a keyed table as a log of per-batch winners.

    A batch costs what it brings, whatever the size of the table; ``current`` resolves the log and
    ``compact`` shortens it. Rows may come late by any time, and again: the last by ``sequence``
    wins wherever it arrives. With ``ids``, repeats of an event and rows behind the watermark are
    dropped first (see ``metrics.without_repeats``).
    """
    if ids:
        stream = without_repeats(stream, ids, delay, time)

    def merge(df: DataFrame, batch: int) -> None:
        order = F.struct(*sequence)
        payload = F.struct(*df.columns)
        winners = df.groupBy(*keys).agg(F.max_by(payload, order).alias("row")).select("row.*")
        write_batch(winners, f"{folder}/log", batch)

    run_batches(stream, folder, merge)


def current(spark: SparkSession, folder: str, keys: list[str],
            sequence: list[str]) -> DataFrame:
    """The table as of the last batch: the last write of each key."""
    return latest_per_key(_since_compaction(spark, folder).drop("batch"), keys, sequence)


def _since_compaction(spark: SparkSession, folder: str) -> DataFrame:
    """The newest compacted table, if there is one, and the batches after it."""
    log = spark.read.parquet(f"{folder}/log")
    try:
        versions = spark.read.parquet(f"{folder}/compacted")
    except AnalysisException:                    # never compacted
        return log
    upto = versions.agg(F.max("batch")).first()[0]
    return log.filter(F.col("batch") > upto).unionByName(
        versions.filter(F.col("batch") == upto))


def compact(spark: SparkSession, folder: str, keys: list[str], sequence: list[str]) -> int:
    """Write the table as of the last batch; later reads start from it. Returns that batch.

    Log folders up to that batch, and older compactions, are no longer read and may be deleted.
    """
    last = spark.read.parquet(f"{folder}/log").agg(F.max("batch")).first()[0]
    write_batch(current(spark, folder, keys, sequence), f"{folder}/compacted", last)
    return last


def user_stream(stream: DataFrame, folder: str) -> None:
    """Keep a sketch of the users of every batch and day, whatever the rows' lateness."""
    run_batches(stream, folder, lambda df, batch: write_batch(
        sketches.user_sketches(df), f"{folder}/users", batch))


def daily_user_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """(day, users) of all batches; ``sketches.users_between`` merges them."""
    return read_all(spark, f"{folder}/users")


# Audits: keyed counters of every batch, and rule totals that change by signed differences

def _keyed_counters(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Rows and failures per source, order and payment sequence; all that an audit needs."""
    def flag(test):
        return F.when(test, 1).otherwise(0)

    none = F.lit(None).cast(payments.schema["payment_sequential"].dataType)
    rows = orders.select(
        F.lit("orders").alias("source"), "order_id", none.alias("payment_sequential"),
        flag(quality.any_null("order_id", "customer_id", "order_status", "purchase_ts"))
        .alias("incomplete"),
        flag(F.col("delivered_ts") < F.col("purchase_ts")).alias("invalid")).unionByName(
        payments.select(
            F.lit("payments").alias("source"), "order_id", "payment_sequential",
            flag(quality.any_null("payment_value", "payment_type", "order_id"))
            .alias("incomplete"),
            flag(F.col("payment_value") < 0).alias("invalid")))
    return rows.groupBy("source", "order_id", "payment_sequential").agg(
        F.count(F.lit(1)).alias("n"), F.sum("incomplete").alias("incomplete"),
        F.sum("invalid").alias("invalid"))


def audit_stream(stream: DataFrame, folder: str,
                 split: Callable[[DataFrame], tuple[DataFrame, DataFrame]],
                 settle_every: int | None = None) -> None:
    """Count the orders and payments of every micro-batch; ``split`` names them.

    A batch writes counters per key and no rows. Orphans and duplicates can only be told over all
    that has arrived; ``audits`` does, from the totals that ``settle_audit`` wrote last (here, after
    every ``settle_every`` batches) and the batches since.
    """
    spark = stream.sparkSession

    def count(df: DataFrame, batch: int) -> None:
        write_batch(_keyed_counters(*split(df)), f"{folder}/counters", batch)
        if settle_every and (batch + 1) % settle_every == 0:
            settle_audit(spark, folder)

    run_batches(stream, folder, count)


def _last_batch(table: DataFrame) -> int:
    """The newest batch of a table, from the names of its files."""
    return max(int(re.search(r"/batch=(\d+)/", f).group(1)) for f in table.inputFiles())


def _settled_until(spark: SparkSession, path: str) -> int:
    """The last batch that the newest settled version covers, or -1."""
    try:
        return _last_batch(spark.read.parquet(path))
    except AnalysisException:                    # never settled
        return -1


def audit_change(earlier: DataFrame, new: DataFrame) -> DataFrame:
    """One row: by how much ``new`` counters change the failures of every rule.

    Only the keys of orders that ``new`` touches are looked up in ``earlier``. An order that comes
    after its payments takes their orphans back; the second row of a key makes it a duplicate.
    """
    key = ["source", "order_id", "payment_sequential"]
    added = new.groupBy(*key).agg(*(F.sum(c).alias(c) for c in ("n", "incomplete", "invalid")))
    touched = new.select(F.col("order_id").alias("touched")).distinct()
    known = earlier.join(touched, F.col("order_id").eqNullSafe(F.col("touched")), "left_semi")
    zero = F.lit(0).cast("long")
    keys = (known.select(*key, F.col("n").alias("before"), zero.alias("n"),
                         zero.alias("incomplete"), zero.alias("invalid"))
            .unionByName(added.withColumn("before", zero)).groupBy(*key)
            .agg(*(F.sum(c).alias(c) for c in ("before", "n", "incomplete", "invalid")))
            .withColumn("after", F.col("before") + F.col("n")))

    def of(source, value):
        return F.sum(F.when(F.col("source") == source, value).otherwise(0))

    repeated = (F.col("after") > 1).cast("long") - (F.col("before") > 1).cast("long")
    # An order's own key has no payment sequence, so its group has one row of orders at most.
    orders = keys.groupBy("order_id").agg(
        of("orders", F.col("incomplete")).alias("orders_complete"),
        of("payments", F.col("incomplete")).alias("payments_complete"),
        of("orders", repeated).alias("orders_unique"),
        of("payments", repeated).alias("payments_unique"),
        of("payments", F.col("invalid")).alias("payments_domain"),
        of("orders", F.col("invalid")).alias("orders_chronology"),
        *(of(s, F.col(at)).alias(f"{s}_{at}") for s in ("orders", "payments")
          for at in ("before", "after")))
    lost = [F.when(F.col("order_id").isNotNull() & (F.col(f"orders_{at}") == 0),
                   F.col(f"payments_{at}")).otherwise(0) for at in ("before", "after")]
    return orders.withColumn("orphan_payments", lost[1] - lost[0]).agg(
        *(F.coalesce(F.sum(r), zero).alias(r) for r in _AUDITED))


_AUDITED = ["orders_complete", "payments_complete", "orders_unique", "payments_unique",
            "payments_domain", "orders_chronology", "orphan_payments"]


def _audit_totals(spark: SparkSession, folder: str, last: int, upto: int | None = None) -> DataFrame:
    """One row of failures up to a batch: the settled ones and what has changed since."""
    counters = spark.read.parquet(f"{folder}/counters")
    if upto is not None:
        counters = counters.filter(F.col("batch") <= upto)
    change = audit_change(counters.filter(F.col("batch") <= last),
                          counters.filter(F.col("batch") > last))
    if last < 0:
        return change
    settled = spark.read.parquet(f"{folder}/totals").filter(F.col("batch") == last)
    return settled.select(*_AUDITED).unionByName(change).agg(
        *(F.sum(r).alias(r) for r in _AUDITED))


def settle_audit(spark: SparkSession, folder: str) -> int:
    """Write the rule totals as of the last batch; later reads start there. Returns that batch."""
    last = _last_batch(spark.read.parquet(f"{folder}/counters"))
    before = _settled_until(spark, f"{folder}/totals")
    if last > before:
        write_batch(_audit_totals(spark, folder, before, last), f"{folder}/totals", last)
    return last


def audits(spark: SparkSession, folder: str) -> DataFrame:
    """The table rules over everything that has arrived, however it was cut into batches."""
    totals = _audit_totals(spark, folder, _settled_until(spark, f"{folder}/totals"))
    return quality.described(quality.per_rule(totals, _AUDITED)).drop("description")


# Incidents: events by time slot, and summaries of the slots that have been settled

def incident_stream(stream: DataFrame, folder: str, width: str = "day",
                    settle_every: int | None = None, few_files: bool = True) -> None:
    """Keep alert, ack and resolve events by time slot, in any order of arrival.

    A batch costs what it brings. ``settle_incidents`` (here, after every ``settle_every``
    batches) summarises the slots that batches have touched since the last time. ``few_files``
    costs an exchange a batch, which small batches of one file don't need.
    """
    spark = stream.sparkSession

    def keep(df: DataFrame, batch: int) -> None:
        rows = df.select(*incidents.EVENT_COLUMNS).withColumn("slot", incidents.slot(width))
        if few_files:                            # and a slot with most of the rows is split
            rows = rows.hint("rebalance", "slot")
        (rows.write.mode("overwrite").partitionBy("slot")
         .parquet(f"{folder}/events/batch={batch}"))
        if settle_every and (batch + 1) % settle_every == 0:
            settle_incidents(spark, folder)

    run_batches(stream, folder, keep)


def touched_events(spark: SparkSession, folder: str,
                   settled: int) -> tuple[DataFrame, DataFrame]:
    """(metrics and slots of the batches after ``settled``, all of their events).

    Only the folders of these slots are read.
    """
    log = spark.read.parquet(f"{folder}/events")
    new = log.filter((F.col("batch") > settled) & (F.col("slot") != incidents.NO_SLOT))
    slots = [] if settled < 0 else [                       # stretches of the calendar
        r["slot"] for r in new.select("slot").distinct().collect()]
    touched = new.select("kpi_name", "slot").distinct()
    if settled < 0:
        return touched, new
    return touched, log.filter(F.col("slot").isin(slots)).join(
        touched, ["kpi_name", "slot"], "left_semi")


def _settled_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of each metric and slot from the version that touched it last."""
    versions = spark.read.parquet(f"{folder}/pieces")
    if len({re.search(r"/batch=\d+/", f).group() for f in versions.inputFiles()}) == 1:
        return versions
    newest = versions.groupBy("kpi_name", "slot").agg(F.max("batch").alias("batch"))
    return versions.join(newest, ["kpi_name", "slot", "batch"], "left_semi")


def settle_incidents(spark: SparkSession, folder: str) -> int:
    """Write the pieces of the slots touched since the last time. Returns the last batch."""
    last = _last_batch(spark.read.parquet(f"{folder}/events"))
    before = _settled_until(spark, f"{folder}/pieces")
    if last > before:
        _, events = touched_events(spark, folder, before)
        write_batch(incidents.pieces(events), f"{folder}/pieces", last)
    return last


def compact_incidents(spark: SparkSession, folder: str) -> int:
    """Write the newest pieces of all slots as one version; older ones may then be deleted."""
    last = settle_incidents(spark, folder)
    whole = _settled_pieces(spark, folder).drop("batch")
    path = f"{folder}/compacted/batch={last}"
    whole.write.mode("overwrite").parquet(path)       # a version can't be read while replaced
    write_batch(spark.read.parquet(path), f"{folder}/pieces", last)
    return last


def incident_table(spark: SparkSession, folder: str) -> DataFrame:
    """Every incident as of the last batch: settled slots, and those touched since folded anew."""
    settled = _settled_until(spark, f"{folder}/pieces")
    last = _last_batch(spark.read.parquet(f"{folder}/events"))
    if settled < 0:
        return incidents.assemble(incidents.pieces(touched_events(spark, folder, settled)[1]))
    known = _settled_pieces(spark, folder).drop("batch")
    if last > settled:
        touched, events = touched_events(spark, folder, settled)
        known = known.join(touched, ["kpi_name", "slot"], "left_anti").unionByName(
            incidents.pieces(events))
    return incidents.assemble(known)


def incident_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Events without a metric or a time, which belong to no incident."""
    return spark.read.parquet(f"{folder}/events").filter(
        F.col("slot") == incidents.NO_SLOT).drop("batch", "slot")
