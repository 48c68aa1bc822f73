"""Incident lifecycle as a fold of an event log.

Events are ``(kpi_name, ts, seq, kind, severity, value, threshold, description, actor,
notes)`` with ``kind`` alert, ack or resolve; ``seq`` orders equal times. A metric has at most
one unresolved incident: the first alert opens it, later alerts update its value, severity and
description, an ack marks it, a resolve closes it. Acks and resolves without an open incident
do nothing.

The incident a row belongs to is the number of resolves of its metric before it. That running
count is built from per-bucket subtotals, so a metric with a third of all events is spread
over its time buckets instead of being sorted in one task; everything after is plain
aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

EVENT_COLUMNS = ["kpi_name", "ts", "seq", "kind", "severity", "value", "threshold",
                 "description", "actor", "notes"]


def running_before(events: DataFrame, key: str, flag: Column, name: str,
                   bucket: str = "hour") -> DataFrame:
    """Adds the number of earlier rows of the same key for which ``flag`` holds."""
    marked = (events.withColumn("_flag", F.when(flag, 1).otherwise(0))
              .withColumn("_bucket", F.date_trunc(bucket, F.col("ts").cast("timestamp"))))
    earlier = (Window.partitionBy(key).orderBy("_bucket")
               .rowsBetween(Window.unboundedPreceding, -1))
    offsets = (marked.groupBy(key, "_bucket").agg(F.sum("_flag").alias("_n"))
               .select(key, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0))
                       .alias("_offset")))
    within = (Window.partitionBy(key, "_bucket").orderBy("ts", "seq")
              .rowsBetween(Window.unboundedPreceding, -1))
    return (marked.withColumn("_before", F.coalesce(F.sum("_flag").over(within), F.lit(0)))
            .join(offsets, [key, "_bucket"])
            .withColumn(name, F.col("_before") + F.col("_offset"))
            .drop("_flag", "_bucket", "_before", "_offset"))


def _ends(kind: str, pick) -> Column:
    """First or last event of a kind within an incident, as a struct."""
    fields = F.struct("ts", "seq", "severity", "value", "threshold", "description", "actor",
                      "notes")
    return pick(F.when(F.col("kind") == kind, fields))


def rejects(events: DataFrame) -> DataFrame:
    """Events without a metric or a time: they have no place in any incident."""
    return events.filter("kpi_name IS NULL OR ts IS NULL")


def _placed(events: DataFrame) -> DataFrame:
    return events.filter("kpi_name IS NOT NULL AND ts IS NOT NULL")


def acknowledge(incidents: DataFrame, ids: DataFrame) -> DataFrame:
    """Ack events for open incidents by id; ``ids`` has incident_id, ts, actor.

    Ids that are unknown, acknowledged or resolved give no event.
    """
    return _calls(incidents.filter("status = 'OPEN'"), ids, "ack", F.col("actor"),
                  F.lit(None).cast("string"))


def resolve(incidents: DataFrame, ids: DataFrame) -> DataFrame:
    """Resolve events for unresolved incidents by id; ``ids`` has incident_id, ts, notes.

    Ids that are unknown or resolved give no event.
    """
    return _calls(incidents.filter("status <> 'RESOLVED'"), ids, "resolve",
                  F.lit(None).cast("string"), F.col("notes"))


def _calls(incidents, ids, kind, actor, notes) -> DataFrame:
    """One event for each id, after every event of the same time; the earliest call counts."""
    none = F.lit(None)
    called = ids.groupBy("incident_id").agg(
        F.min_by(F.struct(*[c for c in ids.columns if c != "incident_id"]), "ts").alias("call"))
    return (incidents.select("incident_id", "kpi_name").join(called, "incident_id")
            .select("kpi_name", "call.*").select(
                "kpi_name", "ts", F.lit(2**62).alias("seq"), F.lit(kind).alias("kind"),
                none.cast("string").alias("severity"), none.cast("double").alias("value"),
                none.cast("double").alias("threshold"), none.cast("string").alias("description"),
                actor.alias("actor"), notes.alias("notes")))


def _merged(numbered: DataFrame, *keys: str) -> DataFrame:
    """What an incident's state follows from, per run of events without a resolve in between."""
    return numbered.groupBy(*keys).agg(
        _ends("alert", F.min).alias("opened"), _ends("alert", F.max).alias("latest"),
        _ends("ack", F.max).alias("ack"), _ends("resolve", F.min).alias("closed"))


def fold(events: DataFrame, bucket: str = "hour") -> DataFrame:
    """Every incident with its current state; ``rejects`` has the events that can't take part."""
    numbered = running_before(_placed(events), "kpi_name", F.col("kind") == "resolve", "incident_no",
                              bucket)
    return _states(_merged(numbered, "kpi_name", "incident_no"))


def _states(folded: DataFrame) -> DataFrame:
    def after_open(event):
        e = F.struct(F.col(f"{event}.ts"), F.col(f"{event}.seq"))
        return F.coalesce(e > F.struct(F.col("opened.ts"), F.col("opened.seq")), F.lit(False))

    acked = after_open("ack")
    created = F.col("opened.ts")
    return folded.filter(F.col("opened").isNotNull()).select(
        F.concat(F.lit("inc_"), F.substring(F.sha2(F.concat_ws(
            "|", "kpi_name", created.cast("string"), F.col("opened.seq").cast("string")),
            256), 1, 16)).alias("incident_id"),
        created.alias("created_at"), "kpi_name", F.col("latest.severity").alias("severity"),
        F.when(F.col("closed").isNotNull(), "RESOLVED").when(acked, "ACKNOWLEDGED")
        .otherwise("OPEN").alias("status"),
        F.col("latest.value").alias("trigger_value"),
        F.col("opened.threshold").alias("threshold_value"),
        F.col("latest.description").alias("description"),
        F.when(acked, F.col("ack.actor")).alias("acknowledged_by"),
        F.when(acked, F.col("ack.ts")).alias("acknowledged_at"),
        F.col("closed.notes").alias("resolution_notes"),
        F.col("closed.ts").alias("resolved_at"))


#: Slot of the events that belong to no incident.
NO_SLOT = "none"


def slot(width: str = "day") -> Column:
    """The time slot of an event, as text that sorts by time."""
    lost = F.col("kpi_name").isNull() | F.col("ts").isNull()
    start = F.date_trunc(width, F.col("ts").cast("timestamp"))
    return F.when(lost, NO_SLOT).otherwise(
        F.concat(F.lit("t"), F.date_format(start, "yyyy-MM-dd-HH")))


def pieces(events: DataFrame) -> DataFrame:
    """Summaries of the events of each metric and ``slot``: one row for each stretch between
    resolves, (kpi_name, slot, n, opened, latest, ack, closed), ``n`` counting the slot's resolves
    before it.

    A slot's rows depend on its own events alone, and ``assemble`` puts the rows of all slots
    together, so new events cost the slots they fall into, however late they come. A task sorts
    one metric's events of one slot; the exchange by both serves the sums, too.
    """
    before = (Window.partitionBy("kpi_name", "slot").orderBy("ts", "seq")
              .rowsBetween(Window.unboundedPreceding, -1))
    resolved = F.when(F.col("kind") == "resolve", 1).otherwise(0)
    numbered = events.filter(F.col("slot") != NO_SLOT).withColumn(
        "n", F.coalesce(F.sum(resolved).over(before), F.lit(0)))
    return _merged(numbered, "kpi_name", "slot", "n")


def assemble(pieces: DataFrame) -> DataFrame:
    """The incidents of all slots' pieces; equals ``fold`` of their events.

    The first piece of a slot goes on where the slots before it end; only pieces meet here.
    """
    before = (Window.partitionBy("kpi_name").orderBy("slot")
              .rowsBetween(Window.unboundedPreceding, -1))
    resolves = (pieces.groupBy("kpi_name", "slot").agg(F.count("closed").alias("r"))
                .select("kpi_name", "slot", F.coalesce(F.sum("r").over(before), F.lit(0))
                        .alias("earlier")))
    joined = pieces.join(resolves, ["kpi_name", "slot"]).groupBy(
        "kpi_name", (F.col("earlier") + F.col("n")).alias("incident_no")).agg(
        F.min("opened").alias("opened"), F.max("latest").alias("latest"),
        F.max("ack").alias("ack"), F.min("closed").alias("closed"))
    return _states(joined)


def compact(events: DataFrame, bucket: str = "hour") -> DataFrame:
    """The few events that still matter: first and last alert and last ack of each
    unresolved incident. Folding them with later events equals folding the whole log."""
    numbered = running_before(_placed(events), "kpi_name", F.col("kind") == "resolve",
                              "incident_no", bucket)
    folded = numbered.groupBy("kpi_name", "incident_no").agg(
        _ends("alert", F.min).alias("a"), _ends("alert", F.max).alias("b"),
        _ends("ack", F.max).alias("c"), F.count_if(F.col("kind") == "resolve").alias("r"))

    def keep(column, kind):
        return F.struct(F.lit(kind).alias("kind"), F.col(column).alias("e"))

    kept = F.array_distinct(F.array(keep("a", "alert"), keep("b", "alert"), keep("c", "ack")))
    return (folded.filter("r = 0 and a is not null")
            .select("kpi_name", F.explode(kept).alias("k")).filter("k.e is not null")
            .select("kpi_name", "k.kind", "k.e.*").select(*EVENT_COLUMNS))


def newest(incidents: DataFrame, n: int = 20) -> DataFrame:
    return incidents.orderBy(F.desc("created_at"), "kpi_name").limit(n)


def alert_events(alerts: DataFrame) -> DataFrame:
    """Log events for the alert rows of an evaluation."""
    return alerts.select(
        F.concat_ws("/", "kpi", "segment").alias("kpi_name"),
        F.col("day").cast("timestamp").alias("ts"), F.lit(0).cast("long").alias("seq"),
        F.lit("alert").alias("kind"), F.upper("alert_priority").alias("severity"),
        F.col("current_value").alias("value"), F.col("threshold_value").alias("threshold"),
        F.format_string("%s %s by %.1f%%", "description", "direction",
                        F.abs(F.coalesce("change_percent", F.lit(0.0))))
        .alias("description"),
        F.lit(None).cast("string").alias("actor"), F.lit(None).cast("string").alias("notes"))
