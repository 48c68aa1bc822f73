"""Comparing each metric with its own history, and reporting on the verdicts."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions import percent, round_to
from tidemark.schemas import VALUE

MONTH_DAYS, WEEK_DAYS = 30, 7

# Verdict notes.
NO_HISTORY = "No historical data available"
ZERO_BASELINE = "Baseline was zero, new value detected"
BOTH_ZERO = "Both baseline and current are zero"


def history(values: DataFrame, with_values: bool = False) -> DataFrame:
    """Mean, spread and count of the present days among the ``back`` days before each row.

    ``back`` is 7 or 30 per row. One lone history day stands for five equal ones.
    ``with_values`` adds the last seven history values, oldest first.
    """
    def pick(function: str) -> str:
        over = {n: f"{function} over (partition by kpi, segment order by unix_date(day) "
                   f"range between {n} preceding and 1 preceding)"
                for n in (WEEK_DAYS, MONTH_DAYS)}
        return f"if(back = {MONTH_DAYS}, {over[MONTH_DAYS]}, {over[WEEK_DAYS]})"

    columns = ["*", pick("count(value)") + " as n", pick("sum(value)") + " as total",
               pick("stddev_pop(cast(value as double))") + " as historical_std"]
    if with_values:
        columns.append(pick("collect_list(struct(day, cast(value as double) as value))")
                       + " as points")
    out = (values.selectExpr(*columns)
           .withColumn("baseline", F.expr("try_divide(cast(total as double), n)"))
           .withColumn("historical_count", F.expr("if(n = 1, 5, n)")))
    if with_values:
        out = out.withColumn("historical_values", F.expr(
            "transform(slice(sort_array(points), greatest(size(points) - 6, 1), 7), "
            "p -> p.value)")).drop("points")
    return out.drop("n", "total")


def verdict(rows: DataFrame) -> DataFrame:
    """Status and details for rows of value, history and threshold.

    Comparisons are strict: a change equal to the threshold is normal.
    """
    return (
        rows
        .withColumn("judged", F.expr("historical_count > 0 and baseline <> 0"))
        .withColumn("change", F.expr(
            "if(judged, (current_value - baseline) / baseline * 100, null)"))
        .withColumn("z_score", F.expr(
            "case when judged and threshold_type = 'statistical' and historical_count > 1 "
            "and historical_std > 0 then (current_value - baseline) / historical_std end"))
        .withColumn("breach", F.expr(
            "coalesce(judged and case threshold_type "
            "when 'percentage_drop' then change < -threshold_value "
            "when 'percentage_spike' then change > threshold_value "
            "when 'absolute_drop' then (baseline - current_value) > threshold_value "
            "when 'absolute_spike' then (current_value - baseline) > threshold_value "
            "when 'statistical' then abs(z_score) > threshold_value end, false)"))
        .withColumn("breach_amount", F.expr(
            "case when breach then case threshold_type "
            "when 'percentage_drop' then abs(change) - threshold_value "
            "when 'percentage_spike' then change - threshold_value "
            "when 'absolute_drop' then (baseline - current_value) - threshold_value "
            "when 'absolute_spike' then (current_value - baseline) - threshold_value "
            "when 'statistical' then abs(z_score) - threshold_value end end"))
        .withColumn("status", F.expr("if(breach, 'alert', 'normal')"))
        .withColumn("reason", F.expr(
            f"case when historical_count = 0 then '{NO_HISTORY}' "
            f"when baseline = 0 and current_value > 0 then '{ZERO_BASELINE}' "
            f"when baseline = 0 then '{BOTH_ZERO}' end"))
        .withColumn("change_percent", F.expr(
            "if(baseline = 0 and current_value > 0, 100d, change)"))
        .drop("judged", "change", "breach"))


def evaluate(values: DataFrame, specs: DataFrame, asof: date | None = None) -> DataFrame:
    """``kpi_status`` rows for every metric, segment and day, or for ``asof`` only.

    ``specs`` holds one row per configured metric, so it is broadcast.
    """
    spec = F.broadcast(specs.drop("sql_query").withColumnRenamed("name", "kpi"))
    if asof is not None:
        values = values.filter(F.col("day") >= F.date_sub(F.lit(asof), MONTH_DAYS))
    back = F.expr(f"if(comparison_period = 'previous_month', {MONTH_DAYS}, {WEEK_DAYS})")
    rows = history(values.join(spec, "kpi").withColumn("back", back), asof is not None)
    if asof is not None:
        rows = rows.filter(F.col("day") == F.lit(asof))
    return verdict(rows.withColumn("current_value", F.col("value").cast("double"))
                   .drop("value", "comparison_period", "back"))


# --- metrics defined by SQL text -------------------------------------------------------

_ERROR_FIELDS = "kpi string, value string, error string"


def sql_kpi_values(spark: SparkSession, specs: list[dict], asof: date,
                   isolate: bool = True) -> DataFrame:
    """Current value or error of each metric whose spec carries a ``sql_query``.

    The query may use ``:asof`` and must return a column ``value``; its first row counts.
    A query that fails, when analysed or at run time, becomes an error row and the others go on.
    That takes one job per metric; without ``isolate`` all run as one job, which an error at run
    time ends.
    """
    parts = []
    for spec in specs:
        name, query = spec.get("name", "Unknown"), spec.get("sql_query")
        try:
            part = _sql_value(spark, name, query, asof)
            if isolate and query:
                part = spark.createDataFrame(part.collect(), _ERROR_FIELDS)
        except PySparkException as e:
            message = f"Query execution failed: {str(e).splitlines()[0]}"
            part = spark.createDataFrame([(name, None, message)], _ERROR_FIELDS)
        parts.append(part)
    out = parts[0] if parts else spark.createDataFrame([], _ERROR_FIELDS)
    for part in parts[1:]:
        out = out.unionByName(part)
    number = F.expr("try_cast(value as double)")
    return out.select("kpi", number.alias("value"), F.coalesce(
        "error", F.when(number.isNull(), F.concat(F.lit("Invalid value type: "), "value")))
        .alias("error"))


def _sql_value(spark, name, query, asof) -> DataFrame:
    label = F.lit(name).alias("kpi")
    if not query:
        return spark.range(1).select(label, F.lit(None).cast("string").alias("value"),
                                     F.lit("No SQL query defined").alias("error"))
    first = spark.sql(query, args={"asof": asof} if ":asof" in query else None).limit(1)
    one = first.agg(F.count(F.lit(1)).alias("n"),
                    F.first(F.col("value").cast("string")).alias("value"))
    return one.select(label, "value",
                      F.when(F.col("n") == 0, "No data returned from query")
                      .when(F.col("value").isNull(), "Null value returned").alias("error"))


def with_errors(status: DataFrame, values: DataFrame) -> DataFrame:
    """Add the failed metrics of ``sql_kpi_values`` to a status table as ``error`` rows."""
    failed = values.filter(F.col("error").isNotNull()).select(
        "kpi", F.lit("ALL").alias("segment"), F.lit("error").alias("status"),
        F.col("error").alias("reason"))
    return status.unionByName(failed, allowMissingColumns=True)


def sql_history(spark: SparkSession, specs: list[dict], asof: date,
                isolate: bool = False) -> DataFrame:
    """Earlier values ``(kpi, segment, day, value)`` of SQL-defined metrics.

    A spec may carry a ``history_query`` that returns ``day, value`` rows, which costs one
    scan; of several rows of a day the highest value counts. Failing that, a ``sql_query`` using ``:asof`` is asked again for each earlier day;
    one without ``:asof`` has no history. ``isolate`` runs each metric by itself, a row a day, and
    leaves out one that fails.
    """
    out = spark.createDataFrame([], f"kpi string, segment string, day date, value {VALUE}")

    def row(df, name, day):
        return df.select(F.lit(name).alias("kpi"), F.lit("ALL").alias("segment"), day,
                         F.expr(f"try_cast(value as {VALUE})").alias("value"))

    for spec in specs:
        name, query = spec.get("name"), spec.get("sql_query") or ""
        days = MONTH_DAYS if spec.get("comparison_period") == "previous_month" else WEEK_DAYS
        own = out.limit(0)
        try:
            if spec.get("history_query"):
                past = spark.sql(spec["history_query"], args={"asof": asof}
                                 if ":asof" in spec["history_query"] else None)
                recent = row(past, name, F.col("day").cast("date").alias("day")).filter(
                    F.col("day") >= F.lit(asof - timedelta(days=days)))
                # One row a day, whatever the query returns: what is collected below is bounded.
                own = own.unionByName(recent.groupBy("kpi", "segment", "day").agg(
                    F.max("value").alias("value"))
                    .filter(F.col("day") < F.lit(asof + timedelta(days=1))))
            elif ":asof" in query:
                for back in range(1, days + 1):
                    day = asof - timedelta(days=back)
                    past = spark.sql(query, args={"asof": day}).limit(1)
                    own = own.unionByName(row(past, name, F.lit(day).alias("day")))
            if isolate:                          # as many rows as the lookback has days
                own = spark.createDataFrame(own.collect(), out.schema)
            out = out.unionByName(own)
        except PySparkException:
            continue                             # reported with the current value
    return out.filter(F.col("value").isNotNull())


def evaluate_sql(spark: SparkSession, specs: list[dict], spec_rows: DataFrame, asof: date,
                 past: DataFrame | None = None, isolate: bool = True) -> DataFrame:
    """Verdicts of SQL-defined metrics at ``asof``; ``past`` defaults to ``sql_history``.

    With ``isolate`` the history of each metric is computed on its own as well, so one that fails
    at run time leaves the others alone.
    """
    current = sql_kpi_values(spark, specs, asof, isolate)
    if past is None:
        past = sql_history(spark, specs, asof, isolate)
    today = current.filter(F.col("error").isNull()).select(
        "kpi", F.lit("ALL").alias("segment"), F.lit(asof).alias("day"),
        F.col("value").cast(VALUE).alias("value"))
    earlier = past.filter(F.col("day") < F.lit(asof)).join(today.select("kpi"), "kpi",
                                                           "left_semi")
    return with_errors(evaluate(earlier.unionByName(today), spec_rows, asof), current)


# --- reports over verdicts ---------------------------------------------------------------

def run_summary(status: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Totals per status, the alert rate and the run status (1 error, 2 alert, 0 clean)."""
    n = {s: F.count_if(F.col("status") == s) for s in ("alert", "normal", "error")}
    return status.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("total"),
        n["alert"].alias("alerts"), n["normal"].alias("normal"), n["error"].alias("errors"),
        percent(n["alert"], F.count(F.lit(1))).alias("alert_rate_pct"),
        F.when(n["error"] > 0, 1).when(n["alert"] > 0, 2).otherwise(0).alias("run_status"))


def alerts(status: DataFrame) -> DataFrame:
    """Rows to send: alerting metrics whose alerting is enabled, dressed for a channel."""
    change = F.coalesce("change_percent", F.lit(0.0))
    return (status.filter((F.col("status") == "alert") & F.col("alert_enabled"))
            .withColumn("colour", F.when(F.col("alert_priority") == "high", "danger")
                        .when(F.col("alert_priority") == "low", "good")
                        .otherwise("warning"))
            .withColumn("direction", F.when(change < 0, "decreased").otherwise("increased")))


def change_band(status: DataFrame) -> DataFrame:
    c = F.col("change_percent")
    return status.withColumn("band", F.when(c.isNull(), "N/A").when(c < -10, "below -10")
                             .when(c < 0, "below 0").when(c > 10, "above 10")
                             .otherwise("none"))


def top_kpis(status: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` largest values by size among metrics that did not fail."""
    return (status.filter((F.col("status") != "error") & F.col("current_value").isNotNull())
            .orderBy(F.desc(F.abs("current_value")), "kpi", "segment").limit(n)
            .select("kpi", "segment", "current_value"))


def display_rows(status: DataFrame) -> DataFrame:
    """Rows as shown on a board: rounded change and defaults for what is missing."""
    change = F.coalesce("change_percent", F.lit(0.0))
    return status.select(
        F.coalesce("kpi", F.lit("Unknown")).alias("name"), "segment",
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("current_value", F.lit(0.0)).alias("value"), "status",
        round_to(change, 2).alias("change_percent"),
        F.coalesce("baseline", F.lit(0.0)).alias("baseline"),
        F.coalesce("threshold_type", F.lit("")).alias("threshold_type"),
        F.coalesce("threshold_value", F.lit(0.0)).alias("threshold_value"),
        F.coalesce("alert_priority", F.lit("medium")).alias("priority"))
