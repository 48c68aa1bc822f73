"""Data-quality audit: one pass over each table, one grouping by order for all of its rules."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions import round_to

# Rule id -> (name, category, severity, description).
RULES = {
    "orders_complete": (
        "Orders Primary Fields Completeness", "Completeness", "CRITICAL",
        "Verifies that order_id, customer_id, order_status, and purchase timestamp are not "
        "null"),
    "payments_complete": (
        "Payment Records Completeness", "Completeness", "HIGH",
        "Ensures payment_value, payment_type, and order_id are fully populated"),
    "orders_unique": (
        "Order ID Uniqueness", "Uniqueness", "CRITICAL",
        "Ensures no duplicate order_id exists in the primary orders table"),
    "payments_unique": (
        "Payment Sequence Uniqueness", "Uniqueness", "HIGH",
        "Verifies composite key uniqueness (order_id, payment_sequential)"),
    "payments_domain": (
        "Payment Value Domain Validity", "Validity", "CRITICAL",
        "Validates that monetary payment amounts are strictly non-negative"),
    "orders_chronology": (
        "Chronological Delivery Logic", "Validity", "MEDIUM",
        "Ensures customer delivery timestamp occurs after the initial purchase date"),
    "orphan_payments": (
        "Orphan Payments Check", "Referential Integrity", "HIGH",
        "Verifies that all payment entries map directly to valid orders"),
    "review_bounds": (
        "Customer Review Score Bounds", "Validity", "LOW",
        "Ensures CSAT review scores adhere to the standardized 1-5 integer scale"),
    # Extension: off unless items are passed.
    "orphan_items": (
        "Orphan Line Items Check", "Referential Integrity", "HIGH",
        "Verifies that all line items map directly to valid orders"),
}


def any_null(*columns: str) -> Column:
    test = F.col(columns[0]).isNull()
    for c in columns[1:]:
        test = test | F.col(c).isNull()
    return test


def per_rule(one_row: DataFrame, rules: list[str]) -> DataFrame:
    pairs = [F.struct(F.lit(r).alias("rule"), F.col(r).cast("long").alias("failed_count"))
             for r in rules]
    return one_row.select(F.explode(F.array(*pairs)).alias("r")).select("r.*")


#: What is counted per order, over all tables.
_COUNTS = ("orders", "orders_complete", "orders_chronology", "payments", "payments_complete",
           "payments_domain", "payments_unique", "items")


def _counts(df: DataFrame, **given: Column) -> DataFrame:
    return df.select("order_id", *(given.get(c, F.lit(0)).cast("long").alias(c)
                                   for c in _COUNTS))


def order_counts(orders: DataFrame, payments: DataFrame,
                 items: DataFrame | None = None) -> DataFrame:
    """Row counts and failures per order, from one pass over each table.

    The tables are stacked, not joined, so the rows of a hot order combine before the exchange by
    order. Payments combine per key first.
    """
    def flag(test: Column) -> Column:
        return F.when(test, 1).otherwise(0)

    keyed = payments.groupBy("order_id", "payment_sequential").agg(
        F.count(F.lit(1)).alias("payments"),
        F.count_if(any_null("payment_value", "payment_type", "order_id"))
        .alias("payments_complete"),
        F.count_if(F.col("payment_value") < 0).alias("payments_domain"))
    rows = _counts(
        orders, orders=F.lit(1), orders_complete=flag(
            any_null("order_id", "customer_id", "order_status", "purchase_ts")),
        orders_chronology=flag(F.col("delivered_ts") < F.col("purchase_ts")))
    rows = rows.unionByName(_counts(
        keyed, payments=F.col("payments"), payments_complete=F.col("payments_complete"),
        payments_domain=F.col("payments_domain"), payments_unique=flag(F.col("payments") > 1)))
    if items is not None:
        rows = rows.unionByName(_counts(items, items=F.lit(1)))
    return rows.groupBy("order_id").agg(*(F.sum(c).alias(c) for c in _COUNTS))


def order_rules(orders: DataFrame, payments: DataFrame,
                items: DataFrame | None = None) -> DataFrame:
    """Failures of every rule on orders, payments and items; a NULL order id is no orphan."""
    lost = F.col("order_id").isNotNull() & (F.col("orders") == 0)
    failures = {
        "orders_complete": F.sum("orders_complete"),
        "payments_complete": F.sum("payments_complete"),
        "orders_unique": F.count_if(F.col("orders") > 1),
        "payments_unique": F.sum("payments_unique"),
        "payments_domain": F.sum("payments_domain"),
        "orders_chronology": F.sum("orders_chronology"),
        "orphan_payments": F.sum(F.when(lost, F.col("payments"))),
    }
    if items is not None:
        failures["orphan_items"] = F.sum(F.when(lost, F.col("items")))
    counts = order_counts(orders, payments, items).agg(
        *(F.coalesce(n, F.lit(0)).alias(rule) for rule, n in failures.items()))
    return per_rule(counts, list(failures))


def review_rules(reviews: DataFrame) -> DataFrame:
    counts = reviews.agg(F.count_if(~F.col("review_score").between(1, 5))
                         .alias("review_bounds"))
    return per_rule(counts, ["review_bounds"])


def duplicate_keys(df: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """Number of keys, not rows, that occur more than once."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return repeated.agg(F.count(F.lit(1)).alias("failed_count")).select(
        F.lit(rule).alias("rule"), "failed_count")


def orphans(children: DataFrame, orders: DataFrame, rule: str) -> DataFrame:
    """Child rows whose order is missing; a NULL key on either side is not judged.

    Children are counted per order before the anti join.
    """
    per_order = (children.filter(F.col("order_id").isNotNull())
                 .groupBy("order_id").agg(F.count(F.lit(1)).alias("n")))
    missing = per_order.join(orders.select("order_id"), "order_id", "left_anti")
    return missing.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("failed_count")).select(
        F.lit(rule).alias("rule"), "failed_count")


def audit(orders: DataFrame, payments: DataFrame, reviews: DataFrame | None = None,
          items: DataFrame | None = None) -> DataFrame:
    """One row per rule: failures, PASS or FAIL, and what the rule means.

    Rules of a table that is not given are left out.
    """
    rows = order_rules(orders, payments, items)
    if reviews is not None:
        rows = rows.unionByName(review_rules(reviews))
    return described(rows)


def described(rows: DataFrame) -> DataFrame:
    """Names, verdicts and meanings for rows of rule and failed_count."""
    names = ["rule_name", "category", "severity", "description"]
    about = F.create_map(*[x for rule, facts in RULES.items() for x in (
        F.lit(rule), F.struct(*[F.lit(v).alias(k) for k, v in zip(names, facts)]))])
    return (rows.withColumn("about", about[F.col("rule")])
            .select("about.rule_name", "about.category", "about.severity", "failed_count",
                    F.when(F.col("failed_count") == 0, "PASS").otherwise("FAIL")
                    .alias("status"), "about.description"))


def score(results: DataFrame) -> DataFrame:
    """Share of passed rules, every rule weighing the same, and the health it stands for."""
    passed = F.count_if(F.col("status") == "PASS")
    total = F.count(F.lit(1))
    return (results.agg(total.alias("total_rules"), passed.alias("passed_rules"),
                        (total - passed).alias("failed_rules"),
                        round_to(passed.cast("double") * 100.0 / total, 1)
                        .alias("overall_score"))
            .withColumn("status", F.when(F.col("overall_score") >= 90, "HEALTHY")
                        .when(F.col("overall_score") >= 70, "DEGRADED")
                        .otherwise("CRITICAL")))


def health(results: DataFrame, orders: DataFrame) -> DataFrame:
    audited = orders.agg(F.count(F.lit(1)).alias("total_orders_audited"))
    return score(results).crossJoin(audited)     # one row each


def audit_log(results: DataFrame, run: datetime) -> DataFrame:
    """Rows to append to the audit table; the id follows from run and rule.

    The score is taken over the result rows, one per rule, so the tables are audited once.
    """
    ts = F.lit(run).cast("timestamp")
    rules = Window.partitionBy(F.lit(0))
    passed = F.count_if(F.col("status") == "PASS").over(rules)
    share = passed.cast("double") * 100.0 / F.count(F.lit(1)).over(rules)
    return results.withColumn("score", round_to(share, 1)).select(
        F.sha2(F.concat_ws("|", ts.cast("string"), "rule_name"), 256).alias("audit_id"),
        ts.alias("run_timestamp"), "rule_name", "category", "status",
        F.col("failed_count").alias("failed_records_count"), "score",
        F.col("description").alias("details"))


def newest_audits(log: DataFrame, n: int = 100) -> DataFrame:
    return log.orderBy(F.desc("run_timestamp"), "rule_name").limit(n)


def remediate(orders: DataFrame, payments: DataFrame, items: DataFrame,
              marker: str = "dq_err_%") -> dict[str, tuple[DataFrame, DataFrame]]:
    """``(kept, removed)`` per table: marked ids, negative payments, orders without status.

    Removal does not cascade. The match ignores case and ``_`` stands for any character. A
    NULL id or value never matches.
    """
    marked = F.coalesce(F.col("order_id").cast("string").ilike(marker), F.lit(False))
    bad = {
        "orders": (orders, marked | F.col("order_status").isNull()),
        "payments": (payments, marked | F.coalesce(F.col("payment_value") < 0, F.lit(False))),
        "items": (items, marked),
    }
    return {name: (df.filter(~test), df.filter(test)) for name, (df, test) in bad.items()}
