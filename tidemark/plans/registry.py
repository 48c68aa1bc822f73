"""Metric specifications: thresholds of the nine built-in metrics, and SQL-defined ones."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tidemark.schemas import KPI_SPEC

_FIELDS = [f.name for f in KPI_SPEC.fields]

# The shipped configuration (name, description, threshold type and value,
# comparison period, priority).
_SHIPPED = [
    ("daily_revenue", "Daily Revenue", "percentage_drop", 10.0, "previous_week", "high"),
    ("average_order_value", "Average Order Value (AOV)", "percentage_drop", 15.0,
     "previous_week", "medium"),
    ("daily_order_volume", "Daily Order Volume", "percentage_drop", 20.0, "previous_week",
     "high"),
    ("customer_churn_rate", "Customer Churn Rate", "absolute_spike", 5.0, "previous_month",
     "high"),
    ("conversion_rate", "Order Conversion Rate (Delivered Orders)", "percentage_drop", 15.0,
     "previous_week", "high"),
    ("payment_approval_rate", "Payment Approval Rate", "percentage_drop", 10.0,
     "previous_week", "medium"),
    ("average_delivery_time", "Average Delivery Time (Days)", "absolute_spike", 3.0,
     "previous_week", "medium"),
    ("on_time_delivery_rate", "On-Time Delivery Rate", "percentage_drop", 10.0,
     "previous_week", "medium"),
    ("repeat_customer_rate", "Repeat Customer Rate", "percentage_drop", 5.0,
     "previous_month", "low"),
]

SHIPPED_SPECS = [
    dict(name=n, description=d, threshold_type=t, threshold_value=v, comparison_period=p,
         alert_enabled=True, alert_priority=a)
    for n, d, t, v, p, a in _SHIPPED
]


def load_specs(path: str) -> list[dict]:
    """Specs of a JSON configuration with a ``kpis`` list; a missing file has none."""
    file = Path(path)
    return json.loads(file.read_text("utf-8")).get("kpis", []) if file.exists() else []


def spec_frame(spark: SparkSession, specs: list[dict] | None = None) -> DataFrame:
    """Specs as rows; absent fields take the documented defaults."""
    rows = []
    for spec in SHIPPED_SPECS if specs is None else specs:
        row = {"threshold_type": "percentage_drop", "threshold_value": 10.0,
               "comparison_period": "previous_week", "alert_enabled": False,
               "alert_priority": "medium", "description": "", **spec}
        row["threshold_value"] = float(row["threshold_value"])
        rows.append(tuple(row.get(f) for f in _FIELDS))
    return spark.createDataFrame(rows, KPI_SPEC)
