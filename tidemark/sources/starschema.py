"""The nine base tables under the column names the operators use."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.extent import date_extent
from tidemark.schemas import TABLES

_ORDER_NAMES = {"order_purchase_timestamp": "purchase_ts", "order_approved_at": "approved_ts",
                "order_delivered_carrier_date": "carrier_ts",
                "order_delivered_customer_date": "delivered_ts",
                "order_estimated_delivery_date": "estimated_ts"}


class StarSchema:
    """Base tables as read by ``csvtables.load_tables`` or from a folder of Parquet tables.

    ``asof`` anchors every window; it defaults to the day of the newest purchase, found with
    one aggregate on one column.
    """

    def __init__(self, tables: dict[str, DataFrame], asof: date | None = None):
        self.tables = tables
        self.orders = tables["orders"].withColumnsRenamed(_ORDER_NAMES)
        self.payments = tables["order_payments"]
        self.items = tables["order_items"]
        self.reviews = tables["order_reviews"]
        self.customers = tables["customers"]
        self.products = tables["products"].select(
            "product_id", F.col("product_category_name").alias("category"))
        self.translation = tables["category_translation"].select(
            F.col("product_category_name").alias("category"),
            F.col("product_category_name_english").alias("category_english"))
        self._asof = asof

    @classmethod
    def from_parquet(cls, spark: SparkSession, folder: str, asof: date | None = None):
        return cls({t: spark.read.schema(s).parquet(f"{folder}/{t}")
                    for t, s in TABLES.items()}, asof)

    @property
    def asof(self) -> date:
        if self._asof is None:
            newest = date_extent(self.orders).first()["max_date"]
            if newest is None:
                raise ValueError("no orders: give the anchor date")
            self._asof = newest.date()
        return self._asof


def write_parquet(tables: dict[str, DataFrame], folder: str) -> None:
    """The base tables as Parquet below ``folder``."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
