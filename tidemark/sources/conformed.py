"""The order star schema read off the supplied TPC-H-style Parquet tables.

==================  =====================================================================
orders              ``orders``; status F, O, P = delivered, shipped, canceled. Delivered on
                    the last ship date of an F order; promised a year after purchase.
payments, items     ``lineitem``; one line is one payment and one item.
customers           ``customer`` with ``nation``: state = nation, city = market segment.
products            ``part``; the largest sizes carry no category.
reviews             orders that were not canceled, scored by the digit of their priority.
==================  =====================================================================
"""

from __future__ import annotations

from datetime import date
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators.extent import date_extent
from tidemark.plans import configure

_STATUS = {"F": "delivered", "O": "shipped", "P": "canceled"}
_PAYMENT = {"R": "credit_card", "A": "boleto", "N": "voucher"}


def _recode(column: str, codes: dict[str, str]):
    out = None
    for code, name in codes.items():
        test = F.col(column) == code
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


class Mart:
    """Lazy DataFrames over one data folder, plus the anchor date taken from the data."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._tables[name]

    @cached_property
    def orders(self) -> DataFrame:
        last_ship = (self.table("lineitem").groupBy("l_orderkey")
                     .agg(F.max("l_shipdate").alias("last_ship")))
        o = self.table("orders")
        return (o.join(last_ship, o.o_orderkey == last_ship.l_orderkey, "left")
                .select(F.col("o_orderkey").alias("order_id"),
                        F.col("o_custkey").alias("customer_id"),
                        _recode("o_orderstatus", _STATUS).alias("order_status"),
                        F.col("o_orderdate").alias("purchase_ts"),
                        F.when(F.col("o_orderstatus") == "F", F.col("last_ship"))
                        .alias("delivered_ts"),
                        (F.col("o_orderdate") + F.expr("INTERVAL 365 DAYS"))
                        .alias("estimated_ts")))

    @cached_property
    def payments(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("payment_sequential"),
            _recode("l_returnflag", _PAYMENT).alias("payment_type"),
            F.col("l_extendedprice").cast("decimal(18,2)").alias("payment_value"))

    @cached_property
    def items(self) -> DataFrame:
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("order_item_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("seller_id"),
            F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))

    @cached_property
    def customers(self) -> DataFrame:
        c, n = self.table("customer"), self.table("nation")
        return (c.join(n, c.c_nationkey == n.n_nationkey)
                .select(F.col("c_custkey").alias("customer_id"),
                        F.col("n_name").alias("customer_state"),
                        F.col("c_mktsegment").alias("customer_city")))

    @cached_property
    def products(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("product_id"),
            F.when(F.col("p_size") <= 45, F.col("p_type")).alias("category"))

    @cached_property
    def translation(self) -> DataFrame:
        return (self.table("part").filter("p_type <> 'PROMO'").select("p_type").distinct()
                .select(F.col("p_type").alias("category"),
                        F.lower("p_type").alias("category_english")))

    @cached_property
    def reviews(self) -> DataFrame:
        return (self.table("orders").filter(F.col("o_orderstatus") != "P")
                .select(F.col("o_orderkey").alias("review_id"),
                        F.col("o_orderkey").alias("order_id"),
                        F.substring("o_orderpriority", 1, 1).cast("int")
                        .alias("review_score")))

    @cached_property
    def _extent(self):
        dates = self.table("orders").select(F.col("o_orderdate").alias("purchase_ts"))
        return date_extent(dates).first()

    @property
    def asof(self) -> date:
        return self._extent["max_date"].date()

    @property
    def first_day(self) -> date:
        return self._extent["min_date"].date()
