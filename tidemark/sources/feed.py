"""Normalising a flat order feed into the star schema.

The feed carries text columns ``order_id, customer_id, product_id, city, category,
delivery_status, is_returned, order_timestamp, order_value, payment_method, quantity, price``.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidemark.operators.tablechange import first_per_key, latest_per_key
from tidemark.schemas import TABLES

# Feed status -> order status, fallbacks and the stand-in seller.
STATUS = {"Delivered": "delivered", "Shipped": "shipped", "Processing": "processing",
          "Cancelled": "canceled", "Pending": "invoiced"}
OTHER_STATUS = "processing"
RETURNED = ["yes", "true", "1"]
SELLER, ZIP, STATE = "seller_default_2025", "00000", "XX"
SELLER_CITY, SELLER_STATE = "New York", "NY"

#: Item numbers in one array.
_CHUNK = 10_000


def order_status(status: Column, returned: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    named = F.coalesce(mapping[F.coalesce(status, F.lit("Pending"))], F.lit(OTHER_STATUS))
    return F.when(F.lower(returned.cast("string")).isin(RETURNED), "canceled").otherwise(named)


def repaired_time(text: Column, asof: date) -> Column:
    """``'13:41.9'`` read as 13:41 on ``asof``; anything unreadable is midnight."""
    clock = F.split(text.cast("string"), r"\.")[0]
    stamp = F.concat(F.lit(f"{asof.isoformat()} "), clock, F.lit(":00"))
    return F.coalesce(F.try_to_timestamp(stamp), F.lit(asof).cast("timestamp"))


def payment_method(method: Column) -> Column:
    return F.replace(F.lower(F.coalesce(method, F.lit("credit_card"))), F.lit(" "), F.lit("_"))


def _read(feed: DataFrame, asof: date, sequence: list[str]) -> DataFrame:
    """The feed's rows with their fields mapped, repaired and typed."""
    return feed.select(
        *sequence,
        F.col("order_id").cast("string").alias("order_id"),
        F.col("customer_id").cast("string").alias("customer_id"),
        F.col("product_id").cast("string").alias("product_id"),
        "city", "category",
        order_status(F.col("delivery_status"), F.col("is_returned")).alias("order_status"),
        repaired_time(F.col("order_timestamp"), asof).alias("purchase_ts"),
        F.col("order_value").try_cast("decimal(18,2)").alias("order_value"),
        payment_method(F.col("payment_method")).alias("payment_type"),
        F.col("quantity").try_cast("int").alias("quantity"),
        F.col("price").try_cast("decimal(18,2)").alias("price"))


def normalise(feed: DataFrame, asof: date, sequence: list[str]) -> dict[str, DataFrame]:
    """Customers, products, sellers, orders, payments and items of a feed.

    Customers and products keep their first row, orders and payments their last. Items are
    numbered per quantity; a later feed row of the same order overwrites equal numbers. All items
    belong to the one stand-in seller; a feed without rows has no seller.
    """
    rows = _read(feed, asof, sequence)
    status, bought = F.col("order_status"), F.col("purchase_ts")
    customers = first_per_key(rows.select(
        *sequence, "customer_id", F.col("customer_id").alias("customer_unique_id"),
        F.lit(ZIP).alias("customer_zip_code_prefix"), F.col("city").alias("customer_city"),
        F.lit(STATE).alias("customer_state")), ["customer_id"], sequence)
    products = first_per_key(rows.select(
        *sequence, "product_id", F.col("category").alias("product_category_name")),
        ["product_id"], sequence)
    sellers = rows.select(
        F.lit(SELLER).alias("seller_id"), F.lit(ZIP).alias("seller_zip_code_prefix"),
        F.lit(SELLER_CITY).alias("seller_city"), F.lit(SELLER_STATE).alias("seller_state")).distinct()
    orders = latest_per_key(rows.select(
        *sequence, "order_id", "customer_id", "order_status", "purchase_ts",
        F.when(status != "canceled", bought).alias("approved_ts"),
        F.when(status.isin("shipped", "delivered"), bought).alias("carrier_ts"),
        F.when(status == "delivered", bought).alias("delivered_ts"),
        bought.alias("estimated_ts")), ["order_id"], sequence)
    payments = latest_per_key(rows.select(
        *sequence, "order_id", F.lit(1).alias("payment_sequential"), "payment_type",
        F.lit(1).alias("payment_installments"), F.col("order_value").alias("payment_value")),
        ["order_id", "payment_sequential"], sequence)
    tables = {"customers": customers, "products": products, "sellers": sellers,
              "orders": orders, "payments": payments, "items": numbered_items(rows, sequence)}
    return {name: df.drop(*sequence) for name, df in tables.items()}


def numbered_items(rows: DataFrame, sequence: list[str]) -> DataFrame:
    """Items 1..quantity per feed row; no row for a quantity below one.

    Where rows of one order overlap, the last row wins each number. Per order and quantity
    only the last row can win anything, so rows shrink to that first; walking an order from
    its last row back, a row wins the numbers above the largest quantity seen so far. Items
    are made from those ranges, so only the final ones ever exist; a long range is cut into
    chunks first, so no row holds more than ``_CHUNK`` numbers, whatever the quantity.
    """
    cols = [*sequence, "product_id", "purchase_ts", "price"]
    last = (rows.withColumn("quantity", F.coalesce("quantity", F.lit(1)))
            .filter(F.col("quantity") >= 1)
            .groupBy("order_id", "quantity")
            .agg(F.max_by(F.struct(*cols), F.struct(*sequence)).alias("row"))
            .select("order_id", "quantity", "row.*"))
    return _numbered(last, sequence)


def _numbered(last: DataFrame, sequence: list[str]) -> DataFrame:
    """Items of the last feed row of each order and quantity."""
    later = (Window.partitionBy("order_id").orderBy(*[F.desc(c) for c in sequence])
             .rowsBetween(Window.unboundedPreceding, -1))
    covered = F.coalesce(F.max("quantity").over(later), F.lit(0))
    ranges = last.withColumn("covered", covered).filter(F.col("quantity") > F.col("covered"))
    last_chunk = F.floor((F.col("quantity") - F.col("covered") - 1) / _CHUNK).cast("int")
    chunks = ranges.withColumn("chunk", F.explode(F.sequence(F.lit(0), last_chunk)))
    first = F.col("covered") + 1 + F.col("chunk") * _CHUNK
    size = F.least(F.lit(_CHUNK), F.col("quantity") - first + 1)
    return chunks.select(
        *sequence, "order_id",
        F.explode(F.sequence(first, first + size - 1)).alias("order_item_id"),
        "product_id", F.lit(SELLER).alias("seller_id"),
        F.col("purchase_ts").alias("shipping_limit_date"), "price",
        F.lit(0).cast("decimal(18,2)").alias("freight_value"))


#: Columns that carry the fields of every kind of stored row through the exchange, and what each
#: kind needs in them. Fields follow the order of their names, by which rows of one place compare.
_CARRIERS = {"text": "string", "status": "string", "amount": "decimal(18,2)", "name": "string",
             "stamp": "timestamp"}
_FIELDS = {"customers": ("city", None, None, None, None),
           "products": ("category", None, None, None, None),
           "orders": ("customer_id", "order_status", "order_value", "payment_type", "purchase_ts"),
           "items": (None, None, "price", "product_id", "purchase_ts")}
_KEYS = {"customers": "customer_id", "products": "product_id", "orders": "order_id",
         "items": "order_id"}


def _by_kind(columns: dict[str, Column]) -> Column:
    """The column of the row's own kind; NULL for a kind without one."""
    first, *others = ((F.col("table") == table, column) for table, column in columns.items())
    out = F.when(*first)
    for test, column in others:
        out = out.when(test, column)
    return out


def deciding_rows(feed: DataFrame, asof: date, sequence: list[str]) -> DataFrame:
    """(table, key, number, place, row): what decides every table, from one read of a feed.

    A feed row becomes one row each for its customer, product, order and item quantity, with only
    the fields that this kind needs. The kinds share a few flat columns: four rows to a feed row
    are sorted before the exchange, and should fit into memory. Rows of one key combine there, and
    the first (customers, products) or last one (orders, items) stays. Rows without a key stay all.
    """
    rows = _read(feed, asof, sequence).withColumn("quantity", F.coalesce("quantity", F.lit(1)))
    types = {f.name: f.dataType for f in rows.schema.fields}
    kinds = F.when(F.col("quantity") >= 1, F.array(*map(F.lit, _FIELDS))).otherwise(
        F.array(*(F.lit(table) for table in _FIELDS if table != "items")))
    key = _by_kind({table: F.col(c) for table, c in _KEYS.items()})
    places = [f"place_{i}" for i in range(len(sequence))]
    carried = {carrier: _by_kind({table: F.col(held[i]).cast(dtype)
                                  for table, held in _FIELDS.items() if held[i]})
               for i, (carrier, dtype) in enumerate(_CARRIERS.items())}
    # What tells rows of one key apart: an item's quantity, or anything where there is no key.
    part = _by_kind({"items": F.col("quantity").cast("bigint")}).otherwise(
        F.when(key.isNull(), F.monotonically_increasing_id()))
    spread = rows.select("*", F.explode(kinds).alias("table")).select(
        "table", key.alias("key"), part.alias("part"),
        *(F.col(c).alias(p) for c, p in zip(sequence, places)),
        *(column.alias(carrier) for carrier, column in carried.items()))
    # A kind needs its first or its last row, so the other stays null and isn't shuffled; rows are
    # ordered by their place, which comes first.
    early = F.col("table").isin("customers", "products")
    whole = F.struct(*places, *_CARRIERS)
    chosen = spread.groupBy("table", "key", "part").agg(
        F.min(F.when(early, whole)).alias("first"), F.max(F.when(~early, whole)).alias("last"))
    out = chosen.withColumn("kept", F.coalesce("first", "last"))
    row = {c: _by_kind({table: F.col(f"kept.{carrier}").cast(types[c])
                        for table, held in _FIELDS.items()
                        for carrier, field in zip(_CARRIERS, held) if field == c})
           for c in sorted({c for held in _FIELDS.values() for c in held if c})}
    return out.select(
        "table", "key", _by_kind({"items": F.col("part").cast("int")}).alias("number"),
        F.struct(*(F.col(f"kept.{p}").alias(c) for c, p in zip(sequence, places))).alias("place"),
        F.struct(*(column.alias(c) for c, column in row.items())).alias("row"))


def store(feed: DataFrame, asof: date, sequence: list[str], folder: str) -> None:
    """Write the deciding rows of a feed, partitioned by table, in one job."""
    (deciding_rows(feed, asof, sequence).write.mode("overwrite").partitionBy("table")
     .option("compression", "zstd").parquet(folder))


def stored_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The nine base tables, as ``StarSchema`` takes them, from what ``store`` wrote.

    Tables that a feed doesn't have are empty, columns that it doesn't have are NULL.
    """
    kept = spark.read.parquet(folder)

    def of(kind):
        return kept.filter(F.col("table") == kind).select("key", "number", "place", "row.*")

    orders = of("orders").withColumnRenamed("key", "order_id")
    status, bought = F.col("order_status"), F.col("purchase_ts")
    sequence = kept.schema["place"].dataType.names
    items = _numbered(of("items").select(
        F.col("key").alias("order_id"), F.col("number").alias("quantity"), "place.*",
        "product_id", "purchase_ts", "price"), sequence)
    made = {
        "customers": of("customers").select(
            F.col("key").alias("customer_id"), F.col("key").alias("customer_unique_id"),
            F.lit(ZIP).alias("customer_zip_code_prefix"), F.col("city").alias("customer_city"),
            F.lit(STATE).alias("customer_state")),
        "products": of("products").select(F.col("key").alias("product_id"),
                                          F.col("category").alias("product_category_name")),
        # A feed with any row has an order row.
        "sellers": orders.limit(1).select(
            F.lit(SELLER).alias("seller_id"), F.lit(ZIP).alias("seller_zip_code_prefix"),
            F.lit(SELLER_CITY).alias("seller_city"), F.lit(SELLER_STATE).alias("seller_state")),
        "orders": orders.select(
            "order_id", "customer_id", "order_status", bought.alias("order_purchase_timestamp"),
            F.when(status != "canceled", bought).alias("order_approved_at"),
            F.when(status.isin("shipped", "delivered"), bought)
            .alias("order_delivered_carrier_date"),
            F.when(status == "delivered", bought).alias("order_delivered_customer_date"),
            bought.alias("order_estimated_delivery_date")),
        "order_payments": orders.select(
            "order_id", F.lit(1).alias("payment_sequential"), "payment_type",
            F.lit(1).alias("payment_installments"), F.col("order_value").alias("payment_value")),
        "order_items": items.drop(*sequence)}
    tables = {}
    for name, schema in TABLES.items():
        df = made.get(name)
        tables[name] = spark.createDataFrame([], schema) if df is None else df.select(*(
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields))
    return tables
