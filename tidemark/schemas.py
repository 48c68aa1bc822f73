"""Declared schemas, keys and fixed domain values of the order star schema."""

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    types = {"s": T.StringType(), "i": T.IntegerType(), "d": T.DoubleType(),
             "t": T.TimestampType(), "m": T.DecimalType(18, 2), "l": T.LongType(),
             "b": T.BooleanType()}
    fields = (f.split(":") for f in spec.split())
    return T.StructType([T.StructField(name, types[kind], True) for name, kind in fields])


# Column names and order of the nine source tables.
TABLES: dict[str, T.StructType] = {
    "customers": _struct(
        "customer_id:s customer_unique_id:s customer_zip_code_prefix:s "
        "customer_city:s customer_state:s"),
    "geolocation": _struct(
        "geolocation_zip_code_prefix:s geolocation_lat:d geolocation_lng:d "
        "geolocation_city:s geolocation_state:s"),
    "order_items": _struct(
        "order_id:s order_item_id:i product_id:s seller_id:s "
        "shipping_limit_date:t price:m freight_value:m"),
    "order_payments": _struct(
        "order_id:s payment_sequential:i payment_type:s payment_installments:i payment_value:m"),
    "order_reviews": _struct(
        "review_id:s order_id:s review_score:i review_comment_title:s "
        "review_comment_message:s review_creation_date:t review_answer_timestamp:t"),
    "orders": _struct(
        "order_id:s customer_id:s order_status:s order_purchase_timestamp:t "
        "order_approved_at:t order_delivered_carrier_date:t "
        "order_delivered_customer_date:t order_estimated_delivery_date:t"),
    "products": _struct(
        "product_id:s product_category_name:s product_name_lenght:d "
        "product_description_lenght:d product_photos_qty:d product_weight_g:d "
        "product_length_cm:d product_height_cm:d product_width_cm:d"),
    "sellers": _struct("seller_id:s seller_zip_code_prefix:s seller_city:s seller_state:s"),
    "category_translation": _struct(
        "product_category_name:s product_category_name_english:s"),
}

# Primary keys; a table without an entry is append-only.
KEYS: dict[str, list[str]] = {
    "customers": ["customer_id"],
    "order_items": ["order_id", "order_item_id"],
    "order_payments": ["order_id", "payment_sequential"],
    "order_reviews": ["review_id"],
    "orders": ["order_id"],
    "products": ["product_id"],
    "sellers": ["seller_id"],
    "category_translation": ["product_category_name"],
}

DQ_AUDIT = _struct(
    "audit_id:s run_timestamp:t rule_name:s category:s status:s "
    "failed_records_count:l score:d details:s")

INCIDENTS = _struct(
    "incident_id:s created_at:t kpi_name:s severity:s status:s trigger_value:d "
    "threshold_value:d description:s acknowledged_by:s acknowledged_at:t resolution_notes:s")

KPI_SPEC = _struct(
    "name:s description:s sql_query:s threshold_type:s threshold_value:d "
    "comparison_period:s alert_enabled:b alert_priority:s")

SCENARIO = _struct("price_change_pct:d churn_change_pct:d delivery_delay_days:d")

# Every derived daily value is kept in this type: decimal sums do not depend on the order in
# which tasks finish, so a baseline is the same number on every run.
VALUE = "decimal(28,6)"

# Order states.
CANCELED = "canceled"
DELIVERED = "delivered"
APPROVED_STATES = ["approved", "processing", "shipped", "delivered"]
