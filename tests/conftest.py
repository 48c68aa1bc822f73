import os
import sys
from datetime import datetime

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.plans import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "local[8]", **{
        "spark__sql__shuffle__partitions": "4", "spark__ui__enabled": "false",
        "spark__driver__memory": "6g", "spark__ui__showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def ts(text):
    return datetime.fromisoformat(text) if text else None


@pytest.fixture(scope="session")
def make(spark):
    """Build operator inputs from short rows; ISO strings become timestamps."""
    schemas = {
        "orders": "order_id string, customer_id string, order_status string, "
                  "purchase_ts timestamp, delivered_ts timestamp, estimated_ts timestamp",
        "payments": "order_id string, payment_sequential int, payment_type string, "
                    "payment_value decimal(18,2)",
        "customers": "customer_id string, customer_state string, customer_city string",
        "reviews": "order_id string, review_score int",
        "items": "order_id string, order_item_id int, product_id string, price decimal(18,2)",
        "products": "product_id string, category string",
        "translation": "category string, category_english string",
        "series": "segment string, metric string, day date, value decimal(28,6)",
        "values": "kpi string, segment string, day date, value decimal(28,6)",
    }
    from decimal import Decimal

    def build(kind, rows):
        fields = [f.strip().split(" ")[1] for f in schemas[kind].replace("(18,2)", "")
                  .replace("(28,6)", "").split(",")]
        def conv(v, t):
            if v is None:
                return None
            if t == "timestamp":
                return ts(v)
            if t == "date":
                return datetime.fromisoformat(v).date()
            return Decimal(str(v)) if t == "decimal" else v
        data = []
        for row in rows:
            row = tuple(row) + (None,) * (len(fields) - len(row))
            data.append(tuple(conv(v, t) for v, t in zip(row, fields)))
        return spark.createDataFrame(data, schemas[kind])
    return build
