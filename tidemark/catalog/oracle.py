"""DuckDB SQL for the registered queries, written as plain joins over the raw rows.

Each statement is an independent formulation: children are joined row by row, windows of days
are spelled out as one row per day, and smoothing is a recursive query.
"""

from __future__ import annotations

from itertools import combinations

ORACLE: dict[str, str] = {}

# --- the conformed tables -------------------------------------------------------------------

TABLES = """
anchor AS (SELECT CAST(max(o_orderdate) AS DATE) AS d, CAST(min(o_orderdate) AS DATE) AS d0
           FROM orders),
ship AS (SELECT l_orderkey, max(l_shipdate) AS last_ship FROM lineitem GROUP BY 1),
o AS (SELECT o_orderkey AS order_id, o_custkey AS customer_id,
        CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped'
             WHEN 'P' THEN 'canceled' END AS order_status,
        o_orderdate AS purchase_ts,
        CASE WHEN o_orderstatus = 'F' THEN last_ship END AS delivered_ts,
        o_orderdate + INTERVAL 365 DAY AS estimated_ts,
        CAST(o_orderdate AS DATE) AS day
      FROM orders LEFT JOIN ship ON l_orderkey = o_orderkey),
p AS (SELECT l_orderkey AS order_id, l_linenumber AS payment_sequential,
        CASE l_returnflag WHEN 'R' THEN 'credit_card' WHEN 'A' THEN 'boleto'
             WHEN 'N' THEN 'voucher' END AS payment_type,
        CAST(l_extendedprice AS DECIMAL(18,2)) AS payment_value FROM lineitem),
it AS (SELECT l_orderkey AS order_id, l_linenumber AS order_item_id, l_partkey AS product_id,
        CAST(l_extendedprice AS DECIMAL(18,2)) AS price FROM lineitem),
c AS (SELECT c_custkey AS customer_id, n_name AS customer_state,
        c_mktsegment AS customer_city FROM customer JOIN nation ON c_nationkey = n_nationkey),
pr AS (SELECT p_partkey AS product_id, CASE WHEN p_size <= 45 THEN p_type END AS category
       FROM part),
tr AS (SELECT DISTINCT p_type AS category, lower(p_type) AS category_english FROM part
       WHERE p_type <> 'PROMO'),
rv AS (SELECT o_orderkey AS order_id, CAST(o_orderpriority[1] AS INTEGER) AS review_score
       FROM orders WHERE o_orderstatus <> 'P'),
so AS (SELECT o.*, unnest(['ALL', customer_state]) AS segment, customer_state, customer_city,
         c.customer_id IS NOT NULL AS known
       FROM o LEFT JOIN c ON o.customer_id = c.customer_id),
segs AS (SELECT 'ALL' AS segment UNION SELECT customer_state FROM c)
"""
ANCHOR = "(SELECT d FROM anchor)"
DAYS = ("cal AS (SELECT CAST(unnest(generate_series((SELECT d0 FROM anchor), "
        "(SELECT d FROM anchor), INTERVAL 1 DAY)) AS DATE) AS day)")


def add(name: str, body: str, *ctes: str) -> None:
    ORACLE[name] = "WITH RECURSIVE " + ",\n".join([TABLES.strip(), *ctes]) + "\n" + body


def rnd(x: str, n: int) -> str:
    return f"(round(CAST(({x}) AS DOUBLE), {n}) + 0e0)"


def settle(x: str, n: int) -> str:
    return f"(floor(({x}) * {10 ** n}e0 + 0.500001e0) / {10 ** n}e0)"


def dbl(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def mean(x: str) -> str:
    return f"({dbl(f'sum({x})')} / nullif(count({x}), 0))"


def micros(a: str = "delivered_ts", b: str = "purchase_ts") -> str:
    return f"(epoch_us({a}) - epoch_us({b}))"


def mean_days(x: str) -> str:
    return f"({dbl(f'sum({x})')} / 864e8 / count({x}))"


def cents(x: str) -> str:
    return f"(floor({dbl(f'sum({x}) * 100')} / nullif(count({x}), 0) + 5e-1) / 100e0)"


def val(x: str) -> str:
    return f"CAST({x} AS DECIMAL(28,6))"


# --- ingest ----------------------------------------------------------------------------------

add("ingest_csv_orders", """
SELECT CAST(order_id AS VARCHAR) AS order_id, CAST(customer_id AS VARCHAR) AS customer_id,
  order_status, purchase_ts AS order_purchase_timestamp,
  CAST(NULL AS TIMESTAMP) AS order_approved_at,
  CAST(NULL AS TIMESTAMP) AS order_delivered_carrier_date,
  delivered_ts AS order_delivered_customer_date,
  estimated_ts AS order_estimated_delivery_date FROM o""")
add("clean_text", """
SELECT c_custkey, c_name AS name,
  CASE WHEN c_nationkey >= 12 THEN c_mktsegment END AS segment FROM customer""")

_LINE = "l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice"


def _line_pick(where: str, direction: str) -> str:
    order = ", ".join(f"{c} {direction}" for c in
                      ("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"))
    return (f"SELECT {_LINE} FROM lineitem WHERE {where} QUALIFY row_number() OVER "
            f"(PARTITION BY l_orderkey, l_linenumber ORDER BY {order}) = 1")


_N, _NOT_N = "l_returnflag = 'N'", "l_returnflag <> 'N'"
_ABSENT = ("SELECT a.* FROM {a} a WHERE NOT EXISTS (SELECT 1 FROM {b} b WHERE "
           "b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber)")
add("upsert_latest",
    "SELECT * FROM fresh UNION ALL " + _ABSENT.format(a="old", b="fresh"),
    f"old AS ({_line_pick(_NOT_N, 'DESC')})", f"fresh AS ({_line_pick(_N, 'DESC')})")
add("insert_if_absent",
    "SELECT * FROM old UNION ALL " + _ABSENT.format(a="fresh", b="old"),
    f"old AS ({_line_pick(_NOT_N, 'ASC')})", f"fresh AS ({_line_pick(_N, 'ASC')})")
add("table_row_counts", " UNION ALL ".join(
    f"SELECT '{name}' AS table_name, count(*) AS row_count FROM {t}" for name, t in (
        ("customers", "c"), ("order_items", "it"), ("order_payments", "p"),
        ("order_reviews", "rv"), ("orders", "o"), ("products", "pr"),
        ("category_translation", "tr"))))
add("parameterised_sql", """
SELECT customer_id, count(*) AS n_orders, max(purchase_ts) AS last_purchase
FROM o WHERE order_status = 'delivered' GROUP BY customer_id""")

_FEED = """
feed AS (SELECT l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
  CAST(l_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id,
  CAST(l_partkey AS VARCHAR) AS product_id, c_mktsegment AS city, p_type AS category,
  CASE WHEN l_returnflag = 'R' AND l_discount > 0.05 THEN 'canceled'
       WHEN o_orderstatus = 'F' THEN 'delivered' WHEN o_orderstatus = 'O' THEN 'shipped'
       WHEN l_linestatus = 'O' THEN 'invoiced' ELSE 'processing' END AS order_status,
  CAST((SELECT d FROM anchor) AS TIMESTAMP) + CASE WHEN l_linenumber < 7 THEN
    to_minutes(CAST((l_linenumber + 8) * 60 + l_quantity AS INTEGER))
    ELSE INTERVAL 0 MINUTE END AS purchase_ts,
  CAST(l_extendedprice AS DECIMAL(18,2)) AS money,
  CASE l_returnflag WHEN 'R' THEN 'credit_card' WHEN 'A' THEN 'debit_card'
       ELSE 'gift_card' END AS payment_type,
  CAST(l_quantity AS INTEGER) - 10 AS quantity
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey)"""


def _feed_pick(columns: str, key: str, direction: str, source: str = "feed") -> str:
    order = ", ".join(f"{c} {direction}" for c in (
        "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return (f"SELECT {columns} FROM {source} QUALIFY row_number() OVER "
            f"(PARTITION BY {key} ORDER BY {order}) = 1")


add("feed_customers", _feed_pick(
    "customer_id, customer_id AS customer_unique_id, '00000' AS customer_zip_code_prefix, "
    "city AS customer_city, 'XX' AS customer_state", "customer_id", "ASC"), _FEED)
add("feed_products", _feed_pick("product_id, category AS product_category_name",
                                "product_id", "ASC"), _FEED)
add("feed_orders", _feed_pick(
    "order_id, customer_id, order_status, purchase_ts, "
    "CASE WHEN order_status <> 'canceled' THEN purchase_ts END AS approved_ts, "
    "CASE WHEN order_status IN ('shipped', 'delivered') THEN purchase_ts END AS carrier_ts, "
    "CASE WHEN order_status = 'delivered' THEN purchase_ts END AS delivered_ts, "
    "purchase_ts AS estimated_ts", "order_id", "DESC"), _FEED)
add("feed_payments", _feed_pick(
    "order_id, 1 AS payment_sequential, payment_type, 1 AS payment_installments, "
    "CAST(money AS DOUBLE) AS payment_value", "order_id", "DESC"), _FEED)
add("feed_sellers", """
SELECT DISTINCT 'seller_default_2025' AS seller_id, '00000' AS seller_zip_code_prefix,
  'New York' AS seller_city, 'NY' AS seller_state FROM feed""", _FEED)
add("feed_regional_summary", f"""
SELECT 'XX' AS customer_state, city AS customer_city, count(*) AS total_orders,
  CAST(sum(money) AS DOUBLE) AS state_revenue, {cents('money')} AS state_aov,
  CAST(NULL AS DOUBLE) AS avg_csat, CAST(sum(items) AS BIGINT) AS items
FROM fo JOIN fc USING (customer_id) LEFT JOIN fi USING (order_id) GROUP BY city
HAVING count(*) >= 3""", _FEED,
    "fo AS (" + _feed_pick("order_id, customer_id, money", "order_id", "DESC") + ")",
    "fc AS (" + _feed_pick("customer_id, city", "customer_id", "ASC") + ")",
    "fi AS (SELECT order_id, max(quantity) AS items FROM feed WHERE quantity >= 1 GROUP BY 1)")
add("feed_items", """
SELECT order_id, i AS order_item_id, product_id, 'seller_default_2025' AS seller_id,
  purchase_ts AS shipping_limit_date, CAST(money AS DOUBLE) AS price,
  CAST(0 AS DOUBLE) AS freight_value FROM items""", _FEED,
    "numbered AS (SELECT *, unnest(range(1, quantity + 1)) AS i FROM feed WHERE quantity >= 1)",
    "items AS (" + _feed_pick(
        "order_id, CAST(i AS INTEGER) AS i, product_id, purchase_ts, money", "order_id, i",
        "DESC", "numbered") + ")")
add("sql_kpi_errors", """
SELECT 'orders_of_day' AS kpi, 'judged' AS outcome, CAST(count(*) AS DOUBLE) AS current_value
FROM o WHERE day = (SELECT d FROM anchor)
UNION ALL SELECT unnest(['no_such_column', 'division_by_zero']), 'error', NULL""")
add("sql_kpi_summary", """
SELECT CAST(3 AS BIGINT) AS total, CAST(2 AS BIGINT) AS errors, 1 AS run_status""")
add("rebase_dates", """
SELECT order_id, customer_id, order_status, purchase_ts + to_days(n) AS purchase_ts,
  delivered_ts + to_days(n) AS delivered_ts, estimated_ts + to_days(n) AS estimated_ts
FROM o, (SELECT CAST(date_diff('day', (SELECT max(o_orderdate) FROM orders),
   (SELECT max(l_shipdate) FROM lineitem)) AS INTEGER) AS n)""")
add("purge_recent_window", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {t} {w}" for n, t, w in (
        ("orders", "kept", ""),
        ("payments", "p", "WHERE order_id IN (SELECT order_id FROM kept)"),
        ("items", "it", "WHERE order_id IN (SELECT order_id FROM kept)"))),
    f"kept AS (SELECT order_id FROM o WHERE day < {ANCHOR} - 700)")
_MARK = "CAST(order_id AS VARCHAR) ILIKE '12_4%'"
_PAYX = ("(SELECT l_orderkey AS order_id, CAST(l_extendedprice - l_quantity * 1000 "
         "AS DECIMAL(18,2)) AS v FROM lineitem)")
add("remediate_tables", " UNION ALL ".join(
    f"SELECT '{name}_{side}' AS table_name, count(*) FILTER ({'NOT ' if side == 'kept' else ''}"
    f"({test})) AS row_count FROM {t}"
    for name, t, test in (
        ("orders", "o", f"{_MARK} OR order_status = 'shipped'"),
        ("payments", _PAYX, f"{_MARK} OR v < 0"), ("items", "it", _MARK))
    for side in ("kept", "removed")))
add("date_extent", "SELECT min(purchase_ts) AS min_date, max(purchase_ts) AS max_date FROM o")
add("recent_distribution", f"""
SELECT day, count(*) AS row_count, CAST(sum(payment_value) AS DOUBLE) AS revenue
FROM o LEFT JOIN p USING (order_id) WHERE day >= {ANCHOR} - 7 GROUP BY day""")
add("recent_history", f"""
SELECT day, CAST(sum(payment_value) AS DOUBLE) AS revenue,
  count(DISTINCT order_id) AS order_volume
FROM o LEFT JOIN p USING (order_id)
WHERE day >= {ANCHOR} - 14 AND order_status <> 'canceled' GROUP BY day""")

# --- metric values ---------------------------------------------------------------------------

_PAID = "so JOIN p ON p.order_id = so.order_id WHERE order_status <> 'canceled'"
_DAY_SQL = {
    "daily_revenue": f"SELECT segment, day, {val('sum(payment_value)')} AS value "
                     f"FROM {_PAID} GROUP BY 1, 2",
    "average_order_value": f"SELECT segment, day, {val(mean('payment_value'))} AS value "
                           f"FROM {_PAID} GROUP BY 1, 2",
    "daily_order_volume": f"SELECT segment, day, {val('count(DISTINCT order_id)')} AS value "
                          "FROM so WHERE order_status <> 'canceled' GROUP BY 1, 2",
    "conversion_rate": "SELECT segment, day, " + val(
        "count(*) FILTER (order_status = 'delivered') * 100e0 / count(*)")
        + " AS value FROM so GROUP BY 1, 2",
    "payment_approval_rate": "SELECT segment, day, " + val(
        "count(*) FILTER (order_status IN ('approved', 'processing', 'shipped', 'delivered'))"
        " * 100e0 / count(*)") + " AS value FROM so GROUP BY 1, 2",
}


def _day_kpi(kpi: str) -> list[str]:
    return [f"{kpi}_days AS ({_DAY_SQL[kpi]})",
            f"""{kpi} AS (SELECT '{kpi}' AS kpi, * FROM {kpi}_days
UNION ALL SELECT '{kpi}', segment, d, {val('0')} FROM segs, anchor WHERE NOT EXISTS (
  SELECT 1 FROM {kpi}_days x WHERE x.segment = segs.segment AND x.day = anchor.d))"""]


_DELIVERY = [f"""done AS (SELECT segment, least(CAST(delivered_ts AS DATE), {ANCHOR}) AS dd,
  {micros()} AS us, CAST(delivered_ts <= estimated_ts AS INTEGER) AS ok
  FROM so WHERE order_status = 'delivered' AND delivered_ts IS NOT NULL)""",
    """week AS (SELECT segment, dd + CAST(k AS INTEGER) AS day, us, ok
  FROM done, range(0, 8) t(k))""",
    f"""rolled AS (SELECT segs.segment, cal.day,
  coalesce({mean_days('us')}, 0e0) AS mean_time,
  coalesce(sum(ok) * 100e0 / nullif(count(ok), 0), 0e0) AS on_time
  FROM segs CROSS JOIN cal LEFT JOIN week USING (segment, day) GROUP BY 1, 2)""",
    f"average_delivery_time AS (SELECT 'average_delivery_time' AS kpi, segment, day, "
    f"{val('mean_time')} AS value FROM rolled)",
    f"on_time_delivery_rate AS (SELECT 'on_time_delivery_rate' AS kpi, segment, day, "
    f"{val('on_time')} AS value FROM rolled)"]

_CUSTOMER = [
    """prior AS (SELECT DISTINCT segment, customer_id, known, day + CAST(k AS INTEGER) AS day
  FROM so, range(31, 61) t(k))""",
    """visits AS (SELECT segment, customer_id, day + CAST(k AS INTEGER) AS day, count(*) AS n
  FROM so, range(0, 31) t(k) GROUP BY ALL)""",
    """churn AS (SELECT prior.segment, prior.day, count(*) AS base,
    count(*) FILTER (visits.n IS NULL AND known) AS lost
  FROM prior LEFT JOIN visits USING (segment, customer_id, day) GROUP BY 1, 2)""",
    f"""customer_churn_rate AS (SELECT 'customer_churn_rate' AS kpi, segs.segment, cal.day,
  {val('coalesce(lost * 100e0 / base, 0e0)')} AS value
  FROM segs CROSS JOIN cal LEFT JOIN churn USING (segment, day))""",
    """buyers AS (SELECT segment, day, count(*) AS n, count(*) FILTER (n > 1) AS again
  FROM visits GROUP BY 1, 2)""",
    f"""repeat_customer_rate AS (SELECT 'repeat_customer_rate' AS kpi, segs.segment, cal.day,
  {val('coalesce(again * 100e0 / n, 0e0)')} AS value
  FROM segs CROSS JOIN cal LEFT JOIN buyers USING (segment, day))"""]

_GROUPS = {**{k: _day_kpi(k) for k in _DAY_SQL},
           "average_delivery_time": [DAYS, *_DELIVERY],
           "on_time_delivery_rate": [DAYS, *_DELIVERY],
           "customer_churn_rate": [DAYS, *_CUSTOMER],
           "repeat_customer_rate": [DAYS, *_CUSTOMER]}
for _k, _ctes in _GROUPS.items():
    add(f"kpi_{_k}", f"SELECT kpi, segment, day, CAST(value AS DOUBLE) AS value FROM {_k}",
        *_ctes)


def _cohort(start: int, end: int) -> str:
    return f"""
SELECT coalesce(count(*) FILTER (NOT later AND c.customer_id IS NOT NULL) * 100e0
  / nullif(count(*), 0), 0e0) AS value
FROM (SELECT customer_id, bool_or(day < {ANCHOR} - {end}) AS before,
        bool_or(day >= {ANCHOR} - {end}) AS later
      FROM o WHERE day >= {ANCHOR} - {start} GROUP BY 1) x
LEFT JOIN c USING (customer_id) WHERE before"""


add("churn_now", _cohort(60, 30))
add("churn_prior_cohort", _cohort(90, 60))

# --- verdicts -----------------------------------------------------------------------------------

_ALL_KPIS = [DAYS, *[s for k in _DAY_SQL for s in _day_kpi(k)], *_DELIVERY, *_CUSTOMER]
_VALUES = "vals AS (" + " UNION ALL ".join(f"SELECT * FROM {k}" for k in _GROUPS) + ")"
_SPEC_ROWS = [
    ("daily_revenue", "Daily Revenue", "percentage_drop", 10, 7, "high"),
    ("average_order_value", "Average Order Value (AOV)", "percentage_drop", 15, 7, "medium"),
    ("daily_order_volume", "Daily Order Volume", "percentage_drop", 20, 7, "high"),
    ("customer_churn_rate", "Customer Churn Rate", "absolute_spike", 5, 30, "high"),
    ("conversion_rate", "Order Conversion Rate (Delivered Orders)", "percentage_drop", 15, 7,
     "high"),
    ("payment_approval_rate", "Payment Approval Rate", "percentage_drop", 10, 7, "medium"),
    ("average_delivery_time", "Average Delivery Time (Days)", "absolute_spike", 3, 7,
     "medium"),
    ("on_time_delivery_rate", "On-Time Delivery Rate", "percentage_drop", 10, 7, "medium"),
    ("repeat_customer_rate", "Repeat Customer Rate", "percentage_drop", 5, 30, "low"),
]
_SPECS = ("spec(kpi, description, threshold_type, t, back, priority) AS (VALUES "
          + ", ".join(f"('{k}', '{d}', '{y}', {t}e0, {b}, '{a}')"
                      for k, d, y, t, b, a in _SPEC_ROWS) + ")")


def _judged(values: str = "vals") -> list[str]:
    """History and verdict CTEs; the result is called ``judged``."""
    def over(n):
        return (f"OVER (PARTITION BY kpi, segment ORDER BY day RANGE BETWEEN "
                f"INTERVAL {n} DAY PRECEDING AND INTERVAL 1 DAY PRECEDING)")

    def pick(f):
        return f"CASE WHEN back = 30 THEN {f} {over(30)} ELSE {f} {over(7)} END"

    return [
        f"""hist AS (SELECT *, CAST(value AS DOUBLE) AS cur,
  {pick('count(*)')} AS n, {pick('sum(value)')} AS total,
  {pick('stddev_pop(CAST(value AS DOUBLE))')} AS std
  FROM {values} JOIN spec USING (kpi))""",
        """based AS (SELECT *, CAST(total AS DOUBLE) / nullif(n, 0) AS base FROM hist)""",
        """changed AS (SELECT *,
  CASE WHEN base <> 0 THEN (cur - base) / base * 100e0 END AS chg,
  CASE WHEN base <> 0 AND n > 1 AND std > 0 THEN (cur - base) / std END AS z FROM based)""",
        """excess AS (SELECT *, CASE WHEN base <> 0 THEN CASE threshold_type
    WHEN 'percentage_drop' THEN -chg - t WHEN 'percentage_spike' THEN chg - t
    WHEN 'absolute_drop' THEN (base - cur) - t WHEN 'absolute_spike' THEN (cur - base) - t
    WHEN 'statistical' THEN abs(z) - t END END AS over_by,
  CASE WHEN base <> 0 THEN CASE threshold_type
    WHEN 'percentage_drop' THEN chg < -t WHEN 'percentage_spike' THEN chg > t
    WHEN 'absolute_drop' THEN base - cur > t WHEN 'absolute_spike' THEN cur - base > t
    WHEN 'statistical' THEN abs(z) > t END END AS hit FROM changed)""",
        """judged AS (SELECT * EXCLUDE (chg), CASE WHEN hit THEN 'alert' ELSE 'normal' END
    AS status, CASE WHEN base = 0 AND cur > 0 THEN 100e0 ELSE chg END AS chg,
  CASE WHEN n = 0 THEN 'No historical data available'
       WHEN base = 0 AND cur > 0 THEN 'Baseline was zero, new value detected'
       WHEN base = 0 THEN 'Both baseline and current are zero' END AS reason FROM excess)"""]


_STATUS_CTES = [*_ALL_KPIS, _VALUES, _SPECS, *_judged()]
_STATUS_ROW = f"""
SELECT kpi, segment, day, cur AS current_value, {rnd('base', 4)} AS baseline,
  {settle('std', 4)} AS historical_std, CASE WHEN n = 1 THEN 5 ELSE n END AS historical_count,
  {rnd('chg', 4)} AS change_percent, threshold_type, t AS threshold_value,
  CASE WHEN hit THEN {rnd('over_by', 4)} END AS breach_amount, status, reason,
  true AS alert_enabled, priority AS alert_priority FROM judged"""
_TODAY = f"day = {ANCHOR}"
add("kpi_status", f"{_STATUS_ROW} WHERE {_TODAY} AND segment = 'ALL'", *_STATUS_CTES)
add("kpi_status_by_state", f"{_STATUS_ROW} WHERE {_TODAY}", *_STATUS_CTES)
add("kpi_status_backtest", f"{_STATUS_ROW} WHERE segment = 'ALL'", *_STATUS_CTES)
add("kpi_history_values", f"""
SELECT kpi, segment, CAST(row_number() OVER (PARTITION BY kpi, segment ORDER BY day) - 1
  AS INTEGER) AS position, CAST(value AS DOUBLE) AS value
FROM (SELECT v.* FROM vals v JOIN spec ON spec.kpi = v.kpi
      WHERE day >= {ANCHOR} - back AND day < {ANCHOR}
      QUALIFY row_number() OVER (PARTITION BY v.kpi, segment ORDER BY day DESC) <= 7)""",
    *_ALL_KPIS, _VALUES, _SPECS)
_RULES = [("percentage_drop", 10), ("percentage_spike", 10), ("absolute_drop", 1000000),
          ("absolute_spike", 1000000), ("statistical", 1.5), ("unheard_of", 1)]
add("kpi_threshold_types", f"""
SELECT kpi, segment, count(*) AS days, count(*) FILTER (status = 'alert') AS alerts,
  {rnd("max(CASE WHEN hit THEN over_by END)", 2)} AS worst_breach
FROM judged GROUP BY 1, 2""",
    *_day_kpi("daily_revenue"),
    "spec(kpi, threshold_type, t, back) AS (VALUES " + ", ".join(
        f"('{k}', '{k}', {float(t)}e0, 30)" for k, t in _RULES) + ")",
    "vals AS (SELECT spec.kpi, segment, day, value FROM daily_revenue, spec)", *_judged())
add("kpi_sql_errors", f"""
SELECT 'revenue_sql' AS kpi, CAST(sum(payment_value) AS DOUBLE) AS value, NULL AS error FROM p
UNION ALL SELECT 'orders_since', count(*), NULL FROM o WHERE day >= {ANCHOR} - 30
UNION ALL SELECT * FROM (VALUES ('no_query', NULL, 'No SQL query defined'),
  ('bad_query', NULL, 'Query execution failed'), ('no_rows', NULL,
  'No data returned from query'), ('null_value', NULL, 'Null value returned'),
  ('text_value', NULL, 'Invalid value type'))""")
add("run_summary", f"""
SELECT segment, count(*) AS total, count(*) FILTER (status = 'alert') AS alerts,
  count(*) FILTER (status = 'normal') AS normal, CAST(0 AS BIGINT) AS errors,
  count(*) FILTER (status = 'alert') * 100e0 / count(*) AS alert_rate_pct,
  CASE WHEN count(*) FILTER (status = 'alert') > 0 THEN 2 ELSE 0 END AS run_status
FROM judged WHERE {_TODAY} GROUP BY segment""", *_STATUS_CTES)
add("alert_rows", f"""
SELECT kpi, segment, priority AS alert_priority, CASE priority WHEN 'high' THEN 'danger'
  WHEN 'low' THEN 'good' ELSE 'warning' END AS colour,
  CASE WHEN chg < 0 THEN 'decreased' ELSE 'increased' END AS direction
FROM judged WHERE {_TODAY} AND status = 'alert'""", *_STATUS_CTES)
add("change_bands", f"""
SELECT kpi, segment, CASE WHEN chg IS NULL THEN 'N/A' WHEN chg < -10 THEN 'below -10'
  WHEN chg < 0 THEN 'below 0' WHEN chg > 10 THEN 'above 10' ELSE 'none' END AS band
FROM judged WHERE {_TODAY}""", *_STATUS_CTES)
add("top_kpis", f"""
SELECT kpi, segment, cur AS current_value FROM judged WHERE {_TODAY}
ORDER BY abs(cur) DESC, kpi, segment LIMIT 10""", *_STATUS_CTES)
add("board_rows", f"""
SELECT kpi AS name, segment, description, cur AS value, status,
  {rnd('coalesce(chg, 0e0)', 2)} AS change_percent,
  {rnd('coalesce(base, 0e0)', 4)} AS baseline, threshold_type, t AS threshold_value, priority
FROM judged WHERE {_TODAY}""", *_STATUS_CTES)

# --- data quality -----------------------------------------------------------------------------

_SPOILED = ["""xo AS (
  SELECT o.* REPLACE (CASE WHEN o_orderpriority <> '5-LOW' THEN order_status END
    AS order_status) FROM o JOIN orders ON o_orderkey = order_id WHERE order_status <> 'canceled'
  UNION ALL SELECT o.* FROM o JOIN orders ON o_orderkey = order_id
  WHERE o_orderpriority = '5-LOW' AND order_status = 'delivered')""",
    """xp AS (SELECT CASE WHEN l_discount < 0.09 THEN l_orderkey END AS order_id,
  l_linenumber AS payment_sequential, CASE WHEN l_quantity < 45 THEN l_returnflag END
  AS payment_type, CAST(l_extendedprice - l_quantity * 1000 AS DECIMAL(18,2))
  AS payment_value FROM lineitem)""",
    """xr AS (SELECT CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderpriority[1] AS INTEGER) * 2
  END AS review_score FROM orders)"""]
_ORPHANS = ("count(*) FROM {t} x WHERE x.order_id IS NOT NULL AND NOT EXISTS "
            "(SELECT 1 FROM {o} y WHERE y.order_id = x.order_id)")


def _audit(o: str, p: str, r: str, items: bool = True) -> str:
    rules = [
        ("Orders Primary Fields Completeness", "Completeness", "CRITICAL",
         f"count(*) FROM {o} WHERE order_id IS NULL OR customer_id IS NULL OR order_status "
         "IS NULL OR purchase_ts IS NULL"),
        ("Payment Records Completeness", "Completeness", "HIGH",
         f"count(*) FROM {p} WHERE payment_value IS NULL OR payment_type IS NULL "
         "OR order_id IS NULL"),
        ("Order ID Uniqueness", "Uniqueness", "CRITICAL",
         f"count(*) FROM (SELECT order_id FROM {o} GROUP BY 1 HAVING count(*) > 1)"),
        ("Payment Sequence Uniqueness", "Uniqueness", "HIGH",
         f"count(*) FROM (SELECT order_id, payment_sequential FROM {p} GROUP BY 1, 2 "
         "HAVING count(*) > 1)"),
        ("Payment Value Domain Validity", "Validity", "CRITICAL",
         f"count(*) FROM {p} WHERE payment_value < 0"),
        ("Chronological Delivery Logic", "Validity", "MEDIUM",
         f"count(*) FROM {o} WHERE delivered_ts < purchase_ts"),
        ("Orphan Payments Check", "Referential Integrity", "HIGH",
         _ORPHANS.format(t=p, o=o)),
    ]
    if r:
        rules.append(("Customer Review Score Bounds", "Validity", "LOW",
                      f"count(*) FROM {r} WHERE review_score NOT BETWEEN 1 AND 5"))
    if items:
        rules.append(("Orphan Line Items Check", "Referential Integrity", "HIGH",
                      _ORPHANS.format(t="it", o=o)))
    rows = " UNION ALL ".join(
        f"SELECT '{n}' AS rule_name, '{c}' AS category, '{s}' AS severity, "
        f"CAST((SELECT {q}) AS BIGINT) AS failed_count" for n, c, s, q in rules)
    return ("checks AS (SELECT *, CASE WHEN failed_count = 0 THEN 'PASS' ELSE 'FAIL' END "
            f"AS status FROM ({rows}))")


_SCORE = f"""score AS (SELECT count(*) AS total_rules,
  count(*) FILTER (status = 'PASS') AS passed_rules,
  count(*) FILTER (status = 'FAIL') AS failed_rules,
  {rnd("count(*) FILTER (status = 'PASS') * 100e0 / count(*)", 1)} AS overall_score
  FROM checks)"""
_LOG = ("rule_name, category, status, failed_count AS failed_records_count, "
        "overall_score AS score FROM checks, score")
add("dq_audit", "SELECT * FROM checks", _audit("o", "p", "rv"))
add("dq_audit_spoiled", "SELECT * FROM checks", *_SPOILED, _audit("xo", "xp", "xr"))
add("dq_orphans", "SELECT 'orphan_payments' AS rule, CAST((SELECT "
    + _ORPHANS.format(t="xp", o="xo") + ") AS BIGINT) AS failed_count", *_SPOILED)
add("dq_health", """
SELECT *, CASE WHEN overall_score >= 90 THEN 'HEALTHY' WHEN overall_score >= 70
  THEN 'DEGRADED' ELSE 'CRITICAL' END AS status,
  (SELECT count(*) FROM o) AS total_orders_audited FROM score""",
    _audit("o", "p", "rv", False), _SCORE)
add("audit_log_append", f"""
SELECT CAST({ANCHOR} - k AS TIMESTAMP) AS run_timestamp, CAST({ANCHOR} - k AS DATE) AS run_date,
  {_LOG}, (VALUES (0), (1)) t(k)""", _audit("o", "p", "rv", False), _SCORE)
add("audit_extract", f"SELECT CAST({ANCHOR} AS TIMESTAMP) AS run_timestamp, {_LOG}",
    _audit("o", "p", "rv", False), _SCORE)
add("dq_integrity_score", "SELECT overall_score AS dq_integrity_score_pct FROM score",
    _audit("o", "p", "rv", False), _SCORE)

# --- series -----------------------------------------------------------------------------------


def _rollup(lookback: int | None) -> str:
    limit = "" if lookback is None else f"WHERE day >= {ANCHOR} - {lookback}"
    us = f"CASE WHEN order_status = 'delivered' THEN {micros()} END"
    return f"""roll AS (SELECT segment, day, count(DISTINCT so.order_id) AS order_volume,
  coalesce(sum(payment_value), 0) AS revenue,
  coalesce({mean('payment_value')}, 0e0) AS avg_payment,
  coalesce({dbl(f'sum({us})')} / 864e8 / nullif(count({us}), 0), 0e0) AS delivery_days
  FROM so LEFT JOIN p ON p.order_id = so.order_id {limit} GROUP BY 1, 2)"""


_SERIES = "ser AS (" + " UNION ALL ".join(
    f"SELECT segment, day, '{m}' AS metric, {val(c)} AS value FROM roll" for m, c in (
        ("revenue", "revenue"), ("volume", "order_volume"), ("aov", "avg_payment"),
        ("delivery", "delivery_days"))) + ")"
_Q = "quantile_cont(CAST(value * 100 AS DOUBLE), {})"
_STATS = f"""raw AS (SELECT segment, metric, {mean('value')} AS m,
  stddev_pop(CAST(value AS DOUBLE)) AS s, {_Q.format('0.25')} AS q1, {_Q.format('0.5')} AS q2,
  {_Q.format('0.75')} AS q3 FROM ser GROUP BY 1, 2),
stats AS (SELECT segment, metric, {rnd('m', 2)} AS mean, {settle('s', 2)} AS std,
  floor(q2 + 5e-1) / 100e0 AS median, floor(q3 - q1 + 5e-1) / 100e0 AS iqr,
  {settle('m + 2e0 * s', 2)} AS upper_bound_2sigma,
  {settle('greatest(0e0, m - 2e0 * s)', 2)} AS lower_bound_2sigma,
  floor(q3 + 1.5e0 * (q3 - q1) + 5e-1) / 100e0 AS iqr_upper_outlier,
  floor(greatest(0e0, q1 - 1.5e0 * (q3 - q1)) + 5e-1) / 100e0 AS iqr_lower_outlier FROM raw)"""
_S60 = [_rollup(60), _SERIES]
add("daily_rollup", """
SELECT segment, day, order_volume, CAST(revenue AS DOUBLE) AS revenue, avg_payment,
  delivery_days FROM roll""", _rollup(None))
add("series_dense", f"""
SELECT k.segment, k.metric, k.day, CAST(coalesce(value, 0) AS DOUBLE) AS value
FROM (SELECT DISTINCT segment, metric, CAST(unnest(generate_series({ANCHOR} - 60, {ANCHOR},
  INTERVAL 1 DAY)) AS DATE) AS day FROM ser) k LEFT JOIN ser USING (segment, metric, day)""",
    *_S60)
add("series_stats", "SELECT * FROM stats", *_S60, _STATS)
add("series_stats_or_empty", """
SELECT segs.segment, 'revenue' AS metric, """ + ", ".join(
    f"coalesce({c}, 0e0) AS {c}" for c in (
        "mean", "std", "median", "iqr", "upper_bound_2sigma", "lower_bound_2sigma",
        "iqr_upper_outlier", "iqr_lower_outlier")) + """,
  CASE WHEN mean IS NULL THEN
  'No days to take statistics from' END AS error
FROM segs LEFT JOIN stats ON stats.segment = segs.segment AND metric = 'revenue'""",
    _rollup(1), _SERIES, _STATS)
_ANOMALIES = f"""
SELECT segment, CASE metric WHEN 'revenue' THEN 'Daily Revenue' WHEN 'volume' THEN
  'Order Volume' ELSE 'Average Delivery Time' END AS metric,
  CASE metric WHEN 'revenue' THEN {rnd('cur', 2)} WHEN 'volume' THEN cur
    ELSE {rnd('cur', 1)} END AS current_value,
  CASE metric WHEN 'revenue' THEN mean ELSE {rnd('mean', 1)} END AS expected_mean,
  {rnd('z', 2)} AS z_score,
  CASE WHEN metric = 'revenue' AND z < -2.5 THEN 'CRITICAL'
    WHEN metric = 'revenue' AND z >= -2 THEN 'MEDIUM' ELSE 'HIGH' END AS severity,
  CASE WHEN metric = 'revenue' AND z < 0 THEN 'REVENUE_LOW'
    WHEN metric = 'revenue' THEN 'REVENUE_HIGH' WHEN metric = 'volume' THEN
    'VOLUME_LOW' ELSE 'DELIVERY_SLOW' END AS type,
  CASE metric WHEN 'revenue' THEN 'Revenue of the day, $' || format('{{:,.2f}}', {rnd('cur', 2)})
    || ', lies ' || printf('%+.1f', {rnd('z', 1)})
    || ' standard deviations off its usual mean.'
  WHEN 'volume' THEN printf('Only %d orders came, %.1f are usual.',
    CAST(cur AS BIGINT), {rnd('mean', 1)})
  ELSE printf('Deliveries took %.1f days, %.1f are usual.', {rnd('cur', 1)},
    {rnd('mean', 1)}) END AS description
FROM scored WHERE (metric = 'revenue' AND abs(z) >= 2) OR (metric = 'volume' AND z <= -2)
  OR (metric = 'delivery' AND z >= 2)"""
_SCORED = """scored AS (SELECT *, CASE WHEN std > 0 THEN (cur - mean) / std END AS z
  FROM (SELECT segment, metric, CAST(arg_max(value, day) AS DOUBLE) AS cur FROM ser
        GROUP BY 1, 2) JOIN stats USING (segment, metric))"""
add("series_anomalies", _ANOMALIES, *_S60, _STATS, _SCORED)
# The same per anchor: a segment's name carries the anchor until the end.
add("series_anomalies_backtest", f"""
SELECT * REPLACE (substr(segment, 12) AS segment), CAST(substr(segment, 1, 10) AS DATE) AS anchor
FROM ({_ANOMALIES})""", _rollup(3 * 242 + 60), _SERIES.replace("ser AS", "known AS", 1),
    f"""ser AS (SELECT strftime(a.day, '%Y-%m-%d') || ' ' || k.segment AS segment, k.day,
  k.metric, k.value FROM known k JOIN (SELECT {ANCHOR} - CAST(3 * range AS INTEGER) AS day
    FROM range(243)) a ON k.day <= a.day AND k.day >= a.day - 60)""", _STATS, _SCORED)
add("series_timeline", f"""
SELECT segment, metric, CAST(row_number() OVER (PARTITION BY segment, metric ORDER BY day) - 1
  AS INTEGER) AS position, day, CASE WHEN metric = 'delivery'
  THEN {rnd('CAST(value AS DOUBLE)', 1)} ELSE {rnd('CAST(value AS DOUBLE)', 2)} END AS value
FROM (FROM ser QUALIFY row_number() OVER
      (PARTITION BY segment, metric ORDER BY day DESC) <= 14)""", *_S60)
add("series_outliers", """
SELECT segment, metric, day, CAST(value AS DOUBLE) AS value,
  CAST(value AS DOUBLE) > iqr_upper_outlier OR CAST(value AS DOUBLE) < iqr_lower_outlier
  AS is_outlier FROM ser JOIN stats USING (segment, metric)""", *_S60, _STATS)


def _sma(days: int) -> str:
    w = (f"OVER (PARTITION BY segment, metric ORDER BY day RANGE BETWEEN INTERVAL {days - 1} "
         "DAY PRECEDING AND CURRENT ROW)")
    return f"CAST(sum(value) {w} AS DOUBLE) / count(*) {w}"


add("moving_average_cross", f"""
SELECT segment, metric, day, {rnd('a', 4)} AS sma_short, {rnd('b', 4)} AS sma_long,
  CASE WHEN a > b THEN 'UP' ELSE 'DOWN' END AS cross
FROM (SELECT *, lag(a > b) OVER (PARTITION BY segment, metric ORDER BY day) AS was
      FROM (SELECT segment, metric, day, {_sma(7)} AS a, {_sma(30)} AS b FROM ser
            WHERE metric IN ('revenue', 'volume'))) WHERE (a > b) <> was""",
    _rollup(None), _SERIES)

# --- views and measures -----------------------------------------------------------------------

_FACT = f"""fact AS (SELECT o.order_id, o.customer_id, customer_city, customer_state,
  order_status, purchase_ts, day AS order_date, strftime(purchase_ts, '%Y-%m')
  AS order_year_month, strftime(purchase_ts, '%H') AS order_hour, delivered_ts, estimated_ts,
  {rnd(micros() + ' / 864e8', 1)} AS delivery_days,
  CASE WHEN delivered_ts <= estimated_ts THEN 1 WHEN delivered_ts > estimated_ts THEN 0 END
  AS is_on_time, coalesce(paid, 0) AS order_revenue,
  coalesce(payment_type, 'unspecified') AS payment_method,
  coalesce(score, 0e0) AS csat_review_score, score AS csat_score_known
  FROM o LEFT JOIN c ON c.customer_id = o.customer_id
  LEFT JOIN (SELECT order_id, sum(payment_value) AS paid, max(payment_type) AS payment_type
             FROM p GROUP BY 1) x ON x.order_id = o.order_id
  LEFT JOIN (SELECT order_id, avg(review_score) AS score FROM rv GROUP BY 1) y
    ON y.order_id = o.order_id)"""
_FACT_ROW = "SELECT * REPLACE (CAST(order_revenue AS DOUBLE) AS order_revenue) FROM fact"
_DAILY = f"""daily AS (SELECT day AS report_date, count(DISTINCT o.order_id) AS total_orders,
  count(DISTINCT CASE WHEN order_status = 'delivered' THEN o.order_id END) AS delivered_orders,
  CAST(sum(payment_value) AS DOUBLE) AS daily_revenue,
  {cents('payment_value')} AS average_order_value,
  {rnd(dbl(f'sum({micros()})') + ' / 864e8 / nullif(count(delivered_ts), 0)', 1)}
  AS avg_delivery_time_days,
  {rnd('count(CASE WHEN delivered_ts <= estimated_ts THEN 1 END) * 100e0'
       ' / nullif(count(delivered_ts), 0)', 1)} AS on_time_delivery_rate_pct
  FROM o LEFT JOIN p USING (order_id) GROUP BY day)"""
add("order_fact", _FACT_ROW, _FACT)
add("recent_orders", f"{_FACT_ROW} WHERE order_date >= {ANCHOR} - 90", _FACT)
add("daily_summary", "SELECT * FROM daily", _DAILY)
add("daily_extract", "SELECT * FROM daily", _DAILY)
add("daily_summary_refreshed", "SELECT * FROM daily", _DAILY)
add("order_fact_refreshed", _FACT_ROW, _FACT)
add("change_by_buckets", """
SELECT c_custkey, CASE WHEN c_custkey % 40 = 8 THEN 'renamed' ELSE c_name END AS c_name, c_acctbal
FROM customer WHERE c_custkey % 40 <> 9 AND NOT c_acctbal < -900""")
_REGION = f"""region_rows AS (SELECT customer_state, customer_city,
  count(DISTINCT o.order_id) AS total_orders,
  CAST(sum(payment_value) AS DOUBLE) AS state_revenue, {cents('payment_value')} AS state_aov,
  {rnd(mean('review_score'), 2)} AS avg_csat
  FROM c JOIN o USING (customer_id) LEFT JOIN p ON p.order_id = o.order_id
  LEFT JOIN rv ON rv.order_id = o.order_id WHERE day >= {ANCHOR} - 90
  GROUP BY 1, 2 HAVING count(DISTINCT o.order_id) >= 3)"""
add("regional_summary", "SELECT * FROM region_rows", _REGION)
add("regional_summary_order_grain", f"""
SELECT customer_state, customer_city, count(*) AS total_orders,
  CAST(sum(paid) AS DOUBLE) AS state_revenue,
  floor(CAST(sum(paid) * 100 AS DOUBLE) / nullif(sum(n), 0) + 5e-1) / 100e0 AS state_aov,
  {rnd('CAST(sum(score) AS DOUBLE) / nullif(sum(k), 0)', 2)} AS avg_csat
FROM c JOIN o USING (customer_id)
LEFT JOIN (SELECT order_id, sum(payment_value) AS paid, count(payment_value) AS n FROM p
           GROUP BY 1) x ON x.order_id = o.order_id
LEFT JOIN (SELECT order_id, sum(review_score) AS score, count(*) AS k FROM rv GROUP BY 1) y
  ON y.order_id = o.order_id
WHERE day >= {ANCHOR} - 90 GROUP BY 1, 2 HAVING count(*) >= 3""")
add("export_manifest", f"""
SELECT 'orders' AS extract, count(*) AS rows FROM o WHERE day >= {ANCHOR} - 90
UNION ALL SELECT 'daily_kpis', count(*) FROM daily
UNION ALL SELECT 'data_quality', count(*) FROM checks
UNION ALL SELECT 'regional', count(*) FROM region_rows""",
    _DAILY, _REGION, _audit("o", "p", "rv", False))


def _distinct(test: str) -> str:
    return f"count(DISTINCT CASE WHEN {test} THEN order_id END)"


_MEASURES = f"""CAST(sum(order_revenue) AS DOUBLE) AS total_revenue,
  count(DISTINCT order_id) AS total_orders,
  {_distinct("order_status = 'delivered'")} AS delivered_orders,
  {_distinct('is_on_time = 1')} AS on_time_orders,
  {_distinct('is_on_time = 0')} AS sla_breaches,
  {_distinct('csat_review_score = 5')} AS promoters,
  {_distinct('csat_review_score IN (1, 2)')} AS detractors,
  CAST(sum(CAST(delivery_days AS DECIMAL(20,1))) AS DOUBLE) / nullif(count(delivery_days), 0)
  AS avg_delivery_days,
  CAST(sum(CAST(csat_review_score AS DECIMAL(20,6))) AS DOUBLE) / count(*) AS avg_csat"""
_DERIVED = """*, total_revenue / total_orders AS aov,
  coalesce(on_time_orders * 100e0 / nullif(delivered_orders, 0), 0e0) AS on_time_rate_pct,
  (promoters - detractors) * 100e0 / total_orders AS net_csat_pct"""
add("measures_total", f"SELECT {_DERIVED} FROM (SELECT {_MEASURES} FROM fact)", _FACT)
add("measures_by_city", f"""SELECT {_DERIVED} FROM (SELECT customer_state, customer_city,
  {_MEASURES} FROM fact GROUP BY 1, 2)""", _FACT)


def _fortnight(f: str) -> str:
    return (f"{f} OVER (ORDER BY order_date RANGE BETWEEN INTERVAL 13 DAY PRECEDING "
            "AND CURRENT ROW)")


add("measures_daily", f"""
SELECT * EXCLUDE (prior_day, s), {settle('s', 4)} AS rolling_std_14d,
  {settle('rolling_mean_14d + 2e0 * s', 4)} AS ucl,
  {settle('greatest(0e0, rolling_mean_14d - 2e0 * s)', 4)} AS lcl,
  CASE WHEN dod_growth_pct < -15 OR on_time_rate_pct < 85 THEN 'CRITICAL ALERT'
       ELSE 'HEALTHY' END AS anomaly
FROM (SELECT *, CASE WHEN prior_day IS NULL OR prior_day = 0 THEN 0e0
        ELSE (total_revenue - prior_day) / prior_day * 100e0 END AS dod_growth_pct
  FROM (SELECT m.*, w.total_revenue AS prior_period_revenue, y.total_revenue AS prior_day,
          CAST({_fortnight('sum(CAST(m.total_revenue AS DECIMAL(28,2)))').replace('order_date', 'm.order_date')} AS DOUBLE)
          / {_fortnight('count(*)').replace('order_date', 'm.order_date')} AS rolling_mean_14d,
          {_fortnight('stddev_pop(m.total_revenue)').replace('order_date', 'm.order_date')} AS s
        FROM md m LEFT JOIN md w ON w.order_date = m.order_date - 7
        LEFT JOIN md y ON y.order_date = m.order_date - 1))""",
    _FACT, f"md AS (SELECT {_DERIVED} FROM (SELECT order_date, {_MEASURES} FROM fact "
           "GROUP BY 1))")
add("daily_average_revenue", """
SELECT CAST(sum(r) AS DOUBLE) / count(*) AS daily_average_revenue
FROM (SELECT order_date, sum(order_revenue) AS r FROM fact GROUP BY 1)""", _FACT)

# --- drivers ------------------------------------------------------------------------------------


def _win(x: str, recent: bool) -> str:
    test = f"day >= {ANCHOR} - 7" if recent else f"day < {ANCHOR} - 7"
    return f"CASE WHEN {test} THEN {x} END"


_SHIFT = f"""shift AS (SELECT customer_state,
  count(DISTINCT {_win('o.order_id', True)}) AS orders_recent,
  count(DISTINCT {_win('o.order_id', False)}) AS orders_prior,
  coalesce(sum({_win('payment_value', True)}), 0) AS rev_recent,
  coalesce(sum({_win('payment_value', False)}), 0) AS rev_prior
  FROM o JOIN c USING (customer_id) LEFT JOIN p ON p.order_id = o.order_id
  WHERE day >= {ANCHOR} - 14 GROUP BY 1)"""
_LEADERS = "(FROM shift ORDER BY rev_recent DESC, customer_state LIMIT 8)"


def _driver(pool: str) -> str:
    return f"""driver AS (SELECT coalesce(max(customer_state), 'No state lost revenue')
  AS top_variance_driver, max(drop_by) AS max_drop FROM (
  SELECT customer_state, rev_prior - rev_recent AS drop_by FROM {pool}
  WHERE rev_prior > rev_recent ORDER BY drop_by DESC, customer_state LIMIT 1))"""


_PAYDIAG = f"""paydiag AS (SELECT payment_type, count(DISTINCT o.order_id) AS total_attempts,
  count(DISTINCT CASE WHEN order_status = 'canceled' THEN o.order_id END) AS canceled_count,
  CAST(sum(payment_value) AS DOUBLE) AS total_volume,
  {rnd("count(DISTINCT CASE WHEN order_status = 'canceled' THEN o.order_id END) * 100e0"
       " / count(DISTINCT o.order_id)", 1)} AS cancellation_rate_pct
  FROM p JOIN o USING (order_id) WHERE day >= {ANCHOR} - 14 GROUP BY 1)"""


def _logistics(days: int) -> str:
    return f"""slow AS (SELECT customer_state, {rnd(mean_days(micros()), 1)}
  AS avg_delivery_days, count(CASE WHEN delivered_ts > estimated_ts THEN 1 END)
  AS late_deliveries, count(*) AS total_delivered FROM o JOIN c USING (customer_id)
  WHERE delivered_ts IS NOT NULL AND day >= {ANCHOR} - {days} GROUP BY 1 HAVING count(*) >= 5
  ORDER BY avg_delivery_days DESC, customer_state LIMIT 5)"""


add("regional_breakdown", f"""
SELECT customer_state, orders_recent, orders_prior, CAST(rev_recent AS DOUBLE) AS rev_recent,
  CAST(rev_prior AS DOUBLE) AS rev_prior FROM {_LEADERS}""", _SHIFT)
add("category_performance", f"""
SELECT coalesce(category_english, pr.category, 'Other') AS category,
  count(DISTINCT it.order_id) AS items_sold, CAST(sum(price) AS DOUBLE) AS category_revenue
FROM it JOIN o USING (order_id) LEFT JOIN pr USING (product_id)
LEFT JOIN tr ON tr.category = pr.category WHERE day >= {ANCHOR} - 14
GROUP BY 1 ORDER BY category_revenue DESC, 1 LIMIT 6""")
add("payment_diagnostics", "SELECT * FROM paydiag", _PAYDIAG)
add("logistics_delays", "SELECT * FROM slow", _logistics(30))
_DRIVER_ROW = ("SELECT top_variance_driver, CAST(max_drop AS DOUBLE) AS max_drop FROM driver")
add("top_driver", _DRIVER_ROW, _SHIFT, _driver("shift"))
add("top_driver_of_leaders", _DRIVER_ROW, _SHIFT, _driver(_LEADERS))
add("recommendations", """
SELECT 1 AS position, 'Region: ''' || top_variance_driver || ''' lost more revenue between the two '
  || 'periods than any other state (-$' || format('{:,.2f}', CAST(max_drop AS DOUBLE))
  || '). Look into its campaigns and its stock.' AS advice
FROM driver WHERE max_drop IS NOT NULL
UNION ALL SELECT 2, CASE WHEN max(cancellation_rate_pct) > 10 THEN
  'Payments: ' || printf('%.1f', max(cancellation_rate_pct))
  || '% of the credit card orders were canceled. Ask the card processor for failures.' ELSE
  'Payments: no method stands out by its cancellations.' END FROM paydiag WHERE payment_type = 'credit_card'
UNION ALL SELECT 3, 'Logistics: deliveries to ''' || customer_state || ''' took '
  || printf('%.1f', avg_delivery_days) || ' days on average, ' || late_deliveries
  || ' of them late. Try another carrier there.'
FROM (FROM slow ORDER BY avg_delivery_days DESC, customer_state LIMIT 1)
WHERE avg_delivery_days > 8""", _SHIFT, _driver("shift"), _PAYDIAG, _logistics(90))
add("driver_ranking", f"""
SELECT dimension, member, CAST(recent AS DOUBLE) AS recent, CAST(prior AS DOUBLE) AS prior,
  CAST(recent - prior AS DOUBLE) AS delta,
  CAST(row_number() OVER (PARTITION BY dimension ORDER BY recent - prior, member) AS INTEGER)
  AS rank, CAST(recent - prior AS DOUBLE) / nullif(CAST(sum(recent - prior) OVER
  (PARTITION BY dimension) AS DOUBLE), 0) AS share
FROM (SELECT dimension, coalesce(member, 'unknown') AS member,
    coalesce(sum({_win('paid', True)}), 0) AS recent,
    coalesce(sum({_win('paid', False)}), 0) AS prior
  FROM (SELECT day, paid, unnest(['customer_state', 'customer_city', 'order_status',
          'payment_type']) AS dimension,
          unnest([customer_state, customer_city, order_status, payment_type]) AS member
        FROM o JOIN c USING (customer_id) LEFT JOIN (SELECT order_id,
          sum(payment_value) AS paid, max(payment_type) AS payment_type FROM p GROUP BY 1) x
          ON x.order_id = o.order_id WHERE day >= {ANCHOR} - 14) GROUP BY 1, 2)""")
_DIMS = ["customer_state", "customer_city", "order_status", "payment_type"]
_SETS = [c for k in (1, 2, 3) for c in combinations(_DIMS, k)]
_LABEL = "concat_ws(', ', " + ", ".join(
    f"CASE WHEN grouping({d}) = 0 THEN '{d}=' || {d} END" for d in _DIMS) + ")"
add("driver_combinations", f"""
SELECT combination, n_dimensions, CAST(recent AS DOUBLE) AS recent,
  CAST(prior AS DOUBLE) AS prior, CAST(recent - prior AS DOUBLE) AS delta,
  CAST(row_number() OVER (ORDER BY recent - prior, combination) AS INTEGER) AS rank
FROM (SELECT {_LABEL} AS combination,
    CAST({' + '.join(f'1 - grouping({d})' for d in _DIMS)} AS INTEGER) AS n_dimensions,
    coalesce(sum({_win('paid', True)}), 0) AS recent,
    coalesce(sum({_win('paid', False)}), 0) AS prior
  FROM (SELECT day, paid, {', '.join(f"coalesce({d}, 'unknown') AS {d}" for d in _DIMS)}
        FROM o JOIN c USING (customer_id) LEFT JOIN (SELECT order_id,
          sum(payment_value) AS paid, max(payment_type) AS payment_type FROM p GROUP BY 1) x
          ON x.order_id = o.order_id WHERE day >= {ANCHOR} - 14)
  GROUP BY GROUPING SETS ({', '.join('(' + ', '.join(c) + ')' for c in _SETS)}))
QUALIFY rank <= 20""")
add("geography_rollup", """
SELECT customer_state, customer_city, CAST(sum(payment_value) AS DOUBLE) AS paid
FROM o JOIN c USING (customer_id) LEFT JOIN p ON p.order_id = o.order_id
GROUP BY ROLLUP (customer_state, customer_city)""")

# --- forecast and scenarios ----------------------------------------------------------------------

_LEVEL = "(3e-1 * pts.y + 7e-1 * (h.level + h.trend))"


def _fit(lookback: int) -> list[str]:
    return [
        _rollup(lookback), _SERIES,
        """pts AS (SELECT segment, metric, day, value, CAST(value AS DOUBLE) AS y,
  row_number() OVER (PARTITION BY segment, metric ORDER BY day) AS i,
  row_number() OVER (PARTITION BY segment, metric ORDER BY day DESC) AS age,
  value - lag(value) OVER (PARTITION BY segment, metric ORDER BY day) AS diff
  FROM ser WHERE metric IN ('revenue', 'volume'))""",
        f"""h AS (SELECT a.segment, a.metric, CAST(1 AS BIGINT) AS i, a.y AS level,
    coalesce(b.y - a.y, 0e0) AS trend FROM pts a LEFT JOIN pts b
    ON b.segment = a.segment AND b.metric = a.metric AND b.i = 2 WHERE a.i = 1
  UNION ALL SELECT h.segment, h.metric, h.i + 1, {_LEVEL},
    1e-1 * ({_LEVEL} - h.level) + 9e-1 * h.trend
  FROM h JOIN pts ON pts.segment = h.segment AND pts.metric = h.metric AND pts.i = h.i + 1)""",
        f"""fits AS (SELECT * FROM (SELECT segment, metric, max(day) AS last_day,
    count(*) AS points, coalesce(stddev_pop(CAST(diff AS DOUBLE)), 1e0) AS std_err,
    CAST(sum(value) FILTER (age <= 7) AS DOUBLE) / count(*) FILTER (age <= 7) AS recent_mean
    FROM pts GROUP BY 1, 2) JOIN h USING (segment, metric) WHERE i = points)"""]


add("holt_fit", f"""SELECT segment, metric, level, trend, {settle('std_err', 4)} AS std_err,
  recent_mean, last_day, points FROM fits""", *_fit(45))
_F = "(level + k * trend)"
_MARGIN = "1.96e0 * std_err * sqrt(CAST(k AS DOUBLE))"
add("forecast_bands", f"""
SELECT segment, metric, last_day + k AS day, k AS h,
  CASE WHEN metric = 'volume' THEN round_even(greatest(0e0, {_F}), 0)
       ELSE {rnd(f'greatest(0e0, {_F})', 2)} END AS forecast,
  {rnd(f'greatest(0e0, {_F} + {_MARGIN})', 2)} AS upper_95,
  {rnd(f'greatest(0e0, {_F} - {_MARGIN})', 2)} AS lower_95
FROM fits, (SELECT CAST(unnest(range(1, 15)) AS INTEGER) AS k) WHERE points >= 7""", *_fit(45))
_ERR = "pts.y - (h.level + k * h.trend)"
_Q = {n: f"quantile_cont(err, {p}e0)" for n, p in (
    ("l95", 0.025), ("l80", 0.1), ("u80", 0.9), ("u95", 0.975))}
add("forecast_intervals", f"""
SELECT segment, metric, last_day + k AS day, k AS h, {rnd(f'greatest(0e0, {_F})', 2)} AS forecast,
  {', '.join(f"CASE WHEN n > 0 THEN {rnd(f'greatest(0e0, {_F} + {c})', 2)} END AS {name}"
             for c, name in (('l80', 'lower_80'), ('u80', 'upper_80'), ('l95', 'lower_95'),
                             ('u95', 'upper_95')))},
  coalesce(n, 0) AS origins
FROM fits CROSS JOIN ks LEFT JOIN errs USING (segment, metric, k) WHERE points >= 7""", *_fit(45),
    "ks AS (SELECT CAST(unnest(range(1, 11)) AS INTEGER) AS k)",
    f"""errs AS (SELECT segment, metric, k, count(*) AS n,
  {', '.join(f'{q} AS {n}' for n, q in _Q.items())}
  FROM (SELECT h.segment, h.metric, k, {_ERR} AS err FROM h, ks, pts
        WHERE pts.segment = h.segment AND pts.metric = h.metric AND pts.i = h.i + k AND h.i >= 7)
  GROUP BY 1, 2, 3)""")
add("forecast_too_short", """
SELECT segment, metric, points, 'Fewer than 7 points: no forecast'
  AS error FROM fits WHERE points < 7""", *_fit(10))
add("trend_direction", f"""
SELECT segment, metric, {rnd('trend', 2)} AS trend_slope,
  CASE WHEN trend > lim THEN 'UPWARD' WHEN trend < -lim THEN 'DOWNWARD' ELSE 'FLAT' END
  AS trend_direction
FROM (SELECT *, CASE metric WHEN 'volume' THEN 1 ELSE 5 END AS lim FROM fits)
WHERE points >= 7""", *_fit(45))
_SUM7 = " + ".join(f"greatest(0e0, level + {k} * trend)" for k in range(1, 8))
add("early_warnings", f"""
SELECT segment, metric, CASE WHEN pct > 15 THEN 'POSITIVE_SURGE' WHEN pct > -20 THEN 'WARNING'
  ELSE 'CRITICAL' END AS severity, {rnd('pct', 1)} AS projected_change_pct,
  CASE WHEN pct > 15 THEN printf('Revenue is forecast to grow by %.1f%% over 7 days.',
    {rnd('pct', 1)})
  ELSE printf('Revenue is forecast to shrink by %.1f%% over 7 days.',
    {rnd('abs(pct)', 1)}) END AS message
FROM (SELECT *, (({_SUM7}) / 7e0 - recent_mean) / greatest(1e0, recent_mean) * 100e0 AS pct
      FROM fits WHERE metric = 'revenue' AND points >= 7)
WHERE pct < -10 OR pct > 15""", *_fit(45))
add("scenario_grid", f"""
SELECT segment, price_change_pct, churn_change_pct, delivery_delay_days, base_orders,
  {rnd('base_revenue', 2)} AS base_revenue, {rnd('base_aov', 2)} AS base_aov,
  volume_change_pct, sim_orders, {rnd('sim_orders * aov', 2)} AS sim_revenue,
  {rnd('aov', 2)} AS sim_aov, {rnd('diff', 2)} AS revenue_delta,
  {rnd('pct', 1)} AS revenue_delta_pct, sim_orders - base_orders AS orders_delta,
  'Net Revenue Impact: ' || CASE WHEN diff >= 0 THEN '+$' ELSE '-$' END
  || format('{{:,.2f}}', {rnd('abs(diff)', 2)}) || ' (' || CASE WHEN diff >= 0 THEN '+' ELSE ''
  END || printf('%.1f', {rnd('pct', 1)}) || '%). ' || CASE WHEN diff > 0 THEN
  'Favorable margin expansion' ELSE 'Adverse revenue pressure from demand degradation' END
  || '.' AS assessment
FROM (SELECT *, diff / greatest(1e0, base_revenue) * 100e0 AS pct FROM
  (SELECT *, sim_orders * aov - base_revenue AS diff FROM
    (SELECT *, greatest(0e0, round_even(base_orders * (1 + volume_change_pct / 100e0), 0))
       AS sim_orders, base_aov * (1 + price_change_pct / 100e0) AS aov FROM
      (SELECT *, price_change_pct * -1.25e0 + -(churn_change_pct * 0.45e0)
         + -(delivery_delay_days * 1.8e0) AS volume_change_pct FROM base, grid))))""",
    f"""base AS (SELECT segment,
  coalesce(nullif(CAST(count(DISTINCT so.order_id) AS DOUBLE), 0), 100e0) AS base_orders,
  coalesce(nullif(CAST(sum(payment_value) AS DOUBLE), 0), 10000e0) AS base_revenue,
  coalesce(nullif({mean('payment_value')}, 0), 100e0) AS base_aov
  FROM so LEFT JOIN p ON p.order_id = so.order_id WHERE day >= {ANCHOR} - 30 GROUP BY 1)""",
    """grid AS (SELECT * FROM (VALUES (-10e0), (0e0), (5e0)) a(price_change_pct),
  (VALUES (0e0), (3e0)) b(churn_change_pct), (VALUES (0e0), (2e0)) d(delivery_delay_days))""")

# --- incidents and streams ------------------------------------------------------------------------

_FOLD = ["""log AS (SELECT 'user_' || user_id AS kpi_name, ts, event_id AS seq,
  CASE event_type WHEN 'error' THEN 'alert' WHEN 'signup' THEN 'ack'
       WHEN 'purchase' THEN 'resolve' END AS kind,
  CASE WHEN value > 100 THEN 'HIGH' ELSE 'LOW' END AS severity, value, props
  FROM events WHERE event_type IN ('error', 'signup', 'purchase'))""",
    """numbered AS (SELECT *, coalesce(sum(CASE WHEN kind = 'resolve' THEN 1 ELSE 0 END) OVER (
  PARTITION BY kpi_name ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  AS no FROM log)""",
    """opened AS (SELECT kpi_name, no, min(ts) AS opened_at FROM numbered WHERE kind = 'alert'
  GROUP BY 1, 2)""",
    """inc AS (SELECT opened_at AS created_at, kpi_name,
  arg_max(severity, ts) FILTER (kind = 'alert') AS severity,
  CASE WHEN count(*) FILTER (kind = 'resolve') > 0 THEN 'RESOLVED'
       WHEN count(*) FILTER (kind = 'ack' AND ts > opened_at) > 0 THEN 'ACKNOWLEDGED'
       ELSE 'OPEN' END AS status,
  arg_max(value, ts) FILTER (kind = 'alert') AS trigger_value, 100e0 AS threshold_value,
  arg_max(props, ts) FILTER (kind = 'alert') AS description,
  CASE WHEN count(*) FILTER (kind = 'ack' AND ts > opened_at) > 0 THEN kpi_name END
  AS acknowledged_by, max(ts) FILTER (kind = 'ack' AND ts > opened_at) AS acknowledged_at,
  'event ' || max(seq) FILTER (kind = 'resolve') AS resolution_notes,
  max(ts) FILTER (kind = 'resolve') AS resolved_at
  FROM numbered JOIN opened USING (kpi_name, no) GROUP BY kpi_name, no, opened_at)"""]
add("incident_fold", "SELECT * FROM inc", *_FOLD)
add("stream_incidents", "SELECT * FROM inc", *_FOLD)
add("incidents_newest", """
SELECT created_at, kpi_name, severity, status, trigger_value FROM inc
ORDER BY created_at DESC, kpi_name LIMIT 20""", *_FOLD)
add("incidents_from_alerts", """
SELECT kpi || '/' || segment AS kpi_name, CAST(min(day) AS TIMESTAMP) AS created_at,
  'OPEN' AS status, upper(any_value(priority)) AS severity,
  arg_max(cur, day) AS trigger_value, any_value(t) AS threshold_value
FROM judged WHERE status = 'alert' AND segment = 'ALL' GROUP BY kpi, segment""",
    *_STATUS_CTES)
add("stream_upsert", """
SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id
  ORDER BY ts DESC, event_id DESC) = 1""")
_EVENT_DAYS = """
SELECT date_trunc('day', ts) AS day_start, event_type, count(*) AS n_events,
  CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2"""
add("stream_daily_metrics", _EVENT_DAYS)
_PASSED = "(SELECT max(ts) FROM events) - INTERVAL 1 HOUR"
add("stream_daily_metrics_closed",
    f"{_EVENT_DAYS} HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= {_PASSED}")
add("stream_daily_users", f"""
SELECT date_trunc('day', ts) AS day_start, count(DISTINCT user_id) AS users FROM events
GROUP BY 1 HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= {_PASSED}""")
add("stream_weekly_users", """
SELECT CAST(date_trunc('week', ts) AS DATE) AS week, count(DISTINCT user_id) AS exact_users,
  true AS within_3_percent FROM events GROUP BY 1""")
add("quantiles_of_ranges", """
SELECT event_type AS segment, days, count(value) AS n, true AS ranks_within_2_percent
FROM events, (VALUES (10), (365)) d(days)
WHERE CAST(ts AS DATE) < (SELECT CAST(min(ts) AS DATE) FROM events) + days GROUP BY 1, 2""")
add("stream_deduped", """
SELECT event_id, 1 + CASE WHEN event_id % 11 = 0 AND date_diff('day',
    (SELECT date_trunc('day', min(ts)) FROM events), ts) < 12 THEN 1 ELSE 0 END AS kept
FROM events""")
add("stream_control_bands", f"""
SELECT window_start, window_start + INTERVAL 7 DAY AS window_end, event_type, n,
  {rnd('mean', 4)} AS mean, {rnd('std', 4)} AS std, {rnd('mean + 2e0 * std', 4)} AS ucl,
  {rnd('greatest(0e0, mean - 2e0 * std)', 4)} AS lcl
FROM (SELECT date_trunc('day', ts) - to_days(CAST(k AS INTEGER)) AS window_start, event_type,
        count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std
      FROM events, range(0, 7) t(k) GROUP BY 1, 2)""")
add("stream_audit", "SELECT rule_name, category, severity, failed_count FROM checks",
    """eo AS (SELECT event_id AS order_id, user_id AS customer_id, 'delivered' AS order_status,
  ts AS purchase_ts, CAST(NULL AS TIMESTAMP) AS delivered_ts FROM events
  WHERE event_type = 'purchase')""",
    """ep AS (SELECT event_id AS order_id, 1 AS payment_sequential, event_type AS payment_type,
  value AS payment_value FROM events WHERE event_type IN ('purchase', 'error'))""",
    _audit("eo", "ep", "", False))
add("stream_sessions", f"""
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end,
  count(*) AS n_events
FROM (SELECT *, sum(CASE WHEN ts >= prev + INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER
        (PARTITION BY user_id ORDER BY ts, event_id) AS s
      FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev
            FROM events))
GROUP BY user_id, s HAVING max(ts) + INTERVAL 30 MINUTE <= {_PASSED}""")
add("stream_counters", """
SELECT count(*) AS orders, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
  max(ts) AS last_event_at FROM events WHERE event_type = 'purchase'""")
