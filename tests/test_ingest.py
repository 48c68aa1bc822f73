from datetime import date, datetime

import pytest
from pyspark.sql import functions as F, types as T

from tidemark.operators import tablechange as tc
from tidemark.schemas import TABLES
from tidemark.sources import csvtables, databases, feed
from tidemark.sources.starschema import StarSchema, write_parquet

ASOF = date(2024, 6, 30)


def test_csv_load(spark, tmp_path):
    (tmp_path / "customers.csv").write_text(
        "customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state\n"
        "a,u1, 01001 ,old city,SP\nb,u2,01002,nan,\na,u3,01001,  new city ,None\n")
    (tmp_path / "order_payments.csv").write_text(
        "order_id,payment_sequential,payment_type,payment_installments,payment_value\n"
        "o1,1,boleto,1, 10.50 \no1,2,boleto,1,bad\n")
    (tmp_path / "geolocation.csv").write_text(
        "geolocation_zip_code_prefix,geolocation_lat,geolocation_lng,geolocation_city,"
        "geolocation_state\n01001,-1.5,2.5,x,SP\n01001,-1.5,2.5,x,SP\n")
    tables = csvtables.load_tables(spark, str(tmp_path))
    assert set(tables) == set(TABLES)
    customers = {r["customer_id"]: r for r in tables["customers"].collect()}
    assert customers["a"]["customer_city"] == "new city"          # the last row wins
    assert customers["a"]["customer_state"] is None
    assert customers["a"]["customer_zip_code_prefix"] == "01001"  # stays text
    assert customers["b"]["customer_city"] is None
    pay = {r["payment_sequential"]: r["payment_value"] for r in tables["order_payments"].collect()}
    assert float(pay[1]) == 10.5 and pay[2] is None
    assert tables["geolocation"].count() == 2                     # no key: rows append
    counts = {r["table_name"]: r["row_count"] for r in csvtables.row_counts(tables).collect()}
    assert counts["orders"] == 0 and counts["customers"] == 2
    write_parquet(tables, str(tmp_path / "tables"))
    again = StarSchema.from_parquet(spark, str(tmp_path / "tables"), ASOF)
    assert again.customers.count() == 2 and again.asof == ASOF
    with pytest.raises(ValueError):
        StarSchema.from_parquet(spark, str(tmp_path / "tables")).asof


def test_later_files_win(spark, tmp_path):
    folder = tmp_path / "sellers.csv"
    folder.mkdir()
    head = "seller_id,seller_zip_code_prefix,seller_city,seller_state\n"
    (folder / "part-0.csv").write_text(head + "s,1,first,A\nt,1,only,A\n")
    (folder / "part-1.csv").write_text(head + "s,1,second,B\n")
    sellers = csvtables.load_tables(spark, str(tmp_path))["sellers"].collect()
    assert {r["seller_id"]: r["seller_city"] for r in sellers} == {"s": "second", "t": "only"}


def test_upsert_and_insert_absent(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), (None, 9)], "k string, v int")
    new = spark.createDataFrame([("b", 5, 1), ("b", 6, 2), ("c", 7, 1), (None, 8, 1)],
                                "k string, v int, seq int")
    up = sorted(map(tuple, tc.upsert(old, new, ["k"], ["seq"]).collect()), key=str)
    assert up == sorted([("a", 1), ("b", 6), ("c", 7), (None, 9), (None, 8)], key=str)
    ins = sorted(map(tuple, tc.insert_absent(old, new, ["k"], ["seq"]).collect()), key=str)
    assert ("b", 2) in ins and ("c", 7) in ins and ("b", 5) not in ins
    assert tc.upsert(old, new, None, ["seq"]).count() == 7


def test_rebase_moves_by_whole_days_and_keeps_null(spark):
    df = spark.createDataFrame([(datetime(2024, 6, 1, 12, 30), None),
                                (datetime(2024, 6, 10, 1), datetime(2024, 6, 11))],
                               "a timestamp, b timestamp")
    out = tc.rebase(df, ["a", "b"], tc.shift_days(df.select("a"), ASOF)).collect()
    assert out[0]["a"] == datetime(2024, 6, 21, 12, 30) and out[0]["b"] is None
    assert out[1]["a"] == datetime(2024, 6, 30, 1)           # lands on the anchor day
    both = tc.rebase_tables({"x": (df, ["a"]), "y": (df, ["b"])}, df.select("a"), ASOF)
    assert both["y"].collect()[1]["b"] == datetime(2024, 7, 1)


def test_quoted_line_breaks_stay_in_their_row(spark, tmp_path):
    (tmp_path / "r.csv").write_text('id,message,n\n"a","line one\nline ""two""", 1 \nb,NULL,2\n')
    schema = T.StructType([T.StructField("id", T.StringType()),
                           T.StructField("message", T.StringType()),
                           T.StructField("n", T.IntegerType())])
    rows = csvtables.read_csv(spark, str(tmp_path / "r.csv"), schema, multi_line=True).collect()
    assert [tuple(r)[::2] for r in rows] == [("a", 1), ("b", 2)]
    assert rows[0]["message"] == 'line one\nline "two"'


def test_purge_drops_orphaned_children(make):
    orders = make("orders", [("new", "c", "x", "2024-06-20T00:00:00"),
                             ("old", "c", "x", "2024-01-01T00:00:00"), ("none", "c", "x")])
    kept = tc.purge_recent(orders, {"payments": make("payments", [
        ("new", 1), ("old", 1), ("none", 1), ("ghost", 1)])}, ASOF)
    assert {r["order_id"] for r in kept["orders"].collect()} == {"old", "none"}
    assert {r["order_id"] for r in kept["payments"].collect()} == {"old", "none"}


FEED = ["seq", "order_id", "customer_id", "product_id", "city", "category", "delivery_status",
        "is_returned", "order_timestamp", "order_value", "payment_method", "quantity", "price"]


def feed_frame(spark, rows):
    return spark.createDataFrame(rows, ", ".join(
        f"{c} {'int' if c == 'seq' else 'string'}" for c in FEED))


def row(seq, order="o", status="Delivered", returned="No", when="13:41.9", qty="1",
        method="Credit Card", customer="c", city="x", price="2.5", product="p"):
    return (seq, order, customer, product, city, "cat", status, returned, when, "10.0", method,
            qty, price)


def test_feed_statuses(spark):
    cases = [("Delivered", "No", "delivered"), ("Shipped", None, "shipped"),
             ("Processing", "no", "processing"), ("Cancelled", "No", "canceled"),
             ("Pending", "0", "invoiced"), ("Lost", "No", "processing"),
             ("Delivered", "YES", "canceled"), ("Shipped", "true", "canceled"),
             ("Shipped", "1", "canceled"), (None, "No", "invoiced")]
    rows = [row(i, f"o{i}", s, r) for i, (s, r, _) in enumerate(cases)]
    orders = feed.normalise(feed_frame(spark, rows), ASOF, ["seq"])["orders"]
    got = {r["order_id"]: r for r in orders.collect()}
    for i, (_, _, want) in enumerate(cases):
        r = got[f"o{i}"]
        assert r["order_status"] == want
        assert r["purchase_ts"] == datetime(2024, 6, 30, 13, 41) == r["estimated_ts"]
        assert (r["approved_ts"] is None) == (want == "canceled")
        assert (r["carrier_ts"] is not None) == (want in ("shipped", "delivered"))
        assert (r["delivered_ts"] is not None) == (want == "delivered")


def test_feed_times_and_methods(spark):
    rows = [row(1, "a", when="13:41.9"), row(2, "b", when="rubbish"), row(3, "c", when=None),
            row(4, "d", when="99:00.1", method="Debit Card")]
    out = feed.normalise(feed_frame(spark, rows), ASOF, ["seq"])
    times = {r["order_id"]: r["purchase_ts"] for r in out["orders"].collect()}
    midnight = datetime(2024, 6, 30)
    assert times == {"a": datetime(2024, 6, 30, 13, 41), "b": midnight, "c": midnight,
                     "d": midnight}
    methods = {r["order_id"]: r["payment_type"] for r in out["payments"].collect()}
    assert methods["a"] == "credit_card" and methods["d"] == "debit_card"


def test_feed_first_and_last_rows(spark):
    rows = [row(1, city="first", status="Pending"), row(2, city="second", status="Shipped")]
    out = feed.normalise(feed_frame(spark, rows), ASOF, ["seq"])
    assert out["customers"].first()["customer_city"] == "first"
    assert out["orders"].first()["order_status"] == "shipped"
    assert out["orders"].count() == out["payments"].count() == out["products"].count() == 1


def test_feed_items_equal_row_by_row_replacement(spark):
    quantities = [3, 1, 5, 0, 2, -4, 5, 4, None, 6, 2]
    rows = [row(i, qty=None if q is None else str(q), product=f"p{i}")
            for i, q in enumerate(quantities)]
    expected = {}
    for i, q in enumerate(quantities):
        for n in range(1, (1 if q is None else q) + 1):
            expected[n] = f"p{i}"
    items = feed.normalise(feed_frame(spark, rows), ASOF, ["seq"])["items"].collect()
    assert {r["order_item_id"]: r["product_id"] for r in items} == expected
    assert len(items) == len(expected)


def test_feed_seller_and_long_quantities(spark):
    n = feed._CHUNK
    rows = [row(1, qty=str(2 * n + 5), product="late"), row(2, qty=str(n), product="over"),
            row(3, "one", qty=str(n + 1))]
    out = feed.normalise(feed_frame(spark, rows), ASOF, ["seq"])
    got = {(r["order_id"], r["product_id"]): (r["low"], r["high"], r["n"]) for r in out["items"]
           .groupBy("order_id", "product_id").agg(
               F.min("order_item_id").alias("low"), F.max("order_item_id").alias("high"),
               F.count_distinct("order_item_id").alias("n")).collect()}
    assert got == {("o", "late"): (n + 1, 2 * n + 5, n + 5), ("o", "over"): (1, n, n),
                   ("one", "p"): (1, n + 1, n + 1)}
    assert [tuple(r) for r in out["sellers"].collect()] == [
        ("seller_default_2025", "00000", "New York", "NY")]
    none = feed.normalise(feed_frame(spark, rows[:0]), ASOF, ["seq"])
    assert none["sellers"].count() == none["items"].count() == 0


def test_jdbc_urls():
    assert databases.jdbc_url({"type": "postgresql", "host": "h", "database": "d"}) == \
        "jdbc:postgresql://h:5432/d"
    assert databases.jdbc_url({"type": "mysql", "port": 1, "database": "d"}) == \
        "jdbc:mysql://localhost:1/d"
    assert databases.jdbc_url({"type": "SQLServer", "host": "h", "database": "d"}) == \
        "jdbc:sqlserver://h:1433;databaseName=d"
    assert databases.jdbc_url({"database": "f.db"}) == "jdbc:sqlite:f.db"
    with pytest.raises(ValueError):
        databases.jdbc_url({"type": "oracle", "database": "d"})


def test_command_line(spark, tmp_path, capsys):
    from tidemark.__main__ import main
    source = tmp_path / "csv"
    source.mkdir()
    (source / "orders.csv").write_text(
        ",".join(f.name for f in TABLES["orders"].fields) + "\n" + "".join(
            f"o{i},c{i % 3},delivered,2024-06-{10 + i:02d} 08:00:00,,,"
            f"2024-06-{12 + i:02d} 08:00:00,2024-06-30 00:00:00\n" for i in range(15)))
    (source / "order_payments.csv").write_text(
        ",".join(f.name for f in TABLES["order_payments"].fields) + "\n" + "".join(
            f"o{i},1,boleto,1,{10 if i == 14 else 100}.00\n" for i in range(15)))
    tables = str(tmp_path / "tables")
    assert main(["load", str(source), tables]) == 0
    assert main(["run", tables]) == 2                     # revenue fell by 90 percent
    assert main(["audit", tables, "--log", str(tmp_path / "log")]) == 0
    assert main(["export", tables, str(tmp_path / "out")]) == 0
    assert spark.read.parquet(str(tmp_path / "log")).count() == 8
    config = tmp_path / "kpis.json"
    config.write_text('{"kpis": [{"name": "n", "sql_query": "SELECT x FROM absent"}]}')
    assert main(["run", tables, "--config", str(config)]) == 1
    assert "daily_revenue" in capsys.readouterr().out


def quoted_file(path, n, long_every=0, newline="\n"):
    import random

    rng = random.Random(n)
    pieces = ["plain", 'say ""hi""', "a, b", "line\nbreak", "two\n\nbreaks", '""', "", "\n", "é ü"]
    with open(path, "w", encoding="utf-8", newline="") as out:
        out.write("id,title,message" + newline)
        for i in range(n):
            text = " ".join(rng.choice(pieces) for _ in range(rng.randrange(1, 6)))
            if long_every and i % long_every == 0:
                text += "long\n" * 2000
            out.write(f'{i},"t""{i}\n{i % 3}","{text}"'.replace("\n", newline) + newline)


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_quoted_line_breaks_read_by_many_tasks(spark, tmp_path, newline):
    """Blocks end anywhere: inside quotes, in records longer than several blocks, at line ends."""
    from tidemark.sources.quotedcsv import read_quoted

    folder = tmp_path / "r.csv"
    folder.mkdir()
    quoted_file(folder / "a.csv", 400, 90, newline)
    quoted_file(folder / "b.csv", 30, 0, newline)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("id", "title", "message")])
    want = spark.read.schema(schema).option("header", True).option("escape", '"').option(
        "multiLine", True).csv(str(folder))
    want = sorted(map(str, want.select(*schema.names).collect()))
    key = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(key)
    try:
        for size in ("3000", "777", old):
            spark.conf.set(key, size)
            got = read_quoted(spark, str(folder), schema)
            blocks = spark.read.text(str(folder)).rdd.getNumPartitions()
            assert size == old or blocks > 8
            assert sorted(map(str, got.select(*schema.names).collect())) == want
            order = got.filter("_file LIKE '%a.csv'").orderBy("_block", "_row").select("id")
            assert [r.id for r in order.collect()] == [str(i) for i in range(400)]
    finally:
        spark.conf.set(key, old)


def test_one_pass_over_a_feed_equals_its_tables(spark, tmp_path):
    import random

    rng = random.Random(2)
    rows = [row(i, rng.choice([None, "a", "b", "c"]), rng.choice(["Shipped", "Pending", None]),
                city=rng.choice(["x", "y", None])) for i in range(60)]
    frame = feed_frame(spark, rows).withColumn("quantity", (F.col("seq") % 5 - 1).cast("string")) \
        .withColumn("customer_id", F.when(F.col("seq") % 7 > 0, F.concat(F.lit("c"), F.col("seq") % 4)))
    path = str(tmp_path / "flat.parquet")
    frame.write.parquet(path)
    source = spark.read.parquet(path)
    want = feed.normalise(source, ASOF, ["seq"])
    plan = feed.deciding_rows(source, ASOF, ["seq"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    feed.store(source, ASOF, ["seq"], str(tmp_path / "kept"))
    tables = feed.stored_tables(spark, str(tmp_path / "kept"))
    assert set(tables) == set(TABLES)
    star = StarSchema(tables, ASOF)
    for name, got in (("customers", tables["customers"]), ("sellers", tables["sellers"]),
                      ("orders", star.orders), ("payments", star.payments), ("items", star.items)):
        columns = want[name].columns
        assert sorted(map(str, got.select(columns).collect())) == sorted(
            map(str, want[name].collect())), name
    assert sorted(map(str, tables["products"].select(want["products"].columns).collect())) == sorted(
        map(str, want["products"].collect()))
    assert tables["order_reviews"].count() == 0


def test_deciding_rows_shuffle_one_row_a_key_whatever_their_order(spark):
    """Only the deciding row of a kind is kept, and rows of one place decide alike in any order."""
    names = ("order_id customer_id product_id city category delivery_status is_returned "
             "order_timestamp order_value payment_method quantity price").split()
    rows = [(1, "o", "c", "p", city, "k", "Shipped", "no", "10:00.0", "5", pay, "2", "5")
            for city, pay in (("Oslo", "Visa"), ("Bonn", "Cash"))]
    rows.append((0, "o2", "c2", "p", "Rome", "a", "Shipped", "no", "10:00.0", "5", "Cash", "0", "5"))
    found = []
    for given in (rows, rows[::-1]):
        df = spark.createDataFrame(given, ["n", *names]).coalesce(1)
        decided = feed.deciding_rows(df, date(2024, 1, 1), ["n"])
        assert "min_by" not in decided._jdf.queryExecution().optimizedPlan().toString()
        found.append(sorted((r["table"], r["key"], r["place"]["n"], r["row"]["city"] or "",
                             r["row"]["category"] or "", r["row"]["payment_type"] or "")
                            for r in decided.collect()))
    assert found[0] == found[1] == [
        ("customers", "c", 1, "Bonn", "", ""), ("customers", "c2", 0, "Rome", "", ""),
        ("items", "o", 1, "", "", ""), ("orders", "o", 1, "", "", "visa"),
        ("orders", "o2", 0, "", "", "cash"), ("products", "p", 0, "", "a", "")]


def _exchanges(df):
    """(records, bytes) of every exchange of a plan that has run."""
    found, todo = [], [df._jdf.queryExecution().executedPlan().executedPlan()]
    while todo:
        node = todo.pop()
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            node = node.plan()
        if node.getClass().getSimpleName() == "ShuffleExchangeExec":
            found.append([node.metrics().apply(m).value()
                          for m in ("shuffleRecordsWritten", "dataSize")])
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_deciding_rows_are_narrow_before_the_exchange(spark):
    """Kinds share their columns: four rows to a feed row are sorted and shuffled."""
    rows = [row(i, f"o{i}", customer=f"c{i}", product=f"p{i}") for i in range(200)]
    decided = feed.deciding_rows(feed_frame(spark, rows), ASOF, ["seq"])
    assert len(decided.collect()) == 800
    (records, size), = _exchanges(decided)
    assert records == 800 and size / records < 160


def test_flat_feed_moves_its_lines_by_part_and_by_order_only(spark, tmp_path):
    from tidemark.catalog import queries
    from tidemark.sources.conformed import Mart

    day = datetime(2024, 3, 1)
    lines = [(1, 1, 10, 7, 12.0, 5.25, 0.06, "R", "O", day), (1, 2, 11, 7, 20.0, 6.5, 0.05, "R", "F", day),
             (2, 5, 10, 8, 30.0, 7.0, 0.09, "A", "F", day), (2, 7, 11, 8, 40.0, 8.0, None, "R", "O", day),
             (2, 4, 10, 8, 50.0, 9.0, 0.1, None, None, day), (3, 1, 10, 9, 10.0, 1.0, 0.0, "N", "O", day),
             (1, 3, 99, 9, 10.0, 1.0, 0.0, "N", "O", day), (None, 1, 10, 9, 10.0, 1.0, 0.0, "N", "O", day)]
    tables = {
        "lineitem": (lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, "
                     "l_quantity double, l_extendedprice double, l_discount double, "
                     "l_returnflag string, l_linestatus string, l_shipdate timestamp"),
        "orders": ([(1, 20, "F"), (2, 21, "P"), (3, 99, "O"), (4, 20, "O")],
                   "o_orderkey long, o_custkey long, o_orderstatus string"),
        "customer": ([(20, "X"), (21, None)], "c_custkey long, c_mktsegment string"),
        "part": ([(10, "a"), (11, "b")], "p_partkey long, p_type string")}
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    try:
        spark.conf.set(key, "-1")
        flat = queries.flat_feed(Mart(spark, str(tmp_path)))
        plan = flat._jdf.queryExecution().executedPlan().toString()
        got = sorted((r.order_id, r.l_linenumber, r.customer_id, r.product_id, r.city, r.category,
                      r.delivery_status, r.is_returned, r.order_timestamp, r.order_value,
                      r.payment_method, r.quantity) for r in flat.collect())
    finally:
        spark.conf.set(key, old)
    # A customer meets orders, so no line is dealt out by its customer.
    branch = plan[plan.index("hashpartitioning(o_custkey"):].splitlines()[1:4]
    assert any("orders.parquet" in x or "o_orderkey" in x for x in branch)
    assert all("l_orderkey" not in x for x in branch)
    assert got == [
        ("1", 1, "20", "10", "X", "a", "Delivered", "Yes", "09:12.5", "5.25", "Credit Card", "2"),
        ("1", 2, "20", "11", "X", "b", "Delivered", "no", "10:20.5", "6.50", "Credit Card", "10"),
        ("2", 4, "21", "10", None, "a", "Lost", "no", "12:50.5", "9.00", "Gift Card", "40"),
        ("2", 5, "21", "10", None, "a", "Processing", "no", "13:30.5", "7.00", "Debit Card", "20"),
        ("2", 7, "21", "11", None, "b", "Pending", "no", "n/a", "8.00", "Credit Card", "30")]


def test_small_tasks_bound_rows_and_give_settings_back(spark):
    from tidemark.plans import small_tasks

    keys = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    before = [spark.conf.get(k) for k in keys]
    with small_tasks(spark, 41, 4, "1m"):
        assert [spark.conf.get(k) for k in keys] == ["11", "1m"]
    with pytest.raises(KeyError), small_tasks(spark, 0, 4, "1m"):
        assert spark.conf.get(keys[0]) == before[0]       # never fewer than the session has
        raise KeyError
    assert [spark.conf.get(k) for k in keys] == before
