"""CSV records with line breaks inside quotes, read by many tasks.

A file is read line by line in blocks, as Spark splits it. A line begins a record where the number
of quotes before it in the file is even: quotes are summed per block, a running sum over the blocks
gives what each begins with, and a running sum inside a block the rest. Lines of a record are put
together inside their block; only the records at block borders meet those of other blocks.

Quotes inside a quoted field are doubled, and unquoted fields have none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

_PLACE = ["_file", "_block"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"),
        (F.length("value") - F.length(F.replace("value", F.lit('"')))).alias("quotes"))


def _joined(parts, order: str, text: str):
    """Texts in order, with the line breaks that stood between them."""
    pairs = F.sort_array(F.collect_list(F.struct(order, text)))
    return F.array_join(F.transform(pairs, lambda p: p[text]), "\n")


def records(spark: SparkSession, path: str) -> DataFrame:
    """(_file, _block, _row, record): every record's text and its place, headers included.

    A task holds the lines of one block; a record longer than a block is put together by one.
    """
    lines = _lines(spark, path)
    by_file = Window.partitionBy("_file").orderBy("_block").rowsBetween(
        Window.unboundedPreceding, -1)
    before = lines.groupBy(*_PLACE).agg(F.sum("quotes").alias("q")).select(
        *_PLACE, F.coalesce(F.sum("q").over(by_file), F.lit(0)).alias("earlier"))
    block = Window.partitionBy(*_PLACE).orderBy("_row")
    upto = block.rowsBetween(Window.unboundedPreceding, -1)
    opened = F.col("earlier") + F.coalesce(F.sum("quotes").over(upto), F.lit(0))
    marked = (lines.join(before, _PLACE).withColumn("begins", (opened % 2 == 0).cast("int"))
              .withColumn("no", F.sum("begins").over(
                  block.rowsBetween(Window.unboundedPreceding, 0))))
    pieces = marked.groupBy(*_PLACE, "no").agg(
        F.min("_row").alias("_row"), _joined(marked, "_row", "value").alias("record"))
    pieces = pieces.withColumn("last", F.max("no").over(Window.partitionBy(*_PLACE)))
    # What precedes a block's first record belongs to the last record begun before.
    begun = F.when(F.col("last") > 0, F.struct(F.col("_block").alias("b"), F.col("last").alias("n")))
    owners = (pieces.select(*_PLACE, "last").distinct()
              .withColumn("owner", F.last(begun, ignorenulls=True).over(by_file)))
    loose = (pieces.filter("no = 0").join(owners.select(*_PLACE, "owner"), _PLACE)
             .select("_file", F.col("owner.b").alias("owner"), F.col("owner.n").alias("no"),
                     "_block", "_row", "record"))
    border = (pieces.filter("no > 0 AND no = last")
              .select("_file", F.col("_block").alias("owner"), "no", "_block", "_row", "record")
              .unionByName(loose).withColumnRenamed("_block", "from"))
    border = border.groupBy("_file", F.col("owner").alias("_block"), "no").agg(
        F.min_by("_row", "from").alias("_row"), _joined(border, "from", "record").alias("record"))
    whole = pieces.filter("no > 0 AND no < last").select(*border.columns).unionByName(border)
    return whole.select(*_PLACE, "_row", F.regexp_replace(
        "record", r"\r(?=\n|\z)", "").alias("record"))


def read_quoted(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Fields of ``schema`` (strings) by position, with _file, _block and _row; headers dropped."""
    found = records(spark, path).filter(F.trim("record") != "")
    first = found.filter("_block = 0").groupBy("_file").agg(F.min("_row").alias("head"))
    rows = (found.join(first, "_file", "left").filter(
        (F.col("_block") > 0) | (F.col("_row") > F.col("head"))))
    return rows.select(
        F.from_csv("record", F.lit(schema.simpleString()[len("struct<"):-1].replace(":", " ")),
                   {"escape": '"', "multiLine": "true"}).alias("fields"), *_PLACE, "_row").select(
        "fields.*", *_PLACE, "_row")
