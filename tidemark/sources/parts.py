"""Parquet tables of which a change rewrites only the partitions it touches.

Spark's dynamic partition overwrite stages the new partitions and puts them in place when the job
commits, so a write that fails before leaves the table as it was, and partitions that no row of the
change falls into are neither read nor written. Every replaced partition gets one marker row
without content, so one that loses all of its rows is replaced as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidemark.operators.tablechange import upsert

BUCKET, _LIVE = "bucket", "_live"


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).filter(_LIVE).drop(_LIVE)


def replace_parts(rows: DataFrame, path: str, column: str, parts: list) -> None:
    """Make ``rows`` the whole content of the given values of the partition column.

    ``rows`` may be read from ``path`` itself. Values that ``parts`` doesn't name are left alone,
    and rows with such values must not occur.
    """
    if not parts:
        return
    kind = rows.schema[column].dataType.simpleString()
    markers = rows.sparkSession.createDataFrame([(p,) for p in parts], f"`{column}` {kind}")
    whole = rows.withColumn(_LIVE, F.lit(True)).unionByName(
        markers.withColumn(_LIVE, F.lit(False)), allowMissingColumns=True)
    (whole.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(column).parquet(path))


def write_parts(rows: DataFrame, path: str, column: str) -> None:
    """A new table, partitioned by ``column``."""
    (rows.withColumn(_LIVE, F.lit(True)).write.mode("errorifexists").partitionBy(column)
     .parquet(path))


def bucket_of(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def write_buckets(rows: DataFrame, path: str, keys: list[str], buckets: int = 256) -> None:
    """A new keyed table; rows of a key share a bucket, and each bucket is written by one task."""
    dealt = rows.withColumn(BUCKET, bucket_of(keys, buckets))
    write_parts(dealt.repartition(BUCKET), path, BUCKET)


def change_buckets(spark: SparkSession, path: str, keys: list[str], sequence: list[str],
                   new: DataFrame | None = None, gone: DataFrame | None = None,
                   buckets: int = 256) -> list[int]:
    """Put in the rows of ``new`` (last one by ``sequence`` wins), take out the keys of ``gone``.

    A key in both is taken out. Reads and rewrites only the buckets that either falls into, and
    returns these; ``buckets`` must be what the table was written with.
    """
    touched = None
    for change in (new, gone):
        if change is not None:
            found = change.select(bucket_of(keys, buckets).alias(BUCKET))
            touched = found if touched is None else touched.unionByName(found)
    if touched is None:
        return []
    parts = sorted(r[BUCKET] for r in touched.distinct().collect())       # ``buckets`` at most
    rows = read_parts(spark, path).filter(F.col(BUCKET).isin(parts)).drop(BUCKET)
    if new is not None:
        rows = upsert(rows, new, keys, sequence)
    if gone is not None:
        rows = rows.join(gone.select(*keys).distinct(), keys, "left_anti")
    replace_parts(rows.withColumn(BUCKET, bucket_of(keys, buckets)).repartition(BUCKET), path,
                  BUCKET, parts)
    return parts


def remove_rows(spark: SparkSession, path: str, test: Column) -> list[int]:
    """Take out the rows for which ``test`` holds; buckets without such rows are not rewritten."""
    table = read_parts(spark, path)
    parts = sorted(r[BUCKET] for r in table.filter(test).select(BUCKET).distinct().collect())
    rows = table.filter(F.col(BUCKET).isin(parts)).filter(~F.coalesce(test, F.lit(False)))
    replace_parts(rows.repartition(BUCKET), path, BUCKET, parts)
    return parts
