"""Running Structured Streaming jobs to files: sources, sinks, versions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F


def parquet_stream(spark: SparkSession, folder: str, name: str,
                   files_per_trigger: int | None = None) -> DataFrame:
    """A stream over ``folder/name.parquet``, whether that is one file or a folder of parts.

    Timestamps without zone become timestamps, as watermarks need.
    """
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    files = spark.read.parquet(path).inputFiles()
    if len(files) == 1 and files[0].endswith(f"/{name}.parquet"):
        stream = reader.option("pathGlobFilter", f"{name}.parquet").parquet(folder)
    else:
        stream = reader.parquet(path)
    return stream.select(*[
        F.col(f.name).cast("timestamp").alias(f.name)
        if f.dataType.typeName() == "timestamp_ntz" else F.col(f.name) for f in schema.fields])


def write_batches(rows: DataFrame, column: str, batches: Sequence[int], path: str,
                  rows_per_file: int = 500_000) -> int:
    """Write the rows of each batch one after the other; the number of files each of them has.

    A stream that takes so many files a trigger reads the batches in turn. A batch is one file as
    long as none has more than ``rows_per_file`` rows. With more, each is dealt out in turn from
    every partition, so that no file is left without rows; a batch too small for that makes all
    batches one file.
    """
    spread = rows.rdd.getNumPartitions()
    sizes = {r[column]: r["count"] for r in rows.groupBy(column).count().collect()}
    present = [sizes[b] for b in batches if b in sizes]
    files = -(-max(present, default=1) // rows_per_file)
    if min(present, default=0) < files * spread or len(present) < len(batches):
        files = 1
    for b in batches:
        part = rows.filter(F.col(column) == b).drop(column)
        part = part.coalesce(1) if files == 1 else part.repartition(files)
        part.write.mode("append").parquet(path)
    return files


def run_batches(stream: DataFrame, folder: str, handle: Callable[[DataFrame, int], None],
                mode: str = "append") -> None:
    """Process all available input through ``handle`` and stop."""
    query = (stream.writeStream.outputMode(mode).foreachBatch(handle)
             .option("checkpointLocation", f"{folder}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()


def write_batch(df: DataFrame, path: str, batch: int) -> None:
    """One folder per batch, replaced when the batch is replayed after a failure."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_all(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("batch")


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest batch folder of a table that each batch rewrites."""
    versions = spark.read.parquet(path)
    newest = versions.agg(F.max("batch")).first()[0]
    if newest is None:
        return versions.drop("batch")
    return versions.filter(F.col("batch") == newest).drop("batch")


def collect_complete(stream: DataFrame, folder: str) -> DataFrame:
    """Final result of an aggregation in complete mode, read back from files."""
    run_batches(stream, folder, lambda df, b: write_batch(df, f"{folder}/out", b), "complete")
    return read_latest(stream.sparkSession, f"{folder}/out")


def collect_append(stream: DataFrame, folder: str) -> DataFrame:
    """Everything an append-mode stream emitted."""
    run_batches(stream, folder, lambda df, b: write_batch(df, f"{folder}/out", b))
    return read_all(stream.sparkSession, f"{folder}/out")
