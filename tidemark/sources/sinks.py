"""Writing audit rows and reporting extracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F


def append_audit(log: DataFrame, path: str) -> None:
    """Append audit rows to a table partitioned by run date."""
    (log.withColumn("run_date", F.to_date("run_timestamp"))
     .write.mode("append").partitionBy("run_date").parquet(path))


def export_csv(extracts: dict[str, DataFrame], folder: str) -> DataFrame:
    """Each extract as headered CSV parts below ``folder``; returns a manifest.

    Rows are counted while they are written.
    """
    manifest = []
    for name, df in extracts.items():
        path, seen = f"{folder}/{name}", Observation(name)
        (df.observe(seen, F.count(F.lit(1)).alias("rows"))
         .write.mode("overwrite").option("header", True).csv(path))
        manifest.append((name, path, seen.get["rows"]))
    return df.sparkSession.createDataFrame(manifest, "extract string, path string, rows long")
