"""Shared helpers of the text operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.session import work_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lower-cases A-Z and turns every byte outside ``[0-9A-Za-z\x80-\xff]`` into a space.
WORD_BYTES = bytes(
    b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32
    for b in range(256))
#: Lower-cases A-Z and nothing else.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` below the cluster's shared checkpoint folder and read it from there.

    A temporary folder is used only where neither the session nor the context names one, in local
    mode (tests).
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
            base = tempfile.mkdtemp(prefix="tidemark-llm-")
        context.setCheckpointDir(base)
    return df.checkpoint()


def stored(df: DataFrame, purpose: str = "step") -> DataFrame:
    """Write ``df`` as Parquet below the cluster's shared checkpoint folder and read it again."""
    path = work_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def rows(batches: Iterator[pa.RecordBatch], size: int = 500) -> Iterator[list[list]]:
    """Columns of at most ``size`` rows at a time as Python lists, to keep a task's memory small."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            part = batch.slice(at, size)
            yield [part.column(i).to_pylist() for i in range(part.num_columns)]


def portions(batches: Iterator[pa.RecordBatch], chars: int = 1_000_000) -> Iterator[list[list]]:
    """Columns as Python lists, cut after about ``chars`` code points of the strings in them."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            columns = [batch.slice(at, 200).column(i).to_pylist()
                       for i in range(batch.num_columns)]
            texts = [i for i in range(batch.num_columns) if pa.types.is_string(batch.column(i).type)]
            first, size, n = 0, 0, len(columns[0])
            for i in range(n):
                size += sum(len(columns[c][i] or "") for c in texts)
                if size > chars or i + 1 == n:
                    yield [c[first:i + 1] for c in columns]
                    first, size = i + 1, 0


def record(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, schema.types)],
        schema=schema)
