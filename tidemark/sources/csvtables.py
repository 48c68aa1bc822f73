"""Loading the nine base tables from CSV files."""

from __future__ import annotations

import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tidemark.operators.tablechange import latest_per_key
from tidemark.schemas import KEYS, TABLES
from tidemark.sources.quotedcsv import read_quoted

log = logging.getLogger(__name__)

# Texts that stand for a missing value.
NULL_TOKENS = ["nan", "None", ""]

POSITION = ["_file", "_block", "_row"]


def clean_strings(df: DataFrame) -> DataFrame:
    """Trim every string column and turn null tokens into NULL."""
    def clean(field):
        c = F.col(field.name)
        if not isinstance(field.dataType, T.StringType):
            return c
        trimmed = F.regexp_replace(c, r"^\s+|\s+$", "")
        return F.when(~trimmed.isin(NULL_TOKENS), trimmed).alias(field.name)
    return df.select(*[clean(f) for f in df.schema.fields])


#: Tables with text that people wrote, which may hold line breaks.
FREE_TEXT = {"order_reviews", "reviews"}


def read_csv(spark: SparkSession, path: str, schema: T.StructType,
             with_position: bool = False, multi_line: bool = False) -> DataFrame:
    """A headered CSV in its declared types; Spark splits the file, no chunk size needed.

    ``multi_line`` keeps line breaks inside quotes; such a file is split like any other.

    Values are read as text, cleaned, then cast, so a padded number still parses and an
    unparsable one is NULL. ``with_position`` adds the columns ``POSITION``, which order the
    rows as they stand in the files.
    """
    text = T.StructType([T.StructField(f.name, T.StringType(), True) for f in schema.fields])
    position = POSITION if with_position else []
    if multi_line:
        raw = read_quoted(spark, path, text)
    else:
        raw = spark.read.schema(text).option("header", True).option("escape", '"').csv(path)
        raw = raw.select("*", F.col("_metadata.file_path").alias("_file"),
                         F.col("_metadata.file_block_start").alias("_block"),
                         F.monotonically_increasing_id().alias("_row")) if position else raw
    raw = raw.select(*text.names, *position)
    clean = clean_strings(raw)
    return clean.select(
        *[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields], *position)


def load_tables(spark: SparkSession, folder: str, pattern: str = "{table}.csv",
                names: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """All nine tables; a missing or unreadable file gives an empty table and a warning.

    ``pattern`` or ``names`` say what the files are called. Where rows repeat a key, the
    last one in the files stays.
    """
    out = {}
    for table, schema in TABLES.items():
        path = f"{folder}/{(names or {}).get(table, pattern.format(table=table))}"
        try:
            df = read_csv(spark, path, schema, with_position=True,
                          multi_line=table in FREE_TEXT)
        except AnalysisException as e:
            log.warning("%s not loaded: %s", table, str(e).splitlines()[0])
            out[table] = spark.createDataFrame([], schema)
            continue
        if table in KEYS:
            df = latest_per_key(df, KEYS[table], POSITION)
        out[table] = df.drop(*POSITION)
    return out


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows per table in one job."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count"))
             .select(F.lit(name).alias("table_name"), "row_count")
             for name, df in tables.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
