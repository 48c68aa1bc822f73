"""Session settings the operators count on, and where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# All of these can be changed on a running session.
_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # One order or customer may own a third of all rows: split it even when the split
    # costs one more (already aggregated) exchange above the join.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Events of one very active user merge into sessions before they are shuffled.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # Date-limited orders thin the big child tables before those are shuffled. The limit is
    # on the estimated size of the order table, which does not see the date filter, so it is
    # high; what is shipped is a filter of at most 20 MB whatever the tables' size.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "16TB",
    "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": "20000000",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumItems": "20000000",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumBits": "167772160",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def session(app: str = "tidemark", master: str | None = None, **conf: str) -> SparkSession:
    # Recording the Python line of every column costs more than building the plan; the
    # setting is fixed once a session exists.
    builder = SparkSession.builder.appName(app).config(
        "spark.python.sql.dataFrameDebugging.enabled", "false")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return configure(builder.getOrCreate())


@contextmanager
def small_tasks(spark: SparkSession, rows: int, most: int, size: str) -> Iterator[None]:
    """Jobs that run inside have exchanges of so many partitions that one gets ``most`` of ``rows``.

    For jobs that hold much more than they read. Adaptive execution merges partitions up to
    ``size`` only, and splits skewed ones as ever.
    """
    parts = "spark.sql.shuffle.partitions"
    inside = {parts: str(max(int(spark.conf.get(parts)), -(-rows // most))),
              "spark.sql.adaptive.advisoryPartitionSizeInBytes": size}
    before = {key: spark.conf.get(key) for key in inside}
    try:
        for key, value in inside.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    A machine-local folder is used only where the session names none (tests, local mode).
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder shared by all executors")
        base = tempfile.mkdtemp(prefix="tidemark-")
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"
