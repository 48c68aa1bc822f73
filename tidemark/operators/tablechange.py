"""Table-level changes: upsert, insert-if-absent, date shift, purge.

Each returns the new content; the caller writes it as a new table version.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F


def _one_per_key(df: DataFrame, keys: list[str], sequence: list[str], pick) -> DataFrame:
    """The row that ``pick`` (max_by or min_by) selects per key.

    An aggregate, so copies of one key combine before the shuffle. NULL keys never collide: a
    row with one is a group of its own, all in the same pass.
    """
    payload = [c for c in df.columns if c not in keys]
    has_key = F.lit(True)
    for k in keys:
        has_key = has_key & F.col(k).isNotNull()
    own = F.when(~has_key, F.monotonically_increasing_id())
    return (df.withColumn("_own", own).groupBy(*keys, "_own")
            .agg(pick(F.struct(F.lit(1).alias("_"), *payload), F.struct(*sequence)).alias("row"))
            .select(*[F.col(c) if c in keys else F.col(f"row.{c}").alias(c)
                      for c in df.columns]))


def latest_per_key(df: DataFrame, keys: list[str], sequence: list[str]) -> DataFrame:
    """Last write wins by ``sequence``."""
    return _one_per_key(df, keys, sequence, F.max_by)


def first_per_key(df: DataFrame, keys: list[str], sequence: list[str]) -> DataFrame:
    """First write wins by ``sequence``."""
    return _one_per_key(df, keys, sequence, F.min_by)


def upsert(old: DataFrame, new: DataFrame, keys: list[str] | None,
           sequence: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` put in; a table without keys only grows.

    ``sequence`` orders the rows of ``new`` among themselves.
    """
    if not keys:
        return old.unionByName(new.select(*old.columns))
    fresh = latest_per_key(new, keys, sequence)
    untouched = old.join(fresh.select(*keys), keys, "left_anti")
    return untouched.select(*old.columns).unionByName(fresh.select(*old.columns))


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str],
                  sequence: list[str]) -> DataFrame:
    """``old`` plus the first row of ``new`` for each key that ``old`` lacks."""
    fresh = first_per_key(new, keys, sequence)
    return old.unionByName(fresh.join(old.select(*keys), keys, "left_anti")
                           .select(*old.columns))


def shift_days(latest: DataFrame, asof: date) -> DataFrame:
    """One row: days from the day of the newest ``latest`` timestamp to ``asof``."""
    newest = F.max(F.col(latest.columns[0])).cast("date")
    return latest.agg(F.date_diff(F.lit(asof), newest).alias("days"))


def rebase(df: DataFrame, columns: list[str], days: DataFrame) -> DataFrame:
    """Move timestamp columns by the one-row ``days``; NULL stays NULL."""
    def moved(c: str) -> Column:
        return (F.col(c) + F.make_dt_interval(F.col("days"))).alias(c)
    return (df.crossJoin(F.broadcast(days))      # one-row right side
            .select(*[moved(c) if c in columns else F.col(c) for c in df.columns]))


def rebase_tables(tables: dict[str, tuple[DataFrame, list[str]]], latest: DataFrame,
                  asof: date) -> dict[str, DataFrame]:
    """Move the named timestamp columns of several tables by the same days.

    ``latest`` has the timestamp whose newest day becomes ``asof``.
    """
    days = shift_days(latest, asof)
    return {name: rebase(df, columns, days) for name, (df, columns) in tables.items()}


def purge_recent(orders: DataFrame, children: dict[str, DataFrame], asof: date,
                 days: int = 70) -> dict[str, DataFrame]:
    """Drop orders bought since ``asof - days``, then child rows left without an order.

    An order without a purchase time stays.
    """
    edge = F.date_sub(F.lit(asof), days)
    kept = orders.filter(F.col("purchase_ts").isNull() | (F.col("purchase_ts") < edge))
    ids = kept.select("order_id")
    return {"orders": kept,
            **{n: c.join(ids, "order_id", "left_semi") for n, c in children.items()}}
