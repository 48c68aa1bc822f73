"""Column helpers shared by the operators; all stay inside generated JVM code."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, functions as F

MICROS_PER_DAY = 86_400_000_000


def elapsed_micros(later: Column, earlier: Column) -> Column:
    """Exact distance between two timestamps (with or without zone) in microseconds."""
    return (F.unix_micros(later.cast("timestamp"))
            - F.unix_micros(earlier.cast("timestamp")))


def in_days(micros: Column) -> Column:
    return micros.cast("double") / F.lit(float(MICROS_PER_DAY))


def days_between(later: Column, earlier: Column) -> Column:
    """Fractional days from ``earlier`` to ``later``."""
    return in_days(elapsed_micros(later, earlier))


def mean_of(total: Column, count: Column) -> Column:
    """``total / count`` as a double, NULL for an empty group."""
    return F.try_divide(total.cast("double"), count.cast("double"))


def percent(part: Column, whole: Column, empty: float | None = 0.0) -> Column:
    """``100 * part / whole``; an empty whole gives ``empty``."""
    pct = F.try_divide(part.cast("double") * F.lit(100.0), whole.cast("double"))
    return pct if empty is None else F.coalesce(pct, F.lit(empty))


def round_to(value: Column, digits: int) -> Column:
    """Rounding of a double on its scaled value, ties away from zero as SQL's ROUND has them."""
    scale = float(10 ** digits)
    size = F.floor(F.abs(value) * F.lit(scale) + F.lit(0.5))
    return F.when(value < 0, -size).otherwise(size) / F.lit(scale)


def settle(value: Column, digits: int) -> Column:
    """Half-up rounding for square roots: a tie that came out a few bits low still goes up."""
    scale = float(10 ** digits)
    return F.floor(value * F.lit(scale) + F.lit(0.500001)) / F.lit(scale)


def since(ts: str | Column, asof: date, days: int) -> Column:
    """``ts`` on or after ``asof - days``.

    The timestamp column is left bare and the bound is a literal, so the predicate reaches
    the Parquet reader.
    """
    column = F.col(ts) if isinstance(ts, str) else ts
    return column >= F.lit(asof - timedelta(days=days))
