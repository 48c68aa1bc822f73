from tidemark.functions.scalars import (  # noqa: F401
    days_between, elapsed_micros, in_days, mean_of, percent, round_to, settle, since)
