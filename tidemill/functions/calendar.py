"""Calendar columns."""

from __future__ import annotations

import math

from pyspark.sql import functions as F


def utc_calendar(ts: str) -> list:
    """Sine and cosine of the hour of day, the weekday (Monday is 0) and the day of the year (leap years have their own length)."""
    t = F.col(ts)
    parts = {"hour": F.hour(t) / 24, "weekday": F.weekday(t) / 7, "year": (F.dayofyear(t) - 1) / F.dayofyear(F.make_date(F.year(t), F.lit(12), F.lit(31)))}
    return [F.round(f(2 * math.pi * x), 6).alias(f"{n}_{k}") for n, x in parts.items() for k, f in (("sin", F.sin), ("cos", F.cos))]
