"""Recursive forecasts from all level features, rebuilt at every step from the observed levels and the forecasts behind them.

Each issue carries the window of levels and imputation flags that the longest feature looks back on. A step turns the window
into every lag, change, rolling statistic and count of imputed hours, moves the calendar on, holds all other columns, and
appends its forecast as an hour that isn't imputed. All issues of a batch move together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.config import CHANGES, HORIZON, LAGS, LOOKBACK, WINDOWS

LENGTH = LOOKBACK + 1  # hours of a window, the issue hour being the last
STATISTICS = ("mean", "std", "min", "max")
LEVEL_FEATURES = ["water_level", *(f"lag_{k}" for k in LAGS), *(f"change_{k}" for k in CHANGES), *(f"{s}_{w}" for w in WINDOWS for s in STATISTICS), *(f"imputed_count_{w}" for w in WINDOWS)]
CALENDAR = [f"{n}_{k}" for n in ("hour", "weekday", "year") for k in ("sin", "cos")]


def windows(frames: DataFrame, held: list[str]) -> DataFrame:
    """``(station_id, ts, levels, flags, held)``: the last LENGTH hours of each hour that has all of them, oldest first. ``held`` packs the
    columns that stay as they are; an hour that misses one gives no row."""
    w = Window.partitionBy("station_id").orderBy("ts").rowsBetween(-LOOKBACK, 0)
    rows = frames.select("station_id", "ts", F.collect_list("water_level").over(w).alias("levels"), F.collect_list("imputed").over(w).alias("flags"), F.array(*(F.col(c).cast("double") for c in held)).cast("array<double>").alias("held"))
    return rows.filter((F.size("levels") == LENGTH) & ~F.exists("held", lambda x: x.isNull()))


def level_features(levels: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """LEVEL_FEATURES of the last hour of each window (rows x hours)."""
    now = levels[:, -1]
    out = [now, *(levels[:, -1 - k] for k in LAGS), *(now - levels[:, -1 - k] for k in CHANGES)]
    for w in WINDOWS:
        last = levels[:, -w:]
        out += [last.mean(axis=1), last.std(axis=1), last.min(axis=1), last.max(axis=1)]
    return np.stack([*out, *(flags[:, -w:].sum(axis=1) for w in WINDOWS)], axis=1)


def calendar_features(times: pd.Series) -> np.ndarray:
    """CALENDAR of UTC hours."""
    year = np.where(times.dt.is_leap_year, 366, 365)
    parts = [times.dt.hour / 24, times.dt.weekday / 7, (times.dt.dayofyear - 1) / year]
    return np.stack([f(2 * math.pi * np.asarray(p)) for p in parts for f in (np.sin, np.cos)], axis=1)


def rolled_out(issues: DataFrame, intercept: float, coefficients: dict[str, float], held: list[str], horizon: int = HORIZON) -> DataFrame:
    """``(station_id, ts, path)``: ``horizon`` forecasts of each issue by a linear model of LEVEL_FEATURES, CALENDAR and ``held``.

    Columns without a coefficient count as 0; a name that is none of them is refused. A forecast that isn't finite raises.
    """
    names = [*LEVEL_FEATURES, *CALENDAR, *held]
    if unknown := sorted(set(coefficients) - set(names)):
        raise ValueError(f"no such predictors: {unknown}")
    c = np.array([coefficients.get(n, 0.0) for n in names])
    uses_calendar = bool(c[len(LEVEL_FEATURES) : len(LEVEL_FEATURES) + len(CALENDAR)].any())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            levels, flags = np.full((n, LENGTH + horizon), np.nan), np.zeros((n, LENGTH + horizon))
            levels[:, :LENGTH], flags[:, :LENGTH] = np.stack(batch["levels"].to_numpy()), np.stack(batch["flags"].to_numpy())
            fixed = np.stack(batch["held"].to_numpy()).reshape(n, len(held))
            for step in range(horizon):
                now = slice(step, step + LENGTH)
                calendar = calendar_features(batch["ts"] + pd.Timedelta(hours=step)) if uses_calendar else np.zeros((n, len(CALENDAR)))
                levels[:, LENGTH + step] = intercept + np.hstack([level_features(levels[:, now], flags[:, now]), calendar, fixed]) @ c
            path = levels[:, LENGTH:]
            if not np.isfinite(path).all():
                raise ValueError("a recursive forecast is not finite")
            yield pd.DataFrame({"station_id": batch["station_id"], "ts": batch["ts"], "path": list(path)})

    return issues.mapInPandas(run, "station_id string, ts timestamp_ntz, path array<double>")


def rebuilt_features(issues: DataFrame, path: str, steps: int) -> DataFrame:
    """``(station_id, ts, LEVEL_FEATURES)`` as they are once the first ``steps`` values of the array ``path`` were appended."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                levels = np.hstack([np.stack(batch["levels"].to_numpy()), np.stack(batch[path].to_numpy())[:, :steps]])
                flags = np.hstack([np.stack(batch["flags"].to_numpy()).astype(float), np.zeros((len(batch), steps))])
                found = level_features(levels[:, steps:], flags[:, steps:])
                yield pd.DataFrame({"station_id": batch["station_id"], "ts": batch["ts"]} | {n: found[:, k] for k, n in enumerate(LEVEL_FEATURES)})

    return issues.mapInPandas(run, "station_id string, ts timestamp_ntz, " + ", ".join(f"{n} double" for n in LEVEL_FEATURES))
