"""Recursive forecasts with inputs from outside: level features rebuilt from the forecasts themselves, the calendar of each valid hour, held columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LOOKBACK = 24
PREDICTORS = ["level", "day_before", "day_mean", "hour_sin", "hour_cos", "held"]


def issues(frames: DataFrame) -> DataFrame:
    """``(station_id, ts, w, held, following)``: the last ``LOOKBACK`` levels (oldest first), the mean level of the other
    stations at the hour, and the next hour's level (null if missing). Only hours with a whole window and another
    station's level stay."""
    own = Window.partitionBy("station_id").orderBy("ts")
    # the sums by hour combine before the shuffle; each station takes its own level out again
    hours = frames.groupBy("ts").agg(F.sum("water_level").alias("total"), F.count("water_level").alias("held_by"))
    rows = frames.select("station_id", "ts", "water_level", F.collect_list("water_level").over(own.rowsBetween(1 - LOOKBACK, 0)).alias("w"), F.lead("water_level").over(own).alias("following"))
    rows = rows.filter(F.size("w") == LOOKBACK).join(hours, "ts").filter("held_by > 1")
    return rows.select("station_id", "ts", "w", ((F.col("total") - F.col("water_level")) / (F.col("held_by") - 1)).alias("held"), "following")


def predictors(issue: DataFrame) -> DataFrame:
    """The columns ``PREDICTORS`` of the first step, and ``following``: the rows that a fit takes."""
    angle = 2 * np.pi * (F.hour("ts") + 1) / 24
    mean = F.aggregate("w", F.lit(0.0), lambda a, x: a + x) / LOOKBACK
    columns = [F.col("w")[LOOKBACK - 1], F.col("w")[0], mean, F.sin(angle), F.cos(angle), F.col("held")]
    return issue.select("station_id", "ts", *(c.alias(n) for n, c in zip(PREDICTORS, columns)), "following").filter("following is not null")


def rolled_out(issue: DataFrame, coefficients: dict[str, float], horizon: int) -> DataFrame:
    """``(station_id, ts, path)``: ``horizon`` steps from each issue. A step appends its forecast to the window, from which the next
    one's level features are built; the hour moves on and ``held`` stays. The rows of a batch move together."""
    c = [coefficients[n] for n in PREDICTORS]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            w = np.stack(batch["w"].to_numpy()) if len(batch) else np.zeros((0, LOOKBACK))
            hour, held = batch["ts"].dt.hour.to_numpy(), batch["held"].to_numpy()
            for k in range(1, horizon + 1):
                angle = 2 * np.pi * (hour + k) / 24
                x = [w[:, -1], w[:, -LOOKBACK], w[:, -LOOKBACK:].mean(1), np.sin(angle), np.cos(angle), held]
                w = np.column_stack([w, coefficients["intercept"] + sum(a * v for a, v in zip(c, x))])
            yield pd.DataFrame({"station_id": batch["station_id"], "ts": batch["ts"], "path": list(w[:, LOOKBACK:])})

    return issue.select("station_id", "ts", "w", "held").mapInPandas(run, "station_id string, ts timestamp_ntz, path array<double>")
