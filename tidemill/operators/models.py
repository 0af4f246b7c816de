"""Forecasters whose fits are sums over rows: Gram aggregates, closed-form solves, row-parallel recursion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def gram(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``(keys, i, j, n, s)``: sums of products of all pairs of columns (and a one) over complete rows, in one aggregate.

    The sums combine before the shuffle, so what moves has the size of the groups times p squared, not of the rows.
    """
    names = ["one", *columns]
    whole = rows.withColumn("one", F.lit(1.0)).filter(" and ".join(f"{c} is not null" for c in columns))
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    sums = whole.groupBy(*keys).agg(*(F.sum(F.col(a) * F.col(b)).alias(f"s{k}") for k, (a, b) in enumerate(pairs)))
    each = F.array(*(F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(f"s{k}").alias("s")) for k, (a, b) in enumerate(pairs)))
    return sums.select(*keys, F.explode(each).alias("x")).select(*keys, "x.*")


def solve(sums: np.ndarray, alphas: list[float]) -> np.ndarray:
    """Ridge fits of a stack of groups, from sums of products of (1, predictors, target): groups x penalties x (intercept, coefficients).

    Predictors are scaled by their deviation and the result is back on the original scale. Constant columns get 0; where the
    penalty leaves a fit singular, the smallest solution counts.
    """
    n = sums[:, 0, 0][:, None]
    mean = sums[:, 0, 1:] / n
    cov = sums[:, 1:, 1:] - n[:, :, None] * mean[:, :, None] * mean[:, None, :]
    scale = np.sqrt(np.maximum(np.einsum("gii->gi", cov)[:, :-1], 0) / n)
    scale = np.where(scale < 1e-12, 1, scale)
    a, b = cov[:, :-1, :-1] / scale[:, :, None] / scale[:, None, :], cov[:, :-1, -1] / scale
    p = a.shape[1]
    out = np.empty((len(sums), len(alphas), 1 + p))
    for k, alpha in enumerate(alphas):
        inverse = np.linalg.pinv(a + alpha * np.eye(p), rcond=np.finfo(float).eps * p, hermitian=True)
        out[:, k, 1:] = np.einsum("gij,gj->gi", inverse, b) / scale
        out[:, k, 0] = mean[:, -1] - np.einsum("gi,gi->g", out[:, k, 1:], mean[:, :-1])
    return out


def ridge(rows: DataFrame, keys: list[str], predictors: list[str], target: str, alphas: list[float]) -> DataFrame:
    """``(keys, alpha, feature, coefficient)``: every group and penalty from one pass over the rows. The sums of a group are one row, and
    the groups of a batch are solved together, so any number of groups needs no shuffle but that of the sums."""
    names = ["one", *predictors, target]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    whole = rows.withColumn("one", F.lit(1.0)).filter(" and ".join(f"{c} is not null" for c in names[1:]))
    sums = whole.groupBy(*keys).agg(*(F.sum(F.col(names[i]) * F.col(names[j])).cast("double").alias(f"_s{k}") for k, (i, j) in enumerate(pairs)))
    kinds = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields), "alpha double, feature string, coefficient double"])

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            g = np.zeros((len(batch), len(names), len(names)))
            for k, (i, j) in enumerate(pairs):
                g[:, i, j] = g[:, j, i] = batch[f"_s{k}"].to_numpy()
            found, each = solve(g, alphas), len(alphas) * (1 + len(predictors))
            out = batch[keys].loc[batch.index.repeat(each)].reset_index(drop=True)
            out["alpha"] = np.tile(np.repeat(alphas, 1 + len(predictors)), len(batch))
            out["feature"] = ["intercept", *predictors] * (len(alphas) * len(batch))
            out["coefficient"] = found.ravel()
            yield out

    return sums.mapInPandas(fit, kinds)


def ar_rows(frames: DataFrame, p: int) -> DataFrame:
    """The design of an autoregression: each hour's level with the ``p`` before it; missing hours drop their rows."""
    w = Window.partitionBy("station_id").orderBy("ts")
    lags = {f"l{k}": F.lag("water_level", k).over(w) for k in range(1, p + 1)}
    return frames.select("station_id", "ts", "water_level", *(c.alias(n) for n, c in lags.items())).filter(" and ".join(f"{n} is not null" for n in ["water_level", *lags]))


def recursive(origins: DataFrame, level: str, intercept, slope, horizon: int) -> DataFrame:
    """First-order recursion as one array expression for each issue row: sequential in the horizon, parallel in the rows."""
    step = lambda a, _: F.struct(F.concat(a["out"], F.array(intercept + slope * a["last"])).alias("out"), (intercept + slope * a["last"]).alias("last"))
    start = F.struct(F.array().cast("array<double>").alias("out"), F.col(level).cast("double").alias("last"))
    return origins.withColumn("path", F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, step, lambda a: a["out"]))


def recursive_levels(windows: DataFrame, coefficients: dict[str, float], lags: list[int], horizon: int) -> DataFrame:
    """``(station_id, ts, path)`` from ``(station_id, ts, w)``, trailing windows of levels: each step appends its own
    forecast and rebuilds the lags from it; all rows of a batch move together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            w = np.stack(batch["w"].to_numpy()) if len(batch) else np.zeros((0, max(lags) + 1))
            for _ in range(horizon):
                following = coefficients["intercept"] + sum(coefficients[f"l{k}"] * w[:, -k] for k in lags)
                w = np.concatenate([w, following[:, None]], axis=1)
            yield pd.DataFrame({"station_id": batch["station_id"], "ts": batch["ts"], "path": list(w[:, -horizon:])})

    return windows.mapInPandas(run, "station_id string, ts timestamp_ntz, path array<double>")
