"""Grids of autoregressive orders for every station and fold, from one aggregate of products of levels and their lags.

Every order (p, d) is linear in the same eight levels, so one matrix of sums per station and segment of the training hours
serves all of them: segments add up to folds, and each order's normal equations are a fixed linear map of the sums. Fits
that can't be solved stay, with a status and its reason, as does every order with a forecast that isn't finite.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.config import FOLDS, HORIZON
from tidemill.operators import features as ft

DEPTH = 7  # lags of the design: six of a differenced series reach seven levels back
ORDERS = [(p, 0) for p in range(1, 7)] + [(p, 1) for p in range(7)]  # level models have an intercept, differenced ones don't
Z = ["one", "y", *(f"l{k}" for k in range(1, DEPTH + 1))]
PAIRS = [(i, j) for i in range(len(Z)) for j in range(i, len(Z))]
LEAST_EIGENVALUE = 1e-10  # of a fit's correlations; below, the fit counts as singular


def placed(frames: DataFrame) -> DataFrame:
    """``(station_id, ts, y, pos, n)``: observed levels (imputed ones count as missing) with each hour's place on the station's grid."""
    own = Window.partitionBy("station_id")
    y = F.when(~F.col("imputed"), F.col("water_level").cast("double"))
    return frames.select("station_id", "ts", y.alias("y"), (F.row_number().over(own.orderBy("ts")) - 1).cast("long").alias("pos"), F.count("*").over(own).alias("n"))


def bounds(n) -> F.Column:
    """Folds of ``n`` hours, an empty array where they would hold no hour."""
    found = ft.fold_bounds(n)
    return F.filter(found, lambda b: (b["val_end"] > b["val_start"]) & (b["train_end"] > 0))


def fold_sums(hours: DataFrame) -> DataFrame:
    """``(station_id, fold, n, s0, s1, ...)`` for every station and fold: the sums of PAIRS over the hours before the fold's first
    validation hour that have all levels of the design."""
    w = Window.partitionBy("station_id").orderBy("ts")
    lags = [F.lag("y", k).over(w).alias(f"l{k}") for k in range(1, DEPTH + 1)]
    rows = hours.select("station_id", "y", "pos", "n", *lags)
    rows = rows.withColumns({"one": F.lit(1.0), "segment": F.size(F.filter(bounds(F.col("n")), lambda b: b["val_start"] <= F.col("pos")))})
    whole = rows.filter(" and ".join(f"{c} is not null" for c in Z[1:])).filter(F.col("segment") < FOLDS)
    sums = whole.groupBy("station_id", "segment").agg(*(F.sum(F.col(Z[i]) * F.col(Z[j])).alias(f"s{k}") for k, (i, j) in enumerate(PAIRS)))
    # a segment trains its own fold and all later ones; these rows are sums already, at most one for each station and fold
    each = sums.withColumn("fold", F.explode(F.sequence(F.col("segment"), F.lit(FOLDS - 1)))).groupBy("station_id", "fold").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(len(PAIRS))))
    stations = hours.groupBy("station_id").agg(F.max("n").alias("hours")).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1)))).withColumn("usable", F.size(bounds(F.col("hours"))) == FOLDS)
    return stations.join(each, ["station_id", "fold"], "left").fillna(0.0, [f"s{k}" for k in range(len(PAIRS))])


def design(p: int, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The columns of an order's regression and its target, as combinations of Z."""
    unit = np.eye(len(Z))
    if d:
        return np.array([unit[1 + k] - unit[2 + k] for k in range(1, p + 1)]).reshape(p, len(Z)).T, unit[1] - unit[2]
    return np.array([unit[0], *(unit[1 + k] for k in range(1, p + 1))]).T, unit[1]


def solved(g: np.ndarray, p: int, d: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Coefficients, residual variances and reasons of failure (empty: none) of a stack of sums."""
    x, t = design(p, d)
    k, n = x.shape[1], g[:, 0, 0]
    a, b, square = np.einsum("ia,nij,jc->nac", x, g, x), np.einsum("ia,nij,j->na", x, g, t), np.einsum("i,nij,j->n", t, g, t)
    scale = np.sqrt(np.maximum(np.einsum("nii->ni", a), 0))
    safe = np.where(scale > 0, scale, 1)
    near = a / safe[:, :, None] / safe[:, None, :]
    least = np.linalg.eigvalsh(near)[:, 0] if k else np.ones(len(g))
    short = n <= k + 1
    singular = ~short & ((least < LEAST_EIGENVALUE) | (scale <= 0).any(axis=1))
    fine = ~short & ~singular
    out = np.full((len(g), k), np.nan)
    if k and fine.any():
        out[fine] = np.linalg.solve(near[fine], (b / safe)[fine][:, :, None])[:, :, 0] / safe[fine]
    with np.errstate(all="ignore"):
        rest = np.where(fine, np.maximum(square - np.nansum(out * b, axis=1), 0) / np.where(fine, n - k, 1), np.nan)
    return out, rest, ["too few rows" if s else "singular" if q else "" for s, q in zip(short, singular)]


def level_form(coefficients: np.ndarray, p: int, d: int) -> np.ndarray:
    """The same fits as an intercept and the coefficients of the last DEPTH levels."""
    out = np.zeros((len(coefficients), 1 + DEPTH))
    if d:
        out[:, 1] = 1
        out[:, 1 : 1 + p] += coefficients
        out[:, 2 : 2 + p] -= coefficients
    else:
        out[:, : 1 + p] = coefficients
    return out


def fits(hours: DataFrame) -> DataFrame:
    """``(station_id, fold, p, d, n, status, reason, coefficients, level, variance)``: all ORDERS of every station and fold. ``level`` holds
    the fit as intercept and coefficients of the last levels; a failed fit has neither."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            g = np.zeros((len(batch), len(Z), len(Z)))
            for k, (i, j) in enumerate(PAIRS):
                g[:, i, j] = g[:, j, i] = batch[f"s{k}"].to_numpy()
            usable = batch["usable"].to_numpy()
            for p, d in ORDERS:
                found, variance, reasons = solved(g, p, d)
                reasons = [r if u else "too few hours" for r, u in zip(reasons, usable)]
                level = level_form(found, p, d)
                yield pd.DataFrame({
                    "station_id": batch["station_id"], "fold": batch["fold"].astype("int64"), "p": p, "d": d, "n": g[:, 0, 0].astype(np.int64), "status": ["failed" if r else "ok" for r in reasons], "reason": [r or None for r in reasons],
                    "coefficients": [None if r else c.tolist() for c, r in zip(found, reasons)], "level": [None if r else c.tolist() for c, r in zip(level, reasons)], "variance": [None if r else v for v, r in zip(variance, reasons)],
                })

    return fold_sums(hours).mapInPandas(run, "station_id string, fold long, p int, d int, n long, status string, reason string, coefficients array<double>, level array<double>, variance double")


def scored(hours: DataFrame, fitted: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """``(station_id, fold, p, d, issues, mae, rmse, finite)``: recursive forecasts from every validation hour with complete levels before
    and after it, by the fits of its fold. All orders of a batch of hours move together."""
    w = Window.partitionBy("station_id").orderBy("ts")
    rows = hours.select("station_id", "pos", "n", F.collect_list("y").over(w.rowsBetween(1 - DEPTH, 0)).alias("w"), F.collect_list("y").over(w.rowsBetween(1, horizon)).alias("actual"))
    rows = rows.filter((F.size("w") == DEPTH) & (F.size("actual") == horizon))
    rows = rows.withColumn("f", F.explode(bounds(F.col("n")))).filter("pos >= f.val_start and pos < f.val_end").select("station_id", "w", "actual", F.col("f.fold").alias("fold"))
    models = fitted.filter("status = 'ok'").groupBy("station_id", "fold").agg(F.collect_list(F.struct("p", "d", "level")).alias("models"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["station_id", "fold", "p", "d", "issues", "a", "q", "finite"]
        for batch in batches:
            out = []
            for (station, fold), part in batch.groupby(["station_id", "fold"]):
                windows, actual = np.stack(part["w"].to_numpy()), np.stack(part["actual"].to_numpy())
                orders = part["models"].iloc[0]
                c = np.array([m["level"] for m in orders])
                moving = np.repeat(windows[:, None, :], len(c), axis=1)
                total, squares, finite = np.zeros(len(c)), np.zeros(len(c)), np.ones(len(c), bool)
                with np.errstate(all="ignore"):
                    for step in range(horizon):
                        guess = c[:, 0] + np.einsum("nmk,mk->nm", moving[:, :, ::-1], c[:, 1:])
                        finite &= np.isfinite(guess).all(axis=0)
                        e = guess - actual[:, step : step + 1]
                        total, squares = total + np.abs(e).sum(axis=0), squares + (e * e).sum(axis=0)
                        moving = np.concatenate([moving[:, :, 1:], guess[:, :, None]], axis=2)
                out += [(station, int(fold), m["p"], m["d"], len(part), a, s, bool(f)) for m, a, s, f in zip(orders, total, squares, finite)]
            yield pd.DataFrame(out, columns=columns)

    each = rows.join(models, ["station_id", "fold"]).mapInPandas(run, "station_id string, fold long, p int, d int, issues long, a double, q double, finite boolean")
    total = each.groupBy("station_id", "fold", "p", "d").agg(F.sum("issues").alias("issues"), F.sum("a").alias("a"), F.sum("q").alias("q"), F.bool_and("finite").alias("finite"))
    n = F.col("issues") * horizon
    return total.select("station_id", "fold", "p", "d", "issues", (F.col("a") / n).alias("mae"), F.sqrt(F.col("q") / n).alias("rmse"), "finite")


def candidates(hours: DataFrame, keep=lambda df, name: df) -> DataFrame:
    """``(station_id, p, d, q, intercept, folds_ok, status, reason, mae_mean, mae_std, rmse_mean, rmse_std)``: one row for each station and
    order. A candidate is ok if every fold was fitted and scored; else it has no metrics, and the reason is that of its first failed fold."""
    fitted = keep(fits(hours), "fits")
    rows = fitted.drop("coefficients", "level", "variance").join(scored(hours, fitted), ["station_id", "fold", "p", "d"], "left")
    reason = F.coalesce("reason", F.when(F.col("issues").isNull(), "no issue to score"), F.when(~F.col("finite"), "forecast not finite"))
    rows = rows.withColumn("reason", reason)
    ok = F.count_if(F.col("reason").isNull())
    mean = lambda f, c: F.when(ok == FOLDS, f(c))
    return rows.groupBy("station_id", "p", "d", F.lit(0).alias("q"), (F.col("d") == 0).alias("intercept")).agg(
        ok.alias("folds_ok"), F.when(ok == FOLDS, "ok").otherwise("failed").alias("status"), F.min_by("reason", F.when(F.col("reason").isNotNull(), F.col("fold"))).alias("reason"),
        *(mean(f, m).alias(f"{m}_{n}") for m in ("mae", "rmse") for n, f in (("mean", F.avg), ("std", F.stddev_pop))),
    )
