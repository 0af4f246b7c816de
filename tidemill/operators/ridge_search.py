"""Ridge over feature subsets, penalties, transforms and expanding folds: one pass of sums fits all of them, one pass of rows scores them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.config import TARGET
from tidemill.operators import features as ft
from tidemill.plans.stored import stored

# base name of a column: the feature that it shows, and whether it takes log1p
COLUMNS = {
    "water_level": ("water_level", True), "imputed": ("imputed", False), "water_level_lag_24h": ("lag_24", True),
    "water_level_change_24h": ("change_24", False), "water_level_rolling_mean_24h": ("mean_24", True),
    "precipitation": ("precipitation", False), "temperature_2m": ("temperature_2m", False),
}
WEATHER = ("precipitation", "temperature_2m")
SUBSETS = {
    "full": lambda own, base: True,
    "all_station_hydrology_quality_time": lambda own, base: base not in WEATHER,
    "raw_all_stations": lambda own, base: base in ("water_level", "imputed", *WEATHER),
    "target_station_full": lambda own, base: own,
    "target_station_hydrology_quality_time": lambda own, base: own and base not in WEATHER,
    "current_water_levels_all_stations": lambda own, base: base == "water_level",
}
WITH_WEATHER = ("full", "raw_all_stations", "target_station_full")
ALPHAS = (0.1, 1.0, 10.0, 100.0, 1000.0)


def bases(weather: bool) -> list[str]:
    return [b for b in COLUMNS if weather or b not in WEATHER]


def design(spark: SparkSession, sf_dir: str, weather: bool) -> tuple[DataFrame, list[tuple[str, str]]]:
    """``(ts, pos, n, x, y)`` of the target's training cohort where every column of every station has a value, and the
    ``(station, base)`` of each place of ``x``. ``y`` holds the levels of all horizons. Without ``weather`` its columns are left
    out, so hours that miss it stay: subsets with weather meet one cohort, those without it another."""
    f = ft.featured(spark, sf_dir, horizons=ft.EVERY).filter("split = 'train'")
    rows = ft.cohort(f).filter(F.col("station_id") == TARGET).select("ts", F.array(*(f"t{h}" for h in ft.EVERY)).alias("y"))
    stations = sorted(r[0] for r in f.select("station_id").distinct().collect())  # the stations of the joined frame: a handful
    values = f.select("station_id", "ts", F.array(*(F.col(c).cast("double") for c, _ in (COLUMNS[b] for b in bases(weather)))).alias("v"))
    values = values.filter(~F.exists("v", lambda v: v.isNull()))
    whole = values.join(rows, "ts").groupBy("ts").agg(F.sort_array(F.collect_list(F.struct("station_id", "v"))).alias("all"), F.any_value("y").alias("y"))
    whole = whole.filter(F.size("all") == len(stations))
    whole = stored(whole, "ridge-hours")
    # places come from the bare hours of one station; the vectors don't pass through the one task that orders them
    hours = whole.select("ts").withColumns({"pos": (F.row_number().over(Window.orderBy("ts")) - 1).cast("long"), "n": F.count("*").over(Window.partitionBy())})
    return whole.join(hours, "ts").select("ts", "pos", "n", F.flatten("all.v").alias("x"), "y"), [(s, b) for s in stations for b in bases(weather)]


def _bounds(rows: DataFrame) -> list:
    """The folds: as many rows as there are folds, whatever the number of hours."""
    return rows.agg(F.max("n").alias("n")).filter("n is not null").select(F.explode(ft.fold_bounds(F.col("n"))).alias("f")).select("f.*").orderBy("fold").collect()


def _transformed(batch: pd.DataFrame, logged: np.ndarray, log: bool) -> tuple[np.ndarray, np.ndarray]:
    x, y = (np.stack(batch[c].to_numpy()).astype(float) for c in ("x", "y"))
    return (np.where(logged, np.log1p(np.where(logged, x, 0)), x), np.log1p(y)) if log else (x, y)


def segment_sums(rows: DataFrame, cuts: list[int], logged: np.ndarray) -> DataFrame:
    """``(segment, log, place, s)``: the products of (1, x, y) with one another, summed over the rows between two cuts.

    Each batch is summed where it lies, so a partition sends a matrix per segment, however many rows it has. Segments add up to the training rows of any fold.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple[int, bool], np.ndarray] = {}
        for batch in batches:
            if not len(batch):
                continue
            segment = np.searchsorted(cuts, batch["pos"].to_numpy(), side="right")
            for log in (False, True):
                z = np.hstack([np.ones((len(batch), 1)), *_transformed(batch, logged, log)])
                for k in np.unique(segment):
                    part = z[segment == k]
                    held[k, log] = held.get((k, log), 0) + part.T @ part
        for (k, log), m in held.items():
            yield pd.DataFrame({"segment": int(k), "log": log, "place": np.arange(m.size), "s": m.ravel()})

    each = rows.select("pos", "x", "y").mapInPandas(run, "segment long, log boolean, place long, s double")
    return each.groupBy("segment", "log", "place").agg(F.sum("s").alias("s"))


def fitted(m: np.ndarray, members: np.ndarray, p: int, alpha: float) -> np.ndarray:
    """Intercept and coefficients (one column a horizon) on ``members`` of the ``p`` predictors, from the sums ``m``. Predictors
    are scaled by their deviation in the same rows; constant ones get 0 and the intercept isn't penalised."""
    n, at = m[0, 0], 1 + members
    y = np.arange(1 + p, len(m))
    mean, mean_y = m[0, at] / n, m[0, y] / n
    cov = m[np.ix_(at, at)] - n * np.outer(mean, mean)
    cross = m[np.ix_(at, y)] - n * np.outer(mean, mean_y)
    spread = np.sqrt(np.maximum(np.diag(cov), 0) / n)
    live = spread > 1e-6 * np.maximum(np.abs(mean), 1)
    scale = np.where(live, spread, 1)
    a = cov / np.outer(scale, scale) * np.outer(live, live) + alpha * np.eye(len(at))
    b = np.linalg.solve(a, cross / scale[:, None] * live[:, None]) / scale[:, None]
    return np.vstack([mean_y - mean @ b, b])


def trained(sums: DataFrame, bounds: list, cuts: list[int], members: dict[str, np.ndarray], p: int) -> DataFrame:
    """``(fold, log, subset, alpha, w)``: every candidate of every fold, solved in one task for each fold and scale. A fold's sums are
    those of the segments before its end; a task holds one matrix, whose size comes from the columns and horizons alone."""
    size = 1 + p + len(ft.EVERY)
    ends = F.array(*(F.struct(F.lit(b["fold"]).cast("long").alias("fold"), F.lit(cuts.index(b["train_end"])).cast("long").alias("last")) for b in bounds))
    own = sums.withColumn("f", F.explode(ends)).filter("segment <= f.last").groupBy("f.fold", "log", "place").agg(F.sum("s").alias("s"))

    def solve(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        m = np.zeros((size, size))
        m.flat[group["place"].to_numpy()] = group["s"].to_numpy()
        rows = [(*key, subset, alpha, fitted(m, at, p, alpha).tobytes()) for subset, at in members.items() for alpha in ALPHAS]
        return pd.DataFrame(rows, columns=["fold", "log", "subset", "alpha", "w"])

    return own.groupBy("fold", "log").applyInPandas(solve, "fold long, log boolean, subset string, alpha double, w binary")


def _search(spark: SparkSession, sf_dir: str, weather: bool, keep) -> DataFrame:
    rows, names = design(spark, sf_dir, weather)
    rows = keep(rows)
    p = len(names)
    logged = np.array([COLUMNS[b][1] for _, b in names])
    members = {s: np.array([k for k, (station, base) in enumerate(names) if rule(station == TARGET, base)]) for s, rule in SUBSETS.items() if (s in WITH_WEATHER) == weather}
    bounds = [b for b in _bounds(rows) if b["train_end"] > 1 and b["val_end"] > b["val_start"]]
    models = []
    if bounds:
        cuts = sorted({b["train_end"] for b in bounds})
        spans = {b["fold"]: (b["val_start"], b["val_end"]) for b in bounds}
        solved = trained(segment_sums(rows, cuts, logged), bounds, cuts, members, p).collect()  # 24 coefficients of each predictor and candidate
        models = [(r["fold"], *spans[r["fold"]], r["log"], r["subset"], r["alpha"], np.frombuffer(r["w"]).reshape(-1, len(ft.EVERY))) for r in solved]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pos, found = batch["pos"].to_numpy(), []
            for fold, lo, hi, log, subset, alpha, w in models:
                part = batch[(pos >= lo) & (pos < hi)]
                if len(part):
                    x, y = _transformed(part, logged, log)[0][:, members[subset]], np.stack(part["y"].to_numpy())
                    guess = w[0] + x @ w[1:]
                    e = (np.expm1(guess) if log else guess) - y
                    found.append((subset, alpha, log, fold, e.size, np.abs(e).sum(), (e * e).sum()))
            yield pd.DataFrame(found, columns=["subset", "alpha", "log1p", "fold", "n", "a", "q"])

    errors = rows.select("pos", "x", "y").mapInPandas(run, "subset string, alpha double, log1p boolean, fold long, n long, a double, q double")
    total = errors.groupBy("subset", "alpha", "log1p", "fold").agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("q").alias("q"))
    return total.select("subset", "alpha", "log1p", "fold", "n", (F.col("a") / F.col("n")).alias("mae"), F.sqrt(F.col("q") / F.col("n")).alias("rmse"))


def search(spark: SparkSession, sf_dir: str, keep=lambda df: df) -> DataFrame:
    """``(subset, alpha, log1p, fold, n, mae, rmse)`` of every candidate on every fold, over all horizons at once.

    ``keep`` writes the designs, which are read twice. Coefficients alone pass through the driver, 24 of each predictor and
    candidate (2 MB for five stations, so this form suits some hundreds of stations). Folds too short to train or to validate give no rows.
    """
    return _search(spark, sf_dir, True, keep).unionByName(_search(spark, sf_dir, False, keep))
