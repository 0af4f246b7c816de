"""Leakage-safe features, targets, cohort and folds on gap-filled station frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.config import CHANGES, EMBARGO, FOLDS, HORIZON, INITIAL_FRACTION, LAGS, TARGET, TEST_FRACTION, WINDOWS
from tidemill.operators.grid import gap_filled
from tidemill.sources.readings import readings, weather

def own():
    """The order of a station's hours; no window crosses the split."""
    return Window.partitionBy("station_id", "split").orderBy("ts")
NUDGE = 1e-9  # before rounding, so that exact halves fall alike whatever the order of summation
EVERY = range(1, HORIZON + 1)


def station_frames(spark: SparkSession, sf_dir: str, kind: str = "dense") -> DataFrame:
    """Gap-filled levels with weather: a left join, so hours without weather stay."""
    return gap_filled(readings(spark, sf_dir, kind)).join(weather(spark, sf_dir), ["station_id", "ts"], "left")


def boundary(frames: DataFrame, target: str = TARGET, fraction: float = TEST_FRACTION) -> DataFrame:
    """One row with the last training hour: the target's ``floor((1 - fraction) * n)``-th. Its grid has no holes, so the hour follows
    from the first hour and the count, without sorting."""
    own = frames.filter(F.col("station_id") == target)
    return own.agg(F.min("ts").alias("lo"), F.count("*").alias("n")).select(F.expr(f"lo + make_interval(0, 0, 0, 0, CAST(floor(n * {1 - fraction}D) AS INT) - 1)").alias("boundary"))


def split(frames: DataFrame, target: str = TARGET, fraction: float = TEST_FRACTION) -> DataFrame:
    """``split``: train up to the target's boundary, test after it, for all stations."""
    return frames.crossJoin(F.broadcast(boundary(frames, target, fraction))).withColumn("split", F.when(F.col("ts") <= F.col("boundary"), "train").otherwise("test")).drop("boundary")


def lag(k: int):
    return F.lag("water_level", k).over(own())


def complete(agg, col: str, w: int):
    """``agg`` over the ``w`` hours up to now, null unless all of them have a value."""
    frame = own().rowsBetween(-(w - 1), 0)
    return F.when(F.count(col).over(frame) == w, F.round(agg(F.col(col)).over(frame), 6))


def imputed_count(w: int):
    frame = own().rowsBetween(-(w - 1), 0)
    return F.when(F.count("*").over(frame) == w, F.sum(F.col("imputed").cast("int")).over(frame).cast("double"))


def eligible(horizon: int = HORIZON):
    """All of the next ``horizon`` hours are observed: present and not imputed."""
    return F.count_if(F.col("water_level").isNotNull() & ~F.col("imputed")).over(own().rowsBetween(1, horizon)) == horizon


def feature_columns() -> dict:
    """Every predictor and the target gate; one select evaluates all of them over one sort."""
    out = {f"lag_{k}": lag(k) for k in LAGS} | {f"change_{k}": F.col("water_level") - lag(k) for k in CHANGES}
    for w in WINDOWS:
        out |= {f"mean_{w}": complete(F.avg, "water_level", w), f"std_{w}": complete(F.stddev_pop, "water_level", w), f"min_{w}": complete(F.min, "water_level", w), f"max_{w}": complete(F.max, "water_level", w)}
        out |= {f"imputed_count_{w}": imputed_count(w), f"precipitation_{w}": complete(F.sum, "precipitation", w), f"temperature_mean_{w}": complete(F.avg, "temperature_2m", w)}
    out |= {"temperature_min_24": complete(F.min, "temperature_2m", 24), "temperature_max_24": complete(F.max, "temperature_2m", 24), "target_valid": eligible()}
    return out


def feature_names() -> list[str]:
    """The names of ``feature_columns``, which need no session."""
    levels = [f"{n}_{w}" for w in WINDOWS for n in ("mean", "std", "min", "max", "imputed_count", "precipitation", "temperature_mean")]
    return [*(f"lag_{k}" for k in LAGS), *(f"change_{k}" for k in CHANGES), *levels, "temperature_min_24", "temperature_max_24", "target_valid"]


def targets(horizons=EVERY) -> dict:
    return {f"t{h}": F.lead("water_level", h).over(own()) for h in horizons}


def forward_targets(horizon: int = HORIZON) -> dict:
    """All targets, null unless every one of them is observed. Names carry the hour with two digits or more."""
    digits = max(2, len(str(horizon)))
    return {f"target_t_plus_{h:0{digits}d}": F.when(eligible(horizon), F.lead("water_level", h).over(own())) for h in range(1, horizon + 1)}


def featured(spark: SparkSession, sf_dir: str, kind: str = "dense", horizons=EVERY) -> DataFrame:
    frames = split(station_frames(spark, sf_dir, kind))
    return frames.select("*", *(c.alias(n) for n, c in (feature_columns() | targets(horizons)).items()))


def cohort(features: DataFrame) -> DataFrame:
    """Issue times with valid targets and complete level predictors. Weather is too sparse in the test tables to ask for."""
    return features.filter("target_valid and water_level is not null and lag_72 is not null and mean_72 is not null")


def target_cohort(features: DataFrame, target: str = TARGET) -> DataFrame:
    """The target's cohort with each row's position and the number of rows in its split."""
    own = Window.partitionBy("station_id", "split")
    rows = cohort(features).filter(F.col("station_id") == target)
    return rows.withColumns({"pos": (F.row_number().over(own.orderBy("ts")) - 1).cast("long"), "n": F.count("*").over(own)})


def fold_bounds(n, folds: int = FOLDS, initial: float = INITIAL_FRACTION, embargo: int = EMBARGO):
    """An array of ``(fold, train_end, val_start, val_end)`` (ends exclusive) for ``n`` rows: expanding, with an embargo, anchored at the end."""
    size = F.floor((n - F.floor(n * F.lit(float(initial))) - embargo) / folds)
    bound = lambda i: F.struct(i.cast("long").alias("fold"), (n - (folds - i) * size - embargo).cast("long").alias("train_end"), (n - (folds - i) * size).cast("long").alias("val_start"), (n - (folds - 1 - i) * size).cast("long").alias("val_end"))
    return F.transform(F.sequence(F.lit(0), F.lit(folds - 1)), bound)


def forecasts(cohort_: DataFrame, horizons=EVERY) -> DataFrame:
    """``(issue_ts, split, horizon, actual, model, prediction)``: persistence and a fixed linear rule, in long form."""
    linear = 0.6 * F.col("water_level") + 0.3 * F.col("mean_24") + 0.1 * F.col("lag_24")
    each = F.array(*(F.struct(F.lit(h).cast("long").alias("horizon"), F.col(f"t{h}").alias("actual")) for h in horizons))
    both = F.array(F.struct(F.lit("persistence").alias("model"), F.col("water_level").alias("prediction")), F.struct(F.lit("linear").alias("model"), linear.alias("prediction")))
    rows = cohort_.select(F.col("ts").alias("issue_ts"), "split", F.explode(each).alias("a"), both.alias("b")).select("issue_ts", "split", "a", F.explode("b").alias("b"))
    return rows.select("issue_ts", "split", "a.*", "b.*")


def metrics() -> list:
    """Count, MAE, RMSE, mean error (prediction - actual) and 1 - SSE/SST, rounded, as aggregates."""
    error = F.col("prediction") - F.col("actual")
    squares, spread = F.sum(error * error), F.count("*") * F.var_pop("actual")
    r2 = F.when(F.var_pop("actual") == 0, F.when(squares == 0, 1.0).otherwise(0.0)).otherwise(1 - squares / spread)
    return [F.count("*").alias("n"), *(F.round(x + NUDGE, 6).alias(n) for n, x in (("mae", F.avg(F.abs(error))), ("rmse", F.sqrt(F.avg(error * error))), ("me", F.avg(error)), ("r2", r2)))]
