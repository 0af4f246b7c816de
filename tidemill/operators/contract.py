"""The feature contract: every predictor of every station under its full name, in one order, with its subsets and its gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.config import CHANGES, LAGS, WINDOWS
from tidemill.functions.calendar import utc_calendar

WEATHER = ("precipitation", "temperature_2m")
CALENDAR = [f"{n}_{k}" for n in ("hour", "weekday", "year") for k in ("sin", "cos")]


def base_columns() -> dict[str, str]:
    """Base name of each predictor of a station, in contract order, and the feature column that holds it."""
    out = {"water_level": "water_level", "imputed": "imputed"} | {w: w for w in WEATHER}
    out |= {f"water_level_lag_{k}h": f"lag_{k}" for k in LAGS} | {f"water_level_change_{k}h": f"change_{k}" for k in CHANGES}
    for w in WINDOWS:
        out |= {f"water_level_rolling_{s}_{w}h": f"{s}_{w}" for s in ("mean", "std", "min", "max")}
    out |= {f"imputed_count_{w}h": f"imputed_count_{w}" for w in WINDOWS} | {f"precipitation_rolling_sum_{w}h": f"precipitation_{w}" for w in WINDOWS}
    out |= {f"temperature_2m_rolling_mean_{w}h": f"temperature_mean_{w}" for w in WINDOWS} | {f"temperature_2m_rolling_{s}_24h": f"temperature_{s}_24" for s in ("min", "max")}
    return out | {f"utc_{c}": c for c in CALENDAR}


def hydrology(base: Column) -> Column:
    """Levels, quality flags and time: everything but the weather."""
    return base.isin("water_level", "imputed") | base.startswith("water_level_") | base.startswith("imputed_count_") | base.startswith("utc_")


def subsets_of(own: Column, base: Column) -> Column:
    """The names of the six ablation subsets that a column belongs to, by its station and base name alone."""
    rules = {
        "full": F.lit(True), "all_station_hydrology_quality_time": hydrology(base), "raw_all_stations": base.isin("water_level", "imputed", *WEATHER), "target_station_full": own,
        "target_station_hydrology_quality_time": own & hydrology(base), "current_water_levels_all_stations": base == "water_level",
    }
    return F.array_compact(F.array(*(F.when(rule, name) for name, rule in rules.items())))


def long_predictors(features: DataFrame) -> DataFrame:
    """``(station_id, ts, split, place, base, value)`` of every predictor of ``features``, as numbers; ``place`` is that within a station."""
    rows = features.select("*", *utc_calendar("ts"))
    each = F.array(*(F.struct(F.lit(k).alias("place"), F.lit(b).alias("base"), F.col(c).cast("double").alias("value")) for k, (b, c) in enumerate(base_columns().items())))
    return rows.select("station_id", "ts", "split", F.explode(each).alias("p")).select("station_id", "ts", "split", "p.*")


def contract(features: DataFrame, target: str) -> DataFrame:
    """``(subset, place, column_name, n, n_null)``: the ordered columns of each subset, ``place`` counted from 1 within it, and how many
    hours of ``features`` have or lack a value."""
    found = long_predictors(features).groupBy("station_id", F.col("place").alias("at"), "base").agg(F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("n_null"))
    named = found.select("station_id", "at", F.explode(subsets_of(F.col("station_id") == target, F.col("base"))).alias("subset"), F.concat("station_id", F.lit("__"), "base").alias("column_name"), "n", "n_null")
    place = F.row_number().over(Window.partitionBy("subset").orderBy("station_id", "at")).cast("long")  # as many rows as the contract has columns
    return named.select("subset", place.alias("place"), "column_name", "n", "n_null")


class ContractMismatch(ValueError):
    """A frame's columns aren't those of a contract."""


def require_columns(columns: list[str], expected: list[str]) -> None:
    """Refuses frames whose predictors are malformed, repeated, missing, unknown or in another order."""
    if malformed := [c for c in columns if not all(c.partition("__"))]:
        raise ContractMismatch(f"not of the form station__feature: {malformed}")
    if len(set(columns)) < len(columns):
        raise ContractMismatch(f"repeated: {sorted({c for c in columns if columns.count(c) > 1})}")
    if missing := [c for c in expected if c not in set(columns)]:
        raise ContractMismatch(f"missing: {missing}")
    if unknown := [c for c in columns if c not in set(expected)]:
        raise ContractMismatch(f"unknown: {unknown}")
    if columns != expected:
        raise ContractMismatch(f"in another order from {next(c for c, e in zip(columns, expected) if c != e)} on")


def null_families(features: DataFrame, most: int = 10) -> DataFrame:
    """``(split, family, n_null)``: missing values by family (a base name without its hours) over all stations, the ``most`` largest of
    each split."""
    family = F.regexp_replace("base", r"_\d+h$", "")
    counts = long_predictors(features).groupBy("split", family.alias("family")).agg(F.count_if(F.col("value").isNull()).alias("n_null"))
    return counts.withColumn("_n", F.row_number().over(Window.partitionBy("split").orderBy(F.desc("n_null"), "family"))).filter(F.col("_n") <= most).drop("_n")


def monthly_matrix(frames: DataFrame, eligible: DataFrame, target: str) -> DataFrame:
    """``(row_name, month, percent)``: of the target's hours of each month, how many each station observed, and, as ``eligible rows``, how
    many ``eligible(ts)`` names. Months are those of the calendar from the first to the last, years apart, none left out;
    a month without hours of the target has null."""
    month = lambda c: F.date_trunc("month", c).cast("date")
    hours = frames.filter(F.col("station_id") == target).select("ts", month("ts").alias("month"))
    all_hours = hours.groupBy("month").agg(F.count("*").alias("hours"))
    months = hours.agg(F.min("month").alias("lo"), F.max("month").alias("hi")).filter("lo is not null").select(F.explode(F.expr("sequence(lo, hi, INTERVAL 1 MONTH)")).alias("month"))
    seen = frames.filter("water_level is not null and not imputed").join(hours, "ts").select(F.col("station_id").alias("row_name"), "month")
    seen = seen.unionByName(eligible.join(hours, "ts").select(F.lit("eligible rows").alias("row_name"), "month"))
    counted = seen.groupBy("row_name", "month").agg(F.count("*").alias("n"))
    names = frames.select(F.col("station_id").alias("row_name")).distinct().unionByName(months.limit(1).select(F.lit("eligible rows").alias("row_name")))
    every = names.crossJoin(F.broadcast(months)).join(all_hours, "month", "left").join(counted, ["row_name", "month"], "left")  # a row for each month of the calendar
    return every.select("row_name", "month", F.round(100.0 * F.coalesce("n", F.lit(0)) / F.col("hours"), 6).alias("percent"))
