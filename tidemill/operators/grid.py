"""Regular hourly grids, causal gap fill, runs and contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.config import MAX_GAP_HOURS, MIN_VALID_LEVEL



def hours_between(a, b):
    return F.timestamp_diff("HOUR", a, b)


def masked(readings: DataFrame, least: float = MIN_VALID_LEVEL) -> DataFrame:
    """Levels at or under ``least`` become missing."""
    return readings.withColumn("value", F.when(F.col("value") > least, F.col("value")))


def hourly_grid(readings: DataFrame) -> DataFrame:
    """``(station_id, ts, value, present)``: every hour from a station's first to its last reading.

    Each reading is followed by the hours up to the next one, so the grid needs one window and no join.
    """
    w = Window.partitionBy("station_id").orderBy("ts")
    spans = readings.withColumn("until", F.coalesce(F.lead("ts").over(w), F.expr("ts + INTERVAL 1 HOUR")))
    grid = spans.withColumn("h", F.explode(F.expr("sequence(ts, until - INTERVAL 1 HOUR, INTERVAL 1 HOUR)")))
    first = F.col("h") == F.col("ts")
    return grid.select("station_id", F.col("h").alias("ts"), F.when(first, F.col("value")).alias("value"), first.alias("present"))


def gap_filled(readings: DataFrame, max_gap: int = MAX_GAP_HOURS, least: float = MIN_VALID_LEVEL) -> DataFrame:
    """``(station_id, ts, water_level, imputed)`` on the hourly grid of each station's raw readings.

    Levels at or under ``least`` count as missing. A gap between two levels, of at most ``max_gap`` hours as a whole, takes
    the last level before it; longer, leading and trailing gaps stay null. All window columns share one sort of
    the readings; the grid comes from exploding each reading up to the next.
    """
    w = Window.partitionBy("station_id").orderBy("ts")
    level = F.when(F.col("value") > least, F.col("value"))
    seen = readings.withColumn("level", level).select(
        "station_id", "ts", "level",
        F.coalesce(F.lead("ts").over(w), F.expr("ts + INTERVAL 1 HOUR")).alias("until"),
        F.last("level", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("held"),
        F.last(F.when(F.col("level").isNotNull(), F.col("ts")), True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("since"),
        F.first(F.when(F.col("level").isNotNull(), F.col("ts")), True).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("next"),
    )
    grid = seen.withColumn("h", F.explode(F.expr("sequence(ts, until - INTERVAL 1 HOUR, INTERVAL 1 HOUR)")))
    observed = (F.col("h") == F.col("ts")) & F.col("level").isNotNull()
    fills = ~observed & (hours_between(F.col("since"), F.col("next")) - 1 <= max_gap)
    fills = F.coalesce(fills, F.lit(False))
    return grid.select("station_id", F.col("h").alias("ts"), F.when(observed | fills, F.col("held")).alias("water_level"), fills.alias("imputed"))


def runs(flagged: DataFrame, flag: str, keys: list[str]) -> DataFrame:
    """Maximal runs of equal ``flag`` on a dense grid: ``(keys, flag, start_ts, end_ts, hours)``."""
    w = Window.partitionBy(*keys).orderBy("ts")
    changes = flagged.withColumn("_change", F.coalesce((F.col(flag) != F.lag(flag).over(w)).cast("int"), F.lit(0)))
    marked = changes.withColumn("_run", F.sum("_change").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_run", flag).agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("hours")).drop("_run")


def grid_contract(frame: DataFrame) -> DataFrame:
    """Per station whether its hours are unique, contiguous and whole; one aggregate."""
    n, span = F.count("*"), hours_between(F.min("ts"), F.max("ts")) + 1
    return frame.groupBy("station_id").agg(n.alias("n_rows"), F.count_distinct("ts").alias("n_hours"), span.alias("span_hours"), F.bool_and(F.col("ts") == F.date_trunc("HOUR", "ts").cast("timestamp_ntz")).alias("whole_hours")).withColumn("ok", (F.col("n_rows") == F.col("n_hours")) & (F.col("n_rows") == F.col("span_hours")) & F.col("whole_hours"))
