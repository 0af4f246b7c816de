"""Statistics that take more than one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.functions.stationarity import autocorrelation, autocovariances


def average_rank(over_keys: list[str], column: str):
    """Rank among rows of equal keys, ties sharing the average of their places."""
    by = Window.partitionBy(*over_keys)
    return F.rank().over(by.orderBy(column)) + (F.count("*").over(Window.partitionBy(*over_keys, column)) - 1) / 2


def spearman(pairs: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """``(keys, n, rho)`` over complete pairs."""
    whole = pairs.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = whole.select(*keys, average_rank(keys, x).alias("rx"), average_rank(keys, y).alias("ry"))
    return ranked.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.corr("rx", "ry"), 6).alias("rho"))


def histogram(rows: DataFrame, keys: list[str], column: str, bins: int) -> DataFrame:
    """``(keys, bin, n)`` over equal-width bins between the keys' least and greatest value, all bins present, the last one closed.
    A constant column spreads over half a unit to either side."""
    ends = rows.groupBy(*keys).agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    flat = F.col("lo") == F.col("hi")
    ends = ends.filter("lo is not null").select(*keys, F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    place = F.least(F.floor((F.col(column) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)).cast("long")
    counted = rows.filter(F.col(column).isNotNull()).join(ends, keys).groupBy(*keys, place.alias("bin")).agg(F.count("*").alias("n"))
    skeleton = ends.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    return skeleton.join(counted, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def autocorrelations(series: DataFrame, lags: int) -> DataFrame:
    """``(lag, rho, n)`` of ``(i, x)``, autocovariances with the full n below."""
    one = series.withColumn("series", F.lit(1))
    return autocorrelation(autocovariances(one, ["series"], lags), ["series"]).select("lag", "rho", "n")
