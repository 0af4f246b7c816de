"""Autocorrelation, partial autocorrelation and tests of stationarity of many series at once, all from sums of lagged products."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WEEK = 168
ADF_LAGS = 12
# The asymptotic critical values at 5 percent of both tests with a constant.
ADF_CRITICAL, KPSS_CRITICAL = -2.8615, 0.463


def both_forms(series: DataFrame) -> DataFrame:
    """``(station_id, form, i, x)``: each series as its levels and its first differences, places counted from 1."""
    w = Window.partitionBy("station_id").orderBy("i")
    forms = F.array(F.struct(F.lit("level").alias("form"), F.col("i").alias("i"), F.col("x").alias("x")), F.struct(F.lit("difference").alias("form"), (F.col("i") - 1).alias("i"), F.col("dx").alias("x")))
    return series.withColumn("dx", F.col("x") - F.lag("x").over(w)).select("station_id", F.explode(forms).alias("f")).select("station_id", "f.*").filter("x is not null")


def autocovariances(series: DataFrame, keys: list[str], lags: int) -> DataFrame:
    """``(keys, n, g)``: ``g[k]`` is the sum of products of the centred series with itself ``k`` places before, divided by the full n;
    0 where a series is shorter.

    A row frame holds each value's last ones, so nothing is joined, and the products add up within tasks before they move.
    """
    own = Window.partitionBy(*keys)
    centred = series.select(*keys, "i", (F.col("x") - F.avg("x").over(own)).alias("c"))
    frame = own.orderBy("i").rowsBetween(-lags, 0)
    products = centred.withColumn("w", F.reverse(F.collect_list("c").over(frame))).select(*keys, "c", F.posexplode("w").alias("k", "d"))
    sums = products.groupBy(*keys, "k").agg(F.sum(F.col("c") * F.col("d")).alias("s"), F.count_if(F.col("k") == 0).alias("n"))
    packed = sums.groupBy(*keys).agg(F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("k", "s"))).alias("s"))
    return packed.select(*keys, "n", F.transform(F.sequence(F.lit(0), F.lit(lags)), lambda k: F.coalesce(F.try_element_at("s", k), F.lit(0.0)) / F.col("n")).alias("g"))


def autocorrelation(found: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, n, lag, rho)`` from ``autocovariances``; constant series have none."""
    rows = found.filter(F.col("g")[0] > 0).select(*keys, "n", F.posexplode("g").alias("lag", "v"), F.col("g")[0].alias("g0"))
    return rows.select(*keys, "n", F.col("lag").cast("long").alias("lag"), (F.col("v") / F.col("g0")).alias("rho"))


def partial_of(g: Column, lags: int) -> Column:
    """The partial autocorrelations at lags 0 to ``lags`` from an array of autocovariances, by the Levinson-Durbin recursion: its
    state (the coefficients of the last order, the residual variance and what came out) is folded over the orders."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    def step(s: Column, k: Column) -> Column:
        a = (F.get(g, k) - dot(s["phi"], F.reverse(F.slice(g, 2, k - 1)))) / s["v"]
        phi = F.concat(F.zip_with(s["phi"], F.reverse(s["phi"]), lambda x, y: x - a * y), F.array(a))
        return F.struct(phi.alias("phi"), (s["v"] * (1 - a * a)).alias("v"), F.concat(s["out"], F.array(a)).alias("out"))

    start = F.struct(F.array().cast("array<double>").alias("phi"), F.get(g, F.lit(0)).alias("v"), F.array(F.lit(1.0)).alias("out"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(lags)), start, step, lambda s: s["out"])


def kpss(series: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, n, lags, kpss)`` of each series around its mean: squared partial sums against the long-run variance with Bartlett
    weights, over the number of lags that the data suggest (Hobijn, Franses and Ooms, 1998), but no more than ``found`` holds:
    for series whose long-run variance nearly vanishes, such as over-differenced ones, that rule asks for nearly n."""
    own = Window.partitionBy(*keys)
    partial = series.select(*keys, "i", (F.col("x") - F.avg("x").over(own)).alias("c")).withColumn("s", F.sum("c").over(own.orderBy("i")))
    eta = partial.groupBy(*keys).agg(F.sum(F.col("s") * F.col("s")).alias("eta"))
    n = F.col("n")
    few = F.floor(F.pow(n.cast("double"), F.lit(2 / 9))).cast("int")
    s0 = F.col("g")[0] + 2 * F.aggregate(F.slice("g", 2, few), F.lit(0.0), lambda a, x: a + x)
    s1 = 2 * F.aggregate(F.transform(F.slice("g", 2, few), lambda x, k: x * (k + 1)), F.lit(0.0), lambda a, x: a + x)
    ratio = s1 / s0
    lags = F.least(F.floor(1.1447 * F.pow(ratio * ratio, F.lit(1 / 3)) * F.pow(n.cast("double"), F.lit(1 / 3))), n - 1, F.size("g") - 1).cast("int")
    long_run = F.col("g")[0] + 2 * F.aggregate(F.transform(F.slice("g", 2, F.col("lags")), lambda x, k: x * (1 - (k + 1) / (F.col("lags") + 1.0))), F.lit(0.0), lambda a, x: a + x)
    rows = found.filter(F.col("g")[0] > 0).withColumn("lags", lags).join(eta, keys)
    return rows.select(*keys, "n", "lags", (F.col("eta") / n / n / long_run).alias("kpss"))


def _adf(sums: np.ndarray, lags: int) -> tuple[int, float]:
    """The number of lagged differences of least AIC and the t-statistic of the level with it, from sums over (1, dx, x before, lagged
    differences); NaN where the regression is singular or has no residual."""
    n, best = sums[0, 0], (math.inf, 0, math.nan)
    for p in range(lags + 1):
        at = [0, *range(2, 3 + p)]
        a, b = sums[np.ix_(at, at)], sums[at, 1]
        scale = np.sqrt(np.maximum(np.diag(a), 0))
        if n <= len(at) + 1 or (scale <= 0).any():
            break
        near = a / np.outer(scale, scale)
        if np.linalg.eigvalsh(near)[0] < 1e-12:
            continue
        inverse = np.linalg.inv(near)
        beta = inverse @ (b / scale)
        rest = sums[1, 1] - beta @ (b / scale)
        if rest <= 1e-12 * sums[1, 1]:
            continue
        score = n * math.log(rest / n) + 2 * len(at)
        if score < best[0]:
            best = score, p, float(beta[1] / math.sqrt(rest / (n - len(at)) * inverse[1, 1]))
    return best[1], best[2]


def dickey_fuller(series: DataFrame, keys: list[str], lags: int = ADF_LAGS) -> DataFrame:
    """``(keys, n, lags, adf)``: the augmented test with a constant, its lagged differences chosen by AIC among 0 to ``lags`` over the
    same rows, all from one aggregate of products."""
    w = Window.partitionBy(*keys).orderBy("i")
    rows = series.select(*keys, "i", F.lag("x").over(w).alias("before"), (F.col("x") - F.lag("x").over(w)).alias("d0"))
    rows = rows.select(*keys, F.lit(1.0).alias("one"), "d0", "before", *(F.lag("d0", k).over(w).alias(f"d{k}") for k in range(1, lags + 1)))
    names = ["one", "d0", "before", *(f"d{k}" for k in range(1, lags + 1))]
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    whole = rows.filter(" and ".join(f"{c} is not null" for c in names))
    sums = whole.groupBy(*keys).agg(*(F.sum(F.col(names[i]) * F.col(names[j])).alias(f"s{k}") for k, (i, j) in enumerate(pairs)))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sums.select(*keys).schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                g = np.zeros((len(names), len(names)))
                for k, (i, j) in enumerate(pairs):
                    g[i, j] = g[j, i] = row[len(keys) + k]
                p, stat = _adf(g, lags)
                out.append((*row[: len(keys)], int(g[0, 0]), p, None if math.isnan(stat) else stat))
            yield pd.DataFrame(out, columns=[*keys, "n", "lags", "adf"])

    return sums.mapInPandas(run, f"{kinds}, n long, lags int, adf double")


def decision(adf: Column, kpss_: Column) -> Column:
    """What both tests say together at 5 percent, null where one has no value."""
    unit_root_rejected, stationarity_rejected = adf < ADF_CRITICAL, kpss_ > KPSS_CRITICAL
    return (
        F.when(adf.isNull() | kpss_.isNull(), F.lit(None))
        .when(unit_root_rejected & ~stationarity_rejected, "stationary").when(~unit_root_rejected & stationarity_rejected, "unit root")
        .when(unit_root_rejected, "both rejected").otherwise("neither rejected")
    )


def stationarity(series: DataFrame, lags: int = ADF_LAGS) -> DataFrame:
    """``(station_id, form, n, adf, adf_lags, kpss, kpss_lags, unit_root_rejected, stationarity_rejected, decision)`` of levels and first
    differences of ``series(station_id, i, x)``."""
    keys = ["station_id", "form"]
    forms = both_forms(series)
    longest = series.groupBy("station_id").count().agg(F.max("count")).first()[0] or 1
    found = autocovariances(forms, keys, max(8, min(longest - 1, math.ceil(5 * longest ** (1 / 3)))))
    both = kpss(forms, found, keys).withColumnRenamed("lags", "kpss_lags").join(dickey_fuller(forms, keys, lags).drop("n").withColumnRenamed("lags", "adf_lags"), keys, "left")
    a, k = F.col("adf"), F.col("kpss")
    return both.select(*keys, "n", "adf", "adf_lags", "kpss", "kpss_lags", (a < ADF_CRITICAL).alias("unit_root_rejected"), (k > KPSS_CRITICAL).alias("stationarity_rejected"), decision(a, k).alias("decision"))
