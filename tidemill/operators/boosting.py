"""Gradient boosting of many horizons at once, by histograms.

Every horizon has trees of its own, and all of them grow together: a level of all trees is one scan, in which each task adds
up residuals and counts by (horizon, node, feature, bin); the sums meet in one aggregate, which also picks the splits. Only
the splits come to the driver, a row for each horizon and node. Predictions of earlier rounds aren't kept with the rows but
follow from the trees, so a lost task has nothing to restore.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.functions.quantiles import exact_quantiles
from tidemill.plans.stored import stored


@dataclass
class Boosted:
    """Trees of all horizons. A round holds heaps of nodes: feature and last bin that goes left (feature -1: no split), and leaf values."""

    base: np.ndarray
    depth: int
    rounds: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def places(self, bins: np.ndarray, features: np.ndarray, cuts: np.ndarray, levels: int) -> np.ndarray:
        """The node of each row (rows x horizons) after so many levels, counted within its level."""
        at = np.zeros((len(bins), len(self.base)), np.int64)
        horizon = np.arange(len(self.base))
        for _ in range(levels):
            feature, cut = features[horizon, at], cuts[horizon, at]
            value = np.take_along_axis(bins, np.maximum(feature, 0), axis=1)
            at = 2 * at + 1 + ((feature >= 0) & (value > cut))
        return at - ((1 << levels) - 1)

    def predict(self, bins: np.ndarray) -> np.ndarray:
        out = np.repeat(self.base[None, :], len(bins), axis=0)
        for features, cuts, values in self.rounds:
            out += values[np.arange(len(self.base)), self.places(bins, features, cuts, self.depth)]
        return out


def edges_of(rows: DataFrame, names: list[str], bins: int) -> list[list[float]]:
    """Ascending cut points of each feature, at equal shares of its values; features with few values have fewer of them."""
    long = rows.select(*names).unpivot([], names, "feature", "v")
    found = exact_quantiles(long, ["feature"], "v", [k / bins for k in range(1, bins)])
    by = {r["feature"]: r["e"] for r in found.groupBy("feature").agg(F.sort_array(F.collect_set("value")).alias("e")).collect()}  # at most ``bins`` numbers a feature
    return [by.get(n, []) for n in names]


def binned(names: list[str], edges: list[list[float]]) -> Column:
    """The bins of a row's features: how many cut points lie below each value."""
    count = lambda n, e: F.size(F.filter(F.array(*map(F.lit, e)), lambda x: x < F.col(n))) if e else F.lit(0)
    return F.array(*(count(n, e) for n, e in zip(names, edges)))


def level_sums(rows: DataFrame, model: Boosted, features: np.ndarray, cuts: np.ndarray, level: int, bins: int) -> DataFrame:
    """``(horizon, node, feature, bin, g, n)``: residuals and rows of each bin in the nodes of a level, one row a task and bin before the
    sum."""
    horizons, width = len(model.base), 1 << level

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = n = None
        for batch in batches:
            if not len(batch):
                continue
            x, y = np.stack(batch["bins"].to_numpy()).astype(np.int64), np.stack(batch["y"].to_numpy()).astype(float)
            if g is None:
                g, n = np.zeros((2, horizons, x.shape[1], width * bins))
            rest, at = y - model.predict(x), model.places(x, features, cuts, level)
            for h in range(horizons):
                for f in range(x.shape[1]):
                    where = at[:, h] * bins + x[:, f]
                    g[h, f] += np.bincount(where, rest[:, h], width * bins)
                    n[h, f] += np.bincount(where, minlength=width * bins)
        if g is not None:
            h, f, where = np.nonzero(n)
            yield pd.DataFrame({"horizon": h, "node": where // bins, "feature": f, "bin": where % bins, "g": g[h, f, where], "n": n[h, f, where].astype(np.int64)})

    each = rows.select("bins", "y").mapInPandas(run, "horizon int, node int, feature int, bin int, g double, n long")
    return each.groupBy("horizon", "node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("n").alias("n"))


def best_splits(sums: DataFrame, penalty: float, least: int) -> DataFrame:
    """``(horizon, node, feature, cut, gain, g, n, gl, nl)``: the split of each node that explains most, features and bins in order where
    equal; feature -1 where no split leaves ``least`` rows on both sides or explains anything."""
    own = Window.partitionBy("horizon", "node", "feature")
    rows = sums.withColumns({"gl": F.sum("g").over(own.orderBy("bin")), "nl": F.sum("n").over(own.orderBy("bin")), "ga": F.sum("g").over(own), "na": F.sum("n").over(own)})
    part = lambda g, n: g * g / (n + penalty)
    gain = part(F.col("gl"), F.col("nl")) + part(F.col("ga") - F.col("gl"), F.col("na") - F.col("nl")) - part(F.col("ga"), F.col("na"))
    good = (F.col("nl") >= least) & (F.col("na") - F.col("nl") >= least) & (gain > 1e-9)
    rows = rows.withColumn("gain", F.when(good, F.round(gain, 6)).otherwise(-1.0))
    top = F.max_by(F.struct("feature", "bin", "gain", "ga", "na", "gl", "nl"), F.struct("gain", -F.col("feature"), -F.col("bin")))
    return rows.groupBy("horizon", "node").agg(top.alias("t")).select(
        "horizon", "node", F.when(F.col("t.gain") > 0, F.col("t.feature")).otherwise(-1).alias("feature"), F.col("t.bin").alias("cut"), F.greatest("t.gain", F.lit(0.0)).alias("gain"),
        F.col("t.ga").alias("g"), F.col("t.na").alias("n"), F.col("t.gl").alias("gl"), F.col("t.nl").alias("nl"),
    )


def fit(rows: DataFrame, horizons: int, bins: int, depth: int = 3, rounds: int = 8, rate: float = 0.3, penalty: float = 1.0, least: int = 5) -> Boosted:
    """Boosted trees for squared error from ``rows(bins, y)`` (a written table; ``y`` has a value for each horizon): ``depth`` scans a
    round, whatever the number of horizons."""
    means = rows.select(F.posexplode("y").alias("h", "v")).groupBy("h").agg(F.avg("v").alias("m")).collect()  # a number for each horizon
    base = np.zeros(horizons)
    for r in means:
        base[r["h"]] = r["m"]
    model = Boosted(base, depth)
    for _ in range(rounds):
        features, cuts = np.full((horizons, (1 << depth) - 1), -1), np.zeros((horizons, (1 << depth) - 1), np.int64)
        values = np.zeros((horizons, 1 << depth))
        for level in range(depth):
            for r in best_splits(level_sums(rows, model, features, cuts, level, bins), penalty, least).collect():
                h, node, split = r["horizon"], r["node"], r["feature"] >= 0
                at = (1 << level) - 1 + node
                if split:
                    features[h, at], cuts[h, at] = r["feature"], r["cut"]
                if level == depth - 1:
                    left = (r["gl"], r["nl"]) if split else (r["g"], r["n"])
                    right = (r["g"] - r["gl"], r["n"] - r["nl"]) if split else (0.0, 0)
                    values[h, 2 * node], values[h, 2 * node + 1] = (rate * g / (n + penalty) for g, n in (left, right))
        model.rounds.append((features, cuts, values))
    return model


def errors(rows: DataFrame, keys: list[str], model: Boosted) -> DataFrame:
    """``(keys, horizon, n, rmse)``, horizons counted from 1."""
    kinds = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema.fields), "q array<double>"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                e = model.predict(np.stack(batch["bins"].to_numpy()).astype(np.int64)) - np.stack(batch["y"].to_numpy())
                out = batch[keys].copy()
                out["q"] = list(e * e)
                yield out

    each = rows.select(*keys, "bins", "y").mapInPandas(run, kinds).select(*keys, F.posexplode("q").alias("h", "q"))
    return each.groupBy(*keys, (F.col("h") + 1).cast("long").alias("horizon")).agg(F.count("*").alias("n"), F.sqrt(F.avg("q")).alias("rmse"))


def prepared(rows: DataFrame, names: list[str], target: Column, keep: list[str], bins: int) -> tuple[DataFrame, list[list[float]]]:
    """``rows`` with ``bins`` and ``y`` as a written table, and the cut points."""
    edges = edges_of(rows, names, bins)
    return stored(rows.select(*keep, binned(names, edges).alias("bins"), target.alias("y")), "binned"), edges
