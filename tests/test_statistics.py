"""Quantiles, ranks, partial autocorrelations and stationarity of many series against plain loops."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.functions import quantiles, stationarity


def test_quantiles_of_any_distribution(spark):
    rng = np.random.default_rng(1)
    groups = {
        "even": rng.uniform(0, 1, 20_000), "heavy": np.exp(rng.normal(0, 8, 20_000)), "ties": rng.integers(0, 3, 20_000).astype(float), "one": np.array([7.0]), "same": np.full(5000, -2.5),
        "wide": np.r_[rng.normal(size=5000), 1e308, -1e308], "close": 1 + rng.integers(0, 5000, 9000) * 2.0**-52,
    }
    frame = spark.createDataFrame(pd.DataFrame([(g, x) for g, v in groups.items() for x in v], columns=["g", "x"])).repartition(6)
    frame = frame.union(spark.createDataFrame([("even", float("nan")), ("even", None), ("void", None)], "g string, x double"))
    shares = [0.0, 0.001, 0.25, 0.5, 0.9, 1.0]
    got = {(r["g"], r["share"]): r for r in quantiles.exact_quantiles(frame, ["g"], "x", shares, bins=16, limit=50).collect()}
    assert len(got) == len(groups) * len(shares)
    for g, v in groups.items():
        for s in shares:
            assert got[g, s]["n"] == len(v) and math.isclose(got[g, s]["value"], np.quantile(v, s), rel_tol=1e-12, abs_tol=1e-300), (g, s)
    whole = quantiles.exact_quantiles(frame, [], "x", [0.5], bins=16, limit=50).first()
    assert math.isclose(whole["value"], np.quantile(np.concatenate(list(groups.values())), 0.5), rel_tol=1e-12)
    assert quantiles.exact_quantiles(frame.limit(0), ["g"], "x", shares).count() == 0


def test_ranks_across_ranges(spark):
    """Groups that spread over many tasks rank as they do in one."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rng = np.random.default_rng(2)
        table = pd.DataFrame({"g": rng.choice(["a", "b"], 200_000, p=[0.99, 0.01]), "x": rng.integers(0, 500, 200_000).astype(float)})
        table["y"] = table["x"] * 0.3 + rng.integers(0, 300, 200_000)
        frame = spark.createDataFrame(table)
        counted = frame.groupBy("g", "x").count()
        ranks = quantiles.average_ranks(counted, ["g"], "x", "count")
        got = {(r["g"], r["x"]): r["rank"] for r in ranks.collect()}
        table["rank"] = table.groupby("g")["x"].rank()
        assert got == {(r.g, r.x): r.rank for r in table.drop_duplicates(["g", "x"])[["g", "x", "rank"]].itertuples(index=False)}
        for r in quantiles.spearman_of_large_groups(frame, ["g"]).collect():
            part = table[table["g"] == r["g"]]
            assert r["n"] == len(part) and math.isclose(r["rho"], part["x"].rank().corr(part["y"].rank()), rel_tol=1e-9)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def frame_of(spark, series):
    return spark.createDataFrame(pd.DataFrame([(s, i + 1, float(x)) for s, v in series.items() for i, x in enumerate(v)], columns=["station_id", "i", "x"]))


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(5)
    e = rng.normal(size=1500)
    ar = np.zeros(1500)
    for t in range(2, 1500):
        ar[t] = 0.5 * ar[t - 1] - 0.3 * ar[t - 2] + e[t]
    walk = np.cumsum(rng.normal(size=1500))
    break_ = np.r_[rng.normal(size=750) * 0.5, 2.2 + rng.normal(size=750) * 0.5]
    short = np.cumsum(rng.normal(size=60))
    return {"ar": ar, "walk": walk, "break": break_, "short": short, "flat": np.ones(50)}


def test_partial_autocorrelations(spark, made):
    found = stationarity.autocovariances(frame_of(spark, made), ["station_id"], 40)
    rho = {(r["station_id"], r["lag"]): r["rho"] for r in stationarity.autocorrelation(found, ["station_id"]).collect()}
    rows = found.filter(F.col("g")[0] > 0).select("station_id", stationarity.partial_of(F.col("g"), 40).alias("p")).collect()
    assert {r["station_id"] for r in rows} == set(made) - {"flat"}
    for r in rows:
        x = made[r["station_id"]] - made[r["station_id"]].mean()
        g = np.array([(x[k:] * x[: len(x) - k]).sum() / len(x) for k in range(41)])
        assert np.allclose([rho[r["station_id"], k] for k in range(41)], g / g[0])
        for k in (1, 2, 7, 40):
            system = np.array([[g[abs(i - j)] for j in range(k)] for i in range(k)])
            assert math.isclose(r["p"][k], np.linalg.solve(system, g[1 : k + 1])[-1], abs_tol=1e-8)


def plain_adf(x, lags):
    d = np.diff(x)
    rows = range(lags, len(d))
    best = None
    for p in range(lags + 1):
        z = np.array([[1.0, x[t], *(d[t - k] for k in range(1, p + 1))] for t in rows])
        y = d[list(rows)]
        beta = np.linalg.lstsq(z, y, rcond=None)[0]
        rest = ((y - z @ beta) ** 2).sum()
        score = len(y) * math.log(rest / len(y)) + 2 * z.shape[1]
        if best is None or score < best[0] - 1e-9:
            best = score, p, beta[1] / math.sqrt(rest / (len(y) - z.shape[1]) * np.linalg.inv(z.T @ z)[1, 1])
    return best[1:]


def plain_kpss(x, most):
    n, c = len(x), x - x.mean()
    g = [(c[k:] * c[: n - k]).sum() / n for k in range(min(n, most + 1))]
    few = int(n ** (2 / 9))
    s0, s1 = g[0] + 2 * sum(g[1 : few + 1]), 2 * sum(k * g[k] for k in range(1, few + 1))
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1, most)
    return lags, (np.cumsum(c) ** 2).sum() / n**2 / (g[0] + 2 * sum((1 - k / (lags + 1)) * g[k] for k in range(1, lags + 1)))


def test_stationarity_against_loops(spark, made):
    got = {(r["station_id"], r["form"]): r for r in stationarity.stationarity(frame_of(spark, made), 4).collect()}
    assert set(got) == {(s, f) for s in made if s != "flat" for f in ("level", "difference")}
    for (s, form), r in got.items():
        x = made[s] if form == "level" else np.diff(made[s])
        lags, adf = plain_adf(x, 4)
        most = max(8, min(1499, math.ceil(5 * 1500 ** (1 / 3))))
        assert (r["adf_lags"], r["kpss_lags"]) == (lags, plain_kpss(x, most)[0])
        assert math.isclose(r["adf"], adf, rel_tol=1e-6) and math.isclose(r["kpss"], plain_kpss(x, most)[1], rel_tol=1e-6)
    assert got["ar", "level"]["decision"] == "stationary" and got["walk", "level"]["decision"] == "unit root" and got["walk", "difference"]["decision"] == "stationary"


def test_what_both_tests_say(spark):
    rows = [(-5.0, 0.1, "stationary"), (-1.0, 0.9, "unit root"), (-5.0, 0.9, "both rejected"), (-1.0, 0.1, "neither rejected"), (None, 0.1, None), (-5.0, None, None)]
    frame = spark.createDataFrame(rows, "a double, k double, wanted string")
    assert frame.filter(stationarity.decision(F.col("a"), F.col("k")).eqNullSafe(F.col("wanted"))).count() == len(rows)
