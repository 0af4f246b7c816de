"""Fits against direct least squares, Spark's own regression against the ridge of the Gram sums, and queries that SQL can't follow by value."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill import registry
from tidemill.operators import models

QUERIES = registry.queries()


def plain_ridge(x, y, alpha):
    mean, scale = x.mean(0), x.std(0)
    scale[scale < 1e-12] = 1
    z = (x - mean) / scale
    c = np.linalg.lstsq(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean()), rcond=None)[0] / scale
    return [y.mean() - c @ mean, *c]


def test_ridge_of_many_groups(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(60):
        n = int(rng.integers(2, 40))
        x = rng.normal(size=(n, 3)) * [1, 10, 0.1] + 5
        if g % 7 == 0:
            x[:, 1] = 2.0  # constant
        if g % 11 == 0:
            x[:, 2] = x[:, 0]  # collinear
        rows += [(g, *map(float, v), float(t)) for v, t in zip(x, x @ [1, 2, 3] + rng.normal(size=n))]
    table = pd.DataFrame(rows, columns=["g", "a", "b", "c", "y"])
    frame = spark.createDataFrame(table).union(spark.createDataFrame([(0, None, 1.0, 1.0, 1.0)], "g long, a double, b double, c double, y double"))
    got = {(r["g"], r["alpha"], r["feature"]): r["coefficient"] for r in models.ridge(frame.repartition(5), ["g"], ["a", "b", "c"], "y", [0.0, 1.0, 50.0]).collect()}
    assert len(got) == 60 * 3 * 4
    for g, part in table.groupby("g"):
        for alpha in (0.0, 1.0, 50.0):
            want = plain_ridge(part[["a", "b", "c"]].to_numpy(), part["y"].to_numpy(), alpha)
            if alpha or len(part) > 8 and g % 11:
                assert np.allclose([got[g, alpha, f] for f in ("intercept", "a", "b", "c")], want, atol=1e-4), (g, alpha)


def test_sparks_regression_is_the_same_ridge(spark):
    """With the penalty that the query gives it, Spark's regression has the coefficients of the Gram fit (it scales by n - 1)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 3)) * [1, 4, 0.5]
    table = pd.DataFrame(x, columns=["a", "b", "c"]).assign(g=1, y=x @ [2, -1, 3] + rng.normal(size=4000))
    frame = spark.createDataFrame(table)
    alpha = 200.0
    want = {r["feature"]: r["coefficient"] for r in models.ridge(frame, ["g"], ["a", "b", "c"], "y", [alpha]).collect()}
    rows = VectorAssembler(inputCols=["a", "b", "c"], outputCol="x").transform(frame).select("x", F.col("y").alias("label"))
    fitted = LinearRegression(featuresCol="x", regParam=alpha / 4000 * float(table["y"].std()), elasticNetParam=0.0, solver="normal").fit(rows)
    free = LinearRegression(featuresCol="x", regParam=0.0, solver="normal").fit(rows)
    shrunk = np.array(fitted.coefficients)
    assert np.abs(shrunk - [want[c] for c in "abc"]).max() < 0.002 * np.abs(shrunk).max() and np.all(np.abs(shrunk) < 0.97 * np.abs(np.array(free.coefficients)))
    plain = {r["feature"]: r["coefficient"] for r in models.ridge(frame, ["g"], ["a", "b", "c"], "y", [0.0]).collect()}
    assert np.allclose(np.array(free.coefficients), [plain[c] for c in "abc"], atol=1e-8) and np.isclose(free.intercept, plain["intercept"])


@pytest.fixture(scope="module")
def trained(spark, sf):
    from tidemill.plans.q_models import PREDICTORS, training

    return training(spark, sf).toPandas(), PREDICTORS


def test_model_formula(spark, sf, trained):
    rows, names = trained
    got = {(r["station_id"], r["feature"]): r for r in QUERIES["model_formula"](spark, sf).collect()}
    assert len(got) == rows["station_id"].nunique() * (1 + len(names))
    for s, part in rows.groupby("station_id"):
        x = part[names].to_numpy(float)
        want = plain_ridge(x.copy(), part["t1"].to_numpy(float), 1.0)
        assert np.allclose([got[s, f]["coefficient"] for f in ["intercept", *names]], want, atol=1e-6)
        assert np.allclose([got[s, f]["centre"] for f in names], x.mean(0)) and np.allclose([got[s, f]["scale"] for f in names], x.std(0)) and got[s, "intercept"]["centre"] is None


def test_forests_beat_the_mean(spark, sf, trained):
    rows, _ = trained
    spread = rows.groupby("station_id")["t1"].std(ddof=0)
    for name in ("random_forest", "linear_regression"):
        got = {r["station_id"]: r for r in QUERIES[name](spark, sf).collect()}
        assert {s: r["n"] for s, r in got.items()} == rows.groupby("station_id").size().to_dict() and all(got[s]["rmse"] <= spread[s] * 1.02 for s in got)
    trees = QUERIES["boosted_trees"](spark, sf).toPandas()
    assert np.isclose(trees["importance"].sum(), 1) and trees["rmse"].nunique() == 1 and trees["rmse"][0] < spread.mean()


def test_autoregressions_of_users(spark, sf):
    got = QUERIES["ar_fit_users"](spark, sf).toPandas().pivot(index="station_id", columns="feature", values="coefficient")
    rows = models.ar_rows(__import__("tidemill.operators.grid", fromlist=["x"]).gap_filled(__import__("tidemill.sources.readings", fromlist=["x"]).readings(spark, sf, "user")), 2).toPandas()
    assert set(got.index) == set(rows["station_id"])
    checked = 0
    for s, part in rows.groupby("station_id"):
        x = part[["l1", "l2"]].to_numpy(float)
        if len(part) > 12 and np.linalg.cond(x - x.mean(0)) < 1e3:
            assert np.allclose(got.loc[s, ["intercept", "l1", "l2"]], plain_ridge(x.copy(), part["water_level"].to_numpy(float), 0.0), atol=1e-5)
            checked += 1
    assert checked > 5


def test_seeded_draws(spark, sf):
    a, b = (QUERIES["sample_params"](spark, sf).toPandas().sort_values(["station_id", "draw"], ignore_index=True) for _ in range(2))
    assert a.equals(b) and a.groupby("station_id").size().eq(16).all()
    assert a["rate"].between(1e-4, 1).all() and a["share"].between(0.5, 1).all() and set(a["depth"]) == set(range(2, 9))
    logs = np.log10(a["rate"])
    assert np.allclose(np.quantile((logs + 4) / 4, [0.1, 0.5, 0.9]), [0.1, 0.5, 0.9], atol=0.03) and np.allclose(np.quantile((a["share"] - 0.5) * 2, [0.1, 0.5, 0.9]), [0.1, 0.5, 0.9], atol=0.03)


def test_flattened_catalog(spark, sf):
    got = {r["station_commonid"]: r for r in QUERIES["flatten_catalog"](spark, sf).collect()}
    want = {r["event_type"]: r["p"] for r in spark.read.parquet(f"{sf}/events.parquet").groupBy("event_type").agg(F.avg("user_id").alias("p")).collect()}
    assert {k: r["station_position_km"] for k, r in got.items()} == pytest.approx(want) and "measurements" not in next(iter(got.values())).asDict()
