"""Boosting against a plain loop, rebuilt features against window columns, policies and saved models with planted faults."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.operators import boosting, model_table, policies, rebuilt
from tidemill.operators import features as ft


def plain_trees(x, y, bins, depth, rounds, rate, penalty, least):
    """One tree after another for one horizon, node by node."""
    guess = np.full(len(y), y.mean())
    for _ in range(rounds):
        rest, nodes = y - guess, {0: np.arange(len(y))}
        for _ in range(depth):
            below = {}
            for node, rows in nodes.items():
                best = (0.0, None)
                g, n = rest[rows].sum(), len(rows)
                for f in range(x.shape[1]):
                    for cut in range(bins):
                        left = x[rows, f] <= cut
                        nl = int(left.sum())
                        if nl < least or n - nl < least:
                            continue
                        gl = rest[rows][left].sum()
                        gain = round(gl**2 / (nl + penalty) + (g - gl) ** 2 / (n - nl + penalty) - g**2 / (n + penalty), 6)
                        if gain > best[0]:
                            best = (gain, (f, cut))
                if best[1] is None:
                    below[2 * node] = rows
                else:
                    left = x[rows, best[1][0]] <= best[1][1]
                    below[2 * node], below[2 * node + 1] = rows[left], rows[~left]
            nodes = below
        for rows in nodes.values():
            guess[rows] += rate * rest[rows].sum() / (len(rows) + penalty)
    return guess


def test_boosting_against_a_loop(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 3))
    x[:, 2] = rng.integers(0, 3, 400)
    y = np.stack([np.sin(2 * x[:, 0]) + 0.1 * rng.normal(size=400), x[:, 1] * (x[:, 2] == 1), np.full(400, 4.0), x[:, 0] * x[:, 1]], axis=1)
    frame = spark.createDataFrame(pd.DataFrame({"i": range(400), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]} | {f"y{k}": y[:, k] for k in range(4)})).repartition(5)
    rows, edges = boosting.prepared(frame, ["a", "b", "c"], F.array(*(f"y{k}" for k in range(4))), ["i"], 8)
    bins = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], axis=1)
    assert np.allclose(edges[0], np.quantile(x[:, 0], np.arange(1, 8) / 8)) and len(edges[2]) <= 3
    assert {r["i"]: r["bins"] for r in rows.collect()} == dict(enumerate(bins.tolist()))
    options = dict(depth=3, rounds=4, rate=0.3, penalty=1.0, least=5)
    model = boosting.fit(rows, 4, 8, **options)
    got = model.predict(bins)
    for h in range(4):
        assert np.allclose(got[:, h], plain_trees(bins, y[:, h], 8, **options), atol=1e-6), h
    assert np.allclose(got[:, 2], 4.0) and ((got - y) ** 2).mean() < ((y.mean(0) - y) ** 2).mean() / 2
    scores = {r["horizon"]: r for r in boosting.errors(rows, [], model).collect()}
    assert all(scores[h + 1]["n"] == 400 and np.isclose(scores[h + 1]["rmse"], np.sqrt(((got - y)[:, h] ** 2).mean())) for h in range(4))


def test_rebuilt_features_are_those_of_the_extended_series(spark):
    """Each column equals the window column over the series with the forecasts behind it, and so do whole paths."""
    rng = np.random.default_rng(2)
    n, steps, held = 130, 5, ["rain"]
    series = {s: (np.round(rng.normal(size=n).cumsum() + 40, 3), rng.random(n) < 0.2) for s in ("a", "b")}
    at = lambda k: pd.Timestamp("2023-12-29") + pd.Timedelta(hours=int(k))
    table = lambda rows: spark.createDataFrame(pd.DataFrame(rows, columns=["station_id", "ts", "water_level", "imputed", "rain"])).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    frames = table([(s, at(k), float(v[k]), bool(g[k]), float(k % 7)) for s, (v, g) in series.items() for k in range(n)])
    weights = {"water_level": 0.3, "lag_6": 0.2, "change_24": -0.1, "mean_72": 0.3, "min_6": 0.1, "imputed_count_72": 0.01, "weekday_cos": 0.7, "year_sin": 2.0, "rain": 0.05}
    issues = rebuilt.windows(frames, held)
    paths = {(r["station_id"], r["ts"]): r["path"] for r in rebuilt.rolled_out(issues, 1.5, weights, held, steps).collect()}
    assert len(paths) == 2 * (n - 72)
    for s, k in (("a", 72), ("b", 100), ("a", n - 1)):
        v, g = series[s]
        path = paths[s, at(k).to_pydatetime()]
        long = table([(s, at(j), float(x), bool(f), float(k % 7)) for j, (x, f) in enumerate(zip([*v[: k + 1], *path], [*g[: k + 1], *[False] * steps]))])
        columns = {c: e for c, e in ft.feature_columns().items() if c in rebuilt.LEVEL_FEATURES}
        wide = long.withColumns({"split": F.lit("train"), "precipitation": F.lit(0.0), "temperature_2m": F.lit(0.0)}).select("ts", "water_level", *(e.alias(c) for c, e in columns.items()))
        want = wide.orderBy("ts").toPandas()
        assert set(rebuilt.LEVEL_FEATURES) == {"water_level", *columns}
        for step in range(steps):
            extended = issues.filter((F.col("station_id") == s) & (F.col("ts") == F.lit(at(k).to_pydatetime()).cast("timestamp_ntz"))).withColumn("path", F.array(*map(F.lit, path)))
            if step in (0, 3):
                got = rebuilt.rebuilt_features(extended, "path", step).first()
                assert all(np.isclose(got[c], want[c].iloc[k + step], atol=2e-6) for c in rebuilt.LEVEL_FEATURES), step
            row = want.iloc[k + step]
            calendar = rebuilt.calendar_features(pd.Series([at(k + step)]))[0]
            values = {c: row[c] for c in rebuilt.LEVEL_FEATURES} | dict(zip(rebuilt.CALENDAR, calendar)) | {"rain": float(k % 7)}
            assert np.isclose(path[step], 1.5 + sum(w * values[c] for c, w in weights.items()), atol=1e-5)
    with pytest.raises(ValueError, match="no such predictors"):
        rebuilt.rolled_out(issues, 0.0, {"lag_5": 1.0}, held)
    with pytest.raises(Exception, match="not finite"):
        rebuilt.rolled_out(issues, 0.0, {"water_level": 1e300}, held).collect()


def candidate(experiment, rmse=1.0, **params):
    return experiment, {k: str(v) for k, v in params.items()}, {"cv_rmse_mean": rmse, "cv_mae_mean": 2.0}


CANDIDATES = "experiment string, params map<string,string>, metrics map<string,double>"


def winners(spark, rows, **options):
    found = policies.ranked(spark.createDataFrame(rows, CANDIDATES), **options).filter("place = 1")
    return {(r["experiment"], *([r["params"].get("subset")] if options.get("within") else [])): r["params"] for r in found.collect()}


def test_each_model_has_its_own_policy(spark):
    ridge = [candidate("ridge", subset=s, feature_count=n, alpha=a, log1p=g) for s, n, a, g in (("full", 20, 0.1, "True"), ("full", 20, 1.0, "False"), ("full", 20, 10.0, "False"), ("target", 9, 100.0, "True"), ("target", 9, 20.0, "True"))]
    rnn = [candidate("rnn", subset=s, channel_count=c, sequence_length=24, hidden_size=h, num_layers=1, cell_type="gru") for s, c, h in (("full", 20, 128), ("full", 20, 64), ("target", 10, 128))]
    trees = [candidate("extra_trees", subset="full", feature_count=5, max_depth=d, n_estimators=100, min_samples_leaf=m, max_features=f) for d, m, f in (("None", 5, "sqrt"), (10, 5, "0.5"), (10, 5, "sqrt"), (4, 1, "sqrt"), (30, 5, "1.0"))]
    arimax = [candidate("arimax", subset=s, feature_count=n, p=p, d=d, q=k) for s, n, p, d, k in (("a", 3, 1, 1, 0), ("a", 3, 0, 0, 1), ("a", 3, 2, 0, 0), ("b", 3, 1, 0, 0))]
    arima = [candidate("arima", p=p, d=d, q=k, intercept=i) for p, d, k, i in ((1, 1, 0, "False"), (0, 1, 1, "False"), (1, 0, 0, "True"))]
    mlp = [candidate("mlp", subset="full", feature_count=20, alpha=a, hidden_layer_sizes=h) for a, h in ((0.1, "64x32"), (0.01, "128"), (0.01, "64"))]
    boosted = [candidate("xgboost", subset="full", feature_count=20, max_depth=d, n_estimators=n, learning_rate=0.1, subsample=1, colsample_bytree=1, reg_lambda=1) for d, n in ((10, 50), (9, 500), (9, 60))]
    rows = ridge + rnn + trees + arimax + arima + mlp + boosted
    top = winners(spark, rows, within=("subset",))
    assert top["ridge", "full"]["alpha"] == "1.0" and top["ridge", "target"]["alpha"] == "20.0" and top["rnn", "full"]["hidden_size"] == "64" and top["rnn", "target"]["hidden_size"] == "128"
    assert (top["extra_trees", "full"]["max_depth"], top["extra_trees", "full"]["max_features"]) == ("10", "sqrt")
    assert (top["xgboost", "full"]["max_depth"], top["xgboost", "full"]["n_estimators"]) == ("9", "60") and top["mlp", "full"]["hidden_layer_sizes"] == "128"
    whole = winners(spark, rows)
    assert whole[("arimax",)] == {"subset": "a", "feature_count": "3", "p": "0", "d": "0", "q": "1"} and whole[("arima",)]["d"] == "0" and whole[("ridge",)]["subset"] == "target"
    better = [*rows, candidate("ridge", 0.5, subset="wide", feature_count=99, alpha=1000, log1p="True")]
    assert winners(spark, better)[("ridge",)]["subset"] == "wide" and winners(spark, better, metric="mae")[("ridge",)]["subset"] == "target"


def test_candidates_that_cannot_be_ranked(spark):
    good = candidate("ridge", subset="full", feature_count=20, alpha=1.0, log1p="True")
    bad = [
        candidate("ridge", float("nan"), subset="full", feature_count=20, alpha=1.0, log1p="True"), candidate("ridge", subset="full", feature_count=20, alpha="much", log1p="True"),
        candidate("ridge", subset="full", alpha=1.0, log1p="True", feature_count="nan"), candidate("ridge", feature_count=20, alpha=1.0, log1p="True"), candidate("ridge", subset="full", feature_count=20, alpha=1.0, log1p="maybe"), ("ridge", good[1], {}),
    ]
    for row in bad:
        with pytest.raises(policies.NoCandidate, match="can't be ranked"):
            winners(spark, [good, row])
    with pytest.raises(policies.NoCandidate, match="no policy for"):
        winners(spark, [good, candidate("oracle", subset="full")])
    with pytest.raises(policies.NoCandidate, match="no candidate"):
        policies.ranked(spark.createDataFrame([], CANDIDATES))
    with pytest.raises(policies.NoCandidate, match="mae or rmse"):
        winners(spark, [good], metric="r2")


def contract(**changed):
    held = dict(station_id="a", feature_columns=("x", "y", "z"), target_columns=("t1", "t2"), subsets={"full": ("x", "y", "z"), "some": ("x", "z")})
    return model_table.Contract(**(held | changed))


def test_saved_models_score_as_fitted_and_refuse_another_contract(spark, tmp_path):
    path, weights = f"file://{tmp_path}/models", np.array([[1.0, 2.0], [0.5, -1.0], [3.0, 0.25]])
    model_table.save(spark, path, contract(), "e1", "some", 1.0, False, [True, False], weights)
    model_table.save(spark, path, contract(), "e2", "some", 1.0, True, [True, False], weights / 10)
    rows = spark.createDataFrame([(i, {"x": float(i), "y": 9.0, "z": i / 2 - 1}) for i in range(20)], "i int, columns map<string,double>")
    got = {(r["execution"], r["i"], r["horizon"]): r["prediction"] for r in model_table.scored(model_table.load(spark, path, contract()), rows, ["i"]).collect()}
    assert len(got) == 2 * 20 * 2
    for i in range(20):
        x = np.array([1.0, i, i / 2 - 1])
        logged = np.array([1.0, np.log1p(i), i / 2 - 1])
        assert np.allclose([got["e1", i, h] for h in (1, 2)], x @ weights) and np.allclose([got["e2", i, h] for h in (1, 2)], np.expm1(logged @ weights / 10))
    refused = {
        "order": contract(feature_columns=("z", "y", "x"), subsets={"some": ("z", "x")}), "unknown subset": contract(subsets={"full": ("x", "y", "z")}), "another station": contract(station_id="b"),
        "other targets": contract(target_columns=("t2", "t1")), "other columns": contract(subsets={"some": ("x", "y")}),
    }
    for reason, other in refused.items():
        with pytest.raises(model_table.ContractError, match=reason):
            model_table.load(spark, path, other)
    old = spark.read.parquet(path).withColumn("schema_version", F.lit("0.9"))
    old.write.parquet(f"{path}-old")
    with pytest.raises(model_table.ContractError, match="schema version 0.9"):
        model_table.load(spark, f"{path}-old", contract())
    with pytest.raises(model_table.ContractError, match="order of the contract"):
        contract(subsets={"some": ("z", "x")}).check()
    for bad in (weights[:2], np.where(weights == 3.0, np.nan, weights)):
        with pytest.raises(model_table.ContractError, match="finite, one for each"):
            model_table.save(spark, path, contract(), "e3", "some", 1.0, False, [True, False], bad)
    with pytest.raises(Exception, match="lacks a column"):
        model_table.scored(model_table.load(spark, path, contract()), rows.withColumn("columns", F.map_filter("columns", lambda k, _: k != "z")), ["i"]).collect()
