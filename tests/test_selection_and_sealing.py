"""Order grids against direct fits, the sealed test's refusals, digests and checks of executions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import orders, provenance, sealed


def series(spark, stations):
    rows = [(s, k, None if v is None else float(v)) for s, values in stations.items() for k, v in enumerate(values)]
    frame = spark.createDataFrame(rows, "station_id string, k int, water_level double")
    return orders.placed(frame.select("station_id", F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, k)").alias("ts"), "water_level", F.lit(False).alias("imputed")))


def fold_bounds(n):
    size = (n - n // 2 - 24) // 5
    return [(n - (5 - f) * size - 24, n - (5 - f) * size, n - (4 - f) * size) for f in range(5)]


def test_orders_against_direct_fits(spark):
    """Each order of each fold by least squares on its own design, and its recursive forecasts by a plain loop."""
    rng = np.random.default_rng(1)
    y = np.zeros(400)
    for t in range(2, 400):
        y[t] = 0.6 * y[t - 1] + 0.2 * y[t - 2] + rng.normal()
    walk = np.cumsum(rng.normal(size=300)) + 50
    gaps = [None if k % 40 == 7 else v for k, v in enumerate(y[:350] + 10)]
    stations = {"ar": (y + 30).tolist(), "walk": walk.tolist(), "gaps": gaps, "flat": [5.0] * 300, "short": [1.0, 2.0] * 20, "none": [None] * 300}
    hours = series(spark, stations)
    fitted = orders.fits(hours)
    got = {(r["station_id"], r["fold"], r["p"], r["d"]): r for r in fitted.collect()}
    assert len(got) == 6 * 5 * 13
    scores = {(r["station_id"], r["fold"], r["p"], r["d"]): r for r in orders.scored(hours, fitted).collect()}
    for s, values in stations.items():
        v = np.array([np.nan if x is None else x for x in values])
        for f, (train_end, lo, hi) in enumerate(fold_bounds(len(v))):
            for p, d in orders.ORDERS:
                r = got[s, f, p, d]
                if s == "short":
                    assert r["status"] == "failed" and r["reason"] == "too few hours" and r["coefficients"] is None
                    continue
                rows = [t for t in range(7, lo) if np.isfinite(v[t - 7 : t + 1]).all()]
                assert r["n"] == len(rows)
                if s in ("flat", "none"):
                    wanted = "too few rows" if s == "none" else None if (p, d) == (0, 1) else "singular"
                    assert r["reason"] == wanted and (r["status"] == "ok") == (wanted is None)
                    continue
                x = np.array([[*([] if d else [1.0]), *((v[t - k] - v[t - k - 1]) if d else v[t - k] for k in range(1, p + 1))] for t in rows]).reshape(len(rows), p + (not d))
                goal = np.array([v[t] - d * v[t - 1] for t in rows])
                want = np.linalg.lstsq(x, goal, rcond=None)[0] if x.shape[1] else np.zeros(0)
                assert r["status"] == "ok" and np.allclose(r["coefficients"], want, atol=1e-6)
                assert np.isclose(r["variance"], ((goal - x @ want) ** 2).sum() / (len(rows) - x.shape[1]), rtol=1e-6)
                if p in (0, 3):
                    errors = []
                    for t in range(lo, hi):
                        if t + 24 < len(v) and np.isfinite(v[t - 6 : t + 25]).all():
                            path = v[: t + 1].tolist()
                            for _ in range(24):
                                step = [path[-k] - path[-k - 1] if d else path[-k] for k in range(1, p + 1)]
                                path.append((path[-1] if d else want[0]) + float(np.dot(want[0 if d else 1 :], step)))
                            errors += (np.array(path[t + 1 :]) - v[t + 1 : t + 25]).tolist()
                    if errors:
                        e = np.array(errors)
                        assert scores[s, f, p, d]["issues"] == len(e) // 24 and np.isclose(scores[s, f, p, d]["rmse"], np.sqrt((e * e).mean())) and np.isclose(scores[s, f, p, d]["mae"], np.abs(e).mean())
    table = {(r["station_id"], r["p"], r["d"]): r for r in orders.candidates(hours).collect()}
    assert len(table) == 6 * 13 and all((r["status"] == "ok") == (r["rmse_mean"] is not None) for r in table.values())
    assert table["short", 1, 0]["reason"] == "too few hours" and table["flat", 2, 0]["reason"] == "singular" and table["flat", 0, 1]["status"] == "ok"


FORECASTS = "model string, issue_ts int, horizon long, prediction double, actual double"


def some_forecasts(n=30):
    return [(m, i, h, float(i + h), float(i + h + (i % 3) - 1)) for m in ("a", "b") for i in range(n) for h in (1, 2)]


def test_a_sealed_test_counts_once(spark, tmp_path):
    frame = spark.createDataFrame(some_forecasts(), FORECASTS)
    seal = lambda f, e="e1", cut=(5.0, 10.0, 20.0): sealed.seal(f, f"file://{tmp_path}", e, cut, 25.0, (1, 2))
    rows = seal(frame).collect()
    assert len(rows) == 2 * 6 * 3 and {r["n"] for r in rows if r["regime"] == "all" and r["horizon"] == 0} == {60}
    with pytest.raises(sealed.SealedError, match="scored before"):
        seal(frame)
    with pytest.raises(sealed.SealedError, match="other forecasts"):
        seal(frame.withColumn("prediction", F.col("prediction") + 1))
    for bad in (float("nan"), float("inf"), None):
        with pytest.raises(sealed.SealedError, match="not finite"):
            seal(frame.withColumn("prediction", F.when(F.col("issue_ts") == 7, F.lit(bad)).otherwise(F.col("prediction"))), "e2")
    with pytest.raises(sealed.SealedError, match="no forecast"):
        seal(frame.limit(0), "e2")
    with pytest.raises(ValueError, match="ascending"):
        seal(frame, "e9", (5.0, 3.0, 20.0))
    assert sealed.logged(spark, f"file://{tmp_path}").count() == 36  # refused passes left nothing
    assert seal(frame, "e2").count() == 36


def test_a_job_lost_between_claim_and_log_goes_on(spark, tmp_path, monkeypatch):
    frame, store = spark.createDataFrame(some_forecasts(), FORECASTS), f"file://{tmp_path}"
    with monkeypatch.context() as m:
        m.setattr(sealed, "logged", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            sealed.seal(frame, store, "e1", (5.0, 10.0, 20.0), 25.0, (1, 2))
    assert sealed.logged(spark, store).count() == 0
    whole = sealed.seal(frame, store, "e1", (5.0, 10.0, 20.0), 25.0, (1, 2))
    rows = [tuple(r) for r in whole.collect()]
    assert len(rows) == 36
    # a write that was lost half-way: the rows that are there are not written again
    half = spark.createDataFrame(rows[:10], sealed.LOG)
    half.withColumn("execution", F.lit("e3")).write.mode("append").parquet(f"{store}/log")
    sealed._claim(spark, store, "e3", provenance.multiset_digest(frame, ["model", "issue_ts", "horizon", "prediction", "actual"]))
    assert sealed.seal(frame, store, "e3", (5.0, 10.0, 20.0), 25.0, (1, 2)).count() == 36


def test_regimes_against_a_loop(spark):
    rows = some_forecasts()
    got = {(r["model"], r["regime"], r["horizon"]): r for r in sealed.regime_scores(spark.createDataFrame(rows, FORECASTS), (5.0, 10.0, 20.0), 25.0, (1, 2)).collect()}
    inside = {"all": lambda a: True, "q1": lambda a: a <= 5, "q2": lambda a: 5 < a <= 10, "q3": lambda a: 10 < a <= 20, "q4": lambda a: a > 20, "alarm": lambda a: a >= 25}
    for (model, regime, h), r in got.items():
        e = [p - a for m, _, k, p, a in rows if m == model and inside[regime](a) and h in (0, k)]
        assert r["n"] == len(e) and np.isclose(r["mae"], np.abs(e).mean(), atol=1e-5) and np.isclose(r["rmse"], np.sqrt(np.mean(np.square(e))), atol=1e-5)


def test_digests_tell_rows_apart(spark):
    rows = [(i, i % 3, None if i % 5 == 0 else float(i)) for i in range(200)]
    frame = spark.createDataFrame(rows, "a int, b int, c double")
    columns = ["a", "b", "c"]
    own = provenance.multiset_digest(frame, columns)
    assert own == provenance.multiset_digest(frame.repartition(7).orderBy(F.rand(1)), columns)
    changed = [frame.filter("a <> 9"), frame.union(frame.filter("a = 9")), frame.withColumn("c", F.when(F.col("a") == 9, 10.0).otherwise(F.col("c"))), frame.fillna(0.0), frame.select(F.col("b").alias("a"), F.col("a").alias("b"), "c")]
    assert len({own, *(provenance.multiset_digest(f, columns) for f in changed)}) == 6
    runs = spark.createDataFrame([("x", 0, "d"), ("y", 0, "d"), ("x", 1, "d"), ("y", 1, "e")], "model string, fold int, train_digest string")
    assert provenance.require_agreement(runs.filter("fold = 0")).count() == 2
    with pytest.raises(provenance.Disagreement, match="fold 1"):
        provenance.require_agreement(runs)
