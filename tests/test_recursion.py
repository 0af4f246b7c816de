"""The fitted recursion beside a plain loop over the rows."""

import math

import numpy as np

from tidemill.operators import recursion
from tidemill.plans import q_recursion


def test_fit_and_path_equal_a_plain_loop(spark, sf):
    issue = q_recursion._issues(spark, sf)
    found = q_recursion.fitted_coefficients(issue)
    rows = [r for r in issue.collect()]
    x = lambda w, hour, held: [w[-1], w[-24], sum(w[-24:]) / 24, math.sin(2 * math.pi * hour / 24), math.cos(2 * math.pi * hour / 24), held]
    a = np.array([x(r["w"], r["ts"].hour + 1, r["held"]) for r in rows if r["following"] is not None])
    y = np.array([r["following"] for r in rows if r["following"] is not None])
    z = (a - a.mean(0)) / a.std(0)
    b = np.linalg.solve(z.T @ z + np.eye(6), z.T @ (y - y.mean())) / a.std(0)
    assert np.allclose([found[n] for n in recursion.PREDICTORS], b, atol=1e-6)
    assert abs(found["intercept"] - (y.mean() - a.mean(0) @ b)) < 1e-6
    got = {(r["station_id"], r["ts"]): r["path"] for r in recursion.rolled_out(issue, found, 24).collect()}
    assert len(got) == len(rows) > 100
    for r in rows[::37]:
        w = list(r["w"])
        for k in range(1, 25):
            w.append(found["intercept"] + sum(found[n] * v for n, v in zip(recursion.PREDICTORS, x(w, r["ts"].hour + k, r["held"]))))
        assert np.allclose(got[r["station_id"], r["ts"]], w[24:], atol=1e-6)


def test_no_row_gives_no_path(spark):
    empty = spark.createDataFrame([], "station_id string, ts timestamp_ntz, water_level double")
    assert recursion.rolled_out(recursion.issues(empty), q_recursion.GIVEN, 24).count() == 0
