"""The ridge search beside direct fits on the rows of each fold."""

import numpy as np
import pytest

from tidemill.config import EMBARGO, FOLDS, INITIAL_FRACTION
from tidemill.operators import ridge_search as rs

LARGE = "/root/testdata/sf0.1"


def direct(x, y, alpha):
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1)
    z = (x - mean) / scale
    b = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean(0)))
    return lambda v: y.mean(0) + (v - mean) / scale @ b


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", LARGE])
def test_every_candidate_and_fold_equals_a_direct_fit(spark, sf):
    got = {(r["subset"], r["alpha"], r["log1p"], r["fold"]): r for r in rs.search(spark, sf).collect()}
    expected = 0
    for weather in (True, False):
        rows, names = rs.design(spark, sf, weather)
        rows = rows.toPandas().sort_values("pos")
        x, y, n = np.stack(rows["x"]), np.stack(rows["y"]), len(rows)
        assert np.isfinite(x).all() and np.isfinite(y).all() and list(rows["pos"]) == list(range(n))
        logged = np.array([rs.COLUMNS[b][1] for _, b in names])
        size = int((n - np.floor(n * INITIAL_FRACTION) - EMBARGO) // FOLDS)
        for (subset, alpha, log, fold), r in got.items():
            if (subset in rs.WITH_WEATHER) != weather:
                continue
            expected += 1
            start = n - (FOLDS - fold) * size
            use = [k for k, (s, b) in enumerate(names) if rs.SUBSETS[subset](s == rs.TARGET, b)]
            u = np.where(logged, np.log1p(np.where(logged, x, 0)), x)[:, use] if log else x[:, use]
            t = np.log1p(y) if log else y
            guess = direct(u[: start - EMBARGO], t[: start - EMBARGO], alpha)(u[start : start + size])
            e = (np.expm1(guess) if log else guess) - y[start : start + size]
            assert r["n"] == e.size
            assert abs(r["rmse"] - np.sqrt((e * e).mean())) < 1e-6 and abs(r["mae"] - np.abs(e).mean()) < 1e-6
    assert len(got) == expected == (6 if sf == LARGE else 3) * 5 * 2 * FOLDS  # sf0.01 has too few hours with all weather for folds


def test_no_row_gives_no_score(spark, tmp_path):
    spark.read.parquet(f"{LARGE}/events.parquet").limit(0).write.parquet(f"{tmp_path}/events.parquet")
    assert rs.search(spark, str(tmp_path)).count() == 0
