"""Registered queries: recursive forecasts with rebuilt levels, calendar and held columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import features as ft
from tidemill.operators import grid, models, recursion
from tidemill.plans import sql as q
from tidemill.plans.catalogue import query
from tidemill.sources import readings as src

GIVEN = {"intercept": 2.0, "level": 0.5, "day_before": 0.2, "day_mean": 0.2, "hour_sin": 1.5, "hour_cos": -0.5, "held": 0.05}


def _issues(spark, sf):
    return recursion.issues(grid.gap_filled(src.readings(spark, sf)))


def _long(paths):
    each = paths.select("station_id", "ts", F.posexplode("path").alias("k", "v"))
    return each.select("station_id", "ts", (F.col("k") + 1).cast("long").alias("horizon"), F.round(F.col("v") + ft.NUDGE, 4).alias("prediction"))


@query("recursive_exogenous_forecast", f"""WITH RECURSIVE {q.readings()}, {q.frame()}, iw AS (SELECT station_id, ts, list(water_level) OVER w AS w, count(water_level) OVER w AS n, (sum(water_level) OVER t - water_level) / nullif(count(water_level) OVER t - 1, 0) AS held
  FROM f WINDOW w AS (PARTITION BY station_id ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW), t AS (PARTITION BY ts)),
st AS (SELECT station_id, ts, w, held, CAST(0 AS BIGINT) AS k, CAST(NULL AS DOUBLE) AS v FROM iw WHERE n = 24 AND held IS NOT NULL
  UNION ALL SELECT station_id, ts, list_append(w[2:], x), held, k + 1, x FROM (SELECT *, 2.0::DOUBLE + 0.5::DOUBLE * w[24] + 0.2::DOUBLE * w[1] + 0.2::DOUBLE * list_avg(w) + 1.5::DOUBLE * sin(2 * pi() * (hour(ts) + k + 1) / 24) - 0.5::DOUBLE * cos(2 * pi() * (hour(ts) + k + 1) / 24) + 0.05::DOUBLE * held AS x FROM st WHERE k < 24))
SELECT station_id, ts, k AS horizon, round(v + 1e-9, 4) AS prediction FROM st WHERE k > 0""")
def recursive_exogenous_forecast(spark, sf):
    """Paths of all issues by given coefficients."""
    return _long(recursion.rolled_out(_issues(spark, sf), GIVEN, 24))


def fitted_coefficients(issue):
    """One fit over all stations: seven numbers from one Gram aggregate."""
    rows = recursion.predictors(issue).withColumn("all", F.lit(1))
    return {r["feature"]: r["coefficient"] for r in models.ridge(rows, ["all"], recursion.PREDICTORS, "following", [1.0]).collect()}


@query("recursive_exogenous_fitted")
def recursive_exogenous_fitted(spark, sf):
    """The same by coefficients that the next hours' levels give."""
    issue = _issues(spark, sf)
    return _long(recursion.rolled_out(issue, fitted_coefficients(issue), 24))
