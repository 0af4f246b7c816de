"""Registered queries: autoregressive orders for every station and fold, with the fits that fail."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import features as ft
from tidemill.operators import grid, orders
from tidemill.plans import sql as q
from tidemill.plans.catalogue import query
from tidemill.plans.stored import stored
from tidemill.sources import readings as src

# dense stations and sparse ones, whose long gaps leave too few rows for some fits, up to the target's training boundary
_HOURS = f"""{q.readings()}, {q.frame()}, {q.readings("sparse", "r2")}, {q.frame(source="r2", name="f2")},
bound AS (SELECT max(ts) AS b FROM (SELECT ts, row_number() OVER (ORDER BY ts) AS i, count(*) OVER () AS n FROM f WHERE station_id = 'click') WHERE i <= floor(n * 0.8::DOUBLE)),
hr AS (SELECT station_id, ts, CASE WHEN NOT imputed THEN water_level END AS y, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY station_id) AS n
  FROM (SELECT station_id, ts, water_level, imputed FROM f UNION ALL SELECT station_id, ts, water_level, imputed FROM f2), bound WHERE ts <= b WINDOW w AS (PARTITION BY station_id ORDER BY ts)),
ds AS (SELECT *, {", ".join(f"lag(y, {k}) OVER w AS l{k}" for k in range(1, orders.DEPTH + 1))} FROM hr WINDOW w AS (PARTITION BY station_id ORDER BY ts)),
bd AS (SELECT station_id, n, fold, n - (5 - fold) * size AS val_start, size >= 1 AND n - (5 - fold) * size - 24 > 0 AS usable
  FROM (SELECT station_id, n, CAST(floor((n - floor(n * 0.5::DOUBLE) - 24) / 5) AS BIGINT) AS size FROM (SELECT DISTINCT station_id, n FROM hr)), (SELECT CAST(unnest(range(0, 5)) AS BIGINT) AS fold)),
ok AS (SELECT station_id, bool_and(usable) AS usable FROM bd GROUP BY 1),
gr AS (SELECT bd.station_id, fold, count(y) AS n, avg(y) AS my, avg(l1) AS m1, avg(l2) AS m2, var_pop(l1) AS v11, var_pop(l2) AS v22, covar_pop(l1, l2) AS v12, covar_pop(l1, y) AS c1, covar_pop(l2, y) AS c2
  FROM bd LEFT JOIN (SELECT * FROM ds WHERE y IS NOT NULL {"".join(f" AND l{k} IS NOT NULL" for k in range(1, orders.DEPTH + 1))}) x ON x.station_id = bd.station_id AND pos < val_start GROUP BY 1, 2)"""


def hours(spark, sf):
    dense = grid.gap_filled(src.readings(spark, sf))
    both = dense.unionByName(grid.gap_filled(src.readings(spark, sf, "sparse")))
    return orders.placed(both.join(F.broadcast(ft.boundary(dense)), F.col("ts") <= F.col("boundary")).drop("boundary"))


@query("order_fits_low", f"""WITH {_HOURS}, ft AS (
  SELECT station_id, fold, 1 AS p, n, usable, n <= 3 AS short, v11 <= 0 AS flat, c1 / v11 AS a1, CAST(NULL AS DOUBLE) AS a2, my - c1 / v11 * m1 AS a0 FROM gr JOIN ok USING (station_id)
  UNION ALL SELECT station_id, fold, 2, n, usable, n <= 4, v11 <= 0 OR v22 <= 0 OR v11 * v22 - v12 * v12 <= 1e-9 * v11 * v22, (c1 * v22 - c2 * v12) / (v11 * v22 - v12 * v12), (c2 * v11 - c1 * v12) / (v11 * v22 - v12 * v12),
    my - (c1 * v22 - c2 * v12) / (v11 * v22 - v12 * v12) * m1 - (c2 * v11 - c1 * v12) / (v11 * v22 - v12 * v12) * m2 FROM gr JOIN ok USING (station_id))
SELECT station_id, fold, CAST(p AS INTEGER) AS p, CAST(n AS BIGINT) AS n, CASE WHEN NOT usable THEN 'too few hours' WHEN short THEN 'too few rows' WHEN flat THEN 'singular' END AS reason,
  {", ".join(f"CASE WHEN usable AND NOT short AND NOT flat THEN round(a{k} + 1e-9, 4) END AS a{k}" for k in range(3))} FROM ft""")
def order_fits_low(spark, sf):
    """The fits of first and second order, which closed forms check; all others come from the same sums."""
    f = orders.fits(hours(spark, sf)).filter("d = 0 and p <= 2")
    a = [F.round(F.get("coefficients", F.lit(k)) + ft.NUDGE, 4).alias(f"a{k}") for k in range(3)]
    return f.select("station_id", "fold", "p", "n", "reason", *a)


@query("order_fits")
def order_fits(spark, sf):
    """Thirteen orders for every station and fold, failed ones with their reason."""
    return orders.fits(hours(spark, sf))


@query("order_search")
def order_search(spark, sf):
    """Every station's candidates over all folds: metrics where each fold was fitted and scored, else a status and why."""
    return orders.candidates(stored(hours(spark, sf), "hours"), stored)


@query("order_candidates", f"""WITH {_HOURS}, st AS (SELECT DISTINCT station_id FROM hr)
SELECT station_id, CAST(p AS INTEGER) AS p, CAST(d AS INTEGER) AS d, CAST(0 AS INTEGER) AS q, d = 0 AS intercept FROM st, (SELECT unnest(range(0, 7)) AS p), (SELECT unnest(range(0, 2)) AS d) WHERE d = 1 OR p > 0""")
def order_candidates(spark, sf):
    """The candidates that the search reports on: every station with every order, whether it could be fitted or not."""
    return order_search(spark, sf).select("station_id", "p", "d", "q", "intercept")
