"""Registered queries: exact quantiles, ranks of large groups, partial autocorrelation and stationarity of every station."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.functions import quantiles as qt
from tidemill.functions import stationarity as st
from tidemill.operators import features as ft
from tidemill.operators import grid
from tidemill.plans import sql as q
from tidemill.plans.catalogue import query
from tidemill.sources import readings as src

R = q.readings()
# levels of every station that are there, in order; gaps that weren't filled are closed up
_SERIES = "se AS (SELECT station_id, row_number() OVER (PARTITION BY station_id ORDER BY ts) AS i, water_level AS x FROM f WHERE water_level IS NOT NULL)"


def series(spark, sf):
    f = grid.gap_filled(src.readings(spark, sf)).filter("water_level is not null")
    return f.select("station_id", F.row_number().over(Window.partitionBy("station_id").orderBy("ts")).cast("long").alias("i"), F.col("water_level").cast("double").alias("x"))


_COV = """ce AS (SELECT station_id, i, x - avg(x) OVER (PARTITION BY station_id) AS c FROM se),
gs AS (SELECT a.station_id, a.k, sum(a.c * b.c) AS s FROM (SELECT station_id, i, c, unnest(range(0, 169)) AS k FROM ce) a JOIN ce b ON b.station_id = a.station_id AND b.i = a.i - a.k GROUP BY 1, 2),
ga AS (SELECT station_id, list(s / n ORDER BY k) AS g, any_value(n) AS n FROM gs JOIN (SELECT station_id, count(*) AS n FROM se GROUP BY 1) USING (station_id) GROUP BY 1)"""


@query("acf_stations", f"WITH {R}, {q.frame()}, {_SERIES}, {_COV} SELECT station_id, CAST(k AS BIGINT) AS lag, round(g[k + 1] / g[1] + 1e-9, 5) AS rho FROM ga, (SELECT unnest(range(0, 169)) AS k)")
def acf_stations(spark, sf):
    """Autocorrelations of every station over a week of hours."""
    found = st.autocorrelation(st.autocovariances(series(spark, sf), ["station_id"], st.WEEK), ["station_id"])
    return found.select("station_id", "lag", F.round(F.col("rho") + ft.NUDGE, 5).alias("rho"))


@query("pacf", f"""WITH RECURSIVE {R}, {q.frame()}, {_SERIES}, {_COV},
lv AS (SELECT station_id, g, 0 AS k, CAST([] AS DOUBLE[]) AS phi, g[1] AS v, 1.0::DOUBLE AS a FROM ga
  UNION ALL SELECT station_id, g, k + 1, list_append([phi[j] - w * phi[k + 1 - j] FOR j IN range(1, k + 1)], w), v * (1 - w * w), w
  FROM (SELECT *, (g[k + 2] - coalesce(list_sum([phi[j] * g[k + 2 - j] FOR j IN range(1, k + 1)]), 0)) / v AS w FROM lv WHERE k < 168))
SELECT station_id, CAST(k AS BIGINT) AS lag, round(a + 1e-9, 5) AS value FROM lv""")
def pacf(spark, sf):
    """Partial autocorrelations of every station over a week of hours."""
    found = st.autocovariances(series(spark, sf), ["station_id"], st.WEEK).filter(F.col("g")[0] > 0)
    return found.select("station_id", F.posexplode(st.partial_of(F.col("g"), st.WEEK)).alias("lag", "v")).select("station_id", F.col("lag").cast("long").alias("lag"), F.round(F.col("v") + ft.NUDGE, 5).alias("value"))


_FORMS = f"""{_SERIES}, fm AS (SELECT station_id, 'level' AS form, i, x FROM se UNION ALL SELECT * FROM (SELECT station_id, 'difference', i - 1, x - lag(x) OVER (PARTITION BY station_id ORDER BY i) AS x FROM se) WHERE x IS NOT NULL),
cf AS (SELECT station_id, form, i, x - avg(x) OVER (PARTITION BY station_id, form) AS c, count(*) OVER (PARTITION BY station_id, form) AS n FROM fm)"""


@query("kpss_statistics", f"""WITH {R}, {q.frame()}, {_FORMS},
gg AS (SELECT a.station_id, a.form, a.k, sum(a.c * b.c) / any_value(a.n) AS g, any_value(a.n) AS n FROM (SELECT *, unnest(range(0, 80)) AS k FROM cf) a JOIN cf b ON b.station_id = a.station_id AND b.form = a.form AND b.i = a.i - a.k GROUP BY 1, 2, 3),
au AS (SELECT station_id, form, any_value(n) AS n, sum(CASE WHEN k = 0 THEN g WHEN k <= floor(power(n, 2 / 9.0::DOUBLE)) THEN 2 * g END) AS s0, sum(CASE WHEN k <= floor(power(n, 2 / 9.0::DOUBLE)) THEN 2 * k * g END) AS s1 FROM gg GROUP BY 1, 2),
lg AS (SELECT *, CAST(least(floor(1.1447::DOUBLE * power(s1 / s0 * s1 / s0, 1 / 3.0::DOUBLE) * power(n, 1 / 3.0::DOUBLE)), n - 1, 79) AS INTEGER) AS lags FROM au),
lr AS (SELECT station_id, form, lags, lg.n, sum(CASE WHEN k = 0 THEN g WHEN k <= lags THEN 2 * (1 - k / (lags + 1.0::DOUBLE)) * g END) AS v FROM gg JOIN lg USING (station_id, form) GROUP BY 1, 2, 3, 4),
et AS (SELECT station_id, form, sum(s * s) AS eta FROM (SELECT station_id, form, sum(c) OVER (PARTITION BY station_id, form ORDER BY i) AS s FROM cf) GROUP BY 1, 2)
SELECT station_id, form, n, lags, round(eta / n / n / v + 1e-9, 5) AS kpss FROM lr JOIN et USING (station_id, form)""")
def kpss_statistics(spark, sf):
    """Levels and first differences of every station, with as many lags as each suggests, up to 79."""
    keys = ["station_id", "form"]
    forms = st.both_forms(series(spark, sf))
    found = st.kpss(forms, st.autocovariances(forms, keys, 79), keys)
    return found.select(*keys, "n", "lags", F.round(F.col("kpss") + ft.NUDGE, 5).alias("kpss"))


@query("dickey_fuller_plain", f"""WITH {R}, {q.frame()}, {_FORMS}, dx AS (SELECT * FROM (SELECT station_id, form, lag(x) OVER w AS b, x - lag(x) OVER w AS d FROM fm WINDOW w AS (PARTITION BY station_id, form ORDER BY i)) WHERE b IS NOT NULL)
SELECT station_id, form, count(*) AS n, round(regr_slope(d, b) / sqrt((regr_syy(d, b) - regr_slope(d, b) * regr_sxy(d, b)) / (count(*) - 2) / regr_sxx(d, b)) + 1e-9, 4) AS adf FROM dx GROUP BY 1, 2""")
def dickey_fuller_plain(spark, sf):
    """The test without lagged differences, which a closed form checks; ``stationarity`` chooses their number."""
    found = st.dickey_fuller(st.both_forms(series(spark, sf)), ["station_id", "form"], 0)
    return found.select("station_id", "form", "n", F.round(F.col("adf") + ft.NUDGE, 4).alias("adf"))


@query("stationarity")
def stationarity(spark, sf):
    """Both tests on levels and first differences of every station, and what they say together."""
    return st.stationarity(series(spark, sf))


_LEVELS = f"{q.BASE}, lv AS (SELECT station_id, split, water_level AS v FROM s WHERE water_level IS NOT NULL AND NOT imputed)"


@query("exact_quantiles", f"WITH {_LEVELS} SELECT station_id, split, share, count(*) AS n, round(quantile_cont(v, [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0])[list_position([0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0], share)] + 1e-9, 6) AS value FROM lv, (SELECT unnest([0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0])::DOUBLE AS share) GROUP BY 1, 2, 3")
def exact_quantiles(spark, sf):
    """Quantiles of observed levels by station and split, by selection over counts; the small limit makes the passes run here too."""
    rows = ft.split(ft.station_frames(spark, sf)).filter("water_level is not null and not imputed")
    found = qt.exact_quantiles(rows, ["station_id", "split"], "water_level", [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0], bins=64, limit=16)
    return found.select("station_id", "split", "share", "n", F.round(F.col("value") + ft.NUDGE, 6).alias("value"))


_W = "PARTITION BY station_id ORDER BY ts"
_RAIN = f"""{R}, {q.frame()}, {q.WEATHER}, rn AS (SELECT f.station_id, f.ts, f.water_level, wx.precipitation FROM f LEFT JOIN wx USING (station_id, ts)),
wd AS (SELECT water_level, [{", ".join(f"round(sum(precipitation) OVER ({_W} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW), 6)" for w in (1, 6, 24, 72))}] AS rain, [{", ".join(f"round(lead(water_level, {h}) OVER ({_W}) - water_level, 6)" for h in (1, 6, 12, 24))}] AS change FROM rn),
pr AS (SELECT [1, 6, 24, 72][i] AS hours, [1, 6, 12, 24][j] AS horizon, rain[i] AS x, change[j] AS y FROM wd, (SELECT unnest(range(1, 5)) AS i), (SELECT unnest(range(1, 5)) AS j)),
ok AS (SELECT *, rank() OVER (PARTITION BY hours, horizon ORDER BY x) + (count(*) OVER (PARTITION BY hours, horizon, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY hours, horizon ORDER BY y) + (count(*) OVER (PARTITION BY hours, horizon, y) - 1) / 2.0 AS ry FROM pr WHERE x IS NOT NULL AND y IS NOT NULL)"""


@query("rain_and_later_change", f"WITH {_RAIN} SELECT CAST(hours AS BIGINT) AS hours, CAST(horizon AS BIGINT) AS horizon, count(*) AS n, round(corr(rx, ry), 6) AS rho, round(corr(x, y), 6) AS r FROM ok GROUP BY 1, 2")
def rain_and_later_change(spark, sf):
    """Rain of the last hours against the change of the level in the next ones: rank and linear correlation of all stations' hours."""
    own = Window.partitionBy("station_id").orderBy("ts")
    frames = ft.station_frames(spark, sf)
    rain = F.array(*(F.struct(F.lit(w).cast("long").alias("hours"), F.round(F.sum("precipitation").over(own.rowsBetween(1 - w, 0)), 6).alias("x")) for w in (1, 6, 24, 72)))
    change = F.array(*(F.struct(F.lit(h).cast("long").alias("horizon"), F.round(F.lead("water_level", h).over(own) - F.col("water_level"), 6).alias("y")) for h in (1, 6, 12, 24)))
    pairs = frames.select(rain.alias("a"), change.alias("b")).select(F.explode("a").alias("a"), "b").select("a", F.explode("b").alias("b")).select("a.*", "b.*").filter("x is not null and y is not null")
    rho = qt.spearman_of_large_groups(pairs, ["hours", "horizon"]).select("hours", "horizon", "n", F.round("rho", 6).alias("rho"))
    return rho.join(pairs.groupBy("hours", "horizon").agg(F.round(F.corr("x", "y"), 6).alias("r")), ["hours", "horizon"])
