"""Registered queries: the feature contract with its subsets and gaps, months of the calendar, folds by horizon, rankings of the sealed test."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.functions import stats
from tidemill.functions.quantiles import quantiles_wide
from tidemill.operators import contract, grid, sealed
from tidemill.operators import features as ft
from tidemill.operators import runlog as rl
from tidemill.plans import sql as q
from tidemill.plans.catalogue import query
from tidemill.plans.q_runlog import CAND
from tidemill.plans.q_sealed import _RE, _SEALED, ALARM, cutoffs, test_forecasts
from tidemill.sources import readings as src


def _predictors_sql() -> str:
    """``lp(station_id, split, k, base, value)``: all predictors of all hours."""
    lag = lambda k: f"lag(water_level, {k}) OVER ({q._W})"
    by = {"water_level": "water_level", "imputed": "CAST(CAST(imputed AS INT) AS DOUBLE)", "precipitation": "precipitation", "temperature_2m": "temperature_2m"}
    by |= {f"lag_{k}": lag(k) for k in (1, 3, 6, 12, 24, 48, 72)} | {f"change_{k}": f"water_level - {lag(k)}" for k in (1, 3, 6, 12, 24)}
    for w in (6, 24, 72):
        by |= {f"{n}_{w}": q.gated(f, "water_level", w) for n, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))}
        by |= {f"imputed_count_{w}": q.counted(w), f"precipitation_{w}": q.gated("sum", "precipitation", w), f"temperature_mean_{w}": q.gated("avg", "temperature_2m", w)}
    by |= {f"temperature_{f}_24": q.gated(f, "temperature_2m", 24) for f in ("min", "max")}
    day = "CAST(strftime(ts, '%Y-12-31') AS DATE)"
    parts = {"hour": "hour(ts) / 24.0", "weekday": "(isodow(ts) - 1) / 7.0", "year": f"(dayofyear(ts) - 1) / CAST(dayofyear({day}) AS DOUBLE)"}
    by |= {f"{n}_{f}": f"{f}(2 * pi() * {e})" for n, e in parts.items() for f in ("sin", "cos")}
    names = contract.base_columns()
    cells = ", ".join(f"CAST({by[c]} AS DOUBLE) AS c{k}" for k, c in enumerate(names.values()))
    return f"""wd AS (SELECT station_id, ts, split, {cells} FROM s),
lp AS (SELECT station_id, split, unnest(range(0, {len(names)})) AS k, unnest([{", ".join(f"'{b}'" for b in names)}]) AS base, unnest([{", ".join(f"c{k}" for k in range(len(names)))}]) AS value FROM wd)"""


_PREDICTORS = f"{q.BASE}, {_predictors_sql()}"
_HYDRO = "(base IN ('water_level', 'imputed') OR starts_with(base, 'water_level_') OR starts_with(base, 'imputed_count_') OR starts_with(base, 'utc_'))"
_RULES = {
    "full": "true", "all_station_hydrology_quality_time": _HYDRO, "raw_all_stations": "base IN ('water_level', 'imputed', 'precipitation', 'temperature_2m')", "target_station_full": "station_id = 'click'",
    "target_station_hydrology_quality_time": f"station_id = 'click' AND {_HYDRO}", "current_water_levels_all_stations": "base = 'water_level'",
}


@query("feature_contract", f"WITH {_PREDICTORS}, ct AS (SELECT station_id, k, base, count(value) AS n, count(*) - count(value) AS n_null FROM lp WHERE split = 'train' GROUP BY 1, 2, 3), su AS ("
       + " UNION ALL ".join(f"SELECT '{n}' AS subset, * FROM ct WHERE {r}" for n, r in _RULES.items())
       + ") SELECT subset, row_number() OVER (PARTITION BY subset ORDER BY station_id, k) AS place, station_id || '__' || base AS column_name, n, n_null FROM su")
def feature_contract(spark, sf):
    """Every predictor of every station in order, by subset, with its values and gaps in the training hours."""
    return contract.contract(ft.featured(spark, sf).filter("split = 'train'"), ft.TARGET)


@query("null_families", f"WITH {_PREDICTORS} SELECT split, family, CAST(n_null AS BIGINT) AS n_null FROM (SELECT split, regexp_replace(base, '_[0-9]+h$', '') AS family, count(*) - count(value) AS n_null FROM lp GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY split ORDER BY n_null DESC, family) <= 10")
def null_families(spark, sf):
    """Which kinds of predictors are missing most."""
    return contract.null_families(ft.featured(spark, sf))


@query("monthly_matrix", f"""WITH {q.BASE}, {q.FEATURES}, {q.COHORT}, hr AS (SELECT ts, CAST(date_trunc('month', ts) AS DATE) AS month FROM f WHERE station_id = 'click'),
mo AS (SELECT CAST(unnest(generate_series(CAST(min(month) AS TIMESTAMP), CAST(max(month) AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS month FROM hr),
sn AS (SELECT station_id AS row_name, month FROM f JOIN hr USING (ts) WHERE water_level IS NOT NULL AND NOT imputed UNION ALL SELECT 'eligible rows', month FROM co JOIN hr USING (ts) WHERE station_id = 'click'),
nm AS (SELECT DISTINCT station_id AS row_name FROM f UNION ALL SELECT 'eligible rows'),
ch AS (SELECT month, count(*) AS hours FROM hr GROUP BY 1), cn AS (SELECT row_name, month, count(*) AS n FROM sn GROUP BY 1, 2)
SELECT row_name, CAST(month AS TIMESTAMP) AS month, round(100.0::DOUBLE * coalesce(n, 0) / hours, 6) AS percent FROM nm CROSS JOIN mo LEFT JOIN ch USING (month) LEFT JOIN cn USING (row_name, month)""")
def monthly_matrix(spark, sf):
    """The share of the target's hours that each station observed, by month of the calendar, and that of eligible rows."""
    frames = grid.gap_filled(src.readings(spark, sf))
    eligible = ft.cohort(ft.featured(spark, sf)).filter(F.col("station_id") == ft.TARGET).select("ts")
    return contract.monthly_matrix(frames, eligible, ft.TARGET).withColumn("month", F.col("month").cast("timestamp_ntz"))


@query("worst_months", f"WITH {q.readings('sparse')}, {q.frame(2.0)} SELECT station_id, date_trunc('month', ts) AS month, round(100.0 * count(CASE WHEN NOT imputed THEN water_level END) / count(*), 6) AS percent FROM f GROUP BY 1, 2 ORDER BY percent, station_id, month LIMIT 12")
def worst_months(spark, sf):
    """The twelve least observed months of all stations."""
    f = grid.gap_filled(src.readings(spark, sf, "sparse"), least=2.0)
    observed = F.count(F.when(~F.col("imputed"), F.col("water_level")))
    m = f.groupBy("station_id", F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month")).agg(F.round(100.0 * observed / F.count("*"), 6).alias("percent"))
    return m.orderBy("percent", "station_id", "month").limit(12)


_BY_HORIZON = f"""{CAND}, fh AS (SELECT model, subset, param, fold, coalesce(horizon, 0) AS horizon, {q.METRICS} FROM cp, fb WHERE split = 'train' AND pos >= val_start AND pos < val_end GROUP BY GROUPING SETS ((model, subset, param, fold), (model, subset, param, fold, horizon))),
fl AS (SELECT model, subset, param, horizon, unnest(['mae', 'rmse', 'me', 'r2']) AS metric, unnest([mae, rmse, me, r2]) AS v FROM fh)"""


@query("cv_horizon_summary", f"WITH {_BY_HORIZON} SELECT model, subset, param, horizon, metric, count(*) AS folds, round(avg(v) + 1e-9, 5) AS mean, round(stddev_pop(v) + 1e-9, 5) AS std FROM fl GROUP BY 1, 2, 3, 4, 5")
def cv_horizon_summary(spark, sf):
    """Mean and population deviation over folds of every metric, for each horizon and, as horizon 0, for all together."""
    features = ft.featured(spark, sf)
    rows = rl.candidate_forecasts(features, ft.target_cohort(features)).filter("split = 'train'").withColumn("f", F.explode(ft.fold_bounds(F.col("n")))).select("*", "f.*").filter("pos >= val_start and pos < val_end")
    key = [F.col(c) for c in (*rl.KEY, "fold")]
    scores = rows.groupingSets([key, [*key, F.col("horizon")]], *key, F.col("horizon")).agg(*ft.metrics()).withColumn("horizon", F.coalesce("horizon", F.lit(0).cast("long")))
    long = scores.unpivot([*rl.KEY, "horizon"], list(rl.MEASURES), "metric", "v")
    return long.groupBy(*rl.KEY, "horizon", "metric").agg(F.count("*").alias("folds"), F.round(F.avg("v") + ft.NUDGE, 5).alias("mean"), F.round(F.stddev_pop("v") + ft.NUDGE, 5).alias("std"))


@query("test_ranking", f"WITH {_SEALED}, {_RE} SELECT regime, model, rmse, row_number() OVER (PARTITION BY regime ORDER BY rmse, model) AS place FROM mt WHERE horizon = 0 AND n > 0")
def test_ranking(spark, sf):
    """Models by their error on the sealed test rows, within each regime."""
    scores = sealed.regime_scores(test_forecasts(spark, sf), cutoffs(spark, sf), ALARM).filter("horizon = 0 and n > 0")
    return scores.select("regime", "model", "rmse", F.row_number().over(Window.partitionBy("regime").orderBy("rmse", "model")).cast("long").alias("place"))


@query("regime_performance", f"""WITH {_SEALED}, {_RE}, lg AS (SELECT model, regime, metric, v AS value, n FROM (SELECT model, regime, n, unnest(['mae', 'rmse', 'me']) AS metric, unnest([mae, rmse, me]) AS v FROM mt WHERE horizon = 0))
SELECT regime, metric, CAST(max(n) AS BIGINT) AS n, min(n) = max(n) AS counts_agree, max(CASE WHEN model = 'persistence' THEN value END) AS persistence, max(CASE WHEN model = 'linear' THEN value END) AS linear
FROM (SELECT r.regime, m.metric, p.model, coalesce(lg.n, 0) AS n, lg.value FROM (SELECT unnest(['all', 'q1', 'q2', 'q3', 'q4', 'alarm']) AS regime) r, (SELECT unnest(['mae', 'rmse', 'me']) AS metric) m, (SELECT DISTINCT model FROM pr) p LEFT JOIN lg ON lg.regime = r.regime AND lg.metric = m.metric AND lg.model = p.model) GROUP BY 1, 2""")
def regime_performance(spark, sf):
    """The sealed test by regime with models side by side: every regime has a row, even without a level in it, and says whether
    all models were scored on as many of them."""
    scores = sealed.regime_scores(test_forecasts(spark, sf), cutoffs(spark, sf), ALARM).filter("horizon = 0")
    long = scores.unpivot(["model", "regime", "n"], ["mae", "rmse", "me"], "metric", "value")
    value = lambda m: F.max(F.when(F.col("model") == m, F.col("value"))).alias(m)
    return long.groupBy("regime", "metric").agg(F.max("n").alias("n"), (F.min("n") == F.max("n")).alias("counts_agree"), value("persistence"), value("linear"))


@query("histogram_clipped", f"""WITH {q.readings()}, e AS (SELECT station_id, min(value) AS lo, quantile_cont(value, 0.99) AS hi FROM r WHERE value IS NOT NULL GROUP BY 1),
c AS (SELECT station_id, CAST(least(floor((least(value, hi) - lo) / ((hi - lo) / 10)), 9) AS BIGINT) AS bin, count(*) AS n FROM r JOIN e USING (station_id) WHERE value IS NOT NULL GROUP BY 1, 2),
k AS (SELECT station_id, CAST(unnest(range(0, 10)) AS BIGINT) AS bin FROM e)
SELECT station_id, bin, CAST(coalesce(n, 0) AS BIGINT) AS n FROM k LEFT JOIN c USING (station_id, bin)""")
def histogram_clipped(spark, sf):
    """Equal-width bins up to the 99th percentile, which values beyond count as."""
    r = src.readings(spark, sf).filter("value is not null")
    top = quantiles_wide(r, ["station_id"], "value", {"hi": 0.99}).select("station_id", "hi")
    return stats.histogram(r.join(top, "station_id").withColumn("value", F.least("value", "hi")).drop("hi"), ["station_id"], "value", 10)
