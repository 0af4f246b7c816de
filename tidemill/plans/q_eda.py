"""Registered queries: metrics, regimes, coverage, resampling, correlation, runs and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.functions import stats
from tidemill.functions.quantiles import quantiles_wide
from tidemill.operators import features as ft
from tidemill.operators import grid
from tidemill.plans import sql as q
from tidemill.plans.catalogue import query
from tidemill.plans.stored import table
from tidemill.sources import readings as src

R, SP = q.readings(), q.readings("sparse")


def preds(spark, sf, horizons=ft.EVERY):
    return ft.forecasts(ft.target_cohort(ft.featured(spark, sf, horizons=horizons)), horizons)


def filled(spark, sf, kind="sparse", least=2.0):
    return grid.gap_filled(src.readings(spark, sf, kind), least=least)


@query("metrics_aggregate", f"WITH {q.ALL} SELECT model, split, count(DISTINCT issue_ts) AS issue_times, {q.METRICS} FROM pr GROUP BY 1, 2")
def metrics_aggregate(spark, sf, horizons=ft.EVERY):
    return preds(spark, sf, horizons).groupBy("model", "split").agg(F.count_distinct("issue_ts").alias("issue_times"), *ft.metrics())


@query("metrics_per_horizon", f"WITH {q.ALL} SELECT model, split, CAST(coalesce(horizon, 0) AS BIGINT) AS horizon, {q.METRICS} FROM pr GROUP BY GROUPING SETS ((model, split), (model, split, horizon))")
def metrics_per_horizon(spark, sf, horizons=ft.EVERY):
    """Metrics over all horizons (0) and each, in one pass."""
    p = preds(spark, sf, horizons)
    both = p.groupingSets([[F.col("model"), F.col("split")], [F.col("model"), F.col("split"), F.col("horizon")]], F.col("model"), F.col("split"), F.col("horizon")).agg(*ft.metrics())
    return both.withColumn("horizon", F.coalesce("horizon", F.lit(0).cast("long")))


_QUART = "qt AS (SELECT quantile_cont(water_level, 0.25) AS q25, quantile_cont(water_level, 0.5) AS q50, quantile_cont(water_level, 0.75) AS q75, count(*) AS n_reference FROM s WHERE station_id = 'click' AND split = 'train' AND water_level IS NOT NULL AND NOT imputed)"


def quartiles(spark, sf):
    rows = ft.split(ft.station_frames(spark, sf)).filter("station_id = 'click' and split = 'train' and water_level is not null and not imputed")
    return quantiles_wide(rows, ["station_id"], "water_level", {"q25": 0.25, "q50": 0.5, "q75": 0.75}).select("q25", "q50", "q75", F.col("n").alias("n_reference"))


@query("train_quartiles", f"WITH {q.BASE}, {_QUART} SELECT round(q25, 6) AS q25, round(q50, 6) AS q50, round(q75, 6) AS q75, n_reference FROM qt")
def train_quartiles(spark, sf):
    return quartiles(spark, sf).select(*(F.round(c, 6).alias(c) for c in ("q25", "q50", "q75")), "n_reference")


_REGIME = "CASE WHEN actual <= q25 THEN 'q1' WHEN actual <= q50 THEN 'q2' WHEN actual <= q75 THEN 'q3' ELSE 'q4' END"


@query("regime_metrics", f"""WITH {q.ALL}, {_QUART}, x AS (SELECT pr.*, {_REGIME} AS regime FROM pr, qt UNION ALL SELECT pr.*, 'alarm' FROM pr WHERE actual >= 90.0::DOUBLE),
k AS (SELECT model, unnest(['q1', 'q2', 'q3', 'q4', 'alarm']) AS regime, h AS horizon FROM (SELECT unnest(['persistence', 'linear']) AS model), (SELECT CAST(unnest({q.HOURS}) AS BIGINT) AS h)),
m AS (SELECT model, regime, horizon, {q.METRICS} FROM x GROUP BY 1, 2, 3)
SELECT k.model, k.regime, k.horizon, CAST(coalesce(n, 0) AS BIGINT) AS n, mae, rmse, me, r2 FROM k LEFT JOIN m USING (model, regime, horizon)""")
def regime_metrics(spark, sf, horizons=ft.EVERY):
    """Metrics by level regime; the alarm regime overlaps the fourth quarter, and empty groups stay."""
    p = preds(spark, sf, horizons).crossJoin(F.broadcast(quartiles(spark, sf)))
    regime = F.when(F.col("actual") <= F.col("q25"), "q1").when(F.col("actual") <= F.col("q50"), "q2").when(F.col("actual") <= F.col("q75"), "q3").otherwise("q4")
    x = p.withColumn("regime", F.explode(F.array_compact(F.array(regime, F.when(F.col("actual") >= 90.0, "alarm")))))
    m = x.groupBy("model", "regime", "horizon").agg(*ft.metrics())
    skeleton = spark.range(1).select(F.explode(F.array(F.lit("persistence"), F.lit("linear"))).alias("model")).select("model", F.explode(F.array(*map(F.lit, ("q1", "q2", "q3", "q4", "alarm")))).alias("regime")).select("model", "regime", F.explode(F.array(*(F.lit(h).cast("long") for h in horizons))).alias("horizon"))
    return skeleton.join(m, ["model", "regime", "horizon"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


@query("regime_label", f"WITH {q.BASE}, {_QUART}, x AS (SELECT ts, water_level AS actual FROM s WHERE station_id = 'click' AND water_level IS NOT NULL) SELECT ts, {_REGIME} AS regime, replace(lower(trim(' High Water ')), ' ', '_') AS slug FROM x, qt")
def regime_label(spark, sf):
    x = ft.split(ft.station_frames(spark, sf)).filter("station_id = 'click' and water_level is not null").crossJoin(F.broadcast(quartiles(spark, sf)))
    a = F.col("water_level")
    return x.select("ts", F.when(a <= F.col("q25"), "q1").when(a <= F.col("q50"), "q2").when(a <= F.col("q75"), "q3").otherwise("q4").alias("regime"), F.replace(F.lower(F.trim(F.lit(" High Water "))), F.lit(" "), F.lit("_")).alias("slug"))


@query("cv_summary", f"WITH {q.ALL}, w AS (SELECT model, horizon, date_trunc('day', issue_ts) AS d, avg(abs(prediction - actual)) AS mae FROM pr GROUP BY 1, 2, 3) SELECT model, horizon, round(avg(mae), 6) AS mae_mean, round(stddev_pop(mae), 6) AS mae_std FROM w GROUP BY 1, 2")
def cv_summary(spark, sf, horizons=ft.EVERY):
    """Mean and population deviation of a metric over groups of issue times."""
    w = preds(spark, sf, horizons).groupBy("model", "horizon", F.to_date("issue_ts").alias("d")).agg(F.avg(F.abs(F.col("prediction") - F.col("actual"))).alias("mae"))
    return w.groupBy("model", "horizon").agg(F.round(F.avg("mae"), 6).alias("mae_mean"), F.round(F.stddev_pop("mae"), 6).alias("mae_std"))


@query("error_box_stats", f"WITH {q.ALL} SELECT model, horizon, " + ", ".join(f"round(quantile_cont(prediction - actual, {p}), 6) AS p{int(p * 100)}" for p in (0, 0.25, 0.5, 0.75, 1)) + " FROM pr GROUP BY 1, 2")
def error_box_stats(spark, sf, horizons=ft.EVERY):
    rows = preds(spark, sf, horizons).select("model", "horizon", (F.col("prediction") - F.col("actual")).alias("error"))
    names = {f"p{n}": n / 100 for n in (0, 25, 50, 75, 100)}
    return quantiles_wide(rows, ["model", "horizon"], "error", names).select("model", "horizon", *(F.round(n, 6).alias(n) for n in names))


@query("first_step_delta", f"WITH {q.ALL}, d AS (SELECT pr.model, prediction - water_level AS predicted, actual - water_level AS observed FROM pr JOIN tc ON pr.issue_ts = tc.ts WHERE horizon = 1) SELECT model, count(*) AS n, round(avg(predicted), 6) AS predicted_mean, round(stddev_samp(predicted), 6) AS predicted_std, round(avg(observed), 6) AS observed_mean, round(stddev_samp(observed), 6) AS observed_std, round(quantile_cont(observed, 0.5), 6) AS observed_median FROM d GROUP BY 1")
def first_step_delta(spark, sf):
    cohort = ft.target_cohort(ft.featured(spark, sf))
    d = ft.forecasts(cohort).filter("horizon = 1").join(cohort.select(F.col("ts").alias("issue_ts"), "water_level"), "issue_ts")
    p, o = F.col("prediction") - F.col("water_level"), F.col("actual") - F.col("water_level")
    return d.groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg(p), 6).alias("predicted_mean"), F.round(F.stddev_samp(p), 6).alias("predicted_std"), F.round(F.avg(o), 6).alias("observed_mean"), F.round(F.stddev_samp(o), 6).alias("observed_std"), F.round(F.percentile(o, 0.5), 6).alias("observed_median"))


@query("long_predictions", f"WITH {q.ALL} SELECT issue_ts, horizon, model, actual, round(prediction, 6) AS prediction FROM pr WHERE split = 'train'")
def long_predictions(spark, sf, horizons=ft.EVERY):
    return preds(spark, sf, horizons).filter("split = 'train'").select("issue_ts", "horizon", "model", "actual", F.round("prediction", 6).alias("prediction"))


@query("valid_time_series", f"WITH {q.ALL} SELECT issue_ts + to_hours(horizon) AS valid_ts, horizon, actual, round(prediction, 6) AS prediction FROM pr WHERE split = 'train' AND model = 'linear'")
def valid_time_series(spark, sf, horizons=ft.EVERY):
    return preds(spark, sf, horizons).filter("split = 'train' and model = 'linear'").select(F.expr("issue_ts + make_interval(0, 0, 0, 0, CAST(horizon AS INT))").alias("valid_ts"), "horizon", "actual", F.round("prediction", 6).alias("prediction"))


@query("persistence_forecast", f"WITH {q.ALL} SELECT ts, split, water_level AS step_1, water_level AS step_24 FROM tc")
def persistence_forecast(spark, sf):
    repeated = ft.target_cohort(ft.featured(spark, sf)).select("ts", "split", F.array_repeat("water_level", 24).alias("p"))
    return repeated.select("ts", "split", F.col("p")[0].alias("step_1"), F.col("p")[23].alias("step_24"))


@query("prediction_validity", f"WITH {q.ALL} SELECT model, count(*) AS n, CAST(count(CASE WHEN prediction IS NULL OR isnan(prediction) OR isinf(prediction) THEN 1 END) AS BIGINT) AS n_bad FROM pr GROUP BY 1")
def prediction_validity(spark, sf, horizons=ft.EVERY):
    v = F.col("prediction")
    return preds(spark, sf, horizons).groupBy("model").agg(F.count("*").alias("n"), F.count_if(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))).alias("n_bad"))


_PER_ISSUE = "iss AS (SELECT model, issue_ts, sqrt(avg(power(prediction - actual, 2))) AS rmse FROM pr WHERE split = 'train' GROUP BY 1, 2)"


@query("best_worst_windows", f"WITH {q.ALL}, {_PER_ISSUE} SELECT model, issue_ts, round(rmse, 6) AS rmse, kind FROM (SELECT *, 'best' AS kind, row_number() OVER (PARTITION BY model ORDER BY round(rmse, 9), issue_ts) AS i FROM iss UNION ALL SELECT *, 'worst', row_number() OVER (PARTITION BY model ORDER BY round(rmse, 9) DESC, issue_ts) FROM iss) WHERE i = 1")
def best_worst_windows(spark, sf, horizons=ft.EVERY):
    """The issue times with the least and the greatest error, the earliest of equals."""
    e = F.col("prediction") - F.col("actual")
    iss = preds(spark, sf, horizons).filter("split = 'train'").groupBy("model", "issue_ts").agg(F.sqrt(F.avg(e * e)).alias("rmse"))
    key = F.round("rmse", 9)
    at = F.struct("issue_ts", "rmse")
    first = iss.groupBy("model").agg(F.min_by(at, F.struct(key, "issue_ts")).alias("best"), F.min_by(at, F.struct(-key, "issue_ts")).alias("worst"))
    return first.select("model", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("w")) for k in ("best", "worst")))).alias("x")).select("model", "x.w.issue_ts", F.round("x.w.rmse", 6).alias("rmse"), "x.kind")


@query("prediction_preview", f"WITH {q.ALL} SELECT issue_ts, horizon, actual, round(prediction, 6) AS prediction FROM pr WHERE model = 'linear' ORDER BY issue_ts, horizon LIMIT 20")
def prediction_preview(spark, sf, horizons=ft.EVERY):
    return preds(spark, sf, horizons).filter("model = 'linear'").orderBy("issue_ts", "horizon").limit(20).select("issue_ts", "horizon", "actual", F.round("prediction", 6).alias("prediction"))


@query("complete_context", f"WITH {R}, {q.frame()}, c AS (SELECT station_id, ts, count(CASE WHEN water_level IS NOT NULL AND NOT imputed THEN 1 END) OVER (PARTITION BY station_id ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS n FROM f) SELECT station_id, ts FROM c WHERE n = 25")
def complete_context(spark, sf):
    """Hours with twelve complete, observed hours on both sides, by row frames on the dense grid rather than a range join."""
    f = filled(spark, sf, "dense", 0.0)
    n = F.count_if(F.col("water_level").isNotNull() & ~F.col("imputed")).over(Window.partitionBy("station_id").orderBy("ts").rowsBetween(-12, 12))
    return f.withColumn("n", n).filter("n = 25").select("station_id", "ts")


@query("window_at_issue", f"WITH {q.ALL} SELECT model, horizon, actual, round(prediction, 6) AS prediction FROM pr WHERE issue_ts = (SELECT min(ts) FROM tc)")
def window_at_issue(spark, sf):
    cohort = ft.target_cohort(ft.featured(spark, sf))
    first = cohort.agg(F.min("ts").alias("issue_ts"))
    return ft.forecasts(cohort).join(F.broadcast(first), "issue_ts", "left_semi").select("model", "horizon", "actual", F.round("prediction", 6).alias("prediction"))


@query("nearest_to_value", f"WITH {R} SELECT station_id, ts, value FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY abs(value - 50), ts) AS i FROM r WHERE value IS NOT NULL) WHERE i = 1")
def nearest_to_value(spark, sf):
    r = src.readings(spark, sf).filter("value is not null")
    return r.groupBy("station_id").agg(F.min_by(F.struct("ts", "value"), F.struct(F.abs(F.col("value") - 50), "ts")).alias("m")).select("station_id", "m.*")


@query("station_coverage", f"WITH {SP}, o AS (SELECT station_id, ts, date_diff('hour', lag(ts) OVER (PARTITION BY station_id ORDER BY ts), ts) AS gap FROM r WHERE value > 2) SELECT station_id, min(ts) AS first_ts, max(ts) AS last_ts, date_diff('hour', min(ts), max(ts)) + 1 - count(*) AS n_missing, max(gap) AS longest_gap FROM o GROUP BY 1")
def station_coverage(spark, sf):
    o = src.readings(spark, sf, "sparse").filter("value > 2").withColumn("gap", grid.hours_between(F.lag("ts").over(Window.partitionBy("station_id").orderBy("ts")), F.col("ts")))
    return o.groupBy("station_id").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), (grid.hours_between(F.min("ts"), F.max("ts")) + 1 - F.count("*")).alias("n_missing"), F.max("gap").alias("longest_gap"))


@query("completeness", f"WITH {SP}, {q.frame(2.0)} SELECT station_id, count(*) AS hours, CAST(count(CASE WHEN present THEN 1 END) AS BIGINT) AS matched, CAST(count(water_level) AS BIGINT) AS usable, CAST(count(CASE WHEN imputed THEN 1 END) AS BIGINT) AS n_imputed, round(100.0 * count(level) / count(*), 6) AS complete_percent, 100.0 * count(level) / count(*) >= 30 AS qualified FROM f GROUP BY 1")
def completeness(spark, sf):
    raw = src.readings(spark, sf, "sparse")
    f = grid.gap_filled(raw, least=2.0)
    matched = raw.groupBy("station_id").agg(F.count("*").alias("matched"))
    share = 100.0 * F.count_if(F.col("water_level").isNotNull() & ~F.col("imputed")) / F.count("*")
    own = f.groupBy("station_id").agg(F.count("*").alias("hours"), F.count("water_level").alias("usable"), F.count_if("imputed").alias("n_imputed"), F.round(share, 6).alias("complete_percent"), (share >= 30).alias("qualified"))
    return own.join(matched, "station_id")


@query("coverage_pct", f"WITH {SP}, {q.frame(2.0)}, t AS (SELECT ts FROM f WHERE station_id = 'u0') SELECT station_id, round(100.0 * count(water_level) / (SELECT count(*) FROM t), 6) AS coverage, round(100.0 * (count(*) - count(water_level)) / count(*), 6) AS missing_inside FROM f JOIN t USING (ts) GROUP BY 1")
def coverage_pct(spark, sf):
    f = filled(spark, sf)
    t = f.filter("station_id = 'u0'").select("ts")
    n = t.agg(F.count("*").alias("n"))
    own = f.join(t, "ts", "left_semi").groupBy("station_id").agg(F.count("water_level").alias("usable"), F.count("*").alias("hours")).crossJoin(F.broadcast(n))
    return own.select("station_id", F.round(100.0 * F.col("usable") / F.col("n"), 6).alias("coverage"), F.round(100.0 * (F.col("hours") - F.col("usable")) / F.col("hours"), 6).alias("missing_inside"))


def _bucketed(name, unit, aggregates, sql_aggregates):
    @query(name, f"WITH {SP}, {q.frame(2.0)} SELECT station_id, CAST(date_trunc('{unit}', ts) AS TIMESTAMP) AS bucket, {sql_aggregates} FROM f GROUP BY 1, 2")
    def run(spark, sf):
        return filled(spark, sf).groupBy("station_id", F.date_trunc(unit, "ts").cast("timestamp_ntz").alias("bucket")).agg(*aggregates())

    return run


daily_resample = _bucketed("daily_resample", "day", lambda: [F.min("water_level").alias("lo"), F.round(F.avg("water_level"), 6).alias("mean"), F.max("water_level").alias("hi"), F.round(F.sum("water_level"), 6).alias("total")], "min(water_level) AS lo, round(avg(water_level), 6) AS mean, max(water_level) AS hi, round(sum(water_level), 6) AS total")
weekly_resample = _bucketed("weekly_resample", "week", lambda: [F.round(F.coalesce(F.sum("water_level"), F.lit(0.0)), 6).alias("total"), F.count("*").alias("hours")], "round(coalesce(sum(water_level), 0), 6) AS total, count(*) AS hours")
monthly_completeness = _bucketed("monthly_completeness", "month", lambda: [F.count("*").alias("hours"), F.count("water_level").alias("usable"), F.round(100.0 * F.count("water_level") / F.count("*"), 6).alias("percent")], "count(*) AS hours, count(water_level) AS usable, round(100.0 * count(water_level) / count(*), 6) AS percent")
monthly_imputation = _bucketed("monthly_imputation", "month", lambda: [F.count_if(F.col("water_level").isNotNull() & ~F.col("imputed")).alias("raw"), F.count_if("imputed").alias("n_imputed"), F.count_if(F.col("water_level").isNull()).alias("n_missing")], "CAST(count(CASE WHEN water_level IS NOT NULL AND NOT imputed THEN 1 END) AS BIGINT) AS raw, CAST(count(CASE WHEN imputed THEN 1 END) AS BIGINT) AS n_imputed, count(*) - count(water_level) AS n_missing")
annual_summary = _bucketed("annual_summary", "year", lambda: [F.round(F.avg("water_level"), 6).alias("mean"), F.max("water_level").alias("hi"), F.round(F.sum("water_level"), 4).alias("total"), F.round(100.0 * F.count("water_level") / F.count("*"), 6).alias("coverage")], "round(avg(water_level), 6) AS mean, max(water_level) AS hi, round(sum(water_level), 4) AS total, round(100.0 * count(water_level) / count(*), 6) AS coverage")


@query("seasonality", f"WITH {SP}, {q.frame(2.0)} SELECT CAST(hour(ts) AS BIGINT) AS hour_of_day, round(avg(water_level), 6) AS mean, count(water_level) AS n FROM f GROUP BY 1")
def seasonality(spark, sf):
    return filled(spark, sf).groupBy(F.hour("ts").cast("long").alias("hour_of_day")).agg(F.round(F.avg("water_level"), 6).alias("mean"), F.count("water_level").alias("n"))


@query("histogram", f"""WITH {R}, e AS (SELECT station_id, min(value) AS lo, max(value) AS hi FROM r GROUP BY 1),
c AS (SELECT station_id, CAST(least(floor((value - lo) / ((hi - lo) / 10)), 9) AS BIGINT) AS bin, count(*) AS n FROM r JOIN e USING (station_id) WHERE value IS NOT NULL GROUP BY 1, 2),
k AS (SELECT station_id, CAST(unnest(range(0, 10)) AS BIGINT) AS bin FROM e)
SELECT station_id, bin, CAST(coalesce(n, 0) AS BIGINT) AS n FROM k LEFT JOIN c USING (station_id, bin)""")
def histogram(spark, sf):
    return stats.histogram(src.readings(spark, sf), ["station_id"], "value", 10)


_NUM = ("value", "user_id")


@query("column_health", "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS n, round(100.0 * (count(*) - count({c})) / count(*), 6) AS missing_percent, CAST(count(CASE WHEN isinf(CAST({c} AS DOUBLE)) THEN 1 END) AS BIGINT) AS n_infinite, min(CAST({c} AS DOUBLE)) = max(CAST({c} AS DOUBLE)) AS constant, min(CAST({c} AS DOUBLE)) AS lo, max(CAST({c} AS DOUBLE)) AS hi FROM events" for c in _NUM) + ")")
def column_health(spark, sf):
    rows = table(spark, sf, "events").select(*(F.col(c).cast("double").alias(c) for c in _NUM)).unpivot([], list(_NUM), "column", "v")
    return rows.groupBy("column").agg(F.count("v").alias("n"), F.round(100.0 * (F.count("*") - F.count("v")) / F.count("*"), 6).alias("missing_percent"), F.count_if(F.abs("v") == float("inf")).alias("n_infinite"), (F.min("v") == F.max("v")).alias("constant"), F.min("v").alias("lo"), F.max("v").alias("hi"))


@query("target_coverage", f"WITH {q.ALL} SELECT horizon, count(actual) AS n FROM (SELECT CAST(unnest({q.HOURS}) AS BIGINT) AS horizon, unnest({q.LEVELS}) AS actual FROM ft) GROUP BY 1")
def target_coverage(spark, sf, horizons=ft.EVERY):
    rows = ft.featured(spark, sf, horizons=horizons).select(F.explode(F.array(*(F.struct(F.lit(h).cast("long").alias("horizon"), F.col(f"t{h}").alias("actual")) for h in horizons))).alias("x")).select("x.*")
    return rows.groupBy("horizon").agg(F.count("actual").alias("n"))


@query("eligible_rows", f"WITH {q.ALL} SELECT station_id, split, count(*) AS n_rows, CAST(count(CASE WHEN target_valid THEN 1 END) AS BIGINT) AS n_valid FROM ft GROUP BY 1, 2")
def eligible_rows(spark, sf):
    return ft.featured(spark, sf).groupBy("station_id", "split").agg(F.count("*").alias("n_rows"), F.count_if("target_valid").alias("n_valid"))


@query("exclusion_reasons", f"""WITH {q.ALL}, x AS (SELECT split, NOT target_valid AS no_target, (lag_72 IS NULL OR mean_72 IS NULL OR water_level IS NULL) AS no_predictor, row_number() OVER (PARTITION BY station_id, split ORDER BY ts) <= 72 AS warm FROM ft)
SELECT split, CAST(count(CASE WHEN no_target AND NOT no_predictor THEN 1 END) AS BIGINT) AS target_only, CAST(count(CASE WHEN no_predictor AND NOT no_target THEN 1 END) AS BIGINT) AS predictor_only, CAST(count(CASE WHEN no_target AND no_predictor THEN 1 END) AS BIGINT) AS both_reasons, CAST(count(CASE WHEN no_predictor AND warm THEN 1 END) AS BIGINT) AS warm_up FROM x GROUP BY 1""")
def exclusion_reasons(spark, sf):
    x = ft.featured(spark, sf).select("split", (~F.col("target_valid")).alias("t"), F.expr("lag_72 is null or mean_72 is null or water_level is null").alias("p"), (F.row_number().over(ft.own()) <= 72).alias("warm"))
    t, p = F.col("t"), F.col("p")
    return x.groupBy("split").agg(F.count_if(t & ~p).alias("target_only"), F.count_if(p & ~t).alias("predictor_only"), F.count_if(t & p).alias("both_reasons"), F.count_if(p & F.col("warm")).alias("warm_up"))


@query("weather_sole_cause", f"WITH {q.ALL}, x AS (SELECT split, temp_24 IS NULL AS wx, (lag_72 IS NULL OR mean_72 IS NULL) AS other FROM ft) SELECT split, CAST(count(CASE WHEN wx AND NOT other THEN 1 END) AS BIGINT) AS weather_only, CAST(count(CASE WHEN other AND NOT wx THEN 1 END) AS BIGINT) AS other_only FROM x GROUP BY 1")
def weather_sole_cause(spark, sf):
    x = ft.featured(spark, sf).select("split", F.col("temperature_mean_24").isNull().alias("w"), F.expr("lag_72 is null or mean_72 is null").alias("o"))
    return x.groupBy("split").agg(F.count_if(F.col("w") & ~F.col("o")).alias("weather_only"), F.count_if(F.col("o") & ~F.col("w")).alias("other_only"))


@query("seam_audit", f"WITH {q.ALL} SELECT split, CAST(count(CASE WHEN lag_24 IS NULL THEN 1 END) AS BIGINT) AS null_predictors, CAST(count(CASE WHEN NOT target_valid THEN 1 END) AS BIGINT) AS invalid_targets FROM ft, bound WHERE ts BETWEEN b - INTERVAL 24 HOURS AND b + INTERVAL 24 HOURS GROUP BY 1")
def seam_audit(spark, sf):
    b = ft.boundary(ft.station_frames(spark, sf))
    near = ft.featured(spark, sf).crossJoin(F.broadcast(b)).filter("ts between boundary - interval 24 hours and boundary + interval 24 hours")
    return near.groupBy("split").agg(F.count_if(F.col("lag_24").isNull()).alias("null_predictors"), F.count_if(~F.col("target_valid")).alias("invalid_targets"))


@query("quality_overview", f"WITH {R}, {q.WEATHER} SELECT 'level' AS role, count(*) AS n, CAST(count(CASE WHEN value <= 2 THEN 1 END) AS BIGINT) AS n_odd, min(value) AS lo, max(value) AS hi FROM r UNION ALL SELECT 'precipitation', count(*), CAST(count(CASE WHEN precipitation < 0 THEN 1 END) AS BIGINT), round(min(precipitation), 6), round(max(precipitation), 6) FROM wx")
def quality_overview(spark, sf):
    level = src.readings(spark, sf).agg(F.count("*").alias("n"), F.count_if(F.col("value") <= 2).alias("n_odd"), F.min("value").alias("lo"), F.max("value").alias("hi")).select(F.lit("level").alias("role"), "*")
    rain = src.weather(spark, sf).agg(F.count("*").alias("n"), F.count_if(F.col("precipitation") < 0).alias("n_odd"), F.round(F.min("precipitation"), 6).alias("lo"), F.round(F.max("precipitation"), 6).alias("hi")).select(F.lit("precipitation").alias("role"), "*")
    return level.union(rain)


@query("raw_weather_availability", f"WITH {q.WEATHER}, u AS (SELECT station_id, unnest(['precipitation', 'temperature_2m']) AS variable, unnest([precipitation, temperature_2m]) AS v FROM wx) SELECT station_id, variable, count(*) AS n_rows, count(v) AS available, round(100.0 * count(v) / count(*), 6) AS percent FROM u GROUP BY 1, 2")
def raw_weather_availability(spark, sf):
    u = src.weather(spark, sf).unpivot(["station_id"], ["precipitation", "temperature_2m"], "variable", "v")
    return u.groupBy("station_id", "variable").agg(F.count("*").alias("n_rows"), F.count("v").alias("available"), F.round(100.0 * F.count("v") / F.count("*"), 6).alias("percent"))


@query("standardize", f"WITH {q.BASE} SELECT station_id, round(avg(water_level), 6) AS mean, round(CASE WHEN stddev_pop(water_level) = 0 THEN 1 ELSE stddev_pop(water_level) END, 6) AS scale FROM s WHERE split = 'train' GROUP BY 1")
def standardize(spark, sf):
    sd = F.stddev_pop("water_level")
    return ft.split(ft.station_frames(spark, sf)).filter("split = 'train'").groupBy("station_id").agg(F.round(F.avg("water_level"), 6).alias("mean"), F.round(F.when(sd == 0, 1.0).otherwise(sd), 6).alias("scale"))


@query("alarm_share", f"WITH {R}, {q.frame()} SELECT station_id, round(quantile_cont(water_level, 0.5), 6) AS median, CAST(count(CASE WHEN water_level >= 90 THEN 1 END) AS BIGINT) AS n_alarm, round(avg(CASE WHEN water_level >= 90 THEN 1.0 ELSE 0.0 END), 6) AS share FROM f WHERE water_level IS NOT NULL AND NOT imputed GROUP BY 1")
def alarm_share(spark, sf):
    f = filled(spark, sf, "dense", 0.0).filter("water_level is not null and not imputed")
    high = F.col("water_level") >= 90
    shares = f.groupBy("station_id").agg(F.count_if(high).alias("n_alarm"), F.round(F.avg(high.cast("double")), 6).alias("share"))
    return quantiles_wide(f, ["station_id"], "water_level", {"median": 0.5}).select("station_id", F.round("median", 6).alias("median")).join(shares, "station_id")


_PAIRS = "pa AS (SELECT a.station_id AS a, b.station_id AS b, a.water_level AS x, b.water_level AS y FROM f a JOIN f b ON a.ts = b.ts AND a.station_id < b.station_id)"


def pairs(spark, sf):
    f = filled(spark, sf, "dense", 0.0).select("station_id", "ts", "water_level")
    return f.select(F.col("station_id").alias("a"), "ts", F.col("water_level").alias("x")).join(f.select(F.col("station_id").alias("b"), "ts", F.col("water_level").alias("y")), "ts").filter("a < b")


@query("pearson_pairs", f"WITH {R}, {q.frame()}, {_PAIRS} SELECT a, b, round(corr(x, y), 6) AS r, abs(corr(x, y)) > 0.95 AS redundant FROM pa GROUP BY 1, 2")
def pearson_pairs(spark, sf):
    return pairs(spark, sf).groupBy("a", "b").agg(F.round(F.corr("x", "y"), 6).alias("r"), (F.abs(F.corr("x", "y")) > 0.95).alias("redundant"))


@query("spearman_pairs", f"WITH {R}, {q.frame()}, {_PAIRS}, k AS (SELECT a, b, rank() OVER (PARTITION BY a, b ORDER BY x) + (count(*) OVER (PARTITION BY a, b, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY a, b ORDER BY y) + (count(*) OVER (PARTITION BY a, b, y) - 1) / 2.0 AS ry FROM pa WHERE x IS NOT NULL AND y IS NOT NULL) SELECT a, b, count(*) AS n, round(corr(rx, ry), 6) AS rho FROM k GROUP BY 1, 2")
def spearman_pairs(spark, sf):
    return stats.spearman(pairs(spark, sf), ["a", "b"])


_SCAN = "sc AS (SELECT u.station_id, CAST(lag AS BIGINT) AS lag, round(corr(u.water_level, t.water_level), 6) AS r FROM f u, (SELECT unnest(range(0, 25)) AS lag), f t WHERE t.station_id = 'click' AND u.station_id <> 'click' AND t.ts = u.ts + to_hours(lag) GROUP BY 1, 2)"


def scanned(spark, sf):
    f = filled(spark, sf, "dense", 0.0).select("station_id", "ts", "water_level")
    moved = f.filter("station_id <> 'click'").select("station_id", "water_level", F.explode(F.sequence(F.lit(0), F.lit(24))).alias("lag"), "ts").withColumn("ts", F.expr("ts + make_interval(0, 0, 0, 0, lag)"))
    own = f.filter("station_id = 'click'").select("ts", F.col("water_level").alias("y"))
    return moved.join(own, "ts").groupBy("station_id", F.col("lag").cast("long").alias("lag")).agg(F.round(F.corr("water_level", "y"), 6).alias("r"))


@query("lag_scan", f"WITH {R}, {q.frame()}, {_SCAN} SELECT station_id, lag, r, row_number() OVER (PARTITION BY station_id ORDER BY r DESC, lag) = 1 AS best FROM sc")
def lag_scan(spark, sf):
    """Correlation with the target at every lag, by an equi-join on the shifted hour."""
    return scanned(spark, sf).withColumn("best", F.row_number().over(Window.partitionBy("station_id").orderBy(F.desc("r"), "lag")) == 1)


@query("upstream_sanity", f"WITH {R}, {q.frame()}, {_SCAN}, {q.CATALOG}, t AS (SELECT position_km AS p FROM cat WHERE station_id = 'click'), x AS (SELECT station_id, r, round(abs(position_km - p), 6) AS d FROM sc JOIN cat USING (station_id), t WHERE lag = 0), k AS (SELECT station_id, r, rank() OVER (ORDER BY d) AS by_distance, rank() OVER (ORDER BY r DESC) AS by_r FROM x) SELECT station_id, by_distance, by_r, abs(by_distance - by_r) >= 3 OR r < 0.5 AS flagged FROM k")
def upstream_sanity(spark, sf):
    c = src.catalog(spark, sf)
    t = c.filter("station_id = 'click'").select(F.col("position_km").alias("p"))
    x = scanned(spark, sf).filter("lag = 0").join(c.crossJoin(F.broadcast(t)).select("station_id", F.round(F.abs(F.col("position_km") - F.col("p")), 6).alias("d")), "station_id")
    k = x.select("station_id", "r", F.rank().over(Window.orderBy("d")).cast("long").alias("by_distance"), F.rank().over(Window.orderBy(F.desc("r"))).cast("long").alias("by_r"))
    return k.select("station_id", "by_distance", "by_r", ((F.abs(F.col("by_distance") - F.col("by_r")) >= 3) | (F.col("r") < 0.5)).alias("flagged"))


_FUTURE = "fu AS (SELECT precipitation AS x, lead(water_level, h) OVER (PARTITION BY station_id, h ORDER BY ts) - water_level AS y, CAST(h AS BIGINT) AS horizon FROM (SELECT station_id, ts, water_level, precipitation, unnest([1, 6, 12, 24]) AS h FROM s))"


@query("weather_future_change", f"WITH {q.BASE}, {_FUTURE} SELECT horizon, round(corr(x, y), 6) AS r, count(CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN 1 END) AS n FROM fu GROUP BY 1")
def weather_future_change(spark, sf):
    w = Window.partitionBy("station_id").orderBy("ts")
    rows = ft.station_frames(spark, sf).select("precipitation", *((F.lead("water_level", h).over(w) - F.col("water_level")).alias(str(h)) for h in (1, 6, 12, 24)))
    u = rows.unpivot(["precipitation"], [str(h) for h in (1, 6, 12, 24)], "horizon", "y").withColumn("horizon", F.col("horizon").cast("long"))
    return u.groupBy("horizon").agg(F.round(F.corr("precipitation", "y"), 6).alias("r"), F.count(F.when(F.col("precipitation").isNotNull() & F.col("y").isNotNull(), 1)).alias("n"))


@query("strongest_relationships", f"WITH {R}, {q.frame()}, {_SCAN} SELECT station_id, lag, r FROM sc ORDER BY abs(r) DESC, station_id, lag LIMIT 12")
def strongest_relationships(spark, sf):
    return scanned(spark, sf).orderBy(F.desc(F.abs("r")), "station_id", "lag").limit(12)


_GAPS = "ga AS (SELECT station_id, min(ts) AS start_ts, count(*) AS hours FROM (SELECT station_id, ts, level, row_number() OVER (PARTITION BY station_id ORDER BY ts) - row_number() OVER (PARTITION BY station_id, level IS NULL ORDER BY ts) AS k FROM f) WHERE level IS NULL GROUP BY station_id, k)"


def gaps(spark, sf):
    g = grid.masked(grid.hourly_grid(src.readings(spark, sf, "sparse")), 2.0).withColumn("missing", F.col("value").isNull())
    return grid.runs(g, "missing", ["station_id"]).filter("missing").select("station_id", "start_ts", "hours", "end_ts")


@query("largest_gaps", f"WITH {SP}, {q.frame(2.0)}, {_GAPS} SELECT station_id, start_ts, hours FROM ga ORDER BY hours DESC, station_id, start_ts LIMIT 20")
def largest_gaps(spark, sf):
    return gaps(spark, sf).drop("end_ts").orderBy(F.desc("hours"), "station_id", "start_ts").limit(20)


@query("gap_length_histogram", f"WITH {SP}, {q.frame(2.0)}, {_GAPS}, a AS (SELECT hours, count(*) AS n FROM ga GROUP BY 1), b AS (SELECT hours, count(*) AS n FROM (SELECT station_id, k, count(*) AS hours FROM (SELECT station_id, ts, present, row_number() OVER (PARTITION BY station_id ORDER BY ts) - row_number() OVER (PARTITION BY station_id, present ORDER BY ts) AS k FROM f) WHERE NOT present GROUP BY 1, 2) GROUP BY 1) SELECT hours, CAST(coalesce(a.n, 0) AS BIGINT) AS n_missing, CAST(coalesce(b.n, 0) AS BIGINT) AS n_absent FROM a FULL JOIN b USING (hours)")
def gap_length_histogram(spark, sf):
    absent = grid.runs(grid.hourly_grid(src.readings(spark, sf, "sparse")), "present", ["station_id"]).filter("not present")
    a = gaps(spark, sf).groupBy("hours").agg(F.count("*").alias("n_missing"))
    b = absent.groupBy("hours").agg(F.count("*").alias("n_absent"))
    return a.join(b, "hours", "full_outer").select("hours", F.coalesce("n_missing", F.lit(0)).alias("n_missing"), F.coalesce("n_absent", F.lit(0)).alias("n_absent"))


@query("gap_row_presence", f"WITH {SP}, {q.frame(2.0)}, m AS (SELECT station_id, ts, present, level, row_number() OVER (PARTITION BY station_id ORDER BY ts) - row_number() OVER (PARTITION BY station_id, level IS NULL ORDER BY ts) AS k FROM f) SELECT station_id, min(ts) AS start_ts, bool_and(present) AS throughout FROM m WHERE level IS NULL GROUP BY station_id, k")
def gap_row_presence(spark, sf):
    """Whether the station had a row in all hours of each gap, by an equi-join on station and day before the range."""
    raw = src.readings(spark, sf, "sparse").select("station_id", "ts", F.to_date("ts").alias("day"))
    g = gaps(spark, sf).withColumn("day", F.explode(F.sequence(F.to_date("start_ts"), F.to_date("end_ts"))))
    n = g.join(raw, ["station_id", "day"], "left").groupBy("station_id", "start_ts", "hours").agg(F.count_if(F.col("ts").between(F.col("start_ts"), F.col("end_ts"))).alias("n"))
    return n.select("station_id", "start_ts", (F.col("n") == F.col("hours")).alias("throughout"))


_EPISODES = "ep AS (SELECT station_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS hours, max(water_level) AS peak, CAST(sum(CAST(imputed AS INT)) AS BIGINT) AS n_imputed FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY ts) - row_number() OVER (PARTITION BY station_id, coalesce(water_level >= 60, false) ORDER BY ts) AS k FROM f) WHERE water_level >= 60 GROUP BY station_id, k)"


def episodes(spark, sf):
    w = Window.partitionBy("station_id").orderBy("ts")
    f = filled(spark, sf, "dense", 0.0).withColumn("high", F.coalesce(F.col("water_level") >= 60, F.lit(False)))
    f = f.withColumn("k", F.row_number().over(w) - F.row_number().over(Window.partitionBy("station_id", "high").orderBy("ts"))).filter("high")
    return f.groupBy("station_id", "k").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("hours"), F.max("water_level").alias("peak"), F.min_by("ts", F.struct(-F.col("water_level"), "ts")).alias("peak_ts"), F.sum(F.col("imputed").cast("int")).alias("n_imputed")).drop("k")


@query("alarm_episodes", f"WITH {R}, {q.frame()}, {_EPISODES} SELECT ep.station_id, start_ts, end_ts, hours, peak, n_imputed, (SELECT min(ts) FROM f WHERE f.station_id = ep.station_id AND f.ts BETWEEN start_ts AND end_ts AND water_level = peak) AS peak_ts, round(peak - 60, 6) AS excess FROM ep")
def alarm_episodes(spark, sf):
    return episodes(spark, sf).withColumn("excess", F.round(F.col("peak") - 60, 6))


@query("episode_context", f"WITH {R}, {q.frame()}, {q.WEATHER}, {_EPISODES} SELECT ep.station_id, start_ts, count(precipitation) AS n_rain_24, round(coalesce(sum(precipitation), 0), 6) AS rain_24 FROM ep LEFT JOIN wx ON wx.station_id = ep.station_id AND wx.ts >= start_ts - INTERVAL 24 HOURS AND wx.ts < start_ts GROUP BY 1, 2")
def episode_context(spark, sf):
    """Rain of the 24 hours before each episode: a range join with station and day as equi-keys."""
    e = episodes(spark, sf).select("station_id", "start_ts", F.explode(F.array(F.to_date(F.expr("start_ts - interval 24 hours")), F.to_date("start_ts"))).alias("day"))
    rain = src.weather(spark, sf).select("station_id", "ts", "precipitation", F.to_date("ts").alias("day"))
    inside = F.when((F.col("ts") >= F.expr("start_ts - interval 24 hours")) & (F.col("ts") < F.col("start_ts")), F.col("precipitation"))
    return e.join(rain, ["station_id", "day"], "left").groupBy("station_id", "start_ts").agg(F.count(inside).alias("n_rain_24"), F.round(F.coalesce(F.sum(inside), F.lit(0.0)), 6).alias("rain_24"))


_SERIES = "se AS (SELECT row_number() OVER (ORDER BY ts) AS i, water_level AS x FROM f WHERE station_id = 'click' AND water_level IS NOT NULL)"


def series(spark, sf):
    return filled(spark, sf, "dense", 0.0).filter("station_id = 'click' and water_level is not null").select(F.row_number().over(Window.partitionBy("station_id").orderBy("ts")).cast("long").alias("i"), F.col("water_level").alias("x"))


_ACF = "mo AS (SELECT avg(x) AS m, count(*) AS n, var_pop(x) AS v FROM se), ac AS (SELECT CAST(lag AS BIGINT) AS lag, sum((a.x - m) * (b.x - m)) / n / v AS rho, n FROM se a, (SELECT unnest(range(0, 25)) AS lag), se b, mo WHERE b.i = a.i + lag GROUP BY lag, n, v)"


@query("acf", f"WITH {R}, {q.frame()}, {_SERIES}, {_ACF} SELECT lag, round(rho, 6) AS rho FROM ac")
def acf(spark, sf):
    return stats.autocorrelations(series(spark, sf), 24).select("lag", F.round("rho", 6).alias("rho"))


@query("ljung_box_q", f"WITH {R}, {q.frame()}, {_SERIES}, {_ACF} SELECT round(sum(n * (n + 2.0) * rho * rho / (n - lag)), 4) AS q FROM ac WHERE lag > 0")
def ljung_box_q(spark, sf):
    a = stats.autocorrelations(series(spark, sf), 24).filter("lag > 0")
    return a.agg(F.round(F.sum(F.col("n") * (F.col("n") + 2.0) * F.col("rho") * F.col("rho") / (F.col("n") - F.col("lag"))), 4).alias("q"))


@query("kpss_stat", f"WITH {R}, {q.frame()}, {_SERIES}, {_ACF}, cu AS (SELECT sum(x - m) OVER (ORDER BY i) AS s, n, v FROM se, mo), lr AS (SELECT max(v) * (1 + 2 * sum(CASE WHEN lag BETWEEN 1 AND 12 THEN (1 - lag / 13.0) * rho END)) AS omega FROM ac, mo) SELECT round(sum(s * s) / (max(n) * max(n)) / max(omega), 5) AS kpss FROM cu, lr")
def kpss_stat(spark, sf):
    """Cumulative sums of the centred series against the long-run variance with Bartlett weights to lag 12."""
    s = series(spark, sf)
    m = s.agg(F.avg("x").alias("m"), F.count("*").alias("n"), F.var_pop("x").alias("v"))
    cum = s.crossJoin(F.broadcast(m)).select(F.sum(F.col("x") - F.col("m")).over(Window.partitionBy("n").orderBy("i")).alias("s"), "n", "v")
    weighted = stats.autocorrelations(s, 12).filter("lag > 0").agg(F.sum((1 - F.col("lag") / 13.0) * F.col("rho")).alias("w"))
    return cum.agg((F.sum(F.col("s") * F.col("s")) / (F.first("n") * F.first("n"))).alias("eta"), F.first("v").alias("v")).crossJoin(weighted).select(F.round(F.col("eta") / (F.col("v") * (1 + 2 * F.col("w"))), 5).alias("kpss"))
