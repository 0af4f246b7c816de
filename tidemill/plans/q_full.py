"""Registered queries at the full widths of the task: all lags and context hours, six feature subsets, planted violations, closed-form fits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.functions import stats
from tidemill.operators import features as ft
from tidemill.operators import grid, models
from tidemill.operators import runlog as rl
from tidemill.plans import q_eda, q_runlog
from tidemill.plans import sql as q
from tidemill.plans.catalogue import query
from tidemill.plans.q_eda import _ACF, _EPISODES, _QUART, _SCAN, _SERIES, filled, preds, quartiles, series
from tidemill.plans.stored import stored, table
from tidemill.sources import readings as src

R, SP = q.readings(), q.readings("sparse")

# base names of the joined frame, and the columns that stand for them
NAMES = {"water_level": "water_level", "imputed": "imputed", "water_level_lag_24h": "lag_24", "water_level_change_24h": "change_24", "water_level_rolling_mean_24h": "mean_24", "precipitation": "precipitation", "temperature_2m": "temperature_2m"}
_LONG = f"""lw AS (SELECT station_id, ts, unnest([{", ".join(f"'{n}'" for n in NAMES)}]) AS base,
  unnest([water_level, CAST(CAST(imputed AS INT) AS DOUBLE), lag_24, water_level - lag_24, mean_24, precipitation, temperature_2m]) AS value FROM ft WHERE ts IN (SELECT ts FROM ft WHERE station_id = 'click'))"""
_HYDRO = "(base IN ('water_level', 'imputed') OR starts_with(base, 'water_level_') OR starts_with(base, 'imputed_count_') OR starts_with(base, 'utc_'))"
_MEMBERS = f"""[CASE WHEN true THEN 'full' END, CASE WHEN {_HYDRO} THEN 'all_station_hydrology_quality_time' END,
  CASE WHEN base IN ('water_level', 'imputed', 'precipitation', 'temperature_2m') THEN 'raw_all_stations' END, CASE WHEN station_id = 'click' THEN 'target_station_full' END,
  CASE WHEN station_id = 'click' AND {_HYDRO} THEN 'target_station_hydrology_quality_time' END, CASE WHEN base = 'water_level' THEN 'current_water_levels_all_stations' END]"""


def long_frame(spark, sf):
    """``(station_id, ts, base, value)``: the joined frame of the target's hours with a row for each column."""
    f = ft.featured(spark, sf).withColumn("imputed", F.col("imputed").cast("double"))
    hours = f.filter(F.col("station_id") == ft.TARGET).select("ts")
    wide = f.join(hours, "ts", "left_semi").select("station_id", "ts", *(F.col(c).cast("double").alias(n) for n, c in NAMES.items()))
    return wide.unpivot(["station_id", "ts"], list(NAMES), "base", "value")


@query("six_feature_subsets", f"""WITH {q.BASE}, {q.FEATURES}, {_LONG}, me AS (SELECT station_id, ts, base, value, unnest({_MEMBERS}) AS subset FROM lw),
co AS (SELECT subset, count(DISTINCT station_id || '__' || base) AS n_columns FROM me WHERE subset IS NOT NULL GROUP BY 1),
ho AS (SELECT subset, ts, count(value) AS n FROM me WHERE subset IS NOT NULL GROUP BY 1, 2)
SELECT subset, n_columns, CAST(count(CASE WHEN n = n_columns THEN 1 END) AS BIGINT) AS n_complete FROM ho JOIN co USING (subset) GROUP BY 1, 2""")
def six_feature_subsets(spark, sf):
    """Columns of each ablation subset by predicates over their names, and the hours at which all of them have values."""
    rows = long_frame(spark, sf)
    base, own = F.col("base"), F.col("station_id") == ft.TARGET
    hydro = base.isin("water_level", "imputed") | base.rlike("^(water_level_|imputed_count_|utc_)")
    rules = {"full": F.lit(True), "all_station_hydrology_quality_time": hydro, "raw_all_stations": base.isin("water_level", "imputed", "precipitation", "temperature_2m"), "target_station_full": own, "target_station_hydrology_quality_time": own & hydro, "current_water_levels_all_stations": base == "water_level"}
    member = rows.withColumn("subset", F.explode(F.array_compact(F.array(*(F.when(r, n) for n, r in rules.items())))))
    # one aggregate by hour carries the hour's columns along, so the frame is read once
    hours = stored(member.groupBy("subset", "ts").agg(F.count("value").alias("n"), F.collect_set(F.concat("station_id", F.lit("__"), "base")).alias("names")), "subset-hours")
    columns = hours.select("subset", F.explode("names").alias("c")).groupBy("subset").agg(F.count_distinct("c").alias("n_columns"))
    return hours.join(F.broadcast(columns), "subset").groupBy("subset", "n_columns").agg(F.count_if(F.col("n") == F.col("n_columns")).alias("n_complete"))


@query("log1p_columns", f"""WITH {q.BASE}, {q.FEATURES}, {_LONG} SELECT station_id || '__' || base AS column_name, base = 'water_level' OR regexp_matches(base, '^water_level_(lag|rolling_mean|rolling_min|rolling_max)_') AS eligible,
count(value) AS n, CAST(count(CASE WHEN value > 0 THEN 1 END) AS BIGINT) AS n_positive FROM lw GROUP BY 1, 2""")
def log1p_columns(spark, sf):
    """Which columns take log1p, by the name after the station's prefix: levels and their lags, means and extremes."""
    name = F.concat("station_id", F.lit("__"), "base")
    base = F.substring_index(F.col("column_name"), "__", -1)
    eligible = (base == "water_level") | base.rlike("^water_level_(lag|rolling_mean|rolling_min|rolling_max)_")
    counts = long_frame(spark, sf).groupBy(name.alias("column_name")).agg(F.count("value").alias("n"), F.count_if(F.col("value") > 0).alias("n_positive"))
    return counts.select("column_name", eligible.alias("eligible"), "n", "n_positive")


@query("top_episodes", f"WITH {R}, {q.frame()}, {_EPISODES} SELECT station_id, start_ts, end_ts, hours, peak FROM ep ORDER BY peak DESC, hours DESC, start_ts, station_id LIMIT 5")
def top_episodes(spark, sf):
    """The five highest episodes, the longer of equals first."""
    return q_eda.episodes(spark, sf).orderBy(F.desc("peak"), F.desc("hours"), "start_ts", "station_id").limit(5).select("station_id", "start_ts", "end_ts", "hours", "peak")


@query("trailing_segment", f"WITH {SP}, {q.frame(2.0)}, lo AS (SELECT station_id, max(CASE WHEN water_level IS NULL THEN ts END) AS gap, min(ts) AS first_ts, max(ts) AS last_ts FROM f GROUP BY 1) SELECT station_id, count(CASE WHEN gap IS NULL OR ts > gap THEN 1 END) AS hours, min(CASE WHEN gap IS NULL OR ts > gap THEN ts END) AS start_ts FROM f JOIN lo USING (station_id) GROUP BY 1")
def trailing_segment(spark, sf):
    """The hours after the last missing one of each series: one window-free pass over a small side of last gaps."""
    f = filled(spark, sf)
    gap = f.groupBy("station_id").agg(F.max(F.when(F.col("water_level").isNull(), F.col("ts"))).alias("gap"))
    after = F.col("gap").isNull() | (F.col("ts") > F.col("gap"))
    return f.join(gap, "station_id").groupBy("station_id").agg(F.count_if(after).alias("hours"), F.min(F.when(after, F.col("ts"))).alias("start_ts"))


@query("acf_168", f"WITH {R}, {q.frame()}, {_SERIES}, {_ACF.replace('range(0, 25)', 'range(0, 169)')} SELECT lag, round(rho, 6) AS rho FROM ac")
def acf_168(spark, sf):
    """Autocorrelations over a week of hours."""
    return stats.autocorrelations(series(spark, sf), 168).select("lag", F.round("rho", 6).alias("rho"))


@query("ljung_box_lags", f"WITH {R}, {q.frame()}, {_SERIES}, {_ACF.replace('range(0, 25)', 'range(0, 169)')} SELECT CAST(upto AS BIGINT) AS lags, round(sum(n * (n + 2.0) * rho * rho / (n - lag)), 4) AS q FROM ac, (SELECT unnest([24, 72, 168]) AS upto) WHERE lag BETWEEN 1 AND upto GROUP BY 1")
def ljung_box_lags(spark, sf):
    a = stats.autocorrelations(series(spark, sf), 168).filter("lag > 0").withColumn("lags", F.explode(F.array(*(F.lit(k).cast("long") for k in (24, 72, 168))))).filter("lag <= lags")
    return a.groupBy("lags").agg(F.round(F.sum(F.col("n") * (F.col("n") + 2.0) * F.col("rho") * F.col("rho") / (F.col("n") - F.col("lag"))), 4).alias("q"))


@query("lag_scan_72", f"WITH {R}, {q.frame()}, {_SCAN.replace('range(0, 25)', 'range(0, 73)')} SELECT station_id, lag, r, row_number() OVER (PARTITION BY station_id ORDER BY r DESC, lag) = 1 AS best FROM sc")
def lag_scan_72(spark, sf):
    """Correlation with the target at every lag up to three days."""
    f = filled(spark, sf, "dense", 0.0).select("station_id", "ts", "water_level")
    w = Window.partitionBy("station_id").orderBy("ts")
    own = f.filter("station_id = 'click'").select("ts", F.col("water_level").alias("y"))
    # one join on the hour; each row brings its last levels along, and lags part only within the sums
    trailing = f.filter("station_id <> 'click'").select("station_id", "ts", F.array(*(F.lag("water_level", k).over(w) for k in range(73))).alias("x"))
    pairs = trailing.join(own, "ts").select("station_id", "y", F.posexplode("x").alias("lag", "x"))
    found = pairs.groupBy("station_id", F.col("lag").cast("long").alias("lag")).agg(F.round(F.corr("x", "y"), 6).alias("r"))
    return found.withColumn("best", F.row_number().over(Window.partitionBy("station_id").orderBy(F.desc("r"), "lag")) == 1)


@query("complete_context_48", f"WITH {R}, {q.frame()}, c AS (SELECT station_id, ts, count(CASE WHEN water_level IS NOT NULL AND NOT imputed THEN 1 END) OVER (PARTITION BY station_id ORDER BY ts ROWS BETWEEN 48 PRECEDING AND 48 FOLLOWING) AS n FROM f) SELECT station_id, ts FROM c WHERE n = 97")
def complete_context_48(spark, sf):
    """Hours with two complete, observed days on both sides."""
    n = F.count_if(F.col("water_level").isNotNull() & ~F.col("imputed")).over(Window.partitionBy("station_id").orderBy("ts").rowsBetween(-48, 48))
    return filled(spark, sf, "dense", 0.0).withColumn("n", n).filter("n = 97").select("station_id", "ts")


@query("seasonality_month", f"WITH {SP}, {q.frame(2.0)} SELECT CAST(month(ts) AS BIGINT) AS month_of_year, round(avg(water_level), 6) AS mean, count(water_level) AS n FROM f GROUP BY 1")
def seasonality_month(spark, sf):
    return filled(spark, sf).groupBy(F.month("ts").cast("long").alias("month_of_year")).agg(F.round(F.avg("water_level"), 6).alias("mean"), F.count("water_level").alias("n"))


@query("weekly_sunday", f"WITH {SP}, {q.frame(2.0)}, w AS (SELECT station_id, CAST(date_trunc('week', ts) AS DATE) + 6 AS sunday, coalesce(sum(water_level), 0) AS total, max(water_level) AS hi FROM f GROUP BY 1, 2) SELECT station_id, CAST(sunday AS TIMESTAMP) AS sunday, round(total, 6) AS total, hi, round((hi - avg(hi) OVER (PARTITION BY station_id)) / nullif(stddev_samp(hi) OVER (PARTITION BY station_id), 0), 5) AS z FROM w")
def weekly_sunday(spark, sf):
    """Weeks from Monday to the Sunday that names them, with the z-score of their highest level among the station's weeks."""
    w = filled(spark, sf).groupBy("station_id", F.date_add(F.date_trunc("week", "ts").cast("date"), 6).alias("sunday")).agg(F.coalesce(F.sum("water_level"), F.lit(0.0)).alias("total"), F.max("water_level").alias("hi"))
    own = Window.partitionBy("station_id")
    z = (F.col("hi") - F.avg("hi").over(own)) / F.nullif(F.stddev_samp("hi").over(own), F.lit(0.0))
    return w.select("station_id", F.col("sunday").cast("timestamp_ntz").alias("sunday"), F.round("total", 6).alias("total"), "hi", F.round(z, 5).alias("z"))


_TEXTS = "CASE event_id % 7 WHEN 0 THEN CAST(user_id % 50 AS VARCHAR) WHEN 1 THEN '-3' WHEN 2 THEN '2.5' WHEN 3 THEN 'nan' WHEN 4 THEN 'inf' WHEN 5 THEN '' ELSE 'x' || user_id END"


@query("parameter_gates", f"WITH t AS (SELECT event_id, {_TEXTS} AS text FROM events) SELECT event_id, regexp_matches(text, '^[0-9]+$') AND coalesce(TRY_CAST(text AS BIGINT), 0) > 0 AS positive_integer, coalesce(isfinite(TRY_CAST(nullif(text, '') AS DOUBLE)), false) AS finite FROM t")
def parameter_gates(spark, sf):
    """Logged texts that pass as positive integers and as finite numbers."""
    k = F.col("event_id") % 7
    text = F.when(k == 0, (F.col("user_id") % 50).cast("string")).when(k == 1, "-3").when(k == 2, "2.5").when(k == 3, "nan").when(k == 4, "inf").when(k == 5, "").otherwise(F.concat(F.lit("x"), F.col("user_id").cast("string")))
    t = table(spark, sf, "events").select("event_id", text.alias("text"))
    number = F.col("text").try_cast("double")
    finite = F.coalesce(~F.isnan(number) & (F.abs(number) < float("inf")), F.lit(False))
    return t.select("event_id", (F.col("text").rlike("^[0-9]+$") & (F.coalesce(F.col("text").try_cast("long"), F.lit(0)) > 0)).alias("positive_integer"), (number.isNotNull() & finite).alias("finite"))


@query("frame_digest", f"WITH {SP}, {q.frame(2.0)} SELECT station_id, count(*) AS n_rows, CAST(sum(CAST('0x' || substr(md5(station_id || '|' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '|' || coalesce(CAST(CAST(round(water_level * 1000) AS BIGINT) AS VARCHAR), '')), 1, 8) AS BIGINT)) AS BIGINT) AS digest FROM f GROUP BY 1")
def frame_digest(spark, sf):
    """A digest of each series' content that doesn't depend on the order of its rows: a sum of row digests."""
    text = F.concat_ws("|", "station_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.coalesce(F.round(F.col("water_level") * 1000).cast("long").cast("string"), F.lit("")))
    return filled(spark, sf).groupBy("station_id").agg(F.count("*").alias("n_rows"), F.sum(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")).alias("digest"))


_BOUNDS = "[{'regime': 'q1', 'lo': NULL, 'hi': q25}, {'regime': 'q2', 'lo': q25, 'hi': q50}, {'regime': 'q3', 'lo': q50, 'hi': q75}, {'regime': 'q4', 'lo': q75, 'hi': NULL}, {'regime': 'alarm', 'lo': 90.0::DOUBLE, 'hi': NULL}]"


@query("regime_provenance", f"""WITH {q.ALL}, {_QUART}, b AS (SELECT n_reference, unnest({_BOUNDS}, recursive := true) FROM qt),
m AS (SELECT regime, count(CASE WHEN model = 'persistence' THEN 1 END) AS np, count(CASE WHEN model = 'linear' THEN 1 END) AS nl FROM b LEFT JOIN pr ON CASE WHEN regime = 'alarm' THEN actual >= lo ELSE (lo IS NULL OR actual > lo) AND (hi IS NULL OR actual <= hi) END GROUP BY 1)
SELECT regime, round(lo, 6) AS lower_bound, round(hi, 6) AS upper_bound, n_reference, np AS n_values, np = nl AS counts_agree FROM b JOIN m USING (regime)""")
def regime_provenance(spark, sf):
    """The bounds of each regime, the number of training levels that they come from, and whether the models' counts agree."""
    qt = quartiles(spark, sf)
    edge = lambda n, lo, hi: F.struct(F.lit(n).alias("regime"), lo.cast("double").alias("lo"), hi.cast("double").alias("hi"))
    none = F.lit(None)
    b = qt.select("n_reference", F.explode(F.array(edge("q1", none, F.col("q25")), edge("q2", F.col("q25"), F.col("q50")), edge("q3", F.col("q50"), F.col("q75")), edge("q4", F.col("q75"), none), edge("alarm", F.lit(90.0), none))).alias("b")).select("n_reference", "b.*")
    v = F.col("actual")
    inside = F.when(F.col("regime") == "alarm", v >= F.col("lo")).otherwise((F.col("lo").isNull() | (v > F.col("lo"))) & (F.col("hi").isNull() | (v <= F.col("hi"))))
    # five rows of bounds meet the forecasts' counts by distinct value, so only values, not forecasts, are compared with them
    values = preds(spark, sf).groupBy("actual").agg(F.count_if(F.col("model") == "persistence").alias("p"), F.count_if(F.col("model") == "linear").alias("l"))
    each = values.crossJoin(F.broadcast(b)).filter(inside).groupBy("regime").agg(F.sum("p").alias("np"), F.sum("l").alias("nl"))
    zero = F.lit(0).cast("long")
    out = b.join(each, "regime", "left").withColumns({"np": F.coalesce("np", zero), "nl": F.coalesce("nl", zero)})
    return out.select("regime", F.round("lo", 6).alias("lower_bound"), F.round("hi", 6).alias("upper_bound"), "n_reference", F.col("np").alias("n_values"), (F.col("np") == F.col("nl")).alias("counts_agree"))


@query("metric_violations", f"""WITH {q_runlog.LOG}, pl AS (SELECT run_id, name, CASE WHEN name LIKE '%rmse_mean' AND param = 6 THEN -value WHEN name LIKE '%mae_mean' AND param = 12 THEN NULL WHEN name LIKE '%me_mean' AND param = 3 THEN 'nan'::DOUBLE ELSE value END AS value FROM lo
UNION ALL SELECT run_id, name, value FROM lo WHERE name = 'cv_mae_std' AND param = 24)
SELECT run_id, name, rule FROM (SELECT run_id, name, CASE WHEN value IS NULL THEN 'missing' WHEN isnan(value) THEN 'not finite' WHEN value < 0 AND regexp_matches(name, 'mae|rmse') THEN 'negative' END AS rule FROM pl) WHERE rule IS NOT NULL
UNION ALL SELECT run_id, name, 'repeated' FROM pl GROUP BY 1, 2 HAVING count(*) > 1""")
def metric_violations(spark, sf):
    """A run log with planted faults (negative errors, missing and undefined values, repeated rows) and the rule that each breaks."""
    t = stored(rl.tidy(q_runlog.log(spark, sf)).select("run_id", "name", "param", "value"), "tidy")
    name, param = F.col("name"), F.col("param")
    value = F.when(name.endswith("rmse_mean") & (param == 6), -F.col("value")).when(name.endswith("mae_mean") & (param == 12), F.lit(None)).when(name.endswith("me_mean") & (param == 3), F.lit(float("nan"))).otherwise(F.col("value"))
    planted = t.withColumn("value", value).union(t.filter("name = 'cv_mae_std' and param = 24"))
    v = F.col("value")
    rule = F.when(v.isNull(), "missing").when(F.isnan(v), "not finite").when((v < 0) & name.rlike("mae|rmse"), "negative")
    single = planted.select("run_id", "name", rule.alias("rule")).filter("rule is not null")
    return single.union(planted.groupBy("run_id", "name").count().filter("count > 1").select("run_id", "name", F.lit("repeated")))


@query("verify_recomputed", f"""WITH {q_runlog.LOG}, a AS (SELECT model, subset, param, unnest(['mae_mean', 'rmse_mean', 'me_mean', 'r2_mean']) AS name, unnest([mae_mean, rmse_mean, me_mean, r2_mean]) AS again FROM cs),
l AS (SELECT experiment AS model, subset, param, replace(name, 'cv_', '') AS name, CASE WHEN param = 24 THEN value + 0.01 ELSE value END AS value FROM lo WHERE execution = 'e1' AND name LIKE '%_mean' AND NOT (param = 12 AND name = 'cv_mae_mean') UNION ALL SELECT DISTINCT experiment, subset, CAST(99 AS BIGINT), 'mae_mean', 1.0::DOUBLE FROM lo)
SELECT model, subset, param, name, CASE WHEN again IS NULL THEN 'not recomputed' WHEN value IS NULL THEN 'not logged' WHEN abs(value - again) <= 1e-6 + 1e-6 * abs(again) THEN 'equal' ELSE 'differs' END AS status FROM l FULL JOIN a USING (model, subset, param, name)""")
def verify_recomputed(spark, sf):
    """Logged metrics against those computed again from the folds, by a full join: some log rows are altered, left out or added."""
    scores = stored(rl.candidates(spark, sf), "scores")
    key = [*rl.KEY, "name"]
    again = rl.summaries(scores).select(*rl.KEY, F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("again")) for n in ("mae_mean", "rmse_mean", "me_mean", "r2_mean")))).alias("x")).select(*rl.KEY, "x.*")
    logged = rl.tidy(rl.run_log(rl.summaries(scores))).filter("execution = 'e1' and stat = 'mean' and not (param = 12 and name = 'cv_mae_mean')")
    logged = logged.select(F.col("experiment").alias("model"), "subset", "param", F.regexp_replace("name", "^cv_", "").alias("name"), F.when(F.col("param") == 24, F.col("value") + 0.01).otherwise(F.col("value")).alias("value"))
    extra = logged.select("model", "subset", F.lit(99).cast("long"), F.lit("mae_mean"), F.lit(1.0)).distinct()
    both = logged.union(extra).join(again, key, "full")
    status = F.when(F.col("again").isNull(), "not recomputed").when(F.col("value").isNull(), "not logged").when(F.abs(F.col("value") - F.col("again")) <= 1e-6 + 1e-6 * F.abs("again"), "equal").otherwise("differs")
    return both.select(*key, status.alias("status"))


@query("cv_fold_summary", f"WITH {q_runlog.CAND} SELECT model, subset, param, metric, count(*) AS folds, round(avg(v) + 1e-9, 5) AS mean, round(stddev_pop(v) + 1e-9, 5) AS std FROM (SELECT model, subset, param, unnest(['mae', 'rmse', 'me', 'r2']) AS metric, unnest([mae, rmse, me, r2]) AS v FROM fs) GROUP BY 1, 2, 3, 4")
def cv_fold_summary(spark, sf):
    """Mean and population deviation over folds of every metric."""
    long = rl.candidates(spark, sf).unpivot(rl.KEY, list(rl.MEASURES), "metric", "v")
    return long.groupBy(*rl.KEY, "metric").agg(F.count("*").alias("folds"), F.round(F.avg("v") + ft.NUDGE, 5).alias("mean"), F.round(F.stddev_pop("v") + ft.NUDGE, 5).alias("std"))


_DESCRIBED = "count(v) AS n, round(avg(v), 5) AS mean, round(stddev_samp(v), 5) AS std, round(min(v), 5) AS lo, round(quantile_cont(v, 0.25), 5) AS q25, round(quantile_cont(v, 0.5), 5) AS q50, round(quantile_cont(v, 0.75), 5) AS q75, round(max(v), 5) AS hi"


@query("first_step_described", f"WITH {q.ALL}, d AS (SELECT unnest(['actual', 'predicted']) AS kind, unnest([t1 - water_level, 0.3::DOUBLE * (mean_24 - water_level) + 0.1::DOUBLE * (lag_24 - water_level)]) AS v FROM tc) SELECT kind, {_DESCRIBED} FROM d GROUP BY 1")
def first_step_described(spark, sf):
    """All of describe() for the first step's change, actual and predicted."""
    c = ft.target_cohort(ft.featured(spark, sf))
    linear = 0.3 * (F.col("mean_24") - F.col("water_level")) + 0.1 * (F.col("lag_24") - F.col("water_level"))
    both = c.select(F.explode(F.array(F.struct(F.lit("actual").alias("kind"), (F.col("t1") - F.col("water_level")).alias("v")), F.struct(F.lit("predicted").alias("kind"), linear.alias("v")))).alias("x")).select("x.*")
    at = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    d = both.groupBy("kind").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("lo"), at.alias("p"), F.max("v").alias("hi"))
    return d.select("kind", "n", *(F.round(c, 5).alias(n) for n, c in (("mean", F.col("mean")), ("std", F.col("std")), ("lo", F.col("lo")), ("q25", F.col("p")[0]), ("q50", F.col("p")[1]), ("q75", F.col("p")[2]), ("hi", F.col("hi")))))


@query("ar2_closed_form", f"""WITH {q.readings('user')}, {q.frame()}, d AS (SELECT station_id, water_level AS y, lag(water_level, 1) OVER w AS a, lag(water_level, 2) OVER w AS b FROM f WINDOW w AS (PARTITION BY station_id ORDER BY ts)),
m AS (SELECT station_id, count(*) AS n, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS cab, covar_pop(a, y) AS cay, covar_pop(b, y) AS cby FROM d WHERE y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL GROUP BY 1)
SELECT station_id, n, round((cay * vb - cby * cab) / (va * vb - cab * cab), 4) AS l1, round((cby * va - cay * cab) / (va * vb - cab * cab), 4) AS l2 FROM m WHERE n >= 10 AND va * vb - cab * cab > 1e-3 * va * vb""")
def ar2_closed_form(spark, sf):
    """Autoregressions of order two over one series per user, solved in column expressions on the groups' moments: any number
    of series, and no Python. Series with under ten complete rows or nearly dependent lags have no fit."""
    d = models.ar_rows(grid.gap_filled(src.readings(spark, sf, "user")), 2)
    m = d.groupBy("station_id").agg(F.count("*").alias("n"), F.var_pop("l1").alias("va"), F.var_pop("l2").alias("vb"), F.covar_pop("l1", "l2").alias("cab"), F.covar_pop("l1", "water_level").alias("cay"), F.covar_pop("l2", "water_level").alias("cby"))
    det = F.col("va") * F.col("vb") - F.col("cab") * F.col("cab")
    fit = m.withColumn("det", det).filter("n >= 10 and det > 1e-3 * va * vb")
    return fit.select("station_id", "n", F.round((F.col("cay") * F.col("vb") - F.col("cby") * F.col("cab")) / F.col("det"), 4).alias("l1"), F.round((F.col("cby") * F.col("va") - F.col("cay") * F.col("cab")) / F.col("det"), 4).alias("l2"))


@query("coefficient_ranking", f"""WITH {R}, {q.frame()}, d AS (SELECT station_id, water_level AS y, lag(water_level, 1) OVER w AS a, lag(water_level, 2) OVER w AS b FROM f WINDOW w AS (PARTITION BY station_id ORDER BY ts)),
m AS (SELECT station_id, var_pop(a) AS va, var_pop(b) AS vb, covar_pop(a, b) AS cab, covar_pop(a, y) AS cay, covar_pop(b, y) AS cby FROM d WHERE y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL GROUP BY 1),
c AS (SELECT station_id, unnest(['l1', 'l2']) AS feature, round(unnest([(cay * vb - cby * cab), (cby * va - cay * cab)]) / (va * vb - cab * cab), 5) AS coefficient FROM m)
SELECT station_id, feature, coefficient, row_number() OVER (PARTITION BY station_id ORDER BY abs(coefficient) DESC, feature) AS place FROM c""")
def coefficient_ranking(spark, sf):
    """The fitted coefficients of each station by their size, the intercept left out."""
    fitted = models.ridge(models.ar_rows(grid.gap_filled(src.readings(spark, sf)), 2), ["station_id"], ["l1", "l2"], "water_level", [0.0]).filter("feature <> 'intercept'")
    c = fitted.select("station_id", "feature", F.round("coefficient", 5).alias("coefficient"))
    return c.withColumn("place", F.row_number().over(Window.partitionBy("station_id").orderBy(F.desc(F.abs("coefficient")), "feature")).cast("long"))


@query("channel_windows", f"""WITH {q.BASE}, w AS (SELECT station_id, split, ts, count(water_level) OVER k AS n, count(*) OVER k AS m, first_value(water_level) OVER k AS first_level, sum(water_level) OVER k AS total, CAST(sum(CAST(imputed AS INT)) OVER k AS BIGINT) AS n_imputed, sum(precipitation) OVER k AS rain FROM s WINDOW k AS (PARTITION BY station_id, split ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
SELECT station_id, ts, first_level, round(total, 5) AS total, n_imputed, round(rain, 5) AS rain FROM w WHERE n = 24 AND m = 24""")
def channel_windows(spark, sf):
    """Windows of a day with three channels (level, imputed, rain) as one array of structs; those with all levels stay."""
    frame = ft.own().rowsBetween(-23, 0)
    s = ft.split(ft.station_frames(spark, sf)).withColumn("w", F.collect_list(F.struct("water_level", "imputed", "precipitation")).over(frame)).filter(F.size("w") == 24)
    s = s.filter(F.forall("w", lambda x: x["water_level"].isNotNull()))
    total = lambda f: F.aggregate("w", F.lit(0.0), lambda a, x: a + F.coalesce(f(x).cast("double"), F.lit(0.0)))
    rain = F.when(F.exists("w", lambda x: x["precipitation"].isNotNull()), total(lambda x: x["precipitation"]))
    return s.select("station_id", "ts", F.col("w")[0]["water_level"].alias("first_level"), F.round(total(lambda x: x["water_level"]), 5).alias("total"), total(lambda x: x["imputed"].cast("int")).cast("long").alias("n_imputed"), F.round(rain, 5).alias("rain"))


@query("grid_points", f"WITH g AS (SELECT event_type AS station_id, date_trunc('day', ts) AS day, user_id % 3 + CASE WHEN event_type = 'view' THEN 0 ELSE user_id % 3 * -1 END AS lat FROM events WHERE event_id % 3 <> 0) SELECT station_id, day, count(DISTINCT lat) = 1 AS single FROM g GROUP BY 1, 2")
def grid_points(spark, sf):
    """Whether a day's weather of a station comes from one point; one station's readings have three."""
    e = table(spark, sf, "events").filter("event_id % 3 <> 0")
    lat = F.when(F.col("event_type") == "view", F.col("user_id") % 3).otherwise(0)
    return e.groupBy(F.col("event_type").alias("station_id"), F.date_trunc("DAY", "ts").cast("timestamp_ntz").alias("day")).agg((F.count_distinct(lat) == 1).alias("single"))
