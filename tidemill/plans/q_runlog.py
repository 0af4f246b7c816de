"""Registered queries: candidate search, selection and the run log."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.operators import features as ft
from tidemill.operators import runlog as rl
from tidemill.plans import sql as q
from tidemill.plans.catalogue import query
from tidemill.plans.q_eda import preds
from tidemill.plans.q_series import _FOLDS
from tidemill.plans.stored import shared_dir, stored, table

_LIST = lambda f: "[" + ", ".join([f("water_level"), *(f(f"lag_{k}") for k in rl.LAG_PARAMS[1:]), *(f(f"mean_{w}") for w in rl.MEAN_PARAMS)]) + "]"
_MODELS = "[" + ", ".join(["'lag'"] * len(rl.LAG_PARAMS) + ["'mean'"] * len(rl.MEAN_PARAMS)) + "]"
_PARAMS = "[" + ", ".join(map(str, rl.LAG_PARAMS + rl.MEAN_PARAMS)) + "]"
_LONG = f"unnest({_MODELS}) AS model, CAST(unnest({_PARAMS}) AS BIGINT) AS param"
CAND = f"""{q.ALL}, {_FOLDS},
ow AS (SELECT ts, 'target' AS subset, {_LONG}, unnest({_LIST(lambda c: c)}) AS prediction FROM ft WHERE station_id = 'click'),
av AS (SELECT ts, {_LIST(lambda c: f"avg({c})")} AS ps FROM ft GROUP BY ts),
ev AS (SELECT ts, 'all' AS subset, {_LONG}, unnest(ps) AS prediction FROM av),
ac AS (SELECT ts, split, pos, n, CAST(unnest({q.HOURS}) AS BIGINT) AS horizon, unnest({q.LEVELS}) AS actual FROM tc),
cp AS (SELECT * FROM ac JOIN (SELECT * FROM ow UNION ALL SELECT * FROM ev) USING (ts)),
fs AS (SELECT model, subset, param, fold, {q.METRICS} FROM cp, fb WHERE split = 'train' AND pos >= val_start AND pos < val_end GROUP BY 1, 2, 3, 4),
cs AS (SELECT model, subset, param, count(*) AS folds, round(avg(mae) + 1e-9, 6) AS mae_mean, round(stddev_pop(mae) + 1e-9, 6) AS mae_std, round(avg(rmse) + 1e-9, 6) AS rmse_mean, round(stddev_pop(rmse) + 1e-9, 6) AS rmse_std, round(avg(me) + 1e-9, 6) AS me_mean, round(avg(r2) + 1e-9, 6) AS r2_mean FROM fs GROUP BY 1, 2, 3)"""
LOG = CAND + """,
ex AS (SELECT 'e1' AS execution, CAST(1000 AS BIGINT) AS end_time UNION ALL SELECT 'e2', 2000),
lg AS (SELECT model || '-' || subset || '-' || param || '-' || execution AS run_id, model AS experiment, execution, subset, param, end_time,
  unnest(['cv_mae_mean', 'cv_mae_std', 'cv_rmse_mean', 'cv_rmse_std', 'cv_me_mean', 'cv_r2_mean']) AS name, unnest([mae_mean, mae_std, rmse_mean, rmse_std, me_mean, r2_mean]) AS value FROM cs, ex),
lo AS (SELECT * FROM lg WHERE NOT (execution = 'e2' AND name = 'cv_r2_mean')),
co_ex AS (SELECT experiment, execution, max(end_time) AS end_time FROM lo GROUP BY 1, 2 HAVING count(CASE WHEN name = 'cv_r2_mean' THEN 1 END) = count(DISTINCT run_id)),
ne AS (SELECT experiment, execution, end_time FROM (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY end_time DESC, execution) AS i FROM co_ex) WHERE i = 1)"""


def summary(spark, sf, horizons=ft.EVERY):
    return rl.summaries(rl.candidates(spark, sf, horizons))


def log(spark, sf, horizons=ft.EVERY):
    return rl.run_log(summary(spark, sf, horizons))


@query("naive_cv_search", f"WITH {CAND} SELECT * FROM fs")
def naive_cv_search(spark, sf, horizons=ft.EVERY):
    """All candidates on all folds in one plan: candidate and fold are columns, not loops."""
    return rl.candidates(spark, sf, horizons)


@query("complete_fold_candidates", f"WITH {CAND} SELECT model, subset, param, rmse_mean FROM cs WHERE folds = 5")
def complete_fold_candidates(spark, sf, horizons=ft.EVERY):
    return summary(spark, sf, horizons).filter("folds = 5").select("model", "subset", "param", "rmse_mean")


@query("select_candidate", f"WITH {CAND} SELECT model, subset, param, rmse_mean FROM cs WHERE rmse_mean IS NOT NULL ORDER BY rmse_mean, mae_mean, subset = 'all', param, model LIMIT 1")
def select_candidate(spark, sf, horizons=ft.EVERY):
    """The least error; ties fall through to the simpler candidate."""
    return summary(spark, sf, horizons).filter("rmse_mean is not null").orderBy("rmse_mean", "mae_mean", F.col("subset") == "all", "param", "model").limit(1).select("model", "subset", "param", "rmse_mean")


_BEST = "SELECT model, subset, param, rmse_mean, mae_mean FROM (SELECT *, row_number() OVER (PARTITION BY model, subset ORDER BY rmse_mean, mae_mean, param) AS i FROM cs) WHERE i = 1"


def best(spark, sf, horizons=ft.EVERY):
    return rl.select_first(summary(spark, sf, horizons), ["model", "subset"], ["rmse_mean", "mae_mean", "param"]).select("model", "subset", "param", "rmse_mean", "mae_mean")


@query("best_within_subset", f"WITH {CAND} {_BEST}")
def best_within_subset(spark, sf, horizons=ft.EVERY):
    return best(spark, sf, horizons)


@query("rmse_ranking", f"WITH {CAND}, b AS ({_BEST}) SELECT model, subset, rmse_mean, row_number() OVER (ORDER BY rmse_mean, model, subset) AS place FROM b")
def rmse_ranking(spark, sf, horizons=ft.EVERY):
    return best(spark, sf, horizons).select("model", "subset", "rmse_mean", F.row_number().over(Window.orderBy("rmse_mean", "model", "subset")).cast("long").alias("place"))


@query("candidate_sensitivity", f"WITH {CAND} SELECT model, param, round(avg(CASE WHEN subset = 'target' THEN rmse_mean END), 6) AS target, round(avg(CASE WHEN subset = 'all' THEN rmse_mean END), 6) AS \"all\" FROM cs GROUP BY 1, 2")
def candidate_sensitivity(spark, sf, horizons=ft.EVERY):
    return summary(spark, sf, horizons).groupBy("model", "param").pivot("subset", ["target", "all"]).agg(F.round(F.avg("rmse_mean"), 6))


@query("subset_candidate_counts", f"WITH {CAND} SELECT model, subset, count(*) AS n, CAST(count(CASE WHEN folds = 5 THEN 1 END) AS BIGINT) AS n_complete FROM cs GROUP BY 1, 2")
def subset_candidate_counts(spark, sf, horizons=ft.EVERY):
    return summary(spark, sf, horizons).groupBy("model", "subset").agg(F.count("*").alias("n"), F.count_if(F.col("folds") == 5).alias("n_complete"))


_UP = "CAST(unnest(range(0, {})) AS BIGINT)"


@query("candidate_grid", f"SELECT station_id, p, d, mq AS q, d = 0 AS intercept FROM (SELECT DISTINCT event_type AS station_id FROM events), (SELECT {_UP.format(7)} AS p), (SELECT {_UP.format(2)} AS d), (SELECT {_UP.format(4)} AS mq) WHERE d = 1 OR p > 0")
def candidate_grid(spark, sf):
    """The 52 orders of every station: level models have an intercept and at least one autoregressive term. The ranges are
    fixed arrays, so nothing is cross-joined."""
    s = table(spark, sf, "events").select(F.col("event_type").alias("station_id")).distinct()
    grid_ = s.withColumn("p", F.explode(up_to(7))).withColumn("d", F.explode(up_to(2))).withColumn("q", F.explode(up_to(4))).filter("d = 1 or p > 0")
    return grid_.withColumn("intercept", F.col("d") == 0)


@query("subset_candidate_grid", f"SELECT station_id, subset, p, d, mq AS q FROM (SELECT DISTINCT event_type AS station_id FROM events), (SELECT unnest(['a', 'b', 'c', 'd', 'e', 'f']) AS subset), (SELECT {_UP.format(3)} AS p), (SELECT {_UP.format(2)} AS d), (SELECT {_UP.format(3)} AS mq) WHERE d = 0 OR (p < 2 AND mq < 2)")
def subset_candidate_grid(spark, sf):
    """Thirteen orders for each of six feature subsets, 78 for every station."""
    s = table(spark, sf, "events").select(F.col("event_type").alias("station_id")).distinct().withColumn("subset", F.explode(F.array(*map(F.lit, "abcdef"))))
    return s.withColumn("p", F.explode(up_to(3))).withColumn("d", F.explode(up_to(2))).withColumn("q", F.explode(up_to(3))).filter("d = 0 or (p < 2 and q < 2)")


def up_to(n):
    return F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))


@query("dedup_params", "SELECT event_type, user_id % 7 AS a, user_id % 3 AS b, min(event_id) AS first_draw FROM events GROUP BY 1, 2, 3")
def dedup_params(spark, sf):
    """The first of equal parameter draws: the least draw number of each key."""
    return table(spark, sf, "events").groupBy("event_type", (F.col("user_id") % 7).alias("a"), (F.col("user_id") % 3).alias("b")).agg(F.min("event_id").alias("first_draw"))


@query("runlog_roundtrip", f"WITH {LOG} SELECT experiment, count(DISTINCT run_id) AS runs, count(*) AS values_, round(sum(value) + 1e-9, 4) AS total FROM lo GROUP BY 1")
def runlog_roundtrip(spark, sf, horizons=ft.EVERY):
    """The log appended to a table partitioned by experiment, and read back."""
    import uuid

    path = f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"
    log(spark, sf, horizons).write.mode("append").partitionBy("experiment").parquet(path)
    rows = spark.read.parquet(path).select("experiment", "run_id", F.explode("metrics").alias("name", "value"))
    return rows.groupBy("experiment").agg(F.count_distinct("run_id").alias("runs"), F.count("*").alias("values_"), F.round(F.sum("value") + ft.NUDGE, 4).alias("total"))


@query("runlog_scan", f"WITH {LOG} SELECT DISTINCT run_id, experiment, end_time FROM lo WHERE execution = 'e2'")
def runlog_scan(spark, sf, horizons=ft.EVERY):
    return log(spark, sf, horizons).filter((F.col("tags")["run_type"] == "candidate") & (F.col("status") == "FINISHED") & (F.col("tags")["execution_uuid"] == "e2")).orderBy(F.desc("end_time"), "run_id").select("run_id", "experiment", "end_time")


@query("newest_complete", f"WITH {LOG} SELECT * FROM ne")
def newest_complete(spark, sf, horizons=ft.EVERY):
    """The newest execution lacks a metric, so the one before it is taken."""
    return rl.newest_complete(log(spark, sf, horizons))


@query("validate_execution", f"WITH {LOG} SELECT experiment, execution, count(DISTINCT run_id) * 6 - count(*) AS n_missing FROM lo GROUP BY 1, 2")
def validate_execution(spark, sf, horizons=ft.EVERY):
    missing = F.size(F.array_except(F.array(*map(F.lit, rl.NAMES)), F.map_keys("metrics")))
    return log(spark, sf, horizons).groupBy("experiment", F.col("tags")["execution_uuid"].alias("execution")).agg(F.sum(missing).alias("n_missing"))


@query("match_selected_candidate", f"WITH {LOG}, b AS ({_BEST}) SELECT b.model, b.subset, b.param, count(DISTINCT run_id) AS n FROM b LEFT JOIN lo ON lo.experiment = b.model AND lo.subset = b.subset AND lo.param = b.param AND lo.execution = 'e1' GROUP BY 1, 2, 3")
def match_selected_candidate(spark, sf, horizons=ft.EVERY):
    """Each selected candidate has exactly one run of its execution with equal parameters."""
    scores = stored(summary(spark, sf, horizons), "scores")  # read twice
    b = rl.select_first(scores, ["model", "subset"], ["rmse_mean", "mae_mean", "param"]).select("model", "subset", "param")
    runs = rl.run_log(scores).filter(F.col("tags")["execution_uuid"] == "e1").select(F.col("experiment").alias("model"), F.col("params")["subset"].alias("subset"), F.col("params")["param"].cast("long").alias("param"), "run_id")
    return b.join(runs, ["model", "subset", "param"], "left").groupBy("model", "subset", "param").agg(F.count_distinct("run_id").alias("n"))


@query("search_completeness", f"WITH {LOG}, have AS (SELECT DISTINCT experiment, subset, param FROM lo) SELECT experiment, count(*) AS n_found, CASE experiment WHEN 'lag' THEN 12 ELSE 4 END = count(*) AS complete FROM have GROUP BY 1")
def search_completeness(spark, sf, horizons=ft.EVERY):
    """Logged candidates against the expected ones, as sets in both directions."""
    have = log(spark, sf, horizons).select("experiment", F.col("params")["subset"].alias("subset"), F.col("params")["param"].cast("long").alias("param")).distinct()
    expected = have.select("experiment").distinct().withColumn("subset", F.explode(F.array(F.lit("target"), F.lit("all")))).withColumn("param", F.explode(F.when(F.col("experiment") == "lag", F.array(*(F.lit(k).cast("long") for k in rl.LAG_PARAMS))).otherwise(F.array(*(F.lit(k).cast("long") for k in rl.MEAN_PARAMS)))))
    wrong = have.exceptAll(expected).union(expected.exceptAll(have)).groupBy("experiment").agg(F.count("*").alias("wrong"))
    return have.groupBy("experiment").agg(F.count("*").alias("n_found")).join(wrong, "experiment", "left").select("experiment", "n_found", F.col("wrong").isNull().alias("complete"))


@query("available_models", f"WITH {LOG} SELECT model, model IN (SELECT experiment FROM ne) AS available FROM (SELECT unnest(['lag', 'mean', 'ridge']) AS model), (SELECT count(*) FROM lo)")
def available_models(spark, sf, horizons=ft.EVERY):
    wanted = table(spark, sf, "region").limit(1).select(F.explode(F.array(*map(F.lit, ("lag", "mean", "ridge")))).alias("model"))
    found = rl.newest_complete(log(spark, sf, horizons)).select(F.col("experiment").alias("model"), F.lit(True).alias("available"))
    return wanted.join(found, "model", "left").select("model", F.coalesce("available", F.lit(False)).alias("available"))


@query("tidy_metrics", f"WITH {LOG} SELECT run_id, 'cv' AS phase, split_part(name, '_', 2) AS metric, max(CASE WHEN name LIKE '%_mean' THEN value END) AS mean, max(CASE WHEN name LIKE '%_std' THEN value END) AS std FROM lo GROUP BY run_id, split_part(name, '_', 2)")
def tidy_metrics(spark, sf, horizons=ft.EVERY):
    return rl.tidy(log(spark, sf, horizons)).groupBy("run_id", "phase", "metric").pivot("stat", ["mean", "std"]).agg(F.first("value"))


@query("flatten_metrics", f"WITH {LOG} SELECT run_id, count(*) AS n, round(sum(value) + 1e-9, 4) AS total FROM lo GROUP BY 1")
def flatten_metrics(spark, sf, horizons=ft.EVERY):
    """Tidy rows back to one map for each run."""
    back = rl.tidy(log(spark, sf, horizons)).groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("m"))
    return back.select("run_id", F.size("m").cast("long").alias("n"), F.round(F.aggregate(F.array_sort(F.map_values("m")), F.lit(0.0), lambda a, x: a + x) + ft.NUDGE, 4).alias("total"))


@query("comparison_metrics", f"WITH {LOG} SELECT experiment, subset, param, name, value FROM lo JOIN ne USING (experiment, execution)")
def comparison_metrics(spark, sf, horizons=ft.EVERY):
    runs = stored(log(spark, sf, horizons), "runs")  # read twice
    return rl.tidy(runs).join(rl.newest_complete(runs).select("experiment", "execution"), ["experiment", "execution"]).select("experiment", "subset", "param", "name", "value")


_SUBSETS = "sm AS (SELECT experiment, subset, param, value AS rmse FROM (SELECT lo.*, row_number() OVER (PARTITION BY experiment, subset ORDER BY value, param) AS i FROM lo JOIN ne USING (experiment, execution) WHERE name = 'cv_rmse_mean') WHERE i = 1)"


def subset_best(spark, sf, horizons=ft.EVERY):
    runs = stored(log(spark, sf, horizons), "runs")  # read twice
    t = rl.tidy(runs).join(rl.newest_complete(runs).select("experiment", "execution"), ["experiment", "execution"]).filter("name = 'cv_rmse_mean'")
    return rl.select_first(t, ["experiment", "subset"], ["value", "param"]).select("experiment", "subset", "param", F.col("value").alias("rmse"))


@query("subset_cv_metrics", f"WITH {LOG}, {_SUBSETS} SELECT * FROM sm")
def subset_cv_metrics(spark, sf, horizons=ft.EVERY):
    return subset_best(spark, sf, horizons)


@query("subset_relative_change", f"WITH {LOG}, {_SUBSETS} SELECT a.experiment, a.subset, round(100 * (a.rmse - b.rmse) / b.rmse, 5) AS change_percent FROM sm a JOIN sm b ON a.experiment = b.experiment AND b.subset = 'target'")
def subset_relative_change(spark, sf, horizons=ft.EVERY):
    s = subset_best(spark, sf, horizons)
    reference = F.max(F.when(F.col("subset") == "target", F.col("rmse"))).over(Window.partitionBy("experiment"))
    return s.select("experiment", "subset", F.round(100 * (F.col("rmse") - reference) / reference, 5).alias("change_percent"))


@query("saved_model_review", f"WITH {LOG} SELECT run_id, name, value FROM lo WHERE execution = 'e1' AND experiment = 'mean'")
def saved_model_review(spark, sf, horizons=ft.EVERY):
    return rl.tidy(log(spark, sf, horizons).filter("experiment = 'mean'")).filter("execution = 'e1'").select("run_id", "name", "value")


@query("tuning_results", f"WITH {LOG}, {_SUBSETS}, b AS (SELECT experiment, subset, param, rmse, row_number() OVER (PARTITION BY experiment ORDER BY rmse, subset) AS i FROM sm) SELECT m.experiment, 'subset=' || subset || ', param=' || param AS parameters, rmse FROM (SELECT unnest(['lag', 'mean', 'ridge']) AS experiment) m LEFT JOIN (SELECT * FROM b WHERE i = 1) b USING (experiment)")
def tuning_results(spark, sf, horizons=ft.EVERY):
    b = rl.select_first(subset_best(spark, sf, horizons), ["experiment"], ["rmse", "subset"])
    wanted = table(spark, sf, "region").limit(1).select(F.explode(F.array(*map(F.lit, ("lag", "mean", "ridge")))).alias("experiment"))
    text = F.when(F.col("subset").isNotNull(), F.concat(F.lit("subset="), "subset", F.lit(", param="), F.col("param").cast("string")))
    return wanted.join(b, "experiment", "left").select("experiment", text.alias("parameters"), "rmse")


@query("comparison_slices", f"WITH {LOG} SELECT experiment, subset, param, value, CASE experiment WHEN 'lag' THEN 1 ELSE 2 END AS place FROM lo JOIN ne USING (experiment, execution) WHERE name = 'cv_mae_mean'")
def comparison_slices(spark, sf, horizons=ft.EVERY):
    runs = stored(log(spark, sf, horizons), "runs")  # read twice
    t = rl.tidy(runs).join(rl.newest_complete(runs).select("experiment", "execution"), ["experiment", "execution"]).filter("metric = 'mae' and stat = 'mean'")
    place = F.when(F.col("experiment") == "lag", 1).otherwise(2)
    return t.select("experiment", "subset", "param", "value", place.alias("place")).orderBy("place", "subset", "param")


@query("cohort_summary", f"WITH {LOG} SELECT DISTINCT experiment, (SELECT max(n) FROM tc) AS cohort FROM lo")
def cohort_summary(spark, sf, horizons=ft.EVERY):
    features = ft.featured(spark, sf, horizons=horizons)
    cohort = ft.target_cohort(features)
    runs = rl.run_log(rl.summaries(rl.cross_validated(rl.candidate_forecasts(features, cohort, horizons))))
    return runs.select("experiment").distinct().crossJoin(F.broadcast(cohort.agg(F.max("n").alias("cohort"))))


@query("near_vs_far_horizons", f"WITH {q.ALL}, m AS (SELECT model, horizon <= 6 AS near, {q.METRICS} FROM pr GROUP BY 1, 2) SELECT a.model, round(a.rmse, 6) AS near_rmse, round(b.rmse, 6) AS far_rmse, round(100 * (b.rmse - a.rmse) / a.rmse, 4) AS delta_percent FROM m a JOIN m b USING (model) WHERE a.near AND NOT b.near")
def near_vs_far_horizons(spark, sf, horizons=ft.EVERY):
    """Near and far horizons of one metric side by side with the relative change, from one conditional aggregate."""
    m = preds(spark, sf, horizons).groupBy("model").agg(*(F.round(F.sqrt(F.avg(F.when(c, F.pow(F.col("prediction") - F.col("actual"), 2)))), 6).alias(n) for n, c in (("near_rmse", F.col("horizon") <= 6), ("far_rmse", F.col("horizon") > 6))))
    return m.withColumn("delta_percent", F.round(100 * (F.col("far_rmse") - F.col("near_rmse")) / F.col("near_rmse"), 4))


_REG = "rg AS (SELECT model, CASE WHEN actual < 50 THEN 'low' ELSE 'high' END AS regime, prediction, actual FROM pr)"


@query("regime_halves", f"WITH {q.ALL}, {_REG} SELECT model, regime, {q.METRICS} FROM rg GROUP BY 1, 2")
def regime_halves(spark, sf, horizons=ft.EVERY):
    return preds(spark, sf, horizons).groupBy("model", F.when(F.col("actual") < 50, "low").otherwise("high").alias("regime")).agg(*ft.metrics())


@query("regime_pivot", f"WITH {q.ALL}, {_REG} SELECT model, round(avg(CASE WHEN regime = 'low' THEN abs(prediction - actual) END), 6) AS low, round(avg(CASE WHEN regime = 'high' THEN abs(prediction - actual) END), 6) AS high FROM rg GROUP BY 1")
def regime_pivot(spark, sf, horizons=ft.EVERY):
    p = preds(spark, sf, horizons).withColumn("regime", F.when(F.col("actual") < 50, "low").otherwise("high"))
    return p.groupBy("model").pivot("regime", ["low", "high"]).agg(F.round(F.avg(F.abs(F.col("prediction") - F.col("actual"))), 6))


@query("tidy_regime_metrics", f"WITH {q.ALL}, {_REG}, m AS (SELECT model, regime, {q.METRICS} FROM rg GROUP BY 1, 2) SELECT model, regime, metric, v AS value FROM (SELECT model, regime, unnest(['mae', 'rmse']) AS metric, unnest([mae, rmse]) AS v FROM m)")
def tidy_regime_metrics(spark, sf, horizons=ft.EVERY):
    """Regime metrics as one map for each model, parsed back into rows."""
    m = regime_halves(spark, sf, horizons).select("model", F.explode(F.array(*(F.struct(F.concat(F.lit("test_regime_"), "regime", F.lit(f"_{k}")).alias("name"), F.col(k).alias("value")) for k in ("mae", "rmse")))).alias("e"))
    maps = m.groupBy("model").agg(F.map_from_entries(F.collect_list("e")).alias("metrics")).select("model", F.explode("metrics").alias("name", "value"))
    part = lambda i: F.regexp_extract("name", "^test_regime_([a-z]+)_([a-z0-9]+)$", i)
    return maps.select("model", part(1).alias("regime"), part(2).alias("metric"), "value")


@query("high_water", f"WITH {q.ALL} SELECT 'all' AS part, model, {q.METRICS} FROM pr GROUP BY 2 UNION ALL SELECT 'alarm', model, {q.METRICS} FROM pr WHERE actual >= 90 GROUP BY 2")
def high_water(spark, sf, horizons=ft.EVERY):
    """All forecasts and those of alarm levels, in one aggregate over an exploded label."""
    p = preds(spark, sf, horizons).withColumn("part", F.explode(F.array_compact(F.array(F.lit("all"), F.when(F.col("actual") >= 90, "alarm")))))
    return p.groupBy("part", "model").agg(*ft.metrics())


def sealed_test(spark, sf, horizons=ft.EVERY, split="test"):
    """One scoring pass, refused if a forecast isn't finite."""
    p = preds(spark, sf, horizons).filter(F.col("split") == split)
    finite = F.col("prediction").isNotNull() & ~F.isnan("prediction") & (F.abs("prediction") < float("inf"))
    checked = p.withColumn("prediction", F.when(finite, F.col("prediction")).otherwise(F.raise_error(F.lit("a forecast is not finite")).cast("double")))
    return checked.groupBy("model", "horizon").agg(*ft.metrics())


@query("score_linear", f"WITH {q.ALL} SELECT issue_ts, horizon, round(prediction, 6) AS prediction FROM pr WHERE model = 'linear'")
def score_linear(spark, sf, horizons=ft.EVERY):
    """A coefficient table meets unpivoted features: one join, one aggregate, any number of features."""
    c = ft.target_cohort(ft.featured(spark, sf, horizons=horizons))
    names = {"water_level": 0.6, "mean_24": 0.3, "lag_24": 0.1}
    long = c.select("ts", *names).unpivot(["ts"], list(names), "feature", "value")
    weights = table(spark, sf, "region").limit(1).select(F.explode(F.array(*(F.struct(F.lit(n).alias("feature"), F.lit(w).alias("w")) for n, w in names.items()))).alias("x")).select("x.*").withColumn("horizon", F.explode(F.array(*(F.lit(h).cast("long") for h in horizons))))
    return long.join(F.broadcast(weights), "feature").groupBy(F.col("ts").alias("issue_ts"), "horizon").agg(F.round(F.sum(F.col("w") * F.col("value")), 6).alias("prediction"))


@query("name_parts", "SELECT event_id, split_part(event_type || '__water_level_lag_' || (user_id % 72) || 'h', '__', 1) AS station, regexp_extract(event_type || '__water_level_lag_' || (user_id % 72) || 'h', '_lag_(\\d+)h$', 1) AS hours FROM events")
def name_parts(spark, sf):
    name = F.concat("event_type", F.lit("__water_level_lag_"), (F.col("user_id") % 72).cast("string"), F.lit("h"))
    return table(spark, sf, "events").select("event_id", F.split_part(name, F.lit("__"), F.lit(1)).alias("station"), F.regexp_extract(name, r"_lag_(\d+)h$", 1).alias("hours"))


@query("parse_params", "SELECT event_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE CAST(user_id % 50 AS DOUBLE) END AS depth, [CAST(64 AS BIGINT), user_id % 9][2] AS second_layer, user_id % 2 = 0 AS flag FROM events")
def parse_params(spark, sf):
    """Logged strings back to values: null for None, a list from ``64x3``, booleans."""
    t = table(spark, sf, "events").select("event_id", F.when(F.col("user_id") % 3 == 0, "None").otherwise((F.col("user_id") % 50).cast("string")).alias("depth"), F.concat(F.lit("64x"), (F.col("user_id") % 9).cast("string")).alias("layers"), F.when(F.col("user_id") % 2 == 0, "True").otherwise("False").alias("flag"))
    return t.select("event_id", F.nullif("depth", F.lit("None")).try_cast("double").alias("depth"), F.transform(F.split("layers", "x"), lambda x: x.try_cast("long"))[1].alias("second_layer"), F.col("flag").cast("boolean").alias("flag"))


@query("alias_coalesce", "SELECT event_id, coalesce(nullif(trim(CASE WHEN user_id % 2 = 0 THEN ' ' ELSE 'a' || user_id END), ''), 'b' || event_id) AS name FROM events")
def alias_coalesce(spark, sf):
    m = F.create_map(F.lit("first"), F.when(F.col("user_id") % 2 == 0, " ").otherwise(F.concat(F.lit("a"), F.col("user_id").cast("string"))), F.lit("second"), F.concat(F.lit("b"), F.col("event_id").cast("string")))
    return table(spark, sf, "events").withColumn("m", m).select("event_id", F.coalesce(F.nullif(F.trim(F.col("m")["first"]), F.lit("")), F.col("m")["second"]).alias("name"))


@query("manifest_contract", f"WITH {LOG} SELECT DISTINCT run_id, param >= 6 AS accepted FROM lo WHERE execution = 'e1'")
def manifest_contract(spark, sf, horizons=ft.EVERY):
    """Model rows written with their contract as JSON, and accepted on reading only if the contract agrees."""
    runs = log(spark, sf, horizons).filter(F.col("tags")["execution_uuid"] == "e1")
    saved = stored(runs.select("run_id", F.to_json(F.struct(F.col("params")["param"].cast("long").alias("param"), F.lit("click").alias("target"))).alias("manifest")), "models")
    m = F.from_json("manifest", "param long, target string")
    return saved.select("run_id", ((m["param"] >= 6) & (m["target"] == "click")).alias("accepted"))
