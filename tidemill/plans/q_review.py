"""Registered queries: forecast windows with a whole context, regime rows out of run logs, faults of forecasts and searches, chart rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import features as ft
from tidemill.operators import review as rv
from tidemill.operators import runlog as rl
from tidemill.operators import sealed
from tidemill.plans import q_runlog
from tidemill.plans import sql as q
from tidemill.plans.catalogue import query
from tidemill.plans.q_eda import _QUART, preds, quartiles
from tidemill.plans.q_sealed import _RE, _SEALED, ALARM, test_forecasts
from tidemill.plans.stored import stored

DAY = 24  # hours of context in the queries: the small tables have no issue time with the 48 that the operators ask for by default


def whole_sql(hours: int) -> str:
    return f"cx AS (SELECT ts FROM (SELECT ts, count(CASE WHEN water_level IS NOT NULL AND NOT imputed THEN 1 END) OVER (ORDER BY ts ROWS BETWEEN {hours} PRECEDING AND {hours} FOLLOWING) AS c FROM f WHERE station_id = 'click') WHERE c = {2 * hours + 1})"


def windows_sql(hours: int) -> str:
    return f"""WITH {q.ALL}, {whole_sql(hours)}, i AS (SELECT model, issue_ts, sqrt(avg(power(prediction - actual, 2))) AS rmse FROM pr WHERE issue_ts IN (SELECT ts FROM cx) GROUP BY 1, 2),
k AS (SELECT *, count(*) OVER (PARTITION BY model) AS n, row_number() OVER (PARTITION BY model ORDER BY round(rmse, 9), issue_ts) AS b, row_number() OVER (PARTITION BY model ORDER BY round(rmse, 9) DESC, issue_ts) AS w FROM i)
SELECT model, 'best' AS kind, issue_ts, round(rmse, 6) AS rmse, n AS n_eligible FROM k WHERE b = 1 UNION ALL SELECT model, 'worst', issue_ts, round(rmse, 6), n FROM k WHERE w = 1"""


def target_frames(spark, sf):
    return ft.station_frames(spark, sf).filter(F.col("station_id") == ft.TARGET)


@query("eligible_windows", windows_sql(DAY))
def eligible_windows(spark, sf, hours=DAY):
    """The best and the worst forecast window whose issue time has whole, observed hours on both sides."""
    return rv.best_and_worst(preds(spark, sf), rv.complete_contexts(target_frames(spark, sf), hours))


@query("issue_time_status", f"WITH {q.ALL}, {whole_sql(DAY)} SELECT ts AS issue_ts, CASE WHEN ts NOT IN (SELECT issue_ts FROM pr) THEN 'no forecast' WHEN ts NOT IN (SELECT ts FROM cx) THEN 'context has a gap' ELSE 'drawn' END AS status FROM f WHERE station_id = 'click'")
def issue_time_status(spark, sf):
    """Every hour of the target, asked as an issue time."""
    frames = target_frames(spark, sf)
    return rv.issue_time_status(frames.select(F.col("ts").alias("issue_ts")), preds(spark, sf), rv.complete_contexts(frames, DAY))


@query("prediction_faults", f"""WITH {q.ALL}, x AS (SELECT DISTINCT model, issue_ts, CAST(date_diff('hour', TIMESTAMP '2020-01-01', issue_ts) % 5 AS BIGINT) AS k FROM pr)
SELECT model, issue_ts, CASE k WHEN 1 THEN 'shape' WHEN 2 THEN 'not finite' WHEN 3 THEN 'not finite' END AS fault FROM x""")
def prediction_faults(spark, sf):
    """Forecasts as arrays. Of every five hours one has a value too few, one a value that isn't a number and one a null."""
    by_hour = F.array_sort(F.collect_list(F.struct("horizon", "prediction")))
    rows = preds(spark, sf).groupBy("model", "issue_ts").agg(F.transform(by_hour, lambda x: x["prediction"]).alias("p"))
    k = F.expr("pmod(timestampdiff(HOUR, TIMESTAMP_NTZ'2020-01-01', CAST(issue_ts AS TIMESTAMP_NTZ)), 5)")
    head = F.slice("p", 1, ft.HORIZON - 1)
    planted = F.when(k == 1, head).when(k == 2, F.concat(head, F.array(F.lit(float("nan"))))).when(k == 3, F.concat(F.array(F.lit(None).cast("double")), head)).otherwise(F.col("p"))
    return rv.prediction_faults(rows.withColumn("predicted", planted), ft.HORIZON).select("model", "issue_ts", "fault")


_GRID = f"SELECT s AS subset, unnest({q_runlog._MODELS} || ['lag']) AS model, CAST(unnest({q_runlog._PARAMS} || [9999]) AS BIGINT) AS param FROM (SELECT unnest(['target', 'all']) AS s)"


@query("search_status", f"""WITH {q_runlog.CAND}, g AS ({_GRID}) SELECT model, subset, param, fold, CASE WHEN n IS NULL THEN 'failed' ELSE 'finished' END AS status, CASE WHEN n IS NULL THEN 'no value was scored' END AS reason
FROM (SELECT g.*, CAST(f.fold AS BIGINT) AS fold FROM g, (SELECT unnest(range(0, 5)) AS fold) f) LEFT JOIN (SELECT model, subset, param, fold, n FROM fs) USING (model, subset, param, fold)""")
def search_status(spark, sf):
    """Every planned candidate on every fold. A lag of 9,999 hours is planned that no series reaches: it fails and stays in the table."""
    scores = stored(rl.candidates(spark, sf), "scores")
    plan = [("lag", k) for k in (*rl.LAG_PARAMS, 9999)] + [("mean", w) for w in rl.MEAN_PARAMS]
    planned = spark.createDataFrame([(m, s, k) for m, k in plan for s in ("target", "all")], "model string, subset string, param long")
    return rv.search_status(scores, planned, rl.KEY, ft.FOLDS)


def sealed_scores(spark, sf):
    r = quartiles(spark, sf).first()
    cutoffs = r["q25"], r["q50"], r["q75"]
    return sealed.regime_scores(test_forecasts(spark, sf), cutoffs, ALARM), cutoffs, r["n_reference"]


def regime_runs(spark, sf):
    """Both models' sealed runs, of which the linear rule's uses the older names."""
    scores, cutoffs, n = sealed_scores(spark, sf)
    return rv.regime_runs(scores, cutoffs, n, ALARM, ft.HORIZON, F.when(F.col("model") == "linear", "old").otherwise("new"))


_ROWS = f"""{_SEALED}, {_RE}, rr AS (SELECT model || '-sealed' AS run_id, model AS experiment, CASE WHEN regime = 'alarm' THEN 'sealed_test_alarm' ELSE 'sealed_test_quartile' END AS phase, regime,
CASE WHEN horizon = 0 THEN 'aggregate' ELSE 'horizon' END AS scope, horizon, unnest(['mae', 'rmse', 'me']) AS metric, unnest([mae, rmse, me]) AS value,
CASE regime WHEN 'q2' THEN q25 WHEN 'q3' THEN q50 WHEN 'q4' THEN q75 WHEN 'alarm' THEN {ALARM}::DOUBLE END AS lower_bound, CASE regime WHEN 'q1' THEN q25 WHEN 'q2' THEN q50 WHEN 'q3' THEN q75 END AS upper_bound,
CAST(coalesce(n, 0) AS BIGINT) AS scored_values FROM sk LEFT JOIN mt USING (model, regime, horizon), qt WHERE regime <> 'all')"""


@query("regime_log_rows", f"WITH {_ROWS} SELECT run_id, experiment, phase, regime, scope, horizon, metric, value, round(lower_bound, 6) AS lower_bound, round(upper_bound, 6) AS upper_bound, scored_values FROM rr")
def regime_log_rows(spark, sf):
    """Regime metrics parsed back from the logs of two runs under different names, with bounds and counts."""
    bounds = {c: F.round(c, 6) for c in ("lower_bound", "upper_bound")}
    return rv.regime_rows(stored(regime_runs(spark, sf), "regime-runs")).withColumns(bounds)


@query("regime_table", f"""WITH {_ROWS} SELECT phase, regime, max(scored_values) AS scored_values, true AS counts_agree, max(scored_values) = 0 AS empty, count(DISTINCT run_id) AS runs,
min(CASE WHEN metric = 'rmse' THEN value END) AS rmse_least, max(CASE WHEN metric = 'rmse' THEN value END) AS rmse_most FROM rr WHERE scope = 'aggregate' GROUP BY 1, 2""")
def regime_table(spark, sf):
    """One line for each regime, with the agreement of the runs' counts."""
    return rv.regime_table(rv.regime_rows(stored(regime_runs(spark, sf), "regime-runs")))


# of a planted run: its name and what the checks must say
PLANTED = {
    "whole": [], "before_regimes": [], "no_cutoff": ["q50 missing or not finite"], "descending": ["cutoffs not ascending"], "infinite_alarm": ["alarm missing or not finite"],
    "no_reference": ["reference count not positive"], "lost_count": ["a count is missing or not whole"], "half_count": ["a count is missing or not whole"], "lost_value": ["a value is missing"],
}


def planted_regime_runs(spark, sf):
    runs = regime_runs(spark, sf).filter("experiment = 'persistence'").withColumn("case", F.explode(F.array(*map(F.lit, PLANTED))))
    c, p, m = F.col("case"), F.col("params"), F.col("metrics")
    changed = lambda col, name, value: F.map_concat(F.map_filter(col, lambda k, _: k != name), F.create_map(F.lit(name), value))
    without = lambda col, name: F.map_filter(col, lambda k, _: k != name)
    params = F.when(c == "before_regimes", F.map_filter(p, lambda k, _: k == "forecast_horizon_hours")).when(c == "no_cutoff", without(p, "regime_q50_cm")).when(c == "descending", changed(p, "regime_q25_cm", F.lit("1e9")))
    params = params.when(c == "infinite_alarm", changed(p, "alarm_threshold_cm", F.lit("Infinity"))).when(c == "no_reference", changed(p, "regime_quartile_reference_count", F.lit("0"))).otherwise(p)
    count = "sealed_test_q3_scored_values_horizon_07"
    metrics = F.when(c == "lost_count", without(m, count)).when(c == "half_count", changed(m, count, m[count] + 0.5)).when(c == "lost_value", without(changed(m, count, F.lit(1.0)), "sealed_test_q3_mae_horizon_07")).otherwise(m)
    return runs.select(F.concat_ws("-", "run_id", "case").alias("run_id"), "experiment", params.alias("params"), metrics.alias("metrics"))


@query("regime_log_faults", f"SELECT 'persistence-sealed-' || c AS run_id, v AS faults FROM (VALUES {', '.join(f"""('{k}', '{"; ".join(v)}')""" for k, v in PLANTED.items())}) AS x(c, v) WHERE EXISTS (SELECT 1 FROM events)")
def regime_log_faults(spark, sf):
    """Each planted fault of a regime log is named; whole logs and those of the time before regimes pass."""
    return rv.regime_faults(stored(planted_regime_runs(spark, sf), "regime-runs")).select("run_id", F.array_join("faults", "; ").alias("faults"))


# the fixed order of categories in charts
SUBSETS, MODELS = ("target", "all"), ("persistence", "linear", "lag", "mean")
_PLACE = lambda names, c: "CASE " + c + " " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(names, 1)) + " END"


@query("chart_rows", f"""WITH {q_runlog.CAND}, {_QUART}, te AS (SELECT * FROM ft WHERE station_id = 'click' AND split = 'test' AND target_valid AND water_level IS NOT NULL AND mean_24 IS NOT NULL AND lag_24 IS NOT NULL),
tp AS ({q.FORECASTS.replace('FROM tc)', 'FROM te)').removeprefix('pr AS (').rstrip()[:-1]}),
rg AS (SELECT tp.*, unnest(list_filter(['all', CASE WHEN actual <= q25 THEN 'q1' WHEN actual <= q50 THEN 'q2' WHEN actual <= q75 THEN 'q3' ELSE 'q4' END, CASE WHEN actual >= {ALARM}::DOUBLE THEN 'alarm' END], lambda x: x IS NOT NULL)) AS regime FROM tp, qt),
b AS (SELECT model, subset, param, rmse_mean, mae_mean, row_number() OVER (PARTITION BY model, subset ORDER BY rmse_mean, mae_mean, param) AS i FROM cs), o AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY rmse_mean, subset) AS j FROM b WHERE i = 1)
SELECT 'aggregate' AS chart, model AS series, unnest(['mae', 'rmse']) AS category, unnest([mae_mean, rmse_mean]) AS value, CAST({_PLACE(MODELS, 'model')} AS BIGINT) AS place FROM o WHERE j = 1
UNION ALL SELECT 'cv_by_horizon', model, lpad(CAST(horizon AS VARCHAR), 2, '0'), rmse, horizon FROM (SELECT model, horizon, {q.METRICS} FROM pr WHERE split = 'train' GROUP BY 1, 2)
UNION ALL SELECT 'test_by_horizon', model, lpad(CAST(horizon AS VARCHAR), 2, '0'), rmse, horizon FROM (SELECT model, horizon, {q.METRICS} FROM tp GROUP BY 1, 2)
UNION ALL SELECT 'test_by_regime', model, regime, rmse, CAST({_PLACE(sealed.REGIMES, 'regime')} AS BIGINT) FROM (SELECT model, regime, {q.METRICS} FROM rg GROUP BY 1, 2)
UNION ALL SELECT 'best_per_subset', model, subset, rmse_mean, CAST({_PLACE(SUBSETS, 'subset')} AS BIGINT) FROM b WHERE i = 1
UNION ALL SELECT 'best_per_subset', 'persistence', subset, rmse_mean, CAST({_PLACE(SUBSETS, 'subset')} AS BIGINT) FROM cs WHERE model = 'lag' AND param = 0 AND subset = 'target'
UNION ALL SELECT 'all_candidates', model || '-' || param, subset, rmse_mean, CAST({_PLACE(SUBSETS, 'subset')} AS BIGINT) FROM cs""")
def chart_rows(spark, sf):
    """The rows of six charts in their fixed order: selected candidates by metric, folds' hours and test by horizon, test by regime, the best
    of each subset beside persistence, and all candidates. The search is written once and read by three of them."""
    place = lambda names, c: F.array_position(F.array(*map(F.lit, names)), F.col(c))
    row = lambda chart, series, category, value, at: (F.lit(chart).alias("chart"), series.alias("series"), category.alias("category"), value.alias("value"), at.cast("long").alias("place"))
    c = F.col
    summary = stored(q_runlog.summary(spark, sf), "summary")
    best = rl.select_first(summary, ["model", "subset"], ["rmse_mean", "mae_mean", "param"])
    chosen = rl.select_first(best, ["model"], ["rmse_mean", "subset"]).select("model", F.explode(F.create_map(F.lit("mae"), c("mae_mean"), F.lit("rmse"), c("rmse_mean"))).alias("metric", "value"))
    test = stored(test_forecasts(spark, sf), "test-forecasts")
    hour = F.lpad(c("horizon").cast("string"), 2, "0")
    by_hour = lambda p: p.groupBy("model", "horizon").agg(*ft.metrics())
    r = quartiles(spark, sf).first()
    regimes = test.withColumn("regime", F.explode(sealed.regimes_of(c("actual"), [F.lit(r[k]) for k in ("q25", "q50", "q75")], F.lit(ALARM)))).groupBy("model", "regime").agg(*ft.metrics())
    parts = [
        chosen.select(*row("aggregate", c("model"), c("metric"), c("value"), place(MODELS, "model"))),
        by_hour(preds(spark, sf).filter("split = 'train'")).select(*row("cv_by_horizon", c("model"), hour, c("rmse"), c("horizon"))),
        by_hour(test).select(*row("test_by_horizon", c("model"), hour, c("rmse"), c("horizon"))),
        regimes.select(*row("test_by_regime", c("model"), c("regime"), c("rmse"), place(sealed.REGIMES, "regime"))),
        best.select(*row("best_per_subset", c("model"), c("subset"), c("rmse_mean"), place(SUBSETS, "subset"))),
        summary.filter("model = 'lag' and param = 0 and subset = 'target'").select(*row("best_per_subset", F.lit("persistence"), c("subset"), c("rmse_mean"), place(SUBSETS, "subset"))),
        summary.select(*row("all_candidates", F.concat_ws("-", "model", "param"), c("subset"), c("rmse_mean"), place(SUBSETS, "subset"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out

