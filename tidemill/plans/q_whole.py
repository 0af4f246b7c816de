"""Registered queries over the sealed test rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.operators import features as ft
from tidemill.operators import runlog as rl
from tidemill.plans import q_runlog
from tidemill.plans import sql as q
from tidemill.plans.catalogue import query


@query("sealed_test_rows", (f"WITH {q.ALL} SELECT model, horizon, {q.METRICS} FROM pr WHERE split = 'test' GROUP BY 1, 2"))
def sealed_test_rows(spark, sf):
    """The sealed test rows, scored once at all horizons. Empty where no test hour has complete predictors and targets."""
    return q_runlog.sealed_test(spark, sf, ft.EVERY, "test")


@query("sealed_test_vs_cv", (f"""WITH {q_runlog.LOG}, b AS ({q_runlog._BEST}), te AS (SELECT model, subset, param, {q.METRICS} FROM cp WHERE split = 'test' GROUP BY 1, 2, 3)
SELECT model, subset, param, rmse_mean AS cv_rmse, rmse AS test_rmse, round(100 * (rmse - rmse_mean) / rmse_mean, 4) AS delta_percent FROM b LEFT JOIN te USING (model, subset, param)"""))
def sealed_test_vs_cv(spark, sf):
    """The sealed run of each selected candidate beside its mean over the folds, both from the run log."""
    features = ft.featured(spark, sf, horizons=ft.EVERY)
    forecasts = rl.candidate_forecasts(features, ft.target_cohort(features), ft.EVERY)
    scores = rl.summaries(rl.cross_validated(forecasts))
    key = ["experiment", "subset", "param"]
    runs = rl.tidy(rl.run_log(scores).union(rl.sealed_log(forecasts))).filter("execution = 'e1' and metric = 'rmse'")
    cv = runs.filter("phase = 'cv' and stat = 'mean'").select(*key, F.col("value").alias("cv_rmse"))
    test = runs.filter("phase = 'test'").select(*key, F.col("value").alias("test_rmse"))
    chosen = rl.select_first(scores, ["model", "subset"], ["rmse_mean", "mae_mean", "param"]).select(F.col("model").alias("experiment"), "subset", "param")
    both = chosen.join(cv, key).join(test, key, "left").withColumnRenamed("experiment", "model")
    return both.withColumn("delta_percent", F.round(100 * (F.col("test_rmse") - F.col("cv_rmse")) / F.col("cv_rmse"), 4))
