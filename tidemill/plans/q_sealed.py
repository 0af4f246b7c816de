"""Registered queries: the sealed test with its regimes, provenance of training rows, and the checks of executions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemill.operators import features as ft
from tidemill.operators import provenance as pv
from tidemill.operators import runlog as rl
from tidemill.operators import sealed
from tidemill.plans import sql as q
from tidemill.plans.catalogue import query
from tidemill.plans.q_eda import _QUART, _REGIME, quartiles
from tidemill.plans.q_runlog import LOG, summary
from tidemill.plans.q_series import _FOLDS
from tidemill.plans.stored import shared_dir, stored

ALARM = 90.0

# a forecast needs its own model's predictors only: the level, a day's mean and the level a day ago
_SEALED = f"""{q.BASE}, {q.FEATURES}, {_QUART}, tc AS (SELECT * FROM ft WHERE station_id = 'click' AND split = 'test' AND target_valid AND water_level IS NOT NULL AND mean_24 IS NOT NULL AND lag_24 IS NOT NULL), {q.FORECASTS}"""


def test_forecasts(spark, sf):
    """Both models' forecasts of the target's test hours."""
    rows = ft.featured(spark, sf).filter(f"station_id = '{ft.TARGET}' and split = 'test' and target_valid and water_level is not null and mean_24 is not null and lag_24 is not null")
    return ft.forecasts(rows)


def cutoffs(spark, sf):
    r = quartiles(spark, sf).first()
    return r["q25"], r["q50"], r["q75"]


_RE = f"""rg AS (SELECT pr.*, unnest(list_filter(['all', {_REGIME}, CASE WHEN actual >= {ALARM}::DOUBLE THEN 'alarm' END], lambda x: x IS NOT NULL)) AS regime FROM pr, qt),
sk AS (SELECT model, unnest(['all', 'q1', 'q2', 'q3', 'q4', 'alarm']) AS regime, h AS horizon FROM (SELECT DISTINCT model FROM pr), (SELECT CAST(unnest(range(0, 25)) AS BIGINT) AS h)),
mt AS (SELECT model, regime, coalesce(horizon, 0) AS horizon, {q.METRICS} FROM rg GROUP BY GROUPING SETS ((model, regime), (model, regime, horizon)))"""


@query("sealed_pass", f"WITH {_SEALED}, {_RE} SELECT 'e1' AS execution, model, regime, horizon, CAST(coalesce(n, 0) AS BIGINT) AS n, mae, rmse, me, r2 FROM sk LEFT JOIN mt USING (model, regime, horizon)")
def sealed_pass(spark, sf):
    """The one scoring of the test rows, through the claim and the log: all horizons together, each of them, by regime."""
    return sealed.seal(test_forecasts(spark, sf), f"{shared_dir(spark)}/sealed-{uuid.uuid4().hex}", "e1", cutoffs(spark, sf), ALARM)


@query("sealed_test", f"WITH {_SEALED} SELECT model, horizon, {q.METRICS} FROM pr GROUP BY 1, 2")
def sealed_test(spark, sf):
    """The test rows' metrics by horizon, refused if a forecast isn't finite."""
    p = test_forecasts(spark, sf)
    finite = F.col("prediction").isNotNull() & ~F.isnan("prediction") & (F.abs("prediction") < float("inf"))
    checked = p.withColumn("prediction", F.when(finite, F.col("prediction")).otherwise(F.raise_error(F.lit("a forecast is not finite")).cast("double")))
    return checked.groupBy("model", "horizon").agg(*ft.metrics())


@query("regime_scores", f"WITH {q.ALL}, {_QUART}, {_RE} SELECT model, regime, horizon, CAST(coalesce(n, 0) AS BIGINT) AS n, mae, rmse, me, r2 FROM sk LEFT JOIN mt USING (model, regime, horizon)")
def regime_scores(spark, sf):
    """All complete issue times by regime, with a row for all regimes and for all horizons together."""
    return sealed.regime_scores(ft.forecasts(ft.target_cohort(ft.featured(spark, sf))), cutoffs(spark, sf), ALARM)


TRAINED = ["ts", "water_level", *(f"t{h}" for h in ft.EVERY)]


def trained_rows(spark, sf):
    """The training rows of three models: two of the same cohort, and a planted one of which one level was changed."""
    cohort = ft.target_cohort(ft.featured(spark, sf)).filter("split = 'train'").select("pos", "n", *TRAINED)
    cohort = stored(cohort, "cohort")
    other = F.col("pos") == ft.fold_bounds(F.col("n"))[1]["train_end"]
    changed = cohort.withColumn("water_level", F.when(other, F.col("water_level") + 1).otherwise(F.col("water_level")))
    named = lambda rows, name: rows.withColumn("model", F.lit(name))
    return named(cohort, "lag").unionByName(named(cohort.repartition(3, "ts"), "mean")).unionByName(named(changed, "planted"))


@query("provenance_agreement", f"WITH {q.ALL}, {_FOLDS} SELECT model, fold, count(*) AS n_rows, NOT (model = 'planted' AND fold >= 2) AS agrees FROM tc, fb, (SELECT unnest(['lag', 'mean', 'planted']) AS model) WHERE split = 'train' AND pos < train_end GROUP BY 1, 2")
def provenance_agreement(spark, sf):
    """Digests of each fold's training rows, compared with the first model's. The planted row lies in the third fold's training
    rows and in those of later folds only."""
    return pv.agreement(pv.fold_digests(trained_rows(spark, sf), ["model"], TRAINED), "lag")


IDENTITY, SHARED = ["subset", "param"], ["train_input_sha256", "test_input_sha256"]
# of a planted run: its name, what is changed, and what the checks must say
PLANTED = {
    "whole": [], "unnamed": ["no execution", "not one candidate"], "running": ["no completion time"], "nameless": ["parameters missing", "not one candidate"], "twice": ["not one candidate"],
    "other_rows": ["disagrees on train_input_sha256"], "no_horizon": ["horizon not positive"], "no_cohort": ["cohort not positive"], "no_cv": ["candidate metrics not finite"], "no_test": ["test metrics not finite"],
}


def planted_runs(spark, sf):
    """Sealed runs and candidates of the search's first folds: a whole execution for each experiment, and one for each fault."""
    best = rl.select_first(summary(spark, sf), ["model"], ["rmse_mean", "mae_mean", "subset", "param"])
    case = best.withColumn("case", F.explode(F.array(*map(F.lit, PLANTED))))
    c = F.col("case")
    maps = lambda **kv: F.map_filter(F.create_map(*(x for k, v in kv.items() for x in (F.lit(k), v))), lambda _, v: v.isNotNull())
    params = dict(
        subset=F.when(c != "nameless", F.col("subset")), param=F.col("param").cast("string"), train_input_sha256=F.when(c == "other_rows", "other").otherwise("rows"), test_input_sha256=F.lit("test"),
        forecast_horizon_hours=F.when(c == "no_horizon", "0").otherwise("24"), scored_issue_times=F.when(c == "no_cohort", "none").otherwise("48"),
    )
    ended = F.lit(2000).cast("long")
    sealed_runs = case.select(
        F.concat_ws("-", "model", "case", F.lit("sealed")).alias("run_id"), F.col("model").alias("experiment"), F.lit("FINISHED").alias("status"), F.when(c != "running", ended).alias("end_time"),
        maps(execution_uuid=F.when(c != "unnamed", c)).alias("tags"), maps(**params).alias("params"), maps(test_rmse=F.when(c == "no_test", float("nan")).otherwise(F.col("rmse_mean"))).alias("metrics"),
    )
    candidates = case.withColumn("copy", F.explode(F.when(c == "twice", F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).select(
        F.concat_ws("-", "model", "case", F.col("copy").cast("string")).alias("run_id"), F.col("model").alias("experiment"), F.lit("FINISHED").alias("status"), F.lit(1000).cast("long").alias("end_time"),
        maps(execution_uuid=c).alias("tags"), maps(**(params | {"subset": F.col("subset"), "train_input_sha256": F.lit("rows")})).alias("params"), maps(cv_rmse_mean=F.when(c != "no_cv", F.col("rmse_mean"))).alias("metrics"),
    )
    return sealed_runs, candidates


_EXPECTED = ", ".join(f"('{k}', '{'; '.join(v)}')" for k, v in PLANTED.items())


@query("execution_violations", f"WITH {LOG} SELECT experiment, experiment || '-' || c || '-sealed' AS run_id, v AS violations FROM (SELECT DISTINCT experiment FROM lo), (VALUES {_EXPECTED}) AS x(c, v)")
def execution_violations(spark, sf):
    """Each planted fault is named, and the whole executions pass."""
    found = pv.violations(*planted_runs(spark, sf), IDENTITY, SHARED, ["cv_rmse_mean"], ["test_rmse"])
    return found.select("experiment", "run_id", F.array_join("violations", "; ").alias("violations"))
