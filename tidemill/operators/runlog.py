"""Naive candidate search and the experiment-run log that it leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.operators import features as ft

LAG_PARAMS, MEAN_PARAMS = (0, 1, 3, 6, 12, 24), (6, 24)
MEASURES = ("mae", "rmse", "me", "r2")
NAMES = ("cv_mae_mean", "cv_mae_std", "cv_rmse_mean", "cv_rmse_std", "cv_me_mean", "cv_r2_mean")
KEY = ["model", "subset", "param"]


def candidate_forecasts(features: DataFrame, cohort: DataFrame, horizons=ft.EVERY) -> DataFrame:
    """``(ts, split, pos, n, horizon, actual, model, subset, param, prediction)`` of all candidates in long form: the level
    ``param`` hours ago, or the mean of ``param`` hours, of the target alone or averaged over all stations."""
    columns = {("lag", k): F.col("water_level") if k == 0 else F.col(f"lag_{k}") for k in LAG_PARAMS} | {("mean", w): F.col(f"mean_{w}") for w in MEAN_PARAMS}
    pack = lambda wrap: F.array(*(F.struct(F.lit(m).alias("model"), F.lit(p).cast("long").alias("param"), wrap(c).alias("prediction")) for (m, p), c in columns.items()))
    own = features.filter(F.col("station_id") == ft.TARGET).select("ts", F.lit("target").alias("subset"), F.explode(pack(lambda c: c)).alias("c"))
    every = features.groupBy("ts").agg(pack(F.avg).alias("c")).select("ts", F.lit("all").alias("subset"), F.explode("c").alias("c"))
    actual = cohort.select("ts", "split", "pos", "n", F.explode(F.array(*(F.struct(F.lit(h).cast("long").alias("horizon"), F.col(f"t{h}").alias("actual")) for h in horizons))).alias("a")).select("ts", "split", "pos", "n", "a.*")
    return actual.join(own.union(every).select("ts", "subset", "c.*"), "ts")


def cross_validated(forecasts: DataFrame) -> DataFrame:
    """Metrics of each candidate on each fold's validation rows: the folds follow from n, so no second table is joined."""
    rows = forecasts.filter("split = 'train'").withColumn("f", F.explode(ft.fold_bounds(F.col("n")))).select("*", "f.*")
    inside = rows.filter("pos >= val_start and pos < val_end")
    return inside.groupBy(*KEY, "fold").agg(*ft.metrics())


def candidates(spark: SparkSession, sf_dir: str, horizons=ft.EVERY) -> DataFrame:
    """``cross_validated`` over the test tables."""
    features = ft.featured(spark, sf_dir, horizons=horizons)
    return cross_validated(candidate_forecasts(features, ft.target_cohort(features), horizons))


def summaries(scores: DataFrame) -> DataFrame:
    """Mean and population deviation over folds."""
    return scores.groupBy(*KEY).agg(F.count("*").alias("folds"), *(F.round(f(m) + ft.NUDGE, 6).alias(f"{m}_{n}") for m, n, f in (("mae", "mean", F.avg), ("mae", "std", F.stddev_pop), ("rmse", "mean", F.avg), ("rmse", "std", F.stddev_pop), ("me", "mean", F.avg), ("r2", "mean", F.avg))))


def run_log(summary: DataFrame) -> DataFrame:
    """The log of two executions per candidate, the newer one without its last metric: params, tags and metrics are maps."""
    runs = summary.withColumn("e", F.explode(F.array(F.struct(F.lit("e1").alias("id"), F.lit(1000).cast("long").alias("at")), F.struct(F.lit("e2").alias("id"), F.lit(2000).cast("long").alias("at")))))
    values = [F.struct(F.lit(n).alias("key"), F.col(n.removeprefix("cv_")).alias("value")) for n in NAMES]
    metrics = F.map_from_entries(F.when(F.col("e.id") == "e1", F.array(*values)).otherwise(F.array(*values[:-1])))
    return runs.select(
        F.concat_ws("-", "model", "subset", "param", "e.id").alias("run_id"), F.col("model").alias("experiment"), F.lit("FINISHED").alias("status"), F.col("e.at").alias("end_time"),
        F.create_map(F.lit("run_type"), F.lit("candidate"), F.lit("execution_uuid"), F.col("e.id")).alias("tags"),
        F.create_map(F.lit("subset"), F.col("subset"), F.lit("param"), F.col("param").cast("string"), F.lit("train_input_sha256"), F.sha2(F.col("model"), 256)).alias("params"),
        metrics.alias("metrics"),
    )


def sealed_log(forecasts: DataFrame) -> DataFrame:
    """One sealed run for each candidate: its metrics over the test rows of ``forecasts``, in the columns of ``run_log``."""
    scores = forecasts.filter("split = 'test'").groupBy(*KEY).agg(*ft.metrics())
    return scores.select(
        F.concat_ws("-", "model", "subset", "param", F.lit("sealed")).alias("run_id"), F.col("model").alias("experiment"), F.lit("FINISHED").alias("status"), F.lit(3000).cast("long").alias("end_time"),
        F.create_map(F.lit("run_type"), F.lit("sealed"), F.lit("execution_uuid"), F.lit("e1")).alias("tags"),
        F.create_map(F.lit("subset"), F.col("subset"), F.lit("param"), F.col("param").cast("string")).alias("params"),
        F.create_map(*(x for m in MEASURES for x in (F.lit(f"test_{m}"), F.col(m)))).alias("metrics"),
    )


def select_first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The best row of each key by an ordered policy; rows whose ranking value is null take no part."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def tidy(runs: DataFrame) -> DataFrame:
    """One row for each run and metric name, split into phase, metric, horizon and statistic."""
    m = runs.select("run_id", "experiment", F.col("tags")["execution_uuid"].alias("execution"), F.col("params")["subset"].alias("subset"), F.col("params")["param"].try_cast("long").alias("param"), "end_time", F.explode("metrics").alias("name", "value"))
    grammar = r"^(cv|test)_(mae|rmse|me|r2)(?:_horizon_(\d+))?(?:_(mean|std))?$"
    part = lambda i: F.regexp_extract("name", grammar, i)
    return m.select("*", part(1).alias("phase"), part(2).alias("metric"), F.coalesce(part(3).try_cast("long"), F.lit(0).cast("long")).alias("horizon"), part(4).alias("stat"))


def complete_executions(runs: DataFrame) -> DataFrame:
    """``(experiment, execution, end_time)`` of executions all of whose runs have all expected, finite metrics."""
    finite = F.forall(F.array(*map(F.lit, NAMES)), lambda n: F.col("metrics")[n].isNotNull() & ~F.isnan(F.col("metrics")[n]))
    own = runs.groupBy("experiment", F.col("tags")["execution_uuid"].alias("execution")).agg(F.max("end_time").alias("end_time"), F.bool_and(finite).alias("complete"))
    return own.filter("complete").drop("complete")


def newest_complete(runs: DataFrame) -> DataFrame:
    return select_first(complete_executions(runs), ["experiment"], [F.desc("end_time"), "execution"])
