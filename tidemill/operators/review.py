"""Review of scored executions: forecast windows with a whole context, regime rows out of run logs, checks of forecasts and searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CONTEXT = 48  # hours before and after an issue time
MEASURES = ("mae", "rmse", "me", "r2")


def finite(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def complete_contexts(frames: DataFrame, hours: int = CONTEXT) -> DataFrame:
    """``(station_id, ts)`` of the hours with ``hours`` observed hours on both sides, by one row frame on the dense grid."""
    own = Window.partitionBy("station_id").orderBy("ts").rowsBetween(-hours, hours)
    n = F.count_if(F.col("water_level").isNotNull() & ~F.col("imputed")).over(own)
    return frames.withColumn("_n", n).filter(F.col("_n") == 2 * hours + 1).select("station_id", "ts")


def scored_windows(forecasts: DataFrame) -> DataFrame:
    """``(model, issue_ts, rmse)`` over the horizons of each issue time."""
    e = F.col("prediction") - F.col("actual")
    return forecasts.groupBy("model", "issue_ts").agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.bool_and(finite(e)).alias("finite"))


def best_and_worst(forecasts: DataFrame, contexts: DataFrame) -> DataFrame:
    """``(model, kind, issue_ts, rmse, n_eligible)``: the windows of least and greatest error among issue times of ``contexts(ts)``,
    the earliest of equals.

    Refused, when it runs, where any error of any issue time isn't finite (null counts as such) or fewer than two issue times of a
    model are eligible. One aggregate finds both windows, so nothing is sorted. Without forecasts there are no rows.
    """
    whole = contexts.select(F.col("ts").alias("issue_ts"), F.lit(True).alias("whole")).distinct()
    rows = scored_windows(forecasts).join(whole, "issue_ts", "left")
    key, at = F.round("rmse", 9), F.struct("issue_ts", "rmse")
    fits = lambda c: F.when(F.col("whole"), c)
    found = rows.groupBy("model").agg(
        F.count_if(~F.col("finite")).alias("bad"), F.count_if(F.col("whole")).alias("n_eligible"),
        F.min_by(at, fits(F.struct(key.alias("a"), F.col("issue_ts").alias("b")))).alias("best"), F.min_by(at, fits(F.struct((-key).alias("a"), F.col("issue_ts").alias("b")))).alias("worst"),
    )
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("w")) for k in ("best", "worst")))
    refused = F.when(F.col("bad") > 0, F.raise_error(F.lit("the error of a forecast window is not finite"))).when(F.col("n_eligible") < 2, F.raise_error(F.concat(F.lit("two issue times with a whole context are needed, found "), F.col("n_eligible").cast("string"))))
    checked = found.withColumn("w", F.when((F.col("bad") > 0) | (F.col("n_eligible") < 2), refused).otherwise(kinds))
    return checked.select("model", "n_eligible", F.explode("w").alias("x")).select("model", "x.kind", "x.w.issue_ts", F.round("x.w.rmse", 6).alias("rmse"), "n_eligible")


def issue_time_status(asked: DataFrame, forecasts: DataFrame, contexts: DataFrame) -> DataFrame:
    """``(issue_ts, status)`` of each distinct ``asked(issue_ts)``: whether a chart of that issue time can be drawn."""
    held = forecasts.select("issue_ts", F.lit(True).alias("held")).distinct()
    whole = contexts.select(F.col("ts").alias("issue_ts"), F.lit(True).alias("whole")).distinct()
    status = F.when(F.col("held").isNull(), "no forecast").when(F.col("whole").isNull(), "context has a gap").otherwise("drawn")
    return asked.select("issue_ts").distinct().join(held, "issue_ts", "left").join(whole, "issue_ts", "left").select("issue_ts", status.alias("status"))


def prediction_faults(rows: DataFrame, horizon: int) -> DataFrame:
    """``rows(predicted array<double>)`` with ``fault``: null for a forecast of ``horizon`` finite values, else what is wrong with it."""
    p = F.col("predicted")
    fault = F.when(p.isNull() | (F.size(p) != horizon), "shape").when(F.exists(p, lambda x: ~finite(x)), "not finite")
    return rows.withColumn("fault", fault)


def search_status(scores: DataFrame, planned: DataFrame, keys: list[str], folds: int, measures=MEASURES) -> DataFrame:
    """``(keys, fold, status, reason)`` of every planned candidate on every fold, so that failures stay in the table.

    ``scores(keys, fold, measures)`` has at most one row for each; a fold without one, or with a measure that isn't finite, has failed.
    """
    every = planned.select(*keys).distinct().withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(folds - 1).cast("long"))))
    good = F.forall(F.array(*measures), finite)
    own = scores.select(*keys, "fold", good.alias("_good"))
    reason = F.when(F.col("_good").isNull(), "no value was scored").when(~F.col("_good"), "a metric is not finite")
    return every.join(own, [*keys, "fold"], "left").select(*keys, "fold", F.when(F.col("_good"), "finished").otherwise("failed").alias("status"), reason.alias("reason"))


# --- regimes in run logs. The names under which runs log them, the canonical one first
QUARTILES = {25: "q25", 50: "q50", 75: "q75"}
CUTOFF_PREFIXES = ("regime_", "target_water_level_quartile_", "water_level_quartile_", "quartile_")
REFERENCE_NAMES = ("regime_quartile_reference_count", "target_water_level_quartile_reference_count", "water_level_quartile_reference_count", "quartile_reference_count")
ALARM_NAMES = ("regime_alarm_threshold_cm", "water_level_alarm_threshold_cm", "target_water_level_alarm_threshold_cm", "alarm_threshold_cm")
METRIC_PREFIXES = ("sealed_test_", "sealed_test_quartile_", "test_quartile_", "regime_", "test_", "sealed_test_regime_", "test_regime_")
COUNT_WORDS = ("scored_value_count", "scored_values", "scored_forecast_values", "count")
REGIMES = ("q1", "q2", "q3", "q4", "alarm")
LOGGED = ("mae", "rmse", "me")  # of a regime

_GRAMMAR = f"^({'|'.join(METRIC_PREFIXES)})({'|'.join(REGIMES)})(?:_horizon_([0-9]+))?_({'|'.join(LOGGED + COUNT_WORDS)})(?:_horizon_([0-9]+))?$"


def first_alias(params: Column, names) -> Column:
    """The first name that has text; null without one."""
    return F.coalesce(*(F.nullif(F.trim(params[n]), F.lit("")) for n in names))


def regime_definitions(runs: DataFrame) -> DataFrame:
    """``(run_id, advertised, q25, q50, q75, n_reference, alarm, horizons, definition_faults)`` of ``runs(run_id, params)``.

    A run without any of the parameters is of the time before regimes (``advertised`` false) and has no faults; one that has any
    must have all, finite, ascending and with a positive reference count.
    """
    p = F.col("params")
    texts = {name: first_alias(p, [f"{c}{name}_cm" for c in CUTOFF_PREFIXES]) for name in QUARTILES.values()} | {"n_reference": first_alias(p, REFERENCE_NAMES), "alarm": first_alias(p, ALARM_NAMES)}
    rows = runs.select("run_id", F.coalesce(*texts.values()).isNotNull().alias("advertised"), *(t.try_cast("long" if n == "n_reference" else "double").alias(n) for n, t in texts.items()), p["forecast_horizon_hours"].try_cast("long").alias("horizons"))
    checks = [F.when(~finite(c), f"{c} missing or not finite") for c in (*QUARTILES.values(), "alarm")]
    checks += [F.when((F.col("q25") > F.col("q50")) | (F.col("q50") > F.col("q75")), "cutoffs not ascending"), F.when(~F.coalesce(F.col("n_reference") > 0, F.lit(False)), "reference count not positive")]
    return rows.withColumn("definition_faults", F.when(F.col("advertised"), F.array_compact(F.array(*checks))).otherwise(F.array().cast("array<string>")))


def logged_regimes(runs: DataFrame) -> DataFrame:
    """``(run_id, regime, horizon, mae, rmse, me, scored_values)`` as logged, horizon 0 for all together. Of several spellings of
    one number the canonical one counts, metrics before parameters."""
    entries = runs.select("run_id", F.explode("metrics").alias("name", "value")).withColumn("source", F.lit(0)).unionByName(
        runs.select("run_id", F.explode("params").alias("name", "text")).select("run_id", "name", F.col("text").try_cast("double").alias("value"), F.lit(1).alias("source"))
    )
    part = lambda i: F.regexp_extract("name", _GRAMMAR, i)
    place = lambda names, c: F.array_position(F.array(*map(F.lit, names)), c)
    rows = entries.filter(F.col("name").rlike(_GRAMMAR)).select("run_id", "source", "value", part(1).alias("prefix"), part(2).alias("regime"), part(3).alias("early"), part(4).alias("word"), part(5).alias("late"))
    rows = rows.filter("early = '' or late = ''").withColumn("horizon", F.coalesce(F.concat("early", "late").try_cast("long"), F.lit(0).cast("long")))
    preferred = F.struct("source", place(METRIC_PREFIXES, F.col("prefix")).alias("p"), place(COUNT_WORDS, F.col("word")).alias("w"), (F.col("early") != "").alias("e"))
    pick = lambda c: F.min_by("value", F.when(c, preferred))
    return rows.groupBy("run_id", "regime", "horizon").agg(*(pick(F.col("word") == m).alias(m) for m in LOGGED), pick(F.col("word").isin(*COUNT_WORDS)).alias("scored_values"))


def _expected(runs: DataFrame) -> DataFrame:
    """Every regime and horizon that an advertising run must have logged, with what it did: a phase of which nothing is logged over
    all horizons is left out, but any of it asks for the whole."""
    logged = logged_regimes(runs)
    phase = F.when(F.col("regime") == "alarm", "sealed_test_alarm").otherwise("sealed_test_quartile")
    phases = logged.filter("horizon = 0").select("run_id", phase.alias("phase")).distinct()
    own = F.when(F.col("phase") == "sealed_test_alarm", F.array(F.lit("alarm"))).otherwise(F.array(*map(F.lit, REGIMES[:4])))
    sound = regime_definitions(runs).filter("advertised and horizons > 0")
    every = sound.join(phases, "run_id").withColumn("regime", F.explode(own)).withColumn("horizon", F.explode(F.sequence(F.lit(0).cast("long"), F.col("horizons"))))
    return every.join(logged, ["run_id", "regime", "horizon"], "left")


def regime_faults(runs: DataFrame) -> DataFrame:
    """``(run_id, faults)`` of every run: faults of the definition, then of counts and values, each kind once."""
    n = F.col("scored_values")
    whole = finite(n) & (n >= 0) & (n == F.floor(n))
    missing = F.exists(F.array(*LOGGED), lambda x: ~finite(x))
    kinds = _expected(runs).groupBy("run_id").agg(F.bool_or(~whole).alias("counts"), F.bool_or(whole & (n > 0) & missing).alias("values"))
    told = F.array_compact(F.array(F.when(F.col("counts"), "a count is missing or not whole"), F.when(F.col("values"), "a value is missing")))
    return regime_definitions(runs).join(kinds, "run_id", "left").select("run_id", F.concat("definition_faults", told).alias("faults"))


def regime_rows(runs: DataFrame) -> DataFrame:
    """Regime metrics of run logs as rows: ``(run_id, experiment, phase, regime, scope, horizon, metric, value, lower_bound,
    upper_bound, scored_values)`` of ``runs(run_id, experiment, params, metrics)``.

    Runs with any fault (``regime_faults``) have no rows, as have those of the time before regimes. Where nothing fell into
    a regime its values are null. Bounds are those of the run's own training quartiles; the lowest and the highest are open.
    """
    sound = regime_faults(runs).filter(F.size("faults") == 0).select("run_id")
    rows = _expected(runs).join(sound, "run_id", "left_semi").join(runs.select("run_id", "experiment"), "run_id")
    bound = lambda low: F.create_map(*(x for r, c in zip(REGIMES, ((None, "q25"), ("q25", "q50"), ("q50", "q75"), ("q75", None), ("alarm", None))) for x in (F.lit(r), F.col(c[not low]) if c[not low] else F.lit(None).cast("double"))))[F.col("regime")]
    values = F.array(*(F.struct(F.lit(m).alias("metric"), F.when((F.col("scored_values") > 0) & finite(m), F.col(m)).alias("value")) for m in LOGGED))
    scope = F.when(F.col("horizon") == 0, "aggregate").otherwise("horizon")
    return rows.select("run_id", "experiment", "phase", "regime", scope.alias("scope"), "horizon", F.explode(values).alias("v"), bound(True).alias("lower_bound"), bound(False).alias("upper_bound"), F.col("scored_values").cast("long").alias("scored_values")).select("*", "v.*").drop("v")


def regime_runs(scores: DataFrame, cutoffs, n_reference: int, alarm: float, horizons: int, spelling: Column) -> DataFrame:
    """``scores(model, regime, horizon, n, mae, rmse, me)`` as one sealed run for each model; ``spelling`` 'old' logs counts as
    parameters and puts horizons before the metric."""
    old = spelling == "old"
    suffix = F.when(F.col("horizon") == 0, "").otherwise(F.format_string("_horizon_%02d", "horizon"))
    name = lambda word: F.when(old, F.concat(F.lit("test_"), F.when(F.col("regime") == "alarm", "").otherwise("quartile_"), "regime", suffix, F.lit(f"_{word}"))).otherwise(F.concat(F.lit("sealed_test_"), "regime", F.lit(f"_{word}"), suffix))
    measured = F.array(*(F.struct(name(m).alias("key"), F.coalesce(F.col(m), F.lit(float("nan"))).alias("value")) for m in LOGGED))
    count = F.struct(name("scored_values").alias("key"), F.col("n").cast("string").alias("value"))
    own = scores.filter("regime <> 'all'").groupBy(F.col("model").alias("experiment"), old.alias("old")).agg(F.flatten(F.collect_list(measured)).alias("m"), F.collect_list(count).alias("c"))
    prefix = F.when(F.col("old"), "quartile_").otherwise("regime_")
    params = [F.struct(F.concat(prefix, F.lit(f"{q}_cm")).alias("key"), F.lit(str(v)).alias("value")) for q, v in zip(QUARTILES.values(), cutoffs)]
    params += [F.struct(F.lit(k).alias("key"), F.lit(str(v)).alias("value")) for k, v in (("regime_quartile_reference_count", n_reference), ("alarm_threshold_cm", alarm), ("forecast_horizon_hours", horizons))]
    as_metrics = F.transform("c", lambda x: F.struct(x["key"].alias("key"), x["value"].cast("double").alias("value")))
    none = F.array().cast("array<struct<key: string, value: string>>")
    return own.select(
        F.concat("experiment", F.lit("-sealed")).alias("run_id"), "experiment",
        F.map_from_entries(F.concat(F.array(*params), F.when(F.col("old"), F.col("c")).otherwise(none))).alias("params"),
        F.map_from_entries(F.concat("m", F.when(F.col("old"), F.array().cast("array<struct<key: string, value: double>>")).otherwise(as_metrics))).alias("metrics"),
    )


def regime_table(rows: DataFrame) -> DataFrame:
    """One line for each regime over all horizons of ``regime_rows``: the number of values, whether all runs and metrics agree on it,
    whether nothing fell into it, and the least and greatest error of the runs."""
    rmse = F.when(F.col("metric") == "rmse", F.col("value"))
    return rows.filter("scope = 'aggregate'").groupBy("phase", "regime").agg(
        F.max("scored_values").alias("scored_values"), (F.min("scored_values") == F.max("scored_values")).alias("counts_agree"), (F.max("scored_values") == 0).alias("empty"),
        F.count_distinct("run_id").alias("runs"), F.min(rmse).alias("rmse_least"), F.max(rmse).alias("rmse_most"),
    )
