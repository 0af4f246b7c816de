"""Windows with a whole context, regime logs, and faults of forecasts and searches, against literal rows."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

import oracle
from tidemill.operators import review as rv
from tidemill.plans import q_review

NAN = float("nan")
HOUR = [dt.datetime(2024, 1, 1) + dt.timedelta(hours=h) for h in range(200)]


def forecasts(spark, errors):
    """Two horizons for each (model, hour, error)."""
    rows = [(m, HOUR[h], k, 10.0, None if e is None else 10.0 + e) for m, h, e in errors for k in (1, 2)]
    return spark.createDataFrame(rows, "model string, issue_ts timestamp, horizon long, actual double, prediction double")


def hours(spark, at):
    return spark.createDataFrame([(HOUR[h],) for h in at], "ts timestamp")


def test_windows_come_from_whole_contexts_only_and_the_earliest_of_equals(spark):
    f = forecasts(spark, [("a", 1, 0.1), ("a", 2, 3.0), ("a", 3, 1.0), ("a", 5, -3.0), ("a", 4, -1.0), ("a", 9, 99.0), ("b", 2, 1.0), ("b", 3, 2.0)])
    got = {(r["model"], r["kind"]): (r["issue_ts"], r["rmse"], r["n_eligible"]) for r in rv.best_and_worst(f, hours(spark, [2, 3, 4, 5, 5, 77])).collect()}
    assert got == {("a", "best"): (HOUR[3], 1.0, 4), ("a", "worst"): (HOUR[2], 3.0, 4), ("b", "best"): (HOUR[2], 1.0, 2), ("b", "worst"): (HOUR[3], 2.0, 2)}


@pytest.mark.parametrize("error", [NAN, math.inf, None])
def test_windows_are_refused_for_any_error_that_is_not_finite(spark, error):
    f = forecasts(spark, [("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, error)])  # the last one isn't eligible, but counts
    with pytest.raises(Exception, match="not finite"):
        rv.best_and_worst(f, hours(spark, [1, 2])).collect()


def test_windows_are_refused_below_two_eligible_issue_times(spark):
    with pytest.raises(Exception, match="found 1"):
        rv.best_and_worst(forecasts(spark, [("a", 1, 1.0), ("a", 2, 2.0)]), hours(spark, [2])).collect()
    assert rv.best_and_worst(forecasts(spark, []), hours(spark, [])).count() == 0


def test_contexts_reach_over_both_sides(spark):
    rows = [("s", HOUR[h], 1.0 if h != 20 else None, h == 60) for h in range(100)]
    frames = spark.createDataFrame(rows, "station_id string, ts timestamp, water_level double, imputed boolean")
    got = {HOUR.index(r["ts"]) for r in rv.complete_contexts(frames, 5).collect()}
    assert got == {h for h in range(5, 95) if not h - 5 <= 20 <= h + 5 and not h - 5 <= 60 <= h + 5}


def test_two_days_of_context_on_larger_tables(spark):
    large = "/root/testdata/sf0.1"
    got = q_review.eligible_windows(spark, large, rv.CONTEXT).toPandas()
    assert len(got) == 4 and set(got["n_eligible"]) == {504}
    assert not oracle.differences(got, oracle.connection(large).execute(q_review.windows_sql(rv.CONTEXT)).df())


def test_issue_times_by_status(spark):
    f = forecasts(spark, [("a", 1, 0.1), ("a", 2, 0.1), ("b", 2, 0.1)])
    asked = hours(spark, [1, 2, 3, 3]).withColumnRenamed("ts", "issue_ts")
    got = {HOUR.index(r["issue_ts"]): r["status"] for r in rv.issue_time_status(asked, f, hours(spark, [2, 3])).collect()}
    assert got == {1: "context has a gap", 2: "drawn", 3: "no forecast"}


def test_faults_of_forecasts(spark):
    cases = [([1.0, 2.0], None), ([1.0], "shape"), ([1.0, 2.0, 3.0], "shape"), ([], "shape"), (None, "shape"), ([1.0, NAN], "not finite"), ([None, 1.0], "not finite"), ([-math.inf, 1.0], "not finite")]
    rows = spark.createDataFrame([(i, p, "clash") for i, (p, _) in enumerate(cases)], "i int, predicted array<double>, n string")
    assert [r["fault"] for r in rv.prediction_faults(rows, 2).orderBy("i").collect()] == [f for _, f in cases]


def test_failed_candidates_stay(spark):
    scores = spark.createDataFrame([("a", 0, 1.0, 1.0, 1.0, 1.0), ("a", 1, 1.0, NAN, 1.0, 1.0), ("c", 0, 1.0, None, 1.0, 1.0)], "k string, fold long, mae double, rmse double, me double, r2 double")
    planned = spark.createDataFrame([("a",), ("b",), ("b",)], "k string")
    got = {(r["k"], r["fold"]): (r["status"], r["reason"]) for r in rv.search_status(scores, planned, ["k"], 2).collect()}
    nothing = ("failed", "no value was scored")
    assert got == {("a", 0): ("finished", None), ("a", 1): ("failed", "a metric is not finite"), ("b", 0): nothing, ("b", 1): nothing}


PARAMS = {"regime_q25_cm": "1", "quartile_q50_cm": "2", "water_level_quartile_q75_cm": " 3 ", "regime_quartile_reference_count": "7", "alarm_threshold_cm": "9", "forecast_horizon_hours": "1"}


def run(spark, metrics, params=None):
    return spark.createDataFrame([("r", "m", PARAMS | (params or {}), metrics)], "run_id string, experiment string, params map<string,string>, metrics map<string,double>")


def alarm(n=2.0, late=True):
    """The alarm regime of one horizon, under two orders of the name's parts."""
    name = lambda w: f"sealed_test_alarm_{w}_horizon_01" if late else f"test_alarm_horizon_01_{w}"
    every = {f"test_alarm_{w}": v for w, v in (("mae", 1.5), ("rmse", 2.5), ("me", -1.5), ("count", n))}
    return every | {name(w): v for w, v in (("mae", 1.0), ("rmse", 2.0), ("me", -1.0), ("scored_values", n))}


@pytest.mark.parametrize("late", [True, False])
def test_regime_rows_of_any_spelling(spark, late):
    got = rv.regime_rows(run(spark, alarm(late=late))).orderBy("horizon", "metric").collect()
    assert [(r["scope"], r["horizon"], r["metric"], r["value"]) for r in got] == [("aggregate", 0, "mae", 1.5), ("aggregate", 0, "me", -1.5), ("aggregate", 0, "rmse", 2.5), ("horizon", 1, "mae", 1.0), ("horizon", 1, "me", -1.0), ("horizon", 1, "rmse", 2.0)]
    assert {(r["phase"], r["regime"], r["lower_bound"], r["upper_bound"], r["scored_values"]) for r in got} == {("sealed_test_alarm", "alarm", 9.0, None, 2)}


def test_the_canonical_name_counts_and_metrics_before_parameters(spark):
    metrics = alarm() | {"regime_alarm_mae": 77.0, "sealed_test_alarm_mae": 5.0, "sealed_test_alarm_mae_horizon_x": 3.0}
    rows = rv.regime_rows(run(spark, metrics, {"sealed_test_alarm_rmse": "88"})).filter("horizon = 0").collect()
    assert {r["metric"]: r["value"] for r in rows} == {"mae": 5.0, "rmse": 2.5, "me": -1.5}


def test_an_empty_regime_has_counts_and_no_values(spark):
    rows = rv.regime_rows(run(spark, {k: v if "count" in k or "scored" in k else NAN for k, v in alarm(0.0).items()})).collect()
    assert len(rows) == 6 and {(r["value"], r["scored_values"]) for r in rows} == {(None, 0)}
    table = rv.regime_table(rv.regime_rows(run(spark, alarm(0.0)))).collect()
    assert [(r["regime"], r["empty"], r["counts_agree"]) for r in table] == [("alarm", True, True)]


def test_runs_before_regimes_and_broken_ones_have_no_rows(spark):
    old = spark.createDataFrame([("r", "m", {"forecast_horizon_hours": "1"}, {"test_rmse": 1.0})], "run_id string, experiment string, params map<string,string>, metrics map<string,double>")
    assert rv.regime_rows(old).count() == 0 and rv.regime_faults(old).first()["faults"] == []
    for params, fault in (({"regime_q25_cm": "none"}, "q25 missing or not finite"), ({"regime_q25_cm": "2.5"}, "cutoffs not ascending"), ({"regime_quartile_reference_count": "-1"}, "reference count not positive")):
        broken = run(spark, alarm(), params)
        assert rv.regime_faults(broken).first()["faults"] == [fault] and rv.regime_rows(broken).count() == 0
    lost = run(spark, {k: v for k, v in alarm().items() if k != "sealed_test_alarm_me_horizon_01"})
    assert rv.regime_faults(lost).first()["faults"] == ["a value is missing"]
    assert rv.regime_faults(run(spark, alarm(1.5))).first()["faults"] == ["a count is missing or not whole"]


def test_counts_that_disagree_are_told(spark):
    two = run(spark, alarm()).union(run(spark, alarm(3.0)).withColumn("run_id", F.lit("other")))
    row = rv.regime_table(rv.regime_rows(two)).first()
    assert not row["counts_agree"] and row["runs"] == 2 and row["scored_values"] == 3
