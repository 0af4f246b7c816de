"""Literal inputs and results of the series operators."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.functions import stats
from tidemill.operators import features as ft
from tidemill.operators import grid, models
from tidemill.sources import readings as src

START = datetime(2024, 1, 1)
SCHEMA = "station_id string, ts timestamp_ntz, value double"


def hourly(spark, values, station="a", skip=()):
    return spark.createDataFrame([(station, START + timedelta(hours=i), v) for i, v in enumerate(values) if i not in skip], SCHEMA)


def filled(df, gap):
    rows = grid.gap_filled(df, gap).orderBy("ts").collect()
    return [r["water_level"] for r in rows], [r["imputed"] for r in rows]


@pytest.mark.parametrize(("values", "gap", "level", "imputed"), [
    ([1, None, None, None, 5, 6], 3, [1, 1, 1, 1, 5, 6], [False, True, True, True, False, False]),
    ([1, None, None, None, None, 6], 3, [1, None, None, None, None, 6], [False] * 6),
    ([0, -1, 2, 3], 2, [None, None, 2, 3], [False] * 4),
    ([2, 3, 0, -1], 2, [2, 3, None, None], [False] * 4),
    ([2, 0, -1, 5], 2, [2, 2, 2, 5], [False, True, True, False]),
    ([2, 0, -1, 0, -1, 3], 2, [2, None, None, None, None, 3], [False] * 6),
])
def test_gap_rule(spark, values, gap, level, imputed):
    df = hourly(spark, [None if v is None else float(v) for v in values])
    assert filled(df, gap) == (level, imputed)


def test_missing_rows_become_grid_rows(spark):
    assert filled(hourly(spark, [1.0, 2.0, 3.0], skip=(1,)), 6) == ([1, 1, 3], [False, True, False])


def test_later_rows_change_nothing_before(spark):
    values = [float(v) if v else None for v in np.random.default_rng(1).integers(0, 4, 60)]
    early = filled(hourly(spark, values[:40]), 3)[0]
    late = filled(hourly(spark, values), 3)[0]
    last = max(i for i in range(40) if values[i])
    assert early[: last + 1] == late[: last + 1]


def test_empty_readings(spark):
    assert grid.gap_filled(hourly(spark, [1.0]).limit(0)).count() == 0


def frame(spark, n, missing=(), imputed=()):
    rows = [("a", START + timedelta(hours=i), None if i in missing else float(i), i in imputed, float(i), 280.0 + i, "train") for i in range(n)]
    return spark.createDataFrame(rows, "station_id string, ts timestamp_ntz, water_level double, imputed boolean, precipitation double, temperature_2m double, split string")


def test_feature_values(spark):
    df = frame(spark, 220, imputed=(160,)).select("ts", *(c.alias(n) for n, c in ft.feature_columns().items())).orderBy("ts").collect()
    r = df[180]
    assert (r["lag_1"], r["lag_72"], r["change_24"], r["mean_6"]) == (179, 108, 24, 177.5)
    assert r["std_6"] == pytest.approx(np.std(np.arange(175, 181)), abs=1e-6)
    assert (r["min_24"], r["max_24"], r["imputed_count_24"], r["precipitation_6"]) == (157, 180, 1, sum(range(175, 181)))
    assert (r["temperature_mean_6"], r["temperature_min_24"], r["temperature_max_24"]) == (457.5, 437, 460)
    assert df[70]["mean_72"] is None and df[71]["mean_72"] is not None


def test_targets_are_all_or_nothing(spark):
    rows = frame(spark, 220).select("ts", *(c.alias(n) for n, c in ft.forward_targets().items())).orderBy("ts").collect()
    assert list(rows[10])[1:] == list(range(11, 35)) and list(rows[195])[1:] == list(range(196, 220))
    assert all(v is None for r in rows[196:] for v in list(r)[1:])


def test_eligibility(spark):
    rows = frame(spark, 80, missing=(10,), imputed=(30,)).select("ts", ft.eligible().alias("ok")).orderBy("ts").collect()
    ok = [r["ok"] for r in rows]
    assert not any(ok[:10]) and not any(ok[6:30]) and ok[30] and all(ok[40:56]) and not any(ok[-24:])


@pytest.mark.parametrize(("n", "fraction", "train"), [(503, 0.20, 402), (10, 0.25, 7), (3, 0.50, 1)])
def test_split_sizes(spark, n, fraction, train):
    rows = frame(spark, n).drop("split")
    assert ft.split(rows, "a", fraction).filter("split = 'train'").count() == train


def test_fold_bounds(spark):
    found = spark.range(1).select(F.explode(ft.fold_bounds(F.lit(20).cast("long"), 2, 0.5, 2)).alias("f")).select("f.*").collect()
    assert [(r["train_end"], r["val_start"], r["val_end"]) for r in found] == [(10, 12, 16), (14, 16, 20)]


def test_metrics(spark):
    rows = [(1.0, 2.0), (2.0, 1.0), (3.0, 5.0), (4.0, 1.0)]
    m = spark.createDataFrame(rows, "actual double, prediction double").agg(*ft.metrics()).first()
    # errors 1, -1, 2, -3
    assert (m["mae"], m["me"]) == (1.75, -0.25) and m["rmse"] == pytest.approx(3.75**0.5, abs=1e-6) and m["r2"] == -2.0


def test_histories(spark):
    body = '{"status":{"code":200},"payload":{"history":[{"sourceDate":"31.03.2024T01:00:00+0100","value":1},{"sourceDate":"31.03.2024T03:00:00+0200","value":2}]}}'
    rows = src.history_rows(spark.createDataFrame([(body,), ('{"status":{"code":200},"payload":{"history":null}}',)], "body string")).orderBy("source_ts").collect()
    assert [r["value"] for r in rows] == [1.0, 2.0] and (rows[1]["source_ts"] - rows[0]["source_ts"]).seconds == 3600
    with pytest.raises(Exception, match="unusable history"):
        src.history_rows(spark.createDataFrame([('{"status":{"code":500}}',)], "body string")).collect()


def test_landed_histories_are_bounded_and_keep_every_station(spark, tmp_path):
    from tidemill.plans.q_series import landed_history

    rows = [(k, START + timedelta(seconds=k % 3000), None if k % 50 == 0 else k / 7, ("click", "flood", None)[k % 3]) for k in range(3000)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, value double, event_type string")
    events.write.parquet(f"{tmp_path}/events.parquet")
    got = sorted((r["station_id"] or "", r["source_ts"], r["value"]) for r in landed_history(spark, str(tmp_path)).collect())
    assert got == sorted((t or "", ts, round(v, 3)) for _, ts, v, t in rows if v is not None)
    sizes = [len(r["body"].split("sourceDate")) - 1 for r in src.landed_bodies(events, 50).collect()]
    assert sum(sizes) == 3000 and len(sizes) >= 55 and max(sizes) < 150


def test_bad_weather_is_refused(spark, tmp_path):
    head = "time,RR [kg m-2],T2M [degree_Celsius],lat,lon\n"
    for i, bad in enumerate(["2024-01-01T00:00:00,x,1,48,16\n", "soon,1,1,48,16\n", "2024-01-01T00:00:00,1,1,48,16\n2024-01-01T01:00:00,1,1,49,16\n"]):
        (tmp_path / f"{i}.csv").write_text(head + bad)
        with pytest.raises(Exception):  # noqa: B017
            src.weather_from_csv(spark, f"file://{tmp_path}/{i}.csv", "2024-01-01", "2024-01-02").collect()
    (tmp_path / "ok.csv").write_text(head + "2024-01-01T02:00:00,5,,48,16\n2024-01-01T02:00:00,9,,48,16\n")
    rows = src.weather_from_csv(spark, f"file://{tmp_path}/ok.csv", "2024-01-01", "2024-01-02").collect()
    assert [(r["precipitation"], r["temperature_2m"]) for r in rows] == [(9.0, None)]


def test_ridge_is_the_closed_form(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 2)) * [3, 0.5] + [10, -4]
    y = x @ [1.5, -2] + rng.normal(size=200)
    df = spark.createDataFrame([("a", *map(float, r), float(t)) for r, t in zip(x, y)], "k string, u double, v double, y double")
    got = {r["feature"]: r["coefficient"] for r in models.ridge(df, ["k"], ["u", "v"], "y", [7.0]).collect()}
    z = (x - x.mean(0)) / x.std(0)
    want = np.linalg.solve(z.T @ z + 7 * np.eye(2), z.T @ (y - y.mean())) / x.std(0)
    assert [got["u"], got["v"]] == pytest.approx(want.tolist(), rel=1e-8)


def test_histogram_of_a_constant(spark):
    df = spark.createDataFrame([("a", 2.0)] * 3, "k string, v double")
    got = {r["bin"]: r["n"] for r in stats.histogram(df, ["k"], "v", 4).collect()}
    assert got == {0: 0, 1: 0, 2: 3, 3: 0}


def test_stream_keeps_the_last_of_an_hour(spark, sf, tmp_path):
    from tidemill.streaming.hourly import hourly_stream

    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(2).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    run = hourly_stream(stream).writeStream.format("memory").queryName("hours").outputMode("complete").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = spark.table("hours").select("station_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "value")
    want = src.readings(spark, sf)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
