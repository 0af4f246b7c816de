"""Registered queries: fits, recursive forecasts, tests of stationarity and landed files."""

from __future__ import annotations

import uuid

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.operators import features as ft
from tidemill.operators import grid, models
from tidemill.plans import sql as q
from tidemill.plans.catalogue import query
from tidemill.plans.stored import shared_dir, table
from tidemill.sources import readings as src

R = q.readings()
PREDICTORS = ["water_level", "lag_1", "lag_24", "mean_6", "mean_24"]


def training(spark, sf):
    """Complete training rows of all stations, with the next hour's level."""
    rows = ft.featured(spark, sf).filter("split = 'train'").select("station_id", "ts", *PREDICTORS, "t1")
    return rows.filter(" and ".join(f"{c} is not null" for c in [*PREDICTORS, "t1"]))


@query("gram_stats", f"""WITH {q.ALL}, tr AS (SELECT station_id, water_level, lag_1, lag_24, mean_6, mean_24, t1 FROM ft WHERE split = 'train' AND water_level IS NOT NULL AND lag_1 IS NOT NULL AND lag_24 IS NOT NULL AND mean_6 IS NOT NULL AND mean_24 IS NOT NULL AND t1 IS NOT NULL)
SELECT station_id, 'one' AS i, 'one' AS j, CAST(count(*) AS DOUBLE) AS s FROM tr GROUP BY 1 UNION ALL SELECT station_id, 'water_level', 't1', round(sum(water_level * t1) + 1e-9, 3) FROM tr GROUP BY 1 UNION ALL SELECT station_id, 'mean_24', 'mean_24', round(sum(mean_24 * mean_24) + 1e-9, 3) FROM tr GROUP BY 1""")
def gram_stats(spark, sf):
    g = models.gram(training(spark, sf), ["station_id"], [*PREDICTORS, "t1"])
    wanted = "(i = 'one' and j = 'one') or (i = 'water_level' and j = 't1') or (i = 'mean_24' and j = 'mean_24')"
    return g.filter(wanted).select("station_id", "i", "j", F.when(F.col("i") == "one", F.col("s")).otherwise(F.round(F.col("s") + ft.NUDGE, 3)).alias("s"))


@query("ridge_fit")
def ridge_fit(spark, sf):
    """Five penalties for every station from one Gram scan."""
    return models.ridge(training(spark, sf), ["station_id"], PREDICTORS, "t1", [0.1, 1.0, 10.0, 100.0, 1000.0])


@query("model_formula")
def model_formula(spark, sf):
    """The coefficients of one penalty beside their predictors' centre and scale."""
    rows = training(spark, sf)
    moments = rows.unpivot(["station_id"], PREDICTORS, "feature", "v").groupBy("station_id", "feature").agg(F.avg("v").alias("centre"), F.stddev_pop("v").alias("scale"))
    return models.ridge(rows, ["station_id"], PREDICTORS, "t1", [1.0]).join(moments, ["station_id", "feature"], "left")


def _assembled(spark, sf):
    return VectorAssembler(inputCols=PREDICTORS, outputCol="x").transform(training(spark, sf)).select("station_id", "ts", "x", F.col("t1").alias("label"))


def _errors(fitted, rows):
    e = F.col("prediction") - F.col("label")
    return fitted.transform(rows).groupBy("station_id").agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"))


@query("linear_regression")
def linear_regression(spark, sf):
    """Spark's own ridge: its penalty is ``alpha / n`` times the deviation of the label."""
    rows = _assembled(spark, sf)
    n, sd = rows.agg(F.count("*"), F.stddev_pop("label")).first()
    return _errors(LinearRegression(featuresCol="x", regParam=1.0 / max(n, 1) * (sd or 1.0), elasticNetParam=0.0, solver="normal").fit(rows), rows)


@query("boosted_trees")
def boosted_trees(spark, sf):
    rows = _assembled(spark, sf)
    fitted = GBTRegressor(featuresCol="x", maxIter=8, maxDepth=3, seed=7).fit(rows)
    return spark.createDataFrame([(n, float(v)) for n, v in zip(PREDICTORS, fitted.featureImportances.toArray())], "feature string, importance double").crossJoin(F.broadcast(_errors(fitted, rows).agg(F.avg("rmse").alias("rmse"))))


@query("random_forest")
def random_forest(spark, sf):
    rows = _assembled(spark, sf)
    fitted = RandomForestRegressor(featuresCol="x", numTrees=10, maxDepth=4, seed=7, featureSubsetStrategy="sqrt", subsamplingRate=0.8).fit(rows)
    return _errors(fitted, rows)


@query("ar_design", f"WITH {R}, {q.frame()}, d AS (SELECT station_id, ts, water_level, lag(water_level, 1) OVER w AS l1, lag(water_level, 2) OVER w AS l2 FROM f WINDOW w AS (PARTITION BY station_id ORDER BY ts)) SELECT * FROM d WHERE water_level IS NOT NULL AND l1 IS NOT NULL AND l2 IS NOT NULL")
def ar_design(spark, sf):
    return models.ar_rows(grid.gap_filled(src.readings(spark, sf)), 2)


@query("ar_fit")
def ar_fit(spark, sf):
    """Autoregressions of order two for every station, by conditional least squares on the Gram aggregate."""
    return models.ridge(ar_design(spark, sf), ["station_id"], ["l1", "l2"], "water_level", [0.0])


@query("ar_fit_users")
def ar_fit_users(spark, sf):
    """The same over one series per user, which grows with the tables."""
    return models.ridge(models.ar_rows(grid.gap_filled(src.readings(spark, sf, "user")), 2), ["station_id"], ["l1", "l2"], "water_level", [0.0])


@query("recursive_ar_forecast", f"WITH {R}, {q.frame()} SELECT station_id, ts, round(1.0 + 0.5::DOUBLE * water_level, 6) AS step_1, round((1.0 + 0.5::DOUBLE * (1.0 + 0.5::DOUBLE * (1.0 + 0.5::DOUBLE * water_level))), 6) AS step_3 FROM f WHERE water_level IS NOT NULL")
def recursive_ar_forecast(spark, sf):
    f = grid.gap_filled(src.readings(spark, sf)).filter("water_level is not null")
    out = models.recursive(f, "water_level", F.lit(1.0), F.lit(0.5), 24)
    return out.select("station_id", "ts", F.round(F.col("path")[0], 6).alias("step_1"), F.round(F.col("path")[2], 6).alias("step_3"))


@query("recursive_arx_forecast")
def recursive_arx_forecast(spark, sf):
    """Paths of 24 hours from every complete window, by fitted coefficients applied to the paths' own levels."""
    frames = grid.gap_filled(src.readings(spark, sf))
    fitted = {r["feature"]: r["coefficient"] for r in models.ridge(models.ar_rows(frames, 3).withColumn("all", F.lit(1)), ["all"], ["l1", "l2", "l3"], "water_level", [1.0]).collect()}
    last = Window.partitionBy("station_id").orderBy("ts").rowsBetween(-2, 0)
    windows = frames.select("station_id", "ts", F.collect_list("water_level").over(last).alias("w")).filter(F.size("w") == 3)
    return models.recursive_levels(windows, fitted, [1, 2, 3], 24)


@query("adf_stat")
def adf_stat(spark, sf):
    """The t-statistic of the level in the regression of differences on level and one lagged difference, per station."""
    import numpy as np
    import pandas as pd

    d = models.ar_rows(grid.gap_filled(src.readings(spark, sf)), 2).select("station_id", F.col("l1").alias("level"), (F.col("water_level") - F.col("l1")).alias("dy"), (F.col("l1") - F.col("l2")).alias("dl"))

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        s = {(r.i, r.j): r.s for r in g.itertuples()} | {(r.j, r.i): r.s for r in g.itertuples()}
        names = ["one", "level", "dl"]
        a, b = np.array([[s[x, y] for y in names] for x in names]), np.array([s[x, "dy"] for x in names])
        beta = np.linalg.pinv(a) @ b
        n = s["one", "one"]
        rest = max(s["dy", "dy"] - beta @ b, 0) / max(n - 3, 1)
        return pd.DataFrame({"station_id": [g["station_id"].iloc[0]], "n": [int(n)], "adf": [float(beta[1] / np.sqrt(rest * np.linalg.pinv(a)[1, 1] + 1e-300))]})

    return models.gram(d, ["station_id"], ["level", "dl", "dy"]).groupBy("station_id").applyInPandas(fit, "station_id string, n long, adf double")


@query("sample_params")
def sample_params(spark, sf):
    """Seeded parameter draws, one for each station and number: log-uniform, uniform and integer, by inverse distribution."""
    stations = table(spark, sf, "events").select(F.concat(F.lit("u"), "user_id").alias("station_id")).distinct()
    u = lambda k: F.pmod(F.xxhash64("station_id", "draw", F.lit(k)), F.lit(1 << 30)) / float(1 << 30)
    return stations.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(15)))).select("station_id", "draw", F.exp(F.log(F.lit(1e-4)) + u(1) * (F.log(F.lit(1.0)) - F.log(F.lit(1e-4)))).alias("rate"), (0.5 + 0.5 * u(2)).alias("share"), (2 + F.floor(u(3) * 7)).alias("depth"))


@query("flatten_catalog")
def flatten_catalog(spark, sf):
    """A nested catalog landed as JSON, read and flattened; list columns are dropped."""
    c = src.catalog(spark, sf).select(F.struct(F.col("station_id").alias("commonid"), "position_km").alias("station"), F.array("position_km").alias("measurements"))
    path = f"{shared_dir(spark)}/catalog-{uuid.uuid4().hex}"
    c.write.json(path)
    return src.flatten_catalog(spark.read.json(path))


@query("csv_weather_ingest", f"WITH {q.WEATHER} SELECT ts, round(precipitation, 4) AS precipitation, round(temperature_2m, 4) AS temperature_2m FROM wx WHERE station_id = 'click' AND ts BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-20'")
def csv_weather_ingest(spark, sf):
    w = src.weather(spark, sf).filter("station_id = 'click'").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("time"), F.round("precipitation", 4).alias("RR [kg m-2]"), F.round("temperature_2m", 4).alias("T2M [degree_Celsius]"), F.lit(48.2).alias("lat"), F.lit(16.4).alias("lon"))
    path = f"{shared_dir(spark)}/weather-{uuid.uuid4().hex}"
    w.write.option("header", True).csv(path)
    out = src.weather_from_csv(spark, path, "2024-01-02", "2024-01-20")
    return out.select(F.col("ts").cast("timestamp_ntz").alias("ts"), "precipitation", "temperature_2m")
