"""Registered queries: boosted trees of all horizons, recursion over rebuilt features, selection policies and saved models."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from tidemill.functions.calendar import utc_calendar
from tidemill.operators import boosting, grid, model_table, models, policies, rebuilt
from tidemill.operators import features as ft
from tidemill.operators import ridge_search as rs
from tidemill.plans import sql as q
from tidemill.plans.catalogue import query
from tidemill.plans.q_runlog import CAND, summary
from tidemill.plans.stored import shared_dir, stored
from tidemill.sources import readings as src

BINS = 16
INPUTS = ["water_level", "lag_1", "lag_24", "mean_6", "mean_24"]
_Y = ", ".join(f"t{h}" for h in ft.EVERY)
_TRAINED = f"""{q.BASE}, {q.FEATURES}, tr AS (SELECT station_id, ts, [{", ".join(f"{c}::DOUBLE" for c in INPUTS)}] AS x, [{_Y}] AS y FROM ft WHERE split = 'train' AND {" AND ".join(f"{c} IS NOT NULL" for c in INPUTS)} AND {" AND ".join(f"t{h} IS NOT NULL" for h in ft.EVERY)})"""


def boosted_rows(spark, sf):
    """Training hours of all stations with complete inputs and targets, binned."""
    rows = ft.featured(spark, sf).filter("split = 'train'").filter(" and ".join(f"{c} is not null" for c in [*INPUTS, *(f"t{h}" for h in ft.EVERY)]))
    return boosting.prepared(rows, INPUTS, F.array(*(F.col(f"t{h}").cast("double") for h in ft.EVERY)), ["station_id", "ts"], BINS)


@query("boosted_root_splits", f"""WITH {_TRAINED}, ed AS (SELECT {", ".join(f"list_sort(list_distinct(quantile_cont(x[{k}], [{', '.join(f'{b / BINS}' for b in range(1, BINS))}]))) AS e{k}" for k in range(1, 1 + len(INPUTS)))} FROM tr),
bn AS (SELECT y, [{", ".join(f"len(list_filter(e{k}, lambda z: z < x[{k}]))" for k in range(1, 1 + len(INPUTS)))}] AS b FROM tr, ed),
lo AS (SELECT h, f - 1 AS feature, b[f] AS bin, y[h] AS v FROM bn, (SELECT unnest(range(1, 25)) AS h), (SELECT unnest(range(1, {1 + len(INPUTS)})) AS f)),
mn AS (SELECT h, avg(v) AS m FROM lo GROUP BY 1),
hs AS (SELECT h, feature, bin, sum(v - m) AS g, count(*) AS n FROM lo JOIN mn USING (h) GROUP BY 1, 2, 3),
cu AS (SELECT h, feature, bin, sum(g) OVER w AS gl, sum(n) OVER w AS nl, sum(g) OVER a AS ga, sum(n) OVER a AS na FROM hs WINDOW w AS (PARTITION BY h, feature ORDER BY bin), a AS (PARTITION BY h, feature)),
ga AS (SELECT *, round(gl * gl / (nl + 1) + (ga - gl) * (ga - gl) / (na - nl + 1) - ga * ga / (na + 1), 6) AS gain FROM cu WHERE nl >= 5 AND na - nl >= 5)
SELECT h AS horizon, CAST(feature AS INTEGER) AS feature, CAST(bin AS INTEGER) AS cut, CAST(nl AS BIGINT) AS n_left, round(gain, 3) AS gain FROM ga QUALIFY row_number() OVER (PARTITION BY h ORDER BY gain DESC, feature, bin) = 1""")
def boosted_root_splits(spark, sf):
    """The first split of each horizon's first tree, which SQL can follow."""
    rows, _ = boosted_rows(spark, sf)
    means = {r["h"]: r["m"] for r in rows.select(F.posexplode("y").alias("h", "v")).groupBy("h").agg(F.avg("v").alias("m")).collect()}
    model = boosting.Boosted(np.array([means.get(h, 0.0) for h in range(24)]), 1)
    sums = boosting.level_sums(rows, model, np.full((24, 1), -1), np.zeros((24, 1), np.int64), 0, BINS)
    best = boosting.best_splits(sums, 1.0, 5)
    return best.select((F.col("horizon") + 1).cast("long").alias("horizon"), "feature", "cut", F.col("nl").alias("n_left"), F.round("gain", 3).alias("gain"))


@query("boosted_horizons")
def boosted_horizons(spark, sf):
    """Trees of all 24 horizons, fitted on three quarters of the days and scored on both parts."""
    rows, _ = boosted_rows(spark, sf)
    held = (F.dayofyear("ts") % 4 == 0).alias("held_out")
    rows = stored(rows.select("bins", "y", held), "binned")
    model = boosting.fit(rows.filter("not held_out"), 24, BINS, depth=2, rounds=5)
    return boosting.errors(rows, ["held_out"], model)


HELD = ["others"]
GIVEN = {"water_level": 0.35, "lag_1": 0.1, "lag_24": 0.15, "mean_6": 0.1, "max_24": 0.05, "std_72": 0.2, "change_3": -0.05, "imputed_count_24": 0.02, "hour_sin": 1.0, "hour_cos": -0.5, "others": 0.1}


def issue_windows(spark, sf):
    """Windows of all stations; the mean level of the others at the hour stands for their columns, which are held."""
    frames = grid.gap_filled(src.readings(spark, sf))
    hours = frames.groupBy("ts").agg(F.sum("water_level").alias("total"), F.count("water_level").alias("by"))
    frames = frames.join(hours, "ts").withColumn("others", (F.col("total") - F.col("water_level")) / F.nullif(F.col("by") - 1, F.lit(0)))
    return rebuilt.windows(frames, HELD)


_WIN = f"""{q.readings()}, {q.frame()}, ww AS (SELECT station_id, ts, list(water_level) OVER w AS l, list(CAST(imputed AS INT)) OVER w AS g, count(water_level) OVER w AS n, (sum(water_level) OVER t - water_level) / nullif(count(water_level) OVER t - 1, 0) AS others
  FROM f WINDOW w AS (PARTITION BY station_id ORDER BY ts ROWS BETWEEN 72 PRECEDING AND CURRENT ROW), t AS (PARTITION BY ts)),
wn AS (SELECT station_id, ts, l, g, others FROM ww WHERE n = 73 AND others IS NOT NULL)"""


def _features_sql(levels: str, flags: str) -> dict[str, str]:
    """LEVEL_FEATURES of lists of 73 levels and flags."""
    out = {"water_level": f"{levels}[73]"} | {f"lag_{k}": f"{levels}[{73 - k}]" for k in (1, 3, 6, 12, 24, 48, 72)} | {f"change_{k}": f"{levels}[73] - {levels}[{73 - k}]" for k in (1, 3, 6, 12, 24)}
    for w in (6, 24, 72):
        last = f"{levels}[{74 - w}:73]"
        out |= {f"mean_{w}": f"list_avg({last})", f"std_{w}": f"list_stddev_pop({last})", f"min_{w}": f"list_min({last})", f"max_{w}": f"list_max({last})"}
    return out | {f"imputed_count_{w}": f"list_sum({flags}[{74 - w}:73])" for w in (6, 24, 72)}


_AFTER = _features_sql("(list_concat(l[3:73], [l[73] + 1, l[73] * 0.5::DOUBLE]))", "(list_concat(g[3:73], [0, 0]))")


@query("rebuilt_features", f"WITH {_WIN} SELECT station_id, ts, {', '.join(f'round(CAST({e} AS DOUBLE) + 1e-9, 5) AS {n}' for n, e in _AFTER.items())} FROM wn")
def rebuilt_features(spark, sf):
    """Every level feature after two forecasts (a level more, and half the level) were appended to each window."""
    now = F.element_at("levels", -1)
    issues = issue_windows(spark, sf).withColumn("path", F.array(now + 1, now * 0.5))
    found = rebuilt.rebuilt_features(issues, "path", 2)
    return found.select("station_id", "ts", *(F.round(F.col(n) + ft.NUDGE, 5).alias(n) for n in rebuilt.LEVEL_FEATURES))


def _given(levels: str, flags: str, hours: str) -> str:
    f = _features_sql(levels, flags) | {"hour_sin": f"sin(2 * pi() * hour(ts + INTERVAL 1 HOUR * {hours}) / 24)", "hour_cos": f"cos(2 * pi() * hour(ts + INTERVAL 1 HOUR * {hours}) / 24)", "others": "others"}
    return "2.0::DOUBLE + " + " + ".join(f"({c})::DOUBLE * ({f[n]})" for n, c in GIVEN.items())


@query("rebuilt_recursion", f"""WITH RECURSIVE {_WIN}, st AS (SELECT station_id, ts, l, g, others, CAST(0 AS BIGINT) AS k, CAST(NULL AS DOUBLE) AS v FROM wn
  UNION ALL SELECT station_id, ts, list_append(l[2:73], x), list_append(g[2:73], 0), others, k + 1, x FROM (SELECT *, {_given("l", "g", "k")} AS x FROM st WHERE k < 24))
SELECT station_id, ts, k AS horizon, round(v + 1e-9, 4) AS prediction FROM st WHERE k > 0""")
def rebuilt_recursion(spark, sf):
    """Paths of 24 hours by given coefficients of rebuilt features, the calendar and a held column."""
    paths = rebuilt.rolled_out(issue_windows(spark, sf), 2.0, GIVEN, HELD)
    each = paths.select("station_id", "ts", F.posexplode("path").alias("k", "v"))
    return each.select("station_id", "ts", (F.col("k") + 1).cast("long").alias("horizon"), F.round(F.col("v") + ft.NUDGE, 4).alias("prediction"))


@query("rebuilt_recursion_fitted")
def rebuilt_recursion_fitted(spark, sf):
    """The same by a ridge fit of the next hour's level on rebuilt features, calendar and the held column, from one Gram aggregate."""
    issues = stored(issue_windows(spark, sf), "windows")
    following = grid.gap_filled(src.readings(spark, sf)).select("station_id", F.expr("ts - INTERVAL 1 HOUR").alias("ts"), F.col("water_level").alias("following"))
    now = rebuilt.rebuilt_features(issues.withColumn("path", F.array().cast("array<double>")), "path", 0)
    rows = now.join(issues.select("station_id", "ts", F.col("held")[0].alias("others")), ["station_id", "ts"]).join(following, ["station_id", "ts"])
    rows = rows.select("*", *utc_calendar("ts")).withColumn("all", F.lit(1))
    names = [*rebuilt.LEVEL_FEATURES, *rebuilt.CALENDAR, *HELD]
    fitted = {r["feature"]: r["coefficient"] for r in models.ridge(rows, ["all"], names, "following", [10.0]).collect()}  # a number for each predictor
    paths = rebuilt.rolled_out(issues, fitted.pop("intercept"), fitted, HELD)
    return paths.select("station_id", "ts", F.posexplode("path").alias("k", "prediction")).select("station_id", "ts", (F.col("k") + 1).cast("long").alias("horizon"), "prediction")


# candidates of three kinds of models whose parameters follow from the naive search; the metric is rounded, so that ties occur
def policy_candidates(spark, sf):
    s = summary(spark, sf).select("model", "subset", F.col("param"), F.round("rmse_mean", 0).alias("rmse"))
    text = lambda c: F.col(c).cast("string")
    rows = s.withColumns({"count": F.when(F.col("subset") == "all", 5).otherwise(1) * (1 + F.col("param") % 2), "p": F.col("param") % 4, "d": F.col("param") % 2, "q": (F.col("param") + F.length("model")) % 3, "even": F.col("param") % 4 == 0})
    maps = {
        "ridge": dict(subset=F.col("subset"), feature_count=text("count"), alpha=text("param"), log1p=F.when(F.col("even"), "True").otherwise("False"), model=F.col("model")),
        "arimax": dict(subset=F.col("subset"), feature_count=text("count"), p=text("p"), d=text("d"), q=text("q"), model=F.col("model")),
        "rnn": dict(subset=F.col("subset"), channel_count=text("count"), sequence_length=text("param"), hidden_size=F.when(F.col("even"), "9").otherwise("16"), num_layers=F.lit("1"), cell_type=F.col("model"), model=F.col("model")),
    }
    each = F.array(*(F.struct(F.lit(e).alias("experiment"), F.create_map(*(x for k, v in m.items() for x in (F.lit(k), v))).alias("params")) for e, m in maps.items()))
    return rows.select("model", "subset", "param", "rmse", F.explode(each).alias("c")).select("model", "subset", "param", "c.*", F.create_map(F.lit("cv_rmse_mean"), F.col("rmse")).alias("metrics"))


_POLICY = """cn AS (SELECT model, subset, param, round(rmse_mean, 0) AS rmse, CASE WHEN subset = 'all' THEN 5 ELSE 1 END * (1 + param % 2) AS c, param % 4 AS p, param % 2 AS d, (param + length(model)) % 3 AS q, param % 4 = 0 AS even FROM cs),
kx AS (SELECT *, 'ridge' AS experiment, row_number() OVER (PARTITION BY subset ORDER BY rmse, c, even, param, subset) AS place FROM cn
  UNION ALL SELECT *, 'arimax', row_number() OVER (PARTITION BY subset ORDER BY rmse, c, p + q, d, subset, p, q) FROM cn
  UNION ALL SELECT *, 'rnn', row_number() OVER (PARTITION BY subset ORDER BY rmse, c, param, CASE WHEN even THEN 9 ELSE 16 END, model, subset) FROM cn)"""


@query("policy_winners", f"WITH {CAND}, {_POLICY} SELECT experiment, subset, rmse, c AS feature_count FROM kx WHERE place = 1")
def policy_winners(spark, sf):
    """The best candidate within each subset by the policy of its model."""
    best = policies.ranked(policy_candidates(spark, sf), "rmse", ("subset",)).filter("place = 1")
    return best.select("experiment", "subset", F.col("metrics")["cv_rmse_mean"].alias("rmse"), F.coalesce(F.col("params")["feature_count"], F.col("params")["channel_count"]).cast("long").alias("feature_count"))


def level_contract(names) -> model_table.Contract:
    columns = tuple(f"{s}__{b}" for s, b in names)
    return model_table.Contract(ft.TARGET, columns, tuple(f"t{h}" for h in ft.EVERY), {"target_level": (f"{ft.TARGET}__water_level",), "full": columns, "levels": tuple(c for c in columns if c.endswith("__water_level"))}).check()


def saved_models(spark, sf):
    """Three ridge models fitted on the training cohort, saved, and loaded under the contract; and the rows that they were fitted on."""
    rows, names = rs.design(spark, sf, False)
    rows = stored(rows, "design")
    contract, p = level_contract(names), len(names)
    logged = np.array([rs.COLUMNS[b][1] for _, b in names])
    size = 1 + p + 24
    sums = {False: np.zeros((size, size)), True: np.zeros((size, size))}
    for r in rs.segment_sums(rows, [], logged).collect():  # one matrix, whatever the number of rows
        sums[r["log"]].flat[r["place"]] = r["s"]
    path = f"{shared_dir(spark)}/models-{uuid.uuid4().hex}"
    for execution, subset, alpha, log in (("level", "target_level", 1.0, False), ("levels", "levels", 10.0, True), ("full", "full", 100.0, False)):
        at = np.array([contract.feature_columns.index(c) for c in contract.subsets[subset]])
        model_table.save(spark, path, contract, execution, subset, alpha, log, logged[at].tolist(), rs.fitted(sums[log], at, p, alpha))
    columns = F.map_from_arrays(F.array(*map(F.lit, contract.feature_columns)), F.col("x"))
    return model_table.load(spark, path, contract), rows.select("ts", columns.alias("columns"))


_ONE = f"""WITH {q.ALL}, nw AS (SELECT ts, station_id FROM ft WHERE split = 'train' AND water_level IS NOT NULL AND imputed IS NOT NULL AND lag_24 IS NOT NULL AND mean_24 IS NOT NULL),
ok AS (SELECT ts FROM nw GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT station_id) FROM ft WHERE split = 'train')),
rw AS (SELECT ts, water_level AS x, unnest({q.HOURS}) AS h, unnest({q.LEVELS}) AS y FROM co JOIN ok USING (ts) WHERE station_id = 'click' AND split = 'train'),
ms AS (SELECT h, avg(x) AS mx, avg(y) AS my, covar_pop(x, y) / var_pop(x) / (1 + 1.0::DOUBLE / count(*)) AS b FROM rw GROUP BY 1)"""


@query("saved_model_scores", f"{_ONE} SELECT ts, CAST(h AS BIGINT) AS horizon, round(my + b * (x - mx) + 1e-9, 5) AS prediction FROM rw JOIN ms USING (h)")
def saved_model_scores(spark, sf):
    """Forecasts of the saved model of one predictor, whose coefficients SQL can give."""
    loaded, rows = saved_models(spark, sf)
    found = model_table.scored(loaded.filter("execution = 'level'"), rows, ["ts"])
    return found.select("ts", "horizon", F.round(F.col("prediction") + ft.NUDGE, 5).alias("prediction"))


@query("saved_models_digest")
def saved_models_digest(spark, sf):
    """Every saved model over all rows: how many forecasts, and their mean by horizon."""
    found = model_table.scored(*saved_models(spark, sf), ["ts"])
    return found.groupBy("execution", "horizon").agg(F.count("*").alias("n"), F.avg("prediction").alias("mean"))
