"""Registered queries: scans, ingest, grids, joins, features and folds."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.config import CHANGES, LAGS, WINDOWS
from tidemill.operators import features as ft
from tidemill.operators import grid
from tidemill.plans import sql as q
from tidemill.plans.catalogue import query
from tidemill.plans.stored import shared_dir, table
from tidemill.sources import readings as src

R, SP = q.readings(), q.readings("sparse")


@query("scan_readings", "SELECT event_id, ts, user_id, event_type, value, props FROM events")
def scan_readings(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")


@query("scan_projected", "SELECT ts, value FROM events WHERE event_type = 'click'")
def scan_projected(spark, sf):
    return table(spark, sf, "events").filter("event_type = 'click'").select("ts", "value")


@query("dedup_keep_last", f"WITH {R} SELECT * FROM r")
def dedup_keep_last(spark, sf):
    return src.readings(spark, sf)


@query("sink_roundtrip", f"WITH {q.BASE} SELECT station_id, split, count(*) AS n_rows, round(sum(water_level), 6) AS total FROM s GROUP BY 1, 2")
def sink_roundtrip(spark, sf):
    path = f"{shared_dir(spark)}/frames-{uuid.uuid4().hex}"
    frames = ft.split(ft.station_frames(spark, sf))
    frames.write.mode("overwrite").partitionBy("split").parquet(path)
    return spark.read.parquet(path).groupBy("station_id", "split").agg(F.count("*").alias("n_rows"), F.round(F.sum("water_level"), 6).alias("total"))


@query("json_history_rows", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events")
def json_history_rows(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("double").alias("k"))


@query("landed_history", "SELECT event_type AS station_id, date_trunc('second', ts) AS source_ts, round(value, 3) AS value FROM events WHERE value IS NOT NULL")
def landed_history(spark, sf):
    """Histories landed as JSON, in bounded bodies of a station and hour, and read back as rows."""
    bodies = src.landed_bodies(table(spark, sf, "events").filter("value is not null"))
    return src.history_rows(bodies).select("station_id", F.col("source_ts").cast("timestamp_ntz").alias("source_ts"), "value")


@query("backfill_chunks", f"""WITH {R}, b AS (SELECT station_id, min(ts) AS lo, max(ts) AS hi FROM r GROUP BY 1),
c AS (SELECT station_id, hi, unnest(generate_series(lo, hi, INTERVAL 192 HOURS)) AS start FROM b)
SELECT station_id, start, least(start + INTERVAL 191 HOURS, hi) AS "end" FROM c""")
def backfill_chunks(spark, sf):
    ranges = src.readings(spark, sf).groupBy("station_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    return src.chunks(ranges)


@query("archive_start", "SELECT event_type AS station_id, min(ts) AS first_ts FROM events GROUP BY 1")
def archive_start(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("station_id")).agg(F.min("ts").alias("first_ts"))


@query("incremental_new_keys", f"WITH {SP} SELECT station_id, ts, value FROM r WHERE ts >= TIMESTAMP '2024-01-20'")
def incremental_new_keys(spark, sf):
    """Readings that an earlier load, of everything before 20 January, doesn't have."""
    now = src.readings(spark, sf, "sparse")
    return now.join(now.filter("ts < timestamp_ntz '2024-01-20'").select("station_id", "ts"), ["station_id", "ts"], "left_anti")


@query("frame_profile", f"WITH {q.readings('sparse')}, {q.frame()} SELECT count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts, count(*) - count(station_id) AS null_station_id, count(*) - count(water_level) AS null_water_level FROM f")
def frame_profile(spark, sf):
    return src.profile(grid.gap_filled(src.readings(spark, sf, "sparse")), "ts", ["station_id", "water_level"]).drop("digest")


@query("source_inventory", f"WITH {R}, {q.WEATHER} SELECT 'level' AS role, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts FROM r UNION ALL SELECT 'weather', count(*), min(ts), max(ts) FROM wx")
def source_inventory(spark, sf):
    one = lambda role, df: df.agg(F.count("*").alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).select(F.lit(role).alias("role"), "*")
    return one("level", src.readings(spark, sf)).union(one("weather", src.weather(spark, sf)))


@query("quarantine_summary", "SELECT event_type AS station_id, count(*) AS n_rows, CAST(count(CASE WHEN value IS NULL OR value <= 0.5::DOUBLE THEN 1 END) AS BIGINT) AS n_bad FROM events GROUP BY 1")
def quarantine_summary(spark, sf):
    """Rows that fail a check are set apart with the reason; the summary per station."""
    marked = table(spark, sf, "events").withColumn("reason", F.when(F.col("value").isNull(), "missing").when(F.col("value") <= 0.5, "too low"))
    return marked.groupBy(F.col("event_type").alias("station_id")).agg(F.count("*").alias("n_rows"), F.count("reason").alias("n_bad"))


@query("numeric_cast", "SELECT event_id, CAST(user_id AS DOUBLE) AS user_value, CAST(CASE WHEN value > 5 THEN 1 ELSE 0 END AS DOUBLE) AS high FROM events")
def numeric_cast(spark, sf):
    return table(spark, sf, "events").select("event_id", F.col("user_id").cast("double").alias("user_value"), (F.coalesce(F.col("value") > 5, F.lit(False))).cast("double").alias("high"))


@query("mask_invalid", f"WITH {R} SELECT station_id, ts, CASE WHEN value > 2.0::DOUBLE THEN value END AS value FROM r")
def mask_invalid(spark, sf):
    return grid.masked(src.readings(spark, sf), 2.0)


@query("range_filter", f"WITH {R} SELECT * FROM r WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-07 00:00:00'")
def range_filter(spark, sf):
    return src.readings(spark, sf).filter("ts between timestamp_ntz '2024-01-05 00:00:00' and timestamp_ntz '2024-01-07 00:00:00'")


@query("hourly_grid", f"WITH {SP}, {q.frame(-1e300)} SELECT station_id, ts, raw AS value, present FROM f")
def hourly_grid(spark, sf):
    return grid.hourly_grid(src.readings(spark, sf, "sparse"))


@query("gap_fill", f"WITH {SP}, {q.frame(2.0)} SELECT station_id, ts, water_level, imputed FROM f")
def gap_fill(spark, sf):
    return grid.gap_filled(src.readings(spark, sf, "sparse"), least=2.0)


@query("gap_fill_users", f"WITH {q.readings('user')}, {q.frame()} SELECT station_id, count(*) AS hours, CAST(sum(CAST(imputed AS INT)) AS BIGINT) AS n_imputed, round(sum(water_level), 4) AS total FROM f GROUP BY 1")
def gap_fill_users(spark, sf):
    """The gap rule over one series per user: the variant that grows with the tables."""
    filled = grid.gap_filled(src.readings(spark, sf, "user"))
    return filled.groupBy("station_id").agg(F.count("*").alias("hours"), F.sum(F.col("imputed").cast("int")).alias("n_imputed"), F.round(F.sum("water_level"), 4).alias("total"))


@query("grid_contract", f"WITH {SP}, {q.frame()} SELECT station_id, count(*) AS n_rows, count(DISTINCT ts) AS n_hours, date_diff('hour', min(ts), max(ts)) + 1 AS span_hours, bool_and(ts = date_trunc('hour', ts)) AS whole_hours, count(*) = date_diff('hour', min(ts), max(ts)) + 1 AS ok FROM f GROUP BY 1")
def grid_contract(spark, sf):
    return grid.grid_contract(grid.gap_filled(src.readings(spark, sf, "sparse")))


@query("observed_only", f"WITH {SP}, {q.frame(2.0)} SELECT station_id, ts, CASE WHEN NOT imputed THEN water_level END AS observed FROM f")
def observed_only(spark, sf):
    return grid.gap_filled(src.readings(spark, sf, "sparse"), least=2.0).select("station_id", "ts", F.when(~F.col("imputed"), F.col("water_level")).alias("observed"))


@query("raw_processed_audit", f"WITH {SP}, {q.frame(2.0)} SELECT station_id, CAST(count(CASE WHEN r.value > 2 THEN 1 END) AS BIGINT) AS n_raw, CAST(count(CASE WHEN r.value > 2 AND f.water_level <> r.value THEN 1 END) AS BIGINT) AS n_altered, CAST(count(CASE WHEN r.value > 2 AND imputed THEN 1 END) AS BIGINT) AS n_flagged FROM r LEFT JOIN f USING (station_id, ts) GROUP BY 1")
def raw_processed_audit(spark, sf):
    raw = src.readings(spark, sf, "sparse")
    both = raw.join(grid.gap_filled(raw, least=2.0), ["station_id", "ts"], "left")
    valid = F.col("value") > 2
    return both.groupBy("station_id").agg(F.count_if(valid).alias("n_raw"), F.count_if(valid & (F.col("water_level") != F.col("value"))).alias("n_altered"), F.count_if(valid & F.col("imputed")).alias("n_flagged"))


@query("gap_runs", f"""WITH {SP}, {q.frame(2.0)}, m AS (SELECT station_id, ts, present, level IS NULL AS missing, row_number() OVER (PARTITION BY station_id ORDER BY ts) - row_number() OVER (PARTITION BY station_id, level IS NULL ORDER BY ts) AS k FROM f),
e AS (SELECT station_id, min(ts) AS lo, max(ts) AS hi FROM f GROUP BY 1),
g AS (SELECT station_id, k, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS hours, CASE WHEN bool_and(NOT present) THEN 'row absent' WHEN bool_and(present) THEN 'value missing' ELSE 'mixed' END AS reason FROM m WHERE missing GROUP BY 1, 2)
SELECT station_id, start_ts, end_ts, hours, reason, CASE WHEN start_ts = lo THEN 'leading' WHEN end_ts = hi THEN 'trailing' ELSE 'internal' END AS place FROM g JOIN e USING (station_id)""")
def gap_runs(spark, sf):
    """Runs of missing levels with their place in the series and why they are missing."""
    g = grid.masked(grid.hourly_grid(src.readings(spark, sf, "sparse")), 2.0).withColumn("missing", F.col("value").isNull())
    all_ = Window.partitionBy("station_id")
    w = all_.orderBy("ts")
    g = g.withColumns({"lo": F.min("ts").over(all_), "hi": F.max("ts").over(all_), "run": F.row_number().over(w) - F.row_number().over(Window.partitionBy("station_id", "missing").orderBy("ts"))})
    out = g.filter("missing").groupBy("station_id", "run", "lo", "hi").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.count("*").alias("hours"), F.bool_or("present").alias("some"), F.bool_and("present").alias("every"))
    reason = F.when(~F.col("some"), "row absent").when(F.col("every"), "value missing").otherwise("mixed")
    place = F.when(F.col("start_ts") == F.col("lo"), "leading").when(F.col("end_ts") == F.col("hi"), "trailing").otherwise("internal")
    return out.select("station_id", "start_ts", "end_ts", "hours", reason.alias("reason"), place.alias("place"))


@query("weather_gap_runs", f"""WITH {q.BASE}, m AS (SELECT station_id, ts, precipitation, row_number() OVER (PARTITION BY station_id ORDER BY ts) - row_number() OVER (PARTITION BY station_id, precipitation IS NULL ORDER BY ts) AS k FROM s)
SELECT station_id, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS hours FROM m WHERE precipitation IS NULL GROUP BY station_id, k""")
def weather_gap_runs(spark, sf):
    """Runs of hours without weather."""
    w = ft.station_frames(spark, sf).withColumn("missing", F.col("precipitation").isNull())
    return grid.runs(w, "missing", ["station_id"]).filter("missing").drop("missing")


@query("longest_observed_run", f"""WITH {SP}, {q.frame(2.0)}, m AS (SELECT station_id, ts, row_number() OVER (PARTITION BY station_id ORDER BY ts) - row_number() OVER (PARTITION BY station_id, level IS NULL ORDER BY ts) AS k, level FROM f),
g AS (SELECT station_id, k, min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS hours FROM m WHERE level IS NOT NULL GROUP BY 1, 2)
SELECT station_id, start_ts, end_ts, hours FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY hours DESC, start_ts) AS i FROM g) WHERE i = 1""")
def longest_observed_run(spark, sf):
    g = grid.masked(grid.hourly_grid(src.readings(spark, sf, "sparse")), 2.0).withColumn("observed", F.col("value").isNotNull())
    found = grid.runs(g, "observed", ["station_id"]).filter("observed").drop("observed")
    return src.latest_first(found, ["station_id"], [F.desc("hours"), "start_ts"])


@query("training_history", f"""WITH {SP}, {q.frame(2.0)}, lo AS (SELECT station_id, min(ts) AS first_ts FROM f WHERE level IS NOT NULL GROUP BY 1)
SELECT station_id, ts, water_level FROM f JOIN lo USING (station_id) WHERE ts BETWEEN first_ts AND TIMESTAMP '2024-01-20 00:00:00'""")
def training_history(spark, sf):
    """Each history from its first level on, cut at 20 January."""
    g = grid.gap_filled(src.readings(spark, sf, "sparse"), least=2.0)
    first = F.min(F.when(F.col("water_level").isNotNull(), F.col("ts"))).over(Window.partitionBy("station_id"))
    return g.withColumn("first_ts", first).filter("ts between first_ts and timestamp_ntz '2024-01-20 00:00:00'").select("station_id", "ts", "water_level")


@query("weather_left_join", f"WITH {R}, {q.frame()}, {q.WEATHER} SELECT station_id, ts, water_level, round(precipitation, 6) AS precipitation, round(temperature_2m, 6) AS temperature_2m FROM f LEFT JOIN wx USING (station_id, ts)")
def weather_left_join(spark, sf):
    return ft.station_frames(spark, sf).select("station_id", "ts", "water_level", F.round("precipitation", 6).alias("precipitation"), F.round("temperature_2m", 6).alias("temperature_2m"))


TYPES = ("click", "error", "purchase", "signup", "view")


@query("wide_station_join", f"WITH {R}, {q.frame()}, t AS (SELECT ts FROM f WHERE station_id = 'click') SELECT ts, " + ", ".join(f"max(CASE WHEN station_id = '{s}' THEN water_level END) AS {s}__water_level" for s in TYPES) + " FROM f JOIN t USING (ts) GROUP BY 1")
def wide_station_join(spark, sf):
    """One row for each of the target's hours, a column for each station; the pivot values are given, so no extra job."""
    f = grid.gap_filled(src.readings(spark, sf))
    hours = f.filter("station_id = 'click'").select("ts")
    wide = f.join(hours, "ts", "left_semi").groupBy("ts").pivot("station_id", list(TYPES)).agg(F.max("water_level"))
    return wide.select("ts", *(F.col(s).alias(f"{s}__water_level") for s in TYPES))


@query("extract_station", f"WITH {R}, {q.frame()} SELECT ts, water_level, imputed FROM f WHERE station_id = 'view' AND ts IS NOT NULL")
def extract_station(spark, sf):
    return grid.gap_filled(src.readings(spark, sf).filter("station_id = 'view'")).select("ts", "water_level", "imputed")


@query("station_order", f"WITH {q.CATALOG}, t AS (SELECT position_km AS p FROM cat WHERE station_id = 'click') SELECT station_id, round(abs(position_km - p), 6) AS distance_km, row_number() OVER (ORDER BY station_id <> 'click', round(abs(position_km - p), 6), station_id) AS place FROM cat, t")
def station_order(spark, sf):
    """The target first, then by distance along the river. The catalog has one row a station."""
    c = src.catalog(spark, sf)
    target = c.filter("station_id = 'click'").select(F.col("position_km").alias("p"))
    d = c.crossJoin(F.broadcast(target)).select("station_id", F.round(F.abs(F.col("position_km") - F.col("p")), 6).alias("distance_km"))
    return d.withColumn("place", F.row_number().over(Window.orderBy(F.col("station_id") != "click", "distance_km", "station_id")).cast("long"))


@query("range_overlap_filter", f"""WITH {SP}, p AS (SELECT station_id, min(ts) AS lo, max(ts) AS hi FROM r GROUP BY 1), t AS (SELECT lo AS tlo, hi AS thi FROM p WHERE station_id = 'u0'),
o AS (SELECT station_id, greatest(0, date_diff('hour', greatest(lo, tlo), least(hi, thi)) + 1) AS overlap_hours, date_diff('hour', tlo, thi) + 1 AS target_hours FROM p, t)
SELECT station_id, overlap_hours, station_id = 'u0' OR (overlap_hours > 0 AND overlap_hours >= 0.9::DOUBLE * target_hours) AS retained FROM o""")
def range_overlap_filter(spark, sf):
    spans = src.readings(spark, sf, "sparse").groupBy("station_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    target = spans.filter("station_id = 'u0'").select(F.col("lo").alias("tlo"), F.col("hi").alias("thi"))
    both = spans.crossJoin(F.broadcast(target))
    overlap = F.greatest(F.lit(0).cast("long"), grid.hours_between(F.greatest("lo", "tlo"), F.least("hi", "thi")) + 1)
    out = both.withColumns({"overlap_hours": overlap, "target_hours": grid.hours_between(F.col("tlo"), F.col("thi")) + 1})
    return out.select("station_id", "overlap_hours", ((F.col("station_id") == "u0") | ((F.col("overlap_hours") > 0) & (F.col("overlap_hours") >= 0.9 * F.col("target_hours")))).alias("retained"))


@query("excluded_stations", f"WITH {SP} SELECT DISTINCT 'u' || (c_custkey % 45) AS station_id FROM customer WHERE 'u' || (c_custkey % 45) NOT IN (SELECT station_id FROM r)")
def excluded_stations(spark, sf):
    """Configured stations without a reading."""
    configured = table(spark, sf, "customer").select(F.concat(F.lit("u"), (F.col("c_custkey") % 45).cast("string")).alias("station_id")).distinct()
    return configured.join(src.readings(spark, sf, "sparse").select("station_id"), "station_id", "left_anti")


@query("duplicate_keys", "SELECT event_type AS station_id, date_trunc('hour', ts) AS ts, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("station_id"), src.hour(F.col("ts")).alias("ts")).agg(F.count("*").alias("n")).filter("n > 1")


@query("catalog_lookup", f"WITH {q.CATALOG} SELECT station_id, round(position_km, 6) AS position_km FROM cat WHERE lower(station_id) = lower('CLICK')")
def catalog_lookup(spark, sf):
    return src.catalog(spark, sf).filter(F.lower("station_id") == "click").select("station_id", F.round("position_km", 6).alias("position_km"))


@query("single_grid_point", f"WITH {q.WEATHER} SELECT station_id, count(DISTINCT station_id) = 1 AS single FROM wx GROUP BY 1")
def single_grid_point(spark, sf):
    return src.weather(spark, sf).groupBy("station_id").agg((F.count_distinct(F.struct("station_id")) == 1).alias("single"))


@query("chrono_split", f"WITH {q.BASE} SELECT station_id, split, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY 1, 2")
def chrono_split(spark, sf):
    return ft.split(ft.station_frames(spark, sf)).groupBy("station_id", "split").agg(F.count("*").alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("split_contract", f"WITH {q.BASE} SELECT station_id, max(CASE WHEN split = 'train' THEN ts END) < min(CASE WHEN split = 'test' THEN ts END) AS ordered, count(*) = count(DISTINCT ts) AS whole FROM s GROUP BY 1")
def split_contract(spark, sf):
    s = ft.split(ft.station_frames(spark, sf))
    return s.groupBy("station_id").agg((F.max(F.when(F.col("split") == "train", F.col("ts"))) < F.min(F.when(F.col("split") == "test", F.col("ts")))).alias("ordered"), (F.count("*") == F.count_distinct("ts")).alias("whole"))


@query("preserves_source", f"WITH {q.BASE}, a AS (SELECT station_id, ts, water_level FROM f), b AS (SELECT station_id, ts, water_level FROM s) SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS lost, (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS added")
def preserves_source(spark, sf):
    a = grid.gap_filled(src.readings(spark, sf))
    b = ft.split(ft.station_frames(spark, sf)).select("station_id", "ts", "water_level")
    a = a.select(*b.columns)
    return a.exceptAll(b).agg(F.count("*").alias("lost")).crossJoin(b.exceptAll(a).agg(F.count("*").alias("added")))


@query("context_series", f"WITH {q.BASE}, u AS (SELECT ts, water_level, imputed, 0 AS o FROM s WHERE station_id = 'click' AND split = 'train' UNION ALL SELECT ts, water_level, imputed, 1 FROM s WHERE station_id = 'click') SELECT ts, water_level, imputed FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY o DESC) AS i FROM u) WHERE i = 1")
def context_series(spark, sf):
    """Both partitions of the target as one series; of overlapping hours the later partition's row stays."""
    s = ft.split(ft.station_frames(spark, sf)).filter("station_id = 'click'")
    both = s.filter("split = 'train'").select("ts", "water_level", "imputed", F.lit(0).alias("o")).union(s.select("ts", "water_level", "imputed", F.lit(1)))
    return src.keep_last(both, ["ts"], ["o"]).drop("o")


@query("history_views", f"WITH {q.BASE} SELECT split, count(*) AS n_rows, CAST(count(CASE WHEN imputed THEN 1 END) AS BIGINT) AS n_imputed FROM s WHERE station_id = 'click' GROUP BY 1")
def history_views(spark, sf):
    return ft.split(ft.station_frames(spark, sf)).filter("station_id = 'click'").groupBy("split").agg(F.count("*").alias("n_rows"), F.count_if("imputed").alias("n_imputed"))


_W = "(PARTITION BY station_id, split ORDER BY ts)"


def _series(spark, sf, columns: dict):
    return ft.split(ft.station_frames(spark, sf)).select("station_id", "ts", *(c.alias(n) for n, c in columns.items()))


@query("lag_features", f"WITH {q.BASE} SELECT station_id, ts, " + ", ".join(f"lag(water_level, {k}) OVER {_W} AS lag_{k}" for k in LAGS) + " FROM s")
def lag_features(spark, sf):
    return _series(spark, sf, {f"lag_{k}": ft.lag(k) for k in LAGS})


@query("change_features", f"WITH {q.BASE} SELECT station_id, ts, " + ", ".join(f"round(water_level - lag(water_level, {k}) OVER {_W}, 6) AS change_{k}" for k in CHANGES) + " FROM s")
def change_features(spark, sf):
    return _series(spark, sf, {f"change_{k}": F.round(F.col("water_level") - ft.lag(k), 6) for k in CHANGES})


@query("rolling_level", f"WITH {q.BASE} SELECT station_id, ts, " + ", ".join(f"{q.gated(a, 'water_level', w)} AS {n}_{w}" for w in WINDOWS for n, a in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))) + " FROM s")
def rolling_level(spark, sf):
    return _series(spark, sf, {f"{n}_{w}": ft.complete(a, "water_level", w) for w in WINDOWS for n, a in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))})


@query("imputed_count", f"WITH {q.BASE} SELECT station_id, ts, " + ", ".join(f"{q.counted(w)} AS imputed_count_{w}" for w in WINDOWS) + " FROM s")
def imputed_count(spark, sf):
    return _series(spark, sf, {f"imputed_count_{w}": ft.imputed_count(w) for w in WINDOWS})


@query("rolling_precip", f"WITH {q.BASE} SELECT station_id, ts, " + ", ".join(f"{q.gated('sum', 'precipitation', w)} AS precipitation_{w}" for w in WINDOWS) + " FROM s")
def rolling_precip(spark, sf):
    return _series(spark, sf, {f"precipitation_{w}": ft.complete(F.sum, "precipitation", w) for w in WINDOWS})


@query("rolling_temp", f"WITH {q.BASE} SELECT station_id, ts, " + ", ".join(f"{q.gated('avg', 'temperature_2m', w)} AS temperature_mean_{w}" for w in WINDOWS) + f", {q.gated('min', 'temperature_2m', 24)} AS temperature_min_24, {q.gated('max', 'temperature_2m', 24)} AS temperature_max_24 FROM s")
def rolling_temp(spark, sf):
    return _series(spark, sf, {f"temperature_mean_{w}": ft.complete(F.avg, "temperature_2m", w) for w in WINDOWS} | {"temperature_min_24": ft.complete(F.min, "temperature_2m", 24), "temperature_max_24": ft.complete(F.max, "temperature_2m", 24)})


@query("target_eligibility", f"WITH {q.BASE} SELECT station_id, ts, {q.ELIGIBLE} AS target_valid FROM s")
def target_eligibility(spark, sf):
    return _series(spark, sf, {"target_valid": ft.eligible()})


@query("forward_targets", f"WITH {q.BASE}, e AS (SELECT *, {q.ELIGIBLE} AS ok FROM s) SELECT station_id, ts, " + ", ".join(f"CASE WHEN ok THEN lead(water_level, {h}) OVER {_W} END AS target_t_plus_{h:02d}" for h in range(1, 25)) + " FROM e")
def forward_targets(spark, sf):
    return _series(spark, sf, ft.forward_targets())


@query("sequence_windows", f"WITH {q.BASE}, l AS (SELECT station_id, ts, list(water_level) OVER (PARTITION BY station_id, split ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS w, count(water_level) OVER (PARTITION BY station_id, split ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS n FROM s) SELECT station_id, ts, w[1] AS first_level, w[6] AS last_level, round(list_sum(w), 6) AS total FROM l WHERE n = 6")
def sequence_windows(spark, sf):
    """Complete sequences of six hours, as arrays; no window crosses the split."""
    six = ft.own().rowsBetween(-5, 0)
    rows = _series(spark, sf, {"w": F.collect_list("water_level").over(six)}).filter(F.size("w") == 6)
    return rows.select("station_id", "ts", F.col("w")[0].alias("first_level"), F.col("w")[5].alias("last_level"), F.round(F.aggregate("w", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("issue_windows", f"WITH {q.BASE} SELECT station_id, ts, CAST(count(water_level) OVER (PARTITION BY station_id, split ORDER BY ts ROWS BETWEEN 72 PRECEDING AND CURRENT ROW) AS BIGINT) AS n_levels FROM s")
def issue_windows(spark, sf):
    return _series(spark, sf, {"n_levels": F.size(F.collect_list("water_level").over(ft.own().rowsBetween(-72, 0))).cast("long")})


@query("calendar_features", f"""WITH {R} SELECT DISTINCT ts, round(sin(2 * pi() * hour(ts) / 24), 6) AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) AS hour_cos, round(sin(2 * pi() * (isodow(ts) - 1) / 7), 6) AS weekday_sin, round(cos(2 * pi() * (isodow(ts) - 1) / 7), 6) AS weekday_cos,
round(sin(2 * pi() * (dayofyear(ts) - 1) / dayofyear(make_date(year(ts), 12, 31))), 6) AS year_sin, round(cos(2 * pi() * (dayofyear(ts) - 1) / dayofyear(make_date(year(ts), 12, 31))), 6) AS year_cos FROM r""")
def calendar_features(spark, sf):
    from tidemill.functions.calendar import utc_calendar

    return src.readings(spark, sf).select("ts").distinct().select("ts", *utc_calendar("ts"))


@query("log1p_roundtrip", f"WITH {R}, {q.frame()} SELECT station_id, ts, round(ln(1 + water_level), 6) AS logged, round(exp(ln(1 + water_level)) - 1, 6) AS back FROM f WHERE water_level > 0")
def log1p_roundtrip(spark, sf):
    return grid.gap_filled(src.readings(spark, sf)).filter("water_level > 0").select("station_id", "ts", F.round(F.log1p("water_level"), 6).alias("logged"), F.round(F.expm1(F.log1p("water_level")), 6).alias("back"))


@query("utc_text", f"WITH {R} SELECT station_id, strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') AS first_text FROM r GROUP BY 1")
def utc_text(spark, sf):
    return src.readings(spark, sf).groupBy("station_id").agg(F.date_format(F.min("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("first_text"))


@query("json_props", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS again FROM events")
def json_props(spark, sf):
    p = F.from_json("props", "k bigint")
    return table(spark, sf, "events").select("event_id", p["k"].alias("k"), F.to_json(F.struct(p["k"].alias("k"))).alias("again"))


@query("attach_features", f"WITH {q.BASE}, t AS (SELECT ts, {q.gated('avg', 'water_level', 24)} AS mean_24 FROM s WHERE station_id = 'view') SELECT s.ts, s.water_level, t.mean_24 AS view__mean_24 FROM s LEFT JOIN t USING (ts) WHERE s.station_id = 'click'")
def attach_features(spark, sf):
    s = ft.split(ft.station_frames(spark, sf))
    own = s.filter("station_id = 'view'").select("ts", ft.complete(F.avg, "water_level", 24).alias("view__mean_24"))
    return s.filter("station_id = 'click'").select("ts", "water_level").join(own, "ts", "left")


@query("cohort_rows", f"WITH {q.ALL} SELECT station_id, ts, split, water_level, lag_72, mean_72 FROM co")
def cohort_rows(spark, sf):
    return ft.cohort(ft.featured(spark, sf)).select("station_id", "ts", "split", "water_level", "lag_72", "mean_72")


_FOLDS = """fd AS (SELECT n, unnest(range(0, 5)) AS fold, (n - CAST(floor(n * 0.5::DOUBLE) AS BIGINT) - 24) // 5 AS size FROM (SELECT DISTINCT n FROM tc WHERE split = 'train')),
fb AS (SELECT CAST(fold AS BIGINT) AS fold, n - (5 - fold) * size - 24 AS train_end, n - (5 - fold) * size AS val_start, n - (4 - fold) * size AS val_end FROM fd)"""


def folds(spark, sf):
    rows = ft.target_cohort(ft.featured(spark, sf)).filter("split = 'train'")
    return rows, rows.agg(F.max("n").alias("n")).select(F.explode(ft.fold_bounds(F.col("n"))).alias("f")).select("f.*")


@query("cv_folds", f"WITH {q.ALL}, {_FOLDS} SELECT * FROM fb")
def cv_folds(spark, sf):
    return folds(spark, sf)[1]


@query("fold_windows", f"""WITH {q.ALL}, {_FOLDS}, x AS (SELECT fold, CASE WHEN pos < train_end THEN 'train' ELSE 'validation' END AS role, ts, pos FROM tc, fb WHERE split = 'train' AND (pos < train_end OR (pos >= val_start AND pos < val_end)))
SELECT fold, role, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts, min(pos) AS first_pos, max(pos) AS last_pos FROM x GROUP BY 1, 2""")
def fold_windows(spark, sf):
    """What each fold trains and validates on; the five fold rows meet the cohort in a broadcast range join."""
    rows, bounds = folds(spark, sf)
    x = rows.join(F.broadcast(bounds), (F.col("pos") < F.col("train_end")) | F.col("pos").between(F.col("val_start"), F.col("val_end") - 1))
    role = F.when(F.col("pos") < F.col("train_end"), "train").otherwise("validation")
    return x.groupBy("fold", role.alias("role")).agg(F.count("*").alias("n_rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))
