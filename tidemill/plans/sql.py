"""Common table expressions of the DuckDB side, written independently of the Spark plans."""


def readings(kind: str = "dense", name: str = "r") -> str:
    station = {"dense": "event_type", "sparse": "'u' || (user_id % 40)", "user": "'u' || user_id"}[kind]
    return f"""{name} AS (SELECT station_id, h AS ts, value FROM (
      SELECT {station} AS station_id, date_trunc('hour', ts) AS h, value,
             row_number() OVER (PARTITION BY {station}, date_trunc('hour', ts) ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1)"""


def frame(least: float = 0.0, gap: int = 12, source: str = "r", name: str = "f") -> str:
    """Gap-filled grid: station_id, ts, level (before filling), present, water_level, imputed."""
    return f"""{name}_g AS (SELECT station_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM (SELECT station_id, min(ts) AS lo, max(ts) AS hi FROM {source} GROUP BY 1)),
    {name}_d AS (SELECT g.station_id, g.ts, CASE WHEN q.value > {least}::DOUBLE THEN q.value END AS level, q.station_id IS NOT NULL AS present, q.value AS raw FROM {name}_g g LEFT JOIN {source} q USING (station_id, ts)),
    {name}_w AS (SELECT *, last_value(level IGNORE NULLS) OVER b AS held, max(CASE WHEN level IS NOT NULL THEN ts END) OVER b AS since, min(CASE WHEN level IS NOT NULL THEN ts END) OVER a AS nxt
      FROM {name}_d WINDOW b AS (PARTITION BY station_id ORDER BY ts ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY station_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    {name} AS (SELECT station_id, ts, level, present, raw,
      CASE WHEN level IS NOT NULL THEN level WHEN date_diff('hour', since, nxt) - 1 <= {gap} THEN held END AS water_level,
      coalesce(level IS NULL AND date_diff('hour', since, nxt) - 1 <= {gap}, false) AS imputed FROM {name}_w)"""


WEATHER = """wx AS (SELECT event_type AS station_id, date_trunc('hour', ts) AS ts, avg(value) AS precipitation,
  avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS temperature_2m FROM events WHERE event_id % 3 <> 0 GROUP BY 1, 2)"""
CATALOG = "cat AS (SELECT event_type AS station_id, avg(user_id) AS position_km FROM events GROUP BY 1)"

# the target's first floor(0.8 n) hours are for training, at one boundary for all stations
SPLIT = """bound AS (SELECT max(ts) AS b FROM (SELECT ts, row_number() OVER (ORDER BY ts) AS i, count(*) OVER () AS n FROM f WHERE station_id = 'click') WHERE i <= floor(n * 0.8::DOUBLE)),
s AS (SELECT f.station_id, f.ts, f.water_level, f.imputed, wx.precipitation, wx.temperature_2m, CASE WHEN f.ts <= b THEN 'train' ELSE 'test' END AS split
      FROM f LEFT JOIN wx USING (station_id, ts), bound)"""

BASE = f"{readings()}, {frame()}, {WEATHER}, {SPLIT}"

_W = "PARTITION BY station_id, split ORDER BY ts"
EVERY = range(1, 25)  # all horizons
HOURS, LEVELS = str([*EVERY]), "[" + ", ".join(f"t{h}" for h in EVERY) + "]"


def gated(agg: str, col: str, w: int) -> str:
    over = f"({_W} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({col}) OVER {over} = {w} THEN round({agg}({col}) OVER {over}, 6) END"


def counted(w: int) -> str:
    over = f"({_W} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(*) OVER {over} = {w} THEN CAST(sum(CAST(imputed AS INT)) OVER {over} AS DOUBLE) END"


ELIGIBLE = f"(count(CASE WHEN water_level IS NOT NULL AND NOT imputed THEN 1 END) OVER ({_W} ROWS BETWEEN 1 FOLLOWING AND 24 FOLLOWING)) = 24"

# features of every row: full contract, used by the cohort
FEATURES = f"""ft AS (SELECT *, {ELIGIBLE} AS target_valid,
  {", ".join(f"lag(water_level, {k}) OVER ({_W}) AS lag_{k}" for k in (1, 3, 6, 12, 24, 48, 72))},
  {", ".join(f"{gated('avg', 'water_level', w)} AS mean_{w}" for w in (6, 24, 72))},
  {", ".join(f"{gated('avg', 'temperature_2m', w)} AS temp_{w}" for w in (6, 24))},
  {", ".join(f"lead(water_level, {h}) OVER ({_W}) AS t{h}" for h in EVERY)} FROM s)"""
# the cohort: a valid target and a complete set of level predictors; weather is too sparse in the test tables to ask for
COHORT = """co AS (SELECT * FROM ft WHERE target_valid AND water_level IS NOT NULL AND lag_72 IS NOT NULL AND mean_72 IS NOT NULL),
tc AS (SELECT *, CAST(row_number() OVER (PARTITION BY split ORDER BY ts) - 1 AS BIGINT) AS pos, count(*) OVER (PARTITION BY split) AS n FROM co WHERE station_id = 'click')"""
# forecasts of the target: persistence and a fixed linear rule, in long form
FORECASTS = f"""pr AS (SELECT ts AS issue_ts, split, CAST(h AS BIGINT) AS horizon, actual, model, CASE model WHEN 'persistence' THEN water_level ELSE 0.6::DOUBLE * water_level + 0.3::DOUBLE * mean_24 + 0.1::DOUBLE * lag_24 END AS prediction
  FROM (SELECT ts, split, water_level, mean_24, lag_24, unnest({HOURS}) AS h, unnest({LEVELS}) AS actual FROM tc), (SELECT unnest(['persistence', 'linear']) AS model))"""
# a nudge before rounding, so that exact halves fall alike whatever the order of summation
METRICS = """CAST(count(*) AS BIGINT) AS n, round(avg(abs(prediction - actual)) + 1e-9, 6) AS mae, round(sqrt(avg(power(prediction - actual, 2))) + 1e-9, 6) AS rmse, round(avg(prediction - actual) + 1e-9, 6) AS me,
round(CASE WHEN var_pop(actual) = 0 THEN CASE WHEN sum(power(prediction - actual, 2)) = 0 THEN 1.0 ELSE 0.0 END ELSE 1 - sum(power(prediction - actual, 2)) / (count(*) * var_pop(actual)) END + 1e-9, 6) AS r2"""
ALL = f"{BASE}, {FEATURES}, {COHORT}, {FORECASTS}"
