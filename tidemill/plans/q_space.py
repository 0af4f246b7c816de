"""Registered queries: draws from search spaces, without repeats, and what was drawn of each parameter."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemill.operators import search_space as ss
from tidemill.plans.catalogue import query
from tidemill.plans.stored import table

SEED = 42
TREES = {"max_depth": ss.Integers(3, 8), "learning_rate": ss.LogUniform(0.01, 0.3), "n_estimators": ss.Integers(100, 501), "subsample": ss.Uniform(0.6, 1.0), "colsample_bytree": ss.Uniform(0.6, 1.0), "reg_lambda": ss.LogUniform(0.1, 10.0)}
LAYERS = {"layers": ["32", "64", "128", "256", "64x32", "128x64"], "depth": ss.Integers(1, 4)}
GRID = {"layers": ["32", "64", "128", "256", "64x32", "128x64"], "dropout": ["0.0", "0.1", "0.2"], "rate": ["0.001", "0.0003"]}

_OWNERS = "ow AS (SELECT DISTINCT 'u' || user_id AS station_id FROM events)"


def _u(name: str, key: str = "draw") -> str:
    return f"(CAST('0x' || substr(md5('{SEED}|' || station_id || '|' || {key} || '|{name}'), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE)"


def _value(name: str, of) -> str:
    if isinstance(of, list):
        return f"{of}[1 + CAST(floor({_u(name)} * {len(of)}) AS BIGINT)] AS {name}"
    if isinstance(of, ss.Integers):
        return f"CAST({of.low} + floor({_u(name)} * {of.high - of.low}) AS DOUBLE) AS {name}"
    if isinstance(of, ss.Uniform):
        return f"round({of.low}::DOUBLE + {_u(name)} * {of.high - of.low}::DOUBLE, 6) AS {name}"
    return f"round(exp({math.log(of.low)!r}::DOUBLE + {_u(name)} * {math.log(of.high) - math.log(of.low)!r}::DOUBLE), 6) AS {name}"


def _drawn(space, n: int) -> str:
    return f"{_OWNERS}, dn AS (SELECT station_id, draw, {', '.join(_value(k, v) for k, v in space.items())} FROM (SELECT station_id, CAST(unnest(range(0, {n})) AS BIGINT) AS draw FROM ow))"


def owners(spark, sf):
    return table(spark, sf, "events").select(F.concat(F.lit("u"), "user_id").alias("station_id")).distinct()


@query("search_draws", f"WITH {_drawn(TREES, 32)} SELECT * FROM dn")
def search_draws(spark, sf):
    """32 draws of the boosted trees' space for every station."""
    return ss.draws(owners(spark, sf), TREES, 32, SEED)


@query("unique_draws", f"WITH {_drawn(LAYERS, 16)} SELECT station_id, min(draw) AS draw, layers, depth FROM dn GROUP BY station_id, layers, depth")
def unique_draws(spark, sf):
    """Sixteen draws from eighteen points for every station, the first of equal ones."""
    return ss.first_of_equal(ss.draws(owners(spark, sf), LAYERS, 16, SEED), ["station_id"], [*LAYERS])


@query("grid_draws", f"""WITH {_OWNERS}, pt AS (SELECT station_id, CAST(unnest(range(0, 36)) AS BIGINT) AS point FROM ow),
rk AS (SELECT station_id, point, row_number() OVER (PARTITION BY station_id ORDER BY {_u('order', 'point')}, point) - 1 AS draw FROM pt)
SELECT station_id, draw, {GRID['layers']}[1 + point % 6] AS layers, {GRID['dropout']}[1 + (point // 6) % 3] AS dropout, {GRID['rate']}[1 + point // 18] AS rate FROM rk WHERE draw < 16""")
def grid_draws(spark, sf):
    """Sixteen different points of a grid of 36 for every station."""
    return ss.draws(owners(spark, sf), GRID, 16, SEED)


@query("search_space_summary", f"""WITH {_drawn(TREES, 32)} SELECT parameter, count(*) AS n, count(DISTINCT value) AS n_distinct, min(value) AS least, max(value) AS greatest, 'random_with_replacement' AS method, 'distribution_defined' AS size
FROM (SELECT unnest({[*TREES]}) AS parameter, unnest([{', '.join(TREES)}]) AS value FROM dn) GROUP BY 1""")
def search_space_summary(spark, sf):
    """What was drawn of each parameter, with the method and the size of the space."""
    method, size = ss.summary(TREES)
    long = search_draws(spark, sf).unpivot(["station_id", "draw"], [*TREES], "parameter", "value")
    return long.groupBy("parameter").agg(F.count("*").alias("n"), F.count_distinct("value").alias("n_distinct"), F.min("value").alias("least"), F.max("value").alias("greatest"), F.lit(method).alias("method"), F.lit(size).alias("size"))
