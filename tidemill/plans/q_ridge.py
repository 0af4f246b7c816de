"""Registered queries: the ridge search over subsets, penalties, transforms and folds, and the sums that it rests on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidemill.operators import ridge_search as rs
from tidemill.plans import sql as q
from tidemill.plans.catalogue import query
from tidemill.plans.q_full import _LONG
from tidemill.plans.stored import stored

_DESIGN = (f"""WITH {q.BASE}, {q.FEATURES}, {q.COHORT}, {_LONG.replace("FROM ft WHERE ts IN (SELECT ts FROM ft WHERE station_id = 'click')", "FROM ft WHERE split = 'train' AND ts IN (SELECT ts FROM co WHERE station_id = 'click')")},
ok AS (SELECT ts FROM lw GROUP BY 1 HAVING count(value) = 7 * (SELECT count(DISTINCT station_id) FROM ft)),
dn AS (SELECT ts, t1, t24, row_number() OVER (ORDER BY ts) - 1 AS pos, count(*) OVER () AS n FROM co JOIN ok USING (ts) WHERE station_id = 'click')""")


@query("ridge_design_sums", f"""{_DESIGN} SELECT station_id || '__' || base AS feature, count(*) AS n, round(sum(value) + 1e-9, 3) AS sx, round(sum(value * value) + 1e-9, 3) AS sxx, round(sum(value * t1) + 1e-9, 3) AS sxy1, round(sum(value * t24) + 1e-9, 3) AS sxy24
FROM lw JOIN dn USING (ts) GROUP BY 1""")
def ridge_design_sums(spark, sf):
    """From the matrices of sums: each predictor's sums, and those with the first and the last horizon."""
    rows, names = rs.design(spark, sf, True)
    logged = np.array([rs.COLUMNS[b][1] for _, b in names])
    p, size = len(names), 1 + len(names) + 24
    sums = rs.segment_sums(rows, [], logged).filter("not log").withColumns({"i": F.expr(f"place div {size}"), "j": F.col("place") % size})
    value = lambda c: F.sum(F.when(c, F.col("s")))
    i, j = F.col("i"), F.col("j")
    own = sums.filter(f"j between 1 and {p}").groupBy("j").agg(value(i == 0).alias("sx"), value(i == j).alias("sxx"), value(i == 1 + p).alias("sxy1"), value(i == p + 24).alias("sxy24"))
    n = sums.filter("place = 0").select(F.col("s").cast("long").alias("n"))
    feature = F.array(*(F.lit(f"{s}__{b}") for s, b in names))[(F.col("j") - 1).cast("int")]
    return own.crossJoin(F.broadcast(n)).select(feature.alias("feature"), "n", *(F.round(F.col(c) + 1e-9, 3).alias(c) for c in ("sx", "sxx", "sxy1", "sxy24")))


@query("ridge_search")
def ridge_search(spark, sf):
    """Mean and population deviation over the folds of each candidate: six subsets, five penalties, with and without log1p."""
    scores = rs.search(spark, sf, lambda rows: stored(rows, "design"))
    means = [F.count("*").alias("folds"), *(x for c in ("mae", "rmse") for x in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std")))]
    return scores.groupBy("subset", "alpha", "log1p").agg(*means)
