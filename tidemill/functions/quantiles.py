"""Exact quantiles and ranks of groups of any size, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemill.plans.stored import small_side, stored

BINS, LIMIT = 1024, 50_000  # intervals of a pass; values of one interval that a task may sort


def exact_quantiles(rows: DataFrame, keys: list[str], column: str, shares: list[float], bins: int = BINS, limit: int = LIMIT) -> DataFrame:
    """``(keys, share, n, value)``: quantiles with linear interpolation between the two nearest ranks, over values that are not null or
    NaN.

    Distributed selection: each pass counts the values of the open intervals in ``bins`` equal parts and goes on with the part
    that holds a wanted rank, between its least and greatest value. What moves are counts, never values, until an interval
    has at most ``limit`` of them (or one value, repeated), which one task sorts. A pass shrinks an interval to a ``bins``-th,
    so doubles take few passes whatever their distribution.
    """
    v = stored(rows.select(*keys, F.col(column).cast("double").alias("v")).filter("v is not null and not isnan(v)"), "quantile-rows")
    held = stored(v.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "quantile-ends")
    at = lambda s: (F.col("n") - 1) * F.lit(float(s))
    wanted = held.select(*keys, "n", "lo", "hi", F.explode(F.array(*(F.struct(F.lit(float(s)).alias("share"), F.floor(at(s)).alias("rank"), (at(s) - F.floor(at(s))).alias("part")) for s in shares))).alias("w")).select(*keys, "n", "lo", "hi", "w.*")
    ranks = wanted.select(*keys, "n", "lo", "hi", F.explode(F.array(F.col("rank"), F.least(F.col("rank") + 1, F.col("n") - 1))).alias("rank")).distinct()
    # an open rank: where its value lies, how many values lie below that interval and how many inside
    open_ = stored(ranks.select(*keys, "rank", "lo", "hi", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside")), "quantile-ranks")
    wide = (F.col("inside") > limit) & (F.col("lo") < F.col("hi"))
    while not open_.filter(wide).isEmpty():
        ends = stored(open_.filter(wide).select(*keys, "lo", "hi").distinct(), "quantile-intervals")
        inside = _inside(v, ends, keys)
        # halves first, so that the width of the widest interval is finite
        step = F.col("hi") / bins - F.col("lo") / bins
        place = F.when(step > 0, F.least(F.floor(F.col("v") / step - F.col("lo") / step), F.lit(bins - 1))).otherwise(F.when(F.col("v") > F.col("lo"), bins - 1).otherwise(0))
        parts = inside.groupBy(*keys, "lo", "hi", F.greatest(place, F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        before = F.sum("c").over(Window.partitionBy(*keys, "lo", "hi").orderBy("bin")) - F.col("c")
        parts = parts.withColumn("before", before)
        moved = open_.filter(wide).join(parts, [*keys, "lo", "hi"]).filter("rank - below >= before and rank - below < before + c")
        moved = moved.select(*keys, "rank", F.col("least").alias("lo"), F.col("most").alias("hi"), (F.col("below") + F.col("before")).alias("below"), F.col("c").alias("inside"))
        open_ = stored(open_.filter(~wide).unionByName(moved), "quantile-ranks")
    narrow = open_.filter("lo < hi")
    values = _inside(v, stored(narrow.select(*keys, "lo", "hi").distinct(), "quantile-intervals"), keys).groupBy(*keys, "lo", "hi").agg(F.sort_array(F.collect_list("v")).alias("all"))
    found = narrow.join(values, [*keys, "lo", "hi"]).select(*keys, "rank", F.get("all", (F.col("rank") - F.col("below")).cast("int")).alias("v"))
    found = stored(open_.filter("lo >= hi").select(*keys, "rank", F.col("lo").alias("v")).unionByName(found), "quantile-values")
    low, high = found.withColumnRenamed("v", "low"), found.select(*keys, F.col("rank").alias("next"), F.col("v").alias("high"))
    both = wanted.drop("lo", "hi").withColumn("next", F.least(F.col("rank") + 1, F.col("n") - 1)).join(low, [*keys, "rank"]).join(high, [*keys, "next"])
    return both.select(*keys, "share", "n", (F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).alias("value"))


def _inside(v: DataFrame, ends: DataFrame, keys: list[str]) -> DataFrame:
    """The values that lie in any interval of ``ends`` (a written table of a few rows for each key), with that interval."""
    side = small_side(ends, 64)
    joined = v.join(side, keys) if keys else v.crossJoin(F.broadcast(ends))  # without keys there are as many intervals as ranks
    return joined.filter("v >= lo and v <= hi")


def quantiles_wide(rows: DataFrame, keys: list[str], column: str, names: dict[str, float], **options) -> DataFrame:
    """One row for each key: a column for each named share, and ``n``."""
    found = exact_quantiles(rows, keys, column, list(dict.fromkeys(names.values())), **options)
    picked = [F.max(F.when(F.col("share") == F.lit(float(s)), F.col("value"))).alias(name) for name, s in names.items()]
    return found.groupBy(*keys).agg(*picked, F.max("n").alias("n"))


def average_ranks(values: DataFrame, keys: list[str], column: str, count: str) -> DataFrame:
    """``(keys, column, rank)`` of distinct values with how often each occurs; ties share the average of their places.

    Values are sorted by ranges, so a group may spread over any number of tasks: each counts within its range, and the sums of
    the ranges before it set its counts forward.
    """
    ranged = stored(values.select(*keys, column, F.col(count).alias("c")).repartitionByRange(*keys, column).withColumn("range", F.spark_partition_id()), "ranges")
    before = F.sum("c").over(Window.partitionBy(*keys, "range").orderBy(column)) - F.col("c")
    ahead = F.sum("all").over(Window.partitionBy(*keys).orderBy("range")) - F.col("all")
    offsets = stored(ranged.groupBy(*keys, "range").agg(F.sum("c").alias("all")).select(*keys, "range", ahead.alias("ahead")), "offsets")
    placed = ranged.withColumn("before", before).join(small_side(offsets, 64), [*keys, "range"])
    return placed.select(*keys, column, (F.col("ahead") + F.col("before") + (F.col("c") + 1) / 2).alias("rank"))


def spearman_of_large_groups(pairs: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """``(keys, n, rho)`` over complete pairs, however many a group holds: equal pairs are counted first, ranks come from ranges."""
    whole = pairs.filter(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))
    counted = stored(whole.groupBy(*keys, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("c")), "pairs")
    rank = lambda z: average_ranks(counted.groupBy(*keys, z).agg(F.sum("c").alias("c")), keys, z, "c").withColumnRenamed("rank", f"r{z}")
    middle = small_side(stored(counted.groupBy(*keys).agg(F.sum("c").alias("n")), "sizes"), 64)
    ranked = counted.join(rank("x"), [*keys, "x"]).join(rank("y"), [*keys, "y"]).join(middle, keys)
    a, b = F.col("rx") - (F.col("n") + 1) / 2, F.col("ry") - (F.col("n") + 1) / 2
    sums = ranked.groupBy(*keys).agg(F.max("n").alias("n"), F.sum(F.col("c") * a * b).alias("ab"), F.sum(F.col("c") * a * a).alias("aa"), F.sum(F.col("c") * b * b).alias("bb"))
    return sums.select(*keys, "n", F.when((F.col("aa") > 0) & (F.col("bb") > 0), F.col("ab") / F.sqrt("aa") / F.sqrt("bb")).alias("rho"))
